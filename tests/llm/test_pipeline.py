"""The pipeline against a brute-force version, stage by stage."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from test_near_copies import _kept
from test_operators import _check_packing

import corpus_pipeline
from graphwright.llm import langid, secrets

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(docs)
    judged = [(r, *model.predict(pa.array([r.text]))) for r in docs.collect()]
    rows = [r for r, names, scores in judged if names[0] != "und" and scores[0] >= langid.LEAST_SCORE]
    kept = corpus_pipeline.language(spark, docs, DIR)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows}
    stay = set(_kept([(r.doc_id, r.text) for r in rows]))
    rows = [r for r in rows if r.doc_id in stay]
    kept = corpus_pipeline.near_dedup(spark, kept, DIR)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows)
    masked = corpus_pipeline.mask_secrets(spark, kept, DIR)
    words = secrets.words_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = {r.doc_id: secrets.mask(r.text, words) for r in rows}
    assert {r.doc_id: r.text for r in masked.collect()} == texts
    used, least = _check_packing(corpus_pipeline.packed(spark, masked, DIR).collect(), list(texts.items()))
    assert used <= least + 1


def test_run_and_odd_documents(spark, tmp_path):
    result = corpus_pipeline.run(spark, DIR)
    assert result.count() > 0 and [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "secrets", "packing"]
    rows = [(1, "Same words in this text here", "en", "s", 28), (1, "Same words in this text here", "en", "s", 28), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "token=abcdef0123456789xyz of words", None, None, None)]
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(folder)).collect()
    assert sorted(r.doc_id for r in out) == [1, 4]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
