"""Language identification with a string kernel.

Kernel: blended spectrum with presence features.  A text is the *set* of its
byte n-grams of lengths 1 to ``ORDERS`` (A-Z lower-cased), hashed to ``DIMS``
places; k(x, z) = |x & z| / sqrt(|x| |z|).  A Nystroem map over landmark texts
feeds one-versus-rest kernel ridge regression,

    (K_mn K_nm + ridge K_mm) A = K_mn Y,      scores(x) = k(x, landmarks) A.

k(x, landmarks) A = P(x) (P(landmarks)' D A) / sqrt|x| with P the presence rows,
so a batch is scored by one matrix product with the places x languages matrix
on the right; it is the same number, computed in the other order.

The fit uses a bounded, documented sample: ``PER_LANGUAGE`` labelled rows of each
language (those of least hash of their id; ``SAMPLE`` in all), of which ``LANDMARKS`` in all serve as
landmarks; it is spread over languages, so that a hot one does not crowd out others.  Every label
with a row outside the fold is learned, however rare: only the rows are bounded, and the sample and
the landmarks grow to one row a label where there are more labels than either.

Defined results: null text or a text without any letter is ``und`` with score 0;
ties go to the language that sorts first; repeated rows get equal answers; without
labelled rows every text is ``und``; an empty table gives no rows; only ``doc_id``
(fold) and ``lang`` of training rows are read besides the text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.llm.arrow import flat_bytes, map_small

ORDERS = 4
DIMS = 1 << 15
PER_LANGUAGE = 300
#: Rows of the sample in all; many languages share it evenly, and each keeps one at least.
SAMPLE = 4096
LANDMARKS = 256
RIDGE = 1.0
UNKNOWN = "und"
#: Score from which a text counts as identified: the predicted language outweighs all others together.  On sf0.01 the
#: least score of a held-out document is 0.66; junk, digits, random letters and unlearned scripts score at most 0.35.
LEAST_SCORE = 0.5
#: Bytes of text whose n-grams are hashed at a time.
TEXT_BLOCK = 1 << 19
#: Rows whose presence bits are held at a time.
ROWS = 64

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_MIX = np.uint32(0x9E3779B1)


def presence(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x DIMS booleans: the hashed n-gram sets of the texts flat[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    seen = np.zeros(n * DIMS, bool)
    for start in range(0, len(flat), TEXT_BLOCK):
        end = min(len(flat), start + TEXT_BLOCK + ORDERS - 1)
        part = _FOLD[flat[start:end]]
        row = np.searchsorted(offsets, np.arange(start, end), side="right") - 1
        gram = np.zeros(len(part), np.uint32)
        for order in range(1, ORDERS + 1):
            size = len(part) - order + 1
            if size <= 0:
                break
            gram = (gram[:size] << np.uint32(8)) | part[order - 1 :]
            place = ((gram + np.uint32(order)) * _MIX) >> np.uint32(32 - 15)
            place ^= place >> np.uint32(7)
            inside = row[:size] == row[order - 1 :] if order > 1 else slice(None)
            seen[(row[:size] * DIMS + (place & np.uint32(DIMS - 1)))[inside]] = True
    return seen.reshape(n, DIMS)


def has_letter(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    ascii_ = np.concatenate([[0], np.cumsum(_LETTER[flat])])
    found = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~found):
        text = flat[offsets[i] : offsets[i + 1]].tobytes()
        found[i] = bool(text) and any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return found


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # DIMS x languages

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        flat, offsets = flat_bytes(column)
        letters = has_letter(flat, offsets)
        best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
        if self.languages:
            for at in range(0, len(column), ROWS):
                part = offsets[at : at + ROWS + 1]
                bits = presence(flat[part[0] : part[-1]], part - part[0])
                size = np.maximum(np.count_nonzero(bits, axis=1), 1)
                values = (bits.astype(np.float32) @ self.weights).astype(np.float64) / np.sqrt(size)[:, None]
                best[at : at + ROWS] = values.argmax(axis=1)
                odds = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
                score[at : at + ROWS] = 1 / odds.sum(axis=1)
        else:
            letters[:] = False
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def fit_rows(packed: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit from packed presence rows; labels beside them."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model((), np.zeros((DIMS, 0), np.float32))
    place = {language: i for i, language in enumerate(languages)}
    of = np.array([place[label] for label in labels])
    share = np.bincount(of)
    order = np.argsort(of, kind="stable")
    rank = np.empty(len(labels), np.int64)
    rank[order] = np.arange(len(labels)) - (np.cumsum(share) - share)[of[order]]
    # Landmarks go round the labels; there is one of every label at least.
    marks = np.lexsort((of, rank))[: max(landmarks, len(languages))]

    def unit(rows) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(b"".join(packed[i] for i in rows), np.uint8).reshape(-1, DIMS // 8), axis=1)
        return bits.astype(np.float32) / np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)[:, None]

    basis = unit(marks)
    k_nm = np.concatenate([unit(range(at, min(at + ROWS, len(packed)))) @ basis.T for at in range(0, len(packed), ROWS)]).astype(np.float64)
    k_mm = k_nm[marks]
    target = np.full((len(labels), len(languages)), -1.0)
    target[np.arange(len(labels)), of] = 1.0
    weight = (1.0 / share[of])[:, None] * len(labels) / len(languages)
    alpha = np.linalg.lstsq(k_nm.T @ (weight * k_nm) + ridge * k_mm, k_nm.T @ (weight * target), rcond=1e-9)[0]
    return Model(languages, basis.T @ alpha.astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's text divisible by 5 (null id: held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from a bounded sample of the rows with a label outside the held-out fold."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = ids.groupBy(F.col("lang").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    languages = sizes.count()
    if not languages:
        return fit_rows([], [])
    per_language = max(1, min(per_language, SAMPLE // languages))
    # A hash threshold leaves about four times the sample of each language, whatever its size; the window only trims it.
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    below = F.floor(F.lit(float(4 * per_language << 40)) / F.col("__n")) + 1
    # One row a label: every label is learned, and the model has a column for each.
    chosen = ids.join(F.broadcast(sizes), F.col("lang") == F.col("__of")).where(draw < below).select("doc_id", "lang").distinct()
    place = Window.partitionBy("lang").orderBy(draw, "doc_id")
    chosen = chosen.withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_language)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    texts = texts.join(chosen, (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("doc_id", "lang", "text")

    def pack(batches):
        for batch in batches:
            flat, offsets = flat_bytes(batch.column(2))
            rows = [
                np.packbits(presence(flat[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0]).tobytes()
                for i in range(batch.num_rows)
            ]
            keep = pa.array(has_letter(flat, offsets))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "lang", "bits"]
            )
            yield out.filter(keep)

    # Repeated rows of a chosen id add nothing: one row an id and language, so the sample stays bounded.
    sample = map_small(texts, pack, "doc_id long, lang string, bits binary")
    rows = sample.groupBy("lang", "doc_id").agg(F.min("bits").alias("bits")).collect()
    rows.sort(key=lambda r: (r["lang"], zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return fit_rows([bytes(r["bits"]) for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``."""
    model = model or fit(docs)

    def run(batches):
        for batch in batches:
            names, scores = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
            )

    found = map_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, model: Model | None = None) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, whose text has an identified language with at least that score.

    Without a trainable labelled row there is no evidence against any text: all rows with a letter stay.
    """
    model = model or fit(docs)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if not model.languages:
                yield batch.filter(pa.array(has_letter(*flat_bytes(batch.column(place)))))
                continue
            names, scores = model.predict(batch.column(place))
            keep = [name != UNKNOWN and score >= least for name, score in zip(names, scores, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_small(docs, run, docs.schema)
