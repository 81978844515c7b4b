"""Best-fit packing of tokenised documents into fixed sequences by minimum bin slack.

A document is its token ids plus a terminator (id 0).  Only documents longer than
a sequence are cut: the last pieces are full, the first may be shorter.

Planning works on the histogram of piece lengths, at most ``CAPACITY`` numbers
however many documents there are.  Each step takes the longest remaining piece,
runs a bitset subset-sum programme over the available lengths, and removes the
combination that fills the sequence most; a combination is reused as long as the
counts last, so there are at most as many steps as lengths.  Pieces get their
place by rank within their length: ranks are computed in cells by the hash of a row
number, so no length (and no group of equal documents or ids) is ever sorted in one task.

Defined results: null text counts as empty and is packed as its terminator alone;
ties and repeated rows are packed as separate pieces; an empty table gives no
rows; other columns are ignored; very long texts are tokenised in blocks cut
where the tokeniser cannot join.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm.arrow import map_small
from graphwright.plans.durable import durable
from graphwright.plans.ranking import gapless_rank

CAPACITY = 2048
CELLS = 1024
#: Characters of one text that are encoded at a time.
TEXT_BLOCK = 1 << 18


class Encoder:
    """Token ids of the byte-level BPE file ``path`` (``tokenizers`` format).

    The ids are those of ``tokenizers`` with ``add_special_tokens=False``, which reads
    the strings of special tokens inside a text as those tokens.  Where the same
    vocabulary lies beside the file as ranks (``.tiktoken``), the faster encoder of the
    two takes texts without such strings, if it agrees on a probe when it is loaded;
    a text on which it fails goes to the other.
    """

    _PROBE = "It's 12 cafés,\n\n  naïve\tß  ... don't stop <|end| 漢字 \r\n x"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
            if fast.encode_ordinary(self._PROBE) == self._slow_ids(self._PROBE):
                self.fast = fast

    def _slow_ids(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    def _ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as error:  # noqa: BLE001 - the native code reports exhausted matching as a panic
                if isinstance(error, KeyboardInterrupt | SystemExit):
                    raise
        return self._slow_ids(text)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text as little-endian unsigned 32-bit numbers."""
        parts = [np.array(self._ids(part), "<u4") for part in safe_blocks(text or "")]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "<u4"), *parts])


def safe_blocks(text: str, size: int = TEXT_BLOCK) -> Iterator[str]:
    """Consecutive parts, cut only before one space between two other characters: no token spans that place."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while 0 <= cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: every document with its terminator, cut where it is too long."""

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py()), np.uint32(0)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_small(source, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most ``room`` (longer lengths first in ties)."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """``(combination, sequences that use it)`` until all pieces are placed; a combination maps lengths to pieces."""
    counts, plan = dict(histogram), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        use = fullest(counts, capacity - longest) if longest < capacity else {}
        counts[longest] += 1
        use[longest] = use.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in use.items())
        for n, k in use.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        plan.append((use, times))
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, pieces a sequence, first sequence, first offset), by rank."""
    places: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for use, times in plan:
        offset = 0
        for length in sorted(use, reverse=True):
            places.setdefault(length, []).append((ranks.get(length, 0), use[length], sequence, offset))
            ranks[length] = ranks.get(length, 0) + use[length] * times
            offset += use[length] * length
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in places.items()}


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to materialised pieces with a ``row`` number."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(plan_bins(histogram, capacity))
    cells = cut.withColumn("__cell", F.pmod(F.xxhash64("row"), F.lit(CELLS)).cast("int")).drop("row")
    ranked = gapless_rank(cells, ["length"], "__cell", ["doc_id", "piece", "ids_crc32"], "__rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("__rank").alias("rank"))

    def run(batches):
        for batch in batches:
            lengths, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                rows = places[int(length)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                step = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + step // row[:, 1]
                offset[own] = row[:, 3] + step % row[:, 1] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return assign(durable(pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity)
