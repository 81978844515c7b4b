"""SentencePiece encoding and decoding: several distinct sampled segmentations of a text.

The vocabulary spans a lattice over the text (one unsplittable stretch is a run of
spaces with the word behind it, because no piece joins a word with a space behind
it).  A piece weighs log(1 / (rank + 2.7) / H), a Zipf law over the merge ranks; a
character outside the vocabulary is spelt in byte pieces.  Backward sums
(raised to the power ``ALPHA``) normalise the lattice, so a segmentation's probability is the product of its
steps'.

Sampling without replacement is Gumbel top-k as an A* search over perturbed
bounds: the set of all segmentations has one Gumbel variable; drawing the best
segmentation of a set splits the rest of the set by the first word in which
another choice is made, each part with its own Gumbel variable, truncated at the
set's.  The next sample is the best of the part with the highest bound, so
samples come in order of their perturbed scores and are distinct by
construction.  The bound of the first part left over is the threshold of the
inclusion scores, 1 - exp(-exp(log_prob - threshold)).

All draws are hashes of (row key, sample, word, step): a row's samples do not
depend on its batch, partition or neighbours.

Defined results: null text counts as empty; an empty text has one segmentation,
without pieces; texts with fewer segmentations than samples return all of them,
with inclusion 1; whole texts are sampled, however long (memory is proportional to
the longest text); repeated rows are sampled alike; a null key counts as 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.arrow import map_small

SAMPLES = 2
#: Exponent of the pieces' weights: 1 samples the model itself, smaller values flatten it (subword regularisation).
ALPHA = 0.25
#: Characters of text whose words are walked together.
TEXT_BLOCK = 1 << 20
#: Lattice edges kept for reuse; the store is emptied beyond that.
STORE_EDGES = 4_000_000
SPACE = "▁"
#: Stands for a "▁" of the text itself inside the lattice: above every code point, so that no text holds it.
_PLAIN_SPACE_MARK = 0x110000
_GOLDEN, _WORD = 0x9E3779B97F4A7C15, 2**64 - 1
#: Slots (a power of two) of the table of pieces and their beginnings, and the multiplier of its rolling hash.
SLOT_BITS = 19
_ROLL = np.uint64(0x100000001B3)
_STRETCH = re.compile(" *[^ ]+| +")
_NONE = -math.inf


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seed: np.ndarray, *parts) -> np.ndarray:
    """Uniform numbers in (0, 1) that are a hash of their arguments."""
    x = seed
    for part in parts:
        if isinstance(part, int):
            step = np.uint64(_GOLDEN * (part + 1) & _WORD)
        else:
            step = np.uint64(_GOLDEN) * (part.astype(np.uint64) + np.uint64(1))
        x = _mix(x + step)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class _Numbers(dict):
    """Consecutive numbers of keys, given on first sight."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Lattice:
    """Lattices of stretches over one vocabulary, in shared arrays."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.weight_of = np.zeros(size)
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.spelling: list[bytes] = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelling[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece joins a word with the space behind it")
                self.ids[piece] = i
                self.spelling[i] = piece.replace(SPACE, " ").encode()
        ranked = sorted(self.ids.values())
        self.weight_of[ranked] = -alpha * np.log((np.arange(len(ranked)) + 2.7) * math.log(len(ranked) + 2.7))
        self.byte_weight = -alpha * math.log((len(ranked) + 2.7) * math.log(len(ranked) + 2.7))
        self._table({**{piece[:n]: -1 for piece in self.ids for n in range(1, len(piece) + 1)}, **self.ids})
        self.longest = max(map(len, self.ids))
        self.unknown: dict[int, int] = {}  # character: place of its byte pieces
        self.spelt: list[tuple[int, ...]] = []  # byte pieces of unknown characters; piece is -2 - place
        self.store = [np.empty(1 << 16), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32), np.empty(1 << 16)]
        self.starts = np.zeros(1 << 16, np.int64)  # first edge of every node, and the end
        self.clear()

    def clear(self) -> None:
        """Forget all stretches; the arrays stay to be filled again."""
        self.types, self.node_of = _Numbers(), np.zeros(0, np.int64)
        self.n_edges = self.n_nodes = 0

    def _table(self, known: dict[str, int]) -> None:
        """Open-addressing table of the hashes of ``known`` strings (value: piece, -1 for a mere beginning)."""
        self.slots, self.values = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -2, np.int32)
        for text, value in known.items():
            h = 0
            for c in text:
                h = ((h ^ ord(c)) * int(_ROLL) + 0x9E37) & _WORD
            key = int(_mix(np.array([h], np.uint64))[0])
            slot = key >> (64 - SLOT_BITS)
            while self.values[slot] != -2:
                if int(self.slots[slot]) == key:
                    raise ValueError("two pieces share a hash")
                slot = (slot + 1) % (1 << SLOT_BITS)
            self.slots[slot], self.values[slot] = key, value

    def _find(self, rolled: np.ndarray) -> np.ndarray:
        """Values of rolling hashes: a piece, -1 for a beginning, -2 for neither."""
        keys = _mix(rolled)
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.values[slot]
        wrong = np.flatnonzero((out != -2) & (self.slots[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % (1 << SLOT_BITS)
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(out[wrong] != -2) & (self.slots[slot[wrong]] != keys[wrong])]
        return out

    def _spell(self, char: int) -> int:
        """The piece number (-2 or less) that stands for the byte pieces of an unknown character."""
        place = self.unknown.get(char)
        if place is None:
            place = self.unknown[char] = len(self.spelt)
            raw = (SPACE if char == _PLAIN_SPACE_MARK else chr(char)).encode("utf-8", "surrogatepass")
            self.spelt.append(tuple(self.byte_ids[b] for b in raw))
        return -2 - place

    def add(self, stretches: list[str]) -> np.ndarray:
        """Build the lattices of stretches (spaces still plain); their first nodes."""
        chars = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4")
        chars = np.where(chars == ord(SPACE), np.uint32(_PLAIN_SPACE_MARK), np.where(chars == 32, np.uint32(ord(SPACE)), chars))
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(chars))
        # Nodes are numbered by what is left of their stretch, so that backward sums run over contiguous layers.
        order = np.argsort(left.astype(np.uint16) if lengths.max() < 65536 else left, kind="stable")
        node = np.empty(len(chars), np.int64)
        node[order] = np.arange(len(chars))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at, rolled = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for size in range(1, self.longest + 1):
            if size > 1:
                more = left[at] >= size
                at, rolled = at[more], rolled[more]
            rolled = (rolled ^ chars[at + size - 1].astype(np.uint64)) * _ROLL + np.uint64(0x9E37)
            value = self._find(rolled)
            hit = value >= 0
            who, piece = at[hit], value[hit]
            if size == 1:
                odd = np.flatnonzero(~hit)
                if len(odd):
                    who = np.concatenate([who, at[odd]])
                    piece = np.concatenate([piece, np.array([self._spell(int(c)) for c in chars[at[odd]]], np.int32)])
            found.append((who, piece))
            more = value != -2
            at, rolled = at[more], rolled[more]
        counts = np.zeros(len(chars), np.int64)
        for who, _ in found:
            counts[node[who]] += 1
        first = np.concatenate([[0], np.cumsum(counts)])
        total, used = int(first[-1]), first[:-1].copy()
        piece, target, weight = np.empty(total, np.int32), np.empty(total, np.int64), np.empty(total)
        for size in range(len(found), 0, -1):  # the longest, mostly the likeliest, first
            who, value = found[size - 1]
            place = used[node[who]]
            used[node[who]] += 1
            piece[place] = value
            last = left[who] == size
            target[place] = np.where(last, -1, node[np.minimum(who + size, len(chars) - 1)])
            weight[place] = np.where(value >= 0, self.weight_of[np.maximum(value, 0)], self.byte_weight)
        odd = np.flatnonzero(piece < 0)
        weight[odd] *= [len(self.spelt[-2 - p]) for p in piece[odd].tolist()]
        back = np.zeros(len(chars) + 1)  # the last entry is the end of every stretch
        layers = np.flatnonzero(np.r_[True, np.diff(left[order]) > 0, True])
        for a, b in zip(layers, layers[1:], strict=False):
            lo, hi = first[a], first[b]
            value = weight[lo:hi] + back[target[lo:hi]]
            inner = first[a:b] - lo
            top = np.maximum.reduceat(value, inner)
            back[a:b] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts[a:b])), inner))
        logp = weight + back[target] - np.repeat(back[:-1], counts)
        logp[np.repeat(counts == 1, counts)] = 0.0
        share = np.exp(logp)
        cum = np.cumsum(share)
        cum -= np.repeat(cum[first[:-1]] - share[first[:-1]], counts)
        cum[first[1:] - 1] = 2.0
        self._keep(cum, np.where(target < 0, -1, target + self.n_nodes), piece, logp, first)
        begin = self.n_nodes + node[ends - lengths]
        self.n_nodes += len(chars)
        self.n_edges += total
        return begin

    def _keep(self, *parts: np.ndarray) -> None:
        """Append edges and node starts to the store, which doubles as needed."""
        end = self.n_edges + len(parts[0])
        for i, part in enumerate(parts[:4]):
            if end > len(self.store[i]):
                self.store[i] = np.concatenate([self.store[i], np.empty(max(end, len(self.store[i])), self.store[i].dtype)])
            self.store[i][self.n_edges : end] = part
        nodes = self.n_nodes + len(parts[4])
        if nodes > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(nodes, len(self.starts)), np.int64)])
        self.starts[self.n_nodes : nodes] = parts[4] + self.n_edges

    @property
    def arrays(self):
        return (*self.store, self.starts)

    def nodes(self, stretches: list[str]) -> np.ndarray:
        """First nodes of the stretches."""
        if self.n_edges > STORE_EDGES:
            self.clear()
        known = len(self.types)
        numbers = np.fromiter(map(self.types.__getitem__, stretches), np.int64, len(stretches))
        if len(self.types) > known:
            self.node_of = np.concatenate([self.node_of, self.add(list(islice(self.types, known, None)))])
        return self.node_of[numbers]

    def walk(self, node: np.ndarray, base: np.ndarray):
        """Sample every stretch with its seed: pieces in order, pieces a stretch, log-probability a stretch."""
        cum, following, piece, logp, first = self.arrays
        logs, counts = np.zeros(len(node)), np.zeros(len(node), np.int64)
        live, at, who, what, step = np.arange(len(node)), node, [], [], 0
        while len(live):
            u = _uniform(base[live], step)
            edge = first[at]
            behind = np.flatnonzero(cum[edge] <= u)
            while len(behind):
                edge[behind] += 1
                behind = behind[cum[edge[behind]] <= u[behind]]
            logs[live] += logp[edge]
            counts[live] += 1
            who.append(live)
            what.append(piece[edge])
            at = following[edge]
            more = at >= 0
            live, at, step = live[more], at[more], step + 1
        begin = np.concatenate([[0], np.cumsum(counts)])
        pieces = np.empty(begin[-1], np.int32)
        for step, (rows, found) in enumerate(zip(who, what, strict=True)):
            pieces[begin[rows] + step] = found
        return pieces, begin, logs

    def walk_unseen(self, node: int, seen: list[tuple[int, ...]], uniforms) -> tuple[list[int], float]:
        """One segmentation of a stretch that is not in ``seen``, drawn in proportion to its probability; its log-probability."""
        _, following, piece, logp, first = self.arrays
        path, total, prefix = [], 0.0, seen
        while node >= 0:
            edges = range(first[node], first[node + 1])
            mass = []
            for e in edges:
                taken = sum(self._rest(p, len(path) + 1, following[e]) for p in prefix if p[len(path)] == piece[e])
                mass.append(math.exp(logp[e]) * max(0.0, 1.0 - taken))
            u, pick = next(uniforms) * sum(mass), len(mass) - 1
            for k, m in enumerate(mass):
                if u < m:
                    pick = k
                    break
                u -= m
            while not mass[pick]:
                pick -= 1
            edge = first[node] + pick
            prefix = [p for p in prefix if p[len(path)] == piece[edge]]
            path.append(int(piece[edge]))
            total += float(logp[edge])
            node = int(following[edge])
        return path, total

    def _rest(self, path: tuple[int, ...], at: int, node: int) -> float:
        """Probability of the rest of ``path`` from ``node`` on."""
        _, following, piece, logp, first = self.arrays
        total = 0.0
        while node >= 0:
            edge = first[node]
            while piece[edge] != path[at]:
                edge += 1
            total += logp[edge]
            node, at = following[edge], at + 1
        return math.exp(total)

    def ids_of(self, pieces: np.ndarray) -> np.ndarray:
        """Piece ids with unknown characters spelt in byte pieces."""
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces.astype("<u4")
        parts, at = [], 0
        for i in odd.tolist():
            parts += [pieces[at:i], np.array(self.spelt[-2 - int(pieces[i])])]
            at = i + 1
        return np.concatenate([*parts, pieces[at:]]).astype("<u4")

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        raw = b"".join(map(self.spelling.__getitem__, ids))
        return raw[1:].decode("utf-8", "surrogatepass")


@dataclass
class Sample:
    rank: int
    ids: np.ndarray
    log_prob: float
    perturbed: float
    inclusion: float


@dataclass
class _Drawn:
    pieces: np.ndarray
    begin: np.ndarray  # of every stretch, and the end
    logs: np.ndarray
    score: float


def _truncated(location: np.ndarray, top, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location``, each conditioned on being at most ``top``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = location - np.logaddexp(location - top, np.log(-np.log(u)))
    return np.where(np.isneginf(location), _NONE, np.minimum(out, top))


def _left_over(logs: np.ndarray) -> np.ndarray:
    """log(1 - exp(logs)), minus infinity where nothing is left."""
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(-np.expm1(np.minimum(logs, 0.0)), 0.0))


class Sampler:
    """Distinct segmentations of a batch of texts."""

    def __init__(self, lattice: Lattice, samples: int = SAMPLES):
        self.lattice, self.samples = lattice, samples

    def run(self, keys: list[int], texts: list[str]) -> list[list[Sample]]:
        """Up to ``samples`` samples of every text, best perturbed score first."""
        words = [_STRETCH.findall(" " + t) if t else [] for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        node = self.lattice.nodes([s for w in words for s in w])
        seeds = _mix(np.array([k & (2**64 - 1) for k in keys], np.uint64) + np.uint64(0x632BE59BD9B4E019))
        u = _uniform(seeds, 1 << 40)
        drawn: list[list[_Drawn]] = [[] for _ in texts]
        # Parts of a text's segmentations that are not yet drawn from: (bound, sample, stretch, seen).
        parts: list[list[tuple]] = [[] for _ in texts]
        todo = [(d, 0, -1, float(-np.log(-np.log(u[d])))) for d in range(len(texts))]
        for rank in range(self.samples):
            self._draw(rank, todo, node, bounds, seeds, drawn, parts)
            todo = []
            for d, own in enumerate(parts):
                if rank + 1 < self.samples and own and len(drawn[d]) == rank + 1:
                    best = max(range(len(own)), key=lambda i: own[i][0])
                    if own[best][0] > _NONE:
                        bound, sample, word, seen = own.pop(best)
                        todo.append((d, sample, word, bound, seen))
        out = []
        for d, found in enumerate(drawn):
            threshold = max((p[0] for p in parts[d]), default=_NONE)
            rows = []
            for rank, s in enumerate(found):
                log_prob = float(s.logs.sum())
                # Beyond e^700 of odds the score is 1 to the last digit.
                included = 1.0 if threshold == _NONE else -math.expm1(-math.exp(min(log_prob - threshold, 700.0)))
                rows.append(Sample(rank, self.lattice.ids_of(s.pieces), log_prob, s.score, included))
            out.append(rows)
        return out

    def _draw(self, rank, todo, node, bounds, seeds, drawn, parts) -> None:
        """Draw the best segmentation of each listed part and add what is left of the part."""
        heads = []
        for item in todo:
            if rank == 0:
                heads.append((item[0], 0, None, item[3]))
                continue
            d, sample, word, bound, seen = item
            uniforms = iter_uniforms(int(seeds[d]), rank, word)
            path, logp = self.lattice.walk_unseen(int(node[bounds[d] + word]), seen, uniforms)
            heads.append((d, word + 1, (sample, word, seen, path, logp), bound))
        sizes = np.array([bounds[d + 1] - bounds[d] - start for d, start, _, _ in heads], np.int64)
        if not len(sizes):
            return
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(heads)), sizes)
        doc = np.array([h[0] for h in heads])[owner]
        word = np.arange(ends[-1]) - (ends - sizes)[owner] + np.array([h[1] for h in heads])[owner]
        base = _mix(seeds[doc] + np.uint64(_GOLDEN * (rank + 1) & _WORD))
        base = _mix(base + np.uint64(0xD1B54A32D192ED03) * (word.astype(np.uint64) + np.uint64(1)))
        pieces, begin, logs = self.lattice.walk(node[bounds[doc] + word], base)
        u = _uniform(base, 1 << 41)
        # A stretch's part is located at the probability of what stands before it times what the stretch leaves over.
        total = np.concatenate([[0.0], np.cumsum(logs)])
        ahead = [0.0 if h[2] is None else float(drawn[h[0]][h[2][0]].logs[: h[2][1]].sum()) + h[2][4] for h in heads]
        location = np.repeat(np.array(ahead) - total[ends - sizes], sizes) + total[:-1] + _left_over(logs)
        bounds_ = np.repeat(np.array([h[3] for h in heads]), sizes)
        everything = _truncated(location, bounds_, u)
        for h, (d, start, head, bound) in enumerate(heads):
            a, b = ends[h] - sizes[h], ends[h]
            own = _Drawn(pieces[begin[a] : begin[b]], begin[a : b + 1] - begin[a], logs[a:b], bound)
            if head is not None:
                parent, at, seen, path, logp = drawn[d][head[0]], *head[1:]
                before = float(parent.logs[:at].sum())
                seen = [*seen, tuple(path)]
                left = 1.0 - sum(self.lattice._rest(p, 0, int(node[bounds[d] + at])) for p in seen)
                if left > 1e-12:
                    v = _uniform(seeds[d : d + 1], rank, at, 1 << 42)
                    parts[d].append((float(_truncated(np.array([before + math.log(left)]), bound, v)[0]), len(drawn[d]), at, seen))
                cut = int(parent.begin[at])
                own = _Drawn(
                    np.concatenate([parent.pieces[:cut], path, own.pieces]).astype(np.int32),
                    np.concatenate([parent.begin[: at + 1], cut + len(path) + own.begin]),
                    np.concatenate([parent.logs[:at], [logp], own.logs]),
                    bound,
                )
            values = everything[a:b]
            # Only the parts that can still be drawn or set the threshold are kept.
            keep = min(self.samples - rank, len(values))
            for i in np.argpartition(-values, keep - 1)[:keep] if keep else ():
                if values[i] > _NONE:
                    w = start + int(i)
                    path = tuple(int(p) for p in own.pieces[own.begin[w] : own.begin[w + 1]])
                    parts[d].append((float(values[i]), len(drawn[d]), w, [path]))
            drawn[d].append(own)


def _mix_word(x: int) -> int:
    """:func:`_mix` of one word, without an array."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WORD
    return x ^ (x >> 31)


def iter_uniforms(seed: int, rank: int, word: int):
    """Uniform numbers for the pieces of one stretch."""
    base = _mix_word(_mix_word(seed + _GOLDEN * (rank + 1) & _WORD) + _GOLDEN * (word + 1) & _WORD)
    step = 1 << 43
    while True:
        step += 1
        yield ((_mix_word(base + _GOLDEN * step & _WORD) >> 11) + 0.5) * 2.0**-53


_OUT = "key long, sample int, ids array<long>, log_prob double, perturbed double, inclusion double, round_trip boolean"


def sample_segmentations(rows: DataFrame, model: str, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``(key, sample, ids, log_prob, perturbed, inclusion, round_trip)``, one row per sampled segmentation."""
    return _sampled(rows, model, key, text, samples, False)


def segmentation_digests(rows: DataFrame, model: str, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """As :func:`sample_segmentations`, with ``n_ids`` and ``ids_crc32`` (little-endian unsigned 32-bit ids) in place of ``ids``."""
    return _sampled(rows, model, key, text, samples, True)


def _sampled(rows: DataFrame, model: str, key: str | Column, text: str, samples: int, digest: bool) -> DataFrame:
    def emit(lattice: Lattice, keys: list, texts: list[str]):
        found = Sampler(lattice, samples).run([k or 0 for k in keys], texts)
        flat = [(k, t, s) for k, t, group in zip(keys, texts, found, strict=True) for s in group]
        columns = [pa.array([k for k, _, _ in flat], pa.int64()), pa.array([s.rank for _, _, s in flat], pa.int32())]
        names = ["key", "sample"]
        if digest:
            columns += [pa.array([len(s.ids) for _, _, s in flat], pa.int64()), pa.array([zlib.crc32(s.ids.tobytes()) for _, _, s in flat], pa.int64())]
            names += ["n_ids", "ids_crc32"]
        else:
            columns.append(pa.array([s.ids.astype(np.int64) for _, _, s in flat], pa.list_(pa.int64())))
            names.append("ids")
        columns += [pa.array([getattr(s, c) for _, _, s in flat], pa.float64()) for c in ("log_prob", "perturbed", "inclusion")]
        columns.append(pa.array([lattice.decode(s.ids.tolist()) == t for _, t, s in flat], pa.bool_()))
        return pa.RecordBatch.from_arrays(columns, names=[*names, "log_prob", "perturbed", "inclusion", "round_trip"])

    def run(batches):
        lattice = Lattice(model)
        for batch in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = t.as_py() or ""
                keys.append(k)
                texts.append(value)
                size += len(value)
                if size >= TEXT_BLOCK:
                    yield emit(lattice, keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield emit(lattice, keys, texts)

    out = _OUT.replace("ids array<long>", "n_ids long, ids_crc32 long") if digest else _OUT
    source = rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_small(source, run, out).withColumnRenamed("key", key)
