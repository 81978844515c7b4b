"""Matches and edits of many pairs of short texts at once, as :mod:`difflib` and the edit distance define them."""

from __future__ import annotations

import os
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np

#: Longest text (less a common start) that :func:`matches` takes at once, as a place fits five bits; pairs of a batch.
LONGEST, BATCH = 31, 8192
#: Entries of the table of characters' places in :func:`edits`.
TABLE = 1 << 22
#: Places that the characters of two texts may be equal at, for their matches to be kept by these; those of the last lengths are.
EQUAL = 25
_KNOWN: dict[tuple[int, int, bool], np.ndarray] = {}
_ENDS = (((LONGEST - np.arange(LONGEST))[:, None] << 5) + LONGEST - np.arange(LONGEST)).astype(np.uint16)[:, :, None]


def _codes(names: list[str], alphabet: np.ndarray, skip: int, end: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Lengths behind ``skip`` and characters as places in ``alphabet``, a column a name, filled with ``end``."""
    lengths = np.fromiter(map(len, names), np.int64, len(names)) - skip
    flat = np.frombuffer("".join(n[skip:] for n in names).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full((int(lengths.max(initial=0)), len(names)), end, dtype)
    row = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, np.repeat(np.arange(len(names)), lengths)] = np.searchsorted(alphabet, flat)
    return lengths, out


def _start(names: list[str]) -> int:
    """Length of what all names start with."""
    return len(os.path.commonprefix([min(names), max(names)])) if names else 0


def _start_matches_first(start: str, rest: int) -> bool:
    """Whether of any two texts, ``start`` and up to ``rest`` characters, the longest match is what both start with.

    Another match as long would have to be shifted, and then ``start`` would repeat itself at that shift.
    """
    return rest <= len(start) and all(any(start[k - d] != start[k] for k in range(rest - 1, len(start))) for d in range(1, rest))


def _longest_first(a: np.ndarray, b: np.ndarray, room: np.ndarray, start: bool) -> np.ndarray:
    """Matched characters of the columns of ``a`` and ``b``, longest match first (of equal ones the earliest in a, then b), then beside it.

    Characters carry the number of the part between matches that they lie in, so that all parts are searched together.
    """
    total, alive = np.zeros(a.shape[1], np.int64), np.arange(a.shape[1])
    a, b = a << 5, b << 5
    at_a, at_b = np.arange(len(a), dtype=np.uint16)[:, None], np.arange(len(b), dtype=np.uint16)[:, None]
    if start:
        least = min(len(a), len(b))
        common = np.logical_and.accumulate(a[:least] == b[:least], axis=0)
        total = common.sum(axis=0)
        a[:least][common], b[:least][common] = 0xFFFF, 0xFFDF
    part = np.uint16(0)
    while True:
        on = total[alive] < room[alive]
        alive, a, b = (alive, a, b) if on.all() else (alive[on], a[:, on], b[:, on])
        runs, best, keys = np.zeros((2, len(b) + 1, len(alive)), np.uint16), np.zeros(len(alive), np.uint16), np.empty(b.shape, np.uint16)
        for i in range(len(a)):
            old, new = runs[i % 2], runs[1 - i % 2]
            np.add(old[:-1], 1024, out=new[1:])
            new[1:] *= b == a[i]
            np.add(new[1:], _ENDS[i, : len(b)], out=keys)
            np.maximum(best, keys.max(axis=0, initial=0), out=best)
        on = best >= 1024
        alive, a, b, best = (alive, a, b, best) if on.all() else (alive[on], a[:, on], b[:, on], best[on])
        if not len(alive):
            return total
        size, part = best >> 10, part + np.uint16(1)
        total[alive] += size
        end_a, end_b = LONGEST - ((best >> 5) & 31), LONGEST - (best & 31)
        within = a[end_a, np.arange(len(alive))] & 31
        for codes, at, end, used in ((a, at_a, end_a, 0xFFFF), (b, at_b, end_b, 0xFFDF)):
            behind = (at > end) & ((codes & 31) == within) & (codes < 0xFFC0)
            codes += np.where(behind, part - within, np.uint16(0))
            codes[(at <= end) & (at + size > end)] = used


def _by_equal_places(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, letters: int, start: bool, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``score(i, j)``, once for all pairs that are equal at the same places, as it depends on nothing else."""
    shape = (len(a), len(b), start)
    if shape not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[shape] = np.zeros(1 << (len(a) * len(b)), np.uint8)
    known, names = _KNOWN[shape], a.shape[1]
    places = np.zeros((letters + 1) * names, np.int32)
    for n, row in enumerate(a):
        places[np.minimum(row, letters).astype(np.int64) * names + np.arange(names)] |= 1 << n
    places[letters * names :] = 0
    at, out = np.minimum(b, letters).astype(np.int64) * names, np.empty(len(i), np.int64)
    for k in np.split(np.arange(len(i)), range(BATCH, len(i), BATCH)):
        ik, jk = i[k], j[k]
        code = np.zeros(len(k), np.int32)
        for n in range(len(b)):
            code |= places[at[n][jk] + ik] << (n * len(a))
        got = known[code]
        new = np.flatnonzero(got == 0)
        if len(new):
            codes, first = np.unique(code[new], return_index=True)
            known[codes] = score(ik[new[first]], jk[new[first]]) + 1
            got = known[code]
        out[k] = got.astype(np.int64) - 1
    return out


def matches(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Matched characters of ``SequenceMatcher`` between ``left[i]`` and ``right[j]``."""
    out = np.zeros(len(i), np.int64)
    skip = _start([*left, *right])
    start = skip > 0 and _start_matches_first(left[0][:skip], max(map(len, [*left, *right])) - skip)
    skip = skip if start else 0
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) - skip for x in (left, right))
    short_a, short_b = [n if len(n) - skip <= LONGEST else n[:skip] for n in left], [n if len(n) - skip <= LONGEST else n[:skip] for n in right]
    alphabet = np.unique(np.frombuffer("".join([n[skip:] for n in short_a + short_b]).encode("utf-32-le", "surrogatepass"), "<u4"))
    fits = (la[i] <= LONGEST) & (lb[j] <= LONGEST) & (len(alphabet) < 2046)
    # Texts of 200 characters and more have their own rule for frequent ones.
    fits &= (la[i] + skip < 200) & (lb[j] + skip < 200)
    fast, slow = np.flatnonzero(fits), np.flatnonzero(~fits)
    if len(fast):
        (_, a), (_, b) = _codes(short_a, alphabet, skip, 2047, np.uint16), _codes(short_b, alphabet, skip, 2046, np.uint16)
        score = lambda x, y: _longest_first(a[:, x], b[:, y], np.minimum(la[x], lb[y]), start)
        if len(a) * len(b) <= EQUAL and len(alphabet) * len(left) <= TABLE and len(fast) > BATCH:
            out[fast] = skip + _by_equal_places(a, b, i[fast], j[fast], len(alphabet), start, score)
        else:
            for k in np.split(fast, range(BATCH, len(fast), BATCH)):
                out[k] = skip + score(i[k], j[k])
    for k in slow:
        out[k] = sum(m.size for m in SequenceMatcher(None, left[i[k]], right[j[k]]).get_matching_blocks())
    return out


def edits(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distances of ``left[i]`` and ``right[j]``."""
    out = np.zeros(len(i), np.int64)
    skip = _start([*left, *right])
    alphabet = np.unique(np.frombuffer("".join(n[skip:] for n in [*left, *right]).encode("utf-32-le", "surrogatepass"), "<u4"))
    (la, a), (lb, b) = _codes(left, alphabet, skip, len(alphabet), np.int32), _codes(right, alphabet, skip, len(alphabet) + 1, np.int32)
    # Distances of short texts are kept as bits, if the table of characters' places is small.
    fits = la[i] <= (64 if len(alphabet) * len(left) <= TABLE else -1)
    if fits.all():
        return _edits_in_bits(a, la, b, lb, i, j, len(alphabet))
    fast, slow = np.flatnonzero(fits), np.flatnonzero(~fits)
    if len(fast):
        out[fast] = _edits_in_bits(a[:64], la, b, lb, i[fast], j[fast], len(alphabet))
    out[slow] = _edits_in_rows(a, la, b, lb, i[slow], j[slow], len(alphabet))
    return out


def _edits_in_bits(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, i: np.ndarray, j: np.ndarray, letters: int) -> np.ndarray:
    """Edit distances by Myers's vectors: whether a column of distances rises or falls at each place of a text of up to 64 characters."""
    longest = int(la[i].max(initial=0))
    word = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if longest <= 8 * np.dtype(t).itemsize)
    names, one = a.shape[1], word(1)
    places = np.zeros((letters + 1) * names, word)
    for n, row in enumerate(a[:longest]):
        places[row.astype(np.int64) * names + np.arange(names)] |= one << word(n)
    places[letters * names :] = 0
    at = np.minimum(b, letters).astype(np.int64) * names
    out, every = np.zeros(len(i), np.int64), word(np.iinfo(word).max)
    used = np.where(la >= 8 * np.dtype(word).itemsize, every, (one << np.minimum(la, 8 * np.dtype(word).itemsize - 1).astype(word)) - one).astype(word)
    order = np.argsort(lb[j], kind="stable") if len(set(lb.tolist())) > 1 else np.arange(len(j))
    for k in np.split(order, range(2 * BATCH, len(order), 2 * BATCH)):
        ik, jk, mask = i[k], j[k], used[i[k]]
        nb = lb[jk]
        rise, fall = np.full(len(k), every), np.zeros(len(k), word)
        out[k] = la[ik]
        ends = set(nb.tolist()) if len(k) and nb[0] != nb[-1] else {int(x) for x in nb[:1]}
        for n in range(int(nb.max(initial=0))):
            same = places[at[n][jk] + ik]
            down = same & rise
            down += rise
            down ^= rise
            down |= same
            same |= fall
            up = down | rise
            np.invert(up, out=up)
            up |= fall
            down &= rise
            up <<= one
            up |= one
            down <<= one
            np.bitwise_or(same, up, out=rise)
            np.invert(rise, out=rise)
            rise |= down
            np.bitwise_and(up, same, out=fall)
            if n + 1 in ends:
                done = np.flatnonzero(nb == n + 1) if len(ends) > 1 else slice(None)
                out[k[done]] = n + 1 + np.bitwise_count(rise[done] & mask[done]).astype(np.int64) - np.bitwise_count(fall[done] & mask[done])
    return out


def _edits_in_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, i: np.ndarray, j: np.ndarray, letters: int) -> np.ndarray:
    """Edit distances of texts of any length, row by row."""
    out = np.zeros(len(i), np.int64)
    a, b = (x.astype(np.uint8 if letters < 254 else np.int32) for x in (a, b))
    kind = np.int8 if len(a) + len(b) < 120 else np.int32
    order = np.argsort(np.maximum(la[i], lb[j]), kind="stable")
    size = max(64, min(BATCH, BATCH * 32 // (len(b) + 1)))
    for k in np.split(order, range(size, len(order), size)):
        na, nb = la[i[k]], lb[j[k]]
        ca, cb = a[: na.max(initial=0), i[k]], b[: nb.max(initial=0), j[k]]
        # Distances less their column, so that insertions are a running least value.
        row = np.zeros((len(cb) + 1, len(k)), kind)
        out[k] = nb
        for n in range(len(ca)):
            new = np.empty_like(row)
            new[0] = n + 1
            np.subtract(row[:-1], cb == ca[n], out=new[1:], casting="unsafe")
            np.minimum(new[1:], row[1:] + 1, out=new[1:])
            row = np.minimum.accumulate(new, axis=0)
            done = np.flatnonzero(na == n + 1)
            out[k[done]] = row[nb[done], done] + nb[done]
    return out
