"""Byte-level kernels on numpy arrays: seeds, checksums, mismatch counts, alignments, codecs.

They work on one Arrow batch at a time; everything relational is left to DataFrames.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

# The polynomial hash, its start, the finaliser and FNV-1a.
ROLL_BASE = 1_099_511_628_211
ROLL_SEED = 0x9E3779B97F4A7C15
FMIX_1, FMIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = (1 << 64) - 1

#: Classes of the reduced alphabet; all other letters share class 6.
REDUCED = {"CU": 1, "AGPST": 2, "DENQBZ": 3, "HKRO": 4, "ILMV": 5, "FWY": 7}

_EXACT = np.arange(1, 257, dtype=np.uint64)
_REDUCED = np.full(256, 7, np.uint64)
for _letters, _cls in REDUCED.items():
    for _c in _letters:
        _REDUCED[ord(_c)] = _cls + 1
_VALID = np.zeros(256, bool)
_VALID[65:91] = True
_VALID[[ord("N"), ord("X")]] = False
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


def fmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(FMIX_1)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(FMIX_2)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have: have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
        have += step
    return out


def seeds(data: np.ndarray, offs: np.ndarray, k: int, m: int, reduce: bool):
    """Bottom-m k-mer seeds of many sequences that lie end to end: (hash, pos, offsets).

    The hash of a window runs on from the sequence's start, so the same k-mer at another
    position has another hash: the start value is multiplied once for every symbol passed.
    Windows with a letter outside A-Z, N or X give none.  Seeds are sorted by (hash, pos).
    """
    n = len(offs) - 1
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    lens = np.diff(offs)
    if k <= 0 or m <= 0 or not len(data) or lens.max() < k:
        return empty
    up = _UPPER[data]
    good = _VALID[up]
    val = np.where(good, (_REDUCED if reduce else _EXACT)[up], np.uint64(0))
    size = len(data) - k + 1
    h = np.zeros(size, np.uint64)
    for j in range(k):
        h *= np.uint64(ROLL_BASE)
        h += val[j: j + size]
    pos = np.arange(len(data), dtype=np.int64) - np.repeat(offs[:-1], lens)
    pos = pos[:size]
    h += (np.uint64(ROLL_SEED) * _powers(ROLL_BASE, int(lens.max()) + k + 1))[pos + k]
    h = fmix(h)
    bad = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~good, out=bad[1:])
    ok = (bad[k:] == bad[:-k]) & (pos + k <= np.repeat(lens, lens)[:size])
    out_h, out_p, out_o = [], [], np.zeros(n + 1, np.int64)
    for i in range(n):
        a, b = offs[i], min(offs[i + 1] - k + 1, size)
        count = 0
        if b > a:
            at = np.flatnonzero(ok[a:b])
            hh = h[a:b][at]
            if len(hh) > m:
                keep = hh <= np.partition(hh, m - 1)[m - 1]
                at, hh = at[keep], hh[keep]
            order = np.lexsort((at, hh))[:m]
            out_h.append(hh[order])
            out_p.append(at[order])
            count = len(order)
        out_o[i + 1] = out_o[i] + count
    if not out_h:
        return empty
    return np.concatenate(out_h), np.concatenate(out_p).astype(np.int64), out_o


def fnv1a64(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """FNV-1a of many byte strings at once: one step for each position, over those still open."""
    lens = np.diff(offs)
    h = np.full(len(lens), FNV_OFFSET, np.uint64)
    order = np.argsort(-lens, kind="stable")
    open_at = len(lens) - np.searchsorted(np.sort(lens), np.arange(lens.max(initial=0)), side="right")
    start = offs[:-1][order]
    state = h[order]
    prime = np.uint64(FNV_PRIME)
    for p, n in enumerate(open_at):
        state[:n] = (state[:n] ^ data[start[:n] + p]) * prime
    h[order] = state
    return h


def mismatches(a: bytes, b: bytes) -> int:
    """Positions that differ over the shorter length."""
    n = min(len(a), len(b))
    return int(np.count_nonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) if n else 0


#: Overlaps up to this length are compared many at once, so many letters at a time; longer ones one by one.
SHORT, LETTERS = 512, 1 << 20


def mismatches_many(a: np.ndarray, ao: np.ndarray, b: np.ndarray, bo: np.ndarray) -> np.ndarray:
    """``mismatches`` of many pairs, given as bytes and offsets."""
    n = np.minimum(np.diff(ao), np.diff(bo))
    out = np.zeros(len(n), np.int32)
    for i in np.flatnonzero(n > SHORT):
        out[i] = np.count_nonzero(a[ao[i]: ao[i] + n[i]] != b[bo[i]: bo[i] + n[i]])
    own = np.flatnonzero((n > 0) & (n <= SHORT))
    for part in np.array_split(own, int(n[own].sum()) // LETTERS + 1):
        if len(part):
            size = n[part]
            first = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(first, size)
            differ = a[np.repeat(ao[part], size) + step] != b[np.repeat(bo[part], size) + step]
            out[part] = np.add.reduceat(differ.astype(np.int32), first)
    return out


#: Four classes of letters, about equally frequent in English and with the four bases apart.
_FOUR = np.arange(256, dtype=np.uint8) & 3
for _cls, _letters in enumerate(("ENLP", "TIDCU", "ASHMB", "ORWFYVKG")):
    for _c in _letters:
        _FOUR[ord(_c)] = _cls
#: Letters in a word of a sketch, and words that are compared at once.
LETTERS_A_WORD, WORDS = 32, 1 << 17
_LOW_BITS = np.uint64(0x5555555555555555)


def sketches(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences that lie end to end as the classes of their letters, two bits each: (words, offsets)."""
    size = np.diff(offs)
    at = np.concatenate([[0], np.cumsum(-(-size // LETTERS_A_WORD))])
    cls = np.zeros((int(at[-1]) * LETTERS_A_WORD // 4, 4), np.uint8)
    cls.ravel()[np.repeat(at[:-1] * LETTERS_A_WORD - offs[:-1], size) + np.arange(len(data))] = _FOUR[data]
    return (cls[:, 0] | cls[:, 1] << 2 | cls[:, 2] << 4 | cls[:, 3] << 6).view(np.uint64), at


def least_mismatches(words: np.ndarray, at: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places where the classes differ, over the shorter length: never more than ``mismatches`` of the pairs ``a``, ``b``.

    ``at`` and ``size``: where the words of each sequence begin, and how many letters it has.
    """
    n = np.minimum(size[a], size[b])
    count = -(-n // LETTERS_A_WORD)
    out = np.zeros(len(n), np.int64)
    own = np.flatnonzero(count)
    cut = np.searchsorted(np.cumsum(count[own]), np.arange(WORDS, int(count.sum()), WORDS))
    for part in np.split(own, cut):
        if len(part):
            c = count[part]
            end = np.cumsum(c)
            step = np.arange(end[-1]) - np.repeat(end - c, c)
            x = words[np.repeat(at[a[part]], c) + step] ^ words[np.repeat(at[b[part]], c) + step]
            x = (x | x >> np.uint64(1)) & _LOW_BITS
            x[end - 1] &= ~np.uint64(0) >> ((LETTERS_A_WORD * c - n[part]) * 2).astype(np.uint64)
            out[part] = np.add.reduceat(np.bitwise_count(x).astype(np.int64), end - c)
    return out


# ------------------------------------------------------------------ scoring

#: BLOSUM62, of the twenty amino acids and the codes B, Z and X.
BLOSUM62 = """
     A  R  N  D  C  Q  E  G  H  I  L  K  M  F  P  S  T  W  Y  V  B  Z  X
A    4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0
R   -1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1
N   -2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1
D   -2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1
C    0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2
Q   -1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1
E   -1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1
G    0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1
H   -2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1
I   -1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1
L   -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1
K   -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1
M   -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1
F   -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1
P   -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2
S    1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0
T    0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0
W   -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2
Y   -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1
V    0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1
B   -2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1
Z   -1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1
X    0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1
"""


def blosum62() -> np.ndarray:
    """256 x 256 scores of bytes; any byte that is no code counts as X, case is ignored."""
    head, *lines = BLOSUM62.strip("\n").split("\n")
    order = head.split()
    scores = np.array([line.split()[1:] for line in lines], np.int64)
    at = np.full(256, order.index("X"), np.int64)
    for i, c in enumerate(order):
        at[ord(c)] = at[ord(c.lower())] = i
    return scores[at][:, at]


_BLOSUM: list[np.ndarray] = []


@dataclass(frozen=True)
class Scoring:
    match: int = 2
    mismatch: int = -1
    gap_open: int = -11
    gap_extend: int = -1
    matrix: bool = True

    def row(self, a: int, b: np.ndarray) -> np.ndarray:
        """Scores of one residue against many."""
        if self.matrix:
            if not _BLOSUM:
                _BLOSUM.append(blosum62())
            return _BLOSUM[0][a][b]
        return np.where(b == a, self.match, self.mismatch).astype(np.int64)


PROTEIN = Scoring()
PROTEIN_FLAT = Scoring(matrix=False)
NUCLEOTIDE = Scoring(2, -2, -8, -2, False)


def with_gaps(s: Scoring, gap_open: int | None, gap_extend: int | None) -> Scoring:
    return replace(s, gap_open=s.gap_open if gap_open is None else gap_open, gap_extend=s.gap_extend if gap_extend is None else gap_extend)


# ------------------------------------------------------------------ alignment

_S, _M = 42, 21
_LOW = -(1 << 61)


def align_full(a: bytes, b: bytes, s: Scoring) -> tuple[int, int, int]:
    """Local alignment with affine gaps: (score, aligned length, matches).

    Of equal scores the one with more matches wins, then the shorter one.  Score, matches and
    length are packed in one integer, score * 2^42 + matches * 2^21 - length, whose order is
    that preference, so a row is a few vector operations; gaps along the row are a running
    maximum, as a gap's cost is linear in its length.
    """
    if not a or not b:
        return 0, 0, 0
    if len(a) + len(b) >= 1 << (_M - 1):  # matches and lengths of the best path no longer fit their fields
        raise OverflowError(f"an alignment of {len(a)} and {len(b)} letters is too long")
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    first = ((s.gap_open + s.gap_extend) << _S) - 1
    more = (s.gap_extend << _S) - 1
    n = len(y)
    ramp = np.arange(n + 1, dtype=np.int64) * more
    h, f = np.zeros(n + 1, np.int64), np.full(n + 1, _LOW, np.int64)
    best, half = 0, 1 << (_M)
    tables: dict[int, np.ndarray] = {}
    for c in x:
        step = tables.get(c)
        if step is None:
            step = tables[c] = (s.row(c, y) << _S) + ((y == c).astype(np.int64) << _M) - 1
        f = np.maximum(np.maximum(h + first, f + more), _LOW)
        g = np.maximum(h[:-1] + step, f[1:])
        g = np.where((g + half) >> _S > 0, g, 0)
        base = np.concatenate([[0], g])
        run = np.maximum.accumulate(base - ramp)
        e = np.concatenate([[_LOW], run[:-1] + ramp[1:] - more + first])
        h = np.maximum(base, e)
        h[(h + half) >> _S <= 0] = 0
        best = max(best, int(h.max()))
    return _unpacked(best)


def _rows(x, y, s: Scoring, lo_of, hi_of, keep):
    """Rows of a plain local DP inside a band; ``keep`` gets each row's choices if given."""
    first, more = s.gap_open + s.gap_extend, s.gap_extend
    n = len(y)
    neg = -(1 << 40)
    h, f = np.zeros(n + 1, np.int64), np.full(n + 1, neg, np.int64)
    reach = 0
    best, at = 0, (0, 0)
    tables: dict[int, np.ndarray] = {}
    for i, c in enumerate(x, 1):
        lo, hi = lo_of(i), hi_of(i)
        if hi < lo:
            h, f, reach = np.zeros(n + 1, np.int64), np.full(n + 1, neg, np.int64), 0
            continue
        if hi > reach:
            h[reach + 1: hi + 1], f[reach + 1: hi + 1] = 0, neg
        if c not in tables:
            tables[c] = s.row(c, y)
        diag = h[lo - 1: hi] + tables[c][lo - 1: hi]
        f_open, f_ext = h[lo: hi + 1] + first, f[lo: hi + 1] + more
        fv = np.maximum(f_open, f_ext)
        g = np.maximum(np.maximum(diag, fv), 0)
        width = hi - lo + 1
        # E[j] = max over earlier columns q of H[q] + first + more * (j - q - 1), H[lo - 1] = 0
        base = np.concatenate([[0], g])
        ramp = np.arange(width + 1) * more
        e = np.maximum.accumulate(base - ramp)[:-1] + ramp[1:] - more + first
        hv = np.maximum(g, e)
        if keep is not None:
            before = np.concatenate([[0], hv[:-1]])
            e_before = np.concatenate([[neg], e[:-1]])
            src = np.zeros(width, np.uint8)
            top = np.zeros(width, np.int64)
            for code, v in ((1, diag), (2, e), (3, fv)):
                better = v > top
                src[better], top = code, np.maximum(top, v)
            keep.append((lo, src | ((e_before + more > before + first).astype(np.uint8) << 2) | ((f_ext > f_open).astype(np.uint8) << 3)))
        h2, f2 = h.copy(), f.copy()
        h2[lo - 1] = 0
        h2[lo: hi + 1], f2[lo: hi + 1] = hv, fv
        h, f, reach = h2, f2, hi
        j = int(hv.argmax())
        if hv[j] > best:
            best, at = int(hv[j]), (i, lo + j)
    return best, at


def best_score(a: bytes, b: bytes, s: Scoring) -> int:
    """Score of the best local alignment, without a band."""
    if not a or not b:
        return 0
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    return _rows(x, y, s, lambda i: 1, lambda i: len(y), None)[0]


#: Limits of the banded alignment.
MAX_DP_CELLS = 16_000_000
MAX_BAND_CELLS = 64_000_000
MIN_BAND = 64


def align_banded(a: bytes, b: bytes, s: Scoring, half_band: int) -> tuple[int, int, int]:
    """Banded local alignment with traceback: (score, aligned length, matches).

    The cell of the first best score in row order is traced back; a cell prefers the diagonal,
    then a gap in ``a``, then a gap in ``b``, and a gap is opened rather than extended on ties.
    """
    if not a or not b:
        return 0, 0, 0
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    m, n = len(x), len(y)
    low, high = min(n - m, 0) - half_band, max(n - m, 0) + half_band
    if m * (high - low + 1) > MAX_BAND_CELLS:
        return 0, 0, 0
    rows: list = []
    best, (i, j) = _rows(x, y, s, lambda i: max(i + low, 1), lambda i: min(i + high, n), rows)
    if best <= 0:
        return 0, 0, 0
    length = matches = 0
    state = 0
    while i and j:
        lo, code = rows[i - 1]
        if not lo <= j < lo + len(code):
            break
        d = int(code[j - lo])
        if state == 0:
            state = d & 3
            if state == 0:
                break
            if state == 1:
                length += 1
                matches += int(x[i - 1] == y[j - 1])
                i, j, state = i - 1, j - 1, 0
            continue
        length += 1
        if state == 2:
            j -= 1
            state = 2 if d & 4 else 0
        else:
            i -= 1
            state = 3 if d & 8 else 0
    return best, length, matches


def align_pair(rep: bytes, member: bytes, s: Scoring, min_identity: float) -> tuple[int, int, int]:
    """The clustering's gapped stage: size limit, score floor, banded alignment."""
    if len(rep) * len(member) > MAX_DP_CELLS:
        return 0, 0, 0
    floor = int(np.float32(min(len(rep), len(member))) * np.float32(min_identity))
    if best_score(rep, member, s) < floor:
        return 0, 0, 0
    return align_banded(rep, member, s, max(max(len(rep), len(member)) // 4, MIN_BAND))


# ------------------------------------------------------------------ many alignments at once

class _Table:
    """A scoring as arrays over bytes, byte 256 being no residue at all."""

    def __init__(self, s: Scoring):
        everything = np.arange(256)
        score = np.stack([s.row(c, everything) for c in range(256)]).astype(np.int64)
        self.own = score.diagonal().copy()
        self.most = np.maximum(score.max(axis=1), 0)
        self.first, self.more = s.gap_open + s.gap_extend, s.gap_extend
        # Of equal sequences no alignment is better than a piece of the diagonal if two residues score no more
        # together than half of what each scores with itself, and a residue in a gap costs more than it saves.
        both = self.own[:, None] + self.own[None, :]
        least = min(int(self.own.min()), 0)
        self.dominant = bool((2 * score <= both).all() and ((2 * score < both) | (self.own[:, None] == self.own)).all() and 2 * self.first < least and 2 * self.more <= least)
        self.gaps_cost = self.first < 0 and self.more < 0
        self.plain = np.full((257, 257), -(1 << 28), np.int32)
        self.plain[:256, :256] = score
        self.packed = np.full((257, 257), _LOW, np.int64)
        self.packed[:256, :256] = (score << _S) + (np.eye(256, dtype=np.int64) << _M) - 1


_TABLES: dict[Scoring, _Table] = {}


def _table(s: Scoring) -> _Table:
    if s not in _TABLES:
        _TABLES[s] = _Table(s)
    return _TABLES[s]


def _align_equal(x: np.ndarray, t: _Table, first_end: bool) -> tuple[int, int, int]:
    """A sequence with itself, where ``t.dominant``: the best piece of the diagonal, from its last place without a score on.

    Of several ends the first counts if ``first_end``, else that of the longest piece.
    """
    total = np.concatenate([[0], np.cumsum(t.own[x])])
    here = total - np.minimum.accumulate(total)
    best = int(here.max())
    if not best:
        return 0, 0, 0
    length = np.arange(len(here)) - np.maximum.accumulate(np.where(here == 0, np.arange(len(here)), 0))
    ends = np.flatnonzero(here == best)
    long = int(length[ends[0]] if first_end else length[ends].max())
    return best, long, long


def _reach(x: np.ndarray, y: np.ndarray, t: _Table, score: int) -> tuple[int, int]:
    """Least and largest offset (place in ``y`` less place in ``x``) that an alignment of at least ``score`` can have.

    Through a place, it can't score more than all residues of one sequence up to there and all of the other after it.
    """
    px, py = np.cumsum(t.most[x]), np.cumsum(t.most[y])
    i = np.arange(1, len(x) + 1)
    high = np.searchsorted(py, py[-1] - (score - px), side="right") - i
    low = np.searchsorted(py, score - (px[-1] - px), side="left") + 1 - i
    return int(low.min()), int(high.max())


#: Cells in a row of a batch, bytes of choices that a batch holds, and the first half-width.
ROW_CELLS, CHOICE_BYTES, FIRST_BAND = 1 << 16, 48_000_000, 16


def _sweep(pairs: list, t: _Table, packed: bool) -> list:
    """Rows of the local DP of many pairs (x, y, low, high) at once, each within its offsets.

    Packed: the best cell's value, as in ``align_full``; else (score, aligned length, matches) by traceback, as in
    ``align_banded``.  Column c of a row i is the place i + low + c of ``y``, so a step on the diagonal stays in its column.
    """
    kind = np.int64 if packed else np.int32
    table = (t.packed if packed else t.plain).ravel()
    first, more = (((t.first << _S) - 1, (t.more << _S) - 1) if packed else (t.first, t.more))
    neg = _LOW if packed else -(1 << 28)
    n, rows = len(pairs), max(len(p[0]) for p in pairs)
    spans = np.array([p[3] - p[2] + 1 for p in pairs])
    width = int(spans.max())
    xs = np.full((rows, n, 1), 256 * 257, np.int32)
    ys = np.full((n, rows + width), 256, np.int32)
    for k, (x, y, low, _) in enumerate(pairs):
        xs[: len(x), k, 0] = x.astype(np.int32) * 257
        a, b = max(0, -low), min(rows + width, len(y) - low)
        if b > a:
            ys[k, a:b] = y[a + low: b + low]
    beyond = np.arange(width) >= spans[:, None] if (spans < width).any() else None  # nothing starts or passes there
    ramp = np.arange(width, dtype=kind) * kind(more)
    back = ramp[1:] + kind(first - more)
    floor = (1 << _S) - (1 << _M) if packed else 0
    h, f = np.zeros((n, width), kind), np.full((n, width), neg, kind)
    e = np.full((n, width), neg, kind)
    opened, longer = np.full((n, width), neg, kind), np.full((n, width), neg, kind)
    best, row_of, col_of = np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)
    choices = None if packed else np.empty((rows, n, width), np.uint8)
    every = np.arange(n)
    for i in range(rows):
        diag = table.take(xs[i] + ys[:, i: i + width])
        diag += h
        np.add(h[:, 1:], kind(first), out=opened[:, :-1])
        np.add(f[:, 1:], kind(more), out=longer[:, :-1])
        f = np.maximum(opened, longer)
        if beyond is not None:
            f[beyond] = neg
        g = np.maximum(diag, f)
        if packed:
            g[g < floor] = 0
        else:
            np.maximum(g, 0, out=g)
        run = np.maximum.accumulate(g - ramp, axis=1)
        np.add(run[:, :-1], back, out=e[:, 1:])
        h = np.maximum(g, e)
        if beyond is not None:
            h[beyond] = 0
        if packed:
            h[h < floor] = 0
            np.maximum(best, h.max(axis=1), out=best)
            continue
        code = np.where(diag == h, np.uint8(1), np.where(e == h, np.uint8(2), np.uint8(3)))
        code[h <= 0] = 0
        code[:, 1:] |= (e[:, :-1] + kind(more) > h[:, :-1] + kind(first)).view(np.uint8) << 2
        code |= (longer > opened).view(np.uint8) << 3
        choices[i] = code
        col = h.argmax(axis=1)
        top = h[every, col]
        up = top > best
        best[up], row_of[up], col_of[up] = top[up], i, col[up]
    if packed:
        return [int(v) for v in best]
    return [(int(best[k]), *_traced(choices[:, k], int(row_of[k]), int(col_of[k]), x, y, low)) if best[k] > 0 else (0, 0, 0) for k, (x, y, low, _) in enumerate(pairs)]


def _traced(choices: np.ndarray, i: int, c: int, x: np.ndarray, y: np.ndarray, low: int) -> tuple[int, int]:
    """(aligned length, matches) from cell (i, c) back."""
    width = choices.shape[1]
    flat, a, b = choices[: i + 1].tobytes(), x.tobytes(), y.tobytes()
    length = matches = state = 0
    while i >= 0 and 0 <= c < width and i + low + c >= 0:
        d = flat[i * width + c]
        if state == 0:
            state = d & 3
            if state == 0:
                break
            if state == 1:
                length += 1
                matches += a[i] == b[i + low + c]
                i, state = i - 1, 0
            continue
        length += 1
        if state == 2:
            c -= 1
            state = 2 if d & 4 else 0
        else:
            i, c = i - 1, c + 1
            state = 3 if d & 8 else 0
    return length, matches


def _batches(jobs: list, packed: bool):
    """``jobs`` (place, x, y, low, high) in groups of similar width and length."""
    group: list = []
    short = long = 0
    for j in sorted(jobs, key=lambda j: (j[4] - j[3], len(j[1]))):
        width, rows = j[4] - j[3] + 1, len(j[1])
        short, long = (min(short, rows), max(long, rows)) if group else (rows, rows)
        cells = (len(group) + 1) * width
        if group and (cells > ROW_CELLS or long > 2 * short + 64 or not packed and cells * long > CHOICE_BYTES):
            yield group
            group, short, long = [], rows, rows
        group.append(j)
    if group:
        yield group


def _widening(jobs: list, t: _Table, packed: bool) -> dict:
    """Exact results of ``jobs`` (place, x, y, least, largest offset allowed) by bands that grow.

    A band's best score is a lower bound; once no alignment of that score can leave the band, the band holds all
    that the whole DP would choose from, ties included.
    """
    out: dict = {}
    todo = []
    for at, x, y, least, largest in jobs:
        gap = len(y) - len(x)
        todo.append(((at, x, y, max(min(gap, 0) - FIRST_BAND, least), min(max(gap, 0) + FIRST_BAND, largest)), least, largest))
    while todo:
        limits = {j[0]: (least, largest) for j, least, largest in todo}
        again = []
        for group in _batches([j for j, _, _ in todo], packed):
            for (at, x, y, low, high), got in zip(group, _sweep([g[1:] for g in group], t, packed)):
                least, largest = limits[at]
                score = (got + (1 << _M)) >> _S if packed else got[0]
                lo, hi = _reach(x, y, t, max(score, 1))
                lo, hi = max(lo, least), min(hi, largest)
                if lo >= low and hi <= high:
                    out[at] = got
                else:
                    more = 3 * (high - low + 1) // 2
                    again.append(((at, x, y, max(min(lo, low), low - more), min(max(hi, high), high + more)), least, largest))
        todo = again
    return out


def _unpacked(best: int) -> tuple[int, int, int]:
    half = 1 << _M
    score = (best + half) >> _S
    rest = best - (score << _S)
    matches = (rest + half - 1) >> _M
    return score, (matches << _M) - rest, matches


def align_full_many(pairs: list[tuple[bytes, bytes]], s: Scoring) -> list[tuple[int, int, int]]:
    """``align_full`` of many pairs."""
    t = _table(s)
    known: dict = {}
    jobs = []
    for a, b in pairs:
        if (a, b) in known:
            continue
        known[a, b] = None
        if a and a == b and t.dominant:
            known[a, b] = _align_equal(np.frombuffer(a, np.uint8), t, False)
        elif not a or not b or not t.gaps_cost or len(a) + len(b) >= 1 << (_M - 1):
            known[a, b] = align_full(a, b, s)
        else:
            jobs.append(((a, b), np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), 1 - len(a), len(b) - 1))
    for at, got in _widening(jobs, t, True).items():
        known[at] = _unpacked(got)
    return [known[p] for p in pairs]


def align_pairs(pairs: list[tuple[bytes, bytes]], s: Scoring, min_identity: float) -> list[tuple[int, int, int]]:
    """``align_pair`` of many pairs: size limit, score floor, band, traceback."""
    t = _table(s)
    known: dict = {}
    jobs = []
    for a, b in pairs:
        if (a, b) in known:
            continue
        known[a, b] = 0, 0, 0
        gap, wide = len(b) - len(a), max(max(len(a), len(b)) // 4, MIN_BAND)
        least, largest = min(gap, 0) - wide, max(gap, 0) + wide
        if not a or not b or len(a) * len(b) > MAX_DP_CELLS or len(a) * (largest - least + 1) > MAX_BAND_CELLS:
            continue
        if a == b and t.dominant:
            got = _align_equal(np.frombuffer(a, np.uint8), t, True)
            if got[0] >= _floor(a, b, min_identity):
                known[a, b] = got
        elif not t.gaps_cost:
            known[a, b] = align_pair(a, b, s, min_identity)
        else:
            jobs.append(((a, b), np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), max(least, 1 - len(a)), min(largest, len(b) - 1)))
    for (a, b), got in _widening(jobs, t, False).items():
        # the floor is one for the score without a band, which is no less than that within it
        if got[0] >= (floor := _floor(a, b, min_identity)) or best_score(a, b, s) >= floor:
            known[a, b] = got
    return [known[p] for p in pairs]


def _floor(a: bytes, b: bytes, min_identity: float) -> int:
    return int(np.float32(min(len(a), len(b))) * np.float32(min_identity))


# ------------------------------------------------------------------ posting codecs

def gaps(ids: list[int]) -> list[int]:
    return [v - (ids[i - 1] if i else 0) for i, v in enumerate(ids)]


def ungaps(values: list[int]) -> list[int]:
    out, at = [], 0
    for v in values:
        at += v
        out.append(at)
    return out


def _leb(v: int) -> bytes:
    out = bytearray()
    while v >= 128:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes(out) + bytes([v])


def _unleb(raw: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("a varint ends early")
        v |= (raw[at] & 127) << shift
        at += 1
        if raw[at - 1] < 128:
            return v, at
        shift += 7


def vbyte(values: list[int]) -> bytes:
    return b"".join(map(_leb, values))


def unvbyte(raw: bytes) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        v, at = _unleb(raw, at)
        out.append(v)
    return out


def delta_varint(values: list[int]) -> bytes:
    """Groups of up to four: a count, then varints."""
    return b"".join(bytes([len(g)]) + vbyte(g) for g in (values[i: i + 4] for i in range(0, len(values), 4)))


def undelta_varint(raw: bytes) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        n, at = raw[at], at + 1
        for _ in range(n):
            v, at = _unleb(raw, at)
            out.append(v)
    return out


def bp128(values: list[int]) -> bytes:
    """Blocks of up to 128: count, bits a value, then the values packed in 32-bit words."""
    out = bytearray()
    for i in range(0, len(values), 128):
        block = values[i: i + 128]
        bits = max(max(block).bit_length(), 1)
        packed = sum(v << (k * bits) for k, v in enumerate(block))
        out += bytes([len(block), bits]) + packed.to_bytes(-(-len(block) * bits // 32) * 4, "little")
    return bytes(out)


def unbp128(raw: bytes) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            raise ValueError("a block ends early")
        n, bits = raw[at], raw[at + 1]
        size = -(-n * bits // 32) * 4
        if at + 2 + size > len(raw):
            raise ValueError("a block ends early")
        packed = int.from_bytes(raw[at + 2: at + 2 + size], "little")
        out += [packed >> (k * bits) & ((1 << bits) - 1) for k in range(n)]
        at += 2 + size
    return out


CODECS = {"vbyte": (vbyte, unvbyte), "delta_varint": (delta_varint, undelta_varint), "bp128": (bp128, unbp128)}
