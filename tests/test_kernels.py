"""Kernels against plain cell-by-cell and symbol-by-symbol versions."""
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.config import thresholds
from seqloom.functions import kernels as K

MASK = (1 << 64) - 1


def flat(seqs):
    raw = [s.encode() for s in seqs]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def plain_seeds(seq, k, m, reduce):
    if not k or not m or len(seq) < k:
        return []
    cls = {c: v for letters, v in K.REDUCED.items() for c in letters}
    val = [0 if (c in "NX" or not "A" <= c <= "Z") else (cls.get(c, 6) if reduce else ord(c)) + 1 for c in seq.upper()]
    h = K.ROLL_SEED
    for v in val[:k]:
        h = (h * K.ROLL_BASE + v) & MASK
    out = []
    for i in range(len(seq) - k + 1):
        if all(val[i:i + k]):
            x = h
            x = (x ^ x >> 33) * K.FMIX_1 & MASK
            x = (x ^ x >> 33) * K.FMIX_2 & MASK
            out.append((x ^ x >> 33, i))
        if i + k < len(seq):
            h = ((h - val[i] * pow(K.ROLL_BASE, k - 1, 1 << 64)) * K.ROLL_BASE + val[i + k]) & MASK
    return sorted(out)[:m]


def test_seeds():
    r = random.Random(1)
    seqs = ["".join(r.choice("ACDEFGHIKLMNXacgt*JOU") for _ in range(r.randint(0, 90))) for _ in range(80)] + ["", "AC", "A" * 300]
    for k, m, reduce in ((5, 8, False), (10, 20, True), (1, 3, False), (14, 20, False), (0, 5, True), (5, 0, True)):
        h, p, o = K.seeds(*flat(seqs), k, m, reduce)
        for i, s in enumerate(seqs):
            assert list(zip(h[o[i]:o[i + 1]].tolist(), p[o[i]:o[i + 1]].tolist())) == plain_seeds(s, k, m, reduce)


def test_reduced_alphabet_shares_more():
    a, b = "MKTAYIAKQRQISFVKSHFSRQDILDLVAA", "MRTAYLAKQRQLSFVKSHFSRQDILDLIAA"
    shared = [len(set(K.seeds(*flat([a]), 6, 32, x)[0]) & set(K.seeds(*flat([b]), 6, 32, x)[0])) for x in (False, True)]
    assert shared[1] > shared[0]


def test_fnv():
    assert int(K.fnv1a64(*flat(["GATTACA", "", "A"]))[0]) == 10139454686114222884
    got = K.fnv1a64(*flat(["", "hello", "x" * 1000]))
    for s, g in zip(["", "hello", "x" * 1000], got):
        h = K.FNV_OFFSET
        for b in s.encode():
            h = (h ^ b) * K.FNV_PRIME & MASK
        assert int(g) == h


def test_hamming():
    assert K.mismatches(b"A" * 20, b"A" * 12 + b"T" + b"A" * 7) == 1
    assert K.mismatches(b"", b"A") == 0 and K.mismatches(b"AB", b"ABCC") == 0


def test_matrix():
    m = K.blosum62()
    assert (m == m.T).all()
    for a, b, v in (("A", "A", 4), ("W", "W", 11), ("C", "C", 9), ("Q", "R", 1), ("I", "L", 2), ("W", "P", -4), ("B", "D", 4), ("Z", "E", 4), ("B", "Z", 1), ("X", "X", -1), ("X", "P", -2), ("X", "A", 0), ("J", "*", -1), ("a", "A", 4)):
        assert m[ord(a), ord(b)] == v


def better(a, b):
    return b if (b[0], b[1], -b[2]) > (a[0], a[1], -a[2]) else a


def plain_full(a, b, s):
    neg = None
    gap = lambda c, g: None if c is None else (c[0] + g, c[1], c[2] + 1)
    pick = lambda x, y: y if x is None else x if y is None else better(x, y)
    zero = (0, 0, 0)
    ph, pf, best = [zero] * (len(b) + 1), [neg] * (len(b) + 1), zero
    for x in a:
        row = s.row(x, np.frombuffer(b, np.uint8))
        h, f, e = [zero], [neg], None
        for j, y in enumerate(b, 1):
            d = (ph[j - 1][0] + int(row[j - 1]), ph[j - 1][1] + (x == y), ph[j - 1][2] + 1)
            e = pick(gap(h[j - 1], s.gap_open + s.gap_extend), gap(e, s.gap_extend))
            f.append(pick(gap(ph[j], s.gap_open + s.gap_extend), gap(pf[j], s.gap_extend)))
            c = pick(pick(d, e), f[j])
            h.append(c if c[0] > 0 else zero)
            best = better(best, h[j])
        ph, pf = h, f
    return best[0], best[2], best[1]


def plain_banded(a, b, s, w):
    m, n = len(a), len(b)
    low, high = min(n - m, 0) - w, max(n - m, 0) + w
    neg = -10 ** 9
    H, F, D = {}, {}, {}
    best, at = 0, None
    for i in range(1, m + 1):
        e = neg
        row = s.row(a[i - 1], np.frombuffer(b, np.uint8))
        for j in range(max(i + low, 1), min(i + high, n) + 1):
            diag = H.get((i - 1, j - 1), 0) + int(row[j - 1])
            eo, ee = H.get((i, j - 1), 0) + s.gap_open + s.gap_extend, e + s.gap_extend
            e, eb = (ee, 4) if ee > eo else (eo, 0)
            fo, fe = H.get((i - 1, j), 0) + s.gap_open + s.gap_extend, F.get((i - 1, j), neg) + s.gap_extend
            f, fb = (fe, 8) if fe > fo else (fo, 0)
            h, src = 0, 0
            for v, c in ((diag, 1), (e, 2), (f, 3)):
                if v > h:
                    h, src = v, c
            H[i, j], F[i, j], D[i, j] = h, f, src | eb | fb
            if h > best:
                best, at = h, (i, j)
    if not best:
        return 0, 0, 0
    (i, j), state, length, same = at, 0, 0, 0
    while i and j and (i, j) in D:
        d = D[i, j]
        if state == 0:
            state = d & 3
            if state == 0:
                break
            if state == 1:
                length, same, i, j, state = length + 1, same + (a[i - 1] == b[j - 1]), i - 1, j - 1, 0
            continue
        length += 1
        if state == 2:
            j, state = j - 1, 2 if d & 4 else 0
        else:
            i, state = i - 1, 3 if d & 8 else 0
    return best, length, same


def mutated(r):
    a = "".join(r.choice("ARNDCQEGHILKMFPSTWYVJOX") for _ in range(r.randint(1, 60)))
    b = list(a[r.randint(0, 5):])
    for _ in range(r.randint(0, 8)):
        if b:
            p = r.randrange(len(b))
            b[p:p + r.choice([0, 1, 1, 2])] = r.choice(["", "A", "W", "KL"])
    return a.encode(), "".join(b).encode()


def test_alignments_equal_plain_versions():
    r = random.Random(7)
    for _ in range(150):
        a, b = mutated(r)
        s = r.choice([K.PROTEIN, K.PROTEIN_FLAT, K.NUCLEOTIDE, K.with_gaps(K.PROTEIN, -2, -1)])
        want = plain_full(a, b, s)
        assert K.align_full(a, b, s) == want
        assert K.best_score(a, b, s) == want[0]
        for w in (1, 4, 64):
            assert K.align_banded(a, b, s, w) == plain_banded(a, b, s, w)


def test_equal_pairs_take_the_short_way():
    r = random.Random(9)
    for _ in range(40):
        a = "".join(r.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(r.randint(1, 80))).encode()
        assert K.align_pair(a, a, K.PROTEIN, 0.9) == K.align_banded(a, a, K.PROTEIN, 64)
    assert K.align_pair(b"", b"A", K.PROTEIN, 0.9) == (0, 0, 0)
    assert K.align_pair(b"A" * 4001, b"A" * 4000, K.PROTEIN, 0.9) == (0, 0, 0)


def test_many_alignments_equal_single_ones():
    r = random.Random(11)
    noise = lambda n: "".join(r.choice("AOUXEST") for _ in range(n)).encode()
    pairs = [mutated(r) for _ in range(120)] + [(x, x) for x in (noise(r.randint(1, 90)) for _ in range(30))]
    pairs += [(x, x[:40] + noise(r.choice([0, 7, 30])) + x[45:]) for x in (noise(150) for _ in range(20))] + [(b"", b"A"), (b"A", b""), (b"X", b"X")]
    for s in (K.PROTEIN, K.PROTEIN_FLAT, K.NUCLEOTIDE, K.with_gaps(K.PROTEIN, -2, -1), K.with_gaps(K.PROTEIN, 0, 0)):
        assert K.align_full_many(pairs, s) == [K.align_full(a, b, s) for a, b in pairs]
        for least in (0.5, 4.0):
            assert K.align_pairs(pairs, s, least) == [K.align_pair(a, b, s, least) for a, b in pairs]


def test_equal_texts_are_aligned_without_a_table(monkeypatch):
    """O and U, which score below 0 with themselves, are in every text."""
    monkeypatch.setattr(K, "_rows", None)
    monkeypatch.setattr(K, "_sweep", None)
    x = b"THEQUOTAOFYOURHOUSE" * 100
    (score, length, same), = K.align_pairs([(x, x)], K.PROTEIN, 0.9)
    assert score > 0 and length == same == 1900
    assert K.align_full_many([(x, x)], K.PROTEIN) == [(score, 1900, 1900)]


def test_goldens():
    x = b"MKTAYIAKQRQISFVKSHFSRQDILDLWQ"
    assert K.align_pair(x, x, K.PROTEIN, 0.9) == (149, 29, 29)
    assert K.align_pair(x, x[:-1] + b"R", K.PROTEIN, 0.9) == (145, 29, 28)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1), max_size=300))
def test_codecs(values):
    ids = sorted(set(values))
    for pack, unpack in K.CODECS.values():
        assert K.ungaps(unpack(pack(K.gaps(ids)))) == ids
    assert K.gaps([3, 10, 11, 24, 100, 130, 131, 5000]) == [3, 7, 1, 13, 76, 30, 1, 4869]


def test_thresholds():
    t = thresholds("fast", 0.9, 0.8, 1.0)
    assert abs(t.prefilter_identity - 0.86) < 1e-6 and not t.gapped
    assert abs(thresholds("ultra", 0.9, 0.8, 1.0).final_coverage - 0.72) < 1e-6
    assert thresholds("sensitive", 0.2, 0.8, 10).prefilter_identity == 0.0


def test_mismatches_of_many_pairs():
    r = np.random.default_rng(3)
    words = lambda: [bytes(r.integers(65, 68, r.choice([0, 1, 5, 90, 512, 513, 3000])).astype(np.uint8)) for _ in range(200)]
    a, b = words(), words()
    flat = lambda x: (np.frombuffer(b"".join(x), np.uint8), np.cumsum([0] + [len(y) for y in x]))
    for size in (1 << 20, 100):
        K.LETTERS, old = size, K.LETTERS
        try:
            assert K.mismatches_many(*flat(a), *flat(b)).tolist() == [K.mismatches(x, y) for x, y in zip(a, b)]
        finally:
            K.LETTERS = old


def test_alignments_that_would_overflow_are_refused():
    with pytest.raises(OverflowError):
        K.align_full(b"A" * (1 << 20), b"A", K.PROTEIN)


def test_sketches_never_count_more_mismatches():
    r = np.random.default_rng(5)
    for _ in range(30):
        size = r.integers(1, 140, 12)
        data = r.integers(65, 91, size.sum()).astype(np.uint8)
        offs = np.concatenate([[0], np.cumsum(size)])
        words, at = K.sketches(data, offs)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12)))
        classes = [K._FOUR[data[offs[i]: offs[i + 1]]] for i in range(12)]
        want = [int((classes[i][: min(size[i], size[j])] != classes[j][: min(size[i], size[j])]).sum()) for i, j in zip(a, b)]
        got = K.least_mismatches(words, at, size, a, b)
        assert got.tolist() == want
        assert all(n <= K.mismatches(data[offs[i]: offs[i + 1]].tobytes(), data[offs[j]: offs[j + 1]].tobytes()) for n, i, j in zip(got, a, b))
