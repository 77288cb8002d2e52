"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The strings are sequences of words (as in ``common.word_hashes``; of scripts without spaces, such as
Chinese, each character is a word).  A document holds an item of L words where some run of its words is within edit distance floor(MAX_EDIT * L) of the item.

The CGK embedding walks over a string: step j emits the word under the pointer and moves the
pointer by a random bit that depends on j and that word, so two strings at a small edit distance
give walks at a small Hamming distance.  Each of ``REPEATS`` independent walks is sampled at
``SAMPLES`` of its steps; equal samples propose (window, item).  The walks drift apart as the edits
of a long item add up, so they alone would miss many.  Therefore the items' segments propose
places too: an item with k edits allowed is cut into k + 1 segments, of 2 to 5 words, and as an
edit destroys one of them at most, one stands unchanged in every passage.  Nothing within
the limit is missed.  Proposals whose place holds fewer of the item's own word pairs than k edits
leave are dropped, and every other one is settled by a semi-global edit distance between the item
and the words about the place.

Windows are as long as the items, at every word of every whole document.  A window can only be
within k edits of an item of L words if at least L - 1 - 2k of its neighbouring word pairs occur
in the items (an edit destroys two pairs at most), so windows below that count aren't walked;
this loses nothing.

An item of fewer than five words allows no edit: it has one segment, itself, and is found where it stands
word for word.

The items are taken in blocks of bounded size, SCAN_BLOCKS of them shipped to all tasks in one scan;
documents are only scanned, never shuffled, in the pipeline stage too.  Defined results: null, empty and
wordless texts hold nothing; wordless items and items without an id are in no document; repeated rows of documents and items give
one result; documents without an id share the id null (the stage judges each row by itself, whatever its id); extra columns
are ignored, and kept by the stage.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix, seeded, small_batches, table, text_chunks, word_hashes

MAX_EDIT = 0.2
REPEATS, SAMPLES = 32, 3
#: Items are shipped in blocks of at most so many rows and bytes of text.
BLOCK_ROWS, BLOCK_BYTES, SCAN_BLOCKS = 20_000, 16_000_000, 4
_PAIR_BITS = 22
#: Proposals, and words of proposed places, that are looked at in one go.
_PART = 1_000_000
#: Item lengths of one class differ by this factor at most.
_CLASS = 1.25


def allowed(n_words: int) -> int:
    return int(MAX_EDIT * n_words)


def pair_hash(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15))


_GRAM = seeded(8, 23) | np.uint64(1)


def gram_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on."""
    out = np.zeros(max(len(h) - size + 1, 0), np.uint64) + np.uint64(size)
    for j in range(size):
        out += h[j: j + len(out)] * _GRAM[j]
    return mix(out)


def _ranges(a: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """The numbers a, a + 1, ... of each range, one range after the other."""
    return np.repeat(a, cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)


def walk_plan(length: int, seed: int):
    """Step seeds (repeats x steps) and the sorted sampled steps of each repeat, for a class."""
    steps = max(SAMPLES, int(1.7 * length))
    seeds = seeded(REPEATS * steps, seed * 7919 + 11).reshape(REPEATS, steps)
    order = np.argsort(mix(seeds ^ np.uint64(0xABCDEF)), axis=1)[:, :SAMPLES]
    return seeds, np.sort(order, axis=1)


def embed_keys(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """LSH keys (rows x repeats) of word windows, one window a row."""
    seeds, picked = walk_plan(length, seed)
    rows, width = words.shape
    taken = np.zeros(seeds.shape, bool)
    taken[np.arange(REPEATS)[:, None], picked] = True
    at = np.zeros((rows, REPEATS), np.int64)
    key = np.zeros((rows, REPEATS), np.uint64) + seeds[:, 0]
    line = np.arange(rows)[:, None]
    one = np.uint64(1)
    for j in range(seeds.shape[1]):
        sym = words[line, np.minimum(at, width - 1)]
        use = np.flatnonzero(taken[:, j])
        if len(use):
            key[:, use] = mix(key[:, use] * np.uint64(31) + sym[:, use] + one)
        at += (mix(sym ^ seeds[:, j]) & one).astype(np.int64)
    return key


def edit_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to a run of words, with the run's bounds (Sellers)."""
    n = len(words)
    step = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    origin = step.copy()
    for i, w in enumerate(item):
        best = np.empty(n + 1, np.int64)
        best[0] = i + 1
        start = origin.copy()
        start[0] = 0
        diag = row[:-1] + (words != w)
        up = row[1:] + 1
        best[1:] = np.minimum(diag, up)
        start[1:] = np.where(diag <= up, origin[:-1], origin[1:])
        low = np.minimum.accumulate(best - step)
        src = np.maximum.accumulate(np.where(best - step == low, step, 0))
        row, origin = low + step, start[src]
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


class Items:
    """A block of items, ready to be matched on executors."""

    def __init__(self, ids: list[int], texts: list[str]):
        arr = pa.array(texts, pa.string())
        self.ids, self.words = [], []
        row = 0
        for i, j, data, offs in text_chunks(arr):
            h, _, _, first = word_hashes(data, offs, True)
            for k in range(j - i):
                w = h[first[k]: first[k + 1]]
                if len(w):
                    self.ids.append(ids[row + k])
                    self.words.append(w)
            row += j - i
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        for w in self.words:
            self.pairs[(pair_hash(w) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)] = True
        size = np.array([len(w) for w in self.words], np.int64)
        self.classes = []  # (longest, least number of known pairs, sorted keys, their items)
        lo = max(int(size.min()), int(1 / MAX_EDIT)) if len(size) else 0  # shorter ones allow no edit
        while len(size) and lo <= size.max():
            hi = max(lo, int(lo * _CLASS))
            own = np.flatnonzero((size >= lo) & (size <= hi))
            if len(own):
                need = min(max(int(n) - 1 - 2 * allowed(int(n)), 1) for n in size[own])
                mat = np.zeros((len(own), hi), np.uint64)
                for r, k in enumerate(own):
                    mat[r, : size[k]] = self.words[k]
                keys = embed_keys(mat, lo, lo)
                flat = (keys + np.arange(REPEATS, dtype=np.uint64)).ravel()
                order = np.argsort(flat, kind="stable")
                self.classes.append((lo, hi, need, flat[order], np.repeat(own, REPEATS)[order]))
            lo = hi + 1
        self.size, self.room = size, np.array([allowed(int(n)) for n in size], np.int64)
        found: dict[int, list] = {}
        own = [np.zeros(0, np.uint64)]
        for k, w in enumerate(self.words):
            own.append(np.unique(self._own(pair_hash(w), np.uint64(k))))
            cut = np.arange(self.room[k] + 2) * len(w) // (self.room[k] + 1)
            for g in np.unique(np.diff(cut)):
                at = cut[:-1][np.diff(cut) == g]
                found.setdefault(int(g), []).append((gram_hash(w, int(g))[at], np.full(len(at), k), at))
        self.own = np.sort(np.concatenate(own))  # the word pairs of each item
        self.segments = []  # (words, known hashes, sorted hashes, their items, their places in them)
        for g, parts in sorted(found.items()):
            key, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << _PAIR_BITS, bool)
            seen[(key >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)] = True
            self.segments.append((g, seen, key[order], item[order], at[order]))

    @staticmethod
    def _own(pairs: np.ndarray, item) -> np.ndarray:
        return mix(pairs + np.atleast_1d(item + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def _anchors(self, h: np.ndarray, first: np.ndarray):
        """Arrays (text, item, place) of the items whose segments stand in the texts."""
        for g, seen, keys, owner, offset in self.segments:
            key = gram_hash(h, g)
            at = np.flatnonzero(seen[(key >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)])
            text = np.searchsorted(first, at, side="right") - 1
            whole = at + g <= first[text + 1]
            at, text = at[whole], text[whole]
            a, b = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            ends = np.cumsum(b - a)
            for part in np.split(np.arange(len(at)), np.searchsorted(ends, np.arange(_PART, ends[-1] if len(ends) else 0, _PART))):
                cnt = (b - a)[part]
                idx = _ranges(a[part], cnt)
                yield np.stack([np.repeat(text[part], cnt), owner[idx], np.repeat(at[part], cnt) - offset[idx]], axis=1)

    def _possible(self, rows: np.ndarray, pairs: np.ndarray, known: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The (text, item, place) rows whose words hold enough of the item's own word pairs."""
        rows = np.unique(rows, axis=0)
        text, item, place = rows.T
        size, room = self.size[item], self.room[item]
        need = size - 1 - 2 * room
        lo, hi = np.maximum(first[text], place - room), np.minimum(first[text + 1], place + size + 2 * room) - 1  # of pairs
        ok = known[hi] - known[lo] >= need
        rows, item, need, lo, hi = rows[ok], item[ok], need[ok], lo[ok], hi[ok]
        keep = [np.zeros((0, 3), np.int64)]
        for part in np.array_split(np.arange(len(rows)), (hi - lo).sum() // _PART + 1):
            cnt = (hi - lo)[part]
            at = np.flatnonzero(cnt > 0)
            if not len(at):
                keep.append(rows[part][need[part] <= 0])
                continue
            key = self._own(pairs[_ranges(lo[part], cnt)], np.repeat(item[part], cnt).astype(np.uint64))
            place = np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)
            held = np.zeros(len(part), np.int64)
            held[at] = np.add.reduceat((self.own[place] == key).astype(np.int64), (np.cumsum(cnt) - cnt)[at])
            keep.append(rows[part][held >= need[part]])
        return np.concatenate(keep)

    def match(self, h: np.ndarray, first: np.ndarray):
        """(text, item, distance, start, end) of all passages in many texts."""
        n = len(h)
        if not n or not self.ids:
            return []
        known = np.zeros(n + 1, np.int32)
        pairs = pair_hash(h)
        hit = self.pairs[(pairs >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)]
        hit[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < n)] - 1] = False  # no pair across texts
        np.cumsum(hit, out=known[1:n])
        known[n] = known[n - 1]
        found: dict[tuple[int, int], list[int]] = {}

        whole: dict[tuple[int, int], int] = {}  # first places of items that allow no edit

        def propose(rows):
            exact = self.room[rows[:, 1]] == 0
            for t, k, p in rows[exact].tolist():
                if p < whole.get((t, k), n) and p >= first[t] and np.array_equal(h[p: p + len(self.words[k])], self.words[k]):
                    whole[t, k] = p
            rows = rows[~exact]
            for t, k, p in self._possible(rows, pairs, known, first).tolist():
                found.setdefault((t, k), []).append(p)

        for rows in self._anchors(h, first):
            propose(rows)
        for lo, hi, need, keys, owner in self.classes:
            at = np.arange(n)
            inside = known[np.minimum(at + hi - 1, n - 1)] - known[at]
            start = np.flatnonzero(inside >= need)
            for part in np.array_split(start, max(1, len(start) // 20_000 + 1)):
                if not len(part):
                    continue
                text = np.searchsorted(first, part, side="right") - 1
                col = part[:, None] + np.arange(hi)
                words = np.where(col < first[text + 1][:, None], h[np.minimum(col, n - 1)], np.uint64(0))
                key = embed_keys(words, lo, lo) + np.arange(REPEATS, dtype=np.uint64)
                flat = key.ravel()
                a, b = np.searchsorted(keys, flat, "left"), np.searchsorted(keys, flat, "right")
                cnt = b - a
                src = np.repeat(np.arange(len(flat)) // REPEATS, cnt)
                propose(np.stack([text[src], owner[_ranges(a, cnt)], part[src]], axis=1))
        out = [(t, self.ids[k], 0, int(self.size[k]), p - int(first[t]), p - int(first[t]) + int(self.size[k])) for (t, k), p in whole.items()]
        for (t, k), places in found.items():
            item = self.words[k]
            room = allowed(len(item))
            places.sort()
            lo = hi = None
            spans = []
            for p in places:
                x, y = max(int(first[t]), p - room), min(int(first[t + 1]), p + len(item) + 2 * room)
                if hi is not None and x <= hi:
                    hi = max(hi, y)
                else:
                    if hi is not None:
                        spans.append((lo, hi))
                    lo, hi = x, y
            spans.append((lo, hi))
            best = min((edit_distance(item, h[x:y]) + (x,) for x, y in spans), key=lambda r: (r[0], r[3] + r[1]))
            if best[0] <= room:
                base = best[3] - int(first[t])
                out.append((t, self.ids[k], best[0], len(item), base + best[1], base + best[2]))
        return out


RESULT = "id long, item_id long, distance int, item_words int, start int, stop int"


def _blocks(benchmark: DataFrame):
    ids, texts, size = [], [], 0
    for row in benchmark.toLocalIterator():
        if row[0] is None or not row[1]:
            continue
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if len(ids) >= BLOCK_ROWS or size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _sent(spark, benchmark: DataFrame):
    """Broadcasts of the items' blocks, a list for each scan."""
    blocks = []
    for ids, texts in _blocks(benchmark):
        blocks.append(spark.sparkContext.broadcast(Items(ids, texts)))
        if len(blocks) == SCAN_BLOCKS:
            yield blocks
            blocks = []
    if blocks:
        yield blocks


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All (document, item) pairs where the document holds the item.

    ``docs``: (id, text), ``benchmark``: (item_id, text).  Returns RESULT: the least edit
    distance, the item's number of words, and the first and last + 1 word of the place.
    """
    spark = small_batches(docs).sparkSession
    docs = docs.select("id", "text")
    out = None
    for sent in _sent(spark, benchmark.select("item_id", "text")):

        def scan(batches, sent=sent):
            for batch in batches:
                name = batch.column(0).to_pylist()
                rows = []
                for i, _, data, offs in text_chunks(batch.column(1), 4_000_000):
                    h, _, _, first = word_hashes(data, offs, True)
                    for block in sent:
                        rows += [(name[i + t], *rest) for t, *rest in block.value.match(h, first)]
                cols = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "item_id", "distance", "item_words", "start", "stop"])

        found = docs.mapInArrow(lean(scan), RESULT)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], RESULT)
    first = F.min(F.struct("distance", "start", "stop", "item_words")).alias("m")
    return out.groupBy("id", "item_id").agg(first).select("id", "item_id", "m.distance", "m.item_words", "m.start", "m.stop")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns: scans alone, no join."""
    spark = small_batches(docs).sparkSession
    at = docs.columns.index(text_col)
    for sent in _sent(spark, benchmark.select("item_id", "text")):

        def scan(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _, data, offs in text_chunks(batch.column(at).cast(pa.string())):
                    h, _, _, first = word_hashes(data, offs, True)
                    for block in sent:
                        keep[[i + t for t, *_ in block.value.match(h, first)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(scan), docs.schema)
    return docs


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def _benchmark(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), F.col("text").cast("string"))


def query(spark, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` in ``documents``: (doc_id, item_id, distance, item_words, start, stop)."""
    return passages(_input(table(spark, sf_dir, "documents")), _benchmark(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go."""
    return clean(docs, _benchmark(spark, sf_dir))
