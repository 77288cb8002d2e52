"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of orders 0 to ORDER is counted on training texts and then
frozen.  The probability of a byte s after a context c, with n bytes of q kinds seen after c, is
count(s)/(n + q); a byte not seen there first pays the escape q/(n + q) and is then predicted by
the next shorter context, at last by 1/256.  A context that was never seen costs nothing and
passes on to the shorter one.  The sum of -log2 p over a text is its exact code length; the
language with the shortest code wins, ties going to the first name in order.  ``score`` is the
winner's share of 2^(-code length), which is between 1/languages and 1.

The trees are flattened to tables: each seen gram has a row with its code length in all
languages, and each seen context a row with its escapes, so a byte costs one look-up, and the
bytes of an unseen gram one more for each order.

Training uses at most SAMPLE_DOCS documents of a language, those of smallest hash, and of their whole
texts at most SAMPLE_BYTES (of many languages TOTAL_BYTES in all, in equal parts), but always one
text.  The bounds do not depend on the size of the input, and every value of lang is learned.  The documents are
found by a threshold of the hash for each language, so no task sorts a language's rows.  The driver counts one
language's texts at a time and holds only the counts.  Tables are dense for GROUP languages at most; of
more, a worker makes and drops the tables of one group after the other for each BUNDLE of text.

Defined results: texts that are null or have no letter are ``und`` with score 0; without any
training row all texts are ``und``; repeated rows give repeated rows; extra columns are ignored.
"""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table, text_chunks

ORDER = 3
SAMPLE_DOCS = 600
SAMPLE_BYTES, TOTAL_BYTES = 3_000_000, 256_000_000
GROUP, BUNDLE = 32, 64 << 20
HELD_OUT = 2


def held_out(col="doc_id"):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Packed big-endian k-grams that end at each byte from the k-th on."""
    out = np.zeros(max(len(data) - k + 1, 0), np.uint32)
    for j in range(k):
        out = (out << np.uint32(8)) | data[j: j + len(out)]
    return out


def gram_counts(texts: list[bytes], order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams of 1 to order + 1 bytes of some texts, and how often each is there."""
    out = []
    for k in range(1, order + 2):
        got = [_grams(np.frombuffer(t, np.uint8), k) for t in texts]
        grams, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint32), return_counts=True)
        out.append((grams, n.astype(np.int32)))
    return out


class Ppm:
    """Frozen context trees of several languages, from the ``gram_counts`` of each."""

    def __init__(self, counted: dict[str, list], order: int = ORDER):
        self.order, self.key = order, uuid.uuid4().hex
        self.langs = sorted(counted)
        self.grams, self.counts = [], []  # for k = 1 .. order + 1: sorted grams, languages x grams
        for k in range(1, order + 2):
            per = [counted[lang][k - 1] for lang in self.langs]
            every = np.unique(np.concatenate([g for g, _ in per])) if per else np.zeros(0, np.uint32)
            count = np.zeros((len(self.langs), len(every)), np.int32)
            for row, (g, c) in zip(count, per):
                row[np.searchsorted(every, g)] = c
            self.grams.append(every)
            self.counts.append(count)
        self.ready = False

    def build(self) -> "Ppm":
        """Tables of code lengths (bits): made once in each worker."""
        if self.ready:
            return self
        n_lang = len(self.langs)
        self.code, self.escape, self.child = [], [], []
        low = np.full((n_lang, 1), 8.0)
        for k in range(1, self.order + 2):
            grams, count = self.grams[k - 1], self.counts[k - 1]
            ctx = grams >> np.uint32(8) if k > 1 else np.zeros(len(grams), np.uint32)
            parents = self.grams[k - 2] if k > 1 else np.zeros(1, np.uint32)
            at = np.searchsorted(parents, ctx)
            n = np.zeros((n_lang, len(parents)))
            q = np.zeros((n_lang, len(parents)))
            for i in range(n_lang):
                n[i] = np.bincount(at, count[i], len(parents))
                q[i] = np.bincount(at, count[i] > 0, len(parents))
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(n > 0, -np.log2(q / (n + q)), 0.0)
                seen = -np.log2(count / (n + q)[:, at])
            # the shorter gram of a seen gram is seen too, so its row is there
            shorter = low[:, np.searchsorted(self.grams[k - 2], grams & np.uint32((1 << 8 * (k - 1)) - 1))] if k > 1 else np.broadcast_to(low, (n_lang, len(grams)))
            code = np.where(count > 0, seen, esc[:, at] + shorter)
            self.escape.append(np.ascontiguousarray(esc.T, np.float32))
            self.code.append(np.ascontiguousarray(code.T, np.float32))
            step = np.full(len(parents) * 256, -1, np.int32)  # (row of context, byte) -> row of gram
            step[at * 256 + (grams & np.uint32(255)).astype(np.int64)] = np.arange(len(grams), dtype=np.int32)
            self.child.append(step)
            low = code
        self.ready = True
        return self

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code lengths (texts x languages) of many texts that lie end to end."""
        n, top = len(data), self.order + 1
        out = np.zeros((n, len(self.langs)), np.float32)
        pos = np.arange(n, dtype=np.int64) - np.repeat(offs[:-1], np.diff(offs))
        node = [np.zeros(n, np.int32)]  # node[k]: row of the k-gram that ends here, -1 if unseen
        byte = data.astype(np.int32)
        for k in range(1, top + 1):
            prev = node[0] if k == 1 else np.concatenate([[-1], node[k - 1][:-1]]).astype(np.int32)
            got = np.where(prev >= 0, self.child[k - 1][np.maximum(prev, 0) * 256 + byte], -1)
            if k > 1:
                got[pos < k - 1] = -1
            node.append(got)
        todo = np.arange(n)
        for k in range(top, 0, -1):
            row = node[k][todo]
            hit = row >= 0
            out[todo[hit]] += self.code[k - 1][row[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if k > 1:  # pay the escape of the context, if it was ever seen
                back = todo[pos[todo] >= k - 1]
                ctx = node[k - 1][back - 1]
                known = ctx >= 0
                out[back[known]] += self.escape[k - 1][ctx[known]]
            else:
                out[todo] += self.escape[0][0] + np.float32(8.0)
        total = np.zeros((len(offs), len(self.langs)))
        np.cumsum(np.add.reduceat(np.vstack([out, np.zeros((1, out.shape[1]), np.float32)]).astype(np.float64), offs[:-1], axis=0) * (np.diff(offs) > 0)[:, None], axis=0, out=total[1:])
        return np.diff(total, axis=0)


def choose(bits: np.ndarray):
    """(index of the winner, score) of each row of code lengths."""
    win = bits.argmin(axis=1)
    gap = bits - bits[np.arange(len(bits)), win][:, None]
    return win, 1.0 / np.exp2(-np.minimum(gap, 1000.0)).sum(axis=1)


class Model:
    """The counts of all languages, and their tables by groups."""

    def __init__(self, counted: dict[str, list], order: int = ORDER):
        self.key, self.order, self.counted = uuid.uuid4().hex, order, counted
        self.langs = sorted(counted)
        self.one: Ppm | None = None  # the tables, if there is one group

    def __getstate__(self):
        return self.__dict__ | {"one": None}

    def bits(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Code lengths (texts x languages) of each part, (bytes, offsets)."""
        if len(self.langs) <= GROUP:
            self.one = self.one or Ppm(self.counted, self.order).build()
            return [self.one.bits(*p) for p in parts]
        out: list[list] = [[] for _ in parts]
        for i in range(0, len(self.langs), GROUP):
            ppm = Ppm({x: self.counted[x] for x in self.langs[i: i + GROUP]}, self.order).build()
            for have, p in zip(out, parts):
                have.append(ppm.bits(*p))
        return [np.hstack(x) for x in out]


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Learn from ``docs`` (id, text, lang) whose id isn't held out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    rows = rows.select("lang", "text", F.xxhash64("id").alias("h"))
    # about twice as many rows as wanted lie below a language's threshold: too few with a chance of e^-100
    share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_DOCS + 100) / F.col("n"))
    marks = stored(rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(-(2.0 ** 63)) + share * F.lit(2.0 ** 64)).alias("below")), "thresholds")
    near = rows.join(marks, "lang").filter(F.col("h") <= F.col("below")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = stored(near.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_DOCS), "training")
    counted: dict[str, list] = {}
    room = min(SAMPLE_BYTES, TOTAL_BYTES // max(1, marks.count()))
    now, texts, size = None, [], 0
    for lang, text in picked.select("lang", "text", "rank").orderBy("lang", "rank").select("lang", "text").toLocalIterator():
        if lang != now:
            if texts:
                counted[now] = gram_counts(texts, order)
            now, texts, size = lang, [], 0
        raw = text.encode()
        if raw and (not texts or size + len(raw) <= room):
            texts.append(raw)
            size += len(raw)
    if texts:
        counted[now] = gram_counts(texts, order)
    return Model(counted, order)


_models: dict[str, Model] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (id, text) to (id, held_out, lang_pred, score); only the text is looked at."""
    if not model.langs:
        return docs.select("id", F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    few = len(model.langs) <= GROUP

    def run(batches):
        m = sent.value
        if m.key not in _models:
            _models.clear()
            _models[m.key] = m
        m = _models[m.key]
        names = np.array(m.langs, object)

        def scored(held):
            cut = [(b, i, j, data, offs) for b in held for i, j, data, offs in text_chunks(b.column(1), 1_000_000)]
            for (b, i, j, _, _), bits in zip(cut, m.bits([x[3:] for x in cut])):
                win, score = choose(bits)
                letters = np.array([any(map(str.isalpha, t or "")) for t in b.column(1).slice(i, j - i).to_pylist()], bool)
                pred = np.where(letters, names[win], "und")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0))], ["id", "held_out", "lang_pred", "score"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if few or size >= BUNDLE:
                yield from scored(held)
                held, size = [], 0
        yield from scored(held)

    flagged = docs.select("id", "text", F.coalesce(held_out("id"), F.lit(False)).alias("held_out"))
    return flagged.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(docs.select("id", "text"), train(docs)).withColumnRenamed("id", "doc_id")
