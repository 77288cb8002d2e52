"""Near duplicates by BagMinHash over multisets of five-word shingles.

Every shingle with weight w (its count in the text) owns one Poisson process for each dyadic
interval [0,1), [1,2), [2,4), [4,8), ... of the discretised weight axis.  An interval of length
L fires at rate L; a point carries a uniform position in the interval and a uniform signature
component, and counts only where the position lies below w.  A component of the signature is
the earliest point that counts, so two texts agree in a component with probability
sum(min)/sum(max): an unbiased weighted-Jaccard signature.  A process is followed only while its
time is below the largest component so far, so the work is about n + m ln m points a text, and
log2(w) processes a shingle.

Steps: (1) texts with the same word sequence collapse to one representative; (2) signatures of
representatives are cut in bands; (3) each is paired with the smallest of its bucket mates, then,
where the classes still differ, with the first and last of each of its buckets, and these pairs
are verified by exact weighted Jaccard; (4) pairs of one bucket that the links so far leave in different classes are compared too, in
blocks of bounded size that give out links only, so no link that the bands propose is lost; (5) classes are connected
components.

Defined results: rows without an id are left out; null, empty or wordless texts are classes of their own; texts of fewer than
five words have one shingle (all words); repeated rows share a class; of different texts with one id the one
with the smallest hash of its words stands for it; extra columns are ignored.
The class id is the smallest doc_id of the class.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, lean, mix, seeded, shingles, small_batches, stored, text_chunks, word_hashes

BANDS, ROWS = 25, 5
M = BANDS * ROWS
THRESHOLD = 0.8
#: Bytes of bags (12 a shingle) that step 4 compares with as many others at a time.
BLOCK_BYTES = 16 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BAND_SEED = seeded(BANDS, 9001)


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform floats in (0, 1] from 53 bits of a hash."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * (2.0 ** -53)


def bags(h: np.ndarray, offs: np.ndarray):
    """Distinct shingles of each text with their weights: (hash, weight, offsets)."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(hs)))
    return hs[at], weight, np.searchsorted(ds[at], np.arange(n + 1))


def signatures(h: np.ndarray, weight: np.ndarray, offs: np.ndarray, m: int = M) -> np.ndarray:
    """BagMinHash signatures, one row of m points (uint64, the point's own hash) for each text.

    A text without shingles keeps the largest value in all components.
    """
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    key, length, start, top, owner = [], [], [], [], []
    level, lo = 0, 0
    while True:  # one process for each shingle and dyadic interval that starts below its weight
        size = 1 if level == 0 else 1 << (level - 1)
        live = weight > lo
        if not live.any():
            break
        k = h[live] + np.uint64((level + 1) * 0xD1B54A32D192ED03 & MASK)
        key.append(mix(k))
        length.append(np.full(len(k), float(size)))
        start.append(np.full(len(k), float(lo)))
        top.append(weight[live].astype(np.float64))
        owner.append(doc[live])
        lo += size
        level += 1
    best = np.full(n * m, np.inf)
    name = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    if not key:
        return name.reshape(n, m)
    key, length, start, top, owner = map(np.concatenate, (key, length, start, top, owner))
    time = np.zeros(len(key))
    state = key.copy()
    while len(key):
        state = mix(state + _GOLD)
        time = time - np.log(_unit(state)) / length
        if len(time) and np.isfinite(best).any():
            limit = best.reshape(n, m).max(axis=1)
            live = time < limit[owner]
            if not live.all():
                key, length, start, top, owner, time, state = (x[live] for x in (key, length, start, top, owner, time, state))
                if not len(key):
                    break
        other = mix(state ^ np.uint64(0xA5A5A5A55A5A5A5A))
        part = (other % np.uint64(m)).astype(np.int64)
        where = start + length * _unit(mix(other))
        ok = where <= top if (length == 1.0).all() else (where < top) | (length == 1.0)
        cell, t, s = owner[ok] * m + part[ok], time[ok], state[ok]
        if len(cell):
            order = np.lexsort((s, t, cell))
            cell, t, s = cell[order], t[order], s[order]
            first = np.ones(len(cell), bool)
            first[1:] = cell[1:] != cell[:-1]
            cell, t, s = cell[first], t[first], s[first]
            better = t < best[cell]
            best[cell[better]] = t[better]
            name[cell[better]] = s[better]
    return name.reshape(n, m)


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Exact weighted Jaccard of two packed bags (sorted uint64 hashes, then int32 weights)."""
    na, nb = len(a) // 12, len(b) // 12
    ha, wa = np.frombuffer(a, np.uint64, na), np.frombuffer(a, np.int32, na, na * 8)
    hb, wb = np.frombuffer(b, np.uint64, nb), np.frombuffer(b, np.int32, nb, nb * 8)
    if not na or not nb:
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), nb - 1)
    both = np.minimum(wa, wb[at])[hb[at] == ha].sum(dtype=np.int64)
    return float(both) / float(wa.sum(dtype=np.int64) + wb.sum(dtype=np.int64) - both)


def _hash_pair(h: np.ndarray, first: np.ndarray):
    """Two independent 64-bit hashes of each text's word sequence, and the number of words."""
    cnt = np.diff(first)
    pos = np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], cnt).astype(np.uint64)
    out = []
    for seed in (0x1234567, 0x7654321):
        v = mix(h + mix(pos * _GOLD + np.uint64(seed)))
        total = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
        out.append(mix(total[first[1:]] - total[first[:-1]] + cnt.astype(np.uint64)))
    return out[0], out[1], cnt


SIG_SCHEMA = "id long, key_a long, key_b long, words long, bands array<long>, total long"


def _signed(batches):
    for batch in batches:
        ids = batch.column(0)
        for i, j, data, offs in text_chunks(batch.column(1), 1_000_000):
            h, _, _, first = word_hashes(data, offs)
            a, b, cnt = _hash_pair(h, first)
            bh, bw, bo = bags(*shingles(h, first))
            sig = signatures(bh, bw, bo)
            acc = np.zeros((j - i, BANDS), np.uint64)
            for r in range(ROWS):
                acc = mix(acc + sig[:, r::ROWS][:, :BANDS] * _GOLD + _BAND_SEED)
            total = np.add.reduceat(np.append(bw, 0), np.minimum(bo[:-1], len(bw))) * (np.diff(bo) > 0)
            flat = pa.array(acc.view(np.int64).ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(cnt), bands, pa.array(total.astype(np.int64))],
                ["id", "key_a", "key_b", "words", "bands", "total"],
            )


def _packer(wanted):
    """Bags of the texts whose id may be wanted: (bit map, its bits), or of all texts."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            if wanted is not None:
                held, bits = wanted.value
                spot = _spot(ids.to_numpy(), bits)
                batch = batch.filter(pa.array((held[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1))
                ids = batch.column(0)
            for i, j, data, offs in text_chunks(batch.column(1)):
                h, _, _, first = word_hashes(data, offs)
                bh, bw, bo = bags(*shingles(h, first))
                w = bw.astype(np.int32)
                bag = [bh[a:b].tobytes() + w[a:b].tobytes() for a, b in zip(bo[:-1], bo[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(bag, pa.binary())], ["id", "bag"])

    return run


#: Bits of the filter of wanted ids, about eight an id: 4 MB at least, 256 MB at most.
FILTER_BITS = (25, 31)


def _spot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit map with the hash of every id (a false hit costs work, never a row)."""

    def run(batches):
        for batch in batches:
            spot = np.unique(_spot(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(spot >> 15), pa.array(spot & 0x7FFF)], ["bucket", "bit"])

    rows = ids.mapInArrow(lean(run), "bucket long, bit long").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for bucket, held in rows.toLocalIterator():
        out[bucket << 12: (bucket + 1) << 12] = np.frombuffer(held, np.uint8)
    return out


def _chosen(batches):
    """Of ids with several texts the chosen one."""
    for batch in batches:
        a, b = (batch.column(c) for c in (2, 3))
        keep = np.ones(batch.num_rows, bool)
        for i, j, data, offs in text_chunks(batch.column(1)):
            h, _, _, first = word_hashes(data, offs)
            own = [x.view(np.int64) for x in _hash_pair(h, first)[:2]]
            for want, got in zip((a, b), own):
                want = want.slice(i, j - i)
                keep[i:j] &= np.array(want.is_null()) | (want.fill_null(0).to_numpy() == got)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in (0, 1)], ["id", "text"]).filter(pa.array(keep))


def _judged(batches):
    for batch in batches:
        sim = [weighted_jaccard(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], ["a", "b", "similarity"])


def _crossed(table: pa.Table) -> pa.Table:
    """Links between classes in one block pair of a bucket: enough of them to join the classes.

    A pair that meets in several buckets is compared in the first one only.
    """
    ids, blk, total = (table[c].to_numpy() for c in ("id", "blk", "total"))
    cls = table["cls"].to_numpy().copy()
    i, j, band = (table[c][0].as_py() for c in ("i", "j", "band"))
    keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, :band]
    bag = table["bag"].to_pylist()
    left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
    out = []
    for x in left:
        y = right[(cls[right] != cls[x]) & (ids[right] > ids[x] if i == j else ids[right] != ids[x])]
        y = y[np.minimum(total[y], total[x]) >= THRESHOLD * np.maximum(total[y], total[x])]
        y = y[~(keys[y] == keys[x]).any(axis=1)]
        for z in y:
            if cls[z] != cls[x] and weighted_jaccard(bag[x], bag[z]) >= THRESHOLD:
                out.append((min(ids[x], ids[z]), max(ids[x], ids[z])))
                cls[cls == cls[z]] = cls[x]
    a, b = zip(*out) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _bags(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, bag) of at least the texts with these ids: one scan, nothing but bags is moved.

    Beyond the largest bit map the texts are joined with the ids first.
    """
    bits = max(FILTER_BITS[0], (8 * ids.count()).bit_length())
    if bits <= FILTER_BITS[1]:
        wanted = texts.sparkSession.sparkContext.broadcast((_filter(ids, bits), bits))
    else:
        wanted, texts = None, texts.join(ids.distinct(), "id", "left_semi")
    return stored(texts.select("id", "text").mapInArrow(lean(_packer(wanted)), "id long, bag binary"), "bags").dropDuplicates(["id"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact similarity of id pairs (a, b): rows (a, b, similarity)."""
    if pairs.isEmpty():
        return pairs.select("a", "b", F.lit(0.0).alias("similarity"))
    packed = _bags(pairs.select(F.explode(F.array("a", "b")).alias("id")), texts)
    return (
        pairs.join(packed.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a")
        .join(packed.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b")
        .select("a", "b", "bag_a", "bag_b")
        .mapInArrow(lean(_judged), "a long, b long, similarity double")
    )


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (id, cls), cls the smallest id.

    Smallest-neighbour labels with pointer jumping: about log(diameter) rounds, each of them
    joins and partial minima; no list of a node's neighbours is ever gathered.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("cls")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "cls"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cls").alias("low"))
        step = labels.join(near, "id").select("id", F.col("cls").alias("old"), F.least("cls", "low").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("cls").alias("far"))
        new = stored(step.join(jump, "mid").select("id", "old", F.least("mid", "far").alias("cls")), "labels")
        if not new.filter("old <> cls").limit(1).count():
            return new.select("id", "cls")
        labels = new.select("id", "cls")


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are not in one class yet."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("id").alias(side), F.col("cls").alias(f"cls_{side}")), side, "left")
    return pairs.filter(F.coalesce("cls_a", "a") != F.coalesce("cls_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct id: (id, class_id).

    Rows that repeat an id are one document: the text whose words have the smallest hash stands for it.
    """
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    signed = stored(texts.mapInArrow(lean(_signed), SIG_SCHEMA), "signatures")
    one = F.struct("key_a", "key_b", "words")
    several = signed.groupBy("id").agg(F.min(one).alias("one"), F.max(one).alias("other")).filter("one <> other")
    several = stored(several.select("id", F.col("one.key_a").alias("one_a"), F.col("one.key_b").alias("one_b")), "several")
    if not several.isEmpty():
        texts = stored(texts.join(several, "id", "left").mapInArrow(lean(_chosen), "id long, text string"), "chosen")
        signed = signed.join(several, "id", "left").filter("one_a is null or (key_a = one_a and key_b = one_b)").drop("one_a", "one_b")
    own = F.when(F.col("words") == 0, F.col("id"))  # wordless texts are never copies of each other
    keys = signed.select("id", F.coalesce(own, F.col("key_a")).alias("key_a"), F.coalesce(own, F.col("key_b")).alias("key_b"), "words")
    reps = keys.groupBy("key_a", "key_b", "words").agg(F.min("id").alias("rep"))
    member = stored(keys.join(reps, ["key_a", "key_b", "words"]).groupBy("id").agg(F.min("rep").alias("rep"), F.max("words").alias("words")), "members")
    sigs = signed.join(member.filter("id = rep and words > 0").select("id"), "id", "left_semi").dropDuplicates(["id"])
    rows = sigs.select("id", F.posexplode("bands").alias("band", "value"))
    buckets = rows.groupBy("band", "value").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).filter("n > 1")
    inside = stored(rows.join(buckets, ["band", "value"]), "buckets")

    # First each text with the smallest of all its bucket mates, then with the ends of its buckets.
    pairs = stored(inside.groupBy("id").agg(F.min("lo").alias("a")).filter("a < id").select("a", F.col("id").alias("b")), "pairs")
    links = stored(verify(pairs, texts).filter(F.col("similarity") >= THRESHOLD), "verified")
    classes = components(links)
    ends = inside.select("lo", "hi", "id").distinct()
    star = ends.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("hi").alias("b")))).alias("p")).select("p.a", "p.b").filter("a < b").distinct()
    star = stored(_apart(star, classes).join(pairs, ["a", "b"], "left_anti"), "star")
    links = stored(links.unionByName(verify(star, texts).filter(F.col("similarity") >= THRESHOLD)), "verified")
    classes = components(links)

    # Buckets that still hold several classes: compare the rest, block by block.
    placed = inside.filter("n > 2").join(classes, "id", "left").withColumn("cls", F.coalesce("cls", "id"))
    mixed = placed.groupBy("band", "value").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).filter("c0 <> c1").select("band", "value")
    light = placed.join(mixed, ["band", "value"]).join(sigs.select("id", "total", "bands"), "id")
    mass = light.groupBy("band", "value").agg(F.sum("total").alias("mass"))
    blocks = F.ceil(F.col("mass") * 12 / BLOCK_BYTES).cast("int")
    todo = stored(light.join(mass, ["band", "value"]).withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")), "mixed")
    if not todo.isEmpty():
        bags_ = _bags(todo.select("id"), texts)
        full = todo.join(bags_, "id")
        dealt = full.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("band", "value", "id", "cls", "blk", "total", "bands", "bag", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
        cross = dealt.groupBy("band", "value", "i", "j").applyInArrow(_crossed, "a long, b long")
        links = stored(links.unionByName(cross.distinct().withColumn("similarity", F.lit(THRESHOLD))), "verified")
        classes = components(links)

    return (
        member.join(classes.select(F.col("id").alias("rep"), "cls"), "rep", "left")
        .select("id", F.coalesce("cls", "rep").alias("class_id"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Classes of near duplicates of the whole ``documents`` table: (doc_id, class_id)."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id stays.

    Rows that share an id but not the text are documents of their own: the one of smallest text
    hash goes by the id, the others by a hash of id and text.  Rows without an id all stay.
    """
    known = docs.filter("doc_id is not null").withColumn("neardup_key", F.col("doc_id").cast("long"))
    mark = F.xxhash64(F.col("text").cast("string"))
    twice = known.groupBy("neardup_key").agg(F.min(mark).alias("neardup_first"), F.max(mark).alias("neardup_last"))
    twice = stored(twice.filter("neardup_first <> neardup_last").drop("neardup_last"), "repeated")
    if not twice.isEmpty():
        other = F.col("neardup_first").isNotNull() & (mark != F.col("neardup_first"))
        known = stored(known.join(twice, "neardup_key", "left").withColumn("neardup_key", F.when(other, F.xxhash64("neardup_key", mark)).otherwise(F.col("neardup_key"))).drop("neardup_first"), "keyed")
    classes = near_duplicates(known.select("neardup_key", "text"), "neardup_key")
    if twice.isEmpty():
        keep = classes.filter("id = class_id").select(F.col("id").alias("neardup_key"))
    else:
        ids = known.select("neardup_key", F.col("doc_id").cast("long").alias("own")).distinct()
        best = F.min(F.struct("own", "id"))["id"].alias("neardup_key")
        keep = classes.join(ids, F.col("id") == F.col("neardup_key")).groupBy("class_id").agg(best).select("neardup_key")
    kept = known.dropDuplicates(["neardup_key"]).join(keep, "neardup_key", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))
