"""Quality rules by distribution divergence, in DataFrame functions only.

Base measures count words (runs without white space), symbols, repeated lines and words in
repeated three-word windows.  The method compares two histograms of a document with those of
its language: classes of characters, and the language's COMMON most frequent short words
(1 to 5 letters, folded to lower case) against all other words.  The measure is the Jensen-Shannon
distance (base 2, so 0 to 1).  A document fails if a distance is over its limit and the text is
long enough for the histogram to mean something (the guards); the reference of a language holds
if the language has at least MIN_REFERENCE words.  How far words can be from a reference depends on
the language: a text with none of its common words is at ``far_words``, and the limit is WORD_SHARE of that.
Where the common words are so rare that this is below MIN_FAR, chance alone would come
near the limit, and the words aren't judged.

References are counted over all documents with a language: partial sums by language and by
(language, short word), and a row for every language in the end, however many there are.  Documents aren't
shuffled for the join with them as long as they are small enough to be broadcast, which
Spark sees from the size of their written table; three-word windows are found by sorting within the row.

Defined results: a null text has no words and fails the base rule; a null language, or one
without a reference, is judged by the base rule alone; repeated rows give repeated rows; extra
columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

COMMON = 20
MIN_REFERENCE = 10_000
MAX_CHAR, MIN_CHAR_WORDS = 0.30, 50
WORD_SHARE, MIN_FAR, MIN_WORD_WORDS = 0.7, 0.29, 200

SPACE = r"[\x20\x09-\x0D]+"
#: Patterns of the classes of characters; the last class is the rest.
CLASSES = (r"[^\p{Ll}]+", r"[^\p{Lu}]+", r"[^0-9]+", r"[^\x20\x09-\x0D]+", r"[^.,;:!?'\"()-]+")
LOWER = r"\p{Ll}+"


def let(value, body):
    """``body`` of a value that is computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text):
    return F.array_remove(F.split(text, SPACE), "")


def char_counts(text, white=None):
    known = [F.length(F.regexp_replace(text, p, "")) for p in CLASSES]
    known[0] = F.length(text) - F.length(F.regexp_replace(text, LOWER, ""))  # most of a text: quicker taken away
    if white is not None:  # known already
        known[3] = white
    return let(F.array(*known), lambda a: F.concat(a, F.array(F.length(text) - F.aggregate(a, F.lit(0), lambda s, x: s + x))))


def _repeat_words(words):
    """Words inside three-word windows that the text has twice or more."""
    n = F.size(words)
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), n - 2)

    def marked(s):
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(again, lambda i: F.get(s, i)["i"]))

    def covered(at):
        start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
        step = lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def sorted_all(g):
        pairs = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return let(F.sort_array(pairs), lambda s: covered(marked(s)))

    def among(g, again):
        at = F.transform(g, lambda h, i: F.when(F.array_contains(again, h), i).otherwise(F.lit(-1)))
        return covered(F.filter(at, lambda i: i >= 0))

    def count(g):
        again = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda h, i: (i > 0) & (h == F.get(s, i - 1)))))
        # a few repeated windows are looked up one by one, many by sorting with their positions
        return let(again, lambda r: F.when(F.size(r) == 0, F.lit(0)).when(F.size(r) <= 16, among(g, r)).otherwise(sorted_all(g)))

    return F.when(n < 4, F.lit(0)).otherwise(let(windows, count))


def common_counts(words, common):
    """How often each of ``common`` stands among the words, case folded.

    Words become their place in the list, 0 for others; one of each place is added, so that in
    sorted order the first of each place tells the counts.
    """
    place = F.transform(F.filter(words, lambda w: F.length(w) <= 5), lambda w: F.array_position(common, F.lower(w)).cast("int"))
    every = F.sequence(F.lit(0), F.size(common) + 1)
    first = let(F.sort_array(F.concat(place, every)), lambda s: F.transform(F.sequence(F.lit(1), F.size(common) + 1), lambda k: F.array_position(s, k).cast("int")))
    return let(first, lambda f: F.transform(F.slice(f, 2, F.size(common)), lambda x, i: (x - F.get(f, i) - 1).cast("double")))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text, lang) with words and base measures."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", words_of(F.col("text"))).withColumn("lines", lines)
    return out.select(
        "id", "text", "lang", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def references(docs: DataFrame) -> DataFrame:
    """(lang, char_ref, common, word_ref, far_words) of each language: shares, its common words, and
    the distance of a text that has none of them."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = len(CLASSES) + 1
    chars = known.select("lang", char_counts(F.col("text")).alias("c")).groupBy("lang").agg(*[F.sum(F.get("c", F.lit(k))).alias(f"c{k}") for k in range(size)])
    words = known.select("lang", F.explode(F.split(F.lower("text"), SPACE)).alias("w")).filter("w <> ''")
    short = F.when((F.length("w") <= 5) & F.col("w").rlike(r"^\p{L}{1,5}$"), F.col("w"))  # null: all other words
    counts = stored(words.groupBy("lang", short.alias("word")).agg(F.count("*").alias("k")), "counts")
    sums = stored(counts.groupBy("lang").agg(F.sum("k").alias("n")).join(chars, "lang"), "languages")
    total = sum((F.col(f"c{k}") for k in range(1, size)), F.col("c0"))
    langs = sums.filter(F.col("n") >= MIN_REFERENCE).select("lang", "n", F.array(*[F.col(f"c{k}") / total for k in range(size)]).alias("char_ref"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("k"), "word"))
    top = counts.filter("word is not null").select("lang", "word", "k").withColumn("rank", rank).filter(F.col("rank") <= COMMON)
    lists = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "k"))).alias("top"))  # COMMON a language
    share = F.transform("top", lambda x: x["k"] / F.col("n"))
    rest = F.col("rest")
    far = F.sqrt(F.greatest(F.lit(0.0), (F.lit(1.0) - rest + F.log2(2 / (1 + rest)) + F.when(rest > 0, rest * F.log2(2 * rest / (1 + rest))).otherwise(F.lit(0.0))) / 2))
    out = langs.join(lists, "lang", "left").withColumn("top", F.coalesce("top", F.expr("cast(array() as array<struct<rank:int,word:string,k:bigint>>)")))
    out = out.withColumn("rest", F.lit(1.0) - F.aggregate(share, F.lit(0.0), lambda s, x: s + x))
    return stored(out.select("lang", "char_ref", F.transform("top", lambda x: x["word"]).alias("common"), F.concat(share, F.array("rest")).alias("word_ref"), far.alias("far_words")), "references")


def distance(p, q):
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2))


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text, lang) to one row each: the base measures, both distances, the verdict."""
    rows = measured(docs).join(references(docs), "lang", "left")
    share = lambda counts, n: F.transform(counts, lambda x: x / n)
    found = common_counts(F.col("words"), F.col("common"))
    hist = let(found, lambda c: F.concat(c, F.array(F.col("n_words") - F.aggregate(c, F.lit(0.0), lambda s, x: s + x))))
    white = (F.length("text") - F.col("word_chars")).cast("int")
    chars = F.when(F.col("char_ref").isNotNull() & (F.col("n_words") >= MIN_CHAR_WORDS), distance(share(char_counts(F.col("text"), white), F.length("text")), F.col("char_ref")))
    words = F.when(F.col("char_ref").isNotNull() & (F.col("n_words") >= MIN_WORD_WORDS), distance(share(hist, F.col("n_words")), F.col("word_ref")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.withColumn("char_distance", chars).withColumn("word_distance", words)
    far = F.coalesce(F.col("char_distance") > MAX_CHAR, F.lit(False)) | F.coalesce((F.col("far_words") >= MIN_FAR) & (F.col("word_distance") > WORD_SHARE * F.col("far_words")), F.lit(False))
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def query(spark, sf_dir: str) -> DataFrame:
    return judged(_input(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, in the columns of ``docs``."""
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*docs.columns).alias("lang_row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # the row itself is carried through as the id, so that nothing has to be joined back
    # and written before the filter, which would else be evaluated where the words are made
    carried = stored(judged(whole.select(F.col("lang_row").alias("id"), "text", "lang")).select("id", "kept"), "judged")
    return carried.filter("kept").select(*[F.col("id")[c].alias(c) for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text, lang FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        [length(regexp_replace(t, '[^\p{{Ll}}]+', '', 'g')), length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')), length(regexp_replace(t, '[^0-9]+', '', 'g')),
         length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')), length(regexp_replace(t, '[^.,;:!?''"()-]+', '', 'g'))] AS c5 FROM d),
m AS (SELECT *, len(ws) AS n, list_concat(c5, [length(t) - list_sum(c5)]) AS c FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, n - 1)) AS i FROM m WHERE n > 2)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
langs AS (SELECT lang, sum(n) AS n, [sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4]), sum(c[5]), sum(c[6])] AS c, sum(length(t)) AS chars
          FROM m WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang HAVING sum(n) >= {MIN_REFERENCE}),
short AS (SELECT lang, word, count(*) AS k FROM (SELECT lang, unnest(regexp_split_to_array(lower(t), '{SPACE}')) AS word FROM m WHERE lang IS NOT NULL AND text IS NOT NULL)
          WHERE regexp_full_match(word, '\p{{L}}{{1,5}}') GROUP BY lang, word),
top AS (SELECT lang, list(word ORDER BY k DESC, word) AS common, list(k ORDER BY k DESC, word) AS ks
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, word) AS rk FROM short) WHERE rk <= {COMMON} GROUP BY lang),
ref AS (SELECT langs.lang, list_transform(c, lambda x: x / chars) AS char_ref, common, list_concat(list_transform(ks, lambda x: x / n), [1.0 - list_sum(ks) / n]) AS word_ref,
          1.0 - list_sum(ks) / n AS o, sqrt((1 - o + log2(2 / (1 + o)) + o * log2(2 * o / (1 + o))) / 2) AS far FROM langs JOIN top ON langs.lang = top.lang),
j AS (SELECT m.doc_id, m.n, m.ws, m.t, m.c, m.ls, ref.char_ref, ref.word_ref, ref.common, ref.far, coalesce(rep.n_repeat, 0) AS n_repeat
      FROM m LEFT JOIN rep ON m.doc_id = rep.doc_id LEFT JOIN ref ON m.lang = ref.lang),
h AS (SELECT *, list_transform(c, lambda x: x / length(t)) AS p, list_transform(common, lambda w: len(list_filter(ws, lambda x: lower(x) = w))) AS f FROM j),
h2 AS (SELECT *, list_transform(list_concat(f, [n - list_sum(f)]), lambda x: x / n) AS q FROM h),
z AS (SELECT *, sqrt(greatest(0, list_sum(list_transform(range(1, 7), lambda i: CASE WHEN p[i] > 0 THEN p[i] * log2(2 * p[i] / (p[i] + char_ref[i])) ELSE 0 END + CASE WHEN char_ref[i] > 0 THEN char_ref[i] * log2(2 * char_ref[i] / (p[i] + char_ref[i])) ELSE 0 END)) / 2)) AS cd,
        sqrt(greatest(0, list_sum(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN q[i] > 0 THEN q[i] * log2(2 * q[i] / (q[i] + word_ref[i])) ELSE 0 END + CASE WHEN word_ref[i] > 0 THEN word_ref[i] * log2(2 * word_ref[i] / (q[i] + word_ref[i])) ELSE 0 END)) / 2)) AS wd
      FROM h2 WHERE n >= 50),
v AS (SELECT doc_id, coalesce(cd > {MAX_CHAR}, FALSE) OR (n >= {MIN_WORD_WORDS} AND coalesce(far >= {MIN_FAR} AND wd > {WORD_SHARE} * far, FALSE)) AS far FROM z)
SELECT j.doc_id, CAST(j.n AS BIGINT) AS n_words, CAST(length(array_to_string(j.ws, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(j.t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(j.ls) - len(list_distinct(j.ls)) AS BIGINT) AS n_dup_lines,
       CAST(j.n_repeat AS BIGINT) AS n_repeat_words, (j.n < 50 OR 100 * j.n_repeat > 50 * j.n) AS base_failed,
       NOT (j.n < 50 OR 100 * j.n_repeat > 50 * j.n) AND NOT coalesce(v.far, FALSE) AS kept
FROM j LEFT JOIN v ON j.doc_id = v.doc_id
"""
