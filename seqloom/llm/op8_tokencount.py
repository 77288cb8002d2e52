"""Token counts by prefix dynamic programming over a sentencepiece BPE vocabulary.

A BPE encoding of a string ends in exactly one piece p such that the encoding of the rest ends
in a piece q and q, p are what BPE makes of the string q + p.  So, from left to right, each
prefix has one last piece, found among the pieces that end there, and its token count is one
more than that of the prefix before the piece: all prefixes are counted in one pass, and any
question about a truncation or a budget is a lookup, with no second encoding.

No piece of the vocabulary has a space after another character (checked when it is loaded), so
a text falls into units (spaces, then a word) whose counts add up.  Within a unit it is
cut further where two neighbours stand side by side in no piece.  The counts of all prefixes
of a unit are kept in a cache of bounded size; a text's table is its units' starts with running
totals.  Characters outside the vocabulary fall back to one token a byte.

Defined results: a null or empty text has 0 tokens; special strings in a text are ordinary
text; repeated rows give repeated rows; extra columns are ignored.
"""
from __future__ import annotations

from array import array
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

LIMIT = 4096
#: Units kept by a worker before its cache starts anew.
CACHE = 400_000


class PrefixCounter:
    def __init__(self, model: str, cache: int = CACHE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.score = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                self.score[sp.id_to_piece(i).replace("▁", " ")] = sp.get_score(i)
        #: Neighbours within some piece; two other neighbours can never be merged.
        self.inner = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}
        self.additive = not any(a != " " and b == " " for a, b in self.inner)
        self.ends: dict = {}  # pieces by their characters from the last to the first
        for p in self.score:
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        self.limit = cache
        self.runs: dict[str, list[int]] = {}
        self.units: dict[str, bytes | array] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def _merged(self, text: str) -> list[str]:
        """BPE of a short string: best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, q: str, p: str) -> bool:
        ok = self.fits.get((q, p))
        if ok is None:
            if len(self.fits) >= 4 * self.limit:
                self.fits.clear()
            ok = self.fits[(q, p)] = self._merged(q + p) == ([q, p] if q else [p])
        return ok

    def _run(self, text: str) -> list[int]:
        """Token counts of the prefixes of a run in which any two neighbours might be merged."""
        known = self.runs.get(text)
        if known is not None:
            return known
        n, score, fits, ends = len(text), self.score, self.fits, self.ends
        last, count = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            node, j = ends, i
            while j and (node := node.get(text[j - 1])) is not None:
                j -= 1
                p = node.get("")
                if p is not None:
                    q = last[j]
                    ok = fits.get((q, p))
                    if ok is None:
                        ok = self._fits(q, p)
                    if ok:
                        last[i], count[i] = p, count[j] + 1
                        break
            else:
                p = text[i - 1]
                last[i], count[i] = p, count[i - 1] + (1 if p in score else len(p.encode()))
        if len(self.runs) >= self.limit:
            self.runs.clear()
        self.runs[text] = count
        return count

    def unit(self, text: str):
        """Token counts of the prefixes of 1, 2, ... characters of one unit."""
        known = self.units.get(text)
        if known is not None:
            return known
        inner, a, count = self.inner, 0, []
        total = 0
        for i in range(1, len(text)):
            if text[i - 1: i + 1] not in inner:
                count += [total + c for c in self._run(text[a:i])[1:]]
                total, a = count[-1], i
        count += [total + c for c in self._run(text[a:])[1:]]
        out = bytes(count) if max(count) < 256 else array("q", count)
        if len(self.units) >= self.limit:
            self.units.clear()
        self.units[text] = out
        return out

    def parts(self, text: str) -> list[str]:
        """Units of a text, as the library sees it with its leading space."""
        if not text:
            return []
        if "▁" in text:
            text = text.replace("▁", " ")
        if not self.additive:
            return [" " + text]
        words = text.split(" ")
        if "" not in words:
            return [" " + w for w in words]
        out, spaces = [], 0
        for w in words:
            spaces += 1
            if w:
                out.append(" " * spaces + w)
                spaces = 0
        if spaces:
            out.append(" " * spaces)
        return out

    def count(self, text: str) -> int:
        unit, known = self.unit, self.units.get
        total = 0
        for u in self.parts(text):
            c = known(u)
            total += (c if c is not None else unit(u))[-1]
        return total

    def index(self, text: str) -> "PrefixIndex":
        return PrefixIndex(self, text)


class PrefixIndex:
    """Token counts of all prefixes of one text."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.length = len(text)
        self.starts, self.before, self.tables = [], [], []
        at, total = -1, 0  # the first unit begins with the library's own space
        for u in counter.parts(text):
            self.starts.append(at)
            self.before.append(total)
            self.tables.append(c := counter.unit(u))
            at += len(u)
            total += c[-1]
        self.total = total

    def count(self, n_chars: int) -> int:
        """Tokens of the first ``n_chars`` characters."""
        if n_chars <= 0:
            return 0
        k = bisect_right(self.starts, n_chars - 1) - 1
        return self.before[k] + self.tables[k][n_chars - self.starts[k] - 1]

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        if self.total <= budget:
            return self.length
        k = bisect_right(self.before, budget) - 1
        while k >= 0:
            table, room = self.tables[k], budget - self.before[k]
            fit = [i for i in range(len(table)) if table[i] <= room]
            if fit and self.starts[k] + fit[-1] + 1 > 0:
                return self.starts[k] + fit[-1] + 1
            k -= 1
        return 0


_counters: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    if model not in _counters:
        _counters[model] = PrefixCounter(model)
    return _counters[model]


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """``docs`` (id, text) to (id, n_bytes, n_tokens, over_limit, fit_chars).

    ``fit_chars``: characters of the longest prefix within the limit.
    """

    def run(batches):
        c = counter(model)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                n = c.count(t)
                out.append((len(t.encode()), n, n > limit, len(t) if n <= limit else c.index(t).longest(limit)))
            cols = list(zip(*out)) if out else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds))], ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return small_batches(docs).select("id", "text").mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def query(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return token_counts(docs, model).withColumnRenamed("id", "doc_id")
