"""Personal data: high-recall generators, gradient-boosted trees, calibrated thresholds.

Four base kinds follow fixed patterns (see ``base_spans``) and always stay.  Beyond them,
generators with loose patterns propose spans, which may overlap: numbers that look like phones,
national ids, IBANs, cards, addresses of machines, written-out mail addresses and credentials.
Boosted trees of depth DEPTH score each proposal from its format (lengths, classes of
characters, entropy, check digits) and its context (words before, neighbours).  The scores are
calibrated by Platt scaling on a held-out part of the training set, and each kind has the lowest
threshold whose precision there reaches PRECISION.  Of selected spans that overlap, the one of
higher score stays; none may touch a base span.

The trees are trained here, on TRAIN_ROWS examples that a seeded generator writes (formats of
personal data, and look-alikes: dates, prices, versions, part numbers, sums).  That number is the
bound of the training sample and doesn't depend on the input.

Offsets are code points, ends exclusive.  Defined results: a null text is empty and has no
spans; repeated rows give repeated rows; extra columns are ignored; whole texts are searched.
"""
from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "iban", "national_id", "email_like", "ip_like", "phone_like")
KINDS = BASE + EXTRA
TRAIN_ROWS = 6_000
TREES, DEPTH, RATE = 60, 3, 0.2
PRECISION = 0.98

# ------------------------------------------------------------------ base kinds

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, so nothing is tried inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches, found from each @ outwards: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            yield s, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the four base kinds, leftmost and non-overlapping within each kind."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if _is_ip(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


# ------------------------------------------------------------------ proposals

_DOT = r"\.|[ ]?[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]?|[ ]dot[ ]"
_COLONS = re.compile(r"::|(?::[0-9A-Fa-f]{1,4}){4}")
_GROUP = re.compile(r"[0-9]+")
_GENERATORS = (
    ("secret", re.compile(r"[=:][ ]?[\"']?([A-Za-z0-9+/_.~-]{12,})"), 1),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0),
    ("national_id", re.compile(r"(?<![0-9.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"), 0),
    ("email_like", re.compile(rf"(?:[\[({{<][ ]?at[ ]?[\])}}>]|(?<=[ ])at(?=[ ][A-Za-z0-9-]+(?:{_DOT})[A-Za-z]))[ ]?(?:[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT})[A-Za-z0-9-]{{1,63}})+(?<=[A-Za-z]{{2}})|[A-Za-z0-9-]{{1,63}}[ ]?\.[ ]?[A-Za-z]{{2,}})", re.I), 0),
)
_NEED = {"iban": re.compile(r"[A-Z]{2}[0-9]{2}"), "email_like": re.compile(r"(?i:[\[({< ]at[\])}> ])"), "secret": re.compile(r"[=:]")}
#: Credentials after a word that announces them, without = or :.
_BEARER = re.compile(r"(?<![A-Za-z])(?:bearer|basic|token|key|secret|passw(?:or)?d|pwd)(?:[ ]is)?[ ]+[\"']?([A-Za-z0-9+/_.~-]{12,}=*)", re.I)
_NAME = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?:(?:{_DOT})[A-Za-z0-9_%+-]{{1,64}})*[ ]?\Z", re.I)
_ADDRESS6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]+(?:\.[0-9]{1,3}){0,3}")
_RUN = re.compile(r"(?<![0-9A-Za-z])[0-9]+(?:[ ()./\u00a0\u2013-]{1,3}[0-9]+)*")
#: Digits of a number that may be a phone; groups of a part of a longer run.
PHONE_DIGITS, PHONE_GROUPS = (7, 15), 6


def _addresses6(text: str):
    for m in _ADDRESS6.finditer(text) if _COLONS.search(text) else ():
        s, e = m.span()
        if text.startswith(":", s) and not text.startswith("::", s):
            s += 1
        elif s and text[s - 1].isalnum():  # the end of a word
            continue
        if text[e - 1] == ":" and text[e - 2] != ":":
            e -= 1
        groups = text[s:e].split(":")
        if e < len(text) and text[e].isalnum() or not any(groups) or len(groups) > 9 or max(map(len, groups[:-1]), default=0) > 4:
            continue
        if "::" in text[s:e] or len(groups) > 4:
            yield s, e


def _phones(text: str):
    """Runs of digits and separators; of long runs each few groups, of others also what spaces part."""
    least, most = PHONE_DIGITS
    for m in _RUN.finditer(text):
        if m.end() - m.start() < least:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
        size = [e - s for s, e in groups]
        ends = set()
        if least <= sum(size) <= most:
            ends.add((0, len(groups) - 1))
            i = 0
            for j in range(len(groups)):
                if j + 1 == len(groups) or text[groups[j][1]] in " \u00a0":
                    if sum(size[i: j + 1]) >= least:
                        ends.add((i, j))
                    i = j + 1
        elif sum(size) > most:
            for i in range(len(groups)):
                n = 0
                for j in range(i, min(i + PHONE_GROUPS, len(groups))):
                    n += size[j]
                    if n > most:
                        break
                    if n >= least:
                        ends.add((i, j))
        for i, j in sorted(ends):
            s, e = groups[i][0], groups[j][1]
            if s and text[s - 1] == "(" and ")" in text[s:e]:
                s -= 1
            yield s - (s > 0 and text[s - 1] == "+"), e


_CUES = {
    "secret": ("token", "key", "secret", "passw", "pwd", "auth", "bearer", "credential"),
    "iban": ("iban", "account", "konto", "bank", "cuenta", "compte"),
    "national_id": ("ssn", "social", "id", "national", "tax"),
    "ip_like": ("ip", "host", "server", "address"),
    "phone_like": ("phone", "tel", "call", "mobile", "cell", "fax", "contact"),
    "email_like": ("mail", "contact", "write"),
}
_DOT_WORD = re.compile(r"[ \[({<](?:dot|at)[ \])}>]", re.I)
_COUNTER_CUES = re.compile(r"\b(?:version|date|isbn|price|total|page|part|order|sha|md5|commit|http|www)\b")


def proposals(text: str):
    """(start, end, kind) of all loose matches; kinds may overlap."""
    for kind, pattern, group in _GENERATORS:
        if kind in _NEED and not _NEED[kind].search(text):
            continue
        for m in pattern.finditer(text):
            s, e = m.span(group)
            if kind == "email_like":  # the name stands before the written-out @
                name = _NAME.search(text, max(0, s - 140), s)
                if not name or name[0] == " ":
                    continue
                s = name.start()
            yield s, e, kind
    yield from ((*m.span(1), "secret") for m in _BEARER.finditer(text))
    yield from ((s, e, "ip_like") for s, e in _addresses6(text))
    yield from ((s, e, "phone_like") for s, e in _phones(text))


#: Digits that a number goes on with, past a separator.
_MORE = re.compile(r"[ ()./\u00a0\u2013-]{1,3}([0-9]+)")
_LESS = re.compile(r"([0-9]+)[ ()./\u00a0\u2013-]{1,3}\Z")


def features(text: str, s: int, e: int, kind: str) -> list[float]:
    x = text[s:e]
    n = len(x)
    digits = sum(c.isdigit() for c in x)
    upper = sum("A" <= c <= "Z" for c in x)
    lower = sum("a" <= c <= "z" for c in x)
    hexa = sum(c in "0123456789abcdefABCDEF" for c in x)
    counts = Counter(x)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    change = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(x, x[1:]))
    runs = re.findall(r"[0-9]+", x)
    before = text[max(0, s - 40): s].lower()
    near = before[-18:]
    d = _digits(x)
    iban = 0
    if kind == "iban":
        flat = x.replace(" ", "")
        iban = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    valid_id = kind == "national_id" and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    after, less = _MORE.match(text, e, e + 20), _LESS.search(text, max(0, s - 20), s)
    shape = [len(g) for g in runs]
    return [
        float(EXTRA.index(kind)), n, digits / n, upper / n, lower / n, hexa / n, (n - digits - upper - lower) / n,
        entropy, change / n, len(runs), max(map(len, runs), default=0), len(d), float(luhn(d)) if d else 0.0, float(iban), float(valid_id),
        float(any(c in near for c in _CUES[kind])), float(any(c in before for c in _CUES[kind])), float(bool(_COUNTER_CUES.search(before))),
        float(near[-1:].isalnum()), float(near.rstrip()[-1:] in ("=", ":", '"', "'")), float(text[e: e + 1].isalnum()), x.count("-"), x.count("."), x.count(" "), x.count("/"), x.count("("),
        len(after[1]) if after else 0, len(less[1]) if less else 0, x.count(":"), x.count("::"), shape[0] if shape else 0, shape[-1] if shape else 0,
        float(x[:1] == "0"), float(x[:2] in ("19", "20")), float(bool(_DOT_WORD.search(x))) if kind == "email_like" else 0.0,
    ]


# ------------------------------------------------------------------ training set

def examples(rows: int, seed: int = 11):
    """(text, start, end, kind, is personal data), written by a seeded generator."""
    r = random.Random(seed)
    prose = lambda: " ".join("".join(r.choice("abcdeéilmnorstuö") for _ in range(r.randint(2, 9))) for _ in range(r.randint(2, 8)))
    digs = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    chars = lambda n, a: "".join(r.choice(a) for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def iban(good):
        body = r.choice(["DE", "FR", "GB", "ES", "NL"]) + "00" + digs(r.choice([14, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        v = body[:2] + f"{check if good else (check + r.randint(1, 90)) % 97:02d}" + body[4:]
        return " ".join(v[i:i + 4] for i in range(0, len(v), 4)) if r.random() < 0.5 else v

    def long_key():
        return r.choice([
            "eyJ" + chars(r.randint(15, 60), alnum) + "." + chars(r.randint(60, 1200), alnum + "-_") + "." + chars(r.choice([43, 86, 342]), alnum + "-_"),
            chars(r.randint(100, 2000), alnum + "+/"), chars(r.choice([128, 256, 512, 1024]), "0123456789abcdef"),
        ])

    def long_path():
        return r.choice("/-_.").join(chars(r.randint(2, 9), "abcdeilmnorstu") for _ in range(r.randint(4, 200)))

    def made(kind, good):
        cue = r.choice(_CUES[kind]) + r.choice([": ", " = ", " ", " is "]) if r.random() < 0.6 else prose()[:12] + " "
        if kind == "secret" and r.random() < 0.25:  # announced by a word alone
            if good:
                return r.choice(["Authorization Bearer ", "bearer ", "Bearer ", "the token ", "key ", "secret is ", "password is ", "Basic "]), r.choice([chars(r.choice([32, 40, 64]), "0123456789abcdef"), chars(r.randint(16, 44), alnum), long_key()])
            return r.choice(["bearer ", "basic ", "token ", "key ", "secret ", "the password "]), r.choice([chars(r.randint(12, 22), "aeilnorstuy"), chars(6, "abcdef") + "-" + chars(8, "ghiklm"), chars(12, "abcdeilnorst") + ".", chars(7, "abcde") + "/" + chars(7, "ilnorst")])
        if kind == "secret":
            name = r.choice(["token", "api_key", "secret", "password", "auth_token", "passwd", "private_key", "KEY"])
            sep, q = r.choice([" = ", "=", ": ", ":"]), r.choice(['"', "'", ""])
            if good:
                return f"{name}{sep}{q}", r.choice([chars(r.choice([32, 40, 64]), "0123456789abcdef"), chars(r.randint(20, 44), alnum), "sk-" + chars(32, alnum), "AKIA" + chars(16, alnum[:26] + "0123456789"), long_key()])
            word = r.choice(["note", "url", "title", "see", "name", "http", "class", "sha", "md5", "commit", "path"])
            return f"{word}{sep}{q}", r.choice([chars(r.randint(12, 22), "aeilnorst"), "//" + chars(8, "abcdefg") + ".example.com/" + chars(5, "abc"), digs(4) + "-" + digs(2) + "-" + digs(2) + "T" + digs(2), chars(6, "abcdef") + "-" + chars(8, "ghiklm"), chars(9, "xyz") + "_" + chars(8, "abc"), digs(12) + ".00", long_path()])
        if kind == "iban":
            return cue, iban(good)
        if kind == "national_id":
            sep = r.choice("- ")
            if good:
                return r.choice(["ssn: ", "social security ", "SSN ", "tax id "]) if r.random() < 0.8 else prose() + " ", f"{r.randint(1, 665):03d}{sep}{r.randint(1, 99):02d}{sep}{r.randint(1, 9999):04d}"
            return r.choice(["part ", "order ", "page ", "total ", prose() + " "]), f"{r.choice(['000', '666', str(r.randint(900, 999))])}{sep}{digs(2)}{sep}{digs(4)}"
        if kind == "ip_like":
            if good:
                groups = lambda n: ":".join(chars(r.randint(1, 4), "0123456789abcdef") for _ in range(n))
                left = r.randint(1, 4)
                short = r.choice(["2001:db8", "2a02:" + groups(1), "fe80", "fd" + chars(2, "0123456789abcdef"), "2" + groups(1)[:3] + ":" + groups(left)]) + "::" + groups(r.randint(1, 7 - left - 2 if left < 4 else 2))
                return (cue if r.random() < 0.7 else prose() + " "), r.choice([groups(8), short])
            return r.choice(["time ", "total ", prose() + " "]), r.choice([":".join(digs(2) for _ in range(r.randint(5, 6))), chars(r.randint(1, 3), "abcdef") + "::" + chars(r.randint(1, 4), "abcdef"), "::" + chars(r.randint(1, 4), "abcdef"), digs(1) + "::" + digs(1)])
        if kind == "phone_like":
            if good:
                gap = r.choice([" ", "-", ".", "/"])
                tail = " " + r.choice(["2", "10", "24"]) + " times" if r.random() < 0.1 else ""
                return r.choice(["tel ", "phone: ", "call ", "mobile ", "fax: ", "contact ", "call me on ", "Tel. ", "my cell "]), r.choice([
                    f"({digs(3)}) {digs(3)}-{digs(4)}", f"({digs(3)}){gap if r.random() < 0.3 else ''}{digs(3)}-{digs(4)}", f"{digs(3)}-{digs(3)}-{digs(4)}", f"0{digs(3)} {digs(3)} {digs(3)}",
                    f"0{digs(1)} {digs(2)} {digs(2)} {digs(2)} {digs(2)}", f"0{digs(r.randint(2, 4))}{gap}{digs(r.randint(5, 8))}", f"{digs(3)}{gap}{digs(4)}", f"0{digs(r.randint(8, 11))}", f"00{digs(2)} {digs(r.randint(2, 4))} {digs(r.randint(4, 7))}", digs(10),
                ]), tail
            return r.choice(["date ", "version ", "price ", "total ", "isbn ", "order ", "page ", prose() + " ", prose() + " "]), r.choice([
                f"{r.randint(1900, 2100)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{digs(2)}.{digs(2)}.{digs(4)}", f"{digs(3)} {digs(3)} {digs(3)}", f"{digs(4)} {digs(4)} {digs(4)}", f"{digs(2)}-{digs(2)}-{digs(2)}{digs(2)}",
                digs(r.randint(7, 13)), f"{digs(r.randint(1, 4))}.{digs(r.randint(6, 9))}", f"{digs(4)}-{digs(4)}", f"{r.randint(1900, 2100)} {digs(4)}", f"{digs(2)}/{digs(2)}/{r.randint(1900, 2100)}", f"97{digs(1)}-{digs(1)}-{digs(4)}-{digs(4)}-{digs(1)}", f"{digs(4)} {digs(4)} {digs(4)} {digs(4)} {digs(4)}",
            ])
        word = lambda: chars(r.randint(2, 9), "abcdeinorst")
        if good:
            at = r.choice(["[at]", "(at)", "at", "{at}", "[AT]"])
            dot = " dot " if at == "at" else r.choice([".", " [dot] ", " (dot) ", " dot "])
            name = word() + r.choice(["", "", "." + word(), dot.replace(".", "_") + word()])
            return (cue if at != "at" or r.random() < 0.5 else prose() + " mail "), f"{name} {at} {chars(6, 'abcdeinorst')}{dot}{r.choice(['', '', word() + dot])}{r.choice(['com', 'org', 'net', 'de', 'co' + dot + 'uk'])}"
        if r.random() < 0.4:
            return r.choice(["look ", "met ", prose() + " "]), f"{word()} at {word()}.{word()}"
        return cue, f"{chars(2, 'abcdeinorst')} (at) {chars(2, 'abcde')}. {chars(3, 'ghik')}"

    while rows:
        kind, good = r.choice(EXTRA), r.random() < 0.5
        head, body, *tail = made(kind, good)
        text = f"{prose()} {head}"
        start = len(text)
        text += body + "".join(tail) + (r.choice(['"', "'", ""]) if kind == "secret" else "") + r.choice([" ", ". ", ", "]) + prose()
        over = [(s, e) for s, e, k in proposals(text) if k == kind and s < start + len(body) and e > start]
        whole = (start, start + len(body))
        others = [x for x in over if x != whole]
        if kind == "phone_like" and good and others and (whole not in over or r.random() < 0.3):
            yield text, *r.choice(others), kind, False  # a part of the number, or more than it
            rows -= 1
        elif over:
            yield text, *(whole if whole in over else over[0]), kind, good
            rows -= 1


class Trees:
    """Gradient-boosted regression trees with logistic loss, and Platt scaling."""

    def __init__(self):
        self.trees, self.bias, self.platt, self.cut = [], 0.0, (1.0, 0.0), {}
        self._arrays = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        p = y.mean()
        self.bias = math.log(p / (1 - p))
        f = np.full(len(y), self.bias)
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob)
            tree: dict[int, tuple] = {}
            node = np.zeros(len(y), np.int64)
            for depth in range(DEPTH + 1):
                for k in range((1 << depth) - 1, (2 << depth) - 1):
                    own = np.flatnonzero(node == k)
                    if not len(own):
                        continue
                    best = (1e-6, None, None)
                    total_g, total_h = g[own].sum(), h[own].sum()
                    if depth < DEPTH:
                        for j, e in enumerate(edges):
                            if not len(e):
                                continue
                            cg = np.cumsum(np.bincount(binned[own, j], g[own], len(e) + 1))[:-1]
                            ch = np.cumsum(np.bincount(binned[own, j], h[own], len(e) + 1))[:-1]
                            gain = cg ** 2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g ** 2 / (total_h + 1)
                            i = int(gain.argmax())
                            if gain[i] > best[0]:
                                best = (gain[i], j, i)
                    if best[1] is None:
                        tree[k] = (-1, RATE * total_g / (total_h + 1))
                        f[own] += tree[k][1]
                    else:
                        tree[k] = (best[1], float(edges[best[1]][best[2]]))
                        right = binned[own, best[1]] > best[2]
                        node[own] = 2 * k + 1 + right
            self.trees.append(tree)
        return self

    def _flat(self):
        """The trees as complete ones, in arrays: splits (trees x inner nodes) and leaves."""
        if self._arrays is None:
            inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
            column, at, value = np.zeros((len(self.trees), inner), np.int64), np.full((len(self.trees), inner), np.inf), np.zeros((len(self.trees), leaves))
            for t, tree in enumerate(self.trees):
                for k in range(inner + leaves):
                    up = k
                    while up not in tree:  # below a leaf: go left, to its value
                        up = (up - 1) // 2
                    j, v = tree[up]
                    if k >= inner:
                        value[t, k - inner] = v
                    elif j >= 0:
                        column[t, k], at[t, k] = j, v
            self._arrays = column, at, value
        return self._arrays

    def margin(self, rows) -> np.ndarray:
        x = np.asarray(rows, float).reshape(len(rows), -1)
        if not len(x):
            return np.zeros(0)
        column, at, value = self._flat()
        line, each = np.arange(len(x))[:, None], np.arange(len(column))[None, :]
        node = np.zeros((len(x), len(column)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[line, column[each, node]] > at[each, node])
        return self.bias + value[each, node - column.shape[1]].sum(axis=1)

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-(a * self.margin(rows) + b)))

    def calibrate(self, rows, y: np.ndarray, kinds) -> "Trees":
        m = self.margin(rows)
        a, b = 1.0, 0.0
        for _ in range(200):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - y) * m).sum() + 1e-3 * a, (p - y).sum()])
            hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.platt = (float(a), float(b))
        p = 1 / (1 + np.exp(-(a * m + b)))
        for kind in EXTRA:
            own = np.array([k == kind for k in kinds])
            order = np.argsort(-p[own], kind="stable")
            right = np.cumsum(y[own][order])
            ok = np.flatnonzero(right / np.arange(1, len(order) + 1) >= PRECISION)
            # never below even odds, whatever the sample allows
            self.cut[kind] = max(0.5, float(p[own][order[ok[-1]]])) if len(ok) else 2.0
        return self


_model: list[Trees] = []


def model() -> Trees:
    """The trained trees: the same ones in every process, made once in each."""
    if not _model:
        data = list(examples(TRAIN_ROWS))
        rows = [features(t, s, e, k) for t, s, e, k, _ in data]
        y = np.array([float(d[4]) for d in data])
        part = len(data) * 2 // 3
        trees = Trees().fit(np.array(rows[:part]), y[:part])
        _model.append(trees.calibrate(rows[part:], y[part:], [d[3] for d in data[part:]]))
    return _model[0]


class Taken:
    """Places of a text that are taken: disjoint intervals in order."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for s, e, *_ in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def take(self, s: int, e: int) -> bool:
        """Take a place, if all of it is free."""
        i = bisect_right(self.starts, s)
        if (i and self.ends[i - 1] > s) or (i < len(self.starts) and self.starts[i] < e):
            return False
        self.starts.insert(i, s)
        self.ends.insert(i, e)
        return True


def _order(x):
    return x[0], KINDS.index(x[2]), x[1]


def _selected(base, found, p, trees: Trees):
    taken = Taken(base)
    kept = [found[i] for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i])) if p[i] >= trees.cut[found[i][2]] and taken.take(*found[i][:2])]
    return base, sorted(base + kept, key=_order)


#: Proposals that are scored together.
SCORED = 20_000


def spans_of(texts: list[str], trees: Trees):
    """(base spans, all spans) of each text, both by start, then kind as listed; many texts are scored at once."""
    found, odds, rows = [], [], []

    def score():
        if rows:
            odds.append(trees.probability(rows))
            rows.clear()

    for text in texts:
        found.append(list(dict.fromkeys(proposals(text))))
        for s, e, k in found[-1]:
            rows.append(features(text, s, e, k))
            if len(rows) >= SCORED:
                score()
    score()
    p, at = np.concatenate(odds) if odds else np.zeros(0), 0
    for text, own in zip(texts, found):
        yield _selected(sorted(base_spans(text), key=_order), own, p[at: at + len(own)].tolist(), trees)
        at += len(own)


def all_spans(text: str, trees: Trees) -> tuple[list, list]:
    """(base spans, all spans) of one text."""
    return next(spans_of([text], trees))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; overlaps merge into the first."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCHEMA = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) to SCHEMA, one row for each row."""
    trees = small_batches(docs).sparkSession.sparkContext.broadcast(model())  # some tens of kB

    def run(batches):
        m = trees.value
        for batch in batches:
            rows = []
            for base, full in spans_of([t or "" for t in batch.column(1).to_pylist()], m):
                n = Counter(k for _, _, k in base)
                rows.append((*(n[k] for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(full), len(full) - len(base)))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return docs.select("id", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return find(docs).withColumnRenamed("id", "doc_id")
