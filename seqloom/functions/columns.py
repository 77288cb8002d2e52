"""Scalar functions as Column expressions; identities and coverages are single precision.

Spark widens float arithmetic to double, so every operation is cast back to float: rounding a
double result of one float operation gives that operation's float result.
"""
from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x) -> Column:
    """A literal with the exact value of a single-precision number."""
    return F.lit(struct.unpack("f", struct.pack("f", np.float32(x)))[0]).cast("float")


def mul32(a: Column, b: Column) -> Column:
    return (a.cast("float") * b.cast("float")).cast("float")


def div32(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("float"), b.cast("float")).cast("float")


def allowed_mismatches(identity: float, overlap: Column) -> Column:
    """floor((1 - identity) * overlap), not below 0."""
    part = f32(np.float32(1) - np.float32(identity))
    return F.greatest(F.floor(mul32(part, overlap)), F.lit(0)).cast("long")


def coverage_ok(aligned: Column, qlen: Column, tlen: Column, min_cov: float, mode: int) -> Column:
    """Mode 0: of both sequences, 1: of the target, 2: of the query, 3: target to query length."""
    q, t, c = F.greatest(qlen, F.lit(1)), F.greatest(tlen, F.lit(1)), f32(min_cov)
    of_q, of_t = div32(aligned, q) >= c, div32(aligned, t) >= c
    return {1: of_t, 2: of_q, 3: div32(t, q) >= c}.get(mode, of_q & of_t)


def coverage_possible(qlen: Column, tlen: Column, min_cov: float, mode: int) -> Column:
    """The coverage if the shorter sequence aligned from end to end."""
    return coverage_ok(F.least(qlen, tlen), qlen, tlen, min_cov, mode)


def ungapped_ok(mismatches: Column, overlap: Column, longest: Column, identity: float, coverage: float) -> Column:
    """Position by position: enough overlap, few enough mismatches, enough identity."""
    same = div32(overlap - mismatches, overlap) >= f32(identity)
    wide = div32(overlap, longest) >= f32(coverage)
    return (overlap > 0) & wide & (mismatches <= allowed_mismatches(identity, overlap)) & same


def idf(n_seqs: Column, df: Column) -> Column:
    return F.log(div32(n_seqs + 1, df + 1)).cast("float")


def seed_weight(n_seqs: Column, df: Column) -> Column:
    """idf in 1/1024, rounded half away from zero, at least 1."""
    return F.greatest(F.lit(1), F.round(mul32(idf(n_seqs, df), F.lit(1024))).cast("int"))


def unsigned(x: Column) -> Column:
    """A key by whose signed order 64-bit hashes come in unsigned order."""
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def hex64(x: Column) -> Column:
    """Lower-case hexadecimal digits without leading zeros."""
    return F.lower(F.hex(x))


def signed64(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def rank_at(n: Column, quantile: float) -> Column:
    """Index (from 0) of a quantile among n sorted values: round((n - 1) * q) in single precision."""
    return F.least(F.round(mul32(n - 1, f32(quantile))).cast("long"), n - 1)


def residues(text: Column) -> Column:
    """The letters of a text, upper-cased: a protein-typed sequence."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def choose_k(policy, k: int, length: Column) -> Column:
    """k of a query's seeds under a policy."""
    from ..config import SHORT_QUERY

    if policy is None or policy.mode != "variable_k":
        return F.lit(max(k, 1))
    return F.when(length < SHORT_QUERY, F.lit(max(policy.short_k, 1))).otherwise(F.lit(max(policy.long_k, 1)))
