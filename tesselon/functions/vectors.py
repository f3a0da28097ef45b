"""Functions over arrays of numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, however often the body uses it and even inside inner functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """The array over its length; one that is all zero stays so."""
    scale = lambda v: F.struct(v.alias("v"), F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v)).alias("n"))
    return let(let(a, scale), lambda s: F.transform(s["v"], lambda x: x / s["n"]))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is all zero."""
    return dot(F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def hash_bucket(token: Column, dim: int) -> Column:
    """The md5 of a token as a 128-bit number, modulo ``dim``: by Horner's rule over four 32-bit parts."""
    digest = F.md5(token)
    part = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
    value = F.pmod(part(0), F.lit(dim))
    for i in (1, 2, 3):
        value = F.pmod(value * F.lit(2**32 % dim) + part(i), F.lit(dim))
    return value


def hash_embedding(text: Column, dim: int = 32) -> Column:
    """Token counts by bucket: lower-case tokens between white space, each in the bucket of its md5; null is all zero."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    buckets = F.transform(tokens, lambda t: hash_bucket(t, dim))
    return let(buckets, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(own, lambda b: b == i)).cast("double")))
