"""Vectors as columns: cosine, normalising, means, and the deterministic mock embedding. Inputs are floats, arithmetic is double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.let import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Unclamped; 0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def cosine_to(column: Column, query: list[float]) -> Column:
    """Cosine to one query, whose length is worked out once."""
    q = [float(x) for x in query]
    size = sum(x * x for x in q) ** 0.5
    if not size:
        return F.lit(0.0)
    n = norm(column)
    return F.when(n > 0, dot(column, literal(q)) / (n * size)).otherwise(0.0)


def normalized(v: Column) -> Column:
    """Unit length; a vector without length stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def mixed(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * weight + y * (1 - weight))


def means(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, mean): a vector per key, averaged by position. Sums combine before the shuffle."""
    at = vectors.select(key, F.posexplode(doubles(F.col(column))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select(key, F.transform("m", lambda p: p["x"]).alias("mean"))


def mock_embedding(text: Column, dims: int) -> Column:
    """Bytes of the text's SHA-256 over 255, repeated to `dims` numbers."""
    byte = lambda h, i: F.conv(F.substr(h, 1 + 2 * (i % 32), F.lit(2)), 16, 10).cast("double") / 255
    return let(F.sha2(text, 256), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: byte(h, i)))  # one hash a text, not one a number
