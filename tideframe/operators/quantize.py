"""Vector quantisation against codebooks: nearest code, residual levels, decoding, usage statistics.

A codebook has rows (code, centroid). It is a dimension table: it is fetched once, its size is checked
against MAX_CODES, and it travels to the tasks as one matrix. Vectors are never exploded or shuffled;
each Arrow batch is compared with the codebook by matrix products.

Vectors that are null, hold a null or NaN, or have another length than the centroids give no row; an empty
codebook, or one whose centroids differ in length, is an error. Repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays

MAX_CODES = 1 << 16


class Codebook:
    """Codes in ascending order and their centroids as a matrix."""

    def __init__(self, table: DataFrame, code: str = "code", centroid: str = "centroid"):
        rows = table.select(F.col(code).cast("bigint").alias("c"), F.col(centroid).cast("array<double>").alias("v")).limit(MAX_CODES + 1).collect()
        if len(rows) > MAX_CODES:
            raise ValueError(f"a codebook has more than {MAX_CODES} codes; it is a dimension table")
        rows = sorted((r for r in rows if r["v"] is not None), key=lambda r: r["c"])
        if not rows or len({len(r["v"]) for r in rows}) > 1:
            raise ValueError("a codebook needs centroids, all of one length")
        self.codes = np.array([r["c"] for r in rows], np.int64)
        self.matrix = np.array([r["v"] for r in rows], np.float64)
        self.squares = (self.matrix**2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the nearest centroids (the lowest of equal ones) and their distances."""
        best = (self.squares[None, :] - 2 * x @ self.matrix.T).argmin(1)
        return best, np.sqrt(((x - self.matrix[best]) ** 2).sum(1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.cast(pa.list_(pa.float64()))
    n = len(flat)
    return np.asarray(flat.flatten()).reshape(n, -1) if n else np.zeros((0, 0))


def _usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """id and vector of the rows whose vectors have `dim` numbers."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return vectors.where((F.size(v) == dim) & F.coalesce(whole, F.lit(False))).select(id_col, vector_col)


def nearest_code(vectors: DataFrame, codebook: Codebook, id_col: str, vector_col: str) -> DataFrame:
    """(id, code, distance) of every vector; ties to the lowest code."""
    source = _usable(vectors, id_col, vector_col, codebook.matrix.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, d = codebook.nearest(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codebook.codes[at]), pa.array(d)], [id_col, "code", "distance"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"{id_col} {kind}, code bigint, distance double")


def residual_codes(x: np.ndarray, levels: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Codes by level, and what the last level leaves over."""
    codes = np.zeros((len(x), len(levels)), np.int64)
    for k, book in enumerate(levels):
        at, _ = book.nearest(x)
        codes[:, k] = book.codes[at]
        x = x - book.matrix[at]
    return codes, x


def residual_encode(vectors: DataFrame, levels: list[Codebook], id_col: str, vector_col: str) -> DataFrame:
    """(id, codes, residual): level by level the nearest code of what the levels before left over."""
    source = _usable(vectors, id_col, vector_col, levels[0].matrix.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, rest = residual_codes(_matrix(b.column(1)), levels)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(codes.tolist(), pa.list_(pa.int64())), pa.array(list(rest), pa.list_(pa.float64()))],
                    [id_col, "codes", "residual"],
                )

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"{id_col} {kind}, codes array<bigint>, residual array<double>")


def split_encode(vectors: DataFrame, semantic: Codebook, acoustic: list[Codebook], id_col: str, vector_col: str) -> DataFrame:
    """(id, codes): one semantic level, then residual levels that start from the same vector; one pass, no join."""
    source = _usable(vectors, id_col, vector_col, semantic.matrix.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                codes = np.concatenate([residual_codes(x, [semantic])[0], residual_codes(x, acoustic)[0]], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.tolist(), pa.list_(pa.int64()))], [id_col, "codes"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"{id_col} {kind}, codes array<bigint>")


def decode_codes(
    encoded: DataFrame, books: list[Codebook], id_col: str, levels: int | None = None, split: bool = False
) -> DataFrame:
    """(id, decoded) of rows (id, codes): the sum over the levels in use of their centroids, within each Arrow batch.

    The codebooks travel to the tasks, so nothing is exploded or shuffled. split: codes of split_encode; then also
    (semantic, acoustic), the first level's centroid and the sum of the others, of which decoded is the sum. A row
    with a code that its book does not hold, or with too few codes, is an error.
    """
    used = books[: levels if levels is not None else len(books)]
    source = encoded.select(id_col, "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.array([row[: len(used)] for row in b.column(1).to_pylist()], np.int64)
            parts = []
            for k, book in enumerate(used):
                at = np.minimum(np.searchsorted(book.codes, codes[:, k]), len(book.codes) - 1)
                if (book.codes[at] != codes[:, k]).any():
                    raise ValueError(f"a code of level {k} is not in its codebook")
                parts.append(book.matrix[at])
            sums = [sum(parts), parts[0], sum(parts[1:], np.zeros_like(parts[0]))][: 3 if split else 1]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(x), pa.list_(pa.float64())) for x in sums]], [id_col, *names])

    names = ["decoded", *["semantic", "acoustic"] * split]
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{n} array<double>" for n in names))


def codes_long(encoded: DataFrame, id_col: str) -> DataFrame:
    """One row per (id, level, code)."""
    return encoded.select(id_col, F.posexplode("codes").alias("level", "code")).withColumn("level", F.col("level").cast("bigint"))


def codebook_table(books: list[tuple[int, DataFrame]]) -> DataFrame:
    """(level, code, centroid) of several codebooks."""
    tables = [b.select(F.lit(level).cast("bigint").alias("level"), "code", F.col("centroid").cast("array<double>").alias("centroid")) for level, b in books]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def lookup(codes: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Code to centroid; the optimiser broadcasts the dimension table while it is small."""
    return codes.join(table, keys)


def decode(codes: DataFrame, table: DataFrame, id_col: str, dim: int, levels: int | None = None) -> DataFrame:
    """(id, decoded): the sum over levels of the centroids, as `dim` sums side by side in one aggregate."""
    if levels is not None:
        codes = codes.where(F.col("level") < levels)
    joined = lookup(codes, table, ["level", "code"])
    summed = joined.groupBy(id_col).agg(*[F.sum(F.get("centroid", F.lit(i))).alias(f"_d{i}") for i in range(dim)])
    return summed.select(id_col, F.array(*[F.col(f"_d{i}") for i in range(dim)]).alias("decoded"))


def usage_entropy(codes: DataFrame, code: str = "code", by: list[str] = ()) -> DataFrame:
    """Entropy (natural) of how often codes are used, per group; unused codes add nothing."""
    counts = codes.groupBy(*by, code).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("nl"), F.count("*").alias("n_codes"))
    return sums.select(*by, "n_codes", (F.log("t") - F.col("nl") / F.col("t")).alias("entropy"))


def centroids(vectors: DataFrame, code: str, vector_col: str, dim: int, eps: float = 1e-5) -> DataFrame:
    """(code, usage, centroid): sum of a code's vectors over its usage, at least eps."""
    v = F.col(vector_col).cast("array<double>")
    summed = vectors.withColumn("_v", v).groupBy(code).agg(
        F.count("*").alias("usage"), *[F.sum(F.get("_v", F.lit(i))).alias(f"_d{i}") for i in range(dim)]
    )
    by = F.greatest(F.col("usage").cast("double"), F.lit(eps))
    return summed.select(code, "usage", F.array(*[F.col(f"_d{i}") / by for i in range(dim)]).alias("centroid"))


def ema(old: Column, new: Column, decay: float = 0.99) -> Column:
    return old * decay + new * (1 - decay)


def replace_expired(codebook: DataFrame, usage: DataFrame, samples: DataFrame, least: float) -> DataFrame:
    """Codes used less than `least` take the vector of the sample row of their number; the rest stay."""
    joined = codebook.join(usage, "code", "left").join(samples.select("code", F.col("vector").alias("_new")), "code", "left")
    expired = F.coalesce(F.col("usage"), F.lit(0)) < least
    return joined.select("code", F.when(expired & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("centroid")).alias("centroid"))


def bandwidth(levels: Column, bins: Column | int, frame_rate: float = 12.5) -> Column:
    """kbit/s"""
    bins = F.lit(bins) if isinstance(bins, int) else bins
    return levels * F.log2(bins.cast("double")) * frame_rate / 1000


def weighted_metric(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """Two metrics' mean by numbers of levels."""
    return (a * n_a + b * n_b) / (n_a + n_b)


def merge_metrics(a: DataFrame, n_a: int, b: DataFrame, n_b: int) -> DataFrame:
    """Tables (metric, value): shared metrics are averaged by level counts, the others are kept."""
    joined = a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), "metric", "full_outer")
    both = weighted_metric(F.col("_a"), F.lit(n_a), F.col("_b"), F.lit(n_b))
    return joined.select("metric", F.coalesce(both, F.col("_a"), F.col("_b")).alias("value"))


def project(a: Column, matrix: list[list[float]]) -> Column:
    """An array times the transpose of a small constant matrix (a 1x1 convolution)."""
    return F.array(*[arrays.dot(a, F.array(*[F.lit(float(x)) for x in row])) for row in matrix])


VECTOR = T.ArrayType(T.DoubleType())


def commitment(encoded: DataFrame) -> DataFrame:
    """Mean squared residual per component of residual_encode's rows."""
    square = arrays.total(F.transform("residual", lambda x: x * x)) / F.size("residual")
    return encoded.agg(F.avg(square).alias("penalty"))
