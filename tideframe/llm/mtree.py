"""Exact top-k by inner product with M-trees.

The largest inner product becomes the nearest neighbour by one more coordinate: with B an upper bound of
all squared norms, x' = (x, sqrt(B - |x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + B - 2 q.x. In that
metric space every shard of the vectors is an M-tree: pages of entries, where an inner entry has a
routing object, a covering radius and its distance to the parent's routing object, and a leaf entry has
a vector and its distance to the page's. Search is best first. Before a distance is computed, the stored
parent distance gives the bound |d(q, parent) - d(parent, entry)| - radius <= d(q, x) for all x below the
entry; what cannot beat the k-th best found is skipped. Scores are integers, and bounds have a margin for
rounding, so results are exact, ties included.

Every shard's tree is one row. Queries go to the shards in blocks; a block meets each shard once, and the
shards' best k are merged.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no
part; vectors of different lengths are not compared; rows that repeat an id are rows of their own, and
a query's own row is left out once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, npz, prepare, un_npz

PAGE = 128
#: Vectors of one tree and queries of one block, about.
SHARD = 8192
QUERIES = 512


class MTree:
    """Bulk-loaded. Flat arrays: entry e has an object, a radius, a parent distance, and a page below or -1."""

    def __init__(self, vectors: np.ndarray, bound: float, page: int = PAGE, seed: int = 3):
        self.vectors = vectors
        self.reach = float(np.sqrt(bound))
        rest = np.sqrt(np.maximum(bound - (vectors.astype(np.float64) ** 2).sum(1), 0.0))
        self.points = np.concatenate([vectors.astype(np.float64), rest[:, None]], axis=1)
        self.rng = np.random.default_rng(seed)
        self.page_size = page
        #: of each page: its entries' objects, radii, parent distances and pages below
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.root = self._load(np.arange(len(vectors)), None) if len(vectors) else -1

    def _load(self, who: np.ndarray, parent: int | None) -> int:
        to_parent = self._distances(parent, who)
        if len(who) <= self.page_size:
            return self._page(who, np.zeros(len(who)), to_parent, np.full(len(who), -1))
        many = int(min(self.page_size, max(2, -(-len(who) // self.page_size))))
        routing = self.rng.choice(who, many, replace=False)
        d = np.stack([self._distances(r, who) for r in routing])
        near = d.argmin(0)
        entries = []
        for k, r in enumerate(routing):
            own = who[near == k]
            if len(own) == len(who):  # copies of one point: halve them
                half = len(own) // 2
                entries += [(r, own[:half]), (r, own[half:])]
            elif len(own):
                entries.append((r, own))
        below = [self._load(own, int(r)) for r, own in entries]
        objects = np.array([r for r, _ in entries])
        radii = np.array([self._distances(int(r), own).max() for r, own in entries])
        return self._page(objects, radii, self._distances(parent, objects), np.array(below))

    def _distances(self, at: int | None, who: np.ndarray) -> np.ndarray:
        if at is None:
            return np.zeros(len(who))
        return np.sqrt(((self.points[who] - self.points[at]) ** 2).sum(1))

    def _page(self, *columns: np.ndarray) -> int:
        self.pages.append(columns)
        return len(self.pages) - 1

    def search(self, query: np.ndarray, ids: np.ndarray, k: int, skip: np.ndarray) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, position), ties to the smaller id; and the number of distances computed.

        skip: a flag for each position that must not be answered.
        """
        q = np.append(query.astype(np.float64), 0.0)
        wide = query.astype(np.int64)
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, position); its top is the worst kept
        limit, computed = np.inf, 0
        queue: list[tuple[float, int, float]] = [(0.0, self.root, -1.0)] if self.root >= 0 else []
        margin = 1e-6 * (1.0 + float(np.sqrt((q * q).sum())) + self.reach)
        while queue:
            low, page, d_parent = heapq.heappop(queue)
            if low > limit:
                break
            objects, radii, to_parent, below = self.pages[page]
            if d_parent >= 0 and limit < np.inf:
                able = np.abs(d_parent - to_parent) - radii <= limit + margin
                objects, radii, below = objects[able], radii[able], below[able]
            if not len(objects):
                continue
            d = np.sqrt(((self.points[objects] - q) ** 2).sum(1))
            computed += len(objects)
            if below[0] >= 0:
                bound = np.maximum(d - radii, 0.0)
                for b, p, x in zip(bound.tolist(), below.tolist(), d.tolist(), strict=True):
                    if b <= limit + margin:
                        heapq.heappush(queue, (b - margin, p, x))
                continue
            near = objects[(d <= limit + margin) & ~skip[objects]]
            if not len(near):
                continue
            score = self.vectors[near].astype(np.int64) @ wide
            if len(near) > k:
                order = np.lexsort((ids[near], -score))[:k]
                near, score = near[order], score[order]
            for s, p in zip(score.tolist(), near.tolist(), strict=True):
                item = (s, -int(ids[p]), p)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                worst = self.points[best[0][2]]
                limit = float(np.sqrt(((worst - q) ** 2).sum())) + margin
        return [(s, p) for s, _, p in sorted(best, key=lambda x: (-x[0], -x[1]))], computed


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """id, vector (floor of factor times each component as double), copy (number among rows of one id).

    A finite component of magnitude 2**31 // factor or more has no exact 32-bit form; it raises an error.
    """
    rows = narrow(table, id=id_col, v=vector_col)
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    most = 2**31 // factor
    wide = F.raise_error(F.lit(f"a vector has a component of magnitude {most} or more; scale the vectors")).cast("int")
    rows = rows.where(F.col("id").isNotNull() & good)
    rows = rows.select("id", F.transform("v", lambda x: F.when(F.abs(x) >= float(most), wide).otherwise(F.floor(x * factor).cast("int"))).alias("v"))
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("v")))


def top_k(
    table: DataFrame,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    factor: int = 256,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best other rows."""
    spark = table.sparkSession
    prepare(spark)
    rows = integer_vectors(table, id_col, vector_col, factor).withColumn("dim", F.size("v"))
    shards = F.expr(f"cast(ceil(n / {SHARD}) as int)")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).withColumn("shards", F.greatest(F.lit(1), shards))
    sized = rows.join(F.broadcast(sizes.limit(65536)), "dim")  # one row per length of vector
    place = sized.withColumn("shard", F.pmod(F.xxhash64("id", "copy"), F.col("shards")))

    def build(key: tuple, part: pa.Table) -> pa.Table:
        """A shard's vectors as one row: ids, copies and components, from which its tree is loaded."""
        order = np.lexsort((part.column("copy").to_numpy(), part.column("id").to_numpy()))
        flat = part.column("v").combine_chunks()
        matrix = np.asarray(flat.flatten()).reshape(len(order), -1)[order].astype(np.int32)
        data = npz(ids=part.column("id").to_numpy()[order], copies=part.column("copy").to_numpy()[order], vectors=matrix)
        return pa.table({"dim": [key[0].as_py()], "shard": [key[1].as_py()], "data": [data]}, schema=packed)

    packed = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("data", pa.binary())])
    trees = place.select("dim", "shard", "id", "copy", "v").groupBy("dim", "shard").applyInArrow(build, "dim int, shard bigint, data binary")

    asked = place.where(F.col("id") % every == 0)
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("copy", "id"), F.greatest(F.lit(1), F.expr(f"cast(ceil(n / {every * QUERIES}) as int)"))))
    blocks = blocks.groupBy("dim", "shards", "block").agg(F.collect_list(F.struct("id", "copy", "v")).alias("queries"))
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards").cast("bigint") - 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            for data, queries in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if last[0] != data:
                    got = un_npz(data)
                    squares = (got["vectors"].astype(np.float64) ** 2).sum(1)
                    last = (data, (MTree(got["vectors"], float(squares.max(initial=0.0))), got["ids"], got["copies"]))
                tree, ids, copies = last[1]
                out: list[tuple] = []
                for q in queries:
                    skip = (ids == q["id"]) & (copies == q["copy"])
                    best, _ = tree.search(np.array(q["v"], np.int64), ids, k, skip)
                    out += [(q["id"], q["copy"], int(ids[p]), s) for s, p in best]
                cols = [*zip(*out, strict=True)] if out else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                    ["query_id", "copy", "vec_id", "score"],
                )

    pairs = blocks.join(trees, ["dim", "shard"]).select("data", "queries")
    found = pairs.mapInArrow(search, "query_id bigint, copy int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
