"""SimHash near-duplicates, linked exactly through vantage-point trees over Hamming distance.

1. Every document gets a 64-bit fingerprint. Equal fingerprints are one item from then on.
2. A vantage-point tree is fitted on a bounded sample of fingerprints (`SAMPLE`); its leaves are the
   shards. A node has a vantage point v and a median m. A fingerprint x lives inside if d(x, v) <= m,
   outside otherwise. As a query of radius r it must look inside if d(x, v) - r <= m and outside if
   d(x, v) + r > m: so it visits every shard that its ball overlaps, and no link is lost.
3. Each block of a shard builds a tree of its residents and runs residents and visitors through it in
   bulk; the last levels compare by XOR and population count. Residents are bounded by `BLOCK`, and visitors
   come message by message.
4. Links are not returned pair by pair: a block joins what a message links and returns one edge per linked
   item. Connected components over these edges come from alternating large-star and
   small-star steps, with a checkpoint in the shared folder after each round.

Defined cases: null text counts as empty; texts without a word have fingerprint zero and are linked like
any other; repeated rows, also of one id, are rows of their own; a null id is returned, and loses
against any other id as a component's smallest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enter, narrow, prepare, raw_texts, scratch, shared_dir

RADIUS = 4
SAMPLE = 65536
#: Items of one shard, about; of one block of a shard, at most; and of one bucket of a block's own tree.
SHARD = 1 << 13
BLOCK = 1 << 16
BUCKET = 384
#: Items that a task packs into one message to a shard, at most.
PACK = 1 << 14

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `width` words, joined by blanks; of all words if there are fewer; nothing without a word."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    return np.array([digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), end[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, repeats included."""
    return majority(shingle_hashes(text.translate(_LOWER).split(), width, seed))


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def row_keys(id_col: Column, text_col: Column) -> list[Column]:
    """128 bits that name a row by its id and text, never null."""
    return [F.xxhash64(id_col.cast("string"), text_col).alias("k1"), F.xxhash64(text_col, F.lit(1), id_col.cast("string")).alias("k2")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, k1, k2 (row_keys) and fp (the fingerprint as a signed long); one pass without a shuffle."""
    prepare(docs.sparkSession)
    source = narrow(docs, doc_id=id_col, text=text_col)
    source = source.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in raw_texts(b.column(3))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fp)], ["doc_id", "k1", "k2", "fp"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, fp bigint")


class VantageTree:
    """A vantage-point tree down to leaves of about `leaf` of the given points.

    A point is a fingerprint and, if `least` is given, the size of a set. A node parts its points by their Hamming
    distance to a vantage fingerprint, or by their size, which is the distance to the empty set: of the two that
    which fewer balls overlap. Where nearly every ball overlaps both halves the node stays a leaf unless `force`d.
    """

    def __init__(self, fp: np.ndarray, size: np.ndarray, leaf: int, radius: int, least: float | None = None, force: bool = True, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        self.radius, self.least, self.force = radius, least, force
        self.nodes: list[tuple] = []  # (vantage or None, cut, inside, outside), or (None, leaf number, 0, 0)
        self.n_leaves = 0
        self.root = self._grow(fp, size, leaf, 40)

    def _grow(self, fp: np.ndarray, size: np.ndarray, leaf: int, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        best = None
        if len(fp) > leaf and depth:
            v = fp[self.rng.integers(len(fp))]
            d = np.bitwise_count(fp ^ v).astype(np.int64)
            for by, x in ((v, d), (None, size)):
                m = _middle(x) if by is not None or self.least is not None else None
                if m is None:
                    continue
                go_in, go_out = self._sides(by, m, x, self.radius)
                both = float((go_in & go_out).mean())
                if (best is None or both < best[0]) and (self.force or both < 0.75):
                    best = (both, by, m, x <= m)
        if best is None:
            self.nodes[at] = (None, self.n_leaves, 0, 0)
            self.n_leaves += 1
            return at
        _, by, m, inside = best
        self.nodes[at] = (by, m, self._grow(fp[inside], size[inside], leaf, depth - 1), self._grow(fp[~inside], size[~inside], leaf, depth - 1))
        return at

    def _sides(self, by, m: int, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Which points look inside and which outside. By size, a point looks for those of its size and larger ones."""
        if by is not None:
            return x - radius <= m, x + radius > m
        if radius < 0:  # at home only
            return x <= m, x > m
        return x <= m, x / self.least > m

    def route(self, fp: np.ndarray, size: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each leaf, the positions of the points whose ball of that radius overlaps it. Radius -1: their own leaf."""
        todo = [(self.root, np.arange(len(fp)))]
        while todo:
            at, who = todo.pop()
            by, m, inside, outside = self.nodes[at]
            if not inside:
                yield m, who
                continue
            x = size[who] if by is None else np.bitwise_count(fp[who] ^ by).astype(np.int64)
            for child, go in zip((inside, outside), self._sides(by, m, x, max(radius, 0) if by is not None else radius), strict=True):
                if go.any():
                    todo.append((child, who[go]))


def _middle(x: np.ndarray) -> int | None:
    """The cut nearest the median that leaves something on both sides."""
    m = int(np.median(x))
    if m >= x.max():
        below = x[x < x.max()]
        return int(below.max()) if len(below) else None
    return m


def items_type(words: int) -> np.dtype:
    """What a shard gets of an item: its key, the words of its fingerprint, and its size."""
    return np.dtype([("key", "<i8"), ("fp", "<u8", (words,)), ("size", "<i8")])


def link(home: np.ndarray, tree: VantageTree, where: dict, queries: np.ndarray, radius: int, wide: int, least: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions in queries, in home) of different items within the radius, by bulk tree search.

    wide: the radius over all words of the fingerprint, where it has more than one.
    """
    first = np.ascontiguousarray(queries["fp"][:, 0])
    own = np.ascontiguousarray(home["fp"][:, 0])
    for leaf, who in tree.route(first, queries["size"], radius):
        rows = where.get(leaf)
        if rows is None:
            continue
        part = own[rows]
        for at in range(0, len(who), max(1, (1 << 19) // len(part))):
            q = who[at : at + max(1, (1 << 19) // len(part))]
            i, j = np.nonzero(np.bitwise_count(first[q][:, None] ^ part[None, :]) <= radius)
            i, j = q[i], rows[j]
            near = queries["key"][i] != home["key"][j]
            if home["fp"].shape[1] > 1:
                near &= np.bitwise_count(queries["fp"][i] ^ home["fp"][j]).sum(1, dtype=np.int64) <= wide
            if least is not None:
                a, b = queries["size"][i], home["size"][j]
                near &= np.minimum(a, b) >= least * np.maximum(a, b)
            if near.any():
                yield i[near], j[near]


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], known: np.ndarray | None = None) -> np.ndarray:
    """For each of n items the smallest item that the pairs connect it with; known: such roots of the first items."""
    parent = np.arange(n)
    if known is not None:
        parent[: len(known)] = known

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            x = up

    for a, b in pairs:
        while True:
            ra, rb = find(a), find(b)
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    return find(np.arange(n))


def edges(unique: DataFrame, radius: int = RADIUS, wide: int = 0, least: float | None = None, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between keys of linked items, enough to connect all that are linked.

    unique: key, fp (binary, the words of the fingerprint), and with `least` also size; one row per key. Shards
    are the leaves of a tree that is fitted on SAMPLE items; a leaf with more than BLOCK residents is dealt out in blocks.
    """
    spark = unique.sparkSession
    n = unique.count()
    size = F.col("size").cast("bigint") if least is not None else F.lit(0).cast("bigint")
    unique = unique.select("key", "fp", size.alias("size"))
    sample = unique.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "a bigint, b bigint")
    kind = items_type(len(sample[0]["fp"]) // 8)
    points = np.frombuffer(b"".join(r["fp"] for r in sample), np.uint64).reshape(len(sample), -1)[:, 0]
    sizes = np.array([r["size"] for r in sample], np.int64)
    shards = max(1, min(n // shard + 1, SAMPLE // 8))
    tree = VantageTree(points, sizes, -(-len(points) // shards), radius, least)
    shared = spark.sparkContext.broadcast(tree)  # at most SAMPLE nodes

    def as_items(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(b.num_rows, kind)
        out["key"] = b.column(0).to_numpy()
        out["fp"] = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, -1)
        out["size"] = b.column(2).to_numpy()
        return out

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        kept: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                kept.append(as_items(b))
            if sum(map(len, kept)) >= PACK:
                yield np.concatenate(kept)
                kept = []
        if kept:
            yield np.concatenate(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.n_leaves, np.int64)
        for x in chunks(batches):
            for leaf, who in shared.value.route(np.ascontiguousarray(x["fp"][:, 0]), x["size"], -1):
                total[leaf] += len(who)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["leaf", "n"])

    residents = unique.mapInArrow(count, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect()  # one row per leaf
    blocks = {r["leaf"]: -(-r["n"] // BLOCK) for r in residents}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pack the items for each block of a shard: residents (role 0) and those that look for them (role 1)."""
        for x in chunks(batches):
            rows = []
            first = np.ascontiguousarray(x["fp"][:, 0])
            for leaf, who in shared.value.route(first, x["size"], -1):
                block = x["key"][who] % blocks[leaf]
                rows += [(leaf, k, 0, x[who[block == k]].tobytes()) for k in np.unique(block).tolist()]
            for leaf, who in shared.value.route(first, x["size"], radius):
                rows += [(leaf, k, 1, x[who].tobytes()) for k in range(blocks.get(leaf, 0))]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[k] for r in rows], pa.int32()) for k in range(3)], pa.array([r[3] for r in rows], pa.binary())],
                ["leaf", "block", "role", "items"],
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's residents come first; then one message after another is compared with them.

        What earlier messages have joined is remembered, so a message gives one edge for each of its own linked items
        and one for each pair of residents' groups that it joins: no more edges than items, however they are linked.
        """
        enter("simhash")
        here, home, kept, tree, where, known = None, np.zeros(0, kind), [], None, {}, np.zeros(0, np.int64)
        for b in batches:
            for leaf, block, role, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (leaf, block) != here:
                    here, home, kept, tree = (leaf, block), np.zeros(0, kind), [], None
                items = np.frombuffer(data, kind)
                if role == 0:
                    kept.append(items)
                    continue
                if tree is None:
                    home = np.unique(np.concatenate(kept)) if kept else home
                    tree = VantageTree(np.ascontiguousarray(home["fp"][:, 0]), home["size"], BUCKET, radius, least, force=False)
                    where = dict(tree.route(np.ascontiguousarray(home["fp"][:, 0]), home["size"], -1))
                    known = np.arange(len(home))
                if not len(home):
                    continue
                n = len(home)
                at = np.minimum(np.searchsorted(home["key"], items["key"]), n - 1)  # a resident goes by its place at home
                at = np.where(home["key"][at] == items["key"], at, n + np.arange(len(items)))
                top = roots(n + len(items), ((at[i], j) for i, j in link(home, tree, where, items, radius, wide, least)), known)
                joined = np.flatnonzero((known == np.arange(n)) & (top[:n] != known))
                linked = np.flatnonzero((at >= n) & (top[n:] != n + np.arange(len(items))))
                known = top[:n]
                a = np.concatenate([home["key"][joined], items["key"][linked]])
                if len(a):
                    to = np.concatenate([top[joined], top[n + linked]])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(home["key"][to])], ["a", "b"])

    packed = unique.mapInArrow(send, "leaf int, block int, role int, items binary")
    parts = max(8, min(4096, 2 * sum(blocks.values())))  # by number, so that small messages are not gathered into few tasks
    return packed.repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", "role").mapInArrow(search, "a bigint, b bigint")


def fresh(name: str) -> Column:
    """The same long under a partitioning that Spark does not know.

    A join with an aggregate then gets a shuffle of its own on this (small) side, and so adaptive execution
    may split the other side's partitions where one key holds very many rows.
    """
    return F.col(name).bitwiseXOR(F.lit(0).cast("bigint")).alias(name)


def components(links: DataFrame) -> DataFrame:
    """(fp, root) of all linked fingerprints, by large-star and small-star steps; root is the smallest fp.

    Each round halves about the distance to the roots. A round's result is checkpointed in the shared
    folder, so a lost executor costs at most a round, and nothing but a count reaches the driver.
    """
    spark = links.sparkSession
    shared_dir(spark)
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        # large star: every neighbour above a goes to a's smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.select(fresh("a"), "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.select(fresh("a"), "m"), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        # done when every node has one edge and no root has an edge of its own
        many = new.groupBy("a").agg(F.count("*").alias("n"))
        busy = many.where("n > 1").select("a").unionByName(many.select("a").join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        if busy.isEmpty():
            return new.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        now = new


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS
) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest linked id), n_copies (rows with that fingerprint)."""
    spark = docs.sparkSession
    where = scratch(spark, "fingerprints")
    fingerprints(docs, id_col, text_col, width).write.parquet(where)  # read again below, 32 bytes a row
    rows = spark.read.parquet(where)
    unique = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"))
    # the bytes of a long come out in big-endian order; a word's bits keep their distances whatever their order
    words = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    tops = components(edges(rows.select("fp").distinct().select(F.col("fp").alias("key"), words.alias("fp")), radius))
    linked = with_roots(tops).join(unique, "fp")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = spread(linked, smallest).select("fp", "component_id")
    classes = unique.join(found, "fp", "left").select("fp", "n_copies", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(classes.select(fresh("fp"), "n_copies", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies"
    )


def with_roots(tops: DataFrame) -> DataFrame:
    """(fp, root) with the roots themselves."""
    return tops.unionByName(tops.select(F.col("root").alias("fp"), "root").distinct())


def spread(linked: DataFrame, smallest: DataFrame, salts: int = 16) -> DataFrame:
    """Join on root, where one root may have very many rows: they are dealt out over `salts` copies of its one row."""
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)))
    copies = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, ["root", "salt"]).drop("salt")
