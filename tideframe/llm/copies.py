"""Near copies: SimHash neighbours by vantage-point trees, then the exact similarity of their shingles.

1. Every text becomes the set of its lower-cased word shingles (`WIDTH` words). Equal sets are one item from then on.
2. An item has a SimHash of 256 bits. Items link as candidates if the first 64 bits differ in at most `RADIUS`, all
   bits in at most `WIDE`, and the smaller set has at least `LEAST` of the larger one's size (see simhash.edges:
   trees by Hamming distance and by size, prune by triangle bounds, boundary-overlapping shards, exact pairs).
   Sets of similarity 0.8 differ in 9 of 64 bits on average; 18 is over three standard deviations more.
3. Candidates are connected to groups, and the texts of a group's members meet its first member's: an exact Jaccard
   similarity of LEAST or more links them. Members that are not linked to the first meet all of their group, in blocks
   of `BLOCK` shingles against blocks, so no task gets a whole group. What is linked is connected again.

Groups that are hot are salted for the first member's comparison and dealt out in blocks for the rest.

Defined cases: null text counts as empty; texts without a word have equal (empty) sets; a text of fewer words
than a shingle is one shingle; repeated rows are one item; a null id loses against any other id; an empty
table gives an empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enter, narrow, positional, prepare, raw_texts, scratch
from .simhash import components, edges, fresh, roots, row_keys, shingle_hashes, with_roots

WIDTH = 5
LEAST = 0.8
RADIUS = 18
WIDE = 60
#: Items of one shard of the candidate search, about: balls of this radius overlap most shards, so shards are large.
SHARD = 1 << 13
#: Shingles of one block of a group's members, and members that meet one copy of the first.
BLOCK = 1 << 17
SALT = 512

_TURN = np.array([0, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the different word shingles of a text."""
    return np.unique(shingle_hashes(text.decode().lower().encode().split(), width, 42))


def signature(own: np.ndarray) -> bytes:
    """SimHash of 256 bits of a set: the first 64 of its hashes themselves, the others of mixes of them."""
    ones = np.zeros(256, np.int64)
    for at in range(0, len(own), 1 << 12):
        h = own[at : at + (1 << 12), None] ^ _TURN
        h[:, 1:] *= np.uint64(0xBF58476D1CE4E5B9)
        h[:, 1:] ^= h[:, 1:] >> np.uint64(31)
        h[:, 1:] *= np.uint64(0x94D049BB133111EB)
        h[:, 1:] ^= h[:, 1:] >> np.uint64(29)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 32), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(own), bitorder="little").tobytes()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets (sorted, without repeats) have that Jaccard similarity; empty ones are equal."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def matches(left: list[np.ndarray], right: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions in left, in right) of that similarity."""
    size = np.array([len(s) for s in right], np.int64)
    values, item = np.unique(np.concatenate(right), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), size)
    mark = np.zeros(len(values) + 1, bool)
    for k, s in enumerate(left):
        at = np.searchsorted(values, s)
        at = np.where(values[np.minimum(at, len(values) - 1)] == s, at, len(values)) if len(values) else np.zeros(0, np.int64)
        mark[at] = True
        mark[len(values)] = False
        both = np.bincount(owner[mark[item]], minlength=len(right))
        mark[at] = False
        near = np.flatnonzero((both >= least * (size + len(s) - both) - 1e-9) & ((both > 0) | (size + len(s) == 0)))
        if len(near):
            yield np.full(len(near), k), near


def near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST, radius: int = RADIUS, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """Of a table (doc_id, text): one row per set (fp, first: the row that stays), and (fp, root) of the sets that are linked."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("copies")
        for b in batches:
            sets = [shingles(t, width) for t in raw_texts(b.column(3))]
            digest = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            words = np.frombuffer(b"".join([signature(s) for s in sets]), "<i8").reshape(len(sets), 4)
            more = [pa.array(np.ascontiguousarray(words[:, k])) for k in range(4)]
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(digest), *more, size], names)

    names = ["doc_id", "k1", "k2", "fp", "w0", "w1", "w2", "w3", "size"]
    kind = source.schema["doc_id"].dataType.simpleString()
    where = scratch(spark, "signatures")
    source.mapInArrow(sign, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])).write.parquet(where)
    rows = spark.read.parquet(where)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    unique = rows.groupBy("fp").agg(first)
    words = F.unhex(F.concat(*[F.lpad(F.hex(f"w{k}"), 16, "0") for k in range(4)]))
    items = rows.groupBy("fp").agg(*[F.first(c).alias(c) for c in names[4:]]).select(F.col("fp").alias("key"), words.alias("fp"), "size")
    groups = with_roots(components(edges(items, radius, wide, least, SHARD)))
    members = groups.join(rows.groupBy("fp").agg(first, F.first("size").alias("size")), "fp").select("fp", "root", "size", "first.k1", "first.k2")
    members = members.checkpoint()
    counted = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    members = members.join(counted.select(fresh("root"), "n", "total"), "root")
    kept = scratch(spark, "candidates")
    texts = source.select("k1", "k2", "text").join(members, ["k1", "k2"]).dropDuplicates(["fp"])
    texts.select("root", "fp", "n", "total", "text").write.parquet(kept)
    texts = spark.read.parquet(kept)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("copies")
        last, seed = None, None
        for b in batches:
            ok = []
            theirs = raw_texts(b.column(3))
            for i, (root, text) in enumerate(zip(b.column(1).to_pylist(), raw_texts(b.column(2)), strict=True)):
                if root != last:
                    last, seed = root, shingles(theirs[i], width)
                ok.append(similar(seed, shingles(text, width), least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["fp", "root", "near"])

    salts = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n") / SALT))
    seeds = texts.where("fp = root").select("root", F.col("text").alias("seed"), F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    others = texts.where("fp <> root").withColumn("salt", F.pmod(F.xxhash64("fp"), salts))
    judged = others.join(seeds, ["root", "salt"]).select("fp", "root", "text", "seed").mapInArrow(compare, "fp bigint, root bigint, near boolean")
    judged = judged.checkpoint()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        enter("copies")
        fp, left = table.column("fp").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
        sets = [shingles(t, width) for t in raw_texts(table.column("text").combine_chunks())]
        own, all_ = np.flatnonzero(left), np.flatnonzero(~left)
        keys, at = np.unique(fp, return_inverse=True)
        pairs = matches([sets[i] for i in own], [sets[i] for i in all_], least) if len(all_) else iter(())
        top = roots(len(keys), ((at[own[i]], at[all_[j]]) for i, j in pairs))
        a = np.flatnonzero(top != np.arange(len(keys)))
        return pa.table({"a": keys[a], "b": keys[top[a]]})

    # a group of two is decided; in larger ones those that the first member did not take meet all members
    open_ = texts.where("n > 2").join(judged.where("not near").select("fp"), "fp").select("root", "fp", "total", "text")
    many = members.join(judged.where("not near").select("fp"), "fp").where("n > 2").groupBy("root").agg(F.sum("size").alias("waiting"))
    block = F.lit(BLOCK)
    n_open, n_all = F.ceil((F.col("waiting") + 1) / block), F.ceil((F.col("total") + 1) / block)

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    waiting = many.select(fresh("root"), "waiting")
    asks = open_.join(waiting, "root").select("root", "fp", "text", F.lit(True).alias("left"), F.pmod(F.xxhash64("fp"), n_open).alias("ub"), every(n_all).alias("mb"))
    gives = texts.join(waiting, "root").select("root", "fp", "text", F.lit(False).alias("left"), every(n_open).alias("ub"), F.pmod(F.xxhash64("fp"), n_all).alias("mb"))
    more = asks.unionByName(gives.select(*asks.columns)).groupBy("root", "ub", "mb").applyInArrow(meet, "a bigint, b bigint")
    links = judged.where("near").select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(more)
    return unique, with_roots(components(links))


def keep_one_of_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST
) -> DataFrame:
    """One row of each group of linked texts with all its columns: that of the smallest id, then of the smallest text hash."""
    unique, linked = near_copies(narrow(docs, doc_id=id_col, text=text_col), width, least)
    labelled = unique.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = labelled.groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    plain = positional(docs)
    at, text = (plain[f"_c{docs.columns.index(c)}"] for c in (id_col, text_col))
    kept = plain.select("*", *row_keys(at, text)).join(chosen, ["k1", "k2"], "left_semi")
    return kept.dropDuplicates(["k1", "k2"]).select(*plain.columns).toDF(*docs.columns)
