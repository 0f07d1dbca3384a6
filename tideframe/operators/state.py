"""Named state: flattening, patching missing entries, merging, and strict key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names."""

    def walk(kind: T.StructType, at: Column | None, name: str):
        for f in kind.fields:
            c = F.col(f"`{f.name}`") if at is None else at[f.name]
            full = f"{name}{sep}{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, c, full)
            else:
                yield c.alias(full)

    return df.select(*walk(df.schema, None, ""))


def patch(wanted: DataFrame, have: DataFrame, key: str, fallback: Column, value: str = "value") -> DataFrame:
    """Values of the wanted keys; a missing one takes the value of the key that `fallback` names."""
    own = have.select(F.col(key).alias("_k"), F.col(value).alias("_own"))
    other = have.select(F.col(key).alias("_f"), F.col(value).alias("_other"))
    rows = wanted.withColumn("_fb", fallback)
    joined = rows.join(own, rows[key] == F.col("_k"), "left").join(other, F.col("_fb") == F.col("_f"), "left")
    source = F.when(F.col("_own").isNotNull(), "own").when(F.col("_other").isNotNull(), "copied").otherwise("missing")
    return joined.select(key, F.coalesce("_own", "_other").alias(value), source.alias("source"))


def key_audit(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that are missing from the given state or left over in it."""
    missing = expected.join(given, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    left = given.join(expected, key, "left_anti").select(key, F.lit("left over").alias("problem"))
    return missing.unionAll(left)


def restore(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """The given state; raises if its keys are not exactly the expected ones."""
    problems = key_audit(expected, given, key).limit(5).collect()
    if problems:
        raise KeyError("; ".join(f"{r[key]} is {r['problem']}" for r in problems))
    return given.join(expected.select(key), key, "left_semi")


def merge(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Union by key; entries of `extra` win."""
    rows = base.withColumn("_pri", F.lit(0)).unionByName(extra.withColumn("_pri", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_pri"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_pri")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old buffer names to new ones, where they occur."""
    return df.withColumnsRenamed(names)


def existing(requests: DataFrame, catalog: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests whose key is in the catalog, and those whose is not."""
    return requests.join(catalog, key, "left_semi"), requests.join(catalog, key, "left_anti")


def placement(modules: DataFrame, device: str = "device") -> DataFrame:
    return modules.agg(F.count_if(F.col(device) != "cpu").alias("n_gpu"), F.count_if(F.col(device) == "cpu").alias("n_cpu"))


def save(state: DataFrame, path: str, metadata: dict) -> None:
    """Write a state table (key, value, ...) and its scalars beside it as JSON lines."""
    import json

    for v in metadata.values():
        if not isinstance(v, (int, float, str, bool, type(None))):
            raise TypeError("metadata holds numbers, strings, booleans and null only")
    state.write.mode("overwrite").parquet(f"{path}/tensors")
    rows = [(k, json.dumps(v)) for k, v in sorted(metadata.items())]
    state.sparkSession.createDataFrame(rows, "key string, json string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load(spark, path: str) -> tuple[DataFrame, dict]:
    """The state table, and the scalars (a bounded number of them)."""
    import json

    rows = spark.read.schema("key string, json string").json(f"{path}/metadata").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the metadata has more than 100000 scalars; what is larger belongs into the state table")
    return spark.read.parquet(f"{path}/tensors"), {r["key"]: json.loads(r["json"]) for r in rows}
