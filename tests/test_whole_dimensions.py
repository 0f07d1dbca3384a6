import pytest
from pyspark.sql import functions as F
from tideframe.operators import alignment, sequence, state


def test_no_row_of_a_long_dimension_is_lost(spark):
    rows = spark.range(5000).select(F.col("id").alias("pos"), F.lit(2.0).alias("v"))
    weights = spark.range(5000).select(F.col("id").alias("step"), F.lit(3.0).alias("weight"))
    got = sequence.per_step_weights(rows, weights, "pos", "v")
    assert got.count() == 5000 and got.where("y = 6").count() == 5000
    tokens = spark.range(5000).select(F.col("id").alias("k"), F.lit(4).alias("step"))
    channels = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("delay"))
    assert alignment.shift_to_grid(tokens, channels).count() == alignment.gather(tokens, channels).count() == 5000


def test_too_much_metadata_raises(spark, tmp_path):
    path = str(tmp_path)
    spark.range(1).write.parquet(f"{path}/tensors")
    spark.range(100_001).select(F.col("id").cast("string").alias("key"), F.lit("1").alias("json")).write.json(f"{path}/metadata")
    with pytest.raises(ValueError, match="100000"):
        state.load(spark, path)
