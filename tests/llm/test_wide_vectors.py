import pytest
from tideframe.llm import mtree


def test_wide_vectors_are_not_dropped_in_silence(spark):
    rows = [(0, [1.0, 2.0]), (50, [float("inf"), 1.0]), (100, [3.0, None]), (1, [2.0, 1.0])]
    schema = "vec_id long, embedding array<double>"
    assert mtree.top_k(spark.createDataFrame(rows, schema)).count() == 1
    with pytest.raises(Exception, match="8388608"):
        mtree.top_k(spark.createDataFrame([*rows, (2, [8388608.0, 1.0])], schema)).collect()
