import pytest
from tideframe.operators import quantize

SCHEMA = "id long, v array<double>"


@pytest.fixture()
def book(spark):
    return quantize.Codebook(spark.createDataFrame([(4, [0.0, 0.0]), (7, [1.0, 1.0]), (9, [0.0, 0.0])], "code long, centroid array<double>"))


def test_odd_vectors_give_no_row(spark, book):
    rows = [(1, [0.1, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, []), (7, [1.0, 0.9])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["id"]: r["code"] for r in quantize.nearest_code(df, book, "id", "v").collect()} == {1: 4, 7: 7}
    assert {r["id"] for r in quantize.residual_encode(df, [book, book], "id", "v").collect()} == {1, 7}
    assert quantize.nearest_code(df.where("id > 9"), book, "id", "v").count() == 0


def test_repeated_ids_stay_rows(spark, book):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], SCHEMA)
    got = sorted((r["id"], r["codes"]) for r in quantize.split_encode(df, book, [book], "id", "v").collect())
    assert got == [(1, [4, 4]), (1, [7, 7]), (2, [7, 7])]
    back = quantize.decode_codes(quantize.split_encode(df, book, [book], "id", "v"), [book, book], "id", split=True).collect()
    assert sorted((r["id"], r["decoded"], r["semantic"], r["acoustic"]) for r in back) == [
        (1, [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]), (1, [2.0, 2.0], [1.0, 1.0], [1.0, 1.0]), (2, [2.0, 2.0], [1.0, 1.0], [1.0, 1.0]),
    ]


def test_bad_codebooks_and_codes_are_errors(spark, book):
    with pytest.raises(ValueError):
        quantize.Codebook(spark.createDataFrame([], "code long, centroid array<double>"))
    with pytest.raises(ValueError):
        quantize.Codebook(spark.createDataFrame([(1, [0.0]), (2, [0.0, 1.0])], "code long, centroid array<double>"))
    wrong = spark.createDataFrame([(1, [5])], "id long, codes array<long>")
    with pytest.raises(Exception, match="not in its codebook"):
        quantize.decode_codes(wrong, [book], "id").collect()
