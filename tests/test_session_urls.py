from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import functions as F
from tideframe import constants as C
from tideframe.functions import text
from tideframe.plans.queries import QUERIES


def test_urls_carry_all_parameters_and_the_whole_prompt(spark, sf_dir):
    prompts = {r["conv_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0").collect()}
    got = QUERIES["session_urls"](spark, sf_dir).collect()
    assert len(got) == len(prompts) and max(map(len, prompts.values())) > 12
    for r in got:
        pairs = parse_qsl(urlsplit(r["url"]).query, keep_blank_values=True)
        assert [k for k, _ in pairs] == C.SESSION_PARAMS and len(pairs) == 11
        assert dict(pairs)["text_prompt"] == prompts[r["conv_id"]]


def test_odd_prompts(spark):
    rows = spark.createDataFrame([("a&b=c ~*é",), (None,), ("",)], "t string")
    url = text.session_link(F.lit("ws://h"), F.col("t"), F.lit("v.pt"), F.lit(1), F.lit(2), text_topk=F.lit(3))
    got = [dict(parse_qsl(urlsplit(r[0]).query, keep_blank_values=True)) for r in rows.select(url).collect()]
    assert [g["text_prompt"] for g in got] == ["a&b=c ~*é", "", ""] and all(g["text_topk"] == "3" and len(g) == 11 for g in got)
