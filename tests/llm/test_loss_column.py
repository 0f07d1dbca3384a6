from collections import Counter

from tideframe.llm import packing


def test_loss_column_binds(spark):
    text = "one two three four five six seven eight nine ten"
    loss = {k: (k * 5) % 9 for k in range(60)} | {60: None, 61: 10**6, 62: -4}
    table = spark.createDataFrame([(k, text, n) for k, n in loss.items()], "doc_id long, text string, answer long").coalesce(1)
    got = packing.pack_documents(table, limits=packing.Limits(64, 8, 12), loss_col="answer").collect()
    bearing, placed, total = Counter(), Counter(), {}
    for r in got:
        n = loss[r["doc_id"]]
        n = r["doc_tokens"] if n is None else min(max(0, n), r["doc_tokens"])
        bearing[r["sequence_id"]] += max(0, r["start"] + r["length"] - max(r["start"], r["doc_tokens"] - n))
        placed[r["doc_id"]] += r["length"]
        total[r["doc_id"]] = r["doc_tokens"]
    assert dict(placed) == total and set(total) == set(loss)
    assert max(bearing.values()) <= 12 and len([n for n in bearing.values() if n == 12]) > 5
