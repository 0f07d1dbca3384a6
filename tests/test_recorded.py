import datetime

from pyspark.sql import functions as F
from tideframe.sources import messages
from tideframe.sources.recorded import RecordedMessages


def test_recorded_messages(spark, tmp_path):
    spark.dataSource.register(RecordedMessages)
    folder = str(tmp_path / "rec")
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(f"s{k % 3}", t0 + datetime.timedelta(milliseconds=80 * k), "text" if k % 2 else "ping", f"piece {k}") for k in range(12)]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, kind string, data string")
    sent = df.select("session_id", "ts", messages.encode(F.col("kind"), F.col("data")).alias("message"))
    sent.write.format("recorded_messages").mode("append").save(folder)
    want = sorted((r["session_id"], r["ts"], bytes(r["message"])) for r in sent.collect())
    back = spark.read.format("recorded_messages").load(folder)
    assert sorted((r["session_id"], r["ts"], bytes(r["message"])) for r in back.collect()) == want
    stream = spark.readStream.format("recorded_messages").option("files_per_batch", "2").load(folder)
    q = stream.writeStream.format("memory").queryName("recorded").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    fine, bad = messages.valid_messages(spark.table("recorded"))
    assert bad.count() == 0 and fine.where("type = 'text'").count() == 6
