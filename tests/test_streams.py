import json
import os

from pyspark.sql import functions as F

from strandline.streaming import streams as S


def drain(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_log_stream(spark, tmp_path):
    folder = tmp_path / "logs" / "refs" / "heads"
    os.makedirs(folder)
    line = f"{'0' * 40} {'a' * 40} A B <a@b> 946681200 +0100\tcommit: x\n"
    (folder / "m.1").write_text(line)
    (folder / "m.2").write_text(line.replace("0" * 40, "a" * 40, 1).replace("a" * 40 + " A", "b" * 40 + " A"))
    drain(S.read_log_stream(spark, str(tmp_path / "logs")), "log_rows", "append")
    rows = sorted(tuple(r) for r in spark.sql("SELECT ref_name, original_id, target_id, signature.tz_offset_min, reason FROM log_rows").collect())
    assert rows == [("refs/heads/m", "0" * 40, "a" * 40, 60, "commit: x"), ("refs/heads/m", "a" * 40, "b" * 40, 60, "commit: x")]


def test_appended_log_lines(spark, tmp_path):
    """Lines are read when they are complete, each once, also by a query that goes on after a stop."""
    folder = tmp_path / "logs" / "refs" / "heads"
    os.makedirs(folder)
    ids = [c * 40 for c in "0abcdef"]
    line = lambda i: f"{ids[i]} {ids[i + 1]} A B <a@b> {1000 + i} +0000\tstep {i}\n"
    checkpoint, out = str(tmp_path / "checkpoint"), str(tmp_path / "out")

    def run():
        q = S.follow_logs(spark, str(tmp_path / "logs")).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(processingTime="1 second").start()
        q.processAllAvailable()
        return q

    (folder / "m").write_text(line(0) + line(1)[:50])
    q = run()
    with open(folder / "m", "a") as f:
        f.write(line(1)[50:] + line(2))
    (folder / "n").write_text(line(5))
    q.processAllAvailable()
    q.stop()
    with open(folder / "m", "a") as f:
        f.write(line(3))
    run().stop()
    rows = sorted((r["ref_name"], r["signature"]["epoch"], r["original_id"], r["target_id"], r["reason"]) for r in spark.read.parquet(out).collect())
    assert rows == [("refs/heads/m", 1000 + i, ids[i], ids[i + 1], f"step {i}") for i in range(4)] + [("refs/heads/n", 1005, ids[5], ids[6], "step 5")]


def test_fold_commands(spark, tmp_path):
    rows = [("s", i, op, path, blob) for i, (op, path, blob) in enumerate([("M", "a/b", "1"), ("M", "c", "2"), ("D", "a", None), ("M", "c", "3")])]
    spark.createDataFrame(rows, "stream string, seq long, op string, path string, blob string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream string, seq long, op string, path string, blob string").parquet(str(tmp_path / "in"))
    drain(S.fold_commands(stream), "folded", "update")
    last = spark.table("folded").orderBy(F.desc("seq")).first()
    assert json.loads(last["files"]) == {"c": "3"} and last["n_files"] == 1
