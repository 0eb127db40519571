"""Files and streams."""

import datetime

from pyspark.sql import functions as F

from lodestar.sources import readers, writers
from lodestar.streaming import streams


def put(root, name, content):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(content)


def test_pages_and_raw_sources(spark, tmp_path):
    put(tmp_path, "concepts/A-b.md", '---\ntitle: "T"\nstatus: seed\n---\nbody [[x]]')
    put(tmp_path, "concepts/deep/no.md", "below")
    put(tmp_path, "other/no.md", "elsewhere")
    put(tmp_path, "raw/articles/x.md", "a\r\nb")
    put(tmp_path, "raw/articles/x.exe", "no")
    put(tmp_path, "raw/unknown/y.md", "no")
    rows = readers.pages(spark, str(tmp_path)).collect()
    assert [(r["id"], r["metadata"]["title"], r["content"]) for r in rows] == [("concepts/a-b", "T", "body [[x]]")]
    raw = readers.raw_sources(spark, str(tmp_path)).collect()
    assert [(r["ref"], r["kind"], r["bytes"]) for r in raw] == [("raw/articles/x.md", "article", 4)]
    assert readers.pages(spark, str(tmp_path / "nowhere")).count() == 0


def test_logs(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert readers.json_log(spark, f"{tmp_path}/log.json", "a int").count() == 2
    assert readers.json_log(spark, f"{tmp_path}/absent.json", "a int").count() == 0
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 2), "op", "# head\nline")], "ts timestamp, op string, message string")
    writers.append_log(df, f"{tmp_path}/wiki_log")
    writers.append_log(df, f"{tmp_path}/wiki_log")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/wiki_log").collect()] == ["- 2024-01-02 | op | \\# head line"] * 2


def test_tables_are_replaced_whole(spark, tmp_path):
    at = f"{tmp_path}/t"
    for n in (3, 5):
        writers.replace_table(spark.range(n), at)
        assert writers.read_table(spark, at).count() == n


def test_streams(spark, tmp_path):
    rows = [("k", i, t) for i, t in enumerate([0, 10, 20, 3601, 3602], 1)]
    spark.createDataFrame(rows, "key string, entry long, at long").coalesce(1).write.parquet(f"{tmp_path}/in")
    calls = streams.arrivals(spark, f"{tmp_path}/in", "key string, entry long, at long")
    q = streams.limited(calls, 2).writeStream.format("memory").queryName("answers").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["entry"]: r["accepted"] for r in spark.table("answers").collect()} == {1: True, 2: True, 3: False, 4: True, 5: False}


def test_weekly_stream(spark, tmp_path, sf):
    from lodestar.plans.adapters import verdicts

    v = verdicts(spark, sf).select("ts", "verdict").coalesce(1)
    v.write.parquet(f"{tmp_path}/v")
    far = spark.createDataFrame([(datetime.datetime(2030, 1, 1), "pass")], "ts timestamp, verdict string")
    far.coalesce(1).write.mode("append").parquet(f"{tmp_path}/v")
    s = streams.weekly_verdicts(streams.arrivals(spark, f"{tmp_path}/v", v.schema))
    q = s.writeStream.format("memory").queryName("weeks").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r["week"]: r["n"] for r in v.groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n")).collect()}
    assert {r["week"]: r["total"] for r in spark.table("weeks").collect()} == want


def test_compile_is_idempotent(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.createDataFrame([("a", "1"), ("b", "2")], "ref string, hash string").write.parquet(src)
    for k in range(2):
        streams.compile_batches(streams.arrivals(spark, src, "ref string, hash string"), f"{tmp_path}/m", f"{tmp_path}/ck{k}").awaitTermination()
    assert sorted(tuple(r) for r in writers.read_table(spark, f"{tmp_path}/m/manifest").collect()) == [("a", "1"), ("b", "2")]
