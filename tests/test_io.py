"""Loaders, sinks and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barograph.sources import files, pages, sinks
from barograph.streaming import jobs
from conftest import FOLDER


def lines(spark, text, file="f.csv"):
    return spark.createDataFrame([(file, line) for line in text], "file string, value string")


def test_short_matrix_both_layouts(spark):
    old = lines(spark, [",,Trade Date,,", ",,02/01/2019,,03/01/2019,", ",,Reported Short Positions,% held,Reported,% held",
                        "Product,Product Code,Reported,%,Reported,%", '"AAA, LTD ",AAA ,"1,000","1,234.5",10,', "BBB,BBB,5,0.7,6,-"], "old.csv")
    new = lines(spark, [",Trade Date,2022-05-02,,2022-05-03,", ",,Reported Short Positions,% held,Reported,% held", "AAA,AAA,1,2.5,1,3.5", "CCC,CCC,20181115,4.5,20181116,5"], "new.csv")
    got = {(r.symbol, str(r.date)): r.short for r in files.short_matrix(old.unionByName(new), ("3 May 2022",)).collect()}
    assert got == {("AAA", "2019-01-02"): 1234.5, ("BBB", "2019-01-02"): 0.7, ("AAA", "2022-05-02"): 2.5, ("CCC", "2022-05-02"): 4.5}
    assert files.short_matrix(lines(spark, [",Trade Date,15/06/2017,,16/08/2017,", "AAA,AAA,1,2.5,1,3.5"])).count() == 1


def test_text_loader_reads_files(spark, tmp_path):
    (tmp_path / "y1.txt").write_text("symbol,date,open,high,low,close,volume\nAAA,20200102,1,2,0.5,1.5,100\n")
    (tmp_path / "y2.txt").write_text("BBB,20210104,1,2,0.5,1.7,200\n\n")
    got = files.yearly_price_rows(spark.read.text(str(tmp_path))).orderBy("symbol").collect()
    assert [(r.symbol, str(r.date), r.close) for r in got] == [("AAA", "2020-01-02", 1.5), ("BBB", "2021-01-04", 1.7)]
    with pytest.raises(Exception):
        files.price_rows(spark.createDataFrame([("AAA,20200102,x,2,1,1,1",)], "value string")).collect()


def test_pages(spark):
    html = "<table><tr><th>h</th></tr><tr><td>ABCO</td><td>2026-01-01</td><td>0.25</td><td>ABC</td><td>A &amp; B</td><td></td></tr><tr><td>bad</td><td>x</td><td>n/a</td><td>b</td><td>c</td></tr></table>"
    rows = pages.option_rows(spark.createDataFrame([(1, html)], "id int, html string")).collect()
    assert [(r.option_symbol, r.exercise, r.share_name, r.note) for r in rows] == [("ABCO", 0.25, "A & B", None)]
    texts = spark.createDataFrame([(1, "<p>wheat is trading at 1,234.5, on April 10, 2026</p>"), (2, "rose to 77.25 today"), (3, "no number")], "id int, html string")
    got = {r.id: (r.price, str(r.date)) for r in pages.text_prices(texts, F.lit(dt.date(2026, 5, 1))).collect()}
    assert got == {1: (1234.5, "2026-04-10"), 2: (77.25, "2026-05-01")}


def test_partition_sink_replaces_only_touched(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([("A", 1), ("B", 1)], "industry string, v int"), path, "industry")
    sinks.replace_partitions(spark.createDataFrame([("B", 2)], "industry string, v int"), path, "industry")
    assert {(r.industry, r.v) for r in spark.read.parquet(path).collect()} == {("A", 1), ("B", 2)}
    builds = []

    def build():
        builds.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.read_or_build(spark, str(tmp_path / "c"), "train-2000", build).count() == 3
    assert len(builds) == 1


@pytest.fixture(scope="module")
def ticks(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), "value")


@pytest.fixture()
def stream(spark, ticks, tmp_path):
    source = str(tmp_path / "in")
    ticks.coalesce(1).sortWithinPartitions("ts").write.parquet(source)
    return spark.readStream.schema(ticks.schema).parquet(source)


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def same(a, b):
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
    assert rows(a) == rows(b) and rows(a)


def test_stream_bars_equal_batch(stream, ticks):
    same(drain(jobs.bars(stream), "bars_out", "complete"), jobs.bars(ticks))


def test_stream_sessions_equal_batch(stream, ticks):
    done = drain(jobs.sessions(stream, "12 hours"), "sessions_out", "complete")
    same(done, jobs.sessions_batch(ticks, 12 * 3600))


def test_stream_activity_equals_batch(stream, ticks):
    same(drain(jobs.activity(stream), "activity_out", "complete"), jobs.activity(ticks))


def test_stream_enriched_and_alerts_equal_batch(spark, stream, ticks):
    static = ticks.select("key").distinct().where(F.col("key") % 2 == 0).withColumn("name", F.concat(F.lit("n"), "key"))
    same(drain(jobs.enriched(stream, static), "enriched_out", "append"), jobs.enriched(ticks, static))
    latest = lambda t: t.groupBy("key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    levels = static.select("key", F.lit("price_above").alias("kind"), F.lit(20.0).alias("level"))
    told = []
    query = latest(stream).writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(
        lambda batch, _: told.extend(map(tuple, jobs.alerts(batch, levels).collect()))).start()
    query.awaitTermination(120)
    assert sorted(told) == sorted(map(tuple, jobs.alerts(latest(ticks), levels).collect())) and told


def test_stream_deduplicates(spark, stream, ticks):
    assert drain(jobs.deduplicated(stream.union(stream)), "dedup_out", "append").count() == ticks.count()


def test_stream_misses_equal_batch(spark, ticks, tmp_path):
    active = ticks.select("key", F.col("ts").cast("date").alias("day")).distinct()
    first = active.groupBy("key").agg(F.min("day").alias("first"))
    days = active.select("day").distinct()
    daily = first.join(days, F.col("day") >= F.col("first")).join(active.withColumn("returned", F.lit(True)), ["key", "day"], "left").select(
        F.col("key").cast("string").alias("key"), "day", F.coalesce("returned", F.lit(False)).alias("returned"))
    path = str(tmp_path / "daily")
    daily.coalesce(1).write.parquet(path)
    out = drain(jobs.miss_counter(spark.readStream.schema(daily.schema).parquet(path)), "miss_out", "append")
    last = out.groupBy("key").agg(F.max_by(F.struct("consecutive_misses", "first_miss_date", "last_miss_date"), "day").alias("s")).select("key", "s.*").where(
        F.col("consecutive_misses") > 0)
    batch = jobs.miss_state(ticks).select(F.col("key").cast("string").alias("key"), F.col("consecutive_misses").cast("int").alias("consecutive_misses"),
                                          "first_miss_date", "last_miss_date")
    same(last, batch)


def test_upsert_sink_survives_replay(spark, tmp_path):
    path = str(tmp_path / "sink")
    write = jobs.upsert_sink(path, ["key"])
    for batch_id, rows in ((0, [(1, 1.0), (2, 1.0), (1, 0.5)]), (1, [(2, 5.0)]), (1, [(2, 6.0)])):
        write(spark.createDataFrame(rows, "key int, v double"), batch_id)
    assert {(r.key, r.v) for r in jobs.current(spark.read.parquet(path), ["key"]).collect()} == {(1, 1.0), (2, 6.0)}


def test_archives_are_opened_in_tasks(spark, tmp_path):
    import io
    import zipfile

    from barograph.sources import archives

    def packed(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in members.items():
                z.writestr(name, text)
        return out.getvalue()

    long = "".join(f"line {k}\n" for k in range(5000))
    good = packed({"a.csv": "x,1\r\ny,2\n", "dir/": "", "dir/b.csv": long, "empty.csv": "", "last.csv": "no newline"})
    torn = bytearray(packed({"c.csv": long * 3, "d.csv": "fine\n"}))
    torn[200:260] = b"\0" * 60  # inside the first member's data
    for name, content in (("one.zip", good), ("two.zip", bytes(torn)), ("bad.zip", b"no archive"), ("skip.txt", b"text")):
        (tmp_path / name).write_bytes(content)
    rows = archives.read_archives(spark, str(tmp_path), batch_bytes=4096).collect()
    lines = {}
    for r in sorted((r for r in rows if r.problem is None), key=lambda r: (r.archive, r.member, r.number)):
        lines.setdefault((r.archive.rsplit("/", 1)[1], r.member), []).append(r.value)
    assert lines["one.zip", "a.csv"] == ["x,1", "y,2"] and lines["one.zip", "last.csv"] == ["no newline"]
    assert lines["one.zip", "dir/b.csv"] == long.splitlines() and lines["two.zip", "d.csv"] == ["fine"]
    assert {(r.archive.rsplit("/", 1)[1], r.member) for r in rows if r.problem} == {("two.zip", "c.csv"), ("bad.zip", None)}
    stored = str(tmp_path / "stored")
    frame = spark.createDataFrame([("z", "m.csv", 2, "b"), ("z", "m.csv", 1, "a"), ("y", "n.csv", 1, "c")], "archive string, member string, number long, value string")
    archives.write_archives(frame, stored)
    again = archives.archive_lines(archives.stored_archives(spark, stored)).collect()
    assert sorted((r.archive, r.member, r.number, r.value) for r in again) == [("y", "n.csv", 0, "c"), ("z", "m.csv", 0, "a"), ("z", "m.csv", 1, "b")]
    assert archives.archive_lines(spark.createDataFrame([("n", None)], "path string, content binary")).count() == 0
