"""The source of files of lines: pruning before files are opened, numbers of lines across blocks, years of files."""

import os

from pyspark.sql import functions as F

from emberlog.sources import files as I
from emberlog.sources import lines as L


def test_only_chosen_files_are_opened(spark, tmp_path):
    for name in ("a-2024-01-05.log", "b-2024-02-05.log", "plain.log", "x.zip", ".git/c.log", "sub/20240106_d.log"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(f"of {name}\n\n  \nlast")
    files = I.chosen(I.listed(spark, str(tmp_path)), "2024-01-01", "2024-01-31")
    got = I.read_files(files)
    names = lambda paths: sorted(os.path.basename(p) for p in paths)
    assert names(got.inputFiles()) == ["20240106_d.log", "a-2024-01-05.log", "plain.log"]
    assert names({r.path for r in got.collect()}) == ["20240106_d.log", "a-2024-01-05.log", "plain.log"]
    assert sorted((r.line_no, r.line) for r in got.where("path like '%plain.log'").collect()) == [(1, "of plain.log"), (4, "last")]
    assert I.read_files(files.limit(0)).count() == 0


def test_line_numbers_across_blocks(spark, tmp_path):
    lines = [f"{k} " + "x" * (k % 300) if k % 7 else "" for k in range(5_000)]
    (tmp_path / "large.log").write_text("\r\n".join(lines))
    (tmp_path / "small.log").write_text("one\ntwo\n")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, "20000")
        got = I.read_files(I.listed(spark, str(tmp_path)))
        rows = got.collect()
        assert got.rdd.getNumPartitions() > 20
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    large = sorted((r.line_no, r.line) for r in rows if r.path.endswith("large.log"))
    assert large == [(k + 1, x) for k, x in enumerate(lines) if x]
    assert sorted((r.line_no, r.line) for r in rows if r.path.endswith("small.log")) == [(1, "one"), (2, "two")]


def test_syslog_year_is_that_of_the_file(spark, tmp_path):
    for year, name in ((2019, "old.log"), (2023, "new.log")):
        p = tmp_path / name
        p.write_text("Mar  5 01:02:03 host-1 sshd[7]: session denied")
        stamp = (year - 1970) * 31_557_600 + 10_000_000
        os.utime(p, (stamp, stamp))
    rows = L.parse_lines(I.read_files(I.listed(spark, str(tmp_path))), F.year("modified")).select("path", "ts", "host").collect()
    assert {(os.path.basename(r.path), r.ts.year, r.ts.month, r.ts.day, r.host) for r in rows} == {("old.log", 2019, 3, 5, "host-1"), ("new.log", 2023, 3, 5, "host-1")}


def test_streamed_items_have_exact_traces(spark, data, tmp_path):
    """Over several triggers the same rows as of all events at once; only days behind the watermark are out."""
    from emberlog.streaming import jobs

    rows = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id", "ts", "event_type", "concat('m', event_id) as message", "case when user_id % 9 > 0 then concat('t', user_id % 7) end as trace_id")
    src = str(tmp_path / "src")
    for lo, hi in (("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01")):
        rows.where(f"ts >= timestamp '{lo}' and ts < timestamp '{hi}'").coalesce(1).write.mode("append").parquet(src)
    stream = jobs.read_events(spark, src, rows.schema, 1)
    jobs.run_available(jobs.items_with_traces(stream, ["event_type"]), str(tmp_path / "i"), str(tmp_path / "ic"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "i")).collect()))
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")
    want = rows.groupBy("event_type", day).agg(F.count("*").alias("n"), F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp"), F.min_by("message", F.struct("ts", "event_id")), F.count_distinct("trace_id"))
    want = sorted(map(tuple, want.collect()))
    assert got and got == [w for w in want if w in got] and len(got) >= len(want) - 12


def test_streamed_runs_keep_terminal_states(spark, tmp_path):
    from emberlog.streaming import jobs

    schema, src = "run_id string, status string, at long", str(tmp_path / "src")
    for batch in ([("a", "queued", 1), ("a", "running", 2), ("b", "ok", 5)], [("a", "ok", 3), ("a", "running", 4), ("b", "running", 6)], [("b", "reopened", 7), ("b", "queued", 2), ("a", "failed", 8)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = jobs.read_events(spark, src, schema, 1)
    q = jobs.run_states(stream).writeStream.format("memory").queryName("run_states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("run_states").collect():
        last[r.run_id] = max(last.get(r.run_id, (-1, "", 0)), (r.at, r.state, r.changes))
    assert {k: v[1:] for k, v in last.items()} == {"a": ("ok", 3), "b": ("reopened", 2)}
