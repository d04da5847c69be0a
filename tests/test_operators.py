import os

from pyspark.sql import functions as F

from emberlog.operators import relational as R
from emberlog.operators import tables
from emberlog.operators import text as T
from emberlog.sources import lines as L
from emberlog.streaming import jobs

LINES = [
    '{"timestamp": "2024-03-01T10:00:00Z", "level": "error", "service": "api", "msg": "it failed", "region": "eu"}',
    '{"ts": "1709287200123", "severity": "INFO", "message": "epoch"}',
    '{"broken": ',
    "2024-03-01T10:00:01.5Z stdout F hello from a pod",
    '10.0.0.1 - - [01/Mar/2024:10:00:02 +0000] "GET /x HTTP/1.1" 503 12',
    "Mar  1 10:00:03 host sshd[12]: session opened",
    'ts=2024-03-01T10:00:04Z level=warn service=db msg="slow query" took=12ms',
    "2024-03-01 10:00:05 [ERROR] [worker] something broke",
    "plain words only",
    "   ",
]


def test_formats(spark, tmp_path):
    (tmp_path / "2024-03-01").mkdir()
    (tmp_path / "2024-03-01" / "a.log").write_bytes("\n".join(LINES).encode() + b"\nbad \xff bytes")
    (tmp_path / "2023-01-01").mkdir()
    (tmp_path / "2023-01-01" / "b.log").write_text("old line")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "c.log").write_text("not a log")
    raw = L.prune_by_path_date(L.read_lines(spark, str(tmp_path), "*.log"), "2024-02-01", "2024-04-01")
    rows = {r.line: r for r in L.parse_lines(raw).collect()}
    assert len(rows) == 10 and any("\ufffd" in x for x in rows)
    assert [rows[x].format for x in LINES[:9]] == ["jsonl", "jsonl", "plain_text", "kubernetes_container_log", "apache_access", "syslog", "logfmt", "plain_text", "plain_text"]
    assert [str(rows[x].ts)[:19] if rows[x].ts else None for x in LINES[:9]] == ["2024-03-01 10:00:00", "2024-03-01 10:00:00", None, "2024-03-01 10:00:01", "2024-03-01 10:00:02", "2024-03-01 10:00:03", "2024-03-01 10:00:04", "2024-03-01 10:00:05", None]
    assert [rows[x].severity for x in LINES[3:8]] == ["info", "error", "info", "warning", "error"]
    assert rows[LINES[0]].attributes["region"] == "eu" and rows[LINES[6]].message == "slow query" and rows[LINES[5]].service == "sshd" and rows[LINES[4]].attributes["client_ip"] == "10.0.0.1"
    text = {r.line: r for r in L.raw_logs(raw).collect()}
    assert text[LINES[7]].service == "worker" and text[LINES[7]].severity == "ERROR" and text[LINES[0]].severity == "ERROR" and text[LINES[0]].labels["region"] == "eu"
    acc = L.line_accounting(L.parse_lines(raw), "2024-03-01 10:00:01", "2024-03-01 10:00:04").first()
    assert acc.input == acc.accepted + acc.rejected + acc.out_of_window == 10


def test_redaction(spark):
    cases = {
        "Authorization: Basic abc== mail a.b@c.org from 10.1.2.3 password=hunter2hunter2 in /home/joe/x": "<AUTH_HEADER> mail <EMAIL> from <IP> <SECRET> in <LOCAL_PATH>/x",
        "bare ghp_abcdefghijk01 and sk-proj-0123456789ab": "bare <SECRET> and <SECRET>",
        "to rtmps://h.example/live2/Key_1-2 now": "to rtmps://h.example/live2/<STREAM_KEY> now",
        "C:\\Users\\joe\\a\\b.txt and /Users/ann/y.log": "<LOCAL_PATH>/b.txt and <LOCAL_PATH>/y.log",
        "cookie: a=b; c=d, rest  user_id = ab12": "<COOKIE>, rest user_id=<ID>",
        "short token=abc stays, 999.1.1.1 too": "short token=abc stays, 999.1.1.1 too",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.sanitize(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases
    t = spark.createDataFrame([("0xff 0xABCDEF01 12345 7 a1b2 123e4567-e89b-12d3-a456-426614174000",)], "t string").select(T.template(F.col("t")).alias("p")).first()
    assert t.p == "0xff <HEX> <NUM> <N> a1b2 <UUID>"


def test_error_types(spark):
    cases = [
        ("can't open file 'x.py'", "INFO", "job_configuration_mismatch"), ("No such file or directory", "ERROR", "application_error"), ("Failed to start a.service", "INFO", "service_start_failure"), ("too many connections", "INFO", "connection_pool_exhausted"),
        ("database timed out", "INFO", "database_timeout"), ("deadline exceeded", "INFO", "dependency_timeout"), ("ingest_connected=false", "INFO", "stream_transport"), ("youtube api", "INFO", "youtube_health"), ("youtube only", "INFO", "none"),
        ("failure_kind=stall", "INFO", "service_health_failure"), ("failure_kind=none", "INFO", "none"), ("failure_kind=none, failure_kind=x", "INFO", "service_health_failure"), ("got 500 from it", "INFO", "http_5xx"), ("permission denied", "INFO", "auth_failure"),
        ("crashloop", "INFO", "runtime_restart"), ("rollout", "INFO", "deployment_event"), ("hm", "alert", "application_error"), ("hm", "WARN", "none"),
    ]
    rows = spark.createDataFrame(cases, "m string, s string, want string").select("want", "m", T.error_type(F.col("m"), F.col("s")).alias("got")).collect()
    assert [(r.m, r.got) for r in rows] == [(r.m, r.want) for r in rows]


def test_short_windows_are_refused():
    import pytest

    from emberlog.operators.logs import checked_window

    assert checked_window("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    with pytest.raises(ValueError):
        checked_window("2024-01-01 00:00:00", "2024-01-01 23:59:59")


def test_key_values_and_times(spark):
    row = spark.createDataFrame([("a=1 b=x a=2", "2024-01-01T00:00:00Z"), ("none", "1704067200000")], "m string, t string").select(T.key_values(F.col("m")).alias("kv"), T.tolerant_timestamp(F.col("t")).alias("ts")).collect()
    assert row[0].kv == {"a": "2", "b": "x"} and row[1].kv == {}
    assert row[0].ts == row[1].ts


def test_packing(spark):
    rows = [("a", i, t) for i, t in enumerate([5, 5, 5, 12, 1, 1])] + [("b", 0, 3)]
    got = R.pack_by_budget(spark.createDataFrame(rows, "b string, i int, t int"), "b", ["i"], "t", 10).orderBy("b", "i").collect()
    assert [r.chunk for r in got] == [1, 1, 2, 3, 4, 4, 1]


def test_range_join_edges(spark):
    a = spark.sql("select 1 k, timestamp '2024-01-01 00:00:00' x")
    b = spark.sql("select 1 k, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s) y from (select explode(array(0, 1799, 1800, 1801)) s)")
    assert sorted(r.gap_s for r in R.range_join(a, b, ["k"], "x", "y", 1800).collect()) == [0, 1799, 1800]


def test_overlapping_spans_meet_once(spark):
    spans = [(k, k * 13 % 50, k * 13 % 50 + k % 4 * 11) for k in range(40)]
    rows = spark.createDataFrame(spans, "k int, s long, e long").withColumns({c: F.timestamp_seconds(c) for c in "se"})
    got = R.overlapping(rows, rows.select(*[F.col(c).alias(f"r_{c}") for c in "kse"]), "s", "e", 10).collect()
    assert sorted((r.k, r.r_k) for r in got) == [(a[0], b[0]) for a in spans for b in spans if max(a[1], b[1]) <= min(a[2], b[2])]


def test_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    tables.append(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, p string, v int"), p, ["p"])
    tables.replace_partitions(spark.createDataFrame([(3, "a", 1)], "id int, p string, v int"), p, ["p"])
    now = spark.read.parquet(p).select("id", "p", "v")
    assert sorted(r.id for r in now.collect()) == [2, 3]
    new = spark.createDataFrame([(3, "a", 9)], "id int, p string, v int")
    assert {r.id: r.v for r in tables.upserted(now, new, ["id"], F.desc("v")).collect()} == {2: 1, 3: 9}
    assert [r.id for r in tables.without_keys(now, new, ["id"]).collect()] == [2]


def test_streams_equal_batch(spark, data, tmp_path):
    src = str(tmp_path / "events")
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(src)
    stream = jobs.read_events(spark, src, events.schema, 10)
    jobs.run_available(jobs.deduplicated(stream, "event_id"), str(tmp_path / "d"), str(tmp_path / "dc"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == events.select("event_id").distinct().count()
    jobs.run_available(jobs.hourly_counts(stream, ["event_type"]), str(tmp_path / "h"), str(tmp_path / "hc"))
    got = {(r.hour, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "h")).collect()}
    want = {(r.hour, r.event_type): r.n for r in jobs.hourly_counts(events, ["event_type"]).collect()}
    assert got and got.items() <= want.items()  # hours after the last watermark stay open
    q = jobs.latest_state(stream, "user_id").writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, jobs.latest_state(events, "user_id").collect()))
    assert os.path.exists(str(tmp_path / "hc"))


def test_streamed_items_equal_batch(spark, data, tmp_path):
    from emberlog.plans import semantics as E

    keys = ["event_name", "severity", "template", "component", "source_system", "error_code", "exception_class"]
    rows = E.events(spark, data).select(*keys, "ts", "event_id", "message", "trace_id", "event_type", "user_id")
    src = str(tmp_path / "items")
    rows.repartition(3).write.parquet(src)
    stream = jobs.read_events(spark, src, rows.schema, 10)
    jobs.run_available(jobs.running_items(stream, keys), str(tmp_path / "i"), str(tmp_path / "ic"))
    jobs.run_available(jobs.latest_state(stream, "user_id", late="1 hour"), str(tmp_path / "s"), str(tmp_path / "sc"))
    got, want = spark.read.parquet(str(tmp_path / "i")), jobs.running_items(rows, keys)
    assert 0 < got.count() <= want.count() and got.exceptAll(want).count() == 0  # days after the last watermark stay open
    state = spark.read.parquet(str(tmp_path / "s"))
    assert state.count() > 0 and state.exceptAll(jobs.latest_state(rows, "user_id", late="1 hour")).count() == 0
