"""Queries over log lines of all formats, derived from the events. Twins are written by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import relational as R
from emberlog.operators import text as T
from emberlog.sources import files as I
from emberlog.sources import lines as S
from emberlog.storage import shared_folder

from .facts import INCIDENT, LOGS, logs, stored

#: The test data's lines, as an expression of the events that both dialects read: not an operator.
LINES = """select event_id, concat('/in/', case event_id % 5 when 0 then 'app-' when 1 then '2024-01-20/db-' when 2 then '20240123_web-' when 3 then 'logs/2023-12-31/old-2024-01-25-' else '.git/' end, case event_id % 7 when 6 then 'x.zip' when 5 then '/LOCK' else concat('n', event_id % 7, '.log') end) as path,
 case event_id % 17
 when 0 then concat('{"timestamp":"', replace(seen, ' ', 'T'), 'Z","level":"Error","service":"api-', user_id % 3, '","message":"request failed for a@b.example.com","status":"failed","host":"h1"}')
 when 1 then concat('{"ts":', 1704067200 + event_id, '123,"app":"worker","msg":"tick","env":"stage","healthy":"false"}')
 when 2 then concat('{"__REALTIME_TIMESTAMP":"', 1704067200 + event_id, '123456","_SYSTEMD_UNIT":"db.service","PRIORITY":"', event_id % 8, '","MESSAGE":"disk at ', user_id % 9, '"}')
 when 3 then concat(replace(seen, ' ', 'T'), '.5Z stderr F error: pod ', user_id % 9, ' died')
 when 4 then concat('10.0.0.1 - joe [', substr(seen, 9, 2), '/Jan/2024:', substr(seen, 12), ' +0000] "GET /x/', user_id % 9, ' HTTP/1.1" ', case event_id % 3 when 0 then 503 when 1 then 404 else 200 end, ' 12 rt=0.5')
 when 5 then concat('10.0.0.2 - - [', substr(seen, 9, 2), '/Jan/2024:', substr(seen, 12), ' +0100] "POST /y HTTP/2" ', case event_id % 2 when 0 then 500 else 201 end, ' -')
 when 6 then 'Traceback (most recent call last) at x'
 when 7 then concat('java.lang.Illegal Exception: boom ', user_id % 9)
 when 8 then concat('Jan ', substr(seen, 9, 2), ' ', substr(seen, 12), ' host-', user_id % 2, ' sshd[', user_id, ']: session denied')
 when 9 then concat('ts=', replace(seen, ' ', 'T'), 'Z level=warn service=db component=pool msg="slow query of ', user_id % 9, '" took=12 took=13')
 when 10 then concat('retry=', user_id % 9, ' only')
 when 11 then concat(seen, ',250 [ERROR] [worker-2] something broke ', user_id % 9)
 when 12 then 'nothing in here at all'
 when 13 then ''
 when 14 then '   '
 when 15 then concat('user-name: u', user_id % 9, ' seen')
 else concat('{"kind":"restart","reason":"r', user_id % 9, '","metric":{"service":"inner"},"note":null}') end as line
 from (select event_id, user_id, substr(cast(date_trunc('second', ts) as varchar(30)), 1, 19) as seen from EVENTS where event_id is not null and user_id is not null) t"""


def _all(spark, d):
    def build():
        spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("__emberlog_lines")
        return spark.sql(LINES.replace("EVENTS", "__emberlog_lines"))

    return stored(spark, d, "lines", build)


def _files(spark, d):
    """The logs' messages as text files, four for each day, below the shared folder."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows = logs(spark, d).select(F.concat_ws("", F.lit("dt="), F.date_format("ts", "yyyy-MM-dd")).alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("dt"), (F.col("event_id") % 4).alias("quarter"), "event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "message").alias("value"))
    rows = rows.repartition("dt", "quarter").sortWithinPartitions("dt", "quarter", "event_id")
    rows.select("value", "dt", "quarter").write.partitionBy("dt", "quarter").text(path)
    return path


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the files of a window with their numbers: files of other days are not opened."""
    files = I.chosen(I.listed(spark, _files(spark, d), "*.txt"), "2024-01-22", "2024-01-28")
    part = lambda p: F.regexp_extract("path", p, 1)
    return I.read_files(files).select(F.split("line", " ")[0].cast("long").alias("event_id"), part(r"dt=([\d-]+)").alias("dt"), part(r"quarter=(\d)").cast("int").alias("quarter"), "line_no")


def wanted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines by file, without the files that hold none and those whose dates are all outside the window."""
    return S.prune_by_path_date(S.wanted_files(_all(spark, d)), "2024-01-22", "2024-01-28").groupBy("path").agg(F.count("*").alias("n"))


def line_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = _all(spark, d)
    return rows.select("event_id", S.detected_format(F.col("line"), S.json_object(F.col("line"))).alias("format"))


def _parsed(spark, d):
    return stored(spark, d, "parsed-lines", lambda: S.parse_lines(S.wanted_files(_all(spark, d))))


def parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("event_id", "format", "ts", "inferred", "severity", "severity_number", "service", "component", "environment", "host", "message")


def line_attributes(spark: SparkSession, d: str) -> DataFrame:
    """How often each attribute has each value, by format."""
    a = _parsed(spark, d).where("format not in ('jsonl', 'journald_json')").select("format", F.explode("attributes").alias("key", "value"))
    return a.groupBy("format", "key", "value").agg(F.count("*").alias("n"))


def raw_log_lines(spark: SparkSession, d: str) -> DataFrame:
    r = S.raw_logs(S.wanted_files(_all(spark, d)))
    return r.select("event_id", "ts", "service", "environment", "severity", "message", "resource_type", F.map_contains_key("labels", "parse_mode").alias("as_text"))


def case_logs(spark: SparkSession, d: str) -> DataFrame:
    """Raw logs under the service and environment of a case: what they were before is a label."""
    r = S.with_case(S.raw_logs(S.wanted_files(_all(spark, d))), "checkout", "case-7")
    old = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))
    return r.groupBy("service", "environment", old("original_service").alias("old_service"), old("original_environment").alias("old_environment")).agg(F.count("*").alias("n"))


def rejected_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.rejected_lines(_all(spark, d)).groupBy("path", "line_sha256", "raw_ref", "reason").agg(F.count("*").alias("n"))


def line_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Input lines and what became of them: lines without a time are kept, or tested by the time they were observed."""
    p = _parsed(spark, d).withColumn("observed", F.expr("timestamp '2024-01-20 00:00:00' + make_dt_interval(event_id % 10)"))
    kept, tested = S.line_accounting(p, *INCIDENT).withColumn("undated", F.lit("kept")), S.line_accounting(p, *INCIDENT, keep_inferred=False).withColumn("undated", F.lit("tested"))
    return kept.unionByName(tested)


def loaded_logs(spark: SparkSession, d: str) -> DataFrame:
    """A bulk load: lines of a half-open window, sanitized, at most so many, counted by service."""
    p = _parsed(spark, d).where("trim(line) <> ''")
    rows = R.in_window(p, *INCIDENT).orderBy("ts", "event_id").limit(500).select("service", "severity", "ts", T.sanitize(F.col("message")).alias("message"))
    return rows.groupBy("service").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.contains("message", F.lit("<EMAIL>"))).alias("redacted"))


SENSITIVE = (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b")


def input_profile(spark: SparkSession, d: str) -> DataFrame:
    return S.input_profile(S.wanted_files(_all(spark, d)), SENSITIVE)


def system_type(spark: SparkSession, d: str) -> DataFrame:
    return S.system_type(input_profile(spark, d))


QUERIES = {f.__name__: f for f in (file_lines, wanted_lines, line_formats, parsed_lines, line_attributes, raw_log_lines, case_logs, rejected_lines, line_accounting, loaded_logs, input_profile, system_type)}


# ---- twins

_L = f"with l as (select *, event_id % 17 k from ({LINES.replace('EVENTS', 'events')})), w as (select * from l where event_id % 5 <> 4 and event_id % 7 not in (5, 6))"
_FORMAT = "case k when 0 then 'jsonl' when 1 then 'jsonl' when 16 then 'jsonl' when 2 then 'journald_json' when 3 then 'kubernetes_container_log' when 4 then 'nginx_access' when 5 then 'apache_access' when 6 then 'python_traceback' when 7 then 'java_stacktrace' when 8 then 'syslog' when 9 then 'logfmt' when 10 then 'key_value' when 15 then 'key_value' else 'plain_text' end"
_STEM = "regexp_replace(string_split(path, '/')[-1], '[.][^.]*$', '')"
_PARSED = _L + f""", q as (select w.*, e.user_id u, date_trunc('second', e.ts)::timestamp seen from w join events e using (event_id)),
p as (select event_id, path, line, {_FORMAT} as format, case when k in (0, 3, 4, 8, 9, 11) then seen when k = 5 then seen - interval 1 hour when k in (1, 2) then make_timestamp((1704067200 + event_id) * 1000000) end ts,
 case k when 0 then 'error' when 1 then 'error' when 2 then ['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'info', 'debug'][event_id % 8 + 1] when 3 then 'error' when 4 then case event_id % 3 when 0 then 'error' when 1 then 'warning' else 'info' end when 5 then case event_id % 2 when 0 then 'error' else 'info' end when 6 then 'error' when 7 then 'error' when 8 then 'error' when 9 then 'warning' when 10 then 'warning' when 11 then 'error' else 'info' end severity,
 case k when 0 then 'api-' || (u % 3) when 1 then 'worker' when 2 then 'db.service' when 8 then 'sshd' when 9 then 'db' else {_STEM} end service, case k when 2 then 'db.service' when 3 then 'stderr' when 4 then 'http_access' when 5 then 'http_access' when 8 then 'sshd' when 9 then 'pool' when 16 then 'restart' else 'unknown' end component,
 case k when 1 then 'stage' else 'unknown' end environment, case k when 0 then 'h1' when 8 then 'host-' || (u % 2) else '' end host,
 case k when 0 then 'request failed for a@b.example.com' when 1 then 'tick' when 2 then 'disk at ' || (u % 9) when 3 then 'error: pod ' || (u % 9) || ' died' when 4 then 'GET /x/' || (u % 9) || ' -> HTTP ' || case event_id % 3 when 0 then 503 when 1 then 404 else 200 end when 5 then 'POST /y -> HTTP ' || case event_id % 2 when 0 then 500 else 201 end
  when 8 then 'session denied' when 9 then 'slow query of ' || (u % 9) when 11 then '[ERROR] [worker-2] something broke ' || (u % 9) when 16 then 'restart reason=r' || (u % 9) else trim(line) end message, u, k from q)"""
_NUM = "case severity when 'debug' then 5 when 'info' then 9 when 'notice' then 10 when 'warning' then 13 when 'error' then 17 when 'critical' then 21 when 'alert' then 22 when 'emergency' then 23 end"
_IN = f"ts >= timestamp '{INCIDENT[0]}' and ts <= timestamp '{INCIDENT[1]}'"
_RAW = _L + f""", q as (select w.*, e.user_id u, date_trunc('second', e.ts)::timestamp seen from w join events e using (event_id) where trim(line) <> ''),
r as (select event_id, case when k in (0, 3, 11) then seen when k = 1 then make_timestamp((1704067200 + event_id) * 1000000) end ts, case k when 0 then 'api-' || (u % 3) when 1 then 'worker' when 16 then 'inner' when 11 then 'worker-2' else {_STEM} end service, case k when 1 then 'stage' else 'prod' end environment,
 case k when 0 then 'ERROR' when 1 then 'ERROR' when 16 then 'WARN' when 3 then 'ERROR' when 6 then 'ERROR' when 7 then 'ERROR' when 9 then 'WARN' when 11 then 'ERROR' else 'INFO' end severity,
 case k when 0 then 'request failed for a@b.example.com status=failed' when 1 then 'tick healthy=false' when 2 then 'event' when 16 then 'restart kind=restart' when 3 then 'Z stderr F error: pod ' || (u % 9) || ' died' when 11 then '[worker-2] something broke ' || (u % 9) else trim(line) end message, case k when 16 then 'restart' else 'log' end resource_type, k not in (0, 1, 2, 16) as_text from q)"""
ORACLES = {
    "file_lines": f"with {LOGS} select event_id, strftime(ts, '%Y-%m-%d') as dt, (event_id % 4)::int as quarter, row_number() over (partition by day, event_id % 4 order by event_id) as line_no from logs where day between date '2024-01-22' and date '2024-01-28'",
    "wanted_lines": f"{_L} select path, count(*) n from w where event_id % 5 <> 1 group by 1",
    "line_formats": f"{_L} select event_id, {_FORMAT} as format from l",
    "parsed_lines": f"{_PARSED} select event_id, format, ts, ts is null inferred, severity, {_NUM} severity_number, service, component, environment, host, message from p",
    "line_attributes": f"""{_PARSED}, a as (select format, unnest(case k when 3 then [['stream', 'stderr'], ['tag', 'F']] when 4 then [['client_ip', '10.0.0.1'], ['user', 'joe'], ['http_method', 'GET'], ['path', '/x/' || (u % 9)], ['status_code', case event_id % 3 when 0 then '503' when 1 then '404' else '200' end], ['response_size', '12']] when 5 then [['client_ip', '10.0.0.2'], ['user', '-'], ['http_method', 'POST'], ['path', '/y'], ['status_code', case event_id % 2 when 0 then '500' else '201' end], ['response_size', '-']]
 when 8 then [['program', 'sshd'], ['pid', u::varchar]] when 9 then [['ts', replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', 'T') || 'Z'], ['level', 'warn'], ['service', 'db'], ['component', 'pool'], ['msg', message], ['took', '13']] when 10 then [['retry', (u % 9)::varchar]] else [] end) kv from p) select format, kv[1] as key, kv[2] as value, count(*) n from a group by all""",
    "raw_log_lines": f"{_RAW} select * from r",
    "case_logs": f"{_RAW} select 'checkout' service, 'case-7' environment, service old_service, environment old_environment, count(*) n from r group by 3, 4",
    "rejected_lines": f"{_L} select path, sha256(line) line_sha256, 'sha256:' || substr(sha256(line), 1, 16) || ':' || string_split(path, '/')[-1] raw_ref, 'empty_line' reason, count(*) n from l where trim(line) = '' group by all",
    "line_accounting": f"{_PARSED}, o as (select *, trim(line) = '' bad, coalesce(ts, timestamp '2024-01-20' + to_days((event_id % 10)::int)) obs from p) select 'kept' undated, count(*) as input, count(*) filter (where not bad and (ts is null or {_IN})) accepted, count(*) filter (where bad) rejected, count(*) filter (where not bad and not ({_IN})) out_of_window from o union all select 'tested', count(*), count(*) filter (where not bad and {_IN.replace('ts ', 'obs ')}), count(*) filter (where bad), count(*) filter (where not bad and not ({_IN.replace('ts ', 'obs ')})) from o",
    "loaded_logs": f"{_PARSED}, s as (select * from p where ts >= timestamp '{INCIDENT[0]}' and ts < timestamp '{INCIDENT[1]}' order by ts, event_id limit 500) select service, count(*) n, min(ts) first_ts, max(ts) last_ts, count(*) filter (where message like '%@%') redacted from s group by 1",
    "input_profile": f"{_PARSED}, z as (select * from p where trim(line) <> ''), f as (select 'format' as kind, format as value from z union all select 'service', service from z union all select 'time_key', case k when 0 then 'timestamp' when 1 then 'ts' else '__REALTIME_TIMESTAMP' end from z where k in (0, 1, 2) union all select 'level_key', case k when 0 then 'level' else 'PRIORITY' end from z where k in (0, 2) union all select 'sensitive', 'yes' from z where k in (0, 4, 5)) select kind, value, count(*) n from f group by all",
    "system_type": f"{_PARSED}, z as (select * from p where trim(line) <> '') select (select format from z group by 1 order by count(*) desc, format limit 1) as format, 'systemd_service' system_type, 'unknown' profile_confidence",
}
