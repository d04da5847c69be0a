"""The fact table of logs over the driver's events, and the same written by hand as SQL for the twins."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import documents as D
from emberlog.operators import text as T
from emberlog.storage import delete, exists, shared_folder

INCIDENT = ("2024-01-22 00:00:00", "2024-01-29 00:00:00")
BASELINE = ("2024-01-15 00:00:00", "2024-01-22 00:00:00")

#: The test data's raw logs, as an expression of the events that both dialects read: not an operator.
SEVERITY = """case when event_type = 'error' and value >= 30 then 'EMERGENCY' when event_type = 'error' and value >= 25 then 'ALERT' when event_type = 'error' and value >= 20 then 'CRITICAL'
 when event_type = 'error' then 'ERROR' when event_type = 'purchase' and value >= 15 then 'WARN' when event_type = 'purchase' and value >= 10 then 'warning'
 when event_type = 'click' and value >= 15 then 'NOTICE' when event_type = 'view' then 'DEBUG' when event_id % 97 = 0 then 'TRACE' else 'INFO' end"""
MESSAGE = """case event_id % 26
 when 0 then concat('GET /items/', user_id % 7, ' 5xx from upstream after ', cast(floor(value) as bigint) * 100, ' ms user_id=ab', user_id, '99')
 when 1 then concat('dependency timeout after 3000 ms for order_id: ', event_id + 1000)
 when 2 then concat('database timed out on shard ', user_id % 7, ', token=abcdefghij', event_id)
 when 3 then concat('connection pool exhausted: too many connections from 10.0.', user_id % 256, '.', event_id % 256)
 when 4 then concat('can''t open file /home/joe/jobs/run', user_id % 7, '.py for the job')
 when 5 then concat('failed to start worker', user_id % 7, '.service on host')
 when 6 then concat('rtmps reconnect to rtmps://a.example.com/live2/key', event_id, '  send-path slow')
 when 7 then concat('youtube watchdog watch url check live ingest ', user_id % 7)
 when 8 then concat('healthy=false judgment=failed failure_kind=stall after ', user_id % 7)
 when 9 then concat('failure_kind=none active stream ok ', user_id % 7)
 when 10 then concat('login unauthorized for mail.user', user_id, '@example.com')
 when 11 then concat('worker restart number ', user_id % 7, ' after oom 0x00ff', 1000 + user_id % 7, 'ab')
 when 12 then concat('deploy rollout v', user_id % 7, ' announced Authorization: Bearer abc.def', event_id, '==')
 when 13 then concat('ffmpeg process exit rc=', user_id % 7, ' track finished')
 when 14 then concat('audio_energy silence for ', cast(floor(value) as bigint), ' s')
 when 15 then concat('chromium renderer capture freshness ', user_id % 7)
 when 16 then concat('connection reset by peer notsent ', event_id)
 when 17 then concat('stream_service_substate running watchdog_ok systemd checkpoint ', user_id % 7)
 when 18 then concat('Traceback in handler stack 123e4567-e89b-12d3-a456-4266141740', 10 + user_id % 80)
 when 19 then concat('set-cookie: session=abc', event_id, ', path ok')
 when 20 then concat('page ', user_id % 11, ' served')
 when 21 then concat('opened C:', chr(92), 'Users', chr(92), 'joe', chr(92), 'app', chr(92), 'log', user_id % 7, '.txt now')
 when 22 then concat('jwt eyJhbGciOi.eyJzdWIi', user_id % 7, '.abc-def and sk-proj', event_id, 'abcdefghij')
 when 23 then concat('metric sample mbps=', cast(floor(value) as bigint), ' fail_count=', user_id % 7, ' status=ok')
 when 24 then concat('no error and no timeout observed on route ', user_id % 7, '. all http 500 absent')
 else concat('request latency p95 of route ', user_id % 7, ' is ', cast(floor(value) as bigint) * 10, ' ms') end"""
LABELS = """case event_id % 6
 when 0 then concat('{"component":"comp-', user_id % 4, '","host":"host-1"}')
 when 1 then concat('{"kind":"kind-', user_id % 3, '","node":"node-2"}')
 when 2 then concat('{"metric_name":"', case user_id % 3 when 0 then 'fail_count' when 1 then 'stream_active' else 'mbps' end, '","metric_value":"', cast(floor(value) as bigint) % 3, '"}')
 when 3 then concat('{"labels":{"metric_name":"ingest_connected","metric_value":"', user_id % 2, '","source_name":"src-', user_id % 3, '"}}')
 when 4 then '{"event_type":"custom","status":"failed"}'
 else concat('{"owner":{"mail":"joe', user_id % 3, '@example.com"},"hosts":["10.1.2.', user_id % 3, '","plain"],"n":1.50}') end"""
RAW = f"""select event_id, date_trunc('second', ts) as ts, concat('svc-', user_id % 5) as service, case when event_id % 10 < 8 then 'prod' else 'stage' end as environment,
 {SEVERITY} as severity, user_id, concat('trace-', user_id) as trace_id, case when event_type = 'signup' then concat('deploy-', user_id % 7) end as deploy_id,
 case event_id % 4 when 0 then 'systemd' when 1 then '' else 'pod' end as resource_type, event_type, value, {MESSAGE} as raw_message, {LABELS} as labels from EVENTS where event_id is not null"""

#: Rows of a task that has much to do for each row, about.
TASK_ROWS = 50_000
_stored: dict[tuple[str, str], str] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """What tells one state of an input folder from another: its entries with their lengths and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    entries = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    listed = sorted((e.getPath().getName(), e.getLen(), e.getModificationTime()) for e in entries)
    return hashlib.sha256(f"{sf_dir}{listed}".encode()).hexdigest()[:16]


def clear(spark: SparkSession) -> None:
    """Delete all stored tables of this application; they are built again when they are asked for."""
    delete(spark, f"{shared_folder(spark)}/facts")
    for key in [k for k in _stored if k[0] == spark.sparkContext.applicationId]:
        del _stored[key]


def stored(spark: SparkSession, sf_dir: str, name: str, build, partition: str | None = None) -> DataFrame:
    """A table that queries share: built once for each application and state of the input, and read from there on."""
    key = spark.sparkContext.applicationId, f"{name}-{_state(spark, sf_dir)}"
    if key not in _stored or not exists(spark, f"{_stored[key]}/_SUCCESS"):
        path = f"{shared_folder(spark)}/facts/{key[1]}"
        rows = build()
        rows = rows.hint("rebalance", partition).write.partitionBy(partition) if partition else rows.hint("rebalance").write
        rows.mode("overwrite").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows of a table in tasks of about TASK_ROWS: a scan has a task for each of a file's row groups at most, which is one for
    a million rows, and all that is done with a row would be done there."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_ROWS))
    return rows.repartition(n, key)


def classified(raw: DataFrame) -> DataFrame:
    """The sanitized log of each raw one: message and labels without secrets, template, error type, severity's rank, stack
    hash."""
    clean = raw.withColumns({"message": T.sanitize(F.col("raw_message")), "labels": D.sanitized_json(F.col("labels"))}).drop("raw_message")
    return clean.withColumns({
        "log_id": F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 16), "severity_rank": T.severity_rank(F.col("severity")), "template": T.template(F.col("message")),
        "error_type": T.error_type(F.col("message"), F.col("severity")), "stack_hash": T.stack_hash(F.col("message")),
    })


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, event_id, ts (whole seconds), service, environment, severity, severity_rank, trace_id, deploy_id,
    resource_type, event_type, value, labels (JSON), message (redacted), template, error_type, stack_hash, user_id, day.

    Logs are sanitized once and stored by day, as a fact table is: queries read the columns and days that they need."""

    def build():
        dealt(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id").createOrReplaceTempView("__emberlog_events")
        rows = classified(spark.sql(RAW.replace("EVENTS", "__emberlog_events")))
        return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))

    return stored(spark, sf_dir, "logs", build, "day")


# ---- the same for the twins, by hand: nothing below is made from the rules of operators/text.py

_SQL_MESSAGE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_message,
 $$(?i)\bauthorization\s*[:=]\s*(bearer|basic)\s+[a-z0-9._~+/\-]+=*$$, '<AUTH_HEADER>', 'g'),
 $$(?i)\b(set-)?cookie\s*[:=]\s*[^,\n]+$$, '<COOKIE>', 'g'),
 $$\beyJ[-\w]+\.[-\w]+\.[-\w]+\b$$, '<JWT>', 'g'),
 $$(?i)(rtmps://[^ \n]+/live2/)[-\w]+$$, '\1<STREAM_KEY>', 'g'),
 $$(?i)\b(api_key|api-key|apikey|token|secret|password)\s*[:=]\s*['"]?[\w.:/=+\-]{10,}['"]?$$, '<SECRET>', 'g'),
 $$(?i)\b(sk-proj|sk|ghp|github_pat|xox[bpar])[\w.:/=+\-]{10,}\b$$, '<SECRET>', 'g'),
 $$(?i)/(home|users)/([^/\s:'"]+/+)*([^/\s:'"]+)$$, '<LOCAL_PATH>/\3', 'g'),
 $$(?i)[a-z]:\\users\\([^\\\s:'"]+\\)*([^\\\s:'"]+)$$, '<LOCAL_PATH>/\2', 'g'),
 $$(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b$$, '<EMAIL>', 'g'),
 $$\b((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)\b$$, '<IP>', 'g'),
 $$(?i)\b((user|order|customer|account)_id)\s*[:=]\s*[-\w]{4,}$$, '\1=<ID>', 'g'),
 $$(?i)\b[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\b$$, '<UUID>', 'g'),
 $$\s+$$, ' ', 'g'))"""


def sql_template(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, $$(?i)\b0x[0-9a-f]{{6,}}\b$$, '<HEX>', 'g'),
 $$(?i)\b[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}\b$$, '<UUID>', 'g'), $$\b\d{{4,}}\b$$, '<NUM>', 'g'), $$\b\d+\b$$, '<N>', 'g'), $$\s+$$, ' ', 'g'))"""


_SQL_ERROR = r"""case
 when regexp_matches(m, 'can.t open file|no such file or directory') and regexp_matches(m, 'systemd|execstart|[.]service|[.]py|[.]sh') then 'job_configuration_mismatch'
 when m like '%failed to start%' and m like '%.service%' then 'service_start_failure'
 when m like '%connection pool%' or m like '%too many connections%' then 'connection_pool_exhausted'
 when m like '%database%' and (m like '%timeout%' or m like '%timed out%') then 'database_timeout'
 when m like '%deadline exceeded%' or m like '%timeout%' or m like '%timed out%' then 'dependency_timeout'
 when m like '%rtmps%' or m like '%ffmpeg tcp send sample%' or contains(m, 'ingest_connected=false') then 'stream_transport'
 when m like '%youtube%' and (m like '%watchdog%' or m like '%api%' or m like '%live%') then 'youtube_health'
 when m like '%healthy=false%' or m like '%judgment=failed%' or len(list_filter(regexp_extract_all(m, $$\bfailure_kind=([^\s,;]+)$$, 1), lambda x: not regexp_matches(x, $$^(none|null|false|0)\b$$))) > 0 then 'service_health_failure'
 when m like '%5xx%' or ' ' || m || ' ' like '% 500 %' or m like '%http 500%' then 'http_5xx'
 when m like '%unauthorized%' or m like '%permission denied%' or m like '%authentication failed%' or m like '%authorization failed%' or contains(m, 'auth_failure') then 'auth_failure'
 when m like '%restart%' or m like '%crashloop%' or m like '%oom%' then 'runtime_restart'
 when m like '%deploy%' or m like '%rollout%' then 'deployment_event'
 when upper(severity) in ('ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY') then 'application_error' else 'none' end"""
SQL_RANK = "case upper(severity) when 'EMERGENCY' then 70 when 'ALERT' then 60 when 'CRITICAL' then 50 when 'ERROR' then 40 when 'WARN' then 30 when 'WARNING' then 30 when 'NOTICE' then 25 when 'INFO' then 20 when 'DEBUG' then 10 else 0 end"
LOGS = f"""
l0 as ({RAW.replace("EVENTS", "events")}),
l1 as (select * exclude (raw_message, ts) replace (case when event_id % 6 = 5 then '{{"owner":{{"mail":"<EMAIL>"}},"hosts":["<IP>","plain"],"n":1.5}}' else labels end as labels), ts::timestamp as ts, {_SQL_MESSAGE} as message, {SQL_RANK} as severity_rank, substr(sha256(event_id::varchar), 1, 16) as log_id from l0),
l2 as (select *, lower(message) as m, {sql_template('message')} as template from l1),
logs as (select * exclude (m), {_SQL_ERROR} as error_type,
 case when m like '%traceback%' or ' ' || m || ' ' like '% stack %' then substr(sha256({sql_template('m')}), 1, 16) else '' end as stack_hash, ts::date as day from l2)"""
cur, base = (f"ts >= timestamp '{a}' and ts < timestamp '{b}'" for a, b in (INCIDENT, BASELINE))
