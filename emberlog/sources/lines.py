"""Log lines of eleven formats as one table of events, and the accounting of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.semantics import SEVERITY_NUMBERS, looked_up
from emberlog.operators.text import any_of, key_values, severity_of_event, severity_of_text, tolerant_timestamp, with_context

#: Directories, names and suffixes of files that hold no lines (fixed values).
SKIP_DIRS = (".git", ".hg", ".svn", ".venv", "venv", "__pycache__", ".pytest_cache", "chromium_profile")
SKIP_NAMES, SKIP_SUFFIXES = ("LOCK", "CURRENT"), (".aac", ".avi", ".bin", ".db", ".flac", ".gif", ".jpeg", ".jpg", ".mp3", ".mp4", ".png", ".sqlite", ".wav", ".zip")
#: Keys of an event's parts, the first that says something counts (fixed values).
TIME_KEYS = ("timestamp", "time", "ts", "datetime", "created_at", "observed_timestamp", "ts_utc", "checked_ts_utc", "@timestamp", "__REALTIME_TIMESTAMP")
LEVEL_KEYS = ("severity", "level", "log_level", "priority", "PRIORITY")
SERVICE_KEYS = ("service", "app", "application", "stream_service", "job", "unit", "_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER", "kubernetes.container_name", "container_name")
COMPONENT_KEYS = ("component", "subsystem", "module", "logger", "kind", "resource_type", "_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER", "kubernetes.container_name")
ENVIRONMENT_KEYS = ("environment", "env", "namespace", "mode", "kubernetes.namespace_name")
HOST_KEYS = ("host", "hostname", "_HOSTNAME", "node", "kubernetes.host")
MESSAGE_KEYS = ("message", "msg", "text", "event", "log", "MESSAGE", "@message", "message_sanitized", "message_template")
JOURNALD = ("__REALTIME_TIMESTAMP", "_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER", "PRIORITY", "MESSAGE")
PRIORITIES = {"0": "emergency", "1": "alert", "2": "critical", "3": "error", "4": "warning", "5": "notice", "6": "info", "7": "debug"}
KUBERNETES = r"^(\d{4}-\d{2}-\d{2}T[0-2]\d:[0-5]\d:[0-5]\d(?:\.\d+)?Z)\s+(stdout|stderr)\s+([FP])\s+(.*)$"
ACCESS = r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)(?:\s+HTTP/[^"]+)?"\s+(\d{3})\s+(\S+)'
SYSLOG = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([A-Za-z0-9_.@/\-]+)(?:\[(\d+)\])?:\s+(.*)$"
PYTHON = r'(?i)Traceback \(most recent call last\)|File "[^"]+", line \d+|^[A-Za-z_][\w.]*Error:'
JAVA = r"\b(?:Exception|Error):|^\s*at\s+[a-zA-Z_$][\w.$]*\([^)]*\)"
KEY_VALUE = r"""\b([A-Za-z_][A-Za-z0-9_.\-]*)=('[^']*'|"[^"]*"|[^\s,;]+)"""
KEY_COLON = r"\b([A-Za-z_][A-Za-z0-9_.\-]*)\s*:\s*([^\s,;]+)"
TIME_PREFIX = r"^\[?(\d{4}-\d{2}-\d{2}[T ][0-2]\d:[0-5]\d:[0-5]\d(?:[.,]\d+)?)\]?\s*"
ANY_TIME = r"\b(\d{4}-\d{2}-\d{2}[T ][0-2]\d:[0-5]\d:[0-5]\d)(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"
LEVEL = r"(?i)\b(DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|ALERT|EMERGENCY|FATAL)\b"


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """line, path of every line that is not blank under path, recursively, but for files that hold no lines. Bytes that
    are no UTF-8 become replacement characters."""
    reader = spark.read.option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    df = df.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    return wanted_files(df).where("trim(line) <> ''")


def wanted_files(lines: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIP_DIRS))) | name.isin(*SKIP_NAMES) | name.startswith("MANIFEST-") | F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in SKIP_SUFFIXES) + ")$")
    return lines.where(~skipped)


def prune_by_path_date(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Lines of files whose path holds no date, or dates of which one is before the end and one after the start."""
    days = F.transform(F.regexp_extract_all("path", F.lit(r"(?<!\d)(20\d{2}[-_]?[01]\d[-_]?[0-3]\d)(?!\d)"), F.lit(1)), lambda x: F.try_to_date(F.regexp_replace(x, "[-_]", ""), "yyyyMMdd"))
    days = F.array_compact(days)
    return lines.where((F.size(days) == 0) | ((F.array_max(days) >= F.lit(start).cast("date")) & (F.array_min(days) <= F.lit(end).cast("date"))))


def detected_format(line: Column, payload: Column) -> Column:
    """One of eleven formats, by the first rule that holds; payload: the line as a JSON object, null if it is none."""
    t = F.trim(line)
    journal = F.exists(F.map_keys(payload), lambda k: k.isin(*JOURNALD))
    pairs = F.size(F.regexp_extract_all(t, F.lit(KEY_VALUE), F.lit(0)))
    return (
        F.when(t == "", "plain_text").when(payload.isNotNull(), F.when(journal, "journald_json").otherwise("jsonl")).when(t.rlike(KUBERNETES), "kubernetes_container_log")
        .when(t.rlike(ACCESS), F.when(any_of(t, ("rt=", "upstream", "request_time")), "nginx_access").otherwise("apache_access")).when(t.rlike(PYTHON), "python_traceback").when(t.rlike(JAVA), "java_stacktrace").when(t.rlike(SYSLOG), "syslog")
        .when(pairs >= 2, "logfmt").when((pairs == 1) | t.rlike(KEY_COLON), "key_value").otherwise("plain_text")
    )


def json_object(line: Column) -> Column:
    """The fields of a line that is a JSON object, as texts; null for any other line."""
    return F.when(F.trim(line).rlike(r"(?s)^\{.*\}$"), F.from_json(line, "map<string,string>", {"mode": "PERMISSIVE"}))


def quoted_pairs(line: Column) -> Column:
    """key=value pairs of a line, of repeated keys the last; quotes around a value go, and a quoted value may hold spaces."""
    strip = lambda x: F.regexp_replace(x, r"""^["']+|["']+$""", "")
    every = lambda k: F.regexp_extract_all(line, F.lit(r"""(?:^|\s)([A-Za-z_][A-Za-z0-9_.\-]*)=("[^"]*"|'[^']*'|\S*)"""), F.lit(k))
    pairs = F.arrays_zip(every(1).alias("k"), F.transform(every(2), strip).alias("v"))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


def _first(source: Column, keys: Sequence[str]) -> Column:
    def one(k):
        if "." not in k:
            return F.nullif(F.try_element_at(source, F.lit(k)), F.lit(""))
        head, tail = k.split(".", 1)
        return F.nullif(F.get_json_object(F.try_element_at(source, F.lit(head)), f"$.{tail}"), F.lit(""))

    return F.coalesce(*[one(k) for k in keys])


def normal_severity(col: Column) -> Column:
    t = F.lower(F.trim(col))
    return F.when(t.isin("warn", "warning"), "warning").when(t.isin(*SEVERITY_NUMBERS), t).when(t.isin(*PRIORITIES), looked_up(PRIORITIES, t, "info")).otherwise("info")


def severity_of_line(message: Column) -> Column:
    t, level = F.lower(message), F.regexp_extract(message, LEVEL, 1)
    return (
        F.when(level != "", normal_severity(level)).when(any_of(t, ("critical", "fatal", "panic", "emergency")), "critical").when(any_of(t, ("error", "failed", "failure", "denied", "unauthorized", "exception", "traceback")), "error")
        .when(any_of(t, ("warn", "degraded", "retry")), "warning").otherwise("info")
    )


def any_timestamp(text: Column) -> Column:
    """Epoch seconds, milliseconds or nanoseconds by magnitude, or ISO text with a comma or point, in whole seconds."""
    n = text.try_cast("double")
    scaled = F.when(n > 1e15, n / 1e9).when(n > 1e12, n / 1e3).otherwise(n)
    return F.date_trunc("SECOND", F.coalesce(F.when(n.isNotNull(), F.timestamp_seconds(scaled)), F.try_to_timestamp(F.replace(F.trim(text), F.lit(","), F.lit(".")))))


def parse_lines(lines: DataFrame, year: int | Column = 2024) -> DataFrame:
    """lines with format, ts, inferred (no time was found), severity, severity_number, service, component, environment,
    host, message and attributes. year: of syslog lines, a number or a column such as that of their file's time. Blank
    lines have format plain_text and an empty message."""
    t = F.trim("line")
    df = lines.withColumn("v", json_object(F.col("line"))).withColumn("format", detected_format(F.col("line"), F.col("v"))).withColumn("kv", quoted_pairs(t))
    by, v, kv = F.col("format"), F.col("v"), F.col("kv")
    x = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    js, k8s, web, sys_, pair = by.isin("jsonl", "journald_json"), by == "kubernetes_container_log", by.isin("nginx_access", "apache_access"), by == "syslog", by.isin("logfmt", "key_value")
    micro = F.timestamp_seconds(F.try_element_at(v, F.lit("__REALTIME_TIMESTAMP")).try_cast("long") / 1e6)
    status = x(ACCESS, 6).try_cast("int")
    prefix = x(TIME_PREFIX, 1)
    syslog_at = F.try_to_timestamp(F.concat_ws(" ", (year if isinstance(year, Column) else F.lit(year)).cast("string"), x(SYSLOG, 1), x(SYSLOG, 2), x(SYSLOG, 3)), F.lit("yyyy MMM d HH:mm:ss"))
    ts = (
        F.when(js, F.coalesce(micro, any_timestamp(_first(v, TIME_KEYS)))).when(k8s, F.try_to_timestamp(x(KUBERNETES, 1))).when(web, F.try_to_timestamp(x(ACCESS, 3), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))).when(sys_, syslog_at)
        .when(pair, any_timestamp(_first(kv, TIME_KEYS))).otherwise(any_timestamp(F.coalesce(prefix, x(ANY_TIME, 1))))
    )
    kind = F.coalesce(_first(v, ("kind", "event_type", "event_id")), F.lit("event"))
    context = [F.when(F.coalesce(_first(v, (k,)), F.lit("")) != "", F.concat(F.lit(f"{k}="), _first(v, (k,)))) for k in ("status", "healthy", "failure_kind", "reason", "action", "http_status", "status_code")]
    message = (
        F.when(js, F.coalesce(_first(v, MESSAGE_KEYS), F.concat_ws(" ", kind, *context))).when(k8s, F.coalesce(x(KUBERNETES, 4), F.lit(""))).when(web, F.concat(x(ACCESS, 4), F.lit(" "), x(ACCESS, 5), F.lit(" -> HTTP "), x(ACCESS, 6))).when(sys_, F.coalesce(x(SYSLOG, 7), F.lit("")))
        .when(pair, F.coalesce(_first(kv, ("message", "msg", "event")), t)).otherwise(F.trim(F.regexp_replace(t, TIME_PREFIX, "")))
    )
    df = df.withColumn("message", message).withColumn("ts", F.date_trunc("SECOND", ts))
    of_text = severity_of_line(F.col("message"))
    state = F.lower(F.coalesce(_first(v, ("status",)), F.lit("")))
    flag = F.array_contains(F.array(*[F.coalesce(_first(v, (k,)), F.lit("")) for k in ("healthy", "ok", "success")]), "false")
    of_json = F.when(_first(v, LEVEL_KEYS).isNotNull(), normal_severity(_first(v, LEVEL_KEYS))).when(state == "critical", "critical").when(state.isin("error", "failed", "fail", "unhealthy", "fatal"), "error").when(state.isin("warn", "warning", "degraded"), "warning").when(flag, "error").otherwise(of_text)
    of_web = F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")
    severity = F.when(js, of_json).when(web, of_web).when(pair & _first(kv, LEVEL_KEYS).isNotNull(), normal_severity(_first(kv, LEVEL_KEYS))).otherwise(of_text)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    plain = ~(js | k8s | web | sys_ | pair)
    unit = F.nullif(F.regexp_extract("message", r"\b([A-Za-z0-9_.@\-]+\.service)\b", 1), F.lit(""))
    service = F.coalesce(F.when(js, _first(v, SERVICE_KEYS)).when(sys_, x(SYSLOG, 5)).when(pair, _first(kv, SERVICE_KEYS)).when(plain, F.coalesce(_first(kv, SERVICE_KEYS), unit)), stem)
    component = F.coalesce(F.when(js, _first(v, COMPONENT_KEYS)).when(k8s, x(KUBERNETES, 2)).when(web, F.lit("http_access")).when(sys_, x(SYSLOG, 5)).otherwise(_first(kv, COMPONENT_KEYS)), F.lit("unknown"))
    environment = F.coalesce(F.when(js, _first(v, ENVIRONMENT_KEYS)).when(pair | plain, _first(kv, ENVIRONMENT_KEYS)), F.lit("unknown"))
    host = F.coalesce(F.when(js, _first(v, HOST_KEYS)).when(sys_, x(SYSLOG, 4)).when(pair | plain, _first(kv, HOST_KEYS)), F.lit(""))
    part = lambda **c: F.map_filter(F.create_map(*[y for k, z in c.items() for y in (F.lit(k), z)]), lambda _, z: z.isNotNull())
    attributes = (
        F.when(js, F.map_filter(v, lambda k, _: ~k.isin(*MESSAGE_KEYS))).when(k8s, part(stream=x(KUBERNETES, 2), tag=x(KUBERNETES, 3))).when(sys_, part(program=x(SYSLOG, 5), pid=x(SYSLOG, 6)))
        .when(web, part(client_ip=x(ACCESS, 1), user=x(ACCESS, 2), http_method=x(ACCESS, 4), path=x(ACCESS, 5), status_code=x(ACCESS, 6), response_size=x(ACCESS, 7))).otherwise(kv)
    )
    df = df.withColumns({"severity": severity, "service": service, "component": component, "environment": environment, "host": host, "attributes": attributes, "inferred": F.col("ts").isNull()})
    df = df.withColumn("severity_number", looked_up(SEVERITY_NUMBERS, F.col("severity"), 0))
    return df.select(*lines.columns, "format", "ts", "inferred", "severity", "severity_number", "service", "component", "environment", "host", "message", "attributes")


# ---- the first ingest: JSON objects and text lines as raw logs

RAW_TIME = ("timestamp", "ts_utc", "time", "ts", "datetime", "created_at", "checked_ts_utc")
RAW_SERVICE = ("service", "stream_service", "component", "subsystem", "job", "repo", "app", "name")
RAW_ENVIRONMENT = ("environment", "env", "mode", "namespace")
RAW_OTHERS = (*RAW_TIME, *RAW_SERVICE, *RAW_ENVIRONMENT, "severity", "level", "log_level", "message", "msg", "text", "event")


def raw_logs(lines: DataFrame) -> DataFrame:
    """Each line that is not blank as a raw log: JSON objects by their fields, any other line as text. labels holds what
    is left, with the path and, of texts, how they were parsed. Lines without a time have ts null."""
    df = lines.where("trim(line) <> ''").withColumn("v", json_object(F.col("line")))
    v, t = F.col("v"), F.trim("line")
    js = v.isNotNull()
    get = lambda k: F.try_element_at(v, F.lit(k))
    stem, suffix = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), F.regexp_extract("path", r"\.([^./]*)$", 1)
    in_metric = lambda keys: F.coalesce(*[F.nullif(F.get_json_object(get("metric"), f"$.{k}"), F.lit("")) for k in keys])
    prefix = r"^\[?(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})(?:[,.]\d+)?\]?\s*"
    level = r"\[(DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|ALERT|EMERGENCY)\]"
    body = F.trim(F.regexp_replace(t, prefix, ""))
    said = F.nullif(F.regexp_extract(body, level, 1), F.lit(""))
    words = F.trim(F.regexp_replace(body, r"^(.*?)" + level, "$1"))
    bracket = F.nullif(F.trim(F.regexp_extract(words, r"^\[([^\]]+)\]", 1)), F.lit(""))
    at = tolerant_timestamp(_first(v, RAW_TIME))
    message = with_context(F.coalesce(_first(v, ("message", "msg", "text", "event")), _first(v, ("kind", "event_id")), F.lit("event")), get)
    place = F.when(F.contains("path", F.lit("stream_v3")) | F.contains("path", F.lit("stream-v3")), "stream_v3").otherwise("prod")
    labels = F.when(js, F.map_concat(F.map_filter(v, lambda k, x: ~k.isin(*RAW_OTHERS) & x.isNotNull()), F.create_map(F.lit("source_path"), F.col("path")))).otherwise(F.create_map(F.lit("source_path"), F.col("path"), F.lit("parse_mode"), F.lit("text")))
    one = lambda *keys: F.coalesce(_first(v, keys), F.lit(""))
    return df.select(
        *lines.columns, F.date_trunc("SECOND", F.when(js, at).otherwise(F.try_to_timestamp(F.replace(F.nullif(F.regexp_extract(t, prefix, 1), F.lit("")), F.lit("T"), F.lit(" "))))).alias("ts"),
        F.when(js, F.coalesce(_first(v, RAW_SERVICE), in_metric(RAW_SERVICE), stem)).otherwise(F.coalesce(bracket, stem)).alias("service"), F.when(js, F.coalesce(_first(v, RAW_ENVIRONMENT), in_metric(RAW_ENVIRONMENT), place)).otherwise(place).alias("environment"),
        F.when(js, severity_of_event(get)).otherwise(F.coalesce(said, severity_of_text(words))).alias("severity"), F.when(js, message).otherwise(words).alias("message"), one("trace_id", "event_id").alias("trace_id"), one("span_id").alias("span_id"), one("deploy_id", "revision").alias("deploy_id"),
        one("version", "release").alias("version"), F.when(js, F.coalesce(_first(v, ("resource_type", "kind")), suffix)).otherwise(F.when(suffix == "", "text").otherwise(suffix)).alias("resource_type"), labels.alias("labels"),
    )


def with_case(raw: DataFrame, service: str = "", environment: str = "") -> DataFrame:
    """Raw logs of one case: its service and environment, what they were before in the labels."""
    for name, value in (("service", service.strip()), ("environment", environment.strip())):
        if value:
            key = F.lit(f"original_{name}")
            changed = (F.col(name) != value) & ~F.map_contains_key("labels", f"original_{name}")
            raw = raw.withColumn("labels", F.when(changed, F.map_concat("labels", F.create_map(key, F.col(name)))).otherwise(F.col("labels"))).withColumn(name, F.lit(value))
    return raw


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Blank lines with the hash and the reason; the line itself is not kept."""
    digest = F.sha2("line", 256)
    name = F.element_at(F.split("path", "/"), -1)
    return lines.where("trim(line) = ''").select("path", digest.alias("line_sha256"), F.concat_ws(":", F.lit("sha256"), F.substring(digest, 1, 16), name).alias("raw_ref"), F.lit("empty_line").alias("reason"))


def line_accounting(parsed: DataFrame, start: str, end: str, keep_inferred: bool = True) -> DataFrame:
    """One row: input, accepted, rejected (blank) and out-of-window lines, which add up; lines without a time are in the
    closed window, or where keep_inferred is off tested by their observed time (column observed)."""
    at = F.col("ts") if keep_inferred else F.coalesce("ts", "observed")
    out = at.isNotNull() & ~at.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    bad = F.trim("line") == ""
    return parsed.agg(F.count("*").alias("input"), F.count_if(~bad & ~out).alias("accepted"), F.count_if(bad).alias("rejected"), F.count_if(~bad & out).alias("out_of_window"))


def input_profile(lines: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    """What an input is: one row for each kind of finding and value, with its count: formats, keys of times and
    severities, candidates for services, and lines with sensitive text (patterns)."""
    p = parse_lines(lines).where("trim(line) <> ''").withColumn("v", json_object(F.col("line")))
    has = lambda k: F.coalesce(F.try_element_at("v", F.lit(k)), F.lit("")) != ""
    hit = F.lit(False)
    for s in sensitive:
        hit = hit | F.col("line").rlike(s)
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    found = F.array(
        pair("format", F.col("format")), pair("service", F.col("service")), *[F.when(has(k), pair("time_key", F.lit(k))) for k in TIME_KEYS], *[F.when(has(k), pair("level_key", F.lit(k))) for k in LEVEL_KEYS], F.when(hit, pair("sensitive", F.lit("yes")))
    )
    return p.select(F.explode(F.array_compact(found)).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def system_type(profile: DataFrame) -> DataFrame:
    """One row: the dominant format, and what kind of system the formats and services suggest."""
    top = profile.where("kind = 'format'").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("format"))
    words = profile.where("kind in ('format', 'service')").agg(F.array_join(F.sort_array(F.collect_set(F.lower("value"))), " ").alias("t"))  # names of formats and services
    t, f = F.col("t"), F.col("format")
    kind = (
        F.when(any_of(t, ("systemd", ".service")) | (f == "journald_json"), "systemd_service").when(any_of(t, ("cron", "timer", "scheduled", "airflow", "dag", "job")), "scheduled_job").when(f.isin("nginx_access", "apache_access") | any_of(t, ("http", "api", "request", "5xx")), "web_api")
        .when(any_of(t, ("batch", "worker", "queue")), "batch_job").when(any_of(t, ("stream", "ffmpeg", "kafka", "pubsub", "consumer")), "streaming_runtime").when(any_of(t, ("postgres", "mysql", "sqlite", "database", "db")), "database_service").otherwise("generic")
    )
    confidence = F.when(f.isin("journald_json", "nginx_access", "apache_access", "kubernetes_container_log"), "inferred").otherwise("unknown")
    return top.crossJoin(words).select("format", kind.alias("system_type"), confidence.alias("profile_confidence"))  # one row each
