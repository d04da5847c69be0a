"""Text operators on columns: redaction, templating, classification by ordered rules, lenient parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity ladder (fixed values).
SEVERITY_RANKS = {"EMERGENCY": 70, "ALERT": 60, "CRITICAL": 50, "ERROR": 40, "WARN": 30, "WARNING": 30, "NOTICE": 25, "INFO": 20, "DEBUG": 10}
#: Redaction rules in the order in which they apply (fixed values).
REDACTIONS = (
    (r"(?i)\bauthorization\s*[:=]\s*(?:bearer|basic)\s+[A-Za-z0-9._~+/\-]+=*", "<AUTH_HEADER>"),
    (r"(?i)\b(?:set-cookie|cookie)\s*[:=]\s*[^,\n]+", "<COOKIE>"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "<JWT>"),
    (r"(?i)(rtmps://[^ \n]+/live2/)[A-Za-z0-9_-]+", "$1<STREAM_KEY>"),
    (r"""(?i)\b(api[_-]?key|token|secret|password)\s*[:=]\s*['"]?[A-Za-z0-9_.:/=+\-]{10,}['"]?""", "<SECRET>"),
    (r"(?i)\b(?:sk-proj|sk|ghp|github_pat|xoxb|xoxp|xoxa|xoxr)[A-Za-z0-9_.:/=+\-]{10,}\b", "<SECRET>"),
    (r"""(?i)/(?:home|Users)/(?:[^/\s:'"]+/+)*([^/\s:'"]+)""", "<LOCAL_PATH>/$1"),
    (r"""(?i)[A-Z]:\\Users\\(?:[^\\\s:'"]+\\)*([^\\\s:'"]+)""", "<LOCAL_PATH>/$1"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "<EMAIL>"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", "<IP>"),
    (r"(?i)\b(user_id|order_id|customer_id|account_id)\s*[:=]\s*[A-Za-z0-9_-]{4,}", "$1=<ID>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\s+", " "),
)
#: White space that is not single spaces.
_SPACES = ("  ", "\t", "\n", "\x0b", "\f", "\r")
#: What a text must hold for the redaction at the same place to change it: one of these terms, in lower case.
REDACTION_MARKS = (
    ("authorization",), ("cookie",), ("eyj",), ("rtmps://",), ("key", "token", "secret", "password"), ("sk", "ghp", "github_pat", "xox"), ("/home/", "/users/"), (":\\users\\",), ("@",), (".",), ("_id",), ("-",), _SPACES,
)
TEMPLATES = (
    (r"(?i)\b0x[0-9a-f]{6,}\b", "<HEX>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b\d{4,}\b", "<NUM>"),
    (r"\b\d+\b", "<N>"),
    (r"\s+", " "),
)
TEMPLATE_MARKS = (("0x",), ("-",), (), (), _SPACES)
#: What hints at a boundary of states in an error type or a template (fixed values).
STATE_TERMS = ("checkpoint", "frontier", "state_transition", "deployment", "deploy", "runtime_restart", "service_start", "watchdog", "systemd")
#: Attributes of an event that are appended to its message (fixed values).
CONTEXT_KEYS = ("kind", "status", "healthy", "failure_kind", "failure_subkind", "incident_stage", "incident_reason", "judgment", "judgment_reason", "action", "mbps", "notsent", "unacked", "lastsnd_ms", "stream_active", "ingest_connected", "api_cost_projected_units_per_day", "query")


def chain(col: Column, rules: Sequence[tuple[str, str]], marks: Sequence[Sequence[str]]) -> Column:
    """The text with all rules applied one after the other. A rule is tried only on a text that holds one of its marks as it
    comes, for most texts meet few rules; a rule without marks always is. No replacement may give a later rule its mark.

    Arrays of one bind the text in lower case and that of each step, so that each is built once."""

    def step(pattern: str, to: str, terms: Sequence[str], low: Column):
        new = lambda x: F.regexp_replace(x, pattern, to)
        return (lambda x: F.when(any_of(low, terms), new(x)).otherwise(x)) if terms else new

    def applied(low: Column) -> Column:
        texts = F.array(col)
        for (pattern, to), terms in zip(rules, marks, strict=True):
            texts = F.transform(texts, step(pattern, to, terms, low))
        return texts[0]

    return F.transform(F.array(F.lower(col)), applied)[0]


def sanitize(col: Column) -> Column:
    """Secrets and personal data become placeholders, user paths keep their last name; white space becomes one space."""
    return F.trim(chain(col, REDACTIONS, REDACTION_MARKS))


def template(col: Column) -> Column:
    """The message with its numbers replaced: rows of one template are one pattern."""
    return F.trim(chain(col, TEMPLATES, TEMPLATE_MARKS))


def any_of(col: Column, terms: Sequence[str]) -> Column:
    """Whether one of the terms occurs in the column: plain text, no wildcards."""
    out = F.contains(col, F.lit(terms[0]))
    for t in terms[1:]:
        out = out | F.contains(col, F.lit(t))
    return out


def first_case(rules: Sequence[tuple[str, Column]], default: Column) -> Column:
    """The name of the first rule that holds."""
    out = default
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def failure_kind(text: Column) -> Column:
    """Whether a failure kind other than none, null, false or 0 is named."""
    return F.contains(F.lower(text), F.lit("failure_kind=")) & text.rlike(r"(?i)\bfailure_kind=(?!none\b|null\b|false\b|0\b)[^\s,;]+")


def error_type(message: Column, severity: Column) -> Column:
    """The first of twelve rules that holds for the message; else by severity."""
    t = F.lower(message)
    has = lambda *terms: any_of(t, terms)
    rules = [
        ("job_configuration_mismatch", has("can't open file", "no such file or directory") & has("systemd", "execstart", ".service", ".py", ".sh")),
        ("service_start_failure", has("failed to start") & has(".service")),
        ("connection_pool_exhausted", has("connection pool", "too many connections")),
        ("database_timeout", has("database") & has("timeout", "timed out")),
        ("dependency_timeout", has("deadline exceeded", "timeout", "timed out")),
        ("stream_transport", has("rtmps", "ffmpeg tcp send sample", "ingest_connected=false")),
        ("youtube_health", has("youtube") & has("watchdog", "api", "live")),
        ("service_health_failure", has("healthy=false", "judgment=failed") | failure_kind(t)),
        ("http_5xx", has("5xx", "http 500") | F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(" 500 "))),
        ("auth_failure", has("unauthorized", "permission denied", "authentication failed", "authorization failed", "auth_failure")),
        ("runtime_restart", has("restart", "crashloop", "oom")),
        ("deployment_event", has("deploy", "rollout")),
        ("application_error", F.upper(severity).isin("ERROR", "CRITICAL", "ALERT", "EMERGENCY")),
    ]
    return first_case(rules, F.lit("none"))


def severity_rank(col: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_RANKS.items():
        out = F.when(F.upper(col) == name, F.lit(rank)).otherwise(out)
    return out


def severity_label(rank: Column) -> Column:
    """The highest step of the ladder that the rank reaches; INFO below all."""
    out = F.lit("INFO")
    for name, least in (("DEBUG", 10), ("INFO", 20), ("NOTICE", 25), ("WARN", 30), ("ERROR", 40), ("CRITICAL", 50), ("ALERT", 60), ("EMERGENCY", 70)):
        out = F.when(rank >= least, F.lit(name)).otherwise(out)
    return out


def severity_of_text(message: Column) -> Column:
    """The severity that words of a message suggest."""
    t = F.lower(message)
    rules = [("CRITICAL", any_of(t, ("critical", "fatal", "panic", "crash"))), ("ERROR", any_of(t, ("error", "failed", "failure", "exception", "traceback"))), ("WARN", any_of(t, ("warn", "degraded", "restart", "recover", "timeout")))]
    return first_case(rules, F.lit("INFO"))


def severity_of_event(get) -> Column:
    """The severity of an event whose attributes get(key) gives as text: explicit, by status, flags, kind of failure,
    judgment, kind."""
    said = F.upper(F.coalesce(*[F.nullif(get(k), F.lit("")) for k in ("severity", "level", "log_level")]))
    low = lambda k: F.lower(F.coalesce(get(k), F.lit("")))
    kind = F.lower(F.coalesce(F.nullif(get("kind"), F.lit("")), F.nullif(get("event"), F.lit("")), F.lit("")))
    rules = [
        ("CRITICAL", low("status").isin("critical", "fatal", "emergency")), ("ERROR", low("status").isin("error", "failed", "fail", "unhealthy")), ("WARN", low("status").isin("warn", "warning", "degraded")),
        ("ERROR", (get("healthy") == "false") | (get("ok") == "false") | (get("success") == "false")), ("ERROR", ~low("failure_kind").isin("", "none")),
        ("WARN", low("judgment").isin("warn", "warning", "degraded")), ("ERROR", low("judgment").isin("error", "failed", "unhealthy")),
        ("ERROR", any_of(kind, ("error", "fail", "panic", "crash"))), ("WARN", any_of(kind, ("restart", "recover", "degraded", "backpressure"))),
    ]
    return F.coalesce(said, first_case(rules, F.lit("INFO")))


def with_context(message: Column, get) -> Column:
    """The message and key=value of each context attribute that the event has."""
    parts = [F.when(F.coalesce(get(k), F.lit("")) != "", F.concat(F.lit(f"{k}="), get(k))) for k in CONTEXT_KEYS]
    return F.concat_ws(" ", message, *parts)


def truncated(col: Column, size: int) -> Column:
    """At most size characters of the text with single spaces, and a note of how many were cut."""
    t = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("...[truncated "), (F.length(t) - size).cast("string"), F.lit(" chars]"))).otherwise(t)


def stack_hash(col: Column) -> Column:
    """16 hexadecimal digits of the template's hash, if the message has marks of a stack; else empty."""
    t = F.lower(col)
    marks = any_of(t, ("traceback", "\n at ")) | F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(" stack "))
    return F.when(marks, F.substring(F.sha2(template(t), 256), 1, 16)).otherwise(F.lit(""))


def stable_id(prefix: str, *parts: Column, size: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size))


def key_values(col: Column) -> Column:
    """map of the key=value pairs of a message; the last value of a key wins."""
    keys = F.regexp_extract_all(col, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)=(\S+)"), F.lit(1))
    values = F.regexp_extract_all(col, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)=(\S+)"), F.lit(2))
    return F.aggregate(F.arrays_zip(keys.alias("k"), values.alias("v")), F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


def tolerant_timestamp(col: Column) -> Column:
    """ISO text, or epoch seconds, milliseconds, microseconds or nanoseconds by magnitude; null if neither."""
    n = col.try_cast("double")
    scaled = F.when(n > 1e17, n / 1e9).when(n > 1e14, n / 1e6).when(n > 1e11, n / 1e3).otherwise(n)
    return F.coalesce(F.when(n.isNotNull(), F.timestamp_seconds(scaled)), F.try_to_timestamp(col))


def tokens(col: Column, stop: Sequence[str] = ("the", "and", "for", "with")) -> Column:
    """Sorted different words of three letters or digits at least, without stop words."""
    words = F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0))
    return F.sort_array(F.array_except(F.filter(words, lambda w: F.length(w) >= 3), F.array(*map(F.lit, stop))))


def scalar_kind(col: Column) -> Column:
    """What a text is as a scalar: bool, null, int, float or text."""
    t = F.lower(F.trim(col))
    return F.when(t.isin("true", "false"), "bool").when(t.isin("none", "null"), "null").when(F.trim(col).rlike(r"^[+-]?\d+$"), "int").when(F.trim(col).rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float").otherwise("text")


def coerced(col: Column) -> Column:
    """A text as the scalar that it is: struct of its kind, the flag of a bool, the number of an int or float, and the text of
    all else."""
    kind, t = scalar_kind(col), F.trim(col)
    return F.struct(kind.alias("kind"), F.when(kind == "bool", F.lower(t) == "true").alias("flag"), F.when(kind.isin("int", "float"), t.try_cast("double")).alias("number"), F.when(kind == "text", t).alias("text"))


def not_negated(text: Column, terms: Sequence[str]) -> Column:
    """Whether a term is mentioned as a word without being denied: no "no" or "without" up to 90 characters before it in its
    sentence, and no "not observed", "not present" or "absent" up to 50 behind it. Every mention counts by itself."""
    any_term = "|".join(t.replace(".", r"\.") for t in terms)
    # the look behind is tried only where a term begins
    return F.lower(text).rlike(rf"\b(?=(?:{any_term})\b)(?<!\b(?:no|without)\b[^.;!?]{{0,90}})(?:{any_term})\b(?![^.;!?]{{0,50}}\b(?:not observed|not present|absent)\b)")


def semantic_name(col: Column) -> Column:
    """Lower case, other characters than letters and digits as one underscore, at most 120 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), 1, 120)


#: Subsystems by the first rule of which each group has a term in the text (fixed values).
SUBSYSTEMS = (
    ("youtube_health", ("youtube", "watch url", "stream_service_substate"), ("dead", "healthy", "watchdog_ok", "health")),
    ("rtmps_ffmpeg", ("ffmpeg", "rtmps", "stream-engine", "stream_transport", "send-path", "encoder", "exit code 1")),
    ("chromium_capture", ("chromium", "chrome", "renderer", "zygote", "gpu", "crashpad", "capture")),
    ("audio_energy", ("audio", "pulseaudio", "pulse", "dbus", "d-bus", "x11", "energy")),
    ("job_configuration", ("restart", "runtime_restart", "service_health_failure", "recovery", "systemd", "substate", "runtime", "fast recovery"), ("can't open file", "no such file or directory", "execstart", "configured command missing")),
    ("runtime_recovery", ("restart", "runtime_restart", "service_health_failure", "recovery", "systemd", "substate", "runtime", "fast recovery")),
    ("service_liveness", ("heartbeat", "liveness", "readiness", "ready", "watch renew", "watch_renew", "watchdog", "polling")),
    ("background_processing", ("background_processing", "background processing", "scheduled job", "queue processing", "worker loop")),
    ("traffic", ("throughput", "request_count", "request count", "notification_forward", "business-event", "output counter")),
    ("user_experience", ("latency", "p95", "p99", "user experience", "user_experience")),
    ("generic_runtime", ("application process", "worker", "generic_runtime", "runtime host")),
    ("network_transport", ("connection reset", "connection_reset", "network", "tcp", "peer", "notsent", "unacked", "packet")),
    ("database_connection_pool", ("connection pool", "connection_pool", "too many connections", "pool saturation")),
    ("database_timeout", ("database",), ("timeout",)),
    ("downstream_dependency", ("payment-gateway", "dependency_timeout", "downstream", "dependency")),
    ("deployment_regression", ("deploy", "release", "rollout", "deployment")),
    ("auth_config", ("auth", "permission", "authorization")),
    ("resource_pressure", ("cpu", "memory", "oom", "timeout", "load", "pressure", "peak", "resource")),
    ("observability_contract", ("healthy", "critical", "warn", "error_count", "total_log_count", "active_hour_count", "active_service_count", "adequacy", "metric", "prometheus", "alert", "observability")),
    ("job_configuration", ("can't open file", "no such file or directory", "execstart", "configured command missing")),
)


def subsystem(col: Column) -> Column:
    t = F.lower(F.coalesce(col, F.lit("")))
    rules = []
    for name, *groups in SUBSYSTEMS:
        holds = any_of(t, groups[0])
        for g in groups[1:]:
            holds = holds & any_of(t, g)
        rules.append((name, holds))
    return first_case(rules, F.lit("general"))
