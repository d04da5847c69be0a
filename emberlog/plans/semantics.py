"""Queries over the meaning of events and evidence items of classified events. Twins are written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import documents as D
from emberlog.operators import packing as K
from emberlog.operators import semantics as S
from emberlog.operators import text as T

from .facts import LOGS, logs, stored

#: The test data's attributes, as an expression that both dialects read: not an operator.
ATTRIBUTES = """case event_id % 11 when 0 then '{"error_type":"Disk Full","http_status":"503"}' when 1 then '{"status_code":"404","reason":"not found"}' when 2 then '{"exception":{"exception_class":"java.io.IOError"}}' when 3 then '{"error_code":"E42"}'
 when 4 then '{"detail":{"deep":{"event_class":"none","grpc_status":"14"}}}' when 5 then '{"status":"ok","response_code":"200"}' when 6 then '{"category":"Billing Team","sqlstate":"40001"}' when 7 then '{"outcome":"dns failed nxdomain","ok":"false"}'
 when 8 then '{"error_type":"error","errno":"ok"}' else '{}' end"""
WINDOW = ("2024-01-22 00:00:00", "2024-01-24 12:00:00")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Classified events of the logs, stored once."""
    def build():
        e = logs(spark, d).withColumn("attributes", F.expr(ATTRIBUTES)).withColumn("severity", F.lower("severity"))
        e = e.withColumn("component", F.coalesce(F.get_json_object("labels", "$.component"), F.lit("unknown"))).withColumn("source_system", F.col("environment")).withColumn("inferred", F.expr("event_id % 50 = 0"))
        return S.classified(e)

    return stored(spark, d, "events", build)


COLUMNS = ["event_id", "event_name", "event_family", "protocol", "error_code", "exception_class", "classification_source", "confidence"]


def event_semantics(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(*COLUMNS, "template_fingerprint")


def profile_semantics(spark: SparkSession, d: str) -> DataFrame:
    """Events renamed by rules of profiles, of which one is not trusted and one is off."""
    rules = spark.createDataFrame([
        (1, True, "unapproved", "timeout", None, None, "never", "never"), (2, False, "human_approved", "rtmps", None, None, "never", "never"), (3, True, "human_approved", "rtmps", None, None, "stream_stalled", "streaming"),
        (4, True, "packaged_allowlist", None, "http", "dependency", "upstream_http", "dependency"), (5, True, "packaged_allowlist", "youtube", None, None, "live_check", "streaming"), (6, True, "human_approved", None, "sql", None, "sql_trouble", None),
    ], "place int, enabled boolean, trust string, term string, protocol string, family string, event_name string, event_family string")
    return S.overridden(events(spark, d), rules).select("event_id", "event_name", "event_family", "classification_source")


RULES = "place int, rule_id string, enabled boolean, trust string, equals map<string,array<string>>, contains_all array<string>, contains_any array<string>, event_name string, event_family string"


def profile_rules(spark: SparkSession, d: str) -> DataFrame:
    """Events by the rule of a profile that renames them: by values of fields, all of some terms, any of others."""
    rules = spark.createDataFrame([
        (1, "off", False, "human_approved", {}, ["rtmps"], None, "never", None), (2, "untrusted", True, "draft", {}, ["rtmps"], None, "never", None), (3, "empty", True, "human_approved", {}, None, None, "never", None), (4, "no-terms", True, "human_approved", {}, [], None, "never", None),
        (5, "slow-send", True, "human_approved", {"component": ["Unknown", "comp 1"]}, ["RTMPS", "send-path"], None, "slow_send", "streaming"), (6, "web", True, "packaged_allowlist", {"protocol": ["HTTP"], "event_family": ["dependency", "x"]}, None, None, "web_call", None),
        (7, "live", True, "packaged_allowlist", {}, None, ["watchdog", "ffmpeg"], "live_check", "streaming"), (8, "coded", True, "human_approved", {"error_code": ["E42", "404"]}, None, None, None, "coded"), (9, "lost", True, "human_approved", {"subsystem": [""]}, None, None, "never", None),
    ], RULES)
    return S.profile_matched(events(spark, d), rules).select("event_id", "profile_rule", "event_name", "event_family", "classification_source")


def flat_attributes(spark: SparkSession, d: str) -> DataFrame:
    return D.flattened(events(spark, d), "event_id", "attributes").groupBy("path", "name", "value").agg(F.count("*").alias("n"))


def enriched_messages(spark: SparkSession, d: str) -> DataFrame:
    """Generic messages with what their attributes say."""
    e = events(spark, d).withColumn("raw", F.expr("case event_id % 3 when 0 then 'event' when 1 then 'log status=kept' else message end"))
    e = e.withColumn("first", D.attribute_facts(F.col("attributes"))["first"])
    return e.select("event_id", S.enriched(F.col("raw"), F.col("service"), F.col("first")).alias("message"))


def semantic_identities(spark: SparkSession, d: str) -> DataFrame:
    """Family, name and template of events that lack some of these."""
    e = events(spark, d).selectExpr("*", "case when event_id % 4 = 0 then '' else event_name end as e_name", "case when event_id % 3 = 0 then '' else event_family end as e_family")
    name = F.coalesce(F.nullif(T.semantic_name(F.col("e_name")), F.lit("")), F.lit("event"))
    e = e.withColumn("i_name", name)
    fam = F.coalesce(F.nullif(T.semantic_name(F.col("e_family")), F.lit("")), S.family(F.lower(F.concat_ws(" ", "i_name", "protocol", "template")), F.col("i_name")))
    return e.groupBy(fam.alias("family"), F.col("i_name").alias("name"), "template_fingerprint").agg(F.count("*").alias("n"))


def _items(spark, d):
    return S.item_stats(S.in_closed_window(events(spark, d), *WINDOW))


def window_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of a closed window with and without those of inferred times."""
    e = events(spark, d)
    a, b = S.in_closed_window(e, *WINDOW), S.in_closed_window(e, *WINDOW, keep_inferred=False)
    both = a.withColumn("kept", F.lit("inferred")).unionByName(b.withColumn("kept", F.lit("tested")))
    return both.groupBy("kept").agg(F.count("*").alias("n"), F.count_if("inferred").alias("inferred"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def evidence_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Items by seven-part key with ordinal ids, the most frequent first, and their counts over all time."""
    e = events(spark, d)
    i = _items(spark, d)
    whole = e.groupBy(*S.ITEM_KEY).agg(F.count("*").alias("n_all"))
    order = [-F.col("n"), "event_name", "template", "component", "source_system", "severity", "error_code", "exception_class"]
    out = K.numbered(i.join(whole, list(S.ITEM_KEY)), *order)
    return out.select(F.concat(F.lit("PATTERN-"), F.lpad(F.col("place").cast("string"), 4, "0")).alias("evidence_id"), *S.ITEM_KEY, "n", "n_all", "first_seen", "last_seen", "example", "traces", "event_family")


def event_signals(spark: SparkSession, d: str) -> DataFrame:
    return S.signals(_items(spark, d)).select("event_name", "target", "n", "number", "items", "component", "confidence")


QUERIES = {f.__name__: f for f in (event_semantics, profile_semantics, profile_rules, flat_attributes, enriched_messages, semantic_identities, window_events, evidence_patterns, event_signals)}


# ---- twins

def _a(k: str) -> str:
    return f"coalesce(json_extract_string(attributes, '$.{k}'), json_extract_string(attributes, '$.exception.{k}'), json_extract_string(attributes, '$.detail.deep.{k}'), '')"


def _name(x: str) -> str:
    return rf"substr(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_'), 1, 120)"


_E = r"('', 'false', 'n/a', 'na', 'none', 'null', 'true', 'unknown')"


def _some(x: str) -> str:
    return f"case when {x} not in {_E} then {x} end"


def _neg(x: str, *ws: str) -> str:
    return "(" + " or ".join(rf"len(list_filter(string_split_regex({x}, '[.;!?]'), lambda s: regexp_matches(s, '\b{w}\b') and not regexp_matches(s, '\b(no|without)\b.{{0,90}}\b{w}\b') and not regexp_matches(s, '\b{w}\b.{{0,50}}\b(not observed|not present|absent)\b'))) > 0" for w in ws) + ")"


_FAM = "case {n} when 'auth_failure' then 'authentication' when 'connection_reset' then 'network' when 'dns_failure' then 'network' when 'http_5xx' then 'dependency' when 'oom' then 'resource' when 'permission_denied' then 'authentication' when 'service_start_failure' then 'runtime' when 'timeout' then 'dependency' when 'missing_command' then 'configuration' else case when regexp_matches({t}, 'tls|ssl|certificate|dns|socket|tcp|udp|network|connection_reset') then 'network' when regexp_matches({t}, 'sql|database|postgres|mysql|sqlite|redis') then 'datastore' when regexp_matches({t}, 'auth|credential|permission|forbidden|unauthorized') then 'authentication' when regexp_matches({t}, 'config|missing_file|missing_command|schema') then 'configuration' when regexp_matches({t}, 'memory|cpu|disk|quota|oom|resource') then 'resource' when regexp_matches({t}, 'process|restart|systemd|kubernetes|crashloop|service_start') then 'runtime' when regexp_matches({t}, 'monitor|metric|heartbeat|freshness|instrumentation|telemetry') then 'observability' when regexp_matches({t}, 'scheduler|scheduled|cron|job|queue') then 'scheduler' when regexp_matches({t}, 'timeout|deadline|unreachable|upstream|dependency|grpc|http_5xx') then 'dependency' else 'general' end end"
_EVENTS = f"""with {LOGS}, e0 as (select * replace (lower(severity) as severity), {ATTRIBUTES} attributes, coalesce(json_extract_string(labels, '$.component'), 'unknown') component, environment source_system, event_id % 50 = 0 inferred from logs),
e1 as (select *, coalesce({_some(_a('error_code'))}, {_some(_a('errno'))}, {_some(_a('sqlstate'))}, {_some(_a('grpc_status'))}, {_some(_a('response_code'))}, {_some(_a('status_code'))}, {_some(_a('http_status'))}, '') error_code,
 coalesce({_some(_name(_a('exception_class')))}, '') exception_class, coalesce({_some(_name(_a('error_type')))}, {_some(_name(_a('exception_class')))}, {_some(_name(_a('event_class')))}, '') explicit, {_name(_a('category'))} cat,
 lower(concat_ws(' ', message, {_some(_a('error_type'))}, {_some(_a('event_class'))}, {_some(_a('outcome'))}, {_some(_a('reason'))}, {_some(_a('status'))})) t, lower(message) m from e0),
e2 as (select *, case when regexp_matches(t, 'tls|ssl|x509|certificate') then 'tls' when t like '%grpc%' or contains(attributes, 'grpc_status') then 'grpc' when t like '%dns%' or t like '%nxdomain%' then 'dns' when contains(attributes, '"http_status"') or contains(attributes, '"status_code"') or regexp_matches(t, '\\bhttp(/\\d(\\.\\d)?)?\\b') then 'http'
 when contains(attributes, 'sqlstate') or regexp_matches(t, 'postgres|mysql|sqlite|sqlstate') then 'sql' when t like '%systemd%' or t like '%.service%' then 'systemd' when regexp_matches(t, 'kubernetes|k8s|pod|crashloop') then 'kubernetes' when regexp_matches(t, 'tcp|udp|socket|connection reset|connection refused') then 'network' else '' end protocol,
 case when regexp_matches(t, 'permission denied|operation not permitted|access denied') then 'permission_denied' when t like '%failed to start%' then 'service_start_failure' when regexp_matches(t, 'restart loop|crashloop') then 'restart_loop' when regexp_matches(t, 'process exited|exited with status|exit status') then 'process_exit' when t like '%connection reset%' then 'connection_reset'
 when m like '%http 5%' or contains(attributes, '"503"') then 'http_5xx' when {_neg('t', 'timed out', 'timeout', 'deadline exceeded')} then 'timeout' when t like '%dns%' and regexp_matches(t, 'failure|failed|nxdomain') then 'dns_failure' when regexp_matches(t, 'unauthorized|forbidden|authentication failed|authorization failed|invalid credentials') then 'auth_failure'
 when {_neg('t', 'out of memory', 'oom')} then 'oom' when severity in ('warn', 'warning') then 'warning' when severity in ('trace', 'debug', 'info', 'notice') then 'info' else 'unknown' end gen from e1),
e3 as (select *, explicit not in ('', 'error', 'event', 'exception', 'failure', 'info', 'log', 'message', 'none', 'unknown', 'warning') said, gen not in ('event', 'info', 'warning', 'unknown') strong, error_code <> '' and not case when try_cast(regexp_extract(error_code, '^\\D*(\\d{{1,3}})\\D*$', 1) as int) is null then lower(error_code) in ('ok', 'success') else regexp_extract(error_code, '^\\D*(\\d{{1,3}})\\D*$', 1)::int = 0 or regexp_extract(error_code, '^\\D*(\\d{{1,3}})\\D*$', 1)::int between 100 and 399 end coded from e2),
e4 as (select *, case when said then explicit when exception_class <> '' then exception_class when strong then gen when coded then 'error_code_' || {_name('error_code')} else gen end event_name, case when said or exception_class <> '' then 'structured_field' when strong then case when protocol <> '' then 'generic_protocol' else 'generic_rule' end when coded then 'structured_field' else 'template_fingerprint' end classification_source,
 case when said then 0.98 when exception_class <> '' then 0.96 when strong or coded then 0.9 else 0.55 end::double confidence, 'tmpl-' || substr(sha256(template), 1, 16) template_fingerprint from e3),
e5 as (select *, lower(event_name || ' ' || protocol || ' ' || message) f from e4), ev as (select *, case when cat <> '' then cat else {_FAM.format(n='event_name', t='f')} end event_family from e5)"""
_INW = f"(ts between timestamp '{WINDOW[0]}' and timestamp '{WINDOW[1]}')"
_ITEMS = f"{_EVENTS}, i as (select event_name, severity, template, component, source_system, error_code, exception_class, count(*) n, min(ts) first_seen, max(ts) last_seen, first(message order by ts, event_id) example, count(distinct trace_id) traces, first(event_family order by ts, event_id) event_family from ev where {_INW} or inferred group by 1, 2, 3, 4, 5, 6, 7)"
_KEY = ", ".join(S.ITEM_KEY)
ORACLES = {
    "event_semantics": f"{_EVENTS} select {', '.join(COLUMNS)}, template_fingerprint from ev",
    "profile_semantics": f"{_EVENTS} select event_id, case when m like '%rtmps%' then 'stream_stalled' when protocol = 'http' and event_family = 'dependency' then 'upstream_http' when m like '%youtube%' then 'live_check' when protocol = 'sql' then 'sql_trouble' else event_name end event_name, case when m like '%rtmps%' then 'streaming' when protocol = 'http' and event_family = 'dependency' then 'dependency' when m like '%youtube%' then 'streaming' else event_family end event_family, case when m like '%rtmps%' or (protocol = 'http' and event_family = 'dependency') or m like '%youtube%' or protocol = 'sql' then 'profile_rule' else classification_source end classification_source from ev",
    "profile_rules": f"""{_EVENTS}, pr as (select *, lower(concat_ws(' ', template, message, event_name, component, environment)) z from ev), ps as (select *, case when component in ('unknown', 'comp-1') and contains(z, 'rtmps') and contains(z, 'send-path') then 'slow-send' when protocol = 'http' and event_family = 'dependency' then 'web' when contains(z, 'watchdog') or contains(z, 'ffmpeg') then 'live' when error_code in ('E42', '404') then 'coded' end as r from pr)
select event_id, r as profile_rule, case r when 'slow-send' then 'slow_send' when 'web' then 'web_call' when 'live' then 'live_check' else event_name end event_name, case when r in ('slow-send', 'live') then 'streaming' when r = 'coded' then 'coded' else event_family end event_family, case when r is not null then 'profile_rule' else classification_source end classification_source from ps""",
    "flat_attributes": f"{_EVENTS}, x as (select t.path || '.' || t.key as p, t.key as name, json_extract_string(t.atom, '$') as value from ev, json_tree(ev.attributes) t where t.type not in ('OBJECT', 'ARRAY')) select substr(replace(replace(p, '$.', ''), '\"', ''), 1) as path, name, value, count(*) n from x group by all",
    "enriched_messages": f"{_EVENTS}, r as (select *, case event_id % 3 when 0 then 'event' when 1 then 'log status=kept' else message end raw from ev) select event_id, case when event_id % 3 = 2 then raw else trim(concat_ws(' ', raw, 'service=' || service, case when {_a('event_class')} not in ('', 'none') then 'event_class=' || {_a('event_class')} end, case when event_id % 3 = 0 and {_a('status')} <> '' then 'status=' || {_a('status')} end, 'outcome=' || nullif({_a('outcome')}, ''), 'reason=' || nullif({_a('reason')}, ''), 'error_type=' || nullif({_a('error_type')}, ''), 'ok=' || nullif({_a('ok')}, ''))) end message from r",
    "semantic_identities": f"{_EVENTS}, x as (select *, case when event_id % 4 = 0 then 'event' else event_name end nm, case when event_id % 3 = 0 then '' else event_family end fm from ev), y as (select *, lower(nm || ' ' || protocol || ' ' || template) g from x) select case when fm <> '' then fm else {_FAM.format(n='nm', t='g')} end as family, nm as name, template_fingerprint, count(*) n from y group by all",
    "window_events": f"{_EVENTS} select 'inferred' kept, count(*) n, count(*) filter (where inferred) inferred, min(ts) first_ts, max(ts) last_ts from ev where {_INW} or inferred union all select 'tested', count(*), count(*) filter (where inferred), min(ts), max(ts) from ev where {_INW}",
    "evidence_patterns": f"{_ITEMS}, w as (select {_KEY}, count(*) n_all from ev group by all) select 'PATTERN-' || lpad((row_number() over (order by n desc, event_name, template, component, source_system, severity, error_code, exception_class))::varchar, 4, '0') evidence_id, {_KEY}, n, n_all, first_seen, last_seen, example, traces, event_family from i join w using ({_KEY})",
    "event_signals": f"{_ITEMS}, j as (select *, case event_name when 'permission_denied' then 'state_mismatch' when 'service_start_failure' then 'service_start_failure' when 'restart_loop' then 'restart_loop' when 'timeout' then 'external_dependency_failure' when 'connection_reset' then 'network_error_signal' when 'dns_failure' then 'network_error_signal' when 'auth_failure' then 'external_dependency_failure' when 'http_5xx' then 'user_impact_signal_gap' when 'oom' then 'resource_pressure' else 'general' end target, case severity when 'trace' then 1 when 'debug' then 5 when 'info' then 9 when 'notice' then 10 when 'warn' then 13 when 'warning' then 13 when 'error' then 17 when 'critical' then 21 when 'alert' then 22 when 'emergency' then 23 else 0 end num from i), c as (select event_name, component, count(*) k from j group by 1, 2 qualify row_number() over (partition by event_name order by k desc, component) = 1) select event_name, target, sum(n)::bigint n, max(num) as number, count(*) as items, any_value(c.component) component, case when event_name in ('unknown', 'info') then 0.35 else round(least(case when max(num) >= 17 then 0.8 else 0.65 end + case when sum(n) >= 5 then 0.1 else 0 end, 0.95), 2) end::double confidence from j join c using (event_name) group by event_name, target",
}
