"""Nested documents, redaction by position, mentions and profile rules on small cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from emberlog.operators import documents as D
from emberlog.operators import semantics as S
from emberlog.operators import text as T


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()[:12]


@pytest.mark.parametrize("text,clean,counts", [
    ("user_id=abc then user_id=abcd", f"user_id=<ID_HASH:{h('abc')}> then user_id=<ID_HASH:{h('abcd')}>", {"id_like": 2}),
    ("v1.2.3.4 from 1.2.3.4", f"v1.2.3.4 from <IP_HASH:{h('1.2.3.4')}>", {"ip_address": 1}),
    ("order_id='12 34'", f"order_id=<ID_HASH:{h('12 34')}>", {"id_like": 1}),
    ("key AIza" + "x" * 20, "key <REDACTED_SECRET>", {"cloud_credential": 1, "secret_like": 1}), ("ya29.a-b/c", "<REDACTED_SECRET>", {"cloud_credential": 1, "token_like": 1}),
    ("-----BEGIN PRIVATE KEY-----abc-----END PRIVATE KEY-----", "<REDACTED_SECRET>", {"secret_like": 1}), ("id_token=zz", "<REDACTED_SECRET>", {"secret_like": 1, "token_like": 1}), ("x-api-key: zzz", "<REDACTED_SECRET>", {"secret_like": 1}),
    ("gmail_token=a pubsub-token=b", "<REDACTED_SECRET> <REDACTED_SECRET>", {"secret_like": 2, "token_like": 2, "gmail_credential": 1, "pubsub_credential": 1}), ("google_application_credentials: /x", "<REDACTED_SECRET>", {"secret_like": 1, "cloud_credential": 1}),
    ("http://172.16.3.4/x", f"<URL_HASH:{h('http://172.16.3.4/x')}>", {"internal_url": 1}), ("http://172.32.3.4/x", f"http://<IP_HASH:{h('172.32.3.4')}>/x", {"ip_address": 1}), ("http://metadata.google.internal/y", f"<URL_HASH:{h('http://metadata.google.internal/y')}>", {"internal_url": 1}),
    ("Authorization: Basic abcdef==", "<REDACTED_SECRET>", {"authorization_header": 1, "token_like": 1, "basic_auth": 1}), ("then Bearer abcdefgh", "then <REDACTED_SECRET>", {"token_like": 1}), ("say Basic abcdefgh", "say <REDACTED_SECRET>", {"basic_auth": 1, "token_like": 1}),
    ("Set-Cookie: a=b; c=d x", "<REDACTED_SECRET> x", {"cookie": 1, "secret_like": 1}), ("sk-live-" + "a" * 12, "<REDACTED_SECRET>", {"secret_like": 1}), ("eyJa.b.c", "<REDACTED_SECRET>", {"token_like": 1, "secret_like": 1}),
    (r"C:\Users\joe\x and /home/joe/y", r"<USER_HOME>\x and <USER_HOME>/y", {"user_home": 2}), ("Joe@Example.com", f"<EMAIL_HASH:{h('joe@example.com')}>", {"email": 1}), ("  plain \n text ", "plain text", {}), (None, "", {}), ("", "", {}),
])
def test_redaction_by_position(text, clean, counts):
    assert D.redacted_text(text) == (clean, counts)


def test_redacted_columns(spark):
    rows = [("a user_id=abc",), (None,), ("a user_id=abc",), ("x" * 500_000 + " 1.2.3.4",)]
    got = [(r.r.text, r.r.counts) for r in spark.createDataFrame(rows, "t string").select(D.redacted(F.col("t")).alias("r")).collect()]
    assert got[0] == got[2] == (f"a user_id=<ID_HASH:{h('abc')}>", {"id_like": 1}) and got[1] == ("", {}) and got[3][1] == {"ip_address": 1}


@pytest.mark.parametrize("text,want", [
    ('{"a":{"b":[{"c":"mail joe@example.com"},["10.0.0.1"]]},"n":2}', '{"a":{"b":[{"c":"mail <EMAIL>"},["<IP>"]]},"n":2}'), ('{ "kept" : "as it is" }', '{ "kept" : "as it is" }'), ('"password=abcdefghijk"', '"<SECRET>"'),
    ("no json, token=abcdefghijk", "no json, <SECRET>"), ('{"cookie":"a=b, c"}', '{"cookie":"a=b, c"}'), ('{"x":"cookie: a=b, c"}', '{"x":"<COOKIE>, c"}'), ("{}", "{}"), ("", ""), (None, None), ('{"é":"user_id=abcd"}', '{"é":"user_id=<ID>"}'),
])
def test_labels_without_secrets(text, want):
    assert D._sanitized_json(text) == want


def facts(spark, *texts):
    return [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(D.attribute_facts(F.col("t")).alias("f")).collect()]


def test_attributes_are_those_of_the_object(spark):
    nested = json.dumps({"status": "ok", "list": [{"status": "500"}], "inner": {"status": "503", "Error-Type": 'x"y'}, "none": None, "flag": True, "status_code": "id 7 is 200"})
    deep = '{"a":{"b":{"c":{"d":{"error_code":"E1","e":{"error_code":"E2"}}}}}}'
    a, b, c, d, e, f = facts(spark, nested, deep, '{"status":"a","status":"b"}', "[1]", None, '{"error_type":"none","exception_type":"My.Err","errno":"ok","error_code":" bad  code!"}')
    assert a.first["status"] == "ok" and a.first["error_type"] == 'x"y' and a.server_error and "none" not in a.first and a.first["flag"] == "true" and a.explicit == "x_y" and a.said == 'ok 503 x"y'
    assert b.code == "E1" and c.first == {"status": "b"} and d.first == e.first == {} and not d.server_error
    assert f.explicit == f.thrown == "my_err" and f.code == "bad_code"


def test_flattened_paths(spark):
    df = spark.createDataFrame([(1, '{"a":{"B-c":"x","n":1.50,"t":true,"z":null,"l":[1]}}'), (2, "broken"), (3, None)], "k int, j string")
    assert sorted(tuple(r) for r in D.flattened(df, "k", "j").collect()) == [(1, "a.b_c", "b_c", "x"), (1, "a.n", "n", "1.50"), (1, "a.t", "t", "true")]


@pytest.mark.parametrize("text,want", [
    ("timeout occurred with no timeout configured", True), ("no timeout", False), ("there was no sign of a timeout", False), ("no error. timeout", True), ("without any timeout; timeouts", False), ("timeout was not observed", False), ("timeout, then absent", False),
    ("Timeout and later, after a long while of many words that go on and on, absent", True), ("no " + "x" * 95 + " timeout", True), ("timed out", True), ("", False), ("now timeout", True),
])
def test_mentions_that_are_not_denied(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.not_negated(F.col("t"), ("timed out", "timeout")).alias("x")).first().x is want


def test_classified_reads_nested_status(spark):
    rows = [(1, "request", "info", '{"status":"ok","inner":{"status":"503"}}', "t"), (2, "request", "warn", '{"a":"\\"status\\":\\"503\\""}', "t"), (3, "timeout with no timeout set", "info", None, "t")]
    got = {r.event_id: (r.event_name, r.protocol) for r in S.classified(spark.createDataFrame(rows, "event_id int, message string, severity string, attributes string, template string")).collect()}
    assert got == {1: ("http_5xx", ""), 2: ("warning", ""), 3: ("timeout", "")}


def test_first_profile_rule_wins(spark):
    e = spark.createDataFrame([(1, "A rtmps b", "http", "dependency", "n", "s"), (2, "c", "sql", "x", "n", "s"), (3, "d", "", "x", "n", "s")], "event_id int, message string, protocol string, event_family string, event_name string, classification_source string")
    rules = spark.createDataFrame([(2, True, "human_approved", None, "http", None, "second", "f2"), (1, True, "human_approved", "rtmps", None, None, "first", None), (0, True, "unapproved", None, None, None, "never", "never"), (3, True, "packaged_allowlist", None, "sql", "x", "third", "f3")], "place int, enabled boolean, trust string, term string, protocol string, family string, event_name string, event_family string")
    got = {r.event_id: (r.event_name, r.event_family, r.classification_source) for r in S.overridden(e, rules).collect()}
    assert got == {1: ("first", "dependency", "profile_rule"), 2: ("third", "f3", "profile_rule"), 3: ("n", "x", "s")}
    assert S.overridden(e, rules.limit(0)).count() == 3
