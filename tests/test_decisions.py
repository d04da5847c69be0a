"""Observations and classes of targets, open proposals, the ledger of outputs, packing and numbering."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.operators import arbitration as A
from emberlog.operators import ledger as L
from emberlog.operators import observations as O
from emberlog.operators import packing as K
from emberlog.storage import shared_folder


def of(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,quiet,bad", [
    ("No issue", True, False), ("n/a", True, False), ("No findings.", True, False), ("none of them", False, False), ("", False, False), (None, False, False), ("timeout", False, True), ("no failure evidence", True, False), ("no failure evidence, a failure", True, True),
    ("missing evidence", False, False), ("missing logs", False, True), ("normal operation rather than an incident", True, False), ("it was not observed", True, False),
])
def test_phrases_are_taken_out_before_problems_are_looked_for(spark, text, quiet, bad):
    assert of(spark, O.no_issue(F.col("t")), t=text) is quiet and of(spark, O.problem(F.col("t")), t=text) is bad


@pytest.mark.parametrize("issue,context,types,want", [
    ("No issue", "", ["support"], True), ("A spike", "currently stable", ["support"], False), ("A spike", "currently stable", ["caveat", "No_Finding "], True), ("Flat", "currently stable", ["support"], True),
    ("Flat", "", ["no_finding"], False), ("Flat", "", [], False), (None, None, [], False),
])
def test_normal_observations(spark, issue, context, types, want):
    assert of(spark, O.normal_observation(F.col("i"), F.col("c"), F.col("t")), i=issue, c=context, t=types) is want


@pytest.mark.parametrize("refs,families,sources,words,kind", [(3, 2, 2, "", "primary_candidate"), (2, 2, 2, "", "validation_target"), (3, 1, 2, "", "validation_target"), (3, 2, 1, "", "validation_target"), (4, 2, 1, "", "primary_candidate"), (9, 9, 9, "Evidence is thin", "validation_target")])
def test_thin_candidates_are_validated(spark, refs, families, sources, words, kind):
    c = O.public_class(F.lit("primary_candidate"), F.lit("x"), F.lit(""), F.array().cast("array<string>"), F.col("w"), F.col("r"), F.col("f"), F.col("s"))
    assert of(spark, c, w=words, r=refs, f=families, s=sources).final_class == kind
    other = O.public_class(F.lit("context"), F.lit("x"), F.lit(""), F.array().cast("array<string>"), F.col("w"), F.col("r"), F.col("f"), F.col("s"))
    assert of(spark, other, w=words, r=refs, f=families, s=sources).final_class == "context"


def test_open_proposals_follow_the_latest_review(spark):
    p = spark.createDataFrame([("a", "pending", "review"), ("b", "pending", "review"), ("c", "archived", "review"), ("d", "pending", "hidden"), ("e", "done", "review")], "k string, review_status string, visibility string")
    r = spark.createDataFrame([("a", "accepted", 1), ("a", "needs_more_data", 2), ("b", "rejected", 1), ("c", "pending", 1)], "k string, status string, at int")
    got = lambda h: sorted(tuple(x) for x in O.open_proposals(p, r, ["k"], F.desc("at"), include_hidden=h).select("k", "status").collect())
    assert got(False) == [("a", "needs_more_data"), ("c", "pending")] and got(True) == [*got(False), ("d", "pending")]


RECORD = "record_id long, provider string, contract string, version string, status string, schema_valid boolean, payload string, at long"


def record(i, status="ok", valid=True, payload="x", version=L.SCHEMA_VERSION, contract="c"):
    return (i, "p", contract, version, status, valid, payload, i)


def test_ledger_is_written_once_and_compacted(spark):
    import uuid

    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    df = lambda *ids: spark.createDataFrame([record(i) for i in ids], RECORD)
    ids = lambda: sorted(r.record_id for r in L.read(spark, path, RECORD).collect())
    assert ids() == []
    L.append(df(1, 2), 0, path)
    L.append(df(3), 1, path)
    L.append(df(3), 1, path)  # a replay
    assert ids() == [1, 2, 3]
    L.compact(spark, path, RECORD)
    assert ids() == [1, 2, 3] and L._entries(spark, path) == {"batch": [], "upto": [1]}
    L.append(df(3), 1, path)  # a replay of what is compacted
    L.append(df(4), 2, path)
    assert ids() == [1, 2, 3, 4]
    L.compact(spark, path, RECORD)
    L.compact(spark, path, RECORD)
    assert ids() == [1, 2, 3, 4]


def test_ledger_as_a_streaming_sink(spark, tmp_path):
    import uuid

    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    for k in range(3):
        spark.createDataFrame([record(10 * k + i) for i in range(4)], RECORD).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        s = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        s.writeStream.foreachBatch(L.sink(path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.record_id for r in L.read(spark, path, RECORD).collect()) == [10 * k + i for k in range(3) for i in range(4)]


def test_reusable_outputs(spark):
    rows = [record(1), record(2, "failed"), record(3, contract="f", status="failed"), record(4, contract="f", status="error"), record(5, contract="v", version="old"), record(6, contract="e", payload=""), record(7, contract="s", valid=None), record(8, contract="n", status="")]
    wanted = spark.createDataFrame([("p", c) for c in "cfvesnx"], "provider string, contract string")
    got = {h: {r.contract: (r.record_id, r.reused) for r in L.reusable(spark.createDataFrame(rows, RECORD), wanted, h).collect()} for h in (False, True)}
    assert got[False] == {"c": (1, "success")} | {c: (None, "none") for c in "fvesnx"}
    assert got[True] == got[False] | {"f": (4, "failed"), "s": (7, "failed")}


def fold(rows, budget, most=None):
    out, now = {}, {}
    for b, k, t in sorted(rows):
        chunk, held, n = now.get(b, (1, 0, 0))
        if n and (held + t > budget or (most and n >= most[b])):
            chunk, held, n = chunk + 1, 0, 0
        now[b] = (chunk, held + t, n + 1)
        out[b, k] = chunk
    return out


@pytest.mark.parametrize("budget", [1, 7, 50, 10_000])
def test_packing_by_doubling_is_the_fold(spark, budget):
    random.seed(budget)
    rows = [(random.choice("aaab"), k, random.choice((0, 0, 1, 3, 9, 60))) for k in range(200)]
    df = spark.createDataFrame(rows, "b string, k int, t int").repartition(5)
    got = {(r.b, r.k): r.chunk for r in K.pack_by_budget(df, "b", ["k"], "t", budget).collect()}
    assert got == fold(rows, budget)
    assert K.pack_by_budget(df.limit(0), "b", ["k"], "t", budget).count() == 0


def test_failed_chunks_are_split(spark):
    rows = [("a", k, 10) for k in range(9)] + [("b", 0, 500)] + [("c", 0, 5), ("c", 1, 5)]
    df = spark.createDataFrame(rows, "b string, k int, t int")
    most = defaultdict(int, {"a": 5, "b": 1, "c": 1})
    for floor, budget in ((8_000, 8_000), (20, 50)):
        got = {(r.b, r.k): r.part for r in K.split_failed(df, "b", ["k"], "t", 100, floor).collect()}
        assert got == fold(rows, budget, most)


def test_numbers_over_all_rows(spark):
    df = spark.range(500).withColumn("v", F.xxhash64("id")).repartition(7)
    rows = K.numbered(df, "v").collect()
    assert [r.place for r in sorted(rows, key=lambda r: r.v)] == list(range(1, 501))


@pytest.mark.parametrize("path,want", [
    ("/opt/a.sh:", "/opt/a.sh"), (" /opt//a/./b/ ", "/opt/a/b"), ("/opt", "/opt"), ("/optional/a", None), ("/opt/../etc", None), ("opt/a", None), ("/etc/passwd", None), ("/usr/lib/systemd/x.service", "/usr/lib/systemd/x.service"), ("", None), (None, None), ("/run/a..b", "/run/a..b"),
])
def test_paths_that_may_be_read(spark, path, want):
    assert of(spark, A.collected_path(F.col("p")), p=path) == want


def test_collector_targets(spark):
    rows = [
        ("r1", "installed_artifact", "no such file: /opt/gone.sh\nother /opt/there.sh of a.service", '{"labels":{"systemd_unit":"b.timer"}}'), ("r1", "installed_artifact", "only /opt/more.sh", "[1]"), ("r2", "installed_artifact", "only /srv/x", None),
        ("r3", "process_state", "missing /opt/m and\n /opt/n", '{"systemd_unit":"bad unit"}'), ("r4", "process_state", None, '{"systemd_unit":7}'),
    ]
    got = {tuple(r) for r in A.collector_targets(spark.createDataFrame(rows, "request_id string, request_type string, text string, labels string")).collect()}
    assert got == {("r1", "unit", "a.service"), ("r1", "unit", "b.timer"), ("r1", "path", "/opt/gone.sh"), ("r2", "path", "/srv/x"), ("r3", "path", "/opt/m"), ("r3", "path", "/opt/n")}


def test_last_before_is_the_pairs_best(spark):
    random.seed(21)
    left = [(random.choice("ab"), k, random.randrange(4_000)) for k in range(60)]
    right = [(random.choice("abc"), k, random.randrange(4_000)) for k in range(80)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"g string, {name} int, t long").select("g", name, F.timestamp_seconds("t").alias("ts"))
    got = {(r.g, r.r): (r.n, r.l, r.gap_s) for r in K.last_before(frame(left, "l"), frame(right, "r"), "g", "l", "r", "ts", 300).collect()}
    want = {}
    for g, r, t in right:
        near = [(u, k) for h, k, u in left if h == g and 0 <= t - u <= 300]
        if near:
            want[g, r] = (len(near), max(near)[1], t - max(near)[0])
    assert got == want and want
