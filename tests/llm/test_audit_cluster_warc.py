"""The filter audit, the clustering and the WARC archives against brute force and on odd inputs."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import clustering, warc
from emberlog.llm.clustering import cluster_vectors, clustering_digest
from emberlog.llm.common import shared_dir
from emberlog.llm.filter_audit import audit_orders, filter_audit, removal_polynomials
from emberlog.llm.warc import archive_records, chunked, page_records, read_warc, unchunked, whole_payload, with_originals, write_warc

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


# ---- filter audit


def brute_audit(rows, labels):
    """Every order applied to every document, step by step."""
    good, toxic = defaultdict(int), defaultdict(int)
    for d, q, t in labels:
        if d is not None:
            good[d], toxic[d] = good[d] or int(q == 1), toxic[d] or int(t == 1)
    own = []
    for d, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows),
        }
        own.append((source or "", fails, good[d] if d is not None else 0, toxic[d] if d is not None else 0))
    out = {}
    for part in {p for p, *_ in own}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            live = [x for x in own if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [x for x in live if x[1][f]]
                redundant = sum(x[1][f] for x in gone)
                live = [x for x in live if not x[1][f]]
                gone += hit
                once = sum(x[0] == part and x[1][f] and sum(x[1].values()) == 1 for x in own)
                out[part, order, step] = [len(live), len(hit), redundant, once, sum(x[2] for x in hit), sum(x[3] for x in hit)]
                shapley[f] += len(hit)
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def got_audit(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_brute_force(spark):
    random.seed(8)
    bag = ["alpha", "Beta", "GAMMA", "d#lta", "é", "中文", "$5", "x", "y", "z"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(random.choices(bag, k=random.choice((0, 5, 49, 50, 51, 200)))) for _ in range(40)] + [None, "", " \n", "A" * 300_000, "word " * 60_000]
    rows = [(random.choice((None, *range(60))), random.choice(texts), random.choice((None, "", "web", "code"))) for _ in range(150)]
    rows += rows[:5]
    labels = [(random.choice((None, *range(70))), random.choice((0, 1, None)), random.choice((0, 1, None))) for _ in range(80)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("words", "part", "fails", "first", "digest", "quality", "t", "total")})
    got = got_audit(filter_audit(docs, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(1))))
    assert got == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit(docs, labels).count() == 0
    one = got_audit(filter_audit(spark.createDataFrame([(1, None, None)], DOCS), labels))
    assert len(one) == 600 and one["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
    with pytest.raises(ValueError):
        audit_orders(docs, "ABCDEFG")


def test_removal_polynomial_and_exact_integral(spark):
    """The polynomial at points between the corners, and its diagonal integrals as fractions, for three filters."""
    random.seed(9)
    rows = [("p", random.randrange(8), random.randrange(2), 0) for _ in range(50)]
    df = spark.createDataFrame(rows, "part string, fails int, good int, toxic int")
    terms = {x["t"]: x["n"] for x in removal_polynomials(df).first().terms}
    for x in itertools.product((Fraction(0), Fraction(1, 3), Fraction(1)), repeat=3):
        want = sum(1 - math.prod(1 - x[k] for k in range(3) if f >> k & 1) for _, f, _, _ in rows)
        assert want == sum(c * math.prod(x[k] for k in range(3) if t >> k & 1) for t, c in terms.items())
    got = got_audit(audit_orders(df, "XYZ"))
    for k, f in enumerate("XYZ"):
        value = sum((Fraction(1, bin(m).count("1")) for _, m, _, _ in rows if m >> k & 1), Fraction(0))
        assert {x[-1] for (_, order, step), x in got.items() if order[step - 1] == f} == {value * 6}


# ---- clustering


def brute_clusters(rows, k, rounds, dims, scale=64):
    clamp = lambda x: max(-(1 << 62), min(1 << 62, math.floor(scale * x) if abs(scale * x) < 1e300 else (1 << 62) * (1 if x > 0 else -1)))
    kept = [(i, tuple(clamp(x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(own[j]) for x in zip(*own[j])) if own[j] else c for j, c in enumerate(centroids)]
    return Counter((i, nearest(v)[1], min(nearest(v)[0], (1 << 63) - 1)) for i, v in kept), centroids


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "cluster", "upper", "lower", "key", "distance")})


@pytest.mark.parametrize("scale", [0.02, 1.0, 50.0])
def test_clusters_brute_force(spark, scale):
    """Coarse grids make many ties between centroids, equal centroids and empty ones."""
    random.seed(int(scale * 100))
    rows = [(i, [random.choice((-1.0, 0.0, 1.0)) * scale + random.choice((0.0, 0.01)) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1]), (400, None), (401, [1.0]), (402, [float("nan"), 0.0, 0.0, 0.0]), (403, [None, 0.0, 0.0, 0.0]), (404, [float("inf"), 0.0, 0.0, 0.0])]
    out, centroids = cluster_vectors(vectors(spark, rows), k=16, rounds=3, dims=4)
    got = out.collect()
    want, final = brute_clusters(rows, 16, 3, 4)
    assert centroids == final and Counter((r.vec_id, r.cluster, r.distance) for r in got) == want
    digest = clustering_digest(out, centroids).collect()
    assert {r.inertia for r in digest} == {sum(d * n for (_, _, d), n in want.items())}
    assert {r.cluster: r.centroid_sha256 for r in digest} == {j: hashlib.sha256(",".join(map(str, final[j])).encode()).hexdigest() for j in {c for _, c, _ in want}}


def test_bounds_skip_distances(spark):
    random.seed(5)
    centres = [[random.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + random.gauss(0, 0.05) for x in random.choice(centres)]) for i in range(500)]
    out, centroids = cluster_vectors(vectors(spark, rows), k=6, rounds=3, dims=8)
    got = out.collect()
    want, final = brute_clusters(rows, 6, 3, 8)
    assert centroids == final and Counter((r.vec_id, r.cluster, r.distance) for r in got) == want
    assert sum(r.computed for r in got) < 0.6 * len(rows) * 6 * 4


@pytest.mark.parametrize("big", [1e7, 1e9, 1e16, 1e300])
def test_clusters_of_large_components(spark, big):
    random.seed(4)
    rows = [(i, [random.choice((-big, 0.0, big, 1.0)), random.uniform(-1, 1), random.choice((-big, 0.5))]) for i in range(60)]
    out, centroids = cluster_vectors(vectors(spark, rows), k=5, rounds=3, dims=3)
    want, final = brute_clusters(rows, 5, 3, 3)
    assert centroids == final and Counter((r.vec_id, r.cluster, r.distance) for r in out.collect()) == want
    assert clustering_digest(out, centroids).count() == 60


def test_few_and_no_vectors(spark):
    one = [(3, [1.0, 2.0])]
    out, centroids = cluster_vectors(vectors(spark, one), dims=2)
    assert [tuple(r)[:3] for r in out.collect()] == [(3, 0, 0)] and centroids == [(64, 128)]
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])]):
        out, centroids = cluster_vectors(vectors(spark, rows), dims=2)
        assert out.count() == 0 and centroids == [] and clustering_digest(out, centroids).count() == 0


def test_bounds_are_conservative():
    random.seed(1)
    x = np.array([random.randrange(1 << random.randrange(1, 62)) for _ in range(2_000)] + [0, 1, (1 << 53) + 1], np.int64)
    for low, high, n in zip(clustering.below(x), clustering.above(x), x):
        assert Fraction(float(low)) ** 2 <= int(n) <= Fraction(float(high)) ** 2
    assert (clustering._float_below(np.sqrt(x.astype(float))) <= np.sqrt(x.astype(float))).all()


# ---- WARC

TRAP = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n after"
PAGES = [
    (1, "http://a/1", "<p>é 中文</p>" * 3_000), (2, "http://a/2", None), (3, "http://a/3", ""), (4, None, "short"), (5, "http://a/5", "short"),
    (6, "http://a/6", "x" * 100), (7, "http://a/7", "x" * 100), (7, "http://a/7", "x" * 100), (8, "http://a/8", "x" * 99), (9, "http://a/9", "x" * 99),
    (6, "http://a/6", "x" * 100), (None, "http://a/n", "x" * 100), (None, None, "y" * 200), (None, None, "y" * 200),
    (10, "http://a/\r\n\r\nWARC/1.1\r\nX: 1", TRAP), (11, "http://a/11", TRAP * 400), (12, "http://a/12", TRAP * 400), (13, "http://a/13", "WARC/1." * 5_000), (14, "u", "\r\n" * 20_000), (15, "u", "a\x00b﻿ " * 50), (16, "u", "z" * 3_000_000),
]
PAGE = "page_id long, url string, html string"


def archive(spark):
    import uuid

    return f"{shared_dir(spark)}/test-warc-{uuid.uuid4().hex}"


def digest_rows(df):
    size = F.when(F.col("record_type") == "revisit", F.col("original_bytes")).otherwise(F.col("payload_bytes"))
    return Counter(tuple(r) for r in df.select(F.col("page_id").cast("long"), size, "payload_digest", "record_type", "original_page_id").collect())


def brute_pages(pages):
    out = Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        first = min(same) if same and len(raw) >= 100 else None
        again = first is not None and i != first
        out[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    return out


@pytest.mark.parametrize("segment_bytes,chunk_bytes", [(16_384, 4_096), (997, 10), (1 << 30, 1 << 30)])
def test_warc_round_trip(spark, segment_bytes, chunk_bytes):
    pages = PAGES if segment_bytes > 1_000 else [p for p in PAGES if len(p[2] or "") < 100_000]
    df = spark.createDataFrame(pages, PAGE).withColumns({c: F.lit("x") for c in ("digest", "first", "payload", "record", "n", "again", "problem")})
    path = archive(spark)
    write_warc(df.repartition(3), path, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes)
    records = read_warc(spark, path).cache()
    assert records.where("problem is not null").count() == 0
    assert digest_rows(with_originals(records.drop("payload"))) == brute_pages(pages)
    payloads = Counter((r.page_id, bytes(r.payload)) for r in records.where("record_type = 'response'").collect())
    want = Counter((None if i is None else str(i), (h or "").encode()) for i, _, h in pages)
    assert not payloads - want
    records.unpersist()


def test_no_pages(spark):
    path = archive(spark)
    write_warc(spark.createDataFrame([], PAGE), path)
    assert with_originals(read_warc(spark, path).drop("payload")).count() == 0


def test_chunks():
    random.seed(2)
    for _ in range(200):
        body = bytes(random.choice(b"\r\nWARC/1.x") for _ in range(random.randrange(60)))
        framed = chunked(body, random.randrange(1, 20))
        assert unchunked(framed) == body and warc.MARK not in framed
        assert unchunked(framed[: random.randrange(len(framed) - 4)]) is None
    assert unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert unchunked(b"-1\r\n\r\n") is None and unchunked(b"3\r\nabcd\r\n0\r\n\r\n") is None and unchunked(b"") is None


def test_segments_of_a_foreign_archive(spark):
    """Plain files of another writer: version 1.0, segments in any order and in other files, damaged and lost ones."""
    whole = page_records(1, "u1", b"a" * 50, hashlib.sha256(b"a" * 50).hexdigest(), None, None, "urn:one", 60, 8)
    lost_last = page_records(2, "u2", b"b" * 90, hashlib.sha256(b"b" * 90).hexdigest(), None, None, "urn:two", 60, 8)[:-1]
    lost_first = page_records(3, "u3", b"c" * 90, "", None, None, "urn:three", 60, 8)[1:]
    twice = page_records(4, "u4", b"d" * 90, hashlib.sha256(b"d" * 90).hexdigest(), None, None, "urn:four", 100, 8)
    twice.append(twice[1])
    torn = page_records(5, "u5", b"e" * 90, "", None, None, "urn:five", 1_000, 500)[0][:-10]
    wrong = page_records(6, "u6", b"f" * 90, "0" * 64, None, None, "urn:six", 1_000, 500)
    orphan = page_records(7, "u7", b"", "1" * 64, 1, "u1", "urn:seven", 1_000, 500)
    within = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:eight>\r\nX-Long: a\r\n b\r\nContent-Length: 31\r\n\r\nx\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.0\r\ny"
    short = page_records(8, "u8", b"g" * 90, hashlib.sha256(b"g" * 90).hexdigest(), None, None, "urn:nine", 1_000, 500)
    files = [[*whole[::-1], *lost_last, within, torn], [*lost_first, *twice, *wrong], [*orphan, *short, b"WARC/1.1\r\nnothing"]]
    path = archive(spark)
    rows = [("\r\n\r\n".join(r.decode("latin-1") for r in f),) for f in files]
    spark.createDataFrame(rows, "value string").repartition(3).write.option("lineSep", "\r\n\r\n").text(path)
    got = {r.record_id: r for r in with_originals(read_warc(spark, path)).collect()}
    assert bytes(got["urn:one"].payload) == b"a" * 50 and got["urn:one"].problem is None and got["urn:one"].target_uri == "u1"
    assert got["urn:two"].problem == "the last segment is missing" and got["urn:three"].problem == "a segment is missing or there twice"
    assert got["urn:three"].record_type == "continuation" and got["urn:four"].problem == "a segment is missing or there twice"
    assert got["urn:five"].problem == "cut off" and got["urn:six"].problem == "payload digest differs" and got["urn:seven"].problem == "the original is missing"
    assert len(got["urn:eight"].payload) == 31 and got["urn:eight"].problem is None and got["urn:nine"].problem is None
    assert got[None].problem == "no header" and len(got) == 10
    heads = {r.record_id: r.headers for r in archive_records(spark, path).collect()}
    assert heads["urn:eight"]["x-long"] == "a b"


def test_records_that_end_anywhere_in_a_read_buffer(spark):
    """Empty lines that end a chunked block and a record, at every place around the 64 KiB that a reader takes at a time."""
    path, n = archive(spark), 24
    files = []
    for k in range(n):
        first = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%02d-a>\r\nContent-Length: %d\r\n\r\n"
        size = 65_536 - len(first % (k, 65_000)) - 14 + k
        body = b"x" * (size - 4) + b"\r\n\r\n"
        files.append((first % (k, size) + body).decode() + "\r\n\r\n" + f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{k:02}-b>\r\nContent-Length: 3\r\n\r\nabc")
    spark.createDataFrame([(f,) for f in files], "value string").repartition(n).write.option("lineSep", "\r\n\r\n").text(path)
    got = read_warc(spark, path).collect()
    assert len(got) == 2 * n and all(r.problem is None for r in got)


def test_whole_payload_of_bad_totals():
    http = b"HTTP/1.1 404 Not Found\r\n\r\nabc"
    assert whole_payload("response", None, [(1, None, http[:10]), (2, len(http), http[10:])], None) == (404, b"abc", None)
    assert whole_payload("response", None, [(1, None, http[:10]), (2, len(http) + 1, http[10:])], None)[2] == "total length differs"
    assert whole_payload("response", None, [(1, None, b"junk")], None) == (None, None, "no HTTP header")
