"""The training-data operators against brute force and on odd inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from emberlog.llm import registry
from emberlog.llm.components import components
from emberlog.llm.decontaminate import decontaminate, find_leaks
from emberlog.llm.html_text import extract_main_text, main_blocks, source_side
from emberlog.llm.katz import Discounts, TRUSTED, held_out, katz_scores
from emberlog.llm.licenses import scan_licenses
from emberlog.llm.mixing import mix_sources
from emberlog.llm.quality import fit_quality, quality_grades, score_quality
from emberlog.llm.simhash import ball_links, drop_near_duplicates, near_duplicate_components
from emberlog.llm.substring_dedup import dedup_substrings
from emberlog.llm.suffix_dedup import dedup_suffixes, drop_repeats, suffix_order
from emberlog.llm.topk import top_k

ODD = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "ééé ß 中文 " * 40), (4, "ééé ß 中文 " * 40), (None, "no id at all"), (None, None), (5, "long " * 60_000), (6, "a\x00b \x1f"), (7, "MIT License. MIT license")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    extra = {c: F.lit("x") for c in ("spans", "fp", "key", "size", "row", "score", "n_words", "chunk", "hash", "seg", "kept", "node")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra).withColumn("source", F.when(F.col("doc_id") > 3, F.concat(F.lit("s"), F.col("doc_id") % 2)))


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


ALL = {
    "licenses": scan_licenses,
    "substring": dedup_substrings,
    "suffix": dedup_suffixes,
    "repeats": drop_repeats,
    "simhash": near_duplicate_components,
    "katz": katz_scores,
    "mixing": mix_sources,
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_rows_and_empty_table(name, spark, odd):
    assert ALL[name](odd).count() == len(ODD)
    assert ALL[name](odd.limit(0)).count() == 0


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_licenses_base_places(docs, odd):
    for table in (docs, odd):
        got = Counter(tuple(r)[:6] for r in scan_licenses(table).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
        want = Counter()
        for d, t in texts(table):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
            at = sorted((i, lab) for p, lab in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
            want[(d, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({lab for _, lab in at})))] += 1
        assert got == want


def test_license_template_containment(spark):
    rows = [(1, "Intro\nReleased under MIT, the License."), (2, "Released yesterday under protest"), (3, "x\nCC BY-NC 4.0 licensed under")]
    got = {r.doc_id: (r.labels, round(r.score, 3)) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == ("mit-notice", 1.0) and got[2] == ("", 0.0) and "cc-by-nc-4.0-notice" in got[3][0]


@pytest.mark.parametrize("width", [72, 80, 100])
def test_license_wrapped(spark, width):
    import textwrap

    from emberlog.llm.licenses import TEMPLATES

    long = [label for label in TEMPLATES if label.endswith("-text")]
    rows = []
    for k, label in enumerate(long):
        text = textwrap.fill("Copyright 2020 of somebody. " + TEMPLATES[label][0] + ", and so on for the rest of it.", width)
        rows += [(3 * k, text), (3 * k + 1, "/*\n" + textwrap.indent(text, " * ") + "\n */"), (3 * k + 2, "x\n" + textwrap.indent(text, "// ").replace("\n", "\r\n"))]
    scattered = "\n".join(f"{w} {'filler ' * 12}" for w in TEMPLATES["mit-text"][0].split())  # the words, far from each other
    rows += [(90, scattered), (91, TEMPLATES["mit-text"][0].replace(" ", "\n\n"))]
    got = {r.doc_id: (r.labels.split(","), r.score) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(label in got[3 * k + i][0] and got[3 * k + i][1] >= 0.8 for k, label in enumerate(long) for i in range(3))
    assert got[90] == ([""], 0.0) and got[91] == ([""], 0.0)


def brute_licenses(text):
    """Labels and score by trying every run of words of every paragraph."""
    from emberlog.llm.licenses import NAMES, TEMPLATES

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    every = [(label, len(split(t)), set(split(t))) for label, ts in TEMPLATES.items() for t in ts]
    parts, now = [], []
    for line in [*(text or "").split("\n"), ""]:
        if split(line):
            now += split(line)
        elif now:
            parts.append(now)
            now = []
    best = {}
    for part in parts:
        found = {}
        for k, (label, long, own) in enumerate(every):
            need = math.ceil(0.8 * len(own) - 1e-9)
            runs = [own.intersection(part[i : i + 2 * long]) for i in range(len(part))]
            common = max((len(r) for r in runs if NAMES & own <= r), default=0)
            if common >= need:
                found[k] = common / len(own)
        for k, x in found.items():
            if not any(every[k][2] < every[j][2] and every[k][0] != every[j][0] for j in found):
                best[every[k][0]] = max(x, best.get(every[k][0], 0))
    return sorted(best), max(best.values(), default=0.0)


def test_licenses_brute_force(spark, docs):
    import random

    from emberlog.llm.licenses import TEMPLATES

    random.seed(2)
    rows = texts(docs) + [(8_000, "Licensed under CC BY 4.0."), (8_001, "Licensed under CC BY-NC 4.0."), (8_002, "Released under the BSD License.")]
    scattered = ["word"] * 500
    scattered[3], scattered[100], scattered[250], scattered[400], scattered[450] = "released", "under", "the", "license", "mit"
    rows.append((8_003, " ".join(scattered)))
    notices = [t for ts in TEMPLATES.values() for t in ts]
    for k in range(300):  # parts of templates among other words, wrapped, with words left out and gaps
        own = random.choice(notices).split()
        own = [w for w in own if random.random() > 0.1]
        for _ in range(random.randrange(3)):
            own.insert(random.randrange(len(own) + 1), " ".join(["filler"] * random.randrange(1, 40)))
        body = [*(["before"] * random.randrange(90)), *own, *(["the", "of", "and"] * random.randrange(40))]
        rows.append((9_000 + k, "".join(w + random.choice(("\n", " ", " ", " ", "\r\n // ", "\n \n" if random.random() < 0.05 else " ")) for w in body)))
    got = {r.doc_id: (set(filter(None, r.labels.split(","))) - set(filter(None, r.base_labels.split(","))), r.score) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    labels = 0
    for d, t in rows:
        want, score = brute_licenses(t)
        assert got[d][0] == set(want) and abs(got[d][1] - score) < 1e-12, (d, t[:300], got[d], want, score)
        labels += bool(want)
    assert labels > 100
    assert got[8_000][0] == {"cc-by-4.0-notice"} and got[8_001][0] == {"cc-by-nc-4.0-notice"} and not got[8_002][0] and not got[8_003][0]


def test_quality_orders_and_held_out_accuracy(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    grades = quality_grades(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    model = fit_quality(docs, grades.where("doc_id % 3 > 0"))
    rows = score_quality(docs, model).join(grades.where("doc_id % 3 = 0"), "doc_id").collect()
    assert all(r.tails[0] >= r.tails[1] and abs(r.expected_grade - sum(r.tails)) < 1e-9 for r in rows)
    assert sum((r.tails[1] >= 0.5) == (r.grade == 2) for r in rows) > 0.85 * len(rows)


def test_quality_scores_brute_force(spark, docs):
    """Scores from words found by regular expressions and a model of random weights."""
    import random

    import numpy as np

    from emberlog.llm.common import word_hashes
    from emberlog.llm.quality import SIZE, SYMBOLS, WORDS, OrdinalModel

    random.seed(4)
    model = OrdinalModel(np.array([random.uniform(-1, 1) for _ in range(SIZE)], np.float32).astype(float), np.array([-0.5, 0.75]))
    of = lambda w, seed=0: int(word_hashes(np.frombuffer(w + bytes(16), np.uint8), np.array([0]), np.array([len(w)]), seed)[0])
    rows = texts(docs)[:120] + [(d, t) for d, t in ODD if d != 5]
    got = Counter((r.doc_id, round(r.expected_grade, 6)) for r in score_quality(spark.createDataFrame(rows, SCHEMA), model).collect())
    want = Counter()
    for d, t in rows:
        raw = (t or "").encode()
        ws = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
        n = max(len(ws), 1)
        z = sum(model.weights[of(w) % WORDS] for w in {of(w) % WORDS: w for w in map(bytes.lower, ws)}.values())
        for kind, c in Counter(WORDS + of(w, 1) % SYMBOLS for w in re.findall(rb"[^0-9A-Za-z\x80-\xff\t-\r ]+", raw)).items():
            z += model.weights[kind] * min(c * 8 / n, 16)
        low_ws = [w.lower() for w in ws]
        z += model.weights[WORDS + SYMBOLS] * min(len(re.findall(rb"[A-Z]", raw)) * 2 / n, 16)
        z += model.weights[WORDS + SYMBOLS + 1] * min(sum(a == b for a, b in zip(low_ws, low_ws[1:])) * 8 / n, 16)
        want[d, round(sum(1 / (1 + math.exp(max(-60, min(60, c - z)))) for c in model.thresholds), 6)] += 1
    assert got == want


def test_ordinal_fit_reaches_the_maximum():
    """The fit's penalised likelihood against long plain gradient ascent, by loops over rows."""
    import random

    import numpy as np

    from emberlog.llm.quality import fit_ordinal

    random.seed(3)
    n, k = 90, 4
    x = [[random.choice((0.0, 1.0)) for _ in range(k)] for _ in range(n)]
    grade = [sum(2.0 * a[0] - 1.5 * a[1] + random.gauss(0, 1) > c for c in (-0.3, 0.9)) for a in x]
    doc, index, value = zip(*[(i, j, v) for i, a in enumerate(x) for j, v in enumerate(a) if v])

    def loss(w, cuts):
        out = 5.0 * sum(a * a for a in w)  # l2 / 2
        for a, g in zip(x, grade):
            z = sum(p * q for p, q in zip(w, a))
            up = 1.0 if g == 2 else 1 / (1 + math.exp(z - cuts[g]))
            out -= math.log(max(up - (0.0 if g == 0 else 1 / (1 + math.exp(z - cuts[g - 1]))), 1e-12))
        return out

    best = [0.0] * k + [-0.5, 0.5]
    step = 0.5
    while step > 1e-5:  # coordinate search
        moved = False
        for i in range(k + 2):
            for d in (step, -step):
                now = best[:]
                now[i] += d
                if now[k] < now[k + 1] and loss(now[:k], now[k:]) < loss(best[:k], best[k:]) - 1e-12:
                    best, moved = now, True
        step = step if moved else step / 2
    model = fit_ordinal(np.array(doc), np.array(index), np.array(value), np.array(grade), 3)
    got, want = loss(model.weights[:k].tolist(), model.thresholds.tolist()), loss(best[:k], best[k:])
    assert model.thresholds[0] < model.thresholds[1] and want - 1e-9 <= got < want + 0.02 * abs(want)


def test_quality_stage_keeps_clashing_columns_and_is_repeatable(spark, docs, data):
    import corpus_pipeline as p

    clash = docs.withColumn("tails", F.lit("x")).withColumn("expected_grade", F.lit("y")).withColumn("__row", F.lit(1))
    out = p.quality(spark, clash, data)
    assert out.dtypes == clash.dtypes and out.where("tails <> 'x' or expected_grade <> 'y'").count() == 0
    grades = quality_grades(spark.read.parquet(f"{data}/labels.parquet"))
    one, two = (fit_quality(docs.repartition(n), grades.repartition(n)) for n in (3, 7))
    assert (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()


def test_quality_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, grade int")
    out = score_quality(odd, fit_quality(odd, none))
    assert out.count() == len(ODD) and set(odd.columns) < set(out.columns)
    few = spark.createDataFrame([(3, 2), (4, 0), (None, 1), (5, None)], "doc_id long, grade int")
    assert score_quality(odd, fit_quality(odd, few)).where("expected_grade is null").count() == 0


def test_top_k_brute_force(spark):
    import random

    random.seed(3)
    rows = [(i, [random.uniform(-1, 1) for _ in range(7)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(9)] + [(0, rows[5][1]), (50, None), (100, [float("nan")] * 7), (None, rows[1][1]), (300, []), (350, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in top_k(df, k=4).collect())
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, (i, v) in enumerate(ok):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(ok) if c != q)[:4]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert top_k(df.limit(0)).count() == 0
    assert top_k(spark.createDataFrame(rows[:3], df.select("vec_id", "embedding").schema)).count() == 2


@pytest.mark.parametrize("big", [1e9, 1e15, 1e300])
def test_top_k_of_large_components(spark, big):
    import random

    random.seed(6)
    rows = [(i, [random.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(61, [big, 0.0, 0.5, -1.0, 1.0]), (62, [-big, 1.0, 0.0, 0.0, 0.0]), (100, [0.0, 0.25, -0.5, 0.5, 0.0])]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect())
    ok = [(i, [max(-(1 << 62), min(1 << 62, math.floor(256 * x))) for x in v]) for i, v in rows]
    want = []
    for i, v in ok:
        if i % 50 == 0:
            best = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in ok if j != i)[:3]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_over_many_cells(spark, monkeypatch):
    """Cells that phase one has not exhausted are asked again."""
    import random

    from emberlog.llm import topk

    random.seed(7)
    monkeypatch.setattr(topk, "CELL_ROWS", 40)
    monkeypatch.setattr(topk, "CELL_QUERIES", 3)
    rows = [(i, [random.uniform(0, 1) for _ in range(4)]) for i in range(400)]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query="vec_id % 20 = 0", k=2).collect())
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for i, v in ok[::20]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i)[:2]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_leaks(spark):
    item = "A farmer in the valley sells 12 kg of apples to Maria for 3 dollars each and keeps the rest, so how much money does Maria pay in total today?"
    other = item.replace("12", "45").replace("Maria", "Jonas Berg").replace("3 dollars", "9 euros")
    clash = item.replace("to Maria", "to Jonas")  # one name of the item stands for two
    rows = [(1, "Before it. " + item), (2, "x\n" + other + " After."), (3, clash), (4, "Something else altogether, of some length, with no question in it at all, as it were."), (5, None), (6, "")]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    assert sorted(r.doc_id for r in find_leaks(docs, bench).collect()) == [1, 2]
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [3, 4, 5, 6]
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0


def template_tokens(text):
    """(what stands in a window, what stands for a placeholder or None, whether a name), by regular expressions."""
    from emberlog.llm.decontaminate import UNITS

    out, before_number, name_ends = [], False, False
    for m in re.finditer(r"(?:[0-9A-Za-z\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", text or ""):
        w, lead = m[0], (text[: m.start()]).rstrip(" \t\x0b\x0c")
        opens = not lead or lead[-1] in ".!?:;\n\r\"|"
        if "0" <= w[0] <= "9":
            out.append(("#", low(w), False))
        elif before_number and low(w) in UNITS:
            out.append(("unit", low(w), False))
        elif "A" <= w[0] <= "Z" and not opens:
            if name_ends:
                out[-1] = ("name", tuple(sorted([*out[-1][1], low(w)])), True)
            else:
                out.append(("name", (low(w),), True))
        else:
            out.append((low(w), None, False))
        before_number, name_ends = "0" <= w[0] <= "9", out[-1][0] == "name"
    return out


def brute_leaks(docs, items):
    found = {}
    for item, text in items:
        t = template_tokens(text)
        n = min(8, len(t))
        if n < 3:
            continue
        every = list(range(len(t) - n + 1))
        own = [i for i in every if sum(x[1] is None for x in t[i : i + n]) >= 5]
        verbatim = not own
        own = own or every
        key = (lambda w: tuple(str(x[1] or x[0]) for x in w)) if verbatim else (lambda w: tuple(x[0] for x in w))
        index = defaultdict(list)
        for i in own:
            index[key(t[i : i + n])].append(i)
        for doc, body in docs:
            d, placing = template_tokens(body), defaultdict(set)
            for j in range(len(d) - n + 1):
                for i in index.get(key(d[j : j + n]), ()):
                    placing[j - i].add(i)
            best = 0
            for shift, at in placing.items():
                pairs = {i: set() if verbatim else {(a[1], b[1], a[2]) for a, b in zip(t[i : i + n], d[i + shift : i + shift + n]) if a[1] is not None} for i in at}
                names = defaultdict(set)
                votes = Counter()
                for i in at:
                    for a, b, is_name in pairs[i]:
                        if is_name:
                            names[a].add(b)
                    votes.update([] if verbatim else [(a[1], b[1]) for a, b in zip(t[i : i + n], d[i + shift : i + shift + n]) if a[1] is not None])
                if any(len(v) > 1 for v in names.values()):
                    continue
                lost = {(a, b) for (a, b), c in votes.items() if any(x == a and k > c for (x, _), k in votes.items())}
                best = max(best, sum(not {(a, b) for a, b, _ in pairs[i]} & lost for i in at))
            if best and (best >= 6 or best >= 0.5 * len(own)):
                found[doc, item] = (best, len(own))
    return found


def test_leaks_brute_force(spark, docs, data, odd):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    items += [(9_001, "What is the capital of France?"), (9_002, "12 + 45 = 57, so 3 x 19 = 57"), (9_003, "Name it."), (9_004, ""), (9_005, None), (9_006, items[0][1])]
    rows = texts(docs) + [(80_000, "They asked: what is the capital of Spain?"), (80_001, "And what is the capital of France, then"), (80_002, "so 12 + 45 = 57, so 3 x 19 = 57."), (80_003, "12 + 45 = 58, so 3 x 20 = 58"), (80_004, "Name it."), *((d, t) for d, t in ODD if d != 4 and d is not None)]
    rows += [(81_000 + k, f"Some words before. {t} And after it, {k}.") for k, (_, t) in enumerate(items[:20])]
    rows += [(82_000 + k, re.sub(r"[0-9]+", lambda m: str(int(m[0]) + 7), t or "").replace("the", "a", 1)) for k, (_, t) in enumerate(items[:20])]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "hash", "slots", "pos", "item_id")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows) for r in find_leaks(table.repartition(3), bench).collect()}
    want = brute_leaks([(d, t) for d, t in rows], items)
    assert got == want and {(80_000, 9_001), (80_001, 9_001), (80_002, 9_002)} <= set(got) and (80_003, 9_002) not in got
    assert sum(d >= 81_000 for d, _ in got) >= 30
    kept = decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_leaks_with_contradicting_numbers(spark):
    item = "A farmer in the valley has 5 apples left in the old wooden barn behind the house and then buys exactly 5 pears at the market near the river, so how much fruit is there in the end for all of the children?"
    two = "A farmer in the valley has 6 apples left in the old wooden barn behind the house and then buys exactly 8 pears at the market near the river, so how much fruit is there in the end for all of the children?"
    parted = item.replace("5 apples", "3 apples").replace("5 pears", "7 pears")
    equal = two.replace("6 apples", "4 apples").replace("8 pears", "4 pears")
    docs = spark.createDataFrame([(1, parted), (2, equal), (3, "Nothing of the kind is to be found in here, I am afraid, dear reader of it.")], SCHEMA)
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows) for r in find_leaks(docs, spark.createDataFrame([(1, item), (2, two)], "item_id long, text string")).collect()}
    assert set(got) == {(d, i) for d in (1, 2) for i in (1, 2)}
    assert got[1, 2] == got[2, 2] == got[2, 1] and got[2, 2][0] == got[2, 2][1] > got[1, 1][0]
    assert [r.doc_id for r in decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [3]


def removed(rows, size, units):
    own, first = defaultdict(list), {}
    for d, t in rows:
        own[d].append(units(t))
    for d in sorted(x for x in own if x is not None):
        for u in own[d]:
            for i in range(len(u) - size + 1):
                first.setdefault(u[i : i + size], d)
    out = Counter()
    for d, us in own.items():
        for u in us:
            gone = [False] * len(u)
            for i in range(len(u) - size + 1):
                if d is not None and first[u[i : i + size]] < d:
                    gone[i : i + size] = [True] * size
            out[(d, len(u), sum(gone), hashlib.sha256(bytes(x for x, g in zip(u, gone) if not g) if isinstance(u, bytes) else " ".join(x for x, g in zip(u, gone) if not g).encode()).hexdigest())] += 1
    return out


#: With ids that the documents have not.
SHORT = [(None if d is None else 100_000 + d, t) for d, t in ODD if d != 5]


def test_substrings_brute_force(spark, docs):
    rows = texts(docs) + SHORT
    df = dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect())
    assert got == removed(rows, 50, lambda t: tuple(words(t)))


def test_suffixes_brute_force(spark, docs):
    rows = texts(docs) + SHORT + [(900 + i, "q" * (60 + i)) for i in range(4)]
    df = dedup_suffixes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())
    assert got == removed(rows, 50, lambda t: (t or "").encode())


def test_repeats_of_texts_that_share_an_id(spark, docs):
    """Only words and bytes that a smaller document holds go, from the row that has them."""
    own = texts(docs)[:60]
    a, b, c = (" ".join(f"{x}{i}" for i in range(90)) for x in "abc")
    rows = own + [(9_001, a), (9_002, a), (9_002, b), (9_002, b), (9_003, b + " " + c), (9_003, c + " " + a), (9_000, c[40:]), (None, a)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in dedup_substrings(df).collect())
    assert got == removed(rows, 50, lambda t: tuple(words(t)))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in dedup_suffixes(df).collect())
    assert got == removed(rows, 50, lambda t: (t or "").encode())
    left = Counter((r.doc_id, r.text) for r in drop_repeats(df).collect())
    assert left == Counter((r.doc_id, bytes(r.kept).decode()) for r in dedup_suffixes(df, whole_chars=True).collect())


def test_spans_of_suffixes(spark, docs):
    """n_spans is the number of maximal runs of removed bytes."""
    rows = texts(docs)[:80] + [(9_000, "x" * 30 + texts(docs)[0][1] + "y" * 30), (9_001, "q" * 200), (9_002, "q" * 55 + "r" + "q" * 60)]
    first = {}
    for d, t in sorted(rows):
        u = (t or "").encode()
        for i in range(len(u) - 49):
            first.setdefault(u[i : i + 50], d)
    want = {}
    for d, t in rows:
        u = (t or "").encode()
        gone = [False] * len(u)
        for i in range(len(u) - 49):
            if first[u[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        want[d] = sum(g and not before for g, before in zip(gone, [False, *gone]))
    assert {r.doc_id: r.n_spans for r in dedup_suffixes(spark.createDataFrame(rows, SCHEMA)).collect()} == want


@pytest.mark.parametrize("dedup", [dedup_substrings, dedup_suffixes])
def test_nothing_unique_goes_around_a_common_line(dedup, spark):
    """Many texts of random words around one common line: its anchors are hot, and all segments around them differ."""
    import random

    random.seed(9)
    line = " ".join(f"c{i:02d}" for i in range(45)) if dedup is dedup_substrings else "a common line of just forty bytes in all"
    word = lambda: f"{random.getrandbits(40):x}"
    rows = [(d, " ".join([*(word() for _ in range(20)), line, *(word() for _ in range(20))])) for d in range(4_000)]
    rows += [(9_000 + d, rows[d][1]) for d in range(3)]  # true copies
    out = dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).where("n_removed > 0").collect()
    assert sorted(r.doc_id for r in out) == [9_000, 9_001, 9_002] and all(not r.kept for r in out)


@pytest.mark.parametrize("dedup", [dedup_substrings, dedup_suffixes])
def test_texts_that_share_an_id(dedup, spark, docs):
    rows = texts(docs) + [(d, (t or "")[::3]) for d, t in texts(docs)]
    assert dedup(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)


def test_suffix_order():
    import numpy as np

    for text in (b"banana", b"mississippi" * 3, b"aaaa", b"a", b"abcabcabc"):
        got = suffix_order(np.frombuffer(text, np.uint8).astype(np.uint16) + 1, 64).tolist()
        assert got == sorted(range(len(text)), key=lambda i: text[i:])


def test_simhash_brute_force(spark, docs):
    rows = texts(docs)[:150] + SHORT
    got = sorted((tuple(r) for r in near_duplicate_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    fps = []
    for _, t in rows:
        w = words(low(t))
        sh = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        fps.append(fp - (1 << 64) if fp >> 63 else fp)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2:
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        names[find(i)] += [] if d is None else [d]
    want = sorted(((d, fps[i], min(names[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)
    assert got == want


def test_ball_links_reach_radius(spark):
    base = 0x0123456789ABCDEF
    near = [base ^ (1 << a) ^ (1 << b) for a, b in ((0, 5), (7, 62), (3, 4))]
    df = spark.createDataFrame([(x,) for x in [base, *near, base ^ 7, 0]], "fp long")
    nodes = {r.node: r.component for r in components(ball_links(df)).collect()}
    assert len({nodes[x] for x in [base, *near]}) == 1 and 0 not in nodes


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_near_duplicates_one_stays(spark, odd):
    import random

    random.seed(5)
    base = [f"w{random.randrange(5000)}" for _ in range(300)]
    rows = [(10, " ".join(base))]
    for i in range(6):
        own = base[:]
        own[random.randrange(300)] = f"z{i}"
        rows.append((20 + i, " ".join(own)))
    rows += [(40, " ".join(f"w{random.randrange(5000)}" for _ in range(300))), (41, " ".join(base[:150] + [f"y{i}" for i in range(150)])), (10, rows[0][1])]
    kept = sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == [10, 40, 41]
    out = drop_near_duplicates(odd)
    assert out.columns == odd.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 0), (False, 3), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]
    assert drop_near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_are_those_of_the_shingles(spark):
    import random

    from emberlog.llm.simhash import alike_links

    random.seed(12)
    rows, pairs = [], {}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for k in range(120):  # pairs of about 0.70 to 0.90
        base = [f"w{random.randrange(10**6)}" for _ in range(400)]
        own = base[:]
        for i in random.sample(range(4, 396), 5 + k % 10):
            own[i] = f"z{i}"
        a, b = " ".join(base), " ".join(own)
        s, t = shingles(a), shingles(b)
        pairs[k] = len(s & t) / len(s | t)
        rows += [(2 * k, a), (2 * k + 1, b)]
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    far = [k for k, x in pairs.items() if x < 0.8]
    near = [k for k, x in pairs.items() if x >= 0.8]
    found = sum(2 * k + 1 not in kept for k in near)
    assert len(far) > 20 and len(near) > 40
    assert all({2 * k, 2 * k + 1} <= kept for k in far) and found >= 0.95 * len(near)
    # a group of several blocks: candidates form a chain, links are those of the shingles
    base = [f"v{i}" for i in range(60)]
    many = [(k, " ".join([*base, f"own{k}"] if k % 3 else [f"u{k}-{i}" for i in range(60)])) for k in range(1300)]
    docs = spark.createDataFrame(many, SCHEMA).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    classes = docs.select(F.col("doc_id").alias("node"), F.struct("doc_id", "text_key").alias("best"), F.lit(56).alias("n"))
    chain = spark.range(1299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.component for r in components(alike_links(docs, classes, chain, 5)).collect()}
    assert got == {k: 1 for k in range(1300) if k % 3}


def exact_groups(rows, least=0.8, size=5):
    """Smallest place of each document's group, by all pairs of five-word shingles with a similarity of least (prefix filter)."""
    sets = []
    for t in rows:
        w = words(low(t))
        sets.append({" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else {""})
    freq = Counter(x for s in sets for x in s)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index, seen = defaultdict(list), {}
    for i, s in enumerate(sets):
        key = frozenset(s)
        if key in seen:
            root[i] = seen[key]
            continue
        seen[key] = i
        order = sorted(s, key=lambda x: (freq[x], x))
        for c in {j for x in order[: int((1 - least) * len(s)) + 1] for j in index[x]}:
            if len(s & sets[c]) >= least * len(s | sets[c]) - 1e-9:
                a, b = sorted((find(i), find(c)))
                root[b] = a
        for x in order[: int((1 - least) * len(s)) + 1]:
            index[x].append(i)
    return [find(i) for i in range(len(rows))]


def test_near_duplicates_recall_and_repeatability(spark):
    """Against exact groups of 10,000 documents; what stays does not depend on how the rows are dealt out."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = sorted(texts(docs))
    ids = [d for d, _ in rows]
    group = exact_groups([t for _, t in rows])
    gone = {ids[i] for i, g in enumerate(group) if g != i}
    kept = [{r.doc_id for r in drop_near_duplicates(docs.repartition(n)).select("doc_id").collect()} for n in (3, 7)]
    assert kept[0] == kept[1]
    dropped = set(ids) - kept[0]
    assert len(gone) > 500 and len(dropped & gone) >= 0.9 * len(gone) and not dropped - gone


def test_near_duplicates_of_one_id(spark):
    """Different texts with one doc_id are documents of their own."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, b), (2, c), (2, c), (3, b)]
    assert Counter(map(tuple, drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter([(1, a), (2, b), (2, c)])


def test_copies_of_fingerprints_grow_with_the_logarithm():
    from emberlog.llm.simhash import bucket_bits

    for nodes in (0, 1, 1_000, 10**6, 10**7, 10**9, 10**10):
        high = bucket_bits(nodes)
        assert nodes * (1 + high) <= 100_000 << high
    assert [1 + bucket_bits(10**k) for k in (5, 6, 7, 9)] == [3, 8, 12, 19]


def test_hot_buckets_are_split_and_others_are_not(spark):
    """Nodes of one piece in one bucket, all within reach of each other or of a chain: with blocks of ten nodes."""
    import numpy as np

    from emberlog.llm.simhash import PIECE_BITS, PIECES, wide_links

    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, PIECES * PIECE_BITS // 8, dtype=np.uint8)
    rows = []
    for k in range(90):
        fp = base.copy() if k < 60 else rng.integers(0, 256, len(base), dtype=np.uint8)
        fp[8:10] ^= np.frombuffer(np.uint16(k).tobytes(), np.uint8)
        rows.append((k, bytearray(fp.tobytes())))
    got = wide_links(spark.createDataFrame(rows, "node long, fp binary").repartition(4), 125, 10).collect()
    reach = {k: k for k in range(90)}
    for _ in range(90):
        for a, b in got:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert all(reach[k] == 0 for k in range(60)) and all(a < 60 and b < 60 for a, b in got)


@pytest.mark.parametrize("bucket_nodes", [50_000, 20])
def test_wide_links_past_a_smaller_stranger(spark, bucket_nodes):
    import random

    from emberlog.llm.simhash import PIECE_BITS, PIECES, wide_links

    random.seed(8)
    bits = PIECES * PIECE_BITS
    near = random.getrandbits(bits)
    copy = near ^ sum(1 << (PIECE_BITS * p + b) for p in range(1, PIECES) for b in (0, 9, 20))
    stranger = random.getrandbits(bits) >> PIECE_BITS << PIECE_BITS | near & (1 << PIECE_BITS) - 1  # shares all variants of a piece
    crowd = [random.getrandbits(bits) >> PIECE_BITS << PIECE_BITS | near & (1 << PIECE_BITS) - 1 for _ in range(60)]
    for others in ([stranger], [stranger, *crowd]):
        rows = [(k, bytearray(x.to_bytes(bits // 8, "little"))) for k, x in enumerate([*others, near, copy])]
        got = wide_links(spark.createDataFrame(rows, "node long, fp binary").repartition(3), 102, bucket_nodes).collect()
        assert [tuple(r) for r in got] == [(len(others), len(others) + 1)]


def brute_katz(rows, order):
    tok = [words(low(t)) + ["</s>"] for _, t in rows]
    cnt = [Counter() for _ in range(order)]
    for (d, _), w in zip(rows, tok):
        s = ["<s>", *w]
        for o in range(1, order + 1):
            cnt[o - 1].update(tuple(s[k - o + 1 : k + 1]) for k in range(o - 1, len(s)) if not held_out(d))
    real = {k: v for k, v in cnt[0].items() if k != ("<s>",)}
    total, disc = sum(real.values()), []
    for c in (real, *cnt[1:]):
        of = Counter(c.values())
        disc.append(Discounts.of([of[r] for r in range(1, TRUSTED + 2)]))
    left = lambda o, c: disc[o - 1].ratio[c] * c if c <= TRUSTED else c - disc[o - 1].less
    unknown = 1 - sum(left(1, v) for v in real.values()) / total if total else 1.0
    after = defaultdict(list)
    for c in cnt[1:]:
        for k in c:
            after[k[:-1]].append(k[-1])

    def p(ctx, w):
        c = cnt[len(ctx)][(*ctx, w)]
        if not ctx:
            return left(1, c) / total if c else unknown
        t = cnt[len(ctx) - 1][ctx]
        if c:
            return left(len(ctx) + 1, c) / t
        if not t:
            return p(ctx[1:], w)
        rest = 1 - sum(left(len(ctx) + 1, cnt[len(ctx)][(*ctx, x)]) for x in after[ctx]) / t
        return rest / (1 - sum(p(ctx[1:], x) for x in after[ctx])) * p(ctx[1:], w)

    out = []
    for (d, _), w in zip(rows, tok):
        s = ["<s>", *w]
        base = sum(math.log10((real.get((x,), 0) + 1) / (total + len(real) + 1)) for x in w)
        score = sum(math.log10(p(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))
        out.append((str(d), held_out(d), len(w), sum((x,) in real for x in w), total, base, score))
    for ctx in list(after)[:20]:  # probabilities after a context sum to 1, the unknown word's included
        assert abs(sum(p(ctx, w) for (w,) in real) + p(ctx, "\x00never") - 1) < 1e-9
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_brute_force(spark, order):
    import random

    random.seed(1)
    rows = [(i, " ".join(random.choices("a b c d e F g é ü k".split(), k=random.randrange(25)))) for i in range(50)] + [(i, f"rare{i} a b") for i in range(50, 60)] + SHORT
    got = sorted((str(r[0]), *r[1:]) for r in katz_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), order).collect())
    want = brute_katz(rows, order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a - b) < 1e-8 for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))


def test_katz_discounts_of_copies():
    import random

    random.seed(4)
    counts = Counter()
    for k in range(400):
        copies = 5 if k % 4 == 0 else 1
        counts.update({w: copies * n for w, n in Counter(f"w{int(random.paretovariate(0.7))}" for _ in range(60)).items()})
    of = Counter(counts.values())
    for n in ([of[r] for r in range(1, TRUSTED + 2)], [203564, 59191, 24852, 14252, 13435, 7102], [1577239, 246764, 51785, 21749, 18965, 7618]):
        assert 6 * n[5] / (5 * n[4]) > 1 or 5 * n[4] / (4 * n[3]) > 1  # Good-Turing fails on the numbers as they are
        x, y = [math.log(r) for r in range(1, 7)], [math.log(v) for v in n]
        slope = sum((a - sum(x) / 6) * (b - sum(y) / 6) for a, b in zip(x, y)) / sum((a - sum(x) / 6) ** 2 for a in x)
        smooth = [r**slope for r in range(1, 7)]
        cut = 6 * smooth[5] / smooth[0]
        want = [((r + 1) * smooth[r] / (r * smooth[r - 1]) - cut) / (1 - cut) for r in range(1, 6)]
        got = Discounts.of(n).ratio
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[1:], want)) and all(0 < a < 1 for a in want)


def test_katz_without_training(spark):
    assert all(r.score == 0 and r.base_score == 0 for r in katz_scores(spark.createDataFrame([(i, "a b") for i in range(200) if held_out(i)], SCHEMA)).collect())


def test_min_cut_by_brute_force():
    import random

    random.seed(2)
    for _ in range(60):
        n = random.randrange(1, 8)
        terminal = [random.randrange(-9, 10) or 1 for _ in range(n)]
        edges = [(i, j, random.randrange(6)) for i in range(n) for j in range(i) if random.random() < 0.5]
        cost = lambda side: sum(abs(t) for t, s in zip(terminal, side) if (t > 0) != s) + sum(c for i, j, c in edges if side[i] != side[j])
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(source_side(terminal, edges)) == least


PAGE = """<!DOCTYPE html><html><body class="has-sidebar"><header><h1>Site</h1><p>Welcome to the site of sites, dear reader.</p></header>
<nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav><script>if (a < b) { "<p>no</p>" }</script>
<article><h2>The title</h2><p>First &amp; foremost, a paragraph&nbsp;with <b>bold</b>
 and a <a href=3>link</a>.</p><div class="ad">Buy this wonderful thing today, it is the best of all things.</div><p>Short.</p></article>
<section id="comments"><div class="comment"><p>What a nice article this is, I liked every word.</p></div></section>
<form><p>Subscribe to our letters, they come each day.</p></form><footer>&copy; all of us</footer></body></html>"""


def test_main_text(spark):
    assert main_blocks(PAGE) == ["The title", "First & foremost, a paragraph with bold and a link.", "Short."]
    formula = "<article><p>The area is given by <math><mi>r</mi><mo>=</mo><mn>2</mn></math> as all of us know by now, <object>and so on</object> <svg><text>here</text></svg>.</p></article>"
    assert main_blocks(formula) == ["The area is given by r=2 as all of us know by now, and so on here."]
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "v", "<p>unclosed <b>words that go on for long enough to matter <i>here."), (4, "w", "<" * 5000), (5, "x", '<a href="' * 2000)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixing_of_many_sources(spark):
    """Hundreds of sources, some tiny and some hot; targets by simple resharing, ranges in many blocks."""
    import random

    from emberlog.llm import mixing

    random.seed(1)
    rows = [(i, "w " * random.randrange(40), "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 211}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df, rows_per_range=10).collect()
    old, mixing.BLOCK = mixing.BLOCK, 7
    try:
        assert sorted(map(tuple, mix_sources(df, rows_per_range=10).collect()), key=str) == sorted(map(tuple, got), key=str)
    finally:
        mixing.BLOCK = old
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            want |= share
            break
        want |= {s: 3.0 * size[s] for s in full}
        left -= sum(3.0 * size[s] for s in full)
        open_ -= full
    assert all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= 1 for s in names)


def test_mixing(docs):
    rows = mix_sources(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    total, names = sum(size.values()), sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, open_, left = {}, set(names), float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * size[s]}
        if not full:
            want |= share
            break
        want |= {s: 3.0 * size[s] for s in full}
        left -= sum(3.0 * size[s] for s in full)
        open_ -= full
        if not open_:
            break
    assert all(abs(target[s] - want[s]) < 1e-6 * total and taken[s] == math.floor(target[s]) for s in names)
    assert sorted(map(tuple, mix_sources(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_twins(spark, data, duck):
    from conftest import normal

    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, data)
        assert normal([tuple(r) for r in df.collect()], df.columns) == duck(sql), name


def test_pipeline_of_odd_tables(spark, data, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows, other columns; and an empty table."""
    import shutil

    import corpus_pipeline as p

    for name in ("labels", "benchmark"):
        shutil.copy(f"{data}/{name}.parquet", tmp_path / f"{name}.parquet")
    source = spark.read.parquet(f"{data}/documents.parquet")
    odd = [(d, t, None, None, None) for d, t in ODD] + [(9_000_001, "same id, " + "one text " * 40, "en", "web", 1), (9_000_001, "same id, " + "another text " * 40, "en", "web", 1)]
    docs = source.unionByName(spark.createDataFrame(odd, source.schema)).withColumn("tails", F.lit("x")).withColumn("taken", F.lit(7))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path)).cache()
        assert after.dtypes == now.dtypes and after.count() <= now.count(), name
        now = after
    assert p.run(spark, str(tmp_path)).count() == now.count()
    empty = tmp_path / "empty"
    empty.mkdir()
    for name in ("labels", "benchmark"):
        shutil.copy(f"{data}/{name}.parquet", empty / f"{name}.parquet")
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    assert p.run(spark, str(empty)).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    now = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, now, data).cache()
        assert after.columns == docs.columns and after.count() <= now.count()
        now = after
    assert p.run(spark, data).count() == now.count() > 0.5 * docs.count()
