"""Templates that a text contains, with and without the words that name a license; places in long texts."""

import math
import random
import re
import time

from emberlog.llm.licenses import REACH, TEMPLATES, _scan, scan_licenses

SCHEMA = "doc_id long, text string"


def contained(text):
    """Labels of all templates of which a run of words has enough, by trying every run."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    found = set()
    for part in re.split(r"\n[^a-z0-9]*\n", text.lower()):
        w = split(part)
        for label, ts in TEMPLATES.items():
            for t in ts:
                own, reach = set(split(t)), REACH * len(split(t))
                if any(len(own.intersection(w[i : i + reach])) >= math.ceil(0.8 * len(own) - 1e-9) for i in range(len(w))):
                    found.add(label)
    return found


def test_every_contained_template_is_found(spark):
    random.seed(12)
    every = [t for ts in TEMPLATES.values() for t in ts]
    rows = [(0, "Released under the BSD License."), (1, "")]
    for k in range(150):
        own = [w for w in random.choice(every).split() if random.random() > 0.12]
        rows.append((k + 2, " ".join(["before"] * random.randrange(30) + own + ["after"] * random.randrange(30)) + random.choice(("", "\n\nother words", " of the license"))))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    free = {r.doc_id: r for r in scan_licenses(df, names=frozenset()).collect()}
    more = 0
    for d, t in rows:
        want = contained(t)
        assert set(filter(None, got[d].contained.split(","))) == want == set(filter(None, free[d].contained.split(",")))
        named = {m.label for m in got[d].matches or ()}
        assert named <= want and (free[d].score > 0) == bool(want)
        more += bool(want - named)
    assert more > 3


def test_places_in_a_long_text_take_one_pass():
    import pyarrow as pa

    run = _scan({"mit license": "mit"}, {b"x": 0}, 1, 10)
    text = "mit license " * 400_000
    began = time.process_time()
    out = next(iter(run([pa.record_batch([pa.array([1]), pa.array([text])], names=["doc_id", "text"])]))).to_pylist()[0]
    assert (out["n_words"], out["n_base"], out["first_word"], out["last_word"]) == (800_000, 400_000, 0, 799_998)
    assert time.process_time() - began < 20
