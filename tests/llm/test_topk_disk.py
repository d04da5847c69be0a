"""What the exact search writes between its phases is bounded by its rows and its results, over several rounds and stripes."""

import random

from emberlog.llm import topk


def test_entries_do_not_leave_their_stripes(spark, monkeypatch):
    written, saved = {}, topk.saved

    def counted(df, name):
        out = saved(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(topk, "saved", counted)
    monkeypatch.setattr(topk, "CELL_ROWS", 150)
    monkeypatch.setattr(topk, "CELL_QUERIES", 90)
    random.seed(4)
    rows = [(i, [random.choice((0.0, 0.5, random.uniform(-1, 1))) for _ in range(6)]) for i in range(400)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query="vec_id % 2 = 0", k=3)
    whole = {i: [int(256 * x // 1) for x in v] for i, v in rows}
    want = []
    for q in range(0, 400, 2):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert max(written.values()) <= max(400, 200 * 4)
