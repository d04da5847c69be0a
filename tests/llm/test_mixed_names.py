"""Copies of benchmark items in which some mentions of a name are changed."""

from emberlog.llm.decontaminate import decontaminate, find_leaks

SCHEMA = "doc_id long, text string"
ITEM = "A farmer in the valley sells 12 kg of apples to Maria for 3 dollars each and keeps the rest, so how much money does Maria pay in total today?"


def test_a_copy_with_one_mention_changed_is_a_leak(spark):
    rows = [
        (1, ITEM), (2, ITEM.replace("to Maria", "to Jonas")), (3, ITEM.replace("does Maria", "does Jonas")), (4, ITEM.replace("Maria", "Jonas")), (5, "Intro. " + ITEM.replace("to Maria", "to Jonas").replace("12", "14") + " End."),
        (6, "Maria and Jonas sell apples in a valley for some dollars today, as far as anybody can tell from here."), (7, None), (8, ""),
    ]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(r.doc_id for r in find_leaks(docs, bench, mixed_names=True).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.doc_id for r in decontaminate(docs, bench, mixed_names=True).collect()) == [6, 7, 8]
    got = {r.doc_id: r.n_windows for r in find_leaks(docs, bench, mixed_names=True).collect()}
    assert got[1] == got[4] > got[2] and got[2] >= 6


def test_mixed_names_find_no_less(spark, data):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    strict, mixed = ({(r.doc_id, r.item_id) for r in find_leaks(docs, bench, mixed_names=m).collect()} for m in (False, True))
    assert strict and strict <= mixed
