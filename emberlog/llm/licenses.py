"""License scans: an exact set-similarity join of text blocks with license templates, and a phrase scan."""

from __future__ import annotations

import re
from collections.abc import Mapping
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wordings of public licenses by label; a block that holds most of the words of one gets its label.
TEMPLATES = {
    "mit-notice": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license."],
    "mit-text": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "apache-2.0-notice": ["Licensed under the Apache License, Version 2.0."],
    "gpl-3.0-notice": ["This work is licensed under the GNU General Public License, version 3."],
    "gpl-text": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "cc-by-nc-4.0-notice": ["Licensed under CC BY-NC 4.0."],
    "cc-by-4.0-notice": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd-text": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Words that name a license: a block must have those of the template, whatever else it has.
NAMES = frozenset("mit apache gnu cc nc creative commons attribution mozilla".split())
_BLANK = re.compile(rb"\n(?: *\n)+")
#: A template is looked for in runs of this many times its own words.
REACH = 2
#: A-Z become a-z, separators become spaces; line feeds stay to part blocks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c == 10 or 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in text.encode().translate(_TABLE).split()]


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches):
        import pyarrow as pa

        counts = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for text in b.column(0):
                if text.is_valid:
                    for w in vocabulary.intersection(text.as_py().encode().translate(_TABLE).split()):
                        counts[w] += 1
        yield pa.record_batch([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return run


def token_order(docs: DataFrame, vocabulary: set[str]) -> list[str]:
    """The templates' tokens from the rarest to the most frequent by number of documents, over all documents."""
    counted = docs.select("text").mapInArrow(_frequencies(frozenset(w.encode() for w in vocabulary)), "token string, n long")
    n = {r.token: r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # as many rows as the templates have tokens
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def windows(n: int, reach: int):
    """(start, end) of parts of n words that hold every run of up to reach words, none longer than twice that."""
    for start in range(0, max(1, n - reach), reach):
        yield start, min(n, start + 2 * reach)


def _scan(phrases: Mapping[str, str], rank: Mapping[bytes, int], least: int, reach: int):
    """Per document: the phrase scan, and the blocks that have at least `least` different template tokens: their ranks, and
    at and own: place and rank of each template token in its order."""
    needles = [(f" {p} ".encode(), label) for p, label in phrases.items()]
    known = frozenset(rank)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for text in b.column(1):
                line = (text.as_py() or "").encode().translate(_TABLE)
                words = line.split()
                flat, places, labels = b" " + b" ".join(words) + b" ", [], set()
                for needle, label in needles:
                    at, before, word = flat.find(needle), 0, 0
                    while at >= 0:
                        word += flat.count(b" ", before, at)  # from the place before: a text is gone through once
                        before = at
                        places.append(word)
                        labels.add(label)
                        at = flat.find(needle, at + 1)
                blocks = []
                for part in _BLANK.split(line):
                    own = part.split()
                    if len(known.intersection(own)) < least:
                        continue
                    for i, j in windows(len(own), reach):
                        if len(found := known.intersection(own[i:j])) >= least:
                            at = [k for k in range(i, j) if own[k] in found]
                            blocks.append({"ranks": sorted(rank[w] for w in found), "at": at, "own": [rank[own[k]] for k in at]})
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), blocks))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([(x, pa.list_(pa.int32())) for x in ("ranks", "at", "own")])))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.record_batch([b.column(0), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    return run


def scan_licenses(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8, names: frozenset[str] = NAMES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches, contained of every row of docs.

    Words are A-Z lower-cased runs of characters other than ASCII ones that are no letters or digits. The phrase scan
    counts the places where a phrase's words follow each other. A template matches a run of words if that has the share
    threshold of the template's different words at least and is no longer than REACH times the template: contained has
    the labels of all templates that match so (sorted, comma-joined). labels, score and matches are of those of which the
    run also has the words that name a license (names; the empty set for all). Line ends and comment marks are no words, so wrapped texts match; a line without words ends
    a run. Blocks of words that overlap enough to hold every such run are joined on tokens: with
    all tokens in one order, the rarest first, a block of the overlap needed must have a token in common with the
    template's prefix within its own prefix (prefix filter), have as many template tokens as needed (length filter), and
    have enough tokens left behind the two places (positional filter); those left are verified exactly, run by run. Of
    templates that match in one block, one whose words another one's include gives way to it if their labels differ.
    matches lists (block's place among the candidates, label, containment); score is the highest containment, 0 without
    a match.
    Null and empty texts have no words. Repeated rows each have their result; a null doc_id stays. Other columns of docs
    are ignored.
    """
    rows = [(label, len(tokens(t)), sorted(set(tokens(t)))) for label, texts in templates.items() for t in texts]
    spark = docs.sparkSession
    order = token_order(docs, {w for _, _, ws in rows for w in ws})
    rank = {w: i for i, w in enumerate(order)}
    need = [max(1, ceil(threshold * len(ws) - 1e-9)) for _, _, ws in rows]
    sets = [set(ws) for _, _, ws in rows]
    over = [[j for j, other in enumerate(sets) if own < other and rows[j][0] != rows[i][0]] for i, own in enumerate(sets)]
    shapes = [(label, i, REACH * long, n, sorted(rank[w] for w in ws), sorted(rank[w] for w in names.intersection(ws)), over[i]) for i, ((label, long, ws), n) in enumerate(zip(rows, need))]
    table = spark.createDataFrame(shapes, "label string, template int, reach int, need int, t_ranks array<int>, t_names array<int>, over array<int>")
    least = min(need)
    scan = _scan(phrases, {w.encode(): i for w, i in rank.items()}, least, REACH * max(long for _, long, _ in rows))
    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, blocks array<struct<ranks: array<int>, at: array<int>, own: array<int>>>"
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, ddl).withColumn("row", F.monotonically_increasing_id())
    scanned = saved(scanned, "license-scan")
    blocks = scanned.select("row", F.posexplode("blocks").alias("block", "b")).select("row", "block", "b.ranks", F.arrays_zip("b.at", "b.own").alias("places"))
    probe = blocks.select("*", F.posexplode(F.expr(f"slice(ranks, 1, size(ranks) - {least} + 1)")).alias("at", "token"))
    index = table.select("*", F.posexplode(F.expr("slice(t_ranks, 1, size(t_ranks) - need + 1)")).alias("t_at", "token"))
    pairs = probe.join(F.broadcast(index), "token")  # as many rows as the templates have prefix tokens
    pairs = pairs.where("size(ranks) >= need and least(at, t_at) + least(size(ranks) - at, size(t_ranks) - t_at) >= need")
    pairs = pairs.dropDuplicates(["row", "block", "template"]).where("size(array_intersect(ranks, t_ranks)) >= need")
    # the run from each place on: a block has a bounded number of them
    pairs = pairs.withColumn("places", F.expr("filter(places, p -> array_contains(t_ranks, p.own))"))
    pairs = pairs.withColumn("runs", F.expr("transform(places, p -> array_distinct(transform(filter(places, q -> q.at >= p.at and q.at < p.at + reach), q -> q.own)))"))
    pairs = pairs.where("exists(runs, r -> size(r) >= need)")
    pairs = saved(pairs.withColumn("common", F.expr("array_max(transform(filter(runs, r -> size(array_except(t_names, r)) = 0), r -> size(r)))")).drop("places", "runs", "ranks"), "license-pairs")
    contained = pairs.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("contained"))
    pairs = pairs.where("common >= need").groupBy("row", "block").agg(F.collect_list(F.struct("template", "over", "label", (F.col("common") / F.size("t_ranks")).alias("containment"))).alias("hits"))
    pairs = pairs.select("row", "block", F.explode(F.expr("filter(hits, h -> not exists(hits, x -> array_contains(h.over, x.template)))")).alias("hit"))
    hits = pairs.groupBy("row").agg(F.sort_array(F.collect_set("hit.label")).alias("own"), F.max("hit.containment").alias("score"), F.sort_array(F.collect_list(F.struct("block", "hit.label", "hit.containment"))).alias("matches"))
    base = F.expr("filter(split(base_labels, ','), x -> x <> '')")
    labels = F.array_join(F.sort_array(F.array_union(base, F.coalesce("own", F.array().cast("array<string>")))), ",")
    out = scanned.drop("blocks").join(hits, "row", "left").join(contained, "row", "left")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "matches", F.coalesce("contained", F.lit("")).alias("contained"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")


QUERIES = {"op1_license_scan": op1_license_scan}
