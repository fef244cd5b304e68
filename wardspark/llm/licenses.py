"""License scans by diagonal voting (operator 9).

Every rolling 3-word hash of every text is joined to the places of that hash in
the templates.  A hit votes for a diagonal: place in the text minus place in the
template.  A copy of a template, also one with changed words, is one diagonal
with many votes; words put in or left out move the rest to another diagonal.
What is verified word by word on the text are chains: words of all diagonals that
follow each other in the text and in the template.

A template stands for its license only if the words are there that tell it from
others, and of templates found in the same words the best covered ones count.

The three base phrases are templates too: a diagonal with all their votes and
equal words is a place.  Texts are known by their digest, so equal texts are
judged once and ids may be null or repeat.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD_WORDS, NOT_WORD, extended, slices, strings, written

K = 3
#: Words put in at one place that a chain passes over first; if no such chain covers the template, any number.
PUT_IN = 100
#: Share of a template's words that must stand in order in the text.
COVERAGE = 0.7

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Words of published licenses and the label they stand for.
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "released under the MIT license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)


#: Where a template with the label is found, one phrase of each group must stand, and none of ``OTHERS``.
TELLING = {
    "mit": (("mit", "permission"),),
    "apache-2": (("apache",), ("version 2", "license 2", "licence 2")),
    "gpl-2": (("gnu",), ("version 2", "v2", "v 2")),
    "gpl-3": (("gnu",), ("version 3", "v3", "v 3")),
    "mpl-2": (("mozilla", "mpl"), ("v 2", "version 2", "license 2")),
    "cc-by": (("attribution",),),
    "cc-by-nc": (("noncommercial", "non commercial", "by nc"),),
    "cc-by-sa": (("sharealike", "share alike", "by sa"),),
}
OTHERS = {
    "gpl-2": ("gnu lesser", "gnu affero", "gnu library"), "gpl-3": ("gnu lesser", "gnu affero", "gnu library"),
    "cc-by": ("attribution noncommercial", "attribution non", "attribution sharealike", "attribution share", "attribution noderivatives", "attribution noderivs", "attribution no"),
}


def words_of(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").translate(FOLD_WORDS).split()]


#: Words, label and whether it is a base phrase, by number.
TEMPLATES = tuple((tuple(words_of(t)), label, base) for base, texts in ((True, BASE), (False, [(t, n) for n, t in TEXTS])) for t, label in texts)


def template_grams(spark: SparkSession) -> DataFrame:
    """``template, t_at, hash`` of all templates: a table as long as the templates above."""
    rows = [(n, " ".join(words)) for n, (words, _, _) in enumerate(TEMPLATES)]
    listed = spark.createDataFrame(rows, "template int, text string").withColumn("words", F.split("text", " "))
    return listed.select("template", F.posexplode(gram_hashes("words")).alias("t_at", "hash"))


def gram_hashes(words: str):
    w = F.col(words)
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*[w[i + n] for n in range(K)]))
    return F.when(F.size(w) >= K, hashes).otherwise(F.array().cast("array<bigint>"))


def word_tables(docs: DataFrame) -> DataFrame:
    """Every row with its text's digest and words."""
    text = F.coalesce("text", F.lit(""))
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(folded, f"[{NOT_WORD}]+"), "")
    return docs.withColumns({"digest": F.unhex(F.md5(text)), "words": words})


def diagonals(worded: DataFrame, grams: DataFrame) -> DataFrame:
    """``digest, template, diagonal, low, high, votes``; ``low`` and ``high`` are places in the text."""
    rolling = worded.select("digest", F.posexplode(gram_hashes("words")).alias("at", "hash"))
    # equal texts vote once; the templates are a constant, so is the size of what is broadcast
    hits = rolling.join(F.broadcast(grams), "hash").select("digest", "template", "at", "t_at").distinct()
    return hits.groupBy("digest", "template", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("votes"))


def candidates(lines: DataFrame) -> DataFrame:
    """``digest, runs``: for each text the templates that it may hold, with their diagonals.

    One text's diagonals of one template are a group, which is bounded by the text.  Of a copy with changed words
    each run of equal words costs two votes, so the first bar is a lower bound for all that can reach the coverage;
    with words put in there are more runs, so what lies between first and last hits is enough too.
    """
    size = F.element_at(F.array(*[F.lit(len(w)) for w, _, _ in TEMPLATES]), F.col("template") + 1)
    is_base = F.element_at(F.array(*[F.lit(b) for _, _, b in TEMPLATES]), F.col("template") + 1)
    least = F.ceil(COVERAGE * size)
    runs = lines.groupBy("digest", "template").agg(
        F.collect_list(F.struct("diagonal", "low", "high")).alias("lines"), F.sum("votes").alias("votes"), F.sum(F.col("high") - F.col("low") + K).alias("reach"))
    runs = runs.where(is_base | (F.col("votes") >= least - (K - 1) * (size - least + 1)) | (F.col("reach") >= least))
    return runs.groupBy("digest").agg(F.collect_list(F.struct("template", "lines")).alias("runs"))


def exact_places(words: list[str], wanted: tuple[str, ...], lines: list[dict]) -> list[int]:
    return [d for d in (line["diagonal"] for line in lines) if d >= 0 and tuple(words[d : d + len(wanted)]) == wanted]


def chains(anchors: list[tuple[int, int]], size: int, put_in: int) -> list[list[tuple[int, int]]]:
    """Chains of ``(place in text, place in template)`` that rise in both and cover enough, best first, apart from each other."""
    nodes: list[tuple[int, int, int, int]] = []  # words so far, start in the text (later is better), place, node before
    ends: list[int | None] = [None] * size  # for each place in the template the node of the best chain that ends there
    for at, t in anchors:
        best = (0, at, at, -1)
        for n in ends[:t]:
            if n is not None and at - nodes[n][2] - 1 <= put_in and nodes[n][:2] >= best[:2] and nodes[n][2] < at:
                best = (*nodes[n][:3], n)
        node = (best[0] + 1, best[1] if best[3] >= 0 else at, at, best[3])
        ends[t] = len(nodes)
        nodes.append(node)
    out, used = [], set()
    for n in sorted((n for n, x in enumerate(nodes) if x[0] >= COVERAGE * size), key=lambda n: (-nodes[n][0], -nodes[n][1], n)):
        chain, free = [], True
        while n >= 0 and free:
            free = nodes[n][2] not in used
            chain.append(anchors[n])
            n = nodes[n][3]
        if free:
            used.update(range(chain[-1][0], chain[0][0] + 1))
            out.append(chain[::-1])
    return out


def found_places(words: list[str], template: int, lines: list[dict]) -> list[tuple[float, frozenset[int]]]:
    """Share of the template and the places in the text of its words, for every place that holds the template."""
    wanted, label, _ = TEMPLATES[template]
    anchors = sorted(
        ((at, at - d) for line in lines for d in (line["diagonal"],)
         for at in range(max(0, d), min(d + len(wanted), len(words))) if words[at] == wanted[at - d]),
        key=lambda a: (a[0], -a[1]))
    out = []
    for chain in chains(anchors, len(wanted), PUT_IN) or chains(anchors, len(wanted), len(words)):
        # a telling word may stand in the template's place outside of what was found
        first, last = chain[0][0] - chain[0][1], chain[-1][0] + len(wanted) - chain[-1][1]
        around = f" {' '.join(words[max(0, first) : last])} "
        inside = f" {' '.join(words[chain[0][0] : chain[-1][0] + 1])} "
        told = all(any(f" {p} " in around for p in group) for group in TELLING.get(label, ()))
        if told and not any(f" {p} " in inside for p in OTHERS.get(label, ())):
            out.append((len(chain) / len(wanted), frozenset(at for at, _ in chain)))
    return out


def best_covered(found: list[tuple[str, float, frozenset[int]]]) -> list[tuple[str, float, frozenset[int]]]:
    """Without those that have half of their words or more in common with a better covered one of another label."""
    kept: list[tuple[str, float, frozenset[int]]] = []
    owner: dict[int, list[int]] = {}
    for label, share, places in sorted(found, key=lambda x: (-x[1], -len(x[2]), x[0])):
        common = Counter(k for at in places for k in owner.get(at, ()))
        beaten = any(
            kept[k][0] != label and 2 * n >= min(len(places), len(kept[k][2])) and (kept[k][1], len(kept[k][2])) > (share, len(places))
            for k, n in common.items())
        if not beaten:
            for at in places:
                owner.setdefault(at, []).append(len(kept))
            kept.append((label, share, places))
    return kept


DETAILS = "n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start:int,end:int,share:double>>"
SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))


def verify(texts: DataFrame) -> DataFrame:
    """Base places, labels and spans of texts with candidate runs."""
    schema = extended(texts, ["digest"], DETAILS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, runs in zip(strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words, places, spans, found = words_of(text), [], [], []
                for r in runs:
                    wanted, label, base = TEMPLATES[r["template"]]
                    if base:
                        exact = exact_places(words, wanted, r["lines"])
                        places += [(at, label) for at in exact]
                        spans += [(label, at, at + len(wanted), 1.0) for at in exact]
                    else:
                        found += [(label, *x) for x in found_places(words, r["template"], r["lines"])]
                found = best_covered(found)
                labels = {label for label, _, _ in found}
                spans += [(label, min(at), max(at) + 1, share) for label, share, at in found]
                base_labels = {label for _, label in places}
                starts = [at for at, _ in places]
                out.append((len(places), min(starts, default=None), max(starts, default=None), sorted(base_labels), sorted(base_labels | labels),
                            max((s[3] for s in spans), default=0.0), [dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in sorted(spans)]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return texts.mapInArrow(run, schema)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for every row of ``docs``.

    Words count from 0.  Texts without a license (null, empty and very short ones too) have no places, no
    labels and score 0; otherwise the score is the largest share of a template found, 1 for a base phrase.
    Repeated rows and null ids each have their row; an empty table gives an empty result; other columns are
    not read.
    """
    worded = word_tables(docs.select("doc_id", "text"))
    counts = written(worded.select("doc_id", "digest", F.size("words").cast("long").alias("n_words")), "license-words")
    runs = written(candidates(diagonals(worded, template_grams(docs.sparkSession))), "license-runs")
    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    found = verify(texts.join(runs.hint("shuffle_hash"), "digest").select("digest", "text", "runs"))
    found = written(found, "license-found").dropDuplicates(["digest"])
    none = F.array().cast("array<string>")
    return counts.join(found, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"),
                        F.concat_ws(",", "labels").alias("labels"), "score")
