import random

from wardspark.llm import licenses

from . import brute

MIT = licenses.TEXTS[0][1]
CASES = [
    "Released under the MIT License.", "x under the mit license, under the MIT-license y", "Apache License (Version 2)", "apache license version 20",
    "cc by nc", "CC BY-NC 4.0 and cc-by-nc", "cc by", "under the mit", "", None, "é cc by nc ü", "under the mit apache license version 2 cc by nc",
    "This work is licensed under the GNU General Public License, version 3.",
]


def test_base_phrases(spark):
    r = random.Random(2)
    words = "under the mit license apache version 2 cc by nc x".split()
    texts = CASES + [" ".join(r.choice(words) for _ in range(r.randint(1, 400))) for _ in range(60)]
    rows = [(n, t, "z") for n, t in enumerate(texts)] + [(None, CASES[0], ""), (0, CASES[0], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = [tuple(r) for r in licenses.digests(licenses.scan_licenses(docs)).collect()]
    assert len(got) == len(rows)
    assert sorted((g[:6] for g in got), key=str) == sorted(((i, *brute.base_licenses(t)) for i, t, _ in rows), key=str)
    for g in got:
        assert set(filter(None, g[5].split(","))) <= set(g[6].split(",")) and 0 <= g[7] <= 1 and (g[7] > 0) == bool(g[6])
    assert {g[0]: g[6] for g in got}[12] == "gpl-3"


def changed(text, seed):
    r = random.Random(seed)
    out = []
    for n, w in enumerate(text.split()):
        if n % 17 == 5:
            out.append(r.choice(["zzz", "", "zzz yyy"]))
        if n % 23 != 7:
            out.append(w)
    return " ".join(out)


def test_changed_templates_are_found_and_others_not(spark):
    filler = " ".join(random.Random(1).choice("alpha beta gamma delta".split()) for _ in range(300))
    rows = [(1, f"{filler} {changed(MIT, 1)} {filler}"), (2, filler), (3, " ".join(MIT.split()[:25])), (4, " ".join(reversed(MIT.split())))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == ["mit"] and got[1].n_base == 0 and 0.7 <= got[1].score < 1
    span = got[1].spans[0]
    assert 295 <= span.start <= 305 and 355 <= span.end <= 380
    assert not got[2].labels and not got[3].labels and not got[4].labels


LGPL = licenses.TEXTS[5][1].replace("General", "Lesser General")
LABELLED = [(text, label) for label, text in licenses.TEXTS] + [
    ("Licensed under CC BY-SA 4.0", ""), ("released under the BSD license", ""), ("licensed under the Mozilla Public License, Version 2.0", ""), ("Licensed under the Apache License, Version 1.1", "apache"), (LGPL, ""),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc,cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ""),
    (f"{licenses.TEXTS[5][1]} {licenses.TEXTS[7][1]}", "gpl-2,gpl-3"),
]


def test_each_template_has_its_own_label_only(spark):
    rows = [(n, f"zzz yyy {t} xxx") for n, (t, _) in enumerate(LABELLED)]
    got = {r.doc_id: ",".join(r.labels) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: label if label != "apache" else "" for n, (_, label) in enumerate(LABELLED)}


def test_scattered_changes_and_words_put_in(spark):
    words, changed_words, at = licenses.words_of(MIT), [], 0
    for n in [3] * 9 + [2] * 10:  # kept words between changed ones
        changed_words += [*words[at : at + n], "zzz"]
        at += n + 1
    inserted = [" ".join([*words[:35], *["yyy"] * n, *words[35:]]) for n in (6, 40, 400)]
    stray = " ".join([*words[:30], "obtain", "to", "any", "person", "obtaining", *words[30:]])
    rows = list(enumerate([" ".join(changed_words), *inserted, stray]))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.labels == ["mit"] and len(r.spans) == 1 for r in got.values())
    assert got[0].score < 0.8 and all(got[n].score == 1 for n in (1, 2, 3, 4))


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
