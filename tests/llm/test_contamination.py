from wardspark.llm import contamination

from . import brute

ITEMS = [(1, "One two three four five six seven eight nine TEN eleven"), (20, "two three four five six seven eight nine ten eleven twelve"),
         (3, "short item"), (4, ""), (5, None), (6, "Short, item!"), (None, "nameless words"), (7, "é ü")]
DOCS = [(1, "x one two-three four five six seven eight nine ten eleven twelve y"), (2, "a SHORT item and a short item"), (3, None), (4, ""),
        (5, "nothing here"), (6, "É é ü nameless Words"), (6, "É é ü nameless Words"), (None, "short item"), (8, "short " * 3000 + "item")]


def tables(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id long, text string, n_words int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_brute_force(spark):
    docs, items = tables(spark)
    want = []
    for d, t in DOCS:
        n, hit, ids = brute.contamination([(d, t)], ITEMS)[d]
        want.append((d, n, hit, [i for i in ids if i != "None"]))
    for part_words in (1_000_000, 12):
        found = contamination.scan(docs, items, part_words=part_words)
        got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.word_spans), r.item_ids) for r in found.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_offsets_are_of_the_original(spark):
    docs, items = tables(spark)
    row = contamination.scan(docs, items).where("doc_id = 2").first()
    assert [DOCS[1][1][s.start : s.end] for s in row.char_spans] == ["SHORT item", "short item"]


def test_clean_rows_stay_whole(spark):
    docs, items = tables(spark)
    clean = contamination.without_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == [3, 4, 5]


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert contamination.scan(docs.limit(0), items).collect() == []
    assert not any(r.contaminated for r in contamination.digests(contamination.scan(docs, items.limit(0))).collect())


def test_an_item_of_more_words_than_a_part(spark):
    import random

    r = random.Random(2)
    words = [r.choice("abcdefg") + r.choice("hijk") for _ in range(200)]
    items = [(1, " ".join(words)), (2, "zz yy"), (3, " ".join(words[:30]))]
    docs = [(1, " ".join(words[40:52])), (2, " ".join(words[15:24])), (3, "x " + " ".join(words[90:130]) + " y"), (4, "yy zz yy"), (5, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, items)
    for part_words in (1_000_000, 25, 20):
        found = contamination.scan(frame, bench, part_words=part_words).collect()
        assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.word_spans), r.item_ids) for r in found} == want
        clean = contamination.without_contaminated(frame, bench, part_words=part_words).collect()
        assert {r.doc_id for r in clean} == {d for d, (_, hit, _) in want.items() if not hit}


def test_a_very_long_text(spark):
    text = "some words go on " * 300_000 + "one two three four five six seven eight nine ten"
    docs, items = spark.createDataFrame([(1, text, 1)], "doc_id long, text string, n_words int"), tables(spark)[1]
    row = contamination.digests(contamination.scan(docs, items)).first()
    assert (row.n_words, row.n_hit, row.n_items) == (1_200_010, 10, 1)
