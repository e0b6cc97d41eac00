"""Ranked search against a literal reading of its contract."""

import random

import pytest

from talentloom.llm import ranked_search


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in docs], "doc_id long, text string, item_id string, score double")
    return d.repartition(3), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")


def found(spark, docs, items, **how):
    out = ranked_search.ranked_search(*frames(spark, docs, items), **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=repr)


def expected(docs, items, **how):
    return sorted(ranked_search.brute_force(docs, items, **how), key=repr)


def text(rng, n):
    return " ".join(rng.choice(["Alpha", "beta-2", "gamma", "x1", "Ünïcödé", "日本語", "the", "the", "of", f"w{rng.randrange(60)}"]) for _ in range(n))


@pytest.mark.parametrize("most_bytes", [8 << 20, 120])
def test_ranking_is_brute_force(spark, most_bytes):
    rng = random.Random(1)
    docs = [(i, text(rng, rng.choice([1, 5, 40, 300]))) for i in rng.sample(range(60_000), 150)]
    items = [(i, text(rng, rng.choice([1, 4, 30]))) for i in range(8)]
    assert found(spark, docs, items, most_bytes=most_bytes) == expected(docs, items)


def test_ties_repeats_and_odd_texts(spark):
    docs = [(i, "same words here") for i in range(40)] + [(7, "same words here")] * 3 + [(100, None), (101, ""), (102, " \n!?"), (103, "word " * 30000), (104, "SAME A\x01B_c")]
    docs += [(-5, "same"), (None, "same words"), (None, "same words")]
    items = [(1, "same words"), (1, "WORD"), (2, None), (3, "..."), (4, "absent"), (5, "c b a same")]
    assert found(spark, docs, items) == expected(docs, items)
    assert found(spark, docs, items, best=60) == expected(docs, items, best=60)


def test_windows_with_many_rows_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "WINDOW", 16)
    rng = random.Random(2)
    docs = [(rng.choice([3, 3, i]), text(rng, 6)) for i in range(200)]
    items = [(i, text(rng, 5)) for i in range(4)]
    spread = ranked_search.postings(frames(spark, docs, items)[0], {t: k for k, t in enumerate({t for _, x in docs for t in ranked_search.terms_of(x)})})
    assert found(spark, docs, items) == expected(docs, items)
    assert spread.agg({"n_docs": "sum"}).first()[0] == 200


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []
