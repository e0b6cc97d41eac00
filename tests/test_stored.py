"""Bucketed tables and sorted pages against the plain forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from talentloom.operators.stored import Buckets, Searchable, SortedPages, bucket_of, literal_trigrams
from talentloom.operators.writes import upsert

SCHEMA = "id long, resume_id long, job_id long, score int, created_at int, updated_at int"


def files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, i // 7, i % 7, i, 1, 1) for i in range(700)]
    table = Buckets(spark, str(tmp_path / "t"), ["resume_id", "job_id"], 32).create(spark.createDataFrame(rows, SCHEMA))
    new = [(None, *rng.choice([(3, 4), (50, 1), (500, 5)]), 1000 + k, 2, 2 + k) for k in range(6)]
    new = spark.createDataFrame(new, SCHEMA)
    want = sorted(map(tuple, upsert(table.rows(), new, ["resume_id", "job_id"]).collect()), key=repr)
    before = files(tmp_path / "t")
    touched = table.upsert(new)
    after = files(tmp_path / "t")
    assert touched == sorted({r[0] for r in new.select(bucket_of(["resume_id", "job_id"], 32)).collect()}) and len(touched) <= 3
    same = {f for f in before if after.get(f) == before[f]}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in set(before) - same} <= set(touched)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in same} == {int(f.split("bucket=")[1].split("/")[0]) for f in before} - set(touched)
    assert sorted(map(tuple, table.rows().collect()), key=repr) == want
    # again: the same rows, ids kept
    table.upsert(new)
    assert sorted(map(tuple, table.rows().collect()), key=repr) == want
    assert table.find(resume_id=3, job_id=4).count() == 1 and table.find(resume_id=-3, job_id=4).count() == 0
    assert table.upsert(new.limit(0)) == []


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), ["id"], 8).create(spark.range(100).select("id", F.lit("x").alias("v")))
    plan = table.find(id=5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and table.find(id=5).first().id == 5


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_any_page_is_that_of_the_sorted_frame(spark, tmp_path, way):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, rng.randrange(50)])) for i in range(997)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    pages = SortedPages(spark, str(tmp_path / "p"), [("v", way), ("id", way)]).create(df, 9)
    sign = 1 if way == "asc" else -1
    want = sorted(rows, key=lambda r: ((r[1] is not None) * sign, sign * (r[1] or 0), sign * r[0]))
    assert pages.total() == len(rows)
    for number, size in ((1, 100), (2, 100), (10, 100), (11, 100), (50, 13), (997, 1), (998, 1), (3, 7)):
        page = pages.page(number, size)
        assert [tuple(r) for r in page.collect()] == want[(number - 1) * size : number * size], (number, size)
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert (number - 1) * size >= len(rows) or "PartitionFilters" in plan
    with pytest.raises(ValueError):
        pages.page(0, 10)


def test_pages_of_an_empty_frame(spark, tmp_path):
    pages = SortedPages(spark, str(tmp_path / "p"), [("id", "asc")]).create(spark.range(3), 4)
    assert pages.page(1, 10).count() == 3 and pages.page(2, 10).count() == 0


def test_needles_tell_their_trigrams():
    assert literal_trigrams("Data") == ["ata", "dat"] and literal_trigrams("ab") == [] and literal_trigrams("ab%cd_ef") == []
    assert literal_trigrams("abc%de") == ["abc"] and literal_trigrams("ab\\%cde") == ["cde"] and literal_trigrams("İstanbul") == ["anb", "bul", "nbu", "sta", "tan"]


@pytest.mark.parametrize("needle", ["python", "PYTH", "on dev", "zz", "th", "p_thon", "a%b", "Ünï", "50\\%", "absent word", "", "İst", "%", "k"])
def test_search_is_ilike(spark, tmp_path_factory, needle):
    rng = random.Random(3)
    words = ["Python", "developer", "SQL", "Ünïcode", "50%", "İstanbul", "a", "b", "zz", "\u212a", "data", None]
    rows = [(i, " ".join(w for w in rng.choices(words[:-1], k=rng.randrange(5))) if rng.random() < 0.9 else None, rng.choice(words)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, title string, location string")
    table = Searchable(spark, str(tmp_path_factory.mktemp("s") / "t"), ["title", "location"]).create(df, 12)
    like = f"%{needle}%"
    want = {r.id for r in df.filter(F.coalesce(F.col("title").ilike(like), F.lit(False)) | F.coalesce(F.col("location").ilike(like), F.lit(False))).collect()}
    got = table.search(needle)
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(want)


def test_a_rare_word_reads_few_blocks(spark, tmp_path):
    df = spark.range(2000).select("id", F.concat(F.lit("job of group "), (F.col("id") / 100).cast("int").cast("string"), F.when(F.col("id") == 777, " haskell").otherwise("")).alias("title"))
    table = Searchable(spark, str(tmp_path / "t"), ["title"]).create(df, 20)
    assert len(table.blocks("haskell")) == 1 and len(table.blocks("job of")) == 20 and table.blocks("jo") is None
    plan = table.search("haskell")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and table.search("Haskell").first().id == 777
    assert table.blocks("nothing like it") == [] and table.search("nothing like it").count() == 0
