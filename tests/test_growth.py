"""What shows only on larger tables: plans that send rows through the driver, keys that most rows share, small files."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from talentloom.functions import text
from talentloom.operators import parsing, scoring, writes
from talentloom.operators.joins import left_by


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """The star schema, a few rows a table, with keys beyond those of sf0.1."""
    folder = str(tmp_path_factory.mktemp("star"))
    day = F.expr("timestamp_ntz'2022-06-01 00:00:00' + make_dt_interval(CAST(id % 900 AS INT))")
    make = {
        "customer": spark.range(0, 410_000, 997).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")),
        "supplier": spark.range(100).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), (F.col("id") % 25).cast("int").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")),
        "part": spark.range(200).select(F.col("id").alias("p_partkey"), F.lit("widget").alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(900.0).alias("p_retailprice")),
        "orders": spark.range(2000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 401 * 997).alias("o_custkey"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")),
        "lineitem": spark.range(6000).select((F.col("id") % 2000).alias("l_orderkey"), (F.col("id") * 7 % 200).alias("l_partkey"), (F.col("id") % 100).alias("l_suppkey"), F.when(F.col("id") % 3 == 0, "A").otherwise("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), day.alias("l_shipdate")),
    }
    for name, rows in make.items():
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["analysis_scores", "match_scores", "parse_into_results"])
def test_texts_and_features_are_not_broadcast(spark, small, name):
    assert "array<" not in "".join(x for x in plan(queries()[name](spark, small)).split("\n") if "BroadcastExchange" in x)
    joins = [x for x in plan(queries()[name](spark, small)).split("\n") if "BroadcastHashJoin" in x]
    assert not [x for x in joins if "resume_id" in x], joins


def test_a_number_and_two_digits_are_no_number_with_a_prefix(spark, small):
    """6,000,000,000 + key * 7919 begins with 91 from 392,000 on."""
    rows = queries()["contacts_of_texts"](spark, small).filter("id % 4 = 3 AND phone != '-'")
    assert rows.count() == 0


def test_requests_are_worked_out_once(spark):
    """Rounds and winners are windows: nothing that requests hang on is read again for them."""
    requests = spark.range(0, 777).select("id", F.lit("Rejected").alias("new_status"), F.lit(0).cast("long").alias("changed_by"), F.current_timestamp().alias("changed_at"))
    applications = spark.range(0, 555).select("id", F.lit("Applied").alias("status"), F.col("id").alias("job_id"), F.col("id").alias("user_id"))
    assert plan(writes.judge_status(applications, requests)).count("Range (0, 777") == 1
    asked = spark.range(0, 777).select(F.col("id").alias("user_id"), F.lit(1).cast("long").alias("job_id"), F.lit(None).cast("long").alias("resume_id"))
    resumes = spark.range(0, 333).select("id", F.col("id").alias("user_id"), F.lit(True).alias("is_primary"))
    assert plan(writes.create_applications(asked, spark.range(9), applications, resumes)).count("Range (0, 777") == 1


def test_rows_without_a_key_are_dealt_out(spark):
    rows = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("resume_id"))
    other = spark.range(500).select(F.col("id").alias("resume_id"), F.lit("x").alias("found"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = left_by(rows, other, "resume_id").withColumn("part", F.spark_partition_id())
        got = joined.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r.id, r.resume_id, r.found) for r in got) == [(i, i if i % 10 == 0 else None, "x" if i % 10 == 0 and i < 500 else None) for i in range(1000)]
    in_part = [sum(r.part == p for r in got) for p in range(4)]
    assert max(in_part) < 500, in_part


@pytest.mark.parametrize("name", ["employer_dashboard_record", "whole_deletions", "status_chain_applied", "status_chain_outcomes", "status_change_applied"])
def test_applications_are_put_together_once(spark, small, name):
    assert "lineitem" not in plan(queries()[name](spark, small))


@pytest.mark.parametrize("name", ["project_shares", "resume_file_texts"])
def test_rows_of_a_small_file_are_dealt_to_all_cores(spark, small, name):
    assert "RoundRobinPartitioning" in plan(queries()[name](spark, small))


def test_users_come_before_jobs(spark, small):
    """The user's key has brought the rows together already for the primary résumé."""
    text = plan(queries()["applications_with_resume"](spark, small))
    assert text.index("customer.parquet") < text.index("part.parquet"), text


def test_texts_are_cleaned_in_pieces(spark):
    """Over several pieces of a batch nothing is lost or mixed up, nor in an empty one."""
    texts = [f"a line {k} of text that\nwas wrapped , here" for k in range(2 * parsing._PIECE + 7)]
    got = parsing.repaired.func(pa.array(texts, pa.string())).to_pylist()
    assert got == [{"once": parsing.clean(t), "twice": parsing.clean(parsing.clean(t))} for t in texts]
    assert len(parsing.repaired.func(pa.array([], pa.string()))) == 0


def test_pairs_of_the_same_kinds_are_scored_once(spark, small):
    """Nothing that pairs and features hang on is read again, and scores are joined by two numbers."""
    shown = plan(queries()["match_scores"](spark, small))
    assert not [t for t in ("customer", "part.parquet", "lineitem") if t in shown] and "resume_kind" in shown


def test_features_are_worked_out_once(spark):
    jobs = spark.createDataFrame([(1, "a", "b", ["sql", "weaving"])], "id int, title string, description string, skills array<string>")
    resumes = spark.createDataFrame([(1, "sql and weaving", "{}")], "resume_id int, extracted_text string, parsed_data string")
    got = scoring.features(resumes, jobs)
    assert all("Python" not in plan(df) for df in got)
    assert [r.resume_keywords for r in got[0].collect()] == [["weaving"]]


def test_words_alone_are_those_of_cleaned_tokens(spark):
    """One pass gives what cleaning each token does; skills that call for no keyword are told beforehand."""
    marks = ["", " ", "/", "//", ".", "..", "./", "/.", "+", "#", "-", "3", "a", ", ", "(", "7/", "-."]
    rows = spark.createDataFrame([(f"{a}{w}{b}{v}{c}",) for w, v in (("testing", "unit"), ("full-stack", "code")) for a in marks for b in marks for c in marks], "t string")
    rows = rows.select(text.normalize(F.col("t")).alias("t"))
    tokens = F.transform(F.regexp_extract_all("t", F.lit("[a-z][a-z0-9+#./-]*"), F.lit(0)), text.clean_keyword)
    before = F.array_sort(F.array_intersect(tokens, text.words_of(scoring.WORDS)))
    after = F.array_sort(F.array_distinct(text.words_alone(F.col("t"), scoring.WORDS)))
    assert rows.filter(before != after).collect() == [] and rows.filter(F.size(after) > 0).count() > 1000
    known = spark.createDataFrame([(s,) for s in scoring.NO_KEYWORD], "s string").select(text.keyword_alias(F.col("s")).alias("k"))
    assert known.filter(text.meaningful(F.col("k")) & ~text.canonical_skill(F.col("k")).isin(*text.TECHNICAL)).collect() == []


def test_requests_for_scores_are_judged_once(spark, small):
    """Scored and refused ones are read from what was judged; applications aren't put together again, nor results read."""
    shown = plan(queries()["analysis_outcomes"](spark, small))
    assert not [t for t in ("customer", "part.parquet", "lineitem") if t in shown]


@pytest.mark.parametrize("name,other", [("parse_resume_projects", "CGPA"), ("parse_resume_education", "tech"), ("parse_resume_experience", "CGPA")])
def test_fields_that_are_not_asked_for_are_not_worked_out(spark, small, name, other):
    patterns = {"CGPA": "CGPA|GPA", "tech": "technologies"}
    assert patterns[other] not in plan(queries()[name](spark, small))
