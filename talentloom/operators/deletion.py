"""Whole deletions: rows go with all that hangs on them, over every table at once.

The foreign keys make a graph. From the rows that are to go it is walked in order of dependence: along CASCADE the rows that
refer to doomed ones are doomed too, each together with the request that dooms it. A RESTRICT on the way, a row that refers to a
doomed one, vetoes the request, and then nothing goes because of it. Rows that stay and refer to deleted ones along SET NULL
lose that reference. Each step is one join by a key over all requests; a request whose row has a third of a table hanging on it is a
join with one frequent key, which Spark splits.

Every request is judged by the tables as they were. Missing keys refer to nothing. A row that two requests doom goes if one of them
is granted.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.operators.joins import left_by


class Key(NamedTuple):
    child: str
    column: str
    parent: str
    rule: str  # cascade, restrict or set null


# The marketplace's references and what becomes of a row whose parent goes.
FOREIGN_KEYS = (
    Key("profiles", "user_id", "users", "cascade"),
    Key("companies", "owner_id", "users", "restrict"),
    Key("jobs", "company_id", "companies", "restrict"),
    Key("applications", "job_id", "jobs", "restrict"),
    Key("applications", "user_id", "users", "cascade"),
    Key("applications", "resume_id", "resumes", "set null"),
    Key("saved_jobs", "user_id", "users", "cascade"),
    Key("saved_jobs", "job_id", "jobs", "cascade"),
    Key("resumes", "user_id", "users", "cascade"),
    Key("parsing_results", "resume_id", "resumes", "cascade"),
    Key("analyses", "resume_id", "resumes", "cascade"),
    Key("analyses", "job_id", "jobs", "cascade"),
    Key("status_history", "application_id", "applications", "cascade"),
    Key("status_history", "changed_by", "users", "set null"),
)


def below(root: str, keys: tuple[Key, ...] = FOREIGN_KEYS) -> list[str]:
    """The tables that rows of ``root`` can take with them, itself first, each behind all that can doom its rows."""
    reached, waiting = {root}, [root]
    while waiting:
        at = waiting.pop()
        more = {k.child for k in keys if k.parent == at and k.rule == "cascade"} - reached
        reached |= more
        waiting += more
    order: list[str] = []
    while len(order) < len(reached):
        ready = [t for t in sorted(reached - set(order)) if all(k.parent in order or k.parent not in reached or k.parent == t for k in keys if k.child == t and k.rule == "cascade")]
        if not ready:
            raise ValueError(f"tables doom each other: {sorted(reached - set(order))}")
        order += ready
    return order


def delete_rows(tables: Mapping[str, DataFrame], root: str, ids: DataFrame, keys: tuple[Key, ...] = FOREIGN_KEYS) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables after the rows of ``root`` with these ids went, and the ids with the reason of refusal, or null.

    Every table has an ``id``. Keys of tables that aren't given are passed over.
    """
    keys = tuple(k for k in keys if k.child in tables and k.parent in tables)
    asked = ids.select("id").distinct()
    known = asked.join(tables[root].select("id"), "id", "left_semi")
    doomed = {root: known.select("id", F.col("id").alias("request"))}
    refers = lambda k: tables[k.child].select(F.col("id").alias("child"), F.col(k.column).alias("id")).filter("id IS NOT NULL")
    for table in below(root, keys)[1:]:
        found = [refers(k).join(doomed[k.parent], "id").select(F.col("child").alias("id"), "request") for k in keys if k.child == table and k.rule == "cascade" and k.parent in doomed]
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        doomed[table] = every.distinct() if len(found) > 1 else every
    vetoes = [doomed[k.parent].join(refers(k).select("id").distinct(), "id", "left_semi").select("request", F.lit(k.child).alias("by")).distinct() for k in keys if k.rule == "restrict" and k.parent in doomed]
    vetoed = asked.select(F.col("id").alias("request"), F.lit("").alias("by")).limit(0)
    for more in vetoes:
        vetoed = vetoed.unionByName(more)
    vetoed = vetoed.groupBy("request").agg(F.array_join(F.array_sort(F.collect_set("by")), ", ").alias("by"))
    gone = {t: rows.join(vetoed, "request", "left_anti").select("id").distinct() for t, rows in doomed.items()}

    after = {}
    for name, table in tables.items():
        rows = table.join(gone[name], "id", "left_anti") if name in gone else table
        for k in keys:
            if k.child == name and k.rule == "set null" and k.parent in gone:
                lost = gone[k.parent].select(F.col("id").alias(k.column), F.lit(True).alias("lost"))
                rows = left_by(rows, lost, k.column).withColumn(k.column, F.when(F.col("lost").isNull(), F.col(k.column))).drop("lost")
        after[name] = rows.select(table.columns)
    told = asked.join(known.withColumn("there", F.lit(True)), "id", "left").join(vetoed.withColumnRenamed("request", "id"), "id", "left")
    reason = F.when(F.col("there").isNull(), "no such row").when(F.col("by").isNotNull(), F.concat(F.lit("in use by "), F.col("by")))
    return after, told.select("id", reason.alias("reason"))
