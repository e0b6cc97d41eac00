"""State changes as functions from tables to tables: accepted rows, and rejects with a reason.

A batch has a single writer and may hold any number of requests for one key. They take effect as if they came one by one,
in the order of ``order``'s columns, each seeing what the ones before it left. What decides a key (its first valid request,
its accepted transitions, the last value of a column) is a minimum or maximum. The last value of a column is combined before the
shuffle; transitions and applications are judged by windows over a key's requests, which one sort brings together and which spill:
a key with a third of all requests is one task's work, but no array of them is ever made. Requests that are
alike in all columns come one behind the other. Keys of results are unique if those of the tables are; a request with a
missing key is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentloom.operators.joins import left_by
from talentloom.sources.tables import not_broadcast, written

# From status, to status.
TRANSITIONS = (("Applied", "Shortlisted"), ("Applied", "Rejected"), ("Shortlisted", "Selected"), ("Shortlisted", "Rejected"))


def insert(existing: DataFrame, new: DataFrame, unique: Sequence[str], order: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is free, the first of each key; and the others with ``reason``."""
    first = F.row_number().over(W.partitionBy(*unique).orderBy(*order))
    taken = existing.select(*unique, F.lit(True).alias("taken")).distinct()
    rows = new.withColumn("nth", first).join(taken, list(unique), "left")
    reason = F.when(F.col("taken"), "exists already").when(F.col("nth") > 1, "repeated in the batch")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").select(*new.columns), rows.filter("reason IS NOT NULL").select(*new.columns, "reason")


def _order(requests: DataFrame, order: Sequence[str]) -> Column:
    """What requests are put in order by: the columns of ``order``, then all others."""
    return F.struct(*order, *(c for c in sorted(requests.columns) if c not in order))


def create_applications(requests: DataFrame, jobs: DataFrame, applications: DataFrame, resumes: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Requests (user_id, job_id, resume_id or null, others) with the résumé used, or the reason of refusal.

    The job must exist and not be applied to, nor by an earlier request of the batch that is accepted; a given résumé must be
    the user's own; without one the primary is used. Reasons go in this order.
    """
    own = resumes.select(F.col("id").alias("resume_id"), F.col("user_id").alias("resume_owner"))
    primary = resumes.filter("is_primary").groupBy("user_id").agg(F.min("id").alias("primary_id"))
    rows = left_by(requests.withColumn("turn", _order(requests, order)), own, "resume_id", ["user_id"])
    rows = (
        rows.join(not_broadcast(jobs.select(F.col("id").alias("job_id"), F.lit(True).alias("job_there"))), "job_id", "left")
        .join(not_broadcast(primary), "user_id", "left")
        .join(not_broadcast(applications.select("user_id", "job_id", F.lit(True).alias("applied")).distinct()), ["user_id", "job_id"], "left")
    )
    chosen = F.coalesce("resume_id", "primary_id")
    before = F.when(F.col("user_id").isNull(), "no such user").when(F.col("job_there").isNull(), "no such job").when(F.col("applied"), "applied already")
    wrong = F.when(F.col("resume_id").isNotNull() & ~F.coalesce(F.col("resume_owner") == F.col("user_id"), F.lit(False)), "no such resume").when(chosen.isNull(), "no primary resume")
    rows = rows.withColumns({"before": before, "wrong": wrong, "chosen": chosen})
    pair = W.partitionBy("user_id", "job_id")
    winner = F.min(F.when(F.col("before").isNull() & F.col("wrong").isNull(), F.col("turn"))).over(pair)
    rows = rows.withColumns({"winner": winner, "nth": F.row_number().over(pair.orderBy("turn"))})
    wins = F.coalesce(F.col("turn") == F.col("winner"), F.lit(False))
    # of requests alike in all columns the first wins
    alike = F.min("nth").over(W.partitionBy("user_id", "job_id", "turn"))
    again = F.when((F.col("turn") > F.col("winner")) | wins & (F.col("nth") > F.col("alike")), "repeated in the batch")
    rows = rows.withColumn("alike", alike).withColumn("reason", F.coalesce("before", again, "wrong"))
    return rows.select("user_id", "job_id", F.when(F.col("reason").isNull(), F.col("chosen")).alias("resume_id"), "reason", *(c for c in requests.columns if c not in ("user_id", "job_id", "resume_id")))


def application_rows(judged: DataFrame, next_id: int, at: Column) -> tuple[DataFrame, DataFrame]:
    """The applications that ``create_applications`` accepted, with ids from ``next_id`` on, and the first entry of each one's history.

    Ids are unique and have gaps: numbers without gaps would put all rows into one task. They are written once, so both tables have the same.
    """
    number = (F.lit(next_id) + F.monotonically_increasing_id()).alias("id")
    rows = written(judged.filter("reason IS NULL").select(number, "user_id", "job_id", "resume_id", F.lit("Applied").alias("status"), at.alias("applied_at")), "applications")
    history = rows.select(F.col("id").alias("application_id"), F.lit(None).cast("string").alias("old_status"), F.col("status").alias("new_status"), F.col("user_id").alias("changed_by"), F.col("applied_at").alias("changed_at"))
    return rows, history


def update(existing: DataFrame, changes: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """Partial updates: changes has the key, ``changed`` (names of supplied columns), values, and the columns of ``order``.

    A supplied null is a null; a column that isn't named keeps its value. Of several changes of a key each column takes the last
    value that one of them supplies.
    """
    fields = [c for c in changes.columns if c in existing.columns and c != key and c not in order]
    last = [F.max(F.when(F.array_contains("changed", c), F.struct(*order, F.col(c).alias("value")))).alias(f"new_{c}") for c in fields]
    new = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(*last) if fields else changes.select(key).distinct()
    rows = existing.join(new, key, "left")
    value = lambda c: F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}.value")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
    return rows.select(*(value(c) for c in existing.columns))


def update_rejects(existing: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The changes of rows that aren't there, with ``reason``."""
    reason = F.when(F.col(key).isNull(), "no key").otherwise("no such row").alias("reason")
    return changes.join(existing.select(key), key, "left_anti").select(*changes.columns, reason)


def transition_problem(old: Column, new: Column) -> Column:
    """Why a status may not follow another, or null."""
    allowed = F.lit(False)
    for a, b in TRANSITIONS:
        allowed = allowed | ((old == a) & (new == b))
    return F.when(old == new, "same status").when(~F.coalesce(allowed, F.lit(False)), "not allowed")


def longest_path(transitions: Sequence[tuple[str, str]] = TRANSITIONS) -> int:
    """How often a status can change."""
    after: dict[str, list[str]] = {}
    for a, b in transitions:
        after.setdefault(a, []).append(b)
    steps = lambda s: max((1 + steps(t) for t in after.get(s, ())), default=0)
    return max(map(steps, after), default=0)


def managers(applications: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """id of each application and owner_id, the owner of its job's company (null: the job or the company isn't there)."""
    posts = jobs.select(F.col("id").alias("job_id"), "company_id").join(companies.select(F.col("id").alias("company_id"), "owner_id"), "company_id", "left")
    return applications.select("id", "job_id").join(posts, "job_id", "left").select("id", "owner_id")


def _admins(users: DataFrame, alias: str) -> DataFrame:
    return users.filter(F.lower("role") == "admin").select(F.col("id").alias(alias), F.lit(True).alias("admin")).distinct()


def judge_status(applications: DataFrame, requests: DataFrame, owners: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """Requests (id, new_status, changed_by, changed_at) with ``old_status``, the status that each met, and ``reason`` (null: accepted).

    With ``owners`` (as of ``managers``) and ``users``, only an admin or the owner may ask. Requests for one application take their
    turns by changed_at: one is judged against the status that the accepted ones before it left. A status can change only
    ``longest_path`` times, so in as many rounds all accepted requests are found, each the first that fits the status of its round.
    A round is a minimum over the requests of an application where they stand: they are put together and sorted once, and nothing is
    worked out again for the next round.
    """
    turn = F.struct("changed_at", "new_status", "changed_by")
    rows = requests.select("id", "new_status", "changed_by", "changed_at")
    rows = rows.join(not_broadcast(applications.select("id", F.col("status").alias("status_0"), F.lit(True).alias("there"))), "id", "left")
    may = F.lit(True)
    if owners is not None:
        rows = rows.join(not_broadcast(owners.select("id", "owner_id")), "id", "left").join(_admins(users, "changed_by"), "changed_by", "left")
        may = F.coalesce("admin", F.lit(False)) | F.coalesce(F.col("owner_id") == F.col("changed_by"), F.lit(False))
    rows = rows.select("id", "new_status", "changed_by", "changed_at", "status_0", F.when(F.col("there").isNull(), "no such application").when(~may, "no permission").alias("outside"))
    rows = rows.withColumns({"turn": turn, "nth": F.row_number().over(W.partitionBy("id", "changed_at", "new_status", "changed_by").orderBy("changed_at"))})
    fits = lambda old: F.col("outside").isNull() & transition_problem(old, F.col("new_status")).isNull()
    accepted, old = F.lit(False), F.col("status_0")
    for k in range(1, longest_path() + 1):
        late = F.lit(True) if k == 1 else F.col("turn") > F.col(f"turn_{k - 1}")
        status = F.col("status_0") if k == 1 else F.col(f"turn_{k - 1}.new_status")
        rows = rows.withColumn(f"turn_{k}", F.min(F.when(fits(status) & late, F.col("turn"))).over(W.partitionBy("id")))
        accepted = accepted | F.coalesce(F.col("turn") == F.col(f"turn_{k}"), F.lit(False))
        old = F.when(F.col("turn") > F.col(f"turn_{k}"), F.col(f"turn_{k}.new_status")).otherwise(old)
    rows = rows.withColumns({"old_status": old, "accepted": accepted})
    # a request that is like an accepted one asks for the status that is there then
    again = F.col("accepted") & (F.col("nth") > 1)
    reason = F.when(again, "same status").when(~F.col("accepted"), F.coalesce("outside", transition_problem(F.col("old_status"), F.col("new_status"))))
    return rows.select("id", "new_status", "changed_by", "changed_at", F.when(again, F.col("new_status")).otherwise(F.col("old_status")).alias("old_status"), reason.alias("reason"))


def change_status(applications: DataFrame, requests: DataFrame, owners: DataFrame | None = None, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Applications after requests, the history, and the rejects, as ``judge_status`` tells them."""
    rows = judge_status(applications, requests, owners, users)
    good = rows.filter("reason IS NULL")
    last = good.groupBy("id").agg(F.max(F.struct("changed_at", "new_status", "changed_by"))["new_status"].alias("new_status"))
    table = applications.join(not_broadcast(last), "id", "left").withColumn("status", F.coalesce("new_status", "status")).select(applications.columns)
    history = good.select(F.col("id").alias("application_id"), "old_status", "new_status", "changed_by", "changed_at")
    return table, history, rows.filter("reason IS NOT NULL").select("id", "new_status", "changed_by", "changed_at", "old_status", "reason")


def delete_applications(applications: DataFrame, requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The applications left, and requests (id, caller_id) with the reason of refusal, or null: applicants and admins may, owners of jobs not."""
    rows = requests.join(applications.select("id", "user_id", F.lit(True).alias("there")), "id", "left").join(_admins(users, "caller_id"), "caller_id", "left")
    own = F.coalesce(F.col("user_id") == F.col("caller_id"), F.lit(False))
    reason = F.when(F.col("there").isNull(), "no such application").when(~own & F.col("admin").isNull(), "no permission")
    rows = rows.select("id", "caller_id", reason.alias("reason"))
    return applications.join(rows.filter("reason IS NULL").select("id"), "id", "left_anti").select(applications.columns), rows


def log_rejects(log: DataFrame) -> DataFrame:
    """Entries of a status log that don't follow from the one before."""
    before = F.lag("new_status").over(W.partitionBy("application_id").orderBy("changed_at", "id"))
    rows = log.withColumn("old_status", before)
    return rows.withColumn("reason", transition_problem(F.col("old_status"), F.col("new_status"))).filter("old_status IS NOT NULL AND reason IS NOT NULL")


def delete_restricted(parents: DataFrame, ids: DataFrame, children: DataFrame, foreign_key: str) -> tuple[DataFrame, DataFrame]:
    """The parents left, and those that couldn't go because a child refers to them."""
    used = ids.select("id").join(children.select(F.col(foreign_key).alias("id")), "id", "left_semi")
    gone = ids.select("id").join(used, "id", "left_anti")
    return parents.join(gone, "id", "left_anti"), parents.join(used, "id", "left_semi")


def delete_cascade(children: DataFrame, deleted: DataFrame, foreign_key: str) -> DataFrame:
    """Children without those of deleted parents."""
    return children.join(deleted.select(F.col("id").alias(foreign_key)), foreign_key, "left_anti").select(children.columns)


def delete_set_null(children: DataFrame, deleted: DataFrame, foreign_key: str, deal: Sequence[str] = ()) -> DataFrame:
    """Children, their key null where the parent is deleted; ``deal`` as of ``left_by``."""
    gone = deleted.select(F.col("id").alias(foreign_key), F.lit(True).alias("gone"))
    rows = left_by(children, gone, foreign_key, deal).withColumn(foreign_key, F.when(F.col("gone").isNull(), F.col(foreign_key)))
    return rows.select(children.columns)


def delete_users(users: DataFrame, requests: DataFrame, companies: DataFrame) -> DataFrame:
    """Requests (id, caller_id) with the reason of refusal, or null: self or admin, admins not themselves, owners not."""
    roles = users.select(F.col("id").alias("caller_id"), F.lower("role").alias("caller_role"))
    rows = requests.join(users.select("id", F.lit(True).alias("there")), "id", "left").join(roles, "caller_id", "left")
    rows = rows.join(companies.select(F.col("owner_id").alias("id"), F.lit(True).alias("owns")).distinct(), "id", "left")
    admin = F.coalesce(F.col("caller_role") == "admin", F.lit(False))
    reason = F.when(F.col("there").isNull(), "no such user").when((F.col("id") != F.col("caller_id")) & ~admin, "not allowed").when((F.col("id") == F.col("caller_id")) & admin, "admins can't delete themselves").when(F.col("owns"), "owns companies")
    return rows.select("id", "caller_id", reason.alias("reason"))


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str], kept: Sequence[str] = ("id", "created_at"), order: str = "updated_at") -> DataFrame:
    """One row a key: the latest new row, with the kept columns of the row it replaces."""
    latest = F.row_number().over(W.partitionBy(*key).orderBy(F.col(order).desc()))
    fresh = new.withColumn("nth", latest).filter("nth = 1").drop("nth")
    old = existing.select(*key, *(F.col(c).alias(f"old_{c}") for c in kept))
    merged = fresh.join(not_broadcast(old), list(key), "left").select(*(F.coalesce(f"old_{c}", c).alias(c) if c in kept else F.col(c) for c in existing.columns))
    return existing.join(not_broadcast(fresh.select(*key)), list(key), "left_anti").select(existing.columns).unionByName(merged)


def primary_requests(resumes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Requests (user_id, resume_id, others) with ``reason``: null if the résumé is the user's own."""
    own = resumes.select(F.col("id").alias("resume_id"), "user_id", F.lit(True).alias("own"))
    rows = chosen.join(own, ["resume_id", "user_id"], "left")
    return rows.select(*chosen.columns, F.when(F.col("own").isNull(), "no such resume").alias("reason"))


def set_primary(resumes: DataFrame, chosen: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Makes the résumé of the user's last valid request (user_id, resume_id, order) the only primary one of its user.

    Requests for résumés that aren't the user's own change nothing; ``primary_requests`` has them with the reason.
    """
    valid = primary_requests(resumes, chosen).filter("reason IS NULL")
    last = valid.groupBy("user_id").agg(F.max(F.struct(*order, F.col("resume_id")))["resume_id"].alias("resume_id"))
    rows = resumes.join(last, "user_id", "left")
    return rows.withColumn("is_primary", F.when(F.col("resume_id").isNull(), F.col("is_primary")).otherwise(F.col("id") == F.col("resume_id"))).select(resumes.columns)
