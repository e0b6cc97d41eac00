"""Batches with several requests for one key, foreign and missing keys, against a plain loop over the requests."""

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from talentloom.operators import writes

DAY = datetime.datetime(2024, 1, 1)


def at(day):
    return DAY + datetime.timedelta(days=day)


def status_requests(spark, rows):
    return spark.createDataFrame([(i, s, who, at(d)) for i, s, who, d in rows], "id long, new_status string, changed_by long, changed_at timestamp_ntz")


def test_a_chain_in_one_batch_is_accepted(spark):
    apps = spark.createDataFrame([(1, "Applied"), (2, "Applied")], "id long, status string")
    asked = [(1, "Selected", 7, 3), (1, "Shortlisted", 7, 1), (2, "Rejected", 7, 2), (2, "Shortlisted", 7, 1), (2, "Selected", 7, 3)]
    after, history, rejects = writes.change_status(apps, status_requests(spark, asked))
    assert {r.id: r.status for r in after.collect()} == {1: "Selected", 2: "Rejected"}
    assert sorted((r.application_id, r.old_status, r.new_status) for r in history.collect()) == [(1, "Applied", "Shortlisted"), (1, "Shortlisted", "Selected"), (2, "Applied", "Shortlisted"), (2, "Shortlisted", "Rejected")]
    assert [(r.id, r.old_status, r.new_status, r.reason) for r in rejects.collect()] == [(2, "Rejected", "Selected", "not allowed")]


def test_status_requests_are_a_loop(spark):
    rng = random.Random(1)
    statuses = ["Applied", "Shortlisted", "Rejected", "Selected", "Withdrawn", None]
    apps = {i: rng.choice(statuses[:5]) for i in range(60)}
    jobs = [(j, j % 3 if j else None) for j in range(6)]
    companies = [(0, 100), (1, 101)]
    users = [(100, "Employer"), (101, "employer"), (5, "ADMIN"), (6, "Candidate")]
    asked = [(rng.choice([*range(30), 3, 3, 3, 999, None]), rng.choice(statuses), rng.choice([100, 101, 5, 6, None]), rng.randrange(8)) for _ in range(600)]
    asked += asked[:60]  # alike
    of_job = {i: i % 7 for i in apps}
    owner = {i: dict(companies).get(dict(jobs).get(j)) for i, j in of_job.items()}
    now, want = dict(apps), []
    key = lambda r: (r[3], r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0)
    for i, s, who, d in sorted(asked, key=key):
        if i not in now:
            want.append((i, s, who, d, None, "no such application"))
        elif who != 5 and (who is None or owner[i] != who):
            want.append((i, s, who, d, now[i], "no permission"))
        elif s == now[i]:
            want.append((i, s, who, d, now[i], "same status"))
        elif (now[i], s) not in writes.TRANSITIONS:
            want.append((i, s, who, d, now[i], "not allowed"))
        else:
            want.append((i, s, who, d, now[i], None))
            now[i] = s
    table = spark.createDataFrame([(i, of_job[i], s) for i, s in apps.items()], "id long, job_id long, status string")
    owners = writes.managers(table, spark.createDataFrame(jobs, "id long, company_id long"), spark.createDataFrame(companies, "id long, owner_id long"))
    after, history, rejects = writes.change_status(table, status_requests(spark, asked), owners, spark.createDataFrame(users, "id long, role string"))
    assert {r.id: r.status for r in after.collect()} == now and after.count() == len(apps)
    got = [(r.application_id, r.new_status, r.changed_by, (r.changed_at - DAY).days, r.old_status, None) for r in history.collect()]
    got += [(r.id, r.new_status, r.changed_by, (r.changed_at - DAY).days, r.old_status, r.reason) for r in rejects.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_applications_are_a_loop(spark):
    rng = random.Random(2)
    jobs, resumes = list(range(5)), [(10 * u + k, u, k == 0 and u != 3) for u in range(6) for k in range(3)]
    there = [(1, 1), (1, 1), (2, 0)]
    asked = [(rng.choice([*range(6), None]), rng.choice([*range(6), None]), rng.choice([None, None, rng.randrange(60)]), k // 2) for k in range(300)]
    asked += asked[:40]
    primary = {u: r for r, u, p in resumes if p}
    done, want = set(there), []
    for u, j, r, k in sorted(asked, key=lambda x: (x[3], *((v is not None, v or 0) for v in (x[1], x[2], x[0])))):
        own = any(x[0] == r and x[1] == u for x in resumes)
        if u is None:
            reason = "no such user"
        elif j not in jobs:
            reason = "no such job"
        elif (u, j) in done:
            reason = "applied already" if (u, j) in there else "repeated in the batch"
        elif r is not None and not own:
            reason = "no such resume"
        elif r is None and u not in primary:
            reason = "no primary resume"
        else:
            reason = None
            done.add((u, j))
        want.append((u, j, None if reason else r if r is not None else primary[u], reason, k))
    rows = writes.create_applications(
        spark.createDataFrame(asked, "user_id long, job_id long, resume_id long, asked long"),
        spark.createDataFrame([(j,) for j in jobs], "id long"),
        spark.createDataFrame(there, "user_id long, job_id long"),
        spark.createDataFrame(resumes, "id long, user_id long, is_primary boolean"),
        ["asked"],
    ).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    good = [(r.user_id, r.job_id) for r in rows if r.reason is None]
    assert len(good) == len(set(good)) and not set(good) & set(there)


def test_accepted_applications_begin_their_history(spark):
    judged = spark.createDataFrame([(1, 2, 3, None), (1, 3, 3, None), (4, 2, None, "no such job"), (5, 6, 7, None)], "user_id long, job_id long, resume_id long, reason string").repartition(3)
    rows, history = writes.application_rows(judged, 1000, F.lit(DAY))
    got = {r.id: (r.user_id, r.job_id, r.resume_id, r.status) for r in rows.collect()}
    assert sorted(got.values()) == [(1, 2, 3, "Applied"), (1, 3, 3, "Applied"), (5, 6, 7, "Applied")] and min(got) >= 1000
    assert {r.application_id: (r.old_status, r.new_status, r.changed_by) for r in history.collect()} == {i: (None, "Applied", v[0]) for i, v in got.items()}


def test_changes_of_one_row_add_up(spark):
    jobs = spark.createDataFrame([(1, "a", Decimal("1.00")), (2, "b", None), (3, None, Decimal("3.00"))], "id long, title string, salary decimal(10,2)")
    changes = [(1, ["title"], "x", None, 2), (1, ["salary", "title"], "early", Decimal("5.00"), 1), (2, ["title"], "z", None, 1), (2, ["title"], None, None, 2), (9, ["title"], "q", None, 1), (None, ["title"], "q", None, 1), (3, [], "unused", None, 1)]
    changes = spark.createDataFrame(changes, "id long, changed array<string>, title string, salary decimal(10,2), at int")
    got = sorted(map(tuple, writes.update(jobs, changes, order=["at"]).collect()))
    assert got == [(1, "x", Decimal("5.00")), (2, None, None), (3, None, Decimal("3.00"))]
    assert {(r.id, r.reason) for r in writes.update_rejects(jobs, changes).collect()} == {(9, "no such row"), (None, "no key")}


def test_only_own_resumes_become_primary(spark):
    resumes = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 8, True), (4, 9, False)], "id long, user_id long, is_primary boolean")
    asked = spark.createDataFrame([(7, 3, 9), (8, 4, 1), (9, 4, 1), (None, 1, 1), (7, 2, 1), (7, 1, 2), (7, 2, 3), (7, None, 4)], "user_id long, resume_id long, at int")
    got = {r.id: r.is_primary for r in writes.set_primary(resumes, asked, ["at"]).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}
    told = sorted((r.user_id or 0, r.resume_id or 0, r.reason) for r in writes.primary_requests(resumes, asked).collect() if r.reason)
    assert told == [(0, 1, "no such resume"), (7, 0, "no such resume"), (7, 3, "no such resume"), (8, 4, "no such resume")]


def test_who_may_delete_applications(spark):
    apps = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "id long, user_id long")
    users = spark.createDataFrame([(7, "Candidate"), (8, "Candidate"), (1, "Admin")], "id long, role string")
    asked = spark.createDataFrame([(1, 7), (1, 1), (2, 7), (2, None), (3, 1), (5, 1), (None, 1)], "id long, caller_id long")
    left, rows = writes.delete_applications(apps, asked, users)
    assert [r.id for r in left.collect()] == [2]
    assert sorted(((r.id or 0), r.caller_id or 0, r.reason or "") for r in rows.collect()) == [(0, 1, "no such application"), (1, 1, ""), (1, 7, ""), (2, 0, "no permission"), (2, 7, "no permission"), (3, 1, ""), (5, 1, "no such application")]


def test_no_requests_no_change(spark):
    apps = spark.createDataFrame([(1, "Applied")], "id long, status string")
    after, history, rejects = writes.change_status(apps, status_requests(spark, []))
    assert after.count() == 1 and history.count() == 0 and rejects.count() == 0
