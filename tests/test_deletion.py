"""Whole deletions against a walk over dictionaries."""

import random

import pytest

from talentloom.operators import deletion

TABLES = ("users", "profiles", "companies", "jobs", "applications", "saved_jobs", "resumes", "parsing_results", "analyses", "status_history")


def rows_of(rng, sizes):
    """Each table as {id: {column: reference or None}}."""
    out = {}
    for t in TABLES:
        keys = [k for k in deletion.FOREIGN_KEYS if k.child == t]
        out[t] = {i: {k.column: rng.choice([*range(sizes[k.parent]), None]) for k in keys} for i in range(sizes[t])}
    return out


def plain(tables, root, ids):
    """One request after another, each against the tables as they were at first."""
    gone, reasons = {t: set() for t in TABLES}, {}
    for i in ids:
        if i not in tables[root]:
            reasons[i] = "no such row"
            continue
        doomed, waiting, by = {(root, i)}, [(root, i)], set()
        while waiting:
            t, x = waiting.pop()
            for k in deletion.FOREIGN_KEYS:
                if k.parent != t:
                    continue
                for child, row in tables[k.child].items():
                    if row[k.column] != x:
                        continue
                    if k.rule == "restrict":
                        by.add(k.child)
                    elif k.rule == "cascade" and (k.child, child) not in doomed:
                        doomed.add((k.child, child))
                        waiting.append((k.child, child))
        reasons[i] = f"in use by {', '.join(sorted(by))}" if by else None
        if not by:
            for t, x in doomed:
                gone[t].add(x)
    after = {}
    for t, rows in tables.items():
        null = [k for k in deletion.FOREIGN_KEYS if k.child == t and k.rule == "set null"]
        after[t] = {i: {c: None if any(k.column == c and v in gone[k.parent] for k in null) else v for c, v in row.items()} for i, row in rows.items() if i not in gone[t]}
    return after, reasons


@pytest.mark.parametrize("root,seed", [("users", 1), ("resumes", 2), ("jobs", 3), ("companies", 4)])
def test_deletions_are_a_walk(spark, root, seed):
    rng = random.Random(seed)
    tables = rows_of(rng, {"users": 12, "profiles": 8, "companies": 4, "jobs": 9, "applications": 14, "saved_jobs": 15, "resumes": 12, "parsing_results": 10, "analyses": 15, "status_history": 30})
    ids = [*range(0, 14, 2), 2, 99, None]
    want, reasons = plain(tables, root, set(ids))
    frames = {t: spark.createDataFrame([(i, *row.values(), "other") for i, row in rows.items()], ", ".join(["id long", *(f"{k.column} long" for k in deletion.FOREIGN_KEYS if k.child == t), "more string"])) for t, rows in tables.items()}
    after, told = deletion.delete_rows(frames, root, spark.createDataFrame([(i,) for i in ids], "id long"))
    assert {r.id: r.reason for r in told.collect()} == reasons
    for t, rows in want.items():
        columns = [k.column for k in deletion.FOREIGN_KEYS if k.child == t]
        assert after[t].columns == frames[t].columns
        got = {r.id: {c: r[c] for c in columns} for r in after[t].collect()}
        assert got == rows, t
    for k in deletion.FOREIGN_KEYS:
        if k.parent in deletion.below(root):  # what pointed nowhere before may do so still
            there = {r.id for r in after[k.parent].collect()} | {None} | set(range(100)) - set(tables[k.parent])
            assert all(r[k.column] in there for r in after[k.child].collect()), k


def test_tables_go_behind_what_can_doom_them():
    assert deletion.below("users")[0] == "users" and deletion.below("users").index("resumes") < deletion.below("users").index("analyses")
    assert deletion.below("companies") == ["companies"]
    with pytest.raises(ValueError):
        deletion.below("a", (deletion.Key("b", "x", "a", "cascade"), deletion.Key("b", "y", "c", "cascade"), deletion.Key("c", "z", "b", "cascade")))
