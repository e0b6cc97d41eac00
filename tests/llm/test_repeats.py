"""Repeats against a literal reading of the contract and against all maximal repeats of small texts."""

import random

import numpy as np
import pytest

from talentloom.llm import repeats

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, kept string, doc int, spot long").repartition(parts)


def check(spark, rows, least=100, parts=3):
    got = sorted((tuple(r) for r in repeats.without_repeats(frame(spark, rows, parts), least).select(COLUMNS).collect()), key=repr)
    assert got == sorted(repeats.brute_force(rows, least), key=repr)
    return got


def prose(rng, n, vocabulary=300):
    return " ".join(f"{'aeiou'[rng.randrange(5)]}{rng.randrange(vocabulary)}" for _ in range(n))


def shared(rng, n_docs, passages=6):
    """Texts made of own words and of passages that many share, with different words before and after."""
    pool = [prose(rng, rng.choice([20, 60])) for _ in range(passages)]
    out = []
    for _ in range(n_docs):
        out.append(" ".join(rng.choice(pool) if rng.random() < 0.4 else prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 8))))
    return out


@pytest.mark.parametrize("least", [100, 31])
def test_removed_bytes_are_brute_force(spark, least):
    rng = random.Random(least)
    check(spark, list(enumerate(shared(rng, 120))), least)


def test_groups_over_many_blocks(spark, monkeypatch):
    # blocks of a few rows: groups, and runs of equal suffixes, reach over several of them
    monkeypatch.setattr(repeats, "BLOCK", 5)
    monkeypatch.setattr(repeats, "MANY", 2)
    rng = random.Random(9)
    common = prose(rng, 40)
    rows = [(i, f"{prose(rng, 5)} {common} {prose(rng, 5)}") for i in rng.sample(range(1000), 60)]
    rows += [(2000 + i, t) for i, t in enumerate(shared(rng, 60))]
    check(spark, rows)


def test_few_letters(spark):
    # strings overlap themselves and each other at many offsets
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(300))) * rng.randrange(1, 3)) for i in range(40)]
    rows += [(100, "a" * 700), (101, "a" * 99), (102, "ab" * 300), (103, "ba" * 60)]
    check(spark, rows, 20)
    check(spark, rows)


def test_near_copies(spark):
    rng = random.Random(7)
    base = prose(rng, 200)
    rows = []
    for i in range(80):
        w = base.split(" ")
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    long = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "short"), (5, "日本語のテキスト" * 30), (6, "日本語のテキスト" * 30), (7, long), (8, "x" + long), (None, long), (None, long), (None, None)]
    rows += [(9, long), (9, long), (9, long + "."), (9, "short"), (9, "short")]
    got = check(spark, rows)
    assert len(got) == len(rows)


def test_text_of_several_segments(spark):
    rng = random.Random(4)
    half = prose(rng, 90_000, 9000)
    rows = [(1, half + " and " + half), (2, half[300_000:] + half[:1000]), (3, "end " + half[-200:])]
    assert len(rows[0][1]) > 2 * repeats.SEGMENT // 1.5
    check(spark, rows)


def test_empty_table(spark):
    assert repeats.without_repeats(frame(spark, [])).count() == 0
    assert repeats.maximal_repeats(frame(spark, [])).count() == 0


def test_each_window_has_its_anchor():
    rng = random.Random(5)
    bodies = [prose(rng, n).encode() for n in (3, 40, 400)] + [b"a" * 250, b""]
    ends = np.cumsum([len(b) for b in bodies])
    starts = ends - [len(b) for b in bodies]
    found = repeats.anchors(np.frombuffer(b"".join(bodies), np.uint8), starts, ends, 100)
    windows = {(d, s - left + k) for d, s, left, more in zip(*(found[c].tolist() for c in ("doc", "spot", "left", "more")), strict=True) for k in range(more + 1)}
    assert windows == {(d, p) for d, b in enumerate(bodies) for p in range(len(b) - 99)}
    assert all(0 <= left <= 50 and left >= more for left, more in zip(found["left"].tolist(), found["more"].tolist(), strict=True))


def test_packed_places_are_read_back():
    rows = np.zeros(5, repeats._KEYED)
    rows["key"], rows["doc"], rows["spot"], rows["tie"] = [5, 4, 3, 2, 1 << 63], [9, 9, -4, 1 << 62, 0], [8, 7, 1 << 40, 0, 1], [1, -1, 2, 3, 4]
    assert (repeats._unpack(repeats._pack(rows), repeats._KEYED) == rows).all()


@pytest.mark.parametrize("block", [1 << 17, 7])
def test_maximal_repeats_have_all_occurrences(spark, monkeypatch, block):
    """Each listed repeat against the texts: all its places are listed; and what all repeats cover is what is removed."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(11)
    rows = list(enumerate(shared(rng, 50, passages=3)))
    rows += [(100 + i, t) for i, t in rows[:4]]  # copies
    text = {i: t.encode() for i, t in rows}
    found = {}
    for r in repeats.maximal_repeats(frame(spark, rows)).collect():
        found.setdefault((r["repeat"], r["length"]), set()).add((r["doc"], r["start"]))
    assert found
    covered = {i: bytearray(len(t)) for i, t in text.items()}
    for (_, n), places in found.items():
        strings = {text[d][p : p + n] for d, p in places}
        assert n >= 100 and len(strings) == 1
        (s,) = strings
        assert places == {(d, p) for d, b in text.items() for p in range(len(b) - n + 1) if b.startswith(s, p)} and len(places) > 1
        for d, p in sorted(places)[1:]:
            covered[d][p : p + n] = b"\x01" * n
    want = {r[0]: r[2] for r in repeats.brute_force(rows)}
    assert {i: sum(c) for i, c in covered.items()} == want


def test_scan_of_intervals_is_plain():
    rng = random.Random(12)
    for _ in range(60):
        lcp = [rng.randrange(-1, 5) for _ in range(rng.randrange(0, 14))]
        plain = set()
        for lo in range(len(lcp) + 1):
            for hi in range(lo + 1, len(lcp) + 1):
                d = min(lcp[lo:hi])
                if d >= 0 and (lo == 0 or lcp[lo - 1] < d) and (hi == len(lcp) or lcp[hi] < d):
                    plain.add((lo, hi, d))
        assert set(repeats.intervals(lcp)) == plain
        places = [(rng.randrange(6),) for _ in range(len(lcp) + 1)]
        best = [max((min(lcp[min(i, j) : max(i, j)]) for j in range(len(places)) if places[j] < places[i]), default=-1) for i in range(len(places))]
        assert repeats.furthest_earlier(lcp, places) == best
