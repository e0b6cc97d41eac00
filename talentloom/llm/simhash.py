"""SimHash near-duplicates through an inverted index over byte positions, with count filtering.

A 64-bit fingerprint has eight positional bytes. Fingerprints that differ in at most four bits
differ in at most four bytes, so a pair that links shares at least four positional bytes. Postings hold
the fingerprints that share the bytes of three positions. Of the 56 choices of three positions 20 do:
any four positions hold one of them, so each pair that shares four bytes meets in a posting. There the pair's
shared bytes are tallied; pairs with at least four are kept and verified by counting differing bits.
(Postings of single bytes would hold 1/256 of all fingerprints each, and so form all pairs of them.)

Equal fingerprints are one entry of the index. A posting is never expanded into all its pairs: it
gives a spanning forest of its links, at most one link for each member. Postings longer than
``long_posting`` (found on a hashed sixteenth of the entries, for planning only) are dealt out as
tiles of pairs of slices. Fingerprints that hold more than a thousandth of the rows (at most a thousand
of them) get their component by broadcast, so a fingerprint with a third of all rows is no hot key.

Null or blank texts have fingerprint zero and link like any other; texts are taken whole. Repeated ids are
repeated rows of the result. Rows without an id keep their fingerprint and never name a component unless no id
is reachable. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from talentloom.llm.common import field_sql, fresh, join_names, map_arrow, materialize
from talentloom.llm.components import connected_components

SHINGLE, SEED, MOST_BITS, BYTES = 4, 42, 4, 8
SHARED = BYTES - MOST_BITS
#: Postings up to this size are searched for links side by side.
FEW = 32


def _position_choices() -> list[tuple[int, int, int]]:
    """Choices of three positions such that any four positions hold one.

    The positions stand in three parts in a ring: a choice has all three in one part, or two in one
    and the third in the next. Of any four positions, three are so.
    """
    part = [p * 3 // BYTES for p in range(BYTES)]
    fits = lambda c: len({part[p] for p in c}) == 1 or any(sorted(part[p] for p in c) == sorted((k, k, (k + 1) % 3)) for k in range(3))
    return [c for c in combinations(range(BYTES), 3) if fits(c)]


CHOICES = _position_choices()


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), run, f"{field_sql(docs, 'doc_id')}, fp long")


def linked(differences: np.ndarray) -> np.ndarray:
    """Count filter, then verification, of pairs by the bits in which they differ."""
    shared = (np.ascontiguousarray(differences).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    out = shared >= SHARED
    out[out] = np.bitwise_count(differences[out]) <= MOST_BITS
    return out


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints, as pairs of their places.

    Takes a member, links all unreached ones near it, goes on from each of those.
    """
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = linked(fps[left] ^ fps[at])
            if near.any():
                got = left[near].tolist()
                out += [(at, j) for j in got]
                stack += got
                left = left[~near]
    return out


def posting_links(key: np.ndarray, tile: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Pairs of places that link, from rows sorted by key and tile."""
    n = len(key)
    same = (key[1:] == key[:-1]) & (tile[1:] == tile[:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    sizes = np.bincount(group)
    # postings in which each member is near the one before need no more
    near = np.zeros(n - 1, bool)
    near[same] = linked(fp[1:][same] ^ fp[:-1][same])
    broken = np.bincount(group[1:][same & ~near], minlength=len(sizes)) > 0
    chain = np.flatnonzero(near & ~broken[group[1:]])
    out = [np.stack([chain + 1, chain], axis=1)]
    # short postings: which hold a link at all
    some = (sizes > FEW) & broken
    rows = np.flatnonzero((broken & (sizes > 2) & ~some)[group])
    for d in range(1, FEW):
        a = rows[: len(rows) - d]
        a = a[group[a] == group[np.minimum(a + d, n - 1)]]
        if not len(a):
            break
        a = a[~some[group[a]]]
        some[group[a[linked(fp[a] ^ fp[a + d])]]] = True
    starts = np.cumsum(sizes) - sizes
    for g in np.flatnonzero(some).tolist():
        out.append(np.array(forest(fp[starts[g] : starts[g] + sizes[g]]), np.int64).reshape(-1, 2) + starts[g])
    return np.concatenate(out)


def _posting_links(postings: DataFrame) -> DataFrame:
    """Links (u, v) of entries from rows (key, tile, fp, entry) that come sorted by key and tile."""

    def run(batches):
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(4)]
            if carry is not None:
                now = [np.concatenate([c, x]) for c, x in zip(carry, now, strict=True)]
            other = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            carry = [x[last:] for x in now]
            if last:
                yield links([x[:last] for x in now])
        if carry is not None:
            yield links(carry)

    def links(rows) -> pa.RecordBatch:
        key, tile, fp, entry = rows
        pairs = posting_links(key, tile, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(entry[pairs[:, k]]) for k in (0, 1)], ["u", "v"])

    return postings.mapInArrow(run, "u long, v long")


def posting_keys(fp):
    """A key for each choice of positions: the choice's number above its bytes."""
    byte = [F.shiftrightunsigned(fp, 8 * p).bitwiseAND(255) for p in range(BYTES)]
    return F.array(*(F.lit(k << 24) + F.shiftleft(byte[a], 16) + F.shiftleft(byte[b], 8) + byte[c] for k, (a, b, c) in enumerate(CHOICES)))


def link_fingerprints(entries: DataFrame, long_posting: int = 5000) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within four bits; entries: fp, entry."""
    # a small table, but each row becomes one for each choice: deal it to all cores first
    entries = entries.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    posted = entries.select(F.explode(posting_keys(F.col("fp"))).alias("key"), "fp", "entry")
    sampled = entries.filter(F.pmod(F.xxhash64("fp"), F.lit(16)) == 0).select(F.explode(posting_keys(F.col("fp"))).alias("key"))
    hot = sampled.groupBy("key").agg((F.count("*") * 16).alias("members")).filter(F.col("members") > long_posting)
    hot = materialize(hot.select("key", F.ceil(F.col("members") / long_posting).cast("int").alias("slices")), "long-postings")
    if hot.isEmpty():
        tiled = posted.select("key", F.lit(0).alias("tile"), "fp", "entry")
    else:
        # slice s of n meets every slice: it goes to the tiles {min(s, t), max(s, t)}
        slices = F.coalesce("slices", F.lit(1))
        s = F.pmod(F.xxhash64("fp", F.lit(7)), slices).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), slices - 1), lambda t: F.least(t, s) * 65536 + F.greatest(t, s))
        tiled = posted.join(hot, "key", "left").select("key", F.explode(tiles).alias("tile"), "fp", "entry")
    dealt = tiled.repartition("key", "tile").sortWithinPartitions("key", "tile", "fp")
    return _posting_links(dealt).distinct()


def near_duplicates(docs: DataFrame, long_posting: int = 5000) -> DataFrame:
    """doc_id, fp (signed), fingerprint (hex), component_id for each document."""
    marked = materialize(fingerprints(docs), "fingerprints")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "entries")
    entries = least.select("fp", F.col("fp").alias("entry"))
    found = materialize(connected_components(link_fingerprints(entries, long_posting)), "members")
    # a component is named by its smallest document, not by its smallest fingerprint
    classes = least.join(found.withColumnRenamed("node", "fp"), "fp")
    named = materialize(classes.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "classes")
    total = marked.count()
    linked_ = join_names(classes.drop("n"), named, "component", total).select("fp", "component_id")
    alone = least.join(linked_, "fp", "left_anti").select("fp", F.col("doc_id").alias("component_id"))
    names = materialize(linked_.unionByName(alone).join(least.select("fp", "n"), "fp"), "components")
    return join_names(marked, names, "fp", total).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One document of each component (the smallest id), with all its columns.

    Of rows with the same id the first one counts; rows without an id come last.
    """
    ids = docs.select("doc_id").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        stay = near_duplicates(docs).filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
        return docs.join(stay, "doc_id", "left_semi").select(docs.columns)
    row = fresh(docs, "row_number")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    stay = found.join(numbered.select("doc_id", row), row).groupBy("component_id").agg(F.min(order)[row].alias(row))
    return numbered.join(stay, row, "left_semi").select(docs.columns)
