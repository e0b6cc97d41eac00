"""Ranked lexical search: postings are traversed in fixed windows of doc_id.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none.

The index has, for each window of ``WINDOW`` consecutive ids, one row or more of packed postings (term, place in the
window, occurrences) and the lengths of its documents; only terms of the queries are kept. A window is scored for all
queries at once: a term's contribution to each document is worked out once, then for each query the contributions
of its terms are scattered into one array with a slot a document, small enough for the cache. A bitset
tells which slots a query touched: each term has one for the window and a query's is their union. The touched slots
are harvested into the query's heap, which a task keeps over all its windows; the heaps of all tasks give the ranking.

Weights are rounded down from doubles, scores are integers. Equal scores rank by ascending doc_id, rows without an id
last. Each row of a table is a document or a query of its own: a repeated doc_id can be ranked more than once, a
repeated item_id gets a ranking for each of its rows, ranks then repeat. A query without terms, or none of whose terms
occurs, gets no row, nor does any if there are no documents. Texts of any length are read whole.
Queries go out by broadcast, at most ``most_bytes`` of their texts at a time: more are worked through in blocks.
A window of repeated ids may have any number of rows: where a batch has more rows of one window than it has ids,
the window is dealt out by batches, and scoring takes at most ``WINDOW`` documents at a time. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import materialize, task_number

#: Documents in a window; an array of their scores takes 128 KiB.
WINDOW = 1 << 14
#: A-Z lower-cased, other letters, digits and bytes beyond ASCII kept, all else blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_FOLD).split()


class Queries:
    """A block of queries: rows of item_id and the numbers of their terms."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.number: dict[bytes, int] = {}
        self.items = [(i, sorted({self.number.setdefault(t, len(self.number)) for t in terms_of(text)})) for i, text in rows]


def query_blocks(items: DataFrame, most_bytes: int) -> Iterator[Queries]:
    block, used = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").encode("utf-8", "surrogatepass"))
        if block and used + n > most_bytes:
            yield Queries(block)
            block, used = [], 0
        block.append((r["item_id"], r["text"]))
        used += n
    if block:
        yield Queries(block)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"".join(a.tobytes() for a in arrays))


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Rows (win, salt, n_docs, n_terms, terms, dfs, ids, body) of packed postings of the numbered terms.

    ids are the doc_ids of the documents that have terms, in their order; body holds their lengths, then slot, term
    and occurrences of each posting.
    """
    held = docs.sparkSession.sparkContext.broadcast(number)
    schema = "win long, salt long, n_docs long, n_terms long, terms array<int>, dfs array<long>, ids array<long>, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for b, batch in enumerate(batches):
            windows: dict[int | None, tuple[list, list, list, list, list]] = {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                ids, lengths, slots, found, times = windows.setdefault(None if doc is None else doc // WINDOW, ([], [], [], [], []))
                for t, tf in Counter(terms).items():
                    k = get(t)
                    if k is not None:
                        slots.append(len(ids))
                        found.append(k)
                        times.append(tf)
                ids.append(doc)
                lengths.append(len(terms))
            rows = []
            for win, (ids, lengths, slots, found, times) in windows.items():
                terms, dfs = np.unique(np.array(found, np.int32), return_counts=True)
                body = _pack(np.array(lengths, np.int64), np.array(slots, np.int32), np.array(found, np.int32), np.array(times, np.int32))
                salt = 0 if len(ids) <= WINDOW and len(set(ids)) == len(ids) else (task_number() << 20) + b + 1
                rows.append((win, salt, len(ids), sum(lengths), terms.tolist(), dfs.tolist(), ids, body))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)],
                    ["win", "salt", "n_docs", "n_terms", "terms", "dfs", "ids", "body"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Scorer:
    """The documents' counts, the weights of terms, and the queries."""

    def __init__(self, items: list[tuple[object, list[int]]], n: int, total: int, weights: dict[int, int], best: int):
        self.items, self.n, self.total, self.weights, self.best = items, n, total, weights, best

    def window(self, ids: list, lengths: np.ndarray, slots: np.ndarray, terms: np.ndarray, times: np.ndarray, heaps: list[list]) -> None:
        """Harvests one window's best documents into ``heaps``, one heap a query of (score, -doc_id, doc_id)."""
        m = np.array([10 + 90 * n * self.n // self.total for n in lengths.tolist()], np.int64)
        order = np.argsort(terms, kind="stable")
        terms, slots, times = terms[order], slots[order], times[order].astype(np.int64)
        there, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        gains = 1_000_000_000 * times // (1000 * times + 8 * m[slots])
        lists: dict[int, tuple] = {}
        for t, a, b in zip(there.tolist(), starts.tolist(), ends.tolist(), strict=True):
            touched = np.zeros(len(ids), bool)
            touched[slots[a:b]] = True
            lists[t] = (slots[a:b], self.weights[t] * gains[a:b], np.packbits(touched))
        scores = np.zeros(len(ids), np.int64)
        for (_, wanted), heap in zip(self.items, heaps, strict=True):
            mine = [lists[t] for t in wanted if t in lists]
            if not mine:
                continue
            occupied = mine[0][2].copy()
            for where, gain, bits in mine:
                scores[where] += gain  # a term has a document once
                occupied |= bits
            hit = np.flatnonzero(np.unpackbits(occupied, count=len(ids)))
            value = scores[hit]
            scores[hit] = 0
            least = heap[0][0] if len(heap) == self.best else 1
            good = value >= least
            hit, value = hit[good], value[good]
            if len(hit) > self.best:  # keeps ties of the last one that could rank
                good = value >= np.partition(value, len(value) - self.best)[len(value) - self.best]
                hit, value = hit[good], value[good]
            for k, v in zip(hit.tolist(), value.tolist(), strict=True):
                entry = (v, *((0, 0) if ids[k] is None else (1, -ids[k])))
                if len(heap) < self.best:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Windows of at most WINDOW documents from rows that are sorted by window; a row of more is cut."""
    at, ids, parts, n = None, [], [], 0

    def joined():
        return ids, *(np.concatenate([p[k] for p in parts]) for k in range(4))

    for batch in batches:
        for row in batch.select(["win", "salt", "ids", "body"]).to_pylist():
            size = len(row["ids"])
            raw = zstandard.ZstdDecompressor().decompress(row["body"])
            lengths, rest = np.frombuffer(raw, np.int64, size), np.frombuffer(raw, np.int32, offset=8 * size).reshape(3, -1)
            for lo in range(0, size, WINDOW):
                some = lengths[lo : lo + WINDOW]
                inside = (rest[0] >= lo) & (rest[0] < lo + WINDOW)
                if parts and ((row["win"], row["salt"]) != at or n + len(some) > WINDOW):
                    yield joined()
                    ids, parts, n = [], [], 0
                at = (row["win"], row["salt"])
                ids = ids + row["ids"][lo : lo + WINDOW]
                parts.append((some, rest[0][inside] - lo + n, rest[1][inside], rest[2][inside]))
                n += len(some)
    if parts:
        yield joined()


def _search(docs: DataFrame, queries: Queries, best: int) -> DataFrame:
    """query (number within the block), item_id, doc_id, score: the best of each task."""
    spark = docs.sparkSession
    index = materialize(postings(docs, queries.number), "postings")
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    # at most one row a term of the block
    pairs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.dfs").alias("df"))
    weights = {r["term"]: weight(n, r["df"]) for r in pairs.collect()}
    held = spark.sparkContext.broadcast(Scorer(queries.items, n, total, weights, best))
    item_type = docs.sparkSession.createDataFrame([], "query long, doc_id long, score long").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = held.value
        heaps: list[list] = [[] for _ in scorer.items]
        for ids, lengths, slots, terms, times in _slices(batches):
            scorer.window(ids, lengths, slots, terms, times, heaps)
        rows = [(q, -e[2] if e[1] else None, e[0]) for q, heap in enumerate(heaps) for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["query", "doc_id", "score"])

    return index.select("win", "salt", "ids", "body").repartition("win", "salt").sortWithinPartitions("win", "salt").mapInArrow(run, item_type)


def ranked_search(docs: DataFrame, items: DataFrame, best: int = 10, most_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents with a score above 0 for each row of ``items``."""
    spark, out = docs.sparkSession, None
    kind = items.schema["item_id"].dataType.simpleString()
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for queries in query_blocks(items, most_bytes):
        found = _search(docs, queries, best).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(queries.items)], f"query long, item_id {kind}")
        part = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        part = materialize(part, "ranking") if out is not None else part
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def brute_force(docs: list[tuple], items: list[tuple], best: int = 10) -> list[tuple]:
    """The contract read literally, for tests: each document against each query."""
    import re

    def terms(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)

    held = [(doc, t) for doc, text in docs if (t := terms(text))]
    n, total, out = len(held), sum(len(t) for _, t in held), []
    for item, text in items:
        wanted, ranked = set(terms(text)), []
        df = {t: sum(t in set(x) for _, x in held) for t in wanted}
        for doc, x in held:
            m = 100 - 90 + (90 * len(x) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)) for t in wanted if (tf := x.count(t)))
            if score > 0:
                ranked.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(ranked, key=lambda r: r[:3])[:best])]
    return out


#: For DuckDB. A text has no zero byte there.
SQL = r"""
WITH folded AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
listed AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM folded),
held AS (SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM listed WHERE len(terms) > 0),
sizes AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM held),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, sizes GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term), sizes GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
