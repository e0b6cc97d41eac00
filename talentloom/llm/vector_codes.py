"""Vector code compression: product codes whose nearest entries are found by partial-distance search.

A component x becomes the integer floor(4096 x), so every distance, sum and mean below is exact. A vector is cut
into ``parts`` consecutive parts; a part's code is the number of the nearest entry in the codebook of its position.

For a part position the dimensions are taken in descending variance of the codebook's entries: those tell entries
apart soonest. All vectors of a batch go through one entry together: its squared differences are added up dimension
by dimension, and a mask drops a vector from the entry once its sum is strictly above the vector's best whole
distance so far. A sum that only equals it goes on, and an equal whole distance doesn't replace an earlier entry, so
ties go to the lower index.

A round of training is one pass: each task hands on counts and sums by (part, entry, position), which are summed
before they are shuffled, so the driver gets ``parts * entries * dimensions`` numbers however many vectors there are.

Rows whose vector is null, empty, or holds null, NaN or an infinity are dropped, and so are those whose length isn't
that of the vector with the smallest id. Rows without an id come last in the order of ids; equal ids are told apart
by their vectors. With fewer than ``entries`` vectors the codebooks have so many entries; an empty table gives an empty
result. If the length can't be cut into equal parts, parts differ by one. Components of 2^26 or more after the scaling
(|x| >= 16384) are calculated in Python's integers; what then doesn't fit 63 bits is given as 2^63 - 1.
Columns of other names are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import field_sql, materialize

SCALE = 4096
#: Beyond it squares of 64 summed differences might leave 63 bits.
LARGE = 1 << 26
MOST = (1 << 63) - 1


def integers(vectors: pa.ListArray, length: int) -> np.ndarray:
    """floor(4096 x) of a list column without nulls, one row a vector; Python integers if any is large."""
    x = np.floor(np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, length) * SCALE)
    if x.size and np.abs(x).max() >= LARGE:
        return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(-1, length)
    return x.astype(np.int64)


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    return [(k * length // parts, (k + 1) * length // parts) for k in range(parts)]


def nearest(x: np.ndarray, book: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry's number and its distance for each row of ``x``, by partial distances."""
    kind = object if x.dtype == object or any(abs(v) >= LARGE for e in book for v in e) else np.int64
    entries = np.array(book, dtype=kind).reshape(len(book), -1)
    x = x.astype(kind)
    spread = [len(book) * sum(v * v for v in col) - sum(col) ** 2 for col in zip(*book, strict=True)]
    dims = sorted(range(x.shape[1]), key=lambda d: (-spread[d], d))
    columns = [np.ascontiguousarray(x[:, d]) for d in dims]
    best, code = np.zeros(len(x), kind), np.zeros(len(x), np.int64)
    for k, entry in enumerate(entries):
        alive, total = np.arange(len(x)), np.zeros(len(x), kind)
        for column, d in zip(columns, dims, strict=True):
            gap = column[alive] - entry[d]
            total = total + gap * gap
            if k:
                on = (total <= best[alive]).astype(bool)
                if not on.all():
                    alive, total = alive[on], total[on]
                    if not alive.size:
                        break
        if k:
            won = (total < best[alive]).astype(bool)
            alive, total = alive[won], total[won]
        best[alive], code[alive] = total, k
    return code, best


def usable(embeddings: DataFrame) -> DataFrame:
    """The rows whose vector is there, isn't empty and has finite components only."""
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ok)


def smallest(vectors: DataFrame, entries: int) -> list[list[float]]:
    """The vectors of the smallest ids, all of the first one's length."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = vectors.orderBy(*order).select(F.size("embedding")).first()
    if first is None:
        return []
    return [list(r[0]) for r in vectors.filter(F.size("embedding") == first[0]).orderBy(*order).limit(entries).select("embedding").collect()]


class Codebooks:
    """For each part position its entries, as tuples of integers."""

    def __init__(self, length: int, books: list[list[tuple[int, ...]]]):
        self.length, self.books = length, books

    @classmethod
    def start(cls, vectors: list[list[float]], parts: int) -> Codebooks:
        length = len(vectors[0])
        rows = integers(pa.array(vectors, pa.list_(pa.float64())), length).tolist()
        return cls(length, [[tuple(r[a:b]) for r in rows] for a, b in cuts(length, parts)])

    def __len__(self) -> int:
        return len(self.books)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and distances summed over parts."""
        found = [nearest(x[:, a:b], book) for (a, b), book in zip(cuts(self.length, len(self)), self.books, strict=True)]
        large = any(d.dtype == object for _, d in found)
        return np.stack([c for c, _ in found], 1), sum(d.astype(object if large else np.int64) for _, d in found)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for e in book for v in e).encode()).hexdigest()

    def moved(self, vectors: DataFrame) -> Codebooks:
        """Each entry replaced by the mean of its parts, rounded down; unused ones stay."""
        books, length = self, self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list] = {}
            for batch in batches:
                x = integers(batch.column("embedding"), length)
                codes, _ = books.assign(x)
                for p, (a, b) in enumerate(cuts(length, len(books))):
                    for k in np.unique(codes[:, p]).tolist():
                        mine = x[codes[:, p] == k, a:b]
                        held = sums.setdefault((p, k), [0] * (b - a + 1))
                        for j, v in enumerate([len(mine), *mine.sum(0).tolist()]):
                            held[j] += v
            if sums:
                rows = [(p, k, j, str(v)) for (p, k), held in sums.items() for j, v in enumerate(held)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["part", "entry", "at", "total"])

        made = vectors.select("embedding").mapInArrow(run, "part long, entry long, at long, total string")
        # at 0 is the count; sums of components within 2^26 fit a decimal of 38 digits for 10^29 rows
        rows = made.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        got = {(r["part"], r["entry"], r["at"]): int(r["total"]) for r in rows}
        moved = [[tuple(got[p, k, j + 1] // got[p, k, 0] for j in range(len(e))) if (p, k, 0) in got else e for k, e in enumerate(book)] for p, book in enumerate(self.books)]
        return Codebooks(length, moved)


def train(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks after ``rounds`` passes over all vectors; None if there is none."""
    vectors = usable(embeddings)
    first = smallest(vectors, entries)
    if not first:
        return None
    books = Codebooks.start(first, parts)
    vectors = vectors.filter(F.size("embedding") == books.length)
    for _ in range(rounds):
        books = books.moved(vectors)
    return books


def encode(embeddings: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, codes (one a part) and error for each vector that can be coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = books.assign(integers(batch.column("embedding"), books.length))
            listed = pa.array(codes.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), listed, pa.array([min(v, MOST) for v in error.tolist()], pa.int64())], ["vec_id", "label", "codes", "error"])

    rows = usable(embeddings).filter(F.size("embedding") == books.length).select("vec_id", "label", "embedding")
    return rows.mapInArrow(run, f"{field_sql(rows, 'vec_id')}, {field_sql(rows, 'label')}, codes array<int>, error long")


def decode(codes: list[int], books: Codebooks) -> list[float]:
    """The vector that a code stands for."""
    return [v / SCALE for k, book in zip(codes, books.books, strict=True) for v in book[k]]


def vector_codes(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, by codebooks trained on the same vectors."""
    books = train(embeddings, parts, entries, rounds)
    if books is None:
        kind = field_sql(embeddings, "vec_id")
        return embeddings.sparkSession.createDataFrame([], f"{kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(encode(embeddings, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "its_label")
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    # few labels go out by broadcast; with many of them, AQE splits the rows of a frequent one
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("its_label")))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def brute_force(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> list[tuple]:
    """The contract read literally, in Python's integers, for tests: (vec_id, vector, label) to (vec_id, code, error, label_error, digest)."""
    kept = sorted((r for r in rows if r[1] and all(v is not None and abs(v) < float("inf") for v in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    length = len(kept[0][1])
    data = [(i, [int(v * SCALE // 1) for v in x], label) for i, x, label in kept if len(x) == length]
    books = [[x[a:b] for _, x, _ in data[:entries]] for a, b in cuts(length, parts)]

    def code_of(x: list[int]) -> list[tuple[int, int]]:
        return [min((sum((u - v) ** 2 for u, v in zip(x[a:b], e, strict=True)), k) for k, e in enumerate(book))[::-1] for (a, b), book in zip(cuts(length, parts), books, strict=True)]

    for _ in range(rounds):
        coded = [code_of(x) for _, x, _ in data]
        for p, (a, b) in enumerate(cuts(length, parts)):
            for k in range(len(books[p])):
                if mine := [x[a:b] for (_, x, _), c in zip(data, coded, strict=True) if c[p][0] == k]:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    coded = [code_of(x) for _, x, _ in data]
    errors: dict = {}
    for (_, _, label), c in zip(data, coded, strict=True):
        errors[label] = errors.get(label, 0) + sum(d for _, d in c)
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for k, _ in c), min(sum(d for _, d in c), MOST), min(errors[label], MOST), digest) for (i, _, label), c in zip(data, coded, strict=True)]


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same in DuckDB, for vectors of one length that can be cut into equal parts; each round is a pair of tables."""
    steps = [
        """kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0)""",
        f"""cells AS MATERIALIZED (SELECT vec_id, (i * {parts}) // n AS part, i % (n // {parts}) AS spot, CAST(floor({SCALE} * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM kept))""",
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries})",
        "book0 AS MATERIALIZED (SELECT part, entry, spot, x AS v FROM cells JOIN firsts USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (SELECT vec_id, part, min(entry) AS entry, min(d) AS d FROM (
    SELECT *, min(d) OVER (PARTITION BY vec_id, part) AS least FROM (
      SELECT c.vec_id, c.part, b.entry, CAST(sum((c.x - b.v) * (c.x - b.v)) AS BIGINT) AS d
      FROM cells c JOIN book{r} b ON c.part = b.part AND c.spot = b.spot GROUP BY ALL))
  WHERE d = least GROUP BY vec_id, part)"""
        )
        if r < rounds:
            steps.append(
                f"""book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.spot, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT part, entry, spot, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (
      SELECT part, entry, spot, sum(x) AS s, count(*) AS n FROM cells JOIN near{r} USING (vec_id, part) GROUP BY ALL)) m
  ON b.part = m.part AND b.entry = m.entry AND b.spot = m.spot)"""
            )
    steps.append(f"digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, spot)) AS codebooks_sha256 FROM book{rounds})")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"


#: For DuckDB; ids are unique in the given tables.
SQL = _sql()
