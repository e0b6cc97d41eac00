"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows. For each window length, a hashed shift table over blocks of
two words tells how far the search may jump; a block that no window holds skips nearly a whole
window. Where the shift is zero, the bucket of that suffix block lists the windows that end in it,
those with the same first words together, and comparing all words confirms an occurrence. Windows are
places in the items' words, so the tables take some ten bytes a window beside the words themselves.

Benchmark texts within ``most_bytes`` go to every task as one broadcast, and each Python worker makes the tables
once; a larger benchmark is searched for in blocks of that size, one after the other, and the documents'
results are united.

Texts are searched whole, one at a time. Null texts have no words and are clean. An item without an id marks
words but is not listed. An item of no words has no window. Repeated items count once by their id; repeated
documents are repeated rows. Empty documents give an empty result; an empty benchmark leaves all clean. Extra
columns are left out.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import field_sql, fresh, keep_rows, materialize

WINDOW = 13
BLOCK = 2
#: Lower-cases A-Z and blanks every other ASCII byte that isn't a letter or digit.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class WuManber:
    """Windows of ``m`` words, as places in ``words``; ``search`` yields (end, window number)."""

    def __init__(self, words: list[bytes], places: array, m: int, bits: int = 20):
        self.words, self.m = words, m
        self.b = min(BLOCK, m)
        self.skip = min(m - self.b + 1, 255)
        self.mask = (1 << bits) - 1
        shift = np.full(1 << bits, self.skip, np.uint8)
        starts = np.array(places, np.int64)
        hashes = self._hashes(words)
        for end in range(self.b, m + 1):
            np.minimum.at(shift, hashes[starts + end - self.b] & self.mask, min(m - end, 255))
        self.shift = shift.tobytes()
        key = self._bucket(hashes[starts + m - self.b], hashes[starts])
        order = np.argsort(key, kind="stable")
        self.keys, self.places = array("q", key[order].tobytes()), array("q", starts[order].tobytes())

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        """The hash of the block that begins at each word."""
        if self.b == 1:
            return np.fromiter((hash((w,)) for w in words), np.int64, len(words))
        return np.fromiter(map(hash, zip(words, words[1:])), np.int64, max(0, len(words) - 1))  # noqa: B905

    @staticmethod
    def _bucket(suffix, prefix):
        """The bucket of a suffix block, by the first words."""
        return suffix ^ (prefix >> 7)

    def search(self, words: list[bytes]):
        end, n, shift, mask, m, b = self.m, len(words), self.shift, self.mask, self.m, self.b
        while end <= n:
            suffix = hash((words[end - 2], words[end - 1]) if b == 2 else (words[end - 1],))
            jump = shift[suffix & mask]
            if jump:
                end += jump
                continue
            window = words[end - m : end]
            key = self._bucket(suffix, hash(tuple(window[:b])))
            k = bisect_left(self.keys, key)
            while k < len(self.keys) and self.keys[k] == key:
                if self.words[self.places[k] : self.places[k] + m] == window:
                    yield end, k
                k += 1
            end += 1


class Windows:
    """The windows of some items, one searcher for each length, and whose each window is."""

    def __init__(self, items: list[tuple[object, str | None]]):
        known: dict[bytes, bytes] = {}
        words: list[bytes] = []
        by_length: dict[int, array] = {}
        self.first, self.names = array("q"), []
        seen: set = set()
        for item, text in items:
            own = words_of(text)
            if not own or (item, text) in seen:
                continue
            seen.add((item, text))
            self.first.append(len(words))
            self.names.append(item)
            m = min(len(own), WINDOW)
            by_length.setdefault(m, array("q")).extend(range(len(words), len(words) + len(own) - m + 1))
            words.extend(known.setdefault(w, w) for w in own)
        self.searchers = [WuManber(words, places, m) for m, places in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The spans of the occurrences, and the items they belong to."""
        spans, items = [], set()
        for searcher in self.searchers:
            for end, k in searcher.search(words):
                if not spans or spans[-1][1] != end or spans[-1][0] != end - searcher.m:
                    spans.append((end - searcher.m, end))
                items.add(self.names[bisect_left(self.first, searcher.places[k] + 1) - 1])
        return spans, items - {None}


class Benchmark:
    """Items that go to the workers; each worker makes their windows once."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.items = items

    def __getstate__(self):
        return {"items": self.items}

    @cached_property
    def windows(self) -> Windows:
        return Windows(self.items)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, most_bytes: int):
    """The benchmark in blocks of at most ``most_bytes`` of text (or one item), one at a time on the driver."""
    block, used = [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        n = len(r["text"].encode("utf-8", "surrogatepass"))
        if block and used + n > most_bytes:
            yield block
            block, used = [], 0
        block.append((r["item_id"], r["text"]))
        used += n
    if block:
        yield block


def _search(docs: DataFrame, items: list) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(Benchmark(items))

    def run(batches):
        windows = held.value.windows
        for batch in batches:
            n_words, starts, ends, found = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                spans, ids = windows.find(words)
                spans = union(spans)
                n_words.append(len(words))
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                found.append(sorted(map(str, ids)))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(n_words, pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(found, pa.list_(pa.string()))],
                [*(c for c in batch.schema.names if c != "text"), "n_words", "starts", "ends", "items"],
            )

    kept = [field_sql(docs, c) for c in docs.columns if c != "text"]
    return docs.mapInArrow(run, ", ".join([*kept, "n_words long, starts array<long>, ends array<long>, items array<string>"]))


def _digest(found: DataFrame) -> DataFrame:
    """Counts and the verdict from the united spans, with built-in functions."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256)}).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, starts, ends, items for each document."""
    docs = docs.select("doc_id", "text")
    blocks = item_blocks(benchmark, most_bytes)
    first, second = next(blocks, []), next(blocks, None)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "starts", "ends", "items"]
    if second is None:
        return _digest(_search(docs, first)).select(columns)
    # rows get a number, as ids may repeat; each pass holds one block of the benchmark
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    parts, block = [materialize(_search(docs, first), "block")], second
    while block is not None:
        parts.append(materialize(_search(docs, block).filter(F.size("items") + F.size("starts") > 0), "block"))
        block = next(blocks, None)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans are sorted: a span adds what lies past the largest end so far
    joined = F.aggregate(
        "spans",
        F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<struct<starts:bigint,ends:bigint>>").alias("done")),
        lambda s, x: F.when(x["starts"] > s["end"], F.struct(x["ends"].alias("end"), F.concat(s["done"], F.array(x)).alias("done"))).otherwise(
            F.struct(
                F.greatest(x["ends"], s["end"]).alias("end"),
                F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(F.struct(F.element_at(s["done"], -1)["starts"].alias("starts"), F.greatest(x["ends"], s["end"]).alias("ends")))).alias("done"),
            )
        ),
    )["done"]
    merged = merged.withColumn("spans", joined).withColumns({"starts": F.col("spans.starts"), "ends": F.col("spans.ends")})
    return _digest(merged).select(columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    blocks = item_blocks(benchmark, most_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        held = docs.sparkSession.sparkContext.broadcast(Benchmark(first))

        def keep(texts: list) -> list[bool]:
            out = []
            for words in map(words_of, texts):
                hit = sum(b - a for a, b in union(held.value.windows.find(words)[0]))
                out.append(hit == 0 or 20 * hit < len(words))
            return out

        return keep_rows(docs, keep)
    row = fresh(docs, "row_number")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = find_contamination(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark, most_bytes)
    return numbered.join(found.filter("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").select(docs.columns)


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]]) -> list[tuple]:
    """The contract read literally, for tests: each window against each position."""
    windows = [(i, tuple(w[k : k + WINDOW])) for i, t in items if (w := words_of(t)) for k in range(max(1, len(w) - WINDOW + 1))]
    out = []
    for doc, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for item, window in windows:
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    ids |= {item} - {None}
        names = ",".join(sorted(map(str, ids)))
        out.append((doc, len(words), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out
