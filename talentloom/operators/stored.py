"""Tables on disk in an order that later reads and writes make use of: hashed buckets for upserts, sorted ranges for pages, blocks with
an index of their trigrams for substring search."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.operators.writes import upsert
from talentloom.sources.tables import written

# ---- buckets


def bucket_of(key: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class Buckets:
    """A table with one row a key, in ``buckets`` folders by a hash of the key.

    ``upsert`` reads and rewrites the folders that a batch has keys of, and no others. What a folder is to hold is written beside
    the table first; the folders are then replaced from there one by one, so a run that was cut short is mended by running the batch
    again: a row that is there already is found, and keeps its id. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, list(key), buckets

    def _write(self, rows: DataFrame) -> None:
        # one file a bucket
        rows = rows.repartition("bucket").sortWithinPartitions("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> Buckets:
        self._write(rows.withColumn("bucket", bucket_of(self.key, self.buckets)))
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def find(self, **key: object) -> DataFrame:
        """The row of one key, from its bucket alone."""
        one = self.spark.range(1).select(*(F.lit(key[c]).cast(self.spark.read.parquet(self.path).schema[c].dataType).alias(c) for c in self.key))
        bucket = one.select(bucket_of(self.key, self.buckets)).first()[0]
        rows = self.spark.read.parquet(self.path).filter(F.col("bucket") == bucket).drop("bucket")
        for c in self.key:
            rows = rows.filter(F.col(c) == key[c])
        return rows

    def upsert(self, new: DataFrame, kept: Sequence[str] = ("id", "created_at"), order: str = "updated_at") -> list[int]:
        """Puts the latest new row of each key in place of the old one, whose ``kept`` columns stay; the buckets that were rewritten.

        Spark broadcasts the batch only if it is small; else the touched buckets are shuffled, never the others.
        """
        batch = written(new.withColumn("bucket", bucket_of(self.key, self.buckets)), "batch")
        touched = sorted(r[0] for r in batch.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        old = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched))
        after = upsert(old, batch.select(old.columns), self.key, kept, order)
        self._write(written(after, "buckets"))
        return touched


# ---- pages


class SortedPages:
    """A frame sorted once by ranges, any page of which is then read from the one range that has it, or the two.

    Ranges are found from a sample and dealt by the whole sort order, ties and all, so many equal values fill several. Their
    counts, one number a range, give each range's first row number and the total in the same pass.
    """

    def __init__(self, spark: SparkSession, path: str, order: Sequence[tuple[str, str]]):
        """``order``: columns with asc or desc; nulls come first in asc and last in desc."""
        self.spark, self.path, self.order = spark, path, list(order)
        self._starts: list[int] | None = None

    def _columns(self) -> list:
        return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_first() for c, way in self.order]

    def create(self, rows: DataFrame, ranges: int) -> SortedPages:
        ranged = rows.repartitionByRange(ranges, *self._columns()).withColumn("range", F.spark_partition_id())
        ranged.sortWithinPartitions("range", *self._columns()).write.partitionBy("range").parquet(self.path)
        return self

    def _counts(self) -> list[int]:
        """The number of rows before each range, and of all."""
        if self._starts is None:
            found = self.spark.read.parquet(self.path).groupBy("range").count().collect()
            self._ranges = sorted((r["range"], r["count"]) for r in found)
            self._starts = [0, *accumulate(n for _, n in self._ranges)]
        return self._starts

    def total(self) -> int:
        return self._counts()[-1]

    def page(self, number: int, size: int) -> DataFrame:
        if number < 1 or not 1 <= size <= 100:
            raise ValueError("page from 1, page size from 1 to 100")
        starts, at = self._counts(), (number - 1) * size
        rows = self.spark.read.parquet(self.path)
        first = bisect_right(starts, at) - 1
        last = min(bisect_right(starts, at + size - 1) - 1, len(self._ranges) - 1)
        if at >= self.total():
            return rows.drop("range").limit(0)
        mine = rows.filter(F.col("range").isin([self._ranges[k][0] for k in range(first, last + 1)])).drop("range")
        return mine.orderBy(*self._columns()).offset(at - starts[first]).limit(size)


# ---- substrings


def literal_trigrams(needle: str) -> list[str]:
    """Trigrams that any text must have that holds ``needle`` of an ILIKE, letter case aside; none if it is too short to tell.

    % and _ stand for anything, and so may what is behind a backslash.
    """
    parts = re.split(r"\\.?|[%_]", needle, flags=re.S)
    # letters whose lower case is of another length, or that two capitals share, are told by no trigram
    plain = [x for p in parts for x in re.split(r"[^\x00-\x7f]+", p)]
    return sorted({p[k : k + 3].lower() for p in plain for k in range(len(p) - 2)})


def trigrams_of(text):
    """The distinct trigrams of a text's lower case, as far as they are ASCII."""
    low = F.lower(text)
    at = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.array_distinct(F.transform(at, lambda k: F.substring(low, k, F.lit(3)))), lambda g: g.rlike(r"^[\x00-\x7f]{3}$"))


class Searchable:
    """A table in blocks of rows, with the blocks in which each trigram of its texts stands.

    A search intersects the blocks of the needle's trigrams and reads those alone, where ILIKE decides. The index is dealt into folders by
    trigram, so a search reads a few of them; it holds a block's number once a trigram, however often that stands there. Needles
    without a trigram of their own read all blocks.
    """

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], folders: int = 64):
        self.spark, self.path, self.columns, self.folders = spark, path, list(columns), folders

    def _folder(self, gram):
        return F.pmod(F.xxhash64(gram), F.lit(self.folders)).cast("int")

    def create(self, rows: DataFrame, blocks: int, by: str = "id") -> Searchable:
        """Blocks are ranges of ``by``: sorted by what texts that are alike share, fewer blocks match."""
        dealt = rows.repartitionByRange(blocks, by).withColumn("block", F.spark_partition_id())
        dealt.sortWithinPartitions("block", by).write.partitionBy("block").parquet(f"{self.path}/rows")
        stored = self.spark.read.parquet(f"{self.path}/rows")
        grams = stored.select("block", F.explode(F.array_distinct(F.flatten(F.array(*(F.coalesce(trigrams_of(F.col(c)), F.array().cast("array<string>")) for c in self.columns))))).alias("gram")).distinct()
        index = grams.withColumn("folder", self._folder(F.col("gram"))).repartition("folder").sortWithinPartitions("folder", "gram", "block")
        index.write.partitionBy("folder").parquet(f"{self.path}/index")
        return self

    def blocks(self, needle: str, column: str | None = None) -> list[int] | None:
        """The blocks that may hold the needle, one number each; None: any."""
        grams = literal_trigrams(needle)
        if not grams:
            return None
        wanted = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        folders = sorted({r[0] for r in wanted.select(self._folder(F.col("gram"))).collect()})
        index = self.spark.read.schema("gram string, block int, folder int").parquet(f"{self.path}/index")
        found = index.filter(F.col("folder").isin(folders) & F.col("gram").isin(grams)).groupBy("block").count()
        return sorted(r["block"] for r in found.filter(F.col("count") == len(grams)).collect())

    def search(self, needle: str) -> DataFrame:
        """The rows one of whose columns holds the needle, as ILIKE '%needle%' says."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        some = self.blocks(needle)
        if some is not None:
            rows = rows.filter(F.col("block").isin(some)) if some else rows.limit(0)
        holds = F.lit(False)
        for c in self.columns:
            holds = holds | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
        return rows.filter(holds).drop("block")
