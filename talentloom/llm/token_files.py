"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

Ids, not texts, are sorted by doc_id: the bounds of the ranges come from doc_id and a hash alone, then texts
are coded where they lie and each task of the range partitioning writes one shard: ``NNNNNN.bin`` (ids, little-endian,
16 bits if the vocabulary allows, else 32) and ``NNNNNN.off`` (documents + 1 unsigned 64-bit
positions within the shard). A prefix sum over the shards' totals gives each shard's base, kept in
``manifest.json``; position + base is a document's start in the whole.

Null text counts as empty (the end id alone). Texts are taken whole: a document's ids are one value, of two bytes
each. Null ids sort first, equal ids by a hash of their text. Extra columns are left out. An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from bisect import bisect_left
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm.common import field_sql, map_arrow, materialize, shared_dir, task_number
from talentloom.llm.tokenizing import default_path, encoder

#: Bytes of text a core below which a table is small enough to be dealt out before it is coded.
SPREAD = 64 << 20


def _local(folder: str) -> str | None:
    """The path if the shared folder is mounted; None if only a file-system client reaches it."""
    at = urlparse(folder)
    return at.path if at.scheme in ("", "file") else None


class _Writer:
    """A file under a name of its own, renamed when complete: a repeated task replaces it whole."""

    def __init__(self, folder: str, name: str):
        self.store, root = fs.FileSystem.from_uri(f"file://{_local(folder)}" if _local(folder) else folder)
        self.final, self.temp = f"{root}/{name}", f"{root}/{name}.{uuid.uuid4().hex}"
        self.store.create_dir(root, recursive=True)
        self.file = self.store.open_output_stream(self.temp)

    def write(self, values: np.ndarray) -> None:
        self.file.write(values.tobytes())

    def close(self) -> None:
        self.file.close()
        self.store.move(self.temp, self.final)


def _slice(folder: str, name: str, dtype: str, start: int, end: int) -> np.ndarray:
    """Values ``start`` to ``end`` of a file: mapped into memory, or that range read where nothing can be mapped."""
    if path := _local(folder):
        path = f"{path}/{name}"
        return np.memmap(path, dtype, "r")[start:end] if os.path.getsize(path) else np.zeros(0, dtype)
    store, root = fs.FileSystem.from_uri(folder)
    size = np.dtype(dtype).itemsize
    with store.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read_at((end - start) * size, start * size), dtype)


def id_type(tokenizer: str) -> str:
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _key(doc_id, hash_: int) -> tuple:
    """Sorts as the columns do, missing ids first."""
    return (doc_id is not None, 0 if doc_id is None else doc_id, hash_)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, shard_bytes: int = 16 << 20, most_shards: int = 200_000) -> DataFrame:
    """Writes the shards and returns their index: doc_id, shard, place (in the shard), n_tokens.

    A shard is of about ``shard_bytes`` of text, or of more where that would make over ``most_shards``.
    """
    tokenizer = tokenizer or default_path()

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    size = hashed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, min(-(-size // shard_bytes), most_shards))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    # a few files of a small table would be coded by as few tasks
    rows = hashed.repartition(cores) if 0 < len(docs.inputFiles()) < cores and size < cores * SPREAD else hashed
    # documents that share one id are dealt out too, by a hash; one row for each shard comes to the driver
    ranged = hashed.select("doc_id", "hash").repartitionByRange(shards, "doc_id", "hash")
    lasts = ranged.groupBy(F.spark_partition_id().alias("shard")).agg(F.max(F.struct("doc_id", "hash")).alias("last")).orderBy("shard").collect()
    ends = docs.sparkSession.sparkContext.broadcast([_key(*r["last"]) for r in lasts][:-1])

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        dtype = id_type(tokenizer)
        ids = [x.astype(dtype).tobytes() for x in encoder(tokenizer).documents(batch.column("text").to_pylist())]
        shard = [bisect_left(ends.value, _key(i, h)) for i, h in zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(ids, pa.binary()), pa.array(shard, pa.int32())], ["doc_id", "hash", "ids", "shard"])

    def run(batches):
        shard, size, place, end = task_number(), np.dtype(id_type(tokenizer)).itemsize, 0, 0
        ids = offsets = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids is None:
                ids, offsets = _Writer(folder, f"{shard:06d}.bin"), _Writer(folder, f"{shard:06d}.off")
                offsets.write(np.zeros(1, "<u8"))
            counts = []
            for coded in batch.column("ids"):
                ids.file.write(coded.as_buffer())
                counts.append(len(coded.as_buffer()) // size)
            ends = end + np.cumsum(counts)
            offsets.write(ends.astype("<u8"))
            end = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(counts), shard), pa.int32()), pa.array(place + np.arange(len(counts)), pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "shard", "place", "n_tokens"],
            )
            place += len(counts)
        if ids is not None:
            ids.close()
            offsets.close()

    coded = map_arrow(rows, code, f"{field_sql(docs, 'doc_id')}, hash long, ids binary, shard int")
    dealt = coded.repartitionById(shards, "shard").sortWithinPartitions("doc_id", "hash", "ids").select("doc_id", "ids")
    index = materialize(dealt.mapInArrow(run, f"{field_sql(docs, 'doc_id')}, shard int, place long, n_tokens long"), "token-index")
    # one row for each shard
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("docs")).orderBy("shard").collect()
    bases, base = [], 0
    for r in totals:
        bases.append({"shard": r["shard"], "base": base, "ids": r["ids"], "documents": r["docs"]})
        base += r["ids"]
    manifest = _Writer(folder, "manifest.json")
    manifest.file.write(json.dumps({"dtype": id_type(tokenizer), "ids": base, "shards": bases}).encode())
    manifest.close()
    return index


def read_manifest(folder: str) -> dict:
    store, root = fs.FileSystem.from_uri(f"file://{_local(folder)}" if _local(folder) else folder)
    return json.loads(store.open_input_file(f"{root}/manifest.json").read())


def read_token_files(index: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the mapped files."""
    manifest = read_manifest(folder)
    bases = {s["shard"]: s["base"] for s in manifest["shards"]}  # a number for each shard

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, places = batch.column("shard").to_numpy(), batch.column("place").to_numpy()
            start, count, crc = (np.zeros(len(shards), np.int64) for _ in range(3))
            found: list = [None] * len(shards)
            for shard in np.unique(shards).tolist():
                own = np.flatnonzero(shards == shard)
                # the batch's documents stand together in their shard
                low = int(places[own].min())
                offsets = _slice(folder, f"{shard:06d}.off", "<u8", low, int(places[own].max()) + 2).astype(np.int64)
                ids, first = _slice(folder, f"{shard:06d}.bin", manifest["dtype"], int(offsets[0]), int(offsets[-1])), int(offsets[0])
                for i in own.tolist():
                    a, b = offsets[places[i] - low : places[i] - low + 2].tolist()
                    part = np.asarray(ids[a - first : b - first])
                    start[i], count[i], crc[i] = bases[shard] + a, b - a, zlib.crc32(part.astype("<u4").tobytes())
                    if with_ids:
                        found[i] = part.astype(np.int64)
            arrays = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (start, count, crc))]
            if with_ids:
                arrays.append(pa.array(found, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return index.mapInArrow(run, f"{field_sql(index, 'doc_id')}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write all documents, then read each back."""
    folder = folder or f"{shared_dir(spark)}/talentloom/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
