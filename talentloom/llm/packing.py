"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to groups of a bounded
size, each group is packed by best-fit decreasing, and dual feasible functions give a lower bound
of the group's bins. Groups above their bound, and the emptiest bin of any group, release
documents; those are dealt anew and packed again until the bound over all pieces is met or no
round helps. There is no other end to the rounds. Each piece tells its group (``partition``), the bins that the
group took and the group's bound: where the two are equal, no packing of that group takes fewer.

Null text counts as empty (one token, the end id). Texts are coded whole; a long one is several pieces.
Equal lengths are packed in the order in which their rows come. Rows with the same or no id are packed like
any others. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import field_sql, materialize, small
from talentloom.llm.tokenizing import default_path, encoder

CAPACITY = 4096


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and deal (which spreads equal rows over groups)."""

    def run(batches):
        task, row = TaskContext.get().partitionId() << 40, 0
        for batch in small(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder(tokenizer).documents(batch.column("text").to_pylist())):
                ids = ids.astype("<u4", copy=False)
                for k, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            deal = task + row + np.arange(len(at))
            row += len(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(deal, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "deal"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"{field_sql(docs, 'doc_id')}, piece int, start long, length long, ids_crc32 long, deal long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and how full each bin is.

    Open bins stand in one list for each amount of free room; the lowest set bit of ``rooms``
    at or above a length is the tightest fit.
    """
    bins, offsets, filled = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        left = room - n
        if left:
            if not free[left]:
                rooms |= 1 << left
            free[left].append(b)
    return bins, offsets, np.array(filled, np.int64)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions.

    u_k rounds (k + 1) * x to multiples of k where it isn't whole; f_e counts items over
    capacity - e as whole, drops those under e, and leaves the rest.
    """
    if not len(lengths):
        return 0
    x, c = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * c).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        # in units of 1 / (k * capacity): exact in integers
        value = np.where(whole, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * c).sum()) // (k * capacity)))
    # every length up to half a bin as e, by sums over the sorted lengths
    order = np.argsort(x, kind="stable")
    x, c = x[order], c[order]
    many, full = (np.concatenate([[0], np.cumsum(v)]) for v in (c, x * c))
    e = np.append(x[x <= capacity // 2], capacity // 2)
    low, high = np.searchsorted(x, e), np.searchsorted(x, capacity - e, side="right")
    value = (many[-1] - many[high]) * capacity + full[high] - full[low]
    return max(best, -(-int(value.max()) // capacity))


def _certificate(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, int]:
    """How many bins hold these pieces, and how many any packing of them needs."""
    return len(np.unique(bins)), lower_bound(*np.unique(lengths, return_counts=True), capacity)


def _pack_groups(items: DataFrame, groups: int, capacity: int, round_: int, before: int) -> DataFrame:
    """Adds sequence_id, offset, open: whether the bin is released for a further round, and the group's bins and bound.

    all_bins and all_bound are those of all its pieces, kept_bins and kept_bound of what stays if the released bins go.
    ``before``: groups of earlier rounds.
    """
    kept = items.columns

    def pack(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets, filled = best_fit_decreasing(lengths, capacity)
        every = _certificate(lengths, bins, capacity)
        gap = every[0] - every[1]
        order = np.argsort(filled, kind="stable")
        slack = np.cumsum(capacity - filled[order])
        # the emptiest bin, and for a gap as many as have gap + 1 bins of free room among them
        n = 1 if gap == 0 else int(np.searchsorted(slack, (gap + 1) * capacity) + 1)
        released = np.zeros(len(filled), bool)
        released[order[:n]] = filled[order[:n]] < capacity
        stays = ~released[bins]
        left = _certificate(lengths[stays], bins[stays], capacity)
        pid = group.column("pid")[0].as_py()
        out = group.select(kept)
        added = {"sequence_id": ((before + pid) << 24) + bins, "offset": offsets, "partition": np.full(len(bins), before + pid)}
        added |= {k: np.full(len(bins), v) for k, v in zip(_FIGURES, (*every, *left), strict=True)}
        for name, values in added.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out.append_column("open", pa.array(~stays, pa.bool_()))

    schema = ", ".join([*(field_sql(items, c) for c in kept), "sequence_id long, offset long, partition long", *(f"{c} long" for c in _FIGURES), "open boolean"])
    return items.withColumn("pid", F.pmod(F.xxhash64("deal", F.lit(round_)), F.lit(groups))).groupBy("pid").applyInArrow(pack, schema)


_FIGURES = ("all_bins", "all_bound", "kept_bins", "kept_bound")


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, per_group: int = 1000) -> tuple[DataFrame, dict[str, int]]:
    """The placed pieces, and {"bins", "bound"}: bins used and the certified least number.

    Each piece tells its partition's bins and bound, of the pieces that stand in that partition in the end: bins that were
    dealt anew count where they went. Pieces that fill a sequence are a partition of their own, -1, whose bound is their number.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = materialize(token_pieces(docs, tokenizer or default_path(), capacity), "pieces")
    sizes = pieces.groupBy("length").count().toPandas()  # at most `capacity` rows
    bound = lower_bound(sizes["length"].to_numpy(), sizes["count"].to_numpy(), capacity)
    whole = pieces.filter(F.col("length") == capacity)
    n_whole = int(sizes.loc[sizes["length"] == capacity, "count"].sum())
    fixed = {"offset": 0, "partition": -1, "partition_bins": n_whole, "partition_bound": n_whole}
    done = [whole.select(*columns, (F.lit(1 << 62) + F.col("deal")).alias("sequence_id"), *(F.lit(v).cast("long").alias(k) for k, v in fixed.items()))]
    placed = lambda rows, of: rows.select(*columns, "sequence_id", "offset", "partition", F.col(f"{of}_bins").alias("partition_bins"), F.col(f"{of}_bound").alias("partition_bound"))
    rest = pieces.filter(F.col("length") < capacity)
    rows = int(sizes["count"].sum()) - n_whole
    n_bins, before = n_whole, 0  # bins for good, groups of earlier rounds
    last, closed, released = None, 0, 0  # the round whose released bins may yet be dealt anew
    for round_ in itertools.count():
        if not rows:
            break
        groups = max(1, -(-rows // per_group))
        packed = materialize(_pack_groups(rest, groups, capacity, round_, before), f"packed{round_}")
        before += groups
        made = packed.groupBy("open").agg(F.countDistinct("sequence_id").alias("bins"), F.count("*").alias("rows")).collect()
        count = {r["open"]: (r["bins"], r["rows"]) for r in made}
        if last is not None:
            if sum(b for b, _ in count.values()) >= released:
                break  # no better than the bins that were released: those stay
            done.append(placed(last.filter(~F.col("open")), "kept"))
            n_bins += closed
        last, closed = packed, count.get(False, (0, 0))[0]
        released, rows = count.get(True, (0, 0))
        rest = packed.filter("open").select(*rest.columns)
        if n_bins + closed + released <= bound:
            break
    if last is not None:
        done.append(placed(last, "all"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, {"bins": n_bins + closed + released, "bound": bound}
