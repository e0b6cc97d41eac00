"""Repeated passages by a sparse enhanced suffix array and trees of its common prefixes.

A repeat is a string of ``least`` bytes or more that starts at two places or more. Only some suffixes are sorted: each window
of ``least`` bytes is held by its anchor, the leftmost of the places within it where the hash of the next ``gram`` bytes is smallest,
so equal windows have equal anchors at equal offsets, about one place in 26. A suffix stands at an anchor and reaches as far as the
windows that the anchor holds; what stands left of the anchor, read backwards, is its left extension.

1. ``anchored`` deals anchors by their gram. One that nothing shares can be in no repeat. Of places whose windows are all
   equal the earliest is kept and the others are repeats all over. What is left are grams with different surroundings:
   the borders of repeats.
2. ``_right`` sorts the suffixes of those (globally, by range), takes common prefixes of neighbours and scans them with a
   stack: each lcp-interval is a group of places that go on alike to the right, and no further (right-diverse).
3. ``_left`` sorts each group by what stands to its left and scans again. An lcp-interval of the left extensions, where
   members differ in the next byte to the left, is a maximal repeat if both extents make up ``least`` bytes: all members
   are its occurrences, not just neighbours. For each member the scan finds the furthest extent that it shares with an earlier one.

Sorted suffixes are cut into blocks; a group may reach over any number of blocks, as each block gets what the blocks before
and after it share with its edge: for each length of a common prefix the earliest place. A block tells as much about
itself, at most ``least`` numbers, so the driver folds some kilobytes a block, whatever the block holds.
So no group, however large, meets in a task; places are in the sort order, so equal suffixes are dealt out too.

Order of places: doc_id, then rows of one doc_id by a hash of their text, then the byte. Rows with the same id and text are
copies: one stays, the others are repeats all over. Rows without an id come last. A null text is empty. Texts of
less than ``least`` bytes stay as they are. Texts of any length are read whole, in segments. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import map_arrow, materialize, task_number

LEAST = 100
#: Positions that are hashed at a time; must be below 2^20.
SEGMENT = 1 << 19
#: Places of one gram in a batch of texts beyond which they needn't meet the gram's other places to be known as borders.
MANY = 16
#: Bytes of texts whose anchors are gathered at a time (or one text's).
PIECE = 6 << 20
#: Suffixes in a block.
BLOCK = 1 << 17
#: Rows without an id come behind all ids.
LAST = (1 << 63) - 1
#: The bits of a text's hash by which rows of one id are told apart.
TIES = (1 << 31) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([c]), 7) for c in range(256)], np.uint64)


# ---- anchors


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    out = a ^ (a >> np.uint64(29))
    out *= _MIX
    out += b
    return out


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    m = 1
    while 2 * m <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (width - m)], x[width - m :]) if width > m else x


def _hashes(data: np.ndarray, gram: int, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``gram`` and of the ``long`` (a power of two) bytes from each position."""
    h, m, at_gram = _BYTES[data], 1, None
    while True:
        if m <= gram < 2 * m:
            at_gram = _pairs(h[: len(h) - (gram - m)], h[gram - m :]) if gram > m else h
        if m == long:
            return at_gram, h
        h = _pairs(h[:-m], h[m:])
        m *= 2


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The anchors of texts that stand at ``starts`` to ``ends`` in ``data``.

    Columns: key (of the gram), around (of all bytes of the anchor's windows), doc (number of the text), spot (of the
    anchor in its text), left (bytes before it) and more (windows after the first). A run of windows that a segment's end cuts
    gives two rows.
    """
    gram = least // 2
    long = 1 << (least.bit_length() - 1)
    out: list[tuple] = []
    fits = np.flatnonzero(ends - starts >= least)
    k = 0
    while k < len(fits):
        # texts that together fill a segment, or a long one in several
        first, lo = k, int(starts[fits[k]])
        while k < len(fits) and int(ends[fits[k]]) - lo <= SEGMENT:
            k += 1
        k = max(k, first + 1)
        end = int(ends[fits[k - 1]])
        docs = fits[first:k]
        for at in range(lo, max(lo + 1, end - least + 1), SEGMENT):
            out.append(_segment(data, at, min(end, at + SEGMENT + least - 1), docs, starts, ends, least, gram, long))
    names = ("key", "around", "doc", "spot", "left", "more")
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)
    return {n: np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))}


def _segment(data, lo, hi, docs, starts, ends, least, gram, long) -> tuple:
    grams, longs = _hashes(data[lo:hi], gram, long)
    # the smallest hash, of equal ones the leftmost: its place is in the low bits
    low = np.uint64((1 << 20) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    where = (_smallest(packed, least - gram + 1) & low).astype(np.int64)
    # windows that lie within a text
    a, b = np.maximum(starts[docs] - lo, 0), np.minimum(ends[docs] - lo - least + 1, len(where))
    some = b > a
    docs, a, b = docs[some], a[some], b[some]
    size = b - a
    window = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
    owner = np.repeat(docs, size)
    at = where[window]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    count = np.diff(np.append(run, len(at)))
    spot, begin = at[run], window[run]
    left, more = spot - begin, count - 1
    # two long blocks cover all but bytes of the gram
    tail = begin + more + least - long
    around = _pairs(_pairs(longs[begin], longs[tail]), (left * 4096 + more).astype(np.uint64) * _MIX)
    return grams[spot], around, owner[run], spot + lo - starts[owner[run]], left, more


# ---- places that share a gram

_PLACE = np.dtype([("doc", "<i8"), ("tie", "<i4"), ("spot", "<i8"), ("left", "<i2"), ("more", "<i2")])
_KEYED = np.dtype([("key", "<u8"), ("around", "<u8"), *_PLACE.descr])


def _pack(rows: np.ndarray) -> bytes:
    """Columns behind one another, ids and spots as differences."""
    out = []
    for n in rows.dtype.names:
        col = rows[n]
        if n in ("doc", "spot"):
            col = np.diff(col, prepend=np.zeros(1, col.dtype))
        out.append(np.frombuffer(col.tobytes(), np.uint8).reshape(-1, col.itemsize).T.tobytes() if n not in ("key", "around") else col.tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join(out))


def _unpack(body: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, at = len(raw) // kind.itemsize, 0
    rows = np.empty(n, kind)
    for name in kind.names:
        size = kind[name].itemsize
        piece = raw[at : at + n * size]
        at += n * size
        if name not in ("key", "around"):
            piece = np.frombuffer(piece, np.uint8).reshape(size, n).T.tobytes()
        col = np.frombuffer(piece, kind[name])
        rows[name] = np.cumsum(col) if name in ("doc", "spot") else col
    return rows


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rows that share their key; which is the first place of its surroundings; which repeats an earlier one."""
    order = np.argsort(rows["key"], kind="stable")
    rows = rows[order]
    new = _runs(rows["key"])
    alone = new & np.append(new[1:], True)
    rows = rows[~alone]
    rows = rows[np.lexsort((rows["spot"], rows["tie"], rows["doc"], rows["around"], rows["key"]))]
    first = _runs(rows["key"], rows["around"])
    head = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    again = np.zeros(len(rows), bool)
    for n in ("doc", "tie", "spot"):
        again |= rows[n] != rows[n][head]
    return rows, first, again


def _borders(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the first places those whose key has different surroundings."""
    mine = rows[first]
    if not len(mine):
        return mine
    key = _runs(mine["key"])
    n = np.diff(np.append(np.flatnonzero(key), len(mine)))
    return mine[np.repeat(n > 1, n)]


def texts(docs: DataFrame) -> DataFrame:
    """doc, tie and the text's bytes for each row of ``docs``."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    doc = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc, F.lit(LAST)).alias("doc"), F.xxhash64(body, doc.isNull()).bitwiseAND(F.lit(TIES)).cast("int").alias("tie"), body.alias("body"))


def _bodies(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets[:-1], offsets[1:]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut after some PIECE bytes of body."""
    for batch in batches:
        if batch.num_rows:
            offsets = np.append(*(lambda b: (b[1], b[2][-1:]))(_bodies(batch.column("body"))))
            cuts = np.flatnonzero(_runs((offsets[:-1] - offsets[0]) // PIECE))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                yield batch.slice(a, b - a)


def anchored(docs: DataFrame, least: int = LEAST, every: bool = False) -> DataFrame:
    """Rows (doc, tie, spot, left, more, border): places whose windows repeat earlier ones, and those at borders.

    With ``every``, all places whose gram is found elsewhere count as borders, also those whose windows are all alike.

    Within a batch of texts places with equal surroundings are reduced to their first, and of a gram with more than
    MANY different surroundings all are borders for certain; only two of them go on to meet the gram's others. So a gram has
    at most MANY + 2 rows a batch, wherever it is found.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, batch in enumerate(_pieces(batches)):
            data, starts, ends = _bodies(batch.column("body"))
            found = anchors(data, starts, ends, least)
            rows = np.empty(len(found["key"]), _KEYED)
            for c in ("key", "around", "spot", "left", "more"):
                rows[c] = found[c]
            rows["doc"] = batch.column("doc").to_numpy()[found["doc"]]
            rows["tie"] = batch.column("tie").to_numpy()[found["doc"]]
            rows = rows[np.argsort(rows["key"], kind="stable")]
            new = _runs(rows["key"])
            shared = ~(new & np.append(new[1:], True)) if len(rows) else new
            mine, first, again = _classes(rows[shared])
            if every:
                first, again = np.ones(len(mine), bool), np.zeros(len(mine), bool)
            firsts = mine[first]
            key = _runs(firsts["key"])
            size = np.diff(np.append(np.flatnonzero(key), len(firsts)))
            many = np.repeat(size > MANY, size)
            place = np.arange(len(firsts)) - np.repeat(np.flatnonzero(key), size)
            go_on = np.concatenate([rows[~shared], firsts[~many | (place < 2)]])
            to = (go_on["key"] >> np.uint64(40)).astype(np.int64) % n
            order = np.lexsort((go_on["spot"], go_on["doc"], to))
            go_on, to = go_on[order], to[order]
            cut = np.flatnonzero(_runs(to))
            out = [(int(to[i]), 0, _pack(go_on[i:j])) for i, j in zip(cut, np.append(cut[1:], len(to)), strict=True)]
            spread = (task_number() + b) % n
            out += [(spread, kind, _pack(np.ascontiguousarray(np.sort(x[list(_PLACE.names)].astype(_PLACE), order=("doc", "spot"))))) for kind, x in ((1, mine[again]), (2, firsts[many])) if len(x)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["goes", "kind", "rows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def batch_of(rows: np.ndarray, border: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(rows[c].astype(np.int64)) for c in _PLACE.names), pa.array(np.full(len(rows), border))], [*_PLACE.names, "border"])

        for batch in batches:
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if kind:
                    yield batch_of(_unpack(body, _PLACE), kind == 2)
                else:
                    held.append(_unpack(body, _KEYED))
        if held:
            rows, first, again = _classes(np.concatenate(held))
            if every:
                yield batch_of(rows, True)
            else:
                yield batch_of(rows[again], False)
                yield batch_of(_borders(rows, first), True)

    dealt = texts(docs).filter(F.length("body") >= least).mapInArrow(gather, "goes int, kind int, rows binary").repartitionById(n, F.col("goes"))
    return dealt.select("kind", "rows").mapInArrow(meet, "doc long, tie long, spot long, left long, more long, border boolean")


# ---- sorted blocks and what they share with their neighbours


def _strings(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as a matrix padded with zeros, and the lengths."""
    data, starts, ends = _bodies(column)
    size = ends - starts
    out = np.zeros((len(size), width), np.uint8)
    if len(size):
        out[np.arange(width) < size[:, None]] = data[starts[0] : ends[-1]]
    return out, size


def common(groups: np.ndarray, strings: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours; -1 between groups."""
    if len(groups) < 2:
        return np.zeros(0, np.int64)
    differ = strings[1:] != strings[:-1]
    first = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
    out = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return np.where(groups[1:] == groups[:-1], out, -1)


def _shared(a: bytes, b: bytes) -> int:
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return k
    return min(len(a), len(b))


def _edge(lcp: np.ndarray, places: list[tuple], last: bool) -> list[tuple]:
    """For each length that rows share with the last (or first) row: the earliest place. The row itself shares LEAST or more."""
    order = range(len(places) - 1, -1, -1) if last else range(len(places))
    best: dict[int, tuple] = {}
    depth = 1 << 30
    for n, i in enumerate(order):
        if n:
            depth = min(depth, int(lcp[i] if last else lcp[i - 1]))
        if depth < 0:
            break
        if depth not in best or places[i] < best[depth]:
            best[depth] = places[i]
    return [(d, *p) for d, p in best.items()]


def _carried(blocks: list[dict], forward: bool) -> dict[tuple[int, int], list[tuple]]:
    """What all blocks before (or after) share with each block's edge: (length, place), by length."""
    out, carry, before = {}, {}, None
    near, far = ("first", "last") if forward else ("last", "first")
    for block in blocks if forward else reversed(blocks):
        mine: dict[int, tuple] = {}
        if before is not None and before["group_" + far] == block["group_" + near]:
            c = _shared(before[far], block[near])
            through = _shared(before["first"], before["last"]) if before["group_first"] == before["group_last"] else -1
            told = [(min(d, c), tuple(p)) for d, *p in json.loads(before["edge_" + far])]
            told += [(min(d, c, through), p) for d, p in carry.items()] if through >= 0 else []
            for d, p in told:
                if d not in mine or p < mine[d]:
                    mine[d] = p
        carry, before = mine, block
        if mine:
            out[block["part"], block["block"]] = sorted(mine.items())
    return out


def _blocks(rows: DataFrame, width: int, label: str) -> DataFrame:
    """Rows (grp, string, doc, tie, spot, ...) sorted and cut into blocks: one row a block, with what it tells about its edges."""
    order = ["grp", "string", "doc", "tie", "spot"]
    schema = "part int, block int, group_first long, group_last long, first binary, last binary, edge_first string, edge_last string, rows binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            groups = t.column("grp").to_numpy()
            lcp = common(groups, *_strings(t.column("string"), width))
            places = list(zip(*(t.column(c).to_pylist() for c in ("doc", "tie", "spot")), strict=True))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(t)
            strings = t.column("string")
            values = [task_number(), number, int(groups[0]), int(groups[-1]), strings[0].as_py(), strings[-1].as_py(), json.dumps(_edge(lcp, places, False)), json.dumps(_edge(lcp, places, True)), sink.getvalue().to_pybytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "block", "group_first", "group_last", "first", "last", "edge_first", "edge_last", "rows"])

        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, BLOCK - n)
                batch = batch.slice(piece.num_rows)
                held.append(piece)
                n += piece.num_rows
                if n == BLOCK:
                    yield flush()
                    held, n, number = [], 0, number + 1
        if n:
            yield flush()

    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), label)


def _scan(blocks: DataFrame, scan, schema: str) -> DataFrame:
    """``scan(rows, before, after)`` on each block with what the others share with its edges."""
    told = blocks.drop("rows").orderBy("part", "block").collect()
    told = [r.asDict() for r in told]
    held = blocks.sparkSession.sparkContext.broadcast((_carried(told, True), _carried(told, False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = held.value
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["part"], row["block"])
                rows = pa.ipc.open_stream(row["rows"]).read_next_batch()
                yield scan(rows, before.get(at, []), after.get(at, []))

    return blocks.select("part", "block", "rows").mapInArrow(run, schema)


def _with_edges(lcp: np.ndarray, before: list[tuple], after: list[tuple]) -> tuple[list[int], int]:
    """Common prefixes with a row before and after for each length told by other blocks; the number of rows before."""
    return [d for d, _ in before] + lcp.tolist() + [d for d, _ in reversed(after)], len(before)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """lcp-intervals (first, last, length) by a scan with a stack; -1 parts groups."""
    stack = [(-1, 0)]
    for i in range(len(lcp) + 1):
        d, lo = lcp[i] if i < len(lcp) else -1, i
        while stack[-1][0] > d:
            depth, lo = stack.pop()
            yield lo, i, depth
        if stack[-1][0] < d:
            stack.append((d, lo))


def furthest_earlier(lcp: list[int], places: list[tuple]) -> list[int]:
    """For each row the longest prefix that it shares with a row of an earlier place; -1 if with none."""
    best = [-1] * len(places)
    for back in (False, True):
        stack: list[tuple[tuple, int]] = []
        for n in range(len(places)):
            i = len(places) - 1 - n if back else n
            m = -1 if not n else lcp[i] if back else lcp[i - 1]
            if m < 0:
                stack.clear()
            place = places[i]
            while stack and stack[-1][0] >= place:
                m = min(m, stack.pop()[1])
            if stack and m > best[i]:
                best[i] = m
            stack.append((place, m))
    return best


# ---- the two trees


def _surroundings(docs: DataFrame, borders: DataFrame, least: int) -> DataFrame:
    """(grp, string, back, doc, tie, spot) of each border: the gram's hash, what follows it, what stands before it backwards."""
    gram = least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = [], zstandard.ZstdDecompressor().decompress
            for doc, tie, packed, at in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "body", "at")), strict=True):
                body = whole(packed)
                for p in {(x["spot"], x["left"], x["more"]) for x in at}:
                    spot, left, more = p
                    gram_end, begin = spot + gram, spot - left
                    rows.append((xxhash.xxh64_intdigest(body[spot:gram_end]) - (1 << 63), body[gram_end : begin + more + least], body[begin:spot][::-1], doc, tie, spot))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["grp", "string", "back", "doc", "tie", "spot"])

    listed = borders.groupBy("doc", "tie").agg(F.collect_list(F.struct("spot", "left", "more")).alias("at"))
    one = texts(docs).filter(F.length("body") >= least).withColumn("tie", F.col("tie").cast("long"))
    return materialize(listed.join(_small(one), ["doc", "tie"]).mapInArrow(run, "grp long, string binary, back binary, doc long, tie long, spot long"), "borders")


def _small(docs: DataFrame) -> DataFrame:
    """Bodies compressed, on their way through a shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = zstandard.ZstdCompressor(1)
        at = batch.schema.get_field_index("body")
        return batch.set_column(at, "body", pa.array([c.compress(b.as_buffer()) for b in batch.column("body")], pa.binary()))

    return map_arrow(docs, run, docs.schema)


def _right(blocks: DataFrame, least: int) -> DataFrame:
    """The members of each lcp-interval of suffixes that can reach ``least`` bytes: (grp, string, right, doc, tie, spot)."""
    width = least - least // 2

    def scan(rows: pa.RecordBatch, before: list, after: list) -> pa.RecordBatch:
        keys, backs = rows.column("grp").to_numpy(), rows.column("back")
        strings, size = _strings(rows.column("string"), width + least)
        lcp, pad = _with_edges(common(keys, strings, size), before, after)
        reach = _strings(backs, width + least)[1]
        index, depths, names = [], [], []
        for lo, hi, depth in intervals(lcp):
            lo, hi = max(lo - pad, 0), min(hi - pad, len(keys) - 1)
            if lo > hi:
                continue
            members = lo + np.flatnonzero(reach[lo : hi + 1] + depth >= width)
            if len(members):
                index.append(members)
                depths.append(np.full(len(members), depth))
                name = xxhash.xxh64_intdigest(keys[lo].tobytes() + strings[lo, :depth].tobytes(), depth) - (1 << 63)
                names.append(np.full(len(members), name))
        index, depths, names = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (index, depths, names))
        taken = rows.take(pa.array(index))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), taken.column("back"), pa.array(depths, pa.int64()), *(taken.column(c) for c in ("doc", "tie", "spot"))], ["grp", "string", "right", "doc", "tie", "spot"])

    return _scan(blocks, scan, "grp long, string binary, right long, doc long, tie long, spot long")


def _left(blocks: DataFrame, least: int) -> DataFrame:
    """(doc, tie, start, stop): the furthest stretch around a member's gram that an earlier member of its group has too."""
    gram = least // 2

    def scan(rows: pa.RecordBatch, before: list, after: list) -> pa.RecordBatch:
        lcp, pad = _with_edges(common(rows.column("grp").to_numpy(), *_strings(rows.column("string"), 2 * least)), before, after)
        own = list(zip(*(rows.column(c).to_pylist() for c in ("doc", "tie", "spot")), strict=True))
        places = [p for _, p in before] + own + [p for _, p in reversed(after)]
        left = np.array(furthest_earlier(lcp, places)[pad : pad + len(own)], np.int64)
        right, spot = rows.column("right").to_numpy(), rows.column("spot").to_numpy()
        again = (left >= 0) & (left + right + gram >= least)
        keep = rows.filter(pa.array(again))
        return pa.RecordBatch.from_arrays([keep.column("doc"), keep.column("tie"), pa.array((spot - left)[again]), pa.array((spot + gram + right)[again])], ["doc", "tie", "start", "stop"])

    return _scan(blocks, scan, "doc long, tie long, start long, stop long")


def _group_blocks(docs: DataFrame, borders: DataFrame, least: int) -> DataFrame:
    around = _surroundings(docs, borders, least)
    return _blocks(_right(_blocks(around, 2 * least, "suffixes"), least), 2 * least, "groups")


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, tie, start, stop): stretches of texts each byte of which is in a string of ``least`` bytes that also starts earlier."""
    found = materialize(anchored(docs, least), "anchored")
    inside = found.filter("not border").select("doc", "tie", (F.col("spot") - F.col("left")).alias("start"), (F.col("spot") - F.col("left") + F.col("more") + least).alias("stop"))
    return inside.unionByName(_left(_group_blocks(docs, found.filter("border").drop("border"), least), least))


def maximal_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(repeat, length, doc, tie, start): the maximal repeats with all their occurrences.

    ``repeat`` is a hash of the string. Each is right-diverse and left-diverse within the surroundings of an anchor, some
    ``least`` bytes to either side: a longer repeat is a chain of these, each with all occurrences. The copies of a row are one place.
    """
    gram = least // 2
    found = materialize(anchored(docs, least, every=True), "anchored")

    def scan(rows: pa.RecordBatch, before: list, after: list) -> pa.RecordBatch:
        groups, right, spot = (rows.column(c).to_numpy() for c in ("grp", "right", "spot"))
        strings, size = _strings(rows.column("string"), 2 * least)
        lcp, pad = _with_edges(common(groups, strings, size), before, after)
        index, names, left = [], [], []
        for lo, hi, depth in intervals(lcp):
            lo, hi = max(lo - pad, 0), min(hi - pad, len(groups) - 1)
            if lo <= hi and depth + gram + right[lo] >= least:
                index.append(np.arange(lo, hi + 1))
                names.append(np.full(hi - lo + 1, xxhash.xxh64_intdigest(groups[lo].tobytes() + strings[lo, :depth].tobytes(), depth) - (1 << 63)))
                left.append(np.full(hi - lo + 1, depth))
        index, names, left = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (index, names, left))
        taken = rows.take(pa.array(index))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(left + gram + right[index], pa.int64()), taken.column("doc"), taken.column("tie"), pa.array(spot[index] - left, pa.int64())], ["repeat", "length", "doc", "tie", "start"])

    return _scan(_group_blocks(docs, found.filter("border").drop("border"), least), scan, "repeat long, length long, doc long, tie long, start long")


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, least: int = LEAST, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes) for each row of ``docs``."""
    spans = repeated(docs, least).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    packed = _small(texts(docs).withColumns({"tie": F.col("tie").cast("long"), "n": F.lit(1).cast("long")}))
    # copies of a row meet before the shuffle
    rows = packed.groupBy("doc", "tie", "body").agg(F.sum("n").alias("n")).join(spans, ["doc", "tie"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for packed, found in zip(batch.column("body"), batch.column("spans"), strict=True):
                body = whole(packed.as_py())
                cut = united([(s["start"], s["stop"]) for s in found.as_py() or []])
                kept, at = [], 0
                for a, b in cut:
                    kept.append(body[at:a])
                    at = b
                kept = b"".join([*kept, body[at:]])
                out.append((len(body), len(body) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc", "n", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    judged = rows.mapInArrow(run, "doc long, n long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    # the copies of a row: one stays as judged, each other is a repeat all over if it is long enough
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= least)
    nothing = F.lit(b"")
    return judged.select("*", copy).select(
        F.nullif(F.col("doc"), F.lit(LAST)).alias("doc_id"),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.sha2(nothing, 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(gone, nothing).otherwise(F.col("kept")).alias("kept")] if with_bytes else []),
    )


def brute_force(docs: list[tuple], least: int = LEAST) -> list[tuple]:
    """The contract read literally, for tests: (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    bodies = [(d, (t or "").encode()) for d, t in docs]
    ties = {(d, b): k for k, (d, b) in enumerate(sorted(set(bodies), key=lambda x: (x[0] is None, x[0] or 0, tie_of(*x))))}
    order = sorted(range(len(bodies)), key=lambda i: ties[bodies[i]])
    seen: set[bytes] = set()
    out = [()] * len(bodies)
    for i in order:
        doc, body = bodies[i]
        hit = bytearray(len(body))
        for p in range(len(body) - least + 1):
            s = body[p : p + least]
            if s in seen:
                hit[p : p + least] = b"\x01" * least
            seen.add(s)
        kept = bytes(c for c, h in zip(body, hit, strict=True) if not h)
        spans = sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        out[i] = (doc, len(body), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def tie_of(doc: int | None, body: bytes) -> int:
    """The order of rows with one id, as in ``texts``."""
    return xxhash.xxh64_intdigest((doc is None).to_bytes(4, "little"), xxhash.xxh64_intdigest(body, 42)) & TIES


#: The contract for DuckDB, read literally: the first place of each window by its md5; ids are unique in the given tables.
SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n_bytes FROM docs),
windows AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(n_bytes - 99)) AS p FROM sized WHERE n_bytes >= 100)),
firsts AS (SELECT s, min((doc_id, p)) AS f FROM windows GROUP BY s HAVING count(*) > 1),
again AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE (doc_id, p) <> f),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM again),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT s.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, n_bytes) - lo)), '' ORDER BY lo) AS k FROM gaps g JOIN sized s ON g.doc_id = s.doc_id GROUP BY s.doc_id),
counted AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT s.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM sized s LEFT JOIN counted c ON s.doc_id = c.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
