"""Exact round trips: tokens, packing, WebP, URL rules, and the pipeline."""

import base64
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from talentloom.llm import common, media, packing, registry, token_files, tokenizing, url_filter, webp

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  ", "don't WE'RE x's", "<|endoftext|>a b", "a\x1cb", "ΑΣ Σ x²y ½", "İstanbul ǅ ŉ", "日本語 12 34", "a_b __ c-d ... !!a", "😀😀a ª º", "tab\tnew\nline", "q" * 3000, "word " * 9000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length string")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizing.default_path())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [r.text for r in registry.table(spark, SF, "documents").orderBy("doc_id").collect()]


def test_pieces_give_the_librarys_ids(tokenizer, texts):
    encoder = tokenizing.WordEncoder(tokenizing.default_path(), most_pieces=300)
    for _ in range(2):
        for text, got in zip(texts, encoder.documents(texts), strict=True):
            assert np.array_equal(got, ids_of(tokenizer, text)), text


def test_token_files_round_trip(spark, tokenizer, texts, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    index = token_files.write_token_files(frame(spark, texts).repartition(5), folder)
    rows = token_files.read_token_files(index, folder, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for text, r in zip(texts, rows, strict=True):
        want = ids_of(tokenizer, text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), crc(want)) and r.ids == want.tolist()
        start += len(want)
    manifest = token_files.read_manifest(folder)
    assert manifest["ids"] == start and manifest["dtype"] == "<u2"
    flat = np.concatenate([np.fromfile(f"{tmp_path}/tokens/{s['shard']:06d}.bin", "<u2") for s in manifest["shards"]])
    assert np.array_equal(flat, np.concatenate([ids_of(tokenizer, t) for t in texts]))
    assert not [f for f in os.listdir(tmp_path / "tokens") if f.count(".") > 1]


def test_token_files_of_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b b"), (None, "c"), (1, "a")], "doc_id long, text string")
    rows = token_files.token_files(spark, docs).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1] and [r.n_tokens for r in rows][0] == 2
    assert token_files.token_files(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("capacity,per_group", [(4096, 1000), (64, 20), (7, 3)])
def test_packing_is_gapless_and_whole(spark, tokenizer, texts, capacity, per_group):
    placed, figures = packing.best_fit_pack(frame(spark, texts[:80]), capacity=capacity, per_group=per_group)
    rows = placed.collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts[:80]):
        want, at = ids_of(tokenizer, text), 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            part = want[at : at + capacity]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, at, len(part), crc(part))
            at += len(part)
        assert at == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity
    group = {}
    for r in rows:
        n, bound = group.setdefault(r.partition, (r.partition_bins, r.partition_bound))
        assert (n, bound) == (r.partition_bins, r.partition_bound) and n >= bound
    assert len(bins) == figures["bins"] and figures["bound"] <= figures["bins"] <= figures["bound"] * 1.05 + 2


def test_lower_bound_never_exceeds_the_best_packing():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([6, 10, 13])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 7))]
        values, counts = np.unique(items, return_counts=True)
        assert packing.lower_bound(values, counts, capacity) <= best_bins(items, capacity)
    assert packing.lower_bound(np.array([6]), np.array([5]), 10) == 5


def best_bins(items, capacity):
    best = [len(items)]

    def place(k, room):
        if len(room) >= best[0]:
            return
        if k == len(items):
            best[0] = len(room)
            return
        for b in range(len(room)):
            if room[b] >= items[k]:
                room[b] -= items[k]
                place(k + 1, room)
                room[b] += items[k]
        place(k + 1, [*room, capacity - items[k]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best[0]


def test_lower_bound_takes_every_length_as_threshold():
    def plain(lengths, capacity):
        return max(-(-sum(capacity if x > capacity - e else x if x >= e else 0 for x in lengths) // capacity) for e in {*(x for x in lengths if 2 * x <= capacity), capacity // 2})

    rng = np.random.default_rng(3)
    for capacity in (1, 7, 100, 4096):
        for n in (1, 5, 400):
            lengths = rng.integers(1, capacity + 1, n)
            assert packing.lower_bound(*np.unique(lengths, return_counts=True), capacity) >= plain(lengths.tolist(), capacity)
    # 300 lengths: only the threshold of one of them, 1001, tells that 3096 and 1001 share no bin
    lengths = np.concatenate([np.arange(1, 151), np.arange(1001, 1151), [3096] * 1000])
    assert packing.lower_bound(*np.unique(lengths, return_counts=True), 4096) >= plain(lengths.tolist(), 4096)


def test_packing_goes_on_until_no_round_helps(spark, monkeypatch):
    rounds, pack = [], packing._pack_groups
    monkeypatch.setattr(packing, "_pack_groups", lambda *a: rounds.append(a) or pack(*a))
    rng = np.random.default_rng(1)
    docs = frame(spark, [" ".join("word" for _ in range(k)) for k in rng.integers(1, 40, 600).tolist()])
    placed, figures = packing.best_fit_pack(docs, capacity=64, per_group=6)
    assert len(rounds) > 4
    bins = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert len(bins) == figures["bins"] and all(b.n == b.end <= 64 for b in bins) and sum(b.pieces for b in bins) == 600


@pytest.mark.parametrize("per_group", [6, 25, 400])
def test_the_certificate_of_each_partition_is_that_of_its_pieces(spark, per_group):
    """Bins counted by partition, and the bound of the lengths that stand there, after all rounds."""
    rng = np.random.default_rng(per_group)
    docs = frame(spark, [" ".join("word" for _ in range(k)) for k in rng.integers(1, 90, 600).tolist()])
    placed, figures = packing.best_fit_pack(docs, capacity=64, per_group=per_group)
    partitions = {}
    for r in placed.collect():
        partitions.setdefault(r.partition, []).append(r)
    for rows in partitions.values():
        assert {r.partition_bins for r in rows} == {len({r.sequence_id for r in rows})}
        assert {r.partition_bound for r in rows} == {packing.lower_bound(*np.unique([r.length for r in rows], return_counts=True), 64)}
    assert sum(rows[0].partition_bins for rows in partitions.values()) == figures["bins"]
    assert figures["bound"] <= figures["bins"]


def test_a_group_is_packed_as_a_plain_best_fit():
    """Each item by a look at all open bins: the fullest that it fits, of equally full ones as the fast one takes them."""
    rng = np.random.default_rng(9)
    for capacity in (10, 64, 4096):
        lengths = rng.integers(1, capacity, 300)
        bins, offsets, filled = packing.best_fit_decreasing(lengths, capacity)
        plain: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [k for k, used in enumerate(plain) if used + n <= capacity]
            if fits:
                plain[max(fits, key=lambda k: plain[k])] += n
            else:
                plain.append(n)
        assert sorted(filled.tolist()) == sorted(plain)
        for b in range(len(filled)):
            own = sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths.tolist(), bins.tolist(), strict=True) if x == b)
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_packing_tells_which_partitions_are_at_their_bound(spark):
    """Each partition's bound is that of its own pieces, as packed; those over it are named by their figures."""
    rng = np.random.default_rng(4)
    docs = frame(spark, [" ".join("word" for _ in range(k)) for k in rng.integers(1, 60, 400).tolist()])
    placed, _ = packing.best_fit_pack(docs, capacity=64, per_group=400)
    rows = placed.filter("partition = 0").collect()
    lengths = [r.length for r in placed.filter("length < 64").collect()]
    assert rows[0].partition_bound == packing.lower_bound(*np.unique(lengths, return_counts=True), 64)
    assert rows[0].partition_bins >= len({r.sequence_id for r in rows})
    whole = placed.filter("partition = -1").collect()
    assert all(r.partition_bins == r.partition_bound == len(whole) for r in whole)


def test_packing_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    placed, figures = packing.best_fit_pack(docs)
    assert placed.count() == 3 and figures == {"bins": 1, "bound": 1}
    assert packing.best_fit_pack(docs.limit(0))[0].count() == 0


# ---- WebP


def transforms_for(rng, h, w):
    modes = lambda s: rng.integers(0, 14, (-(-h >> s), -(-w >> s)))
    mixing = lambda s: rng.integers(0, 1 << 32, (-(-h >> s), -(-w >> s)), dtype=np.uint32)
    green, predict, cross = (webp.SUBTRACT_GREEN,), (webp.PREDICTOR, 2, modes(2)), (webp.CROSS_COLOUR, 3, mixing(3))
    return [(), (green,), (predict,), (cross,), (predict, cross, green), (cross, predict)]


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
@pytest.mark.parametrize("colours", [2, 4, 16, 200, 1 << 24])
def test_webp_round_trip(cache_bits, colours):
    rng = np.random.default_rng(colours + cache_bits)
    h, w = 11, 19
    pixels = (rng.integers(0, colours, (h, w)).astype(np.uint32) * np.uint32(0x010305)) | np.uint32(webp.OPAQUE)
    pixels[5:] = pixels[:6][-len(pixels[5:]) :]  # repeats
    variants = transforms_for(rng, h, w)
    if colours <= 256:
        variants += [((webp.PALETTE,),), ((webp.SUBTRACT_GREEN,), (webp.PALETTE,))]
    files = [webp.encode(pixels, cache_bits, True, t) for t in variants]
    for out in webp.decode_many(files):
        assert np.array_equal(out, pixels)


def test_webp_with_code_groups_and_near_distances():
    """A stream written by hand: two prefix-code groups, and a distance by the two-dimensional map."""
    out = webp.BitsOut()
    for v, n in ((webp.SIGNATURE, 8), (4 - 1, 14), (8 - 1, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        out.put(v, n)
    # a group for each of two blocks of four rows
    webp._put_pixels(out, np.array([0xFF000000, 0xFF000100], np.uint32), False, 0, False)
    simple = lambda s: [(1, 1), (0, 1), (1, 1), (s, 8)]
    green = np.zeros(256 + 24, np.int64)
    green[[7, 256 + 3]] = 1
    codes, lengths = webp._put_code(out, green)
    for s in (1, 2, 255, 0):
        for v, n in simple(s):
            out.put(v, n)
    for s in (9, 3, 4, 255, 0):
        for v, n in simple(s):
            out.put(v, n)
    for _ in range(12):
        out.put(int(codes[7]), int(lengths[7]))
    out.put(int(codes[256 + 3]), int(lengths[256 + 3]))  # four pixels from the row above: distance code 1
    body = out.bytes()
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    pixels = webp.decode_many([data])[0]
    assert (pixels[:4] == 0xFF010702).all() and (pixels[4:] == 0xFF030904).all()


def test_near_offsets_begin_and_end_as_specified():
    offsets = webp.near_offsets()
    assert len(offsets) == 120 and offsets[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and offsets[-2:] == [(8, 6), (8, 7)]


def test_webp_of_another_writer():
    """A widely published file of one pixel, as browsers' support of lossless WebP is probed with."""
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    out = webp.decode_many([data])[0]
    assert out.shape == (1, 1)


def test_broken_files_are_refused():
    with pytest.raises(ValueError):
        webp.decode_many([b"RIFF" + bytes(30)])


def test_media_round_trip(spark, texts):
    own = [*texts, "z" * 40000, "abc" * 30000]
    rows = {r.doc_id: r for r in media.media_digest(media.encode_documents(frame(spark, own))).collect()}
    for i, text in enumerate(own):
        raw = (text or "").encode()
        size = max(192, -(-len(raw) // 192) * 192)
        payload, r = raw.ljust(size, b" "), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.to_images(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    pixels = media.decode_images(media.encode_documents(frame(spark, ["abc", None]))).orderBy("doc_id").collect()
    assert bytes(pixels[0].pixels[0].samples) == b"abc".ljust(192) and pixels[1].pixels[0].width == 64
    assert media.media_digest(media.encode_documents(frame(spark, []))).count() == 0
    clash = media.encode_documents(frame(spark, ["abc"])).withColumn("pixels", F.lit(7))
    assert media.decode_images(clash).columns == ["doc_id", "n_bytes", "pixels", "pixels_"]


# ---- URL rules


def brute_judge(url, rules, default="allow"):
    host, path = url_parts(url)
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else default


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[n:]
    m = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), tail[:m]


def urls():
    rng = random.Random(8)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "example.org.uk", "com", "b.com", "B.Com", "a-b.com", "com.", "", "ÉX.org", "c.net:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/a#b", "/de/", "?q=/de/", "#/fr/"]
    out = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "http://x://y.org/es/", "a\nb://example.org/es/"]
    return out + [rng.choice(out) for _ in range(50)]


@pytest.mark.parametrize("most_rules", [100, 2, 1])
def test_url_rules_are_brute_force(spark, most_rules):
    rules = [*url_filter.RULES, url_filter.Rule("block", "a.example.org", "/"), url_filter.Rule("allow", "b.com", "/de/x")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls())], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_pages(pages, rules, most_rules=most_rules).collect()}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate(urls())}


def test_url_sql_agrees(spark):
    pages = spark.createDataFrame(list(enumerate(urls())), "page_id long, url string")
    got = sorted(map(tuple, url_filter.judge_pages(pages).collect()), key=str)
    db = duckdb.connect()
    frame_ = pages.toPandas()  # noqa: F841
    db.execute("CREATE TABLE pages AS SELECT * FROM frame_")
    assert got == sorted(db.execute(url_filter.SQL).fetchall(), key=str)
    assert url_filter.judge_pages(pages.limit(0)).count() == 0


# ---- the pipeline


def test_pipeline_stages_act(spark, tmp_path):
    docs = registry.table(spark, "/root/testdata/sf0.01", "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "/root/testdata/sf0.01")
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best-fit packing":
            assert docs.columns == columns
            seen[name] = before.count() - docs.count()
        else:
            assert docs.select("doc_id").distinct().count() == before.count()
            lost = docs.select("doc_id").join(before, "doc_id", "left_anti").count()
            assert lost == 0
    assert all(seen[s] > 0 for s in ("quality classifier", "SimHash near-dedup", "benchmark decontamination")), seen


def test_queries_have_production_columns(spark):
    out = registry.QUERIES["op9_token_files"](spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    total = out.agg(F.sum("n_tokens")).first()[0]
    assert total == registry.QUERIES["op8_best_fit_packing"](spark, SF).agg(F.sum("length")).first()[0]


def test_batches_of_long_texts_are_cut():
    texts = ["x" * n for n in (10, 0, 5000, 3, 900, 900, 900)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for at_once in (1, 1000, 2000, 1 << 20):
        parts = list(common.small(iter([batch.slice(0, 0), batch]), at_once))
        assert [t for p in parts for t in p.column("text").to_pylist()] == texts and all(p.num_rows for p in parts)
        sizes = [[len(t or "") for t in p.column("text").to_pylist()] for p in parts]
        assert all(sum(x) - max(x) <= at_once for x in sizes)  # one long text, and what fits beside it
    assert len(list(common.small(iter([batch]), 1 << 20))) == 1
