"""The whole pipeline against a plain-Python reading of its stages."""

import numpy as np

import corpus_pipeline
from talentloom.llm import decontaminate, langid, quality, registry, simhash

SF = "/root/testdata/sf0.001"


def plain_components(docs):
    fps = [simhash.fingerprint(d.text) for d in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for d, g in zip(docs, group, strict=True):
        least[g] = min(least.get(g, d.doc_id), d.doc_id)
    return set(least.values())


def plain_contaminated(text, windows):
    words, hit = decontaminate.words_of(text), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_pipeline_is_its_plain_reading(spark):
    table, labels = registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels")
    model = quality.fit(table, labels)
    docs = [d for d in table.collect() if model.score(np.stack([quality.features(d.text)]))[0] >= quality.THRESHOLD]
    kept = spark.createDataFrame(docs, table.schema)
    languages = langid.fit(kept)
    judged = [(d, langid.judge(d.text, languages)) for d in docs]
    docs = [d for d, (pred, *_) in judged if pred != langid.UNKNOWN]
    stay = plain_components(docs)
    docs = [d for d in docs if d.doc_id in stay]
    windows = set()
    for item in registry.table(spark, SF, "benchmark").collect():
        w = decontaminate.words_of(item.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    docs = [d for d in docs if not plain_contaminated(d.text, windows)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {d.doc_id for d in docs}
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_pipeline_of_odd_documents(spark):
    """Nulls, repeated ids and an extra column go through every stage."""
    docs = registry.table(spark, SF, "documents").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (3, "", "en", None, 0), (3, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd).selectExpr("*", "1 AS score", "'x' AS row")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        if name != "best-fit packing":
            assert docs.columns == columns
    assert docs.count() > 0
    empty = registry.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
