"""Brute-force, round-trip and edge-case tests of the operators on texts."""

import hashlib
import random
import textwrap
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom.llm import common, decontaminate, langid, licenses, quality, registry, simhash, unigram
from talentloom.llm.common import join_names

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "\n\t", "a", "word " * 5000, "Ünïcödé ÇA", "x\x1cy", "日本語 テキスト", "same text here now", "same text here now"]


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", "src", 1, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return df if extra else df.drop("score")


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- decontamination


def contamination(spark, docs, items, **how):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_contamination(docs, benchmark, **how).orderBy("doc_id").collect()
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows]


@pytest.mark.parametrize("most_bytes", [8 << 20, 150])
def test_decontamination_is_brute_force(spark, most_bytes):
    rng = random.Random(3)
    items = [(k, words(rng, rng.choice([1, 3, 12, 13, 14, 30]), 5)) for k in range(25)] + [(90, None), (91, " ,. "), (3, words(rng, 13)), (None, words(rng, 2))]
    texts = [words(rng, rng.choice([1, 12, 40, 200]), 6) for _ in range(60)]
    texts += [f"start {t.upper()}, end!" for _, t in items if t] + ODD
    docs = frame(spark, texts)
    assert contamination(spark, docs, items, most_bytes=most_bytes) == decontaminate.brute_force(list(enumerate(texts)), items)


def test_decontamination_of_empty_tables(spark):
    assert contamination(spark, frame(spark, []), [(1, "a b")]) == []
    clean = contamination(spark, frame(spark, ["a b c"]), [])
    assert clean == [(0, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


@pytest.mark.parametrize("most_bytes", [8 << 20, 100])
def test_contaminated_documents_go_with_repeated_ids(spark, most_bytes):
    rng = random.Random(5)
    items = [(k, words(rng, 20, 500)) for k in range(8)]
    texts = [items[0][1], words(rng, 50, 500), items[5][1] + " " + words(rng, 30, 500)]
    docs = frame(spark, texts).withColumn("doc_id", F.lit(7).cast("long"))
    docs = docs.withColumnRenamed("score", "row_number")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), most_bytes)
    assert {r["row_number"] for r in kept.collect()} == {"clash"}
    assert [r.text for r in kept.collect()] == [texts[1]]
    assert kept.columns == docs.columns


# ---- language


def test_language_mixture_finds_shares(spark):
    rng = random.Random(1)
    kinds = {"aa": ["tho", "ver", "ing", "ble"], "bb": ["que", "eau", "ois", "ent"], "cc": ["sch", "ung", "ich", "keit"]}
    text = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(list(kinds) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got if r.held_out) == sum(r.held_out for r in got)
    mixed = [(0, text("aa", 120) + " " + text("bb", 80), None), (1, None, "aa"), (2, "12 34 !!", "aa"), (3, "", None)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(mixed, docs.schema), model).collect()}
    assert out[0].languages == ["aa", "bb"] and abs(out[0].shares[0] - 0.6) < 0.08
    assert [(out[k].lang_pred, out[k].score) for k in (1, 2, 3)] == [("und", 0.0)] * 3


def test_language_without_labels_is_unknown(spark):
    docs = frame(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()} == {"und"}
    assert langid.keep_known(docs, langid.fit(docs)).count() == 0


def test_language_stage_keeps_mixed_documents(spark):
    docs = registry.table(spark, SF, "documents").collect()
    model = langid.fit(registry.table(spark, SF, "documents"))
    parts = [next(d.text for d in docs if d.lang == lang and len(d.text) > 3000)[:3000] for lang in model.languages[:3]]
    text = "\n".join(parts)
    pred, _, _, shares = langid.judge(text, model)
    assert pred in model.languages and shares[0] < 0.4
    assert [r.doc_id for r in langid.keep_known(frame(spark, [text, "", None, parts[0]]), model).collect()] == [0, 3]


def test_mixture_weights_are_plain_em():
    rng = np.random.default_rng(3)
    p = rng.random((3, 200)).astype(np.float32)
    w = [1 / 3] * 3
    for _ in range(400):
        new = [0.0] * 3
        for i in range(200):
            total = sum(w[k] * float(p[k, i]) for k in range(3))
            for k in range(3):
                new[k] += w[k] * float(p[k, i]) / total / 200
        w = new
    got, value = langid.proportions(p, 400)
    assert np.allclose(got, w, atol=0.02)
    best = sum(np.log(sum(w[k] * float(p[k, i]) for k in range(3))) for i in range(200))
    assert value <= best + 1e-2 and value > best - 0.1


def test_language_of_empty_tables_and_many_languages(spark):
    docs = spark.createDataFrame([(i, f"text number {chr(97 + i % 26)} {chr(97 + i // 26)}", f"l{i % 50:02d}") for i in range(300)], "doc_id long, text string, lang string")
    model = langid.fit(docs, most_languages=10)
    assert len(model.languages) == 10
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)).languages == []


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.98


# ---- quality


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) > 0.9 * len(held)
    kept = [r for r in held if r.quality == 1 and r.predicted == 1]
    assert len(kept) > 0.97 * sum(r.quality for r in held)


def test_quality_ignores_labels_of_held_out_rows(spark):
    docs, labels = registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(quality.crc_mod("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, labels).weights, quality.fit(docs, flipped).weights)


def test_quality_never_uses_negative_labels(spark):
    docs, labels = registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels")
    a, b = (quality.fit(docs, x) for x in (labels, labels.filter("quality = 1")))
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.prior) == (b.bias, b.prior)


def test_quality_of_odd_texts_and_empty_tables(spark):
    docs, labels = frame(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {0.5}
    model = quality.fit(docs, spark.createDataFrame([(1, None), (4, 1), (4, 1), (5, 0), (99, 1)], "doc_id long, quality int"))
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(frame(spark, []), model).count() == 0


def rows_of(spark, x):
    return spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x.astype(np.float32))], "doc_id long, x binary")


def test_quality_sums_over_all_rows(spark):
    """The tree of sums against one matrix product; margins against a plain histogram."""
    rng = np.random.default_rng(2)
    x = rng.random((700, quality.WIDTH)).astype(np.float32)
    rows = rows_of(spark, x).repartition(23)
    got = quality.all_products(rows, together=3)
    assert got[-1, -1] == 700 and np.allclose(got, quality.products(x), rtol=1e-9)
    w = rng.normal(size=quality.WIDTH)
    assert np.array_equal(quality.margin_counts(rows, w, -0.5), np.bincount(quality.cells(x @ w - 0.5), minlength=2 * quality.SPAN * quality.CELLS))


@pytest.mark.parametrize("texts", ["equal", "different"])
@pytest.mark.parametrize("hot", [None, 4])
def test_quality_samples_positive_rows_of_a_repeated_id(spark, hot, texts):
    same, other = np.full(quality.WIDTH, 1.0), [np.full(quality.WIDTH, 2.0 + k) for k in range(4500)]
    x = [(hot, same if texts == "equal" else other[k]) for k in range(1500)] + [(i, other[i]) for i in range(1510, 4510 - 10)]
    rows = spark.createDataFrame([(i, bytearray(v.astype(np.float32).tobytes())) for i, v in x], "doc_id long, x binary").repartition(3)
    labels = spark.createDataFrame([(4, 1)] + [(i, i % 2) for i in range(1510, 4500)], "doc_id long, quality int")
    kept = [r.doc_id for r in labels.filter(quality.crc_mod("doc_id", 5) != 0).filter("quality = 1").collect()]
    total = sum(i in set(kept) for i, _ in x)
    p = quality.trusted_positives(rows, labels, 300)
    assert 230 < len(p) < 370
    if hot == 4 and 4 in kept:
        share = 1500 / total
        mine = (p[:, 0] == 1).sum() if texts == "equal" else (p[:, 0] < 1502).sum()
        assert abs(mine - 300 * share) < 60
    assert len(quality.trusted_positives(rows, labels, 10**6)) == total


def plain_risk(w, b, p, u, prior):
    loss = lambda z: (1 - z) ** 2 / 4
    fp, fu = p @ w + b, u @ w + b
    return prior * loss(fp).mean() + max(0.0, loss(-fu).mean() - prior * loss(-fp).mean())


def test_risk_is_least_at_the_fit():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1, 1, (400, 3)), rng.normal(-1, 1, (400, 3))
    u = np.vstack([p[200:], n])
    w, b = quality.fit_nnpu(quality.products(u), quality.products(p[:200]), 1 / 3, ridge=0)
    right = [(x @ w + b > 0).mean() for x in (p, n)]
    assert right[0] > 0.85 and right[1] < 0.15
    # a plain descent on the risk itself, by differences, ends no lower
    at, rate = np.zeros(4), 0.1
    for _ in range(3000):
        risk = lambda z: plain_risk(z[:3], z[3], p[:200], u, 1 / 3)
        at = at - rate * np.array([(risk(at + d) - risk(at - d)) / 2e-5 for d in np.eye(4) * 1e-5])
    assert plain_risk(w, b, p[:200], u, 1 / 3) <= risk(at) + 2e-3


def test_risk_is_held_non_negative():
    """With a prior far over the truth the unbiased risk of the negatives falls below zero."""
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 0.2, (50, 3)), np.vstack([rng.normal(2, 0.2, (30, 3)), rng.normal(-2, 0.2, (70, 3))])
    w, b = quality.fit_nnpu(quality.products(u), quality.products(p), 0.9, ridge=0)
    # the least unbiased risk, by its normal equations
    x = lambda a: np.hstack([a, np.ones((len(a), 1))])
    z = np.linalg.solve(x(u).T @ x(u) / 100, 2 * 0.9 * x(p).mean(axis=0) - x(u).mean(axis=0))
    loss = lambda z: (1 - z) ** 2 / 4
    assert loss(-(x(u) @ z)).mean() - 0.9 * loss(-(x(p) @ z)).mean() < 0
    assert plain_risk(w, b, p, u, 0.9) <= min(plain_risk(z[:3], z[3], p, u, 0.9), plain_risk(np.zeros(3), 0.0, p, u, 0.9))


def test_prior_from_the_tails(spark):
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        p = rng.normal(1, 0.3, 20000)
        u = np.concatenate([rng.normal(1, 0.3, int(40000 * share)), rng.normal(-1, 0.3, int(40000 * (1 - share)))])
        count = lambda f: np.bincount(quality.cells(f), minlength=2 * quality.SPAN * quality.CELLS)
        assert abs(quality.least_tail_ratio(count(u), count(p)) - share) < 0.03


# ---- unigram counts


def reference_tokenizer(vocabulary, unknown):
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unknown, byte_fallback=False))
    t.normalizer = normalizers.Sequence([normalizers.Replace(Regex(r"\s+"), " "), normalizers.Strip()])
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return t


def test_unigram_counts_are_the_tokenizers(spark):
    vocabulary, unknown = unigram.read_vocabulary(unigram.default_path())
    t = reference_tokenizer(vocabulary, unknown)
    texts = [*ODD, "a<unk><unk>b 😀😀x😀", "<unk>😀", *(r.text for r in registry.table(spark, SF, "documents").collect())]
    got = {r.doc_id: (r.n_tokens, r.n_unknown) for r in unigram.count_tokens(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "").ids
        assert got[i] == (len(ids), sum(x == unknown for x in ids)), text


def test_unigram_ties_go_as_in_the_tokenizer():
    rng = random.Random(2)
    for _ in range(200):
        pieces = {"".join(rng.choices("ab▁", k=rng.randint(1, 4))) for _ in range(8)}
        vocabulary = [("<unk>", 0.0)] + [(p, -float(len(p) * 2 + rng.randint(0, 1))) for p in sorted(pieces)]
        t, own = reference_tokenizer(vocabulary, 0), unigram.Counter(vocabulary, 0)
        for _ in range(20):
            w = "".join(rng.choices("abc", k=rng.randint(1, 9)))
            assert own.text(w)[0] == len(t.encode(w).ids), (vocabulary, w)


def test_unigram_of_long_words_and_empty_tables(spark):
    vocabulary, unknown = unigram.read_vocabulary(unigram.default_path())
    t, rng = reference_tokenizer(vocabulary, unknown), random.Random(9)
    long = "".join(rng.choices("etaoins😀hr", k=20000))
    own = unigram.Counter(vocabulary, unknown)
    ids = t.encode(long).ids
    assert own.text(long)[:2] == (len(ids), sum(x == unknown for x in ids)) and not own.cache
    assert unigram.count_tokens(frame(spark, [])).count() == 0


# ---- licenses


def test_license_scan_of_empty_tables(spark):
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def whole_text_licenses(text):
    """Every template slid over all words of the text, without blocks and without a look at which words are missing; what saves most goes first."""
    words, won, found = licenses.words_of(text or ""), [], {}
    templates = [(name, w) for name, notices in licenses.TEMPLATES.items() for w in map(licenses.words_of, notices)]
    for _, k in licenses.reductions(words) if words else []:
        name, wording = templates[k]
        view = list(words)
        while True:
            different, end = licenses.best_place(wording, view)
            if different > licenses.MOST_DIFFERENT * len(wording):
                break
            mine = {*range(end - len(wording), end)}
            taken = [places for other, places in won if other != name and 2 * len(places & mine) > len(wording)]
            if not taken:
                won.append((name, mine))
                found[name] = min(different, found.get(name, different))
            for places in taken or [mine]:
                view = [None if i in places else w for i, w in enumerate(view)]
    return sorted(found.items())


def test_license_scan_finds_what_each_template_would(spark):
    notices = [n for ns in licenses.TEMPLATES.values() for n in ns]
    texts = [f"Some prose.\n{n}\nMore prose." for n in notices] + [n.upper() for n in notices]
    texts += ["word " * 3000 + notices[0] + " word" * 3000, *ODD, "licensed to thrill", *(r.text for r in registry.table(spark, SF, "documents").collect())]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = whole_text_licenses(text)
        assert got[i].licenses == ",".join(k for k, _ in want), text[:200]


def test_license_scan_finds_a_notice_whatever_shares_its_block():
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for n in (12, 30, 115, 240):
                text = " ".join(f"prose{k * k}" for k in range(n))
                for t in (f"{text} {notice}", f"{notice} {text}", f"{text}\nCopyright (c) 2024 Example Corporation. {notice}\n" + "\n".join(f"copyright line {k * k}" for k in range(n))):
                    assert (name, 0) in licenses.scan(t)[1], (notice, n)


@pytest.mark.parametrize(
    "text,want",
    [
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ["LGPL-3.0"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", ["AGPL-3.0"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License and more", ["GPL-3.0"]),
        ("Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.", ["CC-BY-4.0", "CC-BY-SA-4.0"]),
    ],
)
def test_the_license_that_fits_best_stays(text, want):
    assert [k for k, _ in licenses.scan(text)[1]] == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("                                 Apache License\n                           Version 2.0, January 2004\n", "Apache-2.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL-3.0"),
        ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"),
        ("BSD 3-Clause License\n\nCopyright (c) 2024, someone\n", "BSD-3-Clause"),
        (
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\n'
            "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n",
            "MIT",
        ),
    ],
)
def test_titles_and_warranties_are_found(text, want):
    for t in (text, f"some prose before\n{text}", f"{text} some prose behind"):
        assert [k for k, _ in licenses.scan(t)[1]] == [want], t


def test_the_saving_decides_between_licenses(monkeypatch):
    """With the ranking turned round the license that says less of the text would win."""
    texts = [n for name in ("AGPL-3.0", "GPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0") for n in licenses.TEMPLATES[name] if len(n.split()) > 8]
    told = [licenses.scan(t)[1] for t in texts]
    ranked = licenses.reductions
    monkeypatch.setattr(licenses, "reductions", lambda words: ranked(words)[::-1])
    assert sum(licenses.scan(t)[1] != x for t, x in zip(texts, told, strict=True)) > len(texts) // 2


@pytest.mark.parametrize("n", [200, 2000, 20000])
def test_license_notices_behind_long_prose(n):
    prose = ("some prose that says nothing of note " * (n // 30))[:n]
    mit = "\n".join(textwrap.wrap(licenses.TEMPLATES["MIT"][2], 60))
    apache = " * " + "\n * ".join(textwrap.wrap(" ".join(licenses.TEMPLATES["Apache-2.0"]), 50))
    for notice, name in (("Released under the MIT License.", "MIT"), ("All rights reserved.", "LicenseRef-All-Rights-Reserved"), (mit, "MIT"), (apache, "Apache-2.0")):
        assert (name, 0) in licenses.scan(f"{prose} {notice}")[1] and (name, 0) in licenses.scan(f"{prose} {notice} {prose}")[1]


def test_license_scan_finds_what_the_whole_text_holds():
    rng = random.Random(11)
    notices = [n for ns in licenses.TEMPLATES.values() for n in ns]
    texts = ["\n".join(["Some prose.", *textwrap.wrap(n, width), "More prose."]) for n in notices for width in (1, 20, 40, 60, 78)]
    texts += [f"/*\n * " + "\n * ".join(textwrap.wrap(n, 60)) + "\n */" for n in notices]
    for n in notices * 12:
        # up to four words left out, put in or replaced, amid prose and wrapped
        wording = n.split()
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(wording))
            wording[at : at + rng.randrange(2)] = ["other"] * rng.randrange(2)
            wording = wording or ["other"]
        before, after = words(rng, rng.randrange(200)), words(rng, rng.randrange(200))
        texts.append(rng.choice([" ", "\n", "  \n\t# "]).join([before, *wording, after]))
    texts += ["reproduction" + notices[2][len("Redistribution") :], " ".join(notices), *filter(None, ODD)]
    for text in texts:
        assert licenses.scan(text)[1] == whole_text_licenses(text), text
    assert sum(bool(whole_text_licenses(t)) for t in texts) > len(texts) // 2


def test_wording_differences_count_words():
    t = "a b c d".split()
    assert [licenses.wording_differences(t, x.split()) for x in ("z a b c d z", "a b x c d", "a c d", "a b c e", "")] == [0, 1, 1, 1, 4]


# ---- language sets


def invented_languages(n):
    """Likelihoods of ``n`` languages of invented words, and the words of each."""
    rng, rows, words_of = random.Random(1), [], []
    for _ in range(n):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 10)
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(60)]
        counts = np.bincount(langid.grams(" ".join(rng.choice(vocabulary) for _ in range(3000))), minlength=langid.BUCKETS) + 0.5
        rows.append(counts / counts.sum())
        words_of.append(vocabulary)
    return np.array(rows, np.float32), words_of


def test_language_sets_are_the_best_of_all_subsets():
    """The set that grows by one language at a time against every subset of four languages, by the same penalised likelihood."""
    likelihood, words_of = invented_languages(4)
    rng = random.Random(5)
    for _ in range(60):
        languages = rng.sample(range(4), rng.choice([1, 1, 2, 2, 3, 4]))
        idx = langid.grams(" ".join(rng.choice(words_of[k]) for k in languages for _ in range(rng.choice([3, 10, 40]))))

        def value(chosen):
            w, p = np.full(len(chosen), 1 / len(chosen)), likelihood[list(chosen)][:, idx].astype(float)
            for _ in range(400):  # plain EM
                of = w[:, None] * p
                w = (of / of.sum(axis=0)).mean(axis=1)
            return 2 * np.log(w @ p).sum() - 6.0 * np.log(max(len(idx), 2)) * len(chosen)

        best = max((s for k in range(1, 5) for s in combinations(range(4), k)), key=value)
        chosen, weights, _ = langid.mixture(idx, likelihood)
        assert set(chosen) == set(best) and abs(float(weights.sum()) - 1) < 1e-4


def test_a_prediction_is_that_of_plain_em():
    likelihood, words_of = invented_languages(3)
    model = langid.LanguageModel(["aa", "bb", "cc"], likelihood)
    for k, lang in enumerate(model.languages):
        text = " ".join(words_of[k][:50] + words_of[(k + 1) % 3][:10])
        pred, score, names, shares = langid.judge(text, model)
        assert pred == names[0] == lang and set(names) == {lang, model.languages[(k + 1) % 3]} and shares[0] > 0.7 and 0 <= score <= 1


def test_rows_of_one_id_are_sampled_one_by_one(spark):
    """A third of all rows with one id, each with its own text: about as many are taken as of other rows."""
    texts = [f"word{k} und mehr" for k in range(3000)]
    docs = spark.createDataFrame([(6 if k % 3 == 0 else k, t, "de") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    taken = [r[0] for r in docs.filter(common.in_sample(0.2, 2, "doc_id", "text")).select("doc_id").collect()]
    assert 400 < len(taken) < 800 and 130 < taken.count(6) < 270


# ---- simhash


def brute_components(fps, ids):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return {i: min(ids[k] for k in range(len(ids)) if group[k] == g) for i, g in zip(ids, group, strict=True)}


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_any_four_positions_hold_a_choice():
    assert len(simhash.CHOICES) == 20
    assert all(any(set(c) <= set(four) for c in simhash.CHOICES) for four in combinations(range(8), 4))


def test_posting_links_span_what_all_pairs_span():
    rng = random.Random(12)
    for _ in range(60):
        rows = []
        for key in range(6):
            hubs = [rng.getrandbits(64) for _ in range(rng.randint(1, 4))]
            fps = {rng.choice(hubs) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(rng.choice([1, 2, 3, 20, 60]))}
            rows += [(key, f - (1 << 64) if f >> 63 else f) for f in fps]
        rows.sort()
        key, fp = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]).view(np.uint64)
        pairs = simhash.posting_links(key, np.zeros_like(key), fp)
        assert len(pairs) < len(rows)
        group, want = list(range(len(rows))), list(range(len(rows)))
        merge = lambda g, i, j: [g[i] if x == g[j] else x for x in g]
        for i, j in pairs.tolist():
            group = merge(group, i, j)
        for i in range(len(rows)):
            for j in range(i):
                # links of four bits or fewer always share four bytes
                if key[i] == key[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 4:
                    want = merge(want, i, j)
        same = lambda g: {frozenset(i for i in range(len(g)) if g[i] == x) for x in g}
        assert same(group) == same(want)


@pytest.mark.parametrize("large", [5_000_000, 10])
def test_names_of_hot_keys(spark, large):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS v")
    names = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    got = join_names(rows, names, "k", 3000, large).collect()
    assert sorted((r.v, r.least) for r in got) == [(i, 0 if i % 3 == 0 else i) for i in range(3000)]


def test_components_of_a_hub_and_a_chain(spark, monkeypatch):
    from talentloom.llm import common, components

    monkeypatch.setattr(components, "join_names", lambda rows, names, key, total: common.join_names(rows, names, key, total, 1000))
    hub = spark.range(1, 20000).selectExpr("id AS u", "CAST(20000 AS long) AS v")
    chain = spark.range(30000, 30300).selectExpr("id AS u", "id + 1 AS v")
    got = components.connected_components(hub.unionByName(chain)).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {1: 20000, 30000: 301}


def test_fingerprint_zero_of_many_rows(spark):
    docs = spark.range(100_000).selectExpr("id AS doc_id", "CASE WHEN id % 1000 = 7 THEN concat('word ', id, ' and more words ', id) ELSE ' ' END AS text")
    got = simhash.near_duplicates(docs).filter("fp = 0").agg(F.count("*"), F.min("component_id"), F.max("component_id")).first()
    assert tuple(got) == (99_900, 0, 0)


@pytest.mark.parametrize("long_posting", [5000, 8])
def test_simhash_components_are_brute_force(spark, long_posting):
    rng = random.Random(4)
    base = [words(rng, 300, 1000) for _ in range(12)]
    texts = list(ODD)
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = simhash.near_duplicates(frame(spark, texts), long_posting).collect()
    fps = [slow_fingerprint(t) for t in texts]
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(fps, list(range(len(texts))))


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(6)
    fps = {0, (1 << 64) - 1}
    for _ in range(3):
        hub = rng.getrandbits(64)
        for _ in range(60):
            fps.add(hub ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    entries = spark.createDataFrame(signed, "fp long").withColumn("entry", F.col("fp"))
    for long_posting in (5000, 20):
        found = simhash.connected_components(simhash.link_fingerprints(entries, long_posting))
        got = {r.node: r.component for r in found.collect()}
        want = brute_components(fps, [s for (s,) in signed])
        assert {s: got.get(s, s) for (s,) in signed} == want


def test_one_document_of_each_group_stays(spark):
    texts = ["one two three four five", "one two three four five", "something else entirely here", None, ""]
    kept = simhash.keep_one_each(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and "score" in kept.columns
    same = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.lit(5).cast("long")))
    assert simhash.keep_one_each(same).count() == 3
    clash = same.withColumnRenamed("score", "row_number")
    assert {r["row_number"] for r in simhash.keep_one_each(clash).collect()} == {"clash"}
    assert simhash.keep_one_each(frame(spark, [])).count() == 0


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_no_local_folder_on_a_cluster(master):
    from types import SimpleNamespace

    from talentloom.llm import common

    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError):
        common.shared_dir(session)
    session.conf.get = lambda k, d=None: "file:///shared/"
    assert common.shared_dir(session) == "file:///shared"


def test_crc_mod_is_zlibs(spark):
    got = spark.range(50).select("id", registry.langid.crc_mod("id", 3).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_one_repeated_id_changes_no_other_group(spark):
    rng = random.Random(5)
    texts = [words(rng, 60, 4000) for _ in range(6)]
    rows = [(i, texts[i % 5]) for i in reversed(range(20))]
    odd = [(None, texts[5]), (None, texts[0]), (100, texts[5]), (100, "other words")]
    kept = [{(r.doc_id, r.text) for r in simhash.keep_one_each(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (rows, [odd[0], odd[1], *rows, *odd[2:]])]
    assert kept[0] == {(i, texts[i]) for i in range(5)}
    assert kept[1] == kept[0] | {(100, texts[5]), (100, "other words")}
