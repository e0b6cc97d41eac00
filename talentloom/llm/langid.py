"""Language identification as a mixture: each document's language proportions by EM.

Letter trigrams of the labelled training documents give each language a smoothed n-gram
distribution. A document's trigrams come from a mixture of languages; expectation-maximisation
estimates the proportions, and a language joins the document's set only if the likelihood it adds
exceeds a penalty for one more parameter.

Bounded are the labelled rows that the model is fitted on: about ``most_per_language`` of each language, taken by a hash of id and
text (rows that are alike in both are taken or left together), and the ``most_languages`` languages with most rows (equal ones by
name; others are never predicted), so that what is collected and broadcast has a size that doesn't depend on the data. Texts are
taken whole.

Null texts and texts without a letter are ``und`` with score 0, as is all text when no language
could be learned. Of equally likely languages the first by name is taken. Rows without a lang train nothing.
Repeated rows are repeated rows of the result. Extra columns are left out. An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import crc_mod, field_sql, in_sample, keep_rows, map_arrow, sample_fraction

BUCKETS = 1 << 16
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """The bucket of the trigram around each letter; other characters count as one blank."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    c = np.where(letter, c, 32).astype(np.uint32)
    mixed = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16))[letter[1:-1]].astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    likelihood: np.ndarray  # a row for each language, a column for each bucket


def fit(docs: DataFrame, most_per_language: int = 4000, smoothing: float = 0.5, most_languages: int = 200) -> LanguageModel:
    """From text and lang of the documents that aren't held out, at most about ``most_per_language`` each."""
    train = docs.filter((crc_mod("doc_id", 3) != 1) & F.col("lang").isNotNull())
    largest = train.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_languages)
    sizes = {r["lang"]: r["count"] for r in largest.collect()}
    wanted = F.lit(False)
    for lang, n in sizes.items():
        wanted = wanted | ((F.col("lang") == lang) & in_sample(sample_fraction(n, most_per_language), 2, "doc_id", "text"))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                at += np.bincount(grams(text), minlength=BUCKETS)
        for lang, at in totals.items():
            some = np.flatnonzero(at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(at[some])], ["lang", "bucket", "n"])

    counted = train.filter(wanted).select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS a language
    languages = sorted(rows["lang"].unique().tolist())
    at = np.full((len(languages), BUCKETS), smoothing)
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        at[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return LanguageModel(languages, (at / at.sum(axis=1, keepdims=True)).astype(np.float32))


def proportions(p: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """EM: the mixture weights of the rows of ``p`` and the log-likelihood."""
    n, w = p.shape[1], np.full(len(p), 1 / len(p), np.float32)
    for _ in range(steps):
        new = w * (p @ (1 / (w @ p))) / np.float32(n)
        moved = float(np.abs(new - w).max())
        w = new
        if moved < 1e-4:
            break
    return w / w.sum(), float(np.log(w @ p, dtype=np.float64).sum())


def mixture(idx: np.ndarray, likelihood: np.ndarray, penalty: float = 6.0, steps: int = 25) -> tuple[list[int], np.ndarray, float]:
    """The document's languages, their proportions, and how sure the best single one is.

    Starts from the best single language. The one whose likelihood rises fastest is tried next
    and kept if it adds more than ``penalty`` * log(n) to twice the log-likelihood.
    """
    p = likelihood[:, idx]
    single = np.log(p).sum(axis=1, dtype=np.float64)
    chosen = [int(single.argmax())]
    sure = 1 / np.exp(np.clip(single - single.max(), -700, 0)).sum()
    weights, best = np.ones(1, np.float32), float(single.max())
    while len(chosen) < len(p):
        slope = p @ (1 / (weights @ p[chosen])) / len(idx)
        slope[chosen] = 0
        more = int(slope.argmax())
        if slope[more] <= 1:
            break
        new, value = proportions(p[[*chosen, more]], steps)
        if 2 * (value - best) <= penalty * np.log(max(len(idx), 2)):
            break
        chosen, weights, best = [*chosen, more], new, value
    return chosen, weights, float(sure)


def judge(text: str | None, model: LanguageModel) -> tuple[str, float, list[str], list[float]]:
    """Prediction, score, and the languages with their proportions, largest first."""
    idx = grams(text)
    if not len(idx) or not model.languages:
        return UNKNOWN, 0.0, [], []
    chosen, weights, sure = mixture(idx, model.likelihood)
    order = np.argsort(-weights, kind="stable")
    names, shares = [model.languages[chosen[k]] for k in order], [float(weights[k]) for k in order]
    return names[0], min(1.0, shares[0] * sure), names, shares


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (name and proportion, largest first)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages * BUCKETS floats

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score, names, shares = zip(*(judge(t, held.value) for t in batch.column("text").to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
            ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"],
        )

    marked = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return map_arrow(marked, run, f"{field_sql(docs, 'doc_id')}, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents whose main language is known, whatever its share of the text, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list) -> list[bool]:
        return [judge(t, held.value)[0] != UNKNOWN for t in texts]

    return keep_rows(docs, keep)
