"""Quality classifier by positive-unlabelled learning.

A linear model on features of the text minimises the non-negative unbiased risk: trusted
positives and the marginal of unlabelled text stand for the missing negatives. With the squared
loss the risk needs no more of the unlabelled rows than their count, sums and products, so these are summed
over all rows in one pass and the minimum is exact. Where the estimated negative risk would fall
below zero, its gradient is followed upwards instead. The class prior is the least ratio of
the two tails, unlabelled over positive, above any margin; negative labels are never used. The minimum
of this risk is twice the posterior less one, so the score is read off the margin.

Bounded is only the sample of trusted positives (``most_labelled`` rows). Features are written once; each
further pass reads them. Texts are taken whole, as features of fixed length.

Texts that are null or empty have the features of an empty text and get a score. A document with
several labels counts as positive if most are (half aren't); labels without a document or a quality train
nothing. Rows with the same id or text each count. Without any positive label all scores are 0.5. An
empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import copies_in_sample, crc_mod, field_sql, keep_rows, map_arrow, materialize, sample_fraction, task_number

THRESHOLD = 0.3


def _byte_class(c: int) -> int:
    if c >= 128:
        return 0
    for k, kind in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "#$%&*@^~=+", "'\"()[]{}-_/\\<>`"), 1):
        if chr(c) in kind:
            return k
    return 12


CLASSES = 13
#: No shape or repetition feature is larger.
LARGEST = 4.0
_CLASS = bytes(map(_byte_class, range(256)))
N_STATS = 10


def features(text: str | None) -> np.ndarray:
    """Shares of neighbouring character classes (as square roots), then shape and repetition."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.frombuffer(raw.translate(_CLASS), np.uint8)
    out = np.zeros(CLASSES * CLASSES + N_STATS, np.float32)
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1].astype(np.int16) * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / (len(kinds) - 1))
    words = raw.lower().split()
    if words:
        n, seen = len(words), Counter(words)
        lengths = np.fromiter(map(len, words), np.float32, n)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        top = seen.most_common(5)
        out[CLASSES * CLASSES :] = np.minimum(LARGEST, [
            np.log1p(n) / 10,
            len(seen) / n,
            len(seen) / n**0.8,
            sum(map(bytes.__eq__, words[1:], words[:-1])) / n,
            top[0][1] / n,
            sum(c for _, c in top) / n,
            1 - len(set(lines)) / len(lines),
            lengths.mean() / 10,
            lengths.std() / 10,
            np.log1p(len(raw) / len(lines)) / 10,
        ])
    return out


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.margin(x.astype(np.float64)) + 1) / 2, 0, 1)


WIDTH = CLASSES * CLASSES + N_STATS
#: Margins are counted in cells of 1 / CELLS between -SPAN and SPAN.
SPAN, CELLS = 8, 256


def constant(score: float = 0.5) -> QualityModel:
    return QualityModel(np.zeros(WIDTH), 2 * score - 1, score)


def products(x: np.ndarray) -> np.ndarray:
    """Count, sums and products of rows: the products of the rows with a one put behind."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    return x.T @ x


def fit_nnpu(unlabelled: np.ndarray, positive: np.ndarray, prior: float, ridge: float = 1e-3, steps: int = 2000) -> tuple[np.ndarray, float]:
    """Weights and bias at the least non-negative risk with squared loss, from ``products`` of both sides.

    risk = prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]), l(f) = (1 - f)^2 / 4. Where the
    second part isn't below zero at the least unbiased risk, that is the least of both.
    """
    n, m = unlabelled[-1, -1], positive[-1, -1]
    mean = unlabelled[-1, :-1] / n
    scale = 1 / np.sqrt(np.maximum(np.diag(unlabelled)[:-1] / n - mean**2, 1e-6))
    # the moments of standardised rows
    shift = np.diag(np.append(scale, 1.0))
    shift[-1, :-1] = -mean * scale
    u, p = shift.T @ (unlabelled / n) @ shift, shift.T @ (positive / m) @ shift
    # few rows say little about each product
    held = np.diag(np.append(np.full(len(mean), ridge + len(mean) / (10 * n)), 1e-9))
    w = np.linalg.solve(u + held, 2 * prior * p[-1] - u[-1])

    def negative(w: np.ndarray) -> float:
        """E_U[l(-f)] - prior * E_P[l(-f)]."""
        of = lambda k: 1 + 2 * k[-1] @ w + w @ k @ w
        return (of(u) - prior * of(p)) / 4

    def risk(w: np.ndarray) -> float:
        return prior * (1 - 2 * p[-1] @ w + w @ p @ w) / 4 + max(0.0, negative(w)) + w @ held @ w / 4

    if negative(w) < 0:
        rate, w = 1 / (np.linalg.eigvalsh(u + prior * p + held)[-1] / 2), np.zeros(len(w))
        best, least = w, risk(w)
        for _ in range(steps):
            up = (u[-1] + u @ w - prior * (p[-1] + p @ w)) / 2
            w = w + rate * up if negative(w) < 0 else w - rate * (prior * (p @ w - p[-1]) / 2 + up + held @ w / 2)
            if (now := risk(w)) < least:
                best, least = w, now
        w = best
    back = shift @ w
    return back[:-1], float(back[-1])


def least_tail_ratio(unlabelled: np.ndarray, positive: np.ndarray, deepest: float = 0.1) -> float:
    """The class prior, from counts of margins by cell: no more than this share can be positive.

    Takes the thresholds that at least ``deepest`` of the positives are above; the ratio gets one standard
    error of the unlabelled tail, lest the least of many noisy ones is taken.
    """
    n = unlabelled.sum()
    u, p = (np.cumsum(c[::-1]) / c.sum() for c in (unlabelled, positive))
    far = p >= deepest
    return float(np.clip(((u[far] + np.sqrt(u[far] / n)) / p[far]).min(), 0.01, 0.99))


def cells(margins: np.ndarray) -> np.ndarray:
    return np.clip((margins + SPAN) * CELLS, 0, 2 * SPAN * CELLS - 1).astype(np.int64)


def feature_rows(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns and x, the features as bytes of 32-bit floats."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        once = {t: features(t).tobytes() for t in set(texts)}
        x = [once[t] for t in texts]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(x, pa.binary())], [*kept, "x"])

    return map_arrow(docs.select(*kept, "text"), run, ", ".join([*(field_sql(docs, c) for c in kept), "x binary"]))


def _summed(parts: DataFrame, together: int = 64) -> np.ndarray:
    """The sum of matrices in rows (at, m), by a tree: at most ``together`` come to one task or the driver."""

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        total = sum(np.frombuffer(m, np.float64) for m in group.column("m").to_pylist())
        at = group.column("at")[0].as_py() // together
        return pa.table({"at": pa.array([at], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

    parts = materialize(parts, "products")
    while parts.count() > together:
        parts = materialize(parts.groupBy(F.floor(F.col("at") / together)).applyInArrow(add, "at long, m binary"), "products")
    rows = sorted((r["at"], r["m"]) for r in parts.collect())
    if not rows:
        return np.zeros((WIDTH + 1, WIDTH + 1))
    return sum(np.frombuffer(m, np.float64) for _, m in rows).reshape(WIDTH + 1, WIDTH + 1)


def _matrix(x: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.float32).reshape(len(x), WIDTH)


def all_products(rows: DataFrame, together: int = 64) -> np.ndarray:
    """``products`` of all rows with features x: one matrix a task, summed by a tree."""

    def run(batches):
        total = np.zeros((WIDTH + 1, WIDTH + 1))
        for batch in batches:
            total += products(_matrix(batch.column("x").to_pylist()))
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array([task_number()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "m"])

    return _summed(rows.select("x").mapInArrow(run, "at long, m binary"), together)


def margin_counts(rows: DataFrame, weights: np.ndarray, bias: float) -> np.ndarray:
    """How many rows have their margin in each cell; a row for each cell comes to the driver."""

    def run(batches):
        total = np.zeros(2 * SPAN * CELLS, np.int64)
        for batch in batches:
            total += np.bincount(cells(_matrix(batch.column("x").to_pylist()) @ weights + bias), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["cell", "n"])

    counted = rows.select("x").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 * SPAN * CELLS, np.int64)
    for r in counted:
        out[r["cell"]] = r["n"]
    return out


def trusted_positives(rows: DataFrame, labels: DataFrame, most_labelled: int) -> np.ndarray:
    """Features of about ``most_labelled`` rows with a positive label, repeated rows repeated.

    Rows are sampled, not ids: of rows with the same id and features each counts, but one goes to the driver.
    """
    positive = labels.filter(F.col("quality").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.avg("quality").alias("q")).filter("q > 0.5").select("doc_id")
    labelled = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("rows")).join(positive, "doc_id"), "positives")
    fraction = sample_fraction(labelled.agg(F.sum("rows")).first()[0] or 0, most_labelled)
    # the rows to take of each id, as a share of its rows; about most_labelled ids at the most
    take = copies_in_sample(F.col("rows"), fraction, "doc_id", F.lit(5))
    chosen = labelled.withColumn("take", take).filter("take > 0").select("doc_id", (F.col("take") / F.col("rows")).alias("share"))
    equal = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "x").agg(F.count("*").alias("n"), F.first("share").alias("share"))
    times = F.when(F.col("share") >= 1, F.col("n")).otherwise(copies_in_sample(F.col("n"), F.col("share"), "doc_id", "x", F.lit(5)))
    picked = equal.select("doc_id", "x", times.alias("times")).filter("times > 0").toPandas().sort_values(["doc_id", "x"], kind="stable")
    return np.repeat(_matrix(picked["x"].map(bytes).tolist()), picked["times"].to_numpy(dtype=np.int64), axis=0)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 16000) -> QualityModel:
    """From documents that aren't held out: all of them as unlabelled, about ``most_labelled`` as positives."""
    train = docs.filter(crc_mod("doc_id", 5) != 0)
    rows = materialize(feature_rows(train, "doc_id"), "features")
    p = trusted_positives(rows, labels, most_labelled)
    if not len(p):
        return constant()
    unlabelled, positive = all_products(rows), products(p)
    # the order of margins hardly depends on the prior: any will do to find it
    weights, bias = fit_nnpu(unlabelled, positive, 0.5)
    prior = least_tail_ratio(margin_counts(rows, weights, bias), np.bincount(cells(p @ weights + bias), minlength=2 * SPAN * CELLS))
    return QualityModel(*fit_nnpu(unlabelled, positive, prior), prior)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([features(t) for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.score(x), pa.float64())], ["doc_id", "held_out", "score"])

    marked = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    out = map_arrow(marked, run, f"{field_sql(docs, 'doc_id')}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents at or over the threshold, with all their columns."""
    return keep_rows(docs, lambda texts: (model.score(np.stack([features(t) for t in texts])) >= THRESHOLD).tolist())
