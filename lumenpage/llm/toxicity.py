"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives. The unlabelled texts are those of
the labelled rows of the training fold, with their labels hidden, so that both
samples come from the same rows and their mixture is that of the class prior.
A linear numpy classifier over the presence of words and word heads minimises
the class-prior-corrected risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the logistic loss l. Where the second term falls below zero, the step
goes against it, as in the published algorithm.

Null and empty texts have no features and get the score of the bias alone.
Repeated rows are scored one by one, equal texts get equal scores. An empty
table gives no rows. Without any confirmed toxic document every score is 0.
Texts of any length are scored whole; what is held beside a text follows from
its words (about 50 bytes each). Labels, lang, source and doc_id never enter a
score; further columns are kept, but for score and predicted, which are
replaced. Labels that are null, or of an id without a text, teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.llm.common import PUNCT, parts, steps, text_bytes, word_hashes

#: Bytes of the word heads that are features beside the words themselves.
HEADS = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityModel:
    """Hashes of the features in ascending order, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        raw, at = text_bytes(texts)
        if not self.prior:
            return np.zeros(len(at) - 1)
        out = np.full(len(at) - 1, self.bias)
        if len(self.features):
            for i, j in steps(at):
                row, hashed = features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                place = np.minimum(np.searchsorted(self.features, hashed), len(self.features) - 1)
                known = self.features[place] == hashed
                pair = np.unique(row[known] * len(self.features) + place[known])
                out[i:j] += np.bincount(pair // len(self.features), self.weights[pair % len(self.features)], j - i)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of a feature) for each word and word head of some rows."""
    words, _, _, first, heads = word_hashes(raw, at, PUNCT, HEADS)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    rows, hashed = [row], [words]
    for cut in heads:
        rows.append(row[cut != 0])
        hashed.append(cut[cut != 0])
    return np.concatenate(rows), np.concatenate(hashed)


def train(docs: DataFrame, labels: DataFrame, training_fold, *, max_positive: int = 6000, max_unlabelled: int = 12000, max_features: int = 8192, epochs: int = 300, seed: int = 7) -> ToxicityModel:
    """Fit on at most ``max_positive`` confirmed toxic rows, and ``max_unlabelled`` labelled rows with their labels hidden, of the training fold.

    ``training_fold`` maps a doc_id column to a boolean column. Both samples of
    labelled rows are those of the smallest hash of doc_id, so they are the same
    at each call. The prior is the share of toxic rows among all labelled
    training rows (with half a row added to either class).
    """
    seen = labels.where(training_fold(F.col("doc_id")) & F.col("toxic").isNotNull())
    total, toxic = seen.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not toxic:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0)
    order = F.xxhash64("doc_id", F.lit(seed))
    # a document that is confirmed toxic by any row is a positive; both id lists are bounded, so they may be broadcast
    positive = seen.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(max_positive).withColumn("positive", F.lit(1))
    unlabelled = seen.select("doc_id").distinct().orderBy(order, "doc_id").limit(max_unlabelled).withColumn("positive", F.lit(0))
    texts = docs.select("doc_id", "text").join(F.broadcast(positive.union(unlabelled)), "doc_id").select("positive", "text")
    rows = texts.mapInArrow(_feature_rows, "positive int, features binary").persist(StorageLevel.DISK_ONLY)
    try:
        chosen = choose(rows, max_features)
        sparse = rows.mapInArrow(_only(chosen), "positive int, features binary").toArrow()
    finally:
        rows.unpersist()
    places = [np.frombuffer(x.as_py(), np.int32) for x in sparse["features"]]
    return fit(chosen, places, np.array(sparse["positive"]), (toxic + 0.5) / (total + 1), epochs)


def _feature_rows(batches):
    for batch in parts(batches, "text"):
        raw, at = text_bytes(batch["text"])
        sets = []
        for i, j in steps(at):
            row, hashed = features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(j - i + 1))
            hashed = hashed[order]
            sets += [np.unique(hashed[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["positive"], pa.array(sets, pa.binary())], ["positive", "features"])


def _count_batches(batches):
    for batch in batches:
        positive = batch["positive"].to_numpy().astype(bool)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch["features"]]
        names, place = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        mine = np.repeat(positive, [len(x) for x in sets])
        in_p = np.bincount(place[mine], minlength=len(names))
        in_all = np.bincount(place, minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(in_p), pa.array(in_all - in_p)], ["feature", "in_p", "in_u"])


def _only(chosen: np.ndarray):
    def run(batches):
        for batch in batches:
            sets = [np.flatnonzero(np.isin(chosen, np.frombuffer(x.as_py(), np.uint64))).astype(np.int32).tobytes() for x in batch["features"]]
            yield pa.RecordBatch.from_arrays([batch["positive"], pa.array(sets, pa.binary())], ["positive", "features"])

    return run


def choose(rows: DataFrame, max_features: int) -> np.ndarray:
    """The features whose rate among positives most exceeds that among unlabelled texts (z over 4), in ascending order.

    Features of fewer than 5 positives, or 1 %, may be those of one text and its copies.
    """
    n = {r[0]: r[1] for r in rows.groupBy("positive").count().collect()}
    n_p, n_u = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    counts = rows.mapInArrow(_count_batches, "feature long, in_p long, in_u long").groupBy("feature").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    mean = (F.col("in_p") + F.col("in_u")) / (n_p + n_u)
    z = (F.col("in_p") / n_p - F.col("in_u") / n_u) / F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    best = counts.where(F.col("in_p") >= max(5, 0.01 * n_p)).select("feature", z.alias("z")).where("z > 4").orderBy(F.desc("z"), "feature").limit(max_features)
    return np.sort(np.array([r[0] for r in best.collect()], np.int64).view(np.uint64))


def fit(chosen: np.ndarray, places: list[np.ndarray], positive: np.ndarray, prior: float, epochs: int = 300) -> ToxicityModel:
    """Minimise the risk; ``places`` has the chosen features of each text by their numbers."""
    row = np.repeat(np.arange(len(places)), [len(x) for x in places])
    col = np.concatenate([*places, np.zeros(0, np.int32)])
    weights, bias = _minimise(row, col, positive.astype(bool), len(chosen), prior, epochs)
    return ToxicityModel(chosen, weights, bias, prior)


def _minimise(row: np.ndarray, col: np.ndarray, positive: np.ndarray, n_features: int, prior: float, epochs: int) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk over all rows."""
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    rate, decay = 0.05, 1e-4
    for t in range(1, epochs + 1):
        g = np.bincount(row, theta[col], len(positive)) + theta[-1]
        up = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        neg_loss = np.logaddexp(0, g)
        rest = neg_loss[~positive].mean() - prior * neg_loss[positive].mean() if n_u else 0.0
        slope = np.zeros(len(positive))
        if rest >= 0:
            slope[positive] = prior * ((up[positive] - 1) - up[positive]) / n_p
            slope[~positive] = up[~positive] / n_u
        else:
            slope[positive] = prior * up[positive] / n_p
            slope[~positive] = -up[~positive] / n_u
        grad = np.append(np.bincount(col, slope[row], n_features), slope.sum()) + decay * np.append(theta[:-1], 0)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _score(model: ToxicityModel):
    """The score of a text; only the texts go to Python, and only numbers come back."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))

    return scored(F.col("text"))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The columns of ``docs`` (but any of these two names) with score and predicted (1 if score >= threshold)."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*names, _score(model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns as they are."""
    return docs.where(_score(model) < threshold)


def held_out(doc_id):
    """The fold that is never learnt from: crc32 of doc_id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document (doc_id, held_out, score, predicted)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, lambda doc_id: ~held_out(doc_id))
    scored = score(docs, model).select("doc_id", "score", "predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
