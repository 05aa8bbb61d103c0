"""Quality selection by importance resampling.

Two generative models over hashed 1- and 2-grams, one of the target (documents labelled good) and one of all raw text,
give each document the log ratio of its likelihoods, per n-gram and for a stated number of n-grams (EVIDENCE), so that
a long text's weight does not drown the draw. A document's key is that log weight and a Gumbel number drawn from its id
and text; the documents with the k largest keys are the sample, which are k draws by weight without replacement. k may
be given. Otherwise it is the expected size of a sample that takes each document with probability 1 - exp(-exp(w - t)),
t lying MARGIN below the median weight of good labelled documents: such a document is left out about twice in 10**9
draws, and one whose weight is d below t is taken about exp(-d) of the time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, in_batches, shielded
from .textkit import batches, encode, ngrams

BUCKETS = 1 << 16
#: Labelled documents that the target model and the level are fitted on, at most: those with the smallest hashes.
MOST_LABELLED = 20_000
#: n-grams that a document's evidence counts for, and how far below good documents the level of sampling lies.
EVIDENCE, MARGIN = 5.0, 3.0
SMOOTHING = 0.5
SEED = 20_240_601
BINS = 1024
SCORES = "log_weight double, n_grams long, gumbel_key double"


def _chunks(texts: list, n_buckets: int):
    """(first text, buckets, starts) for consecutive texts."""
    raw = [encode(t) for t in texts]
    for lo, hi in batches(raw):
        yield lo, *ngrams(raw[lo:hi], n_buckets)


def _counts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """How often each bucket occurs in all texts; counts of a partition are summed up before the shuffle."""

    def count(parts):
        held("quality")
        total = np.zeros(n_buckets, np.int64)
        for pdf in parts:
            for _, b, _ in _chunks(pdf["text"].tolist(), n_buckets):
                total += np.bincount(b, minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    return in_batches(docs.select("text")).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """text and quality of at most `most` labelled documents; the small side's size is bound by `most`."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality")


class Model:
    """log ratio of each bucket, and the median log weight of good labelled documents (None without any)."""

    def __init__(self, ratios: np.ndarray, good: float | None, n_buckets: int):
        self.ratios, self.good, self.n_buckets = ratios, good, n_buckets


def fit(docs: DataFrame, labels: DataFrame, *, n_buckets: int = BUCKETS, most: int = MOST_LABELLED, smoothing: float = SMOOTHING) -> Model:
    """The raw model counts every document; the target model and the level take the labelled sample.

    The driver receives n_buckets counts a model and one number for each good document of the sample.
    """
    sample = cut(labelled_sample(docs, labels, most).filter("quality > 0").select("text"))
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    for counts, texts in ((raw, docs), (target, sample)):
        for b, n in _counts(texts, n_buckets).collect():
            counts[b] = n
    if not target.sum():
        return Model(np.zeros(n_buckets), None, n_buckets)
    share = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * n_buckets))
    ratios = share(target) - share(raw)

    def means(parts):
        for pdf in parts:
            total, n = _sums(pdf["text"].tolist(), ratios, n_buckets)
            yield pd.DataFrame({"mean": (total / np.maximum(n, 1))[n > 0]})

    return Model(ratios, EVIDENCE * float(np.median([m for (m,) in sample.mapInPandas(means, "mean double").collect()])), n_buckets)


def _sums(texts: list, ratios: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for lo, b, starts in _chunks(texts, n_buckets):
        sums = np.concatenate([[0.0], np.cumsum(ratios[b])])
        k = len(starts) - 1
        total[lo : lo + k] = sums[starts[1:]] - sums[starts[:-1]]
        n[lo : lo + k] = np.diff(starts)
    return total, n


def score(docs: DataFrame, model: Model, *, evidence: float = EVIDENCE, seed: int = SEED) -> DataFrame:
    """docs with log_weight, n_grams and gumbel_key. Texts without tokens have weight 0."""
    ratios, n_buckets = model.ratios, model.n_buckets
    noise = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    unit = (F.shiftrightunsigned(noise, 11).cast("double") + 0.5) / float(1 << 53)

    def weigh(parts):
        held("quality")
        for pdf in parts:
            total, n = _sums(pdf["text"].tolist(), ratios, n_buckets)
            weight = np.round(evidence * total / np.maximum(n, 1), 9)
            pdf["log_weight"], pdf["n_grams"] = weight, n
            pdf["gumbel_key"] = weight - np.log(-np.log(pdf.pop("unit").to_numpy()))
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_batches(docs.withColumn("unit", unit)).mapInPandas(weigh, f"{schema}, {SCORES}")


def kth_largest(keys: DataFrame, k: int, column: str = "gumbel_key") -> float:
    """The k-th largest value, by counting in ever finer bins; the driver sees BINS counts a pass."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    if lo is None or k <= 0:
        return float("inf")
    while lo < hi:
        width = (hi - lo) / BINS
        inside = keys.filter((F.col(column) >= lo) & (F.col(column) <= hi))
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col(column) - lo) / width).cast("int"))
        found = inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bin"))
        for _, n, lo, hi in found.collect():  # noqa: B007
            if k <= n:
                break
            k -= n
        if width <= 0:
            break
    return float(lo)


def sample_size(weights: DataFrame, model: Model, margin: float = MARGIN) -> int:
    """The expected size of the sample at the model's level; all rows without one."""
    if model.good is None:
        return weights.count()
    above = F.least(F.col("log_weight") - (model.good - margin), F.lit(30.0))
    return round(weights.agg(F.sum(1 - F.exp(-F.exp(above)))).first()[0] or 0)


def resample(docs: DataFrame, labels: DataFrame, *, k: int | None = None, margin: float = MARGIN, **how) -> tuple[DataFrame, DataFrame, float]:
    """Scored docs, their scores by id as written down, and the key from which a document is in the sample.

    Equal keys at the edge are all in it.
    """
    fitting = {name: how.pop(name) for name in ("n_buckets", "most", "smoothing") if name in how}
    model = fit(docs, labels, **fitting)
    scores = cut(score(docs.select("doc_id", "text"), model, **how).drop("text"))
    return score(docs, model, **how), scores, kth_largest(scores, sample_size(scores, model, margin) if k is None else k)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, log_weight, n_grams, gumbel_key and selected for every row of docs.

    Null and empty texts weigh 0, as much as raw text on the average; without labelled good documents all are selected.
    """
    _, scores, edge = resample(docs.select("doc_id", "text"), labels, **how)
    return scores.withColumn("selected", F.col("gumbel_key") >= edge)


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are in the sample, as they were."""
    plain, restored = shielded(docs, "doc_id", "text")
    scored, _, edge = resample(plain, labels, **how)
    return restored(scored.filter(F.col("gumbel_key") >= edge))
