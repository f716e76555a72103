"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples (P) and unlabelled text (U) are used. With the class prior
``pi`` the risk is ``pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))``; when the second part falls
below zero its gradient is reversed, as the estimator prescribes. The classifier is a
logistic model in numpy over hashed words and word beginnings (presence, not counts).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.config import stage_table

BUCKETS = 1 << 18
STEMS = (4, 5, 6, 7)  # lengths of word beginnings used next to the whole word
TRIM = ".,;:!?\"'()[]{}*#%&<>|-_"  # fixed value: marks cut off both ends of a word
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 8_000  # bound of the training sample, rows of least hash first
FEATURES = 256  # buckets a model uses, at most: those that tell most
TELLING = 5.5  # z-score that chance reaches in one of BUCKETS at less than one time in a hundred
CACHE = 50_000  # words whose buckets a worker remembers


@dataclass(frozen=True)
class Model:
    """Buckets in use (ascending), their weights and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


class _Words(dict):
    """Word to its feature buckets; starts again when it has grown to ``CACHE``."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        w = word.decode("utf-8", "replace").strip(TRIM).lower()
        found = ()
        if w:
            grams = [w + "$", *(w[:k] for k in STEMS if len(w) > k)]
            found = tuple(zlib.crc32(g.encode("utf-8", "replace")) & (BUCKETS - 1) for g in grams)
        self[word] = found
        return found


_words = _Words()


def features(text: str | None) -> np.ndarray:
    """Distinct feature buckets of a whole text; empty for null, empty or wordless text."""
    found: set[int] = set()
    for w in set((text or "").encode("utf-8", "replace").split()):
        found.update(_words[w])
    return np.fromiter(found, np.int64, len(found))


def _rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets or [np.empty(0, np.int32)]), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])


def select(p: np.ndarray, u: np.ndarray, n: int, m: int, most: int = FEATURES) -> np.ndarray:
    """Buckets that tell positive from unlabelled texts, at most ``most``, ascending.

    ``p`` and ``u`` say how many of the ``n`` positive and ``m`` unlabelled texts hold each bucket.
    """
    share = (p + u + 1.0) / (n + m + 2.0)
    z = (p / max(1, n) - u / max(1, m)) / np.sqrt(share * (1 - share) * (1 / max(1, n) + 1 / max(1, m)))
    z[p + u < 4] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] >= TELLING])


def flat(prior: float) -> Model:
    """The model of a table with nothing to learn from: every text gets the prior."""
    prior = float(np.clip(prior, 1e-3, 0.999))
    return Model(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Model of a few texts' features held in memory, see :func:`minimise`."""
    if not positive or not unlabelled:
        return flat(prior)
    (pc, pr), (uc, ur) = _rows(positive), _rows(unlabelled)
    buckets = select(np.bincount(pc, minlength=BUCKETS), np.bincount(uc, minlength=BUCKETS), len(positive), len(unlabelled))
    keep_p, keep_u = np.isin(pc, buckets), np.isin(uc, buckets)
    return minimise(buckets, (pc[keep_p], pr[keep_p], len(positive)), (uc[keep_u], ur[keep_u], len(unlabelled)), prior)


def minimise(buckets: np.ndarray, p: tuple, u: tuple, prior: float, rounds: int = 800, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Minimises the non-negative risk over ``buckets`` by full-batch Adam; deterministic.

    ``p`` and ``u`` are (bucket, row, number of rows) of the positive and unlabelled texts, of which only
    ``buckets`` are listed. Without positives, unlabelled text or telling buckets nothing can
    be learned: the model then gives every text the prior.
    """
    model = flat(prior)
    prior = float(np.clip(prior, 1e-3, 0.999))
    if not p[2] or not u[2] or not len(buckets):
        return model
    p, u = ((np.searchsorted(buckets, x[0]), *x[1:]) for x in (p, u))
    w = np.zeros(len(buckets) + 1)
    w[-1] = model.bias
    first, second = np.zeros_like(w), np.zeros_like(w)

    def margin(x: tuple) -> np.ndarray:
        return np.bincount(x[1], w[x[0]], x[2]) + w[-1]

    def slope(x: tuple, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(x[0], g[x[1]], len(buckets)), g.sum())

    for k in range(1, rounds + 1):
        zp, zu = margin(p), margin(u)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # Logistic losses: l(+) = log(1 + exp(-z)), l(-) = log(1 + exp(z)).
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        plus = slope(p, prior * (sp - 1) / p[2])
        minus = slope(u, su / u[2]) - slope(p, prior * sp / p[2])
        grad = plus + minus if rest >= 0 else -minus
        grad[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Model(buckets, w[:-1], float(w[-1]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def scores(texts: Iterator[str | None], model: Model) -> np.ndarray:
    weights = np.zeros(BUCKETS)
    weights[model.buckets] = model.weights
    return _sigmoid(np.array([weights[features(t)].sum() + model.bias for t in texts], dtype=float))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Trains on ``docs`` (doc_id, text) with the confirmed examples of ``labels`` (doc_id, toxic).

    Documents labelled 1 are the positives; all others are unlabelled text, whatever their label says.
    The prior is the share of positives among the labelled. The sample is bounded: at most
    ``max_positive`` and ``max_unlabelled`` documents, those of least hash of doc_id, so one
    table always gives one model. Repeated labels count once; null ids and null labels are left out.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    share = known.join(own.select("doc_id").distinct(), "doc_id").agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]

    @F.pandas_udf("array<int>")
    def buckets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).astype(np.int32))

    ids = own.where("doc_id is not null").select("doc_id").distinct()
    toxic = known.where("toxic = 1").select("doc_id")
    first = [F.xxhash64("doc_id"), F.col("doc_id")]  # the ids are chosen before any text is read
    positive = ids.join(toxic, "doc_id", "left_semi").orderBy(*first).limit(max_positive).withColumn("toxic", F.lit(True))
    unlabelled = ids.join(toxic, "doc_id", "left_anti").orderBy(*first).limit(max_unlabelled).withColumn("toxic", F.lit(False))
    sample = own.join(positive.unionByName(unlabelled), "doc_id").select("toxic", buckets("text").alias("f"))
    sample = stage_table(sample.withColumn("row", F.monotonically_increasing_id()))
    n, m = sample.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    # At most BUCKETS counts reach the driver, then the few buckets of the model in each text of the sample.
    each = sample.select("row", "toxic", F.explode("f").alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u")).toArrow()
    at = counts.column("bucket").to_numpy()
    seen = np.zeros((2, BUCKETS))
    seen[0, at], seen[1, at] = counts.column("p").to_numpy(), counts.column("u").to_numpy()
    chosen = select(*seen, n, m)
    held = each.where(F.col("bucket").isin(chosen.tolist())).toArrow() if len(chosen) else each.limit(0).toArrow()
    bucket, row, is_toxic = (held.column(c).to_numpy() for c in ("bucket", "row", "toxic"))
    sides = []
    for side, size in ((is_toxic.astype(bool), n), (~is_toxic.astype(bool), m)):
        order = np.lexsort((bucket[side], row[side]))
        sides.append((bucket[side][order], np.unique(row[side][order], return_inverse=True)[1], size))
    return minimise(chosen, *sides, share or 0.0)


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic, 0 to 1, for whole texts; null and empty texts get the intercept's."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(texts, model), dtype="float64")

    return of(text)


def fold(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id's text modulo ``parts``; a null id falls into part 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0))
