"""Quality classifier: positive-unlabelled learning by the non-negative unbiased risk.

Trusted positives are labelled good texts, the unlabelled sample is web text of any
kind. With class prior p, positives P and unlabelled U, the risk
``p R+(P) + max(0, R-(U) - p R-(P))`` is minimised; where the bracket is negative,
the step goes against it (Kiryo et al., 2017). The prior is estimated from the
scores of a first classifier of P against U: the least ratio, over thresholds, of
the share of U above it to the share of P above it, each with its confidence bound
(the best bin of Garg et al., 2021).

A score comes from statistics of the whole text, each cut into bins at quantiles
of the training sample, so the model is a sum of step functions. Only the training
sample is bounded: MAX_POSITIVE and MAX_UNLABELLED rows with the smallest hashes of
doc_id. Every text is scored.

Null texts count as empty and are scored; repeated rows get equal scores; an empty
table gives an empty one; without positives in training every score is the prior of 0.5.
Columns of the inputs other than doc_id, text and the label are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm import base

#: Bounds of the sample that a model is fitted on, in rows.
MAX_POSITIVE, MAX_UNLABELLED = 10_000, 15_000
BINS = 24
THRESHOLD = 0.3
FOLDS = 5
#: Frequent short words of four languages.
STOP = frozenset(
    "the of and to in a is that for it with as was on are be this by an or from at not "
    "der die und das ist von zu den mit des für auf dem im nicht ein eine als auch "
    "le la les de et des en un une du est que dans pour qui sur au par plus pas avec "
    "el los las y del se por con una su para al lo como más".split()
)

_CLASS = np.full(256, 7, np.uint8)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:?'\"", 5), (b"!", 6)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
_CLASS[list(b"|#*%&$@=<>{}[]~^\\_+")] = 9
_KINDS = 10


def features(text: str) -> np.ndarray:
    """Statistics of a whole text; all finite, also for an empty one."""
    data = text.encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    size = max(1, raw.size)
    codes = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=codes, minlength=_KINDS) / size
    share = codes[codes > 0] / size
    words = text.split()
    n = max(1, len(words))
    distinct = set(words)
    again = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    lines = text.split("\n")
    m = len(lines)
    sizes = np.fromiter(map(len, lines), np.int64, m)
    packed = len(zlib.compress(data, 1))
    ended = sum(x.endswith((".", "?", "!", '"')) for x in lines)
    upper = sum(map(str.isupper, words))
    alpha = sum(map(str.isalpha, words))
    stop = sum(map(STOP.__contains__, words))
    title = sum(map(str.istitle, words))
    return np.array(
        [
            np.log1p(raw.size), *kinds, -(share * np.log2(share)).sum(),
            np.log1p(len(words)), len(distinct) / n, np.log1p(len(distinct)) / np.log1p(n), again / n,
            lengths.mean(), lengths.std(), lengths.max(), (lengths > 12).mean(), (lengths < 3).mean(),
            np.log1p(m), sizes.mean(), np.log1p(sizes.max()), len(set(lines)) / m, ended / m,
            packed / size, upper / n, alpha / n, stop / n, title / n,
            text.count("http") / n, text.count("...") / n, text.count("|") / n, text.count("!!") / n,
        ],
        np.float32,
    )


class Model:
    """Step functions of the features, summed and put through the logistic function."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.cuts, self.weights, self.bias, self.prior = cuts, weights, bias, prior

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Index of the weight that each feature of each row selects."""
        bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], 1)
        return bins + np.arange(len(self.cuts)) * (self.cuts.shape[1] + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.cuts):
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.weights[self.columns(x)].sum(1) + self.bias, -30, 30)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(w: np.ndarray, b: float, at_p: np.ndarray, at_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part of the risk and the bracket of the negative one; at_p and at_u hold selected weights by row.

    Losses are -log s for the positive class and -log(1 - s) for the negative class.
    """
    sp, su = _sigmoid(w[at_p].sum(1) + b), _sigmoid(w[at_u].sum(1) + b)
    negative = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
    return float(-prior * np.log(np.maximum(sp, 1e-9)).mean()), float(negative)


def gradient(w: np.ndarray, b: float, at_p: np.ndarray, at_u: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk by w, then by b; where the bracket is negative, that of its opposite."""
    sp, su = _sigmoid(w[at_p].sum(1) + b), _sigmoid(w[at_u].sum(1) + b)
    gu, gneg = su / len(at_u), -prior * sp / len(at_p)
    if risk(w, b, at_p, at_u, prior)[1] >= 0:
        gp = prior * (sp - 1) / len(at_p) + gneg
    else:  # ascend the bracket until it is no longer negative
        gp, gu = -gneg, -gu
    own = np.bincount(at_p.ravel(), np.repeat(gp, at_p.shape[1]), len(w)) + np.bincount(at_u.ravel(), np.repeat(gu, at_u.shape[1]), len(w))
    return np.append(own, gp.sum() + gu.sum())


def _descend(at_p, at_u, size, prior, steps=1500, rate=0.03, decay=2e-3, batch=4096, seed=7):
    """Adam on the non-negative risk with logistic loss; at_p and at_u hold selected weights by row."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        p = at_p[rng.integers(0, len(at_p), min(batch, len(at_p)))]
        u = at_u[rng.integers(0, len(at_u), min(batch, len(at_u)))]
        g = gradient(w, b, p, u, prior)
        g[:size] += decay * w / size
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:size], b - move[size]
    return w, b


def best_bin(score_p: np.ndarray, score_u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among U by the best threshold on a score."""
    sp, su = np.sort(score_p), np.sort(score_u)
    cuts = np.quantile(sp, np.linspace(0, 0.98, 99))
    qp = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    qu = 1 - np.searchsorted(su, cuts, "left") / len(su)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = np.argmin((qu + slack) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((0, BINS - 1)), np.zeros(0), 0.0, 0.5)
    both = np.concatenate([positive, unlabelled])
    # half of the cuts at quantiles, half evenly between the extremes, where rare kinds of text are
    ranks = np.quantile(both, np.linspace(0, 1, BINS // 2 + 2)[1:-1], axis=0)
    low, high = both.min(0), both.max(0)
    even = low + (high - low) * np.linspace(0, 1, BINS - BINS // 2 + 1)[1:-1, None]
    cuts = np.sort(np.concatenate([ranks, even]), axis=0).T.copy()
    model = Model(cuts, np.zeros(0), 0.0, 0.5)
    at_p, at_u = model.columns(positive), model.columns(unlabelled)
    size = cuts.shape[0] * (cuts.shape[1] + 1)
    half_p, half_u = len(at_p) // 2, len(at_u) // 2
    w, b = _descend(at_p[: max(1, half_p)], at_u[: max(1, half_u)], size, 0.5, steps=400)
    model.prior = best_bin(w[at_p[half_p:]].sum(1) + b, w[at_u[half_u:]].sum(1) + b)
    model.weights, model.bias = _descend(at_p, at_u, size, model.prior)
    return model


def _ids(rows: DataFrame, bound: int) -> DataFrame:
    """At most bound ids, those of the smallest hashes: the same at every partitioning."""
    return rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fits a model. Labels of held-out rows are not read; neither are held-out texts."""
    seen = ~held_out(F.col("doc_id"))
    good = _ids(labels.where(seen & (F.col("quality") == 1)), max_positive).withColumn("good", F.lit(1))
    web = _ids(docs.where(seen & F.col("doc_id").isNotNull()), max_unlabelled).withColumn("web", F.lit(1))
    wanted = good.join(web, "doc_id", "full")  # of at most max_positive + max_unlabelled rows
    texts = docs.select("doc_id", base.text_or_empty().alias("text")).join(F.broadcast(wanted), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("good", pa.int32()), ("web", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield base.batch_of({"doc_id": batch.column(0), "good": batch.column(2), "web": batch.column(3), "x": x}, schema)

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "good", "web")
    rows = base.arrow_map(rows, run, "doc_id long, good int, web int, x binary")
    # of rows that share a doc_id one counts, the same at every run
    rows = rows.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("web").alias("web"), F.min("x").alias("x"))
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])
    width = len(features(""))
    pick = lambda name: np.array([np.frombuffer(r["x"], np.float32) for r in found if r[name]], np.float32).reshape(-1, width)
    return fit(pick("good"), pick("web"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack([features(t) for t in batch.column(1).to_pylist()])
                yield base.batch_of({"doc_id": batch.column(0), "score": model.score(x)}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.text_or_empty().alias("text"))
    scored = base.arrow_map(rows, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose text scores threshold or more, with all their columns."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack([features(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
                yield batch.filter(pa.array(model.score(x) >= threshold))

    return base.arrow_map(docs, run, docs.schema)
