"""Positive-unlabelled learning with the non-negative risk estimator, for sparse named features.

Trusted positives and a sample of unlabelled texts train a linear model that minimises
prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the logistic loss l. Where the
estimated negative part falls below zero, the step goes against its gradient, as the estimator
prescribes. Labels of 0 are used for the class prior alone.

The sample is bounded by ``PuSettings.positives`` and ``unlabelled``; features are counted and
read by Spark, and what the driver trains on is a sparse matrix of that many rows over at most
``features`` columns. Every text is then scored in the scan that reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import crc_of_id, keyed_text, portions
from riskloom.staging import stage

BATCH_BYTES = 4_000_000
_GRAIN = 1_000_000


@dataclass(frozen=True)
class PuSettings:
    """``positives`` and ``unlabelled`` bound the sample; ``folds`` and ``held`` name the rows never learned from.

    A feature is used if at least ``least`` sampled texts have it, its rates among positives and unlabelled
    texts differ by ``z`` standard errors, and the first is at least ``lift`` times the second.
    """

    folds: int
    held: int
    positives: int = 6_000
    unlabelled: int = 12_000
    features: int = 2_000
    z: float = 4.0
    lift: float = 0.0
    least: int = 3
    seed: int = 17
    rounds: int = 400
    rate: float = 0.1
    decay: float = 1e-4


@dataclass
class PuModel:
    """Weights by feature name; ``score`` is the logistic of their sum."""

    prior: float
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, names: set[str]) -> float:
        known = self.weights
        margin = self.bias + sum(known[n] for n in sorted(names) if n in known)
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def fit_nnpu(rows_p: list[list[int]], rows_u: list[list[int]], width: int, prior: float, s: PuSettings) -> np.ndarray:
    """Weights of ``width`` columns and, last, the bias."""
    rows = rows_p + rows_u
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns = np.fromiter((c for r in rows for c in r), "int64", len(which))
    is_p = np.arange(len(rows)) < len(rows_p)
    n_p, n_u = max(1, len(rows_p)), max(1, len(rows_u))
    w = np.zeros(width + 1)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, s.rounds + 1):
        g = w[-1] + np.bincount(which, weights=w[columns], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
        soft = np.logaddexp(0, g)  # l(-g)
        negative = soft[~is_p].sum() / n_u - prior * soft[is_p].sum() / n_p
        low = np.where(is_p, -prior / n_p, 1 / n_u) * p
        if negative < 0:
            slope = -low
        else:
            slope = low + np.where(is_p, prior / n_p * (p - 1), 0)
        grad = np.append(np.bincount(columns, weights=slope[which], minlength=width), slope.sum())
        grad[:-1] += s.decay * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad ** 2
        w = w - s.rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w


def learnable(key: str | Column, s: PuSettings) -> Column:
    """Rows that may be learned from; a null id is none of them."""
    return F.coalesce(F.pmod(crc_of_id(key), F.lit(s.folds)) != s.held, F.lit(False))


def _share(column: Column, seed: int, part: float) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(_GRAIN)) < int(min(1.0, part) * _GRAIN)


def train(docs: DataFrame, labels: DataFrame, label: str, extract: Callable[[str], set[str]], s: PuSettings,
          key: str = "doc_id", text: str = "text", label_key: str = "doc_id") -> PuModel:
    """Fit on the rows of ``docs`` that ``labels`` marks 1 and on unlabelled ones.

    The prior is the rate of 1 among all labelled rows that may be learned from, less one standard error:
    an estimate above the true rate would make the model blame clean texts. Of repeated labels
    the largest holds; null labels are none. Without positives, or without documents, the model
    is the prior alone.
    """
    known = labels.where(F.col(label).isNotNull() & learnable(label_key, s)).groupBy(
        F.col(label_key).cast("long").alias("key")).agg((F.max(label) > 0).alias("positive"))
    n, positive = known.agg(F.count(F.lit(1)), F.sum(F.col("positive").cast("long"))).first()
    rate = (positive or 0) / n if n else 0.5
    prior = min(max(rate - (rate * (1 - rate) / max(1, n)) ** 0.5, 1e-3), 1 - 1e-3)
    rows = keyed_text(docs, key, text).where(learnable("key", s))
    total = rows.count()
    if not positive or not total:
        return PuModel(prior, float(np.log(prior / (1 - prior))))
    # Ids of at most about s.positives rows.
    trusted = F.broadcast(known.where(F.col("positive") & _share(F.col("key"), s.seed, s.positives / positive))
                          .select("key", F.lit(True).alias("p")))
    sample = stage(rows.join(trusted, "key", "left").select(
        "key", "text", F.coalesce("p", F.lit(False)).alias("p"),
        _share(F.col("key"), s.seed + 1, s.unlabelled / total).alias("u")).where("p or u")
        .groupBy("text")  # copies are one text
        .agg(F.min("key").alias("key"), F.max("p").alias("p"), F.max("u").alias("u")), "sample")
    sizes = sample.agg(F.sum(F.col("p").cast("long")), F.sum(F.col("u").cast("long"))).first()
    n_p, n_u = sizes[0] or 0, sizes[1] or 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for t, p, u in zip(*(batch.column(c).to_pylist() for c in ("text", "p", "u"))):
                for name in extract(t):
                    c = counts.setdefault(name, [0, 0])
                    c[0] += p
                    c[1] += u
            if len(counts) > 200_000:
                yield counted(counts)
                counts = {}
        yield counted(counts)

    def counted(counts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
             pa.array([c[1] for c in counts.values()], pa.int64())], names=["name", "np", "nu"])

    a, b = F.col("np") / max(1, n_p), F.col("nu") / max(1, n_u)
    both = (F.col("np") + F.col("nu")) / (n_p + n_u)
    spread = F.sqrt(both * (1 - both) * (1 / max(1, n_p) + 1 / max(1, n_u)))
    best = (sample.mapInArrow(count, "name string, np long, nu long").groupBy("name")
            .agg(F.sum("np").alias("np"), F.sum("nu").alias("nu"))
            .withColumn("z", F.when(spread > 0, F.abs(a - b) / spread).otherwise(0.0))
            .where((F.col("z") >= s.z) & (a >= s.lift * b) & (F.greatest("np", "nu") >= s.least))
            .orderBy(F.col("z").desc(), "name").limit(s.features).select("name").collect())
    names = {r["name"]: i for i, r in enumerate(best)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(names[x] for x in extract(t) if x in names) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("p"), batch.column("u"), pa.array(found, pa.list_(pa.int32()))],
                names=["key", "p", "u", "columns"])

    matrix = sample.mapInArrow(place, "key long, p boolean, u boolean, columns array<int>").toArrow().to_pylist()
    matrix.sort(key=lambda r: (r["key"], r["columns"]))
    w = fit_nnpu([r["columns"] for r in matrix if r["p"]], [r["columns"] for r in matrix if r["u"]], len(names), prior, s)
    return PuModel(prior, float(w[-1]), {name: float(w[i]) for name, i in names.items()})


def score(docs: DataFrame, model: PuModel, extract: Callable[[str], set[str]], s: PuSettings,
          cut: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, ``held_out``, ``score`` and ``predicted`` (score at least ``cut``).

    Null texts are scored as empty ones; rows with a null id are not held out; repeated rows are
    scored each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, BATCH_BYTES):
            found = [model.score(extract(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.float64())], names=["key", "score"])

    return keyed_text(docs, key, text).mapInArrow(run, "key long, score double").select(
        F.col("key").alias(key), F.coalesce(F.pmod(crc_of_id("key"), F.lit(s.folds)) == s.held, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def kept_rows(docs: DataFrame, model: PuModel, extract: Callable[[str], set[str]], cut: float = 0.3,
              text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``cut``; null texts as empty ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, BATCH_BYTES, text):
            good = [model.score(extract(t or "")) >= cut for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
