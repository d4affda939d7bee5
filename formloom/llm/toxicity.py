"""Toxicity by a classifier chain of linear models over term presence.

Categories are predicted in order. The model of a category sees the terms of the
text and the probabilities of the categories before it. Those it is trained with
come from models that were not fitted on the row in question (out of fold), as
they will be for new texts: neither their weights nor their choice of terms has
seen the row's label.

Terms are counted and chosen in Spark. The driver gets the chosen ones, and of
each training row which of them it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import training_ids
from .session import bounded_batches, checkpointed, narrow, table
from .words import hash_strings, split_words, text_slices

#: Labelled rows of each class of the last category that the chain is fitted on, at most; terms of a model; folds.
PER_CLASS, TERMS, FOLDS = 8_000, 600, 3
EDGE = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of each text and their offsets. A term is a word without ASCII punctuation at its ends."""
    words = split_words(texts)
    codes = hash_strings(pc.replace_substring_regex(words.vocab, EDGE, "")) if len(words.vocab) else np.zeros(0, np.uint64)
    flat = codes[words.ids] if len(words.ids) else codes
    own = [np.unique(flat[a:b]) for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    return np.concatenate(own) if own else flat, np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def presence(flat: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """A 0/1 matrix: which of the ascending ``terms`` each text has."""
    out = np.zeros((len(offsets) - 1, len(terms)))
    if len(terms) and len(flat):
        at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
        hit = terms[at] == flat
        out[np.repeat(np.arange(len(out)), np.diff(offsets))[hit], at[hit]] = 1
    return out


@dataclass
class Linear:
    weight: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1, steps: int = 12) -> Linear:
    """Logistic regression with an L2 penalty, by Newton steps; of one class, the base rate."""
    z = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        grad = z.T @ (weight * (y - p)) - ridge * beta
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, grad)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(beta[:-1], float(beta[-1]))


@dataclass
class Chain:
    """Linear models of the categories in order; each sees the terms and the earlier categories' probabilities."""

    categories: tuple[str, ...]
    terms: np.ndarray
    models: list[Linear]

    def predict(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = presence(flat, offsets, self.terms)
        for model in self.models:
            x = np.hstack([x, model.predict(x)[:, None]])
        return x[:, len(self.terms) :]


#: A term must occur in so many rows, and its likelihood ratio must pass the 0.1 % point of chi-square.
LEAST, TELLING = 3, 10.83


def _term_counts(folds: int):
    """By term and fold: rows that have it, and how many of them are of each category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                flat, offsets = terms_of(part.column("text"))
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                fold, y = np.asarray(part.column("fold"))[row], np.array(part.column("y").to_pylist(), float)[row]
                for k in range(folds):
                    names, code = np.unique(flat[fold == k], return_inverse=True)
                    counts = np.column_stack([np.bincount(code, minlength=len(names)), *(np.bincount(code, c, len(names)) for c in y[fold == k].T)]) if len(names) else np.zeros((0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.full(len(names), k, np.int32)), pa.array(list(counts), pa.list_(pa.float64()))], ["term", "fold", "counts"])

    return run


def choose_terms(rows: DataFrame, categories: int, most: int, folds: int) -> list[np.ndarray]:
    """The terms whose presence tells most about any category, by the likelihood ratio: of all rows, then of all but each fold.

    ``rows`` has fold, y and text; terms come ascending, as unsigned hashes.
    """
    counted = rows.mapInArrow(_term_counts(folds), "term long, fold int, counts array<double>")
    cell = lambda k, c: F.sum(F.when(F.col("fold") == k, F.col("counts")[c]).otherwise(0.0)).alias(f"k{k}_{c}")
    counts = checkpointed(counted.groupBy("term").agg(*[cell(k, c) for k in range(folds) for c in range(categories + 1)]))
    of = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.col("y")[c]).alias(f"y{c}") for c in range(categories)]).collect()}
    chosen = []
    for left_out in (None, *range(folds)):
        used = [k for k in range(folds) if k != left_out]
        held = sum((F.col(f"k{k}_0") for k in used), F.lit(0.0))
        all_rows = sum(of[k]["n"] for k in used if k in of)

        def gain(c: int) -> Column:
            ones = sum(of[k][f"y{c}"] for k in used if k in of)  # noqa: B023
            hit = sum((F.col(f"k{k}_{c + 1}") for k in used), F.lit(0.0))  # noqa: B023
            expect = held * (ones / max(all_rows, 1))  # noqa: B023
            term = lambda k, e: F.when((k > 0) & (e > 0), k * F.ln(k / e)).otherwise(0.0)
            return 2 * (term(hit, expect) + term(held - hit, held - expect))  # noqa: B023

        gains = [gain(c) for c in range(categories)]
        best = counts.where(held >= LEAST).select("term", (F.greatest(*gains) if categories > 1 else gains[0]).alias("gain")).where(F.col("gain") > TELLING)
        found = best.orderBy(F.desc("gain"), "term").limit(most).select("term").toArrow().column("term").combine_chunks()
        chosen.append(np.sort(np.asarray(found, dtype=np.int64).view(np.uint64)))
    return chosen


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, own: np.ndarray, without: list[np.ndarray]) -> tuple[list[Linear], np.ndarray]:
    """The models of the categories (columns of ``y``) in order, and the out-of-fold probabilities that they were fitted with.

    ``own`` are the columns of ``x`` chosen on all rows, ``without`` those chosen without each fold.
    """
    models, earlier = [], np.zeros((len(x), 0))
    for c in range(y.shape[1]):
        ones = np.ones(len(x))
        models.append(fit_linear(np.hstack([x[:, own], earlier]), y[:, c], ones))
        out = np.zeros(len(x))
        for k, terms in enumerate(without):
            test = fold == k
            if test.any():
                z = np.hstack([x[:, terms], earlier])
                out[test] = fit_linear(z[~test], y[~test, c], ones[~test]).predict(z[test])
        earlier = np.hstack([earlier, out[:, None]])
    return models, earlier


def _bits(terms: np.ndarray):
    """Which of ``terms`` each text has, in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                packed = np.packbits(presence(*terms_of(part.column("text")), terms).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "fold", "y")] + [pa.array([p.tobytes() for p in packed], pa.binary())], ["doc_id", "fold", "y", "bits"])

    return run


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], per_class: int = PER_CLASS, terms: int = TERMS, folds: int = FOLDS) -> Chain:
    """A chain for 0/1 columns of ``labels``, in order, fitted on at most ``per_class`` rows of each class of the last.

    The driver gets at most (1 + ``folds``) * ``terms`` terms and a bit for each of them and each training row.
    """
    chosen = training_ids(labels.select("doc_id", *categories), categories[-1], per_class).na.drop()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(narrow(chosen, 2 * per_class), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold")
    rows = checkpointed(rows.select("doc_id", fold, F.array(*[F.col(c).cast("double") for c in categories]).alias("y"), "text"))
    own, *without = choose_terms(rows, len(categories), terms, folds)
    names = np.unique(np.concatenate([own, *without]))
    got = rows.mapInArrow(_bits(names), "doc_id long, fold int, y array<double>, bits binary").toArrow().sort_by([("doc_id", "ascending"), ("bits", "ascending")])
    raw = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(got.num_rows, -(-len(names) // 8))
    x = np.unpackbits(raw, axis=1, count=len(names)).astype(float) if len(names) else np.zeros((got.num_rows, 0))
    y = np.array(got.column("y").to_pylist(), float).reshape(-1, len(categories))
    place = lambda chosen_: np.searchsorted(names, chosen_)
    models, _ = fit_chain(x, y, np.asarray(got.column("fold")), place(own), [place(w) for w in without])
    return Chain(tuple(categories), own, models)


def toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"), per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, a probability p_<category> for each, score (of the last) and predicted (1 from ``threshold``).

    Null texts count as empty and get the models' base probability. Rows may repeat and score alike; columns other
    than doc_id and text are ignored, as are labels that are null. Without labelled rows all probabilities are 0.5.
    An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    chain = train_chain(docs, labels, categories, per_class)
    names = [f"p_{c}" for c in categories]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                p = chain.predict(*terms_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in p.T)], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(score, ", ".join(["doc_id long", *(f"{n} double" for n in names)]))
    return scored.select("doc_id", *names, F.col(names[-1]).alias("score"), (F.col(names[-1]) >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """The labels hold one toxicity category; the chain predicts low quality first and feeds it to toxicity."""
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity(table(spark, sf_dir, "documents"), labels)
