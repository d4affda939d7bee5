"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .labelled import training_ids, usable_labels
from .session import bounded_batches, narrow, table
from .trees import FlatTrees, fit_trees
from .words import text_slices

#: Labelled rows of each class that the trees are fitted on, at most.
PER_CLASS = 8_000
ACCEPT = 0.7
#: Bytes of text that are measured at once.
SLICE = 1 << 20
#: Texts whose byte counts are held together.
TOGETHER = 512
FEATURES = ("log_bytes", "log_words", "word_mean", "word_std", "letters", "upper", "digits", "high_bytes", "stops", "commas", "bangs", "symbols", "pipes", "brackets",
            "spaces", "byte_entropy", "log_lines", "line_repeats", "words_per_line", "distinct_words", "top_word", "top_repeat", "word_repeats", "pair_repeats",
            "ends_in_symbol", "upper_words", "title_words", "digit_words", "short_words", "long_words", "stop_per_word")

_CLASS = np.zeros((256, 11), np.float64)
for _k, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".", b",;:", b"!?", b"#$%&*@^~=+<>_\\/", b"|", b"()[]{}", b" \t\r\n\x0b\x0c")):
    _CLASS[list(_members), _k] = 1


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; a null or empty one, or one without words, has zeros."""
    texts = pc.fill_null(texts, "")
    return np.concatenate([_statistics(texts.slice(at, TOGETHER)) for at in range(0, len(texts), TOGETHER)] or [np.zeros((0, len(FEATURES)))])


def _split(parts: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Of each part the row that it is of, and all parts."""
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    return np.repeat(np.arange(len(parts)), np.diff(offsets)), parts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _statistics(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    per = lambda at, weights=None: np.bincount(at, weights, n).astype(float)
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    held = np.bincount(np.repeat(np.arange(n) << 8, sizes) + data, minlength=n << 8).reshape(n, 256)
    some = held / np.maximum(sizes, 1)[:, None]
    share = some @ _CLASS
    entropy = -(some * np.log2(np.where(held > 0, some, 1))).sum(axis=1)

    # Words: what holds for a word is found once for each distinct one.
    at, words = _split(pc.ascii_split_whitespace(texts))
    coded = words.dictionary_encode()
    vocab, code = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
    length = np.asarray(pc.binary_length(vocab), dtype=np.int64)
    raw = vocab.cast(pa.binary()).to_pylist()
    head, tail = (np.frombuffer(b"".join(x or b" " for x in ends), np.uint8) for ends in ([w[:1] for w in raw], [w[-1:] for w in raw]))
    upper = np.asarray(pc.and_(pc.equal(vocab, pc.ascii_upper(vocab)), pc.not_equal(vocab, pc.ascii_lower(vocab))), dtype=bool) & (length > 1)
    if len(code):
        full = length[code] > 0
        at, code = at[full], code[full]
    v = max(len(vocab), 1)
    count, size = per(at), length[code].astype(float)
    mean = _ratio(per(at, size), count)
    spread = np.sqrt(_ratio(per(at, (size - mean[at]) ** 2), count))
    of_word = lambda x: _ratio(per(at, x[code].astype(float)), count)
    own, seen = np.unique(at * v + code, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, own // v, seen)
    next_ = at[1:] == at[:-1]
    same = next_ & (code[1:] == code[:-1])
    pairs = np.unique((at[1:][next_] * v + code[1:][next_]) * v + code[:-1][next_]) // (v * v)
    gaps = np.maximum(count - 1, 0)

    row, lines = _split(pc.split_pattern(texts, "\n"))
    line = np.asarray(lines.dictionary_encode().indices, dtype=np.int64)
    width = int(line.max()) + 1 if len(line) else 1
    all_lines, distinct = per(row), per(np.unique(row * width + line) // width)
    out = np.column_stack([
        np.log1p(sizes), np.log1p(count), mean, spread, share, entropy, np.log1p(all_lines), 1 - _ratio(distinct, all_lines), _ratio(count, all_lines), _ratio(per(own // v), count), _ratio(most, count), np.log1p(most),
        _ratio(per(at[1:][same]), gaps), np.where(gaps > 0, 1 - _ratio(per(pairs), gaps), 0), of_word(_CLASS[tail][:, [6, 7, 8]].sum(axis=1)), of_word(upper), of_word(_CLASS[head, 1]), of_word(_CLASS[head, 2]), of_word(length <= 3), of_word(length >= 12), _ratio(held[:, 46], count),
    ])
    out[count == 0] = 0
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, most=SLICE):
            found = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(found.astype("<f8")), pa.list_(pa.float64()))], ["label", "x"])


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FlatTrees:
    """Trees for ``labels.quality``, fitted on at most ``per_class`` rows of each class that are not held out."""
    bounded_batches(docs.sparkSession)
    labels, learned = labels.select("doc_id", "quality"), ~held_out(F.col("doc_id"))
    chosen = training_ids(labels, "quality", per_class, learned)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(narrow(chosen, 2 * per_class), "doc_id")
    got = rows.select(F.col("quality").cast("int").alias("label"), "text").mapInArrow(_vectors, "label int, x array<double>").toArrow()
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = np.asarray(got.column("label"), dtype=np.float64)
    order = np.lexsort([*x.T, y])
    return fit_trees(x[order], y[order], class_weights(y[order], usable_labels(labels, "quality", learned)))


def class_weights(y: np.ndarray, learned: DataFrame) -> np.ndarray:
    """Weights that undo the classes' bounds, so that scores are probabilities among all labels that may be learned from."""
    counts = {r["quality"]: r["n"] for r in learned.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = {c: max(1.0, float((y == c).sum())) for c in (0, 1)}
    scale = {c: counts.get(c, 0) / total[c] for c in (0, 1)}
    weight = np.where(y == 1, scale[1], scale[0])
    return weight / max(weight.mean(), 1e-9) if len(weight) else weight


def with_quality(docs: DataFrame, trees: FlatTrees) -> DataFrame:
    """``docs`` with a column __quality, the score of the whole text. Only texts go to Python, only scores come back."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts], ["text"])
        found = [trees.predict(statistics(part.column("text"))) for part in text_slices(rows, most=SLICE)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn("__quality", score(F.col("text").cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from a score of 0.7).

    Only the text makes the score; null texts count as empty, which have a score too. Rows that repeat score alike;
    other columns are ignored; labels that are null or of no document are not used. Without labels all rows score
    the same. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = with_quality(rows, fit_quality(docs, labels, per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__quality").alias("score"), (F.col("__quality") >= ACCEPT).cast("int").alias("predicted"))


def accept_quality(docs: DataFrame, corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier, fitted on labelled rows of ``corpus``, doesn't reject."""
    return with_quality(docs, fit_quality(corpus, labels)).where(F.col("__quality") >= ACCEPT).select(*docs.columns)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
