"""Exact deduplication by exchange of Golomb-coded fingerprints.

Every chunk (some input partitions) sorts the short fingerprints of its texts,
splits them by owner and sends each owner its part as a Golomb-Rice code: about
ten bits a text. Chunks and owners grow with the corpus up to a bound of memory. An owner merges the codes it gets and answers every sender with a bitmap
of the fingerprints that others have too. Only those suspects' texts are
shuffled, and compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .session import checkpointed, narrow, salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a piece of a chunk, and fingerprints of an owner in a small corpus; they grow with it to so many times as many.
CHUNK_ROWS, OWNER_ROWS, GROWTH = 500_000, 500_000, 8
#: Bits of a fingerprint beyond those that number the rows: one text in 2**8 is suspected wrongly.
SPARE_BITS = 8


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def rice_parameter(n: int, universe: int) -> int:
    """Low bits coded plainly: near the optimum for n of ``universe`` values."""
    return max(0, int(universe / max(n, 1) * 0.6931).bit_length() - 1)


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code of distinct ascending integers below 2**63: the gaps' high parts in unary, then their k low bits."""
    gaps = np.diff(values, prepend=np.int64(-1)) - 1
    high = gaps >> k
    ends = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def rice_decode(code: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n] if n else np.zeros(0, np.int64)
    unary = int(ends[-1]) + 1 if n else 0
    # Bits after the n-th one belong to the low parts.
    high = np.diff(ends, prepend=-1) - 1
    low = bits[unary : unary + n * k].reshape(n, k).astype(np.int64) @ (np.int64(1) << np.arange(k, dtype=np.int64)) if k else 0
    return np.cumsum((high.astype(np.int64) << k) + low + 1) - 1


def _split(values: np.ndarray, owners: int, width: int) -> tuple[np.ndarray, list[int]]:
    distinct = np.unique(values)
    return distinct, np.searchsorted(distinct, np.arange(owners + 1, dtype=np.int64) * width).tolist()


def exact_groups(rows: DataFrame, key: str, fingerprint: str, total: int) -> DataFrame:
    """The keys (long) of rows whose fingerprint, cut to the bits that ``total`` rows need, occurs more than once.

    ``rows`` must be materialised with a ``part`` column that names the partition it came from; a key is unique. A chunk
    and an owner have about 1 / 4,096 of all rows within their bounds, so messages stay millions as rows grow.
    """
    bits = min(62, max(1, total - 1).bit_length() + SPARE_BITS)
    own_rows = max(OWNER_ROWS, min(GROWTH * OWNER_ROWS, total >> 12))
    owners = max(1, -(-total // own_rows))
    width = -(-(1 << bits) // owners)
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    # Partitions of a chunk: as many as make up its rows, as long as there are chunks enough for all cores.
    group = max(1, min(own_rows * parts // max(total, 1), parts // (4 * rows.sparkSession.sparkContext.defaultParallelism)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, chunk, seq, held = [], [], None, 0, 0

        def piece() -> pa.RecordBatch:
            data = [np.concatenate(x).astype("<i8").tobytes() for x in (keys, values)]
            return pa.RecordBatch.from_arrays([pa.array([f"{chunk}-{seq}"]), pa.array([data[0]]), pa.array([data[1]])], ["chunk", "keys", "prints"])

        for batch in batches:
            for start in range(0, batch.num_rows, 10_000):
                cut = batch.slice(start, 10_000)
                chunk = cut.column("part")[0].as_py() // group if chunk is None else chunk
                keys.append(np.asarray(cut.column("key")))
                values.append((np.asarray(cut.column("print")).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
                held += cut.num_rows
                if held >= CHUNK_ROWS:
                    yield piece()
                    keys, values, seq, held = [], [], seq + 1, 0
        if held:
            yield piece()

    read = lambda packed, name: np.concatenate([np.frombuffer(x, "<i8") for x in packed.column(name).to_pylist()])

    def send(packed: pa.Table) -> pa.Table:
        distinct, cuts = _split(read(packed, "prints"), owners, width)
        out = []
        for owner in range(owners):
            own = distinct[cuts[owner] : cuts[owner + 1]] - owner * width
            if len(own):
                k = rice_parameter(len(own), width)
                out.append((owner, packed.column("chunk")[0].as_py(), len(own), k, rice_encode(own, k)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["owner", "chunk", "n", "k", "code"])

    def answer(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        n, k, codes = group.column("n").to_pylist(), group.column("k").to_pylist(), group.column("code").to_pylist()
        lists = [rice_decode(c, x, y) for c, x, y in zip(codes, n, k, strict=True)]
        merged, inverse, seen = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice = (seen > 1)[inverse]
        ends = np.cumsum(n)
        maps = [np.packbits(twice[e - x : e]).tobytes() for e, x in zip(ends, n, strict=True)]
        return pa.table({"chunk": group.column("chunk"), "owner": group.column("owner"), "bitmap": pa.array(maps, pa.binary())})

    def suspects(packed: pa.Table, maps: pa.Table) -> pa.Table:
        keys, values = read(packed, "keys"), read(packed, "prints")
        distinct, cuts = _split(values, owners, width)
        place = np.searchsorted(distinct, values)
        flagged = np.bincount(place, minlength=len(distinct)) > 1
        for owner, bitmap in zip(maps.column("owner").to_pylist(), maps.column("bitmap").to_pylist(), strict=True):
            a, b = cuts[owner], cuts[owner + 1]
            flagged[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: b - a].astype(bool)
        return pa.table({"key": pa.array(keys[flagged[place]], pa.int64())})

    prints = rows.select("part", F.col(key).alias("key"), F.col(fingerprint).alias("print"))
    packed = prints.mapInArrow(pack, "chunk string, keys binary, prints binary")
    sent = packed.groupBy("chunk").applyInArrow(send, "owner int, chunk string, n int, k int, code binary")
    maps = sent.groupBy("owner").applyInArrow(answer, "chunk string, owner int, bitmap binary")
    return packed.groupBy("chunk").cogroup(maps.groupBy("chunk")).applyInArrow(suspects, "key long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest
    doc_id stays (nulls are smallest; of rows that repeat that doc_id, one). text_sha256 is the lower-case hex
    digest of the normalised text in UTF-8. Other columns are ignored. An empty table gives an empty result.
    """
    text = normalised(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long"), "text").select(
        F.monotonically_increasing_id().alias("uid"), F.spark_partition_id().alias("part"), "doc_id", F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("print")
    )
    base = checkpointed(base)
    total = base.count()
    suspect = checkpointed(exact_groups(base, "uid", "print", total))
    rows = base.join(narrow(suspect.withColumnRenamed("key", "uid"), suspect.count()), "uid", "left_semi")
    best = rows.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count("*").alias("n")).where("n > 1")
    ids = rows.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), text.alias("norm"))
    texts = texts.join(narrow(ids, suspect.count()), F.col("d").eqNullSafe(F.col("doc_id")), "left_semi")
    groups = texts.groupBy("norm").agg(F.count("*").alias("group_size")).where("group_size > 1")
    groups = groups.select(F.sha2("norm", 256).alias("text_sha256"), "group_size").join(best, "text_sha256")
    groups = groups.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"))
    joined = salted_join(base, checkpointed(groups), "text_sha256", total, "left", by="uid")
    alone = F.col("keep_uid").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_dedup() keeps: one for each text.

    Null texts count as empty ones, which are equal; a null doc_id stays only if all rows of its text have one. Of rows
    that repeat both doc_id and text the one of the smallest hash over all columns stays, so reruns agree. An empty
    table gives an empty one. Columns called __key, __sha or __row must not be among those of ``docs``, nor maps.
    """
    gone = checkpointed(exact_dedup(docs).where("not kept").groupBy("doc_id", "keep_id", "text_sha256").agg(F.lit(1).alias("one")))
    n = gone.count()
    others = gone.where("not doc_id <=> keep_id").select("doc_id", "text_sha256")
    repeated = gone.where("doc_id <=> keep_id").select("doc_id", "text_sha256")
    keyed = docs.withColumns({"__key": F.col("doc_id").cast("long"), "__sha": F.sha2(normalised(F.col("text")), 256)})
    on = lambda side: F.col("__key").eqNullSafe(side["doc_id"]) & (F.col("__sha") == side["text_sha256"])
    left = keyed.join(narrow(others, 3 * n), on(others), "left_anti")
    once = left.join(narrow(repeated, 3 * n), on(repeated), "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    once = once.select("__key", "__sha", row.alias("__row")).groupBy("__key", "__sha").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row.*")
    return left.join(narrow(repeated, 3 * n), on(repeated), "left_anti").select(*docs.columns).union(once)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
