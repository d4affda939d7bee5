"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

``SuperMinHash`` signatures use one pseudo-random permutation of the lanes per
shingle: step ``j`` puts the value ``j + u`` into lane ``p(j)``. Step by step over
all shingles of a document, a lane once filled cannot be improved by a later
step, so a document stops as soon as all its lanes are filled.

Documents with equal shingle sets are one class from the start. A class links
to the smallest class of each band bucket it falls in; likely links are
confirmed on the full sets, and components are formed. Then every bucket that
still holds several components is compared across components, in blocks, so no
confirmed link is lost to the star shape and no bucket is expanded into pairs.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .session import checkpointed, narrow, salted_join
from .words import mix64, shingle_hashes, split_words, text_slices

LANES = 128
BAND = 4
BANDS = LANES // BAND
WIDTH = 5
#: Lanes that must agree before full sets are compared; at a similarity of 0.75 this is five standard deviations below the mean.
LIKELY = 0.55
#: Rows of a block of bucket members.
OTHERS, MEMBERS = 128, 512
SIGNED = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary"


def superminhash(elements: np.ndarray, offsets: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Signatures of the sets elements[offsets[d]:offsets[d+1]], as uint64 values of shape (sets, lanes).

    Equal lanes of two signatures are as likely as the sets' Jaccard similarity. Empty sets keep the largest value.
    """
    sets = len(offsets) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full(sets * lanes, empty, np.uint64)
    owner = np.repeat(np.arange(sets, dtype=np.int64), np.diff(offsets))
    seed, swaps = elements.astype(np.uint64), []
    for step in range(lanes):
        if not len(seed):
            break
        drawn = mix64(seed + np.uint64(0x9E3779B97F4A7C15 * (step + 1) % 2**64))
        at = step + ((drawn >> np.uint64(32)) % np.uint64(lanes - step)).astype(np.int64)
        lane = at
        for t in range(step - 1, -1, -1):  # where the earlier swaps of the permutation took it from
            lane = np.where(lane == swaps[t], t, lane)
        value = (np.uint64(step) << np.uint64(56)) | (mix64(drawn) >> np.uint64(8))
        np.minimum.at(signature, owner * lanes + lane, value)
        full = (signature.reshape(sets, lanes) != empty).all(axis=1)
        swaps.append(at)
        open_ = ~full[owner]
        if not open_.all():
            seed, owner = seed[open_], owner[open_]
            swaps = [s[open_] for s in swaps]
    return signature.reshape(sets, lanes)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            flat, offsets = shingle_hashes(split_words(part.column("text")), WIDTH)
            lanes = (mix64(superminhash(flat, offsets)) & np.uint64(0xFFFF)).astype("<u2")
            sums = [np.concatenate([[0], np.cumsum(mix64(flat + np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64) for salt in (1, 2)]
            h1, h2 = ((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums)
            raw = pa.py_buffer(lanes.tobytes())
            step = LANES * 2
            ends = pa.py_buffer(np.arange(0, step * (len(offsets)), step, dtype=np.int32).tobytes())
            sig = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, raw])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(offsets)), pa.array(h1), pa.array(h2), sig], ["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig"])


def _lanes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, LANES)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows u, v, sig_u, sig_v whose signatures agree on enough lanes."""
    for batch in batches:
        if batch.num_rows:
            good = (_lanes(batch.column("sig_u")) == _lanes(batch.column("sig_v"))).sum(axis=1) >= LIKELY * LANES
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in ("u", "v")], ["u", "v"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows u, text_u, v, text_v whose full shingle sets overlap enough. The sets of recent texts are kept, by size."""
    kept: OrderedDict[int, np.ndarray] = OrderedDict()
    held = 0

    def shingles(doc: int, text: str) -> np.ndarray:
        nonlocal held
        if doc in kept:
            kept.move_to_end(doc)
            return kept[doc]
        kept[doc] = shingle_hashes(split_words(pa.array([text])), WIDTH)[0]
        held += len(kept[doc])
        while held > 1_000_000 and len(kept) > 1:
            held -= len(kept.popitem(last=False)[1])
        return kept[doc]

    for batch in batches:
        out: list[tuple[int, int]] = []
        columns = [batch.column(k) for k in ("u", "v", "text_u", "text_v")]
        for row in range(batch.num_rows):
            u, v, text_u, text_v = (c[row].as_py() for c in columns)
            x, y = shingles(v, text_v), shingles(u, text_u)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                out.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], ["u", "v"])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of batches sorted by them."""
    pending: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([pending, rows]) if pending is not None else rows
        at = np.stack([rows.column(k).to_numpy() for k in keys])
        start = 0
        for cut in (np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist():
            yield rows.slice(start, cut - start)
            start = cut
        pending = rows.slice(start)
    if pending is not None:
        yield pending


def _likely_in_block(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each 'other' row of a block: its position, the positions of all members, and which of those may link to it.

    Those are of another component, agree on enough lanes, differ little enough in size, and share no earlier band, so
    that a pair comes up in one bucket only.
    """
    other = rows.column("other").to_numpy()
    comp, size = rows.column("comp").to_numpy(), rows.column("n").to_numpy()
    band = int(rows.column("bucket")[0].as_py()) & (BANDS - 1)
    lanes = _lanes(rows.column("sig").combine_chunks())
    members = np.flatnonzero(~other)
    for i in np.flatnonzero(other):
        same = lanes[members] == lanes[i]
        near = (same.sum(axis=1) >= LIKELY * LANES) & (comp[members] != comp[i])
        near &= 100 * np.minimum(size[members], size[i]) >= 75 * np.maximum(size[members], size[i])
        near[near] = same[near].reshape(-1, BANDS, BAND).all(axis=2).argmax(axis=1) == band
        yield i, members, near


def _flag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket's rows that may link to some row of another component."""
    for rows in _groups(batches, ("bucket", "ob", "mb")):
        hit = np.zeros(rows.num_rows, bool)
        for i, members, near in _likely_in_block(rows):
            hit[i] |= near.any()
            hit[members[near]] = True
        kept = rows.select(["bucket", "id"]).filter(pa.array(hit)).combine_chunks()
        yield from kept.to_batches()


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose 32-bit shingle sets overlap enough, allowing for codes that fell together."""
    for rows in _groups(batches, ("bucket", "ob", "mb")):
        ids, size = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        sets = [np.frombuffer(x, "<u4") for x in rows.column("codes").to_pylist()]
        held = np.array([len(x) for x in sets])
        other = rows.column("other").to_numpy()
        flat = np.concatenate([sets[m] for m in np.flatnonzero(~other)]) if (~other).any() else np.zeros(0, np.uint32)
        names, code = np.unique(flat, return_inverse=True)
        starts = np.cumsum(held[~other]) - held[~other]
        found: list[tuple[int, int]] = []
        for i, members, near in _likely_in_block(rows):
            if not near.any():
                continue
            mine = np.zeros(len(names), np.int64)
            at = np.searchsorted(names, sets[i])
            at = at[at < len(names)]
            mine[at[np.isin(names[at], sets[i])]] = 1
            both = np.add.reduceat(mine[code], starts) + (size[i] - held[i]) + (size[members] - held[members])
            near &= 100 * both >= 75 * (size[members] + size[i] - both)
            found += [(max(x, int(ids[i])), min(x, int(ids[i]))) for x in ids[members[near]].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of documents as ascending 32-bit codes."""
    for batch in batches:
        for part in text_slices(batch):
            flat, offsets = shingle_hashes(split_words(part.column("text")), WIDTH)
            codes = [np.unique((flat[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4")).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(codes, pa.binary())], ["id", "codes"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: a hash of the text, shingle count, a 128-bit digest of the shingle set, and its signature in 16-bit lanes."""
    return _texts(docs).mapInArrow(_sign, SIGNED)


def _texts_of(ids: DataFrame, bound: int, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, text of at most ``bound`` classes ``ids`` (id, distinct): the text of the row that a class is named after."""
    keys = classes.select("id", "doc_id", "text_hash").join(narrow(ids, bound), "id", "left_semi")
    return _texts(docs).join(narrow(keys, bound), ["doc_id", "text_hash"]).groupBy("id").agg(F.min("text").alias("text"))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (u, v, distinct) whose texts' full shingle sets are similar enough."""
    ends = checkpointed(pairs)
    n = ends.count()
    texts = checkpointed(_texts_of(ends.select(F.col("u").alias("id")).union(ends.select("v")).distinct(), 2 * n, classes, docs))
    with_u = salted_join(ends, texts.toDF("u", "text_u"), "u", n, by="v")
    with_v = salted_join(with_u, texts.toDF("v", "text_v"), "v", n, counted=ends, by="u")  # many rows may link to one
    return with_v.select("u", "v", "text_u", "text_v").mapInArrow(_confirm, "u long, v long")


def _blocks(placed: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (bucket, id, comp) of buckets with several components, dealt into blocks with the facts of each id.

    A bucket's rows outside its main component are the 'other' rows; blocks of them meet blocks of all its rows, so the
    rows grow with the product of a bucket's others and members over the size of a block. Rows come sorted by block.
    """
    shares = placed.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    open_ = shares.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    open_ = open_.select("bucket", "main", F.ceil((F.col("size") - F.col("most")) / OTHERS).cast("int").alias("obs"), F.ceil(F.col("size") / MEMBERS).cast("int").alias("mbs"))
    rows = placed.join(open_, "bucket").join(facts, "id")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    first = ["bucket", "id", "comp", *[c for c in facts.columns if c != "id"]]
    left = rows.where("comp <> main").select(*first, F.lit(True).alias("other"), at("obs").alias("ob"), F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"))
    right = rows.select(*first, F.lit(False).alias("other"), F.explode(F.sequence(F.lit(0), F.col("obs") - 1)).alias("ob"), at("mbs").alias("mb"))
    return left.union(right).repartition("bucket", "ob", "mb").sortWithinPartitions("bucket", "ob", "mb")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked doc_id, itself included), kept.

    Documents are linked when 100 * intersection >= 75 * union of their sets of distinct five-word shingles;
    with fewer words the whole sequence is the one shingle. Null and empty texts have no shingle and stay alone,
    as do rows of null doc_id (component null, kept true). Every row is a document: rows that repeat a doc_id are reported
    as often as given, each by its own text, and kept as often as theirs is the smallest doc_id of the component. Columns
    other than doc_id and text are ignored. An empty table gives an empty result.
    """
    signed = checkpointed(signatures(docs).withColumn("uid", F.monotonically_increasing_id()))
    alive = signed.where("n_shingles > 0 and doc_id is not null")
    # A class is named after one of its rows, of the smallest doc_id.
    first = F.struct("doc_id", "text_hash", "uid")
    classes = alive.groupBy("h1", "h2", "n_shingles").agg(F.min(first).alias("first"), F.min_by("sig", first).alias("sig"))
    classes = checkpointed(classes.select("h1", "h2", "n_shingles", F.col("first.uid").alias("id"), "first.doc_id", "first.text_hash", "sig"))
    sigs = classes.select("id", F.col("n_shingles").alias("n"), "sig")
    # A bucket's low bits are its band.
    shift = BANDS.bit_length() - 1
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.shiftleft(F.xxhash64(i, F.substring(F.col("sig"), i * (2 * BAND) + 1, F.lit(2 * BAND))), shift).bitwiseOR(i.cast("long")))
    rows = sigs.select("id", F.explode(bands).alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1")
    members = checkpointed(salted_join(rows, heads, "bucket", BANDS * classes.count(), by="id", sizes=heads.select("bucket", F.col("size").alias("__n"))))

    def likely(pairs: DataFrame) -> DataFrame:
        sig = sigs.select("id", "sig")
        return pairs.join(sig.toDF("u", "sig_u"), "u").join(sig.toDF("v", "sig_v"), "v").mapInArrow(_agree, "u long, v long")

    stars = members.where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct()
    links = checkpointed(_confirmed(likely(stars), classes, docs))
    labels = connected_components(links)
    labels = checkpointed(labels)

    # Buckets of two are settled by their star; in larger ones, members of different components are compared in blocks:
    # signatures first, then the sets of those that may link.
    placed = members.where("size > 2").join(labels, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    flagged = checkpointed(_blocks(placed, sigs).mapInArrow(_flag_rows, "bucket long, id long").distinct())
    sets = _texts_of(flagged.select("id").distinct(), flagged.count(), classes, docs).mapInArrow(_code, "id long, codes binary")
    rest = _blocks(placed.join(flagged, ["bucket", "id"], "left_semi"), sigs.join(sets, "id")).mapInArrow(_link_rows, "u long, v long").distinct()
    more = checkpointed(_confirmed(rest, classes, docs))
    if not more.isEmpty():
        labels = connected_components(links.union(more))

    # Components are named after the smallest doc_id of their classes.
    placed = classes.join(labels, F.col("id") == F.col("node"), "left").select("h1", "h2", "n_shingles", "doc_id", F.coalesce("component", "id").alias("component"))
    named = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    key = F.struct("h1", "h2", "n_shingles").alias("class")
    of_class = checkpointed(placed.join(named, "component").select(key, "component_id"))
    grouped = salted_join(signed.select("uid", "doc_id", "n_shingles", key), of_class, "class", signed.count(), "left", by="uid")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return grouped.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that near_duplicates() keeps: of each group the document of the smallest doc_id.

    Null and empty texts, and rows of null doc_id, stay. Rows that repeat a doc_id go or stay together, by whether one of
    them is kept. An empty table gives an empty one; columns stay as they are, whatever they are called.
    """
    found = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    gone = checkpointed(found.where("not kept").select(F.col("doc_id").alias("__gone")))
    return docs.join(narrow(gone, gone.count()), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
