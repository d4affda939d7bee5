"""Language-model scoring with a weighted backoff automaton.

The model interpolates n-grams with Dirichlet weights: a context that was seen t
times leaves m / (t + m) of its mass to the shorter context, down to an additive
unigram. Contexts are the automaton's states; a seen n-gram is an arc whose weight
is its smoothed log-probability, and a state's failure arc leads to the shorter
context and carries the log of the mass left to it.

No task holds the whole model. Documents are dealt into blocks of bounded size. A
block sends the keys of its distinct n-grams, of every order alike, with its
training counts to the shards that own ranges of the keys, Golomb-coded; a shard
adds up what all blocks counted and answers each. How often a context was seen is
the count of the n-gram that it is, so nothing else is asked for, and a frequent
word is no more than one key of each block. A block then builds the part of the
automaton that it needs and walks its texts once from left to right. Counts cover
every training document, and what is exchanged grows with the corpus: a block sends
no more messages than it has distinct n-grams, however many shards there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exact import rice_decode, rice_encode, rice_parameter
from .words import hash_strings, mix64, split_words

ORDER = 3
#: Words of the shorter context that a longer one is worth, by the length of the context.
PRIOR = {1: 8.0, 2: 2.0}
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
#: Tokens of a lane: a longer text is walked as several lanes, each entered in the state that its preceding words lead to.
LANE = 256
#: Hashes of the end and of the start of a text; no word hashes to them but by chance of 2**-64.
END, START = np.uint64(0x454E44), np.uint64(0x5354415254)
#: Bits of a key in its shard; keys below this bound are words, which have an eighth of the shards.
BITS, WORDS_BELOW = 48, np.uint64(1 << 61)
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
REQUEST = "shard int, block int, n int, k int, code binary, counts binary, big binary"
REPLY = "block int, shard int, words long, tokens long, n int, counts binary, big binary"


class BackoffAutomaton:
    """States with weighted arcs and failure arcs, walked by many texts at once.

    N-grams are numbered by order; ``weight[n]`` holds the log-probability on the arc of each n-gram of n tokens (nan: no
    arc), ``failure[n]`` the log weight on the failure arc of the state that an n-gram is as a context (nan: no state).
    The root has an arc for every token, ``weight[1]``. An arc leads to the longest state that ends its n-gram.
    """

    def __init__(self, weight: dict[int, np.ndarray], failure: dict[int, np.ndarray]) -> None:
        # The number -1 finds the last one: no arc, no state.
        self.weight, self.failure = ({n: np.append(x, np.nan) for n, x in own.items()} for own in (weight, failure))
        self.order = max(weight)

    def walk(self, grams: dict[int, np.ndarray], start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The log-probability of each text offsets[d]:offsets[d+1].

        ``grams[n]`` has, at each place, the number of the n-gram that ends there (-1 where a text is shorter), ``start``
        that of the state (an n-gram of one token) in which each text begins.
        """
        lengths = np.diff(offsets)
        lanes = -(-lengths // LANE)
        text = np.repeat(np.arange(len(lengths)), lanes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = offsets[:-1][text] + place * LANE
        size = np.minimum(LANE, offsets[1:][text] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, place, text = begin[order], size[order], place[order], text[order]
        # A state is its length and, for each length up to that, the number of the n-gram that it is.
        state = {n: np.where(place > 0, grams[n][np.maximum(begin - 1, 0)], start[text] if n == 1 else -1) for n in range(1, self.order)}
        length = self._longest(state)
        total = np.zeros(len(begin))
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, side="left"))
            at = begin[:live] + step
            open_ = np.ones(live, bool)
            for n in range(self.order, 1, -1):  # down the failure arcs, until there is an arc for the token
                here = open_ & (length[:live] == n - 1)
                arc = np.where(here, self.weight[n][grams[n][at]], np.nan)
                hit = ~np.isnan(arc)
                total[:live][hit] += arc[hit]
                open_ &= ~hit
                fell = here & ~hit
                total[:live][fell] += self.failure[n - 1][state[n - 1][:live][fell]]
                length[:live][fell] = n - 2
            total[:live][open_] += self.weight[1][grams[1][at[open_]]]
            for n in state:
                state[n][:live] = grams[n][at]
            length[:live] = self._longest({n: s[:live] for n, s in state.items()})
        return np.bincount(text, total, len(lengths)) if len(text) else np.zeros(len(lengths))

    def _longest(self, state: dict[int, np.ndarray]) -> np.ndarray:
        """The length of the longest context that is a state; 0 is the root."""
        found = np.zeros(len(state[1]), np.int64)
        for n, own in state.items():
            found = np.where((own >= 0) & ~np.isnan(self.failure[n][own]), n, found)
        return found


class Block:
    """The n-grams of some documents: their distinct keys, and at each place of the texts the number of the n-gram that ends there.

    The numbers of order 1 go on, behind the words, with the end and the start of a text, which have no key.
    """

    def __init__(self, table: pa.Table, order: int) -> None:
        table = table.combine_chunks()
        words = split_words(table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string()))
        self.held = np.asarray(table.column("held_out").chunk(0)) if table.num_rows else np.zeros(0, bool)
        hashes, inverse = np.unique(hash_strings(words.vocab), return_inverse=True)
        docs = len(words.offsets) - 1
        self.words, self.offsets = len(hashes), words.offsets + np.arange(docs + 1)
        tokens = np.full(self.offsets[-1], len(hashes), np.int64)
        tokens[np.arange(len(words.ids)) + np.repeat(np.arange(docs), words.counts)] = inverse[words.ids] if len(words.ids) else words.ids
        place = np.arange(len(tokens)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        learned = np.repeat(~self.held, np.diff(self.offsets))
        names = np.append(hashes, [END, START])
        self.grams, self.first, counts = {1: tokens}, {}, [np.bincount(tokens[learned], minlength=len(names))[: self.words]]
        keys = [mix64(hashes + np.uint64(1)) >> np.uint64(3)]
        with np.errstate(over="ignore"):
            before = [np.where(place >= back, names[np.roll(tokens, back)] if len(tokens) else names[:0], START) for back in range(order)]
            for n in range(2, order + 1):
                key = np.zeros(len(tokens), np.uint64)
                for back in range(n):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + before[back] + np.uint64(n))
                key = np.where(key < WORDS_BELOW, key + WORDS_BELOW, key)
                whole = np.flatnonzero(place >= n - 2)  # the start of a text is part of its first n-grams, once
                own, first, number = np.unique(key[whole], return_index=True, return_inverse=True)
                self.grams[n] = np.full(len(tokens), -1, np.int64)
                self.grams[n][whole] = number
                self.first[n] = whole[first]
                counts.append(np.bincount(number, learned[whole], len(own)).astype(np.int64))
                keys.append(own)
        self.bounds = np.cumsum([0, *map(len, keys)])
        self.keys, self.counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)

    def shares(self, shards: int):
        """For each shard that has keys of the block: its number, the keys' places, their distinct codes in it, and each key's code."""
        order = np.argsort(self.keys)
        width = (1 << 64) // shards
        ranges = np.searchsorted(self.keys[order], np.array([s * width for s in range(shards)], np.uint64))
        shift = np.uint64(max(0, (width - 1).bit_length() - BITS))
        for shard in np.flatnonzero(np.diff(np.append(ranges, len(order)))).tolist():
            own = order[ranges[shard] : ranges[shard + 1] if shard + 1 < shards else len(order)]
            code = ((self.keys[own] - np.uint64(shard * width)) >> shift).astype(np.int64)
            new = np.concatenate([[True], code[1:] != code[:-1]])
            yield shard, own, code[new], np.cumsum(new) - 1


def _short(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts in a byte each; those of 255 and more again, in full."""
    return np.minimum(counts, 255).astype("u1").tobytes(), counts[counts >= 255].astype("<i8").tobytes()


def _long(short: bytes, big: bytes) -> np.ndarray:
    counts = np.frombuffer(short, "u1").astype(np.int64)
    counts[counts == 255] = np.frombuffer(big, "<i8")
    return counts


def _request(shards: int, order: int):
    def request(key: tuple, table: pa.Table) -> pa.Table:
        block, rows = Block(table, order), []
        for shard, own, codes, at in block.shares(shards):
            k = rice_parameter(len(codes), 1 << BITS)
            rows.append((shard, key[0].as_py(), len(codes), k, rice_encode(codes, k), *_short(np.bincount(at, block.counts[own]).astype(np.int64))))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "block", "n", "k", "code", "counts", "big"])

    return request


def _answer(shards: int):
    def answer(key: tuple, table: pa.Table) -> pa.Table:
        """Add up what the blocks counted for the keys of a shard, and answer each block in its own order. The first answer tells of the words."""
        asked = table.to_pylist()
        codes = np.concatenate([rice_decode(r["code"], r["n"], r["k"]) for r in asked])
        names, at = np.unique(codes, return_inverse=True)
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, at, np.concatenate([_long(r["counts"], r["big"]) for r in asked]))
        shard, rows, start = key[0].as_py(), [], 0
        told = (int((totals > 0).sum()), int(totals.sum())) if shard < shards // 8 else (0, 0)
        for r in asked:
            rows.append((r["block"], shard, *told, r["n"], *_short(totals[at[start : start + r["n"]]])))
            start, told = start + r["n"], (0, 0)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "shard", "words", "tokens", "n", "counts", "big"])

    return answer


def _score(shards: int, order: int, ends: int):
    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], [c.split()[0] for c in OUT.split(", ")])
        block = Block(table, order)
        told = {r["shard"]: r for r in replies.to_pylist()}
        counts = np.zeros(len(block.keys), np.int64)
        for shard, own, _, at in block.shares(shards):
            counts[own] = _long(told[shard]["counts"], told[shard]["big"])[at]
        of = {n: counts[a:b] for n, (a, b) in enumerate(zip(block.bounds[:-1], block.bounds[1:], strict=True), 1)}
        of[1] = np.append(of[1], [ends, ends])  # a text begins as often as it ends
        known = replies.column("all_words")[0].as_py() + (ends > 0)
        n = replies.column("all_tokens")[0].as_py() + ends
        tokens = block.grams[1]
        p = {1: (of[1] + 0.5) / (n + 0.5 * (known + 1))}
        weight, failure = {1: np.log10(p[1])}, {}
        unknown = of[1] == 0
        for k in range(2, order + 1):
            at = block.first[k]
            before = np.where(np.arange(len(tokens)) == np.repeat(block.offsets[:-1], np.diff(block.offsets)), block.words + 1, np.roll(tokens, 1)) if k == 2 else np.roll(block.grams[k - 1], 1)
            seen, prior = of[k - 1][before[at]], PRIOR[k - 1]
            p[k] = (of[k] + prior * p[k - 1][block.grams[k - 1][at]]) / (seen + prior)
            weight[k] = np.where(of[k] > 0, np.log10(p[k]), np.nan)
            with np.errstate(divide="ignore"):
                failure[k - 1] = np.where(of[k - 1] > 0, np.log10(prior / (of[k - 1] + prior)), np.nan)
        failure[1][block.words] = np.nan  # nothing follows an end
        offsets = block.offsets
        add = lambda x: np.add.reduceat(x, offsets[:-1])
        docs = table.num_rows
        walked = BackoffAutomaton(weight, failure).walk(block.grams, np.full(docs, block.words + 1), offsets)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": pa.array(block.held), "n_tokens": pa.array(np.diff(offsets).astype(np.int64)),
            "n_known": pa.array(add((~unknown)[tokens].astype(np.int64))), "train_tokens": pa.array(np.full(docs, n, np.int64)),
            "base_score": pa.array(add(weight[1][tokens])), "score": pa.array(walked),
        })

    return score


def lm_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, order: int = ORDER) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (of n-grams up to ``order``, 2 or 3).

    The model learns from rows whose crc32 of the doc_id as text, modulo 5, is not 1 (a null doc_id is learned from).
    Tokens are the lower-cased words and one end per text; a null text is an empty one, of the end token alone. With
    no training row every token is unknown. Other columns are ignored; rows may repeat and count each time. An empty
    table gives an empty result.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    size, ends = rows.agg(F.sum(F.octet_length("text") + 64), F.count_if(~F.col("held_out"))).first()
    blocks, shards = max(1, -(-(size or 0) // block_bytes)), 8 * max(1, -(-(size or 0) // (8 * shard_bytes)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(_request(shards, order), REQUEST)
    replies = asked.groupBy("shard").applyInArrow(_answer(shards), REPLY).repartition("block")
    # All columns are read, so that the exchange is the same as that of the replies, and used again.
    told = replies.agg(F.sum("words").alias("all_words"), F.sum("tokens").alias("all_tokens"), F.max(F.hash(*replies.columns)).alias("unused")).drop("unused")
    full = replies.crossJoin(F.broadcast(told))  # one row
    return dealt.groupBy("block").cogroup(full.groupBy("block")).applyInArrow(_score(shards, order, ends), OUT)


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
