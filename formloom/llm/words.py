"""Word and hash helpers over Arrow batches, shared by the operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z are
lower-cased. Nulls count as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20


@dataclass
class Words:
    """Words of some documents: word k of document d is vocab[ids[offsets[d] + k]]."""

    offsets: np.ndarray
    ids: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` bytes of text; a longer text is a run of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array) -> Words:
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.dictionary_encode()
    return Words(offsets, np.asarray(coded.indices, dtype=np.int64), coded.dictionary)


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string; the same on every machine."""
    digest = xxhash.xxh3_64_intdigest
    data = values.cast(pa.binary()).to_pylist()
    return np.fromiter((digest(v, seed) for v in data), dtype=np.uint64, count=len(data))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document and their offsets.

    A document of fewer words has one shingle, the whole sequence; one without words has none.
    """
    hashes = hash_strings(words.vocab)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                        0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
    factor = lambda k: factors[k % 8] + np.uint64(2 * (k // 8))
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * factor(k)
    rolled = mix64(rolled + np.uint64(width))
    out, sizes = [], np.zeros(len(words.offsets) - 1, np.int64)
    bounds = words.offsets.tolist()
    for d in range(len(sizes)):
        a, b = bounds[d], bounds[d + 1]
        if b - a >= width:
            own = np.unique(rolled[a : b - width + 1])
        elif b > a:
            whole = (hashes[a:b] * np.array([factor(k) for k in range(b - a)], np.uint64)).sum(dtype=np.uint64)
            own = mix64(np.array([whole], np.uint64) + np.uint64(b - a))
        else:
            continue
        out.append(own)
        sizes[d] = len(own)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
