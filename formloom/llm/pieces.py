"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read field by field; its normaliser, white-space
marker, piece scores and byte fallback are rebuilt as a ``tokenizers.Tokenizer``.
No piece has a marker after another character, so no merge crosses the start of
a marker run, and a text may be cut there: each distinct cut of a batch is
encoded once, all of them in one multithreaded call.
"""

from __future__ import annotations

import hashlib
import importlib.util
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .session import bounded_batches, table
from .words import text_slices

MARK = "▁"
#: Cuts that are encoded as one run; cuts that a worker remembers; text that it handles at once; threads of a worker.
JOINED, CACHED, SLICE, THREADS = 500, 200_000, 1 << 20, 2
#: Characters of a text that the library checks, at most.
WITNESS = 20_000
#: Fixed values of the model format: model types, and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    """The installed public tokenizers' SentencePiece file."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec else Path("/opt/tokenizers")
    return str(folder / "piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message; nested ones stay bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What a model file says: pieces with scores and types, and how texts are normalised."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True
    marker_last: bool = False
    unknown_surface: str = " \u2047 "

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                model.pieces.append(own.get(1, b"").decode())
                model.scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                model.types.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                model.model_type, model.byte_fallback, model.marker_last = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
                model.unknown_surface = own[44].decode() if 44 in own else model.unknown_surface
            elif number == 3:
                own = dict(_fields(value))
                model.charsmap = own.get(2, b"")
                model.dummy_prefix, model.trim_spaces, model.escape_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
        return model

    @property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN)


def _merges(model: PieceModel, ids: dict[str, int]) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best first: by the joined piece's score, ties by the parts' ids."""
    found = []
    for piece, score, kind in zip(model.pieces, model.scores, model.types, strict=True):
        if kind == NORMAL:
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in ids and b in ids:
                    found.append((-score, ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


class CharacterMap:
    """A model's character map: at each place the longest string that it has is replaced, anything else stays.

    The map is a double-array trie over UTF-8 bytes, of 32-bit units, behind its size; leaves point to the replacements,
    which follow, each with a zero byte at its end.
    """

    def __init__(self, data: bytes) -> None:
        size = int(np.frombuffer(data[:4], "<u4")[0])
        units, out = np.frombuffer(data[4 : 4 + size], "<u4").astype(np.int64), data[4 + size :]
        offset = (units >> 10) << ((units & 512) >> 6)
        self.to: dict[str, str] = {}
        level = [(b"", int(offset[0]))]
        while level:  # all nodes of one length at a time, with all their children
            at = np.array([n for _, n in level], np.int64)[:, None] ^ np.arange(1, 256)
            inside = at < len(units)
            child = np.where(inside, at, 0)
            good = inside & ((units[child] & 0x800000FF) == np.arange(1, 256))
            following = []
            for row, byte in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
                node = int(child[row, byte])
                key, base = level[row][0] + bytes([byte + 1]), node ^ int(offset[node])
                if units[node] >> 8 & 1:
                    start = int(units[base]) & 0x7FFFFFFF
                    self.to[key.decode()] = out[start : out.index(b"\0", start)].decode()
                following.append((key, base))
            level = following
        self.longest = max(map(len, self.to), default=0)
        alone = regex.escape("".join(sorted({k for k in self.to if len(k) == 1})), special_only=False)
        heads, nexts = (regex.escape("".join(sorted({k[i] for k in self.to if len(k) > 1})), special_only=False) for i in (0, 1))
        parts = [f"[{heads}][{nexts}]"] * bool(heads) + [f"[{alone}]"] * bool(alone)
        #: Where a replacement may start; other characters are passed over.
        self.start = regex.compile("|".join(parts)) if parts else None

    def __call__(self, text: str) -> str:
        if self.start is None:
            return text
        done, at, parts = 0, 0, []
        while found := self.start.search(text, at):
            at = found.start()
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if (new := self.to.get(text[at : at + n])) is not None:
                    parts += [text[done:at], new]
                    at = done = at + n
                    break
            else:
                at += 1
        return "".join([*parts, text[done:]])


class PieceTokenizer:
    """Encodes and decodes whole texts in batches. Special pieces in a text are ordinary text."""

    def __init__(self, data: bytes) -> None:
        self.model = model = PieceModel.parse(data)
        if model.model_type not in (UNIGRAM, BPE) or not model.escape_spaces or model.marker_last or any(t == USER_DEFINED for t in model.types):
            raise ValueError("only unigram and BPE models with escaped spaces, markers first and no user-defined pieces are supported")
        kinds = list(zip(model.pieces, model.types, strict=True))
        if model.model_type == BPE:
            names = {p: i for i, p in enumerate(model.pieces)}
            if alone := {c for p, t in kinds if t == NORMAL for c in p} - {p for p, t in kinds if t == NORMAL}:
                raise ValueError(f"characters of pieces that are no pieces can't be merged: {sorted(alone)[:5]}")
            core = models.BPE(names, _merges(model, {p: i for i, (p, t) in enumerate(kinds) if t == NORMAL}), unk_token=model.pieces[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
        else:  # pieces that no text may match keep their ids under names with a space, which no normalised text has
            core = models.Unigram([(p, s) if t == NORMAL else (f" {i}", 0.0) for i, ((p, t), s) in enumerate(zip(kinds, model.scores, strict=True))], model.unknown, False)
        self.backend = Tokenizer(core)
        #: A cut before each marker run is exact only if a piece has a marker at its start alone, and no unknown run crosses it.
        self.cuts = not any(MARK in p.lstrip(MARK) for p, t in kinds if t == NORMAL) and (model.byte_fallback or (MARK, NORMAL) in kinds)
        if self.cuts:
            self.backend.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        self.charsmap = CharacterMap(model.charsmap) if model.charsmap else None
        self._reset()
        #: Ids of the bytes, where the unigram core's unknown runs are to be spelled out.
        self.byte_ids = np.array([{int(p[3:5], 16): i for i, (p, t) in enumerate(kinds) if t == BYTE}.get(b, model.unknown) for b in range(256)], np.int32) if model.model_type == UNIGRAM and model.byte_fallback else None
        surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else model.unknown_surface.encode() if t == UNKNOWN else p.replace(MARK, " ").encode() for p, t in kinds]
        self.marked = np.array([p.startswith(MARK) and t == NORMAL for p, t in kinds])
        self.out_size = np.array([len(x) for x in surface], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_flat = np.frombuffer(b"".join(surface), np.uint8)

    def _ids(self, text: str, got) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an encoding and of each the word that it is of; unknown runs as bytes if the model has them."""
        ids, words = np.array(got.ids, np.int32), np.array(got.word_ids, np.int64) if got.ids else np.zeros(0, np.int64)
        if self.byte_ids is None or self.model.unknown not in got.ids:
            return ids, words
        parts = [self.byte_ids[np.frombuffer(text[a:b].encode(), np.uint8)] if i == self.model.unknown else ids[k : k + 1] for k, (i, (a, b)) in enumerate(zip(got.ids, got.offsets, strict=True))]
        return np.concatenate(parts), np.repeat(words, [len(x) for x in parts])

    def _reset(self) -> None:
        """Forget the cuts encoded so far: their places by text, and the ids of all, one after the other."""
        self.place: dict[str, int] = {}
        self.sizes, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @classmethod
    def load(cls, path: str) -> PieceTokenizer:
        return cls(Path(path).read_bytes())

    def normalise(self, texts: list[str]) -> list[str]:
        """As the model normalises: character map, trimmed spaces if it says so, a prefix, spaces as markers."""
        out = []
        for text in texts:
            if self.charsmap:
                text = self.charsmap(text)
            if self.model.trim_spaces:
                text = " ".join(x for x in text.split(" ") if x)
            if text and self.model.dummy_prefix:
                text = " " + text
            out.append(text.replace(" ", MARK))
        return out

    def _encode_cuts(self, cuts: list[str]) -> list[np.ndarray]:
        """Ids of cuts. Runs of them are joined, as the pre-tokenizer parts them again; a call encodes all runs on many threads."""
        runs, alone = [], []
        run: list[str] = []
        for cut in cuts:
            if cut.startswith(MARK) and not cut.endswith(MARK):
                run.append(cut)
                if len(run) == JOINED:
                    runs.append(run)
                    run = []
            else:
                alone.append(cut)
        runs += [run] if run else []
        found: dict[str, np.ndarray] = {}
        joined = ["".join(r) for r in runs]
        for own, text, got in zip(runs, joined, self.backend.encode_batch(joined, add_special_tokens=False), strict=True):
            ids, words = self._ids(text, got)
            bounds = np.searchsorted(words, np.arange(len(own) + 1)).tolist()
            found.update((cut, ids[x:y]) for cut, x, y in zip(own, bounds[:-1], bounds[1:], strict=True))
        found.update((cut, self._ids(cut, got)[0]) for cut, got in zip(alone, self.backend.encode_batch(alone, add_special_tokens=False), strict=True))
        return [found[c] for c in cuts]

    def _places(self, cuts: list[str]) -> np.ndarray:
        """Where the ids of cuts are kept; new ones are encoded once."""
        place = self.place
        new = [c for c in cuts if c not in place]
        if new:
            rows = self._encode_cuts(new)
            sizes = np.array([len(r) for r in rows], np.int64)
            place.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, *rows])
        return np.fromiter((place[c] for c in cuts), np.int64, len(cuts))

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all cuts of all texts, and the texts' bounds among them."""
        if len(self.place) > CACHED:
            self._reset()
        ready = self.normalise(texts)
        if not self.cuts:
            return self._places(ready), np.arange(len(ready) + 1)
        parts = pc.split_pattern(pa.array(ready, pa.string()), MARK)
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        flat = parts.values
        # The first part of a text stands before its first marker; empty parts are markers that run on into the next part.
        first = np.zeros(len(flat), bool)
        first[offsets[:-1]] = True
        empty = np.asarray(pc.equal(pc.binary_length(flat), 0))
        if (empty & ~first).any():
            return self._cut_runs(parts)
        coded = flat.dictionary_encode()
        full = ~(first & empty)
        code = (np.asarray(coded.indices, dtype=np.int64) * 2 + ~first)[full]
        names, code = np.unique(code, return_inverse=True)
        words = coded.dictionary.take(pa.array(names // 2)).to_pylist()
        places = self._places([MARK + w if n % 2 else w for w, n in zip(words, names.tolist(), strict=True)])
        return places[code] if len(code) else code, np.concatenate([[0], np.cumsum(full)])[offsets]

    def _cut_runs(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same where some text has runs of markers, or ends in one."""
        index: dict[str, int] = {}
        code, bounds = [], [0]
        for row in parts.to_pylist():
            run = 0
            for k, part in enumerate(row):
                run += k > 0
                if part or k == len(row) - 1:
                    if unit := MARK * run + part:
                        code.append(index.setdefault(unit, len(index)))
                    run = 0
            bounds.append(len(code))
        places = self._places(list(index))
        return (places[np.array(code, np.int64)] if code else np.zeros(0, np.int64)), np.array(bounds, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their offsets."""
        places, bounds = self._cut(texts)
        return _gather(self.flat, self.starts[places], self.sizes[places], bounds)

    def lengths(self, texts: list[str]) -> np.ndarray:
        places, bounds = self._cut(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.sizes[places])])[bounds])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id sequences; the space of the prefix is left out, bytes that form no UTF-8 become U+FFFD."""
        data, at = _gather(self.out_flat, self.out_start[ids], self.out_size[ids], offsets)
        raw, out = data.tobytes(), []
        some = offsets[1:] > offsets[:-1]
        cuts = np.zeros(len(some), bool)  # the prefix of the first piece; a space spelled as a byte is none
        cuts[some] = self.marked[ids[offsets[:-1][some]]] & self.model.dummy_prefix
        for a, b, cut in zip(at[:-1].tolist(), at[1:].tolist(), cuts.tolist(), strict=True):
            try:
                text = raw[a:b].decode()
            except UnicodeDecodeError:
                text = regex.sub("[\udc80-\udcff]", "\ufffd", raw[a:b].decode(errors="surrogateescape"))
            out.append(text[cut:])
        return out


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[starts:starts+sizes] of all rows, one after the other, and where the groups of rows ``bounds`` begin and end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    taken = flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)] if total else flat[:0]
    return taken, np.concatenate([[0], ends])[bounds].astype(np.int64)


@lru_cache(maxsize=2)
def tokenizer(path: str, parity: bool = True) -> PieceTokenizer:
    """The worker's tokenizer of a model file, checked against the reference library on probe texts when it is built."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    built = PieceTokenizer.load(path)
    if parity and (bad := parity_failures(built, path, PROBES)):
        raise ValueError(f"the rebuilt tokenizer differs from the model on {bad[:3]!r}")
    return built


PROBES = ("", " ", "  two  spaces ", "plain words of a text", "Tabs\tand\nlines\r\n", "été ß naïve ▁ mark", "\U0001f600 bytes ͸", "<s> </s> <unk> <0x41>", "UPPER!! ### $$$ 12345 a.b@c.de", "中文 日本語", "a" * 40)


@lru_cache(maxsize=2)
def _reference(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def parity_failures(built: PieceTokenizer, path: str, texts) -> list[str]:
    """The texts whose ids differ from those of the sentencepiece library."""
    ids, offsets = built.encode(list(texts))
    return [t for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True) if _reference(path).encode(t) != ids[a:b].tolist()]


def _encoded_slices(path: str, batches: Iterator[pa.RecordBatch]):
    """For each slice: doc_ids, ids and offsets, decoded texts, and whether these are the normalised ones.

    Each slice's first text of at most WITNESS characters is encoded by the sentencepiece library too, whole; a difference is an error.
    """
    built = tokenizer(path)
    for batch in batches:
        for part in text_slices(batch, most=SLICE):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids, offsets = built.encode(texts)
            witness = next((k for k, t in enumerate(texts) if 0 < len(t) <= WITNESS), None)
            if witness is not None and _reference(path).encode(texts[witness]) != ids[offsets[witness] : offsets[witness + 1]].tolist():
                raise ValueError(f"the rebuilt tokenizer differs from the model on {texts[witness][:200]!r}")
            back = built.decode(ids, offsets)
            plain = not built.charsmap and not built.model.trim_spaces
            same = [b == t for b, t in zip(back, texts, strict=True)] if plain else [a == b for a, b in zip(built.normalise(back), built.normalise(texts), strict=True)]
            yield part.column("doc_id"), ids, offsets, back, same


def _rows(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text"))


def encoded(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded (text), exact (the decoded text is the normalised one).

    A null text counts as empty, which has no ids. Rows may repeat; other columns are ignored. An empty table gives an
    empty result. The model file must be readable by the workers at the same path.
    """
    path = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, offsets, back, same in _encoded_slices(path, batches):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([doc_ids, lists, pa.array(back), pa.array(same)], ["doc_id", "ids", "decoded", "exact"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string, exact boolean")


def encoded_digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """encoded() as digests: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256, exact."""
    path = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, offsets, back, same in _encoded_slices(path, batches):
            flat, at = ids.astype("<i4"), offsets.tolist()
            sha = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            text = [hashlib.sha256(t.encode()).hexdigest() for t in back]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(offsets).astype(np.int64)), pa.array(sha), pa.array(text), pa.array(same)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))
