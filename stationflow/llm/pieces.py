"""SentencePiece models on the tokenizers library.

The model's protobuf is read here, and its normaliser, white-space marker, scores and byte fallback are rebuilt as a
tokenizers pipeline: a unigram model keeps its scores, a BPE model's scores become the order of its merges. No
piece of such a model has the marker behind another character, so a text's ids are those of its parts between
markers: of a block of texts each different part is encoded once and its ids are put wherever it stands. Each whole text's
ids are compared with those of the sentencepiece library. Where the two differ (long runs of spaces, whose pieces all have one score, which the order of
merges can't express) its ids are taken and the text is marked.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import on_batches

MARK = "▁"
# Kinds of pieces and of models in the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Characters encoded at a time; longer pieces of work gain nothing.
CHUNK = 4000
#: Texts up to so many characters are compared as a whole, longer ones chunk by chunk.
WHOLE = 1 << 20
#: Characters whose parts are Python strings at a time; a longer chunk is a block of its own.
BLOCK = 4 << 20
#: Ids decoded at a time.
IDS = 1 << 20
#: A text's parts: each begins with all the spaces before it.
PART = re.compile(" +[^ ]*|[^ ]+")
#: Parts that can be told apart again after they were encoded side by side: one space, then no marker.
SINGLE = rf"\A [^ {MARK}]+\z"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message: an integer, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
            continue
        if wire not in (1, 2, 5):
            raise ValueError("not a protobuf message")
        size = varint() if wire == 2 else 8 if wire == 1 else 4
        yield number, raw[at : at + size]
        at += size


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]  # text, score, kind
    kind: int
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    suffix_marker: bool


def parse(raw: bytes) -> Model:
    """Read a serialised model; absent fields have the format's defaults."""
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            score = float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0])
            pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Model(
        tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), unknown, normaliser.get(2, b""),
        bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)), bool(trainer.get(24, 0)),
    )


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs that make up a piece, best score first; the ids of the halves settle ties."""
    ids = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for text, score, kind in model.pieces:
        if kind == NORMAL:
            cuts = [(text[:k], text[k:]) for k in range(1, len(text))]
            found += [(-score, ids[a], ids[b], a, b) for a, b in cuts if a in ids and b in ids]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model, prefix: bool):
    """The tokenizers pipeline of a model; ``prefix``: with the dummy prefix."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind not in (UNIGRAM, BPE) or model.suffix_marker or not model.escape:
        raise ValueError("only unigram and BPE models with a leading white-space marker can be rebuilt")
    if any(kind == USER_DEFINED for _, _, kind in model.pieces):
        raise ValueError("models with user-defined pieces can't be rebuilt")
    if model.kind == UNIGRAM:
        scored = [(text, score) for text, score, _ in model.pieces]
        core = models.Unigram(scored, unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        vocabulary = {text: i for i, (text, _, _) in enumerate(model.pieces)}
        unknown = model.pieces[model.unknown][0]
        core = models.BPE(vocabulary, _merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    tokenizer = Tokenizer(core)
    steps += [normalizers.Prepend(" ")] if prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


def _blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in lists of about ``BLOCK`` characters."""
    block, chars = [], 0
    for text in texts:
        if block and chars + len(text) > BLOCK:
            yield block
            block, chars = [], 0
        block.append(text)
        chars += len(text)
    if block:
        yield block


def _joined(values: pa.Array) -> bytes:
    """The bytes of large strings or binaries one after another, as Arrow holds them."""
    if not len(values):
        return b""
    _, ends, held = values.buffers()
    ends = np.frombuffer(ends, "<i8")[values.offset :]
    return held[int(ends[0]) : int(ends[len(values)])].to_pybytes() if held else b""


@cache
def codec(path: str) -> Codec:
    return Codec(path)


class Codec:
    """Encodes and decodes texts with one model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core of an executor
        import sentencepiece

        with open(path, "rb") as file:
            raw = file.read()
        self.model = parse(raw)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=raw)
        texts = [text for text, _, kind in self.model.pieces if kind == NORMAL]
        inside = any(MARK in text.lstrip(MARK) for text in texts)
        #: A text may be cut before a marker unless a piece, or the character map, could reach over it.
        self.cuts = not inside and not self.model.charsmap and not self.model.squeeze
        self.tokenizer = build(self.model, self.model.dummy_prefix and not self.cuts)
        self.bytes_of = pa.array([self._raw(*piece) for piece in self.model.pieces], pa.large_binary())
        self.begins = np.array([text.startswith(MARK) for text, _, _ in self.model.pieces])

    def _raw(self, text: str, _score: float, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(text[1:-1], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.replace(MARK, " ").encode()

    def chunks(self, text: str) -> list[str]:
        """The text in chunks of about ``CHUNK`` characters, each with the spaces before it; whole where it can't be cut."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        whole = f" {text}" if self.model.dummy_prefix else text
        return [whole] if MARK in text else self._cut(whole)

    def _cut(self, whole: str) -> list[str]:
        out, start = [], 0
        while len(whole) - start > CHUNK:
            at = whole.find(" ", start + CHUNK)
            while at > 0 and whole[at - 1] == " ":  # a run of spaces stays before the word that follows it
                at = whole.find(" ", at + 1)
            if at < 0 or at == len(whole) - 1:  # a lone last space is no chunk: sentencepiece gives the empty text no ids
                break
            out.append(whole[start:at])
            start = at
        return [*out, whole[start:]]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Per text its ids as little-endian unsigned 32-bit numbers, and whether sentencepiece gives the same."""
        cut = [self.chunks(t) for t in texts]
        encoded = chain.from_iterable(map(self._rebuilt, _blocks(chain.from_iterable(cut))))
        expected = self.original.encode([t if len(t) <= WHOLE else "" for t in texts], num_threads=1, return_type="numpy")
        out = []
        for text, chunks, right in zip(texts, cut, expected):
            got = np.concatenate([np.empty(0, "<i4"), *(next(encoded) for _ in chunks)])
            if len(text) > WHOLE:
                right = self._in_chunks(chunks)
            same = np.array_equal(got, right)
            out.append(((got if same else right).astype("<i4").tobytes(), same))
        return out

    def _rebuilt(self, chunks: list[str]) -> list[np.ndarray]:
        """The rebuilt tokenizer's ids of each chunk."""
        if not self.cuts:
            return [np.array(ids, "<i4") for ids in self._each(chunks)]
        parts = [[c] if MARK in c else PART.findall(c) for c in chunks]
        words = pa.array(chain.from_iterable(parts), pa.large_string()).dictionary_encode()
        ids, sizes, place = self._parts(words.dictionary)
        lists = pa.LargeListArray.from_arrays(np.append(0, sizes.cumsum()), ids)
        spread = lists.take(pa.array(place[words.indices.to_numpy()]))
        ends = spread.offsets.to_numpy()[np.cumsum([len(p) for p in parts])]
        return np.split(spread.values.to_numpy(), ends[:-1])

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different parts, one part after another; how many each has; and which of them each of ``words`` is.

        Parts of one space are encoded side by side: the first id of each, and no other, begins with a marker.
        """
        single = pc.match_substring_regex(words, SINGLE).to_numpy(zero_copy_only=False)
        beside = _joined(words.filter(pa.array(single))).decode()
        ids = np.fromiter(chain.from_iterable(self._each(self._cut(beside))), "<i4")
        first = np.flatnonzero(self.begins[ids])
        if len(first) < single.sum():  # a model without the marker itself
            single[:], ids, first = False, ids[:0], first[:0]
        alone = list(self._each(words.filter(pa.array(~single)).to_pylist()))
        sizes = np.append(np.diff(np.append(first, len(ids))), np.array([len(x) for x in alone], np.int64))
        place = np.empty(len(words), np.int64)
        place[np.append(np.flatnonzero(single), np.flatnonzero(~single))] = np.arange(len(words))
        return np.append(ids, np.fromiter(chain.from_iterable(alone), "<i4")), sizes, place

    def _each(self, texts: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _in_chunks(self, chunks: list[str]) -> np.ndarray:
        """What sentencepiece makes of a very long text, chunk by chunk. It puts its own dummy prefix before a chunk, so the space
        that one begins with is taken off for it."""
        bare = [c[1:] for c in chunks] if self.cuts and self.model.dummy_prefix else chunks
        return np.concatenate([self.original.encode(c, return_type="numpy") for c in bare])

    def decode(self, ids: bytes) -> str:
        """The text of ids; the dummy prefix is taken off, bytes that are no text become U+FFFD."""
        every = np.frombuffer(ids, "<i4")
        raw = b"".join(_joined(self.bytes_of.take(pa.array(every[at : at + IDS]))) for at in range(0, len(every), IDS))
        if self.model.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


ENCODED = pa.struct([("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("parity", pa.bool_()), ("round_trip", pa.bool_())])


def encoded(text: Column, path: str) -> Column:
    """Struct of ids, their crc32 as little-endian unsigned 32-bit numbers, parity (sentencepiece gives the same ids) and
    round_trip (decoding gives the text again). NULL and the empty text have no ids."""

    def start():
        code = codec(path)

        def handle(texts: list[str]) -> list[dict]:
            out = []
            for part in _blocks(texts):
                for text, (ids, same) in zip(part, code.encode(part)):
                    fits = code.decode(ids) == text
                    out.append({"ids": np.frombuffer(ids, "<i4"), "ids_crc32": zlib.crc32(ids), "parity": same, "round_trip": fits})
            return out

        return handle

    return on_batches(start, ENCODED, "ids array<int>, ids_crc32 long, parity boolean, round_trip boolean")(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of an array of ids; NULL is no ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = codec(path)
        for lists in batches:
            yield pa.array([code.decode(np.array(x or [], "<u4").tobytes()) for x in lists.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, parity, round_trip) of every row."""
    rows = docs.select("doc_id", encoded(F.col("text"), path).alias("_e"))
    return rows.select("doc_id", "_e.ids", F.size("_e.ids").cast("long").alias("n_tokens"), "_e.ids_crc32", "_e.parity", "_e.round_trip")
