"""Token ids in directly addressable codes.

Ids of consecutive documents are written as segments. A segment splits every id into chunks of ``BITS`` bits.
Level 0 holds the lowest chunk of each id, level k the next chunk of those ids that need one. A bitmap
per level tells which entries go on, and a directory with the number of set bits before each block of 512
gives the entry's place on the next level, so any one id is read with a few lookups and no decoding.

Layout of a segment, all numbers little-endian: ``b"DAC1"``, u32 ids, u32 levels, then per level u32 entries,
the chunks (one byte each), the bitmap (one bit per entry, lowest first, to whole bytes), u32 directory
(one count per 512 entries, and one more). The last level has neither bitmap nor directory.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.common import Remembered
from stationflow.session import settle

MAGIC = b"DAC1"
BITS = 8
BLOCK = 512
END_ID = 2
#: Ids after which a segment is closed; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 18

SEGMENTS = "shard int, segment int, ids long, doc_ids array<long>, lengths array<long>, payload binary"


# -- the code ---------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """Segment bytes of an array of unsigned 32-bit ids."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunk, rest = (rest & ((1 << BITS) - 1)).astype(np.uint8), rest >> BITS
        more = rest > 0
        levels.append((chunk, more))
        rest = rest[more]
        if not rest.size:
            break
    out = [MAGIC, np.array([ids.size, len(levels)], "<u4").tobytes()]
    for chunk, more in levels:
        out += [np.array([chunk.size], "<u4").tobytes(), chunk.tobytes()]
        if chunk is not levels[-1][0]:
            starts = np.add.reduceat(more, np.arange(0, more.size, BLOCK), dtype=np.uint32)
            directory = np.concatenate([[0], np.cumsum(starts)]).astype("<u4")
            out += [np.packbits(more, bitorder="little").tobytes(), directory.tobytes()]
    return b"".join(out)


def parse(payload: bytes) -> list[SimpleNamespace]:
    """Views of the levels of a segment; nothing is decoded."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    _, levels = np.frombuffer(payload, "<u4", 2, 4)
    at, out = 12, []
    for k in range(levels):
        n = int(np.frombuffer(payload, "<u4", 1, at)[0])
        level = SimpleNamespace(chunk=np.frombuffer(payload, np.uint8, n, at + 4), bitmap=None, directory=None)
        at += 4 + n
        if k < levels - 1:
            level.bitmap = np.frombuffer(payload, np.uint8, -(-n // 8), at)
            at += level.bitmap.size
            level.directory = np.frombuffer(payload, "<u4", -(-n // BLOCK) + 1, at)
            at += 4 * level.directory.size
        out.append(level)
    return out


def id_at(levels: list[SimpleNamespace], i: int) -> int:
    """The id at position ``i``: a chunk, a bit and a rank per level, nothing else is read."""
    value, shift = 0, 0
    for level in levels:
        value |= int(level.chunk[i]) << shift
        if level.bitmap is None or not level.bitmap[i >> 3] >> (i & 7) & 1:
            return value
        block = i // BLOCK
        inside = np.unpackbits(level.bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")
        i = int(level.directory[block]) + int(inside[: i - block * BLOCK].sum())
        shift += BITS
    return value


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a segment."""
    levels = parse(payload)
    values = np.zeros(0, np.uint32)
    for level in reversed(levels):
        here = level.chunk.astype(np.uint32)
        if level.bitmap is not None:
            more = np.unpackbits(level.bitmap, count=here.size, bitorder="little").astype(bool)
            here[more] |= values << BITS
        values = here
    return values


# -- encoding ---------------------------------------------------------------------------------------


@cache
def _library_encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Whole-text ids of a tokenizer whose pre-tokenizer never joins what white space divides.

    Such a text's ids are those of its parts between spaces, so parts are encoded once and remembered. A word of Latin-1
    letters is remembered in lower case and without the marks behind it, which the pre-tokenizer parts from it anyway, and goes to
    the vocabulary's model directly, its bytes spelled as the vocabulary spells them.
    """

    def __init__(self, path: str):
        self.tokenizer = _library_encoder(path)
        self.model = self.tokenizer.model
        self.stems = Remembered(self._stem)
        self.parts = Remembered(self._part)
        self.spelling = self._spellings()
        #: Words whose letters the model can be given.
        self.plain = re.compile(f"[a-z{''.join(map(chr, self.spelling))}]+").fullmatch

    def _spellings(self) -> dict[int, str]:
        """How the vocabulary spells each lower-case Latin-1 letter beyond ASCII; only of those for which the model by itself gives the
        ids that the whole tokenizer gives."""
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(0xAA, 0x100)) if c.isalpha() and c.lower() == c]
        spelled = {c: "".join(part for part, _ in level.pre_tokenize_str(c)) for c in letters}
        words = {c: (c, f"a{c}", f"{c}b", f"re{c}{c}te") for c in letters}

        def agrees(c: str) -> bool:
            return all([t.id for t in self.model.tokenize(w.replace(c, spelled[c]))] == self._whole(w) for w in words[c])

        return {ord(c): spelled[c] for c in letters if agrees(c)}

    def _stem(self, stem: str) -> bytes:
        spelled = stem if stem.isascii() else stem.translate(self.spelling)
        return self._bytes([t.id for t in self.model.tokenize(spelled)])

    def _whole(self, part: str) -> list[int]:
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        bare = part.rstrip(string.punctuation)
        stem = bare.lower()
        if not self.plain(stem):
            return self._bytes(self._whole(part))
        return self.stems[stem] if len(bare) == len(part) else self.stems[stem] + self.parts[part[len(bare) :]]

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.parts.joined(text.replace("\n", " ").split(" "))


@cache
def _word_encoder(path: str) -> WordEncoder:
    """One per Python worker, so that its later tasks know the words of the earlier ones."""
    return WordEncoder(path)


def _segments(tokenizer: str, end_id: int):
    """Rows in order of doc_id to segments, a shard per partition."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), _word_encoder(tokenizer)
        docs, parts, held, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            row = {
                "shard": [shard], "segment": [number], "ids": [held], "doc_ids": [docs],
                "lengths": [[len(p) // 4 for p in parts]], "payload": [pack(np.frombuffer(b"".join(parts), "<u4"))],
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds)], list(row))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                if parts and held + len(ids) // 4 > SEGMENT_IDS:
                    yield flush()
                    docs, parts, held, number = [], [], 0, number + 1
                docs.append(doc_id)
                parts.append(ids)
                held += len(ids) // 4
        if parts:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode whole texts (NULL: empty), close each with ``end_id``, and write them in ascending doc_id.

    Returns the written table (``SEGMENTS``), read back. Rows of equal id follow each other, in order of a hash of
    their text; a NULL id comes first. No rows give an empty table. The sort moves each text once; every task
    then encodes and writes its range, so a lost executor costs only its ranges.
    """
    ordered = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id"), F.col("_tie")).sortWithinPartitions("doc_id", "_tie")
    return settle(ordered.select("doc_id", "text").mapInArrow(_segments(tokenizer, end_id), SEGMENTS), "tokens")


# -- reading ----------------------------------------------------------------------------------------


def with_first(segments: DataFrame) -> DataFrame:
    """Add ``first``, the number of ids in all segments before. Shards are summed first, so a window holds one row
    per shard, or one shard's segments."""
    by_shard = segments.groupBy("shard").agg(F.sum("ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = by_shard.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    slim = segments.select("shard", "segment", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("_inside"))
    first = slim.join(offset, "shard").select("shard", "segment", (F.col("_offset") + F.col("_inside")).alias("first"))
    return segments.join(first, ["shard", "segment"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw = memoryview(unpack(row["payload"]).astype("<u4").tobytes())
            starts = np.cumsum([0, *row["lengths"]])
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1], starts[1:])]
            columns = {
                "shard": [row["shard"]] * len(sums), "segment": [row["segment"]] * len(sums), "doc_id": row["doc_ids"],
                "inside": starts[:-1], "n_tokens": row["lengths"], "ids_crc32": sums,
            }
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds)], list(columns))


def document_index(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written segments."""
    kinds = "shard int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    decoded = segments.select("shard", "segment", "doc_ids", "lengths", "payload").mapInArrow(_documents, kinds)
    first = with_first(segments.select("shard", "segment", "ids")).select("shard", "segment", "first")
    placed = decoded.join(first, ["shard", "segment"])
    return placed.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            levels = parse(row["payload"])
            ids = [id_at(levels, p - row["first"]) for p in row["positions"]]
            yield pa.RecordBatch.from_arrays([pa.array(row["positions"], pa.int64()), pa.array(ids, pa.int64())], ["position", "id"])


def tokens_at(segments: DataFrame, positions: list[int]) -> DataFrame:
    """(position, id) for a stated list of global positions; those outside the table give no row.

    Only segments that hold one are opened, and in them only the chunks of the wanted ids are read.
    """
    placed = with_first(segments.select("shard", "segment", "ids"))
    wanted = F.filter(
        F.lit(sorted(set(positions))) if positions else F.array().cast("array<long>"),
        lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("ids")),
    )
    held = placed.withColumn("positions", wanted.cast("array<long>")).where(F.size("positions") > 0)
    rows = segments.join(held.select("shard", "segment", "first", "positions"), ["shard", "segment"])
    return rows.select("first", "positions", "payload").mapInArrow(_picked, "position long, id long")
