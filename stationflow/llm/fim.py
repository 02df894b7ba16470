"""Fill-in-middle rearrangement of texts, cut between code points found by word-parallel arithmetic on the UTF-8 bytes.

The bytes of an Arrow batch are seen as 64-bit words. A byte ends a unit if the next one does not continue it; that is marked
for the eight bytes of a word at once, ``bitwise_count`` counts the marks of each word, and their running sum gives the word
of the k-th unit by binary search. Within the word, a multiplication puts the number of marks up to each byte into that byte,
and comparing all eight with k at once gives the byte. No text is decoded in Python: it only returns two places, and the
JVM puts the parts together.

Edge cases: a NULL text is an empty one; an empty text, and one that holds a sentinel, stays as it is (form 'plain'). A NULL id is
hashed as empty text. Rows are handled one by one, so repeated rows give equal results; texts may have any length, since a
batch is handled in spans of ``SPAN`` bytes (a longer text alone in its span); other columns pass through, and those named like a
result are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes whose words are looked at together, so that a batch of long texts needs little memory.
SPAN = 4 << 20

_LOW = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    """Marks before prefix, suffix and middle. None may begin inside another, so that they are found again."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = [self.prefix, self.suffix, self.middle]
        overlap = any(a[i:].startswith(b[: len(a) - i]) or b in a[i:] for a in marks for b in marks for i in range(1, len(a)))
        if not all(marks) or len(set(marks)) < 3 or overlap:
            raise ValueError("sentinels must differ and not overlap each other")


def unit_ends(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Words in which a byte is 1 where a code point ends: where no continuation byte follows, and at each of ``stops``."""
    words = np.zeros(len(data) // 8 + 1, "<u8")
    words.view(np.uint8)[: len(data)] = data
    starts = ~((words >> np.uint64(7)) & ~(words >> np.uint64(6))) & _LOW
    marks = starts >> np.uint64(8)
    marks[:-1] |= starts[1:] << np.uint64(56)
    seen = marks.view(np.uint8)
    seen[stops - 1] = 1
    seen[len(data) :] = 0
    return marks


def rank(marks: np.ndarray, before: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Units that end before byte ``place``; ``before`` has the units before each word."""
    word, byte = place >> 3, (place & 7).astype(np.uint64)
    below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
    return before[word] + np.bitwise_count(marks[word] & below)


def select(marks: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Byte behind the ``k``-th unit, counted from 1."""
    word = np.minimum(np.searchsorted(before, k, "left") - 1, len(marks) - 1)
    missing = (k - before[word]).astype(np.uint64)
    upto = marks[word] * _LOW  # byte i: the marks of bytes 0 to i
    reached = ((upto | _HIGH) - missing * _LOW) & _HIGH
    return (word << 3) + 9 - np.bitwise_count(reached)


def _spans(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + SPAN, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def cut_places(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Per text: code points, units before the two cuts, bytes before the two cuts (rows of an array)."""
    out = np.zeros((5, len(offsets) - 1), np.int64)
    for first, last in _spans(offsets):
        start = offsets[first]
        at = (offsets[first : last + 1] - start).astype(np.int64)
        marks = unit_ends(data[start : start + at[-1]], at[1:][at[1:] > at[:-1]])
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))
        base = rank(marks, before, at)
        n = np.diff(base)
        a, b = h1[first:last] % (n + 1), h2[first:last] % (n + 1)
        out[0, first:last] = n
        for row, units in enumerate((np.minimum(a, b), np.maximum(a, b))):
            out[1 + row, first:last] = units
            behind = np.where(units > 0, select(marks, before, np.maximum(base[:-1] + units, 1)), at[:-1])
            out[3 + row, first:last] = behind - at[:-1]
    return out


_CUTS = pa.struct([(name, pa.int64()) for name in ("n", "a", "b", "a_bytes", "b_bytes")])


def _cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    columns = cut_places(data, offsets, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_CUTS))


def _draws(key: Column, seed: str) -> list[Column]:
    """Four integers of 32 bits from the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 90,
    spm_percent: int = 20,
    seed: str = "1",
    sentinels: Sentinels = Sentinels(),
) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Of the texts that can be cut, about ``percent`` in a hundred are, and of those ``spm_percent`` with the suffix first. The
    choice and both cuts follow from ``seed`` and key alone, so a task that is run again gives the same.
    """
    marks = (sentinels.prefix, sentinels.suffix, sentinels.middle)
    whole = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = _draws(F.col(key), seed)
    places = F.arrow_udf(_cuts, "n long, a long, b long, a_bytes long, b_bytes long")
    held = reduce(lambda x, y: x | y, [F.contains(whole, F.lit(m)) for m in marks])
    form = F.when((whole == "") | held | (h3 % 100 >= percent), PLAIN).when(h4 % 100 < spm_percent, SPM).otherwise(PSM)
    rows = docs.withColumns({"_cut": places(F.col(text), h1, h2), "_form": form})
    raw, a, b = whole.cast("binary"), F.col("_cut.a_bytes"), F.col("_cut.b_bytes")
    prefix = F.substring(raw, F.lit(1), a.cast("int")).cast("string")
    middle = F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    suffix = F.substring(raw, (b + 1).cast("int"), F.octet_length(whole)).cast("string")
    p, s, m = (F.lit(mark) for mark in marks)
    output = (
        F.when(F.col("_form") == PSM, F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("_form") == SPM, F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(whole)
    )
    cut = F.col("_form") != PLAIN
    return rows.withColumns(
        {
            "n": F.col("_cut.n"),
            "form": F.col("_form"),
            "prefix_chars": F.when(cut, F.col("_cut.a")),
            "middle_chars": F.when(cut, F.col("_cut.b") - F.col("_cut.a")),
            "output": output,
        }
    ).drop("_cut", "_form")


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that ``transformed`` was given, from its output and form."""
    marks = (sentinels.prefix, sentinels.suffix, sentinels.middle)
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    prefix = F.when(form == PSM, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    suffix = F.when(form == PSM, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(form == PLAIN, output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))
