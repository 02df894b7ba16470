"""Secret scan with a recursive decoding worklist.

A text is scanned as it is; then whatever looks encoded in it (URL escapes, Unicode escapes, base64, zlib or gzip bytes,
UTF-16) is decoded into a layer of its own, and layers are scanned and searched for further ones until none is
new. A layer seen before for the same place is not opened again, which ends cycles. Every character of a layer
knows the span of the original text it came from, so all findings are told as spans of the original. Escapes are decoded over
the whole layer, so plain parts between them stay in their places. Base64 is decoded at all four alignments, over line ends, and
what it gives may hold any bytes; a byte stands as the character of its number.

The work stays in proportion to the text and what it unpacks to, in bounded memory: escapes nested deeper than ``PASSES`` are opened
to their end at once, and compressed streams are searched in windows of ``WINDOW`` bytes.

Edge cases: NULL and empty texts have no spans. Rows are handled one by one, so repeated rows, ties and other columns play no part, and
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from stationflow.llm.common import on_texts

KINDS = ("assign", "access", "hex")
MASK = "[SECRET]"

# The patterns of the result's contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole or not at all, so its least length may stand in the pattern

NAMES = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: The same over line ends; a line's last characters may be few.
LINES64 = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{12,}|[A-Za-z0-9+/_-]+(?=\r?\n))(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}"
)
PACKED = re.compile(r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
WIDE = re.compile(r"(?:[\x09-\x7e]\x00){8,}[\x09-\x7e]?")  # UTF-16 of either order, as bytes
ESCAPED_PACKED = re.compile(r"%1f%8b|(?:x|%78)(?:%01|%5e|\^|%9c|%da)", re.IGNORECASE)
#: What decoded bytes must hold for a finding or a further layer.
WORTH = re.compile(
    rb"passw|secret|token|api_?key|AKIA|[0-9a-f]{24}|%[0-9a-f]{2}|\\[ux]|[a-z0-9+/_-]{12}|[a-z0-9+/_-]\r?\n[ \t]*[a-z0-9+/_-]"
    rb"|\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|(?:[\x09-\x7e]\x00){8}",
    re.IGNORECASE,
)
ESCAPED_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED_UNITS = re.compile(r"(?:\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}))+")

#: Layers of escapes opened one by one; what is nested deeper is opened to its end at once, so that the work stays in proportion.
PASSES = 4
#: Bytes of a stream fed at a time, and the most it gives at a time.
STEP, PIECE = 1 << 15, 1 << 20
#: Decoded bytes of a stream that are held and searched at a time, and how far two such windows overlap. An encoded part of a longer
#: stream that is longer than the overlap and lies over a window's edge is opened in two parts.
WINDOW, OVERLAP = 8 << 20, 1 << 20
#: Decoded characters below which a stream can't hold a finding.
LEAST = 12

_BASE64_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_IN_BASE64 = bytes(99 if b in _BASE64_BYTES else b if b in b"\r\n" else 46 for b in range(256))
_IN_WIDE = bytes(0 if b == 0 else 99 if 9 <= b <= 126 else 46 for b in range(256))
_HEXADECIMAL = frozenset("0123456789abcdefABCDEF")

#: Where the characters of a layer come from: starts and ends, one span for all of them alike, or None for the same places.
Places = np.ndarray | tuple[int, int] | None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, leftmost and non-overlapping per kind, in order."""
    found = []
    if NAMES.search(text):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _utf8_runs(raw: bytes) -> list[tuple[str, int, int]]:
    """Characters of ``raw`` with their byte ranges; a byte that is not part of one stands for itself."""
    out, at = [], 0
    while at < len(raw):
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 1
        try:
            char = raw[at : at + size].decode()
        except UnicodeDecodeError:
            char, size = chr(lead), 1
        out.append((char, at, min(at + size, len(raw))))
        at += size
    return out


def _unescape(text: str, runs: re.Pattern, units) -> tuple[str, np.ndarray]:
    """The text with its escapes decoded, and the starts and ends of each character."""
    parts, places, at = [], [np.zeros((2, 0), np.int64)], 0
    for run in [*runs.finditer(text), None]:
        start = run.start() if run else len(text)
        parts.append(text[at:start])
        places.append(np.arange(at, start) + [[0], [1]])
        if run:
            decoded = units(run.group())
            parts += [char for char, _, _ in decoded]
            places.append(np.array([[start + a for _, a, _ in decoded], [start + b for _, _, b in decoded]], np.int64))
            at = run.end()
    return "".join(parts), np.concatenate(places, axis=1)


def _url_units(run: str):
    return [(c, 3 * a, 3 * b) for c, a, b in _utf8_runs(binascii.unhexlify(run.replace("%", "")))]


def _unicode_units(run: str):
    units = [(int(m.group(1) or m.group(2), 16), *m.span()) for m in re.finditer(r"\\(?:u(.{4})|x(.{2}))", run)]
    out = []
    for code, a, b in units:
        if out and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, start, _ = out.pop()
            out.append((chr(0x10000 + (ord(high) - 0xD800) * 1024 + code - 0xDC00), start, b))
        else:
            out.append((chr(code), a, b))
    return out


def _escape_size(chars: list) -> int:
    """Length of the escape that the characters end with, 0 if none. Decoded bytes are numbers among them."""
    if chars[-1] not in _HEXADECIMAL or len(chars) < 3 or chars[-2] not in _HEXADECIMAL:
        return 0
    if chars[-3] == "%":
        return 3
    if len(chars) >= 4 and chars[-3] == "x" and chars[-4] == "\\":
        return 4
    if len(chars) >= 6 and chars[-5] == "u" and chars[-6] == "\\" and all(c in _HEXADECIMAL for c in chars[-4:-2]):
        return 6
    return 0


def _fully_unescaped(text: str) -> tuple[str, np.ndarray]:
    """The text with URL and Unicode escapes decoded until none is left, however deep they are nested, in one pass: whatever a
    decoded character completes is decoded at once. With the starts and ends of each character."""
    chars, starts, ends = [], [], []
    for at, char in enumerate(text):
        chars.append(char)
        starts.append(at)
        ends.append(at + 1)
        while chars[-1] in _HEXADECIMAL and (size := _escape_size(chars)):
            code = int("".join(chars[-(4 if size == 6 else 2) :]), 16)
            first, last = starts[-size], ends[-1]
            del chars[-size:], starts[-size:], ends[-size:]
            chars.append(code if size == 3 and code > 127 else chr(code))
            starts.append(first)
            ends.append(last)
    out, places, at = [], [], 0
    while at < len(chars):
        upto = at
        while upto < len(chars) and isinstance(chars[upto], int):
            upto += 1
        if upto > at:  # a run of bytes beyond ASCII
            for char, a, b in _utf8_runs(bytes(chars[at:upto])):
                out.append(char)
                places.append((starts[at + a], ends[at + b - 1]))
            at = upto
            continue
        char = chars[at]
        if out and "\udc00" <= char < "\ue000" and "\ud800" <= out[-1] < "\udc00":
            out[-1] = chr(0x10000 + (ord(out[-1]) - 0xD800) * 1024 + ord(char) - 0xDC00)
            places[-1] = (places[-1][0], ends[at])
        else:
            out.append(char)
            places.append((starts[at], ends[at]))
        at += 1
    return "".join(out), np.array(places, np.int32).reshape(-1, 2).T


def _byte_units(run: str):
    return [(chr(c), 3 * i, 3 * i + 3) for i, c in enumerate(binascii.unhexlify(run.replace("%", "")))]


def _readable(raw: bytes) -> str | None:
    """The text that bytes hold; None if they hold none."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\t\r\n" for c in text) else None


def _bytes_of(body: str) -> bytes:
    """The bytes of base64 characters of either alphabet, without a last one that completes none."""
    body = body.replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _inflate(raw: memoryview, at: int):
    """Decoded pieces of the zlib or gzip stream at ``at``; returns where it ends: behind its last byte, at the byte at which it is
    damaged, or with the bytes."""
    stream = zlib.decompressobj(47)  # 47: either header
    while at < len(raw) and not stream.eof:
        fed, before, told = raw[at : at + STEP], stream.copy(), 0
        try:
            rest = fed
            while len(rest) and not stream.eof:
                out = stream.decompress(rest, PIECE)
                told += len(out)
                yield out
                rest = stream.unconsumed_tail
            at += len(fed) - len(stream.unused_data)
        except zlib.error:
            for i in range(len(fed)):  # what the bytes before the damage give
                try:
                    out = before.decompress(fed[i : i + 1])
                except zlib.error:
                    return at + i
                yield out[told:]
                told = max(0, told - len(out))
            return at + len(fed)
    return at


def _end_and_size(raw: memoryview, at: int) -> tuple[int, int]:
    pieces, size = _inflate(raw, at), 0
    while True:
        try:
            size += len(next(pieces))
        except StopIteration as done:
            return done.value, size


def _windows(pieces, size: int):
    """The decoded bytes in windows that overlap; those of a long stream only where anything could be found in them."""
    held = b""
    for piece in pieces:
        held += piece
        if len(held) >= WINDOW:
            if _promising(held):
                yield held
            held = held[-OVERLAP:]
    if size < WINDOW or _promising(held):
        yield held


def _promising(window: bytes) -> bool:
    """Whether a window can hold a finding or anything encoded; tells only windows away that hold neither."""
    low, runs = window.lower(), window.translate(_IN_BASE64)
    marks = (b"passw", b"secret", b"token", b"key", b"akia", b"%", b"\\", b"\x1f\x8b\x08", b"x\x01", b"x^", b"x\x9c", b"x\xda")
    return (
        any(mark in low for mark in marks)
        or any(mark in runs for mark in (b"c" * 12, b"c\n", b"c\r\n"))
        or b"c\0" * 8 in window.translate(_IN_WIDE)
    )


def _unpacked(text: str):
    """(start, end, decoded, None) of zlib and gzip streams among characters that stand for bytes; a long stream in windows."""
    raw = memoryview(text.encode("latin-1", "replace"))
    for m in PACKED.finditer(text):
        start = m.start()
        try:  # what is damaged before it gave enough is most often no stream at all
            zlib.decompressobj(47).decompress(raw[start : start + 512], LEAST)
        except zlib.error:
            continue
        end, size = _end_and_size(raw, start)
        if size >= LEAST:
            for window in _windows(_inflate(raw, start), size):
                yield start, end, window.decode("latin-1"), None


def _base64_layers(text: str):
    clean = set()
    for m in BASE64.finditer(text):
        body = m.group().rstrip("=")
        if len(body) % 4 != 1 and (decoded := _readable(_bytes_of(body))):
            clean.add(m.span())
            yield (*m.span(), decoded, None)
    for m in LINES64.finditer(text):
        run = m.group().rstrip("=")
        body = "".join(run.split()) if "\n" in run else run
        if len(body) < 12:
            continue
        at = None
        for skip in range(4):
            raw = _bytes_of(body[skip:])
            if not WORTH.search(raw) or (skip == 0 and m.span() in clean):
                continue
            if at is None:
                at = np.array([i for i, c in enumerate(run) if not c.isspace()]) if len(body) < len(run) else np.arange(len(run))
            bits = 8 * np.arange(len(raw))
            places = np.stack([at[skip + bits // 6], at[skip + (bits + 7) // 6] + 1])
            places[1, -1] = m.end() - m.start()
            yield (*m.span(), raw.decode("latin-1"), places)


def _inner(text: str, depth: int):
    """(start, end, decoded, places in the region or None for all of it alike) of whatever in the text looks encoded, ``depth``
    layers down."""
    escapes = ((("%",), ESCAPED_BYTES, _url_units), (("\\u", "\\x"), ESCAPED_UNITS, _unicode_units))
    found = [(runs, units) for marks, runs, units in escapes if any(mark in text for mark in marks) and runs.search(text)]
    if found and depth >= PASSES:
        yield (0, len(text), *_fully_unescaped(text))
    elif found:
        for runs, units in found:
            yield (0, len(text), *_unescape(text, runs, units))
    if "%" in text and ESCAPED_PACKED.search(text):
        yield (0, len(text), *_unescape(text, ESCAPED_BYTES, _byte_units))
    if PACKED.search(text):
        yield from _unpacked(text)
    if "\x00" in text:
        for m in WIDE.finditer(text):
            wide, at = m.group()[::2], 2 * np.arange(len(m.group()[::2]))
            yield (*m.span(), wide, np.stack([at, np.minimum(at + 2, len(m.group()))]))
    yield from _base64_layers(text)


def _origin(places: Places, a: int, b: int) -> tuple[int, int]:
    if places is None:
        return a, b
    return places if isinstance(places, tuple) else (int(places[0, a]), int(places[1, b - 1]))


def layers(text: str):
    """All decoded layers with the places of their characters in the text. A layer is followed to its end before the next one
    is made, so only those that lie within each other are held."""
    open_layers, seen = [(text, None, _inner(text, 0))], set()
    while open_layers:
        layer, places, inner = open_layers[-1]
        found = next(inner, None)
        if found is None:
            open_layers.pop()
            continue
        start, end, decoded, inside = found
        span = _origin(places, start, end)
        mark = (span, xxhash.xxh128_digest(decoded.encode("utf-8", "surrogatepass")))
        if not decoded or decoded == layer[start:end] or mark in seen:
            continue
        seen.add(mark)
        mapped: Places = span
        if inside is not None and not isinstance(places, tuple):
            inside = inside.astype(np.int32) + start
            mapped = inside if places is None else np.stack([places[0, inside[0]], places[1, inside[1] - 1]])
        yield decoded, mapped
        open_layers.append((decoded, mapped, _inner(decoded, len(open_layers))))


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """Base spans of the text and of all its layers, as spans of the text."""
    found = base_spans(text)
    for layer, places in layers(text):
        found += [(*_origin(places, start, end), kind) for start, end, kind in base_spans(layer)]
    return in_order(found)


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _row(text: str) -> dict:
    base = base_spans(text)
    kinds = [kind for _, _, kind in base]
    counts = {f"n_{k}": kinds.count(k) for k in KINDS}
    return {**counts, "base": written(base), "spans": written(spans_of(text))}


def redacted(text: str) -> str:
    """The text with every span, overlapping ones as one, replaced by ``MASK``."""
    out, end = [], 0
    for a, b, _ in [*spans_of(text), (len(text), len(text), "")]:
        if a >= end:
            out += [MASK] * (end > 0) + [text[end:a]]
        end = max(end, b)
    return "".join(out)


def scan(text: Column) -> Column:
    """Struct of n_assign, n_access, n_hex (base spans), base and spans (kind:start:end in order, comma-joined). NULL
    and empty texts have none."""
    kind = pa.struct([*[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("spans", pa.string())])
    return on_texts(_row, kind, "n_assign long, n_access long, n_hex long, base string, spans string")(text)


def redact(text: Column) -> Column:
    """The text without its secrets; NULL stays NULL."""
    return F.when(text.isNotNull(), on_texts(redacted, pa.string(), "string")(text))
