"""The secret scan on texts made to cost time or memory, and its short cuts against the plain form."""

import base64
import gzip
import random
import resource
import time
import zlib

import pytest

from stationflow.llm import secrets

SECRET = "password=hunter2secret"


def timed(text):
    start = time.process_time()
    return secrets.spans_of(text), time.process_time() - start


@pytest.mark.parametrize(
    "text",
    [
        "%" + "25" * 500_000,
        "\\u005c" + "u005c" * 200_000,
        "x^2 + " * 170_000,
        "x\x9c" * 250_000,
        "%2525" * 200_000,
        "a" * 1_000_000,
        "%61%3d" * 160_000,
        "secret " * 140_000,
        ("QUJD" * 30 + "\n") * 8_000,
    ],
    ids=["percent", "unicode", "formulas", "headers", "twice", "one run", "escapes", "names", "base64 lines"],
)
def test_a_megabyte_takes_seconds(text):
    _, took = timed(text)
    assert took < 15


def test_deep_nesting_is_opened_to_its_end():
    for depth in (1, 3, secrets.PASSES, secrets.PASSES + 1, 40, 3000):
        text = "see %" + "25" * (depth - 1) + "70assword=" + "hunter2x now"
        assert (4, len(text) - 4, "assign") in secrets.spans_of(text)
    nested = SECRET
    for _ in range(9):
        nested = base64.b64encode(nested.encode()).decode()
    assert secrets.spans_of(f"say {nested} .")[0] == (4, 4 + len(nested), "assign")


def test_a_layer_of_many_megabytes_is_searched_in_little_memory():
    body = b"\0" * (150 << 20) + SECRET.encode() + b"\n" * (150 << 20) + b"AKIA" + b"Q" * 20
    packed = base64.b64encode(zlib.compress(body, 9)).decode()
    del body
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found, took = timed(f"key {packed} end")
    assert {kind for _, _, kind in found} == {"assign", "access"} and took < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10


def wrap(rng, text):
    way = rng.randrange(6)
    if way == 0:
        return "".join(f"%{b:02x}" if rng.random() < 0.7 else chr(b) for b in text.encode() if b < 128)
    if way == 1:
        return "".join(f"\\u{ord(c):04x}" if rng.random() < 0.7 else c for c in text if ord(c) < 0x10000)
    if way == 2:
        return base64.b64encode(text.encode()).decode()
    if way == 3:
        return base64.b64encode(rng.choice([zlib.compress, gzip.compress])(text.encode())).decode()
    if way == 4:
        return text.replace("%", "%25").replace("=", "%3D")
    return f"{rng.choice(['', 'é ', 'x^2 '])}{text}{rng.choice(['', ' .', '%', 'x\x9c'])}"


def test_short_cuts_find_what_the_plain_form_finds(monkeypatch):
    rng = random.Random(12)
    for _ in range(120):
        text = rng.choice([SECRET, "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "token: é%41bcdef1"])
        for _ in range(rng.randrange(1, 8)):
            text = wrap(rng, text)
            if len(text) > 4000:
                break
        short = secrets.spans_of(text)
        with monkeypatch.context() as patch:
            patch.setattr(secrets, "PASSES", 1000)
            plain = secrets.spans_of(text)
        assert set(short) <= set(plain)
        # what is missing lies within, or around, what the deepest layer shows of the same kind
        for a, b, kind in set(plain) - set(short):
            assert any(k == kind and c < b and a < d for c, d, k in short)
        with monkeypatch.context() as patch:
            patch.setattr(secrets, "WINDOW", 64)
            patch.setattr(secrets, "OVERLAP", 48)
            patch.setattr(secrets, "PIECE", 16)
            patch.setattr(secrets, "STEP", 8)
            assert set(secrets.base_spans(text)) <= set(secrets.spans_of(text))


def test_damaged_streams_give_what_comes_before_the_damage():
    packed = bytearray(zlib.compress(b"filler words " * 20 + SECRET.encode() + bytes(range(256)) * 20))
    for cut in (len(packed) - 3, len(packed) // 2 + 40):
        text = "go " + packed[:cut].decode("latin-1")
        assert ("assign" in {k for *_, k in secrets.spans_of(text)}) == (SECRET.encode() in zlib.decompressobj().decompress(bytes(packed[:cut])))
    packed[-40:] = b"\xff" * 40
    whole = "go " + packed.decode("latin-1") + " and more plain words after it"
    (span,) = [s for s in secrets.spans_of(whole) if s[2] == "assign"]
    assert span[0] == 3 and span[1] <= len(whole)
