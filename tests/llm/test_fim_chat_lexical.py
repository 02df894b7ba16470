import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.llm import chat, fim, lexical

SIGNS = ["a", "é", "€", "\U0001f600", " ", "\n", "\0"]


def random_text(rng, most):
    return "".join(rng.choice(SIGNS) for _ in range(rng.randrange(most + 1)))


# -- fill in the middle ---------------------------------------------------------------------------------


@pytest.mark.parametrize("span", [8, 64, 1 << 20])
def test_places_in_bytes(span, monkeypatch):
    monkeypatch.setattr(fim, "SPAN", span)
    rng = random.Random(span)
    for n_texts in (0, 1, 2, 7, 60):
        texts = [random_text(rng, 40) for _ in range(n_texts)]
        raw = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        h1, h2 = (np.array([rng.randrange(2**32) for _ in texts], np.int64) for _ in "ab")
        got = fim.cut_places(np.frombuffer(b"".join(raw), np.uint8), offsets, h1, h2)
        for i, text in enumerate(texts):
            a, b = sorted((int(h1[i]) % (len(text) + 1), int(h2[i]) % (len(text) + 1)))
            assert got[:, i].tolist() == [len(text), a, b, len(text[:a].encode()), len(text[:b].encode())]


def by_hand(doc_id, text, p="<P>", s="<S>", m="<M>", percent=90, spm=20, seed="1"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(x in text for x in (p, s, m)) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "spm" if h[3] % 100 < spm else "psm"
    parts = (p, text[:a], s, text[b:], m, text[a:b]) if form == "psm" else (s, text[b:], p, text[:a], m, text[a:b])
    return n, form, a, b - a, "".join(parts)


def test_rearranged_texts(spark, documents, odd):
    rng = random.Random(3)
    made = spark.createDataFrame([(i, random_text(rng, 30) + rng.choice(["", "", "<M>", "<"])) for i in range(400)], "doc_id long, text string")
    for frame in (documents, odd, made, odd.limit(0)):
        out = fim.transformed(frame)
        assert set(frame.columns) <= set(out.columns)
        rows = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_hand(r["doc_id"], r["text"])
            assert r["back"] == (r["text"] or "")
    forms = Counter(r["form"] for r in fim.transformed(made).collect())
    assert forms["psm"] > forms["spm"] > 10 and forms["plain"] > 100


def test_other_sentinels(spark):
    marks = fim.Sentinels("[[p]]", "[[s]]", "\\E.*")
    frame = spark.createDataFrame([(i, f"x{i} . " * i) for i in range(60)], "doc_id long, text string")
    out = fim.transformed(frame, percent=100, spm_percent=50, seed="z", sentinels=marks)
    rows = out.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    for r in rows:
        assert r["output"] == by_hand(r["doc_id"], r["text"], "[[p]]", "[[s]]", "\\E.*", 100, 50, "z")[-1] and r["back"] == r["text"]
    for wrong in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "x<P>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Sentinels(*wrong)


# -- chat -----------------------------------------------------------------------------------------------


def test_escaping_leaves_no_control_string_and_comes_back():
    rng = random.Random(5)
    bits = ["<", "[", "\\", "|", "end", "|end|>", "/s>", "INST]", "/INST]", "SYS>", "x", "\n", "<|role|>", "<|text|>", "</s>", "é", ">"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(mark in safe for mark in ("<|role|>", "<|text|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]"))
        assert chat.parts_of_segment(chat.segment_of(text, [{"kind": "text", "text": text}])["segment"]) == (
            text,
            [{"kind": "text", "text": text}] if text else [],
        )
    assert chat.escape("plain < [ text \\ ") == "plain < [ text \\ "


def part(kind, text=None, uri=None, width=None, height=None, seconds=None, pages=None):
    return {"kind": kind, "text": text, "uri": uri, "width": width, "height": height, "seconds": seconds, "pages": pages}


def test_parts_become_placeholders_with_attachments(spark):
    parts = [
        part("text", "see <|image|> "), part("image", uri="a.png", width=57, height=28), part("audio", uri="b.wav", seconds=1.01),
        part("text", "and"), part("document", uri="c.pdf", pages=3), part("video", uri="d"), part(None, "tail"), part(None), None,
    ]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part("text", "ok"), part("image")]), (1, None, None, None), (None, 2, "assistant", [])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}")
    frame = frame.withColumns({"segment": F.lit(1), "learnt": F.lit(2), "attachments": F.lit(3)})
    made = {(r["conv_id"], r["turn"]): r for r in chat.formatted(frame, F.col("parts")).collect()}
    first = made[1, 0]
    found = [(a["kind"], a["uri"], a["tokens"]) for a in first["attachments"]]
    assert found == [("image", "a.png", 3), ("audio", "b.wav", 26), ("document", "c.pdf", 768), ("video", "d", 0), (None, None, 0)]
    assert first["expanded_tokens"] == 3 + 26 + 768
    for a, mark in zip(first["attachments"], ("image", "audio", "document", "file", "file")):
        assert first["segment"][a["start"] :].startswith(f"<|{mark}|>")
    role, back = chat.parts_of_segment(first["segment"], [a.asDict() for a in first["attachments"]])
    assert role == "user" and [p.get("text", p.get("uri")) for p in back] == ["see <|image|> ", "a.png", "b.wav", "and", "c.pdf", "d", "tail", None]
    assert made[1, None]["segment"] == "<|role|><|text|><|end|>" and not made[1, None]["learnt"]
    told = {r["conv_id"]: r for r in chat.read_back(chat.formatted(frame, F.col("parts"))).collect()}
    assert told[1]["n_turns"] == 3 and told[1]["loss_chars"] == 2 and told[None]["n_turns"] == 1
    assert chat.read_back(chat.formatted(frame.limit(0), F.col("parts"))).count() == 0


def test_conversations_come_back_over_many_batches(spark):
    rng = random.Random(8)
    rows = [
        (c, t, rng.choice(["user", "assistant", None, "a\n</s>"]), rng.choice([None, "", "[INST] x", "é<\\|end|>", random_text(rng, 50)]))
        for c in [None, *range(30)]
        for t in rng.sample(range(900), 900 if c == 7 else rng.randrange(1, 9))
    ]
    rows += rows[:5]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    told = chat.read_back(chat.formatted(frame.repartition(7), chat.text_parts(F.col("text")))).collect()
    assert len(told) == 31
    for r in told:
        mine = sorted((t, chat.segment_of(role or "", [part("text", text)])["segment"], role or "", text or "") for c, t, role, text in rows if c == r["conv_id"])
        learnt = "".join(x[3] for x in mine if x[2] == "assistant")
        assert r["n_turns"] == len(mine) and r["formatted_chars"] == sum(len(x[1]) for x in mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


# -- ranked search --------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def searched_by_hand(docs, items, k):
    found = [(d, Counter(terms_of(text))) for d, text in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for d, c in found:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            scores.append((-score, d is None, d or 0, d))
        best = [s for s in sorted(scores) if s[0] < 0][:k]
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(best, 1)]
    return out


def as_rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_like_brute_force(spark, documents, odd, monkeypatch, small):
    if small:  # many blocks of items, scores a few documents at a time
        monkeypatch.setattr(lexical, "BLOCK_BYTES", 200)
        monkeypatch.setattr(lexical, "TRIPLES", 50)
        monkeypatch.setattr(lexical, "CELLS", 8)
    items = [(1, "The same short TEXT"), (2, "word"), (2, "of that 42"), (3, None), (4, ""), (None, "Straße ǅ É"), (5, "nowhere-at-all"), (6, "gamma gamma")]
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit(1), "doc_id": F.lit(2)})
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert as_rows(lexical.ranked(odd.repartition(3), wanted, 3)) == sorted(searched_by_hand(docs, items, 3), key=str)
    assert as_rows(lexical.ranked(odd, wanted.limit(0))) == [] and as_rows(lexical.ranked(odd.limit(0), wanted)) == []
    if not small:
        some = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
        queries = [(f"q{i}", text[:300]) for i, text in some[:20]]
        frame = spark.createDataFrame(queries, "item_id string, text string")
        assert as_rows(lexical.ranked(documents, frame, 7)) == sorted(searched_by_hand(some, queries, 7), key=str)


def test_matches_are_whole_terms():
    made = lexical.automaton(["a", "ab", "b2", "é", "aé"])
    found = Counter(made.get(lexical.guarded(t.encode())) for t in ["a", "ab", "b2", "é", "aé"])
    assert sorted(found) == [0, 1, 2, 3, 4]
    text = "A ab_ab a-a b2 b é aé É xé"
    assert Counter(v for _, v in made.iter(lexical.guarded(text.encode()))) == {0: 3, 1: 2, 2: 1, 3: 1, 4: 1}
