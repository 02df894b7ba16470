"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A step's input is a word's own embedding, if the word is common among the labelled texts, beside the mean of the
embeddings of its hashed character trigrams, so words that were never seen are read by their letters. Forward and
backward states are pooled with learnt attention weights over a window of words. A text is scored in overlapping
windows that cover all of it, and its score is that of its worst window, mapped to a chance by a logistic curve fitted to
labelled documents that took no part in the training.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import labelled_sample, on_batches, remainder

FOLDS = 3
HELD_OUT = 1
TOXIC = 0.7
#: Labelled rows per class, and windows of each, that training may use at most.
PER_CLASS = 2_000
TRAIN_WINDOWS = 8
#: One labelled document in so many is kept for the logistic curve, with up to so many windows.
CURVE_EVERY = 4
CURVE_WINDOWS = 48

WINDOW = 48
STRIDE = 40
#: A word has an embedding of its own if so many of the training documents hold it.
COMMON = 5
GRAM_BITS = 13
WORD_DIMS, GRAM_DIMS, UNITS, ATTENTION = 8, 8, 8, 8
#: Share of words whose own, and of words whose trigram embedding is blanked in a training step.
BLANK_WORDS, BLANK_GRAMS = 0.1, 0.3
#: How far the log odds set the first number of an embedding.
LEAN = 0.3
#: Pull of the embeddings to zero, and their first spread.
DECAY, SPREAD = 1e-5, 0.1
WORD = re.compile(r"\w+")
#: Words whose gate inputs one Python worker remembers; beyond, it starts anew.
REMEMBERED_WORDS = 300_000
#: Windows that go through the network at a time.
BLOCK = 1_024


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping ranges that cover n words; none for no words."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = [min(s, n - WINDOW) for s in range(0, n - WINDOW + STRIDE, STRIDE)]
    return [(s, s + WINDOW) for s in starts]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the byte trigrams of all words, ends marked, and where each word's begin."""
    marked = [f"^{w}$".encode("utf-8", "surrogatepass") for w in words]
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(size)
    inside = np.ones(raw.size, bool)
    inside[ends - 1] = inside[ends - 2] = False
    code = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    rows = (code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    return rows[inside[:-2]].astype(np.int64), np.concatenate([[0], np.cumsum(size - 2)[:-1]])


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


@dataclass
class Network:
    """Weights by name. Gates stand in the order update, reset, candidate; one set per direction."""

    w: dict[str, np.ndarray]
    rows: dict[str, int]  # of the common words; 0 is any other
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None  # every text's score if there was nothing to learn from
    history: list[float] = field(default_factory=list)

    @staticmethod
    def fresh(common: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        inputs, w = WORD_DIMS + GRAM_DIMS, {}
        w["word"], w["gram"] = draw(len(common) + 1, WORD_DIMS, scale=SPREAD), draw(1 << GRAM_BITS, GRAM_DIMS, scale=SPREAD)
        w["word"][0] = 0.0
        for d in "fb":
            w[f"W{d}"] = draw(inputs, 3 * UNITS, scale=inputs**-0.5)
            w[f"U{d}"] = draw(UNITS, 3 * UNITS, scale=UNITS**-0.5)
            w[f"b{d}"] = np.zeros(3 * UNITS, np.float32)
        w["A"], w["a"] = draw(2 * UNITS, ATTENTION, scale=0.2), draw(ATTENTION, scale=0.2)
        w["o"], w["c"] = draw(2 * UNITS, scale=0.2), np.zeros(1, np.float32)
        return Network(w, {word: i for i, word in enumerate(common, 1)})

    def embed(self, words: list[str]) -> np.ndarray:
        """Step inputs of words."""
        if not words:
            return np.zeros((0, WORD_DIMS + GRAM_DIMS), np.float32)
        flat, starts = trigrams(words)
        size = np.diff(starts, append=flat.size)[:, None]
        grams = np.add.reduceat(self.w["gram"][flat], starts, axis=0) / size
        own = self.w["word"][[self.rows.get(w, 0) for w in words]]
        return np.concatenate([own, grams], axis=1).astype(np.float32)

    def gates(self, inputs: np.ndarray, direction: str) -> np.ndarray:
        return inputs @ self.w[f"W{direction}"] + self.w[f"b{direction}"]

    def recur(self, gates_at, mask: np.ndarray, direction: str, keep: list | None = None) -> np.ndarray:
        """States (window, step, unit). ``gates_at(t)`` gives the input side of the gates; masked steps pass the state on."""
        n, steps = mask.shape
        U, h = self.w[f"U{direction}"], np.zeros((n, UNITS), np.float32)
        out = np.zeros((n, steps, UNITS), np.float32)
        for t in range(steps) if direction == "f" else range(steps - 1, -1, -1):
            x = gates_at(t)
            rec = h @ U[:, : 2 * UNITS]
            zr = _sigmoid(x[:, : 2 * UNITS] + rec)
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            cand = np.tanh(x[:, 2 * UNITS :] + (r * h) @ U[:, 2 * UNITS :])
            m = mask[:, t : t + 1]
            if keep is not None:
                keep.append((t, h, z, r, cand, m))
            h = h + m * z * (cand - h)
            out[:, t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray):
        hidden = np.tanh(states @ self.w["A"])
        energy = np.where(mask > 0, hidden @ self.w["a"], -1e9)
        energy = np.exp(energy - energy.max(axis=1, keepdims=True)) * mask
        weight = energy / np.maximum(energy.sum(axis=1, keepdims=True), 1e-9)
        context = (weight[:, :, None] * states).sum(axis=1)
        return hidden, weight, context, context @ self.w["o"] + self.w["c"][0]

    def table(self, words: list[str]) -> np.ndarray:
        """Gate inputs of words, forward beside backward; they do not depend on where a word stands."""
        inputs = self.embed(words)
        return np.concatenate([self.gates(inputs, "f"), self.gates(inputs, "b")], axis=1)

    def logits(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows given as rows of a table of gate inputs (forward gates beside backward ones)."""
        half = 3 * UNITS
        forward = self.recur(lambda t: table[index[:, t], :half], mask, "f")
        backward = self.recur(lambda t: table[index[:, t], half:], mask, "b")
        return self.pool(np.concatenate([forward, backward], axis=2), mask)[3]

    def chance(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * np.asarray(logit, float) + self.shift)

    # -- training -----------------------------------------------------------------------------------

    def gradients(self, inputs: np.ndarray, mask: np.ndarray, y: np.ndarray, toxic_weight: float = 1.0):
        """Loss with toxic windows weighted, gradients of the dense weights and of the step inputs, by back-propagation through time."""
        n, w, g = len(y), self.w, {}
        kept: dict[str, list] = {"f": [], "b": []}
        flat = inputs.reshape(-1, inputs.shape[2])
        gates = {d: self.gates(flat, d).reshape(n, mask.shape[1], -1) for d in "fb"}
        states = np.concatenate([self.recur(lambda t, d=d: gates[d][:, t], mask, d, kept[d]) for d in "fb"], axis=2)
        hidden, weight, context, logit = self.pool(states, mask)
        p = _sigmoid(logit)
        share = np.where(y > 0, toxic_weight, 1.0) / n
        loss = float(-(share * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum())
        d_logit = (share * (p - y)).astype(np.float32)
        g["o"], g["c"] = context.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_context = d_logit[:, None] * w["o"]
        d_states = weight[:, :, None] * d_context[:, None, :]
        d_weight = (states * d_context[:, None, :]).sum(axis=2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["a"] = np.tensordot(d_energy, hidden, ([0, 1], [0, 1]))
        d_hidden = d_energy[:, :, None] * w["a"] * (1 - hidden**2)
        g["A"] = np.tensordot(states, d_hidden, ([0, 1], [0, 1]))
        d_states = d_states + d_hidden @ w["A"].T
        d_inputs = np.zeros_like(flat)
        for d, part in (("f", slice(0, UNITS)), ("b", slice(UNITS, None))):
            U, dU = w[f"U{d}"], np.zeros_like(w[f"U{d}"])
            d_gates, d_h = np.zeros_like(gates[d]), np.zeros((n, UNITS), np.float32)
            for t, h, z, r, cand, m in reversed(kept[d]):
                d_h = d_h + d_states[:, t, part]
                d_cand = d_h * m * z * (1 - cand**2)
                d_z = d_h * m * (cand - h) * z * (1 - z)
                d_rh = d_cand @ U[:, 2 * UNITS :].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                dU[:, : 2 * UNITS] += h.T @ d_zr
                dU[:, 2 * UNITS :] += (r * h).T @ d_cand
                d_gates[:, t] = np.concatenate([d_zr, d_cand], axis=1)
                d_h = d_h * (1 - m * z) + d_rh * r + d_zr @ U[:, : 2 * UNITS].T
            d_flat = d_gates.reshape(-1, 3 * UNITS)
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = dU, flat.T @ d_flat, d_flat.sum(axis=0)
            d_inputs += d_flat @ w[f"W{d}"].T
        return loss, g, d_inputs


class Adam:
    def __init__(self, rate: float = 0.01):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, weights: dict, gradients: dict) -> None:
        self.t += 1
        for k, g in gradients.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            weights[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _padded(windows_: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    index = np.zeros((len(windows_), WINDOW), np.int64)
    mask = np.zeros((len(windows_), WINDOW), np.float32)
    for i, ws in enumerate(windows_):
        index[i, : len(ws)], mask[i, : len(ws)] = ws, 1.0
    return index, mask


def fit(docs: list[list[list[str]]], labels: list[int], curve: list[bool], epochs: int = 6, batch: int = 96, steps: int = 400, seed: int = 7) -> Network:
    """Train on documents given as windows of words; those marked ``curve`` only set the logistic curve.

    All windows first take their document's label. Since a toxic document may have harmless windows, the second half of the
    epochs takes of each toxic document only the half of its windows that score worst. Documents without words tell
    nothing. With one class only, its share is every text's score.
    """
    docs, labels, curve = zip(*[x for x in zip(docs, labels, curve) if x[0]]) if any(docs) else ((), (), ())
    curve = np.array(curve, bool)
    if len({y for y, c in zip(labels, curve) if not c}) < 2:
        return Network({}, {}, constant=float(labels[0]) if labels else 0.0)
    holders = Counter(w for d, c in zip(docs, curve) if not c for w in {w for part in d for w in part})
    net, rng = Network.fresh(sorted(w for w, n in holders.items() if n >= COMMON), seed), np.random.default_rng(seed)
    vocabulary = sorted({w for d in docs for part in d for w in part})
    place = {w: i for i, w in enumerate(vocabulary)}
    index, mask = _padded([[place[x] for x in w] for d in docs for w in d])
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat, starts = trigrams(vocabulary)
    size = np.diff(starts, append=flat.size)
    own = np.array([net.rows.get(w, 0) for w in vocabulary])
    _lean(net, docs, labels, curve, place, own, flat, starts)
    y_doc = np.array(labels)
    y, adam = y_doc[owner].astype(np.float32), Adam()
    chosen = np.flatnonzero(~curve[owner])

    def all_logits() -> np.ndarray:
        table = net.table(vocabulary)
        parts = range(0, len(owner), BLOCK)
        return np.concatenate([net.logits(table, index[i : i + BLOCK], mask[i : i + BLOCK]) for i in parts])

    epochs = max(epochs, -(-steps * batch // max(len(chosen), 1)))  # few windows are gone through more often
    for epoch in range(epochs):
        if epoch == epochs // 2:
            logit = all_logits()
            order = np.lexsort((-logit, owner))
            rank = np.empty(len(owner), np.int64)
            rank[order] = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
            chosen = np.flatnonzero(~curve[owner] & ((y == 0) | (2 * rank < np.bincount(owner)[owner])))
        weight = (y[chosen] == 0).sum() / max((y[chosen] == 1).sum(), 1)  # both classes weigh alike
        losses = []
        for at in np.array_split(rng.permutation(chosen), -(-len(chosen) // batch)):
            words, back = np.unique(index[at], return_inverse=True)
            n = size[words]
            grams = flat[np.repeat(starts[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            pieces = np.concatenate([[0], np.cumsum(n)[:-1]])
            mean = np.add.reduceat(net.w["gram"][grams], pieces, axis=0) / n[:, None]
            keep_word = (rng.random((len(words), 1)) >= BLANK_WORDS) & (own[words] > 0)[:, None]
            keep_gram = rng.random((len(words), 1)) >= BLANK_GRAMS
            inputs = np.concatenate([net.w["word"][own[words]] * keep_word, mean * keep_gram / (1 - BLANK_GRAMS)], axis=1)
            inputs = inputs.astype(np.float32)
            loss, grads, d_inputs = net.gradients(inputs[back.reshape(index[at].shape)], mask[at], y[at], weight)
            d_words = np.zeros_like(inputs)
            np.add.at(d_words, back.ravel(), d_inputs * mask[at].reshape(-1, 1))
            grads["word"], grads["gram"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["gram"])
            np.add.at(grads["word"], own[words], d_words[:, :WORD_DIMS] * keep_word)
            d_mean = d_words[:, WORD_DIMS:] * keep_gram / (1 - BLANK_GRAMS) / n[:, None]
            np.add.at(grads["gram"], grams, np.repeat(d_mean, n, axis=0))
            for name in ("word", "gram"):
                grads[name] += DECAY * net.w[name]
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            adam.step(net.w, {k: g * min(1.0, 1.0 / (norm + 1e-9)) for k, g in grads.items()})
            losses.append(loss)
        net.history.append(float(np.mean(losses)))
    worst = np.full(len(docs), -np.inf)
    np.maximum.at(worst, owner, all_logits())
    fitted = curve if len(set(y_doc[curve])) == 2 else np.ones_like(curve)
    _calibrate(net, worst[fitted], y_doc[fitted])
    return net


def _lean(net: Network, docs, labels, curve, place, own, flat, starts) -> None:
    """Start the first number of each embedding at the smoothed log odds of toxic among the documents that hold it, so that
    training begins from what single words and trigrams tell and a small labelled table does not have to find it anew."""
    held = {name: np.zeros((2, len(net.w[name]))) for name in ("word", "gram")}
    total, ends = np.zeros(2), np.append(starts[1:], flat.size)
    for parts, label, aside in zip(docs, labels, curve):
        if not aside:
            seen = np.array(sorted({place[w] for part in parts for w in part}))
            held["word"][label, np.unique(own[seen])] += 1
            held["gram"][label, np.unique(np.concatenate([flat[starts[i] : ends[i]] for i in seen]))] += 1
            total[label] += 1
    for name, counts in held.items():
        odds = np.log((counts + 1) / (total[:, None] + 2))
        net.w[name][:, 0] += (LEAN * (odds[1] - odds[0]) * (counts.sum(axis=0) > 0)).astype(np.float32)
    net.w["word"][0] = 0.0


def _calibrate(net: Network, logit: np.ndarray, y: np.ndarray) -> None:
    """Logistic curve from a document's worst logit to its chance, a little regularised, by Newton steps."""
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ b)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        b = b + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * b), -2, 2)
    net.slope, net.shift = max(float(b[0]), 1e-3), float(b[1])


def training_parts(text: str) -> tuple[bool, list[str]]:
    """Whether the text is one for the curve, and some of its windows, spread over all of it, as joined words."""
    words, curve = words_of(text), zlib.crc32(text.encode("utf-8", "surrogatepass")) % CURVE_EVERY == 0
    places = windows(len(words))
    picked = sorted(range(len(places)), key=lambda i: zlib.crc32(b"%d" % i))[: CURVE_WINDOWS if curve else TRAIN_WINDOWS]
    return curve, [" ".join(words[slice(*places[i])]) for i in sorted(picked)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            curve, parts = training_parts(text or "")
            columns = [pa.array([label], pa.int32()), pa.array([curve]), pa.array([parts], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "curve", "parts"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """Train on at most about ``per_class`` labelled rows of each class and ``TRAIN_WINDOWS`` windows of each; held-out ids never."""
    held_out = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    sample = labelled_sample(docs, labels, "toxic", held_out, per_class).select(F.col("label").cast("int"), "text")
    rows = sample.mapInArrow(_cut, "label int, curve boolean, parts array<string>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["label"], r["parts"]))  # the order of tasks must not matter
    docs = [[p.split(" ") for p in r["parts"]] for r in rows]
    return fit(docs, [r["label"] for r in rows], [r["curve"] for r in rows])


class Scorer:
    """Scores texts; remembers the gate inputs of words, which do not depend on where they stand."""

    def __init__(self, net: Network):
        self.net, self.place = net, {}
        self.table = np.zeros((0, 6 * UNITS), np.float32)

    def _places(self, lists: list[list[str]]) -> list[list[int]]:
        if len(self.place) > REMEMBERED_WORDS:
            self.place, self.table = {}, self.table[:0]
        new = list(dict.fromkeys(w for ws in lists for w in ws if w not in self.place))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            blocks = [self.net.table(new[i : i + 8192]) for i in range(0, len(new), 8192)]
            self.table = np.concatenate([self.table, *blocks])
        look = self.place.__getitem__
        return [list(map(look, ws)) for ws in lists]

    def __call__(self, texts: list[str]) -> list[float]:
        if self.net.constant is not None:
            return [self.net.constant] * len(texts)
        out: list[float] = []
        part, size = [], 0
        for text in texts:  # a few MB of text at a time
            part.append(text)
            size += len(text)
            if size > 1 << 21:
                out += self._scored(part)
                part, size = [], 0
        return out + (self._scored(part) if part else [])

    def _scored(self, texts: list[str]) -> list[float]:
        lists = self._places([words_of(t) for t in texts])
        cut = [(d, ws[a:b]) for d, ws in enumerate(lists) for a, b in windows(len(ws))]
        cut.sort(key=lambda x: len(x[1]))
        worst = np.full(len(texts), -np.inf)
        for at in range(0, len(cut), BLOCK):
            block = cut[at : at + BLOCK]
            index, mask = _padded([w for _, w in block])
            steps = len(block[-1][1])
            logit = self.net.logits(self.table, index[:, :steps], mask[:, :steps])
            np.maximum.at(worst, [d for d, _ in block], logit)
        worst[np.isinf(worst)] = self.net.w["c"][0]  # no words: what the network says of nothing
        return self.net.chance(worst).tolist()


def score(text: Column, net: Network) -> Column:
    """Chance of label 1 between 0 and 1 over the whole text; NULL is the empty text."""
    return on_batches(lambda: Scorer(net), pa.float64(), "double")(text)


def judged(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    held_out = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    scored = docs.select("doc_id", score(F.col("text"), net).alias("score"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
