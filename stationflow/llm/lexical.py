"""Ranked lexical search of many queries at once by one scan of the texts.

All terms of the items go into one Aho-Corasick automaton, each between guards (a space in place of what may not stand in a
term), so a match is a whole term and nothing else. Each task runs its texts through the automaton and counts term
frequencies directly; there is no index of the documents. The automaton's outputs are term numbers, which map to the items that
have the term. A second pass over the counts adds up scores, documents against items in blocks, and keeps the best ``k`` of each
item per task, so what is shuffled does not depend on how many documents match.

Items are a stated query set. They are dealt to blocks by a hash of their id, as many as keep a block's terms within
``BLOCK_BYTES`` (measured; one item must fit by itself), and each block is a scan of its own; terms and statistics of one block are all
that is sent to the driver and to the tasks.

Edge cases: a NULL text has no terms, a document without terms is not counted; every row is a document, so repeated rows
count and rank one by one; equal scores rank by ascending id, NULL last. Rows of equal item id are one item with
the terms of all; an item without terms, or whose terms no document holds, has no result. Empty tables give no rows. Texts may have any
length. Only the named columns are read.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.common import ascii_lower, words
from stationflow.session import settle

#: What stands between terms: every ASCII character that is no letter and no digit.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: UTF-8 bytes of the terms of one block of items.
BLOCK_BYTES = 16 << 20
#: (document, term, item) triples that are added up together.
TRIPLES = 1 << 21
#: Cells of a block of scores.
CELLS = 1 << 21

_KEPT = string.ascii_letters + string.digits
_FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b) in _KEPT else 32 for b in range(256))
_LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), each once."""
    found = items.select(F.col(item).alias("item_id"), F.explode(F.array_distinct(words(ascii_lower(F.col(text)), BETWEEN))).alias("term"))
    return found.distinct()


def guarded(text: bytes) -> str:
    """The text with lower-case ASCII letters, a space for each byte between terms and at both ends, one character a byte."""
    return (b" " + text.translate(_FOLD) + b" ").decode("latin-1")


def automaton(terms: list[str]):
    """Each term between guards; its output is its number."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        made.add_word(guarded(term.encode()), number)
    made.make_automaton()
    return made


def term_counts(docs: DataFrame, terms: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with at least one term of any kind; ``n`` counts all their terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(terms) if terms else None
        for batch in batches:
            kept, lengths, numbers, tfs = [], [], [], []
            for place, value in enumerate(batch.column(1)):
                raw = value.as_py()
                if not raw:
                    continue
                line = guarded(raw)
                inside = np.frombuffer(line.encode("latin-1"), np.uint8) != 32
                n = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
                if not n:
                    continue
                tf = Counter(map(itemgetter(1), found.iter(line))) if found else {}
                kept.append(place)
                lengths.append(n)
                numbers.append(list(tf))
                tfs.append(list(tf.values()))
            columns = [
                batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()),
                pa.array(numbers, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(counted, "doc_id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The best ``k`` (score, document) of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)
        self.item = self.score = self.doc = np.empty(0, np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(pair) for pair in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        begins = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(begins, np.diff(begins, append=len(item)))
        full = item[place == self.k - 1]
        self.least[full] = score[place == self.k - 1]
        kept = place < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _add_scores(best: Best, docs, m, offsets, terms, tfs, weight, item_starts, item_lists) -> None:
    """Offer all scores above 0 of a batch of documents, in blocks of bounded size."""
    n_items = len(best.least)
    fan = np.diff(item_starts)
    triples = np.concatenate(([0], np.cumsum(fan[terms])))[offsets]
    first, widest = 0, max(1, CELLS // max(n_items, 1))
    while first < len(docs):
        last = int(np.searchsorted(triples, triples[first] + TRIPLES, "right")) - 1
        last = min(max(last, first + 1), first + widest, len(docs))
        span = slice(offsets[first], offsets[last])
        row = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
        tf = tfs[span]
        worth = weight[terms[span]] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[first:last][row]))
        size = fan[terms[span]]
        cell = np.repeat(row * n_items, size) + item_lists[_runs(item_starts[terms[span]], size)]
        scores = np.zeros((last - first) * n_items, np.int64)
        np.add.at(scores, cell, np.repeat(worth, size))
        good = np.flatnonzero(scores.reshape(-1, n_items) >= best.least)
        if len(good):
            best.offer(good % n_items, scores[good], docs[first:last][good // n_items])
        first = last


def _block_ranking(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """Best ``k`` documents of each item of one block: (item_id, doc_id, score), at most ``k`` per item and task."""
    spark = docs.sparkSession
    pairs = block.collect()
    if not pairs:
        return block.select("item_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    items = list(dict.fromkeys(r["item_id"] for r in pairs))
    terms = list(dict.fromkeys(r["term"] for r in pairs))
    item_at, term_at = {v: i for i, v in enumerate(items)}, {v: i for i, v in enumerate(terms)}
    of_term = np.array([term_at[r["term"]] for r in pairs], np.int64)
    of_item = np.array([item_at[r["item_id"]] for r in pairs], np.int64)
    item_lists = of_item[np.argsort(of_term, kind="stable")]
    item_starts = np.concatenate(([0], np.cumsum(np.bincount(of_term, minlength=len(terms)))))

    counts = settle(term_counts(docs, terms), "term-counts")
    total = counts.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = held.select("term", F.floor(1000 * F.log(F.lit(2.0 * total["N"] + 2) / (2 * F.col("df") + 1))).alias("w")).collect()
    weight = np.zeros(len(terms), np.int64)
    weight[[r["term"] for r in weights]] = [r["w"] for r in weights]

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        for batch in batches:
            ids, m, numbers, tfs = batch.columns
            offsets = numbers.offsets.to_numpy().astype(np.int64)
            _add_scores(
                best, ids.fill_null(_LAST).to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False), offsets - offsets[0],
                numbers.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False), weight, item_starts, item_lists,
            )
        columns = [pa.array(best.item, pa.int64()), pa.array(best.doc, pa.int64(), mask=best.doc == _LAST), pa.array(best.score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    # decimals, since the product may pass 64 bits
    length = F.expr(f"cast(90 as decimal(2)) * cast(n as decimal(18)) * cast({total['N']} as decimal(18)) div cast({max(total['L'], 1)} as decimal(19))")
    scored = counts.select("doc_id", (100 - 90 + length).cast("long").alias("m"), "terms", "tfs")
    found = scored.mapInArrow(best_of_task, "item long, doc_id long, score long")
    # fewer rows per item in two steps: first among neighbouring tasks, then among all
    near = Window.partitionBy("item", "_near").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("_near", F.floor(F.spark_partition_id() / 64)).withColumn("_place", F.row_number().over(near)).where(F.col("_place") <= k)
    names = spark.createDataFrame(list(enumerate(items)), f"item long, item_id {block.schema['item_id'].dataType.simpleString()}")
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    pairs = settle(item_terms(items), "item-terms")
    size = pairs.agg(F.sum(F.octet_length("term") + 16).alias("b")).first()["b"] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    dealt = [pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, [_block_ranking(docs, block, k) for block in dealt])
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
