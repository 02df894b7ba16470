"""Benchmark decontamination: windows of benchmark words looked up in every document, in DataFrame functions.

The windows of all benchmark items become a hash set that is broadcast, since a benchmark is small and its size is
checked; each document's windows are hashed, looked up and, on a hit, compared word by word. Only hits are shuffled, and
one row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import ascii_lower, bind, run_hash, words
from stationflow.session import settle

WINDOW = 13
#: A document is contaminated if one word in so many, or more, is hit.
ONE_IN = 20
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of benchmark windows up to which they are broadcast; a larger set is joined by Spark's own choice.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters and digits and of anything beyond ASCII."""
    return words(ascii_lower(text), BETWEEN)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, len, window, items): each different window, its words and the items that hold it.

    An item of fewer words than a window is one window; one without words has none. Items of equal id count as one, a
    NULL id as the empty text.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    rows = rows.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    cut = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(WINDOW)))).alias("window"))
    by_window = cut.groupBy("window").agg(F.collect_set("item").alias("items"))
    return by_window.select(F.xxhash64("window").alias("hash"), F.size("window").alias("len"), "window", "items")


def _bounded(windows: DataFrame) -> tuple[DataFrame, list[int]]:
    """The windows, for broadcast if they are few, and their lengths (at most ``WINDOW`` different ones)."""
    size = F.length(F.concat_ws(" ", "window")) * 3 + F.length(F.concat_ws(" ", "items")) + 64
    facts = windows.agg(F.sum(size).alias("size"), F.collect_set("len").alias("lens")).first()
    small = (facts["size"] or 0) <= BROADCAST_BYTES
    return (F.broadcast(windows) if small else windows), sorted(facts["lens"])


def _hashes(w: Column, lens: list[int]) -> Column:
    """Array of (position, len, hash) of the document's windows of each length, and a first entry with position 0 and the number
    of words as len, so that every document has one."""

    def entry(position: Column, size: Column, value: Column) -> Column:
        return F.struct(position.alias("position"), size.alias("len"), value.alias("hash"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        none = F.array().cast("array<struct<position:int,len:int,hash:bigint>>")
        cut = F.transform(starts, lambda i: entry(i, F.lit(n), run_hash(w, i - 1, n)))
        return F.when(F.size(w) >= n, cut).otherwise(none)

    head = F.array(entry(F.lit(0), F.size(w), F.lit(0).cast("long")))
    return F.concat(head, *map(of_length, lens))


def _covered(places: Column) -> Column:
    """Number of words in the union of sorted (position, len) ranges."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state: Column, x: Column) -> Column:
        end = x["position"] + x["len"]
        new = F.greatest(end - F.greatest(x["position"], state["end"]), F.lit(0))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + new).alias("n"))

    return F.aggregate(places, zero, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items, places, contaminated), a row for each row of ``docs``.

    ``items`` are the ids, sorted as strings, of the items with a window in the document, ``places`` the hit
    ranges as (first word, words). NULL and empty texts have no words and are clean, as is everything with an
    empty benchmark. Of a hash that agrees by chance the words are compared. Equal rows each give a row.
    """
    windows, lens = _bounded(settle(benchmark_windows(benchmark), "windows"))
    kept = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    # The entries are a column of their own before they are exploded: so the words stay beside them without being copied.
    # None is empty; the outer form saves the filter that the optimizer would otherwise compute the column twice for.
    listed = kept.select("doc_id", "text_hash", "w", bind(F.col("w"), lambda w: _hashes(w, lens)).alias("entries"))
    scan = listed.select("doc_id", "text_hash", "w", F.explode_outer("entries").alias("e"))
    found = scan.join(windows, F.col("e.hash") == F.col("hash"), "left")
    head = F.col("e.position") == 0
    hit = ~head & (F.slice("w", F.greatest("e.position", F.lit(1)), F.greatest("e.len", F.lit(0))) == F.col("window"))
    hits = found.where(head | hit).select(
        "doc_id", "text_hash",
        F.when(head, F.col("e.len")).alias("n_words"),
        F.when(~head, F.struct("e.position", "e.len")).alias("place"),
        F.when(~head, F.col("items")).alias("items"),
    )
    by_doc = hits.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count("n_words").alias("_copies"),
        F.array_sort(F.collect_set("place")).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    by_doc = by_doc.withColumn("n_hit", _covered(F.col("places")).cast("long"))
    rule = (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words"))
    each = by_doc.select("*", rule.alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return each.select("doc_id", "text_hash", "n_words", "n_hit", "items", "places", "contaminated")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns kept and texts as they are."""
    bad = contamination(docs, benchmark).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(bad["_bad_id"]) & (hashed["_text_hash"] == bad["_bad_hash"])
    return hashed.join(bad, same, "left_anti").drop("_text_hash")
