"""Document fingerprints: threshold-scaled sketches, in DataFrame functions.

A sketch retains every shingle hash below a fixed fraction of the hash range, the same for all documents, so it grows with its
document and two sketches of very unequal documents can still be compared or merged. If none of a document's hashes is
below it, its smallest one is retained, so that only documents without words have an empty sketch. Sketches of different
fractions are compared below the smaller one.

An estimate from n different shingles of both documents has a standard error of about sqrt(j (1 - j) * SCALED / n) for a Jaccard
similarity of j: 0.06 at most for 130 shingles, 0.02 for 1,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.common import ascii_lower, bind, run_hash, words
from stationflow.session import settle

SHINGLE_WORDS = 5
#: One hash in so many is retained.
SCALED = 2
WHITE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a bin of the ordered pass holds, about, and the largest number of bins.
BIN_BYTES = 24 << 20
MOST_BINS = 1 << 12

SKETCH = "struct<scaled:int,n:int,mark:bigint,hashes:array<bigint>>"


def below(scaled: Column) -> Column:
    """Hashes are compared as non-negative 63-bit numbers; those below this one are retained."""
    return F.call_function("div", F.lit((1 << 63) - 1), scaled.cast("long"))


def _shingles(w: Column) -> Column:
    """Different non-negative shingle hashes of an array of words; fewer words than a shingle are one."""
    positive = lambda h: h.bitwiseAND((1 << 63) - 1)
    starts = F.sequence(F.lit(0), F.size(w) - SHINGLE_WORDS)
    hashes = F.array_distinct(F.transform(starts, lambda i: positive(run_hash(w, i, SHINGLE_WORDS))))
    few = F.when(F.size(w) > 0, F.array(positive(F.xxhash64(w)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(w) >= SHINGLE_WORDS, hashes).otherwise(few)


def _within(hashes: Column, limit: Column) -> Column:
    """The hashes below the limit, or else the smallest one; none of none. In order if they are in order."""
    return bind(
        F.filter(hashes, lambda h: h < limit),
        lambda kept: F.when((F.size(kept) > 0) | (F.size(hashes) == 0), kept).otherwise(F.array(F.array_min(hashes))),
    )


def sketch(text: Column, scaled: int = SCALED) -> Column:
    """Sketch of a whole text: (scaled, n, mark, hashes in order), with the number of its different shingles and all their hashes as one.
    Without words it is empty."""
    limit = F.lit(((1 << 63) - 1) // scaled)

    def retained(all_hashes: Column) -> Column:
        mark = F.aggregate(all_hashes, F.lit(0).cast("long"), lambda m, h: m.bitwiseXOR(F.xxhash64(h)))
        return F.struct(
            F.lit(scaled).alias("scaled"), F.size(all_hashes).alias("n"), mark.alias("mark"), F.sort_array(_within(all_hashes, limit)).alias("hashes")
        )

    return bind(words(ascii_lower(text), WHITE), lambda w: bind(_shingles(w), retained))


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    """Hashes of two sketches below the smaller fraction."""
    coarser = F.greatest(a["scaled"], b["scaled"])
    cut = lambda s: F.when(s["scaled"] == coarser, s["hashes"]).otherwise(_within(s["hashes"], below(coarser)))
    return cut(a), cut(b)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1. It is 1 for equal sets of shingles only, also empty ones; for others it is at most what
    sets of those sizes can have. Sizes and marks of merged documents are not known and then say nothing."""
    x, y = _common(a, b)

    def share(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["x"], pair["y"]))
        either = F.size(pair["x"]) + F.size(pair["y"]) - both
        return F.when(either > 0, both / either).otherwise(F.lit(0.0))

    less, more = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    most = F.when(less == more, (more - 1) / (more + 1)).otherwise(less / more)
    known = a["mark"].isNotNull() & b["mark"].isNotNull() & (more > 0)
    equal = F.when(known, (a["n"] == b["n"]) & (a["mark"] == b["mark"])).otherwise(a["hashes"] == b["hashes"])
    estimate = bind(F.struct(x.alias("x"), y.alias("y")), share)
    return F.when(equal, F.lit(1.0)).when(known, F.least(estimate, most)).otherwise(estimate)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second holds too; NULL if the sketch of the first retains none
    at the common fraction."""
    x, y = _common(a, b)
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(x))


def merged(a: Column, b: Column) -> Column:
    """Sketch of two documents taken as one, by the smaller fraction."""
    x, y = _common(a, b)
    scaled = F.greatest(a["scaled"], b["scaled"])
    hashes = bind(F.sort_array(F.array_union(x, y)), lambda both: _within(both, below(scaled)))
    unknown = F.lit(None)
    return F.struct(scaled.alias("scaled"), unknown.cast("int").alias("n"), unknown.cast("long").alias("mark"), hashes.alias("hashes"))


def written(s: Column) -> Column:
    """A sketch as text: the fraction and the mark, then the hashes as 16 hex digits each."""
    digits = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat_ws(":", s["scaled"].cast("string"), digits(s["mark"]), F.array_join(F.transform(s["hashes"], digits), ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sketch) of every row; NULL is the empty text, whose sketch is empty. Rows are handled one by one, so ties, repeated
    rows and other columns play no part, and an empty table gives no rows."""
    return docs.select("doc_id", sketch(F.col("text")).alias("sketch"))


# -- a document beside the next one -------------------------------------------------------------------


def _bins(docs: DataFrame) -> list[int]:
    """First ids of all bins but the first: quantiles of doc_id, in number after the bytes of text. No more than
    ``MOST_BINS`` numbers reach the driver; a bin larger than memory is sorted on disk."""
    facts = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()
    n = min(MOST_BINS, max(1, -(-(facts["size"] or 0) // BIN_BYTES)))
    if n == 1:
        return []
    cuts = F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)
    return sorted(set(docs.agg(cuts.alias("c")).first()["c"] or []))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _next): each row with the text that follows in ascending doc_id, the last with the first.

    NULL texts are empty. A NULL id comes first; rows of equal id follow each other by their text. Rows are dealt to bins of
    consecutive ids, so each text is moved once; a copy of each bin's first row closes the bin before. A single row
    follows itself.
    """
    cuts = _bins(docs)
    bin_of = F.lit(0)
    if cuts:
        # the number of cuts at or below the id, found by halving
        def place(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(F.col("doc_id") >= cuts[middle], place(middle + 1, high)).otherwise(place(low, middle))

        bin_of = place(0, len(cuts))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_bin", bin_of)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text")
    # the first text of a bin, without moving texts: first ids by bin, then only those rows
    firsts = rows.groupBy("_bin").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("_f"))
    firsts = settle(firsts.select("_bin", F.col("_f.doc_id").alias("_first")), "firsts")
    known = sorted(r["_bin"] for r in firsts.select("_bin").collect())  # at most MOST_BINS numbers
    before = {b: known[i - 1] for i, b in enumerate(known)}
    if not known:
        return rows.select("doc_id", "text", F.lit("").alias("_next"))
    heads = rows.join(F.broadcast(firsts), "_bin").where(F.col("doc_id").eqNullSafe(F.col("_first")))
    heads = heads.groupBy("_bin").agg(F.min(order).alias("_o")).select("_bin", F.col("_o.text").alias("text"))
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    last = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.try_element_at(to, F.col("_bin")).alias("_bin"), F.lit(1).alias("_end"))
    both = rows.withColumn("_end", F.lit(0)).unionByName(last)
    track = Window.partitionBy("_bin").orderBy("_end", F.col("doc_id").asc_nulls_first(), "text")
    following = both.withColumn("_next", F.lead("text").over(track))
    return following.where("_end = 0").select("doc_id", "text", "_next", "_bin")


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch) of every row.

    The edited text has its last quarter of code points (rounded down) replaced by as many from the start of the next
    document, or all of it if that is shorter.
    """
    rows = with_next(docs)
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("_next", F.lit(1), k))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("_edited"), "_next")
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("sketch"),
        sketch(F.col("_edited")).alias("edited_sketch"), sketch(F.col("_next")).alias("next_sketch"),
    )


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    rows = beside_next(docs)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
