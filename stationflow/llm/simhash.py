"""Near copies by SimHash and multi-index hashing.

The 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most two bits can
be made equal by changing at most one bit in one segment of each. So the index enumerates, for every
segment, the Hamming ball of radius one around its value and keeps the other segment beside it in the key. Matches
of the table are then verified over the whole fingerprint. With the other segment in the key, no entry holds more
than 65 different fingerprints, however many share a segment: a bucket of near copies never becomes all pairs.

Texts that share four fifths of their five-word shingles differ in too many of 64 bits for that. ``similar_copies`` takes
the least values of the shingles under many hashes (MinHash), five of them to an index entry, and verifies the shingles
themselves of all texts of an entry that are not linked yet.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.common import on_texts
from stationflow.session import settle

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
SEGMENT_BITS = (range(0, 32), range(32, 64))
#: Shingles hashed at a time, so that a very long text needs no more memory.
BLOCK = 1 << 16

#: Shingle length and least share of common shingles (of all different ones of both) of ``similar_copies``.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Index entries of a text and the least hashes that make one: a pair of that similarity shares no entry in 3 of 10^6 cases.
BANDS, ROWS = 32, 5
#: Bits by which pairs of an entry are told apart before their shingles are compared.
BITS = 1024
#: About so many different texts are dealt to one bucket where pairs are verified.
BUCKET = 1024


def fingerprint_of(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the text's shingles, repeats included; 0 without words.

    A-Z is lower-cased, words are what stands between ASCII white space. With fewer words than a shingle the whole
    sequence is the only one. A bit is set if more than half of the hashes have it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(shingle_words, len(words))
    starts, ends = (ends - lengths)[: len(words) - k + 1], ends[k - 1 :]
    ones, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, starts.size, BLOCK):
        pairs = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > starts.size, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    return on_texts(lambda t: fingerprint_of(t, shingle_words), pa.int64(), "long")(text)


def links(prints: DataFrame) -> DataFrame:
    """(fp, root) of different fingerprints that differ in at most two bits, one link from each member of an index entry
    to its smallest one; ``prints`` has one row per ``fp``."""
    balls = [0] + [1 << b if b < 63 else -(1 << 63) for segment in SEGMENT_BITS for b in segment]
    keys = F.transform(F.lit(balls), lambda flip: F.col("fp").bitwiseXOR(flip))
    entries = prints.select("fp", F.explode_outer(keys).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    entries = entries.where(F.size("fps") > 1).select(F.array_min("fps").alias("root"), F.explode("fps").alias("fp"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("root"))) <= MAX_BITS
    return entries.where((F.col("fp") != F.col("root")) & near).select("fp", "root").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): each linked node with the smallest node it can reach.

    Alternates two steps until nothing changes: link each node's larger neighbours to its smallest one, then each
    node's smaller neighbours likewise. Paths halve, so rounds grow with the logarithm of the longest. Every
    round is written to the shared folder; only a count and a checksum of the links reach the driver.
    """

    def state(links: DataFrame) -> tuple:
        mixed = F.sum(F.xxhash64("fp", "root").cast("decimal(38,0)"))
        return tuple(links.agg(F.count("*"), mixed).first())

    def smallest(links: DataFrame) -> DataFrame:
        return links.groupBy("fp").agg(F.min("root").alias("least"))

    edges = settle(edges.select(F.greatest("fp", "root").alias("fp"), F.least("fp", "root").alias("root")), "links")
    now = state(edges)
    while now[0]:
        both = edges.union(edges.select("root", "fp"))
        larger = both.join(smallest(both), "fp").where(F.col("root") > F.col("fp"))
        stars = larger.select(F.col("root").alias("fp"), F.least("fp", "least").alias("root")).distinct()
        starred = settle(stars, "stars")
        below = starred.join(smallest(starred), "fp")
        moved = below.where(F.col("root") != F.col("least")).select(F.col("root").alias("fp"), F.col("least").alias("root"))
        edges = settle(moved.union(smallest(starred)).distinct(), "links")
        before, now = now, state(edges)
        if before == now:
            break
    return edges


def near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row of ``docs``.

    ``root`` names the component by its smallest fingerprint, ``component_id`` is the smallest doc_id that can be reached over fingerprints of at most two different bits. NULL and
    empty texts have fingerprint 0 and are linked like any other; rows of equal id each give a row; a component of
    NULL ids alone has a NULL id. Copies are first reduced to one row per fingerprint, so groups of copies of any
    size add no links.
    """
    marks = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text"), shingle_words).alias("fp"))
    marked = settle(marks, "fingerprints")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fp")))
    rooted = prints.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id")
    return marked.join(by_print, "fp")


def shingle_set(text: str, shingle_words: int = SIMILAR_WORDS) -> np.ndarray:
    """Sorted different hashes of the text's shingles; one zero without words, so that all such texts are alike."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(shingle_words, len(words))
    pairs = zip((ends - lengths)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - k + 1))


def _factors() -> np.ndarray:
    """Two odd factors for each of the hashes."""
    x = np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)).reshape(2, -1, 1)


FACTORS = _factors()


def sketch_of(text: str) -> dict:
    """``fp`` (hash of the shingle set), ``n`` (its size), ``keys`` (entries of the index) and ``bits`` (a bit for each value that a
    shingle's hash has modulo ``BITS``)."""
    hashes = shingle_set(text)
    halves = hashes.view(np.uint32).reshape(-1, 2).T.copy()
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, hashes.size, BLOCK // 64):
        low, high = halves[:, at : at + BLOCK // 64]
        np.minimum(least, (FACTORS[0] * low + FACTORS[1] * high).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(bands[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)
    fp = int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), SEED), np.uint64).view(np.int64))
    places = np.zeros(BITS, np.uint8)
    places[hashes % np.uint64(BITS)] = 1
    bits = np.packbits(places, bitorder="little").view("<i8")
    return {"fp": fp, "n": hashes.size, "keys": keys.tolist(), "bits": bits.tolist()}


def sketch(text: Column) -> Column:
    kind = pa.struct([("fp", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
    return on_texts(sketch_of, kind, "fp long, n int, keys array<long>, bits array<long>")(text)


def _sized(n: str, m: str) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(n, m) >= F.greatest(n, m) * SIMILARITY


def _near(bits: str, of: str, n: str, m: str) -> Column:
    """Whether two sets can be similar by their bits. Each bit that differs comes of a shingle that only one set has, and
    sets of that similarity have at most this many such shingles; so no similar pair is told apart, and few others pass."""
    differ = reduce(add, [F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(of)[i])) for i in range(BITS // 64)])
    return differ * (1 + SIMILARITY) <= (F.col(n) + F.col(m)) * (1 - SIMILARITY) + 1e-6


def _shared(prints: DataFrame) -> DataFrame:
    """(key, fp, n, weight) of the index entries that several texts have. A text weighs what it shares: the sum of the sizes of its
    entries, so that of many edits of one page the page itself weighs most."""
    entries = prints.select("fp", "n", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = settle(entries.join(sizes, "key"), "entries")
    weights = shared.groupBy("fp").agg(F.sum("_n").alias("weight"))
    return settle(shared.drop("_n").join(weights, "fp"), "weighed")


def _first_pairs(shared: DataFrame, prints: DataFrame) -> DataFrame:
    """(fp, root) of different texts that can be similar: each member of an index entry beside the entry's weightiest one."""
    heaviest = F.max(F.struct("weight", "fp", "n"))
    firsts = shared.groupBy("key").agg(heaviest.alias("_f")).select("key", F.col("_f.fp").alias("root"), F.col("_f.n").alias("m"))
    pairs = shared.join(firsts, "key").where((F.col("fp") != F.col("root")) & _sized("n", "m")).select("fp", "root").distinct()
    mine = prints.select("fp", "n", "bits")
    theirs = prints.select(F.col("fp").alias("root"), F.col("n").alias("m"), F.col("bits").alias("_bits"))
    return pairs.join(mine, "fp").join(theirs, "root").where(_near("bits", "_bits", "n", "m")).select("fp", "root")


def _other_pairs(shared: DataFrame, roots: DataFrame, tried: DataFrame, prints: DataFrame) -> DataFrame:
    """(fp, root) of all pairs of an index entry that can be similar, that no links join yet and that were not tried."""
    rooted = shared.drop("weight").join(roots.withColumnRenamed("root", "of"), "fp", "left").withColumn("of", F.coalesce("of", "fp"))
    several = rooted.groupBy("key").agg(F.min("of").alias("a"), F.max("of").alias("z")).where("a < z").select("key")
    open_ = settle(rooted.join(several, "key", "left_semi").join(prints.select("fp", "bits"), "fp"), "open")
    other = open_.select("key", F.col("fp").alias("root"), F.col("n").alias("m"), F.col("of").alias("_of"), F.col("bits").alias("_bits"))
    apart = (F.col("of") != F.col("_of")) & (F.col("fp") > F.col("root")) & _sized("n", "m") & _near("bits", "_bits", "n", "m")
    pairs = open_.join(other, "key").where(apart).select("fp", "root").distinct()
    both = tried.union(tried.select(F.col("root").alias("fp"), F.col("fp").alias("root")))
    return pairs.join(both, ["fp", "root"], "left_anti")


def _similar_in(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs of a cell that share enough shingles."""
    lists = sets["set"].combine_chunks()
    offsets, hashes = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    offsets = offsets - offsets[0]
    fps = sets["member"].to_numpy()
    order = np.argsort(fps)
    rows = [order[np.searchsorted(fps, pairs[c].to_numpy(), sorter=order)] for c in ("fp", "root")]
    different, ids = np.unique(hashes, return_inverse=True)
    has, keep = np.zeros(different.size, bool), np.zeros(pairs.num_rows, bool)
    by_left = np.argsort(rows[0], kind="stable")
    for some in np.split(by_left, np.flatnonzero(np.diff(rows[0][by_left])) + 1):
        left = rows[0][some[0]]
        mine = ids[offsets[left] : offsets[left + 1]]
        has[mine] = True
        for i in some:
            right = rows[1][i]
            theirs = ids[offsets[right] : offsets[right + 1]]
            common = int(np.count_nonzero(has[theirs]))
            keep[i] = common / (mine.size + theirs.size - common) >= SIMILARITY
        has[mine] = False
    return pairs.select(["fp", "root"]).filter(pa.array(keep))


def _verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, root) of the pairs of similar shingle sets.

    Texts are dealt to buckets and pairs to cells of two buckets, so a text that is part of many pairs is moved once for each
    bucket, not once for each pair.
    """
    needed = settle(pairs.select("fp").union(pairs.select("root")).distinct().join(prints.select("fp", "text_hash"), "fp"), "needed")
    buckets = -(-needed.count() // BUCKET) or 1
    hashed = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(needed, "text_hash")
    # Of copies one is enough: the least text, if hashes should agree by chance.
    texts = hashed.groupBy("fp").agg(F.min("text").alias("text"))
    to_set = on_texts(lambda t: shingle_set(t).view(np.int64).tolist(), pa.list_(pa.int64()), "array<long>")
    sets = settle(texts.select("fp", to_set(F.col("text")).alias("set")), "shingles")
    of = lambda c: F.pmod(F.col(c), F.lit(buckets))
    celled = settle(pairs.withColumn("cell", F.least(of("fp"), of("root")) * buckets + F.greatest(of("fp"), of("root"))), "cells")
    places = celled.select(F.col("cell").alias("place"), F.explode(F.array("fp", "root")).alias("member")).distinct()
    there = places.join(sets.withColumnRenamed("fp", "_fp"), F.col("member") == F.col("_fp")).select("place", "member", "set")
    return celled.groupBy("cell").cogroup(there.groupBy("place")).applyInArrow(_similar_in, "fp long, root long")


def similar_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root) for every row of ``docs``; rows of one ``root`` are copies of each other, directly or
    over others: texts that share four fifths of their different five-word shingles, or more.

    Every member of an index entry is verified against the text of the entry that shares most, which links most of a large group of copies;
    then all members of an entry that are not linked yet are verified against each other. So no two texts that
    share an entry are left untold, and the pairs grow with the square only of what is in one entry and not
    linked. The index misses 3 in 10^6 pairs at the least similarity and fewer above. NULL and empty texts are copies
    of each other, texts of fewer words than a shingle have one shingle; rows of equal id each give a row.
    """
    marks = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch(F.col("text")).alias("_s"))
    marked = settle(marks.select("doc_id", "text_hash", "_s.*"), "sketches")
    firsts = marked.groupBy("fp").agg(F.min(F.struct("text_hash", "n", "keys", "bits")).alias("_f"))
    prints = settle(firsts.select("fp", "_f.*"), "prints")
    shared = _shared(prints)
    tried = settle(_first_pairs(shared, prints), "candidates")
    told = settle(_verified(tried, prints, docs), "told")
    others = settle(_other_pairs(shared, components(told), tried, prints), "candidates")
    roots = components(told.union(_verified(others, prints, docs)))
    return marked.drop("n", "keys", "bits").join(roots, "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))


def survivors(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without the copies that ``similar_copies`` finds: one row of each component stays."""
    return _one_of_each(docs, similar_copies(docs))


def without_near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Rows of ``docs`` without the copies that ``near_copies`` finds: one row of each component stays. Texts without words
    have the fingerprint 0 in common and so are copies of each other."""
    return _one_of_each(docs, near_copies(docs, shingle_words))


def _one_of_each(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``copies``, all columns kept: that of its smallest id (NULL ids
    last, then the smallest hash of the text). Of wholly equal rows one stays."""
    found = settle(copies.select("doc_id", "text_hash", "root"), "copies")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    best = found.groupBy("root").agg(F.min(order).alias("best")).select("root", "best.doc_id", "best.text_hash")
    id_, hash_ = F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("_n"))
    rest = rows.join(best.withColumns({"_best_id": F.col("doc_id"), "_best_hash": F.col("text_hash")}).drop("doc_id", "text_hash"), "root")
    first = F.col("doc_id").eqNullSafe(F.col("_best_id")) & (F.col("text_hash") == F.col("_best_hash"))
    # what goes, and of what stays the few rows that are there several times
    gone = settle(rest.where(~first).select(id_, hash_), "gone")
    several = settle(rest.where(first & (F.col("_n") > 1)).select(id_, hash_), "several")

    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    kept = hashed.join(gone, same, "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id", "_text_hash").orderBy("_text_hash"))
    one = kept.join(several, same, "left_semi").withColumn("_place", place).where("_place = 1").drop("_place")
    return kept.join(several, same, "left_anti").unionByName(one).drop("_text_hash")
