"""SimHash near-dedup by multi-index hashing.

A fingerprint has 64 bits; a bit is set if it is set in over half the XXH64 hashes of a text's word shingles, repeats
included. Fingerprints link at RADIUS or fewer differing bits. Each is cut into SEGMENTS; where two link, one of their
segments differs by RADIUS // SEGMENTS bits at most. So the table holds each distinct fingerprint by its segments, every
fingerprint asks for the Hamming ball of that radius around each of its own, and complete distances of the matches are
verified. What asks is joined by shuffling: Spark, when it looks for what to broadcast, takes all rows of a ball for one.

Only distinct fingerprints are linked: copies meet in one aggregate. Dense clusters are never expanded into their pairs:
first, each fingerprint is compared with one member of every bucket it asks for, and components are taken; then, with all
members of the buckets that still hold another component, of which one link per pair of components is kept. Buckets of more than
HOT fingerprints are asked by a second level then, which cuts the other bits in turn. No candidate is dropped.

Edge cases: null text: empty. Texts without words have fingerprint zero and link like any other; texts with fewer
words than a shingle are one shingle. Repeated rows are rows of one group; a null doc_id never names a group unless all of
it is null. Very long texts are hashed whole, in slices. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_unique, map_batches, settle, spread, table, text_column, unless_many
from .components import components

WORDS, SEED, RADIUS, SEGMENTS, HOT = 3, 42, 3, 2, 256
#: Hashes whose bits are counted at once.
SLICE = 1 << 16


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text's words, in order; A-Z count as a-z."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        found, words = [b" ".join(found)], 1
    runs = zip(*(found[k:] for k in range(words)), strict=False)
    return np.fromiter((xxh64_intdigest(b" ".join(run), seed) for run in runs), np.uint64, len(found) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), SLICE):
        counts += np.unpackbits(hashes[k : k + SLICE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp long of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([majority(shingle_hashes(text.as_py(), words)) for text in batch.column(1)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_column().alias("text")), run, "doc_id long, fp long")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def ball(first: int, width: int, radius: int) -> list[int]:
    """All masks of up to radius bits among width bits from first on."""
    return [signed(sum(1 << first + k for k in some)) for n in range(radius + 1) for some in combinations(range(width), n)]


def mask(first: int, width: int) -> int:
    return signed(((1 << width) - 1) << first)


def cut(segments: int, first: int = 0, width: int = 64) -> list[tuple[int, int]]:
    edges = [first + width * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def keyed(df: DataFrame, parts: list[tuple[int, int]], radius: int, name: str) -> DataFrame:
    """One row per segment and per key of the ball around it: columns NAME_seg and NAME_key."""
    rows = [F.struct(F.lit(k).cast("byte").alias("seg"), F.col("fp").bitwiseAND(F.lit(mask(*part))).bitwiseXOR(F.lit(flip)).alias("key")) for k, part in enumerate(parts) for flip in ball(*part, radius)]
    return df.select("*", F.inline(F.array(*rows))).withColumnsRenamed({"seg": f"{name}_seg", "key": f"{name}_key"})


def differing(a: Column, b: Column, part: int = -1) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(part)))


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs u, v of distinct fingerprints (column fp) that differ by radius bits at most, enough of them to connect all that any such pairs connect."""
    parts, near, on = cut(segments), radius // segments, ["t_seg", "t_key"]
    u, v = F.col("u"), F.col("v")
    rows = keyed(distinct.select("fp"), parts, 0, "t").withColumnRenamed("fp", "v")
    buckets = scratch.settle(rows.groupBy(*on).agg(F.min("v").alias("one"), F.count("*").alias("n")), "buckets")
    asks = keyed(distinct.select("fp"), parts, near, "t").withColumnRenamed("fp", "u")
    hits = scratch.settle(spread(asks).join(buckets, on).where((F.col("n") > 1) | (F.col("one") != u)), "hits")
    first = scratch.settle(hits.where((u != F.col("one")) & (differing(u, F.col("one")) <= radius)).select("u", F.col("one").alias("v")).distinct(), "first")
    labels = components(first, scratch).select(F.col("node").alias("fp"), "root")

    def labelled(df: DataFrame, name: str) -> DataFrame:
        return df.join(spread(labels.withColumnsRenamed({"fp": name, "root": f"{name}_root"})), name, "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))

    shared = scratch.settle(labelled(rows.join(buckets.where("n > 1").select(*on, "n"), on), "v"), "shared")
    ranges = shared.groupBy(*on).agg(F.min("v_root").alias("low"), F.max("v_root").alias("high"))
    open_asks = labelled(hits.where("n > 1").select("u", *on), "u").join(ranges, on)
    open_asks = scratch.settle(open_asks.where((F.col("low") != F.col("u_root")) | (F.col("high") != F.col("u_root"))).select("u", "u_root", *on), "asks")
    pair = (F.col("u_root") < F.col("v_root")) & (differing(u, v) <= radius)
    found = [spread(open_asks).join(shared.where(F.col("n") <= HOT), on).where(pair)]
    # Second level: what is left of the distance lies in the other bits, which are cut in two.
    for k in range(len(parts)):
        finer = [q for j, p in enumerate(parts) if j != k for q in cut(2, *p)]
        inner_rows = keyed(shared.where((F.col("n") > HOT) & (F.col("t_seg") == k)).withColumnRenamed("v", "fp"), finer, 0, "s").withColumnRenamed("fp", "v")
        inner_asks = keyed(open_asks.where(F.col("t_seg") == k).withColumnRenamed("u", "fp"), finer, radius // len(finer), "s").withColumnRenamed("fp", "u")
        found.append(spread(inner_asks).join(inner_rows, [*on, "s_seg", "s_key"]).where(pair))
    rest = reduce(DataFrame.unionByName, [f.select("u_root", "v_root", "u", "v") for f in found])
    one = rest.groupBy("u_root", "v_root").agg(F.min(F.struct("u", "v")).alias("one")).select("one.u", "one.v")
    return first.unionByName(scratch.settle(one, "rest"))


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id, n for rows doc_id, fp: the smallest doc_id that links of fingerprints reach, and how many rows have the fingerprint."""
    scratch = Scratch(prints.sparkSession)
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = settle(components(links(distinct, scratch, radius), scratch), "roots").withColumnRenamed("node", "fp")
    scratch.clear()
    placed = distinct.join(unless_many(roots, roots.count()), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return settle(placed.join(names, "root").select("fp", "component_id", "n"), "groups")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = settle(fingerprints(table(spark, sf_dir, "documents")), "prints")
    return join_unique(prints, groups(prints), "fp", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
