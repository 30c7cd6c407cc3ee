"""Near-duplicate removal: SimHash links first, then prefix filtering, so that every pair of texts whose word shingles are alike is compared.

Fingerprints of WORDS-word shingles are linked by multi-index hashing (simhash.links), and texts of one fingerprint with one of
them; what these candidates' exact Jaccard similarity confirms is linked. SimHash alone misses many pairs at the threshold (a block
put at the end moves more than three bits), so the rest is found exactly.

Shingles have one order for all texts. Of two sets of x and y shingles with a Jaccard similarity t, t / (1 + t) * (x + y) are
common, so that each set's first x - ceil(t * x) + 1 shingles hold the first common one: texts meet in a bucket for each
shingle of that prefix, and no pair that is similar enough is missed, whatever was edited. The order is rare ones first, by
counts over all texts: of few texts by shingle, of many by slots of hashes, which count their shingles together. It decides how large
buckets get, not what they find. A bucket's pairs are cut down by
the places of its shingle in both sets, then by BINS one-bit minima of the shingles that go along (SIGMAS standard deviations, which
misses 3 in 100,000 pairs at the very threshold, fewer above), then by the exact Jaccard similarity of WORDS-word shingles. Linked
texts form groups, one document of each stays.

Buckets of SMALL texts at most give all their pairs where prefixes meet, and are done with: pairs are compared once, whatever number
of buckets they share, if their texts aren't in one group by then. No larger one is expanded into all its pairs. Rounds compare every text that isn't in its bucket's largest group with one member of
that group, another in each round, as long as that leaves fewer of them by a fair part; buckets of one group are done with. Then the
pairs that are left between different groups of a bucket are compared, all of them.

Texts are read by Python twice, first for the counts; sets of shingles aren't kept, but made again for texts that are compared. A text is known by two 64-bit halves of its MD5: rows whose first half is another text's too are
told apart by the second and stay, each text once.

Edge cases: null text: empty; texts without words are copies of each other. Texts with fewer words than a shingle are one
shingle. Of rows with one text the smallest doc_id stays, null only if there is no other; of repeated rows one stays. An
empty table stays empty; ties go to the smallest doc_id; further columns are kept as they are; very long texts are compared whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, Scratch, few, if_few, if_small, map_batches, map_partitions, settle, spread, text_column, unless_many
from .components import components
from .simhash import links, majority, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Bits of the sketch; standard deviations by which it may err; the part by which what lies outside largest groups must shrink for another round.
BINS, SIGMAS, FAIR = 128, 4.5, 0.02
#: Members of a bucket up to which all its pairs are compared at once, without rounds.
SMALL = 32
#: Texts up to which shingles are counted one by one; times from which one counts as common there; common ones that are told apart.
SAMPLED, COMMON, TOLD = 16_000, 4, 20_000
#: Of more texts: slots in which all shingles are counted, parts in which slots are added up, and steps of an order for twice the count.
SLOTS, PARTS, STEPS = 1 << 20, 64, 2048


def half_of(text: Column, half: int) -> Column:
    """64 bits of a text's MD5, the first or the second half."""
    return F.conv(F.substring(F.md5(text), 1 + 16 * half, 16), 16, -10).cast("long")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, node, half, text of every row: node stands for a distinct text, half tells whether it is that one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), half_of(text_column(), 0).alias("node"), half_of(text_column(), 1).alias("half"), text_column().alias("text"))


def common_shingles(texts: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """What orders shingles, counted over all count texts (node, text): of few texts the most common shingles, sorted, and how often each came; else none, and slot_counts()."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t.as_py(), WORDS)) for t in batch.column(0)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    if count > SAMPLED:
        return np.zeros(0, np.uint64), slot_counts(texts)
    found = map_batches(texts.select("text"), run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "shingle").limit(TOLD).toArrow()
    shingles, counts = (np.array(rows[c].to_numpy(), np.int64) for c in ("shingle", "n"))
    shingles = shingles.view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def slot_counts(texts: DataFrame) -> np.ndarray:
    """Of each of SLOTS slots how often all texts' shingles of it came, each once a text, as STEPS times the logarithm to base 2 of one more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), WORDS)) for t in batch.column(0)]
            if sets:
                total += np.bincount(slot_of(np.concatenate(sets)), minlength=SLOTS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(part.tobytes(), 1) for part in np.split(total, PARTS)], pa.binary())], ["part", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals[part] = totals.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        if totals:
            steps = [np.minimum(STEPS * np.log2(1 + x), 65535).astype(np.uint16).tobytes() for x in totals.values()]
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), pa.array(steps, pa.binary())], ["part", "counts"])

    counted = map_partitions(texts.select("text"), count, "part int, counts binary")
    rows = map_partitions(counted.repartition("part"), add_up, "part int, counts binary").toArrow()
    found = dict(zip(rows["part"].to_pylist(), rows["counts"].to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(found[k], np.uint16) if found else np.zeros(SLOTS // PARTS, np.uint16) for k in range(PARTS)])


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a set of sorted hashes, rare ones before common ones, so many that similar sets share one; of the empty set 0.

    counts: of the common shingles, or, without any, of slots.
    """
    if not len(hashes):
        return np.zeros(1, np.uint64)
    often = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, counts[at], 0)
    elif len(counts):
        often = counts[slot_of(hashes)]
    return hashes[np.argsort(often, kind="stable")[: len(hashes) - int(np.ceil(SIMILARITY * len(hashes) - 1e-6)) + 1]]


def shingled(texts: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Of every row of doc_id, node, text its distinct shingles' number and prefix, its SimHash fingerprint and its sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, firsts, prints, sketches = [], [], [], []
        for t in batch.column(2):
            found = shingle_hashes(t.as_py(), WORDS)
            hashes = np.unique(found)
            lengths.append(len(hashes))
            firsts.append(prefix(hashes, common, counts).view(np.int64))
            prints.append(majority(found))
            sketches.append(sketch(hashes))
        made = [pa.array(lengths, pa.int32()), *(pa.array(x, pa.int64()) for x in (prints, *zip(*sketches, strict=True))), pa.array(firsts, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "node", "length", "fp", "m0", "m1", "prefix"])

    return map_batches(texts.select("doc_id", "node", "text"), run, "doc_id long, node long, length int, fp long, m0 long, m1 long, prefix array<long>")


def sets_of(texts: DataFrame) -> DataFrame:
    """node, shingles of every row of node, text: the 32-bit hashes of its distinct shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique((shingle_hashes(t.as_py(), WORDS) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["node", "shingles"])

    return map_batches(texts.select("node", "text"), run, "node long, shingles array<int>")


def sketch(hashes: np.ndarray) -> list[int]:
    """BINS bits of a set of hashes: one bit of the least of its elements under each of as many orders, as two numbers."""
    if not len(hashes):
        return [0, 0]
    odd = np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    mixed = hashes ^ (hashes >> np.uint64(32))
    least = np.full(BINS, np.iinfo(np.uint64).max)
    for k in range(0, len(mixed), 1 << 14):
        least = np.minimum(least, (odd[:, None] * mixed[k : k + (1 << 14)]).min(axis=1))
    least = (least ^ (least >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.packbits((least >> np.uint64(63)).astype(np.uint8)).view(np.int64).tolist()


def possible(a: str, b: str) -> Column:
    """Whether two sets may be similar enough if the shingle of their bucket is the first that they share."""
    left = F.least(F.col(f"{a}length") - F.col(f"{a}pos"), F.col(f"{b}length") - F.col(f"{b}pos"))
    return left * (1 + SIMILARITY) >= SIMILARITY * (F.col(f"{a}length") + F.col(f"{b}length")) - 1e-6


def plausible(a: str, b: str) -> Column:
    """Whether two nodes' sketches allow for the similarity."""
    share = (1 - SIMILARITY) / 2
    differing = reduce(add, [F.bit_count(F.col(f"{a}{m}").bitwiseXOR(F.col(f"{b}{m}"))) for m in ("m0", "m1")])
    return differing <= BINS * share + SIGMAS * (BINS * share * (1 - share)) ** 0.5


class Linker:
    """Compares candidate pairs and keeps what was linked. texts: node, doc_id, text; chosen: node, least (the row of texts to take)."""

    def __init__(self, texts: DataFrame, chosen: DataFrame, scratch: Scratch):
        spark = texts.sparkSession
        self.texts, self.chosen, self.scratch = texts.select("node", "doc_id", "text"), chosen.select("node", "least"), scratch
        self.tested = self.edges = spark.createDataFrame([], "u long, v long")
        self.labels = spark.createDataFrame([], "node long, root long")
        self.sets: DataFrame | None = None
        self.tests = 0

    def know(self, pairs: DataFrame) -> DataFrame:
        """The sets of all nodes of pairs, and maybe others; those that were not needed before are looked up."""
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        missing = nodes if self.sets is None else nodes.join(self.sets.select("node"), "node", "left_anti")
        missing = self.scratch.settle(missing.join(spread(self.chosen), "node"), "missing")
        if self.sets is None or not missing.isEmpty():
            found = self.texts.join(if_small(missing), "node").where(F.col("doc_id").eqNullSafe(F.col("least")))
            made = self.scratch.settle(sets_of(found).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
            self.sets = made if self.sets is None else self.sets.union(made)
        return self.sets

    def test(self, candidates: DataFrame) -> tuple[int, int]:
        """Compares the candidate pairs u, v that haven't been compared; how many there were, and how many were linked."""
        pairs = self.scratch.settle(candidates.distinct().join(if_few(self.tested, self.tests), ["u", "v"], "left_anti"), "pairs")
        count = pairs.count()
        if not count:
            return 0, 0
        sets = self.know(pairs)
        if few(count):  # else nearly all are needed
            sets = sets.join(F.broadcast(pairs.select(F.explode(F.array("u", "v")).alias("node"))), "node", "left_semi")
        end = lambda name: unless_many(sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_shingles")), count)
        whole = end("u").join(if_few(pairs, count), "u").join(end("v"), "v")
        common, sizes = F.size(F.array_intersect("u_shingles", "v_shingles")), [F.size("u_shingles"), F.size("v_shingles")]
        sized = F.least(*sizes) >= SIMILARITY * F.greatest(*sizes)
        good = self.scratch.settle(whole.where(sized & (common >= SIMILARITY * (sizes[0] + sizes[1] - common))).select("u", "v"), "links")
        self.tested, self.tests = self.tested.union(pairs), self.tests + count
        if linked := good.count():
            self.edges = self.edges.union(good)
            round_scratch = Scratch(self.scratch.spark)
            self.labels = self.scratch.settle(components(self.edges, round_scratch), "labels")
            round_scratch.clear()
        self.scratch.release()
        return count, linked


def ordered(a: str, b: str) -> list[Column]:
    """Two columns of nodes as a pair u, v."""
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def print_pairs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs u, v by SimHash of rows node, fp and sketch: each node with one of its fingerprint, and those whose fingerprints link."""
    prints = scratch.settle(nodes.groupBy("fp").agg(F.min_by(F.struct("node", "m0", "m1"), "node").alias("one")).select("fp", "one.*"), "prints")
    end = lambda name: spread(prints.select(F.col("fp").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("node", "m0", "m1")]))
    near = links(prints, scratch).join(end("u"), "u").join(end("v"), "v").where(plausible("u_", "v_")).select(*ordered("u_node", "v_node"))
    same = nodes.join(end("fp"), "fp").where(F.col("node") != F.col("fp_node")).where(plausible("", "fp_")).select(*ordered("node", "fp_node"))
    return near.unionByName(same)


def one_each(every: DataFrame, scratch: Scratch) -> DataFrame:
    """Of the rows of shingled() one for each node, without the shingles; nodes of one row, mostly nearly all, aren't shuffled."""
    columns = ("length", "fp", "m0", "m1", "prefix")
    several = scratch.settle(every.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "several")
    once = lambda rows: rows.groupBy("node").agg(*[F.first(c).alias(c) for c in columns])
    if several.count() > FEW:
        made = scratch.settle(once(every), "prefixes")
        scratch.release()
        return made
    several = F.broadcast(several)
    return every.select("node", *columns).join(several, "node", "left_anti").unionByName(once(every.join(several, "node")))


def small_pairs(rows: DataFrame) -> DataFrame:
    """Pairs u, v that may be similar by where they meet, as often as they do, of rows node, length, pos, bucket; buckets have SMALL at most."""
    lists = rows.groupBy("bucket").agg(F.collect_list(F.struct("node", "length", "pos")).alias("all"))
    pairs = lists.select("all", F.posexplode("all").alias("k", "a")).select("a", F.explode(F.slice("all", F.col("k") + 2, SMALL)).alias("b"))
    pairs = pairs.select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("a", "b") for c in ("node", "length", "pos")])
    return pairs.where(possible("a_", "b_")).select(*ordered("a_node", "b_node"))


def near_groups(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """node, root for the distinct texts that are linked to others; texts: doc_id, node, text; distinct: node, least (a doc_id that has it)."""
    scratch = Scratch(texts.sparkSession)
    common = common_shingles(texts, distinct.count())
    every = scratch.settle(shingled(texts, *common), "shingles")
    made = one_each(every, scratch)
    rows = made.select("node", "length", F.posexplode("prefix").alias("pos", "bucket"))
    sized = rows.withColumn("size", F.count("*").over(Window.partitionBy("bucket")))
    # Both parts are made of one shuffle: pairs of small buckets and, without pairs, members of larger ones.
    both = small_pairs(sized.where(F.col("size").between(2, SMALL))).unionByName(sized.where(F.col("size") > SMALL).drop("size"), allowMissingColumns=True)
    both = scratch.settle(both, "members")
    scratch.release()
    small, members = both.where("u IS NOT NULL").select("u", "v"), both.where("u IS NULL").drop("u", "v")
    # Texts with few edits meet most others: they are the ones that rounds compare with.
    nodes = members.select("node", F.lit(1).alias("one")).union(small.select(F.explode(F.array("u", "v")), F.lit(0)))
    met = nodes.groupBy("node").agg(F.sum("one").alias("met")).join(spread(distinct), "node").join(spread(made.select("node", "fp", "m0", "m1")), "node")
    met = scratch.settle(met, "met")
    members = scratch.settle(members.join(if_small(met.select("node", "met", "m0", "m1")), "node"), "members")
    linker = Linker(texts, met, scratch)
    linker.test(print_pairs(met, scratch))

    def unfinished() -> DataFrame:
        """Members, with their group, of buckets with several groups."""
        now = members.join(if_small(linker.labels), "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        return scratch.settle(now.join(if_small(scratch.settle(several, "several")), "bucket"), "members")

    ends = ("node", "length", "pos", "m0", "m1")

    def labelled(rows: DataFrame, name: str) -> DataFrame:
        labels = linker.labels.withColumnsRenamed({"node": name, "root": f"{name}_root"})
        return rows.join(if_small(labels), name, "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))

    def grouped(now: DataFrame, turn: int) -> DataFrame:
        """Such members, and of each bucket the largest group and one of its members."""
        weight = F.col("met") * (1024 + F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1024)))
        groups = now.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.max(weight).alias("weight"), F.max_by(F.struct(*ends), F.struct(weight, "node")).alias("other"))
        largest = groups.groupBy("bucket").agg(F.max_by(F.struct("root", "other"), F.struct("n", "weight", "root")).alias("top"))
        largest = largest.select("bucket", F.col("top.root").alias("top"), *[F.col(f"top.other.{c}").alias(f"other_{c}") for c in ends])
        return now.join(largest, "bucket")

    # Small buckets are done with at once, so that rounds don't deal them again and again.
    opened = scratch.settle(labelled(labelled(small.distinct(), "u"), "v").where("u_root <> v_root").select("u", "v"), "members")
    end = lambda name: if_small(met.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("m0", "m1")]))
    linker.test(opened.join(end("u"), "u").join(end("v"), "v").where(plausible("u_", "v_")).select("u", "v"))
    turn, before, fair = 0, None, True
    while fair:
        members = unfinished()
        others = [f"other_{c}" for c in ends]
        away = scratch.settle(grouped(members, turn).where(F.col("root") != F.col("top")).select(*ends, *others), "away")
        _, linked = linker.test(away.where(possible("", "other_") & plausible("", "other_")).select(*ordered("node", "other_node")))
        members, left = members.drop("root"), away.count()
        turn, before, fair = turn + 1, left, linked > 0 and (before is None or left < (1 - FAIR) * before)
    # What no round has linked: all pairs between different groups of a bucket, of which one isn't in its largest group.
    left = scratch.settle(grouped(unfinished(), turn).select("bucket", "root", "top", *ends), "left")
    if not left.isEmpty():
        end = lambda rows, name: rows.select("bucket", "top", *[F.col(c).alias(f"{name}_{c}") for c in ("root", *ends)])
        rest, others = end(left.where("root != top"), "a"), unless_many(end(left, "b").drop("top"), left.count())
        once = (F.col("b_root") == F.col("top")) | (F.col("a_node") < F.col("b_node"))
        found = rest.join(others, (rest["bucket"] == others["bucket"]) & (F.col("a_root") != F.col("b_root")) & once & possible("a_", "b_") & plausible("a_", "b_"))
        linker.test(found.select(*ordered("a_node", "b_node")))
    labels = settle(linker.labels, "labels")
    scratch.clear()
    return labels


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of copies and near copies."""
    texts = texts_of(docs)
    ids = settle(texts.select("doc_id", "node", "half"), "near-ids")
    distinct = settle(ids.groupBy("node").agg(F.min("half").alias("half"), F.max("half").alias("other"), F.min("doc_id").alias("least")), "distinct")
    shared = settle(distinct.where("half <> other").select("node", F.col("half").alias("own")), "shared")
    if shared.isEmpty():
        placed = ids.withColumn("own", F.col("half"))
    else:
        # Nodes of several texts: the one with the least second half is compared, the others only go with their own copies.
        placed = ids.join(if_small(shared), "node", "left").withColumn("own", F.coalesce("own", "half"))
        texts = texts.join(if_small(shared), "node", "left").where(F.coalesce(F.col("own") == F.col("half"), F.lit(True)))
        distinct = settle(placed.where("half = own").groupBy("node").agg(F.min("doc_id").alias("least")), "distinct")
    labels = near_groups(texts, distinct.select("node", "least"))
    placed = placed.join(unless_many(labels, labels.count()), "node", "left").withColumn("root", F.when(F.col("half") == F.col("own"), F.coalesce("root", "node")).otherwise(F.col("node")))
    placed = placed.withColumn("side", F.when(F.col("half") != F.col("own"), F.col("half")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "half")
    keep = placed.groupBy("root", "side").agg(F.min(rank).alias("kept")).select("kept.*").drop("none").withColumn("stays", F.lit(True))
    rows = placed.groupBy("doc_id", "node", "half").agg(F.count("*").alias("n"))
    same = lambda few, id="doc_id", node="node", half="half": (F.col(node) == few["node"]) & (F.col(half) == few["half"]) & F.col(id).eqNullSafe(few["doc_id"])
    mine = rows.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), F.col("half").alias("_half"), "n")
    counted = settle(mine.join(keep, same(keep, "_id", "_node", "_half"), "left").select(F.col("_id").alias("doc_id"), F.col("_node").alias("node"), F.col("_half").alias("half"), "n", "stays"), "kept")
    gone = settle(counted.where("stays IS NULL").select("doc_id", "node", "half"), "gone")
    again = settle(counted.where("stays AND n > 1").select("doc_id", "node", "half"), "again")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), half_of(text_column(), 0).alias("_node"), half_of(text_column(), 1).alias("_half"))
    few = if_small(gone)
    stay = held.join(few, same(few, "_id", "_node", "_half"), "left_anti")
    if again.isEmpty():
        return stay.select("_row.*")
    again = unless_many(again, again.count())
    these = same(again, "_id", "_node", "_half")
    once = stay.join(again, these, "left_semi").groupBy("_node", "_half", "_id").agg(F.first("_row").alias("_row"))
    return stay.join(again, these, "left_anti").select("_row.*").unionByName(once.select("_row.*"))
