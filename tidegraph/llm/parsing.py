"""Document fingerprints by locally consistent parsing.

A level parses a sequence of names into phrases: runs of one name are merged, deterministic coin tossing (the lowest bit in
which a name differs from its left neighbour, four times over) leaves labels below six with no two equal neighbours, and a
phrase starts at each local maximum of the labels. A phrase's name is a hash of the names in it, so that equal substrings
get equal names away from their edges, wherever they stand. The first level parses code points; levels are built until a text is
one phrase, its top.

The fingerprint has, for each level from FIRST to the top, how many names it has and the smallest of them (32 bits; second and
later occurrences count as names of their own): KEEP, or one in RATE if that is more, so that a long text has the more names and a
passage that two long texts share stays visible. Likeness is the share of names in common of both texts' names on all levels
together, estimated on each level from the names below the smaller of the two bounds.

All texts of a batch are parsed at once as one array; texts above CHARS code points in sum are taken in turn.

Edge cases: null text: empty; the empty text has the empty fingerprint, like itself (1.0) and unlike all others. Texts of one
code point are one phrase. Documents are ordered by descending doc_id, null last, rows of one id by their place in the table; repeated
rows follow each other. A single document is its own next. An empty table gives no rows; further columns are ignored; very
long texts are parsed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shipping import ship_by_value
from .common import limit_batches, map_batches, table, text_column

FIRST, KEEP, RATE, CHARS = 2, 48, 64, 1 << 20
A, B, C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * A
    x = (x ^ (x >> np.uint64(27))) * B
    return x ^ (x >> np.uint64(31))


def toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a label differs from its left neighbour, plus that bit; at the start of a text bit 0."""
    one = labels.dtype.type(1)
    other = np.empty_like(labels)
    other[1:] = labels[:-1]
    other[first] = labels[first] ^ one
    other ^= labels
    place = np.bitwise_count((other & (~other + one)) - one)
    return place * np.uint8(2) + ((labels >> place.astype(labels.dtype)) & one).astype(np.uint8)


def parse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of phrases and where texts start among them. Every text has one name at least."""
    first = np.zeros(len(names), bool)
    first[starts] = True
    fresh = first.copy()
    fresh[1:] |= names[1:] != names[:-1]
    heads = np.flatnonzero(fresh)
    if len(heads) < len(names):
        lengths = np.diff(heads, append=len(names))
        names, first = names[heads], first[heads]
        runs = lengths > 1
        names[runs] = mix(names[runs] + lengths[runs].astype(np.uint64) * C)
    starts = np.flatnonzero(first)
    labels = names
    for _ in range(4):
        labels = toss(labels, starts)
    cut = first.copy()
    cut[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:] & ~first[1:-1]
    cuts = np.flatnonzero(cut)
    lengths = np.diff(cuts, append=len(names))
    places = np.arange(len(names)) - np.repeat(cuts, lengths)
    sums = np.add.reduceat(mix(names + (places.astype(np.uint64) + np.uint64(1)) * C), cuts)
    return mix(sums ^ lengths.astype(np.uint64)), np.searchsorted(cuts, starts)


def sketches(texts: list[str]) -> list[list[tuple[int, np.ndarray]]]:
    """The fingerprint of each text: of each level its number of names and the smallest ones, sorted."""
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    some, total = [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        if some and total + len(text) > CHARS:
            _sketch(texts, some, out)
            some, total = [], 0
        some.append(k)
        total += len(text)
    if some:
        _sketch(texts, some, out)
    return out


def _sketch(texts: list[str], some: list[int], out: list[list[tuple[int, np.ndarray]]]) -> None:
    names = np.frombuffer("".join([texts[k] for k in some]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(texts[k]) for k in some])
    starts = np.cumsum(sizes) - sizes
    who = np.array(some)
    level = 0
    while len(who):
        names, starts = parse(names, starts)
        level += 1
        counts = np.diff(starts, append=len(names))
        if level >= FIRST:
            keys = distinct_names(names, np.repeat(np.arange(len(who), dtype=np.uint64), counts))
            edges = np.searchsorted(keys, np.arange(len(who) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
            least = (keys & np.uint64(0xFFFFFFFF)).astype(">u4")
            for k, a, b in zip(who.tolist(), edges, edges[1:], strict=False):
                out[k].append((b - a, least[a : min(b, a + max(KEEP, (b - a) // RATE))]))
        more = counts > 1
        if level >= FIRST and not more.all():
            # Texts that are one phrase are done.
            who, kept = who[more], np.repeat(more, counts)
            names, starts = names[kept], np.cumsum(counts[more]) - counts[more]


def distinct_names(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sorted owner << 32 | name, the second and later occurrences of a name in a text counting as names of their own."""
    keys = np.sort(owner << np.uint64(32) | names >> np.uint64(32))
    again = np.arange(len(keys)) - np.maximum.accumulate(np.where(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0, np.arange(len(keys)), 0))
    more = again > 0
    low = np.uint64(0xFFFFFFFF)
    keys[more] = (keys[more] & ~low) | (mix((keys[more] & low) + again[more].astype(np.uint64) * C) >> np.uint64(32))
    return np.unique(keys)


def likeness(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]]) -> float:
    """The share of names in common, of both fingerprints' numbers of names together."""
    if not a or not b:
        return float(len(a) == len(b))
    common = 0.0
    for (n, x), (m, y) in zip(a, b, strict=False):
        bound = min(int(z[-1]) if len(z) < count else 1 << 32 for count, z in ((n, x), (m, y)))
        p, q = set(x[x <= bound].tolist()), set(y[y <= bound].tolist())
        j = len(p & q) / max(1, len(p | q))
        common += min(n, m, (n + m) * j / (1 + j))
    return 2 * common / (sum(n for n, _ in a) + sum(m for m, _ in b))


def hexed(sketch: list[tuple[int, np.ndarray]]) -> str:
    """Levels joined by dots: number of names, colon, the names kept."""
    return ".".join(f"{n:x}:{names.tobytes().hex()}" for n, names in sketch)


def edit(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of what follows."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def answer(ids: list, texts: list[str]) -> list[pa.Array]:
    """Columns of SCHEMA for all texts but the last, each followed by the next."""
    edited = [edit(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    marks, changed = sketches(texts), sketches(edited)
    columns = (
        ids[: len(edited)],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        [hexed(m) for m in marks[:-1]],
        [hexed(m) for m in changed],
        [likeness(a, b) for a, b in zip(marks, changed, strict=False)],
        [likeness(a, b) for a, b in zip(marks, marks[1:], strict=False)],
    )
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def compare_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for doc_id, text.

    Documents are dealt to ranges of ids, rows of one id or none by their place too, so that they may be split. Each range
    answers for its rows but the last, whose next is the first of the following range: of these two rows of each range a small
    second step makes the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row before, which waits for its next
        for batch in batches:
            rows = [*held, *zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if len(rows) > 1:
                ids, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(answer(ids, list(texts)), NAMES)
            held = rows[-1:]

    def last(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [answer([i], [a, b]) for i, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*rows, strict=True)], NAMES)

    ship_by_value()
    limit_batches(docs.sparkSession)
    count = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("place")]
    ranges = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")).repartitionByRange(count, *order)
    inside = ranges.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SCHEMA)
    # First and last row of each range, from the same shuffle. They are ordered by the ranges' numbers, texts are joined to them.
    place = F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.col("place"))
    ends = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.max_by("text", place).alias("next"), F.min_by(F.struct("doc_id", "text"), place).alias("last"))
    following = ends.where("next IS NOT NULL").select("part", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())).alias("before"))
    firsts = ends.select("part", "next").join(following, "part").select(F.col("before").alias("part"), "next")
    open_rows = ends.select("part", "last.*").join(firsts, "part").select("doc_id", "text", "next")
    return inside.unionByName(map_batches(open_rows, last, SCHEMA))


def op3_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")))
