"""Mixing sources to target weights: capped water-filling.

Each source asks for its share of the mix by weight; sources that would be repeated more than max_epochs times are clamped
there, and what is left is shared by weight among the others, until no source is above its cap. A source then takes its
documents floor(target / size) times whole, and once more those that come first in a seeded order, until the target is met.

Nothing is collected but sums: the rounds of water-filling are aggregates over the table of sources (a row per source, which are
ordered in one task to get their weights); the seeded order is a prefix of md5 over 4096 buckets, and only the bucket in which a
source reaches its target is ordered. The order hashes id and text, so that rows without ids are spread too. Rows that agree in
both are interchangeable: they are counted per partition and taken by number, so that no group of them is gathered.

Edge cases: null text: size 0, taken 0. Null source: a source of its own, last. Null doc_id: a row like others, hashed as
empty. Repeated rows are taken each for itself. Sources of size 0: target 0. An empty table gives no rows. Very long texts only
count their words and are hashed. Further columns stay in mix_documents, which takes whole texts: a source ends within half a
document of its target, with null, equal or repeated ids as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Hexadecimal digits of the order's buckets: 4096 of them.
DIGITS = 3


def order(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, at: what mixing needs of a document; at is its place in the seeded order."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), order(F.col("doc_id"), F.col("text")).alias("at"))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds target to sources with size and weight. Each round is one aggregate; a clamped source stays clamped."""
    level, clamped, cap = None, -1, F.col("size") * F.lit(float(max_epochs))
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum("size").alias("all"), F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == clamped or not row["open"]:
            break
        clamped, level = row["n"], (share * row["all"] - (row["held"] or 0.0)) / row["open"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if level is not None else cap)


def weigh(totals: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """Weights by the place of the source in code-point order, null last; one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return totals.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place % len(weights)))


def named(source: Column) -> Column:
    """A join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def plan_mix(slim: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows of sizes(): the rows with key and bucket, the sources, and the groups of the buckets in which a source meets its target.

    Sources have source_size, target, whole (repetitions of all documents), rest (words still missing after them) and the
    bucket in which rest is reached. Groups are rows of that bucket with one id and text in one partition, n of them, with
    start, the words that come before them in the seeded order.
    """
    slim = settle(slim.withColumn("key", named(F.col("source"))).withColumn("bucket", F.substring("at", 1, DIGITS)), "sizes")
    parts = settle(slim.groupBy("key", "source", "bucket").agg(F.sum("size").alias("size")), "parts")
    sources = settle(weigh(parts.groupBy("key", "source").agg(F.sum("size").alias("size"))), "sources")
    goal = water_fill(sources).select("key", F.col("size").alias("source_size"), "target")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5)).cast("long"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = parts.withColumn("before", before).join(goal, "key").where(F.col("before") < F.col("rest"))
    last = reached.groupBy("key").agg(F.max(F.struct("bucket", "before")).alias("last"))
    goal = settle(goal.join(last, "key", "left").select("key", "source_size", "target", "whole", "rest", F.col("last.bucket").alias("last"), F.col("last.before").alias("before")), "goal")
    inner = Window.partitionBy("key").orderBy("at", "doc_id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    groups = slim.join(goal, "key").where(F.col("bucket") == F.col("last")).groupBy("key", "source", "at", "doc_id", "size", F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    inside = groups.join(goal, "key").withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inner), F.lit(0)) + F.col("before"))
    return slim, goal, inside


def taken_words(slim: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; the document in which a source meets its target gives only the words still missing."""
    slim, goal, inside = plan_mix(slim)
    each = inside.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    each = each.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("k") * F.col("size"))))
    outside = slim.join(goal, "key").where(F.coalesce(F.col("bucket") != F.col("last"), F.lit(True))).withColumn("more", F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(0))
    both = [rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken")) for rows in (each, outside)]
    return both[0].unionByName(both[1])


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as the mix takes it, columns as they were. Texts stay whole: the document
    in which a source meets its target is taken or not, whichever is nearer.

    Texts aren't shuffled: a row finds its own place in the order and needs only the plan of its source, a table that Spark
    broadcasts or not by its size on disk. Only the rows at the very place where a source meets its target, which agree in id and
    text, are grouped, by all their columns and their partition, and taken by number.
    """
    _, goal, inside = plan_mix(sizes(docs))
    edge = inside.where(F.col("start") < F.col("rest")).groupBy("key").agg(F.max("at").alias("at"))
    spot = inside.join(edge, ["key", "at"]).groupBy("key", "at").agg(F.min("start").alias("start"), F.max("size").alias("size"), F.max("rest").alias("rest"), F.sum("n").alias("n"))
    # Of the rows at the edge, as many as bring the source nearest to its target.
    quota = F.least(F.col("n"), F.floor((F.col("rest") - F.col("start")) / F.greatest("size", F.lit(1)) + F.lit(0.5)).cast("long"))
    plan = settle(goal.join(spot.select("key", F.col("at").alias("edge"), quota.alias("quota")), "key", "left").select("key", "whole", "edge", "quota"), "mix")
    row = F.struct(*[docs[c] for c in docs.columns])
    mine = docs.select(named(F.col("source").cast("string")).alias("key"), order(F.col("doc_id"), F.col("text")).alias("at"), row.alias("row")).join(plan, "key")
    times = F.col("whole").cast("int") + F.when(F.col("at") < F.col("edge"), 1).otherwise(0)
    sure = mine.where(F.coalesce(F.col("at") != F.col("edge"), F.lit(True))).select("row", F.explode(F.array_repeat(F.lit(0), times)))
    groups = mine.where(F.col("at") == F.col("edge")).groupBy("key", F.xxhash64("row").alias("hash"), F.spark_partition_id().alias("part")).agg(F.first("row").alias("row"), F.first("whole").alias("whole"), F.first("quota").alias("quota"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("hash", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - before))
    split = groups.withColumn("times", (F.col("whole") * F.col("n") + more).cast("int")).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return sure.select("row.*").unionByName(split.select("row.*"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(sizes(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS hashed,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), o AS (
  SELECT *, CAST(sum(2 * source_size) OVER w - 2 * source_size AS DOUBLE) AS held, CAST(sum(weight) OVER (ORDER BY source_size * 2.0 / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS open,
    sum(source_size) OVER () AS total
  FROM s WINDOW w AS (ORDER BY source_size * 2.0 / weight ASC, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT max(CASE WHEN 2.0 * source_size > weight * ((1.5 * total - held) / open) THEN (1.5 * total - held) / open END) AS level FROM o
), g AS (
  SELECT source, source_size, least(2.0 * source_size, weight * coalesce(level, 1e300)) AS target FROM s, l
), h AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g
), c AS (
  SELECT d.*, source_size, target, whole, floor(target - whole * source_size + 0.5)
    - (sum(size) OVER (PARTITION BY d.source ORDER BY hashed, doc_id, size ROWS UNBOUNDED PRECEDING) - size) AS missing
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(whole * size + greatest(0, least(size, missing)) AS BIGINT) AS taken FROM c
"""
