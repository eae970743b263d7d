"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only.

Every source has a weight schedule over training time t in [0, 1], w(t) = 1 + slope * (2t - 1). Its integral
S(t) = t + slope * (t^2 - t) is the share of the source's tokens that training has asked for by time t. A source's
documents stand in a fixed pseudo-random order, are taken whole in that order, pass after pass, until the source's target
is met; the inverse of S at a document's place in that demand is the document's training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, written

#: Schedules of the sources by rank, repeating: early, even, late.
SLOPES = (-0.5, 0.0, 0.5)
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Targets of sources (source_key, source_size, weight, ...): share of the whole size is dealt out by weight, no
    source gets more than cap times its size, and what is cut off is dealt out again until nothing is.

    The fixed point is least(cap * size, weight * level) with one level for all. Sources fill up in the order of
    cap * size / weight, so the level is the first candidate, in that order, at which the next source isn't full yet.
    The table has one row per source.
    """
    fill = Window.orderBy("ratio", "rank")
    caps = sources.withColumn("cap_size", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("cap_size") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    tried = caps.withColumn(
        "candidate",
        ((F.sum("source_size").over(Window.partitionBy()) * F.lit(share)) - F.coalesce(F.sum("cap_size").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    first = F.min(F.when(F.col("candidate") <= F.col("ratio"), F.struct("ratio", "rank", "candidate"))).over(Window.partitionBy())
    level = F.col("first")["candidate"]
    return tried.withColumn("first", first).withColumn("target", F.when(level.isNull(), F.col("cap_size")).otherwise(F.least(F.col("cap_size"), F.col("weight") * level)))


def position(asked: Column, slope: Column) -> Column:
    """The time t at which S(t) = asked."""
    rest = 1 - slope
    root = (-rest + F.sqrt(F.greatest(rest * rest + 4 * slope * asked, F.lit(0.0)))) / (2 * slope)
    return F.when(slope == 0, asked).otherwise(root)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, share: float = 1.5, cap: float = 2.0, bucket_rows: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs (doc_id, source, text, others ignored): doc_id, size, source_size, target, taken, source,
    position, position_again, and the columns named by carry.

    size is the number of words (0 for null or empty texts). taken counts the words that the mix takes, repeats counted:
    the sum over a source is its target, rounded; only the document at the cut is taken in part. position is when the
    first copy is trained on, position_again when the second is (null: never). Sources rank by code point, a null source
    is a source of its own and comes last. Rows of one doc_id are dealt with as they come by size, so repeated rows give
    the same set of results on every run. An empty table gives an empty one.
    """
    ids = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = written(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("source_key"),
            ids.alias("place"),
            word_count(F.col("text")).alias("size"),
            *carry,
        )
    )
    rows = sized.count()
    buckets = 1
    while buckets < 65536 and buckets * bucket_rows < rows:
        buckets *= 2
    sized = sized.withColumn("bucket", F.shiftright(F.conv(F.substring("place", 1, 4), 16, 10).cast("int"), 16 - buckets.bit_length() + 1))

    totals = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    pick = lambda options: F.element_at(F.array(*(F.lit(x) for x in options)), (F.col("rank") % len(options) + 1).cast("int"))
    ranked = totals.withColumn("rank", rank).withColumn("weight", pick(weights)).withColumn("slope", pick(tuple(map(float, slopes))))
    targets = water_level(ranked, share, cap).select("source_key", "source_size", "target", "slope")

    # words before a document in its source's order: whole buckets before it, then rows before it in its own bucket
    parts = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("bucket_size").join(targets, "source_key")
    own = Window.partitionBy("source_key", "bucket").orderBy("place", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).join(offsets, ["source_key", "bucket"])
    start = F.col("offset") + F.col("within")
    whole = F.round("target").cast("long")
    got = lambda at: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - at))
    first, second = got(start), got(start + F.col("source_size"))
    at = lambda begun, n: F.when(F.col("target") > 0, position(F.least(F.lit(1.0), (begun + n / 2) / F.col("target")), F.col("slope"))).otherwise(F.lit(0.0))
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (first + second).alias("taken"),
        "source",
        F.when((first > 0) | (F.col("size") == 0), at(start, first)).alias("position"),
        F.when(second > 0, at(start + F.col("source_size"), second)).alias("position_again"),
        *carry,
    ).orderBy("position", "doc_id")


def mixed(docs: DataFrame, in_order: bool = True, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns and their training_position, each as often as it is taken;
    range-sorted by training_position, then doc_id, unless in_order is false.

    A document that the mix takes in part is taken whole; one without words is taken once. Repeated rows are placed one
    by one. A column of docs that is called training_position gives way to the mix's. An empty table gives an empty one.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    source = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))
    places = mix(docs.select("doc_id", "source", "text", text.alias("t")), carry=("t",), **options)
    lists = places.groupBy(F.col("doc_id").alias("placed_id"), F.col("t").alias("placed_t")).agg(
        F.sort_array(F.collect_list(F.struct(source("source").alias("source"), F.array_compact(F.array("position", "position_again")).alias("at")))).alias("places")
    )
    names = [c for c in docs.columns if c != "training_position"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").alias("id"), text.alias("t"), source("source").alias("key"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "t").orderBy("key")))
    joined = rows.join(lists, F.col("id").eqNullSafe(F.col("placed_id")) & (F.col("t") == F.col("placed_t")))
    taken = joined.select("row", F.explode(F.element_at("places", F.col("n"))["at"]).alias("training_position")).select("row.*", "training_position")
    return taken.orderBy("training_position", "doc_id") if in_order else taken
