"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only).

Each source's documents are put in a fixed random order and cut into blocks of equally many
words. Golden-ratio points, mapped through the cumulative targets, say which source each place
of the mix is drawn from; a place's rank within its source says which block it takes. A source
that is drawn beyond its last block starts again, three times at most.

The schedule has about ``slots`` places whatever the size of the corpus (the blocks grow), so it
and the table of blocks are bounded and may be broadcast. A source for which a block of several
words is coarse (its size or its target is under ``FEW`` blocks) is settled to the word instead: the
whole passes that its target holds, and the rest of it from the start of its order, which is what
the schedule comes to as its blocks get small. Documents are ordered by a hash within
4096 buckets a source, so a source that holds a third of all rows is sorted by many tasks.

Defined results: a null text has no words, a document without words is taken 0 times, a null
source is a source of its own and comes last, equal rows are documents of their own, an empty
table gives no rows, a very long text lies in many blocks. Reruns agree. Sources themselves are put in order by one
task, a row each; tables of more than ``MAX_SOURCES`` are joined by a shuffle, in which no block holds
more than its share of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, count_words, materialise

WEIGHTS = (5, 2, 1)
MOST = 3
SLOTS = 65536
#: A source of fewer blocks than this, by size or target, is settled to the word.
FEW = 256
CHUNK = 1024
#: Up to so many sources are broadcast.
MAX_SOURCES = 200_000
GOLDEN = 0.6180339887498949
SEED = "mix-1"


def _key() -> Column:
    """The source as a key that is never null."""
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))


def _placed(docs: DataFrame) -> DataFrame:
    order = F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    return docs.withColumns({"size": count_words(F.col("text"), WHITE)}).withColumns({"source_key": _key(), "mix_order": order, "bucket": F.substring(order, 1, 3)})


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source_key, source_size -> also sid (from 0), weight, target, reach (sum of targets before).

    Water-filling: in the order of size over weight, a source is full if its share of what the
    earlier ones leave exceeds ``most`` times its size. One row per source.
    """
    by_name = Window.orderBy(F.col("source_key").startswith("-"), "source_key")
    nth = F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1)
    df = totals.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", nth.cast("long"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * most
    df = df.withColumns({"total": F.sum("source_size").over(every), "weights": F.sum("weight").over(every), "cap_before": F.coalesce(F.sum(cap).over(fill), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(fill), F.lit(0))})
    df = df.withColumn("full", (F.col("total") - F.col("cap_before")) * F.col("weight") > cap * (F.col("weights") - F.col("weight_before")))
    full_cap = F.sum(F.when(F.col("full"), cap).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    df = df.withColumns({"full_cap": full_cap, "open_weight": open_weight})
    share = (F.col("weight") * (F.col("total") - F.col("full_cap"))).cast("double") / F.col("open_weight").cast("double")
    df = df.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(share))
    return df.withColumn("reach", F.coalesce(F.sum("target").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("source_key", "sid", "source_size", "target", "reach", "total")


def schedule(sources: DataFrame, block: int, total: int) -> DataFrame:
    """place, sid, rank: which source each place of the mix draws, and for which time."""
    spark = sources.sparkSession
    places = spark.range(-(-total // block)).select(F.col("id").alias("place"), ((F.col("id") * GOLDEN) % 1.0 * total).alias("at"), F.lit(None).cast("int").alias("own"))
    edges = sources.where("target > 0").select(F.lit(-1).cast("long").alias("place"), F.col("reach").alias("at"), F.col("sid").alias("own"))
    both = places.unionByName(edges)
    sid = F.last("own", ignorenulls=True).over(Window.orderBy("at", "place", "own"))
    drawn = both.withColumn("sid", sid).where("place >= 0").select("place", "sid", F.floor(F.col("place") / CHUNK).alias("chunk"))
    # A source's places are ranked chunk by chunk, as one source may hold most of the schedule.
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("place")) - 1
    return drawn.withColumn("nth", nth).join(first.hint("merge"), ["sid", "chunk"]).select("place", "sid", (F.col("first") + F.col("nth")).alias("rank"))


def blocks(sources: DataFrame, plan: DataFrame, block: int, most: int = MOST) -> DataFrame:
    """sid, block, uses, taken_before: how often the schedule takes each block of each source."""
    n = F.ceil(F.col("source_size") / block).cast("long")
    every = sources.where("source_size > 0").select("sid", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    counted = sources.where("source_size > 0").select("sid", n.alias("n"))
    uses = plan.join(counted, "sid").where(F.col("rank") < most * F.col("n")).groupBy("sid", (F.col("rank") % F.col("n")).alias("block")).agg(F.count("*").alias("uses"))
    long = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    df = every.join(uses, ["sid", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    df = df.select("sid", "block", "uses", (F.col("uses") * long).alias("words"), F.floor(F.col("block") / CHUNK).alias("chunk"))
    # Running sums chunk by chunk, as one source may hold most of the blocks.
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy("sid", "chunk").agg(F.sum("words").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("sid", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("own", F.coalesce(F.sum("words").over(inner), F.lit(0))).join(first.hint("merge"), ["sid", "chunk"])
    return df.select("sid", "block", "uses", (F.col("first") + F.col("own")).alias("taken_before"))


def mix(docs: DataFrame, keep: tuple[str, ...] = (), slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, sid and mix_at (its place in the
    order of its source, in words), besides the columns named in ``keep``.

    taken counts the words of the document in the mix, each repeat again.
    """
    rows = _placed(docs.select(*dict.fromkeys(["doc_id", "text", "source", *keep])))
    narrow = ["doc_id", "source_key", "bucket", "mix_order", "size"]
    kept = materialise(rows.select(*narrow), "mix_sizes")
    sums = kept.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    sums = materialise(sums, "mix_sums")
    sources = materialise(targets(sums.groupBy("source_key").agg(F.sum("words").alias("source_size"))), "mix_targets")
    total = (sources.agg(F.max("total")).first()[0]) or 0
    block = max(1, -(-total // slots))
    cut = materialise(blocks(sources, schedule(sources, block, total), block), "mix_blocks")  # slots rows and one per source
    few = sources.count() <= MAX_SOURCES
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("bucket_at", F.coalesce(F.sum("words").over(before), F.lit(0))).join(sources, "source_key").drop("words", "total", "reach")
    inner = Window.partitionBy("source_key", "bucket").orderBy("mix_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.select(*narrow, *[c for c in keep if c not in narrow]) if keep else kept).withColumn("upto", F.sum("size").over(inner))
    df = placed.join(offsets.hint("merge"), ["source_key", "bucket"]).withColumn("mix_at", F.col("bucket_at") + F.col("upto") - F.col("size"))
    last = F.ceil(F.col("source_size") / block).cast("long") - 1

    coarse = F.lit(block > 1) & (F.least(F.col("source_size").cast("double"), F.col("target")) < FEW * block)
    whole = F.round("target").cast("long")
    passes = F.floor(whole / F.col("source_size")).cast("long")
    rest = whole - passes * F.col("source_size")

    def with_taken(df: DataFrame, at: Column, name: str) -> DataFrame:
        side = cut.select(F.col("sid").alias("cut_sid"), F.col("block").alias("cut_block"), "uses", "taken_before")
        df = df.withColumn("cut_at", at).withColumn("on", F.least(F.floor(F.col("cut_at") / block).cast("long"), last))
        same = (F.col("sid") == F.col("cut_sid")) & (F.col("on") == F.col("cut_block")) & (F.col("size") > 0)
        df = df.join(F.broadcast(side) if few else side.hint("merge"), same, "left")
        upto = F.col("taken_before") + F.col("uses") * (F.col("cut_at") - F.col("on") * block)
        upto = F.when(coarse, passes * F.col("cut_at") + F.least(F.col("cut_at"), rest)).otherwise(upto)
        return df.withColumn(name, F.coalesce(upto, F.lit(0))).drop("cut_sid", "cut_block", "uses", "taken_before", "cut_at", "on")

    df = with_taken(df, F.col("mix_at"), "taken_from")
    df = with_taken(df, F.col("mix_at") + F.col("size"), "taken_to")
    return df.select("doc_id", *[c for c in keep if c != "doc_id"], "size", "source_size", "target", (F.col("taken_to") - F.col("taken_from")).cast("long").alias("taken"), "sid", "mix_at")
