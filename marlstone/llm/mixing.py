"""Mixing sources to target weights, in DataFrame operations only.

1. A source's documents, in a fixed pseudorandom order, form one stream of words, cut into blocks of BLOCK words.
2. Targets: the sources in code point order (null last) weigh WEIGHTS, repeating, and share the sum of all sizes; no
   source gets over MAX_EPOCHS times its size, and what that leaves is shared again by weight (water level, closed form).
3. Output shards have SHARD_SLOTS slots. Their source counts are multinomial draws, conditioned on the sources' totals
   so that the whole mix meets the targets: all slots lie in an urn, and a pseudorandom permutation deals them to shards.
4. Slot j of a source is epoch j // n, place j % n; the place goes through a pseudorandom permutation of the source's n
   block indices (one per source and epoch), and the block is joined by its index.

The permutation is a swap-or-not shuffle: for any n, a round pairs x with (k - x) mod n and a hash of the pair decides
whether they swap. It needs no sort, so a source that holds a third of all rows is no group in any one task. Offsets
are two-level prefix sums over hashed buckets for the same reason. Everything follows from SEED: reruns agree.

Defined results: a null text has size 0 and takes 0; null sources are one source, the last; repeated rows each have
their place in the stream; a null doc_id is a row like others; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ROW_KEY, WORD, column, groups_for, row_key, row_order, staged, words_col

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 64
SHARD_SLOTS = 4096
#: Offsets are summed in buckets of about so many rows, at least BUCKETS of them.
BUCKETS, BUCKET_ROWS = 256, 1 << 17
CHUNK = 1 << 14
#: Slots to a task.
TASK_SLOTS = 1 << 16
ROUNDS = 10
SEED = 20240


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The image of x in a pseudorandom permutation of 0..n-1 that key selects."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - at, n)
        return F.when(F.xxhash64(F.lit(SEED + 1), r, F.greatest(at, other), *key).bitwiseAND(1) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def running_start(rows: DataFrame, group: list[str], order: list[Column], value: str, bucket: Column) -> DataFrame:
    """Adds start: the sum of value over the rows before, in the order of bucket and then order, within group."""
    rows = rows.withColumn("bucket", bucket)
    inner = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*group, "bucket").agg(F.sum(value).alias("total")).withColumn("base", F.coalesce(F.sum("total").over(outer), F.lit(0))).drop("total")
    rows = rows.withColumn("within", F.sum(value).over(inner) - F.col(value))
    return rows.join(base, [*group, "bucket"]).withColumn("start", F.col("within") + F.col("base")).drop("within", "base", "bucket")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: skey, source, size. One row per source: skey, source_size, target, blocks, slots, first slot in the urn."""
    by_source = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").isNull(), "source")
    by_source = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(place) - 1) % len(WEIGHTS) + 1).cast("int")))
    cap = F.col("source_size") * MAX_EPOCHS
    ratio = Window.orderBy(cap / F.col("weight"), "skey")
    below, rest, whole = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The water level if this source and all of larger ratio are not capped; the first source that lies above it fixes it.
    by_source = by_source.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(below), F.lit(0))) / F.sum("weight").over(rest))
    by_source = by_source.withColumn("level", F.min(F.when(cap / F.col("weight") >= F.col("level"), F.struct(cap / F.col("weight"), "level"))).over(whole)["level"])
    by_source = by_source.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("level"))).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    slots = F.when(F.col("source_size") > 0, F.least(F.col("blocks") * MAX_EPOCHS, F.round(F.col("target") * F.col("blocks") / F.col("source_size")))).otherwise(0).cast("long")
    before = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    return (
        by_source.withColumn("slots", slots)
        .withColumn("urn", F.coalesce(F.sum("slots").over(before), F.lit(0)))
        .withColumn("all_slots", F.sum("slots").over(whole))
        .select("skey", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "blocks", "slots", "urn", "all_slots")
    )


def spread(rows: DataFrame, n: Column, total: int) -> DataFrame:
    """Each row n times (total in all) with j from 0; long runs go through chunks that are dealt out to tasks first."""
    chunks = rows.withColumn("n_", n).where("n_ > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_") - 1) / CHUNK))))
    chunks = chunks.repartition(groups_for(total, TASK_SLOTS), F.xxhash64(*[c for c in ("skey", "shard") if c in rows.columns], F.col("chunk")))
    last = F.least(F.col("n_"), (F.col("chunk") + 1) * CHUNK) - 1
    return chunks.withColumn("j", F.explode(F.sequence(F.col("chunk") * CHUNK, last))).drop("chunk", "n_")


def slot_plan(targets: DataFrame) -> DataFrame:
    """skey, shard, slot j of the source, block: which block each output slot takes."""
    total = targets.agg(F.sum("slots")).first()[0] or 0
    dealt = spread(targets.select("skey", "slots", "urn", "all_slots"), F.col("slots"), total)
    dealt = dealt.withColumn("shard", F.floor(permuted(F.col("urn") + F.col("j"), F.col("all_slots"), F.lit(0)) / SHARD_SLOTS))
    counts = dealt.groupBy("skey", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = running_start(counts, ["skey"], [F.col("shard")], "n", F.floor(F.col("shard") / 1024)).join(targets.select("skey", "blocks"), "skey")
    slots = spread(counts, F.col("n"), total).withColumn("j", F.col("start") + F.col("j"))
    epoch = F.floor(F.col("j") / F.col("blocks"))
    return slots.select("skey", "shard", "j", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("skey"), epoch).alias("block"))


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit(0)).otherwise(F.xxhash64(source)).cast("long")


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents with size and place in their source's stream, sources with targets); both are staged."""
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("doc_id"),
        source.alias("source"),
        source_key(source).alias("skey"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        *row_key(id_col, text_col),
    )
    rows = staged(rows, "sizes")
    targets = staged(source_targets(rows), "targets")
    slim = running_start(rows.drop("source"), ["skey"], [F.col("doc_id"), F.col("size"), F.col("ktext"), F.col("rid")], "size", F.pmod(F.xxhash64("doc_id", "ktext"), F.lit(max(BUCKETS, rows.count() // BUCKET_ROWS))))
    return slim.join(targets.select("skey", "source_size", "target"), "skey"), targets


def pieces(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (rid, skey, start, size): a row for each block that a document meets, with at, words and times taken."""
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    met = rows.where("size > 0").select("rid", "skey", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    taken = plan.groupBy("skey", "block").agg(F.count(F.lit(1)).alias("times"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    at = F.greatest(F.col("start"), F.col("block") * BLOCK)
    return met.join(taken, ["skey", "block"]).select("rid", (at - F.col("start")).cast("int").alias("at"), (end - at).cast("int").alias("words"), F.col("times").cast("int").alias("times"))


def mix_counts(docs: DataFrame, **cols: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted): one row per row of docs."""
    rows, targets = placed(docs, **cols)
    taken = pieces(rows, slot_plan(targets)).groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return rows.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents, with the columns of docs: a text holds the blocks' words that the mix takes, epoch after epoch.

    A document that is taken whole and once keeps its text as it is; one of which nothing is taken goes. Rows alike in
    id, text and source have their own places; in the order of their other columns they get these places' blocks.
    """
    rows, targets = placed(docs, id_col, text_col, source_col)
    part = pieces(rows, slot_plan(targets)).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "words", "times"))).alias("parts"))
    alike = Window.partitionBy("skey", *ROW_KEY)
    mine = rows.select("rid", "skey", "start", "size", *ROW_KEY).withColumn("nth", F.row_number().over(alike.orderBy("start", "rid"))).join(part, "rid").drop("rid", "start")
    whole = docs.select(F.struct(*map(column, docs.columns)).alias("row"), source_key(F.col(source_col).cast("string")).alias("skey"), *row_key(id_col, text_col), row_order(docs, text_col).alias("korder"))
    whole = whole.withColumn("nth", F.row_number().over(alike.orderBy("korder"))).join(mine, ["skey", *ROW_KEY, "nth"])
    whole = whole.select("row", "size", "parts").withColumn("all", words_col(F.col("row")[text_col]))
    epoch = lambda e: F.flatten(F.transform(F.filter("parts", lambda p: p["times"] > e), lambda p: F.slice(F.col("all"), p["at"] + 1, p["words"])))
    as_is = F.forall("parts", lambda p: p["times"] == 1) & (F.aggregate("parts", F.lit(0), lambda s, p: s + p["words"]) == F.col("size"))
    text = F.when(as_is, F.col("row")[text_col]).otherwise(F.array_join(F.flatten(F.array(*[epoch(e) for e in range(MAX_EPOCHS)])), " "))
    return whole.withColumn("mixed", text).select(*[(F.col("mixed") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
