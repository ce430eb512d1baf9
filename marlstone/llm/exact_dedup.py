"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Every row falls into a run by a hash of its id; there are FAN^2 runs or more, about one for RUN_ROWS rows. Within a run, rows of one digest collapse to their smallest
identifier and their count (the leaf level). Runs then meet in binomial rounds: a round of fan-in FAN takes runs r with
the same r // FAN together, each partition keeping the digests that hash to it, merging the sorted runs and retaining
the smallest identifier of each digest. After as many rounds as FAN has powers in their number one run is left, the groups of the whole table. On
the way back a leaf asks for its group's identifier, and a row asks its leaf, so that a group that holds a third of the
table is met by a row a run and never by all its members in one task.

A digest is verified: rows merge only where SHA-256, a second independent 64-bit hash and the byte length of the
normalised text all agree.

Defined results: a null text counts as empty; rows of a null doc_id come last in their group (they stay only if all ids
of the group are null); of rows that repeat a doc_id within a group one stays; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ROW_KEY, SPACE, row_key, rows_kept, staged

FAN = 8
RUN_ROWS = 1 << 20


def runs_for(rows: int) -> int:
    """A power of FAN, at least the second."""
    width = FAN * FAN
    while width * RUN_ROWS < rows:
        width *= FAN
    return width


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, row number, row key, digest, check hash, length, run."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), *row_key(id_col, text_col))
    return rows.select(
        "doc_id",
        *ROW_KEY,
        F.monotonically_increasing_id().alias("rid"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").alias("n_bytes"),
        F.pmod(F.xxhash64("doc_id", "ktext"), F.lit(runs)).cast("int").alias("run"),
    )


KEY = ("digest", "check", "n_bytes")


def tree_merge(runs: DataFrame, width: int) -> DataFrame:
    """runs (width of them): run, KEY, best struct(missing, doc_id, rid), n. One row per digest: the best of all runs and the summed n."""
    while width > 1:
        width = -(-width // FAN)
        runs = (
            runs.withColumn("run", (F.col("run") / FAN).cast("int"))
            .groupBy("run", *KEY)
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
            .sortWithinPartitions("run", "digest")
        )
    return runs.drop("run")


def groups(rows: DataFrame, runs: int) -> DataFrame:
    """rows: of digests(). Adds keep_id, keep_rid and group_size; every row stays."""
    best = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("rid"))
    leaves = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    whole = tree_merge(leaves, runs).select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), F.col("n").alias("group_size"))
    known = leaves.select("run", *KEY).join(whole, list(KEY))
    return rows.join(known, ["run", *KEY])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    runs = runs_for(docs.count())
    out = groups(staged(digests(docs, runs, id_col, text_col), "digests"), runs)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Only their keys are staged; the texts move once."""
    runs = runs_for(docs.count())
    kept = groups(staged(digests(docs, runs, id_col, text_col), "digests"), runs).where("rid = keep_rid")
    return rows_kept(docs, kept, id_col, text_col)
