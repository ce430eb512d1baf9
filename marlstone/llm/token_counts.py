"""Token counts from a digest cache.

A text's count depends on its normalised content and on the tokenizer's version alone. The cache is a folder of Parquet
files in storage that the cluster shares, tokenizer=<version digest>/run=<id>/: content digest (SHA-256) and count.
Documents are reduced to digests; digests that the cache lacks are misses; of each distinct miss one text is encoded, and
its count is appended in a run folder of its own. Counts then come back by a join of digests. Every row of the cache is
right by itself, so a run that was cut short, or two at a time, do no harm: the rows that are there are used, and a digest
that stands there twice is read once.

Where the misses are few (MOST_SMALL digests at most, counted) they are broadcast and only their texts move; else texts
move once, after equal ones met within a partition. Copies that make up much of the table are one text a partition there,
and short rows in the join at the end, whose crowded partitions adaptive execution splits.

Normalised content: null is empty; for a SentencePiece model that takes texts as they are, U+2581 is a space, which it
reads alike. Long texts are encoded in parts, see _vocabulary.py.

Defined results: null and repeated doc_ids and repeated rows pass through, a row in and a row out; a null or empty text
has 0 bytes and no token; an empty table gives no rows; the size of a text is bounded by a worker's memory (some 10 bytes a byte).
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import union_all
from ._common import stage_root, staged, text_bytes
from ._vocabulary import BLANK, counter, plain_pieces, texts_of, version

LIMIT = 4096
#: Digests that may be broadcast: 32 bytes each.
MOST_SMALL = 1 << 20
CACHE_DDL = "digest binary, n_tokens long"


def normalised(text: Column, tokenizer: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.replace(text, F.lit(BLANK), F.lit(" ")) if tokenizer.endswith(".model") and plain_pieces(tokenizer) else text


def stored(spark: SparkSession, cache: str, of: str) -> DataFrame | None:
    """The cache's rows for a tokenizer's version, one a digest; None if it has no run yet."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={of}/run=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if not found:
        return None
    return spark.read.schema(CACHE_DDL).parquet(*[str(x.getPath()) for x in found]).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """digest, text to digest, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(count, texts_of(b.column(1))), type=pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(run, CACHE_DDL)


def counts_of(keyed: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """keyed: digest and normalised text of rows. digest, n_tokens of each distinct digest; those that the cache lacked are
    encoded and appended to it."""
    spark, of = keyed.sparkSession, version(tokenizer)
    known = stored(spark, cache, of)
    texts = keyed.select("digest", "norm")
    one_each = lambda rows: rows.groupBy("digest").agg(F.first("norm").alias("norm"))
    if known is not None:
        asked = keyed.select("digest").distinct().join(known, "digest", "left")
        asked = staged(asked, "asked")
        misses = asked.where("n_tokens is null").select("digest")
        few = misses.limit(MOST_SMALL + 1).count() <= MOST_SMALL
        texts = one_each(texts.join(F.broadcast(misses), "digest", "left_semi")) if few else one_each(texts).join(misses, "digest", "left_semi")
    else:
        texts = one_each(texts)
    path = f"{cache}/tokenizer={of}/run={uuid.uuid4().hex}"
    encoded(texts, tokenizer).write.parquet(path)
    new = spark.read.schema(CACHE_DDL).parquet(path)
    return new if known is None else staged(union_all(asked.where("n_tokens is not null"), new), "counts")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of docs. cache: a folder that outlives the application; unset,
    a new one among its staged tables."""
    cache = cache or f"{stage_root(docs.sparkSession)}/{uuid.uuid4().hex}/token_counts"
    norm = normalised(F.col(text_col), tokenizer)
    digest = F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest")
    counts = counts_of(docs.select(digest, norm.alias("norm")), tokenizer, cache)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text_bytes(F.col(text_col))).cast("long").alias("n_bytes"), digest)
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
