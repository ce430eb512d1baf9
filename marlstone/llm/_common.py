"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of ASCII white space, and its complement: the words of every operator here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Unset it is an error, but for a local master (as in
    tests), whose driver is its only executor: there a temporary folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marlstone/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for the queries run inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_cleared(spark: SparkSession):
    """The shuffle files of the queries run inside go when each query ends (for rounds whose results are staged)."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def checkpointed(df: DataFrame, n: int, column: str) -> DataFrame:
    """df in the shared folder, in n partitions by a column: groups by it are found where they lie, without a shuffle
    (adaptive plans don't say how they end up partitioned, so this one is not adaptive)."""
    with setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return df.repartition(n, column).checkpoint()


def drop_staged(spark: SparkSession) -> None:
    """Removes all that this application staged; results that still read from it must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """A top-level column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_col(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % modulus).cast("int")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What names a row of documents without its text: id, whether the id is null, 64 bits of the text."""
    doc_id = F.col(id_col).cast("long")
    return [F.coalesce(doc_id, F.lit(0)).alias("kid"), doc_id.isNull().alias("knull"), F.xxhash64(F.col(text_col)).alias("ktext")]


ROW_KEY = ["kid", "knull", "ktext"]


def row_order(docs: DataFrame, text_col: str) -> Column:
    """A number that rows alike in id and text are ordered by: 64 bits of their other columns (by the columns' names)."""
    rest = sorted(c for c in docs.columns if c != text_col)
    return F.xxhash64(F.to_json(F.struct(*[column(c).alias(f"c{k}") for k, c in enumerate(rest)])) if rest else F.lit(0))


def rows_kept(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that kept names by row_key(), with all their columns; of rows alike in id and text one stays, the
    first by row_order(): rows that tie there too are alike in all that a JSON of their columns shows."""
    whole = docs.select(F.struct(*map(column, docs.columns)).alias("row"), *row_key(id_col, text_col), row_order(docs, text_col).alias("korder"))
    found = whole.join(kept.select(*ROW_KEY).distinct(), ROW_KEY, "left_semi")
    alike = Window.partitionBy(*ROW_KEY).orderBy("korder")
    return found.withColumn("nth", F.row_number().over(alike)).where("nth = 1").select("row.*")


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one pass over one column, from which group counts are derived."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def groups_for(n_bytes: int, per_group: int) -> int:
    """So many groups that each holds about per_group bytes."""
    return max(1, -(-n_bytes // per_group))


def flush_batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about limit bytes from row tuples."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 16 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size >= limit:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)
