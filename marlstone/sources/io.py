"""Sources and sinks: files of documents and pages, JSON arrays, tables of stages, reports."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import COMPARISON_COLUMNS

TAGS = "struct<doi_tuong:array<string>,loai_van_ban:array<string>,do_quan_trong:string>"
#: Schemas of the stages' tables.
SCHEMAS = {
    "documents": "source string, text string",
    "pages": "source string, page_no int, total_pages int, text string",
    "chunks": f"id string, source string, section string, chapter string, text string, text_with_context string, pre_norm_parent_id string, sub_index int, semantic_tags {TAGS}, text_for_retrieval string, text_for_generation string",
    "qa": "question string, answer string, type string, source string, section string, chunk_id string, generated_by string",
    "summaries": "chunk_id string, text_for_retrieval string",
    "vectors": "id string, embedding array<float>",
    "ocr_progress": "completed_files array<string>, stats map<string, struct<chars:int,time_s:double,engine:string,timestamp:string>>",
    "predictions": f"config string, qid bigint, question string, gold string, prediction string, sources array<string>, sections array<string>, semantic_tags array<{TAGS}>, crag_verdict string, hyde string",
    "metrics": "config string, label string, bleu double, rouge_l double, bertscore_f1 double, time_seconds double, num_samples int, recall_at_5 double",
}


def stem(path):
    """The file name without folder and ending."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(source, path, length, content) of the files that match, in any order; sorted_files() gives the order by path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(stem(F.col("path")).alias("source"), "path", "length", "content")


def sorted_files(files: DataFrame) -> DataFrame:
    """(source, path, length) in order of path: contents are not moved for it."""
    return files.select("source", "path", "length").orderBy("path")


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(source, text): a row a file."""
    return spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("source"), F.col("value").alias("text"))


def read_pages(files: DataFrame, render: Callable[[bytes], Iterator[bytes]]) -> DataFrame:
    """(source, content) -> (source, page_no, total_pages, image); render yields a document's page images in order."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for source, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pages = list(render(content))
                for k, image in enumerate(pages):
                    yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([k + 1], type=pa.int32()), pa.array([len(pages)], type=pa.int32()), pa.array([image], type=pa.binary())], names=["source", "page_no", "total_pages", "image"])

    return files.select("source", "content").mapInArrow(run, "source string, page_no int, total_pages int, image binary")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects, with its declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "json", multi_line: bool = True) -> DataFrame:
    """A progress file without its malformed records, or no rows where there is no such file. Other errors are raised.
    multi_line: a JSON file is one record or array, not a record a line."""
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "DROPMALFORMED").format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T._parse_datatype_string(schema))


def prefer_clean(raw: DataFrame, clean: DataFrame, cleaner) -> DataFrame:
    """(source, text, was_clean): the clean text where there is one, else the raw one cleaned."""
    kept = clean.select("source", F.col("text").alias("done"))
    return raw.join(kept, "source", "left").select("source", F.coalesce("done", cleaner(F.col("text"))).alias("text"), F.col("done").isNotNull().alias("was_clean"))


def clean_and_keep(raw: DataFrame, clean_path: str, cleaner) -> DataFrame:
    """As prefer_clean with what clean_path holds; texts that had to be cleaned are appended there, for the next run."""
    clean = read_or_empty(raw.sparkSession, clean_path, SCHEMAS["documents"], "parquet")
    out = staged(prefer_clean(raw, clean, cleaner))
    out.where("not was_clean").select("source", "text").write.mode("append").parquet(clean_path)
    return out


def read_written_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of what write_texts() wrote: the source is the folder's name, the last line end the writer's."""
    rows = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path, wholetext=True)
    source = F.url_decode(F.replace(F.regexp_extract("_metadata.file_path", r"source=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    return rows.select(source.alias("source"), F.regexp_replace("value", r"\n\z", "").alias("text"))


#: Documents that get a file of their own, at most.
MOST_FILES = 100_000


def write_texts(docs: DataFrame, path: str, most: int = MOST_FILES) -> None:
    """One folder a source, text files within: for so many documents as a file system bears; write_keyed() has no limit."""
    if docs.limit(most + 1).count() > most:
        raise ValueError(f"over {most} documents: write_keyed() keeps many texts in a file")
    docs.select("source", "text").write.mode("overwrite").partitionBy("source").text(path)


def kept_texts(docs: DataFrame, path: str, most: int = MOST_FILES) -> DataFrame:
    """docs (source, text) written and read again. Up to most documents get a file each; beyond, all of them lie in part
    files with their source beside them: the driver lists every file that it writes or reads."""
    if docs.limit(most + 1).count() > most:
        write_keyed(docs, path)
        return read_keyed(docs.sparkSession, path)
    write_texts(docs, path, most)
    return read_written_texts(docs.sparkSession, path)


def write_keyed(docs: DataFrame, path: str) -> None:
    """(source, text) in part files of many texts each, the source beside its text."""
    docs.select("source", "text").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["documents"]).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """One indented JSON array, characters as they are, in order. One file is one task, which streams sorted rows: no row
    or list holds the table."""
    n = df.count()
    columns = [c for c in df.columns if c != order]
    row = F.regexp_replace(F.to_json(F.struct(order, *columns), {"pretty": "true", "ignoreNullFields": "false"}), r"(?m)^", "  ")
    # Numbered after all rows are in one partition: 0 to n - 1 in order.
    rows = df.orderBy(order).coalesce(1).select(row.alias("row"), F.monotonically_increasing_id().alias("k"))
    rows = rows.select(F.concat(F.when(F.col("k") == 0, "[\n").otherwise(""), "row", F.when(F.col("k") == n - 1, "\n]").otherwise(",")).alias("value"))
    (rows if n else df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)).write.mode("overwrite").text(path)


def write_splits(pairs: DataFrame, path: str, split: str = "split") -> None:
    """All pairs in the folder all, and those of each split in a folder of its name."""
    pairs.drop(split).write.mode("overwrite").json(f"{path}/all")
    for name in ("train", "test"):
        pairs.where(F.col(split) == name).drop(split).write.mode("overwrite").json(f"{path}/{name}")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """A folder of JSON lines for each configuration."""
    predictions.write.mode("overwrite").partitionBy("config").json(path)


def image_payload(image: Column, kind: str = "image/png") -> Column:
    """Binary as the data address that a vision service takes."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(image))


def image_bytes(payload: Column) -> Column:
    return F.unbase64(F.regexp_extract(payload, "base64,(.*)$", 1))


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; with a local master and none set, of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def write_stage(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """A stage's table, new each time (never the one that it was read from); returns it as read."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame) -> DataFrame:
    """df written to a new folder and read again: worked out once, however often it is used, and no lineage behind it."""
    return write_stage(df, scratch(df.sparkSession))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "source", "section", "chapter")


def comparison_table(metrics: DataFrame) -> DataFrame:
    """The report of configurations in their order, with N/A where a figure does not apply."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    cols = [F.col("config"), F.col("label"), text("bleu"), text("rouge_l"), text("bertscore_f1"), text("recall_at_5"), text("time_seconds"), F.coalesce(F.col("num_samples").cast("string"), F.lit(""))]
    return metrics.orderBy("config").select(*[c.alias(n) for c, n in zip(cols, COMPARISON_COLUMNS)])


def write_report_csv(report: DataFrame, path: str) -> None:
    """One CSV file with a header; its first name carries the byte order mark that spreadsheets look for."""
    first, *rest = report.columns
    report.select(F.col(f"`{first}`").alias("﻿" + first), *[F.col(f"`{c}`") for c in rest]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def run_metadata(metrics: DataFrame) -> DataFrame:
    """One row of JSON: when, how many questions, each configuration's label and time, the total."""
    runs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("config", F.struct("label", "time_seconds").alias("v")))))
    return metrics.agg(F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.max("num_samples").alias("num_samples"), runs.alias("configs"), F.sum("time_seconds").alias("total_time_seconds"))).alias("value"))
