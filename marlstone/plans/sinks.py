"""Round trips through the sources and sinks, resuming, and model calls through a service's stand-in."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import union_all
from ..functions.text import first_tokens
from ..operators import chunking as C
from ..operators import generation as M
from ..operators import qa as Q
from ..operators import tagging as G
from ..sources import io
from ..sources.providers import CallPolicy, RateLimited
from ..streaming import incremental as I
from . import _sql as S
from .chunking import DRIVER, TAGGED, tagged
from .cleaning import table
from .qa import CHUNKS, SPLIT_SQL, TEMPLATE_SQL, documents_as_chunks, qa_template


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document written to a text file of its own and read again; of tables too large for that, many in a file."""
    return io.kept_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"), io.scratch(spark))


TEXT_FILES_SQL = "SELECT CAST(doc_id AS VARCHAR) AS source, text FROM documents"


def keyed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in part files with the key beside the text, and read again."""
    path = io.scratch(spark)
    io.write_keyed(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"), path)
    return io.read_keyed(spark, path)


def sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written files' sources by their place in the order of paths."""
    path = io.scratch(spark)
    io.write_texts(table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("string").alias("text")), path)
    files = io.sorted_files(io.read_files(spark, f"{path}/*", "*.txt")).withColumn("pos", F.lit(0))
    placed = C.with_ids(files.drop("source"), ("path", "pos"))  # by prefix sums over paths, see there
    return placed.select(F.col("n").cast("int").alias("place"), F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"))


SORTED_FILES_SQL = "SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS place, source FROM (SELECT DISTINCT source FROM documents)"


def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as one indented JSON array, written and read with its declared schema."""
    path = io.scratch(spark)
    io.write_json_array(table(spark, sf_dir, "benchmark").select("item_id", "text"), path, "item_id")
    return io.read_json_array(spark, path, "item_id bigint, text string")


JSON_ARRAY_SQL = "SELECT item_id, text FROM benchmark"


def stage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's chunks written and read by the next, and the projection that an index keeps."""
    chunks = documents_as_chunks(spark, sf_dir).withColumn("chapter", F.lit(""))
    return io.chunk_metadata(io.write_stage(chunks, io.scratch(spark)))


STAGE_SQL = f"SELECT id, source, section, '' AS chapter FROM ({CHUNKS})"


def qa_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as all, train and test, and read again."""
    path = io.scratch(spark)
    pairs = io.staged(qa_template(spark, sf_dir).select("chunk_id", "ord", "question", "answer"))
    # Which pairs are test is settled once, for all three folders.
    io.write_splits(io.staged(Q.split_pairs(pairs)).select("chunk_id", "ord", "question", "answer", "split"), path)
    schema = "chunk_id string, ord int, question string, answer string"
    return union_all(*[spark.read.schema(schema).json(f"{path}/{name}").withColumn("part", F.lit(name)) for name in ("all", "train", "test")])


QA_SPLITS_SQL = f"""
WITH t AS ({TEMPLATE_SQL}), s AS ({SPLIT_SQL}), j AS (SELECT t.chunk_id, t.ord, question, answer, split FROM t JOIN s ON t.chunk_id = s.chunk_id AND t.ord = s.ord)
SELECT chunk_id, ord, question, answer, 'all' AS part FROM j UNION ALL SELECT chunk_id, ord, question, answer, split FROM j
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two configurations written by configuration and read again."""
    path = io.scratch(spark)
    rows = table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("config"), F.col("item_id").alias("qid"), F.col("text").alias("question"), F.concat(F.lit("about "), "text").alias("prediction"))
    io.write_predictions(rows, path)
    return spark.read.schema("config string, qid bigint, question string, prediction string").json(path)


PREDICTIONS_SQL = "SELECT config, item_id AS qid, text AS question, 'about ' || text AS prediction FROM benchmark, (VALUES ('A'), ('B')) c(config)"


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run may skip: sources that written progress lists (a broken record in it is passed over) and whose output
    has over 100 bytes. A progress file that is not there lists none."""
    path, docs = io.scratch(spark), table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.octet_length("text").alias("length"))
    listed = table(spark, sf_dir, "labels").where("quality = 1").select(F.to_json(F.struct(F.array(F.col("doc_id").cast("string")).alias("completed_files"))).alias("value"))
    union_all(listed, listed.limit(1).select(F.lit('{"completed_files": [').alias("value"))).write.text(path)
    schema = "completed_files array<string>"
    known = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return I.finished_files(docs, union_all(known, io.read_or_empty(spark, path + "-none", schema)), docs)


PROGRESS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND octet_length(encode(text)) > 100"


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.importance_index(tagged(spark, sf_dir))


IMPORTANCE_SQL = f"SELECT do_quan_trong AS importance, count(*) AS n_chunks FROM ({TAGGED}) GROUP BY 1"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' bytes as data addresses, and back."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("image"))
    sent = pages.select("page_id", F.regexp_replace(io.image_payload(F.col("image")), r"[\r\n]", "").alias("payload"))
    return sent.select("page_id", "payload", F.octet_length(io.image_bytes(F.col("payload"))).cast("long").alias("n_bytes"))


PAYLOADS_SQL = "SELECT page_id, 'data:image/png;base64,' || to_base64(encode(html)) AS payload, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM pages"


def chat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to their first 2,048 words."""
    return table(spark, sf_dir, "documents").select("doc_id", first_tokens(F.col("text")).alias("text"))


CHAT_CUT_SQL = rf"SELECT doc_id, {S.join(f'''regexp_extract_all(text, '[{S.WS}]*[^{S.WS}]+')[1:2048]''', '')} AS text FROM documents"


class Refusing:
    """A service's stand-in: the first of its models refuses every item that begins with a mark, the second none."""

    def __init__(self, reply):
        self.reply = reply

    def __call__(self, model: str, item: tuple) -> str:
        if model == "first" and item[1].startswith("!"):
            raise RateLimited(0.0)
        return self.reply(item[0], item[1].lstrip("!"))


def patient() -> CallPolicy:
    return CallPolicy(models=("first", "second"), attempts=2, breaker=1, spacing=0.0, sleep=lambda seconds: None)


def asked_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as chunks, and which of them are done: those marked toxic."""
    chunks = documents_as_chunks(spark, sf_dir).withColumnRenamed("id", "chunk_id")
    return chunks, table(spark, sf_dir, "labels").where("toxic = 1").select(F.format_string("chunk_%04d", "doc_id").alias("chunk_id"))


def prompt():
    """The chunk's source, marked where the first model will refuse it."""
    return F.concat(F.when(F.col("doc_id") % 7 == 0, "!").otherwise(""), F.col("source"))


def pair_reply(key: str, asked: str) -> str:
    """A fenced pair; every fifth chunk gets no list."""
    if int(key.split("_")[1]) % 5 == 0:
        return "nothing to ask"
    return f'```json\n[{{"question": "What does {key} say?", "answer": " {asked} ", "type": "procedural"}}]\n```'


def qa_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a model makes of pending chunks, and a row for each chunk that is done by it, pair or none."""
    chunks, done = asked_chunks(spark, sf_dir)
    pairs, now = M.generated_pairs(chunks, done, prompt(), patient, Refusing(pair_reply), io.scratch(spark))
    return now.join(pairs.select("chunk_id", "question", "answer", "type", "generated_by"), "chunk_id", "left")


PENDING_CHUNKS = f"SELECT * FROM ({CHUNKS}) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
QA_GENERATE_SQL = f"""SELECT id AS chunk_id, CASE WHEN doc_id % 5 <> 0 THEN 'What does ' || id || ' say?' END AS question, CASE WHEN doc_id % 5 <> 0 THEN source END AS answer,
CASE WHEN doc_id % 5 <> 0 THEN 'procedural' END AS type, CASE WHEN doc_id % 5 <> 0 THEN 'api' END AS generated_by FROM ({PENDING_CHUNKS})"""


def summary_reply(key: str, asked: str) -> str:
    return f'{{"summary": "{key} from {asked}", "keywords": ["{asked}", " x "]}}'


def summaries_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval summaries that a model makes of pending chunks."""
    chunks, done = asked_chunks(spark, sf_dir)
    return M.generated_summaries(chunks, done, prompt(), patient, Refusing(summary_reply), io.scratch(spark))


SUMMARIES_GENERATE_SQL = f"""SELECT id AS chunk_id, CASE WHEN section <> '' THEN '[' || section || '] ' ELSE '' END || id || ' from ' || source || chr(10) || 'Từ khóa: ' || source || ', x' AS text_for_retrieval FROM ({PENDING_CHUNKS})"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs made in rounds that are saved one by one."""
    chunks, done = asked_chunks(spark, sf_dir)
    path = io.scratch(spark)
    left = I.pending(chunks, done, "chunk_id")
    work = lambda part: M.called(part, "chunk_id", prompt(), patient, Refusing(pair_reply))
    M.in_rounds(left, "chunk_id", max(1, left.count() // 3), work, lambda made, k: made.write.mode("append").parquet(path))
    return spark.read.schema("chunk_id string, reply string").parquet(path).select("chunk_id", F.contains("reply", F.lit("question")).alias("has_pair"))


ROUNDS_SQL = f"SELECT id AS chunk_id, doc_id % 5 <> 0 AS has_pair FROM ({PENDING_CHUNKS})"


def queries() -> dict:
    return {
        "text_files": text_files, "keyed_texts": keyed_texts, "sorted_files": sorted_files, "json_array": json_array, "stage_tables": stage_tables, "qa_splits": qa_splits,
        "predictions_files": predictions, "progress_skips": progress, "importance_index": importance, "image_payloads": payloads,
        "token_cut": chat_cut, "qa_generate": qa_generate, "summaries_generate": summaries_generate, "calls_in_rounds": rounds,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "text_files": TEXT_FILES_SQL, "keyed_texts": TEXT_FILES_SQL, "sorted_files": SORTED_FILES_SQL, "json_array": JSON_ARRAY_SQL, "stage_tables": STAGE_SQL, "qa_splits": QA_SPLITS_SQL,
        "predictions_files": PREDICTIONS_SQL, "progress_skips": PROGRESS_SQL, "importance_index": IMPORTANCE_SQL, "image_payloads": PAYLOADS_SQL,
        "token_cut": CHAT_CUT_SQL, "qa_generate": QA_GENERATE_SQL, "summaries_generate": SUMMARIES_GENERATE_SQL, "calls_in_rounds": ROUNDS_SQL,
    }
