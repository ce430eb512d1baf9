"""Cleaning, tokens and corpus statistics over `documents`."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import ABBREVIATIONS, CONTROL, LOWER_VI, OCR_PAGE_FIXES, OCR_TEXT_FIXES, STAMPS, WORD_CLASS, WS, WS_INLINE
from ..operators.lines import assemble_pages, drop_repeated_lines
from . import _sql as S

#: The tables' texts hold none of the marks that cleaning looks for; both sides add the same ones.
BEFORE = "--- Trang  3/12 ---Ðiều 7 \x07"
AFTER = " [Con dấu]\t xSV SV, ĐH/SV  P.ĐH SV SV. \n\n\n\nlI Ill Ðồng \n  GPA:HK TC\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(BEFORE), F.col("text"), F.lit(AFTER)).alias("text"))


MARKED = f"SELECT doc_id, {S.lit(BEFORE)} || text || {S.lit(AFTER)} AS text FROM documents"


def replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {S.lit(a)}, {S.lit(b)})"
    return x


def tidied(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '[{WS_INLINE}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return S.join(f"list_transform(string_split({x}, chr(10)), lambda l: {S.strip('l')})")


def abbreviated(x: str) -> str:
    edge = f"[^:/{WORD_CLASS}]"
    for a, b in ABBREVIATIONS:
        for _ in range(2):  # neighbours share the character between them
            x = f"regexp_replace({x}, '(^|{edge}){a.replace('.', chr(92) + '.')}($|{edge})', '\\1{b}\\2', 'g')"
    return x


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


def clean_sql(marked: str = MARKED) -> str:
    one = f"regexp_replace(regexp_replace(text, '{CONTROL}', '', 'g'), '---[{WS}]*Trang[{WS}]+\\p{{Nd}}+/\\p{{Nd}}+[{WS}]*---', chr(10), 'g')"
    two = f"regexp_replace({replaced(replaced('a', [(s, '') for s in STAMPS]), OCR_TEXT_FIXES)}, '([{LOWER_VI},])\\n([{LOWER_VI}])', '\\1 \\2', 'g')"
    return f"WITH m AS ({marked}), o AS (SELECT doc_id, {one} AS a FROM m), p AS (SELECT doc_id, {two} AS b FROM o), q AS (SELECT doc_id, {tidied('b')} AS c FROM p) SELECT doc_id, {abbreviated('c')} AS clean FROM q"


def fix_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("doc_id", T.fix_page(F.col("text")).alias("page"))


def fix_page_sql() -> str:
    fixed = f"regexp_replace({replaced('text', OCR_PAGE_FIXES)}, '{CONTROL}', '', 'g')"
    return f"WITH m AS ({MARKED}), p AS (SELECT doc_id, {fixed} AS b FROM m), q AS (SELECT doc_id, {tidied('b')} AS c FROM p) SELECT doc_id, {S.strip('c')} AS page FROM q"


def nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))
    return table(spark, sf_dir, "documents").select("doc_id", T.nfc(apart).alias("composed"))


NFC_SQL = "SELECT doc_id, nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))) AS composed FROM documents"


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", drop_repeated_lines(F.col("text")).alias("kept"))


REPEATED_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT *, {S.strip('line')} AS k FROM l),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS r FROM c)
SELECT doc_id, {S.strip("string_agg(line, chr(10) ORDER BY pos)")} AS kept FROM n WHERE k = '' OR n < 3 OR r = 1 GROUP BY doc_id
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as books: a source's documents are its pages, every seventh unreadable."""
    place = Window.partitionBy("source").orderBy("doc_id")
    rows = table(spark, sf_dir, "documents").select("source", F.row_number().over(place).alias("page_no"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("text"))
    return assemble_pages(rows.withColumn("total_pages", F.count(F.lit(1)).over(Window.partitionBy("source"))))


PAGES_SQL = """
WITH p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text FROM documents)
SELECT source, string_agg('--- Trang ' || i || '/' || n || ' ---' || chr(10) || CASE WHEN text = '' THEN '[Không trích xuất được text trang ' || i || ']' ELSE text END, chr(10) || chr(10) ORDER BY i) AS text FROM p GROUP BY source
"""


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"), T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), F.size("s").alias("n_sentences"), F.element_at("s", -1).alias("last_sentence"))


TOKEN_SQL = f"""
WITH t AS (SELECT doc_id, {S.tokens('text')} AS w, {S.sentences('text')} AS s FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct, CAST(len(s) AS INTEGER) AS n_sentences, s[-1] AS last_sentence FROM t
"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, extremes and shares by language."""
    lines = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents").select(
        "lang", "doc_id", "source", F.length("text").alias("n"), F.size(T.tokens(F.col("text"))).alias("w"),
        F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|")))).alias("rows"), F.size(F.filter(lines, lambda x: x.rlike("^[-*] "))).alias("items"),
    )
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("w").alias("n_words"), F.sum("n").alias("n_chars"), F.floor(F.sum("n") / F.count(F.lit(1))).alias("mean_chars"),
        F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), F.median("n").alias("median_chars"), F.count_distinct("source").alias("n_sources"),
        F.min_by("doc_id", F.struct(-F.col("n"), "doc_id")).alias("longest"), F.sum("rows").alias("n_table_rows"), F.sum("items").alias("n_items"), F.count_if(F.col("n") < 80).alias("n_tiny"),
    )


PROFILE_SQL = f"""
WITH r AS (SELECT lang, doc_id, source, length(text) AS n, len({S.tokens('text')}) AS w,
  len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))) AS rows_, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[-*] '))) AS items FROM documents)
SELECT lang, count(*) AS n_docs, CAST(sum(w) AS BIGINT) AS n_words, CAST(sum(n) AS BIGINT) AS n_chars, CAST(floor(sum(n) / count(*)) AS BIGINT) AS mean_chars, CAST(min(n) AS INTEGER) AS min_chars, CAST(max(n) AS INTEGER) AS max_chars,
  median(n) AS median_chars, count(DISTINCT source) AS n_sources, arg_min(doc_id, (-n, doc_id)) AS longest, CAST(sum(rows_) AS BIGINT) AS n_table_rows, CAST(sum(items) AS BIGINT) AS n_items, count(*) FILTER (n < 80) AS n_tiny
FROM r GROUP BY lang
"""


def queries() -> dict:
    return {
        "clean_text": clean_text, "fix_page": fix_page, "nfc": nfc, "drop_repeated_lines": repeated_lines,
        "assemble_pages": pages, "token_stats": token_stats, "corpus_profile": profile,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "clean_text": clean_sql(), "fix_page": fix_page_sql(), "nfc": NFC_SQL, "drop_repeated_lines": REPEATED_SQL,
        "assemble_pages": PAGES_SQL, "token_stats": TOKEN_SQL, "corpus_profile": PROFILE_SQL,
    }
