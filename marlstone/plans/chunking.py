"""Segmentation, packing, normalisation and tags over `documents` with section headers put in."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import CHAPTER_WORD, PREAMBLE, SECTION_HEADER, VIETNAMESE
from ..operators import chunking as C
from ..operators import tagging as G
from ..sources import io
from . import _sql as S
from .cleaning import table

SIZE = VIETNAMESE.sizes
#: Rules that fit the tables' invented words, so that every branch is met.
DRIVER = replace(
    VIETNAMESE,
    audience=(("sinh viên", ("ndthth", "sv")), ("giảng viên", ("erverau", "osadota")), ("cán bộ", ("eauxpa",))),
    kinds=(("quy định", ("tionthe",)), ("hướng dẫn", ("ingthe", "keitge")), ("quy chế", ("mentle",)), ("thông báo", ("ciónque", "thathe"))),
    important=("erthoning", "rights", "esth"),
    topics=(("tot_nghiep", "anthe|ionth"), ("hoc_phi", "ndthe|sthat"), ("ky_luat", "schich|eauen"), ("dao_tao", "THIN|osque")),
    audience_of_query=(("ndth", "sinh viên"), ("ver", "giảng viên"), ("eaux", "cán bộ"), ("ing", "giảng viên")),
)


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, text): each document's lines as paragraphs, chapters and articles put in front of some."""
    i = lambda k: k.cast("string")
    line = lambda x, k: F.when(k % 12 == 2, F.concat(F.lit("Chương "), i(k), F.lit("\n"), x)).when(k % 3 == 1, F.concat(F.lit("Điều "), i(k), F.lit(". "), x)).otherwise(F.when(k % 5 == 0, F.concat(F.lit("| "), x)).otherwise(x))
    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n\n")
    return table(spark, sf_dir, "documents").select(F.format_string("d%09d", "doc_id").alias("source"), text.alias("text"))


HEADED = f"""SELECT printf('d%09d', doc_id) AS source, {S.join("list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 12 = 2 THEN 'Chương ' || (i - 1) || chr(10) || x WHEN (i - 1) % 3 = 1 THEN 'Điều ' || (i - 1) || '. ' || x WHEN (i - 1) % 5 = 0 THEN '| ' || x ELSE x END)", chr(10) * 2)} AS text FROM documents"""


def parts_sql(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '(?m)^({SECTION_HEADER})', chr(1) || '\\1', 'g'), chr(1))"
    return f"list_filter({cut}, lambda p, i: i > 1 OR p <> '')"


SECTIONS = f"""
WITH h AS ({HEADED}), l AS (SELECT source, {parts_sql('text')} AS ps FROM h),
p AS (SELECT source, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS part FROM l),
k AS (SELECT *, {S.strip(f"regexp_extract(text, '^{SECTION_HEADER}')")} AS header FROM p)
SELECT source, CAST(part AS INTEGER) AS part, header, coalesce(last_value(CASE WHEN starts_with(header, '{CHAPTER_WORD}') THEN header END IGNORE NULLS) OVER (PARTITION BY source ORDER BY part), '') AS chapter, text FROM k
"""

BLANK = "[]::VARCHAR[]"


def merged_tables(xs: str) -> str:
    table_ = f"len(list_filter(string_split({S.strip('x.p')}, chr(10)), lambda y: starts_with({S.strip('y')}, '|'))) > 0"
    start = f"{{'out': {BLANK}, 'open': false, 'p': ''}}"
    step = f"{{'out': CASE WHEN {table_} AND s.open THEN list_append(s.out[:-2], s.out[-1] || chr(10) || x.p) ELSE list_append(s.out, x.p) END, 'open': {table_}, 'p': ''}}"
    return f"list_reduce(list_transform({xs}, lambda p: {{'out': {BLANK}, 'open': false, 'p': p}}), lambda s, x: {step}, {start}).out"


def packed_sql(xs: str, limit: float, emit: str | None = None, opening: str = "''", full_if: str = "true") -> str:
    """emit: whether the stripped buffer b is long enough; opening: what a new buffer starts with."""
    b = S.strip("s.buf")
    flush = lambda s: f"CASE WHEN {(emit or '{b} <> {q}').format(b=S.strip(s + '.buf'), q=chr(39) * 2)} THEN list_append({s}.out, {S.strip(s + '.buf')}) ELSE {s}.out END"
    gap = "chr(10) || chr(10)"
    full = f"length(s.buf) + length(x.buf) > {limit} AND {full_if.format(b=b)}"
    step = f"CASE WHEN {full} THEN {{'out': {flush('s')}, 'buf': {opening.format(b=b)} || x.buf || {gap}}} ELSE {{'out': s.out, 'buf': s.buf || x.buf || {gap}}} END"
    fold = f"list_reduce(list_transform({xs}, lambda p: {{'out': {BLANK}, 'buf': p}}), lambda s, x: {step}, {{'out': {BLANK}, 'buf': ''}})"
    return f"list_transform([{fold}], lambda s: {flush('s')})[1]"


PARAGRAPHS = "string_split({x}, chr(10) || chr(10))"
OVERLAP = "CASE WHEN len(string_split({b}, '.')) > 1 THEN string_split({b}, '.')[-2] || '. ' || string_split({b}, '.')[-1] ELSE '' END || chr(10) || chr(10)"
CHUNKS = f"""
WITH h AS ({HEADED}), l AS (SELECT source, text, {parts_sql('text')} AS ps FROM h),
m AS (SELECT *, len(list_filter(ps, lambda p: regexp_matches(p, '^{SECTION_HEADER}'))) >= 3 AS structured FROM l),
p AS (SELECT source, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS part FROM m WHERE structured),
k AS (SELECT *, {S.strip(f"regexp_extract(text, '^{SECTION_HEADER}')")} AS header, {S.strip('text')} AS t FROM p),
c AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(header, '{CHAPTER_WORD}') THEN header END IGNORE NULLS) OVER (PARTITION BY source ORDER BY part), '') AS chapter FROM k),
o AS (SELECT source, part, CASE WHEN header = '' THEN '{PREAMBLE}' ELSE header END AS section, chapter,
  CASE WHEN header = '' THEN CASE WHEN length(text) > {SIZE.least_chunk} AND length(t) >= {SIZE.least_chunk} THEN [t] END
       WHEN length(t) > {SIZE.chunk * 3} THEN {packed_sql(merged_tables(PARAGRAPHS.format(x='t')), SIZE.chunk * 1.5)}
       WHEN length(t) >= {SIZE.least_chunk} THEN [t] END AS own FROM c
  UNION ALL SELECT source, 0, '', '', {packed_sql(f"list_filter(list_transform({merged_tables(PARAGRAPHS.format(x='text'))}, lambda q: {S.strip('q')}), lambda q: q <> '')", SIZE.chunk * 1.5, f"length({{b}}) >= {SIZE.least_chunk}", OVERLAP)} FROM m WHERE NOT structured),
u AS (SELECT source, part, section, chapter, unnest(own) AS text, generate_subscripts(own, 1) - 1 AS sub FROM o WHERE own IS NOT NULL)
SELECT source, part * 4294967296 + sub AS pos, section, chapter, text,
  '[' || source || ']' || CASE WHEN chapter <> '' THEN ' - ' || chapter ELSE '' END || CASE WHEN section <> '' THEN ' - ' || section ELSE '' END || chr(10) || text AS text_with_context FROM u
"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(headed(spark, sf_dir)).select("source", "part", "header", "chapter", "text")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_documents(headed(spark, sf_dir))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Places alone are numbered, and read three times: worked out once.
    return C.with_ids(io.staged(C.chunk_documents(headed(spark, sf_dir)).select("source", "pos"))).select("source", "pos", "n", "id")


IDS_SQL = f"WITH chunks AS ({CHUNKS}), n AS (SELECT source, pos, row_number() OVER (ORDER BY source, pos) - 1 AS n FROM chunks) SELECT *, printf('chunk_%04d', n) AS id FROM n"


def lines_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a chunk."""
    rows = table(spark, sf_dir, "documents").select(F.format_string("d%09d", "doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    rows = rows.withColumn("pos", F.col("pos").cast("long")).withColumn("section", F.concat(F.lit("s"), (F.col("pos") % 3).cast("string"))).withColumn("chapter", F.when(F.col("pos") % 2 == 0, "c").otherwise(""))
    return rows.withColumn("text_with_context", F.concat(F.lit("<"), "text", F.lit(">")))


LINES = "SELECT printf('d%09d', doc_id) AS source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


def merge_tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_tiny(lines_as_chunks(spark, sf_dir), 200).select("source", "pos", "section", "chapter", "text", "text_with_context", "anchor", "n_merged")


MERGE_SQL = f"""
WITH l AS ({LINES}),
a AS (SELECT *, CASE WHEN length(text) >= 200 THEN pos END AS big FROM l),
b AS (SELECT *, coalesce(first_value(big IGNORE NULLS) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(big IGNORE NULLS) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS anchor FROM a),
g AS (SELECT source, anchor, CASE WHEN anchor = -1 THEN min(pos) ELSE anchor END AS pos, count(*) AS n_merged, string_agg(text, chr(10) ORDER BY pos) AS text FROM b GROUP BY source, anchor),
f AS (SELECT b.source, b.anchor, string_agg(b.text, chr(10) ORDER BY b.pos) FILTER (b.pos <= g.pos) AS front, count(*) FILTER (b.pos <= g.pos) AS n_front, max(b.text) FILTER (b.pos = g.pos) AS own,
   string_agg(CASE WHEN b.anchor <> -1 AND b.pos = g.pos + 1 THEN '<' || b.text || '>' ELSE b.text END, chr(10) ORDER BY b.pos) FILTER (b.pos > g.pos) AS behind
   FROM b JOIN g ON b.source = g.source AND b.anchor = g.anchor GROUP BY b.source, b.anchor)
SELECT g.source, g.pos, 's' || (g.pos % 3) AS section, CASE WHEN g.pos % 2 = 0 THEN 'c' ELSE '' END AS chapter, g.text,
  CASE WHEN n_front > 1 THEN '[' || g.source || ']' || CASE WHEN g.pos % 2 = 0 THEN ' - c' ELSE '' END || ' - s' || (g.pos % 3) || chr(10) || front ELSE '<' || own || '>' END || coalesce(chr(10) || behind, '') AS text_with_context,
  g.anchor, CAST(n_merged AS INTEGER) AS n_merged
FROM g JOIN f ON g.source = f.source AND g.anchor = f.anchor
"""


def split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.format_string("chunk_%04d", "doc_id").alias("id"), F.col("source"), F.lit("").alias("section"), F.lit("").alias("chapter"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return C.split_oversized(rows).select("id", "source", "text", "sub_index", "pre_norm_parent_id")


SPLIT_SQL = f"""
WITH d AS (SELECT printf('chunk_%04d', doc_id) AS id, source, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
e AS (SELECT *, length(text) > 3000 AS over_, string_split(text, chr(10)) AS ls FROM d),
h AS (SELECT *, CASE WHEN contains(text, '|') AND len(ls) >= 2 THEN ls[1] || chr(10) || ls[2] || chr(10) ELSE '' END AS head FROM e),
b AS (SELECT *, CASE WHEN head <> '' THEN {S.join('ls[3:]')} ELSE text END AS body FROM h),
p AS (SELECT *, CASE WHEN over_ THEN list_transform({packed_sql(PARAGRAPHS.format(x='body'), 3000, full_if="{b} <> ''")}, lambda q: head || q) ELSE [text] END AS parts FROM b)
SELECT id, source, unnest(parts) AS text, CASE WHEN over_ THEN CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) END AS sub_index, CASE WHEN over_ THEN id END AS pre_norm_parent_id FROM p
"""


def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.with_ids(lines_as_chunks(spark, sf_dir))
    return C.sibling_lists(rows, "section")


SIBLINGS_SQL = f"""
WITH l AS (SELECT *, 's' || (pos % 3) AS section, printf('chunk_%04d', row_number() OVER (ORDER BY source, pos) - 1) AS id FROM ({LINES})),
g AS (SELECT source, section, list(id ORDER BY pos) AS ids FROM l GROUP BY source, section)
SELECT id, list_filter(ids, lambda x: x <> id) AS siblings FROM l JOIN g USING (source, section)
"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.semantic_tags(F.col("text"), DRIVER)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.doi_tuong", "t.loai_van_ban", "t.do_quan_trong")


TAGS = f"{S.labels('lower(text)', DRIVER.audience, DRIVER.audience_default)} AS doi_tuong, {S.labels('lower(text)', DRIVER.kinds, DRIVER.kind_default)} AS loai_van_ban, CASE WHEN {S.any_of('lower(text)', DRIVER.important)} THEN 'cao' ELSE 'trung bình' END AS do_quan_trong"
TAGS_SQL = f"SELECT doc_id, {TAGS} FROM documents"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks (id, source, text, semantic_tags, n); sources by 20 documents, so that the guards bite."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("b"), F.floor(F.col("doc_id") / 20).cast("string")).alias("source"), "text", G.semantic_tags(F.col("text"), DRIVER).alias("semantic_tags"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as questions."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("query"))


QUESTIONS = "SELECT conv_id * 1000 + turn AS qid, text AS query FROM conversations WHERE role = 'user'"
TAGGED = f"SELECT doc_id AS id, 'b' || (doc_id // 20) AS source, text, {TAGS} FROM documents"


def topics_sql(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({x}), {S.lit(p)}) THEN {S.lit(n)} END" for n, p in DRIVER.topics) + "], lambda t: t IS NOT NULL)"


def topic_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.topic_sources(tagged(spark, sf_dir), DRIVER)


TOPIC_SQL = f"SELECT DISTINCT source, unnest({topics_sql('text')}) AS topic FROM ({TAGGED})"


def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tag_index(tagged(spark, sf_dir))


TAG_INDEX_SQL = f"SELECT tag, count(*) AS n_chunks FROM (SELECT unnest(doi_tuong) AS tag FROM ({TAGGED})) GROUP BY tag"


def filter_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.filter_signatures(turns(spark, sf_dir), tagged(spark, sf_dir), DRIVER, keep=io.staged)


AUDIENCE = "CASE " + " ".join(f"WHEN contains(lower(query), {S.lit(k)}) THEN {S.lit(v)}" for k, v in DRIVER.audience_of_query) + " END"


def signatures_sql(tagged: str) -> str:
    return f"""
WITH c AS ({tagged}), q AS ({QUESTIONS}), ts AS (SELECT DISTINCT source, unnest({topics_sql('text')}) AS topic FROM c),
qs AS (SELECT DISTINCT qid, source FROM (SELECT qid, unnest({topics_sql('query')}) AS topic FROM q) JOIN ts USING (topic)),
n AS (SELECT qid FROM qs JOIN c USING (source) GROUP BY qid HAVING count(*) >= 20),
s AS (SELECT qid, list(source ORDER BY source) AS sources FROM qs JOIN n USING (qid) GROUP BY qid),
w AS (SELECT q.qid, sources, {AUDIENCE} AS a FROM q LEFT JOIN s USING (qid)),
k AS (SELECT w.qid, count(*) AS kept FROM w JOIN c ON (sources IS NULL OR list_contains(sources, c.source)) AND (list_contains(doi_tuong, a) OR list_contains(doi_tuong, 'tất cả')) WHERE a IS NOT NULL GROUP BY w.qid)
SELECT w.qid, sources, CASE WHEN coalesce(kept, 0) >= 20 THEN a END AS audience FROM w LEFT JOIN k USING (qid)
"""


SIGNATURES = signatures_sql(TAGGED)


def signatures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The filters of users' turns, the sets of sources that they name, both written once, and the chunks."""
    chunks = tagged(spark, sf_dir)
    return *G.topic_filters(turns(spark, sf_dir), chunks, DRIVER, keep=io.staged), chunks


def filtered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each filter keeps, the first, and the sum of their ids."""
    sums = {"n": F.count(F.lit(1)), "min_id": F.min("id"), "sum_id": F.sum("id")}
    signed, sets, chunks = signatures(spark, sf_dir)
    return G.filter_totals(signed, chunks, sums, DRIVER, sets, io.staged).withColumnRenamed("min_id", "first_id")


FILTERED_SQL = f"""
SELECT qid, count(*) AS n, min(id) AS first_id, CAST(sum(id) AS BIGINT) AS sum_id FROM ({SIGNATURES}) s JOIN ({TAGGED}) c
ON (sources IS NULL OR list_contains(sources, c.source)) AND (audience IS NULL OR list_contains(doi_tuong, audience) OR list_contains(doi_tuong, 'tất cả')) GROUP BY qid
"""


def queries() -> dict:
    return {
        "section_split": sections, "chunk_documents": chunk_documents, "chunk_ids": chunk_ids, "merge_tiny": merge_tiny,
        "split_oversized": split_oversized, "siblings": siblings, "semantic_tags": tags, "topic_sources": topic_sources,
        "tag_index": tag_index, "filter_signatures": filter_signatures, "filtered_chunks": filtered_chunks,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "section_split": SECTIONS, "chunk_documents": CHUNKS, "chunk_ids": IDS_SQL, "merge_tiny": MERGE_SQL,
        "split_oversized": SPLIT_SQL, "siblings": SIBLINGS_SQL, "semantic_tags": TAGS_SQL, "topic_sources": TOPIC_SQL,
        "tag_index": TAG_INDEX_SQL, "filter_signatures": SIGNATURES, "filtered_chunks": FILTERED_SQL,
    }
