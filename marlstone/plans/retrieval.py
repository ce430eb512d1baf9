"""Dense, sparse and hybrid search, and the path from hits to answers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import beside, union_all
from ..functions.rules import ANSWER_TEXTS, ARTICLE_REF, CLAUSE_REF, CROSS_REF, MODES, SYNONYMS
from ..operators import answering as A
from ..operators import postings as P
from ..operators import retrieval as R
from ..operators import tagging as G
from ..operators import vectors as V
from ..operators.rag import Models, answer, embedded
from ..sources import io
from ..sources.providers import DigestEmbedder, ExtractiveGenerator, OverlapReranker
from ..streaming import incremental as I
from . import _sql as S
from .chunking import DRIVER, QUESTIONS, SIGNATURES, TAGGED, TAGS, signatures, signatures_sql, turns
from .cleaning import table


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is a question, against all."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 20).select("qid", "id", "score", "rank")


def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index that is written and read again."""
    path = io.scratch(spark)
    V.write_index(vectors(spark, sf_dir), path)
    return V.index_topk(vector_queries(spark, sf_dir), V.read_index(spark, path), 20, keep=io.staged).hits.select("qid", "id", "score", "rank")


def dense_sql(k: int) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of questions that some labels narrow (the odd hundreds: labels 1, 4, 7) leave the others out, not refilled."""
    hits = dense_topk(spark, sf_dir).join(vectors(spark, sf_dir).select("id", F.col("label").cast("string").alias("source")), "id")
    allowed = vector_queries(spark, sf_dir).where("qid % 200 = 100").select("qid", F.explode(F.array(F.lit("1"), F.lit("4"), F.lit("7"))).alias("source"))
    return R.keep_sources(hits, allowed).select("qid", "id", "source", "rank")


DENSE_FILTERED_SQL = f"SELECT qid, id, CAST(label AS VARCHAR) AS source, rank FROM ({dense_sql(20)}) JOIN embeddings ON vec_id = id WHERE qid % 200 <> 100 OR label IN (1, 4, 7)"


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_topk(questions(spark, sf_dir), corpus(spark, sf_dir), 20).select("qid", "id", "score", "rank")


def posting_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over blocks of postings that are written and read again."""
    path = io.scratch(spark)
    P.write_postings(corpus(spark, sf_dir), path)
    return P.posting_topk(questions(spark, sf_dir), P.read_postings(spark, path), 20, keep=io.staged).hits.select("qid", "id", "score", "rank")


#: Okapi scores with k1 1.5, b 0.75, negative idf floored at a quarter of the mean.
BM25_SQL = f"""
WITH q AS (SELECT item_id AS qid, unnest({S.tokens('text')}) AS term FROM benchmark), d AS (SELECT doc_id AS id, {S.tokens('text')} AS w FROM documents),
t AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d), f AS (SELECT id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), r AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM f, n GROUP BY term, n),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
s AS (SELECT qid, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN i USING (term) JOIN f USING (term), n GROUP BY qid, id),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE score > 0)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20
"""


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed, sets, chunks = signatures(spark, sf_dir)
    return R.bm25_filtered(turns(spark, sf_dir).join(signed, "qid"), chunks, 20, rules=DRIVER, keep=io.staged, sets=sets).select("qid", "id", "score", "rank")


def bm25_filtered_sql(signatures: str, tagged: str, asked: str) -> str:
    """signatures (qid, sources, audience), tagged (id, source, text, doi_tuong), asked (sub, qid, query) -> hits of each sub."""
    return f"""
WITH g AS ({signatures}), c AS ({tagged}), s0 AS (SELECT DISTINCT sources, audience FROM g), s1 AS (SELECT *, row_number() OVER () AS sig FROM s0),
a AS (SELECT sig, id, text FROM s1 JOIN c ON (sources IS NULL OR list_contains(sources, c.source)) AND (audience IS NULL OR list_contains(doi_tuong, audience) OR list_contains(doi_tuong, 'tất cả'))),
gs AS (SELECT qid, sig FROM g JOIN s1 ON g.sources IS NOT DISTINCT FROM s1.sources AND g.audience IS NOT DISTINCT FROM s1.audience),
q AS (SELECT sub, sig, unnest({S.tokens('query')}) AS term FROM ({asked}) JOIN gs USING (qid)),
d AS (SELECT sig, id, {S.tokens('text')} AS w FROM a), t AS (SELECT sig, id, len(w) AS dl, unnest(w) AS term FROM d), f AS (SELECT sig, id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT sig, count(*) AS n, avg(len(w)) AS avgdl FROM d GROUP BY sig), r AS (SELECT f.sig, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM f JOIN n USING (sig) GROUP BY f.sig, term, n),
m AS (SELECT sig, avg(raw) AS mean FROM r GROUP BY sig), i AS (SELECT sig, term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM r JOIN m USING (sig)),
s AS (SELECT sub, f.id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN i USING (sig, term) JOIN f USING (sig, term) JOIN n USING (sig) GROUP BY sub, f.id),
k AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY score DESC, id) AS rank FROM s WHERE score > 0)
SELECT sub, id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20
"""


BM25_FILTERED_SQL = f"SELECT sub AS qid, id, score, rank FROM ({bm25_filtered_sql(SIGNATURES, TAGGED, f'SELECT qid AS sub, qid, query FROM ({QUESTIONS})')})"


def hybrid_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, list_no, rank, id): the dense list of each question's vector (item and vector of one id), then its sparse one."""
    asked = questions(spark, sf_dir)
    own = table(spark, sf_dir, "embeddings").join(asked.select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), "embedding")
    dense = R.dense_topk(own, vectors(spark, sf_dir), 20).select("qid", F.lit(0).alias("list_no"), "rank", "id")
    return union_all(dense, bm25_topk(spark, sf_dir).select("qid", F.lit(1).alias("list_no"), "rank", "id"))


LISTS = f"""
SELECT qid, 0 AS list_no, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM
 (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 20
UNION ALL SELECT qid, 1, rank, id FROM ({BM25_SQL})
"""


def fused_sql(place: str, first: str, k: int) -> str:
    return f"""WITH l AS ({LISTS}), p AS (SELECT qid, id, {place} AS place, {first} AS first FROM l),
s AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score, min(first) AS first FROM p GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM s) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


PLACE = "row_number() OVER (PARTITION BY qid ORDER BY list_no, rank)"


def rrf_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf_concat(hybrid_lists(spark, sf_dir), 20)


def rrf_per_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf_per_list(hybrid_lists(spark, sf_dir), 20)


def hybrid_rrf_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf_concat(hybrid_lists(spark, sf_dir), 5)


def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns with informal phrases and references put in."""
    extra = F.when(F.col("qid") % 3 == 0, " em bị đuổi học vì RỚT môn, Điều 5 khoản 2").when(F.col("qid") % 3 == 1, " khoản 7 thi lại").otherwise("")
    return turns(spark, sf_dir).select("qid", A.variants(F.concat("query", extra), DRIVER).alias("variants"))


def variants_sql() -> str:
    extra = "CASE qid % 3 WHEN 0 THEN ' em bị đuổi học vì RỚT môn, Điều 5 khoản 2' WHEN 1 THEN ' khoản 7 thi lại' ELSE '' END"
    return variants_sql_of(f"SELECT qid, query || {extra} AS q FROM ({QUESTIONS})")


def variants_sql_of(rows: str) -> str:
    """rows (qid, q) -> (qid, variants)."""
    steps, last = [], "q0"
    for k, (a, b) in enumerate(SYNONYMS):
        steps.append(f"r{k} AS (SELECT *, CASE WHEN contains(lower(q), {S.lit(a.lower())}) THEN regexp_replace(v, '(?i){a}', {S.lit(b)}, 'g') ELSE v END AS w FROM {last})")
        steps.append(f"s{k} AS (SELECT qid, q, w AS v FROM r{k})")
        last = f"s{k}"
    art, cla = f"regexp_extract(q, '{ARTICLE_REF}', 1)", f"regexp_extract(q, '{CLAUSE_REF}', 1)"
    return f"""WITH q0 AS (SELECT qid, q, q AS v FROM ({rows})), {', '.join(steps)}
SELECT qid, list_filter([q, CASE WHEN v <> q THEN v END, CASE WHEN {art} <> '' THEN 'Điều ' || {art} END, CASE WHEN {art} <> '' AND {cla} <> '' THEN 'Điều ' || {art} || ' Khoản ' || {cla} END], lambda x: x IS NOT NULL) AS variants FROM {last}"""


def fused_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's fused hits with its words and their texts, which meet the few hits where they lie."""
    hits = io.staged(rrf_concat(spark, sf_dir))
    return beside(hits, corpus(spark, sf_dir), "id").join(questions(spark, sf_dir), "qid")


def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each question's fused hits, by the overlap stand-in (range -5 to 5)."""
    best = A.reranked(fused_texts(spark, sf_dir), OverlapReranker(), 5)
    return io.staged(best.select("qid", "id", "score", "rerank_score", "rank"))  # every later step reads them


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked_hits(spark, sf_dir).select("qid", "id", "rerank_score", "rank")


def reranked_sql(hits: str, asked: str) -> str:
    """hits (qid, id, score, rank), asked (qid, query) -> the five best."""
    return f"""
WITH h AS ({hits}), b AS ({asked}), x AS (SELECT h.qid, h.id, score, rank AS fused, list_distinct({S.tokens('b.query')}) AS a, list_distinct({S.tokens('d.text')}) AS t FROM h JOIN b ON b.qid = h.qid JOIN documents d ON doc_id = h.id),
s AS (SELECT qid, id, score, fused, round(-5.0 + 10.0 * (len(list_filter(a, lambda w: list_contains(t, w)))::DOUBLE / greatest(len(a), 1)), 6) AS rerank_score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, fused) AS rank FROM s)
SELECT qid, id, score, rerank_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
"""


ASKED = "SELECT item_id AS qid, text AS query FROM benchmark"
RERANKED = reranked_sql(fused_sql(PLACE, PLACE, 20), ASKED)


def chunk_table(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    """documents as chunks with sections: ten a section, the first section of each source without a name. hits (id): only
    the chunks that they name."""
    docs = table(spark, sf_dir, "documents")
    if hits is not None:
        docs = beside(hits.select(F.col("id").alias("doc_id")), docs, "doc_id", "left_semi")
    k = F.floor(F.col("doc_id") / 10)
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("n"), F.concat(F.lit("b"), F.floor(F.col("doc_id") / 40).cast("string")).alias("source"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Điều "), k.cast("string"))).alias("section"), F.lit("").alias("chapter"), "text", G.semantic_tags(F.col("text"), DRIVER).alias("semantic_tags"))


def expanded_hits(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    return A.expanded(hits or reranked_hits(spark, sf_dir), chunk_table(spark, sf_dir))


def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded_hits(spark, sf_dir).select("qid", "ord", "id", "method", F.round("rerank_score", 6).alias("rerank_score"))


CHUNK_ROWS = "SELECT doc_id AS id, 'b' || (doc_id // 40) AS source, CASE WHEN (doc_id // 10) % 4 = 0 THEN '' ELSE 'Điều ' || (doc_id // 10) END AS section, text FROM documents"


def expanded_sql(reranked: str) -> str:
    """A fold over each question's hits in order: what is taken so far grows from hit to hit; six members are offered at
    each, three of its section from the start and then three of its group without it."""

    def offer(rows: str, member: str, decay: float, method: str) -> str:
        take = f"SELECT *, {member} AS m FROM ({rows})"
        take = f"SELECT *, open AND added < 2 AND m IS NOT NULL AND NOT list_contains(seen, m) AS take FROM ({take})"
        return f"""SELECT qid, hits, i, h, CASE WHEN take THEN list_append(seen, m) ELSE seen END AS seen, CASE WHEN take THEN list_append(extra, {{'id': m, 's': h.s * {decay}, 'method': '{method}'}}) ELSE extra END AS extra,
added + CAST(take AS INTEGER) AS added, take AS open FROM ({take})"""

    step = "SELECT qid, hits, i, hits[i + 1] AS h, seen, extra, 0 AS added, hits[i + 1].section <> '' AS open FROM f WHERE i < len(hits)"
    for k in (1, 2, 3):
        step = offer(step, f"h.members[{k}]", 0.6, "hierarchical_section")
    step = f"SELECT * REPLACE (true AS open) FROM ({step})"
    for k in (1, 2, 3):
        step = offer(step, f"list_filter(h.members, lambda x: x <> h.id)[{k}]", 0.4, "hierarchical_parent")
    return f"""
WITH RECURSIVE r AS ({reranked}), c AS ({CHUNK_ROWS}), g AS (SELECT source, section, list(id ORDER BY id)[1:3] AS members FROM c GROUP BY ALL),
s AS (SELECT qid, list({{'id': r.id, 's': rerank_score, 'section': section, 'members': members}} ORDER BY rank) AS hits, list(r.id ORDER BY rank) AS seen FROM r JOIN c ON c.id = r.id JOIN g USING (source, section) GROUP BY qid),
f AS (SELECT qid, hits, 0 AS i, seen, CAST([] AS STRUCT(id BIGINT, s DOUBLE, method VARCHAR)[]) AS extra FROM s UNION ALL SELECT qid, hits, i + 1, seen, extra FROM ({step})),
x AS (SELECT qid, len(hits) AS k, unnest(extra) AS e, generate_subscripts(extra, 1) AS pos FROM f WHERE i = len(hits))
SELECT qid, rank AS ord, id, 'hit' AS method, round(rerank_score, 6) AS rerank_score FROM r UNION ALL SELECT qid, CAST(k + pos AS INTEGER), e.id, e.method, round(e.s, 6) FROM x
"""


EXPANDED_SQL = expanded_sql(RERANKED)


def gate(spark: SparkSession, sf_dir: str, high: float = 3.0, low: float = 1.0) -> DataFrame:
    out = A.gate(questions(spark, sf_dir), reranked_hits(spark, sf_dir), high, low)
    return out.select("qid", "crag.verdict", F.round("crag.top_score", 6).alias("top_score"), F.round("crag.avg_score", 6).alias("avg_score"))


def gate_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the thresholds that answering uses."""
    return gate(spark, sf_dir, 0.5, -2.0)


def gate_sql(high: float, low: float) -> str:
    return f"""
WITH r AS ({RERANKED}), g AS (SELECT qid, max(rerank_score) AS t, avg(rerank_score) AS m FROM r GROUP BY qid)
SELECT item_id AS qid, CASE WHEN t >= {high} THEN 'CORRECT' WHEN t >= {low} THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS verdict, round(coalesce(t, 0), 6) AS top_score, round(coalesce(m, 0), 6) AS avg_score FROM benchmark LEFT JOIN g ON qid = item_id
"""


def with_chunks(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """hits (qid, ord, id) with their chunks and questions: a few texts a question, read several times."""
    own = chunk_table(spark, sf_dir).drop("n", "semantic_tags")
    return io.staged(beside(hits, own, "id").join(questions(spark, sf_dir), "qid"))


def context_rows(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    return with_chunks(spark, sf_dir, io.staged(expanded_hits(spark, sf_dir, hits).select("qid", "ord", "id")))


def compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an embedder: short chunks whole, of long ones the first sentences, over the re-ranked hits."""
    return A.compressed(with_chunks(spark, sf_dir, reranked_hits(spark, sf_dir).select("qid", F.col("rank").alias("ord"), "id")), None)


VALID = f"list_filter({S.sentences('text')}, lambda s: length({S.strip('s')}) >= 15)"
COMPRESS_SQL = f"""
WITH r AS ({RERANKED}), c AS (SELECT qid, rank, text, 'b' || (doc_id // 40) AS source, CASE WHEN (doc_id // 10) % 4 = 0 THEN '' ELSE 'Điều ' || (doc_id // 10) END AS section FROM r JOIN documents ON doc_id = id),
p AS (SELECT qid, rank, '[' || source || ']' || CASE WHEN section <> '' THEN ' - ' || section ELSE '' END || chr(10) || CASE WHEN length(text) < 1500 THEN text ELSE {S.join(VALID + '[1:10]', ' ')} END AS part FROM c WHERE length(text) < 1500 OR len({VALID}) > 0)
SELECT qid, string_agg(part, chr(10) || chr(10) ORDER BY rank) AS context FROM p GROUP BY qid
"""


def compress_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of long chunks the sentences nearest to the question, over hits and their neighbours."""
    return A.compressed(context_rows(spark, sf_dir), DigestEmbedder())


def embedded_sql(rows: str, key: str, text: str) -> str:
    """key and the stand-in's vector of each text of rows."""
    digits = "list_transform(range(1, 33), lambda i: CAST(instr('0123456789abcdef', substr(md5(w), i, 1)) - 8.5 AS DOUBLE))"
    return f"""SELECT {key}, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT {key}, list(x ORDER BY d) AS v FROM
 (SELECT {key}, d, sum(x) AS x FROM (SELECT {key}, unnest(u.v) AS x, generate_subscripts(u.v, 1) AS d FROM (SELECT {key}, unnest({S.tokens(text)}) AS w FROM {rows}) JOIN
  (SELECT w, list_transform(g, lambda x: x / sqrt(list_dot_product(g, g))) AS v FROM (SELECT w, {digits} AS g FROM (SELECT DISTINCT unnest({S.tokens(text)}) AS w FROM {rows}))) u USING (w)) GROUP BY {key}, d) GROUP BY {key})"""


COMPRESS_WHOLE_SQL = f"""
WITH e AS ({EXPANDED_SQL}), c AS (SELECT e.qid, ord, text, source, section FROM e JOIN ({CHUNK_ROWS}) c ON c.id = e.id),
p AS (SELECT qid, ord, '[' || source || ']' || CASE WHEN section <> '' THEN ' - ' || section ELSE '' END || chr(10) || CASE WHEN length(text) < 1500 THEN text ELSE {S.join(VALID + '[1:10]', ' ')} END AS part FROM c WHERE length(text) < 1500 OR len({VALID}) > 0)
SELECT qid, string_agg(part, chr(10) || chr(10) ORDER BY ord) AS context FROM p GROUP BY qid
"""
def compress_semantic_sql(expanded: str, asked: str) -> str:
    return f"""
WITH e AS ({expanded}), asked AS ({asked}), c AS (SELECT e.qid, ord, c.text, '[' || source || ']' || CASE WHEN section <> '' THEN ' - ' || section ELSE '' END || chr(10) AS head, b.query FROM e JOIN ({CHUNK_ROWS}) c ON c.id = e.id JOIN asked b ON b.qid = e.qid),
v AS (SELECT *, list_filter(list_transform({S.sentences('text')}, lambda s, i: {{'i': i, 's': s}}), lambda x: length({S.strip('x.s')}) >= 15) AS ok FROM c WHERE length(text) >= 1500),
n AS (SELECT qid, ord, head, query, x.i AS i, x.s AS s FROM (SELECT qid, ord, head, query, unnest(ok) AS x FROM v WHERE len(ok) > 10)),
se AS ({embedded_sql('n', 'qid, ord, i', 's')}), qe AS ({embedded_sql('(SELECT qid AS q, query FROM asked)', 'q', 'query')}),
sc AS (SELECT n.*, round(coalesce(list_dot_product(se.v, qe.v), 0) + CASE WHEN regexp_matches(s, {S.lit(ARTICLE_REF + '|' + CLAUSE_REF)}) THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(s, {S.lit(CROSS_REF.replace("(?iu)", "(?i)"))}) THEN 0.1 ELSE 0 END, 6) AS score FROM n LEFT JOIN se USING (qid, ord, i) LEFT JOIN qe ON qe.q = n.qid),
t AS (SELECT qid, ord, head || string_agg(s, ' ' ORDER BY i) AS part FROM (SELECT *, row_number() OVER (PARTITION BY qid, ord ORDER BY score DESC, i) AS k FROM sc) WHERE k <= 10 GROUP BY qid, ord, head),
p AS (SELECT qid, ord, head || text AS part FROM c WHERE length(text) < 1500 UNION ALL SELECT qid, ord, head || {S.join('list_transform(ok, lambda x: x.s)', ' ')} FROM v WHERE len(ok) BETWEEN 1 AND 10 UNION ALL SELECT * FROM t)
SELECT qid, string_agg(part, chr(10) || chr(10) ORDER BY ord) AS context FROM p GROUP BY qid
"""


COMPRESS_SEMANTIC_SQL = compress_semantic_sql(EXPANDED_SQL, ASKED)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path with the offline stand-ins: variants, hits, re-ranking, expansion, gate, context, answer."""
    asked = questions(spark, sf_dir).withColumn("query_variants", A.variants(F.col("query"), DRIVER)).withColumn("hyde_hypothesis", ExtractiveGenerator(20).generate(F.col("query")))
    best = reranked_hits(spark, sf_dir)
    hits = io.staged(beside(best.select("qid", "id", "rank", "rerank_score"), chunk_table(spark, sf_dir, best).select("id", F.col("source"), "section", "semantic_tags"), "id"))
    out = A.answers(asked, hits, A.compressed(context_rows(spark, sf_dir, best), None), A.gate(asked, hits, 3.0, 1.0), ExtractiveGenerator())
    out = flat(out.withColumn("shown", A.displayed(F.col("answer"), F.col("sources"), F.col("sections"))))
    tags = F.transform("semantic_tags", lambda t: F.concat_ws("|", F.array_join(t["doi_tuong"], ","), F.array_join(t["loai_van_ban"], ","), t["do_quan_trong"]))
    return out.withColumn("semantic_tags", tags)


def flat(rows: DataFrame) -> DataFrame:
    """The gate's finding in columns of its own."""
    found = [F.col("crag.verdict").alias("verdict"), *[F.round(f"crag.{c}", 6).alias(c) for c in ("top_score", "avg_score")], F.col("crag.reason").alias("reason")]
    return rows.select(*[c for c in rows.columns if c != "crag"], *found)


def answers_sql(reranked: str, context: str, asked: str, high: float, low: float) -> str:
    """The path's parts put together: what the gate lets pass is answered with the first words of the prompt."""
    t = ANSWER_TEXTS
    text = lambda x: f"replace({S.lit(x)}, chr(92) || 'n', chr(10))"
    before, mid, after = (text(x.replace("\n", "\\n")) for x in t["context"].replace("{institution}", "").replace("{query}", "{context}").split("{context}"))
    meta_before, meta_after = (text(x.replace("\n", "\\n")) for x in t["meta"].replace("{query}", "").split("{meta}"))
    first = lambda x, n: S.join(rf"regexp_split_to_array(trim({x}), '\s+')[1:{n}]", " ")
    none = "CAST([] AS VARCHAR[])"
    tag = "{'doi_tuong': doi_tuong, 'loai_van_ban': loai_van_ban, 'do_quan_trong': do_quan_trong}"
    named = "array_to_string(x.doi_tuong, ',') || '|' || array_to_string(x.loai_van_ban, ',') || '|' || x.do_quan_trong"
    return f"""
WITH r AS ({reranked}), c AS ({CHUNK_ROWS}), tg AS (SELECT doc_id AS id, {TAGS} FROM documents), ctx AS ({context}), b AS ({asked}), v AS ({variants_sql_of(f"SELECT qid, query AS q FROM ({asked})")}),
g AS (SELECT b.qid, query, max(rerank_score) AS t, avg(rerank_score) AS m FROM b LEFT JOIN r ON r.qid = b.qid GROUP BY ALL),
k AS (SELECT qid, query, CASE WHEN t >= {high} THEN 'CORRECT' WHEN t >= {low} THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS verdict, coalesce(t, 0) AS top_score, coalesce(m, 0) AS avg_score,
 CASE WHEN t IS NULL THEN {S.lit(t["no_hits"])} WHEN t >= {high} THEN 'Top reranker score ' || printf('%.2f', t) || ' >= {high}' WHEN t >= {low} THEN 'Score ' || printf('%.2f', t) || ' ở vùng không chắc chắn' ELSE 'Top score ' || printf('%.2f', t) || ' < {low} — context không liên quan' END AS reason FROM g),
h AS (SELECT r.qid, list(source ORDER BY rank) AS sources, list(section ORDER BY rank) AS sections, list(rerank_score ORDER BY rank) AS scores, list({tag} ORDER BY rank) AS tags FROM r JOIN c ON c.id = r.id JOIN tg ON tg.id = r.id GROUP BY r.qid),
j AS (SELECT k.*, variants, coalesce(context, '') AS context, coalesce(sources, []) AS sources, coalesce(sections, []) AS sections, coalesce(scores, []) AS scores, tags,
 array_to_string(list_sort(list_distinct(flatten(list_transform(coalesce(tags, []), lambda x: list_concat(list_transform(x.doi_tuong, lambda y: {S.lit(t["audience"])} || y), list_transform(x.loai_van_ban, lambda y: {S.lit(t["kind"])} || y)))))), ' | ') AS meta
 FROM k LEFT JOIN h ON h.qid = k.qid LEFT JOIN ctx ON ctx.qid = k.qid JOIN v ON v.qid = k.qid),
p AS (SELECT *, CASE WHEN context <> '' THEN {before} || CASE WHEN verdict = 'AMBIGUOUS' THEN {text(t["caution"].replace(chr(10), chr(92) + "n"))} ELSE '' END || context || {mid} || query || {after} WHEN meta <> '' THEN {meta_before} || meta || {meta_after} || query ELSE query END AS prompt FROM j),
a AS (SELECT *, verdict <> 'INCORRECT' AS ok, CASE WHEN verdict = 'INCORRECT' THEN {S.lit(t["rejected"])} ELSE {first("prompt", 40)} END AS answer FROM p),
o AS (SELECT *, CASE WHEN ok THEN sources ELSE {none} END AS src, CASE WHEN ok THEN sections ELSE {none} END AS sec FROM a)
SELECT qid, variants AS query_variants, {first("query", 20)} AS hyde_hypothesis, verdict, round(top_score, 6) + 0.0 AS top_score, round(avg_score, 6) + 0.0 AS avg_score, reason, answer, src AS sources, sec AS sections, scores AS retrieval_scores, CASE WHEN ok THEN list_transform(tags, lambda x: {named}) END AS semantic_tags,
 CASE WHEN ok THEN {S.lit(MODES["rag"])} ELSE {S.lit(MODES["rejected"])} END AS mode,
 answer || CASE WHEN len(src) > 0 THEN {text(t["sources"].replace(chr(10), chr(92) + "n"))} || array_to_string(list_transform(list_filter(src[1:3], lambda x, i: NOT list_contains(src[1:i - 1], x)), lambda x: x), ', ') ELSE '' END
  || CASE WHEN len(list_filter(sec[1:3], lambda x: x <> '')) > 0 THEN {text(t["sections"].replace(chr(10), chr(92) + "n"))} || array_to_string(list_filter(sec[1:3], lambda x: x <> ''), ', ') ELSE '' END AS shown
FROM o
"""


def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns answered end to end over documents as chunks, with the offline stand-ins."""
    chunks = chunk_table(spark, sf_dir).withColumn("text_for_retrieval", F.col("text")).withColumn("text_for_generation", F.col("text"))
    models = Models(embedder=DigestEmbedder())
    out = answer(turns(spark, sf_dir), chunks, embedded(chunks, models.embedder), models, DRIVER)
    return flat(out.select("qid", "answer", "sources", "query_variants", "crag", "mode"))


def rag_sql() -> str:
    """Dense lists of all variants and the hypothesis, then sparse ones of the variants; fused, re-ranked, expanded, answered."""
    first = S.join(r"regexp_split_to_array(trim(query), '\s+')[1:20]", " ")
    chunks = f"SELECT doc_id AS id, 'b' || (doc_id // 40) AS source, text, {TAGS} FROM documents"
    hits = f"""
WITH sg AS ({signatures_sql(chunks)}), v AS ({variants_sql_of(f"SELECT qid, query AS q FROM ({QUESTIONS})")}), w AS (SELECT qid, query, variants, {first} AS hyde FROM ({QUESTIONS}) JOIN v USING (qid)),
l AS (SELECT qid, unnest(xs) AS t, generate_subscripts(xs, 1) - 1 AS list_no FROM (SELECT qid, list_concat(variants, CASE WHEN hyde <> '' THEN [hyde] ELSE [] END) AS xs FROM w)),
u AS (SELECT qid, unnest(variants) AS query, generate_subscripts(variants, 1) - 1 AS list_no FROM w),
le AS ({embedded_sql('l', 'qid, list_no', 't')}), ce AS ({embedded_sql('documents', 'doc_id', 'text')}),
ds AS (SELECT l.qid, l.list_no, d.doc_id AS id, round(coalesce(list_dot_product(le.v, ce.v), 0), 6) AS score FROM l CROSS JOIN documents d LEFT JOIN le ON le.qid = l.qid AND le.list_no = l.list_no LEFT JOIN ce ON ce.doc_id = d.doc_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid, list_no ORDER BY score DESC, id) AS rank FROM ds),
de AS (SELECT dr.qid, list_no, rank, id FROM dr JOIN sg ON sg.qid = dr.qid WHERE rank <= 20 AND (sources IS NULL OR list_contains(sources, 'b' || (id // 40)))),
sp AS ({bm25_filtered_sql('SELECT * FROM sg', chunks, "SELECT qid * 100 + list_no AS sub, qid, query FROM u")}),
a AS (SELECT * FROM de UNION ALL SELECT sub // 100, 1000 + sub % 100, rank, id FROM sp), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY list_no, rank) AS place FROM a),
f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score, min(place) AS first FROM p GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM f) SELECT qid, id, score, rank FROM r WHERE rank <= 20
"""
    context = compress_semantic_sql(expanded_sql("SELECT * FROM rr"), QUESTIONS)
    return f"""WITH rr AS MATERIALIZED ({reranked_sql(hits, QUESTIONS)})
SELECT qid, answer, sources, query_variants, verdict, top_score, avg_score, reason, mode FROM ({answers_sql("SELECT * FROM rr", context, QUESTIONS, 0.5, -2.0)})"""


RAG_SQL = rag_sql()


def plain_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plain_answers(turns(spark, sf_dir), ExtractiveGenerator(12)).select("qid", "answer", "mode")


PLAIN_SQL = rf"SELECT qid, {S.join('list_filter(regexp_split_to_array(trim(query), ' + chr(39) + chr(92) + 's+' + chr(39) + '), lambda x, i: i <= 12)', ' ')} AS answer, 'No-RAG' AS mode FROM ({QUESTIONS})"


def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that arrive as files are answered as they come; a third arrives twice and is answered once."""
    arriving, made, marks = (io.scratch(spark) for _ in range(3))
    asked = turns(spark, sf_dir)
    asked.write.parquet(arriving)
    asked.where("qid % 3 = 0").write.mode("append").parquet(arriving)
    reply = lambda rows: A.plain_answers(rows, ExtractiveGenerator(12)).select("qid", "answer")
    I.stream_documents(spark, arriving, "qid bigint, query string", reply, I.merge_done(made, "qid"), marks).awaitTermination()
    return spark.read.schema("qid bigint, answer string").parquet(made)


def queries() -> dict:
    return {
        "hybrid_rrf_top5": hybrid_rrf_top5, "dense_topk": dense_topk, "index_topk": index_topk, "dense_topk_filtered": dense_filtered, "bm25_topk": bm25_topk, "posting_topk": posting_topk,
        "bm25_filtered": bm25_filtered, "rrf_concat": rrf_concat, "rrf_per_list": rrf_per_list, "query_variants": query_variants,
        "rerank": rerank, "expand_siblings": expand, "crag_gate": gate, "crag_gate_default": gate_default, "compress_context": compress,
        "compress_semantic": compress_semantic, "answer_rows": answers, "rag_answer": rag_answer, "plain_answers": plain_answers, "stream_answers": stream_answers,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "hybrid_rrf_top5": fused_sql(PLACE, PLACE, 5), "dense_topk": dense_sql(20), "index_topk": dense_sql(20), "dense_topk_filtered": DENSE_FILTERED_SQL, "bm25_topk": BM25_SQL, "posting_topk": BM25_SQL, "expand_siblings": EXPANDED_SQL, "compress_semantic": COMPRESS_SEMANTIC_SQL, "answer_rows": answers_sql(RERANKED, COMPRESS_WHOLE_SQL, ASKED, 3.0, 1.0), "rag_answer": RAG_SQL,
        "bm25_filtered": BM25_FILTERED_SQL, "rrf_concat": fused_sql(PLACE, PLACE, 20), "rrf_per_list": fused_sql("rank", "(list_no, rank)", 20), "query_variants": variants_sql(),
        "rerank": f"SELECT qid, id, rerank_score, rank FROM ({RERANKED})", "crag_gate": gate_sql(3.0, 1.0), "crag_gate_default": gate_sql(0.5, -2.0), "compress_context": COMPRESS_SQL, "plain_answers": PLAIN_SQL, "stream_answers": f"SELECT qid, answer FROM ({PLAIN_SQL})",
    }
