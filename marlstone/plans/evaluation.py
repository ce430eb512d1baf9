"""The evaluation of configurations, from questions to the results file, and the cross-encoder's slot."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import beside
from ..operators import answering as A
from ..operators import retrieval as R
from ..operators.evaluation import Run
from ..sources import io
from ..sources.providers import CrossEncoder, ExtractiveGenerator, SharedWords
from . import _sql as S
from .cleaning import table
from .qa import bert_sql, bleu_sql, rouge_sql
from .retrieval import BM25_SQL, PLACE, bm25_topk, corpus, fused_sql, fused_texts, questions

LABELS = {"A": "plain, short", "B": "best hit, short", "C": "plain, long", "D": "best hit, long"}
WORDS = {"A": 6, "B": 20, "C": 12, "D": 40}


def answerers(spark: SparkSession, sf_dir: str) -> dict:
    """By configuration: A and C say the question's first words, B and D the best hit's; B and D name the sources of five hits."""
    hits = io.staged(beside(io.staged(bm25_topk(spark, sf_dir).where("rank <= 5")), corpus(spark, sf_dir), "id"))
    listed = hits.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("sources"))
    best = hits.where("rank = 1").select("qid", "text")
    none = F.expr("cast(array() as array<string>)")

    def plain(words: int):
        return lambda asked: asked.select("qid", ExtractiveGenerator(words).generate(F.col("question")).alias("prediction"), none.alias("sources"))

    def informed(words: int):
        return lambda asked: asked.join(best, "qid").join(listed, "qid").select("qid", ExtractiveGenerator(words).generate(F.col("text")).alias("prediction"), "sources")

    return {c: (informed if c in "BD" else plain)(WORDS[c]) for c in LABELS}


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All configurations over the benchmark: a first attempt that gets as far as the even questions, then a second that
    goes on. The results file is read back; times are the clock's and not compared."""
    asked = questions(spark, sf_dir).withColumnRenamed("query", "question")
    run, by = Run(spark, io.scratch(spark)), answerers(spark, sf_dir)
    for part in (asked.where("qid % 2 = 0"), asked):
        for config, answerer in by.items():
            run.answer(config, part, answerer)
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("source").alias("gold_source")).dropDuplicates(["qid"])
    gold = asked.select("qid", F.col("question").alias("gold")).join(sources, "qid", "left")
    out = run.results(gold, LABELS)
    return out.select("config", "label", *[F.round(c, 6).alias(c) for c in ("bleu", "rouge_l", "bertscore_f1", "recall_at_5")], "num_samples", "success", "error", "skip", "chars", "runs")


FIRST = lambda x, n: S.join(rf"regexp_split_to_array(trim({x}), '\s+')[1:{n}]", " ")
RUN_PREDICTIONS = f"""
SELECT q.config, b.item_id AS qid, b.text AS gold, CASE WHEN q.rag THEN {FIRST('d.text', 'q.n')} ELSE {FIRST('b.text', 'q.n')} END AS prediction, CASE WHEN q.rag THEN l.sources ELSE [] END AS sources, gs.source AS gold_source, q.rag
FROM benchmark b CROSS JOIN (VALUES ('A', 6, false), ('B', 20, true), ('C', 12, false), ('D', 40, true)) q(config, n, rag)
LEFT JOIN (SELECT qid, list(source ORDER BY rank) AS sources, min_by(id, rank) AS id FROM ({BM25_SQL}) JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY qid) l ON l.qid = b.item_id
LEFT JOIN documents d ON d.doc_id = l.id LEFT JOIN documents gs ON gs.doc_id = b.item_id WHERE NOT q.rag OR l.id IS NOT NULL
"""
EVALUATION_SQL = f"""
WITH p AS MATERIALIZED ({RUN_PREDICTIONS}), bl AS ({bleu_sql('SELECT * FROM p')}), ro AS ({rouge_sql('SELECT * FROM p')}), be AS (SELECT config, round(avg(f1) * 100, 6) AS bertscore_f1 FROM ({bert_sql('SELECT * FROM p').replace('round(CASE WHEN precision + recall', 'CASE WHEN precision + recall').replace('ELSE 0 END, 6) AS f1', 'ELSE 0 END AS f1')}) GROUP BY config),
c AS (SELECT config, count(*) AS success, sum(length(prediction)) AS chars, count(*) FILTER (qid % 2 = 0) AS again, round(CASE WHEN bool_or(rag) THEN avg(CASE WHEN len(list_filter(sources[1:5], lambda s: contains(lower(s), lower(gold_source)))) > 0 THEN 1 ELSE 0 END) * 100 END, 6) AS recall_at_5 FROM p GROUP BY config),
n AS (SELECT count(*) AS n, count(*) FILTER (item_id % 2 = 0) AS even FROM benchmark)
SELECT config, CASE config WHEN 'A' THEN 'plain, short' WHEN 'B' THEN 'best hit, short' WHEN 'C' THEN 'plain, long' ELSE 'best hit, long' END AS label, bleu, rouge_l, bertscore_f1, recall_at_5, CAST(success AS INTEGER) AS num_samples, success, CAST((even - again) + (n - again - (success - again)) AS BIGINT) AS error, again AS skip, CAST(chars AS BIGINT) AS chars, CAST(2 AS BIGINT) AS runs
FROM c JOIN bl USING (config) JOIN ro USING (config) JOIN be USING (config), n
"""


def cross_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each question's fused hits by a model that reads pairs in batches, cut to 256 words a pair."""
    return A.reranked(fused_texts(spark, sf_dir), CrossEncoder(SharedWords(), limit=256), 5).select("qid", "id", "rerank_score", "rank")


PAIR_WORDS = lambda x: rf"list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w: w <> '')"
CROSS_ENCODER_SQL = f"""
WITH h AS ({fused_sql(PLACE, PLACE, 20)}), x AS (SELECT qid, h.id, rank AS fused, {PAIR_WORDS('b.text')} AS a, {PAIR_WORDS('d.text')} AS t FROM h JOIN benchmark b ON item_id = qid JOIN documents d ON doc_id = h.id),
k AS (SELECT *, CASE WHEN len(a) + len(t) <= 256 THEN greatest(len(a), len(t)) WHEN least(len(a), len(t)) <= 128 THEN 256 - least(len(a), len(t)) ELSE 128 END AS keep FROM x),
c AS (SELECT qid, id, fused, CASE WHEN len(a) + len(t) <= 256 THEN a WHEN len(a) >= len(t) THEN a[1:keep] ELSE a[1:256 - keep] END AS a, CASE WHEN len(a) + len(t) <= 256 THEN t WHEN len(a) >= len(t) THEN t[1:256 - keep] ELSE t[1:keep] END AS t FROM k),
s AS (SELECT qid, id, fused, round(-5 + 10 * CAST(len(list_filter(list_distinct(a), lambda w: list_contains(t, w))) AS DOUBLE) / greatest(1, len(list_distinct(a))), 6) AS rerank_score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, fused) AS rank FROM s)
SELECT qid, id, rerank_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
"""


def queries() -> dict:
    return {"evaluation_run": evaluation_run, "cross_encoder": cross_encoder}


def oracle_sql() -> dict[str, str]:
    return {"evaluation_run": EVALUATION_SQL, "cross_encoder": CROSS_ENCODER_SQL}
