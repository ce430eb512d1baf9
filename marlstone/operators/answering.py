"""From ranked hits to answers: question variants, re-ranking, expansion, the relevance gate, compression, prompts."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import beside, is_small, join_same, union_all
from ..functions.rules import ANSWER_TEXTS, ARTICLE_REF, CLAUSE_REF, CROSS_REF, MODES, VIETNAMESE, RuleSet
from ..functions.text import dot, header_line, sentences, strip
from ..sources.providers import Embedder, Generator, Reranker


def rewritten(query: Column, pairs) -> Column:
    """Phrases that the question holds (in any case) replaced one after the other, in the running text."""
    low = F.lower(query)
    rules = F.array(*[F.struct(F.lit(a.lower()).alias("k"), F.lit(f"(?iu){re.escape(a)}").alias("p"), F.lit(b).alias("v")) for a, b in pairs])
    return F.aggregate(rules, query, lambda r, x: F.when(F.contains(low, x["k"]), F.regexp_replace(r, x["p"], x["v"])).otherwise(r))


def variants(query: Column, rules: RuleSet = VIETNAMESE) -> Column:
    """The question, its formal wording if that differs, and the article (and clause) that it names."""
    formal = rewritten(query, rules.synonyms)
    article, clause = (F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in (ARTICLE_REF, CLAUSE_REF))
    every = F.array(query, F.when(formal != query, formal), F.concat(F.lit("Điều "), article), F.concat(F.lit("Điều "), article, F.lit(" Khoản "), clause))
    return F.filter(every, lambda v: v.isNotNull())


def reranked(hits: DataFrame, scorer: Reranker, k: int = VIETNAMESE.sizes.rerank_k) -> DataFrame:
    """hits (qid, query, id, text, rank, ...): adds rerank_score and rank anew, the k best; ties keep their order."""
    scored = hits.withColumn("rerank_score", F.round(scorer.score(F.col("query"), F.col("text")), 6)).withColumnRenamed("rank", "fused_rank")
    order = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def expanded(hits: DataFrame, chunks: DataFrame, most: int = VIETNAMESE.sizes.extra) -> DataFrame:
    """hits (qid, rank, id, score, rerank_score) of chunks (id, source, section, n) -> the hits and up to `most` neighbours
    of each: (qid, ord, id, score, rerank_score, method).

    A hit's section is walked from its start until a chunk that is taken already (the hit itself ends it too); then,
    with room left, the group without the hit. What is taken grows from hit to hit, so a question's few hits are folded
    in order. Only a group's first members can be reached: each group is cut to those before it is joined. Chunks of other
    groups than the hits' go where they lie. hits are read several times, so they should be kept.
    """
    place = Window.partitionBy("source", "section").orderBy("n")
    found = beside(hits.select("qid", "rank", "id", "score", "rerank_score"), chunks.select("id", "source", "section"), "id")
    groups = found.select("source", "section").distinct()
    near = join_same(chunks.select("id", "source", "section", "n"), F.broadcast(groups) if is_small(hits) else groups, ["source", "section"], "left_semi")
    heads = near.withColumn("k", F.row_number().over(place)).where(F.col("k") <= most + 1).groupBy("source", "section").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("members"))
    known = join_same(found, heads, ["source", "section"])
    hit = F.struct("rank", "id", "score", "rerank_score", "section", "members")
    sets = known.groupBy("qid").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    extra = "array<struct<id:{t},score:double,rerank_score:double,method:string>>".format(t=dict(chunks.dtypes)["id"])
    start = F.struct(F.transform("hits", lambda h: h["id"]).alias("seen"), F.expr(f"cast(array() as {extra})").alias("extra"))

    def offer(s: Column, h: Column, m: Column, decay: float, method: str) -> Column:
        """One member offered: s has seen, extra, added, open."""
        take = s["open"] & (s["added"] < most) & ~F.array_contains(s["seen"], m)
        new = F.struct(m.alias("id"), (h["score"] * decay).alias("score"), (h["rerank_score"] * decay).alias("rerank_score"), F.lit(method).alias("method"))
        return F.struct(
            F.when(take, F.concat(s["seen"], F.array(m))).otherwise(s["seen"]).alias("seen"),
            F.when(take, F.concat(s["extra"], F.array(new))).otherwise(s["extra"]).alias("extra"),
            (s["added"] + take.cast("int")).alias("added"),
            take.alias("open"),
        )

    def walk(s: Column, h: Column) -> Column:
        first = F.struct(s["seen"].alias("seen"), s["extra"].alias("extra"), F.lit(0).alias("added"), (h["section"] != "").alias("open"))
        section = F.aggregate(h["members"], first, lambda a, m: offer(a, h, m, 0.6, "hierarchical_section"), lambda a: F.struct(a["seen"].alias("seen"), a["extra"].alias("extra"), a["added"].alias("added"), F.lit(True).alias("open")))
        others = F.filter(h["members"], lambda m: m != h["id"])
        return F.aggregate(others, section, lambda a, m: offer(a, h, m, 0.4, "hierarchical_parent"), lambda a: F.struct(a["seen"].alias("seen"), a["extra"].alias("extra")))

    added = sets.select("qid", F.size("hits").alias("k"), F.posexplode(F.aggregate("hits", start, walk, lambda s: s["extra"])).alias("pos", "x"))
    added = added.select("qid", (F.col("k") + F.col("pos") + 1).alias("ord"), "x.id", "x.score", "x.rerank_score", "x.method")
    return union_all(hits.select("qid", F.col("rank").alias("ord"), "id", "score", "rerank_score", F.lit("hit").alias("method")), added)


def gate(queries: DataFrame, hits: DataFrame, high: float = 0.5, low: float = -2.0) -> DataFrame:
    """(qid, crag): the verdict on the best re-ranked score of each question; one without hits is INCORRECT with 0."""
    best = hits.groupBy("qid").agg(F.max("rerank_score").alias("top"), F.avg("rerank_score").alias("mean"))
    top = F.col("top")
    verdict = F.when(top >= high, "CORRECT").when(top >= low, "AMBIGUOUS").otherwise("INCORRECT")
    two = F.replace(F.format_number(top, 2), F.lit(","), F.lit(""))  # halves to even, as the value is in binary
    reason = (
        F.when(top.isNull(), ANSWER_TEXTS["no_hits"])
        .when(top >= high, F.concat(F.lit("Top reranker score "), two, F.lit(f" >= {high}")))
        .when(top >= low, F.concat(F.lit("Score "), two, F.lit(" ở vùng không chắc chắn")))
        .otherwise(F.concat(F.lit("Top score "), two, F.lit(f" < {low} — context không liên quan")))
    )
    crag = F.struct(verdict.alias("verdict"), F.coalesce(top, F.lit(0.0)).alias("top_score"), F.coalesce("mean", F.lit(0.0)).alias("avg_score"), reason.alias("reason"))
    return queries.select("qid").join(best, "qid", "left").select("qid", crag.alias("crag"))


def compressed(hits: DataFrame, embedder: Embedder | None = None, rules: RuleSet = VIETNAMESE) -> DataFrame:
    """hits (qid, query, ord, id, source, chapter, section, text) -> (qid, context).

    Short chunks stay whole; of longer ones the sentences stay that are nearest to the question (references weigh a little
    more), in their own order; without an embedder the first ones.
    """
    size = rules.sizes
    head = F.concat(header_line(F.col("source"), F.col("chapter"), F.col("section")), F.lit("\n"))
    short = hits.where(F.length("text") < size.verbatim).select("qid", "ord", F.concat(head, F.col("text")).alias("part"))
    long = hits.where(F.length("text") >= size.verbatim).withColumn("head", head)
    valid = F.filter(F.transform(sentences(F.col("text")), lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: F.length(strip(x["s"])) >= size.context_sentence)
    long = long.withColumn("valid", valid).where(F.size("valid") > 0)
    few = long if embedder is None else long.where(F.size("valid") <= size.sentences)
    few = few.select("qid", "ord", F.concat("head", F.array_join(F.transform(F.slice("valid", 1, size.sentences), lambda x: x["s"]), " ")).alias("part"))
    parts = union_all(short, few)
    if embedder is not None:
        many = long.where(F.size("valid") > size.sentences).select("qid", "query", "ord", "head", F.explode("valid").alias("x"))
        score = dot(embedder.embed(F.col("x.s")), embedder.embed(F.col("query")))
        score = score + F.when(F.col("x.s").rlike(f"{ARTICLE_REF}|{CLAUSE_REF}"), 0.15).otherwise(0.0) + F.when(F.col("x.s").rlike(CROSS_REF), 0.1).otherwise(0.0)
        best = Window.partitionBy("qid", "ord").orderBy(F.desc(F.round("score", 6)), "x.i")
        top = many.withColumn("score", score).withColumn("k", F.row_number().over(best)).where(F.col("k") <= size.sentences)
        top = top.groupBy("qid", "ord", "head").agg(F.sort_array(F.collect_list(F.struct("x.i", "x.s"))).alias("xs"))
        parts = union_all(parts, top.select("qid", "ord", F.concat("head", F.array_join(F.transform("xs", lambda x: x["s"]), " ")).alias("part")))
    whole = parts.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("ord", "part"))).alias("ps"))
    return whole.select("qid", F.array_join(F.transform("ps", lambda p: p["part"]), "\n\n").alias("context"))


def cautioned(context: Column, verdict: Column) -> Column:
    return F.when(verdict == "AMBIGUOUS", F.concat(F.lit(ANSWER_TEXTS["caution"]), context)).otherwise(context)


def meta_line(tags: Column) -> Column:
    """Of an array of semantic tags: the distinct audiences and kinds, sorted, in a line."""
    named = lambda field, key: F.transform(F.flatten(F.transform(tags, lambda t: t[field])), lambda x: F.concat(F.lit(ANSWER_TEXTS[key]), x))
    return F.array_join(F.array_sort(F.array_distinct(F.concat(named("doi_tuong", "audience"), named("loai_van_ban", "kind")))), " | ")


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places filled by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def prompt(query: Column, context: Column, meta: Column, institution: str = "") -> Column:
    """What the generator is asked: with context, else with a line of tags, else the bare question. institution: whose
    rules the context is from, for its heading."""
    with_text = filled(ANSWER_TEXTS["context"], context=context, query=query, institution=F.lit(f" {institution}" if institution else ""))
    return F.when(F.coalesce(context, F.lit("")) != "", with_text).when(F.coalesce(meta, F.lit("")) != "", filled(ANSWER_TEXTS["meta"], meta=meta, query=query)).otherwise(query)


def answers(queries: DataFrame, hits: DataFrame, context: DataFrame, crag: DataFrame, generator: Generator) -> DataFrame:
    """One answer row a question: generated where the gate lets it pass, the fixed reply where not. Refused questions
    never reach the generator."""
    per = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "section", "rerank_score", "semantic_tags"))).alias("hs"))
    rows = queries.select("qid", "query", "query_variants", "hyde_hypothesis").join(crag, "qid").join(per, "qid", "left").join(context, "qid", "left")
    pick = lambda f: F.transform("hs", lambda h: h[f])
    rows = rows.withColumn("hs", F.coalesce("hs", F.slice(F.col("hs"), 1, 0), F.expr("filter(hs, x -> false)")))
    common = ["qid", "query_variants", "hyde_hypothesis", "crag"]
    scores = F.coalesce(pick("rerank_score"), F.expr("cast(array() as array<double>)"))
    passed = rows.where("crag.verdict <> 'INCORRECT'").withColumn("prompt", prompt(F.col("query"), cautioned(F.col("context"), F.col("crag.verdict")), meta_line(pick("semantic_tags"))))
    passed = passed.select(*common, generator.generate(F.col("prompt")).alias("answer"), pick("source").alias("sources"), pick("section").alias("sections"), scores.alias("retrieval_scores"), pick("semantic_tags").alias("semantic_tags"), F.lit(MODES["rag"]).alias("mode"))
    none = F.expr("cast(array() as array<string>)")
    kind = dict(passed.dtypes)["semantic_tags"]
    refused = rows.where("crag.verdict = 'INCORRECT'").select(*common, F.lit(ANSWER_TEXTS["rejected"]).alias("answer"), none.alias("sources"), none.alias("sections"), scores.alias("retrieval_scores"), F.lit(None).cast(kind).alias("semantic_tags"), F.lit(MODES["rejected"]).alias("mode"))
    return union_all(passed, refused)


def plain_answers(queries: DataFrame, generator: Generator) -> DataFrame:
    """Answers without retrieval."""
    none = F.expr("cast(array() as array<string>)")
    return queries.select("qid", generator.generate(F.col("query")).alias("answer"), none.alias("sources"), none.alias("sections"), F.expr("cast(array() as array<double>)").alias("retrieval_scores"), none.alias("query_variants"), F.lit(MODES["plain"]).alias("mode"))


def displayed(answer: Column, sources: Column, sections: Column) -> Column:
    """The answer with its first three sources (each once) and sections."""
    first = F.array_distinct(F.slice(sources, 1, 3))
    named = F.filter(F.slice(sections, 1, 3), lambda s: s != "")
    return F.concat(answer, F.when(F.size(sources) > 0, F.concat(F.lit(ANSWER_TEXTS["sources"]), F.array_join(first, ", "))).otherwise(""), F.when(F.size(named) > 0, F.concat(F.lit(ANSWER_TEXTS["sections"]), F.array_join(named, ", "))).otherwise(""))
