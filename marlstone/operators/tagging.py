"""Keyword tags, topics and the question-side filters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import is_small, once, union_all
from ..functions.rules import VIETNAMESE, RuleSet
from ..functions.text import contains_any
from .chunking import bound


def labels(low: Column, table, default: str) -> Column:
    """Labels of table any of whose words the lower-case text holds, in the table's order; the default if none."""
    found = F.filter(F.array(*[F.when(contains_any(low, words), F.lit(label)) for label, words in table]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def semantic_tags(text: Column, rules: RuleSet = VIETNAMESE) -> Column:
    """struct(doi_tuong, loai_van_ban, do_quan_trong): audience, kind and importance of a chunk."""
    high, usual = rules.importance
    found = lambda low: F.struct(
        labels(low, rules.audience, rules.audience_default).alias("doi_tuong"),
        labels(low, rules.kinds, rules.kind_default).alias("loai_van_ban"),
        F.when(contains_any(low, rules.important), high).otherwise(usual).alias("do_quan_trong"),
    )
    return bound(F.lower(text), found)  # in lower case once, not once a word that is looked for


def topics(text: Column, rules: RuleSet = VIETNAMESE) -> Column:
    """Names of the topics whose pattern the lower-case text matches, in order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in rules.topics]), lambda x: x.isNotNull())


def topic_sources(chunks: DataFrame, rules: RuleSet = VIETNAMESE) -> DataFrame:
    """(topic, source): which sources touch a topic; chunks are reduced to distinct pairs before the shuffle."""
    return chunks.select("source", F.explode(topics(F.col("text"), rules)).alias("topic")).distinct()


def tag_index(chunks: DataFrame) -> DataFrame:
    """(tag, n_chunks) over the audience tags."""
    return chunks.select(F.explode("semantic_tags.doi_tuong").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_chunks"))


def importance_index(chunks: DataFrame) -> DataFrame:
    """(importance, n_chunks)."""
    return chunks.groupBy(F.col("semantic_tags.do_quan_trong").alias("importance")).agg(F.count(F.lit(1)).alias("n_chunks"))


def audience_of(query: Column, rules: RuleSet = VIETNAMESE) -> Column:
    """The audience that a question names: the first rule that occurs, or null."""
    low = F.lower(query)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in rules.audience_of_query], F.lit(None).cast("string"))


def topic_filters(queries: DataFrame, chunks: DataFrame, rules: RuleSet = VIETNAMESE, least: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(qid, set or null, audience or null): what each question's filter keeps, and the sets (set, source).

    Questions of the same topics share a set, so there are no more sets than combinations of topics, and no question meets
    a source. Both guards look at counts only: chunks by source and audience tag are counted once. Rows of one qid are one
    question with the topics of all; its audiences' counts add up.
    """
    least = rules.sizes.least_results if least is None else least
    rows = queries.select("qid", audience_of(F.col("query"), rules).alias("audience"), topics(F.col("query"), rules).alias("topics"))
    same = Window.partitionBy("qid")
    rows = rows.withColumn("topics", F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics").over(same)))))
    rows = keep(rows.withColumn("set", F.when(F.col("qid").isNotNull() & (F.size("topics") > 0), F.md5(F.to_json(F.struct("topics")).cast("binary")))))
    named = rows.where("set is not null").select("set", "topics").dropDuplicates(["set"])
    # Texts are read for topics and tags once; what is looked at below has no text.
    chunks = keep(once(chunks.select("source", "semantic_tags", "text"), tags=F.col("semantic_tags.doi_tuong"), topics=topics(F.col("text"), rules)).select("source", "tags", "topics"))
    touched = chunks.select("source", F.explode("topics").alias("topic")).distinct()
    sets = named.select("set", F.explode("topics").alias("topic")).join(touched, "topic").select("set", "source").distinct()
    sized = sets.join(chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source")
    known = sized.groupBy("set").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("set", F.lit(True).alias("known"))
    sets = keep(sets.join(known.drop("known"), "set", "left_semi"))
    asked = rows.join(F.broadcast(known), "set", "left").select("qid", F.when(F.col("known"), F.col("set")).alias("set"), "audience")
    counts = chunks.select("source", F.explode("tags").alias("tag"), F.array_contains("tags", rules.audience_default).alias("open"))
    # A chunk counts for each of its tags and, once, for all: under the name of no audience.
    own = F.when(F.col("tag") == rules.audience_default, F.lit(None).cast("string")).otherwise(F.col("tag"))
    counts = keep(counts.where(~F.col("open") | (F.col("tag") == rules.audience_default)).select("source", own.alias("tag")).groupBy("source", "tag").agg(F.count(F.lit(1)).alias("n")))
    by_set = union_all(counts.join(sets, "source").groupBy("set", "tag").agg(F.sum("n").alias("n")), counts.groupBy("tag").agg(F.sum("n").alias("n")).withColumn("set", F.lit("")))
    pairs = asked.where("audience is not null").select(F.coalesce("set", F.lit("")).alias("scope"), "audience").distinct()
    kept = pairs.join(by_set, (F.col("scope") == F.col("set")) & F.coalesce(F.col("tag") == F.col("audience"), F.lit(True))).groupBy("scope", "audience").agg(F.sum("n").alias("kept"))
    asked = asked.withColumn("scope", F.coalesce("set", F.lit(""))).join(F.broadcast(kept), ["scope", "audience"], "left")
    enough = F.col("qid").isNotNull() & (F.coalesce(F.sum("kept").over(same), F.lit(0)) >= least)
    return keep(asked.select("qid", "set", F.when(enough, F.col("audience")).alias("audience"))), sets


def filter_signatures(queries: DataFrame, chunks: DataFrame, rules: RuleSet = VIETNAMESE, least: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """topic_filters() with each question's sources spelled out: (qid, sources or null, audience or null)."""
    asked, sets = topic_filters(queries, chunks, rules, least, keep)
    listed = sets.groupBy("set").agg(F.sort_array(F.collect_list("source")).alias("sources"))  # a row a combination of topics
    return asked.join(F.broadcast(listed), "set", "left").select("qid", "sources", "audience")


def source_sets(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries with lists of sources -> the same with the set that a list is (null: all), and the sets (set, source)."""
    own = F.md5(F.to_json(F.struct(F.array_sort(F.array_distinct("sources")).alias("x"))).cast("binary"))
    named = queries.withColumn("set", F.when(F.col("sources").isNotNull(), own))
    sets = named.where("set is not null").select("set", "sources").dropDuplicates(["set"])
    return named.drop("sources"), sets.select("set", F.explode(F.array_distinct("sources")).alias("source"))


def in_classes(chunks: DataFrame, sets: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """chunks with cls, which sources that lie in the same sets share ('' in none), and which classes a set holds
    (set, cls); the set '' holds all."""
    of = sets.distinct().groupBy("source").agg(F.sort_array(F.collect_set("set")).alias("held"))
    of = keep(of.select("source", "held", F.md5(F.array_join("held", ",").cast("binary")).alias("cls")))
    members = of.select(F.explode("held").alias("set"), "cls").distinct()
    every = union_all(of.select("cls").distinct(), of.sparkSession.range(1).select(F.lit("").alias("cls"))).select(F.lit("").alias("set"), "cls")
    names = of.select("source", "cls")
    out = chunks.join(F.broadcast(names) if is_small(names) else names, "source", "left")
    return out.withColumn("cls", F.coalesce("cls", F.lit(""))), union_all(members, every)


def filter_cells(filters: DataFrame, members: DataFrame, rules: RuleSet = VIETNAMESE) -> DataFrame:
    """filters (set, audience, ...) -> class and key of each place that a filter looks at, the other columns kept."""
    keys = F.when(F.col("audience").isNull(), F.array(F.lit(ANY))).otherwise(F.array_distinct(F.array(F.col("audience"), F.lit(rules.audience_default))))
    rest = [c for c in filters.columns if c not in ("set", "audience")]
    rows = filters.select(*rest, F.coalesce("set", F.lit("")).alias("set"), F.explode(keys).alias("key"))
    return rows.join(members, "set").select(*rest, "cls", "key")


#: The key under which every chunk stands, whatever its tags.
ANY = "*"


def scopes(source: Column) -> Column:
    """Where a chunk is found: in its source, and in the whole corpus (the empty scope)."""
    return F.array(F.lit(""), F.concat(F.lit("="), source))


def tag_keys(tags: Column, rules: RuleSet = VIETNAMESE) -> Column:
    """The keys under which a chunk of some tags stands: an audience's filter asks for that audience and for the default,
    and meets each chunk that it keeps under one of them."""
    own = F.when(F.array_contains(tags, rules.audience_default), F.array(F.lit(rules.audience_default))).otherwise(F.array_distinct(tags))
    return F.concat(F.coalesce(own, F.expr("cast(array() as array<string>)")), F.array(F.lit(ANY)))


def filter_places(filters: DataFrame, rules: RuleSet = VIETNAMESE) -> DataFrame:
    """filters (sources, audience, ...) -> scope and key of each place that a filter looks at, the other columns kept."""
    where = F.when(F.col("sources").isNull(), F.array(F.lit(""))).otherwise(F.transform(F.array_distinct("sources"), lambda s: F.concat(F.lit("="), s)))
    keys = F.when(F.col("audience").isNull(), F.array(F.lit(ANY))).otherwise(F.array_distinct(F.array(F.col("audience"), F.lit(rules.audience_default))))
    rest = [c for c in filters.columns if c not in ("sources", "audience")]
    return filters.select(*rest, F.explode(where).alias("scope"), keys.alias("keys")).select(*rest, "scope", F.explode("keys").alias("key"))


def chunk_places(chunks: DataFrame, *columns: str, rules: RuleSet = VIETNAMESE) -> DataFrame:
    """chunks (source, semantic_tags, ...) -> columns, scope and key of each place where a chunk stands."""
    rows = chunks.select(*columns, F.explode(scopes(F.coalesce("source", F.lit("")))).alias("scope"), tag_keys(F.col("semantic_tags.doi_tuong"), rules).alias("keys"))
    return rows.select(*columns, "scope", F.explode("keys").alias("key"))


def filtered(signatures: DataFrame, chunks: DataFrame, rules: RuleSet = VIETNAMESE) -> DataFrame:
    """(qid, id, every) of the chunks that each question's filter keeps: one equi-join by place. A question that nothing
    narrows is one row, with every true and no id: it keeps all chunks, which are not listed."""
    free = F.col("sources").isNull() & F.col("audience").isNull()
    aimed = filter_places(signatures.where(~free).select("qid", "sources", "audience"), rules)
    kept = aimed.join(chunk_places(chunks, "id", rules=rules), ["scope", "key"]).select("qid", "id", F.lit(False).alias("every"))
    kind = dict(chunks.dtypes)["id"]
    return union_all(kept, signatures.where(free).select("qid", F.lit(None).cast(kind).alias("id"), F.lit(True).alias("every")))


def filter_totals(signatures: DataFrame, chunks: DataFrame, sums: dict[str, Column], rules: RuleSet = VIETNAMESE, sets: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """qid and sums over the chunks that each question's filter keeps (sums: aggregates that add up, by sum or by the
    function that their name begins with: min_, max_), from the places' own: no question meets a chunk or a source.
    signatures (qid, sources, audience) or, with sets (set, source), (qid, set, audience)."""
    if sets is None:
        signatures, sets = source_sets(signatures)
    chunks, members = in_classes(chunks, sets, keep)
    columns = sorted({c for c in chunks.columns if c not in ("text", "source", "semantic_tags", "cls")})
    rows = once(chunks.select(*columns, "cls", "semantic_tags"), tags=F.col("semantic_tags.doi_tuong"))
    rows = rows.select(*columns, "cls", F.explode(tag_keys(F.col("tags"), rules)).alias("key"))
    cells = rows.groupBy("cls", "key").agg(*[v.alias(k) for k, v in sums.items()])
    again = {"min": F.min, "max": F.max}
    named = signatures.select("qid", "set", "audience").withColumn("sig", F.to_json(F.struct("set", "audience")))
    wanted = filter_cells(named.select("sig", "set", "audience").distinct(), members, rules)
    found = wanted.join(cells, ["cls", "key"]).groupBy("sig").agg(*[again.get(k.split("_")[0], F.sum)(k).alias(k) for k in sums])
    return named.select("qid", "sig").join(found, "sig").drop("sig")
