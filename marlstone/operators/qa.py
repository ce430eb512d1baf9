"""Question-answer pairs by template and from model replies, and the training rows made of them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import once, union_all
from ..functions.rules import ANSWER_TEXTS, QA_TEXTS, QA_TYPES, VIETNAMESE, RuleSet
from ..functions.text import json_part, sentences, strip, truncated
from ..sources.providers import TokenCutter
from .answering import filled
from .chunking import bound


def answer_of(sents: Column, n: int) -> Column:
    """The first n sentences, joined; ended by a full stop unless by . ; or : already."""
    text = F.array_join(F.slice(sents, 1, n), ". ")
    return F.when(text.rlike(r"[.;:]$"), text).otherwise(F.concat(text, F.lit(".")))


def stopped(text: Column) -> Column:
    return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def pair(question: Column, answer: Column, kind: str) -> Column:
    return F.struct(question.alias("question"), answer.alias("answer"), F.lit(kind).alias("type"))


def template_pairs(chunks: DataFrame, rules: RuleSet = VIETNAMESE) -> DataFrame:
    """chunks (id, source, section, text) -> up to four pairs each (schema qa, with ord): what the chunk is about, its
    figures, conditions, procedures and purposes, and a summary where that makes fewer than two."""
    text, low, section = F.col("text"), F.col("low"), F.coalesce("section", F.lit(""))
    sents = F.filter(F.transform(sentences(text), strip), lambda s: F.length(s) > rules.sizes.answer_sentence)
    rows = once(chunks, s=sents).where(F.size("s") >= 1)
    s, named = F.col("s"), (section != "") & (section != rules.preamble)
    prefix = F.when(named, filled(QA_TEXTS["prefix_section"], section=section)).otherwise(QA_TEXTS["prefix"])
    where = lambda key: F.when(section != "", section).otherwise(QA_TEXTS[key])
    # bound(): what a lambda looks for is worked out once a row, not once a sentence.
    first_with = lambda what, test: bound(what, lambda w: F.get(F.filter(s, lambda x: test(x, w)), F.lit(0)))
    none = F.lit(None).cast("struct<question:string,answer:string,type:string>")

    topic = F.regexp_replace(F.substring(F.get(s, F.lit(0)), 1, 80), "[ ,;:]+$", "")
    main = F.when(F.size(s) >= 2, F.when(named, pair(filled(QA_TEXTS["main_section"], section=section), answer_of(s, 3), "factual")).otherwise(pair(filled(QA_TEXTS["main_topic"], topic=topic), answer_of(s, 3), "factual")))

    # The first rule that the text meets decides, even where no sentence then holds what it found.
    found = F.coalesce(*[F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 0).alias("hit"), F.lit(unit).alias("unit"))) for p, unit in rules.qa_units], F.lit(None).cast("struct<hit:string,unit:string>"))
    held = F.col("held")
    unit = F.when(held.isNotNull(), pair(F.concat(prefix, filled(QA_TEXTS["unit"], unit=F.col("unit.unit"))), stopped(held), "factual"))

    matched = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in rules.qa_conditions], F.lit(None).cast("string"))
    forbidden = F.contains(F.lower("condition"), F.lit(QA_TEXTS["forbidden_mark"]))
    asked = F.when(forbidden, F.concat(prefix, F.lit(QA_TEXTS["forbidden"]))).otherwise(filled(QA_TEXTS["condition"], where=where("condition_where")))
    condition = F.when(F.col("condition").isNotNull(), pair(asked, F.col("condition"), "conditional"))

    word = lambda words: F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))
    rows = once(rows, low=F.lower("text"))
    rows = once(rows, unit=found, condition=strip(matched), word1=word(rules.qa_procedures), word2=word(rules.qa_purposes))
    says = lambda x, w: F.contains(F.lower(x), w)
    rows = once(rows, held=first_with(F.col("unit.hit"), lambda x, w: F.contains(x, w)), hit1=first_with(F.col("word1"), says), hit2=first_with(F.col("word2"), says))
    procedure = F.when(F.col("hit1").isNotNull(), pair(F.concat(prefix, filled(QA_TEXTS["procedure"], word=F.col("word1"))), stopped(F.col("hit1")), "procedural"))
    purpose = F.when(F.col("hit2").isNotNull(), pair(filled(QA_TEXTS["purpose"], where=where("purpose_where")), F.col("hit2"), "reasoning"))
    rows = once(rows, pairs=F.filter(F.array(main, unit, condition, procedure, purpose), lambda x: x.isNotNull()))
    summary = pair(filled(QA_TEXTS["summary"], where=where("summary_where")), answer_of(s, 4), "factual")
    more = F.when((F.size("pairs") < 2) & (F.size(s) >= 3), F.array(summary)).otherwise(F.slice(F.array(none), 1, 0))
    rows = rows.withColumn("pairs", F.slice(F.concat("pairs", more), 1, 4))
    out = rows.select(F.col("id").alias("chunk_id"), "source", section.alias("section"), F.posexplode("pairs").alias("ord", "p"))
    return out.select("chunk_id", "ord", "p.question", "p.answer", "p.type", "source", "section", F.lit("template").alias("generated_by"))


def parsed_pairs(replies: DataFrame) -> DataFrame:
    """replies (chunk_id, source, section, reply) -> valid pairs of model replies (schema qa, with ord).

    Entries that are no objects or lack a question or an answer go; an unknown type is factual.
    """
    items = F.from_json(json_part(F.col("reply"), "[", "]"), "array<string>")
    objects = F.filter(F.transform(items, lambda x: F.from_json(F.when(F.ltrim(x).startswith("{"), x), "question string, answer string, type string")), lambda x: x.isNotNull())
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    rows = replies.select("chunk_id", "source", "section", F.posexplode(objects).alias("ord", "x"))
    rows = rows.select("chunk_id", "ord", text(F.col("x.question")).alias("question"), text(F.col("x.answer")).alias("answer"), F.lower(strip(F.coalesce("x.type", F.lit(QA_TYPES[0])))).alias("type"), "source", F.coalesce("section", F.lit("")).alias("section"))
    rows = rows.withColumn("type", F.when(F.col("type").isin(*QA_TYPES), F.col("type")).otherwise(QA_TYPES[0]))
    return rows.where("question <> '' and answer <> ''").withColumn("generated_by", F.lit("api"))


def parsed_summaries(replies: DataFrame) -> DataFrame:
    """replies (chunk_id, section, reply) -> (chunk_id, text_for_retrieval): [section] summary, then the keywords' line."""
    x = F.from_json(json_part(F.col("reply"), "{", "}"), "summary string, keywords array<string>")
    rows = replies.withColumn("x", x).where("x is not null")
    head = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit("["), "section", F.lit("] "))).otherwise("")
    words = F.coalesce(F.array_join(F.transform("x.keywords", strip), ", "), F.lit(""))
    return rows.select("chunk_id", F.concat(head, strip(F.coalesce("x.summary", F.lit(""))), F.lit("\n" + ANSWER_TEXTS["keywords"]), words).alias("text_for_retrieval"))


def with_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """text_for_retrieval and text_for_generation of every chunk, falling back to the text with context and the text."""
    found = summaries.select(F.col("chunk_id").alias("id"), F.col("text_for_retrieval").alias("found"))
    return chunks.join(found, "id", "left").withColumn("text_for_retrieval", F.coalesce("found", "text_with_context")).withColumn("text_for_generation", F.col("text")).drop("found")


def first_by_question(pairs: DataFrame, *order: str) -> DataFrame:
    """Of pairs with one question the first in order stays."""
    place = Window.partitionBy("question").orderBy(*order)
    return pairs.withColumn("k", F.row_number().over(place)).where("k = 1").drop("k")


def topped_up(made: DataFrame, templates: DataFrame, done: DataFrame, low: int = 300, enough: int = 350) -> DataFrame:
    """Model pairs, template pairs of chunks that the model has not done, and, while that is under `low`, template pairs of
    done chunks with new questions until `enough` (the chunk that crosses it counts whole).

    made, templates: schema qa with ord; done: chunk_id. Pairs carry part (0 made, 1 rest, 2 top-up).
    """
    rest = templates.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")
    base = union_all(made.withColumn("part", F.lit(0)), rest.withColumn("part", F.lit(1)))
    total = base.agg(F.count(F.lit(1)).alias("n"))
    spare = templates.join(done.select("chunk_id").distinct(), "chunk_id", "left_semi").join(base.select("question").distinct(), "question", "left_anti")
    spare = first_by_question(spare, "chunk_id", "ord")
    per = spare.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("m")).withColumn("n", total.scalar())
    # A chunk is taken while the pairs before it leave the total under enough; nothing is where the base reaches low.
    # Each chunk left has a pair at least, so the first `enough` of them are all that can matter: a top-k, no sort of the table.
    reach = F.coalesce(F.sum("m").over(Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = per.where(F.col("n") < low).orderBy("chunk_id").limit(enough)
    taken = first.withColumn("before", reach).where(F.col("n") + F.col("before") < enough).select("chunk_id")
    return union_all(base, spare.join(taken, "chunk_id", "left_semi").withColumn("part", F.lit(2)))


def split_pairs(pairs: DataFrame, seed: int = 42, most: int = 50, share: int = 5) -> DataFrame:
    """Adds split: min(most, n // share) pairs are test, the rest train, by a hash order (the reference order of a seeded
    generator has no equal here). The few test keys are found by a top-k, not by sorting the table; of pairs that are
    equal in all that is hashed as many are test as stand in the top."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "question", "answer", "chunk_id").cast("binary"))
    rows = pairs.withColumn("order_key", key)
    n = pairs.agg(F.least(F.lit(most).cast("long"), F.floor(F.count(F.lit(1)) / share)).alias("k"))
    first = rows.select("order_key").orderBy("order_key").limit(most).withColumn("r", F.row_number().over(Window.orderBy("order_key"))).where(F.col("r") <= n.scalar()).groupBy("order_key").agg(F.count(F.lit(1)).alias("wanted"))
    known = rows.join(F.broadcast(first), "order_key", "left")  # at most `most` keys
    # Only rows of those keys are numbered; the others keep where they lie.
    near = known.where("wanted is not null").withColumn("r", F.row_number().over(Window.partitionBy("order_key").orderBy(F.lit(0))))
    both = union_all(known.where("wanted is null").withColumn("r", F.lit(None).cast("int")), near)
    return both.withColumn("split", F.when(F.col("r") <= F.col("wanted"), "test").otherwise("train")).drop("wanted", "r", "order_key")


def held_out_share(rows: DataFrame, key: str, percent: int = 5, seed: int = 42) -> DataFrame:
    """Adds is_eval: about percent of the rows by a hash of the key; no sort, and the same for a key in any run."""
    return rows.withColumn("is_eval", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(100)) < percent)


def chat_rows(pairs: DataFrame, chunks: DataFrame, system: str, limit: int = VIETNAMESE.sizes.grounding) -> DataFrame:
    """pairs (qa) with chunks (id, semantic_tags, text_for_generation) -> messages of a training row; without the chunk's
    text the question stands alone."""
    grounded = chunks.where(F.coalesce("text_for_generation", F.lit("")) != "")
    known = once(grounded.select(F.col("id").alias("chunk_id"), "semantic_tags", F.col("text_for_generation").alias("g")), t=F.col("semantic_tags"))
    listed = lambda key, c: F.when(F.size(c) > 0, F.concat(F.lit(ANSWER_TEXTS[key]), F.array_join(c, ", ")))
    meta = F.concat_ws(" | ", listed("audience", F.col("t.doi_tuong")), listed("kind", F.col("t.loai_van_ban")), F.when(F.coalesce("t.do_quan_trong", F.lit("")) != "", F.concat(F.lit(ANSWER_TEXTS["importance"]), "t.do_quan_trong")))
    head = F.when(meta != "", F.concat(F.lit("["), meta, F.lit("]"))).otherwise("")
    # What a row may hold of the chunk is cut before the join: no text moves whole.
    before = F.concat(F.lit(ANSWER_TEXTS["grounding"]), head, F.lit("\n"), truncated(F.col("g"), limit), F.lit("\n\n" + ANSWER_TEXTS["question"]))
    rows = pairs.join(known.select("chunk_id", before.alias("grounding")), "chunk_id", "left")
    user = F.when(F.col("grounding").isNotNull(), F.concat("grounding", "question")).otherwise(F.col("question"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.withColumn("messages", F.array(message("system", F.lit(system)), message("user", user), message("assistant", F.col("answer")))).drop("grounding")


def chat_text(messages: Column) -> Column:
    """A chat template: role tags around each message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def training_rows(rows: DataFrame, cutter: TokenCutter) -> DataFrame:
    """rows with messages -> their text by the chat template, cut to the tokens that a training row may have."""
    return rows.withColumn("text", cutter.cut(chat_text(F.col("messages"))))
