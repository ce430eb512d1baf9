"""Question-answer pairs, training rows, metrics, reports and incremental work."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import union_all
from ..functions.rules import WS
from ..functions.text import clean_text
from ..operators import evaluate as E
from ..operators import qa as Q
from ..operators import tagging as G
from ..sources import io
from ..sources.providers import TokenCutter
from ..streaming import incremental as I
from . import _sql as S
from .chunking import DRIVER, TAGS
from .cleaning import clean_sql, table

RULES = replace(
    DRIVER,
    qa_units=((r"\p{Nd}+[" + WS + r"]*rights", "rights"), (r"on[aeiou]+[" + WS + r"]+th", "pairs"), (r"\p{Nd}+", "số")),
    qa_conditions=(r"[Ee]resh[" + WS + r"]+[^\n]{15,}?(?:the|of)[^\n]{10,}?[.;]", r"[Uu]nd[" + WS + r"]+[^\n]{15,}?[.;]"),
    qa_procedures=("tionthe", "heitge", "ciones"),
    qa_purposes=("thation", "eauxle", "ndthe"),
)


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    section = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, RULES.preamble).otherwise(F.concat(F.lit("Điều "), (F.col("doc_id") % 9).cast("string")))
    return docs.select(F.format_string("chunk_%04d", "doc_id").alias("id"), "source", section.alias("section"), "text", "doc_id")


CHUNKS = "SELECT printf('chunk_%04d', doc_id) AS id, source, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Phần mở đầu' ELSE 'Điều ' || (doc_id % 9) END AS section, text, doc_id FROM documents"


def qa_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.template_pairs(documents_as_chunks(spark, sf_dir), RULES)


def _template_sql() -> str:
    answer = lambda n: f"CASE WHEN regexp_matches({S.join(f's[1:{n}]', '. ')}, '[.;:]$') THEN {S.join(f's[1:{n}]', '. ')} ELSE {S.join(f's[1:{n}]', '. ')} || '.' END"
    p = lambda q, a, t: f"{{'question': {q}, 'answer': {a}, 'type': '{t}'}}"
    stop = lambda x: f"CASE WHEN ends_with({x}, '.') THEN {x} ELSE {x} || '.' END"
    named = "section <> '' AND section <> 'Phần mở đầu'"
    prefix = f"CASE WHEN {named} THEN 'Theo ' || section || ', ' ELSE 'Theo quy chế, ' END"
    where = lambda d: f"CASE WHEN section <> '' THEN section ELSE '{d}' END"
    unit = "CASE " + " ".join(f"WHEN regexp_matches(text, {S.lit(r)}) THEN {{'hit': regexp_extract(text, {S.lit(r)}), 'unit': {S.lit(u)}}}" for r, u in RULES.qa_units) + " END"
    cond = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {S.lit(r)}), '')" for r in RULES.qa_conditions) + ")"
    word = lambda ws: "CASE " + " ".join(f"WHEN contains(lower(text), {S.lit(w)}) THEN {S.lit(w)} END" if i == len(ws) - 1 else f"WHEN contains(lower(text), {S.lit(w)}) THEN {S.lit(w)}" for i, w in enumerate(ws))
    return f"""
WITH c AS ({CHUNKS}), k AS (SELECT *, list_filter(list_transform({S.sentences('text')}, lambda x: {S.strip('x')}), lambda x: length(x) > 25) AS s FROM c),
r AS (SELECT *, {unit} AS u, {S.strip(cond)} AS cond, {word(RULES.qa_procedures)} AS w1, {word(RULES.qa_purposes)} AS w2 FROM k WHERE len(s) >= 1),
h AS (SELECT *, list_filter(s, lambda x: contains(x, u.hit))[1] AS hu, list_filter(s, lambda x: contains(lower(x), w1))[1] AS h1, list_filter(s, lambda x: contains(lower(x), w2))[1] AS h2 FROM r),
p AS (SELECT *, list_filter([
 CASE WHEN len(s) >= 2 THEN CASE WHEN {named} THEN {p("section || ' quy định những nội dung gì?'", answer(3), 'factual')} ELSE {p("'Quy chế quy định gì về: " + chr(34) + "' || regexp_replace(left(s[1], 80), '[ ,;:]+$', '') || '" + chr(34) + "?'", answer(3), 'factual')} END END,
 CASE WHEN hu IS NOT NULL THEN {p(prefix + " || u.unit || ' được quy định như thế nào?'", stop('hu'), 'factual')} END,
 CASE WHEN cond IS NOT NULL THEN {p("'Điều gì xảy ra trong trường hợp được nêu tại ' || " + where('quy chế') + " || '?'", 'cond', 'conditional')} END,
 CASE WHEN h1 IS NOT NULL THEN {p(prefix + " || w1 || ' được quy định thế nào?'", stop('h1'), 'procedural')} END,
 CASE WHEN h2 IS NOT NULL THEN {p("'Mục đích của ' || " + where('quy định này') + " || ' là gì?'", 'h2', 'reasoning')} END], lambda x: x IS NOT NULL) AS ps FROM h),
f AS (SELECT *, (CASE WHEN len(ps) < 2 AND len(s) >= 3 THEN list_append(ps, {p("'Hãy tóm tắt nội dung chính của ' || " + where('đoạn quy chế này') + " || '.'", answer(4), 'factual')}) ELSE ps END)[1:4] AS qs FROM p),
o AS (SELECT id, source, section, unnest(qs) AS q, generate_subscripts(qs, 1) - 1 AS ord FROM f)
SELECT id AS chunk_id, CAST(ord AS INTEGER) AS ord, q.question AS question, q.answer AS answer, q.type AS type, source, section, 'template' AS generated_by FROM o
"""


TEMPLATE_SQL = _template_sql()


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies made of conversations: fenced JSON with a good entry, one without an answer and one that is no object."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    kind = F.element_at(F.array(F.lit("factual"), F.lit("Procedural"), F.lit("odd")), (F.col("turn") % 3 + 1).cast("int"))
    good = F.to_json(F.struct(F.col("text").alias("question"), F.concat(F.col("role"), F.lit(" says")).alias("answer"), kind.alias("type")))
    text = F.concat(F.lit("Here you are:\n```json\n["), good, F.lit(', {"question": "q", "answer": " ", "type": "factual"}, 7]\n```'))
    text = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("no list here {"), "text")).otherwise(text)
    return turns.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.lit("s").alias("source"), F.lit("").alias("section"), text.alias("reply"))


def qa_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.parsed_pairs(replies(spark, sf_dir)).select("chunk_id", "ord", "question", "answer", "type", "generated_by")


PARSE_SQL = f"""SELECT conv_id || '_' || turn AS chunk_id, 0 AS ord, {S.strip('text')} AS question, role || ' says' AS answer, CASE turn % 3 WHEN 1 THEN 'procedural' ELSE 'factual' END AS type, 'api' AS generated_by
FROM conversations WHERE role <> 'system' AND turn % 5 <> 4 AND {S.strip('text')} <> ''"""


def made_and_done(spark: SparkSession, sf_dir: str, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of good quality are done; the first pairs of those marked toxic too stand for a model's."""
    done = table(spark, sf_dir, "labels").where("quality = 1").select(F.format_string("chunk_%04d", "doc_id").alias("chunk_id"), "toxic")
    some = templates.join(done.where("toxic = 1"), "chunk_id", "left_semi").where("ord = 0").withColumn("generated_by", F.lit("api"))
    return some, done.select("chunk_id")


def qa_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read some ten times: worked out once.
    templates = io.staged(qa_template(spark, sf_dir).select("chunk_id", "ord", "question", "generated_by"))
    made, done = made_and_done(spark, sf_dir, templates)
    return Q.topped_up(made, templates, done, 1400, 1500).select("chunk_id", "ord", "question", "generated_by", "part")


TOPUP_SQL = f"""
WITH t AS ({TEMPLATE_SQL}), d AS (SELECT printf('chunk_%04d', doc_id) AS chunk_id, toxic FROM labels WHERE quality = 1),
m AS (SELECT t.*, 0 AS part FROM t WHERE ord = 0 AND chunk_id IN (SELECT chunk_id FROM d WHERE toxic = 1)),
b AS (SELECT chunk_id, ord, question, 'api' AS generated_by, part FROM m UNION ALL SELECT chunk_id, ord, question, generated_by, 1 FROM t WHERE chunk_id NOT IN (SELECT chunk_id FROM d)),
s AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY chunk_id, ord) AS k FROM t WHERE chunk_id IN (SELECT chunk_id FROM d) AND question NOT IN (SELECT question FROM b)),
p AS (SELECT chunk_id, count(*) AS m FROM s WHERE k = 1 GROUP BY chunk_id),
r AS (SELECT chunk_id, coalesce(sum(m) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT count(*) FROM b) AS n FROM p)
SELECT * FROM b UNION ALL SELECT chunk_id, ord, question, generated_by, 2 FROM s WHERE k = 1 AND chunk_id IN (SELECT chunk_id FROM r WHERE n < 1400 AND n + before < 1500)
"""


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.split_pairs(io.staged(qa_template(spark, sf_dir).select("chunk_id", "ord", "question", "answer"))).select("chunk_id", "ord", "split")


SPLIT_SQL = f"""
WITH t AS (SELECT *, md5('42|' || question || '|' || answer || '|' || chunk_id) AS k FROM ({TEMPLATE_SQL})),
r AS (SELECT *, row_number() OVER (ORDER BY k) AS r, least(50, (SELECT count(*) FROM t) // 5) AS n FROM t) SELECT chunk_id, ord, CASE WHEN r <= n THEN 'test' ELSE 'train' END AS split FROM r
"""
SYSTEM = "Trả lời dựa trên quy chế."


def tokenizer_file() -> str:
    """The tokenizer by which training rows are cut."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chunk has no text for generation: its questions stand alone."""
    chunks = documents_as_chunks(spark, sf_dir).withColumn("semantic_tags", G.semantic_tags(F.col("text"), DRIVER)).withColumn("text_for_generation", F.when(F.col("doc_id") % 3 > 0, F.col("text")))
    return Q.chat_rows(qa_template(spark, sf_dir), chunks, SYSTEM)


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("chunk_id", "ord", Q.chat_text(F.col("messages")).alias("text"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, cut to 2,048 tokens of a byte-level tokenizer, which SQL can't run."""
    return Q.training_rows(messages(spark, sf_dir), TokenCutter(tokenizer_file())).select("chunk_id", "ord", "text")


CHAT_SQL = f"""
WITH t AS ({TEMPLATE_SQL}), c AS (SELECT printf('chunk_%04d', doc_id) AS chunk_id, doc_id, text, {TAGS} FROM documents),
u AS (SELECT t.chunk_id, ord, answer, CASE WHEN doc_id % 3 > 0 AND text <> '' THEN 'Ngữ cảnh quy chế:' || chr(10) || '[Đối tượng: ' || array_to_string(doi_tuong, ', ') || ' | Loại: ' || array_to_string(loai_van_ban, ', ') || ' | Mức quan trọng: ' || do_quan_trong || ']' || chr(10)
  || left(text, 1200) || CASE WHEN length(text) > 1200 THEN '...' ELSE '' END || chr(10) || chr(10) || 'Câu hỏi: ' || question ELSE question END AS q FROM t JOIN c USING (chunk_id))
SELECT chunk_id, ord, '<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || q || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>' || chr(10) AS text FROM u
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants' turns as predictions: config by conversation, gold the conversation's next turn (or its own text)."""
    place = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.coalesce(F.lead("text").over(place), F.col("text")).alias("gold"))
    config = F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("conv_id") % 4 + 1).cast("int"))
    return rows.where("role = 'assistant'").select(config.alias("config"), (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), "gold")).otherwise("")).alias("prediction"), "gold")


PREDICTIONS = """SELECT substr('ABCD', CAST(conv_id % 4 + 1 AS INTEGER), 1) AS config, conv_id * 1000 + turn AS qid, text || CASE WHEN turn % 2 = 0 THEN ' ' || gold ELSE '' END AS prediction, gold
FROM (SELECT *, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), text) AS gold FROM conversations) WHERE role = 'assistant'"""


def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.corpus_bleu(predictions(spark, sf_dir)).select("config", F.round("bleu", 6).alias("bleu"))


def bleu_tokens_sql(x: str) -> str:
    x = f"replace(replace(replace(replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<')"
    x = f"' ' || replace({x}, '&gt;', '>') || ' '"
    x = rf"regexp_replace({x}, '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g')"
    x = rf"regexp_replace({x}, '([0-9])(-)', '\1 \2 ', 'g')"
    return rf"list_filter(regexp_split_to_array({x}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


def bleu_sql(predictions: str) -> str:
    return f"""
WITH p AS ({predictions}), t AS (SELECT config, qid, {bleu_tokens_sql('prediction')} AS p, {bleu_tokens_sql('gold')} AS g FROM p),
l AS (SELECT config, sum(len(p)) AS sl, sum(len(g)) AS rl FROM t GROUP BY config),
a AS (SELECT config, qid, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], ' '))) AS gram, 1 AS a, 0 AS b FROM t, range(1, 5) r(n)
  UNION ALL SELECT config, qid, n, unnest(list_transform(range(1, len(g) - n + 2), lambda i: array_to_string(g[i:i + n - 1], ' '))), 0, 1 FROM t, range(1, 5) r(n)),
c AS (SELECT config, qid, n, gram, sum(a) AS a, sum(b) AS b FROM a GROUP BY ALL), s AS (SELECT config, n, sum(least(a, b)) AS m, sum(a) AS t FROM c GROUP BY ALL HAVING sum(a) > 0),
z AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY config ORDER BY n) AS zeros FROM s)
SELECT config, CASE WHEN sum(m) = 0 OR count(*) < 4 THEN 0.0 ELSE round(100 * CASE WHEN max(sl) < max(rl) THEN exp(1 - max(rl) / max(sl)) ELSE 1 END * exp(sum(CASE WHEN m > 0 THEN ln(m / t) ELSE -ln(pow(2.0, zeros) * t) END) / 4), 6) END AS bleu FROM z JOIN l USING (config) GROUP BY config
"""


BLEU_SQL = bleu_sql(PREDICTIONS)


def rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).groupBy("config").agg(F.round(F.avg(E.rouge_l("prediction", "gold")) * 100, 6).alias("rouge_l"))


def rouge_sql(predictions: str) -> str:
    """The table of the longest common subsequence, row by row: a row is the running maximum of what a token adds to the
    row before."""
    cut = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    return f"""
WITH RECURSIVE p AS (SELECT config, qid, {cut('prediction')} AS a, {cut('gold')} AS b FROM ({predictions})),
r AS (SELECT config, qid, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0) AS row FROM p
  UNION ALL SELECT config, qid, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(c[1:j])) FROM
   (SELECT config, qid, a, b, i, list_transform(range(1, len(b) + 2), lambda j: CASE WHEN j > 1 AND b[j - 1] = a[i + 1] THEN row[j - 1] + 1 ELSE row[j] END) AS c FROM r WHERE i < len(a))),
l AS (SELECT config, qid, len(a) AS na, len(b) AS nb, row[len(b) + 1] AS n FROM r WHERE i = len(a))
SELECT config, round(avg(CASE WHEN n > 0 THEN 2.0 * n / (na + nb) ELSE 0 END) * 100, 6) AS rouge_l FROM l GROUP BY config
"""


ROUGE_SQL = rouge_sql(PREDICTIONS)


def bert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matching of words by the stand-in's vectors."""
    return E.bert_score(predictions(spark, sf_dir)).select("config", "qid", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def bert_sql(predictions: str) -> str:
    digits = "list_transform(range(1, 33), lambda i: CAST(instr('0123456789abcdef', substr(md5(w), i, 1)) - 8.5 AS DOUBLE))"
    side = lambda a, b, name: f"SELECT config, qid, sum(best * n) / sum(n) AS {name} FROM (SELECT x.config, x.qid, x.w, x.n, max(list_dot_product(u.v, o.v)) AS best FROM {a} x JOIN {b} y USING (config, qid) JOIN u ON u.w = x.w JOIN u o ON o.w = y.w GROUP BY ALL) GROUP BY ALL"
    return f"""
WITH p AS (SELECT config, qid, {S.tokens('prediction')} AS p, {S.tokens('gold')} AS g FROM ({predictions})),
pw AS (SELECT config, qid, w, count(*) AS n FROM (SELECT config, qid, unnest(p) AS w FROM p) GROUP BY ALL), gw AS (SELECT config, qid, w, count(*) AS n FROM (SELECT config, qid, unnest(g) AS w FROM p) GROUP BY ALL),
u0 AS (SELECT DISTINCT w FROM (SELECT w FROM pw UNION ALL SELECT w FROM gw)), u1 AS (SELECT w, {digits} AS d FROM u0), u AS (SELECT w, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS v FROM u1),
a AS ({side('pw', 'gw', 'precision')}), b AS ({side('gw', 'pw', 'recall')}),
m AS (SELECT p.config, p.qid, coalesce(precision, 0.0) AS precision, coalesce(recall, 0.0) AS recall FROM p LEFT JOIN a ON a.config = p.config AND a.qid = p.qid LEFT JOIN b ON b.config = p.config AND b.qid = p.qid)
SELECT config, qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m
"""


BERT_SQL = bert_sql(PREDICTIONS)


def recall_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions: retrieved are the sources of the seven next ids, gold is the tail of a source name."""
    place = Window.partitionBy("lang").orderBy("doc_id").rowsBetween(1, 7)
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("config"), "doc_id", F.collect_list("source").over(place).alias("sources"), F.concat(F.lit("RC"), (F.col("doc_id") % 20).cast("string")).alias("gold_source"))
    return rows


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recall_at_k(recall_rows(spark, sf_dir)).select("config", F.round("recall", 6).alias("recall"))


RECALL_SQL = """
WITH r AS (SELECT lang AS config, list(source) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS sources, 'rc' || (doc_id % 20) AS gold FROM documents)
SELECT config, round(avg(CASE WHEN len(list_filter(coalesce(sources, [])[1:5], lambda s: contains(lower(s), gold))) > 0 THEN 1 ELSE 0 END) * 100, 6) AS recall FROM r GROUP BY config
"""


def times(spark: SparkSession) -> DataFrame:
    return E.configurations(spark).select("config", F.concat(F.lit("run "), "config").alias("label"), "rag", F.lit(10.0).alias("time_seconds"))


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("sources", F.array(F.lit("x"), F.col("config"))).withColumn("gold_source", F.element_at(F.array(*[F.lit(c) for c in "abcd"]), (F.col("qid") % 4 + 1).cast("int")))
    table_ = io.comparison_table(E.metrics(rows, times(spark)))
    return table_.select(F.col("Config").alias("config"), F.col("Label").alias("label"), F.col("Num_Samples").alias("num_samples"), F.when(F.col("`Recall@5`") == "N/A", "N/A").otherwise(F.round(F.col("`Recall@5`").cast("double"), 4).cast("string")).alias("recall"))


COMPARISON_SQL = f"""
WITH p AS ({PREDICTIONS}), r AS (SELECT config, count(*) AS n, avg(CASE WHEN substr('abcd', CAST(qid % 4 + 1 AS INTEGER), 1) IN ('x', lower(config)) THEN 1.0 ELSE 0 END) * 100 AS recall FROM p GROUP BY config)
SELECT config, 'run ' || config AS label, CAST(n AS VARCHAR) AS num_samples, CASE WHEN config IN ('A', 'C') THEN 'N/A' ELSE CAST(round(recall, 4) AS VARCHAR) END AS recall FROM r
"""


def human_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as the test set; predictions by item from the conversations."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.concat(F.lit("A: "), "text").alias("answer"))
    preds = table(spark, sf_dir, "conversations").where("turn = 1").select((F.col("conv_id") % 40).alias("qid"), F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("conv_id") % 3 + 1).cast("int")).alias("config"), "text")
    preds = preds.groupBy("qid", "config").agg(F.min("text").alias("prediction"))
    out = E.human_eval_sheet(items, preds, 1000)
    return out.select(F.col("STT").alias("stt"), F.col("`Gold Answer`").alias("gold"), F.col("Pred_A").alias("pred_a"), F.col("Pred_B").alias("pred_b"), F.col("Pred_C").alias("pred_c"), F.col("Pred_D").alias("pred_d"), F.col("Score_D_Naturalness").alias("score_d"))


HUMAN_SQL = """
WITH p AS (SELECT conv_id % 40 AS qid, substr('ABCD', CAST(conv_id % 3 + 1 AS INTEGER), 1) AS config, min(text) AS t FROM conversations WHERE turn = 1 GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY item_id) AS INTEGER) AS stt, 'A: ' || b.text AS gold, coalesce(pa.t, '') AS pred_a, coalesce(pb.t, '') AS pred_b, coalesce(pc.t, '') AS pred_c, '' AS pred_d, '' AS score_d
FROM benchmark b LEFT JOIN p pa ON pa.qid = item_id AND pa.config = 'A' LEFT JOIN p pb ON pb.qid = item_id AND pb.config = 'B' LEFT JOIN p pc ON pc.qid = item_id AND pc.config = 'C'
"""


def config_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration against every test question."""
    return E.configurations(spark).join(table(spark, sf_dir, "benchmark").select("item_id"))


CONFIG_SQL = "SELECT * FROM (VALUES ('A', false, false), ('B', true, false), ('C', false, true), ('D', true, true)) c(config, rag, finetuned), (SELECT item_id FROM benchmark)"


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


PENDING_SQL = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def prefer_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents have a clean text, others are cleaned on the way."""
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    clean = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").cast("string").alias("source"), F.concat(F.lit("clean: "), "text").alias("text"))
    return io.prefer_clean(raw, clean, clean_text)


PREFER_SQL = f"""
WITH c AS ({clean_sql('SELECT doc_id, text FROM documents')})
SELECT CAST(d.doc_id AS VARCHAR) AS source, CASE WHEN l.doc_id IS NOT NULL THEN 'clean: ' || text ELSE clean END AS text, l.doc_id IS NOT NULL AS was_clean
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def first_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("text").alias("question"), "conv_id", "turn")
    return Q.first_by_question(rows, "conv_id", "turn")


FIRST_SQL = "SELECT text AS question, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS k FROM conversations WHERE role = 'user') WHERE k = 1"


def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").where(F.length("text") > 20000).select("source")
    return I.uncovered(table(spark, sf_dir, "documents").select("source").distinct(), chunks)


GAP_SQL = "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE length(text) > 20000)"


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled chunks have a model's summary; others fall back to their text with context."""
    chunks = documents_as_chunks(spark, sf_dir).withColumn("text_with_context", F.concat(F.lit("["), "source", F.lit("]\n"), "text"))
    done = table(spark, sf_dir, "labels").select(F.format_string("chunk_%04d", "doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "Điều 1").otherwise("").alias("section"), F.format_string('```json\n{"summary": " about %d ", "keywords": ["a", " b "]}\n```', "doc_id").alias("reply"))
    return Q.with_summaries(chunks, Q.parsed_summaries(done)).select("id", "text_for_retrieval")


SUMMARIES_SQL = """
SELECT printf('chunk_%04d', d.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN '[' || source || ']' || chr(10) || text ELSE CASE WHEN quality = 1 THEN '[Điều 1] ' ELSE '' END || 'about ' || l.doc_id || chr(10) || 'Từ khóa: a, b' END AS text_for_retrieval
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa_template(spark, sf_dir)
    return union_all(pairs.groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n")), pairs.groupBy(F.col("section").alias("what")).agg(F.count(F.lit(1)).alias("n")))


CATEGORY_SQL = f"WITH t AS ({TEMPLATE_SQL}) SELECT type AS what, count(*) AS n FROM t GROUP BY type UNION ALL SELECT section, count(*) FROM t GROUP BY section"


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.tumbling_counts(table(spark, sf_dir, "events"))
    return out.select(F.unix_timestamp("window_start").alias("window_s"), "event_type", "n", F.round("total", 4).alias("total"))


TUMBLING_SQL = "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def queries() -> dict:
    return {
        "qa_template": qa_template, "qa_parse_json": qa_parse, "qa_topup": qa_topup, "hash_split": hash_split, "chat_rows": chat_rows, "training_rows": training_rows,
        "bleu_corpus": bleu, "rouge_l": rouge, "bert_score": bert, "recall_at_k": recall, "comparison_table": comparison, "human_eval_sheet": human_sheet,
        "config_matrix": config_matrix, "resume_pending": pending, "prefer_clean": prefer_clean, "dedupe_first": first_by_question,
        "coverage_gap": coverage_gap, "retrieval_summaries": summaries, "category_counts": category_counts, "tumbling_counts": tumbling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "qa_template": TEMPLATE_SQL, "qa_parse_json": PARSE_SQL, "qa_topup": TOPUP_SQL, "hash_split": SPLIT_SQL, "chat_rows": CHAT_SQL,
        "bleu_corpus": BLEU_SQL, "rouge_l": ROUGE_SQL, "bert_score": BERT_SQL, "recall_at_k": RECALL_SQL, "comparison_table": COMPARISON_SQL, "human_eval_sheet": HUMAN_SQL,
        "config_matrix": CONFIG_SQL, "resume_pending": PENDING_SQL, "prefer_clean": PREFER_SQL, "dedupe_first": FIRST_SQL, "coverage_gap": GAP_SQL,
        "retrieval_summaries": SUMMARIES_SQL, "category_counts": CATEGORY_SQL, "tumbling_counts": TUMBLING_SQL,
    }
