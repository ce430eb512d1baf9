"""The queries of this subpackage: each applies one operator to its whole table. sql() has those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, collocations, exact_dedup, kn_quality, mixing, passages, run_length_index, simhash, suffix_tree_lm, syncmers, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_length_index.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT rid, i, word, CASE WHEN count(*) OVER a = 35 THEN md5(string_agg(word, ' ') OVER a) END AS win FROM p WINDOW a AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT win FROM v WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
m AS (SELECT rid, i, word, max(CASE WHEN r.win IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM v LEFT JOIN r ON v.win = r.win),
k AS (SELECT rid, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_documents(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = syncmers.compared(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kn_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", "kept")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]') AS pieces FROM documents),
p AS (SELECT rid, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS nr FROM d),
ws AS (SELECT rid, lang, nr, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
w AS (SELECT rid, lang, nr, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY rid, nr ORDER BY i)),
f AS (SELECT lang, phrase, count(*) AS a FROM (SELECT lang, w1 AS phrase FROM g UNION ALL SELECT lang, concat_ws(' ', w1, w2) FROM g WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3) FROM g WHERE w3 IS NOT NULL UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3, w4) FROM g WHERE w4 IS NOT NULL) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS ws, len(string_split(phrase, ' ')) AS k FROM f WHERE contains(phrase, ' ')),
cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:k], ' ') AS rp FROM c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, CAST(2000000 * CAST(cuts.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_of AS (SELECT lang, a, array_to_string(ws[h:h + m - 1], ' ') AS part FROM c, (SELECT unnest([1, 2, 3]) AS h), (SELECT unnest([2, 3]) AS m) WHERE m < k AND h + m - 1 <= k),
gone AS (SELECT DISTINCT i.lang, part FROM inner_of i JOIN f ON f.lang = i.lang AND f.phrase = part WHERE 100 * CAST(i.a AS HUGEINT) >= 80 * CAST(f.a AS HUGEINT)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = b.lang AND gone.part = b.phrase) QUALIFY rank <= 2000
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of the run's own, unless the session names one that outlives it.
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), spark.conf.get("marlstone.tokenCache", None))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_run_length_index": op1,
        "op2_bpe_round_trip": op2,
        "op3_toxicity_grammar": op3,
        "op4_fixed_block_anchors": op4,
        "op5_simhash_near_dedup": op5,
        "op6_suffix_tree_lm": op6,
        "op7_closed_syncmers": op7,
        "op8_mix_sources": op8,
        "op9_exact_dedup": op9,
        "op10_quality_classifier": op10,
        "op11_phrase_collocations": op11,
        "op12_token_counts": op12,
        "op13_tokenizer_alignment": op13,
    }


def sql() -> dict[str, str]:
    return {"op4_fixed_block_anchors": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op11_phrase_collocations": OP11_SQL}
