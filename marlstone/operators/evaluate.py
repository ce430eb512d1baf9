"""Metrics over predictions, and the reports built from them."""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.rules import CONFIGS, HUMAN_EVAL_COLUMNS, HUMAN_EVAL_CRITERIA
from ..functions.text import tokens
from ..sources.providers import DigestVectors, TokenVectors

ORDERS = 4


def metric_tokens(text: Column) -> Column:
    """Tokens as the usual machine-translation scorer cuts them: marks and symbols apart, . and , kept between digits."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<skipped>", "")
    t = F.regexp_replace(F.regexp_replace(t, "-\n", ""), "\n", " ")
    for mark, plain in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(mark), F.lit(plain))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(t, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def bleu_counts(pairs: DataFrame) -> DataFrame:
    """pairs (config, prediction, gold) -> (config, n, matched, total, sys_len, ref_len): what corpus BLEU sums.

    Counts are clipped within a pair, where both texts lie: what leaves a batch is four rows a configuration.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for config, p, g in zip(*(c.to_pylist() for c in b.columns)):
                for n in range(1, ORDERS + 1):
                    own, other = (Counter(zip(*(x[i:] for i in range(n)))) for x in (p, g))
                    row = sums.setdefault((config, n), [0] * 4)
                    for k, v in enumerate(((own & other).total(), own.total(), len(p), len(g))):
                        row[k] += v
            cols = zip(*((c, n, *row) for (c, n), row in sums.items())) if sums else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(cols, (pa.string(), pa.int32(), *[pa.int64()] * 4))], names=["config", "n", "matched", "total", "sys_len", "ref_len"])

    rows = pairs.select("config", metric_tokens(F.col("prediction")).alias("p"), metric_tokens(F.col("gold")).alias("g"))
    parts = rows.mapInArrow(run, "config string, n int, matched long, total long, sys_len long, ref_len long")
    return parts.groupBy("config", "n").agg(*[F.sum(c).alias(c) for c in ("matched", "total", "sys_len", "ref_len")])


def corpus_bleu(pairs: DataFrame) -> DataFrame:
    """(config, bleu), 0 to 100: geometric mean of the four precisions (zeros smoothed by halves) and the brevity penalty."""
    order = Window.partitionBy("config").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = bleu_counts(pairs).where("total > 0")
    zeros = F.sum((F.col("matched") == 0).cast("int")).over(order)
    p = F.when(F.col("matched") > 0, F.col("matched") / F.col("total")).otherwise(1 / (F.pow(F.lit(2.0), zeros) * F.col("total")))
    rows = counts.withColumn("logp", F.log(p)).groupBy("config").agg(F.sum("logp").alias("s"), F.count(F.lit(1)).alias("k"), F.max("sys_len").alias("sl"), F.max("ref_len").alias("rl"), F.sum("matched").alias("m"))
    penalty = F.when(F.col("sl") < F.col("rl"), F.exp(1 - F.col("rl") / F.col("sl"))).otherwise(1.0)
    return rows.select("config", F.when((F.col("m") == 0) | (F.col("k") < ORDERS), 0.0).otherwise(100 * penalty * F.exp(F.col("s") / ORDERS)).alias("bleu"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors: a word operation per token of b and 64 of a."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    """F measure of the longest common subsequence of tokens [a-z0-9]+ of the lower-case texts."""
    cut = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    out = []
    for p, g in zip(prediction, gold):
        a, b = cut(p), cut(g)
        n = lcs_length(a, b) if a and b else 0
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out, dtype="float64")


#: Words of a side that are matched with the other side at once.
MATCHED = 1024


def best_matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a its greatest product with a row of b, and the other way round, in pieces of bounded size."""
    of_a, of_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), MATCHED):
        for j in range(0, len(b), MATCHED):
            m = a[i : i + MATCHED] @ b[j : j + MATCHED].T
            np.maximum(of_a[i : i + MATCHED], m.max(1), out=of_a[i : i + MATCHED])
            np.maximum(of_b[j : j + MATCHED], m.max(0), out=of_b[j : j + MATCHED])
    return of_a, of_b


def bert_score(pairs: DataFrame, vectors: TokenVectors = DigestVectors()) -> DataFrame:
    """pairs (config, qid, prediction, gold) -> (config, qid, precision, recall, f1): each word takes the most similar one
    of the other side. Rows go through Arrow batches; a text's distinct words are matched, weighed by how often they stand
    there; a side without words gives 0."""
    kind = dict(pairs.dtypes)["qid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if not p or not g:
                    out.append((0.0, 0.0, 0.0))
                    continue
                (wp, np_), (wg, ng) = (np.unique(np.array(x, dtype=object).astype(str), return_counts=True) for x in (p, g))
                of_p, of_g = best_matches(vectors.of(wp.tolist()), vectors.of(wg.tolist()))
                precision, recall = float((of_p * np_).sum() / len(p)), float((of_g * ng).sum() / len(g))
                out.append((precision, recall, 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0))
            cols = zip(*out) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array(c, type=pa.float64()) for c in cols]], names=["config", "qid", "precision", "recall", "f1"])

    return pairs.select("config", "qid", tokens(F.col("prediction")).alias("p"), tokens(F.col("gold")).alias("g")).mapInArrow(run, f"config string, qid {kind}, precision double, recall double, f1 double")


def is_hit(sources: Column, gold: Column, k: int = 5) -> Column:
    """Whether a gold source is part of one of the first k retrieved (in any case)."""
    return F.coalesce(F.exists(F.slice(sources, 1, k), lambda s: F.contains(F.lower(s), F.lower(gold))), F.lit(False))


def recall_at_k(rows: DataFrame, k: int = 5) -> DataFrame:
    """rows (config, sources, gold_source) -> (config, recall): percent of hits."""
    return rows.groupBy("config").agg((F.avg(is_hit(F.col("sources"), F.col("gold_source"), k).cast("int")) * 100).alias("recall"))


def configurations(spark) -> DataFrame:
    """(config, rag, finetuned): the four runs that are compared."""
    return spark.createDataFrame(list(CONFIGS), "config string, rag boolean, finetuned boolean")


def metrics(predictions: DataFrame, times: DataFrame, vectors: TokenVectors = DigestVectors()) -> DataFrame:
    """predictions (config, qid, prediction, gold, sources, gold_source), times (config, label, rag, time_seconds) -> one
    row a configuration; recall only where retrieval took part."""
    lengths = predictions.groupBy("config").agg((F.avg(rouge_l("prediction", "gold")) * 100).alias("rouge_l"), F.count(F.lit(1)).cast("int").alias("num_samples"))
    similar = bert_score(predictions, vectors).groupBy("config").agg((F.avg("f1") * 100).alias("bertscore_f1"))
    out = times.join(lengths, "config").join(corpus_bleu(predictions), "config").join(recall_at_k(predictions), "config").join(similar, "config")
    return out.select("config", "label", "bleu", "rouge_l", "bertscore_f1", "time_seconds", "num_samples", F.when(F.col("rag"), F.col("recall")).alias("recall_at_5"))


def human_eval_sheet(test: DataFrame, predictions: DataFrame, limit: int = 50) -> DataFrame:
    """test (qid, question, answer), predictions (config, qid, prediction) -> the sheet that people fill in."""
    names = [c for c, _, _ in CONFIGS]
    wide = predictions.groupBy("qid").pivot("config", names).agg(F.first("prediction"))
    rows = test.orderBy("qid").limit(limit).withColumn("no", F.row_number().over(Window.orderBy("qid"))).join(wide, "qid", "left")
    cols = [F.col("no").alias(HUMAN_EVAL_COLUMNS[0]), F.col("question").alias(HUMAN_EVAL_COLUMNS[1]), F.col("answer").alias(HUMAN_EVAL_COLUMNS[2])]
    for c in names:
        cols += [F.coalesce(F.col(c), F.lit("")).alias(f"Pred_{c}"), *[F.lit("").alias(f"Score_{c}_{x}") for x in HUMAN_EVAL_CRITERIA]]
    return rows.select(*cols)


def bleu_of(counts: list[tuple[int, int]], sys_len: int, ref_len: int) -> float:
    """Corpus BLEU from summed counts (matched, total) by order: the plain form of corpus_bleu, for tests and small runs."""
    if len(counts) < ORDERS or not any(m for m, _ in counts):
        return 0.0
    zeros, logs = 0, 0.0
    for m, t in counts:
        if not t:
            return 0.0
        zeros += not m
        logs += math.log(m / t if m else 1 / (2**zeros * t))
    return 100 * (math.exp(1 - ref_len / sys_len) if sys_len < ref_len else 1.0) * math.exp(logs / ORDERS)
