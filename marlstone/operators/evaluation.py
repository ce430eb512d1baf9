"""A run over configurations: predictions per question that can be resumed, counters, metrics and a results file."""
from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import read_or_empty
from ..sources.providers import DigestVectors, TokenVectors
from ..streaming.incremental import pending
from . import evaluate as E
from .generation import in_rounds

PREDICTION_DDL = "config string, qid bigint, prediction string, sources array<string>"
RUN_DDL = "config string, success bigint, error bigint, skip bigint, chars bigint, time_seconds double"
RESULT_DDL = "config string, label string, bleu double, rouge_l double, bertscore_f1 double, time_seconds double, num_samples int, recall_at_5 double, success bigint, error bigint, skip bigint, chars bigint, runs bigint"
#: questions (qid, question) -> (qid, prediction, sources); a question that could not be answered has a null prediction.
Answerer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    """A folder that holds a run: predictions and counters of each attempt, and the results."""

    spark: SparkSession
    folder: str
    every: int = 1 << 14
    clock: Callable[[], float] = time.time

    def predictions(self) -> DataFrame:
        """One row for each question and configuration that has an answer; a round that was saved twice counts once."""
        return read_or_empty(self.spark, f"{self.folder}/predictions", PREDICTION_DDL, "parquet").dropDuplicates(["config", "qid"])

    def counters(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.folder}/runs", RUN_DDL, multi_line=False)

    def answer(self, config: str, questions: DataFrame, answerer: Answerer) -> None:
        """Answers the questions that have no prediction yet, in rounds that are saved one by one: a run that stops loses
        one round, and questions that failed are asked again by the next."""
        began, path = self.clock(), f"{self.folder}/predictions"
        done = self.predictions().where(F.col("config") == config)
        left = pending(questions, done, "qid")
        n, asked = questions.count(), left.count()
        if asked:
            work = lambda part: answerer(part).where("prediction is not null").select(F.lit(config).alias("config"), F.col("qid").cast("long").alias("qid"), "prediction", "sources")
            in_rounds(left, "qid", self.every, work, lambda made, k: made.write.mode("append").parquet(path))
        made = pending(self.predictions().where(F.col("config") == config), done, "qid").agg(F.count(F.lit(1)), F.sum(F.length("prediction"))).first()
        row = (config, made[0], asked - made[0], n - asked, made[1] or 0, float(self.clock() - began))
        self.spark.createDataFrame([row], RUN_DDL).write.mode("append").json(f"{self.folder}/runs")

    def results(self, gold: DataFrame, labels: dict[str, str], vectors: TokenVectors = DigestVectors()) -> DataFrame:
        """gold (qid, gold, gold_source): metrics and counters of each configuration, written as JSON and read again."""
        rows = self.predictions().join(gold, "qid")
        counts = self.counters().groupBy("config").agg(*[F.sum(c).alias(c) for c in ("success", "error", "chars", "time_seconds")], F.sum("skip").alias("skip"), F.count(F.lit(1)).alias("runs"))
        named = self.spark.createDataFrame(list(labels.items()), "config string, label string")
        times = E.configurations(self.spark).join(named, "config").join(counts.select("config", "time_seconds"), "config").select("config", "label", "rag", "time_seconds")
        out = E.metrics(rows, times, vectors).join(counts.drop("time_seconds"), "config").select(*[c.split()[0] for c in RESULT_DDL.split(", ")])
        out.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.folder}/results")
        return read_or_empty(self.spark, f"{self.folder}/results", RESULT_DDL, multi_line=False)
