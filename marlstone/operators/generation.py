"""Model calls as operators: question-answer pairs and retrieval summaries made by a service, under its call policy."""
from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import read_or_empty
from ..sources.providers import CallPolicy
from ..streaming.incremental import pending
from .qa import parsed_pairs, parsed_summaries


def called(items: DataFrame, key: str, prompt: Column, policy: Callable[[], CallPolicy], call: Callable[[str, tuple], str], good: Callable[[str], bool] = bool) -> DataFrame:
    """key, reply: what the service says to each prompt; null where the policy gave the item back undone.

    policy() makes one partition's policy; call(model, (key, prompt)) asks the service; good is the policy's. Items go
    through Arrow batches and replies leave as they come, so a partition holds one batch. Each use of the result asks
    again, and so does a task that is run again: replies are written before they are used (logged_replies).
    """
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = policy()
        for b in batches:
            found = list(rules.run(zip(*(c.to_pylist() for c in b.columns)), call, good))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([reply for _, reply in found], type=pa.string())], names=[key, "reply"])

    return items.select(key, prompt.alias("prompt")).mapInArrow(run, f"`{key}` {kind}, reply string")


def logged_replies(items: DataFrame, key: str, prompt: Column, policy, call, log: str, every: int = 1 << 16, good: Callable[[str], bool] = bool) -> DataFrame:
    """The replies to items, by way of a log of (key, reply) in the shared folder `log`, in rounds of about `every` items.

    Items that the log has are not asked. A round's replies are appended before the next round begins, and read from there
    by all that use them: a run that stops, or a task that is lost, costs the replies of one round at most.
    """
    spark = items.sparkSession
    schema = f"`{key}` {dict(items.dtypes)[key]}, reply string"
    left = pending(items, read_or_empty(spark, log, schema, "parquet"), key)
    if left.take(1):
        in_rounds(left, key, every, lambda part: called(part, key, prompt, policy, call, good).where("reply is not null"), lambda made, k: made.write.mode("append").parquet(log))
    found = read_or_empty(spark, log, schema, "parquet")
    return found.join(items.select(key).distinct(), key, "left_semi").dropDuplicates([key])


def has_pair(reply: str) -> bool:
    """Whether a reply's list holds a valid pair; an error where the list is broken: the item is then asked again, and in
    the end stays pending. A reply without a list is a reply."""
    found = re.search(r"\[.*\]", re.sub(r"```(json)?\s*", "", reply), re.DOTALL)
    text = lambda v: str(v if v is not None else "").strip()
    return bool(found) and any(isinstance(x, dict) and text(x.get("question")) != "" and text(x.get("answer")) != "" for x in json.loads(found[0]))


def generated_pairs(chunks: DataFrame, done: DataFrame, prompt: Column, policy, call, log: str, every: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(pairs, done): chunks (chunk_id, source, section, text) that are not done are asked about, each once (see
    logged_replies). A reply without a valid pair marks its chunk done too; a chunk whose replies were broken lists, or
    that the policy gave back undone, stays pending."""
    left = pending(chunks, done, "chunk_id")
    replies = logged_replies(left, "chunk_id", prompt, policy, call, log, every, has_pair)
    told = left.select("chunk_id", "source", "section").join(replies, "chunk_id")
    return parsed_pairs(told), replies.select("chunk_id")


def generated_summaries(chunks: DataFrame, done: DataFrame, prompt: Column, policy, call, log: str, every: int = 1 << 16) -> DataFrame:
    """(chunk_id, text_for_retrieval) of the chunks that are not done."""
    left = pending(chunks, done, "chunk_id")
    replies = logged_replies(left, "chunk_id", prompt, policy, call, log, every)
    return parsed_summaries(left.select("chunk_id", "section").join(replies, "chunk_id"))


def in_rounds(items: DataFrame, key: str, every: int, work: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], None]) -> int:
    """Works through items in rounds of about `every`, saving each round before the next begins; returns the rounds.
    A run that stops loses one round. Rounds are dealt by a hash of the key: no order, no collected list."""
    n = max(1, -(-items.count() // every))
    for k in range(n):
        save(work(items.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)), k)
    return n
