import re
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, kn_quality, mixing, queries, simhash

from .conftest import rows_of, words

STAGES = dict(corpus_pipeline.STAGES)


def brute_exact(rows):
    """Of equal normalised texts the row of the smallest id (null ids last)."""
    best = {}
    for d, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        place = (d is None, d or 0)
        best[key] = min(best.get(key, place), place)
    return sorted(best.values())


def brute_near(rows):
    """Of documents whose fingerprints are linked by steps of at most two bits, the row of the smallest id."""
    prints = sorted({simhash.fingerprint_of((t or "").encode()) for _, t in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= simhash.RADIUS:
                root[max(find(a), find(b))] = min(find(a), find(b))
    best = defaultdict(lambda: (True, 1 << 62))
    for d, t in rows:
        p = find(simhash.fingerprint_of((t or "").encode()))
        best[p] = min(best[p], (d is None, d or 0))
    return sorted(best.values())


def of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def places(rows):
    return sorted((d is None, d or 0) for d, _ in rows)


def run_and_check(spark, docs, sf_dir):
    """Each stage on all that its predecessor kept, held against plain means."""
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = STAGES["quality classifier"](spark, docs, sf_dir).cache()
    verdict = kn_quality.classify(docs, labels)
    assert good.columns == columns and good.count() == verdict.where("kept").count()
    assert sorted(map(repr, of(good))) == sorted(map(repr, of(docs.join(verdict.where("kept").select("doc_id").distinct(), "doc_id", "left_semi")))) or docs.where("doc_id is null").count()
    exact = STAGES["exact dedup"](spark, good, sf_dir).cache()
    assert exact.columns == columns and places(of(exact)) == brute_exact(of(good))
    near = STAGES["SimHash near-dedup"](spark, exact, sf_dir).cache()
    assert near.columns == columns and places(of(near)) == brute_near(of(exact))
    mixed = STAGES["mixing sources"](spark, near, sf_dir).cache()
    taken = {(r["doc_id"], r["taken"]) for r in mixing.mix_counts(near).where("taken > 0").collect()}
    assert mixed.columns == columns and {(d, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for d, t in of(mixed)} == taken
    tokens = STAGES["byte-level BPE"](spark, mixed, sf_dir).collect()
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = sorted(((r["doc_id"] or 0, enc.decode_bytes(np.frombuffer(r["ids"], dtype="<u4").tolist()).decode()) for r in tokens))
    assert decoded == sorted((d or 0, t) for d, t in of(mixed)) and all(r["n_tokens"] * 4 == len(r["ids"]) for r in tokens)
    return len(decoded)


def test_stages_against_plain_means(spark, small):
    assert run_and_check(spark, spark.read.parquet(f"{small}/documents.parquet"), small) > 0


def test_chain_on_edges(spark, edge, small):
    """Nulls in any column, empty, blank and long texts, copies, repeated rows and ids, columns with clashing names."""
    texts = edge + [(100 + k, words(k, 30)) for k in range(12)]
    docs = rows_of(spark, texts).withColumn("odd name", F.lit(1)).withColumn("row", F.lit("r")).withColumn("nth", F.lit(2))
    assert run_and_check(spark, docs, small) > 0


def test_chain_on_an_empty_table(spark, none, small):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0


def test_rows_alike_in_id_and_text_keep_one_place(spark):
    """Rows that differ in other columns only: the mix and the dedup choose the same ones however the table is dealt."""
    rows = [(k % 5, words(k % 5, 40), f"s{k % 2}", k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    seen = set()
    for n in (1, 3, 7):
        dealt = docs.repartition(n, F.rand(n))
        kept = STAGES["exact dedup"](spark, dealt, "")
        mixed = STAGES["mixing sources"](spark, dealt, "")
        seen.add((tuple(sorted(map(tuple, kept.collect()))), tuple(sorted(map(tuple, mixed.collect())))))
    assert len(seen) == 1


def test_queries_are_registered():
    names = queries.queries()
    assert sorted(int(x[2:].split("_")[0]) for x in names) == list(range(1, 14))
    assert set(queries.sql()) <= set(names)
