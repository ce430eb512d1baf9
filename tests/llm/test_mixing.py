import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing

from .conftest import rows_of, words


def water(sizes, weights):
    """Targets by repeated resharing."""
    live, out, left = set(sizes), {}, float(sum(sizes.values()))
    while live:
        w = sum(weights[s] for s in live)
        over = [s for s in live if left * weights[s] / w > 3 * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / w for s in live}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            live.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x")).collect()
        assert sorted(r["x"] for r in got) == list(range(n))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 9000, "c": 40, "d": 7000}, {"a": 1}, {"a": 5000, "b": 5000, "c": 5000}, {"a": 0, "b": 0}, {"b": 3, "a": 100000, "z": 1}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(sizes.items())], "skey bigint, source string, size bigint").withColumn("skey", F.xxhash64("source"))
    names = {r["skey"]: r["source"] for r in frame.collect()}
    want = water(sizes, dict(zip(sorted(sizes), [5, 2, 1] * 3)))
    got = {names[r["skey"]]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(want)


def test_mix(spark):
    texts = [(i, words(i, 40 + 13 * (i % 60))) for i in range(400)]
    docs = rows_of(spark, texts)
    one, two = (sorted(mixing.mix_counts(docs).collect()) for _ in range(2))
    assert one == two and len(one) == 400
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {d: len(t.split()) for d, t in texts}
    taken, target = {}, {}
    for r in one:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    for s, n in taken.items():
        assert n == pytest.approx(target[s], abs=2 * mixing.BLOCK)


def test_documents_hold_what_was_counted(docs, edge):
    counts = mixing.mix_counts(docs).collect()
    assert len(counts) == len(edge)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(r["text"].encode().split()) for r in rows) == sum(r["taken"] for r in counts)
    assert len(rows) == sum(r["taken"] > 0 for r in counts)
    known = {}
    for d, t in edge:
        known.setdefault(d, set()).update((t or "").encode().split())
    assert all(set(r["text"].encode().split()) <= known[r["doc_id"]] for r in rows)


def test_empty(spark, none):
    assert mixing.mix_counts(none).count() == 0
    assert mixing.mix_documents(none).count() == 0
    assert sorted(mixing.mix_counts(rows_of(spark, [(1, None), (2, "")])).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
