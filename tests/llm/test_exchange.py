import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import _exchange as ex

HELD = "chunk long, key long, n long"


def test_packing():
    r = np.random.default_rng(1)
    for x in ([], [0], [0, 0], [1, 2, 300], [5_000_000_000, 1], [2**62]):
        assert ex.unpacked(ex.packed(np.array(x, dtype=np.int64)), len(x)).tolist() == x
    signed = np.array([0, -1, 1, -(2**40), 2**40])
    assert ex.unpacked(ex.packed(signed), 5).tolist() == signed.tolist()
    for n in (0, 1, 1000):
        first, second = (r.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        d = ex.Distinct(np.concatenate([first, first]), np.concatenate([second, second]))
        a, b = ex.Keys.read(d.keys.cut(slice(None)), n, True)
        assert np.array_equal(a, d.keys.first) and np.array_equal(b, d.keys.second)
        assert d.sums(np.arange(2 * n)).sum() == n * (2 * n - 1)


@pytest.mark.parametrize(("chunks", "bits"), [(5, 8), (9, 2), (20, 2)])
def test_sums_come_back(spark, monkeypatch, chunks, bits):
    """Every chunk is told the sum over all chunks of each of its keys, far over 2^32, at any number of levels."""
    monkeypatch.setattr(ex, "FAN_BITS", bits)
    route = ex.Route.through(chunks)
    r = np.random.default_rng(chunks)
    pool = r.integers(0, 2**64, 60, dtype=np.uint64)
    held = [{int(k): int(r.integers(1, 2**40)) for k in r.choice(pool, 25, replace=False)} for _ in range(chunks)]
    rows = [(c, k - 2**64 if k >> 63 else k, n) for c, d in enumerate(held) for k, n in d.items()]

    def of(group):
        d = ex.Distinct(group.column("key").to_numpy().view(np.uint64))
        return group.column("chunk")[0].as_py(), d.keys, d.sums(group.column("n").to_numpy())

    def ask(group):
        chunk, keys, n = of(group)
        second = route.requests(keys, [-n], chunk | 1 << ex.PLACE_BITS, chunk)
        return pa.concat_tables([route.requests(keys, [n], chunk, chunk), second])

    def got(group, known):
        chunk, keys, _ = of(group)
        a, b = ex.told(known, 1, keys, route.bits), -ex.told(known, 2, keys, route.bits)
        return pa.table({"chunk": [chunk] * len(keys), "key": keys.first.view(np.int64), "n": a, "m": b})

    by_chunk = spark.createDataFrame(rows, HELD).groupBy("chunk")
    exchange = ex.Exchange(by_chunk.applyInArrow(ask, ex.REQUEST_DDL), route, 1, lambda keys, sums: (sums[0], [int(sums[0].sum())]))
    out = by_chunk.cogroup(exchange.replies.groupBy("to")).applyInArrow(got, "chunk long, key long, n long, m long").collect()
    want = {}
    for d in held:
        for k, n in d.items():
            want[k] = want.get(k, 0) + n
    assert len(out) == len(rows)
    assert all(x["n"] == x["m"] == want[x["key"] % 2**64] for x in out)
    assert exchange.replies.where("kind = 1").agg(F.sum(F.col("totals")[0])).first()[0] == sum(want.values())


def test_messages_grow_with_chunks():
    """Rows of requests: at most FAN a chunk and level, so five times the chunks send five times the rows."""
    keys = ex.Distinct(np.random.default_rng(0).integers(0, 2**64, 50_000, dtype=np.uint64)).keys
    sent = {chunks: chunks * ex.Route.through(chunks).levels * len(list(ex.Route.through(chunks).nodes(keys, 0, 1))) for chunks in (41, 205)}
    assert sent[205] == 5 * sent[41] == 205 << ex.FAN_BITS


def test_keys_are_stored_as_their_steps():
    """A message's first key does not widen the steps of the others: under 6.5 bytes a key, where the whole first key as a step gave 7."""
    keys = ex.Distinct(np.random.default_rng(5).integers(0, 2**64, 1 << 20, dtype=np.uint64)).keys
    rows = ex.Route(1, 8).requests(keys, [], 0, 0)
    assert sum(map(len, rows.column("keys").to_pylist())) < 6.5 * len(keys)
    read = np.concatenate([ex.Keys.read(data, n, False)[0] for data, n in zip(rows.column("keys").to_pylist(), rows.column("n").to_pylist())])
    assert np.array_equal(read, keys.first)


def test_one_level_of_nodes_for_op6(spark, monkeypatch):
    """750 chunks (6 GB) need no second level, which stages and moves every request again; scores don't depend on chunks."""
    from marlstone.llm import suffix_tree_lm as lm

    assert [lm.route_of(n).levels for n in (1, 64, 257, 750, 4096, 4097)] == [1, 1, 1, 1, 1, 2] and lm.route_of(64).bits == lm.FAN_BITS
    docs = spark.createDataFrame([(d, f"a b c a b c d{d % 7} e f{d} a b") for d in range(60)], "doc_id long, text string").repartition(1)
    rows = lambda: sorted((r["doc_id"], r["n_known"], round(r["score"], 9)) for r in lm.score_documents(docs).collect())
    whole = rows()
    monkeypatch.setattr(lm, "CHUNK_BYTES", 64)
    monkeypatch.setattr(lm, "FAN_BITS", 2)
    assert rows() == whole
