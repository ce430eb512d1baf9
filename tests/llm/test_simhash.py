import itertools
import random

import numpy as np
import pytest
import xxhash

from marlstone.llm import simhash

from .conftest import rows_of


def brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_groups(docs, edge):
    out = simhash.near_groups(docs).collect()
    assert len(out) == len(edge)
    fps = [brute(t) for _, t in edge]
    assert sorted(r["fingerprint"] for r in out) == sorted(f"{f:016x}" for f in fps)
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}
    for _ in distinct:
        for a, b in itertools.combinations(distinct, 2):
            if (a ^ b).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    least = {}
    for (d, _), f in zip(edge, fps):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    for r in out:
        assert r["component_id"] == least.get(root[int(r["fingerprint"], 16)])


def test_one_of_each_group_stays(docs):
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    prints = [brute(r["text"]) for r in kept.collect()]
    assert all((a ^ b).bit_count() > 2 for a, b in itertools.combinations(prints, 2))


def test_every_pair_within_the_radius_collides():
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m & (1 << i | 1 << j) for m in simhash.MASKS)


@pytest.mark.parametrize("small,wide", [(16, 1 << 16), (2, 8)])
def test_links_by_every_path(spark, monkeypatch, small, wide):
    """Clusters of fingerprints: small buckets, large ones, and wide ones that are split again give the same components."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "WIDE", wide)
    r = random.Random(5)
    values = set()
    for _ in range(6):
        at = r.getrandbits(64)
        for _ in range(40):
            values.add(at)
            at ^= 1 << r.randrange(64) | 1 << r.randrange(64)
    values |= {r.getrandbits(64) for _ in range(30)}
    values = sorted(values)
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp bigint")
    roots = {row["v"]: row["root"] for row in simhash.components(simhash.links(frame)).collect()}
    want = {v: v for v in values}

    def find(v):
        while want[v] != v:
            v = want[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            x, y = find(a), find(b)
            want[max(x, y)] = min(x, y)
    groups = lambda key: sorted(sorted(g) for g in _grouped(values, key))
    assert groups(find) == groups(lambda v: roots.get(simhash.signed(v), simhash.signed(v)))


def _grouped(values, key):
    out = {}
    for v in values:
        out.setdefault(key(v), []).append(v)
    return out.values()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_long_text_in_parts():
    text = " ".join(str(i % 977) for i in range(140000)).encode()
    assert simhash.fingerprint_of(text) == brute(text.decode())


def test_empty(spark, none):
    assert simhash.near_groups(none).count() == 0
    assert simhash.near_groups(rows_of(spark, [(None, None)])).collect()[0]["component_id"] is None
    assert np.array(simhash.MASKS).shape == (7,)
