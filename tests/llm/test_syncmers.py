import hashlib

import pytest

from pyspark.sql import functions as F

from marlstone.llm import syncmers

from .conftest import rows_of, words


def order(e):
    return (e[0] is not None, e[0] or 0, (e[1] or "").encode())


@pytest.mark.parametrize(("rows", "quantiles"), [(syncmers.RANGE_ROWS, 4096), (2, 4096), (1, 3)])
def test_edits(docs, edge, monkeypatch, rows, quantiles):
    """rows 2: many ranges, and seams between them. quantiles 3: ranges between quantiles are divided."""
    monkeypatch.setattr(syncmers, "RANGE_ROWS", rows)
    monkeypatch.setattr(syncmers, "MOST_QUANTILES", quantiles)
    out = syncmers.compared(docs).collect()
    rows = sorted(edge, key=order)
    want = []
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        want.append((d is None, d or 0, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], hashlib.sha256(r["edited"].encode()).hexdigest()) for r in out]
    assert sorted(got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)


def spelled_out(spark, texts):
    """Fingerprints by the definition, over whole texts at once; Spark gives the hash function only."""
    data = [t.encode() for t in texts]
    grams = sorted({d[i : i + n] for d in data for n in (syncmers.S, syncmers.K) for i in range(len(d) - n + 1)} | {d for d in data if 0 < len(d) < syncmers.K})
    frame = spark.createDataFrame([(bytearray(g),) for g in grams] or [(bytearray(b"-"),)], "g binary")
    rows = frame.select("g", F.xxhash64("g"), F.hash("g")).collect()
    h, small = {bytes(r[0]): r[1] for r in rows}, {bytes(r[0]): r[2] for r in rows}
    out = []
    for d in data:
        inner = [small[d[i : i + syncmers.S]] for i in range(len(d) - syncmers.S + 1)]
        first = {}
        for i in range(len(d) - syncmers.K + 1):
            own = inner[i : i + syncmers.K - syncmers.S + 1]
            if min(own) in (own[0], own[-1]):
                first.setdefault(h[d[i : i + syncmers.K]], i)
        if 0 < len(d) < syncmers.K:
            first = {h[d]: 0}
        out.append({x: first[x] for x in sorted(first)[: syncmers.SKETCH]})
    return out


def alike(a, b):
    union = sorted(a | b)[: syncmers.SKETCH]
    return sum(x in a and x in b and abs(a[x] - b[x]) <= syncmers.DRIFT for x in union) / len(union) if union else 1.0


@pytest.mark.parametrize("block", [1 << 14, 100])
def test_fingerprints_and_likeness_by_the_definition(spark, monkeypatch, edge, block):
    monkeypatch.setattr(syncmers, "BLOCK", block)
    texts = [(k, t or "") for k, (_, t) in enumerate(sorted(edge, key=order)) if len(t or "") < 4000]
    texts += [(100 + k, t) for k, t in enumerate(["x" * 23, "x" * 24, "y" * 47 + "é", words(50, 200).replace(" ", ""), words(51, 90)])]
    out = sorted(syncmers.compared(rows_of(spark, texts)).collect(), key=lambda r: r["doc_id"])
    own = spelled_out(spark, [t for _, t in texts])
    edited = spelled_out(spark, [r["edited"] for r in out])
    shown = lambda f: "".join(f"{x % 2**64:016x}{p:08x}" for x, p in f.items())
    for k, r in enumerate(out):
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(own[k]), shown(edited[k])), texts[k]
        assert r["near_edited"] == pytest.approx(alike(own[k], edited[k]))
        assert r["near_next"] == pytest.approx(alike(own[k], own[(k + 1) % len(out)]))


def test_equal_texts_and_likeness(spark):
    a, b = words(1, 400), words(2, 400)
    moved = words(3, 3) + " " + a
    texts = [(1, a), (2, a), (3, moved), (4, b), (5, a[: len(a) // 2] + b), (6, words(7, 900).replace(" ", "")), (7, words(8, 900).replace(" ", ""))]
    out = {r["doc_id"]: r for r in syncmers.compared(rows_of(spark, texts)).collect()}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] != out[4]["fingerprint"]
    assert out[1]["near_next"] == 1.0 and out[2]["near_next"] > 0.8 and out[3]["near_next"] < 0.1 < 0.15 < out[5]["near_edited"]
    assert all(r["near_edited"] > 0.15 for r in out.values())


def test_cuts(spark):
    cuts = [-5, 0, 3, 4, 9, 100, 101, 200]
    for held in (cuts, cuts[:1], []):
        got = spark.range(-10, 210).select("id", syncmers.cuts_below(F.col("id"), held).alias("n")).collect()
        assert all(r["n"] == sum(c <= r["id"] for c in held) for r in got)


def test_empty(spark, none):
    assert syncmers.compared(none).count() == 0
    one = syncmers.compared(rows_of(spark, [(1, None)])).collect()
    assert [(r["n_chars"], r["fingerprint"], r["near_next"]) for r in one] == [(0, "", 1.0)]
    null = syncmers.compared(rows_of(spark, [(None, "a b"), (None, "c")])).collect()
    assert sorted(r["edited"] for r in null) == ["a ca"[:2] + "c", "c"] or len(null) == 2
