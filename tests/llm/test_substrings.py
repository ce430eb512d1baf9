import random
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import _exchange, passages, run_length_index as rli

from .conftest import rows_of, words


def brute_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(d), int(gone.sum()), np.frombuffer(d, dtype=np.uint8)[~gone].tobytes()))
    return out


def brute_words(texts, window):
    data = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(d), sum(gone), b" ".join(w for w, g in zip(d, gone) if not g)))
    return out


def key(doc_id):
    return (doc_id is None, doc_id or 0)


def repeats(spark, seed):
    """Texts that share passages, near copies, periodic runs, at and around the lengths that count."""
    r = random.Random(seed)
    base = [words(100 + seed * 50 + k, 150) for k in range(6)]
    texts = []
    for k in range(60):
        a, b = r.choice(base), words(seed * 1000 + k, r.randint(5, 90))
        cut = r.randint(0, len(a) // 2)
        texts.append((k, b[: r.randint(0, len(b))] + a[cut : cut + r.choice([200, 399, 400, 401, 600])] + " " + b))
    texts += [(100, "ab" * 900), (101, "c" * 1500), (102, "ab" * 250 + "x" + "ab" * 250), (103, base[0]), (104, base[0])]
    return texts


@pytest.mark.parametrize(("hot", "seed", "fan_bits"), [(rli.HOT, 0, 8), (rli.HOT, 1, 2), (3, 0, 8)])
def test_bytes(spark, monkeypatch, hot, seed, fan_bits):
    """hot 3: most families go the way of those that no index should hold. fan_bits 2: two levels of nodes."""
    monkeypatch.setattr(rli, "HOT", hot)
    monkeypatch.setattr(_exchange, "FAN_BITS", fan_bits)
    monkeypatch.setattr(rli, "CHUNK_BYTES", 8000)
    texts = repeats(spark, seed)
    out = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"]), r["n_spans"], r["spans"]) for r in rli.remove_repeats(rows_of(spark, texts)).collect()))
    want = brute_bytes([t for _, t in texts], rli.LENGTH)
    assert [o[1:4] for o in out] == want
    assert all(o[4] == len(o[5]) and sum(n for _, n in o[5]) == o[2] for o in out)


def test_bytes_edges(docs, edge, none):
    out = sorted((key(r["doc_id"]), r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in rli.remove_repeats(docs).collect())
    want = sorted((key(d), *b) for (d, _), b in zip(edge, brute_bytes([t for _, t in edge], rli.LENGTH)))
    assert out == want
    assert rli.remove_repeats(none).count() == 0


def test_index_alone():
    r = random.Random(3)
    base = bytes(r.choice(b"abc") for _ in range(300))
    texts = [base[i : i + r.randint(1, 200)] + bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) for i in range(0, 200, 9)] + [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaa"]
    index = rli.RunLengthIndex(texts)
    every = [t[i:] for t in texts for i in range(len(t))]
    best = index.matching_statistics()
    at = 0
    for t, b in zip(texts, index.begins.tolist()):
        for i in range(len(t)):
            s = t[i:]
            common = lambda x: next((k for k, (p, q) in enumerate(zip(s, x)) if p != q), min(len(s), len(x)))  # noqa: E731, B023
            want = max(common(x) for k, x in enumerate(every) if k != at)
            assert best[b + i] == want
            at += 1
    assert len(index.heads) == len(index.symbols) == len(index.head_at) == len(index.tail_at) == len(index.agree) + 1 < index.n


def test_index_follows_runs():
    """Copies with few edits: the index holds some thousandth of the text, whose places it tells all."""
    r = random.Random(5)
    base = bytes(r.choice(b"abcdefgh") for _ in range(2000))
    texts = [base[:k] + b"X" + base[k:] for k in range(0, 2000, 50)]
    index = rli.RunLengthIndex(texts)
    assert len(index.heads) < index.n / 10 and sum(m.sum() for m in index.repeats(300)) > index.n / 3


def test_words(spark, monkeypatch):
    texts = [(k, t) for k, t in enumerate(w for _, w in repeats(spark, 4))]
    passage = words(77, 60).split()
    for n in (17, 34, 35, 36, 52, 60):
        texts += [(200 + n, words(n, 31) + " " + " ".join(passage[:n]) + " " + words(n + 1, 22))]
    texts.append((300, "the end " * 60))
    out = sorted((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in passages.remove_passages(rows_of(spark, texts)).collect())
    assert [o[1:] for o in out] == brute_words([t for _, t in sorted(texts)], passages.WINDOW)


def test_words_edges(docs, edge, none):
    out = sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], bytes(r["kept"])) for r in passages.remove_passages(docs).collect())
    want = sorted((key(d), *b) for (d, _), b in zip(edge, brute_words([t for _, t in edge], passages.WINDOW)))
    assert out == want
    assert passages.remove_passages(none).count() == 0
