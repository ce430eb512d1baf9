"""op11 to op13 against plain versions."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
import tokenizers

from marlstone.llm import alignment, collocations, token_counts
from marlstone.llm._vocabulary import counter, encoder

from .conftest import rows_of, words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = list(" \t\n\r\x0b\x0c\x00aAé'sll'1239!?<|>_  　‍ 中文👍🏽﻿\x1c\x85▁") + ["  ", " ", "the", "<s>", "<|endoftext|>"]


def odd_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(n)]


def plain():
    hf = tokenizers.Tokenizer.from_file(BYTES)
    hf.encode_special_tokens = True
    return hf, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_encoders_are_the_libraries():
    hf, sp = plain()
    count, a, b = counter(PIECES), encoder(BYTES), encoder(PIECES)
    default = tokenizers.Tokenizer.from_file(BYTES)
    counted = counter(BYTES)
    for t in odd_texts(1, 3000) + [words(1, 500), words(2, 300) + "\n\n " + words(3, 30) + "  x"]:
        assert count(t) == len(sp.encode(t)) and counted(t) == len(default.encode(t, add_special_tokens=False).ids)
        if t:
            assert a(t).tolist() == hf.encode(" " + t, add_special_tokens=False).ids
            got = b(t)
            assert got is None if "▁" in t else got.tolist() == sp.encode(t)


def test_token_counts(docs, edge, none, spark, tmp_path):
    _, sp = plain()
    cache = f"file://{tmp_path}/cache"
    want = sorted((str(d), len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for d, t in edge)

    def got(rows):
        return sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(rows, PIECES, cache, 100).collect())

    def runs():
        return sorted(spark.read.parquet(str(p)).count() for p in tmp_path.glob("cache/*/run=*"))

    distinct = len({t or "" for _, t in edge})
    assert got(docs) == want and runs() == [distinct]
    assert got(docs) == want and runs() == [0, distinct]  # every text is known now
    more = docs.unionByName(rows_of(spark, [(99, "new one"), (98, "new one"), (97, "new▁one"), (96, None)]))
    assert len(got(more)) == len(edge) + 4 and runs() == [0, 1, distinct]
    assert got(none) == [] and token_counts.count_tokens(docs, PIECES).count() == len(edge)
    assert token_counts.count_tokens(docs, BYTES, cache).count() == len(edge) and len(list(tmp_path.glob("cache/tokenizer=*"))) == 2


def test_an_interrupted_append_does_no_harm(docs, edge, spark, tmp_path):
    """A part of a run, and the same digest in two runs."""
    cache = f"file://{tmp_path}/cache"
    first = sorted(map(str, token_counts.count_tokens(docs, PIECES, cache).collect()))
    run = next(tmp_path.glob("cache/*/run=*"))
    spark.read.parquet(str(run)).limit(5).write.parquet(f"{run.parent}/run=other")
    for p in [*run.glob("part-*")][:1]:
        p.unlink()
    (run / "_SUCCESS").unlink()
    assert sorted(map(str, token_counts.count_tokens(docs, PIECES, cache).collect())) == first


def spelled_alignment(texts):
    """By text: ids of both sides, groups; over all: the results that align() returns."""
    hf, sp = plain()
    entry = {i: t for t, i in hf.get_vocab(with_added_tokens=False).items()}
    shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    back = {c: b for b, c in (shown | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}).items()}
    docs = []
    for t in texts:
        a = [(i, bytes(back[c] for c in entry[i])) for i in hf.encode(" " + (t or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(t or "")]
        if not t or any(b"".join(x for _, x in side) != b" " + t.encode() for side in (a, b)):
            docs.append([])
            continue
        ends = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                at += len(x)
                own.append((at, i))
            ends.append(own)
        common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups, low = [], 0
        for high in common:
            groups.append(tuple(tuple(i for e, i in own if low < e <= high) for own in ends))
            low = high
        docs.append(groups)
    held = Counter(p for g in docs for p in {(x, y) for a, b in g for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for g in docs:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), text))
    return out


def compared(rows, texts, **more):
    got = sorted((r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in alignment.align(rows, BYTES, PIECES, **more).collect())
    assert got == sorted(spelled_alignment(texts))


def test_alignment(docs, edge, none):
    compared(docs, [t for _, t in edge])
    assert alignment.align(none, BYTES, PIECES).count() == 0


def test_alignment_in_small_pieces(spark):
    """Texts of many rows of events, windows that end inside a text, many chunks, several levels of nodes, groups of many links."""
    texts = odd_texts(5, 60) + [words(7, 700), "x" * 3000, "中" * 900, "=" * 400 + "- " * 50, "0" * 777, None, "", words(8, 40)] * 2
    rows = rows_of(spark, list(enumerate(texts))).repartition(3)
    compared(rows, texts, sizes=alignment.Sizes(events=37, window=50, chunk=200, fan_bits=2))


def spelled_collocations(rows, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {p: a for p, a in f.items() if a >= 30}
    found, gone = [], set()
    for (lang, p), a in f.items():
        if len(p) > 1:
            score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((lang, -score, -a, " ".join(p).encode(), p, l, r))
            gone |= {(lang, p[i:j]) for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * f[lang, p[i:j]]}
    out, rank = [], Counter()
    for lang, score, a, _, p, l, r in sorted(found):
        if (lang, p) not in gone:
            rank[lang] += 1
            if rank[lang] <= top:
                out.append((lang, rank[lang], " ".join(p), -a, l, r, n[lang], -score))
    return out


def test_collocations(spark, docs, edge, none):
    r = random.Random(3)
    texts = []
    for d in range(400):
        lang = r.choice(["en", "de", None, "und"])
        w = []
        while len(w) < 60:
            w += r.choice([["new", "york", "city", "hall"], ["in", "the", "end"], ["In", "THE", "end"], [r.choice("abcdefgh")], ["é　x"], ["r", "r", "r"], ["the", r.choice("abc")]])
        texts.append((lang, "".join(x + r.choice([" ", " ", " ", "  ", "\t", " \t", ". ", ",", "\n", " ;"]) for x in w)))
    texts += [("en", None), ("en", ""), (None, " .\n;"), ("en", "york " * 3000)]
    rows = spark.createDataFrame([(k, t, x, "s", None) for k, (x, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, chunk string")
    for more in ({}, {"per_chunk": 1000, "fan_bits": 2}):
        got = [tuple(x) for x in collocations.mine(rows.repartition(4), top=50, **more).orderBy("lang", "rank").collect()]
        assert got == spelled_collocations(texts, 50) and len(got) > 60
    assert collocations.mine(none).count() == 0
    found = collocations.mine(docs).collect()
    assert [tuple(x) for x in sorted(found, key=lambda x: (x["lang"], x["rank"]))] == spelled_collocations([("en" if k % 3 else None, t) for k, (_, t) in enumerate(edge)], 2000)


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50000):
        keys = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        table = collocations.PerfectHash(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(r.integers(0, 2**63, 1000).astype(np.uint64), keys)
        assert (table.slots(others) == -1).all()
