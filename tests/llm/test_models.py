import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import kn_quality, suffix_tree_lm, toxicity

from .conftest import rows_of, words


def test_suffix_tree_base(docs, edge, none):
    out = suffix_tree_lm.score_documents(docs).collect()
    assert len(out) == len(edge) and suffix_tree_lm.score_documents(none).count() == 0
    toks = [[*(t or "").encode().lower().split(), None] for _, t in edge]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in edge]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((h, len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in t), 6)) for t, h in zip(toks, held))
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] <= 0 for r in out)


def test_suffix_tree_beats_words_alone(spark):
    """Text with order in it: what follows a word is mostly fixed."""
    r = np.random.default_rng(2)
    follow = {k: [int(x) for x in r.integers(0, 60, 2)] for k in range(60)}
    texts = []
    for d in range(300):
        w, at = [], int(r.integers(60))
        for _ in range(60):
            w.append(f"w{at}")
            at = follow[at][int(r.random() < 0.1)] if r.random() < 0.95 else int(r.integers(60))
        texts.append((d, " ".join(w)))
    out = suffix_tree_lm.score_documents(rows_of(spark, texts)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.75 * out[1]


def test_suffix_tree_sums_to_one():
    """The smoothed distribution of a state is one: known next words and the unknown one together."""
    root = {"a": 0.5, "b": 0.3, None: 0.2}
    count = {"a": 3, "b": 0, None: 0}
    assert sum(suffix_tree_lm.smoothed(count[x], 3, p) for x, p in root.items()) == pytest.approx(1)


def spelled_kneser_ney(texts, order, symbols, lut):
    """-ln p of an n-gram by the textbook's recursion over dictionaries."""
    codes = [[0] * (order - 1) + [int(lut[ord(c)]) for c in t] for t in texts]
    counts = {order: Counter(tuple(c[i : i + order]) for c in codes for i in range(len(c) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: kn_quality.discounts(Counter(n for n in c.values())) for k, c in counts.items()}

    def p(g):
        if not g:
            return 1 / symbols
        k = len(g)
        same = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        share = sum(d[k][min(n, 3)] for n in same.values()) / total
        return max(same.get(g, 0) - d[k][min(same.get(g, 0), 3)], 0) / total + share * p(g[1:])

    return lambda g: -math.log(p(g))


def test_kneser_ney_against_the_recursion(spark):
    texts = [words(k, 12) for k in range(30)] + ["", "zz", "a"]
    model = kn_quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    lut = model.table()
    want = spelled_kneser_ney(texts, kn_quality.ORDER, kn_quality.SYMBOLS, lut)
    for t in (texts[0][:40], "abc zzz qqq", words(99, 6), "\u4e2d\u6587"):
        held = [0] * (kn_quality.ORDER - 1) + [int(lut[ord(c)]) for c in t]
        each = [want(tuple(held[i : i + kn_quality.ORDER])) for i in range(len(t))]
        assert model.cost[kn_quality.addresses(t, lut)].astype(float) == pytest.approx(np.array(each), rel=2e-3, abs=2e-3)
    rows = np.exp(-model.cost.astype(np.float64)).reshape(-1, kn_quality.SYMBOLS)
    assert rows[np.random.default_rng(0).integers(0, len(rows), 2000)].sum(axis=1) == pytest.approx(np.ones(2000), abs=0.02)


def test_quality(spark, docs, edge, none):
    good = [(i, words(i, 60)) for i in range(1000, 2000)]
    bad = [(i, words(i, 60).upper().replace(" ", "!! ")) for i in range(2000, 2020)]
    every = rows_of(spark, edge + good + bad).withColumn("lang", F.lit("en")).withColumn("odd name", F.lit(1)).withColumn("s", F.struct(F.lit(1).alias("a b")))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:800]] + [(2000, 0, 0), (None, 1, 0), (2001, None, None)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in kn_quality.classify(every, labels).collect() if r["doc_id"] is not None}
    assert not any(out[i]["kept"] for i, _ in bad)
    assert sum(out[i]["kept"] for i, _ in good) >= 0.97 * len(good)
    assert out[1]["kept"] and out[2]["kept"] and out[4]["kept"]
    kept = kn_quality.quality_filter(every, labels)
    assert kept.columns == every.columns and kept.count() == kn_quality.classify(every, labels).where("kept").count()
    assert kn_quality.classify(docs, labels.limit(0)).where("kept and perplexity is null").count() == len(edge)
    assert kn_quality.quality_filter(none, labels).count() == 0


def test_quality_counts_all_trusted_text(spark, monkeypatch):
    """Of more trusted documents than any sample took: every n-gram's count is in the model, in counts handed on in parts."""
    seen = []
    train, counts = kn_quality.train, kn_quality.kneser_ney
    monkeypatch.setattr(kn_quality, "train", lambda trusted: (seen.append(sorted(r["text"] for r in trusted.collect())), train(trusted))[1])
    monkeypatch.setattr(kn_quality, "kneser_ney", lambda grams: (seen.append(grams.agg(F.sum("n")).first()[0]), counts(grams))[1])
    for name in ("COUNTED", "HANDED_ON"):
        monkeypatch.setattr(kn_quality, name, 100)
    n = 12000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert kn_quality.classify(docs, labels).count() == n
    want = [f"text {r['doc_id']}" for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).select("doc_id").collect()]
    assert len(want) > 5000 and seen == [sorted(want), sum(map(len, want))]


def test_quality_model_holds_contexts_of_the_text(spark):
    """A row for each context that text has, none for the others."""
    texts = [words(k, 12) for k in range(30)]
    model = kn_quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    lut = model.table()
    contexts = {int(x) // kn_quality.SYMBOLS for t in texts for x in kn_quality.addresses(t, lut)}
    assert len(model.rows) == kn_quality.SYMBOLS ** (kn_quality.ORDER - 2) + len(contexts)


def test_quality_model_counts_every_character(spark):
    """Characters beyond the most frequent ones have counts of their own; all shares of their class sum to one."""
    common = "".join(chr(0x100 + k) * 40 for k in range(kn_quality.SYMBOLS - 2))
    rare = {chr(0x400 + k): k + 1 for k in range(30)}
    texts = [common, "".join(c * n for c, n in rare.items()), common]
    model = kn_quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {chr(c): n for c, n in zip(model.others.tolist(), model.counts.tolist()) if chr(c) in rare} == {c: n for c, n in rare.items() if ord(c) not in model.symbols}
    assert len(model.symbols) + len(model.others) == kn_quality.SYMBOLS - 2 + 30
    own = model.own().astype(np.float64)
    assert np.exp(-np.delete(own, model.symbols)).sum() == pytest.approx(1, rel=1e-4) and not own[model.symbols].any()
    lut = model.table()
    cost = [kn_quality.scored(c, model, lut, model.own())[0] for c in (chr(0x400), chr(0x41C), "\u4e2d")]
    assert cost[0] > cost[1] + 1 and cost[2] > cost[0] + 5  # rare, frequent, never seen


def grammar(*insults):
    return toxicity.Grammar(dict.fromkeys(insults, 0.5))


def test_clauses():
    g = grammar("idiot", "lowei*")
    assert g.emissions("You idiot. Fine.") == {"insult": 0.5, "aimed": 0.5}
    assert g.emissions("not an idiot") == {"denied": 0.5}
    assert g.emissions("She said that the man was an idiot; idiot!") == {"reported": 0.5, "insult": 0.5}
    assert g.emissions("loweiheit und idioten") == {"insult": 0.5}
    assert g.emissions("I will kill you. kill them; them kill") == {"threat": 2.0, "aimed": 1.0}
    assert g.emissions("videoidiot") == {}
    assert g.emissions("") == {} and 0 <= g.score("") < 0.5
    both = toxicity.Grammar({"idiot": 0.9, "idi*": 0.4})
    assert both.emissions("idiot idiom") == {"insult": 1.3}
    # A clause's beginning counts however far back it lies.
    for fillers in (10, 60, 2000):
        assert g.emissions("She said " + "so " * fillers + "an idiot") == {"reported": 0.5}


def spelled_out(lexicon, text):
    """What the grammar's docstring says, clause by clause and word by word, with no automaton or search for entries."""
    found = Counter()
    for clause in re.split(r"[.!?;:\n\r]", text.lower()):
        words = toxicity.WORD.findall(clause)
        for i, w in enumerate(words):
            own = max([x for e, x in lexicon.items() if (w.startswith(e[:-1]) and len(w) > len(e[:-1]) if e.endswith("*") else w == e)] or [0])
            if not own and w not in toxicity.THREAT:
                continue
            plain = lambda x: not any(x == e or (e.endswith("*") and x.startswith(e[:-1]) and len(x) >= len(e)) for e in lexicon) and x not in toxicity.THREAT
            near = words[max(0, i - toxicity.REACH) : i]
            target = any(x in toxicity.TARGET and plain(x) for x in near)
            denied = any(x in toxicity.NEGATION and x not in toxicity.TARGET and plain(x) for x in near)
            told = any(x in toxicity.REPORTED and x not in toxicity.TARGET | toxicity.NEGATION and plain(x) for x in words[:i])
            weight = own or (1.0 if target else toxicity.ALONE)
            found["denied" if denied else "reported" if told else "insult" if own else "threat"] += weight
            if target and not denied:
                found["aimed"] += weight
    return {k: pytest.approx(v) for k, v in found.items()}


def test_composed_machine_against_the_grammar_spelled_out():
    r = random.Random(4)
    lexicon = {"dolt": 0.7, "gru*": 0.4, "oaf": 0.9, "oafi*": 0.2}
    words = ["dolt", "grumx", "gru", "oaf", "oafish", "kill", "you", "they", "not", "never", "said", "quoted", "the", "man", "is", "xoaf", "il", "ne"]
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", ", ", ". ", "; ", "\n", "! "]) for _ in range(r.randint(0, 40)))
        assert dict(toxicity.Grammar(lexicon).emissions(text)) == spelled_out(lexicon, text)


def test_toxicity(spark, docs, edge, none):
    texts, marks = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        bad = ["dolts", "oafs", f"grum{chr(97 + i % 20)}x"][i // 6 % 3]
        t = words(i, 30)
        texts.append((i, t + (f" you {bad} " if toxic else " you fine ") + words(i + 9000, 10)))
        marks.append((i, 1, int(toxic)))
    every, labels = rows_of(spark, texts), spark.createDataFrame(marks + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    g = toxicity.train(every, labels)
    assert {"dolts", "oafs", "grum*"} <= set(g.lexicon) and all(0.9 < w <= 1 for w in g.lexicon.values())
    out = toxicity.score_documents(every, g).collect()
    assert all(r["predicted"] == (r["doc_id"] % 6 == 0) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    rest = toxicity.score_documents(docs, g).collect()
    assert len(rest) == len(edge) and not any(r["predicted"] for r in rest)
    assert not any(r["held_out"] for r in rest if r["doc_id"] is None)
    twice = toxicity.train(every.unionByName(every), labels)
    assert twice.lexicon == g.lexicon and np.array_equal(twice.weights, g.weights)
    empty = toxicity.train(docs, labels.limit(0))
    assert empty.lexicon == {} and toxicity.score_documents(none, empty).count() == 0


def test_held_out_labels_are_not_read(spark):
    """Turning the held-out labels round changes nothing."""
    texts = [(i, words(i, 20) + (" dolt" if i % 4 == 0 else "")) for i in range(400)]
    docs = rows_of(spark, texts)
    rows = [(i, int(i % 4 == 0)) for i in range(400)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in rows]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (rows, turned))
    assert a.lexicon == b.lexicon and np.array_equal(a.weights, b.weights)
