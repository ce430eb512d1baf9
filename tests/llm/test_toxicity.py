"""The lexicon's learner on few labels, against a plain count."""
import math
import random

from marlstone.llm import toxicity

from .conftest import rows_of, words


def test_few_labels(spark):
    """Ten toxic documents tell the words that chance doesn't explain; the many words that stand in two or three of them
    by chance stay out, and clean documents stay clean."""
    r = random.Random(6)
    insults = ["scumbag", "moronic"]
    texts = []
    for d in range(240):
        tox = d % 8 == 0
        own = [words(1000 + d, 30), *["you are " + (r.choice(insults) if tox else words(5000 + d, 1))] * 2, f"common{r.randint(0, 40)} common{r.randint(0, 40)}"]
        texts.append((d, ". ".join(own)))
    labels = spark.createDataFrame([(d, 1, int(d % 8 == 0)) for d, _ in texts if d < 120], "doc_id long, quality int, toxic int")
    docs = rows_of(spark, texts)
    grammar = toxicity.train(docs, labels)
    assert grammar.lexicon and all(any(i.startswith(e.rstrip("*")) for i in insults) for e in grammar.lexicon)
    out = {x["doc_id"]: x["predicted"] for x in toxicity.score_documents(docs, grammar).collect()}
    assert sum(out[d] for d, _ in texts if d % 8 == 0) >= 20 and not any(out[d] for d, _ in texts if d % 8)


def test_chance():
    """What is kept is what a plain sum of the binomial tail would keep."""
    rows = [{"e": f"w{pos}-{neg}", "pos": pos, "neg": neg} for pos in range(2, 9) for neg in range(3)]
    tried, p, total = {m: 4000 // m**2 for m in range(1, 12)}, 20, 150
    tail = lambda k, m: sum(math.comb(m, i) * (p / total) ** i * (1 - p / total) ** (m - i) for i in range(k, m + 1))
    expected = sorted((sum(n for m, n in tried.items() if m >= r["pos"] + r["neg"]) * tail(r["pos"], r["pos"] + r["neg"]), r["e"]) for r in rows)
    kept = max((k for k, (x, _) in enumerate(expected, 1) if x <= toxicity.CHANCE * k), default=0)
    assert {r["e"] for r in toxicity.significant(rows, tried, p, total)} == {e for _, e in expected[:kept]} and 0 < kept < len(rows)
    assert toxicity.significant(rows, tried, 150, 150) == []  # where all are toxic nothing tells
