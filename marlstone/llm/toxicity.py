"""Toxicity by a weighted finite-state pattern grammar.

Transducers over the words of a clause (text between . ! ? ; : and line ends), each a small table of weighted steps:

    insult      a word of the insult lexicon        -> emits an insult, with the entry's own learned weight
    threat      a word of threat                    -> emits a threat: weight 1 with a target in reach, else ALONE
    target      a word that points at a person      -> opens a window in which insults and threats count as aimed
    negation    a word that denies                  -> opens a window in which insults and threats count as denied
    reported    a word of saying or quoting         -> marks the rest of the clause as someone else's words

They run composed: one product automaton whose state is the tuple of their states, its steps built once and cached; the
weight of a composed step is the product of its parts' weights. A clause is scored by the weights that the composed
machine emits from its beginning to its end, never a word by itself; a document by the weighted sum of its clauses'
emissions, squashed to 0..1.

Learned from labelled rows that are not held out, at most SAMPLE ids of them, the first by a hash of the id (of rows that
share an id the one of the least text): the insult lexicon (whole words and word beginnings, chosen greedily; near copies
count about once, so that what merely accompanies insults adds nothing), each entry's weight (the smoothed share of toxic
documents among the sample's that hold it) and the weights of the emissions (logistic regression around fixed priors). An
entry must tell LEAST_DOCS toxic documents that no other tells (fewer where few are labelled) and pass a test that counts
how many entries were tried; both bound the lexicon by the sample. Scanning looks
for lexicon entries at word starts with one Aho-Corasick pass and runs the machine on the clauses that hold one.

Defined results: a null or empty text has the score of no emissions; without toxic labels the lexicon is empty and the
priors stand; null or conflicting labels count as toxic only where a row says 1; null ids are not held out; repeated
rows score alike; an empty table gives no rows.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from math import exp, lgamma, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import remainder, staged

MODULUS = 5
SAMPLE = 20000
LEAST_SHARE = 0.005
#: An entry's toxic documents: at least so many, or one of PART of the sample's toxic ones if that is less, but two.
LEAST_DOCS, PART = 5, 20
#: The share of the telling entries that chance may have brought, in expectation.
CHANCE = 0.15
ODDS = 3.0
PENALTY = 5
REACH = 4
#: Weight of a threat that points at nobody.
ALONE = 0.5
#: Words of the transducers besides the learned lexicon (en, de, fr, es).
TARGET = frozenset("you your yours u ur he she they them him her his their these those people du dich dir ihr euch sie ihn tu te toi vous ils elle elles usted ustedes ellos ellas tú él ella".split())
NEGATION = frozenset("not no never nor without isn't aren't wasn't don't doesn't didn't won't nicht kein keine keinen nie niemals pas jamais aucun sans ni nunca jamás sin".split())
REPORTED = frozenset("said says say wrote writes claimed claims quote quoted quotes reported reports allegedly called sagte sagt schrieb zitiert behauptet dit écrit cité affirme dijo dice escribió citó afirma".split())
THREAT = frozenset("kill murder hurt destroy shoot stab strangle töten umbringen erschießen tuer assassiner frapper matar golpear".split())
#: Priors of the weights: of nothing, of an insult's weight up to 1, of the logarithms of one more than the weights emitted as
#: insult, aimed, denied, reported and threat.
PRIORS = np.array([-3.0, 5.0, 1.0, 0.5, 0.5, 0.3, 4.0])
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
CLAUSE_ENDS = ".!?;:\n\r"
CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")


def window(opens: str):
    """A transducer that is open for REACH words after a word of the class opens."""
    return lambda left, kind: (REACH if kind == opens else max(0, left - 1))


def latch(sets: str):
    """A transducer that stays set until the clause ends."""
    return lambda on, kind: int(on or kind == sets)


MACHINES = (window("target"), window("negation"), latch("reported"))


#: Weights of the fixed classes that emit, by whether a target is in reach; an insult's is its lexicon entry's.
FIXED = {("threat", True): 1.0, ("threat", False): ALONE}


@cache
def step(state: tuple[int, ...], kind: str) -> tuple[tuple[int, ...], tuple[str, ...], float]:
    """The composed machine: (next state, emissions, their weight without the word's own) of a word of a class in a state."""
    after = tuple(m(s, kind) for m, s in zip(MACHINES, state))
    if kind not in ("insult", "threat"):
        return after, (), 0.0
    target, denied, told = state
    emitted = ["denied"] if denied else ["reported"] if told else [kind]
    if target and not denied:
        emitted.append("aimed")
    return after, tuple(emitted), FIXED.get((kind, bool(target)), 1.0)


class Grammar:
    """The lexicon (an entry, * at the end of a word beginning -> its weight) and the weights of the emissions."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray = PRIORS):
        self.lexicon, self.weights = lexicon, weights
        self.finder = ahocorasick.Automaton()
        for entry in {*(e.rstrip("*") for e in lexicon), *THREAT}:
            self.finder.add_word(entry, entry)
        self.finder.make_automaton()

    def kind(self, word: str) -> tuple[str, float]:
        """A word's class and its own weight: of the entries that match, the greatest."""
        held = max((self.lexicon.get(e, 0.0) for e in (word, *(word[:k] + "*" for k in range(3, len(word))))), default=0.0)
        if held:
            return "insult", held
        for name, words in (("threat", THREAT), ("target", TARGET), ("negation", NEGATION), ("reported", REPORTED)):
            if word in words:
                return name, 1.0
        return "other", 1.0

    def clause(self, low: str, first: int, last: int) -> dict[str, float]:
        """The weights that the machine emits over a clause of a lower-cased text, from its beginning to its end."""
        found: dict[str, float] = defaultdict(float)
        state: tuple[int, ...] = (0,) * len(MACHINES)
        for m in WORD.finditer(low, first, last):
            kind, own = self.kind(m[0])
            state, emitted, weight = step(state, kind)
            for e in emitted:
                found[e] += weight * own
        return found

    def emissions(self, text: str) -> dict[str, float]:
        """What the composed machine emits over the clauses of a text."""
        low = text.lower()
        found: dict[str, float] = defaultdict(float)
        done = 0
        for end, entry in self.finder.iter(low) if len(self.finder) else ():
            begin = end - len(entry) + 1
            if begin < done or (begin and (low[begin - 1].isalnum() or low[begin - 1] == "_")):
                continue
            first = max(done, *(low.rfind(c, done, begin) + 1 for c in CLAUSE_ENDS))
            last = m.start() if (m := CLAUSE_END.search(low, begin)) else len(low)
            for e, weight in self.clause(low, first, last).items():
                found[e] += weight
            done = last
        return found

    def features(self, text: str) -> np.ndarray:
        e = self.emissions(text)
        return np.array([1.0, min(1.0, e["insult"]), *(np.log1p(e[x]) for x in ("insult", "aimed", "denied", "reported", "threat"))])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-self.features(text) @ self.weights)))


def words_of(texts: DataFrame) -> DataFrame:
    """tox, sig, w: each document's distinct words. sig is the least hash of them, which near copies mostly share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tox, text in zip(*(c.to_pylist() for c in b.columns)):
                words = sorted({w for w in WORD.findall(text.lower()) if 3 <= len(w) <= 30 and not w.isdigit()})
                sig = min((xxhash.xxh64_intdigest(w) >> 1 for w in words), default=0)
                yield pa.RecordBatch.from_arrays([pa.array([tox] * len(words), type=pa.int32()), pa.array([sig] * len(words), type=pa.int64()), pa.array(words, type=pa.string())], names=["tox", "sig", "w"])

    return texts.select("tox", "text").mapInArrow(run, "tox int, sig long, w string")


def entries(w: Column) -> Column:
    """A word and its beginnings of 4 to 6 letters, marked by a *."""
    return F.concat(F.array(w), F.filter(F.array(*[F.when(F.length(w) > k, F.concat(F.left(w, F.lit(k)), F.lit("*"))) for k in (4, 5, 6)]), lambda x: x.isNotNull()))


def significant(rows: list, tried: dict[int, int], p: int, total: int) -> list:
    """The entries that chance doesn't explain, the most certain first: of all entries in as many documents or more, so
    many would be expected to stand in as many of the p toxic ones among total; that may be CHANCE of the entries kept."""
    more, above = {}, 0
    for m in sorted(tried, reverse=True):
        above += tried[m]
        more[m] = above

    def expected(r) -> float:
        pos, m, share = r["pos"], r["pos"] + r["neg"], p / total
        logs = [lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * log(share) + (m - k) * log1p(-share) for k in range(pos, m + 1)] if share < 1 else [0.0]
        return more[m] * min(1.0, sum(map(exp, logs)))

    order = sorted((expected(r), r["e"], r) for r in rows)
    last = max((k for k, (x, _, _) in enumerate(order, 1) if x <= CHANCE * k), default=0)
    return [r for _, _, r in order[:last]]


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and word beginnings that tell toxic documents from others, the most general of each family.

    Documents count by their signature, so a group of near copies speaks about once. An entry is worth the toxic
    documents whose words no earlier entry matches, less PENALTY for each other document that holds it. Its weight is the
    smoothed share of toxic documents among those that hold it.
    """
    sizes = {r["tox"]: r["n"] for r in sample.groupBy("tox").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    if not p:
        return {}
    words = staged(words_of(sample), "words")
    least = max(2, min(LEAST_DOCS, p // PART), int(p * LEAST_SHARE))
    held = words.select("tox", "sig", F.explode(entries(F.col("w"))).alias("e")).distinct()
    held = held.groupBy("e").agg(F.sum("tox").alias("pos"), F.sum(1 - F.col("tox")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    telling = staged(held.where((F.col("pos") >= least) & (odds >= ODDS)), "telling")  # at most the sample's words / LEAST_DOCS
    # How many entries were tried that stand in as many documents or more: what chance brings grows with them.
    tried = {r["m"]: r["n"] for r in held.groupBy((F.col("pos") + F.col("neg")).alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = significant(telling.collect(), tried, p, p + n)
    against, weight = {r["e"]: r["neg"] for r in rows}, {r["e"]: (r["pos"] + 0.5) / (r["pos"] + r["neg"] + 1) for r in rows}
    by_word = defaultdict(set)  # words of toxic documents of the sample that a telling entry matches
    toxic = words.where("tox = 1").select("sig", "w").distinct()
    found = sample.sparkSession.createDataFrame([(e,) for e in against], "e string")
    matched = toxic.select("w", F.explode(entries(F.col("w"))).alias("e")).distinct().join(F.broadcast(found), "e", "left_semi").select("w").distinct()
    for r in toxic.join(matched, "w").groupBy("w").agg(F.collect_set("sig").alias("sigs")).collect():
        by_word[r["w"]] = set(r["sigs"])
    of = defaultdict(set)
    for w in by_word:
        for e in (w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)):
            if e in against:
                of[e].add(w)
    lexicon: dict[str, float] = {}

    def value(e: str) -> int:
        return len(set().union(*(by_word[w] for w in of[e]))) - PENALTY * against[e] if of[e] else 0

    worth = {e: value(e) for e in of}
    while worth:
        best = max(worth, key=lambda e: (worth[e], not e.endswith("*"), len(e), e))
        now = value(best)
        if now < worth[best]:
            worth[best] = now
            if now < least:
                del worth[best]
            continue
        if now < least:
            break
        lexicon[best] = weight[best]
        gone = set(of.pop(best))
        del worth[best]
        for e in [e for e, ws in of.items() if ws & gone]:
            of[e] -= gone
            if not of[e]:
                del of[e]
                worth.pop(e, None)
    return lexicon


def fit(x: np.ndarray, y: np.ndarray, pull: float = 2.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to the priors."""
    w = PRIORS.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (p - y) + pull * (w - PRIORS))
        w -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """The grammar learned from the labelled rows of docs that are not held out, SAMPLE at most."""
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic is not null")
    marks = marks.where(remainder(F.col("label_id"), MODULUS) != 0).groupBy("label_id").agg(F.max("toxic").alias("tox"))
    marks = marks.orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(marks), F.col("key") == F.col("label_id"))
    sample = staged(found.groupBy("label_id").agg(F.max("tox").alias("tox"), F.min("text").alias("text")).select("tox", "text"), "labelled")
    lexicon = learn_lexicon(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for b in batches:
            rows = [grammar.features(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, type=pa.list_(pa.float64()))], names=["tox", "x"])

    rows = sample.select("tox", "text").mapInArrow(features, "tox int, x array<double>").collect()  # at most SAMPLE short rows
    if not rows or not lexicon:
        return Grammar(lexicon)
    return Grammar(lexicon, fit(np.array([r["x"] for r in rows]), np.array([r["tox"] for r in rows], dtype=float)))


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    lexicon, weights = grammar.lexicon, grammar.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon, weights)
        for b in batches:
            texts = b.column(2)
            scores = [g.score(texts[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, type=pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(F.col(id_col), MODULUS) == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
