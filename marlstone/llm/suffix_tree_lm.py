"""LM scoring by a probabilistic suffix tree over words.

States are contexts of up to DEPTH words. A context is a candidate state once training text holds it twice; it is
retained if it passes a divergence test: over its own training occurrences, each left out in turn, the smoothed
prediction from the state must beat the best of its shorter contexts' by GAIN nats in sum (the leave-one-out estimate of
count times divergence, so chance pairs of rare words don't pass). The next-symbol distribution of a state is
(c(s, x) + K * P_shorter(x)) / (c(s) + K); the root discounts counts absolutely and gives the discounted mass to the one
unknown word. A token's probability is that of the longest retained suffix of its history.

The tree is never gathered anywhere. Documents are tokenised once, into chunks of words and places, checkpointed by
chunk. Chunks ask for the counts of their distinct words and pairs, then of longer runs, a run only where all pairs in it
occur twice in the table (of others it is known that they occur once); then for the sums of the tests. Nodes add up what all chunks hold and answer in the order asked (_exchange.py). A word that makes up a tenth of
all text is one entry per chunk. Each round's answers are staged, so a lost executor costs no earlier round.
Words and runs are told apart by 64-bit hashes; counts are whole numbers of any size, and what an occurrence adds to a
test is rounded to 1 / STEPS nats, so neither depends on how documents fall into chunks.

Defined results: a null text is empty: one token, the end; a null doc_id belongs to training text; without training text
every word is unknown with probability 1; null and repeated doc_ids pass through, a row in and a row out; an empty table
gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, groups_for, remainder, shared_dir, shuffles_cleared, staged, text_bytes, total_bytes
from ._exchange import PLACE_BITS, REQUEST, REQUEST_DDL, Distinct, Exchange, Keys, Route, mixed, packed, table_of, told, unpacked

MODULUS, HELD_OUT = 7, 2
LEAST = 2
K = 1.0
GAIN = 1.0
STEPS = 1 << 8
#: Words of the longest context.
DEPTH = 3
#: Lengths of the runs that are asked about together, after words and pairs.
ROUNDS = ((3, 4),)
#: A chunk's bytes: more than elsewhere, since more of its keys are then one; no more than two of an executor's tasks can
#: hold beside a full heap.
CHUNK_BYTES = 6 << 20
#: log2 of the nodes that a chunk asks: as many as there are chunks, within these bounds. One level of nodes then stands for
#: all of up to 4,096 chunks (24 GB); each further level stages and moves every request once more.
FAN_BITS, MOST_FAN_BITS = 8, 12
PARTITION_CHUNKS = 2
#: Kinds of replies: COUNT + k about runs of k words, TEST + k about contexts of k words.
COUNT, TEST = 0, 20
CHUNK = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("size", pa.list_(pa.int64())), ("n_words", pa.int64()), ("words", pa.binary()), ("places", pa.binary())])
CHUNK_DDL = "chunk long, doc_id array<long>, held_out array<boolean>, size array<long>, n_words long, words binary, places binary"
END = xxhash.xxh64_intdigest(b" ", 42)  # no word holds a space
STEP = np.uint64(0x9E3779B97F4A7C15)
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def route_of(chunks: int) -> Route:
    return Route.through(chunks, min(max(FAN_BITS, (chunks - 1).bit_length()), MOST_FAN_BITS))


def tokenised(docs: DataFrame, per_chunk: int) -> DataFrame:
    """Chunks of about per_chunk bytes of text: ids, sizes in tokens, the distinct words' hashes and each token's word."""

    def chunk_row(number: int, ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
        digest = xxhash.xxh64_intdigest
        sizes, parts = [], []
        for t in texts:
            found = t.lower().split()
            sizes.append(len(found) + 1)
            parts.append(np.fromiter((*map(digest, found), END), dtype=np.uint64, count=len(found) + 1))
        words = Distinct(np.concatenate(parts))
        row = (number, ids, held, sizes, len(words.keys), words.keys.cut(slice(None)), packed(words.which))
        return table_of([row], CHUNK).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list = []
        texts: list[bytes] = []
        size = 0
        for b in batches:
            column = b.column(2)
            for i, (doc_id, out) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                text = column[i].as_py()
                ids.append(doc_id)
                held.append(out)
                texts.append(text)
                size += len(text)
                if size >= per_chunk:
                    yield chunk_row(number, ids, held, texts)
                    number, ids, held, texts, size = number + 1, [], [], [], 0
        if texts:
            yield chunk_row(number, ids, held, texts)

    return docs.mapInArrow(run, CHUNK_DDL)


@dataclass(frozen=True)
class Totals:
    """Of training text: tokens, distinct words, words that occur once and twice."""

    total: int
    distinct: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once else 0.5


class Chunk:
    """A chunk's tokens and, from the answers at hand, what is known of the runs that end at each.

    asked[k]: the distinct runs of k words that are asked about; at[k]: the places whose runs they are, and which run each
    is; told[k]: their answers. Kept by run, not by place: a chunk's memory is some ten numbers a token.
    """

    def __init__(self, docs: pa.Table, known: pa.Table | None, route: Route, answered: int, asking: int, totals: Totals | None = None):
        row = docs.to_pylist()[0]
        self.doc_id, self.totals = row["doc_id"], totals
        # A chunk stands at a place that its number's hash picks among as many as the route has room for.
        self.number = row["chunk"]
        self.place = xxhash.xxh64_intdigest(self.number.to_bytes(8, "little")) >> (64 - route.bits * route.levels)
        sizes = np.array(row["size"], dtype=np.int64)
        self.n = int(sizes.sum())
        ends = np.cumsum(sizes)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.held_out = np.array(row["held_out"], dtype=bool)
        self.train = ~self.held_out[self.doc]
        self.inside = (np.arange(self.n) - (ends - sizes)[self.doc]).astype(np.int32)
        hashes, _ = Keys.read(row["words"], row["n_words"], False)
        which = unpacked(row["places"], self.n).astype(np.int32)
        self.asked: list = [None, Keys(hashes)]
        self.at: list = [None, (slice(None), which)]
        self.told: list = [None]
        key = h = hashes[which]
        for k in range(1, asking + 1):
            if k > 1:
                key = mixed(self.before(key) * STEP + h)
                use = np.flatnonzero(self.may_repeat(k)).astype(np.int32)
                runs = Distinct(key[use])
                self.asked.append(runs.keys)
                self.at.append((use, runs.which.astype(np.int32)))
                del runs  # its orders, before the next run's are made
            if k <= answered:
                self.told.append(told(known, COUNT + k, self.asked[k], route.bits))

    def may_repeat(self, k: int) -> np.ndarray:
        """Whether the k words that end at a place may occur twice in the table: all of its pairs do."""
        use = self.inside >= k - 1
        if k > 2:
            again = np.zeros(self.n, dtype=bool)
            where, of = self.at[2]
            again[where] = (self.told[2] & 1)[of] > 0
            for _ in range(k - 1):
                use &= again
                again = self.before(again)
        return use

    def count(self, k: int) -> np.ndarray:
        """How often training text holds the k words that end at a place; 0 where the document has fewer."""
        # A run that was not asked about occurs once in the table: here.
        out = np.where(self.inside >= k - 1, self.train, False).astype(np.int64)
        where, of = self.at[k]
        out[where] = (self.told[k] >> 1)[of]
        return out

    def before(self, x: np.ndarray) -> np.ndarray:
        """What x holds for the place before."""
        return np.concatenate([x[:1], x[:-1]])

    def sums(self, k: int, values: np.ndarray) -> np.ndarray:
        """By run asked about at k, the sum of its places' values."""
        where, of = self.at[k]
        return np.bincount(of, weights=values[where], minlength=len(self.asked[k])).astype(np.int64)  # exact below 2^53

    def root(self) -> np.ndarray:
        t = self.totals
        if not t.total:
            return np.ones(self.n)
        count = self.count(1)
        return np.where(count > 0, (count - t.discount) / t.total, t.discount * t.distinct / t.total)

    def candidates(self, k: int) -> tuple[Keys, np.ndarray]:
        """The runs asked about at k that training text holds often enough for a state, and their indices among all."""
        which = np.flatnonzero(self.told[k] >> 1 >= LEAST)
        return Keys(self.asked[k].first[which]), which

    def contexts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, whether the k words before a place are a candidate state, its count, its count with the word at the place)."""
        shorter = self.count(1)
        for k in range(1, DEPTH + 1):
            size, shorter = np.where(self.inside >= k, self.before(shorter), 0), self.count(k + 1)
            yield k, size >= LEAST, size, shorter


def smoothed(c, s, shorter):
    return (c + K * shorter) / (s + K)


def in_space(k: int, place: int) -> int:
    """A chunk's place in the nodes that know runs, or contexts, of k words."""
    return k << PLACE_BITS | place


def ask(docs: pa.Table, known: pa.Table | None, route: Route, ks: tuple[int, ...]) -> pa.Table:
    """What the chunk holds of its runs of ks words: in training text, in all."""
    c = Chunk(docs, known, route, ks[0] - 1, ks[-1])
    out = []
    for k in ks:
        where, of = c.at[k]
        size = len(c.asked[k])
        held = [np.bincount(of, weights=c.train[where], minlength=size).astype(np.int64), np.bincount(of, minlength=size)]
        out.append(route.requests(c.asked[k], held, in_space(k, c.place), c.number))
    return pa.concat_tables(out)


def counted(keys: Keys, sums: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Twice the count in training text, and one more if the table holds the run twice."""
    train, every = sums
    return train * 2 + (every >= LEAST), [int(train.sum()), int((train > 0).sum()), int((train == 1).sum()), int((train == 2).sum())]


def ask_tests(docs: pa.Table, known: pa.Table, route: Route, totals: Totals) -> pa.Table:
    """Sums, over the chunk's training places, of what each candidate state gains over shorter contexts, left-one-out."""
    c = Chunk(docs, known, route, DEPTH + 1, DEPTH + 1, totals)
    best = c.root()
    out = []
    for k, state, size, count in c.contexts():
        use = np.flatnonzero(state & c.train)
        own = smoothed(np.maximum(count[use] - 1, 0), size[use] - 1, best[use])
        gain = np.zeros(c.n, dtype=np.int64)
        gain[use - 1] = np.rint(np.log(own / best[use]) * STEPS).astype(np.int64)  # to the place where the state ends
        keys, which = c.candidates(k)
        out.append(route.requests(keys, [c.sums(k, gain)[which]], in_space(k, c.place), c.number))
        best[use] = np.maximum(best[use], own)
    return pa.concat_tables(out)


def retained(keys: Keys, sums: list[np.ndarray]) -> tuple[np.ndarray, None]:
    return sums[0] >= GAIN * STEPS, None


def score(docs: pa.Table, known: pa.Table, route: Route, totals: Totals) -> pa.Table:
    c = Chunk(docs, known, route, DEPTH + 1, DEPTH + 1, totals)
    p = c.root()
    for k, state, size, count in c.contexts():
        keys, which = c.candidates(k)
        stays = np.zeros(len(c.asked[k]), dtype=bool)
        stays[which] = told(known, TEST + k, keys, route.bits) > 0
        where, of = c.at[k]
        kept = np.zeros(c.n, dtype=bool)
        kept[where] = stays[of]
        p = np.where(state & c.before(kept), smoothed(count, size, p), p)
    by_doc = lambda x: np.bincount(c.doc, weights=x, minlength=len(c.doc_id))
    n = by_doc(np.ones(c.n)).astype(np.int64)
    count = c.count(1)
    base = by_doc(np.log10((count + 1) / (totals.total + totals.distinct + 1)))
    return pa.table([pa.array(c.doc_id, type=pa.int64()), pa.array(c.held_out), pa.array(n), pa.array(by_doc(count > 0).astype(np.int64)), pa.array(np.full(len(n), totals.total)), pa.array(base), pa.array(by_doc(np.log10(p)))], schema=SCORES)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(F.col(id_col), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), text_bytes(F.col(text_col)).alias("text"))
    n = groups_for(total_bytes(docs, text_col), CHUNK_BYTES)
    route = route_of(n)
    answers: list[DataFrame] = []

    def known():
        return reduce(DataFrame.unionByName, answers).groupBy("to")

    def with_docs(run, schema: pa.Schema, *more):
        return lambda docs, known: run(docs, known, route, *more) if docs.num_rows else table_of([], schema)

    with shuffles_cleared(docs.sparkSession):
        shared_dir(docs.sparkSession)  # checkpoints go there
        by_chunk = checkpointed(tokenised(rows, CHUNK_BYTES), groups_for(n, PARTITION_CHUNKS), "chunk").groupBy("chunk")
        answers.append(staged(Exchange(by_chunk.applyInArrow(lambda d: ask(d, None, route, (1, 2)), REQUEST_DDL), route, COUNT, counted).replies, "counts"))
        at = [F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(4)]
        totals = Totals(*answers[0].where(F.col("kind") == COUNT + 1).agg(*at).first())
        for ks in ROUNDS:
            asked = by_chunk.cogroup(known()).applyInArrow(with_docs(ask, REQUEST, ks), REQUEST_DDL)
            answers.append(staged(Exchange(asked, route, COUNT, counted).replies, "counts"))
        asked = by_chunk.cogroup(known()).applyInArrow(with_docs(ask_tests, REQUEST, totals), REQUEST_DDL)
        answers.append(staged(Exchange(asked, route, TEST, retained).replies, "tests"))
    return by_chunk.cogroup(known()).applyInArrow(with_docs(score, SCORES, totals), SCORES_DDL)
