"""Phrase collocations: phrases of two to MAX_WORDS words that hold together, ranked by language.

Documents are tokenised once, into chunks of words and places that are checkpointed by chunk. Two rounds of requests go
over the butterfly of nodes (_exchange.py):

- Candidates. Chunks ask about their words and pairs by 64-bit hashes; nodes say whether all chunks together hold LEAST.
  A hash can only count too much, so no phrase is lost; and a longer phrase is a candidate only if all its pairs are
  (a phrase is never more frequent than a part of it).
- Counts. Each chunk builds a minimal perfect hash over its candidates, looks up the phrase that ends at each word, lets
  the key stored in the slot decide whether it is that candidate, and counts slots into one array. Keys are exact within
  the chunk. The arrays are summed up a tree, by 96 bits of the candidates' hashes, and the totals come back down it.

A chunk then holds the totals of its candidates by slot. All parts of a phrase occur where it does, so a chunk that was
given the phrase reads both sides of its cuts by slot, and what it takes from shorter ones inside: phrases are scored and
dropped without another look at the text. A word that a third of all text is, is one slot a chunk.

Defined results: a null text is empty; a null lang is `und`; null and repeated doc_ids and repeated rows count as rows;
an empty table, or one without a phrase of LEAST occurrences, gives no rows; a document lies in one chunk, so the longest
is bounded by a task's memory (some 60 bytes a byte).
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import union_all
from ._common import checkpointed, groups_for, shared_dir, shuffles_cleared, staged, text_bytes, total_bytes
from ._exchange import PLACE_BITS, REQUEST, REQUEST_DDL, Distinct, Exchange, Keys, Route, mixed, packed, table_of, told, unpacked

LEAST = 30
MAX_WORDS = 4
TOP = 2000
#: A score is SCALE * a / (l + r).
SCALE = 2_000_000
#: A longer phrase with this share of a candidate's occurrences, or more, drops it.
SHARE = (80, 100)
CHUNK_BYTES = 6 << 20
FAN_BITS = 8
PARTITION_CHUNKS = 2
#: Kinds of replies: CANDIDATE + k about words and pairs, TOTAL about candidates.
CANDIDATE, TOTAL = 0, 10
#: Slots of a level for each key that is still without one.
GAMMA = 2
STEPS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Ends of pieces all become one mark, which no word holds.
MARK = b"."
ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", MARK * 10)
CHUNK = pa.schema([("chunk", pa.int64()), ("langs", pa.list_(pa.string())), ("n_of", pa.list_(pa.int64())), ("n", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("lang_of", pa.binary()), ("places", pa.binary()), ("first", pa.binary())])
CHUNK_DDL = "chunk long, langs array<string>, n_of array<long>, n long, n_words long, words binary, lang_of binary, places binary, first binary"
FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("dropped", pa.bool_()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "lang string, phrase string, dropped boolean, a long, l long, r long, score long"


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in lower case (A-Z), with MARK where a piece ends."""
    return text.lower().translate(ENDS).replace(MARK, b" . ").split()


def tokenised(docs: DataFrame, per_chunk: int) -> DataFrame:
    """Chunks of about per_chunk bytes: the distinct words of each language, each token's word, which tokens begin a piece."""

    def chunk_row(number: int, texts: list[tuple[str, bytes]]) -> pa.RecordBatch:
        fresh = count().__next__
        words: dict[str, dict[bytes, int]] = {}
        n_of: dict[str, int] = {}
        places, firsts = [], []
        for lang, text in texts:
            if lang not in words:
                words[lang] = defaultdict(fresh, {MARK: -1})
            own = words[lang]
            found = tokens(text)
            at = np.fromiter(map(own.__getitem__, found), dtype=np.int64, count=len(found))
            word = at >= 0
            begins = np.ones(len(at), dtype=bool)
            begins[1:] = ~word[:-1]
            places.append(at[word])
            firsts.append(begins[word])
            n_of[lang] = n_of.get(lang, 0) + len(places[-1])
        every = sorted((i, k, w) for k, own in enumerate(words.values()) for w, i in own.items() if i >= 0)
        which = np.concatenate(places)
        row = (number, list(words), [n_of[x] for x in words], len(which), len(every), b"\n".join([w for _, _, w in every]), packed(np.array([k for _, k, _ in every], dtype=np.int64)), packed(which), np.packbits(np.concatenate(firsts)).tobytes())
        return table_of([row], CHUNK).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        texts: list[tuple[str, bytes]] = []
        size = 0
        for b in batches:
            column = b.column(1)
            for i, lang in enumerate(b.column(0).to_pylist()):
                texts.append((lang, column[i].as_py()))
                size += len(texts[-1][1])
                if size >= per_chunk:
                    yield chunk_row(number, texts)
                    number, texts, size = number + 1, [], 0
        if texts:
            yield chunk_row(number, texts)

    return docs.mapInArrow(run, CHUNK_DDL)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: at each level the keys that are alone at their bit get the bit's rank
    as their slot, the others go on to the next. The keys stand in their slots, so that a stranger is told from a member."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        slots = np.zeros(len(keys), dtype=np.int64)
        rest, taken = np.arange(len(keys)), 0
        while len(rest):
            at = self.at(keys[rest], len(self.levels), GAMMA * len(rest))
            alone = np.bincount(at, minlength=GAMMA * len(rest)) == 1
            rank = np.cumsum(alone) - 1 + taken
            self.levels.append((alone, rank))
            placed = alone[at]
            slots[rest[placed]] = rank[at[placed]]
            taken += int(placed.sum())
            rest = rest[~placed]
        self.stored = np.zeros(len(keys), dtype=np.uint64)
        self.stored[slots] = keys

    @staticmethod
    def at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * int(STEPS[0]) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 of those that aren't stored."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self.at(keys[rest], level, len(alone))
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        found = out >= 0
        out[found] = np.where(self.stored[out[found]] == keys[found], out[found], -1)
        return out


class Chunk:
    """A chunk's words, and of the phrase that ends at each word what is known so far."""

    def __init__(self, rows: pa.Table, route: Route):
        row = rows.to_pylist()[0]
        self.number, self.langs, self.n = row["chunk"], row["langs"], row["n"]
        self.place = xxhash.xxh64_intdigest(self.number.to_bytes(8, "little")) >> (64 - route.bits * route.levels)
        self.words = row["words"].split(b"\n") if row["n_words"] else []
        self.lang_of = unpacked(row["lang_of"], row["n_words"])
        self.word = unpacked(row["places"], self.n)
        first = np.unpackbits(np.frombuffer(row["first"], dtype=np.uint8), count=self.n).astype(bool) if self.n else np.zeros(0, dtype=bool)
        starts = np.maximum.accumulate(np.where(first, np.arange(self.n), 0))
        self.inside = np.arange(self.n) - starts
        seeds = [xxhash.xxh64_intdigest(x) for x in self.langs]
        whole = b"".join(xxhash.xxh3_128_digest(w, seeds[k]) for w, k in zip(self.words, self.lang_of.tolist()))
        self.hashes = np.frombuffer(whole, dtype="<u8").reshape(-1, 2)

    def before(self, x: np.ndarray, by: int = 1) -> np.ndarray:
        """What x holds for the place so many before; for the first places, their own."""
        return np.concatenate([x[:by], x[:-by]])[: len(x)]

    def asked(self) -> list[tuple[Keys, np.ndarray]]:
        """Of words and of pairs: the distinct hashes, and how often each stands here."""
        words, of = np.unique(self.hashes[:, 0], return_inverse=True)
        counts = np.bincount(of, weights=np.bincount(self.word, minlength=len(self.words)), minlength=len(words)).astype(np.int64)
        pairs, n = np.unique(self.pair_hashes()[self.inside >= 1], return_counts=True)
        return [(Keys(words), counts), (Keys(pairs), n)]

    def pair_hashes(self) -> np.ndarray:
        """Of the pair that ends at each word."""
        h = self.hashes[:, 0][self.word]
        return mixed(self.before(h) * STEPS[0] + h)

    def candidates(self, known: pa.Table, route: Route) -> None:
        """Sets table, the hash of all candidates; slot[k], of the phrase of k words that ends at each place, -1 where it
        is none; at, by slot a place where the candidate ends; size, by slot its words; counts and keys by slot."""
        (words, _), (pairs, _) = self.asked()
        often = [PerfectHash(keys.first[told(known, CANDIDATE + k, keys, route.bits) > 0]) for k, keys in ((1, words), (2, pairs))]
        alone = (often[0].slots(self.hashes[:, 0]) >= 0)[self.word]
        pair = alone & self.before(alone) & (self.inside >= 1)
        near = np.flatnonzero(pair)
        pair[near] = often[1].slots(self.pair_hashes()[near]) >= 0
        base = max(1, len(self.words))
        codes: list[tuple[np.ndarray, np.ndarray] | None] = []  # of each length: places, exact keys there
        number = self.word  # of the phrase that ends at a place, among those of its length
        for k in range(1, MAX_WORDS + 1):
            if k > 1:
                again = pair & (self.inside >= k - 1)
                for back in range(1, k - 1):
                    again &= self.before(pair, back)
                code = self.before(number) * base + self.word
            else:
                again, code = alone, self.word
            places = np.flatnonzero(again)
            distinct, own = np.unique(code[places], return_inverse=True)
            number = np.full(self.n, 0, dtype=np.int64)
            number[places] = own
            codes.append((distinct.astype(np.uint64) << np.uint64(2) | np.uint64(k - 1), code.astype(np.uint64) << np.uint64(2) | np.uint64(k - 1)))
        self.table = PerfectHash(np.concatenate([d for d, _ in codes]))
        size = len(self.table.stored)
        self.at, self.size, self.counts = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.slot: list[np.ndarray] = [np.zeros(0)]
        self.keys = np.zeros((size, 2), dtype=np.uint64)
        for k in range(1, MAX_WORDS + 1):
            _, code = codes[k - 1]
            codes[k - 1] = None  # let go as they are used
            places = np.arange(self.n) if k == 1 else np.flatnonzero((self.slot[k - 1] >= 0) & (self.before(self.slot[k - 1]) >= 0) & (self.inside >= k - 1))
            slot = np.full(self.n, -1, dtype=np.int64)
            slot[places] = self.table.slots(code[places])
            held = np.flatnonzero(slot >= 0)
            self.counts += np.bincount(slot[held], minlength=size)
            self.at[slot[held]], self.size[slot[held]] = held, k
            self.slot.append(slot)
            own = np.flatnonzero(self.size == k)
            last = self.hashes[self.word[self.at[own]]]
            for half in (0, 1):
                self.keys[own, half] = last[:, half] if k == 1 else mixed(self.keys[self.slot[k - 1][self.at[own] - 1], half] * STEPS[half] + last[:, half])
        self.order = Distinct(self.keys[:, 0], self.keys[:, 1] >> np.uint64(32))

    def phrase(self, slot: int) -> tuple[str, str]:
        end, k = int(self.at[slot]), int(self.size[slot])
        words = self.word[end - k + 1 : end + 1]
        return self.langs[int(self.lang_of[words[0]])], b" ".join([self.words[w] for w in words]).decode("utf-8", "replace")


def in_space(k: int, place: int) -> int:
    return k << PLACE_BITS | place


def ask_candidates(rows: pa.Table, route: Route) -> pa.Table:
    c = Chunk(rows, route)
    asked = [route.requests(keys, [n], in_space(k, c.place), c.number) for k, (keys, n) in enumerate(c.asked(), 1)]
    return pa.concat_tables(asked)


def frequent(keys: Keys, sums: list[np.ndarray]) -> tuple[np.ndarray, None]:
    return sums[0] >= LEAST, None


def ask_totals(rows: pa.Table, known: pa.Table, route: Route) -> pa.Table:
    c = Chunk(rows, route)
    c.candidates(known, route)
    return route.requests(c.order.keys, [c.order.sums(c.counts)], c.place, c.number)


def totals(keys: Keys, sums: list[np.ndarray]) -> tuple[np.ndarray, None]:
    """Twice the total, and one more for the one chunk that is given the phrase; 0 if it is too rare."""
    return np.where(sums[0] >= LEAST, sums[0] * 2 + 1, 0), None


def scored(rows: pa.Table, known: pa.Table, route: Route) -> pa.Table:
    """The phrases that the chunk was given, and the shorter ones that they drop."""
    c = Chunk(rows, route)
    c.candidates(known, route)
    of = told(known, TOTAL, c.order.keys, route.bits)[c.order.which]
    total = of >> 1
    out = []
    for q in np.flatnonzero((of & 1 > 0) & (c.size >= 2)).tolist():
        end, k, a = int(c.at[q]), int(c.size[q]), int(total[q])
        part = lambda last, n: int(c.slot[n][end - last])  # noqa: E731  of n words, so many before the end
        cuts = [(int(total[part(k - n, n)]), int(total[part(0, k - n)])) for n in range(1, k)]
        l, r = min(cuts, key=lambda x: SCALE * a // (x[0] + x[1]))  # the first of equals
        out.append((*c.phrase(q), False, a, l, r, SCALE * a // (l + r)))
        for n in range(2, k):
            for p in {part(back, n) for back in range(k - n + 1)}:
                if SHARE[1] * a >= SHARE[0] * int(total[p]):
                    out.append((*c.phrase(p), True, None, None, None, None))
    return table_of(out, FOUND)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, per_chunk: int = CHUNK_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_bytes(F.col(text_col)).alias("text"))
    n = groups_for(total_bytes(docs, text_col), per_chunk)
    route = Route.through(n, fan_bits)
    answers: list[DataFrame] = []

    def known():
        return union_all(*answers).groupBy("to")

    def with_rows(run, schema: pa.Schema):
        return lambda rows, known: run(rows, known, route) if rows.num_rows else table_of([], schema)

    with shuffles_cleared(docs.sparkSession):
        shared_dir(docs.sparkSession)  # checkpoints go there
        chunks = checkpointed(tokenised(rows, per_chunk), groups_for(n, PARTITION_CHUNKS), "chunk")
        by_chunk = chunks.groupBy("chunk")
        answers.append(staged(Exchange(by_chunk.applyInArrow(lambda d: ask_candidates(d, route), REQUEST_DDL), route, CANDIDATE, frequent).replies, "candidates"))
        asked = by_chunk.cogroup(known()).applyInArrow(with_rows(ask_totals, REQUEST), REQUEST_DDL)
        answers.append(staged(Exchange(asked, route, TOTAL, totals, wide=True, one=True).replies, "totals"))
        found = staged(by_chunk.cogroup(known()).applyInArrow(with_rows(scored, FOUND), FOUND_DDL), "phrases")
    dropped = found.where("dropped").select("lang", "phrase").distinct()
    left = found.where("not dropped").drop("dropped").join(dropped, ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    sizes = chunks.select(F.inline(F.arrays_zip("langs", "n_of"))).groupBy(F.col("langs").alias("lang")).agg(F.sum("n_of").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
