"""Alignment of two tokenizers' tokens by a sweep over the events of both.

An event is the end of a token at a byte offset of the text. A task that has read a text emits the events of both
tokenizers, united, as rows of some EVENTS events each: the row of the text, the offset at which the first token begins,
the side, and the tokens' ids (a token's length is its entry's, so ends are the running sum). The rows are repartitioned
by text and sorted within partitions by offset and side; a machine then streams through them. It holds the tokens behind
the last common end and nothing else: where ends of both sides meet, the tokens up to there are a group, and all pairs of
one of its A tokens with one of its B tokens are links.

What the sweep finds is written in chunks of about CHUNK tokens: the distinct groups, and the places where they stand.
Chunks then ask how many documents hold each distinct pair that they have linked, through nodes that add up (see
_exchange.py); a pair's key begins with a scramble of its A id, so that one node sees all pairs of an A id and knows the
highest count among them. A pair that a third of all documents hold is one entry a chunk. Ids are the keys: nothing is
told apart by a hash of it (groups are gathered by a hash and compared token by token).

Defined results: a null or empty text, and one whose tokens' bytes joined are not a space and the text, has no tokens:
zeros and no groups; null and repeated doc_ids and repeated rows pass through, each row a document of its own, a row in
and a row out; an empty table gives no rows. One document's groups lie in one chunk, so a document is bounded by a
task's memory (some 100 bytes a byte of text); so are the distinct pairs of a group without a common end inside.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import groups_for, shuffles_cleared, staged, total_bytes
from ._exchange import REQUEST_DDL, Distinct, Exchange, Keys, Route, mixed, packed, table_of, told, unpacked
from ._vocabulary import Encoder, encoder

EVENTS = 1 << 16
#: Bytes of text that a partition of the sweep gets.
PARTITION_BYTES = 24 << 20
#: Tokens of a chunk, and of what the machine looks at together.
CHUNK = 3 << 20
WINDOW = 1 << 19
#: A group of more links is taken by its distinct ids.
MANY = 1 << 12
FAN_BITS = 8
SIDES = (0, 1)
EVENT = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("ids", pa.binary())])
EVENT_DDL = "rid long, doc_id long, at long, side int, ids binary"
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("n_distinct", pa.int64()), ("places", pa.binary()), ("sizes", pa.list_(pa.binary())), ("ids", pa.list_(pa.binary()))])
CHUNK_DDL = "chunk long, doc_id array<long>, n_groups array<long>, n_distinct long, places binary, sizes array<binary>, ids array<binary>"
OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])
OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


@dataclass(frozen=True)
class Sizes:
    """events: of a row; window: tokens that the machine looks at together; chunk: tokens of a chunk."""

    events: int = EVENTS
    window: int = WINDOW
    chunk: int = CHUNK
    fan_bits: int = FAN_BITS


def events(docs: DataFrame, file_a: str, file_b: str, id_col: str, text_col: str, sizes: Sizes) -> DataFrame:
    """The events of both sides; a text without tokens has one row without ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(file_a), encoder(file_b)
        rows: list[tuple] = []
        held = 0
        for b in batches:
            texts = b.column(2)
            for i, (rid, doc_id) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                text = texts[i].as_py()
                ids = [e(text) for e in both] if text else [None]
                if any(x is None for x in ids):
                    rows.append((rid, doc_id, 0, 0, b""))
                    continue
                for side, x in zip(SIDES, ids):
                    for at, part in cut(x, both[side], sizes.events):
                        rows.append((rid, doc_id, at, side, part.tobytes()))
                    held += x.nbytes
                if held > 4 << 20 or len(rows) > 10000:
                    yield table_of(rows, EVENT).to_batches()[0]
                    rows, held = [], 0
        if rows:
            yield table_of(rows, EVENT).to_batches()[0]

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, EVENT_DDL)


def cut(ids: np.ndarray, of: Encoder, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(the offset where it begins, n ids)."""
    at = 0
    for k in range(0, len(ids), n):
        part = ids[k : k + n]
        yield at, part
        at += int(of.lengths[part].sum())


@dataclass
class Groups:
    """Groups in order: by side, how many tokens each has, and all their ids; the document of each."""

    doc: np.ndarray
    sizes: list[np.ndarray]
    ids: list[np.ndarray]

    @staticmethod
    def joined(parts: list[Groups]) -> Groups:
        return Groups(np.concatenate([p.doc for p in parts]), *([np.concatenate([getattr(p, f)[s] for p in parts]) for s in SIDES] for f in ("sizes", "ids")))

    def split(self, n: int) -> tuple[Groups, Groups]:
        """The first n groups, and the others, which don't keep the first ones' memory."""
        at = [int(s[:n].sum()) for s in self.sizes]
        return Groups(self.doc[:n], [s[:n] for s in self.sizes], [x[:k] for x, k in zip(self.ids, at)]), Groups(self.doc[n:].copy(), [s[n:].copy() for s in self.sizes], [x[k:].copy() for x, k in zip(self.ids, at)])


@dataclass
class Sweep:
    """The machine. ids: by side, of the tokens behind the last common end; docs: those since the last chunk."""

    lengths: tuple[np.ndarray, np.ndarray]
    rid: int | None = None
    docs: list = field(default_factory=list)
    ids: list = field(default_factory=lambda: [[], []])
    whose: list = field(default_factory=lambda: [[], []])
    waiting: int = 0
    found: list[Groups] = field(default_factory=list)
    tokens: int = 0

    def take(self, rid: int, doc_id: int | None, side: int, ids: np.ndarray) -> None:
        if rid != self.rid:
            self.rid = rid
            self.docs.append(doc_id)
        if len(ids):
            self.ids[side].append(ids)
            self.whose[side].append(np.full(len(ids), len(self.docs) - 1, dtype=np.int32))
            self.waiting += len(ids)

    def advance(self) -> None:
        """Moves up to the last common end. All tokens of a text cover the same bytes on both sides, so running sums over
        several texts meet at each text's end and no group passes it."""
        self.waiting = 0
        ids = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in self.ids]
        whose = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in self.whose]
        ends = [np.cumsum(self.lengths[s][ids[s]]) for s in SIDES]
        at = np.searchsorted(ends[1], ends[0])
        hit = at < len(ends[1])
        hit[hit] = ends[1][at[hit]] == ends[0][hit]
        last = [np.flatnonzero(hit), at[hit]]
        n = [int(x[-1]) + 1 if len(x) else 0 for x in last]
        if n[0]:
            self.found.append(Groups(whose[0][last[0]], [np.diff(x, prepend=-1).astype(np.int32) for x in last], [i[:k] for i, k in zip(ids, n)]))
            self.tokens += sum(n)
        self.ids, self.whose = [[i[k:].copy()] for i, k in zip(ids, n)], [[w[k:].copy()] for w, k in zip(whose, n)]

    def chunk(self, number: int, all_of_it: bool) -> pa.RecordBatch | None:
        """The texts so far, but for the last, which may go on."""
        self.advance()
        n_docs = len(self.docs) - (not all_of_it)
        if n_docs <= 0:
            return None
        empty = Groups(np.zeros(0, dtype=np.int64), [np.zeros(0, dtype=np.int64)] * 2, [np.zeros(0, dtype=np.int64)] * 2)
        every = Groups.joined(self.found or [empty])
        self.found = []
        done, rest = every.split(int(np.searchsorted(every.doc, n_docs)))
        rest.doc = rest.doc - n_docs
        which, first = gathered(done)
        starts = [np.cumsum(s) - s for s in done.sizes]
        kept = [flat(done.ids[s], starts[s][first], done.sizes[s][first]) for s in SIDES]
        row = (number, self.docs[:n_docs], np.bincount(done.doc, minlength=n_docs).tolist(), len(first), packed(which), [packed(done.sizes[s][first].astype(np.int64)) for s in SIDES], [packed(x.astype(np.int64)) for x in kept])
        self.docs, self.found, self.tokens = self.docs[n_docs:], [rest], sum(map(len, rest.ids))
        self.whose = [[w - n_docs for w in x] for x in self.whose]
        return table_of([row], CHUNK_SCHEMA).to_batches()[0]


def flat(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each, one after the other."""
    total = int(sizes.sum())
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]


def gathered(g: Groups) -> tuple[np.ndarray, np.ndarray]:
    """(the index of each group among the distinct ones, where each of these stands first)."""
    if not len(g.doc):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = [np.cumsum(s) - s for s in g.sizes]
    for salt in range(1, 100):
        key = np.zeros(len(g.doc), dtype=np.uint64)
        for s in SIDES:
            inside = np.arange(len(g.ids[s])) - np.repeat(starts[s], g.sizes[s])
            each = mixed(g.ids[s].astype(np.uint64) << np.uint64(32) | inside.astype(np.uint64) << np.uint64(1) | np.uint64(s)) * np.uint64(2 * salt + 1)
            key += mixed(np.add.reduceat(each, starts[s]) + np.uint64(salt + s))
        all_of = Distinct(key)
        first = all_of.order[all_of.starts]
        like = first[all_of.which]
        same = all(np.array_equal(g.sizes[s], g.sizes[s][like]) and np.array_equal(g.ids[s], flat(g.ids[s], starts[s][like], g.sizes[s])) for s in SIDES)
        if same:
            return all_of.which, first
    raise ValueError("no hash tells the groups apart")


def swept(rows: DataFrame, file_a: str, file_b: str, sizes: Sizes) -> DataFrame:
    """Chunks, from the events in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(file_a), encoder(file_b)
        machine = Sweep((both[0].lengths, both[1].lengths))
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            parts = b.column("ids")
            for i, (rid, doc_id, side) in enumerate(zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "side")))):
                machine.take(rid, doc_id, side, np.frombuffer(parts[i].as_py(), dtype=both[side].dtype))
                if machine.waiting >= sizes.window:
                    machine.advance()
                    if machine.tokens >= sizes.chunk and (row := machine.chunk(number, False)) is not None:
                        yield row
                        number += 1
        if (row := machine.chunk(number, True)) is not None:
            yield row

    return rows.select("rid", "doc_id", "side", "ids").mapInArrow(run, CHUNK_DDL)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit values."""
    mask = np.uint64(0xFFFFFFFF)
    x = x.astype(np.uint64)
    for m in (0x7FEB352D, 0x846CA68B):
        x = (x ^ (x >> np.uint64(16))) * np.uint64(m) & mask
    return x ^ (x >> np.uint64(16))


class Chunk:
    """A chunk's distinct groups and their places; the links of the distinct groups, as pairs with how often."""

    def __init__(self, row: dict, route: Route):
        self.doc_id, self.number = row["doc_id"], row["chunk"]
        self.place = xxhash.xxh64_intdigest(self.number.to_bytes(8, "little")) >> (64 - route.bits * route.levels)
        self.n_groups = np.array(row["n_groups"], dtype=np.int64)
        self.groups = row["n_distinct"]
        self.which = unpacked(row["places"], int(self.n_groups.sum()))
        self.sizes = [unpacked(x, self.groups) for x in row["sizes"]]
        self.ids = [unpacked(x, int(n.sum())) for x, n in zip(row["ids"], self.sizes)]
        self.starts = [np.cumsum(n) - n for n in self.sizes]
        self.links = self.sizes[0] * self.sizes[1]
        self._pairs()

    def _pairs(self) -> None:
        big = self.links > MANY
        few = np.flatnonzero(~big)
        n, width = self.links[few], self.sizes[1][few]
        of = np.repeat(np.arange(len(few)), n)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        parts = [(few[of], self.ids[0][self.starts[0][few][of] + inside // width[of]], self.ids[1][self.starts[1][few][of] + inside % width[of]], np.ones(len(of), dtype=np.int64))]
        for g in np.flatnonzero(big).tolist():
            (a, na), (b, nb) = (np.unique(self.ids[s][self.starts[s][g] : self.starts[s][g] + self.sizes[s][g]], return_counts=True) for s in SIDES)
            parts.append((np.full(len(a) * len(b), g), np.repeat(a, len(b)), np.tile(b, len(a)), np.outer(na, nb).reshape(-1)))
        of, a, b, self.times = (np.concatenate(x) for x in zip(*parts))
        if len(parts) > 1:
            order = np.argsort(of, kind="stable")
            of, a, b, self.times = of[order], a[order], b[order], self.times[order]
        self.per_group = np.bincount(of, minlength=self.groups)
        self.pairs = Distinct(scrambled(a) << np.uint64(32) | b.astype(np.uint64))

    def documents(self) -> np.ndarray:
        """By distinct pair, the chunk's documents that hold it linked."""
        doc = np.repeat(np.arange(len(self.doc_id)), self.n_groups)
        held = np.unique(doc * max(1, self.groups) + self.which)
        doc, group = np.divmod(held, max(1, self.groups))
        first = np.cumsum(self.per_group) - self.per_group
        n, size = self.per_group[group], len(self.pairs.keys)
        held = np.unique(np.repeat(doc, n) * max(1, size) + flat(self.pairs.which, first[group], n))
        return np.bincount(held % max(1, size), minlength=size)

    def by_document(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's groups of values by distinct group."""
        sums = np.concatenate([[0], np.cumsum(values[self.which], dtype=np.int64)])
        ends = np.cumsum(self.n_groups)
        return sums[ends] - sums[ends - self.n_groups]

    def by_group(self, values: np.ndarray) -> np.ndarray:
        """Sums over each distinct group's links of values by distinct pair."""
        sums = np.concatenate([[0], np.cumsum(values[self.pairs.which] * self.times, dtype=np.int64)])
        ends = np.cumsum(self.per_group)
        return sums[ends] - sums[ends - self.per_group]

    def spelled(self, sizes: tuple[int, int]) -> pa.Array:
        """Each document's groups as text: a1,a2|b1;a3|b2,b3. sizes: of the vocabularies."""
        if not len(self.which):
            return pa.array([""] * len(self.doc_id))
        tokens = written(sizes)
        order = [np.arange(len(self.ids[0])) + np.repeat(self.starts[1], self.sizes[0]), np.arange(len(self.ids[1])) + np.repeat(self.starts[0] + self.sizes[0], self.sizes[1])]
        index = np.empty(sum(map(len, order)), dtype=np.int64)
        for s, base in zip(SIDES, (0, 2 * sizes[0])):
            ends = np.zeros(len(self.ids[s]), dtype=np.int64)
            ends[np.cumsum(self.sizes[s]) - 1] = sizes[s]
            index[order[s]] = self.ids[s] + base + ends
        groups = rejoined(tokens.take(pa.array(index)), np.append(self.starts[0] + self.starts[1], len(index)))
        return pc.utf8_rtrim(rejoined(groups.take(pa.array(self.which)), np.append(0, np.cumsum(self.n_groups))), ";")


@cache
def written(sizes: tuple[int, int]) -> pa.Array:
    """Each id with what may follow it: for A a comma or a bar, for B a comma or a semicolon."""
    return pa.array([f"{i}{mark}" for size, marks in zip(sizes, (",|", ",;")) for mark in marks for i in range(size)])


def rejoined(strings: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The strings from bound to bound put together."""
    at = np.frombuffer(strings.buffers()[1], dtype=np.int32)[bounds]
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(at)), strings.buffers()[2])


def asked(chunks: DataFrame, route: Route) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = Chunk(b.slice(i, 1).to_pylist()[0], route)
                yield from route.requests(c.pairs.keys, [c.documents()], c.place, c.number).to_batches()

    return chunks.mapInArrow(run, REQUEST_DDL)


def counted(keys: Keys, sums: list[np.ndarray]) -> tuple[np.ndarray, None]:
    """Twice the documents that hold a pair, and one more if no pair of its A id is held by more."""
    a = keys.first >> np.uint64(32)
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    most = np.maximum.reduceat(sums[0], new)
    return sums[0] * 2 + (sums[0] == np.repeat(most, np.diff(new, append=len(a)))), None


def align(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (as text): one row per row of docs. A's text has a
    space in front; B's model adds one."""
    n = groups_for(total_bytes(docs, text_col), PARTITION_BYTES)
    with shuffles_cleared(docs.sparkSession):
        in_order = events(docs, file_a, file_b, id_col, text_col, sizes).repartition(n, "rid").sortWithinPartitions("rid", "at", "side")
        chunks = staged(swept(in_order, file_a, file_b, sizes), "chunks")
    route = Route.through(max(1, chunks.count()), sizes.fan_bits)
    replies = Exchange(asked(chunks, route), route, 0, counted).replies

    def finish(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return table_of([], OUT)
        c = Chunk(rows.to_pylist()[0], route)
        of = told(known, 0, c.pairs.keys, route.bits)
        vocabularies = tuple(len(encoder(f).lengths) for f in (file_a, file_b))
        n_of = [c.by_document(x) for x in (*c.sizes, c.links, c.by_group(of & 1), c.by_group(of >> 1))]
        cols = [c.doc_id, n_of[0], n_of[1], c.n_groups, *n_of[2:], c.spelled(vocabularies)]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(cols, OUT)], schema=OUT)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("to")).applyInArrow(finish, OUT_DDL)
