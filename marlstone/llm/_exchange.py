"""Counting across a corpus by requests and replies over a butterfly of nodes.

Documents are dealt to chunks; a chunk is worked on as a whole and asks about its distinct keys only, in sorted order, so
a key that a third of all documents hold is one entry a chunk and no position travels. A node of level 1 stands for FAN
chunks and one of FAN parts of the key space. It adds up what its chunks hold of each key and asks the next level, where
a node stands for FAN times as many chunks and a part of the key space that is FAN times as narrow, until a node stands
for all chunks: it answers, and the replies return the way the requests came, in the order asked. A chunk, and a node,
sends at most FAN messages of about a FAN-th of a chunk's keys. So messages grow with the number of chunks (times the
levels, its logarithm to base FAN), and what any task holds is about the keys of one chunk, at every size.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import groups_for, staged, text_bytes, total_bytes

CHUNK_BYTES = 4 << 20
FAN_BITS = 9
#: Bits of a place. Those above tell spaces apart: keys of several kinds may share an exchange, in nodes of their own.
PLACE_BITS = 48
REQUEST = pa.schema([("node", pa.int64()), ("sender", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("held", pa.binary())])
REQUEST_DDL = "node long, sender long, n int, keys binary, held binary"
REPLY = pa.schema([("to", pa.int64()), ("by", pa.int64()), ("kind", pa.int32()), ("told", pa.binary()), ("totals", pa.list_(pa.int64()))])
REPLY_DDL = "to long, by long, kind int, told binary, totals array<long>"


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_chunk: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text as bytes, chunk; the number of chunks). Rows that repeat an id are dealt by their text too."""
    n = groups_for(total_bytes(docs, text_col), per_chunk)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("long").alias("chunk"))
    return rows, n


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def planes(x: np.ndarray) -> tuple[int, np.ndarray]:
    """(width, the bytes of width planes, low bytes first) of integers that are not negative."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return width, np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def packed(x: np.ndarray) -> bytes:
    """Integers of any size; those near 0 take little."""
    signed = bool(len(x)) and int(x.min()) < 0
    width, rows = planes((x << 1) ^ (x >> 63) if signed else x)
    return bytes([width | signed << 7]) + zlib.compress(rows.tobytes(), 1)


def unpacked(data: bytes, n: int) -> np.ndarray:
    width = data[0] & 127
    rows = np.frombuffer(zlib.decompress(memoryview(data)[1:]), dtype=np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = rows.T
    x = out.view("<i8").reshape(-1)
    return (x >> 1) ^ -(x & 1) if data[0] >> 7 else x


class Keys:
    """Distinct keys in order: 64 bits each, with as many further bits as second holds."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None = None):
        self.first, self.second = first, second

    def __len__(self) -> int:
        return len(self.first)

    def cut(self, part: slice) -> bytes:
        """The first key whole (as a step it would widen all others), then steps from key to key as byte planes, of which
        only the highest is worth deflating; then the second bits."""
        width, rows = planes(np.diff(self.first[part]))
        top = zlib.compress(rows[-1].tobytes(), 1) if width else b""
        out = self.first[part][:1].astype("<u8").tobytes() + bytes([width]) + len(top).to_bytes(4, "little") + top + rows[:-1].tobytes()
        if self.second is None:
            return out
        width, rows = planes(self.second[part])
        return out + bytes([width]) + rows.tobytes()

    @staticmethod
    def read(data: bytes, n: int, wide: bool) -> tuple[np.ndarray, np.ndarray | None]:
        if not n:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64) if wide else None
        width, top = data[8], int.from_bytes(data[9:13], "little")
        steps = np.zeros((n, 8), dtype=np.uint8)
        steps[0] = np.frombuffer(data, dtype=np.uint8, count=8)
        if width:
            steps[1:, width - 1] = np.frombuffer(zlib.decompress(memoryview(data)[13 : 13 + top]), dtype=np.uint8)
            steps[1:, : width - 1] = np.frombuffer(data, dtype=np.uint8, offset=13 + top, count=(width - 1) * (n - 1)).reshape(width - 1, n - 1).T
        first = np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)
        if not wide:
            return first, None
        at = 13 + top + max(0, width - 1) * (n - 1)
        steps[:] = 0
        steps[:, : data[at]] = np.frombuffer(data, dtype=np.uint8, offset=at + 1).reshape(data[at], n).T
        return first, steps.view("<u8").reshape(-1)

    def parts(self, bits: int) -> Iterator[tuple[int, slice]]:
        """The slices that share their highest bits, with those bits."""
        if len(self):
            high = self.first >> np.uint64(64 - bits)
            ends = [0, *(np.flatnonzero(high[1:] != high[:-1]) + 1).tolist(), len(high)]
            for a, b in zip(ends, ends[1:]):
                yield int(high[a]), slice(a, b)


class Distinct:
    """The distinct ones of entries, in order; which: the index of each entry's."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None = None):
        self.order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
        f = first[self.order]
        new = np.ones(len(f), dtype=bool)
        new[1:] = f[1:] != f[:-1]
        if second is not None:
            s = second[self.order]
            new[1:] |= s[1:] != s[:-1]
        self.starts = np.flatnonzero(new)
        self.keys = Keys(f[self.starts], None if second is None else s[self.starts])
        self.which = np.empty(len(f), dtype=np.int64)
        self.which[self.order] = np.cumsum(new) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By key, the exact sum of its entries' integers."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64)
        return np.add.reduceat(values[self.order].astype(np.int64), self.starts)


@dataclass(frozen=True)
class Route:
    """The way through the nodes: the chunks' number fixes the levels."""

    levels: int
    bits: int

    @staticmethod
    def through(chunks: int, bits: int | None = None) -> Route:
        """bits: log2 of the fan, fewer where a chunk has few keys a node."""
        bits = bits or FAN_BITS
        return Route(max(1, -(-(chunks - 1).bit_length() // bits)), bits)

    def nodes(self, keys: Keys, place: int, level: int) -> Iterator[tuple[int, slice]]:
        """The nodes of a level that a chunk, or a node of the level below, at place asks; and which keys."""
        low = self.bits * level
        for high, part in keys.parts(low):
            yield (place >> low << low) | high, part

    def below(self, node: int, level: int) -> int:
        """The place of a node of a level, as that of one of its chunks."""
        return node >> self.bits * level << self.bits * level

    def requests(self, keys: Keys, held: list[np.ndarray], place: int, sender: int, level: int = 1) -> pa.Table:
        rows = []
        for node, part in self.nodes(keys, place, level):
            values = [packed(h[part]) for h in held]
            rows.append((node, sender, part.stop - part.start, keys.cut(part), b"".join(len(v).to_bytes(4, "little") + v for v in values)))
        return table_of(rows, REQUEST)


class Node:
    """The requests of a node: its distinct keys, and what their senders hold of them."""

    def __init__(self, requests: pa.Table, wide: bool):
        self.node = requests.column("node")[0].as_py()
        self.senders, self.sizes = requests.column("sender").to_pylist(), requests.column("n").to_pylist()
        read = [Keys.read(data, n, wide) for data, n in zip(requests.column("keys").to_pylist(), self.sizes)]
        self.asked = Distinct(np.concatenate([r[0] for r in read]), np.concatenate([r[1] for r in read]) if wide else None)
        self.keys = self.asked.keys
        self.held = requests.column("held")

    def sums(self) -> list[np.ndarray]:
        """By key, the sums of each of the values that came with the requests."""
        parts = []
        for data, n in zip(self.held.to_pylist(), self.sizes):
            own, at = [], 0
            while at < len(data):
                size = int.from_bytes(data[at : at + 4], "little")
                own.append(unpacked(data[at + 4 : at + 4 + size], n))
                at += 4 + size
            parts.append(own)
        return [self.asked.sums(np.concatenate(p)) for p in zip(*parts)]

    def replies(self, kind: int, result: np.ndarray, totals: list[int] | None = None, one: bool = False) -> pa.Table:
        """Rows of kind and the node's space. one: an odd result goes to one sender only, to the others less one."""
        kind += self.node >> PLACE_BITS
        rows, at, each = [], 0, result.astype(np.int64)[self.asked.which]
        if one:
            others = np.ones(len(each), dtype=bool)
            others[self.asked.order[self.asked.starts]] = False
            each[others] &= ~1
        for sender, n in zip(self.senders, self.sizes):
            rows.append((sender, self.node, kind, packed(each[at : at + n]), totals))
            totals, at = None, at + n  # once a node
        return table_of(rows, REPLY)


def told(rows: pa.Table, kind: int, keys: Keys, bits: int) -> np.ndarray:
    """The replies of a kind to keys, in their order (bits: those that tell the asked nodes apart); 0 where none came."""
    out = np.zeros(len(keys), dtype=np.int64)
    mask = (1 << bits) - 1
    by_node = {n & mask: d for n, k, d in zip(*(rows.column(c).to_pylist() for c in ("by", "kind", "told"))) if k == kind}
    for high, part in keys.parts(bits):
        if high in by_node:
            out[part] = unpacked(by_node[high], part.stop - part.start)
    return out


#: The keys and, by key, the summed values to (the replies, totals of the node or None).
Answer = Callable[[Keys, list[np.ndarray]], tuple[np.ndarray, "list[int] | None"]]


class Exchange:
    """requests: of the chunks, to level 1; rows to negative nodes are others' business. replies: to the chunks, of a kind.
    wide: keys have second bits. one: of the senders of a key with an odd reply, one gets it, the others one less."""

    def __init__(self, requests: DataFrame, route: Route, kind: int, answer: Answer, wide: bool = False, one: bool = False):
        self.route, self.kind, self.answer, self.wide, self.one = route, kind, answer, wide, one
        # With more levels than one the plan of the requests would be repeated for each.
        self.levels = [staged(requests, "requests") if route.levels > 1 else requests]
        for level in range(1, route.levels):
            self.levels.append(self.levels[-1].groupBy("node").applyInArrow(self._forward(level), REQUEST_DDL))

    def _forward(self, level: int):
        route, wide = self.route, self.wide

        def run(requests: pa.Table) -> pa.Table:
            if requests.column("node")[0].as_py() < 0:
                return table_of([], REQUEST)
            node = Node(requests, wide)
            return route.requests(node.keys, node.sums(), route.below(node.node, level), node.node, level + 1)

        return run

    def _returned(self, top: DataFrame) -> DataFrame:
        """The replies of the highest level, brought down to the chunks."""
        wide, replies, one, kind = self.wide, top, self.one, self.kind

        def down(bits: int):
            def run(requests: pa.Table, known: pa.Table) -> pa.Table:
                if not requests.num_rows or requests.column("node")[0].as_py() < 0:
                    return table_of([], REPLY)
                node = Node(requests, wide)
                totals = [t for t in known.column("totals").to_pylist() if t]
                own = [sum(t) for t in zip(*totals)] or None
                return node.replies(kind, told(known, kind + (node.node >> PLACE_BITS), node.keys, bits), own, one=one)

            return run

        for level in range(self.route.levels - 1, 0, -1):
            replies = self.levels[level - 1].groupBy("node").cogroup(replies.groupBy("to")).applyInArrow(down(self.route.bits * (level + 1)), REPLY_DDL)
        return replies

    @cached_property
    def top(self) -> DataFrame:
        answer, wide, kind, one = self.answer, self.wide, self.kind, self.one

        def run(requests: pa.Table) -> pa.Table:
            if requests.column("node")[0].as_py() < 0:
                return table_of([], REPLY)
            node = Node(requests, wide)
            return node.replies(kind, *answer(node.keys, node.sums()), one=one)

        return self.levels[-1].groupBy("node").applyInArrow(run, REPLY_DDL)

    @cached_property
    def replies(self) -> DataFrame:
        return self._returned(self.top)


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, as far as asked."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + n // 4
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def prefixes(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2^64."""
    up, _ = POWERS[which].upto(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their entropy over all bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def rolling(prefix: np.ndarray, starts: np.ndarray, length, which: int = 0) -> np.ndarray:
    """Hashes of the runs [start, start + length) from their prefix sums."""
    _, down = POWERS[which].upto(len(prefix))
    return mixed((prefix[starts + length] - prefix[starts]) * down[starts])
