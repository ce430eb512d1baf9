"""Substring dedup on bytes with a run-length index.

Index (class RunLengthIndex): the texts of a bucket, end to end with a terminator of its own each, are sorted by suffix;
of the Burrows-Wheeler transform only the runs are kept: each one's symbol and first row, the text places of its first
and last suffix (the sampled run ends), and how long the suffixes on either side of its first row agree. The sort's
arrays are dropped, so what the index holds follows the runs. Matching statistics stream from the samples along the
text: at a place whose row is no run end the match is the previous place's, less one. They give, for every place, the
longest string that starts there and also starts elsewhere; places of LENGTH bytes or more are marked.

Routing: a string of LENGTH bytes has a content-defined anchor (the smallest hash of its inner GRAM-byte strings), and
equal strings have equal anchors. All string starts in a row that share an anchor place make a region. Chunks first ask
which of their anchors occur elsewhere and how many distinct regions each has (_exchange.py), then send the regions of
those to the bucket of the anchor, where the index is built; of equal regions (by anchor, 64-bit hash and length) one
chunk sends the text, so copies cost some bytes however many there are. Buckets are told by a second hash of the anchor,
since anchors, as minima, are small numbers. A family of over HOT distinct regions would be no bounded group; its
strings are compared by 128-bit hashes instead, counted through the exchange: the exact way for what no single index
should hold. Most text never moves but once, to its chunk.

Defined results: a null text is empty; a text under LENGTH bytes loses nothing; matches never cross documents; repeated
rows (and copies) count as different places; null and repeated doc_ids pass through, a row in and a row out; an empty
table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._exchange import REPLY, REPLY_DDL, REQUEST, REQUEST_DDL, Distinct, Exchange, Keys, Route, chunked, mixed, prefixes, rolling, table_of, told
from .passages import covered, runs_of

LENGTH = 400
GRAM = 32
SPAN = LENGTH - GRAM + 1
HOT = 2048
#: Bytes of the texts that one index holds, about; a family of one anchor is never split over two.
INDEX_BYTES = 1 << 18
#: A chunk's work takes some 60 bytes for each of its own.
CHUNK_BYTES = 2 << 20
#: Chunks to a bucket of regions; up to half of all text may lie in regions.
BUCKET_CHUNKS = 2
ANCHORS, STRINGS, REGIONS = 0, 1, 2
#: A region in a request: its anchor, hash and length, and whether the chunk has it twice.
REGION = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("size", "<u4"), ("many", "u1")])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept", pa.binary())])
RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<int>>, kept binary"


def suffix_order(text: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    """The places of text (0: a terminator) by their suffixes, by prefix doubling; every terminator is a symbol of its own."""
    n = len(text)
    place = np.arange(n, dtype=np.int32)
    # Seven symbols of nine bits; symbols after a terminator count as none.
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([text, np.zeros(8, dtype=np.int16)])
    for k in range(7):
        key = (key << 9) | np.where(place + k < end_of, padded[k : k + n], 0)
    order = np.argsort(key, kind="stable").astype(np.int32)
    # A suffix that meets its terminator within the symbols read is unlike any other.
    key = key[order]
    short = order + 7 > end_of[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | short[1:] | short[:-1]
    del key
    group = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = group
    length = 7
    while True:
        edge = group[1:] != group[:-1]
        open_ = np.flatnonzero(~(np.append(True, edge) & np.append(edge, True))) if n else place[:0]
        if not len(open_):
            return order
        at = order[open_]
        after = at + length
        key = (group[open_].astype(np.int64) << 32) + np.where(after <= end_of[at], rank[np.minimum(after, n - 1)], -1)
        by = np.argsort(key)
        order[open_] = at[by]
        key = key[by]
        fresh = np.ones(len(open_), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        group[open_] = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[order[open_]] = group[open_]
        length *= 2


def common_prefixes(data: bytes, limit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of data agree from a and from b on, at most limit: compared eight at a time."""
    words = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=data + bytes(16), strides=(1,))
    out = limit.copy()
    active = np.flatnonzero(limit > 0)
    done = 0
    while len(active):
        differ = words[a[active] + done] ^ words[b[active] + done]
        unlike = differ != 0
        stop = active[unlike]
        low = differ[unlike] & (~differ[unlike] + np.uint64(1))
        out[stop] = np.minimum(out[stop], done + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
        done += 8
        active = active[~unlike]
        active = active[limit[active] > done]
    return out


class RunLengthIndex:
    """The run-length index of texts: symbols and heads of the transform's runs, and their sampled ends."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        self.n = int(self.ends[-1]) + 1
        data = b"\x00".join(texts) + b"\x00"
        text = np.frombuffer(data, dtype=np.uint8).astype(np.int16) + 1
        text[self.ends] = 0
        order = suffix_order(text, np.repeat(self.ends, sizes + 1).astype(np.int32))
        before = text[order - 1].astype(np.int32)
        stops = np.flatnonzero(before == 0)
        before[stops] = -1 - stops  # the terminators differ, so each is a run of its own
        self.heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.symbols = before[self.heads]
        self.head_at = order[self.heads].astype(np.int64)
        self.tail_at = order[np.append(self.heads[1:], self.n) - 1].astype(np.int64)
        a, b = self.tail_at[:-1], self.head_at[1:]
        room = lambda x: self.ends[np.searchsorted(self.ends, x)] - x
        self.agree = common_prefixes(data, np.minimum(room(a), room(b)), a, b)

    def matching_statistics(self) -> np.ndarray:
        """For each place, the longest string that starts there and at another place too."""
        place = np.arange(self.n)
        best = np.zeros(self.n, dtype=np.int64)
        for at, outer in ((self.head_at[1:], self.head_at[0]), (self.tail_at[:-1], self.tail_at[-1])):
            sampled = np.full(self.n, -1, dtype=np.int64)
            sampled[at] = self.agree
            sampled[outer] = 0  # no neighbour on this side
            known = np.maximum.accumulate(np.where(sampled >= 0, place, -1))
            streamed = np.where(known >= 0, sampled[known] - (place - known), 0)
            np.maximum(best, streamed, out=best)
        return best

    def repeats(self, length: int) -> list[np.ndarray]:
        """For each text, which of its places start a string of that length that also starts elsewhere."""
        long = self.matching_statistics() >= length
        return [long[b:e] for b, e in zip(self.begins.tolist(), self.ends.tolist())]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    n = len(values)
    pad = np.full(-n % width + width, np.iinfo(values.dtype).max, dtype=values.dtype)
    blocks = np.concatenate([values, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    back = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(ahead[: n - width + 1], back[width - 1 : n])


class Chunk:
    """A chunk's bytes, end to end, with the anchors of all strings of LENGTH bytes; none crosses a document."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.joined = b"".join(texts)
        data = np.frombuffer(self.joined, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        self.prefix = prefixes(data)
        n = len(data)
        if n < LENGTH:
            self.first = self.last = self.at = np.zeros(0, dtype=np.int64)
            self.anchor = np.zeros(0, dtype=np.uint64)
            return
        grams = rolling(self.prefix, np.arange(n - GRAM + 1), GRAM)
        low = np.uint64((1 << 24) - 1)
        blocks = []
        step = 1 << 24  # places are told apart by 24 bits
        for k in range(0, n - LENGTH + 1, step - SPAN):
            part = grams[k : k + step]
            keyed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
            least = sliding_least(keyed, SPAN) if len(part) >= SPAN else keyed[:0]
            blocks.append(k + (least[: step - SPAN] & low).astype(np.int64))
        anchor_at = np.concatenate(blocks)[: n - LENGTH + 1]
        valid = np.zeros(n - LENGTH + 1, dtype=bool)
        for b, e in zip(self.begins.tolist(), self.ends.tolist()):
            if e - b >= LENGTH:
                valid[b : e - LENGTH + 1] = True
        starts = np.flatnonzero(valid)
        at = anchor_at[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        #: One entry for each anchor place: the first and last string start that it stands for, and its hash.
        self.first = starts[new]
        self.last = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1] if len(starts) else starts
        self.at = at[new]
        #: Told apart by a second hash: minima are small numbers, and buckets and nodes go by the high bits.
        self.anchor = mixed(grams[self.at])

    def regions(self) -> tuple[np.ndarray, np.ndarray, Distinct]:
        """Of each anchor place: the length of its region, its hash; and the distinct (anchor, hash of text and length)."""
        length = self.last - self.first + LENGTH
        own = rolling(self.prefix, self.first, length)
        return length, own, Distinct(self.anchor, mixed(own + length.astype(np.uint64)))

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, Distinct]:
        """All string starts of the anchor places which, and their distinct 128-bit hashes."""
        size = self.last[which] - self.first[which] + 1
        ends = np.cumsum(size)
        starts = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - self.first[which], size)
        data = np.frombuffer(self.joined, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        return starts, Distinct(rolling(self.prefix, starts, LENGTH), rolling(prefixes(data, 1), starts, LENGTH, 1))


def ask_anchors(group: pa.Table, route: Route) -> pa.Table:
    number = group.column("chunk")[0].as_py()
    _, _, regions = Chunk(group.column("text").to_pylist()).regions()
    return route.requests(regions.keys, [np.bincount(regions.which, minlength=len(regions.keys))], number, number)


ONCE, LOOK, HEAVY = 0, 2, 4


def spread(hot: int):
    """By region: ONCE if its anchor has one place, HEAVY if over hot distinct regions, else LOOK; to one sender, one more."""

    def answer(keys: Keys, sums: list[np.ndarray]) -> tuple[np.ndarray, None]:
        if not len(keys):
            return np.zeros(0, dtype=np.int64), None
        new = np.append(True, keys.first[1:] != keys.first[:-1])
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        places, distinct = np.add.reduceat(sums[0], starts), np.diff(np.append(starts, len(keys)))
        state = np.where(places < 2, ONCE, np.where(distinct > hot, HEAVY, LOOK))
        return np.where(state == ONCE, 0, state + 1)[of], None

    return answer


class Work:
    """What a chunk knows once its anchors are answered: the places to look at, in regions and in hot families."""

    def __init__(self, docs: pa.Table, known: pa.Table, route: Route):
        self.number = docs.column("chunk")[0].as_py()
        self.chunk = Chunk(docs.column("text").to_pylist())
        self.length, self.hash, regions = self.chunk.regions()
        state = told(known, ANCHORS, regions.keys, route.bits)
        self.of, self.count = regions.which, np.bincount(regions.which, minlength=len(regions.keys))
        self.sends = (state & 1) > 0
        self.one = regions.order[regions.starts]
        self.look = np.flatnonzero(state & ~1 == LOOK)
        self.places = np.flatnonzero((state & ~1 == LOOK)[self.of])
        self.hot = np.flatnonzero((state & ~1 == HEAVY)[self.of])


def ask_regions(docs: pa.Table, known: pa.Table, route: Route, buckets: int) -> pa.Table:
    """A row for each distinct region that the chunk holds, to a negative node (its bucket); the strings of hot families."""
    if not docs.num_rows:
        return table_of([], REQUEST)
    work = Work(docs, known, route)
    c, one = work.chunk, work.one[work.look]
    head = np.zeros(len(one), dtype=REGION)
    head["anchor"], head["hash"], head["size"], head["many"] = c.anchor[one], work.hash[one], work.length[one], work.count[work.look] > 1
    node = -1 - (mixed(c.anchor[one]) % np.uint64(buckets)).astype(np.int64)
    rows = []
    for k, b, h, sends, at, n in zip(work.look.tolist(), node.tolist(), head, work.sends[work.look].tolist(), c.first[one].tolist(), work.length[one].tolist()):
        rows.append((b, work.number, k, h.tobytes(), c.joined[at : at + n] if sends else None))
    _, strings = c.strings(work.hot)
    asked = route.requests(strings.keys, [np.bincount(strings.which, minlength=len(strings.keys))], work.number, work.number)
    return pa.concat_tables([table_of(rows, REQUEST), asked])


def answer_regions(group: pa.Table) -> pa.Table:
    """Which string starts of each region also start elsewhere in the bucket."""
    if group.column("node")[0].as_py() >= 0:
        return table_of([], REPLY)
    # Equal regions are one text; what is left of an anchor's family is indexed if it holds more than one.
    head = np.frombuffer(b"".join(group.column("keys").to_pylist()), dtype=REGION)
    _, of = np.unique(head[["anchor", "hash", "size"]], return_inverse=True)
    texts: list[bytes] = [b""] * (int(of.max()) + 1)
    for k, text in zip(of.tolist(), group.column("held").to_pylist()):
        if text is not None:
            texts[k] = text
    anchor = np.zeros(len(texts), dtype=np.uint64)
    anchor[of] = head["anchor"]
    marks = [np.full(len(x) - LENGTH + 1, m) for x, m in zip(texts, (np.bincount(of, weights=head["many"] + 1.0) > 1).tolist())]
    order = np.argsort(anchor, kind="stable")
    families = [f for f in np.split(order, np.flatnonzero(np.diff(anchor[order])) + 1) if len(f) > 1]
    batch: list[int] = []
    size = 0
    for k, family in enumerate(families):
        batch += family.tolist()
        size += sum(len(texts[i]) for i in family)
        if size >= INDEX_BYTES or k == len(families) - 1:
            for i, long in zip(batch, RunLengthIndex([texts[i] for i in batch]).repeats(LENGTH)):
                marks[i] |= long[: len(marks[i])]
            batch, size = [], 0
    told_of = [np.packbits(m).tobytes() if m.any() else None for m in marks]
    rows = [(chunk, nth, REGIONS, told_of[i], None) for chunk, nth, i in zip(group.column("sender").to_pylist(), group.column("n").to_pylist(), of.tolist()) if told_of[i]]
    return table_of(rows, REPLY)


def twice(keys: Keys, sums: list[np.ndarray]) -> tuple[np.ndarray, None]:
    return sums[0] > 1, None


def remove(docs: pa.Table, known: pa.Table, route: Route) -> pa.Table:
    if not docs.num_rows:
        return table_of([], RESULT)
    work = Work(docs, known, route)
    c = work.chunk
    marked = {n: b for n, k, b in zip(known.column("by").to_pylist(), known.column("kind").to_pylist(), known.column("told").to_pylist()) if k == REGIONS}
    gone = []
    for first, last, k in zip(c.first[work.places].tolist(), c.last[work.places].tolist(), work.of[work.places].tolist()):
        if k in marked:  # a region with nothing to mark got no row
            gone.append(first + np.flatnonzero(np.unpackbits(np.frombuffer(marked[k], dtype=np.uint8), count=last - first + 1)))
    starts, strings = c.strings(work.hot)
    gone.append(starts[told(known, STRINGS, strings.keys, route.bits)[strings.which] > 0])
    lost = covered(len(c.joined), np.concatenate(gone), LENGTH)
    data, rows = np.frombuffer(c.joined, dtype=np.uint8), []
    for doc_id, b, e in zip(docs.column("doc_id").to_pylist(), c.begins.tolist(), c.ends.tolist()):
        own = lost[b:e]
        n = int(own.sum())
        spans = runs_of(own) if n else []
        rows.append((doc_id, e - b, n, len(spans), spans, data[b:e][~own].tobytes() if n else c.joined[b:e]))
    return table_of(rows, RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans ([start, bytes] of removed runs), kept (the bytes left)."""
    rows, chunks = chunked(docs, id_col, text_col, CHUNK_BYTES)
    route, buckets = Route.through(chunks), max(1, chunks // BUCKET_CHUNKS)
    by_chunk = rows.groupBy("chunk")
    hits = Exchange(by_chunk.applyInArrow(lambda g: ask_anchors(g, route), REQUEST_DDL), route, ANCHORS, spread(HOT), wide=True, one=True).replies
    asked = by_chunk.cogroup(hits.groupBy("to")).applyInArrow(lambda d, k: ask_regions(d, k, route, buckets), REQUEST_DDL)
    strings = Exchange(asked, route, STRINGS, twice, wide=True)
    found = strings.levels[0].groupBy("node").applyInArrow(answer_regions, REPLY_DDL)
    known = hits.unionByName(found).unionByName(strings.replies)
    return by_chunk.cogroup(known.groupBy("to")).applyInArrow(lambda d, k: remove(d, k, route), RESULT_DDL)
