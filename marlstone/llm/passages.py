"""Substring dedup on words by fixed-block anchors.

Index: the non-overlapping blocks of BLOCK words of every document. Probe: every rolling run of BLOCK words of every
document. A window of WINDOW >= 2 * BLOCK - 1 words holds a whole block of its document, so a window that occurs twice
has a block that some other place's rolling run hits. Extend: each hit is extended to all windows that hold it, and a
window stays if its whole word sequence (96-bit hash) starts at another place too; overlapping windows merge to maximal
exact repeats. Blocks, probes and windows meet in nodes of the hash space (_exchange.py), not in groups of documents.

Defined results: a null text has no words; a document of under WINDOW words loses nothing; repeated rows (and copies)
count as different places, so all their windows go; null and repeated doc_ids pass through, a row in and a row out; an
empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._exchange import REQUEST, REQUEST_DDL, Distinct, Exchange, Keys, Route, chunked, prefixes, rolling, table_of, told

BLOCK = 18
WINDOW = 35
ANCHORS, WINDOWS = 0, 1
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept", pa.binary())])
RESULT_DDL = "doc_id long, n_words long, n_removed long, n_spans long, spans array<array<int>>, kept binary"


class Chunk:
    """A chunk's words, end to end, and the hashes of its rolling runs; none crosses a document."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, self.words), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        digest = xxhash.xxh64_intdigest
        flat = np.fromiter((digest(w) for d in self.words for w in d), dtype=np.uint64, count=int(sizes.sum()))
        self.prefix = [prefixes(flat, k) for k in (0, 1)]
        self.end_of = np.repeat(self.ends, sizes)
        self.begin_of = np.repeat(self.begins, sizes)

    def starts(self, length: int) -> np.ndarray:
        at = np.arange(len(self.end_of))
        return at[at + length <= self.end_of]

    def anchors(self) -> tuple[np.ndarray, Distinct, np.ndarray]:
        """Rolling runs: their starts, the distinct hashes, and by hash whether one of its runs is a block."""
        at = self.starts(BLOCK)
        runs = Distinct(rolling(self.prefix[0], at, BLOCK))
        block = np.zeros(len(runs.keys), dtype=np.int64)
        block[runs.which[(at - self.begin_of[at]) % BLOCK == 0]] = 1
        return at, runs, block

    def candidates(self, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a hit run."""
        hits = np.zeros(len(self.end_of) + 1, dtype=np.int32)
        hits[at[hit] + 1] = 1
        np.cumsum(hits, out=hits)
        first = self.starts(WINDOW)
        return first[hits[first + WINDOW - BLOCK + 1] > hits[first]]

    def windows(self, first: np.ndarray) -> Distinct:
        """Distinct 96-bit hashes of the windows that start at first."""
        return Distinct(rolling(self.prefix[0], first, WINDOW), rolling(self.prefix[1], first, WINDOW, 1) >> np.uint64(32))


def ask_anchors(group: pa.Table, route: Route) -> pa.Table:
    """What the chunk holds of each run: whether a place, whether a second one, whether a block."""
    chunk = group.column("chunk")[0].as_py()
    _, runs, block = Chunk(group.column("text").to_pylist()).anchors()
    return route.requests(runs.keys, [np.bincount(runs.which, minlength=len(runs.keys)), block], chunk, chunk)


def hit(keys: Keys, sums: list[np.ndarray]) -> tuple[np.ndarray, None]:
    """A run is hit if it has two places, one of them a block of its document."""
    places, block = sums
    return (places > 1) & (block > 0), None


def found(docs: pa.Table, known: pa.Table, route: Route) -> tuple[Chunk, np.ndarray]:
    """The chunk and its candidate windows, given the replies about its anchors."""
    chunk = Chunk(docs.column("text").to_pylist())
    at, runs, _ = chunk.anchors()
    return chunk, chunk.candidates(at, told(known, ANCHORS, runs.keys, route.bits)[runs.which] > 0)


def ask_windows(docs: pa.Table, known: pa.Table, route: Route) -> pa.Table:
    if not docs.num_rows:
        return table_of([], REQUEST)
    number = docs.column("chunk")[0].as_py()
    chunk, first = found(docs, known, route)
    windows = chunk.windows(first)
    return route.requests(windows.keys, [np.bincount(windows.which, minlength=len(windows.keys))], number, number)


def twice(keys: Keys, sums: list[np.ndarray]) -> tuple[np.ndarray, None]:
    return sums[0] > 1, None


def runs_of(mask: np.ndarray) -> list[list[int]]:
    """Maximal runs of true places: [start, length]."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return np.stack([edge[::2], edge[1::2] - edge[::2]], axis=1).tolist()


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Places 0..n-1 that a run [start, start + length) covers."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(step)[:-1] > 0


def remove(docs: pa.Table, known: pa.Table, route: Route) -> pa.Table:
    if not docs.num_rows:
        return table_of([], RESULT)
    chunk, first = found(docs, known, route)
    windows = chunk.windows(first)
    gone_at = first[told(known, WINDOWS, windows.keys, route.bits)[windows.which] > 0]
    gone = covered(len(chunk.end_of), gone_at, WINDOW)
    rows = []
    for doc_id, words, begin, end in zip(docs.column("doc_id").to_pylist(), chunk.words, chunk.begins.tolist(), chunk.ends.tolist()):
        own = gone[begin:end]
        spans = runs_of(own) if own.any() else []
        kept = b" ".join(words) if not spans else b" ".join([w for w, g in zip(words, own.tolist()) if not g])
        rows.append((doc_id, len(words), int(own.sum()), len(spans), spans, kept))
    return table_of(rows, RESULT)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, spans ([start, words] of removed runs), kept (the words left, one space between)."""
    rows, chunks = chunked(docs, id_col, text_col)
    route = Route.through(chunks)
    by_chunk = rows.groupBy("chunk")
    hits = Exchange(by_chunk.applyInArrow(lambda g: ask_anchors(g, route), REQUEST_DDL), route, ANCHORS, hit).replies
    windows = by_chunk.cogroup(hits.groupBy("to")).applyInArrow(lambda d, k: ask_windows(d, k, route), REQUEST_DDL)
    repeats = Exchange(windows, route, WINDOWS, twice, wide=True).replies
    return by_chunk.cogroup(hits.unionByName(repeats).groupBy("to")).applyInArrow(lambda d, k: remove(d, k, route), RESULT_DDL)
