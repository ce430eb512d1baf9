"""Vectors in blocks: dense search with both sides distributed, and an index whose blocks a search may pass over.

A block is a row that holds some vectors as one matrix. Blocks of questions meet blocks of vectors; each meeting is one
matrix product, and what a task has met so far is kept as the k best of each question.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import union_all

QUERY_BLOCK = 1024
VECTOR_BLOCK = 4096
#: Questions whose blocks may be broadcast (some 8 MB at 64 places each); beyond, both sides are dealt out as a grid.
MOST_BROADCAST = 1 << 14
PLACES = 6
#: A block of an index, and the rows that its cells are fitted on.
INDEX_BLOCK = 512
SAMPLE = 20_000
MOST_CELLS = 256
ROUNDS = 8
#: What rounding to PLACES may add to a bound.
SLACK = 1e-5
PACK_DDL = "block long, keys array<long>, extra array<double>, dim int, data binary"
HIT_DDL = "qid long, id long, score double"
BLOCK_DDL = "block long, cell int, centre array<double>, radius double, n int, keys array<long>, data binary"


def matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<f8").reshape(-1, dim) if dim else np.zeros((0, 0))


def rows_of(column: pa.Array) -> np.ndarray:
    """A column of arrays as a matrix."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), dtype=np.float64)


def packed(rows: DataFrame, key: str, n: int, vector: str = "embedding", extra: str | None = None) -> DataFrame:
    """Blocks of up to n rows with a vector, as they lie: nothing is shuffled. extra: a number that goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, n):
                b = whole.slice(at, n)
                m = rows_of(b.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([b.column(0).to_pylist()], type=pa.list_(pa.int64())), pa.array([b.column(2).to_pylist()], type=pa.list_(pa.float64())), pa.array([m.shape[1]], type=pa.int32()), pa.array([m.tobytes()], type=pa.binary())],
                    names=["block", "keys", "extra", "dim", "data"],
                )
                number += 1

    known = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    return known.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), (F.col(extra) if extra else F.lit(0.0)).cast("double").alias("extra")).mapInArrow(run, PACK_DDL)


def best_of(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Of each row the places of the n best scores, ties by id: only those that reach the n-th best are sorted."""
    ids = np.broadcast_to(ids, scores.shape)
    if n == scores.shape[1]:
        return np.lexsort((ids, -scores), axis=1)
    least = np.partition(scores, scores.shape[1] - n, axis=1)[:, -n]
    out = np.empty((len(scores), n), dtype=np.int64)
    for k, (row, low) in enumerate(zip(scores, least)):
        near = np.flatnonzero(row >= low)
        out[k] = near[np.lexsort((ids[k][near], -row[near]))[:n]]
    return out


class Best:
    """The k best hits of each question of a block, among all that were offered."""

    def __init__(self, qids: list[int], k: int):
        self.qids, self.k = np.array(qids, dtype=np.int64), k
        self.scores, self.ids = np.zeros((len(qids), 0)), np.zeros((len(qids), 0), dtype=np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.k and self.scores.shape[1] == self.k:  # only scores that reach a question's k-th best are looked at
            row, at = np.nonzero(scores >= self.scores[:, -1:])
            if len(row) <= 4 * self.k * len(scores):
                self.merge(row, scores[row, at], np.broadcast_to(ids, scores.shape)[row, at])
                return
        scores, ids = self.cut(scores, np.broadcast_to(ids, scores.shape))
        self.scores, self.ids = self.cut(np.concatenate([self.scores, scores], axis=1), np.concatenate([self.ids, ids], axis=1))

    def merge(self, row: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(row)
        row = np.concatenate([row, np.repeat(rows, self.k)])
        scores, ids = np.concatenate([scores, self.scores[rows].ravel()]), np.concatenate([ids, self.ids[rows].ravel()])
        order = np.lexsort((ids, -scores, row))
        take = order[(np.searchsorted(row[order], rows)[:, None] + np.arange(self.k)).ravel()]
        self.scores[rows], self.ids[rows] = scores[take].reshape(-1, self.k), ids[take].reshape(-1, self.k)

    def cut(self, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        take = best_of(scores, ids, min(self.k, scores.shape[1]))
        return np.take_along_axis(scores, take, 1), np.take_along_axis(ids, take, 1)

    def batch(self) -> pa.RecordBatch:
        n = self.scores.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.qids, n)), pa.array(self.ids.reshape(-1)), pa.array(self.scores.reshape(-1))], names=["qid", "id", "score"])


def grid(queries: DataFrame, blocks: DataFrame, many: bool) -> DataFrame:
    """Every block of questions with every other block, as columns q and b: the questions' blocks go to where the others
    lie while there are few questions; else the two are dealt out against each other, so that neither need fit anywhere."""
    left, right = blocks.select(F.struct("*").alias("b")), queries.select(F.struct("*").alias("q"))
    return left.crossJoin(right if many else F.broadcast(right))


def met(pairs: DataFrame, k: int, score: Callable[[np.ndarray, dict], tuple[np.ndarray, np.ndarray]], of: list[str]) -> DataFrame:
    """The k best of each question over all meetings of a task; score gives a block's scores and ids for some questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                q, b = (x[0].as_py() for x in batch.slice(i, 1).columns)
                own = best.setdefault(q["block"], Best(q["keys"], k))
                own.offer(*score(matrix(q["data"], q["dim"]), b))
        for own in best.values():
            yield own.batch()

    return pairs.select("q", F.struct(*[F.col(f"b.{c}") for c in of]).alias("b")).mapInArrow(run, HIT_DDL)


def products(q: np.ndarray, b: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.round(q @ matrix(b["data"], q.shape[1]).T, PLACES), np.array(b["keys"], dtype=np.int64)


def ranked(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best hits of each group by score, with rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def as_floats(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding"))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 20, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """queries (qid, embedding), vectors (id, embedding) -> (qid, id, score, rank): exact inner product.

    A grid of question blocks and vector blocks; the plan is the same for any number of questions, and nothing passes
    through the driver but that number. Tasks leave k rows a question, which a window ranks. keep: what is done with the
    blocks of many questions, where each part of one side is read again for each part of the other (written, say, so that
    no vector is worked out twice).
    """
    many = queries.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST
    kept = keep if many else lambda df: df
    cells = grid(kept(packed(queries, "qid", QUERY_BLOCK)), kept(packed(as_floats(vectors), "id", VECTOR_BLOCK)), many)
    return ranked(met(cells, k, products, ["keys", "data"]), k, "qid")


# --- the index ---


def cells_of(sample: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Centres of n cells, by rounds of means over a sample."""
    r = np.random.default_rng(seed)
    centres = sample[np.sort(r.choice(len(sample), min(n, len(sample)), replace=False))]
    for _ in range(ROUNDS):
        own = nearest(sample, centres)[0]
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre nearest to each row, and its distance."""
    d = np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None], 0)
    own = d.argmin(1)
    return own, np.sqrt(d[np.arange(len(rows)), own])


def write_index(vectors: DataFrame, path: str, per_block: int = INDEX_BLOCK, sample: int = SAMPLE) -> None:
    """vectors (id, embedding) as blocks of near ones, each with its centre and radius, in Parquet.

    Cells are fitted on at most `sample` vectors (the first by a hash of the id), at most MOST_CELLS of them; every vector
    is indexed. Within a cell, vectors are ordered by their distance from its centre, so a block is a part of a shell.
    Ranges of (cell, distance, hash of the id) are dealt to tasks: neither a crowded cell nor copies of one vector meet in one.
    """
    known = as_floats(vectors).where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = known.count()
    rows = known.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()  # a bounded sample
    centres = cells_of(np.array([r[0] for r in rows]), max(1, min(MOST_CELLS, n // per_block))) if rows else np.zeros((0, 0))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, far = nearest(rows_of(b.column(1)), centres)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(far)], names=["id", "embedding", "cell", "far"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        held: list[np.ndarray] = []
        cell = None

        def block() -> pa.RecordBatch:
            m = np.array(held)
            centre = m.mean(0)
            radius = float(np.sqrt(((m - centre) ** 2).sum(1)).max())
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([cell], type=pa.int32()), pa.array([centre.tolist()], type=pa.list_(pa.float64())), pa.array([radius]), pa.array([len(ids)], type=pa.int32()), pa.array([ids], type=pa.list_(pa.int64())), pa.array([m.tobytes()], type=pa.binary())],
                names=["block", "cell", "centre", "radius", "n", "keys", "data"],
            )

        for b in batches:
            for vec_id, row, of in zip(b.column(0).to_pylist(), rows_of(b.column(1)) if b.num_rows else (), b.column(2).to_pylist()):
                if ids and (of != cell or len(ids) == per_block):
                    yield block()
                    number, ids, held = number + 1, [], []
                ids.append(vec_id)
                held.append(row)
                cell = of
        if ids:
            yield block()

    spread = known.mapInArrow(placed, "id long, embedding array<double>, cell int, far double")
    keys = ("cell", "far", F.xxhash64("id"))
    spread.repartitionByRange(max(1, -(-n // (per_block * 64))), *keys).sortWithinPartitions(*keys).mapInArrow(cut, BLOCK_DDL).write.mode("errorifexists").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_DDL).parquet(path)


@dataclass
class Search:
    """hits: the result. probed, reached: (qid, block) pairs searched first, and then since their bound reached the k-th best."""

    hits: DataFrame
    probed: DataFrame
    reached: DataFrame


def bounds(q: np.ndarray, b: dict) -> np.ndarray:
    """No vector of a block has a greater product with a question than that of the centre and the radius along it."""
    return q @ matrix(b["data"], q.shape[1]).T + np.sqrt((q**2).sum(1))[:, None] * np.array(b["extra"])[None]


def index_topk(queries: DataFrame, index: DataFrame, k: int = 20, probes: int = 2, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Search:
    """As dense_topk over an index: exact, and of the blocks only those are read whose bound a question's k-th best score
    so far doesn't exceed.

    The blocks of greatest bound are searched first, which sets the k-th best; then those that it leaves. keep: what is done
    with a table that is read again (written, say); unset, it is worked out again.
    """
    n = queries.count()
    many, shares = n > MOST_BROADCAST, max(1, -(-n // QUERY_BLOCK))
    asked = packed(queries, "qid", QUERY_BLOCK)
    heads = packed(index.select("block", "centre", "radius"), "block", VECTOR_BLOCK, "centre", "radius")
    first = met(grid(asked, heads, many), probes, lambda q, b: (bounds(q, b), np.array(b["keys"], dtype=np.int64)), ["keys", "extra", "data"])
    probed = keep(ranked(first, probes, "qid").select("qid", F.col("id").alias("block")))
    found = keep(searched(probed, queries, index, k, shares))
    least = ranked(found, k, "qid").where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    limits = queries.select(F.col("qid").cast("long").alias("qid"), "embedding").join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, b = (x[0].as_py() for x in batch.slice(i, 1).columns)
                own, block = np.nonzero(bounds(matrix(q["data"], q["dim"]), b) >= np.array(q["extra"])[:, None] - SLACK)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(q["keys"], dtype=np.int64)[own]), pa.array(np.array(b["keys"], dtype=np.int64)[block])], names=["qid", "block"])

    cells = grid(packed(limits, "qid", QUERY_BLOCK, extra="least"), heads, many).select("q", F.struct("b.keys", "b.extra", "b.data").alias("b"))
    reached = keep(cells.mapInArrow(reach, "qid long, block long").join(probed, ["qid", "block"], "left_anti"))
    hits = ranked(union_all(found, searched(reached, queries, index, k, shares)), k, "qid")
    return Search(hits, probed, reached)


def searched(pairs: DataFrame, queries: DataFrame, index: DataFrame, k: int, shares: int) -> DataFrame:
    """The k best of each question in each of its blocks. A block that many questions ask for gets them in shares, of
    about QUERY_BLOCK questions at most."""
    share = F.pmod(F.xxhash64("qid"), F.lit(shares))
    rows = pairs.join(queries.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding")), "qid")
    asked = rows.groupBy("block", share.alias("share")).agg(F.collect_list(F.struct("qid", "embedding")).alias("asked"))
    both = index.select("block", "keys", "data").join(asked, "block").select("keys", "data", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, data, asked = (x[0].as_py() for x in batch.slice(i, 1).columns)
                for at in range(0, len(asked), QUERY_BLOCK):
                    part = asked[at : at + QUERY_BLOCK]
                    own = Best([x["qid"] for x in part], k)
                    own.offer(*products(np.array([x["embedding"] for x in part]), {"keys": keys, "data": data}))
                    yield own.batch()

    return both.mapInArrow(run, HIT_DDL)
