"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints: the majority bits of the XXH64 values (seed 42) of a text's three-word shingles.

Links: with radius r, every bit position gets a vector of r+1 bits that is not zero, and table v (each non-zero vector
v) keeps the positions whose vector has an odd product with v. Up to r positions leave some v orthogonal to all of
their vectors, so that table keeps none of them: every pair within the radius agrees in all the bits that some table keeps. For r = 2
there are 7 tables of 36 or 37 kept bits. Only distinct fingerprints are indexed (copies collapse first).

Buckets never grow without bound: one of over WIDE fingerprints is split by a second covering of its free bits, under
which at most 2^12 fingerprints share a key. Small buckets are joined with themselves on the key and the distance;
larger ones are linked to the smallest fingerprint of each group that agrees outside two free bits, which spans the
same components without listing pairs. No cap, no lost link.

Components: large-star and small-star rounds on the links between distinct fingerprints, each round written to the
shared folder. Documents ask for their component by fingerprint and salt.

Defined results: a null or blank text has fingerprint zero, linked like any other; a component of only null doc_ids has
a null id; repeated rows fall together; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import ROW_KEY, row_key, rows_kept, staged, text_bytes

SHINGLE = 3
RADIUS = 2
SMALL = 16
WIDE = 1 << 16
#: A fingerprint that many rows share is met in parts of about so many rows; at least SALTS parts.
SALTS, SALT_ROWS = 64, 1 << 20


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], dtype=np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, the row key, fp (the 64 bits as a signed long)."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), text_bytes(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(5)
            fps = np.fromiter((fingerprint_of(texts[i].as_py()) for i in range(b.num_rows)), dtype=np.uint64, count=b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(fps)], names=["rid", "doc_id", *ROW_KEY, "fp"])

    return rows.mapInArrow(run, "rid long, doc_id long, kid long, knull boolean, ktext long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """A mask of kept bits for each table: any radius of positions are all free (not kept) in some mask."""
    vectors = range(1, 1 << (radius + 1))
    at = {p: vectors[i % len(vectors)] for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (at[p] & v).bit_count() % 2) for v in vectors]


MASKS = covering_masks(list(range(64)), RADIUS)


def star_links(values: np.ndarray, free: int) -> set[tuple[int, int]]:
    """Links that span the same components as all pairs of values within RADIUS (2) bits, the differing bits lying in free."""
    bits = [1 << p for p in range(64) if free >> p & 1]
    masks = [a | b for i, a in enumerate(bits) for b in bits[i + 1 :]] or bits
    root = np.arange(len(values))
    links: set[tuple[int, int]] = set()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for m in masks:
        masked = values & np.uint64(~m & (1 << 64) - 1)
        order = np.argsort(masked, kind="stable")
        same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
        for k in same.tolist():
            i, j = find(order[k]), find(order[k + 1])
            if i != j:
                root[max(i, j)] = min(i, j)
                links.add((int(values[order[k]]), int(values[order[k + 1]])))
    return links


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fp. Edges (a, b) that span the components of all pairs within RADIUS bits."""
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(MASKS)]))
    keyed = distinct.select("fp", table.alias("k")).select("fp", "k.t", "k.key").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("t", "key")))
    small = keyed.where(F.col("n").between(2, SMALL))
    other = small.select(F.col("fp").alias("fp2"), "t", "key")
    near = small.join(other, ["t", "key"]).where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    # Wide buckets: a second covering of the bits that the first table leaves free.
    free = [[p for p in range(64) if not m >> p & 1] for m in MASKS]
    second = F.array(*[F.array(*[F.lit(signed(m)) for m in covering_masks(f, RADIUS)]) for f in free])
    large = keyed.where(F.col("n") > SMALL)
    subs = F.when(F.col("n") > WIDE, F.transform(second[F.col("t")], lambda m, i: F.struct((i + 1).alias("t2"), F.col("fp").bitwiseAND(m).alias("key2")))).otherwise(F.array(F.struct(F.lit(0).alias("t2"), F.lit(0).cast("long").alias("key2"))))
    large = large.select("fp", "t", "key", F.explode(subs).alias("s")).select("fp", "t", "key", "s.t2", "s.key2")
    frees = [[~m & ((1 << 64) - 1)] + [~m & ~m2 & ((1 << 64) - 1) for m2 in covering_masks(f, RADIUS)] for m, f in zip(MASKS, free)]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def star(group: pa.Table) -> pa.Table:
        values = np.unique(group.column("fp").to_numpy().view(np.uint64))
        found = sorted(star_links(values, frees[group.column("t")[0].as_py()][group.column("t2")[0].as_py()]))
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return near.unionByName(large.groupBy("t", "key", "t2", "key2").applyInArrow(star, "a long, b long"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b): one row (v, root) for each vertex, root the smallest vertex of its component."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = edges.agg(mark).first()[0]
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = staged(small, "edges")
        after = edges.agg(mark).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def with_components(prints: DataFrame) -> DataFrame:
    """prints: staged rid, doc_id, fp. Adds component_id and first (the rid of the row that stands for the component)."""
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(max(SALTS, prints.count() // SALT_ROWS))).cast("int"))
    best = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "rid")
    leaves = salted.groupBy("fp", "salt").agg(F.min(best).alias("best"))
    distinct = leaves.groupBy("fp").agg(F.min("best").alias("best"))
    roots = components(links(distinct.select("fp")))
    distinct = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    heads = distinct.groupBy("root").agg(F.min("best").alias("head"))
    known = distinct.select("fp", "root").join(heads, "root").select("fp", "head")
    return salted.join(leaves.select("fp", "salt").join(known, "fp"), ["fp", "salt"]).select(*prints.columns, F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("first"))


def near_groups(docs: DataFrame, **cols: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of docs."""
    out = with_components(staged(fingerprints(docs, **cols), "fingerprints"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns."""
    kept = with_components(staged(fingerprints(docs, id_col, text_col), "fingerprints")).where("rid = first")
    return rows_kept(docs, kept, id_col, text_col)
