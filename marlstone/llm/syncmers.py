"""Document fingerprints of closed syncmers, in DataFrame operations only.

Symbols are the bytes of UTF-8. A k-mer of K bytes is an anchor if the smallest of its inner S-mers' hashes lies at its
first or last place: a rule that looks at nothing outside the k-mer, so an edit moves no anchor but those it touches. A
fingerprint keeps the SKETCH smallest distinct anchor hashes and each one's first byte position. Two fingerprints are
matched by position: an anchor counts as shared if both hold it within the SKETCH smallest of their union and their
positions differ by at most DRIFT bytes; the likeness is the shared part of those SKETCH (an estimate of the anchors'
Jaccard similarity, 0 to 1; two empty fingerprints are alike).

Written out, an anchor is 16 hex digits of its hash and 8 of its position; anchors stand in the order of their hashes.
Texts are read in blocks of BLOCK k-mers, each reduced to its smallest anchors, so no array grows with a long text.

Each text is edited with its successor's first half. Anchors need no context, so an edited text's fingerprint is merged
from that of the part it keeps, worked out with the whole text's, and the anchors from the seam on. Rows find their
successor by key ranges of the id, of about RANGE_ROWS rows each: approximate quantiles, which beyond MOST_QUANTILES are
divided evenly; a window in each, and one row per range for the seams; no window spans the table.

Defined results: a null text is empty; a text of fewer than K bytes is one anchor, all of it; no bytes, no anchors (an
empty fingerprint); null ids come first in the order; of rows that share an id the order is by text; a table of one row
is its own successor; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

K = 24
S = 15
#: S-mers between the first and the last of a k-mer.
INNER = K - S - 1
SKETCH = 64
DRIFT = 512
BLOCK = 1 << 14
RANGE_ROWS = 2000
MOST_QUANTILES = 4096
NONE = "cast(array() as array<struct<h:bigint,p:int>>)"


def upto(n: Column) -> Column:
    """0, 1, .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))


def anchors(block: Column, base: Column) -> Column:
    """The (hash, position) pairs of the closed syncmers of bytes, in order; base is added to positions."""

    def of(b: Column) -> Column:
        inner = F.transform(upto(F.octet_length(b) - (S - 1)), lambda i: F.hash(F.substr(b, i + 1, F.lit(S))))
        return with_value(inner, lambda m: selected(b, m))

    def selected(b: Column, m: Column) -> Column:
        edge = lambda i: F.least(F.get(m, i), F.get(m, i + INNER + 1))
        closed = F.filter(upto(F.octet_length(b) - (K - 1)), lambda i: edge(i) <= F.least(*[F.get(m, i + k) for k in range(1, INNER + 1)]))
        return F.transform(closed, lambda i: F.struct(F.xxhash64(F.substr(b, i + 1, F.lit(K))).alias("h"), (i + base).cast("int").alias("p")))

    return with_value(block, of)


def sketches(data: Column, keep: Column) -> Column:
    """struct(whole, kept): the sketch of the anchors of bytes, and of those that end within the first keep bytes."""

    def of(b: Column) -> Column:
        blocks = F.transform(upto(F.greatest(F.ceil((F.octet_length(b) - (K - 1)) / BLOCK), F.lit(1)).cast("int")), lambda c: with_value(anchors(F.substr(b, c * BLOCK + 1, F.lit(BLOCK + K - 1)), c * BLOCK), both))
        return with_value(blocks, lambda found: F.struct(sketch(F.flatten(F.transform(found, lambda x: x["whole"]))).alias("whole"), sketch(F.flatten(F.transform(found, lambda x: x["kept"]))).alias("kept")))

    def both(a: Column) -> Column:
        kept = with_value(keep, lambda k: F.filter(a, lambda x: x["p"] + K <= k))  # keep once, not for every anchor
        return F.struct(sketch(a).alias("whole"), sketch(kept).alias("kept"))

    return with_value(data, of)


def short(data: Column, found: Column) -> Column:
    """found, or the one anchor of a text of fewer than K bytes."""
    one = F.array(F.struct(F.xxhash64(data).alias("h"), F.lit(0).alias("p")))
    return F.when(F.octet_length(data) >= K, found).when(F.octet_length(data) > 0, one).otherwise(F.expr(NONE))


def packed(held: Column) -> Column:
    """A sketch as two plain arrays, a third of its size."""
    return F.struct(F.transform(held, lambda x: x["h"]).alias("h"), F.transform(held, lambda x: x["p"]).alias("p"))


def opened(held: Column) -> Column:
    return F.zip_with(held["h"], held["p"], lambda h, p: F.struct(h.alias("h"), p.alias("p")))


def with_value(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable holds it."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def sketch(found: Column) -> Column:
    """The SKETCH smallest distinct hashes with their first positions: an array of (h, p) by h."""

    def least(a: Column) -> Column:
        lowest = F.slice(F.sort_array(F.array_distinct(F.transform(a, lambda x: x["h"]))), 1, SKETCH)
        return with_value(F.element_at(lowest, -1), lambda top: with_value(F.sort_array(F.filter(a, lambda x: x["h"] <= top)), firsts))

    def firsts(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["h"] != x["h"]))

    return with_value(found, lambda a: F.when(F.size(a) > 0, least(a)).otherwise(a))


def written(held: Column) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(held, lambda x: F.concat(F.lower(F.lpad(F.hex(x["h"]), 16, "0")), F.lower(F.lpad(F.hex(x["p"]), 8, "0")))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the part of the SKETCH smallest anchors of both sketches that both hold at near positions."""
    h = lambda x: x["h"]

    def of(union: Column) -> Column:
        top = F.element_at(union, -1)
        low = F.map_from_entries(F.filter(b, lambda x: x["h"] <= top))
        near = lambda m: F.filter(a, lambda x: F.coalesce(F.abs(m[x["h"]] - x["p"]) <= DRIFT, F.lit(False)))
        return F.size(with_value(low, near)) / F.size(union)

    union = F.slice(F.sort_array(F.array_union(F.transform(a, h), F.transform(b, h))), 1, SKETCH)
    return with_value(union, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(of(u)))


def cuts_below(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most x: looked up in two steps, first among every step-th cut."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    if not groups:
        return F.lit(0)
    count = lambda held: F.size(F.filter(held, lambda c: c <= x))
    first = count(F.array(*[F.lit(g[0]) for g in groups]))
    lists = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    return with_value(first, lambda f: F.when(f == 0, 0).otherwise((f - 1) * step + count(F.element_at(lists, f))))


def ranges(docs: DataFrame) -> Column:
    """The number of a row's key range, in the order of doc_id; null ids have their own, the first."""
    rows, least, most = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    wanted = -(-rows // RANGE_ROWS)
    n = min(MOST_QUANTILES, wanted)
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20000)).first()[0] or [])) if n > 1 else []
    above, parts = cuts_below(F.col("doc_id"), cuts), -(-wanted // MOST_QUANTILES)
    if parts > 1:  # even divisions of the stretch between two cuts
        ends = F.array(*[F.lit(int(c)) for c in (least, *cuts, most + 1)])
        above = with_value(above, lambda a: a * parts + F.least(F.lit(parts - 1), F.floor((F.col("doc_id") - F.get(ends, a)) / (F.get(ends, a + 1) - F.get(ends, a)) * parts)))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(above + 1).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, held. Adds next (text, held): of the next row by (doc_id, text), after the last of the first."""
    docs = docs.withColumn("bucket", ranges(docs))
    within = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = docs.withColumn("next", F.lead(F.struct("text", "held")).over(within)).withColumn("is_last", F.col("next").isNull())
    # Seams: each range's last row takes the first row of the next range. Its id is found first, then the texts of that id.
    # As a table of known size: the planner broadcasts it while it is small, so that no texts move for it.
    ids = staged(docs.groupBy("bucket").agg(F.min("doc_id").alias("first_id")), "first_ids")
    firsts = docs.select("bucket", "doc_id", "text").join(ids, "bucket").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    firsts = firsts.groupBy("bucket").agg(F.min("text").alias("text"))
    turn = Window.orderBy("bucket")  # one number a range
    before = F.coalesce(F.lag("bucket").over(turn), F.last("bucket").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    seams = firsts.join(ids.select("bucket", before.alias("after")), "bucket").select(F.col("after").alias("bucket"), F.lit(True).alias("is_last"), F.struct("text", packed(short(F.col("text").cast("binary"), sketches(F.col("text").cast("binary"), F.lit(0))["whole"])).alias("held")).alias("seam"))
    return rows.join(seams, ["bucket", "is_last"], "left").withColumn("next", F.coalesce("next", "seam")).drop("seam", "bucket", "is_last")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next: one row per row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    data, half = F.col("text").cast("binary"), F.floor(F.length("text") / 2).cast("int")
    cut = F.octet_length(F.left("text", F.length("text") - half))
    rows = rows.withColumn("found", sketches(data, cut))
    rows = with_next(rows.select("doc_id", "text", packed(short(data, F.col("found.whole"))).alias("held"), packed(F.col("found.kept")).alias("kept")))
    # The edited text: the last half of the code points replaced by the first as many (or all) of the next text.
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "held", "kept", F.col("next.held").alias("next_held"), cut.alias("cut"), F.concat(F.left("text", F.length("text") - half), F.left("next.text", half)).alias("edited"))
    whole, seam = F.col("edited").cast("binary"), F.greatest(F.col("cut") - (K - 1), F.lit(0))
    rest = F.transform(sketches(F.substr(whole, seam + 1), F.lit(0))["whole"], lambda x: F.struct(x["h"].alias("h"), (x["p"] + seam).cast("int").alias("p")))
    rows = rows.withColumn("edited_held", short(whole, sketch(F.concat(opened(F.col("kept")), rest)))).withColumn("held", opened(F.col("held"))).withColumn("next_held", opened(F.col("next_held")))
    return rows.select(
        "doc_id", "n_chars", "edited", written(F.col("held")).alias("fingerprint"), written(F.col("edited_held")).alias("edited_fingerprint"),
        likeness(F.col("held"), F.col("edited_held")).alias("near_edited"), likeness(F.col("held"), F.col("next_held")).alias("near_next"),
    )
