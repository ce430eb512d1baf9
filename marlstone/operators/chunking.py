"""Structure-aware segmentation, packing and chunk normalisation.

Documents are independent until ids are given: everything before works inside a row (array expressions, no shuffle) or
within a document's window. Order travels as explicit columns (pos), never as row order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import join_same, union_all
from ..functions.rules import VIETNAMESE, WS, RuleSet
from ..functions.text import strip, with_context

TEXTS = "array<string>"


#: Sources that cut the order of all sources into stretches.
CUTS = 256


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def header_parts(text: Column, rules: RuleSet = VIETNAMESE) -> Column:
    """The text cut before each section header at a line's start; what precedes the first header is part 0 if not empty."""
    return F.split(text, f"(?md)(?=^{rules.header})")


def header_of(part: Column, rules: RuleSet = VIETNAMESE) -> Column:
    """The header that a part begins with, or ''."""
    return strip(F.regexp_extract(part, f"^{rules.header}", 0))


def is_table(paragraph: Column) -> Column:
    """Whether a line of the (stripped) paragraph begins with a pipe."""
    return F.exists(F.split(strip(paragraph), "\n"), lambda line: strip(line).startswith("|"))


def merge_tables(paragraphs: Column) -> Column:
    """Neighbouring table paragraphs become one, a line end between them."""
    start = F.struct(F.expr(f"cast(array() as {TEXTS})").alias("out"), F.lit(False).alias("open"))

    def step(s: Column, p: Column) -> Column:
        joined = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.concat(F.element_at(s["out"], -1), F.lit("\n"), p)))
        table = is_table(p)
        return F.struct(F.when(table & s["open"], joined).otherwise(F.concat(s["out"], F.array(p))).alias("out"), table.alias("open"))

    return F.aggregate(paragraphs, start, step, lambda s: s["out"])


def packed(paragraphs: Column, limit: float, gap: str = "\n\n", keep_blank: bool = False) -> Column:
    """Greedy packing: a buffer is closed before a paragraph that would take it over limit (its trailing gap counts).

    keep_blank: a buffer of only white space is added to, not closed (it still counts towards the limit).
    """
    start = F.struct(F.expr(f"cast(array() as {TEXTS})").alias("out"), F.lit("").alias("buf"))
    flushed = lambda s: F.when(strip(s["buf"]) != "", F.concat(s["out"], F.array(strip(s["buf"])))).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        full = F.length(s["buf"]) + F.length(p) > limit
        if keep_blank:
            full = full & (strip(s["buf"]) != "")
        return F.struct(F.when(full, flushed(s)).otherwise(s["out"]).alias("out"), F.when(full, F.concat(p, F.lit(gap))).otherwise(F.concat(s["buf"], p, F.lit(gap))).alias("buf"))

    return F.aggregate(paragraphs, start, step, flushed)


def packed_with_overlap(paragraphs: Column, limit: float, least: int, gap: str = "\n\n") -> Column:
    """As packed(), of stripped non-blank paragraphs; a closed buffer's last two sentences open the next one, and a
    buffer under least is not emitted (but closed all the same)."""
    start = F.struct(F.expr(f"cast(array() as {TEXTS})").alias("out"), F.lit("").alias("buf"))
    flushed = lambda s: F.when(F.length(strip(s["buf"])) >= least, F.concat(s["out"], F.array(strip(s["buf"])))).otherwise(s["out"])
    dots = lambda s: F.split(strip(s["buf"]), r"\.", -1)
    tail = lambda s: F.when(F.size(dots(s)) > 1, F.array_join(F.slice(dots(s), -2, 2), ". ")).otherwise("")

    def step(s: Column, p: Column) -> Column:
        full = F.length(s["buf"]) + F.length(p) > limit
        return F.struct(F.when(full, flushed(s)).otherwise(s["out"]).alias("out"), F.when(full, F.concat(tail(s), F.lit(gap), p, F.lit(gap))).otherwise(F.concat(s["buf"], p, F.lit(gap))).alias("buf"))

    return F.aggregate(F.filter(F.transform(paragraphs, strip), lambda p: p != ""), start, step, flushed)


def sections(docs: DataFrame, rules: RuleSet = VIETNAMESE, keep: list[str] | None = None) -> DataFrame:
    """(source, text) of documents with headers -> (source, part, header, chapter, text): one row a part, chapter carried on."""
    parts = docs.select(*(keep or ["source"]), F.posexplode(header_parts(F.col("text"), rules)).alias("part", "text"))
    parts = parts.withColumn("header", header_of(F.col("text"), rules))
    carried = Window.partitionBy(*(keep or ["source"])).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chapter = F.last(F.when(F.col("header").startswith(rules.chapter_word), F.col("header")), ignorenulls=True).over(carried)
    return parts.withColumn("chapter", F.coalesce(chapter, F.lit("")))


def chunk_documents(docs: DataFrame, rules: RuleSet = VIETNAMESE, paragraph: str = "\n\n") -> DataFrame:
    """(source, text) -> (source, pos, section, chapter, text, text_with_context), pos ordering a source's chunks.

    Three headers or more: one chunk a section, long ones packed, short ones dropped, and what precedes them first.
    Fewer: paragraphs packed with overlap.
    """
    size = rules.sizes
    structured = F.size(F.filter(header_parts(F.col("text"), rules), lambda p: p.rlike(f"^{rules.header}"))) >= 3
    paragraphs = lambda t: merge_tables(F.split(t, paragraph, -1))
    docs = docs.select("source", "text", structured.alias("structured"))
    parts = sections(docs.where("structured"), rules)
    raw, text = F.length("text"), strip(F.col("text"))
    own = (
        F.when(F.col("header") == "", F.when((raw > size.least_chunk) & (F.length(text) >= size.least_chunk), F.array(text)))
        .when(F.length(text) > size.chunk * 3, packed(paragraphs(text), size.chunk * 1.5))
        .when(F.length(text) >= size.least_chunk, F.array(text))
    )
    cut = parts.select("source", "part", F.when(F.col("header") == "", rules.preamble).otherwise(F.col("header")).alias("section"), "chapter", F.posexplode(own).alias("sub", "text"))
    free = packed_with_overlap(paragraphs(F.col("text")), size.chunk * 1.5, size.least_chunk)
    plain = docs.where(~F.col("structured")).select("source", F.lit(0).alias("part"), F.lit("").alias("section"), F.lit("").alias("chapter"), F.posexplode(free).alias("sub", "text"))
    both = union_all(cut, plain).withColumn("pos", F.col("part").cast("long") * (1 << 32) + F.col("sub"))
    return both.select("source", "pos", "section", "chapter", "text", with_context(F.col("source"), F.col("chapter"), F.col("section"), F.col("text")).alias("text_with_context"))


def with_ids(chunks: DataFrame, order: tuple[str, ...] = ("source", "pos"), name: str = "chunk_%04d") -> DataFrame:
    """Adds n (0, 1, 2, ... over source and position) and id, by per-source counts and their prefix sum in two levels:
    sources fall into the ranges between some of them, chosen by a hash. No window spans the table or the sources."""
    source, *rest = order
    counts = chunks.groupBy(source).agg(F.count(F.lit(1)).alias("size"))
    cuts = sorted(r[0] for r in counts.select(source).where(F.col(source).isNotNull()).orderBy(F.xxhash64(source), source).limit(CUTS).collect())
    held = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("cast(array() as array<string>)")
    counts = counts.withColumn("stretch", F.size(F.filter(held, lambda c: F.coalesce(c <= F.col(source), F.lit(False)))))
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    stretches = counts.groupBy("stretch").agg(F.sum("size").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(before(Window.orderBy("stretch"))), F.lit(0))).drop("size")
    counts = counts.withColumn("within", F.coalesce(F.sum("size").over(before(Window.partitionBy("stretch").orderBy(source))), F.lit(0))).join(stretches, "stretch")
    counts = counts.select(source, (F.col("base") + F.col("within")).alias("before"))
    numbered = join_same(chunks, counts, [source]).withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy(source).orderBy(*rest)) - 1)
    return numbered.drop("before").withColumn("id", F.format_string(name, "n"))


def merge_tiny(chunks: DataFrame, least: int = VIETNAMESE.sizes.tiny) -> DataFrame:
    """Chunks under least characters go in front of the next longer one of their source; trailing ones behind the last.

    Adds anchor (the position whose chunk a group keeps) and n_merged; a source of only tiny chunks becomes one.
    """
    ahead = Window.partitionBy("source").orderBy("pos")
    onward = ahead.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    back = ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = F.when(F.length("text") >= least, F.col("pos"))
    rows = chunks.withColumn("anchor", F.coalesce(F.first(big, ignorenulls=True).over(onward), F.last(big, ignorenulls=True).over(back), F.lit(-1).cast("long")))
    cols = [c for c in chunks.columns if c not in ("source", "pos", "text", "text_with_context")]
    context = "text_with_context" in chunks.columns
    member = F.struct("pos", "text", *(["text_with_context"] if context else []), *cols)
    out = rows.groupBy("source", "anchor").agg(F.sort_array(F.collect_list(member)).alias("all"))
    texts = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), "\n")
    out = out.withColumn("kept", F.coalesce(F.get(F.filter("all", lambda x: x["pos"] == F.col("anchor")), F.lit(0)), F.col("all")[0]))
    merged = [texts(F.col("all")).alias("text")]
    if context:
        # A chunk with tiny ones in front gets its header anew; tiny ones behind bring the first one's own header along.
        out = out.withColumn("front", F.filter("all", lambda x: x["pos"] <= F.col("kept.pos"))).withColumn("behind", F.filter("all", lambda x: x["pos"] > F.col("kept.pos")))
        front = F.when(F.size("front") > 1, with_context(F.col("source"), F.col("kept.chapter"), F.col("kept.section"), texts(F.col("front")))).otherwise(F.col("kept.text_with_context"))
        first = F.when(F.col("anchor") == -1, F.get("behind", F.lit(0))["text"]).otherwise(F.get("behind", F.lit(0))["text_with_context"])
        rest = F.when(F.size("behind") > 0, F.concat_ws("\n", first, F.when(F.size("behind") > 1, texts(F.slice("behind", 2, F.size("behind"))))))
        merged.append(F.concat_ws("\n", front, rest).alias("text_with_context"))
    return out.select("source", F.col("kept.pos").alias("pos"), *[F.col(f"kept.{c}").alias(c) for c in cols], *merged, "anchor", F.size("all").alias("n_merged"))


def split_oversized(chunks: DataFrame, limit: int = VIETNAMESE.sizes.oversized, paragraph: str = "\n\n") -> DataFrame:
    """Chunks over limit are packed anew by paragraphs, the first two lines of one with a table heading each part.

    Adds sub_index and pre_norm_parent_id (null where a chunk is left as it is). A long paragraph stays whole.
    """
    lines = F.split("text", "\n", -1)
    table = F.contains(F.col("text"), F.lit("|")) & (F.size(lines) >= 2)
    head = F.when(table, F.concat(F.array_join(F.slice(lines, 1, 2), "\n"), F.lit("\n"))).otherwise("")
    body = F.when(table, F.array_join(F.slice(lines, 3, F.size(lines)), "\n")).otherwise(F.col("text"))
    parts = F.transform(packed(F.split(body, paragraph, -1), limit, keep_blank=True), lambda p: F.concat(head, p))
    over = F.length("text") > limit
    rows = chunks.withColumn("parts", F.when(over, parts).otherwise(F.array("text"))).withColumn("over", over)
    rows = rows.select(*[c for c in rows.columns if c not in ("text", "parts")], F.posexplode("parts").alias("sub", "text"))
    parent = F.col("id") if "id" in chunks.columns else F.lit(None).cast("string")
    if "text_with_context" in chunks.columns:
        anew = with_context(F.col("source"), F.col("chapter"), F.col("section"), F.col("text"))
        rows = rows.withColumn("text_with_context", F.when(F.col("over"), anew).otherwise(F.col("text_with_context")))
    return rows.withColumn("sub_index", F.when(F.col("over"), F.col("sub"))).withColumn("pre_norm_parent_id", F.when(F.col("over"), parent)).drop("over")


def siblings(chunks: DataFrame, by: str) -> DataFrame:
    """(id, group key, rank in the group): who shares source and section (or chapter); lists are looked up, not stored.

    Storing each chunk's list would be quadratic in the group; sibling_lists() builds them where they are asked for.
    """
    within = Window.partitionBy("source", by).orderBy("n")
    return chunks.select("source", by, "n", "id", F.row_number().over(within).alias("rank"))


def sibling_lists(chunks: DataFrame, by: str, wanted: DataFrame | None = None) -> DataFrame:
    """id -> the ids of its group in order, itself left out. wanted: the ids asked for (all if none)."""
    asked = chunks if wanted is None else chunks.join(wanted.select("id").distinct(), "id", "left_semi")
    held = chunks if wanted is None else join_same(chunks, asked.select("source", by).distinct(), ["source", by], "left_semi")
    groups = held.groupBy("source", by).agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("all"))
    out = join_same(asked.select("id", "source", by), groups, ["source", by])
    return out.select("id", F.transform(F.filter("all", lambda x: x["id"] != F.col("id")), lambda x: x["id"]).alias("siblings"))
