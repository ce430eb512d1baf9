"""Operators on the lines and pages of documents."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_text, strip


def drop_repeated_lines(text: Column, least: int = 3) -> Column:
    """Of each non-blank line (stripped) that a text holds least times or more, the first stays. No shuffle: arrays only.

    A document's lines are sorted by what they say, then by place. A line goes if the one before it says the same and
    it lies in a run of least equal ones; what stays is put back in order of place.
    """
    keyed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(strip(x).alias("k"), i.alias("i"), x.alias("line")))

    def staying(s: Column) -> Column:
        key = lambda j: F.get(s, j)["k"]
        in_run = lambda x, j: reduce(or_, [(key(j - least + 1 + t) == x["k"]) & (key(j + t) == x["k"]) for t in range(least - 1)])
        return F.filter(s, lambda x, j: (x["k"] == "") | ~F.coalesce((key(j - 1) == x["k"]) & in_run(x, j), F.lit(False)))

    kept = F.transform(F.array(F.sort_array(keyed)), staying)[0]
    placed = F.sort_array(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"))))
    return strip(F.array_join(F.transform(placed, lambda x: x["line"]), "\n"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(source, page_no, total_pages, text) -> (source, text): pages in order under their markers, a blank line between."""
    mark = F.concat(F.lit("--- Trang "), F.col("page_no").cast("string"), F.lit("/"), F.col("total_pages").cast("string"), F.lit(" ---\n"))
    part = F.struct("page_no", F.concat(mark, page_text(F.col("page_no"), F.col("text"))).alias("t"))
    return pages.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["t"]), "\n\n").alias("text"))
