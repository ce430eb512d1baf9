"""Column functions on text: cleaning, tokens, sentences, small JSON. Built-in expressions but for NFC.

Every function takes and returns Columns; order of the cleaning steps matters and `clean_text` keeps it.
"""
from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .rules import ABBREVIATIONS, ANSWER_TEXTS, CONTROL, OCR_PAGE_FIXES, VIETNAMESE, WORD_CLASS, WS, WS_INLINE, RuleSet


#: The characters of the class WS; to trim by a list takes no regular expression.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition (Spark has no built-in for it)."""
    return text.str.normalize("NFC")


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(WS_CHARS))


def replaced(text: Column, pairs) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def where_held(text: Column, part: str, use) -> Column:
    """use(text) if the text holds part, else the text: a plain search spares most texts a regular expression."""
    return F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit(part)), use(t)).otherwise(t))[0]


def tidy_space(text: Column) -> Column:
    """One space for runs of white space in a line, two line ends at most, lines stripped."""
    # Single spaces are what most text has: they are no match. Afterwards a line has one space at an end, or none.
    text = F.regexp_replace(text, f"[{WS_INLINE}]{{2,}}|[{WS_INLINE}&&[^ ]]", " ")
    text = where_held(text, "\n\n\n", lambda t: F.regexp_replace(t, "\n{3,}", "\n\n"))
    return F.trim(replaced(text, [(" \n", "\n"), ("\n ", "\n")]))


def fix_page(text: Column) -> Column:
    """Cleaning of one recognised page (after NFC)."""
    return strip(tidy_space(F.regexp_replace(replaced(text, OCR_PAGE_FIXES), CONTROL, "")))


def join_broken_lines(text: Column, lower: str) -> Column:
    """Lines broken between two lower-case letters (or after a comma) are joined; each letter takes part once."""
    # The line end comes first, the rarest of the three; one where the last match ended (\\G) has its letter taken.
    return F.regexp_replace(text, f"(?!\\G)\n(?<=[{lower},]\n)([{lower}])", " $1")


def expand_abbreviations(text: Column, pairs=ABBREVIATIONS) -> Column:
    """Stand-alone abbreviations become words, in order; not inside words, paths or times."""
    edge = f"[:/{WORD_CLASS}]"
    return reduce(lambda t, p: where_held(t, p[0], lambda x: F.regexp_replace(x, f"(?<!{edge}){re.escape(p[0])}(?!{edge})", p[1])), pairs, text)


def clean_text(text: Column, rules: RuleSet = VIETNAMESE) -> Column:
    """The document cleaning chain after NFC and before repeated lines go (operators.lines)."""
    text = F.regexp_replace(text, CONTROL, "")
    text = where_held(text, "---", lambda t: F.regexp_replace(t, f"---[{WS}]*{rules.page_word}[{WS}]+\\p{{Nd}}+/\\p{{Nd}}+[{WS}]*---", "\n"))
    text = replaced(text, [(s, "") for s in rules.stamps])
    text = join_broken_lines(replaced(text, rules.fixes), rules.lower)
    return expand_abbreviations(tidy_space(text), rules.abbreviations)


def tokens(text: Column) -> Column:
    """Lower-case words, as an array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{WORD_CLASS}]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces that end in . or ; before white space; each keeps its mark."""
    return F.split(text, f"(?<=[.;])[{WS}]+")


def header_line(source: Column, chapter: Column, section: Column) -> Column:
    """[source] - chapter - section; empty parts are left out."""
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(" - ", F.concat(F.lit("["), source, F.lit("]")), some(chapter), some(section))


def with_context(source: Column, chapter: Column, section: Column, text: Column) -> Column:
    return F.concat(header_line(source, chapter, section), F.lit("\n"), text)


def truncated(text: Column, limit: int, mark: str = "...") -> Column:
    return F.concat(F.substring(text, 1, limit), F.when(F.length(text) > limit, mark).otherwise(""))


def first_tokens(text: Column, limit: int = 2048) -> Column:
    """The first limit words with the white space before them: what a training row may hold at most."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{WS}]*[^{WS}]+"), F.lit(0)), 1, limit), "")


def page_text(page_no: Column, text: Column) -> Column:
    """A page's text, or the note that it could not be read."""
    before, after = ANSWER_TEXTS["failed_page"].split("{page}")
    return F.coalesce(F.when(text != "", text), F.concat(F.lit(before), page_no.cast("string"), F.lit(after)))


def json_part(reply: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket of a model's reply, code fences taken off; null without any."""
    bare = F.regexp_replace(F.regexp_replace(reply, f"```json[{WS}]*", ""), f"```[{WS}]*", "")
    return F.nullif(F.regexp_extract(bare, f"(?s){re.escape(opening)}.*{re.escape(closing)}", 0), F.lit(""))


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
