"""Text and category functions over columns."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tesselon.functions.vectors import let

#: Labels that are written in capitals.
ACRONYMS = ("4k", "cd", "dvd", "pc", "rpg", "tv", "uhd", "vhs", "vr")
#: The lexicon of the default sentiment model.
POSITIVE_WORDS = ("amazing", "awesome", "excellent", "fun", "good", "great", "love")
NEGATIVE_WORDS = ("awful", "bad", "boring", "broken", "hate", "terrible", "worst")
#: A Java pattern for what Python's str.split() takes as white space.
SPACES = r"(?U)[\s\x1c-\x1f]+"


@pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def collapse(col: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col, SPACES, " "))


def clean_text(col: Column) -> Column:
    """Tags as spaces, then entities resolved, then white space collapsed. Only texts with an ampersand leave the JVM's own functions."""
    bare = F.regexp_replace(col, "<[^>]+>", " ")
    return collapse(F.when(F.contains(bare, F.lit("&")), html_unescape(bare)).otherwise(bare))


def variant_text(variant: Column, path: str) -> Column:
    """A field that may be missing, a scalar or a list, as one text (list elements with spaces between); missing is ''."""
    return F.coalesce(F.array_join(F.try_variant_get(variant, path, "array<string>"), " "), F.try_variant_get(variant, path, "string"), F.lit(""))


def join_text(value: Column) -> Column:
    """An array of strings joined with spaces (null elements left out); null is ''."""
    return F.coalesce(F.array_join(value, " "), F.lit(""))


def parse_price(text: Column) -> tuple[Column, Column]:
    """(price, missing): the number without dollar signs and commas; 0.0 and true where there is none."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, r"^[\s]+|[\s]+$", "")), "[$,]", "")
    number = F.when(bare.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), bare.try_cast("double"))
    return F.coalesce(number, F.lit(0.0)), number.isNull()


def normalize_category(col: Column) -> Column:
    """White space collapsed, each word capitalised, acronyms in capitals; null for null and blank."""
    word = lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    text = collapse(col)
    return F.when(text != "", F.array_join(F.transform(F.split(text, " "), word), " "))


def filter_categories(raw: Column, generic_roots: Sequence[str]) -> Column:
    """An array of labels in normal form, without generic roots and blanks, each once (ignoring case, the first kept); null is empty."""
    roots = sorted({" ".join(r.split()).lower() for r in generic_roots})
    labels = F.filter(F.transform(raw, normalize_category), lambda c: c.isNotNull() & ~F.lower(c).isin(*roots) if roots else c.isNotNull())
    first = F.aggregate(labels, F.array().cast("array<string>"), lambda done, c: F.when(F.exists(done, lambda d: F.lower(d) == F.lower(c)), done).otherwise(F.concat(done, F.array(c))))
    return F.coalesce(first, F.array().cast("array<string>"))


def filter_category_path(raw: Column, generic_roots: Sequence[str]) -> Column:
    """A path flattened to one text: its longest generic root prefix is taken off and the rest is the only label."""
    roots = sorted({" ".join(r.split()).lower() for r in generic_roots}, key=lambda r: (-len(r), r))
    norm = normalize_category(raw)
    rest = norm
    for root in reversed(roots):
        rest = F.when(F.startswith(F.lower(norm), F.lit(root + " ")), F.trim(F.substring(norm, F.lit(len(root) + 2), F.length(norm)))).otherwise(rest)
    keep = rest.isNotNull() & (rest != "") & ~F.lower(rest).isin(*roots) if roots else rest.isNotNull()
    return F.when(keep, F.array(rest)).otherwise(F.array().cast("array<string>"))


def last_label(categories: Column, generic_roots: Sequence[str]) -> Column:
    """The last category that isn't exactly a generic root; null if there is none."""
    kept = F.filter(categories, lambda c: c.isNotNull() & (F.trim(c) != "") & ~c.isin(*generic_roots) if generic_roots else c.isNotNull())
    return F.when(F.size(kept) > 0, F.element_at(kept, -1))


def lexicon_sentiment(text: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> Column:
    """A struct (label, score, positive_prob, negative_prob) from counts of exact lower-case tokens between white space."""
    tokens = F.split(collapse(F.lower(F.coalesce(text, F.lit("")))), " ")
    count = lambda own, words: F.size(F.filter(own, lambda t: t.isin(*words)))
    counts = let(tokens, lambda own: F.struct(count(own, positive).alias("pos"), count(own, negative).alias("neg")))

    def result(c: Column) -> Column:
        pos, neg, total = c["pos"], c["neg"], c["pos"] + c["neg"]
        p, n = (F.when(total == 0, F.lit(0.5)).otherwise(x / total) for x in (pos, neg))
        label = F.when(pos > neg, "POSITIVE").when(neg > pos, "NEGATIVE").otherwise("NEUTRAL")
        return F.struct(label.alias("sentiment_label"), (p - n).alias("sentiment_score"), p.alias("positive_prob"), n.alias("negative_prob"))

    return let(counts, result)


def optional_number(col: Column, kind: str) -> Column:
    """The number, or null for null and NaN; whole numbers are cut off, not rounded."""
    number = col.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), number.cast(kind))


def optional_text(col: Column, cap: int | None = None) -> Column:
    """The text up to ``cap`` characters; null stays null."""
    text = col.cast("string")
    return F.substring(text, 1, cap) if cap else text


def categories_to_string(col: Column, separator: str = "|") -> Column:
    """An array of labels joined, null and '' left out; null array gives ''."""
    return F.coalesce(F.array_join(F.filter(col, lambda c: c.isNotNull() & (c != "")), separator), F.lit(""))


def stable_seed(key: Column, base: int) -> Column:
    """A seed per key, the same in every process: the base plus the low 32 bits of the key's sha256."""
    return F.conv(F.right(F.sha2(key, 256), F.lit(8)), 16, 10).cast("bigint") + F.lit(base)
