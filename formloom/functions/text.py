"""Text functions: canonical forms, label matching, value parts."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: White space as Unicode has it; Java's plain \s is ASCII only.
SPACE = r"(?U)\s+"


@lru_cache(maxsize=1)
def _unfolded() -> tuple[str, str]:
    """Characters that upper and then lower case leave otherwise than full folding does, and what they fold to: one to one each."""
    found = {"ς": "σ"}  # lower case writes it at a word's end
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]):
        cased = c.upper().lower()
        if cased != c.casefold() and len(cased) == len(c.casefold()):
            found.update((x, y) for x, y in zip(cased, c.casefold(), strict=True) if x != y and not x.isascii())
    return "".join(found), "".join(found.values())


def casefold(v: Column) -> Column:
    """Full Unicode case folding. Upper and then lower case does most of it; ASCII texts need lower case alone."""
    # Something must stand between both cases, or the optimizer drops the inner one.
    cased = F.lower(F.replace(F.upper(v), F.lit("\u1e9e"), F.lit("SS")))
    return F.when(v.rlike(r"^[\x00-\x7F]*\z"), F.lower(v)).otherwise(F.translate(cased, *_unfolded()))


def canonical_text(v: Column) -> Column:
    """Case-folded text in which runs of anything but letters, numbers and _ are one space."""
    return F.trim(F.regexp_replace(casefold(v), r"[^\p{L}\p{N}_]+", " "))


def word_tokens(v: Column) -> Column:
    """Distinct case-folded words of letters and numbers, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(casefold(v), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; not symmetric, as its inputs have roles. What it notes of a ``b`` serves all rows that share it."""
    out = pd.Series([None] * len(a), dtype="float64")
    for y, rows in a.groupby(b, sort=False):
        matcher = SequenceMatcher(None, "", y)
        for at, x in rows.items():
            if x is not None:
                matcher.set_seq1(x)
                out[at] = matcher.ratio()
    return out


def direct_alias_score(n: Column, t: Column) -> Column:
    """The exact and containment arms of the alias score, over canonical text and alias; null where only the ratio decides."""
    contains = F.least(F.lit(0.98), F.length(t) / F.greatest(F.length(n), F.lit(1)) + F.lit(0.35))
    return F.when(n == t, F.lit(1.0)).when(F.contains(n, t), contains)


def ratio_bound(n: Column, t: Column) -> Column:
    """An upper bound of the ratio, so that hopeless pairs skip the Python function: characters that the other text has at all can match."""
    common = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    return 2.0 * F.least(common(n, t), common(t, n)) / F.greatest(F.length(n) + F.length(t), F.lit(1))


def group_alias_score(n: Column, t: Column) -> Column:
    """A group label may have text after it on its line."""
    return F.when(n == t, F.lit(1.0)).when(F.startswith(n, F.concat(t, F.lit(" "))), F.lit(0.96))


def squeezed(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, SPACE, " "))


def value_part(v: Column, part: Column) -> Column:
    """The whole value, its first token, or the remaining ones (null if there are none)."""
    s = squeezed(v)
    first = F.substring_index(s, " ", 1)
    rest = F.when(F.contains(s, F.lit(" ")), F.substring(s, F.length(first) + 2, F.length(s)))
    return F.when(F.length(s) > 0, F.when(part == "first_token", first).when(part == "remaining_tokens", rest).otherwise(s))


def same_line_suffix(text: Column, aliases: Column) -> Column:
    """What follows a label on its own line: aliases are tried longest first, found without regard to case.

    ``aliases`` is an array ordered by length descending, ties in blueprint order.
    """
    after = F.transform(aliases, lambda a: _suffix(text, a))
    return F.get(F.filter(after, lambda x: F.length(x) > 0), F.lit(0))


def _suffix(text: Column, alias: Column) -> Column:
    at = F.position(F.lower(alias), F.lower(text))
    return F.when(at > 0, F.regexp_replace(F.substring(text, at + F.length(alias), F.length(text)), "^[ :\\-–—\\t]+", ""))


def text_supports_value(text: Column, value: Column) -> Column:
    """A value is supported by text that contains it, or all of its tokens of more than one character."""
    n, v = canonical_text(text), canonical_text(value)
    parts = F.filter(F.split(v, " "), lambda x: F.length(x) > 1)
    words = F.split(n, " ")
    return (F.length(v) > 0) & (F.contains(n, v) | ((F.size(parts) > 0) & F.forall(parts, lambda x: F.array_contains(words, x))))


def safe_label(label: Column, confidence: Column) -> Column:
    """A label for drawing: ASCII only, 48 characters, and the confidence in two digits."""
    return F.concat(F.left(F.regexp_replace(label, r"[^\x00-\x7F]", "?"), F.lit(48)), F.lit(" "), F.format_string("%.2f", confidence))


def label_colour(label: Column) -> Column:
    """One of ten colours by the label's digest."""
    return F.conv(F.substring(F.sha2(label, 256), 1, 2), 16, 10).cast("int") % 10


def squeezed_error(message: Column, most: int = 240) -> Column:
    """A message on one line, cut to ``most`` characters."""
    return F.left(squeezed(message), F.lit(most))


def camel(name: Column) -> Column:
    """snake_case as camelCase."""
    parts = F.split(name, "_")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))), ""))


def to_camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in tail)


def safe_error(message: str, most: int = 240) -> str:
    return " ".join(message.split())[:most]
