"""Column functions over text and cell values."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use names it; an alias is put in again at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def plain_letters(c: Column) -> Column:
    """No zero-width characters, ligatures as letters."""
    c = F.translate(c, "".join(K.ZERO_WIDTH), "")
    for ligature, letters in K.LIGATURES.items():
        c = F.replace(c, F.lit(ligature), F.lit(letters))
    return c


def plain_marks(c: Column) -> Column:
    """Plain spaces, quotes and dashes."""
    return F.translate(c, "\u00a0“”‘’–—", " \"\"''--")


def clean_unicode(c: Column) -> Column:
    """Compatibility forms and odd punctuation as plain ones; only texts beyond ASCII go through Python."""
    plain = plain_letters(c)
    return plain_marks(F.when(plain.rlike(r"[^\x00-\x7F]"), _nfkc(plain)).otherwise(plain))


def null_if_token(c: Column) -> Column:
    """NULL for the tokens that stand for a missing value."""
    return F.when(F.lower(F.trim(c)).isin(K.NULL_TOKENS), F.lit(None)).otherwise(c)


def typed_cell(c: Column, code_field: bool = False) -> Column:
    """struct(value, value_type) of a cleaned cell: null, integer, float, boolean or string."""
    x = null_if_token(collapse(c))
    low = F.lower(x)
    kind = F.when(x.isNull(), "null")
    if not code_field:
        kind = kind.when(x.rlike(r"^-?[0-9]+$"), "integer").when(x.rlike(r"^-?[0-9]+\.[0-9]+$"), "float")
    kind = kind.when(low.isin("yes", "true", "y", "no", "false", "n"), "boolean").otherwise("string")
    value = F.when(kind == "boolean", F.when(low.isin("yes", "true", "y"), "true").otherwise("false")).otherwise(x)
    return F.struct(value.alias("value"), kind.alias("value_type"))


def province(c: Column) -> Column:
    """The full name of a province; other values stay."""
    table = F.create_map(*[F.lit(x) for kv in K.PROVINCES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), c)


def snake_case(c: Column) -> Column:
    """A header as a column name: words split at spaces, hyphens and camel humps, joined by underscores."""
    c = F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_\s-]", "")
    c = F.regexp_replace(c, r"[\s-]+", "_")
    c = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    c = F.regexp_replace(F.lower(c), r"_+", "_")
    c = F.regexp_replace(c, r"^_|_$", "")
    return F.when(c == "", "column").otherwise(c)


def clean_code(c: Column) -> Column:
    """The digits of a classification code, without a year prefix."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^20[0-9]{2}-", ""), "[^0-9]", "")


def nqf_level(c: Column) -> Column:
    """The level from 1 to 10 that a text names, else NULL."""
    n = F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")
    return F.when(n.between(1, 10), n)


def comparable(c: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


def split_items(c: Column) -> Column:
    """The items of a cell that lists several, in order, trimmed, repeats included."""
    parts = F.split(c, r"[;\n•·]+")
    return F.filter(F.transform(parts, lambda x: collapse(x)), lambda x: x != "")


def distinct_items(c: Column) -> Column:
    """struct(items, repeats): first occurrences whatever their case, and the later ones."""
    items = split_items(c)
    keys = F.transform(items, lambda x: F.lower(x))
    first = F.filter(items, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
    later = F.filter(items, lambda x, i: F.array_position(keys, F.lower(x)) != i + 1)
    return F.struct(F.coalesce(first, F.array().cast("array<string>")).alias("items"), F.coalesce(later, F.array().cast("array<string>")).alias("repeats"))


def has_word(c: Column, words: list[str]) -> Column:
    """Whether one of the words occurs between word boundaries."""
    return c.rlike(r"\b(" + "|".join(words) + r")\b")


def has_part(c: Column, parts: list[str]) -> Column:
    """Whether one of the parts occurs anywhere."""
    return c.rlike("|".join(parts))


def first_word_of(c: Column, words: list[str]) -> Column:
    """The first entry of words that occurs in the text; the order is the list's."""
    return F.coalesce(*[F.when(c.rlike(rf"\b{w}\b"), F.lit(w)) for w in words])


#: Words of institutions. Fixed values.
INSTITUTIONS = ["tvet", "college", "campus", "centre", "center", "institution", "school", "academy", "university"]


def repair_bleed(title: Column, items: Column) -> Column:
    """struct(title, items): words of a title that wrapped into the list cell go back to the title.

    Before the first institution word only its own name may stand; two words or more before it mean
    that all but the last belong to the title. A first item of up to four words without an
    institution word or a digit belongs to the title as a whole.
    """
    words = "|".join(INSTITUTIONS)
    found = items.rlike(rf"(?i)\b({words})\b")
    prefix = F.when(found, F.regexp_extract(items, rf"(?is)^(.*?)\b(?:{words})\b", 1)).otherwise("")
    rest = F.substring(items, F.length(prefix) + 1, F.length(items))
    bits = F.filter(F.split(F.regexp_replace(prefix, r"^[ ;,\t\n]+|[ ;,\t\n]+$", ""), r"\s+"), lambda w: w != "")
    n = F.size(bits)
    wrapped = found & (n >= 2)
    parts = F.split(items, "[;\\n•·]")
    first = F.trim(F.get(parts, F.lit(0)))
    lone = (first != "") & ~F.lower(first).rlike(words) & (F.size(F.split(first, r"\s+")) <= 4) & ~first.rlike("[0-9]")
    others = F.trim(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "; "))
    new_title = F.when(wrapped, F.trim(F.concat_ws(" ", title, F.array_join(F.slice(bits, 1, F.greatest(n - 1, F.lit(0))), " ")))).when(lone, F.trim(F.concat_ws(" ", title, first))).otherwise(title)
    new_items = F.when(wrapped, F.trim(F.concat_ws(" ", F.get(bits, n - 1), rest))).when(lone, others).otherwise(items)
    return F.struct(new_title.alias("title"), new_items.alias("items"))
