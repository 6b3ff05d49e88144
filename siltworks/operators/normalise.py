"""Records whose fields are only known from the data: maps of raw texts become typed, comparable values beside what they were."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import text as X


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda values: values if values is None else [v if v is None else unicodedata.normalize("NFKC", v) for v in values])


def parsed(c: Column) -> Column:
    """map(field, raw text) of a JSON object with any fields; nested values stay JSON, other texts are NULL."""
    return F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})


def _wide(text: Column) -> Column:
    """Whether a text has characters beyond ASCII."""
    return F.octet_length(text) != F.length(text)


def cleaned(values: Column) -> Column:
    """Texts in compatibility form with plain marks and single spaces; only lists with a text beyond ASCII go through Python."""
    plain = F.transform(values, lambda v: F.when(_wide(v), X.plain_letters(v)).otherwise(v))
    forms = F.coalesce(_nfkc_each(X.bound(plain, lambda p: F.when(F.exists(p, lambda v: F.coalesce(_wide(v), F.lit(False))), p))), plain)
    return F.transform(forms, lambda v: X.collapse(F.when(_wide(v), X.plain_marks(v)).otherwise(v)))


def code_field(field: Column) -> Column:
    """Whether values of a field are codes, which keep leading zeros and are never numbers."""
    low = F.lower(field)
    hit = F.lit(False)
    for part in K.CODE_FIELD_PARTS:
        hit = hit | F.contains(low, F.lit(part))
    return hit


def normalised(record: Column) -> Column:
    """map(field, struct(value, kind, changed, raw)) of a map of raw texts.

    kind is null, integer, float, boolean or string. Whole numbers lose leading zeros, except in fields for codes;
    yes and no words are true and false; regions have their full names. changed says whether the value
    differs from the raw text; a null and an empty raw text do not count as changed.
    """
    regions = F.create_map(*[F.lit(x) for kv in K.PROVINCES.items() for x in kv])

    def cell(p: Column) -> Column:
        field, raw, text, low = p["field"], p["raw"], p["text"], p["low"]
        code = code_field(field)
        region = F.when(F.lower(field).rlike("prov|region"), F.try_element_at(regions, low))
        whole, part = text.rlike("^-?[0-9]+$") & ~code, text.rlike(r"^-?[0-9]+\.[0-9]+$") & ~code
        yes, no = low.isin("yes", "true", "y"), low.isin("no", "false", "n")

        def out(value: Column, kind: str, changed: Column) -> Column:
            return F.struct(value.cast("string").alias("value"), F.lit(kind).alias("kind"), changed.alias("changed"), raw.alias("raw"))

        number = F.regexp_replace(F.regexp_replace(text, "^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")
        return (
            F.when(text.isNull(), out(F.lit(None), "null", F.lit(False)))
            .when(low.isin(K.NULL_TOKENS), out(F.lit(None), "null", F.regexp_replace(raw, r"(?U)\s+", "") != ""))
            .when(whole, out(number, "integer", raw != text)).when(part, out(text, "float", raw != text))
            .when(yes, out(F.lit("true"), "boolean", raw != "True")).when(no, out(F.lit("false"), "boolean", raw != "False"))
            .otherwise(X.bound(region, lambda r: out(F.coalesce(r, text), "string", F.coalesce(r != text, text != raw)))))

    def cells(m: Column) -> Column:
        pairs = F.arrays_zip(m["fields"].alias("field"), m["raw"].alias("raw"), m["text"].alias("text"), F.transform(m["text"], lambda t: F.lower(t)).alias("low"))
        return F.map_from_arrays(m["fields"], F.transform(pairs, cell))

    texts = F.struct(F.map_keys(record).alias("fields"), F.map_values(record).alias("raw"), cleaned(F.map_values(record)).alias("text"))
    return F.when(record.isNotNull(), X.bound(texts, cells))


def as_json(values: Column) -> Column:
    """The JSON object of a normalised record, numbers and booleans without quotes; parse_json makes it a VARIANT."""
    def quoted(c: Column) -> Column:
        inside = F.to_json(F.array(c))
        return F.substring(inside, F.lit(2), F.length(inside) - 2)

    def member(e: Column) -> Column:
        v = e["value"]
        text = F.when(v["kind"] == "null", F.lit("null")).when(v["kind"] == "string", quoted(v["value"]))
        # a fraction may begin with several zeros, which JSON does not allow
        text = text.when(v["kind"] == "float", F.regexp_replace(v["value"], "^(-?)0+(?=[0-9])", "$1")).otherwise(v["value"])
        return F.concat(quoted(e["key"]), F.lit(":"), text)

    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(values), member), ","), F.lit("}"))


def as_variant(values: Column) -> Column:
    """A normalised record as one VARIANT, from which variant_get takes typed fields by path."""
    return F.parse_json(as_json(values))
