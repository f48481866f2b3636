"""Positions in raw text, for reports on records that do not parse."""

from __future__ import annotations

import json
import math
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideframe.storage import written


def error_context(text: Column, position: Column, window: int = 60) -> Column:
    """(line, col, snippet) of a position counted from 0: both from 1, and the text around it over a caret.

    Positions past the end mean the end. Counted in code points.
    """
    at = F.least(F.greatest(position, F.lit(0)), F.length(text))
    head = F.substring(text, F.lit(1), at)
    lines = F.split(head, "\n", -1)
    start = F.greatest(at - window, F.lit(0))
    around = F.substring(text, start + 1, at - start + F.least(F.length(text) - at, F.lit(window)))
    caret = F.concat(F.repeat(F.lit(" "), at - start), F.lit("^"))
    return F.struct(F.size(lines).alias("line"), (F.length(F.element_at(lines, -1)) + 1).alias("col"), F.concat_ws("\n", around, caret).alias("snippet"))


def coerced(text: Column) -> Column:
    """(kind, whole, real, word) of the text of an element: null where blank, a whole number, else a number, else the text without its margins."""
    t = F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))
    whole = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))
    real = F.when(whole.isNull() & t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    kind = F.when(t.isNull(), "null").when(whole.isNotNull(), "int").when(real.isNotNull(), "float").otherwise("text")
    return F.struct(kind.alias("kind"), whole.alias("whole"), real.alias("real"), F.when(kind == "text", t).alias("word"))


def iso_epoch(text: Column) -> Column:
    """Seconds since 1970 of an ISO time with Z or an offset; without one it is UTC; null if it is no time."""
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.unix_seconds(F.try_to_timestamp(zoned)))


def _plain(value: str | None):
    """As ``coerced`` has it; a number that JSON can't hold is text."""
    value = (value or "").strip()
    if re.fullmatch(r"[+-]?[0-9]+", value) and abs(int(value)) < 1 << 63:
        return int(value)
    if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", value) and math.isfinite(float(value)):
        return float(value)
    return value or None


def _told(element) -> object:
    """A dict of an element's children by local name, repeated names as a list; its coerced text if it has none."""
    out: dict = {}
    for child in element:
        out.setdefault(child.tag.rpartition("}")[2], []).append(_told(child))
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()} if out else _plain(element.text)


def xml_json(column: Column) -> Column:
    """The JSON of an XML element of any shape, null where it does not parse."""

    def one(text):
        try:
            return None if text is None else json.dumps(_told(ET.fromstring(text)), ensure_ascii=False)
        except ET.ParseError:
            return None

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(run, "string")(column)


def _leaves(value, key: str, out: list) -> list:
    for k, v in value.items() if isinstance(value, dict) else enumerate(value):
        _leaves(v, str(k), out) if isinstance(v, dict | list) else out.append((str(k), v))
    return out


def json_leaves(column: Column) -> Column:
    """Leaves of a JSON object of any depth as (last part of the path, value), without nulls, each pair once, in order."""

    def one(text):
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if not isinstance(value, dict | list):
            return None
        found = dict.fromkeys((k, v if isinstance(v, str) else json.dumps(v)) for k, v in _leaves(value, "", []) if v is not None)
        return [{"key": k, "value": v} for k, v in found]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(run, "array<struct<key:string,value:string>>")(column)


def leaf_rows(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys``, place, key, value: a row for every leaf of a JSON object or list of any depth, by the last part of its path.

    Each round opens one level of what is nested yet, all rows at once, until nothing is; the
    rounds are as many as the deepest text has levels. place holds the positions down to the
    leaf, so that sorting by it gives the order of the text. Numbers and truth values are text as in JSON; nulls,
    empty containers, and texts that don't parse or are no container have no leaves.
    """
    spark = rows.sparkSession
    kind = F.schema_of_variant("v")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    front = written(rows.select(*keys, F.array().cast("array<int>").alias("place"), F.try_parse_json(column).alias("v")).where(F.col("v").isNotNull() & nested), "level")
    out: list[DataFrame] = []
    while not front.isEmpty():
        inner = front.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        inner = inner.select(*keys, F.concat("place", F.array("pos")).alias("place"), F.coalesce("key", F.col("pos").cast("string")).alias("key"), F.col("value").alias("v"))
        inner = written(inner.withColumn("nested", nested), "level")
        out.append(inner.where(~F.col("nested") & (F.schema_of_variant("v") != "VOID")).select(*keys, "place", "key", F.variant_get("v", "$", "string").alias("value")))
        front = inner.where("nested").select(*keys, "place", "v")
    found = spark.createDataFrame([], f"{', '.join(f'`{k}` {dict(rows.dtypes)[k]}' for k in keys)}, place array<int>, key string, value string") if not out else out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def json_error(column: Column) -> Column:
    """Where a JSON text stops to parse, counted from 1, and why; nulls where it parses or is null."""

    def one(text):
        try:
            json.loads(text) if text is not None else None
        except json.JSONDecodeError as e:
            return e.lineno, e.colno, e.msg
        return None, None, None

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in texts], columns=["line", "col", "message"]).astype({"line": "Int32", "col": "Int32"})

    return F.pandas_udf(run, "struct<line:int,col:int,message:string>")(column)
