"""Values, headers and symbols as native column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Excel's error values, each with a message of our own.
ERROR_TEXTS = {
    "#BLOCKED!": "a resource the formula needs is not accessible",
    "#BUSY!": "still waiting for a service",
    "#CALC!": "the calculation has no result, as of an empty array",
    "#CONNECT!": "no connection to a service",
    "#DIV/0!": "divisor is zero or empty",
    "#FIELD!": "the record has no such field",
    "#GETTING_DATA": "data are still loading",
    "#N/A": "lookup found nothing",
    "#NAME?": "function or name not recognised",
    "#NULL!": "two ranges share no cell",
    "#NUM!": "numeric argument or result not allowed",
    "#REF!": "points at cells that were deleted",
    "#SPILL!": "cells in the way of an array result",
    "#UNKNOWN!": "data type this version cannot show",
    "#VALUE!": "argument has the wrong type",
}


def normal_header(text, fallback: Column | None = None) -> Column:
    """Lower case, every run of other than letters and digits one underscore, none at the ends."""
    text = F.col(text) if isinstance(text, str) else text
    got = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(got, F.lit("")) != "", got).otherwise(fallback if fallback is not None else F.lit("column"))


@pandas_udf(StringType())
def fold_header(texts: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark's own functions lack; for non-ASCII headers."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def display(value_type, v_str, v_num, v_bool) -> Column:
    """TRUE/FALSE, integral numbers without a fraction, else the text."""
    number = F.when(v_num == F.floor(v_num), v_num.cast("long").cast("string")).otherwise(v_num.cast("string"))
    return F.when(value_type == "bool", F.when(v_bool, "TRUE").otherwise("FALSE")).when(value_type == "number", number).otherwise(v_str)


def shorten(text, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis if some were cut."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(text.substr(1, limit - 1), F.lit("…")))


def snippet(text, pattern: str, around: int = 30, limit: int = 80) -> Column:
    """The first match with ``around`` characters on either side."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.regexp_instr(text, F.lit(pattern))
    n = F.length(F.regexp_substr(text, F.lit(pattern)))
    start = F.greatest(F.lit(1), at - around)
    stop = F.least(F.length(text), at + n - 1 + around)
    body = text.substr(start, stop - start + 1)
    whole = F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(stop < F.length(text), "…").otherwise(""))
    return F.when(at > 0, shorten(whole, limit))


def number_of(text) -> Column:
    """Struct(v_long, v_double): integral decimals are longs if they fit, others doubles; null if not finite."""
    text = F.col(text) if isinstance(text, str) else text
    d = text.try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    exact = text.try_cast("decimal(38,10)")
    whole = ok & (d == F.floor(d)) & (F.abs(d) < 9.2e18)
    return F.struct(F.when(whole, F.coalesce(exact.try_cast("long"), d.cast("long"))).alias("v_long"), F.when(ok & ~whole, d).alias("v_double"))


def serial_to_timestamp(serial, date1904: bool = False) -> Column:
    """Serial number of a workbook date; serials under 60 of the 1900 system are a day off, as 1900 counts as a leap year."""
    s = F.col(serial) if isinstance(serial, str) else serial
    day = F.floor(s).cast("int")
    base = F.lit("1904-01-01" if date1904 else "1899-12-30").cast("date")
    shift = F.lit(0) if date1904 else F.when((s < 60) & (s >= 1), 1).otherwise(0)
    seconds = F.round((s - F.floor(s)) * 86400).cast("int")
    return F.timestamp_add("SECOND", seconds, F.date_add(base, day + shift).cast("timestamp_ntz"))


def temporal_kind(text) -> Column:
    """datetime, time, date or null for an ISO text."""
    text = F.col(text) if isinstance(text, str) else text
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), "datetime")
        .when(text.rlike(r"^\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), "time")
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
    )


def normal_function(name) -> Column:
    """Upper case without @, an A1: prefix and the prefixes of newer functions."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), r"^@|^\$?[A-Z]{1,3}\$?[0-9]+:", ""), r"^(_XLFN\.|_XLWS\.|_XLUDF\.)+", "")


def url_label(url) -> Column:
    """The decoded last path segment without credentials, query or fragment."""
    url = F.col(url) if isinstance(url, str) else url
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    last = F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)
    return F.when(last != "", F.coalesce(F.try_url_decode(last), last)).otherwise("[none]")


def workbook_label(target) -> Column:
    """A known workbook suffix shows its file name in brackets, any other target a fixed label."""
    label = url_label(target)
    return F.when(label.rlike(r"(?i)\.(xlsx|xlsm|xltx|xltm|xls|xlsb)$"), F.concat(F.lit("["), label, F.lit("]"))).otherwise("[external-workbook]")


def sheet_id(name) -> Column:
    return F.concat(F.lit("sheet:"), name)


def region_id(sheet, n) -> Column:
    return F.concat(F.lit("region:"), sheet, F.lit(":"), n.cast("string"))


def column_id(sheet, n, header) -> Column:
    return F.concat(F.lit("col:"), sheet, F.lit(":"), n.cast("string"), F.lit(":"), header)


def block_id(sheet, n) -> Column:
    return F.concat(F.lit("fblock:"), sheet, F.lit(":"), n.cast("string"))


def name_id(name, scope) -> Column:
    return F.concat(F.lit("name:"), F.when(scope.isNull(), name).otherwise(F.concat(scope, F.lit("!"), name)))


def cell_id(sheet, ref) -> Column:
    return F.concat(F.lit("cell:"), sheet, F.lit("!"), ref)
