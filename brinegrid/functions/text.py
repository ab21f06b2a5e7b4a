"""Numbers in JSON and text, addresses of requests, times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern of the first number in a text.
_TEXT_NUMBER = r"[-+]?[0-9]*\.?[0-9]+"
_STRINGS = r'"(\\.|[^"\\])*"'
_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def json_first_number(text: Column) -> Column:
    """The first number in a JSON document, depth first in order of writing; strings and booleans are none. Null if there is none, or no JSON."""
    bare = F.regexp_replace(text, _STRINGS, '""')
    return F.when(F.try_parse_json(text).isNotNull(), F.regexp_extract(bare, _NUMBER, 0).try_cast("double"))


def json_first_number_or_flag(text: Column) -> Column:
    """As json_first_number, but true counts as 1 and false as 0."""
    bare = F.regexp_replace(text, _STRINGS, '""')
    hit = F.regexp_extract(bare, _NUMBER + "|true|false", 0)
    value = F.when(hit == "true", 1.0).when(hit == "false", 0.0).otherwise(hit.try_cast("double"))
    return F.when(F.try_parse_json(text).isNotNull(), value)


def text_first_number(text: Column) -> Column:
    return F.regexp_extract(text, _TEXT_NUMBER, 0).try_cast("double")


def year_in_name(name: Column, pattern: str = r"combined_(\d+)\.csv") -> Column:
    return F.regexp_extract(name, pattern, 1).try_cast("int")


def last_part(stem: Column, sep: str = "_") -> Column:
    return F.element_at(F.split(stem, sep), -1)


def utc_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plain_time(ts: Column) -> Column:
    """ISO without zone; microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


# The parameters of a feature-info request, in order; None where the value is that of the request.
_REQUEST = (
    ("SERVICE", "WMTS"),
    ("REQUEST", "GetFeatureInfo"),
    ("VERSION", "1.0.0"),
    ("LAYER", None),
    ("STYLE", ""),
    ("TILEMATRIXSET", None),
    ("TILEMATRIX", None),
    ("TILEROW", None),
    ("TILECOL", None),
    ("I", None),
    ("J", None),
    ("INFOFORMAT", None),
    ("FORMAT", "image/png"),
    ("TIME", None),
)


def feature_url(base: Column | str, layer: str, matrix_set: str, matrix: Column, col: Column, row: Column, i: Column, j: Column, time: Column, info: str = "application/json") -> Column:
    """The address of one lookup. Values are not percent-encoded; the base may already have a query part."""
    b = F.lit(base) if isinstance(base, str) else base
    own = {"LAYER": F.lit(layer), "TILEMATRIXSET": F.lit(matrix_set), "TILEMATRIX": matrix, "TILEROW": row, "TILECOL": col, "I": i, "J": j, "INFOFORMAT": F.lit(info), "TIME": time}
    rest = F.concat_ws("&", *[F.concat(F.lit(k + "="), F.lit(v) if v is not None else own[k].cast("string")) for k, v in _REQUEST])
    return F.concat(b, F.when(F.endswith(b, F.lit("?")), "").when(F.contains(b, F.lit("?")), "&").otherwise("?"), rest)


def encoded_parameters(params: dict[str, Column]) -> Column:
    """key=value pairs with percent-encoded values, joined by &."""
    return F.concat_ws("&", *[F.concat(F.lit(k + "="), F.url_encode(v.cast("string"))) for k, v in params.items()])


def thousands(n: Column, decimals: int = 0) -> Column:
    return F.format_number(n, decimals)


def fixed(x: Column, decimals: int = 3) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{decimals}f", x))
