"""Reading values out of the JSON attribute columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAP = "map<string,string>"
EVENTS = (
    "array<struct<name:string,time_unix_nano:bigint,attributes:string,"
    "dropped_attributes_count:bigint>>"
)
LINKS = (
    "array<struct<trace_id:string,span_id:string,trace_state:string,attributes:string,"
    "dropped_attributes_count:bigint,flags:bigint>>"
)


def json_key(json: Column | str, key: str) -> Column:
    """Text of one top-level key; the key may contain dots."""
    return F.get_json_object(json, f"$['{key}']")


def json_fields(json: Column | str, keys) -> Column:
    """Struct with the text of several top-level keys, parsed once.

    Use this rather than repeated json_key calls when a query needs more than
    one key: each json_key parses the document again. It also accepts the
    NaN and Infinity literals some writers leave in their JSON.
    """
    layout = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    return F.from_json(json, layout)


def as_bigint(text: Column) -> Column:
    """Tolerant integer cast: '12.5' rounds half up, '1e3' is 1000, junk is NULL."""
    return text.try_cast("decimal(38,0)").try_cast("bigint")


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_text(*texts: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[non_empty(t) for t in texts])


def attribute_map(json: Column | str) -> Column:
    """All keys as text. Text that is no JSON object comes back under 'raw'."""
    json = F.col(json) if isinstance(json, str) else json
    raw = F.when(json.isNull() | (json == ""), F.create_map().cast(MAP)).otherwise(
        F.create_map(F.lit("raw"), json)
    )
    # FAILFAST is unavailable per row, so an object is told apart by its first character
    parsed = F.when(F.ltrim(json).startswith("{"), F.from_json(json, MAP))
    return F.coalesce(parsed, raw)


def _array(json: Column | str, layout: str) -> Column:
    json = F.col(json) if isinstance(json, str) else json
    # a lone object would parse as an array of one
    parsed = F.when(F.ltrim(json).startswith("["), F.from_json(json, layout))
    return F.coalesce(parsed, F.array().cast(layout))


def events_array(json: Column | str) -> Column:
    """Typed span events; anything that is no JSON array is the empty array."""
    return _array(json, EVENTS)


def links_array(json: Column | str) -> Column:
    return _array(json, LINKS)
