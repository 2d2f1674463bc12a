"""Sensor event lines <-> typed columns (wire format ``timestamp,sensor,Sensor <n>,value``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.vectors import fixed5

# Fixed values of the wire format (must equal the sender's format).
WIRE_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"  # millisecond UTC timestamp with a literal Z
PARSE_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSX"   # same text; X reads the Z as UTC
SENSOR_NAME_PREFIX = "Sensor "
N_FIELDS = 4

# Reject reasons (``status`` column of parse_event_lines).
OK, CONTROL = "ok", "control"
BAD_FIELDS, BAD_TYPE, BAD_TIME, BAD_RANGE = "bad_fields", "bad_type", "bad_time", "bad_range"


def sensor_name(sensor: Column) -> Column:
    """P10: ``Sensor <n>``."""
    return F.concat(F.lit(SENSOR_NAME_PREFIX), sensor.cast("string"))


def format_ts_utc(ts: Column) -> Column:
    """Millisecond ISO text in UTC, independent of the session time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), WIRE_TS_FORMAT)


def encode_event(ts: Column, sensor: Column, value: Column) -> Column:
    """P5: one wire line per reading."""
    return F.concat_ws(
        ",",
        format_ts_utc(ts),
        sensor.cast("string"),
        sensor_name(sensor),
        fixed5(value),  # same text as %.5f, faster
    )


def event_fields(line: Column) -> dict[str, Column]:
    """P1 field extraction.  ANSI-safe: ``get`` and ``try_*`` never raise, so Catalyst may
    reorder these expressions with the shape filter freely."""
    f = F.split(line, ",", -1)  # limit -1 keeps a trailing empty field
    return {
        "n_fields": F.size(f),
        "ts": F.try_to_timestamp(F.get(f, 0), F.lit(PARSE_TS_FORMAT)),
        "sensor": F.get(f, 1).try_cast("int"),
        "name": F.get(f, 2),
        "value": F.get(f, 3).try_cast("double"),
    }


def parse_status(n_fields: Column, ts: Column, sensor: Column, value: Column,
                 n_sensors: int | Column | None = None) -> Column:
    """Why a line is kept or rejected.  A negative sensor number is the end-of-stream control
    record (P8); sensor 0 or above ``n_sensors`` is out of range."""
    st = (
        F.when(n_fields != N_FIELDS, F.lit(BAD_FIELDS))
        .when(sensor.isNull() | value.isNull(), F.lit(BAD_TYPE))
        .when(sensor < 0, F.lit(CONTROL))
        .when(ts.isNull(), F.lit(BAD_TIME))
        .when(sensor == 0, F.lit(BAD_RANGE))
    )
    if n_sensors is not None:
        limit = n_sensors if isinstance(n_sensors, Column) else F.lit(int(n_sensors))
        st = st.when(sensor > limit, F.lit(BAD_RANGE))
    return st.otherwise(F.lit(OK))



def sentinel_line(ts: Column) -> Column:
    """The end-of-stream record the sender appends after its last reading."""
    return encode_event(ts, F.lit(-1), F.lit(0.0))
