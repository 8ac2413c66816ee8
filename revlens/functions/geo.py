"""Point texts such as ``POINT(121.0 24.8)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions.text import strip
from revlens.schema import FILL_LAT_MIN, FILL_LON_MIN, FILL_SPAN


def normalised(coord: Column) -> Column:
    return F.upper(F.nullif(coord, F.lit("")))


def _numbers(coord: Column) -> Column:
    bare = strip(F.regexp_replace(F.upper(coord), r"POINT|\(|\)", ""))
    return F.split(bare, r"\s+")


def _number(coord: Column, index: int) -> Column:
    parts = _numbers(coord)
    return F.when(
        F.upper(coord).startswith("POINT") & (F.size(parts) >= 2), F.get(parts, F.lit(index)).try_cast("double")
    )


def longitude(coord: Column) -> Column:
    """First number; NULL unless the text is a point with two parts."""
    return _number(coord, 0)


def latitude(coord: Column) -> Column:
    return _number(coord, 1)


def _offset(url: Column, salt: Column, axis: str) -> Column:
    digest = F.md5(F.concat_ws("|", url, salt.cast("string"), F.lit(axis)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (FILL_SPAN + 1)


def _degrees(units: Column) -> Column:
    whole = F.floor(units / 100000).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((units % 100000).cast("string"), 5, "0"))


def synthetic_point(url: Column, salt: Column) -> Column:
    """A repeatable point inside the fill box, five decimals; each further salt adds two, so there is always room."""
    lon = F.lit(FILL_LON_MIN).cast("long") + _offset(url, salt, "lon")
    lat = F.lit(FILL_LAT_MIN).cast("long") + _offset(url, salt, "lat")
    more = [F.substring(F.md5(F.concat_ws("|", url, salt.cast("string"), F.lit(f"{axis} digits"))), 1, 32) for axis in ("lon", "lat")]
    more = [F.substring(F.translate(m, "abcdef", "012345"), F.lit(1), F.least(2 * salt, F.lit(32))) for m in more]
    return F.concat(F.lit("POINT("), _degrees(lon), more[0], F.lit(" "), _degrees(lat), more[1], F.lit(")"))
