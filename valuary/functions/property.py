"""Expressions over parcel, unit, segment and location columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuary.functions.parse import lookup, strip, token_or

# Residential category prefixes and the segment each belongs to.
SEGMENT_BY_PREFIX = {
    "01": "SINGLE_FAMILY",
    "02": "SINGLE_FAMILY",
    "03": "SINGLE_FAMILY",
    "07": "WALKUP",
    "08": "ELEVATOR",
    "09": "WALKUP",
    "10": "ELEVATOR",
    "12": "WALKUP",
    "13": "ELEVATOR",
    "14": "SMALL_MULTI",
    "15": "SMALL_MULTI",
    "16": "SMALL_MULTI",
    "17": "SMALL_MULTI",
}

# Words that look like a unit but are part of a street name.
STREET_WORDS = (
    "STREET", "ST", "AVENUE", "AVE", "ROAD", "RD", "BOULEVARD", "BLVD", "PLACE", "PL", "LANE", "LN",
    "DRIVE", "DR", "COURT", "CT", "TERRACE", "TER", "PARKWAY", "PKWY", "WAY", "NORTH", "SOUTH", "EAST", "WEST",
)

# Borough codes, display names and catalogue names.
BOROUGH_NAMES = {"1": "Manhattan", "2": "Bronx", "3": "Brooklyn", "4": "Queens", "5": "Staten Island"}
BOROUGH_KEYS = {"1": "MANHATTAN", "2": "BRONX", "3": "BROOKLYN", "4": "QUEENS", "5": "STATEN_ISLAND"}

# City centre used for distances, kilometres per degree.
CENTER_LAT, CENTER_LON, KM_PER_DEGREE = 40.7831, -73.9712, 111.0


def category_prefix(category: Column) -> Column:
    return F.substring(category.cast("string"), 1, 2)


def segment(category: Column) -> Column:
    """Segment of a building class category, OTHER when its prefix is unknown or null."""
    return F.coalesce(lookup(SEGMENT_BY_PREFIX, category_prefix(category)), F.lit("OTHER"))


# An absent-value word standing alone, a unit marker in front, and what no unit holds are dropped; the rest must not be a
# street word.
_NO_UNIT = r"^(?:(?:NAN|NONE|NULL)$|(?:APT|APARTMENT|UNIT)\s*)|[^A-Z0-9\-]"
_UNIT = rf"^(?!(?:{'|'.join(STREET_WORDS)})$).+$"
_STRICT_UNIT = rf"^(?!(?:{'|'.join(STREET_WORDS)})$)(?:PH.*|.*\d.*)$"


def unit_token(c: Column, strict: bool) -> Column:
    """Normalised unit such as 3B or PH-2; null for blanks and street words.

    `strict` also demands a digit or a PH prefix, for units guessed from an address.
    """
    token = F.regexp_replace(F.upper(strip(c)), _NO_UNIT, "")
    # The first of all matches is null where there is none; `nullif` would write out and work the whole chain twice.
    matches = F.regexp_extract_all(token, F.lit(_STRICT_UNIT if strict else _UNIT), F.lit(0))
    return F.try_element_at(matches, F.lit(1))


def unit_from_address(address: Column) -> Column:
    """Unit written at the end of an address: text after the last comma, else an APT/UNIT/# suffix."""
    text = strip(address)
    after_comma = F.regexp_extract(text, r",\s*([^,]+)\s*$", 1)
    marked = F.regexp_extract(text, r"(?i)(?:APT|APARTMENT|UNIT|#)\s*([A-Z0-9\-]+)\s*$", 1)
    return F.coalesce(unit_token(after_comma, strict=True), unit_token(marked, strict=True))


def borough_digits(borough: Column) -> Column:
    """First run of digits in a borough value, else its text, `__missing__` when null."""
    text = F.coalesce(borough.cast("string"), F.lit("__missing__"))
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")), text)


def borough_name(borough: Column) -> Column:
    """Display name of a borough code; other text is kept."""
    return F.coalesce(lookup(BOROUGH_NAMES, borough.cast("string")), borough.cast("string"))


def upper_key(c: Column, default: str | None = None) -> Column:
    """Upper-case identifier with inner whitespace as underscores."""
    text = strip(c.cast("string")) if default is None else token_or(c, default)
    return F.regexp_replace(F.upper(text), r"\s+", "_")


def borough_key(borough: Column) -> Column:
    text = strip(borough.cast("string"))
    return F.when(text.isNull() | (borough.cast("string") == ""), F.lit("UNKNOWN")).otherwise(
        F.coalesce(lookup(BOROUGH_KEYS, text), upper_key(text))
    )


def zip5(c: Column) -> Column:
    digits = F.regexp_replace(c.cast("string"), r"\D", "")
    return F.when(F.length(digits) >= 5, F.substring(digits, 1, 5))


def grid_cell(lat: Column, lon: Column, size: float = 0.01) -> Column:
    """Equal-angle cell id `floor(lat/size):floor(lon/size)`, null where a coordinate is null."""
    cell = F.concat_ws(":", F.floor(lat / F.lit(size)).cast("string"), F.floor(lon / F.lit(size)).cast("string"))
    return F.when(lat.isNotNull() & lon.isNotNull(), cell)


def distance_to_center_km(lat: Column, lon: Column) -> Column:
    """Equirectangular distance to the city centre."""
    north = (lat - F.lit(CENTER_LAT)) * F.lit(KM_PER_DEGREE)
    east = (lon - F.lit(CENTER_LON)) * F.lit(KM_PER_DEGREE) * F.lit(math.cos(math.radians(CENTER_LAT)))
    return F.sqrt(north * north + east * east)


def building_age(year_built: Column, as_of_year: int = 2025) -> Column:
    """Years since construction: future years count as 0, ages above 300 (no year known) as 100."""
    age = F.lit(as_of_year) - year_built
    return F.when(age < 0, 0).when(age > 300, 100).otherwise(age)


def price_per_sqft(price: Column, sqft: Column) -> Column:
    return F.when(sqft > 0, price / sqft)
