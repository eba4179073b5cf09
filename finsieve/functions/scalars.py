"""Column expressions: cleaning, coding, geometry, text. All stay in codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from finsieve import vocab

HOUR_US = 3_600 * 1_000_000
DAY_US = 24 * HOUR_US

# All characters Unicode counts as white space; trimming by set needs no regex.
_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_OFFSET = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


# --- missing values, codes, amounts -----------------------------------------------------
def is_missing(col: Column) -> Column:
    """Null, NaN text or blank (Unicode white space counts as blank)."""
    return col.isNull() | (strip(col) == "")


def filled(col: Column) -> Column:
    """The value, or null when it is missing."""
    return F.when(~is_missing(col), col)


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(_SPACE))


def normal_code(col: Column) -> Column:
    return F.upper(strip(col))


def normal_payment_type(col: Column) -> Column:
    return F.translate(F.lower(strip(col)), "- ", "__")


def lookup(table: Mapping[str, object]) -> Column:
    """A literal map column."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def category_code(col: Column, vocabulary: Iterable[str]) -> Column:
    """Position in the vocabulary, 0 when unknown."""
    codes = {name: code for code, name in enumerate(vocabulary)}
    return F.coalesce(F.try_element_at(lookup(codes), col), F.lit(0)).cast("tinyint")


def translate_category(col: Column, table: Mapping[str, str]) -> Column:
    """Raw label to canonical code; anything else is unknown."""
    return F.coalesce(F.try_element_at(lookup(table), col), F.lit(vocab.UNKNOWN))


def valid_amount(col: Column) -> Column:
    """The amount as a double when it is finite and positive, else null."""
    value = col.try_cast("double")
    ok = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < F.lit(float("inf")))
    return F.when(ok, value)


def scaled_amount(col: Column, factor: float = vocab.AMOUNT_SCALE) -> Column:
    """Amount times factor, two decimals, halves to even."""
    return F.rint(col * F.lit(float(factor)) * 100.0) / 100.0


# --- time --------------------------------------------------------------------------------
def has_offset(text: Column) -> Column:
    return text.rlike(_OFFSET)


def utc_timestamp(text: Column, naive_is_utc: bool) -> Column:
    """ISO text to timestamp. Text without an offset is UTC, or null when not allowed."""
    text = strip(text)
    zoned = text.rlike(r"\d[T ]\d") & has_offset(text)
    parsed = F.when(zoned, text.try_cast("timestamp"))
    if naive_is_utc:
        parsed = F.when(zoned, parsed).when(
            text.rlike(r"\d[T ]\d"), F.concat(text, F.lit("Z")).try_cast("timestamp")
        ).otherwise(F.concat(text, F.lit("T00:00:00Z")).try_cast("timestamp"))
    return parsed


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def utc_hour(ts: Column) -> Column:
    return F.pmod(F.floor(micros(ts) / HOUR_US), F.lit(24)).cast("tinyint")


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.pmod(F.floor(micros(ts) / DAY_US) + 3, F.lit(7)).cast("tinyint")


# --- identifiers ----------------------------------------------------------------------------
def clean_iban(col: Column) -> Column:
    """Upper case without spaces; null when shorter than 15 characters."""
    text = F.upper(F.regexp_replace(strip(col), " ", ""))
    return F.when(F.length(text) >= 15, text)


def is_tr_iban(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^TR\d{24}$"), F.lit(False))


def stable_id(prefix: str, *key: Column) -> Column:
    """``PREFIX-`` and 12 upper-case hex digits, the same for the same key."""
    text = F.concat_ws("\u001f", *[k.cast("string") for k in key])
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(text, 256), 1, 12)))


def short_label(col: Column) -> Column:
    return F.concat(F.substring(col, 1, 12), F.lit("..."))


def alert_title(fraud_type: Column) -> Column:
    return F.concat(F.initcap(F.translate(fraud_type, "_", " ")), F.lit(" Detected"))


def is_fraud_mark(fraud_type: Column) -> Column:
    return ~F.coalesce(fraud_type, F.lit("none")).isin("none", "")


# --- numbers --------------------------------------------------------------------------------
def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_lon), F.lit(2.0))
    return 2 * vocab.EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def city_point(city: Column) -> Column:
    """struct(lat, lon) of a known city, else null. The table is a literal of 26 rows."""
    points = F.create_map(
        *[
            x
            for name, (lat, lon) in vocab.CITY_COORDINATES.items()
            for x in (F.lit(name), F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")))
        ]
    )
    return F.try_element_at(points, city)


# --- text --------------------------------------------------------------------------------
def normal_name(col: Column) -> Column:
    """Lower case, word characters and single spaces only."""
    words = F.regexp_replace(F.lower(col), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(words, r"(?U)\s+", " "))


def name_words(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda w: w != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """0-100 for two normalised names: equal, contained, or share of common words."""
    words_a, words_b = name_words(a), name_words(b)
    longest = F.greatest(F.size(words_a), F.size(words_b))
    overlap = F.size(F.array_intersect(words_a, words_b))
    return (
        F.when(a == b, 100.0)
        .when(F.contains(a, b) | F.contains(b, a), 90.0)
        .when((F.size(words_a) == 0) | (F.size(words_b) == 0), 0.0)
        .otherwise(overlap / longest * 100.0)
    )


def found_keywords(text: Column, words: Iterable[str]) -> Column:
    """The dictionary words contained in the whole text, in dictionary order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in words]
    return F.array_compact(F.array(*hits))


def repaired_evidence(text: Column, item: str) -> Column:
    """JSON list kept, ``{"items": [...]}`` unwrapped, anything else an empty list."""
    empty = F.from_json(F.lit("[]"), f"array<{item}>")
    head = F.substring(F.ltrim(text), 1, 1)
    as_list = F.when(head == "[", F.from_json(text, f"array<{item}>"))
    wrapped = F.when(head == "{", F.from_json(text, f"items array<{item}>")["items"])
    return F.coalesce(as_list, wrapped, empty)
