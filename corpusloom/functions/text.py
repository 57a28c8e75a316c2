"""Column functions on text: the only place of patterns that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"(?U)\w+(?:[-']\w+)*"
TERM_PATTERN = r"(?U)\w(?:[\w-]*\w)?"


def fold(c: Column) -> Column:
    """Caseless form; ß is the one letter of the supported languages that lower() leaves different."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def word_tokens(c: Column) -> Column:
    """Lexical index terms, with repetition: words that keep inner hyphens and apostrophes."""
    return F.regexp_extract_all(fold(c), F.lit(WORD_PATTERN), F.lit(0))


def term_set(c: Column) -> Column:
    """Distinct terms for set similarity."""
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit(TERM_PATTERN), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 1 when both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def suffix(c: Column) -> Column:
    """Lower-case extension without the dot; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(base_name(c), r"^.+\.([^.]+)$", 1))


def preview(c: Column, n: int = 140) -> Column:
    """At most n characters, the last of them an ellipsis where the text was cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(n - 1))), F.lit("…")))


def number(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded, 0 where b is 0."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def truth(c: Column, default: bool = True) -> Column:
    """Boolean cell of a text file: blank is the default."""
    t = F.lower(F.trim(c))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(default)).otherwise(t.isin("1", "true", "yes", "y"))


def listed(c: Column) -> Column:
    """Comma-separated cell as an array of trimmed, non-empty values."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def stable_json(m: Column) -> Column:
    """JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def uuid5_url(name: Column) -> Column:
    """UUID version 5 in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# Fixed values that results depend on: names a file can't have on some systems.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *[f"{device}{i}" for device in ("COM", "LPT") for i in range(1, 10)])


def safe_name(c: Column, default: str = "batch_qa", most: int = 120) -> Column:
    """A file or folder name: what no system allows and white space become one underscore, reserved names get one in front."""
    joined = F.regexp_replace(F.regexp_replace(F.trim(c), r'[<>:"/\\|?*\x00-\x1f\s]+', "_"), "_+", "_")
    name = F.regexp_replace(joined, r"^[ ._]+|[ ._]+$", "")
    cut = F.regexp_replace(F.left(name, F.lit(most)), r"[ ._]+$", "")
    return F.when(F.upper(name).isin(*RESERVED_NAMES), F.concat(F.lit("_"), name)).otherwise(F.coalesce(F.nullif(cut, F.lit("")), F.lit(default)))


def slug(c: Column, default: str = "question", most: int = 64) -> Column:
    """Letters, digits, dots and hyphens of a text; everything else in a run is one underscore."""
    name = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}\p{M}_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.left(name, F.lit(most)), F.lit("")), F.lit(default))


def iso_time(ts: Column) -> Column:
    """A time as ISO 8601 in UTC with microseconds: 2024-05-01T06:07:08.000009+00:00."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def parsed_time(c: Column) -> Column:
    """The time in an ISO 8601 text with or without an offset (then UTC), a blank or a T between date and time; null where there is none."""
    t = F.regexp_replace(F.trim(c), r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    t = F.regexp_replace(t, r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})?$", "$1:00$2")
    whole = F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$"))
    placed = F.when(F.regexp_like(t, F.lit(r"(?:Z|[+-]\d{2}:\d{2})$")), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(whole, placed).try_cast("timestamp")


def elapsed_seconds(start: Column, end: Column, digits: int = 6) -> Column:
    """Seconds from start to end, never below 0."""
    return F.greatest(F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, digits), F.lit(0.0))
