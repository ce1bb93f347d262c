"""Pure Column rules: safe numbers, rounding, number text, threshold buckets.

Every function takes and returns ``pyspark.sql.Column`` objects, so they stay
JVM-side inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_ROUND_GUARD = 1e15  # floor() returns bigint; keep the argument far from its range


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN becomes SQL NULL once, at ingest: Spark orders NaN above +inf."""
    c = col(c)
    return F.when(~F.isnan(c), c)


#: Decimal numbers as Python's ``float`` reads them; the engine's own cast also takes
#: type suffixes (``1.5d``) and hexadecimal floats.
NUMBER = (r"^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?"
          r"|(?i:inf|infinity|nan))$")


def to_double(c: str | Column) -> Column:
    """Parse text or number to double; unparseable, missing and NaN become null."""
    c = col(c)
    text = strip_ws(c.cast("string"))
    parsed = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    # typeof is a constant: only the branch for the column's type stays in the plan
    return nan_to_null(F.when(F.typeof(c) == "string", parsed).otherwise(c.try_cast("double")))


def strict_double(c: str | Column) -> Column:
    """Parsed double of a text; anything that is no number (a missing or blank cell too) is
    an error that names the text."""
    c = col(c)
    text = strip_ws(c)
    parsed = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    wrong = F.raise_error(F.concat(F.lit("could not convert to a number: "), F.coalesce(c, F.lit("nothing"))))
    return F.when(parsed.isNotNull(), parsed).otherwise(wrong.cast("double"))


def round_half_up(c: str | Column, decimals: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d; the same IEEE steps in every engine.

    Infinite and very large values pass through unchanged; null stays null.
    """
    c = col(c)
    m = float(10 ** decimals)
    return F.when(F.abs(c) < _ROUND_GUARD, F.floor(c * m + 0.5) / m + F.lit(0.0)).otherwise(c)


def safe(c: str | Column, decimals: int = 2) -> Column:
    """Parsed, rounded float or null (missing, unparseable or NaN)."""
    return round_half_up(to_double(c), decimals)


def number_text(c: str | Column) -> Column:
    """Shortest text of a double (``85.0``, ``0.46``, ``12345678.0``, ``1e-05``); null stays
    null.  The engine's own text has exponents from 1e7 up and below 1e-3."""
    c = col(c)
    text, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1)
    digits = F.replace(power, F.lit("-"), F.lit(""))
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    science = F.concat(mantissa, F.lit("e"), sign, F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))
    return (F.when(((size >= 1e7) & (size < 1e16)) | ((size < 1e-3) & (size >= 1e-4)), plain)
            .when(text.contains("E"), science).otherwise(text))


def safe_display(c: str | Column, decimals: int = 2) -> Column:
    """Rounded number as text, or ``N/A``."""
    return F.coalesce(number_text(safe(c, decimals)), F.lit(fixed.MISSING_NUMBER))


def safe_gt(c: str | Column, threshold: float) -> Column:
    """safe(v) > t with missing values false; compares the 2-decimal value."""
    return F.coalesce(safe(c) > F.lit(threshold), F.lit(False))


def energy_bucket(c: str | Column) -> Column:
    hi, mid, low = fixed.ENERGY_LABELS
    return (F.when(safe_gt(c, fixed.ENERGY_HIGH), hi)
            .when(safe_gt(c, fixed.ENERGY_MID), mid)
            .otherwise(low))


def track_mood(c: str | Column) -> Column:
    hi, mid, low = fixed.TRACK_MOOD_LABELS
    return (F.when(safe_gt(c, fixed.VALENCE_HIGH), hi)
            .when(safe_gt(c, fixed.VALENCE_MID), mid)
            .otherwise(low))


def artist_mood(avg_valence: str | Column) -> Column:
    """Bucket on an already-rounded average; null (all missing) is the lowest label."""
    v = col(avg_valence)
    hi, mid, low = fixed.ARTIST_MOOD_LABELS
    return (F.when(F.coalesce(v > fixed.VALENCE_HIGH, F.lit(False)), hi)
            .when(F.coalesce(v > fixed.VALENCE_MID, F.lit(False)), mid)
            .otherwise(low))


def cell_text(c: str | Column, null_text: str = fixed.MISSING_CELL) -> Column:
    """String cell as it appears in generated text; a missing cell prints ``nan``."""
    return F.coalesce(col(c).cast("string"), F.lit(null_text))


def meta_number(c: str | Column) -> Column:
    """Metadata numeric: safe value, missing becomes 0."""
    return F.coalesce(safe(c), F.lit(0.0))


def meta_number_text(c: str | Column) -> Column:
    """Metadata numeric as text: ``safe(v) or 0`` prints ``0`` for missing and zero."""
    v = col(c)
    return F.when(v.isNull() | (v == 0), F.lit("0")).otherwise(number_text(v))


def fixed_decimals(c: str | Column, decimals: int) -> Column:
    """``%.{d}f`` after half-up rounding, so every engine prints the same digits."""
    return F.format_string(f"%.{decimals}f", round_half_up(c, decimals))


def strip_ws(c: str | Column) -> Column:
    """Remove leading and trailing white space of any script (``trim`` removes spaces only)."""
    return F.regexp_replace(col(c), rf"^[{WHITE}]+|[{WHITE}]+\z", "")


WHITE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def routing_pattern() -> str:
    return "|".join(fixed.ROUTING_SIGNALS)


def routes_to_tfidf(question: str | Column) -> Column:
    """True when the lowercased question contains any routing signal as a substring."""
    return F.coalesce(F.lower(col(question)).rlike(routing_pattern()), F.lit(False))
