"""Text and formatting expressions; each one returns a Column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# White space as str.split() sees it: the Unicode property plus the four ASCII separators.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A word character, and its complement with and without the line feed.
WORD_CHAR = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
NON_WORD_INLINE = r"[^\p{L}\p{N}_\n]"
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Fixed value: prefix of a verdict cache key.
CACHE_PREFIX = "llm_cache:"


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: str | Column) -> Column:
    """Trim white space of any kind from both ends."""
    return F.btrim(as_col(text), F.lit(SPACES))


def normalise(text: str | Column) -> Column:
    """Lower-case, collapse white space runs, trim."""
    return F.trim(F.regexp_replace(F.lower(as_col(text)), SPACE_RUN, " "))


def cache_key(text: str | Column) -> Column:
    return F.concat(F.lit(CACHE_PREFIX), F.sha2(normalise(text), 256))


def stable_string(column: str | Column, data_type: str) -> Column:
    """Engine-independent rendering of the whole value; NaN counts as missing.

    Numbers are written out in full with at least one decimal (``45000000.0``), or as Spark writes
    them where ten decimals do not hold them.
    """
    column = as_col(column)
    if data_type in ("double", "float"):
        number = F.when(~F.isnan(column), column)
        exact = number.try_cast("decimal(38,10)")
        shown = F.regexp_replace(exact.cast("string"), r"(\.\d+?)0+$", "$1")
        return F.when(exact.cast(data_type) == number, shown).otherwise(number.cast("string"))
    return column.cast("string")


def row_checksum(fields: Sequence[tuple[str, str]], delimiter: str = "") -> Column:
    """SHA-256 over the non-null ``(column, type)`` fields in order.

    An empty delimiter matches the established state; a non-empty one rules out that text moving
    between neighbouring fields goes unnoticed.
    """
    return F.sha2(F.concat_ws(delimiter, *[stable_string(name, kind) for name, kind in fields]), 256)


def combined_text(title: str | Column, description: str | Column) -> Column:
    """Title and description with one blank between, ends stripped, nulls as empty."""
    empty = F.lit("")
    return strip(F.concat(F.coalesce(as_col(title), empty), F.lit(" "), F.coalesce(as_col(description), empty)))


def preview(text: str | Column, length: int, suffix: str = "") -> Column:
    """First ``length`` characters, always followed by ``suffix``."""
    return F.concat(F.substring(as_col(text), 1, length), F.lit(suffix))


def preview_if_longer(text: str | Column, length: int, placeholder: str, suffix: str = "...") -> Column:
    """Whole text when short, shortened when long, placeholder when missing or empty."""
    text = as_col(text)
    return (
        F.when(text.isNull() | (text == ""), F.lit(placeholder))
        .when(F.length(text) > length, preview(text, length, suffix))
        .otherwise(text)
    )


def tokens(text: str | Column) -> Column:
    """Words of at least two characters from already normalised text."""
    return F.regexp_extract_all(as_col(text), F.lit(TOKEN), F.lit(0))


def terms(text: str | Column) -> Column:
    """All words followed by all pairs of neighbouring words.

    The pairs come from zipping the token array with itself shifted by one.
    """
    words = tokens(text)
    shifted = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    pairs = F.filter(
        F.zip_with(words, shifted, lambda left, right: F.concat(left, F.lit(" "), right)),
        lambda pair: pair.isNotNull(),
    )
    return F.concat(words, pairs)


def grouped_number(value: str | Column, decimals: int, unit: str = "", missing: str = "N/A") -> Column:
    """``1,234.5 unit`` with half-even rounding; null becomes ``missing``."""
    text = F.format_number(as_col(value).cast("double"), decimals)
    return F.coalesce(F.concat(text, F.lit(unit)), F.lit(missing))


def millions(value: str | Column) -> Column:
    return F.format_number(as_col(value) / 1e6, 1)


def duration(seconds: str | Column) -> Column:
    """``42s``, ``3m 7s`` or ``2h 5m``; null and zero give an empty string."""
    seconds = as_col(seconds)
    whole = F.floor(seconds).cast("bigint")
    return (
        F.when(seconds.isNull() | (seconds == 0), F.lit(""))
        .when(seconds < 60, F.concat(whole.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor((whole % 3600) / 60)))
    )


def rate(items_per_second: str | Column) -> Column:
    """Rate per second, or per minute when below one item a second."""
    per_second = as_col(items_per_second)
    return F.when(
        per_second < 1, F.concat(F.format_string("%.1f", per_second * 60), F.lit(" elem/perc"))
    ).when(per_second >= 1, F.concat(F.format_string("%.2f", per_second), F.lit(" elem/sec")))
