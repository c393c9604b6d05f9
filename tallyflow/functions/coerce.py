"""Text to typed column; whatever does not parse becomes NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a plain or scientific number is made of, and the spellings
# of infinity. Anything else a bare cast would accept (type suffixes as in ``12d``,
# hexadecimal, ``nan``) needs a letter that is not among them.
NUMBER_CHARACTERS = "0123456789+-.eE \t\n\r\f\v"
INFINITIES = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")

ISO_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"

DEFAULT_TIMESTAMP_FORMATS = ("M/d/yyyy", "iso")

# Wide enough for every 64-bit integer, with places to see that nothing follows the point.
_WHOLE_NUMBER = "decimal(38,18)"


def parse_timestamp(text: Column, formats=DEFAULT_TIMESTAMP_FORMATS) -> Column:
    """First format that matches, as TIMESTAMP_NTZ.

    ``iso`` and ``M/d/yyyy`` (each with an optional time of day) never pass through
    the session time zone. Any other entry is a Spark datetime pattern.
    """
    return F.coalesce(*[_parse_one_format(text, fmt) for fmt in formats])


def _parse_one_format(text: Column, fmt: str) -> Column:
    if fmt == "iso":
        return F.when(text.rlike(ISO_PATTERN), text.try_cast("timestamp_ntz"))
    if fmt == "M/d/yyyy":
        return _month_first(F.trim(text))
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def _month_first(text: Column) -> Column:
    """Moves the year to the front and leaves the checking to the cast."""
    month = F.substring_index(text, "/", 1)
    day = F.substring_index(F.substring_index(text, "/", 2), "/", -1)
    rest = F.substring_index(text, "/", -1)
    three_parts = F.length(month) + F.length(day) + F.length(rest) + 2 == F.length(text)
    year_ends = (F.length(rest) == 4) | F.substring(rest, 5, 1).isin(" ", "T")
    iso = F.concat(
        F.substring(rest, 1, 4), F.lit("-"), month, F.lit("-"), day, rest.substr(F.lit(5), F.length(rest))
    )
    return F.when(three_parts & year_ends, iso.try_cast("timestamp_ntz"))


def number_in(text: Column) -> Column:
    """Double of a numeric text; a finite literal too large for one comes out infinite."""
    number = text.try_cast("double")
    only_number_characters = F.translate(text, NUMBER_CHARACTERS, "") == ""
    return F.when(only_number_characters, number).when(
        F.lower(F.trim(text)).isin(*INFINITIES), number
    )


def without_overflow(number: Column, text: Column) -> Column:
    """NULL where an infinity was not written as one."""
    infinite = F.abs(number) == F.lit(float("inf"))
    return F.when(~infinite | F.lower(text).contains("inf"), number)


def price_from(number: Column, text: Column, finite_only: bool = False) -> Column:
    if finite_only:
        return F.when(F.abs(number) < F.lit(float("inf")), number)
    return without_overflow(number, text)


def parse_price(text: Column, finite_only: bool = False) -> Column:
    return price_from(number_in(text), text, finite_only)


def parse_user_id(text: Column, strict: bool = False) -> Column:
    """Bigint. Exact for all 64-bit integers; ``7.0`` and ``1e3`` are whole, so accepted.

    A fractional id is NULL, or an error with ``strict=True``; it is never truncated.
    """
    number = number_in(text)
    # The decimal keeps the digits that a double rounds away near the ends of the range.
    exact = F.when(number.isNotNull(), text.try_cast(_WHOLE_NUMBER))
    whole = (number == F.floor(number)) & (exact == F.floor(exact))
    parsed = F.coalesce(text.try_cast("bigint"), F.when(whole, exact.try_cast("bigint")))
    if not strict:
        return parsed
    failure = F.raise_error(F.concat(F.lit("user_id is not an integer: "), text))
    return F.when(number.isNotNull() & parsed.isNull(), failure.cast("bigint")).otherwise(parsed)
