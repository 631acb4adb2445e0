"""Number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number text: an integer, or a decimal, exponent, infinity or NaN; underscores may stand
# between digits and blanks around it. Suffixes such as 'd' and 'f' are no part of it.
_DIGITS = r"[0-9](?:_?[0-9])*"
INTEGER_RE = r"^[-+]?[0-9]+$"
NUMBER_RE = rf"(?i)^\s*[-+]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[-+]?{_DIGITS})?|inf|infinity|nan)\s*$"
#: as above, without blanks and underscores: a token of a text stream
TOKEN_RE = r"(?i)^[-+]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[-+]?[0-9]+)?|inf|infinity|nan)$"


def number_of(token: Column) -> Column:
    """DOUBLE of a token, else NULL."""
    return F.when(token.rlike(TOKEN_RE), token.try_cast("double"))


def loose_number_of(raw: Column) -> Column:
    """DOUBLE of a number text, else NULL."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(raw, r"^\s+|\s+$", "")), "_", "")
    return F.when(raw.rlike(NUMBER_RE), plain.try_cast("double"))
