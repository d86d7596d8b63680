"""Column expressions for the project's ids.

An id is a prefix and a number. Case, blanks around, the separator and leading
zeros do not matter; a null or a value without a digit is no id (null here).
Inside plans an id is its number (8 bytes instead of a padded string); the
canonical text is made only for results.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = {"CARD": 9, "MERCH": 5, "DEV": 9}


def id_number(col, prefix: str) -> Column:
    """Number of an id of the given prefix, or null. Numbers of more than 18 digits are no ids."""
    col = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_extract(col, rf"^[\s\p{{Z}}]*(?i:{prefix})[^A-Za-z0-9]*([0-9]+)[\s\p{{Z}}]*$", 1)
    return digits.try_cast("bigint")


def id_text(col, prefix: str) -> Column:
    """Canonical text of an id number: the prefix, an underscore and at least WIDTH digits."""
    col = F.col(col) if isinstance(col, str) else col
    digits = col.cast("string")
    width = F.greatest(F.lit(WIDTH[prefix]), F.length(digits))
    return F.when(col.isNotNull(), F.concat(F.lit(f"{prefix}_"), F.lpad(digits, width, F.lit("0"))))


def card_numbers(cards) -> Column:
    """Sorted distinct card numbers of a list of card ids; elements that are no id are left out, a null list is empty."""
    cards = F.col(cards) if isinstance(cards, str) else cards
    numbers = F.array_compact(F.transform(cards, lambda c: id_number(c, "CARD")))
    return F.coalesce(F.array_sort(F.array_distinct(numbers)), F.array().cast("array<bigint>"))


#: The same rules as a DuckDB expression, for oracles.
def sql_id(col: str, prefix: str) -> str:
    width = WIDTH[prefix]
    digits = f"TRY_CAST(NULLIF(regexp_extract({col}, '^\\s*(?i:{prefix})[^A-Za-z0-9]*([0-9]+)\\s*$', 1), '') AS BIGINT)"
    return f"CASE WHEN {digits} IS NOT NULL THEN '{prefix}_' || lpad(CAST({digits} AS VARCHAR), greatest({width}, length(CAST({digits} AS VARCHAR)))::INT, '0') END"
