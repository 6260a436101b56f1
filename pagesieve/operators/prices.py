"""Price rows. No shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.operators.rows import RowPattern, page_rows

# A currency is a sign or three capital letters, before the number or after it.
_CURRENCY = r"\p{Sc}|[A-Z]{3}"
# Commas, dots or blanks group by three; a comma before one or two last digits is a
# decimal mark. A single dot is always a decimal point, so "1.350" is 1.35.
_NUMBER = "|".join(
    [
        r"\d{1,3}+(?:,\d{3})++(?:\.\d{1,6}+)?+",
        r"\d{1,3}+(?: \d{3})++(?:[.,]\d{1,2}+)?+",
        r"\d{1,3}+(?:\.\d{3})++,\d{1,2}+",
        r"\d{1,24}+(?:,\d{1,2}+|\.\d{1,6}+)?+",
    ]
)
# A trailing "+" means "from".
_PRICE = (
    rf"\A(?:(?:({_CURRENCY})\s*+({_NUMBER}))|({_NUMBER})(?:\s*+({_CURRENCY}))?+)\s*+(\+?+)\z"
)
_PART = "\x01"
AMOUNT = "decimal(30,6)"


def price_rows(pages: DataFrame, pattern: RowPattern) -> DataFrame:
    """``page_id, pos, name, currency, amount, open_ended``.

    A row whose price cannot be read keeps its name, with NULL for the rest.
    """
    parts = F.split(
        F.regexp_replace("value", _PRICE, _PART + _PART.join(f"${i}" for i in range(1, 6))), _PART, -1
    )
    rows = page_rows(pages, pattern).withColumn("parts", parts)
    readable = (F.size("parts") == 6) & ~F.col("value").contains(_PART)
    part = lambda i: F.get("parts", F.lit(i))
    number, sign = F.concat(part(2), part(3)), F.concat(part(1), part(4))
    # What is not the last mark, or a comma with three digits after it, groups.
    plain = F.regexp_replace(number, r" |,(?=\d{3})|\.(?=.*,)", "")
    return rows.select(
        "page_id",
        "pos",
        "name",
        F.when(readable, F.nullif(sign, F.lit(""))).alias("currency"),
        F.when(readable, F.replace(plain, F.lit(","), F.lit(".")).try_cast(AMOUNT)).alias("amount"),
        F.when(readable, part(5) == "+").alias("open_ended"),
    )
