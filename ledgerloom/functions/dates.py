"""Reading dates out of printed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date shapes in the order they are tried.
DAY_FIRST = r"(?U)\b\d{1,2}/\d{1,2}/\d{4}"
ISO = r"(?U)\b\d{4}-\d{2}-\d{2}(?!\d)"
NAMED_MONTH = r"(?U)\b(\d{1,2})-([A-Z]{3})[A-Z]?-(\d{4})"

# Month names, English and Spanish.
MONTHS = {
    "JAN": "1", "ENE": "1", "FEB": "2", "MAR": "3", "APR": "4", "ABR": "4", "MAY": "5",
    "JUN": "6", "JUL": "7", "AUG": "8", "AGO": "8", "SEP": "9", "SET": "9", "OCT": "10",
    "NOV": "11", "DEC": "12", "DIC": "12",
}


def parse_date(text: Column) -> Column:
    """First date of the first shape that occurs; an impossible day gives NULL."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    named = F.concat_ws(
        "/",
        F.regexp_extract(text, NAMED_MONTH, 1),
        F.coalesce(F.element_at(months, F.regexp_extract(text, NAMED_MONTH, 2)), F.lit("x")),
        F.regexp_extract(text, NAMED_MONTH, 3),
    )
    return (
        F.when(text.rlike(DAY_FIRST), F.try_to_date(F.regexp_extract(text, DAY_FIRST, 0), "d/M/yyyy"))
        .when(text.rlike(ISO), F.try_to_date(F.regexp_extract(text, ISO, 0), "yyyy-MM-dd"))
        .when(text.rlike(NAMED_MONTH), F.try_to_date(named, "d/M/yyyy"))
    )
