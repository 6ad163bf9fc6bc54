"""Days of nanosecond times."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_NANOS_PER_DAY = 86_400 * 10**9


def day_of(nanos: str | Column) -> Column:
    """UTC calendar day of a column of nanoseconds since the epoch, whatever the session's time zone."""
    days = F.call_function("div", F.col(nanos) if isinstance(nanos, str) else nanos, F.lit(_NANOS_PER_DAY)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)
