"""Times that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The one form a load time has. A cast alone would also read ``2024`` or drop an offset.
LOAD_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"


def load_time(column: str = "timestamp") -> Column:
    """``yyyy-MM-dd HH:mm:ss`` as a time without zone; NULL for anything else."""
    text = F.col(column)
    return F.when(text.rlike(LOAD_TIME), text.try_cast("timestamp_ntz"))
