"""Time to live as columns, for logs of plain writes that need no fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expiry_column(at_ms: Column, ttl_secs: Column, default_secs: int) -> Column:
    """The expiry of a write: null ttl_secs means the default, 0 (of either) never."""
    seconds = F.coalesce(ttl_secs, F.lit(default_secs)).cast("bigint")
    return F.when(seconds != 0, at_ms + seconds * 1000)
