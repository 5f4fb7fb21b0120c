"""How levels are stretched for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

#: Where the median lands, and the bounds of the shown range in dB.
MEDIAN_AT = 0.25
MIN_RANGE_DB = 36.0
MAX_RANGE_DB = 84.0
SILENCE_DB = -100.0


def display_floor(peak_db, median_db) -> Column:
    peak, median = col(peak_db), col(median_db)
    wanted = (median - peak * MEDIAN_AT) / (1 - MEDIAN_AT)
    return F.greatest(F.lit(SILENCE_DB), F.least(F.greatest(wanted, peak - MAX_RANGE_DB), peak - MIN_RANGE_DB))


def scale_db(db, peak_db, median_db) -> Column:
    """0 at the display floor, 1 at the peak."""
    floor, db = display_floor(peak_db, median_db), col(db)
    return F.when(db <= floor, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (db - floor) / F.greatest(F.lit(1.0), col(peak_db) - floor)))
