"""Event-study and media-pressure analytics over daily panels, on Spark.

Every operator takes and returns a DataFrame keyed by ``series_id`` and
``date``.  One row per (series, calendar day) is the grain of every panel, so
a window partitioned by series is bounded by the calendar; only the raw
records below that grain are unbounded and they are always pre-aggregated
with ``groupBy`` before any ordered work starts.
"""

from pulsepanel.functions.index import (  # noqa: F401
    CALIB_FULL,
    CALIB_TRAIN,
    historic_percentile,
    pressure_index,
    pressure_index_train,
    resolve_calibration,
    zone,
    zone_short,
)

__version__ = "0.1.0"
