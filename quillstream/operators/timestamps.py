"""Mixed time notations, precisions and zones to one instant in UTC."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import instants, zones
from ..session import melt


def normalise_times(df: DataFrame, sites: DataFrame, keys: list[str], fields: list[str], site_key: str = "site_id") -> DataFrame:
    """One row for each non-null value of ``fields``: keys, ``field_name``,
    ``raw``, ``utc_ms``, ``status``, ``shape`` and ``zone_release``.

    ``sites`` gives ``time_zone`` and ``date_order`` by ``site_key``, for
    values that say nothing of their own. ``status`` is ``ok`` (then, and only
    then, ``utc_ms`` is set), ``ambiguous`` or ``nonexistent`` (a wall clock
    shown twice or never, or a date with two readings), ``incomplete`` (no time
    of day), ``impossible`` (no such date or time), ``no_zone`` or ``unread``.
    Edge cases: null values give no row, empty ones ``unread``; a row whose
    site is missing from ``sites`` is read as far as its value suffices;
    repeated rows stay repeated; other columns are ignored. Of repeated sites
    the least zone and order count.
    """
    tables = zones.load()
    shipped = df.sparkSession.sparkContext.broadcast(tables)  # bounded by the release: about 1 MB

    @F.pandas_udf("struct<utc_ms: bigint, status: string, shape: string>")
    def read(raw: pd.Series, zone: pd.Series, order: pd.Series) -> pd.DataFrame:
        return instants.read_instants(raw, zone, order, shipped.value)

    cells = melt(df, [*keys, site_key] if site_key not in keys else keys, fields)
    rules = sites.groupBy(site_key).agg(F.min("time_zone").alias("_zone"), F.min("date_order").alias("_order"))
    joined = cells.join(rules, site_key, "left")
    out = joined.withColumn("_t", read("raw", "_zone", "_order"))
    return out.select(*keys, "field_name", "raw", "_t.utc_ms", "_t.status", "_t.shape", F.lit(tables.version).alias("zone_release"))


def changed_times(normalised: DataFrame, keys: list[str]) -> DataFrame:
    """The determined instants of values not yet in canonical form."""
    canonical = F.col("raw").rlike(f"^{instants.CANONICAL.pattern}$") & ~F.col("raw").contains("\n")
    return normalised.filter((F.col("status") == instants.OK) & ~canonical).select(*keys, "field_name", "utc_ms")
