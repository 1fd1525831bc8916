"""Parsing of pages as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.parse import Options, parse_html


def parse_stream(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, html_col: str = "html", url_col: str = "url", options: Options = Options()) -> StreamingQuery:
    """Parses a stream of pages batch by batch into ``sink``. A page's
    candidates are ranked in its own row, so the plan keeps no state; ``sink``
    gets each batch with its number and may be called again after a failure."""
    def each(batch: DataFrame, number: int) -> None:
        sink(parse_html(batch, html_col, url_col, options), number)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_stream(pages: DataFrame, path: str, checkpoint: str, html_col: str = "html", url_col: str = "url") -> StreamingQuery:
    """As a plain streaming projection into Parquet, exactly once."""
    made = parse_html(pages, html_col, url_col).select(url_col, "title", "description", "site_name", "locale", "canonical_url", "kind", "status")
    return made.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
