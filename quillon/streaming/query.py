"""Queries of the language over streams.

A query compiles to one plan, so a table of the context can be a streaming DataFrame: selections, projections, UNION ALL
and joins with static tables run as they are; grouped queries run with a watermark of the input. What Spark rejects on
streams (TOP, ORDER BY without aggregation, EXCEPT ...) it rejects here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.query import Query
from ..sources.catalog import DataContext


def stream(context: DataContext, text: str, late: tuple[str, str] | None = None, table: str | None = None) -> DataFrame:
    """The query over streaming tables; ``late`` = (time column, how late rows may be) sets a watermark on ``table``."""
    if late and table:
        found = context.tables[table.upper()][0]
        context.add_table(table, found.frame.withWatermark(*late))
    return Query(context, text).execute()


def start(frame: DataFrame, name: str, checkpoint: str, mode: str = "append", form: str = "memory", **options) -> StreamingQuery:
    """Writes a streaming result; with the checkpoint a restart goes on where it stopped."""
    return frame.writeStream.format(form).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).options(**options).start()
