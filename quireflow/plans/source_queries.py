"""Files and streams."""

from __future__ import annotations

from quireflow.sources import files, lift
from quireflow.streaming import arrivals

from . import sql as S
from .registry import query


@query()
def file_properties(spark, d):
    """The smallest tables' files; the store that they are in needs only Spark's reader."""
    return files.properties(spark, f"{d}/region.parquet").unionByName(files.properties(spark, f"{d}/nation.parquet"))


@query(f"WITH {S.FEATURES} SELECT doc_id, line_no, line_type FROM features")
def streamed_line_types(spark, d):
    return arrivals.run_to_end(arrivals.line_types(arrivals.table_stream(spark, d, "documents")), spark)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    """The windows of the event stream; over a finished table all of them are closed."""
    return arrivals.windowed_events(lift.read(spark, d, "events"))
