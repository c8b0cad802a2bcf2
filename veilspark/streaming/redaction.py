"""Continuous redaction: new rows of a stream are rewritten as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.detect import redact
from veilspark.plans.rules import RuleSet


def redact_stream(stream: DataFrame, out: str, checkpoint: str, rules: RuleSet | None = None, key: bytes | None = None) -> StreamingQuery:
    """Writes `stream` (with a text column) to Parquet with a redacted column; ends when all that is there is done.

    Rewriting is stateless, so a batch that runs again gives the same rows, and the sink's log keeps them once."""
    done = redact(stream, rules, key=key).drop("found", "text")
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
