"""Progress of a running query, taken from Spark's own reports."""

from __future__ import annotations

import json

from pyspark.sql.streaming import StreamingQuery


def progress_report(query: StreamingQuery) -> list[dict]:
    """Rows, rate and observed metrics of each finished micro-batch; the trigger interval is the throttle."""
    reports = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    return [
        {
            "batch": p["batchId"],
            "rows": p["numInputRows"],
            "rows_per_second": p.get("processedRowsPerSecond"),
            "observed": {name: row if isinstance(row, dict) else row.asDict() for name, row in (p.get("observedMetrics") or {}).items()},
        }
        for p in reports
    ]
