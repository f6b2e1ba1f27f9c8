"""The request log: outcome classes, filters and progress."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.functions.rows import count_where

# What the vendor's error codes and HTTP statuses mean for a request.
CODE_CLASSES = {
    -8: "auth_recoverable",
    -16: "auth_recoverable",
    -17: "auth_recoverable",
    -15: "auth_fatal",
    -50: "fatal",
    -51: "fatal",
    -53: "fatal",
    -99: "fatal",
    -300: "fatal",
    -352: "fatal",
    400: "fatal",
    -429: "rate_limited",
}
HTTP_CLASSES = {
    400: "fatal",
    401: "auth_fatal",
    403: "fatal",
    429: "rate_limited",
    500: "transient",
    502: "transient",
    503: "transient",
    504: "transient",
}
STATES = ["pending", "leased", "done", "empty", "failed", "skipped", "cancelled"]
OPEN_STATES = ["pending", "leased"]


def _lookup(value: Column, classes: Mapping[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for item in classes.items() for x in item])
    return F.try_element_at(table, value)


def classify(log: DataFrame) -> DataFrame:
    """Failed requests ``(status, code, http_status)`` with class, task state and flags.

    Precedence: no data, rate limit, 401, known code, known HTTP status, any other 5xx, fatal.
    """
    code, http = F.col("code").cast("int"), F.col("http_status").cast("int")
    limited = F.coalesce(http == 429, F.lit(False)) | F.coalesce(code == -429, F.lit(False))
    retry_class = (
        F.when(F.col("status") == "no_data", "empty")
        .when(limited, "rate_limited")
        .when(http == 401, "auth_fatal")
        .otherwise(
            F.coalesce(
                _lookup(code, CODE_CLASSES),
                _lookup(http, HTTP_CLASSES),
                F.when(http.between(500, 599), F.lit("transient")),
                F.lit("fatal"),
            )
        )
    )
    failed = log.where("status IS NULL OR status <> 'ok'").withColumn("retry_class", retry_class)
    klass = F.col("retry_class")
    return failed.withColumns(
        {
            "task_state": F.when(klass == "empty", "empty")
            .when(klass == "fatal", "failed")
            .otherwise("pending"),
            "consumes_attempt": klass == "transient",
            "pipeline_mode": F.when(klass == "rate_limited", "paused_rate").when(
                klass.isin("auth_recoverable", "auth_fatal"), "paused_auth"
            ),
            "check_symbol_encoding": F.coalesce(
                (klass == "fatal") & (code == -300), F.lit(False)
            ),
        }
    )


def recent(
    log: DataFrame, since: str | None = None, endpoint: str | None = None,
    outcome: str | None = None, limit: int = 100,
) -> DataFrame:
    """The newest requests that match, as a top-k."""
    out = log
    if since is not None:
        out = out.where(F.col("created_at") >= clock.ntz(since))
    if endpoint is not None:
        out = out.where(F.col("kind") == endpoint)
    if outcome is not None:
        out = out.where(F.col("state") == outcome)
    return out.orderBy(F.desc("created_at"), F.desc("task_id")).limit(limit)


def progress(log: DataFrame, per_minute: float) -> DataFrame:
    """Per job: requests by state, what is open, time left at a rate and usage totals."""
    counted = log.groupBy("job_id").agg(
        F.count("*").alias("total"),
        *[count_where(F.col("state") == s).alias(s) for s in STATES],
        F.coalesce(F.sum("requests_used"), F.lit(0)).alias("requests_used"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_written"),
        F.coalesce(F.sum("response_bytes"), F.lit(0)).alias("bytes_downloaded"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
    )
    open_tasks = F.col("pending") + F.col("leased")
    settled = F.col("total") - open_tasks
    elapsed = clock.local_seconds(F.col("finished_at")) - clock.local_seconds(F.col("started_at"))
    eta = F.bround(open_tasks / F.lit(per_minute / 60.0), 0).cast("bigint")
    return counted.withColumns(
        {
            "open": open_tasks,
            "eta_seconds": F.when(open_tasks > 0, eta),
            "tasks_per_minute": F.when(
                (settled > 0) & F.col("started_at").isNotNull(),
                F.round(settled / (F.greatest(elapsed, F.lit(1)) / F.lit(60.0)), 2),
            ),
        }
    ).drop("started_at", "finished_at")
