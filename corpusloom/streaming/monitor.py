"""Live monitoring of a request stream (ts, user_id, ok, latency_ms)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.evaluate import alerts, health

KEEP = 100
ROLLING = "service string, n bigint, rolling_ms double"
STATE = "held array<double>"


def windowed_health(requests: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Health and alerts of each window of event time; rows later than the watermark are dropped."""
    w = requests.withWatermark("ts", late).withColumn("window", F.window("ts", window))
    return alerts(health(w, ["window"]))


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session, requests): activity separated by gaps of event time."""
    s = requests.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session"))
    return s.agg(F.count(F.lit(1)).alias("requests"))


def rolling(requests: DataFrame) -> DataFrame:
    """(service, n, rolling_ms): after every batch, the mean of each service's last KEEP successful latencies; a bounded state for each service."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for b in batches:
            b = b[b["ok"].fillna(False).astype(bool) & b["latency_ms"].notna()].sort_values("ts")
            held = (held + b["latency_ms"].tolist())[-KEEP:]
        state.update((held,))
        yield pd.DataFrame({"service": [key[0]], "n": [len(held)], "rolling_ms": [sum(held) / len(held) if held else 0.0]})

    return requests.groupBy("service").applyInPandasWithState(update, ROLLING, STATE, "update", "NoTimeout")


def requests_of(events: DataFrame) -> DataFrame:
    """The request log of an event stream: value is the latency, event_type `error` a failure."""
    return events.select("ts", "user_id", F.col("event_type").alias("service"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))
