"""Streams over the append-only logs: idempotent ingestion, review state, head checks.

A key's rows of one micro-batch are sorted together, so micro-batches are to be bounded (maxFilesPerTrigger); over a whole log
with keys of any size run the batch twins in operators/logs.py, which carry the state over sorted rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditloom.operators.logs import REVIEW_START, review_step
from auditloom.sources.tables import shared_dir


def ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch in order."""
    return pd.concat(list(batches)).sort_values(by, kind="stable")


def idempotent_ingest(stream: DataFrame) -> DataFrame:
    """(event_id, idem_key, outcome): accepted, replay (same key and hash as before) or conflict. State: a key's first hash."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        rows = []
        for e, h in ordered(batches, ["recorded_at", "event_id"])[["event_id", "request_hash"]].itertuples(index=False):
            rows.append((e, key[0], "accepted" if first is None else "replay" if h == first else "conflict"))
            first = h if first is None else first
        state.update((first,))
        yield pd.DataFrame(rows, columns=["event_id", "idem_key", "outcome"])

    return stream.groupBy("idem_key").applyInPandasWithState(step, "event_id long, idem_key long, outcome string", "first string", "append", GroupStateTimeout.NoTimeout)


def review_state(stream: DataFrame) -> DataFrame:
    """(event_id, submission_id, outcome, status, version): each action on a submission, accepted or with the reason why not.

    The rules are those of logs.review_step. State: status, version, whether it is claimed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, rows = state.get if state.exists else REVIEW_START, []
        for e, action in ordered(batches, ["recorded_at", "event_id"])[["event_id", "action"]].itertuples(index=False):
            now, told = review_step(now, (action,))
            rows.append((e, key[0], *told))
        state.update(now)
        yield pd.DataFrame(rows, columns=["event_id", "submission_id", "outcome", "status", "version"])

    return stream.groupBy("submission_id").applyInPandasWithState(step, "event_id long, submission_id long, outcome string, status string, version long", "status string, version long, held boolean", "append", GroupStateTimeout.NoTimeout)


def append_head(stream: DataFrame) -> DataFrame:
    """(log_key, entry_id, outcome): an append stands if it names the entry that is its log's head. State: the head. stream: log_key, sequence, entry_id, names."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head = state.get[0] if state.exists else ""
        rows = []
        for entry, names in ordered(batches, ["sequence", "entry_id"])[["entry_id", "names"]].itertuples(index=False):
            rows.append((key[0], entry, "accepted" if names == head else "stale"))
            head = entry if names == head else head
        state.update((head,))
        yield pd.DataFrame(rows, columns=["log_key", "entry_id", "outcome"])

    return stream.groupBy("log_key").applyInPandasWithState(step, "log_key long, entry_id string, outcome string", "head string", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there now, into a table in the shared folder, and reads it."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
