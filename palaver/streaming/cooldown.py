"""What an agent was shown lately isn't shown again: a fold over its candidates in order, with state on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.scratch import shared_dir

LAST, HOURS = 10, 12
_OUT = "agent long, event_id long, session_id long"


def shown(candidates: DataFrame, last: int = LAST, hours: int = HOURS) -> DataFrame:
    """The candidates (agent, event_id, session_id, ts) of a stream that are shown: those not among the last so many shown to their agent, nor shown within so many hours before.

    An agent's candidates count by time, then event; each batch goes on from the state that the one before left, so batches
    must come in order. The state of an agent is a list of as many ids and times; a null id or time is never shown.
    """
    import pandas as pd

    def fold(key, frames, state):
        have = list(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(frames)).dropna(subset=["session_id", "ts"]).sort_values(["ts", "event_id"])
        out = []
        for event, session, ts in zip(rows["event_id"], rows["session_id"].astype("int64"), rows["ts"].astype("int64") // 1000, strict=True):
            if any(s == session for s, t in have if ts - t < hours * 3_600_000_000):
                continue
            have = [*have, (int(session), int(ts))][-last:]
            out.append((key[0], event, session))
        state.update(([s for s, _ in have], [t for _, t in have]))
        yield pd.DataFrame(out, columns=["agent", "event_id", "session_id"])

    typed = candidates.selectExpr("CAST(agent AS BIGINT) AS agent", "CAST(event_id AS BIGINT) AS event_id", "CAST(session_id AS BIGINT) AS session_id", "CAST(ts AS TIMESTAMP) AS ts")
    return typed.groupBy("agent").applyInPandasWithState(fold, _OUT, "ids array<bigint>, times array<bigint>", "append", "NoTimeout")


def run_to_end(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes what a stream gives, up to what has arrived, and reads it back."""
    spark = stream.sparkSession
    folder = folder or shared_dir(spark)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/stream").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
