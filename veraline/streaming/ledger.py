"""The token-budget ledger on a stream: state per stage, committed attempts alone count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraline.operators.budget import fold

OUT = "stage long, event_id long, selected long, counted long, consumed_before long, consumed_after long, version long, status string"


def stream_ledger(attempts: DataFrame, target: int, start: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """attempts (stage, event_id, candidate, executed[, planned_version]) as a stream -> OUT, in event_id order within each batch.

    Each executed attempt takes min(candidate, what is left) and raises the version;
    skipped attempts leave both alone, and attempts planned from another version than
    the current one are stale.  start: (consumed, version) of stages that are restored;
    the others begin with nothing.
    """
    begun = start or {}
    if "planned_version" not in attempts.columns:
        attempts = attempts.withColumn("planned_version", F.lit(-1).cast("long"))

    def step(key, batches, state):
        consumed, version = state.get if state.exists else begun.get(key[0], (0, 0))
        for pdf in batches:
            pdf = pdf.sort_values("event_id")
            seen = pdf["planned_version"].fillna(-1).to_numpy(np.int64)
            out = fold(pdf["candidate"].to_numpy(np.int64), pdf["executed"].to_numpy(bool), seen, target, consumed, version)
            if len(out):
                consumed, version = int(out["consumed_after"].iloc[-1]), int(out["version"].iloc[-1])
            yield pd.concat([pd.DataFrame({"stage": key[0], "event_id": pdf["event_id"].to_numpy()}), out], axis=1)
        state.update((consumed, version))

    return attempts.groupBy("stage").applyInPandasWithState(step, OUT, "consumed long, version long", "append", "NoTimeout")
