"""The versioned token budget of a stage: reservations, commits and state as rows.

A reservation is a pure function of the state it was planned from.  A commit is accepted
only if that state is still the stage's, and moves it only if the update ran.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraline.functions import predicates as P
from veraline.functions.canonical import object_sha256
from veraline.operators.checks import repeated, union, violations

STATE = "stage long, target_tokens long, consumed_tokens long, version long"


def state_violations(states: DataFrame) -> DataFrame:
    """Rules on stored states: a positive target, consumed tokens within it, a version from 0 on, one state a stage."""
    rules = {"target_tokens": F.col("target_tokens") > 0, "consumed_tokens": F.col("consumed_tokens").between(0, F.col("target_tokens")), "version": F.col("version") >= 0}
    return union(violations(states, "stage", rules), repeated(states, "repeated_stage", "stage"))


def selection_id(df: DataFrame, target: Column, consumed: Column, version: Column, candidate: Column, selected: Column, digest: Column) -> Column:
    return object_sha256(df, schema_version=F.lit(1), target_tokens=target, consumed_tokens=consumed, counter_version=version, candidate_tokens=candidate, selected_tokens=selected, content_digest=digest)


def reserve(candidates: DataFrame, states: DataFrame) -> DataFrame:
    """candidates (stage, candidate_tokens, content_digest, ...) with what their stage's state leaves them, and the reservation's id."""
    df = candidates.join(states, "stage").withColumn("selected_tokens", F.least("candidate_tokens", F.col("target_tokens") - F.col("consumed_tokens")))
    made = df.withColumnsRenamed({"consumed_tokens": "consumed_before", "version": "counter_version"})
    ident = selection_id(made, F.col("target_tokens"), F.col("consumed_before"), F.col("counter_version"), F.col("candidate_tokens"), F.col("selected_tokens"), F.col("content_digest"))
    return made.withColumn("selection_id", ident).withColumn("truncated", F.col("selected_tokens") < F.col("candidate_tokens"))


def reservation_violations(reservations: DataFrame, states: DataFrame) -> DataFrame:
    """Reservations that a commit must reject: of another target, of a stale count or version, not the canonical prefix, or altered."""
    now = states.select("stage", F.col("target_tokens").alias("t"), F.col("consumed_tokens").alias("c"), F.col("version").alias("v"))
    df = reservations.join(now, "stage", "left")
    ident = selection_id(df, F.col("target_tokens"), F.col("consumed_before"), F.col("counter_version"), F.col("candidate_tokens"), F.col("selected_tokens"), F.col("content_digest"))
    rules = {
        "target": F.col("target_tokens") == F.col("t"), "stale_consumed": F.col("consumed_before") == F.col("c"), "stale_version": F.col("counter_version") == F.col("v"), "content_digest": P.is_sha256(F.col("content_digest")),
        "canonical_prefix": F.col("selected_tokens") == F.least(F.col("candidate_tokens"), F.col("target_tokens") - F.col("consumed_before")), "selection_id": F.col("selection_id") == ident, "candidate_tokens": F.col("candidate_tokens") >= 0,
    }
    return violations(df, "selection_id", rules)


def committed(reservations: DataFrame, outcomes: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, new states) of one reservation a stage and its outcome (stage, step_id, objective, executed).

    An update that ran counts its selected tokens and raises the version; others change nothing.
    """
    ran = F.col("executed") & (F.col("selected_tokens") > 0)
    rows = reservations.join(outcomes, "stage").withColumn("counted_tokens", F.when(ran, F.col("selected_tokens")).otherwise(0).cast("long"))
    records = rows.withColumns({"consumed_after": F.col("consumed_before") + F.col("counted_tokens"), "counter_version_after": F.col("counter_version") + ran.cast("long")}).withColumn("complete", F.col("consumed_after") == F.col("target_tokens"))
    moved = records.select("stage", F.col("consumed_after").alias("a"), F.col("counter_version_after").alias("w"))
    return records, states.join(moved, "stage", "left").select("stage", "target_tokens", F.coalesce("a", "consumed_tokens").alias("consumed_tokens"), F.coalesce("w", "version").alias("version"))


def fold(candidate: np.ndarray, executed: np.ndarray, seen: np.ndarray | None, target: int, consumed: int, version: int) -> pd.DataFrame:
    """A row for each attempt in order: selected, counted, consumed_before, consumed_after, version, status.

    seen: the version that an attempt was planned from, -1 for whatever is current.  Without
    any, sums decide all at once; a stale attempt depends on those before it, so with them
    attempts are taken one by one.  Statuses: counted, skipped, empty, stale.
    """
    n = len(candidate)
    if seen is None or not n or (seen < 0).all():
        after = np.minimum(consumed + np.cumsum(np.where(executed, candidate, 0)), target)
        before = np.concatenate([[consumed], after[:-1]]).astype(np.int64)
        selected = np.minimum(candidate, target - before)
        ran = executed & (selected > 0)
        status = np.where(~executed, "skipped", np.where(ran, "counted", "empty"))
        return pd.DataFrame({"selected": selected, "counted": np.where(ran, selected, 0), "consumed_before": before, "consumed_after": after, "version": version + np.cumsum(ran), "status": status})
    rows = []
    for c, e, s in zip(candidate.tolist(), executed.tolist(), seen.tolist(), strict=True):
        left, before = min(c, target - consumed), consumed
        status = "stale" if s not in (-1, version) else "skipped" if not e else "counted" if left else "empty"
        if status == "counted":
            consumed, version = consumed + left, version + 1
        rows.append((left, left if status == "counted" else 0, before, consumed, version, status))
    return pd.DataFrame(rows, columns=["selected", "counted", "consumed_before", "consumed_after", "version", "status"])
