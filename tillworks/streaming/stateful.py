"""The keyed state machine for raw sign-in tries.

Its state per key is a handful of times. Rows of a key are handled in time order within
a micro-batch, whose size the source bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tillworks.functions import timeutil as T
from tillworks.operators import access as A


def _sorted(chunks: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(chunks), ignore_index=True).sort_values(by, kind="stable")


def attempt_lockout(attempts: DataFrame, key: str, limit: int, reset_on_success: bool) -> DataFrame:
    """Raw tries ``(id, username, ip, succeeded, created_at)`` with the rate limit applied.

    A refused try leaves no trace, so it does not prolong the lock: only let-through
    failures are remembered, at most ``limit`` of them per key. ``allowed`` says whether
    the password was looked at. The user rule resets on a success, the address rule
    does not; each runs as its own stream, so a try refused by one rule is still seen
    by the other.
    """
    window, limit_, reset = A.LOCK_WINDOW_US, limit, reset_on_success

    def step(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = list(state.get[0]) if state.exists else []
        rows = _sorted(chunks, ["us", "id"])
        out = []
        for id_, us, good in zip(rows["id"], rows["us"], rows["succeeded"]):
            # Only the newest ``limit`` failures can matter, and only while they are recent.
            failures = [f for f in failures if us - f < window][-limit_:]
            if len(failures) >= limit_:
                wait = max(-((us - failures[-limit_] - window) // T.MINUTE_US), 1)
                out.append((id_, keys[0], False, int(wait)))
                continue
            out.append((id_, keys[0], True, None))
            if good:
                failures = [] if reset else failures
            else:
                failures.append(int(us))
        state.update((failures,))
        yield pd.DataFrame(out, columns=["id", "key", "allowed", "wait_minutes"]).astype({"wait_minutes": "Int64"})

    rows = attempts.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), "id", "succeeded", T.micros(F.col("created_at")).alias("us"))
    return rows.groupBy("key").applyInPandasWithState(
        step, "id bigint, key string, allowed boolean, wait_minutes bigint", "failures array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
