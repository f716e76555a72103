"""The live rate limit over raw sign-in tries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillworks.config import stage_table
from tillworks.operators import signin
from tillworks.streaming.feeds import drain
from tillworks.streaming.state import BatchLog, VersionedTable

RECORDED = "id bigint, username string, ip string, succeeded boolean, created_at timestamp_ntz"
DECIDED = f"{RECORDED}, lock string, wait_minutes bigint"


def guard(tries: DataFrame, run: str) -> DataFrame:
    """Live form over a stream of tries: both rules, batch by batch.

    State between batches is what :func:`tillworks.operators.signin.still_counted` keeps: some failures per user and address of the last
    quarter hour, so a batch costs its own rows and those. A batch that runs again reads the same
    state and overwrites its own decisions. Tries later than the state reaches back see only what is left of it.
    """
    spark = tries.sparkSession
    state, log = VersionedTable(f"{run}/state", RECORDED), BatchLog(f"{run}/decided", DECIDED)

    def each(batch: DataFrame, n: int) -> None:
        held = state.read(spark, n - 1)
        decided = stage_table(signin.decide_tries(batch.select("id", "username", "ip", "succeeded", "created_at"), held))
        log.write(decided.select("id", "username", "ip", "succeeded", "created_at", "lock", "wait_minutes"), n)
        state.write(signin.still_counted(held.unionByName(signin.let_through(decided))), n)

    drain(tries, run, each)
    return log.read(spark)
