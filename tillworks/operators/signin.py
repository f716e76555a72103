"""Raw sign-in tries with the rate limits applied: a refused try leaves no trace.

The user rule looks at let-through failures of a username since its last success, the address rule at those
of an address; a try that one rule refuses is unseen by the other. So what becomes of a try can hang on all
earlier ones, and the tries are replayed in time order, each once. Only keys that can lock are replayed: a user or an
address refuses nothing in a quarter hour unless its failures in it and the one before, refused ones
too, reach the limit. Such spans of users and addresses that meet in a try form a group, and groups know
nothing of each other: each is read in order by one task that remembers as many failures of a key as its rule counts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.functions import timeutil as T
from tillworks.operators import access as A
from tillworks.operators.groups import linked

KEYS_KEPT = 10_000  # keys of a group up to which outdated ones are not looked for


def _spans(rows: DataFrame) -> DataFrame:
    """(rule, who, slot, node): the quarter hours in which a key can lock or its failures can count; adjacent ones share a node.

    A key has one row a slot, so a key under attack fills no task. Nodes are hashes: two that are equal by chance only share a group.
    """
    rules = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(c).alias("who")) for rule, c in (("user", "username"), ("ip", "ip"))])
    failed = rows.filter(~F.coalesce("succeeded", F.lit(False)) & F.col("slot").isNotNull()).select("slot", F.inline(rules)).filter("who is not null")
    counted = failed.groupBy("rule", "who", "slot").agg(F.count("*").alias("n"))
    reach = F.array(*[F.struct((F.col("slot") + k).alias("slot"), F.col("n")) for k in (0, 1)])
    within = counted.select("rule", "who", F.inline(reach)).groupBy("rule", "who", "slot").agg(F.sum("n").alias("n"))
    limit = F.when(F.col("rule") == "user", A.USER_LIMIT).otherwise(A.IP_LIMIT)
    spans = within.filter(F.col("n") >= limit).select("rule", "who", F.explode(F.array(F.col("slot") - 1, F.col("slot"))).alias("slot")).distinct()
    first = F.col("slot") - F.row_number().over(Window.partitionBy("rule", "who").orderBy("slot"))
    return spans.withColumn("node", F.xxhash64("rule", "who", first))


def _refused(asked: DataFrame) -> DataFrame:
    """(row, lock, left) of the refused tries, ``left`` being the microseconds until the deciding failure is a quarter hour old."""
    window, user_limit, ip_limit, kept = A.LOCK_WINDOW_US, A.USER_LIMIT, A.IP_LIMIT, KEYS_KEPT

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, time and id; a group may go on in the next batch."""
        group, now, users, ips, passed, most = None, None, {}, {}, set(), kept
        for batch in batches:
            rows, locks, lefts = [], [], []
            columns = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("row", "group", "username", "ip", "us", "succeeded", "known"))
            for row, g, user, ip, us, good, known in zip(*columns, strict=True):
                if g != group:
                    group, now, users, ips, most = g, None, {}, {}, kept
                if us != now:
                    now, passed = us, set()
                if not known:
                    mine = users.get(user)
                    if mine and len(mine) == user_limit and us - mine[0] < window:
                        rows.append(row)
                        locks.append("user")
                        lefts.append(mine[0] + window - us)
                        continue
                    near = ips.get(ip)
                    if near and len(near) == ip_limit and us - near[0] < window:
                        rows.append(row)
                        locks.append("ip")
                        lefts.append(None)
                        continue
                if good:
                    users.pop(user, None)
                    passed.add(user)
                    continue
                if user is not None and user not in passed:  # a failure counts if it is later than the last success
                    users.setdefault(user, deque(maxlen=user_limit)).append(us)
                if ip is not None:
                    ips.setdefault(ip, deque(maxlen=ip_limit)).append(us)
                if len(users) + len(ips) > most:
                    users, ips = ({k: f for k, f in seen.items() if us - f[-1] < window} for seen in (users, ips))
                    most = 2 * (len(users) + len(ips)) + kept
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(locks, pa.string()), pa.array(lefts, pa.int64())], names=["row", "lock", "left"])

    ordered = asked.repartition("group").sortWithinPartitions("group", "us", F.desc("known"), "id", "row").drop("id")
    return ordered.mapInArrow(work, "row bigint, lock string, left bigint")


def decide_tries(tries: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """``tries`` (id, username, ip, succeeded, created_at) with ``lock`` (user, ip or null) and ``wait_minutes``.

    ``recorded`` are attempts let through earlier. Tries of one instant follow their ids; rows that share an id are tries of their
    own. A try without an address knows no address rule, one without a username no user rule.
    """
    rows = tries.select("id", "username", "ip", "succeeded", "created_at", F.lit(False).alias("known"))
    if recorded is not None:
        rows = rows.unionByName(recorded.select("id", "username", "ip", "succeeded", "created_at").withColumn("known", F.lit(True)))
    rows = rows.withColumn("us", T.micros(F.col("created_at"))).withColumn("slot", F.expr(f"us div {A.LOCK_WINDOW_US}"))
    rows = stage_table(rows.withColumn("row", F.monotonically_increasing_id()))
    spans = stage_table(_spans(rows))
    of = lambda rule, key: spans.filter(F.col("rule") == rule).select(F.col("who").alias(key), "slot", F.col("node").alias(f"{rule}_node"))
    placed = stage_table(rows.join(of("user", "username"), ["username", "slot"], "left").join(of("ip", "ip"), ["ip", "slot"], "left").filter("user_node is not null or ip_node is not null"))
    groups = linked(placed.select(F.col("user_node").alias("a"), F.col("ip_node").alias("b")).filter("a is not null and b is not null").distinct())
    # Keys that cannot lock just now are not remembered.
    asked = placed.withColumn("node", F.coalesce("user_node", "ip_node")).withColumns({key: F.when(F.col(f"{rule}_node").isNotNull(), F.col(key)) for rule, key in (("user", "username"), ("ip", "ip"))})
    asked = asked.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node")).select("row", "group", "username", "ip", "us", "succeeded", "known", "id")
    locked = _refused(asked).select("row", "lock", F.when(F.col("lock") == "user", A.wait_minutes(F.col("left"))).alias("wait_minutes"))
    return rows.filter("not known").drop("known", "us", "slot").join(locked, "row", "left").drop("row")


def let_through(decided: DataFrame) -> DataFrame:
    return decided.filter("lock is null").select("id", "username", "ip", "succeeded", "created_at")


def still_counted(recorded: DataFrame) -> DataFrame:
    """Recorded attempts that can still refuse a try: the last quarter hour, without successes that a later one outdates."""
    newest = recorded.agg(F.max("created_at").alias("_now"))
    recent = recorded.join(F.broadcast(newest), F.col("created_at") > F.col("_now") - F.expr("interval 15 minutes")).drop("_now")
    last = recent.filter("succeeded").groupBy("username").agg(F.max(F.struct("created_at", "id")).alias("_last"))
    good = recent.filter("succeeded").join(last, "username").filter(F.col("id") == F.col("_last.id")).drop("_last")
    return recent.filter("not succeeded").unionByName(good)
