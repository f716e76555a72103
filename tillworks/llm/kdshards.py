"""Shards of nearly equal bytes by a k-d tree over metadata, in DataFrame operations only.

The rows are reduced to integer metadata. A node that is to become ``k`` shards is cut along
its widest dimension (its value range as a share of the whole table's) at the weighted
``k // 2 : k`` quantile of the bytes, found by histograms that narrow down on the cut: each
pass reads at most ``BINS`` sums for each node of the level, whatever the table's size. A cut is
a bound on the row's coordinates in the node's order, so ties are broken by the next
dimensions and every cut falls between two groups of equal texts unless a group is
larger than ``WHOLE`` of a shard; such a group is cut by doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.config import stage_table

BINS = 2048
WHOLE = 0.01  # share of a shard up to which rows next to a cut go to one side together
DIMENSIONS = ("n_bytes", "n_words", "lang_at", "source_at")  # metadata a cut may follow
TIES = ("text_hash", "doc_at")  # order within equal metadata
HASHES = 1 << 62  # values of the coordinates in TIES
OFFSET = 8  # bytes counted for each row besides its text
BUCKET = 50_000  # rows numbered together


@dataclass
class Node:
    """A box of the tree with ``shards`` to make, numbered from ``first``."""

    shards: int
    first: int


@dataclass
class Cut:
    """The search for one node's cut: all below (``prefix``, ``low``) is left, all above (``prefix``, ``high``) right."""

    order: list[str]
    spans: dict[str, tuple[int, int]]
    want: float  # bytes that shall lie left
    room: float  # bytes that may go to either side together
    below: int = 0
    prefix: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0
    bound: list[int] | None = None

    def __post_init__(self):
        self.low, self.high = self.spans[self.order[0]]

    @property
    def step(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))

    def narrow(self, bins: list[tuple[int, int, int, int]]) -> None:
        """Takes (lowest, highest value, bytes, rows) of the bins between the bounds, in order."""
        for least, most, size, n in bins:
            if self.below + size <= self.want:
                self.below += size
                continue
            last = len(self.prefix) + 1 == len(self.order)
            if n == 1 or size <= self.room or (least == most and last):
                # Next to nothing, or not to be told apart: whole to the nearer side.
                left = self.below + size / 2 <= self.want
                self.bound = [*self.prefix, most + 1 if left else least]
            elif least == most:
                self.prefix.append(least)
                self.low, self.high = self.spans[self.order[len(self.prefix)]]
            else:
                self.low, self.high = least, most
            return
        self.bound = [*self.prefix, self.high + 1]


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) and the integer coordinates of each row; null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    optional = {n: F.col(n) if n in docs.columns else F.lit(None) for n in ("lang", "source")}
    own = docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("text_hash"),
        # Spaces in hundred-thousandths of the bytes: how dense the text is.
        F.when(F.octet_length(text) > 0, (F.length(text) - F.length(F.replace(text, F.lit(" ")))).cast("long") * 100_000 / F.octet_length(text)).otherwise(F.lit(0)).cast("long").alias("n_words"),
        F.pmod(F.xxhash64(optional["lang"].cast("string")), F.lit(1 << 20)).alias("lang_at"),
        F.pmod(F.xxhash64(optional["source"].cast("string")), F.lit(1 << 20)).alias("source_at"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("doc_at"),
    )
    return own.withColumn("size", F.col("n_bytes") + OFFSET)


def with_one_box_a_text(rows: DataFrame) -> DataFrame:
    """Copies of a text that differ in ``lang`` or ``source`` take the smallest pair among them, so that no cut along these parts them.

    Only texts with several pairs enter the join; its rows are narrow, and a large group of copies is split by AQE.
    """
    pair = F.struct("lang_at", "source_at")
    mixed = rows.groupBy("text_hash").agg(F.min(pair).alias("_least"), F.max(pair).alias("_most")).filter("_least <> _most")
    both = rows.join(mixed.drop("_most"), "text_hash", "left")
    return both.select(*[F.coalesce(f"_least.{c}", c).alias(c) if c in ("lang_at", "source_at") else c for c in rows.columns])


def _of_node(values: list, kind: str) -> Column:
    """The entry of ``values`` (numbers, lists of numbers, names or None) at the row's node, as a look-up in a constant array."""

    def text(x) -> str:
        if isinstance(x, list):
            return f"array({', '.join(f'{i}L' for i in x)})"
        return "null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}L"

    return F.expr(f"element_at(cast(array({', '.join(map(text, values))}) as array<{kind}>), node + 1)")


def _orders() -> dict[str, list[str]]:
    return {wide: [wide, *(c for c in DIMENSIONS if c != wide), *TIES] for wide in DIMENSIONS}


def _keyed(placed: DataFrame, cuts: list[Cut | None]) -> DataFrame:
    """Adds ``key``: the row's coordinates in its node's order."""
    key, wide = F.lit(None).cast("array<bigint>"), _of_node([c.order[0] if c else "" for c in cuts], "string")
    for name, order in _orders().items():
        key = F.when(wide == name, F.array(*order)).otherwise(key)
    return placed.withColumn("key", key)


def _cuts(placed: DataFrame, nodes: list[Node]) -> list[Cut | None]:
    """The cut of each node that has rows and more than one shard to make."""
    ends = [f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
    found = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}
    table = {c: max((r[f"hi_{c}"] for r in found.values()), default=0) - min((r[f"lo_{c}"] for r in found.values()), default=0) for c in DIMENSIONS}
    cuts: list[Cut | None] = [None] * len(nodes)
    for k, node in enumerate(nodes):
        if node.shards == 1 or k not in found:
            continue
        r = found[k]
        spans = {c: (r[f"lo_{c}"], r[f"hi_{c}"]) for c in DIMENSIONS} | {c: (0, HASHES - 1) for c in TIES}
        wide = max(DIMENSIONS, key=lambda c: (spans[c][1] - spans[c][0]) / max(1, table[c]))
        cuts[k] = Cut(_orders()[wide], spans, r["bytes"] * (node.shards // 2) / node.shards, WHOLE * r["bytes"] / node.shards)
    keyed = _keyed(placed, cuts)
    while any(c and c.bound is None for c in cuts):
        # One pass narrows every open node: bytes of BINS equal steps between its bounds.
        open_ = [c if c and c.bound is None else None for c in cuts]
        at = _of_node([len(c.prefix) if c else None for c in open_], "int")
        prefix = _of_node([c.prefix if c else [] for c in open_], "array<bigint>")
        low, high, step = (_of_node([getattr(c, n) if c else None for c in open_], "bigint") for n in ("low", "high", "step"))
        value = F.element_at("key", at + 1)
        live = at.isNotNull() & (F.slice("key", F.lit(1), at) == prefix) & value.between(low, high)
        seen = keyed.select("node", "size", F.when(live, value).alias("value"), low.alias("low"), step.alias("step"))
        bins = seen.groupBy("node", F.expr("(value - low) div step").alias("bin")).agg(
            F.min("value").alias("least"), F.max("value").alias("most"), F.sum("size").alias("bytes"), F.count("*").alias("n")
        )
        sums: dict[int, list] = {}
        for r in bins.collect():
            if r["bin"] is not None:
                sums.setdefault(r["node"], []).append((r["least"], r["most"], r["bytes"], r["n"]))
        for k, c in enumerate(open_):
            if c:
                c.narrow(sorted(sums[k]))
    return cuts


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash, shard): every row in one of ``shards`` shards of nearly equal bytes.

    Size is the text's UTF-8 bytes plus 8. Equal texts share a shard, whatever their ``lang`` and ``source``,
    unless they outweigh ``WHOLE`` of it. Rows that agree in text, metadata and doc_id cannot be told apart and stay together.
    Missing ``lang`` or ``source`` columns and nulls are single values; an empty table gives no rows.
    """
    placed = stage_table(with_one_box_a_text(stage_table(metadata(docs)))).withColumn("node", F.lit(0))
    nodes = [Node(shards, 0)]
    while any(n.shards > 1 for n in nodes):
        cuts = _cuts(placed, nodes)
        after, left, right = [], [], []
        for n, cut in zip(nodes, cuts, strict=True):
            half = n.shards // 2 if cut else n.shards
            left.append(len(after))
            # A node without rows needs no cut.
            after.append(Node(half if cut else 1, n.first))
            right.append(len(after))
            if cut:
                after.append(Node(n.shards - half, n.first + half))
        bound = _of_node([c.bound if c else [] for c in cuts], "array<bigint>")
        below = F.col("key").isNull() | (F.col("key") < bound)
        to = F.when(below, _of_node(left, "int")).otherwise(_of_node(right, "int"))
        placed = stage_table(_keyed(placed, cuts).withColumn("node", to).drop("key"))
        nodes = after
    return placed.select("doc_id", "size", "text_crc32", "text_hash", _of_node([n.first for n in nodes], "int").alias("shard"))


def slots(assigned: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard; numbered in buckets whose count follows the rows."""
    assigned = stage_table(assigned)
    parts = assigned.count() // BUCKET + 1
    dealt = assigned.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(parts)))
    order = Window.partitionBy("shard").orderBy("part")
    sizes = dealt.groupBy("shard", "part").count()
    sizes = sizes.select("shard", "part", (F.sum("count").over(order) - F.col("count")).alias("before"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_hash")
    return dealt.withColumn("row", F.row_number().over(own) - 1).join(sizes, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("row")).drop("part", "row", "before", "text_hash")
