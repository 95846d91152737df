"""Left joins against a side with unique keys, safe for hot keys.

Two shapes occur:

* the right side is one small row per file (``salted_lookup``): it is copied a
  fixed number of times and the left rows of one file spread over the copies;
* the right side is as large as the data (``unique_lookup``): only the few
  hottest keys travel by broadcast, the rest by an ordinary shuffled join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import input_bytes


@dataclass(frozen=True)
class SkewPolicy:
    """When and how hot keys are split off.

    A key is hot from ``hot_rows`` rows on, or from a ``hot_share``th of all
    rows where that is more, so there are at most ``hot_share`` hot keys (or
    rows / hot_rows) to broadcast, and no other key fills a task. ``hot_keys``
    is the size of the sketch that finds frequent ids. Inputs below
    ``small_input`` bytes fit one task whole and skip the extra work.

    ``broadcast_bytes`` bounds the stored size of a broadcast per-file table,
    ``broadcast_uids`` the number of ids sent to filter a large ledger, which
    is done when the batch takes less than 1/``ledger_ratio`` of its bytes.
    """

    hot_keys: int = 1024
    hot_rows: int = 1_000_000
    hot_share: int = 1_000_000
    small_input: int = 1 << 30
    salts: int = 64
    salt_bytes: int = 1 << 30
    broadcast_bytes: int = 64 << 20
    broadcast_uids: int = 2_000_000
    ledger_ratio: int = 20

    def needed_for(self, *inputs: DataFrame) -> bool:
        sizes = [input_bytes(df) for df in inputs]
        return any(s is None or s >= self.small_input for s in sizes)

    def ledger_dwarfs(self, records: DataFrame, entries: DataFrame) -> bool:
        batch, ledger = input_bytes(records), input_bytes(entries)
        return (batch is not None and ledger is not None and ledger >= self.small_input
                and batch * self.ledger_ratio <= ledger)


def spread_key(*cols: Column) -> Column:
    """A filler that matches nothing and spreads rows without a real key."""
    return F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*cols), F.lit(65536)).cast("string"))


def unique_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], *,
                  spread_by: Sequence[str], values: Sequence[str],
                  hot: DataFrame | None = None) -> DataFrame:
    """``left`` plus ``values`` of the one ``right`` row with equal ``on``.

    The first column of ``on`` is the string key that may be NULL or hot.
    ``hot`` holds the rows of ``right`` with hot keys, a bounded number; rows it
    answers, and rows without a key, take part in the shuffle under a filler.
    """
    key, rest = on[0], list(on[1:])
    found = left
    if hot is not None:
        served = F.broadcast(hot.select(
            F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in rest],
            F.struct(*values).alias("_hot")))
        match = F.col(key) == F.col("_hot_key")
        for c in rest:
            match &= F.col(c) == F.col(f"_hot_{c}")
        found = left.join(served, match, "left").drop("_hot_key", *[f"_hot_{c}" for c in rest])
        asks = F.col(key).isNotNull() & F.col("_hot").isNull()
    else:
        asks = F.col(key).isNotNull()
    found = found.withColumn(
        "_probe", F.when(asks, F.col(key)).otherwise(spread_key(*[F.col(c) for c in spread_by])))
    answers = right.select(
        F.col(key).alias("_probe"), *rest, F.struct(*values).alias("_cold"))
    joined = found.join(answers, ["_probe", *rest], "left")
    got = F.coalesce("_hot", "_cold") if hot is not None else F.col("_cold")
    return joined.select(*[c for c in left.columns], *[got[v].alias(v) for v in values])


def hottest(df: DataFrame, rows: str, policy: SkewPolicy) -> DataFrame:
    """All keys of ``df`` that are hot; how many there can be follows from the policy."""
    total = df.agg(F.sum(rows)).first()[0] or 0
    return df.filter(F.col(rows) >= max(policy.hot_rows, total // policy.hot_share))


def hottest_values(df: DataFrame, column: str, policy: SkewPolicy) -> DataFrame:
    """Frequent values of ``column`` from a sketch: one small row per task.

    The sketch only chooses which path a row takes, so its error never shows
    in a result.
    """
    k = min(policy.hot_keys, 1024)
    top = df.agg(F.expr(f"approx_top_k({column}, {k}, {k * 8})").alias("top"))
    return (top.select(F.inline("top"))
            .filter((F.col("count") >= policy.hot_rows) & F.col("item").isNotNull())
            .select(F.col("item").alias(column)))


def salted_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], *,
                  spread_by: Sequence[str], policy: SkewPolicy = SkewPolicy(),
                  how: str = "left") -> DataFrame:
    """Join ``left`` with a side of one row per file.

    A side whose tables take at most ``broadcast_bytes`` travels by broadcast
    and ``left`` is not moved at all. Beyond that each right row is copied
    ``salts`` times, or as often as ``left`` has ``salt_bytes``, if that is
    more, so even one file with a third of all rows fills no task.
    """
    size = input_bytes(right)
    if size is not None and size <= policy.broadcast_bytes:
        return left.join(F.broadcast(right), list(on), how)
    salts = max(policy.salts, (input_bytes(left) or 0) // policy.salt_bytes)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")
