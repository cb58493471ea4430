"""Self-referencing keys and ragged hierarchies.

A chain of managers is walked by pointer doubling: every round replaces each
row's pointer by its pointer's pointer, so a chain of depth d takes log2(d)
joins, whatever its depth.  (A recursive common table expression needs one
round per level and stops at the engine's limits on levels and rows.)
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermart.session import materialize


def parent_chain(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Q8 for a key that points into its own table: (key, depth, top, issue)
    per key.

    ``depth`` counts the steps to the ``top``, the last row reached.
    ``issue``: ``orphan`` (the parent is not there; the row is its own top),
    ``cycle`` (the row is its own ancestor), ``below_cycle`` (its ancestors
    end in a cycle); the last two have neither depth nor top.  A key listed
    twice is one node with its least parent; rows without a key are left out.

    Every round writes its pointers, so a lost executor repeats one round;
    rows that have reached their top leave, and a row that still moves
    after as many steps as there are rows is in or below a cycle."""
    nodes = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(parent).alias("parent"))
    there = nodes.select(F.col("node").alias("__there"))
    first = nodes.join(there, nodes["parent"] == there["__there"], "left").select(
        "node", F.col("__there").alias("next"), F.when(F.col("__there").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        F.coalesce("__there", "node").alias("top"), (F.col("parent").isNotNull() & F.col("__there").isNull()).alias("orphan"))
    now = materialize(first, "chain")
    count = now.count()
    for _ in range(max(1, math.ceil(math.log2(count + 1)) + 1) if count else 0):
        moving = now.filter("next IS NOT NULL")
        if moving.isEmpty():
            break
        step = now.select(F.col("node").alias("__n"), F.col("next").alias("__next"), F.col("depth").alias("__depth"), F.col("top").alias("__top"))
        moved = moving.join(step, moving["next"] == step["__n"]).select(
            "node", F.col("__next").alias("next"), (F.col("depth") + F.col("__depth")).alias("depth"), F.col("__top").alias("top"), "orphan")
        now = materialize(now.filter("next IS NULL").unionByName(moved), "chain")
    # who still moves: every row on a cycle is pointed at, rows below are not
    cyclic = now.filter("next IS NOT NULL").select(F.col("next").alias("__c")).distinct()
    out = now.join(cyclic, now["node"] == cyclic["__c"], "left")
    moves = F.col("next").isNotNull()
    issue = (F.when(moves & F.col("__c").isNotNull(), "cycle").when(moves, "below_cycle").when(F.col("orphan"), "orphan"))
    return out.select(F.col("node").alias(key), F.when(~moves, F.col("depth")).alias("depth"), F.when(~moves, F.col("top")).alias("top"),
                      issue.alias("issue"))


def ragged_rollup(facts: DataFrame, accounts: DataFrame, key: str, levels: Sequence[str], measure: str) -> DataFrame:
    """G19 for a hierarchy whose branches end at different levels: (levels...,
    ``depth``, row_count, total_balance) for every prefix of every path.

    A path ends at the account's last level that is not NULL; there are no
    subtotals below it.  ``depth`` is the number of levels that a row is a
    total of: a NULL within them is a level without a name, a NULL after
    them belongs to a subtotal.  ``depth`` 0 is the total.

    The facts are added up per account first (partial sums, so a hot account
    is combined map-side); only one row per account is spread over its
    prefixes, one ``explode`` for all levels."""
    per_account = facts.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"), F.sum(measure).alias("__s"))
    path = F.array(*[F.col(c).cast("string") for c in levels])
    last = F.greatest(F.lit(0), *[F.when(F.col(c).isNotNull(), i + 1).otherwise(0) for i, c in enumerate(levels)])
    tree = accounts.select(F.col(key).alias("__a"), path.alias("__path"), last.alias("__last"))
    spread = per_account.join(tree, F.col("__k") == F.col("__a")).select(
        "__path", "__n", "__s", F.explode(F.sequence(F.lit(0), F.col("__last"))).alias("depth"))
    named = [F.when(F.col("depth") > i, F.col("__path")[i]).alias(c) for i, c in enumerate(levels)]
    return spread.select(*named, "depth", "__n", "__s").groupBy(*levels, "depth").agg(
        F.sum("__n").alias("row_count"), F.sum("__s").cast("decimal(38,2)").alias("total_balance"))
