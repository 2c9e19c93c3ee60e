"""Filling containers of fixed capacity with documents, by first-fit decreasing in randomised groups.

Documents are dealt to groups by a hash of their id, so groups are alike whatever order or skew the input has, and each
group is filled on its own: the largest document first, into the first container with room, which a tournament tree of
the remaining capacities finds in as many steps as the tree is high. A document larger than a container is cut into
full containers and a rest that is an item like any other; no other document is split.

A null or empty text has no tokens and takes part as an item of size 0. Documents of the same size are placed by id.
An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: Documents in a group on average. Only the last containers of a group stay open, so larger groups waste less.
GROUP_SIZE = 20_000


class FirstFit:
    """Containers under a tournament tree: each node holds the most room of the containers below it."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.used = capacity, 0
        self.width = 1 << max(0, math.ceil(math.log2(max(1, most))))
        self.room = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """The first container with room for the item, which is put there."""
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < size:
                node += 1
        found = node - self.width
        room[node] -= size
        self.used = max(self.used, found + 1)
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, for sizes of at most the capacity in falling order."""
    bins = FirstFit(capacity, len(sizes))
    return np.fromiter((bins.place(s) for s in sizes.tolist()), np.int32, len(sizes))


def _pack_group(group: pa.Table, capacity: int) -> pa.Table:
    group = group.sort_by([("size", "descending"), ("id", "ascending"), ("part", "ascending")])
    where = pack(group["size"].to_numpy(), capacity)
    return group.append_column("slot", pa.array(where))


def containers(counts: DataFrame, key: str, n_documents: int, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """(key, part, first_token, n_tokens, pack_group, slot) of every item; pack_group and slot name its container.

    counts has key and n_tokens. n_documents, about as many as there are, sets the number of groups.
    """
    groups = max(1, math.ceil(n_documents / group_size))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1))
    items = counts.select(
        F.col(key).alias("id"), "n_tokens", F.pmod(F.xxhash64(F.lit("pack"), F.col(key).cast("string")), F.lit(groups)).cast("int").alias("pack_group"), F.explode(parts).alias("part")
    )
    items = items.select("id", "pack_group", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).alias("size"))
    schema = f"id {items.schema['id'].dataType.simpleString()}, pack_group INT, part INT, size INT, slot INT"

    def run(group: pa.Table) -> pa.Table:
        return _pack_group(group, capacity)

    packed = items.groupBy("pack_group").applyInArrow(run, schema)
    return packed.select(F.col("id").alias(key), "part", (F.col("part") * capacity).alias("first_token"), F.col("size").alias("n_tokens"), "pack_group", "slot")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens and the share of the capacity that is used."""
    each = packed.groupBy("pack_group", "slot").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    return each.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )
