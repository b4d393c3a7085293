"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kermesse.llm.common import free_name, materialise

SHARDS = 24
VIRTUAL_NODES = 64  # places of a shard on the ring
RING_BITS = 32
PIECE_ROWS = 10_000  # rows that are ranked together, on average

c, lit = F.col, F.lit


@dataclass(frozen=True)
class Ring:
    """Virtual nodes in clockwise order: the ring place where each one's arc ends, and its shard."""

    places: tuple[int, ...]
    shards: tuple[int, ...]

    @staticmethod
    def of(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> Ring:
        def place(name: str) -> int:
            return int.from_bytes(hashlib.md5(name.encode()).digest()[:4], "big")

        nodes = sorted(
            (place(f"shard {s} node {v}"), s, v) for s in range(shards) for v in range(virtual_nodes)
        )
        return Ring(tuple(n[0] for n in nodes), tuple(n[1] for n in nodes))

    def arc_of(self, place: int) -> int:
        """The first virtual node at or after a place, clockwise."""
        return bisect.bisect_left(self.places, place) % len(self.places)


def fill(ring: Ring, loads: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) runs that place every row.

    `loads` has the rows of each arc. Shards hold total // shards rows, the first ones one more, so
    that counts differ by one at most. Arcs first fill the shard they end at, in ring order; ranks
    that overflow a full shard go on clockwise to the next virtual node whose shard has room. Only
    overflow moves, so most rows stay where an unbounded ring would put them.
    """
    total = sum(loads.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    runs, over = [], []

    def put(arc: int, start: int, wanted: int, shard: int) -> int:
        taken = min(wanted, room[shard])
        if taken:
            runs.append((arc, start, start + taken, shard, slot[shard]))
            room[shard] -= taken
            slot[shard] += taken
        return taken

    for arc in sorted(loads):
        taken = put(arc, 0, loads[arc], ring.shards[arc])
        if taken < loads[arc]:
            over.append((arc, taken))
    for arc, start in over:
        at = arc
        while start < loads[arc]:
            at = (at + 1) % len(ring.shards)
            start += put(arc, start, loads[arc] - start, ring.shards[at])
    return runs


def _longs(values: list[int] | tuple[int, ...]) -> Column:
    """A constant array."""
    return F.split(lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _arc(place: Column, ring: Ring) -> Column:
    """The arc of a ring place: the ring is cut into even cells, and only the few virtual nodes of
    the place's cell are compared with it."""
    bits = len(ring.places).bit_length()
    cells = [bisect.bisect_left(ring.places, i << (RING_BITS - bits)) for i in range((1 << bits) + 1)]
    cell = F.shiftright(place, RING_BITS - bits).cast("int")
    first = F.get(_longs(cells), cell)
    inside = F.slice(_longs(ring.places), first.cast("int") + 1, (F.get(_longs(cells), cell + 1) - first).cast("int"))
    passed = F.size(F.filter(inside, lambda node: node < place))
    return ((first + passed) % len(ring.places)).cast("int")


def with_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    virtual_nodes: int = VIRTUAL_NODES,
    id: str = "doc_id",
    text: str = "text",
    shard: str = "shard",
    slot: str = "slot",
) -> DataFrame:
    """`docs` with `shard` (0 to shards - 1) and `slot` (gapless from 0 within a shard).

    A row's place on the ring is a hash of its id and text, so copies with ids of their own spread,
    and equal texts are no hot spot. Rows of an arc are ranked in pieces of about PIECE_ROWS rows,
    by further bits of the hash; only counts of pieces are summed up. The driver sees one number
    per arc, `shards * virtual_nodes` in all. Null ids and texts hash as such; repeated rows take
    ranks beside each other in any order. Equal columns named `shard` and `slot` are replaced.
    """
    rest = docs.drop(shard, slot)
    arc, piece, mark, start, runs, rank = (
        free_name(docs, name) for name in ("arc", "piece", "mark", "piece_start", "runs", "rank")
    )
    ring = Ring.of(shards, virtual_nodes)
    hashed = F.md5(
        F.concat(F.coalesce(c(id).cast("string"), lit("-")), lit(":"), F.coalesce(c(text), lit("-")))
    )
    place = F.conv(F.substring(c(mark), 1, 8), 16, 10).cast("long")
    marked = rest.withColumn(mark, hashed).withColumn(arc, _arc(place, ring))
    counts = materialise(
        marked.select(arc, (F.conv(F.substring(mark, 9, 3), 16, 10).cast("int")).alias(piece))
        .groupBy(arc, piece)
        .agg(F.count("*").alias("rows"))
    )
    loads = dict(counts.groupBy(arc).agg(F.sum("rows")).collect())
    spark = docs.sparkSession
    placed = spark.createDataFrame(
        fill(ring, loads, shards) or [(0, 0, 0, 0, 0)],
        f"{arc} int, first long, end long, shard int, slot long",
    )
    # As many pieces as make PIECE_ROWS rows each, 4096 for an arc at most: a power of two.
    most = max(loads.values(), default=0)
    pieces = 1 << min(12, max(0, (most // PIECE_ROWS).bit_length()))
    joined_piece = F.floor(c(piece) / (4096 // pieces)).cast("int")
    before = Window.partitionBy(arc).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn(piece, joined_piece)
        .groupBy(arc, piece)
        .agg(F.sum("rows").alias("rows"))
        .withColumn(start, F.coalesce(F.sum("rows").over(before), lit(0)))
        .drop("rows")
    )
    by_arc = placed.groupBy(arc).agg(
        F.collect_list(F.struct("first", "end", "shard", "slot")).alias(runs)
    )
    # One row for each arc and piece; the number of pieces and arcs is a parameter, not data.
    table = materialise(starts.join(by_arc, arc))
    within = Window.partitionBy(arc, piece).orderBy(mark)
    number = F.conv(F.substring(mark, 9, 3), 16, 10).cast("int")
    ranked = (
        marked.withColumn(piece, F.floor(number / (4096 // pieces)).cast("int"))
        .join(table, [arc, piece])
        .withColumn(rank, c(start) + F.row_number().over(within) - 1)
    )
    run = F.filter(c(runs), lambda r: (r["first"] <= c(rank)) & (c(rank) < r["end"]))[0]
    return ranked.withColumn(runs, F.array(run)).select(
        *rest.columns,
        c(runs)[0]["shard"].alias(shard),
        (c(runs)[0]["slot"] + c(rank) - c(runs)[0]["first"]).alias(slot),
    )
