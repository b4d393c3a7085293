"""Merge of the rows that share a key: newest row wins, lists unite, objects fill up.

Two aggregations, both with partial (map-side) aggregation, meet in one join:

* plain values and struct fields take the newest value present, one `max_by` each;
* list items and map entries are exploded to rows, made distinct by (key, column, item), and
  only the distinct ones are gathered per key.

So however many rows a key has, a task sees at most its distinct items - the content of the
merged row itself - never the group.

Both carry a rank beside every value and item, which costs several times the row. Where asked, keys are
counted first: a row whose key no other row has is its own merged row and is not shuffled, and where no
key has many rows, the others are dealt by key as they are, once, and aggregated where they arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kermesse.functions.missing import comparison_key, holds_map, is_missing, present
from kermesse.functions.text import valid_text, wall_micros

OLDEST = -(2**63) + 1
LONG_KEY = 64
# Parts in which the items of the group without a key are put in order, if asked.
SPREAD = 64
NO_KEY = "null"
# Words of 64 bits, by hash, that flag the keys of several rows: 2 MB.
FLAG_WORDS = 1 << 18
# Rows that a key may have where rows are dealt by key before they are aggregated.
MANY = 10_000
NULL_KEYS = ("group", "spread", "apart")

Target = tuple[int, str, T.DataType]  # number of a gathered column, where its values are, their type


def _age_rank(c: Column, dtype: T.DataType) -> Column:
    """Orderable long that grows with recency; null comes last."""
    if isinstance(dtype, T.TimestampNTZType):
        micros = wall_micros(c)
    elif isinstance(dtype, T.TimestampType):
        micros = F.unix_micros(c)
    elif isinstance(dtype, T.DateType):
        micros = F.unix_date(c).cast("long")
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        micros = c.cast("long")
    else:
        raise TypeError(f"cannot order by a column of type {dtype.simpleString()}")
    return F.coalesce(micros, F.lit(OLDEST))


def _hashable(c: Column, dtype: T.DataType) -> Column:
    """A value that can be hashed: each map in it as its entries in order of their keys."""
    if not holds_map(dtype):
        return c
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(e["key"].alias("k"), _hashable(e["value"], dtype.valueType).alias("v")),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _hashable(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.struct(*[_hashable(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    return F.to_json(c)


def _group_key(c: Column) -> Column:
    """Text that is never null, so that both sides of the join keep the aggregations' partitioning.

    A long key (a whole text) is shuffled as its SHA-256.
    """
    long_key = F.concat(F.lit("#"), F.sha2(c, 256))
    return F.coalesce(
        F.when(F.length(c) > LONG_KEY, long_key).otherwise(F.concat(F.lit("="), c)), F.lit(NO_KEY)
    )


def keyless_rows(df: DataFrame, key: str) -> DataFrame:
    """The rows that `merge_by_key` leaves out with `null_keys="apart"`."""
    return df.where(F.col(f"`{key}`").isNull())


def keyless_items(
    df: DataFrame,
    key: str,
    *,
    order_by: str | None = None,
    tie_break: Sequence[str] = (),
    base_only: Sequence[str] = (),
    gather: Mapping[str, str] | None = None,
    gather_text: Mapping[str, str] | None = None,
) -> DataFrame | None:
    """What lists and maps of the group without a key hold when merged, a row per item.

    For a group whose lists pass the 2 GB that a row may have. Rows are (`column`, `place`, a column
    per target with the item's value); a target's items stand in the order of `merge_by_key`, by
    `place`, in partitions sorted by it, so no task holds more than a range of them. A map's items are
    structs of key and value. None where there is no such column; arguments as in `merge_by_key`.
    """
    gather, gather_text = dict(gather or {}), dict(gather_text or {})
    types = {f.name: f.dataType for f in df.schema.fields}
    work, forward, backward = _ranked(keyless_rows(df, key), key, types, order_by, tie_break)
    lists, maps, _ = _kinds(types, key, tie_break, base_only)
    exploded, targets, _ = _exploded_items(work, types, lists, maps, gather, gather_text, forward, backward)
    if exploded is None:
        return None
    fields = [f"o{i}" for i in range(len(forward))] + ["i"]
    order = [F.col("c"), *[F.col(f"r.{f}").desc() for f in fields]]
    rows = _first_sights(exploded).repartitionByRange(*order).sortWithinPartitions(*order)
    names = F.array(*[F.lit(t) for t in targets])
    return rows.select(
        F.get(names, "c").alias("column"),
        F.monotonically_increasing_id().alias("place"),
        *[F.when(F.col("c") == j, F.col(v)).alias(t) for t, (j, v, _) in targets.items()],
    )


def _kinds(
    types: Mapping[str, T.DataType], key: str, tie_break: Sequence[str], base_only: Sequence[str]
) -> tuple[list[str], list[str], list[str]]:
    """Names of the list columns, the map columns and all columns that hold values."""
    values = [n for n in types if n != key and n not in set(tie_break)]
    lists = [n for n in values if isinstance(types[n], T.ArrayType) and n not in base_only]
    maps = [n for n in values if isinstance(types[n], T.MapType) and n not in base_only]
    return lists, maps, values


def _ranked(
    df: DataFrame,
    key: str,
    types: Mapping[str, T.DataType],
    order_by: str | None,
    tie_break: Sequence[str],
) -> tuple[DataFrame, list[Column], list[Column]]:
    """Rows with their group key and ranks; the ranks, newest largest and oldest largest."""
    newest = _age_rank(F.col(order_by), types[order_by]) if order_by else F.lit(0).cast("long")
    ties = [F.coalesce(F.col(n).cast("long"), F.lit(0)) for n in tie_break]
    # Rows still tied go by a hash of their content.
    ties.append(F.xxhash64(*[_hashable(F.col(f"`{n}`"), types[n]) for n in df.columns]))
    # Absolute value bounds keep the negated rank inside a long. Ranks are columns of their own, so
    # that no value needed for them is carried, or hashed again, beyond this projection.
    ranks = [newest, *[-F.greatest(t, F.lit(OLDEST)) for t in ties]]
    work = df.select(
        "*",
        _group_key(F.col(key).cast("string")).alias("_key"),
        *[r.alias(f"_o{i}") for i, r in enumerate(ranks)],
    )
    forward = [F.col(f"_o{i}") for i in range(len(ranks))]
    return work, forward, [-r for r in forward]


def merge_by_key(
    df: DataFrame,
    key: str,
    *,
    order_by: str | None = None,
    tie_break: Sequence[str] = (),
    base_only: Sequence[str] = (),
    gather: Mapping[str, str] | None = None,
    gather_text: Mapping[str, str] | None = None,
    normalised: bool = False,
    null_keys: str = "group",
    count_first: bool = False,
) -> DataFrame:
    """One row per key; null keys form one group.

    `order_by`: column that tells which row is newest (null is oldest). `tie_break`: numeric
    columns, ascending, among rows equally new; a hash of the row decides the rest, so the result
    never depends on partitioning. `base_only`: columns taken from the newest row even
    when missing there. `gather` / `gather_text`: new list column -> source column whose distinct
    values (distinct stripped texts) are listed newest first. `normalised`: missing values of
    whole columns are null already. `null_keys`: with "group" the rows without a key become one row
    as any other; with "spread" too, but its items, which may be a large part of all, are put in
    order in SPREAD parts before they meet; with "apart" they are left out, and `keyless_rows` has
    them for a table of their own. `count_first`: a job counts the rows of each key, and what is
    shuffled follows from it; the result is the same.
    """
    if null_keys not in NULL_KEYS:
        raise ValueError(f"null_keys must be one of {NULL_KEYS}")
    if null_keys == "apart":
        df = df.where(F.col(f"`{key}`").isNotNull())
    if key not in df.columns:
        raise ValueError(f"key column {key!r} is missing")
    gather, gather_text = dict(gather or {}), dict(gather_text or {})
    types = {f.name: f.dataType for f in df.schema.fields}
    work, forward, backward = _ranked(df, key, types, order_by, tie_break)
    lists, maps, values = _kinds(types, key, tie_break, base_only)
    scalars = [n for n in values if n not in lists and n not in maps]
    order = [key, *values, *gather, *gather_text]

    lone = None
    if count_first:
        several, most = _counted(work, types, lists, maps)
        if several is not False:
            rows = work if several is None else work.where(~several)
            cells = _as_merged(types, lists, maps, scalars, base_only, gather, gather_text, normalised)
            lone = rows.select(*[cells.get(n, F.col(f"`{n}`")).alias(n) for n in order])
            if several is None:
                return lone
            work = work.where(several)
        if most <= MANY:
            work = work.repartition("_key")

    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(forward)])
    aggs = [F.max_by(F.col(key), F.col("_rank")).alias(key)]
    shape: dict[str, Column] = {}
    for n in scalars:
        dtype, c = types[n], F.col(f"`{n}`")
        if n in base_only:
            aggs.append(F.max_by(c, F.col("_rank")).alias(n))
        elif isinstance(dtype, T.StructType):
            for f in dtype.fields:
                cell = c.getField(f.name)
                seen = F.when(~is_missing(cell, f.dataType), F.col("_rank"))
                aggs.append(F.max_by(cell, seen).alias(f"{n}.{f.name}"))
            filled = F.struct(*[F.col(f"`{n}.{f.name}`").alias(f.name) for f in dtype.fields])
            shape[n] = present(filled, dtype)
        else:
            absent = c.isNull() if normalised else is_missing(c, dtype)
            aggs.append(F.max_by(c, F.when(~absent, F.col("_rank"))).alias(n))
    plain = work.withColumn("_rank", rank).groupBy("_key").agg(*aggs)

    spread = null_keys == "spread"
    exploded, targets, of_maps = _exploded_items(
        work, types, lists, maps, gather, gather_text, forward, backward
    )
    if exploded is None:
        joined = plain
    else:
        items = _distinct_items(exploded, targets, of_maps, spread)
        # Every key of `items` is a key of `plain`, so a left join keeps exactly one row per key.
        joined = plain.join(items, "_key", "left")
    merged = joined.select(*[shape.get(n, F.col(f"`{n}`")).alias(n) for n in order])
    return merged if lone is None else lone.unionByName(merged)


def _counted(
    work: DataFrame, types: Mapping[str, T.DataType], lists: Sequence[str], maps: Sequence[str]
) -> tuple[Column | bool | None, int]:
    """Which rows need a merge, and the rows of the most frequent key. Which rows: a condition that
    holds for all that share their key, or hold an item twice, and for some more whose hashes meet;
    None if there is no such row; False if there are so many that they are not worth telling apart."""
    twice = F.lit(False)
    for n in lists:
        element, size = types[n].elementType, F.size(f"`{n}`")
        keys = F.transform(F.col(f"`{n}`"), lambda v: comparison_key(v, element))
        twice |= F.coalesce((size > 1) & (F.size(F.array_distinct(keys)) < size), F.lit(False))
    for n in maps:
        if not isinstance(types[n].keyType, T.StringType):
            keys = F.transform(F.map_keys(F.col(f"`{n}`")), lambda k: k.cast("string"))
            twice |= F.coalesce(F.size(F.array_distinct(keys)) < F.size(f"`{n}`"), F.lit(False))

    def flag(h: Column) -> tuple[Column, Column]:
        bits = F.shiftright(h, FLAG_WORDS.bit_length() - 1)
        return F.pmod(h, F.lit(FLAG_WORDS)).cast("int"), F.pmod(bits, F.lit(64)).cast("int")

    word, bit = flag(F.col("h"))
    counts = work.select(F.xxhash64("_key").alias("h"), twice.alias("t")).groupBy("h")
    counts = counts.agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"))
    flagged = (F.col("n") > 1) | F.col("t")
    # The keys of one row each are one group, which a task counts before the shuffle.
    rows = counts.select("n", F.when(flagged, word).alias("w"), F.when(flagged, bit).alias("b"))
    found = rows.groupBy("w").agg(
        F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"),
        F.sum("n").alias("rows"),
        F.max("n").alias("most"),
    )
    table = found.toArrow()
    most = max(table.column("most").to_pylist(), default=0)
    total = sum(table.column("rows").to_pylist())
    table = table.filter(table.column("w").is_valid())
    if not len(table):
        return None, most
    words = np.zeros(FLAG_WORDS, np.int64)
    words[table.column("w").to_numpy()] = table.column("bits").to_numpy()
    single = total - sum(table.column("rows").to_pylist())
    clear = 1 - int(np.unpackbits(words.view(np.uint8)).sum()) / (64 * FLAG_WORDS)
    if 2 * single * clear < total:
        return False, most
    flags = pa.table({"flags": pa.ListArray.from_arrays(pa.array([0, FLAG_WORDS], pa.int32()), pa.array(words))})
    word, bit = flag(F.xxhash64("_key"))
    return F.getbit(F.get(work.sparkSession.createDataFrame(flags).scalar(), word), bit) == 1, most


def _as_merged(
    types: Mapping[str, T.DataType],
    lists: Sequence[str],
    maps: Sequence[str],
    scalars: Sequence[str],
    base_only: Sequence[str],
    gather: Mapping[str, str],
    gather_text: Mapping[str, str],
    normalised: bool,
) -> dict[str, Column]:
    """The columns, as merged, of a row that is alone with its key and holds no item twice."""
    cells = {n: F.when(F.size(f"`{n}`") > 0, F.col(f"`{n}`")) for n in lists}
    for n in maps:
        value = types[n].valueType
        kept = F.map_filter(F.col(f"`{n}`"), lambda _, v: ~is_missing(v, value))
        cells[n] = F.when(F.size(kept) > 0, kept)
    for n in scalars:
        dtype, c = types[n], F.col(f"`{n}`")
        if n in base_only:
            continue
        if isinstance(dtype, T.StructType):
            fields = [present(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
            cells[n] = present(F.struct(*fields), dtype)
        elif not normalised:
            cells[n] = present(c, dtype)
    texts = {t: valid_text(F.col(f"`{n}`")) for t, n in gather_text.items()}
    for t, c in {**{t: F.col(f"`{n}`") for t, n in gather.items()}, **texts}.items():
        cells[t] = F.when(c.isNotNull(), F.array(c))
    return cells




def _exploded_items(
    work: DataFrame,
    types: Mapping[str, T.DataType],
    lists: Sequence[str],
    maps: Sequence[str],
    gather: Mapping[str, str],
    gather_text: Mapping[str, str],
    forward: list[Column],
    backward: list[Column],
) -> tuple[DataFrame | None, dict[str, Target], list[str]]:
    """A row per item of the list and map columns, the columns, and which of them are maps."""
    # target column -> (value type, its items: array and whether to number it, key of a value, ranks)
    sources: dict[str, tuple[T.DataType, Column, bool, Callable[[Column], Column], list[Column]]] = {}
    same = lambda v: v
    for n in lists:
        element = types[n].elementType
        item_key = lambda v, element=element: comparison_key(v, element)
        sources[n] = (element, F.col(f"`{n}`"), True, item_key, forward)
    for n in maps:
        # Objects fill up from the oldest row on: old keys keep their place, new values win.
        # That is the list rule with time reversed.
        pair = T.StructType(
            [T.StructField("key", types[n].keyType), T.StructField("value", types[n].valueType)]
        )
        entry_key = lambda v: v["key"].cast("string")
        sources[n] = (pair, F.map_entries(F.col(f"`{n}`")), True, entry_key, backward)
    for target, n in gather.items():
        # Here text differs by its white space too.
        dtype = types[n]
        exact = same if isinstance(dtype, T.StringType) else lambda v, t=dtype: comparison_key(v, t)
        sources[target] = (dtype, F.col(f"`{n}`"), False, exact, forward)
    for target, n in gather_text.items():
        sources[target] = (T.StringType(), valid_text(F.col(f"`{n}`")), False, same, forward)
    if not sources:
        return None, {}, []

    targets = list(sources)
    # One value field per type, not per target: rows are sorted and shuffled with all fields.
    slots: list[T.DataType] = []
    for dtype, *_ in sources.values():
        if dtype not in slots:
            slots.append(dtype)
    slot = {t: slots.index(sources[t][0]) for t in targets}

    def tagged(j: int) -> Column:
        """Items of a target as flat structs. Keys are computed after the explode, where they are
        compiled, as bodies of array functions are not."""
        _, source, many, _, _ = sources[targets[j]]
        own = slot[targets[j]]

        def item(x: Column, i: Column) -> Column:
            cells = [x if m == own else F.lit(None).cast(t) for m, t in enumerate(slots)]
            return F.struct(
                F.lit(j).alias("c"),
                i.cast("long").alias("i"),
                *[v.alias(f"v{m}") for m, v in enumerate(cells)],
            )

        if many:
            numbered = F.transform(source, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
            return F.transform(numbered, lambda p: item(p["v"], p["i"]))
        return F.when(source.isNotNull(), F.array(item(source, F.lit(0))))

    every = F.concat(*[F.coalesce(tagged(j), F.array()) for j in range(len(targets))])
    backwards = [j for j, t in enumerate(targets) if sources[t][4] is backward]
    ranks = [
        (F.when(F.col("x.c").isin(*backwards), b).otherwise(f) if backwards else f).alias(f"o{m}")
        for m, (f, b) in enumerate(zip(forward, backward))
    ]
    rows = work.select("_key", *forward, every.alias("_all"))
    # Outer, and the rows without items left out after it: before an inner one the optimizer puts a
    # filter that builds every list of items twice more.
    exploded = rows.select("_key", *forward, F.explode_outer("_all").alias("x"))
    kept = F.col("x").isNotNull()
    item_key = F.lit(None).cast("string")
    for j, t in enumerate(targets):
        own, value = F.col("x.c") == j, F.col(f"x.v{slot[t]}")
        item_key = F.when(own, sources[t][3](value)).otherwise(item_key)
        if t in maps:
            kept &= ~(own & is_missing(value["value"], types[t].valueType))
    exploded = exploded.where(kept).select(
        "_key",
        "x.c",
        item_key.alias("k"),
        F.struct(*[F.col(f"x.v{m}") for m in range(len(slots))]).alias("v"),
        F.struct(*ranks, (-F.col("x.i")).alias("i")).alias("r"),
    )
    return exploded, {t: (j, f"v.v{slot[t]}", sources[t][0]) for j, t in enumerate(targets)}, list(maps)


def _first_sights(exploded: DataFrame) -> DataFrame:
    return exploded.groupBy("_key", "c", "k").agg(
        # Place of the first sight, value of the last one.
        F.max("r").alias("r"),
        F.min_by("v", "r").alias("v"),
    )


def _distinct_items(
    exploded: DataFrame, targets: Mapping[str, Target], maps: Sequence[str], spread: bool
) -> DataFrame:
    """Per key, each list and map column rebuilt from its distinct items."""
    distinct = _first_sights(exploded)
    cells = [
        F.collect_list(
            F.when(F.col("c") == j, F.struct("r", F.col(v).alias("v")))
        ).alias(t)
        for t, (j, v, _) in targets.items()
    ]

    def newest_first(t: str) -> Column:
        c = F.col(f"`{t}`")
        if not holds_map(targets[t][2]):
            return F.sort_array(c, asc=False)  # no two items of a list have one rank
        return F.array_sort(
            c, lambda a, b: F.when(a["r"] > b["r"], -1).when(a["r"] < b["r"], 1).otherwise(0)
        )

    keyless = F.col("_key") == NO_KEY
    gathered = distinct.where(~keyless if spread else F.lit(True)).groupBy("_key").agg(*cells)
    if spread:
        # Sorted runs, which the last sort only merges: it takes SPREAD rows, not one per item.
        part = F.pmod(F.xxhash64("c", "k"), F.lit(SPREAD)).alias("_part")
        parts = distinct.where(keyless).groupBy("_key", part).agg(*cells)
        runs = parts.select("_key", *[newest_first(t).alias(t) for t in targets])
        whole = runs.groupBy("_key").agg(
            *[F.flatten(F.collect_list(F.col(f"`{t}`"))).alias(t) for t in targets]
        )
        gathered = gathered.unionByName(whole)

    def rebuilt(t: str) -> Column:
        out = F.transform(newest_first(t), lambda x: x["v"])
        if t in maps:
            out = F.map_from_entries(out)
        return F.when(F.size(F.col(f"`{t}`")) > 0, out).alias(t)

    return gathered.select("_key", *[rebuilt(t) for t in targets])
