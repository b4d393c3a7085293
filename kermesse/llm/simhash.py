"""SimHash near-duplicates: fingerprints, links found by pigeonring filtering, groups of copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from kermesse.llm.common import free_name, materialise, slices
from kermesse.llm.components import components

SHINGLE = 4  # words
SEED = 42
MAX_BITS = 4
SEGMENTS = 5
BLOCK = 4096  # fingerprints compared in one piece


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles: a bit is 1 if set in over half their hashes.

    A text with fewer words is one shingle; a null or blank one has fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(gram, SEED) for gram in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(
            hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """`docs` without its text, with the fingerprint as a signed 64-bit number in `name`."""
    rest = docs.drop(text)
    names = rest.columns
    schema = StructType([*rest.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                values = [fingerprint(t) for t in part.column(text).to_pylist()]
                kept = part.select(names)
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(np.array(values, dtype=np.uint64).view(np.int64))],
                    names=[*names, name],
                )

    return docs.mapInArrow(run, schema)


def _segments(count: int = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment; widths differ by one at most."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def ring_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the fingerprint each belongs to).

    With m segments on a ring and at most t differing bits in all, some chain of consecutive
    segments keeps every prefix of length l within floor(l * t / m) differences. For m = 5, t = 4
    the quotas are 0, 1, 2, 3, 4: the first segment of the chain is equal, the first two differ in
    one bit at most. So two linked fingerprints share a key made of the chain's first segment and
    the second with one of its bits masked.
    """
    one = np.uint64(1)
    keys, owners = [], []
    segments = _segments()
    everyone = np.arange(len(prints))
    for i, (low, width) in enumerate(segments):
        low2, width2 = segments[(i + 1) % len(segments)]
        first = (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
        second = (prints >> np.uint64(low2)) & np.uint64((1 << width2) - 1)
        for bit in range(width2):
            masked = second & ~(one << np.uint64(bit))
            head = np.uint64((i * 16 + bit) << 32)
            keys.append(head | (first << np.uint64(16)) | masked)
            owners.append(everyone)
    return np.concatenate(keys), np.concatenate(owners)


def _chain_holds(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from segment `start` stays within its quotas over the whole ring."""
    segments = _segments()
    parts = np.stack(
        [
            np.bitwise_count((a ^ b) & np.uint64(((1 << width) - 1) << low))
            for low, width in segments
        ]
    ).astype(np.int64)
    holds = np.ones(len(a), dtype=bool)
    total = np.zeros(len(a), dtype=np.int64)
    rows = np.arange(len(a))
    for length in range(1, len(segments) + 1):
        total += parts[(start + length - 1) % len(segments), rows]
        holds &= total <= length * MAX_BITS // len(segments)
    return holds


def _forest(prints: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, another one of its component) that span the components of `prints`."""
    n = len(prints)
    label = np.arange(n)
    left, right = np.triu_indices(n, 1) if n <= 64 else (None, None)
    if left is None:
        pieces = [
            (i + np.nonzero(near)[0], np.nonzero(near)[1])
            for i in range(0, n, 256)
            for near in [np.bitwise_count(prints[i : i + 256, None] ^ prints[None, :]) <= MAX_BITS]
        ]
        left = np.concatenate([p[0] for p in pieces])
        right = np.concatenate([p[1] for p in pieces])
        left, right = left[left < right], right[left < right]
    passes = _chain_holds(prints[left], prints[right], np.full(len(left), start))
    left, right = left[passes], right[passes]
    near = np.bitwise_count(prints[left] ^ prints[right]) <= MAX_BITS
    left, right = left[near], right[near]
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return prints[moved], prints[label[moved]]


_KEYED = "ring_key long, print long"
_LINKS = "left long, right long, ring_key long"


def _runs(
    batches: Iterator[pa.RecordBatch], compare_large: bool
) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(key, its fingerprints, whether it is a piece of a longer run) from rows sorted by key.

    A run of more than BLOCK fingerprints comes in pieces, unless `compare_large`.
    """
    key, held, long_run = None, [], False
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        prints = batch.column(1).to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(cuts[1:], len(keys))
        shared = ends - cuts > 1
        shared[[0, -1]] = True  # these may go on in the batch before or after
        for begin, end in zip(cuts[shared].tolist(), ends[shared].tolist()):
            if keys[begin] != key:
                if key is not None and (long_run or sum(map(len, held)) > 1):
                    yield key, np.concatenate(held), long_run
                key, held, long_run = keys[begin], [], False
            held.append(prints[begin:end])
            if not compare_large and sum(map(len, held)) > (0 if long_run else BLOCK):
                yield key, np.concatenate(held), True
                held, long_run = [prints[:0]], True
    if key is not None and (long_run or sum(map(len, held)) > 1):
        yield key, np.concatenate(held), long_run


def _arrow(left, right, keys) -> pa.RecordBatch:
    as_long = lambda values: pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [as_long(left), as_long(right), pa.array(keys, type=pa.int64())],
        names=["left", "right", "ring_key"],
    )


def _link_runs(compare_large: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, prints, large in _runs(batches, compare_large):
            start = (int(key) >> 36) & 0xF if not compare_large else None
            if large:  # left null: a fingerprint of a key too frequent for one piece
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(len(prints), pa.int64()),
                        pa.array(prints.view(np.int64)),
                        pa.array(np.full(len(prints), key)),
                    ],
                    names=["left", "right", "ring_key"],
                )
                continue
            left, right = _forest(np.unique(prints), start)
            if len(left):
                yield _arrow(left, right, np.full(len(left), key))

    return run


def links(prints: DataFrame, name: str) -> DataFrame:
    """Links (left, right) between the distinct fingerprints of `prints` that span every group
    connected by MAX_BITS or fewer differing bits.

    Fingerprints meet by ring key. Within a key only links that span its groups leave, so a key
    with n fingerprints gives fewer than n rows. Keys with more than BLOCK fingerprints are cut
    into blocks, and pairs of blocks are compared as tasks of their own.
    """

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(begin, 4096).to_numpy(zero_copy_only=False)
                keys, owners = ring_keys(values.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(values[owners])],
                    names=["ring_key", "print"],
                )

    keyed = prints.select(F.col(name).alias("print")).mapInArrow(key_rows, _KEYED)
    by_key = keyed.repartition("ring_key").sortWithinPartitions("ring_key")
    found = materialise(by_key.mapInArrow(_link_runs(False), _LINKS))
    large = found.where("left is null").select("ring_key", F.col("right").alias("print"))
    return found.where("left is not null").select("left", "right").union(_large_links(large))


def _large_links(large: DataFrame) -> DataFrame:
    """Links within keys of more than BLOCK fingerprints: every pair of blocks is one task's run."""
    sizes = large.groupBy("ring_key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = large.join(sizes, "ring_key").withColumn(
        "block", F.pmod(F.xxhash64("print"), F.col("blocks"))
    )
    # A block meets every block from itself on: it is dealt to (block, other) in either role.
    paired = dealt.select(
        "ring_key",
        "print",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda other: F.struct(
                    F.least("block", other).alias("low"), F.greatest("block", other).alias("high")
                ),
            )
        ).alias("pair"),
    )
    run_key = F.xxhash64("ring_key", "pair.low", "pair.high")
    keyed = paired.select(
        ((F.shiftrightunsigned("ring_key", 36).bitwiseAND(F.lit(0xF))).alias("start")),
        run_key.alias("run"),
        "print",
    ).select(
        F.shiftleft("start", 60).bitwiseOR(F.col("run").bitwiseAND(F.lit((1 << 60) - 1))).alias("k"),
        "print",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, prints, _ in _runs(batches, True):
            left, right = _forest(np.unique(prints), (int(key) >> 60) & 0xF)
            if len(left):
                yield _arrow(left, right, np.full(len(left), key))

    by_run = keyed.repartition("k").sortWithinPartitions("k")
    return by_run.mapInArrow(run, _LINKS).select("left", "right")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, `fingerprint` (16 hex digits) and `component_id`, the
    smallest id of the group linked by MAX_BITS or fewer differing bits; null where all are null.

    Only distinct fingerprints are compared, so thousands of exact copies cost one. Rows with a
    null id belong to their group as others do. Texts enter only the fingerprint pass.
    """
    rows = materialise(with_fingerprint(docs.select(id, text), "print", text))
    joined = rows.join(_classes(rows, id), "print")
    return joined.select(
        id,
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def _classes(rows: DataFrame, id: str) -> DataFrame:
    """(print, group, component): each distinct fingerprint's group and its smallest id."""
    prints = rows.groupBy("print").agg(F.min(id).alias("first_id"))
    prints = materialise(prints)
    groups = components(links(prints, "print"))
    labelled = prints.join(groups, prints["print"] == groups["node"], "left").select(
        "print", F.coalesce("label", "print").alias("group"), "first_id"
    )
    # Groups without a link have one fingerprint: only the others need the smallest id of a group.
    smallest = (
        labelled.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("first_id").alias("component"))
    )
    return labelled.join(smallest, "group").select("print", "group", "component")


def one_of_each_group(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with the smallest id of their group, one a group; columns stay.

    Of several such rows, as with a repeated or null id, the one whose text has the smallest hash
    stays. Long texts are moved once, to meet the list of rows that stay.
    """
    row = free_name(docs, "row_key")
    key = F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("-"))))
    narrow = docs.select(F.col(id).alias("id"), key.alias("row_key"), F.col(text).alias("text"))
    rows = materialise(with_fingerprint(narrow, "print", "text"))
    best = (
        rows.join(_classes(rows, "id"), "print")
        .groupBy("group")
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key"))["row_key"].alias(row))
    )
    first = Window.partitionBy(row).orderBy(F.lit(0))
    place = free_name(docs, "place")
    kept = docs.withColumn(row, key).join(best, row)
    return kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns)
