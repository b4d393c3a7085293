"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

One edit moves a word's vector of letter counts by an L1 distance of one (a letter more or less) or
two (a letter replaced), so near words lie in small balls around each other. Words of each length
have a tree of their own, and a word asks the trees of its own length (distance two) and of the next
(distance one).

The upper part of every tree is fitted to a bounded sample of vectors and cuts the words into cells;
a word is stored in one cell and asks every cell whose box its ball touches. In a cell a second tree
answers all questions at once, box by box. Letter order is verified last: for two vectors that
differ by a letter, the words that the edit makes are looked up among the words stored, so that many
anagrams are never compared in pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kermesse.llm.common import materialise, slices, text_bytes

MIN_LENGTH = 7
MIN_COUNT = 2
TYPO_OF = 31  # a run whose CRC this divides loses a letter
RATIO = 10  # a form is so many times as frequent
CELL_WORDS = 20_000  # words stored per cell, as fitted to the sample
SAMPLE_WORDS = 200_000  # words the cells are fitted to, at most
LEAF = 24  # vectors in a leaf of a cell's tree
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
HOPS = 5  # doublings that follow a chain: each step is RATIO times as frequent, so 2**5 are enough

_LONG_RUN = 64
# Step of the byte-wise CRC, by the low byte of its state.
_CRC_STEP = np.array(
    [zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32
)


# --- Words ---


def _crcs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC of each run of bytes, carried on from its seed."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    state = seeds[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    far = int(np.searchsorted(-lengths, -_LONG_RUN, side="left"))  # runs longer than that
    for step in range(min(int(lengths[0]) if len(lengths) else 0, _LONG_RUN)):
        n = int(np.searchsorted(-lengths, -step, side="left"))
        part = state[far:n]
        byte = raw[starts[far:n] + step]
        state[far:n] = (part >> np.uint32(8)) ^ _CRC_STEP[(part ^ byte) & np.uint32(0xFF)]
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(far):
        run = raw[starts[i] : starts[i] + lengths[i]].tobytes()
        state[i] = zlib.crc32(run, int(seeds[order[i]]))
    out = np.empty(len(order), np.uint32)
    out[order] = state
    return out


def word_rows(ids: list, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, occurrences) of some texts: runs of letters with A-Z in lower case, of at
    least MIN_LENGTH letters once those drawn by their CRC have lost one."""
    raw, offsets = text_bytes(column)
    upper = (raw >= 65) & (raw <= 90)
    raw = raw + (upper * np.uint8(32)).astype(np.uint8)
    lead = np.append(raw[:-1] == 0xC3, False) if len(raw) else np.zeros(0, bool)
    tail = np.roll(lead, 1) if len(raw) else lead
    letter = ((raw >= 97) & (raw <= 122)) | lead | tail
    # A run ends with its text: a mark before each text's first byte and after its last one.
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.append(False, letter[:-1]) & ~edge[:-1] if len(raw) else letter
    starts = np.flatnonzero(letter & ~before)
    after = np.append(letter[1:], False) & ~edge[1:] if len(raw) else letter
    ends = np.flatnonzero(letter & ~after) + 1
    points = np.append(0, np.cumsum(~tail))
    size = points[ends] - points[starts]
    long = size >= MIN_LENGTH
    starts, ends, size = starts[long], ends[long], size[long]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    prefix = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    crc = _crcs(raw, starts, ends - starts, np.array(prefix, np.uint32)[doc])

    typo = crc % TYPO_OF == 0
    whole = np.flatnonzero(~typo)
    lengths = (ends - starts)[whole]
    bounds = np.append(0, np.cumsum(lengths))
    at = np.repeat(starts[whole] - bounds[:-1], lengths) + np.arange(bounds[-1])
    plain = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(whole), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw[at])]
    )
    changed = []
    for i in np.flatnonzero(typo & (size > MIN_LENGTH)).tolist():
        run = raw[starts[i] : ends[i]].tobytes().decode()
        place = int(crc[i]) % len(run)
        changed.append((run[:place] + run[place + 1 :]).encode())
    both = pa.concat_arrays([plain, pa.array(changed, pa.large_binary())]).dictionary_encode()
    counts = np.bincount(both.indices.to_numpy(), minlength=len(both.dictionary))
    return both.dictionary.cast(pa.string()), counts.astype(np.int64)


def words(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(word, n): the distinct words of at least MIN_COUNT occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                found, n = word_rows(part.column("id").to_pylist(), part.column("text"))
                yield pa.RecordBatch.from_arrays([found, pa.array(n)], names=["word", "n"])

    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


# --- Trees ---


class Node(NamedTuple):
    """Words with at most `cut` of letter `axis` go to `low`, the others to `high`; a leaf has a
    number instead."""

    axis: int
    cut: int
    low: object
    high: object
    leaf: int


def letter_counts(found: list[str]) -> np.ndarray:
    """Letter counts of each word, in the order of LETTERS."""
    code = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
    column = np.where(code >= 0xC0, code - 0xC0 + 26, code - 97).astype(np.int64)
    row = np.repeat(np.arange(len(found)), [len(w) for w in found])
    flat = np.bincount(row * len(LETTERS) + column, minlength=len(found) * len(LETTERS))
    return flat.astype(np.int32).reshape(len(found), len(LETTERS))


def build_tree(vectors: np.ndarray, leaf_size: int) -> tuple[Node, list[np.ndarray]]:
    """A k-d tree and the rows in each leaf. Cuts halve the letter count that varies most; rows
    with equal vectors stay together, however many they are."""
    leaves: list[np.ndarray] = []

    def grow(rows: np.ndarray) -> Node:
        part = vectors[rows]
        if len(rows) > leaf_size and (spread := part.var(axis=0)).max() > 0:
            axis = int(spread.argmax())
            values = part[:, axis]
            cut = int(np.median(values))
            cut = min(cut, int(values.max()) - 1)
            under = values <= cut
            if under.any() and not under.all():
                return Node(axis, cut, grow(rows[under]), grow(rows[~under]), -1)
        leaves.append(rows)
        return Node(-1, 0, None, None, len(leaves) - 1)

    root = grow(np.arange(len(vectors)))
    return root, leaves


def visits(root: Node, vectors: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows whose ball of `radius` touches the leaf's box). With radius 0: where rows lie."""
    top = np.iinfo(np.int32).max
    stack = [(root, np.arange(len(vectors)), np.zeros(len(vectors), np.int32), {})]
    while stack:
        node, rows, gone, box = stack.pop()
        if node.axis < 0:
            yield node.leaf, rows
            continue
        value = vectors[rows, node.axis].astype(np.int32)
        least, most = box.get(node.axis, (0, top))
        outside = lambda a, b: np.maximum(np.maximum(a - value, value - b), 0)
        rest = gone - outside(least, most)
        for child, limits in ((node.low, (least, node.cut)), (node.high, (node.cut + 1, most))):
            away = rest + outside(*limits)
            near = away <= radius
            if near.any():
                stack.append((child, rows[near], away[near], {**box, node.axis: limits}))


# --- Cells ---


def fit_cells(sample: list[str], rows: int, cell_words: int) -> dict[int, tuple[Node, int]]:
    """For each length the upper part of its tree and the number of its first cell, such that a
    cell holds about `cell_words` of all `rows` words."""
    per_leaf = max(1, int(cell_words * len(sample) / max(rows, 1)))
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    cells, first = {}, 0
    for length in sorted(by_length):
        root, leaves = build_tree(letter_counts(by_length[length]), per_leaf)
        cells[length] = (root, first)
        first += len(leaves)
    return cells


_PLACED = "cell long, asks boolean, word string, n long"


def place(found: DataFrame, cells: dict[int, tuple[Node, int]]) -> DataFrame:
    """Each word once in the cell that stores it, and once per cell it asks. A length the sample
    lacks has one cell, below zero, for itself."""

    def tree(length: int) -> tuple[Node, int]:
        return cells.get(length, (Node(-1, 0, None, None, 0), -length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_words = batch.column("word").to_pylist()
            vectors = letter_counts(all_words)
            sizes = np.array([len(w) for w in all_words])
            for length in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == length)
                for target, radius, asks in ((length, 0, False), (length, 2, True), (length + 1, 1, True)):
                    root, first = tree(target)
                    for leaf, rows in visits(root, vectors[own], radius):
                        taken = batch.take(pa.array(own[rows]))
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, first + leaf, np.int64)),
                                pa.array(np.full(n, asks)),
                                taken.column("word"),
                                taken.column("n"),
                            ],
                            names=["cell", "asks", "word", "n"],
                        )

    return found.select("word", "n").mapInArrow(run, _PLACED)


def _distinct(found: list[str]) -> tuple[np.ndarray, list[list[str]]]:
    """Distinct vectors, and the words of each."""
    groups: dict[str, list[str]] = {}
    for word in found:
        groups.setdefault("".join(sorted(word)), []).append(word)
    return letter_counts(list(groups)), list(groups.values())


def near_vectors(asking: np.ndarray, stored: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows of `asking`, rows of `stored`) whose L1 distance is exactly `radius`."""
    root, leaves = build_tree(stored, LEAF)
    for leaf, rows in visits(root, asking, radius):
        here = leaves[leaf]
        block = max(1, (1 << 22) // max(1, len(here) * asking.shape[1]))
        for start in range(0, len(rows), block):
            some = rows[start : start + block]
            away = np.abs(asking[some][:, None, :] - stored[here][None, :, :]).sum(axis=2)
            a, s = np.nonzero(away == radius)
            if len(a):
                yield some[a], here[s]


def _edits(asking: list[str], out: str | None, into: str) -> Iterator[tuple[str, str]]:
    """(word, edited word): `out` replaced by `into` at each of its places, or for None `into` put
    in at each place where that makes a new word."""
    for word in asking:
        if out is None:
            for p in range(len(word) + 1):
                if not p or word[p - 1] != into:
                    yield word, word[:p] + into + word[p:]
        else:
            p = word.find(out)
            while p >= 0:
                yield word, word[:p] + into + word[p + 1 :]
                p = word.find(out, p + 1)


def cell_pairs(asking: list[str], stored: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs (asked, stored) one edit apart, the words of `stored` having one length and those of
    `asking` that length or one less. Of words of equal length, only pairs in order of vectors."""
    if not stored or not asking:
        return
    length = len(stored[0])
    vectors, groups = _distinct(stored)
    known = set(stored)
    for radius, own in ((2, [w for w in asking if len(w) == length]), (1, [w for w in asking if len(w) < length])):
        if not own:
            continue
        asked, askers = _distinct(own)
        for a, s in near_vectors(asked, vectors, radius):
            change = vectors[s].astype(np.int8) - asked[a].astype(np.int8)
            gains, losses = change.argmax(axis=1).tolist(), change.argmin(axis=1).tolist()
            for i, j, gain, loss in zip(a.tolist(), s.tolist(), gains, losses):
                if radius == 1:
                    # Fewer look-ups: a letter taken out of the stored words, or put in the asking ones.
                    if len(groups[j]) <= len(askers[i]):
                        mine = set(askers[i])
                        for word in groups[j]:
                            for shorter in {
                                word[:p] + word[p + 1 :] for p, c in enumerate(word) if c == LETTERS[gain]
                            }:
                                if shorter in mine:
                                    yield shorter, word
                    else:
                        for pair in _edits(askers[i], None, LETTERS[gain]):
                            if pair[1] in known:
                                yield pair
                elif gain < loss:
                    for pair in _edits(askers[i], LETTERS[loss], LETTERS[gain]):
                        if pair[1] in known:
                            yield pair


def near_pairs(found: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, near, near_n), each pair in both directions, of the words of (word, n)."""
    rows = found.count()
    share = min(1.0, 0.9 * SAMPLE_WORDS / max(rows, 1))
    picked = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = [r[0] for r in found.where(picked).select("word").limit(SAMPLE_WORDS).collect()]
    cells = fit_cells(sample, rows, cell_words)

    def run(table: pa.Table) -> pa.Table:
        columns = table.select(["asks", "word", "n"]).to_pydict()
        count = dict(zip(columns["word"], columns["n"]))
        asking = [w for w, asks in zip(columns["word"], columns["asks"]) if asks]
        stored = [w for w, asks in zip(columns["word"], columns["asks"]) if not asks]
        pairs = list(cell_pairs(asking, stored))
        left, right = [a for a, _ in pairs], [b for _, b in pairs]
        return pa.table(
            {
                "word": pa.array(left + right, pa.string()),
                "near": pa.array(right + left, pa.string()),
                "near_n": pa.array([count[w] for w in right + left], pa.int64()),
            }
        )

    placed = place(found, cells)
    return placed.groupBy("cell").applyInArrow(run, "word string, near string, near_n long")


# --- Forms ---


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by doubling: after i rounds, 2**i steps are taken."""
    steps = materialise(forms.select("word", F.col("form").alias("root")))
    for _ in range(HOPS):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(ahead, "root", "left")
        moved = materialise(joined.select("word", F.coalesce("next", "root").alias("root"), "next"))
        steps = moved.drop("next")
        if moved.where("next is not null").isEmpty():
            break
    return steps


def variants(
    docs: DataFrame, id: str = "doc_id", text: str = "text", cell_words: int = CELL_WORDS
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of whole texts.

    A word's form is its most frequent near word (ties: the first by code points), if RATIO times as
    frequent as the word; its root ends the chain of forms. A null or empty text has no word; a null
    id counts as an empty one; repeated rows count each; an empty table gives no row. Other columns
    are left out. What is shuffled are distinct words; a word near very many others is summed in
    parts. The sample bounds the cells only: every word is stored and asks.
    """
    found = materialise(words(docs, id, text))
    pairs = near_pairs(found, cell_words)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    taken = -F.col("best.m") >= RATIO * F.col("n")
    rows = materialise(
        found.join(near, "word", "left").select(
            "word",
            F.when(taken, F.col("best.w")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, -F.col("best.m")).alias("form_n"),
        )
    )
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
