"""Quality rules from repetition inside a text, found with a suffix array over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from kermesse.llm.common import slices, text_bytes

WINDOW = 8  # words; a shorter repeat is ordinary language
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_LONGEST_REPEAT = 100  # words

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, base_failed boolean, kept boolean"
)


def _table_of(members: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(members)] = True
    return found


_IS_SYMBOL, _IS_SPACE = _table_of(SYMBOLS), _table_of(SPACES)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each key among the distinct keys, whether its rank is shared)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.cumsum(new) - 1
    shared = np.bincount(rank)[rank] > 1
    out, tied = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=bool)
    out[order], tied[order] = rank, shared
    return out, tied


def longest_matches(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word position the length of the longest prefix of its suffix that starts elsewhere
    in the same document too.

    Prefix doubling: after a round for h, suffixes of one document that agree on h words share a
    rank. Only suffixes still tied go on, so ordinary text is settled after a few rounds. Ties that
    end give the order; the common prefix of neighbours is read off the ranks of all rounds, from
    the longest step down, and a position's longest match is the larger of its two neighbours'.
    """
    n = len(words)
    best = np.zeros(n, dtype=np.int64)
    if n < 2:
        return best
    rank, tied = _dense(doc * (int(words.max()) + 1) + words)
    last = np.searchsorted(doc, doc, side="right")  # end of each position's document
    rounds, h, live = [rank], 1, np.flatnonzero(tied)
    while len(live):
        after = np.where(live + h < last[live], rank[np.minimum(live + h, n - 1)] + 1, 0)
        sub, tied = _dense(rank[live] * np.int64(n + 1) + after)
        if h == 1:
            rank = _spread(rank)
        fresh = rank.copy()
        fresh[live] = _refine(rank[live], sub)
        rank, h = fresh, 2 * h
        rounds.append(rank)
        live = live[tied]
    order = np.argsort(rank, kind="stable")
    left, right = order[:-1], order[1:]
    same = rounds[0][left] == rounds[0][right]
    left, right = left[same], right[same]
    length = np.zeros(len(left), dtype=np.int64)
    a, b = left.copy(), right.copy()
    for level in range(len(rounds) - 1, -1, -1):
        step = 1 << level
        inside = (a < last[left]) & (b < last[right])
        equal = np.zeros(len(a), dtype=bool)
        equal[inside] = rounds[level][a[inside]] == rounds[level][b[inside]]
        length[equal] += step
        a[equal] += step
        b[equal] += step
    np.maximum.at(best, left, length)
    np.maximum.at(best, right, length)
    return best


def _spread(rank: np.ndarray) -> np.ndarray:
    """Ranks as the number of smaller elements, so that a group has room for its members."""
    counts = np.bincount(rank)
    return (np.cumsum(counts) - counts)[rank]


def _refine(old: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """New ranks of tied elements: the old rank plus the members of its group that are smaller."""
    order = np.argsort(sub, kind="stable")
    o, s = old[order], sub[order]
    place = np.arange(len(o))
    group_start = np.ones(len(o), dtype=bool)
    group_start[1:] = o[1:] != o[:-1]
    run_start = np.ones(len(s), dtype=bool)
    run_start[1:] = s[1:] != s[:-1]
    first_of_group = np.maximum.accumulate(np.where(group_start, place, 0))
    first_of_run = np.maximum.accumulate(np.where(run_start, place, 0))
    out = np.empty_like(old)
    out[order] = o + first_of_run - first_of_group
    return out


def _duplicate_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(SPACES.decode())]
    return len(lines) - len(set(lines))


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a number for every word, the document it is in); equal words have equal numbers."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        doc, codes = doc[codes != empty], codes[codes != empty]
    return codes, doc


def measure(column: pa.Array, max_percent: int, max_longest: int) -> list[np.ndarray]:
    """The columns of MEASURES for an array of texts."""
    raw, bounds = text_bytes(column)
    n = len(column)
    characters = _sums((raw & 0xC0) != 0x80, bounds) - _sums(_IS_SPACE[raw], bounds)
    symbols = _sums(_IS_SYMBOL[raw], bounds)
    dup_lines = np.array([_duplicate_lines(t) for t in column.to_pylist()], dtype=np.int64)
    codes, doc = word_codes(column)
    words = np.bincount(doc, minlength=n).astype(np.int64)
    match = longest_matches(codes, doc)
    starts = np.flatnonzero(match >= WINDOW)
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + match[starts], -1)
    covered = np.cumsum(edge[:-1]) > 0
    repeated = np.bincount(doc[covered], minlength=n).astype(np.int64)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, doc[starts], match[starts])
    failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * words)
    kept = ~failed & (100 * repeated <= max_percent * words) & (longest <= max_longest)
    return [words, characters, symbols, dup_lines, repeated, longest, failed, kept]


def _judged(max_percent: int, max_longest: int, text: str):
    """A function for mapInArrow: (slice of rows, their measures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in batches:
            for part in slices(batch, text):
                yield part, measure(part.column(text), max_percent, max_longest)

    return run


def quality(
    docs: DataFrame,
    text: str = "text",
    max_percent: int = MAX_REPEATED_PERCENT,
    max_longest: int = MAX_LONGEST_REPEAT,
) -> DataFrame:
    """`docs` with MEASURES added; columns of these names are replaced.

    `n_repeat_words` is the number of words in windows of WINDOW words found twice or more in the
    text, `longest_repeat` the longest run of words found twice (0 below WINDOW). A text is kept
    unless it is short, more than `max_percent` of its words are repeated, or a repeat is longer
    than `max_longest`. A null or empty text has no words and is not kept. Rows never meet: there
    is no shuffle, and a task holds a few MB of text, or one text that is longer.
    """
    measures = StructType.fromDDL(MEASURES)
    rest = docs.drop(*measures.names)
    types = [pa.int64()] * 6 + [pa.bool_()] * 2
    judged = _judged(max_percent, max_longest, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in judged(batches):
            arrays = [pa.array(x, type=t) for x, t in zip(found, types)]
            names = [*part.schema.names, *measures.names]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=names)

    return rest.mapInArrow(run, StructType([*rest.schema.fields, *measures.fields]))


def good_documents(
    docs: DataFrame,
    text: str = "text",
    max_percent: int = MAX_REPEATED_PERCENT,
    max_longest: int = MAX_LONGEST_REPEAT,
) -> DataFrame:
    """The rows that `quality` keeps, with the columns they had."""
    judged = _judged(max_percent, max_longest, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in judged(batches):
            yield part.filter(pa.array(found[-1]))

    return docs.mapInArrow(run, docs.schema)
