"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from kermesse.llm.common import WHITE_SPACE, free_name, materialise, slices

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5  # of the score of an exact copy
BLOCK_BYTES = 32 << 20  # of benchmark text that a pass over the documents looks for

_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, of no other meaning

_SPACES, _NOT_WORD = re.compile(f"[{WHITE_SPACE}]+"), re.compile(r"\W+")

# For each piece of a document around some hits: its words, the n-gram hashes found in it, and the
# number of its first word in the document.
_HITS = "piece_words string, grams array<long>, piece_start long"


def plain(word: str) -> str:
    """A word without case and without characters that are not letters, digits or underscores."""
    return _NOT_WORD.sub("", word.casefold())


def words_of(text: str | None) -> list[str]:
    """The plain words of a text, without empty ones; null has none."""
    return [word for raw in _SPACES.split(text or "") if (word := plain(raw))]


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def gram_hashes(hashes: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """One number per run of `n` word hashes."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        total = (total + hashes[i : len(hashes) - n + 1 + i]) * _FACTOR
        total ^= total >> np.uint64(29)
    return total


def item_grams(text: str | None) -> np.ndarray:
    """The n-gram hashes of a benchmark item. A shorter item is one n-gram of all its words."""
    hashes = np.array([word_hash(w) for w in words_of(text)], dtype=np.uint64)
    return gram_hashes(hashes, min(SEED_WORDS, max(len(hashes), 1)))


class Seeds:
    """The n-gram hashes of a block of the benchmark, for fast lookup from many at once."""

    def __init__(self, items: list[str | None]):
        found = {n: [] for n in range(1, SEED_WORDS + 1)}
        self.reach = 1
        for text in items:
            size = len(words_of(text))
            if size:
                found[min(size, SEED_WORDS)].append(item_grams(text))
                self.reach = max(self.reach, size)
        self.by_length = {n: np.unique(np.concatenate(g)) for n, g in found.items() if g}
        self.filters = {}
        for n, grams in self.by_length.items():
            bits = max(16, int(len(grams) * 64).bit_length())
            table = np.zeros(1 << bits, dtype=bool)
            table[(grams >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.filters[n] = (np.uint64(64 - bits), table)

    def hits(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, n-gram hashes) of the n-grams that lie inside one document and are seeds."""
        places, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for n, known in self.by_length.items():
            all_grams = gram_hashes(hashes, n)
            shift, table = self.filters[n]
            at = np.flatnonzero(table[(all_grams >> shift).astype(np.int64)])
            at = at[doc[at] == doc[at + n - 1]]
            spot = np.minimum(np.searchsorted(known, all_grams[at]), len(known) - 1)
            at = at[known[spot] == all_grams[at]]
            places.append(at)
            grams.append(all_grams[at])
        at, found = np.concatenate(places), np.concatenate(grams)
        order = np.argsort(at, kind="stable")
        return at[order], found[order]


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word hash at each place, document of each place, the words)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    words = lists.flatten()
    coded = words.dictionary_encode()
    known = [plain(w) for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy()
    table = np.array([word_hash(w) for w in known], dtype=np.uint64)
    full = np.array([bool(w) for w in known], dtype=bool)[codes] if len(codes) else codes.astype(bool)
    return table[codes[full]], doc[full], words.filter(pa.array(full))


def _pieces(places: np.ndarray, reach: int, low: int, high: int) -> Iterator[tuple[int, int, slice]]:
    """(first word, end, hits) of the stretches of a document within `reach` words of a hit."""
    cuts = np.flatnonzero(np.diff(places) > 2 * reach) + 1
    for begin, end in zip(np.append(0, cuts), np.append(cuts, len(places))):
        yield (
            max(low, int(places[begin]) - reach),
            min(high, int(places[end - 1]) + reach + SEED_WORDS),
            slice(begin, end),
        )


def _find(docs: DataFrame, row: str, text: str, items: list[str | None]) -> DataFrame:
    """(row, piece) of every document that holds an n-gram of the items."""
    schema = StructType([*docs.select(row).schema.fields, *StructType.fromDDL(_HITS).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(items)
        for batch in batches:
            for part in slices(batch, text):
                hashes, doc, words = _coded(part.column(text))
                places, grams = seeds.hits(hashes, doc)
                if not len(places):
                    continue
                rows, texts, all_grams, starts = [], [], [], []
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                first = np.searchsorted(places, bounds)
                for d in np.unique(doc[places]).tolist():
                    own = slice(first[d], first[d + 1])
                    own_places, own_grams = places[own], grams[own]
                    for low, high, hit in _pieces(own_places, seeds.reach, bounds[d], bounds[d + 1]):
                        rows.append(d)
                        texts.append(" ".join(words.slice(low, high - low).to_pylist()))
                        all_grams.append(own_grams[hit].view(np.int64))
                        starts.append(low - bounds[d])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(row).take(pa.array(rows)),
                        pa.array(texts, pa.string()),
                        pa.array(all_grams, pa.list_(pa.int64())),
                        pa.array(starts, pa.int64()),
                    ],
                    names=names,
                )

    return docs.select(row, text).mapInArrow(run, schema)


def align(item: np.ndarray, piece: np.ndarray) -> tuple[int, int, int]:
    """(best local score, first word, end) of the alignment of an item with a piece of text.

    Smith-Waterman with a linear gap cost, a row of the table at a time: the gaps within a row are
    a running maximum. Where the best alignment starts is carried along with each score.
    """
    width = len(piece)
    score = np.zeros(width + 1, dtype=np.int64)
    start = np.arange(width + 1)
    best = (0, 0, 0)
    step = GAP * np.arange(width + 1)
    places = np.arange(width + 1)
    for word in item:
        diagonal = score[:-1] + np.where(piece == word, MATCH, MISMATCH)
        above = score[1:] + GAP
        open_here = np.maximum(diagonal, above)
        came = np.where(diagonal >= above, start[:-1], start[1:])
        fresh = open_here <= 0
        row = np.concatenate([[0], np.where(fresh, 0, open_here)])
        from_start = np.concatenate([[0], np.where(fresh, places[1:], came)])
        level = row - step
        run = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == run, places, 0))
        score = run + step
        start = np.where(score > row, from_start[source], from_start)
        end = int(score.argmax())
        if score[end] > best[0]:
            best = (int(score[end]), int(start[end]), end)
    return best


def _benchmark_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list]:
    """The benchmark in blocks of (id, text), each about BLOCK_BYTES of text, on the driver."""
    keyed = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    hashed = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for block in range(blocks):
        yield keyed.where(hashed == block).distinct().collect()


def overlaps(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """(`id`, item_id, score, first_word, end_word, n_seeds): benchmark items found in documents.

    All n-grams of an item are seeds. A document that holds a seed of an item is aligned with the
    item around its hits, unless it holds too few of the item's words for `min_score`. `score` is the
    alignment's, over that of an exact copy; pairs from `min_score` on are returned, one per document
    and item, the best. Words are counted in the document, plain ones from 0.

    The benchmark is looked for in blocks of bounded size, so a larger one means more passes, not
    larger tasks. The passes emit only the words around hits. Null and blank texts hold and are
    nothing. Repeated benchmark rows count once; repeated documents give a row each per id.
    """
    out = "score double, first_word long, end_word long, n_seeds long"
    found = None
    for items in _benchmark_blocks(benchmark, item, item_text):
        block = _overlaps_block(docs, benchmark, items, id, text, item, min_score, out)
        found = block if found is None else found.union(block)
    best = F.max(F.struct("score", "n_seeds", "first_word", "end_word"))
    return (
        found.groupBy(id, "item_id")
        .agg(best.alias("best"))
        .select(id, "item_id", "best.score", "best.first_word", "best.end_word", "best.n_seeds")
    )


def _overlaps_block(docs, benchmark, items, id, text, item, min_score, out) -> DataFrame:
    pieces = materialise(_find(docs, id, text, [row["text"] for row in items]))
    seeds: dict[int, list[int]] = {}
    for no, row in enumerate(items):
        for gram in np.unique(item_grams(row["text"]).view(np.int64)).tolist():
            seeds.setdefault(gram, []).append(no)
    texts = [row["text"] for row in items]
    ids = [row["item"] for row in items]
    kind = benchmark.schema[item]
    id_field = docs.schema[id]
    schema = StructType(
        [id_field, StructType.fromDDL("item_id long").fields[0], *StructType.fromDDL(out).fields]
    )
    schema.fields[1].dataType = kind.dataType
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded: dict[str, int] = {}
        code = lambda words: np.array([coded.setdefault(w, len(coded)) for w in words], dtype=np.int64)
        known = [code(words_of(t)) for t in texts]
        size = len(coded)
        here = np.zeros(size + 1, dtype=bool)
        for batch in batches:
            rows, item_ids, results = [], [], []
            columns = ("piece_words", "grams", "piece_start")
            pieces = zip(*(batch.column(name).to_pylist() for name in columns))
            for at, (words, grams, offset) in enumerate(pieces):
                hits: dict[int, int] = {}
                for gram in grams:
                    for no in seeds.get(gram, ()):
                        hits[no] = hits.get(no, 0) + 1
                if not hits:
                    continue
                piece = np.array([coded.get(w, size) for w in words_of(words)], dtype=np.int64)
                here[piece] = True
                for no, count in hits.items():
                    full = MATCH * len(known[no])
                    if MATCH * np.count_nonzero(here[known[no]]) < min_score * full:
                        continue  # a score is MATCH for each word found at most
                    score, first, end = align(known[no], piece)
                    if score >= min_score * full:
                        rows.append(at)
                        item_ids.append(ids[no])
                        results.append((score / full, offset + first, offset + end, count))
                here[piece] = False
            columns = list(zip(*results)) or [[], [], [], []]
            types = [pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(item_ids, to_arrow_type(kind.dataType)),
                    *[pa.array(v, t) for v, t in zip(columns, types)],
                ],
                names=names,
            )

    return pieces.select(id, "piece_words", "grams", "piece_start").mapInArrow(run, schema)


def clean_documents(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found, with their columns.

    Rows are told apart by a hash of id and text, so null and repeated ids are judged one by one.
    """
    row = free_name(docs, "row_key")
    key = F.md5(
        F.concat(F.coalesce(F.col(id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("-")))
    )
    keyed = docs.withColumn(row, key)
    bad = overlaps(spark, keyed.select(row, text), benchmark, row, text).select(row).distinct()
    return keyed.join(materialise(bad), row, "left_anti").select(*docs.columns)
