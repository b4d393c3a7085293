"""Phrase collocations: frequent phrases of two to four words, counted by broadcast tries.

Texts become blocks of word codes once, with each block's distinct words. Words are counted over the
cluster, and the frequent ones get an id, which is brought back to the blocks as a list beside their
words. The codes themselves stay in a file per block, which only the Python workers write and read.

Then one pass per phrase length, from the shorter to the longer (Apriori): candidates of a length are
phrases whose parts but one word are frequent, and which stand often enough. A block only says of each
such extension how often it saw it, up to the support that is asked, as proof that it belongs in the
trie. The candidates become double-array tries of bounded size, one broadcast each; every task moves
the states of all its text positions through a trie at once, word by word, adds up the accepting
states of all its blocks, and the sums of all tasks are the counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kermesse.llm.common import new_folder, opened, slices, text_bytes, written

SUPPORT = 30
LONGEST = 4  # words
SCALE = 2_000_000
COVERED = 80  # percent of a phrase's places at which a longer one stands for it
TOP = 2000
NO_LANG = "und"
BLOCK_BYTES = 8 << 20
BLOCKS_PER_FILE = 2  # few, as the lists are a small part of what their tasks read
WINDOW = 1 << 19
TRIE_PHRASES = 1 << 20  # phrases per trie: 60 MB to broadcast at most
CHUNK = 1 << 12  # counts in a row
FAN_IN = 64

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x20, 0x09]] = True


# --- Blocks ---

_BLOCK = "block long, lang string, path string, words array<string>, counts array<int>"


def word_codes(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, distinct words, their counts): one code per word in the order of the texts, and -1
    wherever a piece ends between two of them."""
    raw, offsets = text_bytes(column)
    # A line end after every text keeps its pieces apart from the next one's.
    raw = np.insert(raw, offsets[1:], 10)
    upper = (raw >= 65) & (raw <= 90)
    raw = raw + (upper * np.uint8(32)).astype(np.uint8)
    inside = ~_GAPS[raw]
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    lengths = ends - starts
    bounds = np.append(0, np.cumsum(lengths)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw[inside])]
    ).dictionary_encode()
    codes = words.indices.to_numpy()
    closed = np.append(0, np.cumsum(_ENDS[raw]))
    breaks = np.flatnonzero(np.diff(closed[starts])) + 1
    counts = np.bincount(codes, minlength=len(words.dictionary)).astype(np.int32)
    return np.insert(codes, breaks, -1), words.dictionary.cast(pa.string()), counts


def _one(values, kind: pa.DataType) -> pa.Array:
    array = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)


def save_codes(uri: str, codes: np.ndarray) -> None:
    from pyarrow import parquet

    system, path = opened(uri)
    table = pa.table({"codes": pa.array(codes.astype(np.int32, copy=False))})
    parquet.write_table(table, path, filesystem=system, compression="zstd", row_group_size=max(len(codes), 1))


def load_codes(uri: str) -> np.ndarray:
    from pyarrow import parquet

    system, path = opened(uri)
    with system.open_input_file(path) as file:
        return parquet.ParquetFile(file).read().column("codes").combine_chunks().to_numpy()


def blocks(docs: DataFrame, lang: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Codes of whole texts in blocks of one language each, some MB of text, or one longer text: the
    file of each block's codes, its distinct words and their counts."""
    folder = new_folder(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}

        def close(name: str) -> pa.RecordBatch:
            nonlocal number
            column = pa.concat_arrays([a.cast(pa.large_string()) for a in held.pop(name)])
            sizes.pop(name)
            codes, words, counts = word_codes(column)
            number += 1
            uri = f"{folder}/{uuid.uuid4().hex}.parquet"
            save_codes(uri, codes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([name]),
                    pa.array([uri]),
                    _one(words, pa.string()),
                    _one(counts, pa.int32()),
                ],
                names=["block", "lang", "path", "words", "counts"],
            )

        for batch in batches:
            for piece in slices(batch, "text", block_bytes // 4):
                names = piece.column("lang").dictionary_encode()
                places = names.indices.to_numpy()
                for i, name in enumerate(names.dictionary.to_pylist()):
                    own = piece.column("text").take(pa.array(np.flatnonzero(places == i)))
                    held.setdefault(name, []).append(own)
                    sizes[name] = sizes.get(name, 0) + own.nbytes
                    if sizes[name] >= block_bytes:
                        yield close(name)
                while sum(sizes.values()) >= 2 * block_bytes:
                    yield close(max(sizes, key=sizes.get))
        for name in sorted(held):
            yield close(name)

    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return written(rows, run, _BLOCK)


def _with_ids(blocked: DataFrame, frequent: DataFrame) -> DataFrame:
    """(path, place, id): the files of the blocks' codes with the places and ids of their frequent
    distinct words."""
    places = blocked.select("block", "lang", F.posexplode("words").alias("place", "word"))
    known = places.join(frequent.select("lang", "word", "id"), ["lang", "word"])
    # At most the distinct words of a block, so some MB of text, meet in a row.
    lists = known.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("k"))
    return blocked.select("block", "path").join(lists, "block").select("path", "k.place", "k.id")


# --- Tries ---


class Trie:
    """Double-array trie of phrases of equal length, given as rows of word ids.

    From a state, a word leads to the place `base[state] + symbol`, if `check` there is the state.
    Symbols number the words by how many phrases hold them. `accept` has a phrase's row.
    """

    def __init__(self, phrases: np.ndarray):
        self.phrases = phrases[np.lexsort(phrases.T[::-1])]
        n, length = self.phrases.shape
        self.words, inverse = np.unique(self.phrases, return_inverse=True)
        inverse = inverse.reshape(n, length)
        order = np.argsort(-np.bincount(inverse.ravel()), kind="stable")
        self.symbols = np.empty(len(order), np.int32)
        self.symbols[order] = np.arange(len(order), dtype=np.int32)
        rows = self.symbols[inverse]
        self._reserve(len(self.words) + 1, 2 * n * length + 1024)
        self.base[0] = 1
        nodes = 1 + rows[:, 0]  # the place of each phrase's first word
        self.used[: len(self.words) + 1] = True
        self.check[nodes] = 0
        for depth in range(1, length):
            nodes = self._children(nodes, rows[:, depth])
        self.accept = np.full(len(self.base), -1, np.int32)
        self.accept[nodes] = np.arange(n, dtype=np.int32)
        last = int(np.flatnonzero(self.check >= 0).max()) + len(self.words) + 1
        self.base, self.check = self.base[:last].copy(), self.check[:last].copy()
        self.accept = self.accept[:last].copy()
        del self.used

    def _reserve(self, first: int, size: int) -> None:
        """Arrays for `size` places more, with room for any symbol behind the last one."""
        old = getattr(self, "base", np.zeros(0, np.int32))
        extra = first + size + len(self.words)
        self.base = np.concatenate([old, np.zeros(extra, np.int32)])
        more = np.full(extra, -1, np.int32)
        self.check = np.concatenate([getattr(self, "check", more[:0]), more])
        self.used = np.concatenate([getattr(self, "used", np.zeros(0, bool)), np.zeros(extra, bool)])
        self.first = getattr(self, "first", first)

    def _children(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Give each (parent, symbol) a place; the places, row by row. Rows are sorted, so equal
        pairs stand together. Large families first, at the first base where all their places are
        free; single children then fill the gaps."""
        new = np.append(True, (parents[1:] != parents[:-1]) | (symbols[1:] != symbols[:-1]))
        parent, symbol = parents[new], symbols[new]
        heads = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        sizes = np.diff(np.append(heads, len(parent)))
        place = np.empty(len(parent), np.int64)
        at, width = self.first, 0
        for family in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            head, size = int(heads[family]), int(sizes[family])
            own = np.sort(symbol[head : head + size])
            if size.bit_length() != width:
                at, width = self.first, size.bit_length()
            while True:
                if at + 64 + len(self.words) >= len(self.base):
                    self._reserve(0, len(self.base))
                tries = np.arange(max(1, at - int(own[0])), max(1, at - int(own[0])) + 64)
                free = ~self.used[tries[:, None] + own[None, :]].any(axis=1)
                if free.any():
                    base = int(tries[int(free.argmax())])
                    break
                at += 64
            slots = base + symbol[head : head + size]
            self.used[slots] = True
            place[head : head + size] = slots
            self.base[parent[head]] = base
        single = heads[sizes == 1]
        gaps = np.flatnonzero(~self.used[self.first : len(self.base) - len(self.words)])
        if len(gaps) < len(single):
            self._reserve(0, len(self.base) + len(single))
            gaps = np.flatnonzero(~self.used[self.first : len(self.base) - len(self.words)])
        place[single] = gaps[: len(single)] + self.first
        self.used[place[single]] = True
        self.base[parent[single]] = place[single] - symbol[single]
        self.check[place] = parent
        return place[np.cumsum(new) - 1]

    def rows_at(self, symbols: np.ndarray) -> np.ndarray:
        """For each position of a text of symbols (-1: none) the row of the phrase that starts there,
        or -1. The positions move one word at a time, WINDOW of them at once."""
        length = self.phrases.shape[1]
        padded = np.append(symbols, np.full(length, -1, np.int32))
        found = np.full(len(symbols), -1, np.int32)
        for start in range(0, len(symbols), WINDOW):
            at = np.flatnonzero(symbols[start : start + WINDOW] >= 0) + start
            state = 1 + symbols[at]
            live = self.check[state] == 0
            at, state = at[live], state[live]
            for step in range(1, length):
                ahead = padded[at + step]
                target = self.base[state] + ahead
                live = (ahead >= 0) & (self.check[target] == state)
                at, state = at[live], target[live]
            found[at] = self.accept[state]
        return found

    def symbols_of(self, ids: np.ndarray) -> np.ndarray:
        """Symbols of word ids, -1 for words in no phrase."""
        spot = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        return np.where(self.words[spot] == ids, self.symbols[spot], np.int32(-1))


# --- Passes ---


def _names(length: int) -> list[str]:
    return [f"w{i}" for i in range(1, length + 1)]


def packed(trie, whole: bool) -> bool:
    return trie is not None and whole


def _pass(coded: DataFrame, length: int, trie, whole: bool, extend: bool, support: int) -> DataFrame:
    """One pass over the texts, with two kinds of rows: how often a block holds a phrase of the trie
    with one word more (n up to `support`), where the phrase without its last word is in the trie; and
    at the end of a task the counts of the trie's phrases, CHUNK of them a row (chunk, counts).

    An extension is given by its words (w1 .. w[length + 1]). If the trie is the only one, the phrase
    without its first word must be in it too, and `key` stands for all words: the trie's row and the
    symbol of the last word. Without a trie: pairs of frequent words."""
    names = [*([] if packed(trie, whole) else _names(length + 1)), "key", "n"]
    schema = ", ".join(f"{name} long" for name in names) + ", chunk int, counts binary"
    all_names = [*names, "chunk", "counts"]
    most = 1 << 17

    def extensions(words: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(n), most):
            cut = slice(start, start + most)
            size = len(n[cut])
            columns = [*[pa.array(w[cut]) for w in words], pa.array(n[cut].astype(np.int64))]
            none = [pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *none], names=all_names)

    def shards(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        for chunk, start in enumerate(range(0, len(totals), CHUNK)):
            part = totals[start : start + CHUNK]
            if part.any():
                none = [pa.nulls(1, pa.int64()) for _ in names]
                own = [pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, *own], names=all_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Trie | None = trie.value if trie is not None else None
        totals = np.zeros(len(own.phrases) if own else 0, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                take = lambda name: batch.column(name)[r].values.to_numpy(zero_copy_only=False)
                codes = load_codes(batch.column("path")[r].as_py())
                size = int(codes.max()) + 2
                ids = np.full(size, -1, np.int64)  # the last one stands for code -1
                ids[take("place")] = take("id")
                if own is None:
                    here = ids[codes] >= 0
                    at = np.flatnonzero(here[:-1] & here[1:])
                    number, follow = codes[at].astype(np.int64), codes[at + 1]
                else:
                    symbols = own.symbols_of(ids)
                    symbols[ids < 0] = -1
                    found = own.rows_at(symbols[codes])
                    totals += np.bincount(found + 1, minlength=len(totals) + 1)[1:]
                    if not extend or len(codes) <= length:
                        continue
                    live = (found[:-length] >= 0) & (ids[codes[length:]] >= 0)
                    if whole:
                        live &= found[1 : len(found) - length + 1] >= 0
                    at = np.flatnonzero(live)
                    number, follow = found[at].astype(np.int64), codes[at + length]
                if own is not None and whole:
                    key = number * len(own.words) + symbols[follow]
                    key, n = np.unique(key, return_counts=True)
                    yield from extensions([key], np.minimum(n, support))
                    continue
                key, n = np.unique(number * size + follow, return_counts=True)
                number, follow = key // size, key % size
                words = [ids[number]] if own is None else list(own.phrases[number].T)
                none = np.full(len(n), -1)
                yield from extensions([*words, ids[follow], none], np.minimum(n, support))
        yield from shards(totals)

    # What is read once only, all pairs or nothing but counts, goes to its shuffle without a file.
    return written(coded, run, schema) if trie is not None and extend else coded.mapInArrow(run, schema)


def _totals(found: DataFrame, length: int, trie) -> DataFrame:
    """(w1 .. w[length], n): the sums of all tasks' counts. A task adds up one chunk after another,
    row by row as they come."""
    names = [*_names(length), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(chunk: int, total: np.ndarray) -> pa.RecordBatch:
            seen = np.flatnonzero(total)
            words = trie.value.phrases[chunk * CHUNK + seen].T
            return pa.RecordBatch.from_arrays([*map(pa.array, words), pa.array(total[seen])], names=names)

        chunk, total = -1, None
        for batch in batches:
            for at, part in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                if total is not None and at != chunk:
                    yield close(chunk, total)
                    total = None
                part = np.frombuffer(part, np.int64)
                chunk, total = at, part.copy() if total is None else total + part
        if total is not None:
            yield close(chunk, total)

    rows = found.where("chunk is not null").select("chunk", "counts")
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk")
    return written(dealt, run, ", ".join(f"{name} long" for name in names))


def _summed(found: DataFrame, keys: list[str], support: int) -> DataFrame:
    # Dealt out first: blocks send distinct phrases already, and one shuffle serves the sums.
    sums = found.select(*keys, "n").repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))
    return written(sums.where(F.col("n") >= support).select(*keys))


def _unpacked(keys: DataFrame, length: int, trie) -> DataFrame:
    """(w1 .. w[length + 1]) of the keys that stand for a row of the trie and a symbol."""
    names = _names(length + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Trie = trie.value
        by_symbol = own.words[np.argsort(own.symbols)]
        for batch in batches:
            key = batch.column("key").to_numpy()
            words = [*own.phrases[key // len(by_symbol)].T, by_symbol[key % len(by_symbol)]]
            yield pa.RecordBatch.from_arrays([pa.array(w) for w in words], names=names)

    return written(keys, run, ", ".join(f"{name} long" for name in names))


def frequent_phrases(
    coded: DataFrame, support: int, longest: int, trie_phrases: int = TRIE_PHRASES
) -> list[DataFrame]:
    """(w1 .. wk, n) for each length k from 2 to `longest`: phrases with at least `support` places.

    Tries hold `trie_phrases` phrases at most, dealt out by a hash; where a length has more, each
    trie takes a pass of its own.
    """
    context = coded.sparkSession.sparkContext
    union = lambda frames: reduce(DataFrame.union, frames)
    candidates = _summed(_pass(coded, 1, None, True, True, support), _names(2), support)
    counts = []
    for length in range(2, longest + 1):
        parts = -(-candidates.count() // trie_phrases)
        if not parts:
            break
        part = F.pmod(F.xxhash64(*_names(length)), F.lit(parts))
        sums, longer = [], []
        for p in range(parts):
            table = candidates.where(part == p).select(*_names(length)).toArrow()
            matrix = np.stack([c.to_numpy() for c in table.columns], axis=1)
            if not len(matrix):
                continue
            trie = context.broadcast(Trie(matrix))
            found = _pass(coded, length, trie, parts == 1, length < longest, support)
            sums.append(_totals(found, length, trie))
            if length < longest:
                longer.append(found.where("chunk is null"))
                if packed(trie, parts == 1):
                    keys = _summed(longer.pop(), ["key"], support)
                    candidates = _unpacked(keys, length, trie)
            trie.unpersist()
        counts.append(union(sums))
        if longer:
            candidates = _summed(union(longer), _names(length + 1), support)
    return counts


# --- Scores ---


def _best_cuts(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(p, a, l, r, score, lang) of each phrase by its lowest-scoring cut. The language is that of the
    first word, which is the left part of the first cut."""
    cuts = phrases.select(
        "p", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k")
    ).select("*", F.slice("p", F.lit(1), F.col("k")).alias("left"), F.expr("slice(p, k + 1, size(p) - k)").alias("right"))
    left = counts.select(F.col("p").alias("left"), F.col("n").alias("l"), "lang")
    right = counts.select(F.col("p").alias("right"), F.col("n").alias("r"))
    scored = cuts.join(left, "left").join(right, "right").withColumn("score", _score())
    lowest = F.min(F.struct("score", "k", "l", "r", "a")).alias("x")
    best = scored.groupBy("p").agg(lowest, F.max("lang").alias("lang"))
    return best.select("p", "x.a", "x.l", "x.r", "x.score", "lang")


def _score() -> Column:
    return F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)")


def _pair_scores(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """`_best_cuts` of pairs, which have one cut: their words are met by id, in narrow rows."""
    first = words.select(F.col("id").alias("w1"), F.col("n").alias("l"), "lang")
    second = words.select(F.col("id").alias("w2"), F.col("n").alias("r"))
    rows = pairs.withColumnRenamed("n", "a").join(second, "w2").join(first, "w1")
    return rows.withColumn("score", _score()).select(F.array("w1", "w2").alias("p"), "a", "l", "r", "score", "lang")


def _covered(phrases: DataFrame) -> DataFrame:
    """(p, longer): the count of the most frequent longer phrase that holds p."""
    inner = F.expr(
        "flatten(transform(sequence(2, size(p) - 1), m -> "
        "transform(sequence(1, size(p) - m + 1), i -> slice(p, i, m))))"
    )
    longer = phrases.where(F.size("p") > 2).select(F.explode(inner).alias("p"), F.col("n").alias("longer"))
    return longer.groupBy("p").agg(F.max("longer").alias("longer"))


def _spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with their text in place of word ids."""
    spots = phrases.select("p", F.posexplode("p").alias("i", "id")).join(words, "id")
    texts = spots.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["word"]), " ")
    return phrases.join(texts.select("p", text.alias("phrase")), "p")


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    support: int = SUPPORT,
    longest: int = LONGEST,
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
    trie_phrases: int = TRIE_PHRASES,
) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase stands in a piece of text of one document and language, A-Z in lower case. A null
    language is `und`, a null text empty; repeated rows count each; ties go by count, then by the
    bytes of the phrase; an empty table, or one where nothing is frequent, gives no row. Other
    columns are left out. Memory follows the longest text.
    """
    blocked = blocks(docs, lang, text, block_bytes)
    totals = blocked.groupBy("lang").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")
    )
    pairs = blocked.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    vocabulary = pairs.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))
    frequent = written(
        vocabulary.where(F.col("n") >= support).withColumn("id", F.monotonically_increasing_id())
    )
    coded = written(_with_ids(blocked, frequent), rows_per_file=BLOCKS_PER_FILE)
    found = frequent_phrases(coded, support, longest, trie_phrases)

    counts = frequent.select(F.array("id").alias("p"), "n", "lang")
    for length, part in enumerate(found, 2):
        words = F.array(*_names(length)).alias("p")
        counts = counts.union(part.select(words, "n", F.lit(None).cast("string").alias("lang")))
    counts = written(counts)
    phrases = counts.where(F.size("p") > 1).select("p", "n")
    best = _best_cuts(phrases.where(F.size("p") > 2), counts)
    if found:
        best = best.unionByName(_pair_scores(found[0], frequent))
    share = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVERED
    kept = best.join(_covered(phrases), "p", "left").where(~F.coalesce(share, F.lit(False)))

    # Cut by score and count before phrases are spelled: those tied with the last one stay. Groups
    # first, so that no task sees all phrases of a language.
    order: list[Column] = [F.desc("score"), F.desc("a")]
    group = F.pmod(F.xxhash64("p"), F.lit(FAN_IN))
    first = lambda df, *keys: df.withColumn("at", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("at") <= top)
    near = first(first(kept.drop("longer").withColumn("g", group), "lang", "g"), "lang").drop("g", "at")
    spelled = _spelled(written(near), frequent.select("id", "word"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase")))
    ranked = spelled.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
