"""Language-model scores: a Katz backoff model of words, word pairs and word triples.

Counts are discounted by Good-Turing up to DISCOUNTED, level by level; what a context loses goes to
the words not seen after it, by the probability one level down, with a weight that makes each
context's probabilities sum to one. A token is evaluated from the triple down: triple seen, else
backoff weight times the pair's probability; pair seen, else backoff weight times the word's; word
seen, else the mass of unknown words.

Texts are cut into blocks of some MB. A block numbers its words once, sends its distinct words to
word partitions and its distinct triples, with the documents they stand in, to triple partitions, as
arrays. So a word or triple crosses the network once per block, not once per occurrence, and no table
of all words or triples meets in one task.

Triples are dealt by their middle word b. The triples a b w of one b hold all that both levels ask
for: a count of a b is the sum over w, a count of b w the sum over a. Middle words too frequent for one
partition are dealt by a and b. The pairs b w of these are counted beforehand, in the word partition of
w; the pairs a b too frequent for one partition are dealt by all three words, and summed up at the end.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from kermesse.llm.common import materialise, slices, text_bytes

HELD_OUT_OF = 10  # a document is held out if the CRC of its id is a multiple of this
DISCOUNTED = 5  # counts up to this are discounted by Good-Turing
TAIL = 1e-3  # share of larger counts that goes to unseen words, so that no context lacks some
ADDED = 0.1  # of the base score
HOT_SHARE = 1e-3  # words and pairs with more of the tokens, or than a partition's, are dealt over several
BLOCK_BYTES = 16 << 20
MAX_BUCKETS = 50_000  # the session refuses more than 100,000
BLOCK_DOCS = 32_000  # document numbers in a block fit 16 bits
BEGIN = -1  # an id beside the words'; the end is the word "", which no text has

_MIX = np.uint64(0x9E3779B97F4A7C15)


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Share of a count r that stays, at place r: Good-Turing, renormalised so that counts above
    DISCOUNTED keep all but TAIL. Where it is undefined or not between 0 and 1, half a count goes."""
    n = lambda r: counts_of_counts.get(r, 0)
    kept = np.full(DISCOUNTED + 1, 1 - TAIL)
    k = DISCOUNTED
    common = (k + 1) * n(k + 1) / n(1) if n(1) else 1.0
    for r in range(1, k + 1):
        kept[r] = (r - 0.5) / r
        if n(r) and n(r + 1) and common < 1:
            share = ((r + 1) * n(r + 1) / (n(r) * r) - common) / (1 - common)
            if 0 < share < 1:
                kept[r] = share
    return kept


class Words:
    """Unigram level: probabilities of words by their training count; they sum to one with the
    unknown words, which are taken to be as many as the words seen once."""

    def __init__(self, tokens: int, counts_of_counts: dict[int, int]):
        self.tokens = tokens
        self.kept = discounts(counts_of_counts)
        small = {r: r * counts_of_counts.get(r, 0) for r in range(1, DISCOUNTED + 1)}
        freed = sum((1 - self.kept[r]) * mass for r, mass in small.items())
        freed += TAIL * (tokens - sum(small.values()))
        unknown = max(1, counts_of_counts.get(1, 0))
        self.unknown = freed / tokens / unknown if tokens else 1 / unknown

    def probability(self, counts: np.ndarray) -> np.ndarray:
        share = np.where(counts > DISCOUNTED, 1 - TAIL, self.kept[np.minimum(counts, DISCOUNTED)])
        return np.where(counts > 0, share * counts / max(self.tokens, 1), self.unknown)


def _list(values, kind: pa.DataType) -> pa.Array:
    """An array with one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _small(values: np.ndarray) -> pa.Array:
    """Numbers from 0 in the narrowest type that holds them."""
    most = int(values.max(initial=0))
    kind = next(t for t in (np.uint8, np.uint16, np.int32, np.int64) if most <= np.iinfo(t).max)
    return _list(values.astype(kind), pa.from_numpy_dtype(kind))


def _steps(values: np.ndarray) -> pa.Array:
    """Ascending numbers, each less the one before."""
    return _list(np.diff(values, prepend=0), pa.from_numpy_dtype(values.dtype))


def _pack(**arrays: pa.Array) -> bytes:
    """Arrays as a compressed Arrow batch: what is moved is mostly small numbers."""
    batch = pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out, pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(batch: pa.RecordBatch, row: int = 0) -> pa.RecordBatch:
    packed = pa.BufferReader(batch.column("packet")[row].as_buffer())
    return pa.ipc.open_stream(pa.CompressedInputStream(packed, "zstd")).read_next_batch()


def _only(batch, name: str, row: int = 0) -> np.ndarray:
    """The list of a row as an array."""
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _long(batch, name: str, row: int = 0) -> np.ndarray:
    return _only(batch, name, row).astype(np.int64)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0. Numbers are sorted with their places in the low bits, where
    both fit: several times faster than to sort places."""
    bits = len(values).bit_length()
    if int(values.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(values, kind="stable")
    both = values.astype(np.int64) << bits
    both |= np.arange(len(values))
    both.sort()
    both &= (1 << bits) - 1
    return both


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct numbers, the first place of each, the number of each value among them)."""
    order = _order(values)
    in_order = values[order]
    starts = _starts(in_order) if len(values) else order
    number = np.empty(len(values), np.int32)
    number[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(values))))
    return in_order[starts], order[starts], number


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# --- Blocks ---

_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word, words of each text, the distinct words), A-Z in lower case. Flat arrays
    throughout: millions of small objects would stay with the worker."""
    raw, offsets = text_bytes(column)
    raw = np.insert(raw, offsets[1:], 0x0A)  # no word reaches into the next text
    raw[(raw >= 65) & (raw <= 90)] += 32
    inside = ~_GAPS[raw]
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    sizes = np.diff(np.searchsorted(starts, offsets + np.arange(len(offsets))))
    lengths = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1 - starts
    bounds = np.append(0, np.cumsum(lengths)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw[inside])]
    ).dictionary_encode()
    return words.indices.to_numpy().astype(np.int32), sizes, words.dictionary.cast(pa.string())


_BLOCK = (
    "sizes array<int>, tokens array<int>, words array<string>, train array<int>, "
    "train_tokens long, often array<string>, often_train array<int>"
)


def _block_rows(docs: DataFrame, block_bytes: int, share: float) -> DataFrame:
    """Blocks of whole documents: ids, which are held out, words each, all words as numbers, the
    distinct words and the end with their training counts, and the words with at least half of
    `share` of these."""
    id_type = docs.schema["id"].dataType
    schema = StructType(
        [
            *StructType.fromDDL("block long").fields,
            StructField("ids", ArrayType(id_type)),
            *StructType.fromDDL("held array<boolean>").fields,
            *StructType.fromDDL(_BLOCK).fields,
        ]
    )

    def close(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        column = lambda name: pa.concat_arrays(whole.column(name).chunks)
        held = column("held").to_numpy(zero_copy_only=False).astype(bool)
        tokens, sizes, words = _coded(column("text"))
        train = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
        often = pa.array(np.flatnonzero((train >= share / 2 * (train.sum() + (~held).sum())) & (train > 0)))
        words = pa.concat_arrays([words, pa.array([""])])
        train = np.append(train, (~held).sum()).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), column("id")),
            _list(held, pa.bool_()),
            _list(sizes.astype(np.int32), pa.int32()),
            _list(tokens, pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
            _list(train, pa.int32()),
            pa.array([int(train.sum())], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(often)], pa.int32()), words.take(often)),
            _list(train[often], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays([pa.array([block]), *lists], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts, size, rows = [], 0, 0
        for batch in batches:
            for part in slices(batch, "text", block_bytes // 8):
                for start in range(0, part.num_rows, BLOCK_DOCS):
                    piece = part.slice(start, BLOCK_DOCS)
                    amount = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                    if parts and (size + amount > block_bytes or rows + piece.num_rows > BLOCK_DOCS):
                        yield close(number, parts)
                        number, parts, size, rows = number + 1, [], 0, 0
                    parts.append(piece)
                    size, rows = size + amount, rows + piece.num_rows
        if parts:
            yield close(number, parts)

    return docs.mapInArrow(run, schema)


# --- Words ---

_WORDS = "part int, block long, packet binary"
_ANSWERS = "block long, packet binary, places array<int>, totals array<long>"


def _stream(one: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document's first token, target, word before it, document) of a block's tokens, an end after
    each document, as places in the block's words; the end is the last word, BEGIN stands behind."""
    sizes, tokens = _long(one, "sizes"), _only(one, "tokens")
    n = len(one.column("train")[0])
    first = np.cumsum(sizes + 1) - 1 - sizes
    target = np.insert(tokens, np.cumsum(sizes), np.int32(n - 1))
    before = np.roll(target, 1)
    before[first] = n
    return first, target, before, np.repeat(np.arange(len(sizes), dtype=np.int16), sizes + 1)


def _hot_numbers(words: pa.Array, hot_words: list[str]) -> np.ndarray:
    """0 for BEGIN, which is the last, 1 and more for frequent words, -1 for others."""
    found = pc.fill_null(pc.index_in(words, value_set=pa.array(hot_words, pa.string())), -2)
    return np.append(found.to_numpy(zero_copy_only=False).astype(np.int64) + 1, 0)


def _hot_pairs(
    target: np.ndarray, before: np.ndarray, hot: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens stand after a frequent word, and the key of their pair, ascending with the target."""
    after = np.flatnonzero(hot[before] >= 0)
    return after, target[after] * np.int64(width) + hot[before[after]]


def _word_requests(blocks: DataFrame, hot_words: list[str], parts: int) -> DataFrame:
    """The distinct words of each block, each with the pairs of a frequent word and it, as packets by
    word partition."""
    width = len(hot_words) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from requests(batch.slice(row, 1))

    def requests(one: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, train = one.column("words")[0].values, _only(one, "train")
        _, target, before, doc = _stream(one)
        after, keys = _hot_pairs(target, before, _hot_numbers(words, hot_words), width)
        learned = ~_only(one, "held").astype(bool)[doc[after]]
        del target, before, doc, after
        keys, _, index = _distinct(keys)
        pair_train = np.bincount(index, weights=learned, minlength=len(keys)).astype(np.int64)
        del index, learned
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words)
        )
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = _order(part)
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        pair_part = part[keys // width]
        pair_order = _order(pair_part)
        pair_bounds = np.searchsorted(pair_part[pair_order], np.arange(parts + 1))
        for p in np.unique(part).tolist():
            places = order[bounds[p] : bounds[p + 1]]
            pairs = pair_order[pair_bounds[p] : pair_bounds[p + 1]]
            own = words.take(pa.array(places))
            packet = _pack(
                places=_steps(places.astype(np.int32)),
                words=pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                train=_small(train[places]),
                pairs=_steps(pairs.astype(np.int32)),
                p_words=_steps(np.searchsorted(places, keys[pairs] // width).astype(np.int32)),
                p_hot=_small(keys[pairs] % width),
                p_train=_small(pair_train[pairs]),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), one.column("block"), pa.array([packet], pa.binary())],
                names=["part", "block", "packet"],
            )

    return blocks.select("block", "held", "sizes", "tokens", "words", "train").mapInArrow(run, _WORDS)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(part, its rows) of batches sorted by part: a task may have several, and holds one."""
    part, rows = None, []
    for batch in batches:
        for r, own in enumerate(batch.column("part").to_pylist()):
            if rows and own != part:
                yield part, rows
                rows = []
            part = own
            rows.append(batch.slice(r, 1))
    if rows:
        yield part, rows


def _dealt(requests: DataFrame, parts: int) -> DataFrame:
    return requests.repartition(parts, "part").sortWithinPartitions("part")


# Places of a frequent word's facts: pairs of count 1 to DISCOUNTED + 1; of the words seen after it,
# those of count 1 to DISCOUNTED, and the summed counts of the others.
_HOT_FACTS = 2 * DISCOUNTED + 2
_FIRST_HOT = DISCOUNTED + 2


def _word_answers(requests: DataFrame, width: int, parts: int) -> DataFrame:
    """For each block's words an id and the training count of the whole corpus, and for its pairs
    with a frequent first word their counts; and a row of block -1 per part: places 0 (words), 1 to
    DISCOUNTED + 1 (words of that count), -1 (tokens), and from _FIRST_HOT on the facts of `width`
    frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _by_part(batches):
            yield from answers(part, found)

    def answers(part: int, found: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [row.column("block")[0].as_py() for row in found]
        rows = [_unpack(row) for row in found]
        first = part << 40
        sizes = [len(row.column("places")[0]) for row in rows]
        words = pa.concat_arrays([row.column("words")[0].values for row in rows])
        codes = words.dictionary_encode().indices.to_numpy()
        train = np.concatenate([_only(row, "train") for row in rows])
        totals = np.bincount(codes, weights=train).astype(np.int64)
        codes = np.split(codes, np.cumsum(sizes)[:-1])
        keys = [
            own[np.cumsum(_only(row, "p_words"))] * np.int64(width) + _only(row, "p_hot")
            for row, own in zip(rows, codes)
        ]
        sizes = [len(own) for own in keys]
        pairs, _, index = _distinct(np.concatenate(keys))
        del keys
        p_train = np.concatenate([_only(row, "p_train") for row in rows])
        p_totals = np.bincount(index, weights=p_train, minlength=len(pairs)).astype(np.int64)
        index = np.split(index, np.cumsum(sizes)[:-1])
        names = ["block", "packet", "places", "totals"]
        for block, row, own, own_pairs in zip(blocks, rows, codes, index):
            packet = _pack(
                places=row.column("places"),
                first=_list([first], pa.int64()),
                codes=_small(own),
                totals=_small(totals[own]),
                pairs=row.column("pairs"),
                p_totals=_small(p_totals[own_pairs]),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([packet], pa.binary()),
                    pa.nulls(1, pa.list_(pa.int32())),
                    pa.nulls(1, pa.list_(pa.int64())),
                ],
                names=names,
            )
        k = DISCOUNTED
        facts = [int(totals.sum()), int((totals > 0).sum())]
        facts += [int((totals == r).sum()) for r in range(1, k + 2)]
        seen = p_totals > 0
        hot, count, of_word = pairs[seen] % width * _HOT_FACTS, p_totals[seen], totals[pairs[seen] // width]
        low = count <= k + 1
        hot_facts = np.bincount(hot[low] + count[low] - 1, minlength=width * _HOT_FACTS)
        rare = of_word <= k
        hot_facts += np.bincount(hot[rare] + k + of_word[rare], minlength=width * _HOT_FACTS)
        hot_facts = hot_facts + np.bincount(
            hot[~rare] + 2 * k + 1, weights=of_word[~rare], minlength=width * _HOT_FACTS
        ).astype(np.int64)
        some = np.flatnonzero(hot_facts)
        places = np.concatenate([np.arange(-1, k + 2), some + _FIRST_HOT])
        facts = np.concatenate([facts, hot_facts[some]])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1]), pa.nulls(1, pa.binary()), _list(places, pa.int32()), _list(facts, pa.int64())],
            names=names,
        )

    return _dealt(requests, parts).mapInArrow(run, _ANSWERS)


def _facts(rows: DataFrame, places: str, values: str) -> dict[int, int]:
    """Sums of the rows of block -1, by place."""
    pairs = rows.where("block = -1").select(F.explode(F.arrays_zip(places, values)).alias("x"))
    return dict(
        pairs.groupBy(F.col(f"x.{places}").alias("place")).agg(F.sum(f"x.{values}")).collect()
    )


def _hot_words(blocks: DataFrame, share: float) -> list[str]:
    """All words with more than `share` of the training tokens, and some with half of it: a word's
    blocks in which it has less than half of `share` add up to less than that."""
    tokens = blocks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0))).first()[0]
    often = blocks.select(F.explode(F.arrays_zip("often", "often_train")).alias("x"))
    found = often.groupBy(F.col("x.often").alias("word")).agg(F.sum("x.often_train").alias("n"))
    return sorted(row["word"] for row in found.where(F.col("n") >= share / 2 * tokens).collect())


# --- Triples ---

# A packet of triples a b w has its middle words (b) with the number of contexts of each, the words
# before them (a) with the number of triples of each context, the words after (t), and for each
# triple its count in training documents and the documents it stands in. What is counted beforehand
# goes along: totals of words, of the pairs b w of frequent b (p_counts), and of the contexts dealt over
# several partitions (c_counts), which have a key (c_keys); numbers that may lack are one higher, or 0.
_TRIPLES = "part int, block long, packet binary"
_INFO = "held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>"


def _scrambled(values: np.ndarray) -> np.ndarray:
    mixed = values.astype(np.uint64) * _MIX
    return (mixed ^ (mixed >> np.uint64(31))) * _MIX >> np.uint64(16)


def _triple_requests(blocks: DataFrame, answers: DataFrame, model: dict, parts: int) -> DataFrame:
    """The distinct triples of each block, as packets by triple partition, and a row with what is
    known of its documents by now. For a model of pairs all words before a context are BEGIN."""
    id_field = blocks.schema["ids"]
    schema = StructType([*StructType.fromDDL(_TRIPLES).fields, id_field, *StructType.fromDDL(_INFO).fields])
    blank = pa.RecordBatch.from_pylist([{}], schema=_arrow_schema(schema))
    hot_words, limit, order = model["hot_words"], model["hot"], model["order"]
    width = len(hot_words) + 1

    def filled(**columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns.get(name, blank.column(name)) for name in schema.names], schema=blank.schema
        )

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.Table.from_batches([], schema=blank.schema)
        one = block.combine_chunks().to_batches()[0]
        number = pa.array([one.column("block")[0].as_py()], pa.int64())
        first, target, middle, doc = _stream(one)
        n = len(one.column("train")[0])
        hot = _hot_numbers(one.column("words")[0].values, hot_words)
        pair_keys = np.sort(_hot_pairs(target, middle, hot, width)[1])
        pair_keys = pair_keys[_starts(pair_keys)]
        ids, totals = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        pair_totals = np.empty(len(pair_keys), np.int64)
        for batch in answers.to_batches():
            for row in range(batch.num_rows):
                answer = _unpack(batch, row)
                places = np.cumsum(_only(answer, "places"))
                ids[places] = _only(answer, "first")[0] + _long(answer, "codes")
                totals[places] = _only(answer, "totals")
                pair_totals[np.cumsum(_only(answer, "pairs"))] = _only(answer, "p_totals")
        ids[n], totals[n] = BEGIN, model["train_docs"]

        held = _only(one, "held").astype(bool)
        sizes = _long(one, "sizes")
        n_known = np.add.reduceat((totals > 0).astype(np.int64)[target], first)
        base = np.add.reduceat(np.log10(totals + ADDED)[target], first) - (sizes + 1) * math.log10(
            model["tokens"] + ADDED * (model["words"] + 1)
        )
        out = [
            filled(
                part=pa.array([int(number[0].as_py()) % parts], pa.int32()),
                block=number,
                ids=one.column("ids"),
                held=one.column("held"),
                n_tokens=_list(sizes + 1, pa.int64()),
                n_known=_list(n_known, pa.int64()),
                base=_list(base, pa.float64()),
            )
        ]

        # Words are numbered anew in the order of their ids, which then go out in small steps.
        by_id = np.append(np.argsort(ids[:n]), n)
        rank = np.empty(n + 1, np.int64)
        rank[by_id] = np.arange(n + 1)
        ids, totals, hot = ids[by_id], totals[by_id], hot[by_id]
        pair_keys = rank[pair_keys // width] * width + pair_keys % width
        in_order = _order(pair_keys)
        pair_keys, pair_totals = pair_keys[in_order], pair_totals[in_order]
        del by_id, in_order

        def pair_total(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Counts of pairs whose first word is frequent; nothing stands before BEGIN but BEGIN."""
            at = np.searchsorted(pair_keys, b * np.int64(width) + hot[a])
            some = pair_totals[np.minimum(at, len(pair_totals) - 1)]
            return np.where(b == n, model["train_docs"], some)

        target, middle = rank[target], rank[middle]
        if order == 2:
            before = np.full_like(middle, n)
        else:
            before = np.roll(middle, 1)
            before[first] = n
        contexts, _, context = _distinct(middle * (n + 1) + before)
        del middle, before, rank
        key = context * np.int64(n + 1) + target
        del context, target
        in_order = _order(key)
        key, doc = key[in_order], doc[in_order]
        del in_order
        starts = _starts(key)
        size = np.diff(np.append(starts, len(key)))
        train = np.add.reduceat(~held[doc], starts, dtype=np.int64)
        c, t = key[starts] // (n + 1), key[starts] % (n + 1)
        del key
        b, a = contexts // (n + 1), contexts % (n + 1)
        del contexts

        c_counts, c_keys = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        both = np.flatnonzero((hot[a] >= 0) & (hot[b] >= 0))
        if order == 3:
            count = pair_total(a[both], b[both])
            both, count = both[count > limit], count[count > limit]
            c_counts[both] = count
        c_keys[both] = hot[a[both]] * width + hot[b[both]] + 1
        p_counts = np.zeros(len(t), np.int64)
        after = np.flatnonzero(hot[b[c]] >= 0)
        p_counts[after] = pair_total(b[c[after]], t[after]) + 1
        del after

        spread = _scrambled(ids[b])
        split = hot[b] >= 0
        spread[split] = _scrambled(spread[split] ^ _scrambled(ids[a[split]]))
        split = c_keys[c] > 0
        spread = spread[c]
        spread[split] = _scrambled(spread[split] ^ _scrambled(ids[t[split]]))
        part = (spread % np.uint64(parts)).astype(np.int32)
        del spread, split
        by_part = _order(part)
        bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
        for p in np.unique(part).tolist():
            own = by_part[bounds[p] : bounds[p + 1]]
            runs = _starts(c[own])
            cs = c[own[runs]]
            b_runs = _starts(b[cs])
            bs = b[cs[b_runs]]
            firsts, _, a_index = _distinct(a[cs])
            ts, _, t_index = _distinct(t[own])
            lengths = size[own]
            at = np.repeat(starts[own] - np.append(0, np.cumsum(lengths)[:-1]), lengths)
            packet = _pack(
                b_ids=_steps(ids[bs]),
                b_counts=_small(totals[bs]),
                b_hot=_small(hot[bs] + 1),
                b_sizes=_small(np.diff(np.append(b_runs, len(cs)))),
                a_ids=_steps(ids[firsts]),
                a_index=_small(a_index),
                c_keys=_small(c_keys[cs]),
                c_counts=_small(c_counts[cs]),
                c_sizes=_small(np.diff(np.append(runs, len(own)))),
                t_ids=_steps(ids[ts]),
                t_counts=_small(totals[ts]),
                t_index=_small(t_index),
                p_counts=_small(p_counts[own]),
                train=_small(train[own]),
                sizes=_small(lengths),
                docs=_small(doc[at + np.arange(len(at))]),
            )
            out.append(
                filled(part=pa.array([p], pa.int32()), block=number, packet=pa.array([packet], pa.binary()))
            )
        return pa.Table.from_batches(out, schema=blank.schema)

    answered = answers.where("block >= 0").select("block", "packet")
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)


# What is known of a packet's documents: the sum of logarithms that no discount changes, how many of
# their tokens take the discount of a triple or pair of count 1 to DISCOUNTED, and the contexts of two
# words (c) and of one (b) that their tokens are backed off from. Contexts have their count, the
# triples or pairs of count 1 to DISCOUNTED, and of the words seen after them the probability one level
# down: of one word its sum; of two words the pairs of count 1 to DISCOUNTED and the summed count of the
# others, over the count of b. Contexts dealt over several partitions, known in part here, have a key.
# The rows of block -1 have these contexts of a partition, and how many pairs (places up to
# DISCOUNTED + 1) and triples (as many more) have each count.
_PARTS = (
    "block long, packet binary, c_keys array<long>, c_facts array<long>, facts array<long>, "
    "places array<int>"
)
_C_FACTS = 2 * DISCOUNTED + 3  # count, count of b, triples, pairs, others


def _triple_parts(requests: DataFrame, model: dict, parts: int) -> DataFrame:
    id_field = requests.schema["ids"]
    schema = StructType([*StructType.fromDDL(_PARTS).fields, id_field, *StructType.fromDDL(_INFO).fields])
    info = [id_field.name, *StructType.fromDDL(_INFO).names]
    blank = pa.RecordBatch.from_pylist([{}], schema=_arrow_schema(schema))
    words: Words = model["unigrams"]
    k = DISCOUNTED

    def filled(**columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns.get(name, blank.column(name)) for name in schema.names], schema=blank.schema
        )

    def counted(home: np.ndarray, counts: np.ndarray, homes: int) -> np.ndarray:
        """How many of each home's counts are 1 to DISCOUNTED."""
        low = (counts > 0) & (counts <= k)
        return np.bincount(home[low] * k + counts[low] - 1, minlength=homes * k).reshape(-1, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_part(batches):
            yield from one_part(rows)

    def one_part(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, packets = [], []
        for row in rows:
            if row.column("ids")[0].is_valid:
                yield filled(block=row.column("block"), **{name: row.column(name) for name in info})
            else:
                blocks.append(pa.array(row.column("block").to_pylist(), pa.int64()))
                packets.append(_unpack(row))
        rows.clear()
        if not packets:
            return

        def joined(name: str) -> np.ndarray:
            return np.concatenate([_long(p, name) for p in packets])

        def numbered(name: str) -> tuple[int, np.ndarray, list[np.ndarray]]:
            """(how many words, the number of each in all packets, the same by packet)."""
            lists = [np.cumsum(_only(p, name)) for p in packets]
            distinct, code = np.unique(np.concatenate(lists), return_inverse=True)
            code = code.astype(np.int32)
            return len(distinct), code, np.split(code, np.cumsum([len(x) for x in lists])[:-1])

        def each(codes: list[np.ndarray], index: str) -> np.ndarray:
            return np.concatenate([x[_only(p, index)] for p, x in zip(packets, codes)])

        # Middle words (b), contexts (c), and the words before (a) and after (t).
        n_b, b_code, _ = numbered("b_ids")
        b_count, b_hot = np.zeros(n_b, np.int64), np.zeros(n_b, np.int64)
        b_count[b_code], b_hot[b_code] = joined("b_counts"), joined("b_hot") - 1
        n_a, _, a_codes = numbered("a_ids")
        c_name = np.repeat(b_code, joined("b_sizes")) * np.int64(n_a) + each(a_codes, "a_index")
        del a_codes, b_code
        contexts, c_first, c_no = _distinct(c_name)
        del c_name
        n_c, c_b = len(contexts), contexts // n_a
        c_key, c_given = joined("c_keys")[c_first], joined("c_counts")[c_first]
        del contexts, c_first
        n_t, t_code, t_codes = numbered("t_ids")
        t_count = np.zeros(n_t, np.int64)
        t_count[t_code] = joined("t_counts")
        chance = words.probability(t_count)
        name = np.repeat(c_no, joined("c_sizes")) * np.int64(n_t) + each(t_codes, "t_index")
        del c_no, t_code, t_codes, t_count

        # Distinct triples, with their context and last word, and the pairs b w of these.
        triples, first, triple = _distinct(name)
        del name
        total = np.bincount(triple, weights=joined("train")).astype(np.int64)
        c, t = triples // n_t, triples % n_t
        del triples
        given = joined("p_counts")[first]
        del first
        pairs, p_first, pair = _distinct(c_b[c] * n_t + t)
        p_b, p_t, given = pairs // n_t, pairs % n_t, given[p_first]
        del pairs, p_first
        p_total = np.bincount(pair, weights=total).astype(np.int64)
        p_total[given > 0] = given[given > 0] - 1
        c_total = np.bincount(c, weights=total, minlength=n_c).astype(np.int64)
        c_total[c_key > 0] = c_given[c_key > 0]
        if model["order"] == 2:
            total[:], c_total[:] = 0, 0
        below = p_total[pair]
        del pair, given

        # What contexts are backed off by.
        own = (p_total > 0) & (b_hot[p_b] < 0)
        b_seen = counted(p_b[own], p_total[own], n_b)
        b_mass = np.bincount(p_b[own], weights=chance[p_t[own]], minlength=n_b)
        hot = np.flatnonzero(b_hot >= 0)
        b_seen[hot], b_mass[hot] = model["hot_seen"][b_hot[hot]], model["hot_mass"][b_hot[hot]]
        from_two = (total == 0) & (c_total[c] > 0)
        spots = (c_key > 0) & (c_total > 0)
        wanted = spots.copy()
        wanted[c[from_two]] = True
        c_row, wanted_c = np.cumsum(wanted) - 1, int(wanted.sum())
        held = np.flatnonzero(wanted[c] & (total > 0))
        home, lower = c_row[c[held]], below[held]
        c_facts = np.column_stack(
            [
                c_total[wanted],
                b_count[c_b[wanted]],
                counted(home, total[held], wanted_c),
                counted(home, lower, wanted_c),
                np.bincount(home, weights=lower * (lower > k), minlength=wanted_c).astype(np.int64),
            ]
        )
        numbers = np.arange(1, k + 2)
        facts = [int((p_total[own] == r).sum()) for r in numbers]
        facts += [int((total == r).sum()) for r in numbers]
        yield filled(
            block=pa.array([-1], pa.int64()),
            c_keys=_list(c_key[spots], pa.int64()),
            c_facts=_list(c_facts[c_row[spots]].ravel(), pa.int64()),
            facts=_list(facts, pa.int64()),
            places=_list(np.arange(1, 2 * k + 3), pa.int32()),
        )
        del p_b, p_t, p_total, own, held, home, lower, wanted

        # What tokens take: the triple's count, else the pair's, else the word's.
        log = lambda counts: np.log10(np.maximum(counts, 1))
        count = np.where(total > 0, total, below)
        fixed = np.where(
            count > 0, log(count) - log(np.where(total > 0, c_total[c], b_count[c_b[c]])), np.log10(chance)[t]
        )
        fixed[count > k] += math.log10(1 - TAIL)
        step = np.where((count > 0) & (count <= k), np.where(total > 0, 0, k) + count - 1, -1)
        from_one = (count == 0) & (b_count[c_b[c]] > 0)
        del count, total, below, t
        start = 0
        for block, packet in zip(blocks, packets):
            sizes, docs = _only(packet, "sizes"), _only(packet, "docs")
            here = np.repeat(triple[start : start + len(sizes)], sizes)
            start += len(sizes)
            stands = np.bincount(docs) > 0
            names, spot = np.flatnonzero(stands), (np.cumsum(stands) - 1)[docs]
            logs = np.bincount(spot, weights=fixed[here], minlength=len(names))
            small = step[here] >= 0
            seen = np.bincount(spot[small] * 2 * k + step[here][small], minlength=len(names) * 2 * k)
            c_events, b_events = np.flatnonzero(from_two[here]), np.flatnonzero(from_one[here])
            own_c, c_place = np.unique(c[here[c_events]], return_inverse=True)
            own_b, b_place = np.unique(c_b[c[here[b_events]]], return_inverse=True)
            known = _pack(
                docs=_small(names),
                logs=_list(logs, pa.float64()),
                seen=_small(seen),
                c_docs=_small(docs[c_events]),
                c_place=_small(c_place),
                c_keys=_small(c_key[own_c]),
                c_facts=_small(c_facts[c_row[own_c]].ravel()),
                b_docs=_small(docs[b_events]),
                b_place=_small(b_place),
                b_counts=_small(b_count[own_b]),
                b_seen=_small(b_seen[own_b].ravel()),
                b_mass=_list(b_mass[own_b], pa.float64()),
            )
            yield filled(block=block, packet=pa.array([known], pa.binary()))

    return _dealt(requests, parts).mapInArrow(run, schema)


def backoff_weights(
    counts: np.ndarray, seen: np.ndarray, mass: np.ndarray, kept: np.ndarray
) -> np.ndarray:
    """Log10 of what a context hands to each word unseen after it, over that word's probability one
    level down: the share it loses to discounts, over that probability of all words unseen after it."""
    r = np.arange(1, DISCOUNTED + 1)
    freed = seen @ ((1 - kept[1:]) * r) + TAIL * (counts - seen @ r)
    return np.log10(freed / counts) - np.log10(1 - mass)


def _two_word_weights(facts: np.ndarray, kept_two: np.ndarray, kept_three: np.ndarray) -> np.ndarray:
    """`backoff_weights` of contexts of two words."""
    k = DISCOUNTED
    count, count_b, seen = facts[:, 0], facts[:, 1], facts[:, 2 : k + 2]
    low, others = facts[:, k + 2 : 2 * k + 2], facts[:, 2 * k + 2]
    mass = (low @ (kept_two[1:] * np.arange(1, k + 1)) + (1 - TAIL) * others) / count_b
    return backoff_weights(count, seen, mass, kept_three)


# --- Scores ---


def _scores(parts: DataFrame, model: dict, id: str) -> DataFrame:
    two, three, hot = model["kept_two"], model["kept_three"], model["hot_weights"]
    id_field = parts.schema["ids"]
    info = StructType([id_field, *StructType.fromDDL(_INFO).fields])
    narrow = StructType([*StructType.fromDDL("block long, packet binary").fields, *info.fields])
    step = np.log10(np.concatenate([three[1:], two[1:]]))

    def scored(known: pa.RecordBatch) -> bytes:
        docs, logs = _only(known, "docs"), _only(known, "logs").copy()
        logs += _only(known, "seen").reshape(-1, 2 * DISCOUNTED) @ step
        if len(events := _only(known, "c_docs")):
            keys, facts = _only(known, "c_keys"), _long(known, "c_facts").reshape(-1, _C_FACTS)
            part = keys > 0
            weights = np.zeros(len(keys))
            weights[~part] = _two_word_weights(facts[~part], two, three)
            weights[part] = [hot[i] for i in keys[part].tolist()]
            np.add.at(logs, np.searchsorted(docs, events), weights[_only(known, "c_place")])
        if len(events := _only(known, "b_docs")):
            weights = backoff_weights(
                _long(known, "b_counts"),
                _long(known, "b_seen").reshape(-1, DISCOUNTED),
                _only(known, "b_mass"),
                two,
            )
            np.add.at(logs, np.searchsorted(docs, events), weights[_only(known, "b_place")])
        return _pack(docs=_small(docs), logs=_list(logs, pa.float64()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = pa.RecordBatch.from_pylist([{}], schema=_arrow_schema(narrow))
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                columns = {name: row.column(name) for name in narrow.names}
                if row.column("packet")[0].is_valid:
                    columns["packet"] = pa.array([scored(_unpack(row))], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [columns[name] for name in narrow.names], schema=blank.schema
                )

    out = StructType(
        [
            StructField(id, id_field.dataType.elementType),
            *StructType.fromDDL(
                "held_out boolean, n_tokens long, n_known long, base_score double, score double"
            ).fields,
        ]
    )

    def by_block(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks().to_batches()[0]
        known = next(r for r in range(rows.num_rows) if rows.column("ids")[r].is_valid)
        score = np.zeros(len(rows.column("ids")[known].values))
        for r in range(rows.num_rows):
            if r != known:
                packet = _unpack(rows, r)
                score[_only(packet, "docs")] += _only(packet, "logs")
        columns = [rows.column(name)[known].values for name in ("ids", "held", "n_tokens", "n_known", "base")]
        return pa.Table.from_arrays([*columns, pa.array(score)], schema=_arrow_schema(out))

    narrowed = parts.where("block >= 0").mapInArrow(summed, narrow)
    return narrowed.groupBy("block").applyInArrow(by_block, out)


def score(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    order: int = 2,
) -> DataFrame:
    """(`id`, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model, of words and pairs (`order` 2) or of triples too (3), learns from documents whose CRC
    of the id is no multiple of HELD_OUT_OF, and scores all. Tokens are the words, A-Z in lower case,
    and an end. A null or empty text is an end alone; a
    null id counts as the empty text, which is held out. Repeated rows are learned and scored each.
    The tables of blocks, word counts and what triples add to documents are written in the shared
    folder; parts grow in number with the text, so that one holds less than a block does, and a task
    works on one part at a time.
    """
    if order not in (2, 3):
        raise ValueError(f"a model has order 2 or 3, not {order}")
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0
    rows = docs.select(F.col(id).alias("id"), held.alias("held"), F.col(text).alias("text"))
    size, train_docs = rows.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held"))
    ).first()
    parts = int(size // block_bytes) + 1
    share = min(HOT_SHARE, 1 / parts)
    name = f"llm_blocks_{uuid.uuid4().hex}"
    # Bucketed by block, so that the answers come to the blocks and the texts stay. Beyond MAX_BUCKETS
    # blocks a bucket has several.
    _block_rows(rows, block_bytes, share).write.bucketBy(min(parts, MAX_BUCKETS), "block").option(
        "compression", "zstd"
    ).format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    try:
        hot_words = _hot_words(blocks, share)
        requests = _word_requests(blocks, hot_words, parts)
        answers = materialise(_word_answers(requests, len(hot_words) + 1, parts))
        facts = _facts(answers, "places", "totals")
        tokens = facts.get(-1, 0)
        model = {
            "order": order,
            "train_docs": train_docs,
            "tokens": tokens,
            "words": facts.get(0, 0),
            "hot": tokens * share,
            "hot_words": hot_words,
            "unigrams": Words(tokens, facts),
        }
        hot_pairs = _hot_word_facts(facts, model)
        requests = _triple_requests(blocks, answers, model, parts)
        triples = materialise(_triple_parts(requests, model, parts))
    finally:
        spark.sql(f"DROP TABLE {name}")
    found, k = _facts(triples, "places", "facts"), DISCOUNTED
    model["kept_two"] = discounts({r: found.get(r, 0) + hot_pairs[r - 1] for r in range(1, k + 2)})
    model["kept_three"] = discounts({r: found.get(r + k + 1, 0) for r in range(1, k + 2)})
    model["hot_weights"] = _hot_weights(triples, model)
    return _scores(triples, model, id).select(
        id, "held_out", "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _hot_word_facts(facts: dict[int, int], model: dict) -> list[int]:
    """Put into the model what is known of frequent words as contexts; how many pairs have each count."""
    k, words = DISCOUNTED, model["unigrams"]
    table = np.zeros((len(model["hot_words"]) + 1, _HOT_FACTS), np.int64)
    for place, value in facts.items():
        if place >= _FIRST_HOT:
            table.flat[place - _FIRST_HOT] = value
    low = table[:, k + 1 : 2 * k + 1] @ (words.kept[1:] * np.arange(1, k + 1))
    model["hot_seen"] = table[:, :k]
    model["hot_mass"] = (low + (1 - TAIL) * table[:, 2 * k + 1]) / max(words.tokens, 1)
    return table[:, : k + 1].sum(axis=0).tolist()


def _hot_weights(triples: DataFrame, model: dict) -> dict[int, float]:
    """Backoff weights of the contexts dealt over several parts: as many as HOT_SHARE lets be, or one
    a part."""
    zipped = triples.where("block = -1").select(F.posexplode("c_keys").alias("at", "key"), "c_facts")
    fact = lambda i: F.get("c_facts", F.col("at") * _C_FACTS + i)
    sums = [(F.max if i < 2 else F.sum)(fact(i)).alias(f"n{i}") for i in range(_C_FACTS)]
    found = zipped.groupBy("key").agg(*sums).collect()
    if not found:
        return {}
    values = np.array([row[1:] for row in found], dtype=float)
    weights = _two_word_weights(values, model["kept_two"], model["kept_three"])
    return {row[0]: float(w) for row, w in zip(found, weights)}
