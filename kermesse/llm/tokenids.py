"""Token ids in packed files: each id takes the fewest bits that hold the vocabulary.

Documents are sorted over the cluster, and a task encodes the texts of its range and writes them as
files of whole documents. For that, texts are cut before white space that follows a visible
character; byte-level BPE never joins across such a place, so each distinct piece goes through the
tokenizer once while a worker remembers it, and its ids are dealt out to all its places. A file is:

    magic, bits per id, ids per block, ids, documents, bytes of the index     (a fixed header)
    index of documents: an Arrow stream of their ids and where each one ends
    offsets of the blocks in the payload
    payload: blocks of BLOCK_IDS ids, packed from the lowest bit on

A block starts on a byte, so any run of ids needs the blocks it lies in and nothing else. A task
names its files after its own attempt, and only those of the attempt that Spark commits are listed in
the manifest: files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kermesse.llm.common import materialise, shared_folder, slices, text_bytes

BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 24  # a file is closed after the document that reaches so many ids
READ_IDS = 1 << 20  # ids unpacked at a time
SLICE = 8 << 20
PART_BYTES = 32 << 20  # text per range
JOINED = 256  # new pieces encoded as one text
CACHED_PIECES = 1_500_000  # a worker forgets its pieces beyond this: some 100 MB
CACHED_BYTES = 64  # longer pieces are not kept
GROUP = 1024  # ranges per group of the running sums

_MAGIC = b"TOKBITS1"
_HEADER = struct.Struct("<8sIIQQQ")


# --- Bits ---


def bits_for(vocabulary: int) -> int:
    """Bits that hold any id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def _lanes(bits: int) -> list[tuple[int, int, int, int]]:
    """Eight ids fill `bits` bytes: for each, its first byte, its shift there, and its bytes."""
    return [(j, j * bits // 8, j * bits % 8, (j * bits % 8 + bits + 7) // 8) for j in range(8)]


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the ids at `bits` bits each, padded with zero ids to a multiple of eight."""
    groups = -(-len(ids) // 8)
    values = np.zeros(groups * 8, np.uint64)
    values[: len(ids)] = ids
    values = values.reshape(groups, 8)
    out = np.zeros((groups, bits), np.uint8)
    for lane, first, shift, n in _lanes(bits):
        moved = values[:, lane] << np.uint64(shift)
        for byte in range(n):
            out[:, first + byte] |= (moved >> np.uint64(8 * byte)).astype(np.uint8)
    return out.ravel()


def unpack(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first `n` ids of packed bytes."""
    rows = data.reshape(-1, bits)
    out = np.empty((len(rows), 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane, first, shift, width in _lanes(bits):
        value = np.zeros(len(rows), np.uint64)
        for byte in range(width):
            value |= rows[:, first + byte].astype(np.uint64) << np.uint64(8 * byte)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.ravel()[:n]


# --- Files ---


def _opened(uri: str):
    """(file system, path) of a URI, or of a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def write_file(uri: str, ids: pa.Array, lengths: np.ndarray, tokens: np.ndarray, bits: int) -> None:
    """One packed file of whole documents: their ids, lengths in tokens, and all their tokens."""
    ends = np.cumsum(lengths, dtype=np.int64)
    index = pa.RecordBatch.from_arrays([ids, pa.array(ends)], names=["id", "end"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema) as stream:
        stream.write_batch(index)
    index_bytes = sink.getvalue()
    starts = range(0, len(tokens), BLOCK_IDS)
    sizes = [-(-min(BLOCK_IDS, len(tokens) - s) // 8) * bits for s in starts]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    system, path = _opened(uri)
    with system.open_output_stream(path) as out:
        out.write(
            _HEADER.pack(_MAGIC, bits, BLOCK_IDS, len(tokens), len(ends), index_bytes.size)
        )
        out.write(index_bytes)
        out.write(offsets.tobytes())
        for s in starts:
            out.write(pack(tokens[s : s + BLOCK_IDS], bits).tobytes())


class PackedFile:
    """Random access to a packed file: reads the blocks that hold what is asked for."""

    def __init__(self, uri: str):
        system, path = _opened(uri)
        self._file = system.open_input_file(path)
        head = self._file.read_at(_HEADER.size, 0)
        magic, self.bits, self.block_ids, self.n_ids, self.n_docs, index = _HEADER.unpack(head)
        if magic != _MAGIC:
            raise ValueError(f"no file of packed ids: {uri}")
        stream = pa.ipc.open_stream(self._file.read_at(index, _HEADER.size))
        table = stream.read_next_batch()
        self.ids = table.column("id")
        self.ends = table.column("end").to_numpy()
        blocks = -(-self.n_ids // self.block_ids)
        at = _HEADER.size + index
        self.offsets = np.frombuffer(self._file.read_at(8 * (blocks + 1), at), "<u8").astype(int)
        self._payload = at + 8 * (blocks + 1)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids `start` to `stop` of the file."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        data = self._file.read_at(
            int(self.offsets[last + 1] - self.offsets[first]), self._payload + int(self.offsets[first])
        )
        base = first * self.block_ids
        return unpack(np.frombuffer(data, np.uint8), self.bits, stop - base)[start - base :]

    def document(self, place: int) -> np.ndarray:
        """Ids of the document at `place` in the file."""
        return self.tokens(int(self.ends[place - 1]) if place else 0, int(self.ends[place]))

    def close(self) -> None:
        self._file.close()


# --- Encoding ---


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start in the bytes of all texts: at each text, and at white space right after a
    character that is certainly none. Characters of three bytes that might be white space (those
    led by E1, E2 and E3 80) make no cut, which joins pieces and changes no id."""
    b1, b2, b3, b4 = (np.roll(raw, k) for k in (1, 2, 3, 4))
    space = (raw == 32) | (raw == 10) | (raw == 9) | (raw == 13)
    one = (b1 > 32) & (b1 < 127)
    two = (b2 >= 0xC3) & (b2 <= 0xDF) & (b1 >= 128)
    wide = (b3 == 0xE0) | ((b3 == 0xE3) & (b2 != 0x80)) | ((b3 >= 0xE4) & (b3 < 0xF0))
    three = wide & (b2 >= 128) & (b2 < 0xC0) & (b1 >= 128) & (b1 < 0xC0)
    four = (b4 >= 0xF0) & (b3 >= 128) & (b3 < 0xC0) & (b2 >= 128) & (b2 < 0xC0) & (b1 < 0xC0)
    cut = space & (one | two | three | (four & (b1 >= 128)))
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)


class _Memory:
    """Ids of pieces seen before: bytes and ids in flat arrays, found by a hash and then compared."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)  # the entry of each hash, hashes being sorted
        self.bytes, self.ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.id_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Entries of pieces, -1 for those not held."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[spot] == hashes, self.entry[spot], -1)
        sizes = np.diff(bounds)
        same = (found >= 0) & (np.diff(self.ends)[found] == sizes)
        rows = np.flatnonzero(same & (sizes > 0))
        mine = raw[_runs(bounds[rows], sizes[rows])]
        held = self.bytes[_runs(self.ends[found[rows]], sizes[rows])]
        heads = np.cumsum(sizes[rows]) - sizes[rows]
        if len(rows):
            same[rows] = np.logical_and.reduceat(mine == held, heads)
        return np.where(same, found, -1)

    def add(self, hashes, raw, sizes, ids, id_sizes) -> None:
        """Pieces that `find` did not know; of two with one hash the first is held."""
        first = len(self.ends) - 1
        self.bytes, self.ids = np.concatenate([self.bytes, raw]), np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(id_sizes)])
        fresh, at = np.unique(hashes, return_index=True)
        spot = np.searchsorted(self.hashes, fresh)
        known = np.zeros(len(fresh), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(spot, len(self.hashes) - 1)] == fresh
        self.hashes = np.insert(self.hashes, spot[~known], fresh[~known])
        self.entry = np.insert(self.entry, spot[~known], first + at[~known])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after another."""
    done = np.cumsum(sizes)
    total = int(done[-1]) if len(done) else 0
    return np.repeat(starts - (done - sizes), sizes) + np.arange(total)


_POWERS = np.cumprod(np.full(CACHED_BYTES, 0x9E3779B97F4A7C15, np.uint64))


def _hashes(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each piece, by its first CACHED_BYTES bytes and its length."""
    sizes = np.diff(bounds)
    used = np.minimum(sizes, CACHED_BYTES)
    place = _runs(np.zeros(len(used), np.int64), used)
    terms = (raw[_runs(bounds[:-1], used)].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    sums = np.append(np.uint64(0), np.cumsum(terms))
    ends = np.cumsum(used)
    mixed = sums[ends] - sums[ends - used] + sizes.astype(np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))) * _POWERS[1]


class Encoder:
    """Ids of texts by a tokenizer, each distinct piece encoded once while it is remembered."""

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(spec)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        added = self._tokenizer.get_added_tokens_decoder()
        # Bytes of every id: a byte-level token has a character per byte, an added one is its text.
        self._width = np.zeros(max([*vocabulary.values(), *added]) + 1, np.int64)
        for token, i in vocabulary.items():
            self._width[i] = len(token)
        for i, token in added.items():
            self._width[i] = len(token.content.encode())
        self._memory = _Memory()

    def _encoded(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some pieces, how many each has). Pieces are joined where a text may be cut, and
        the ids dealt out again by the bytes that they stand for."""
        n = len(bounds) - 1
        cut = np.zeros(len(raw) + 1, bool)
        cut[piece_starts(raw, np.array([0, len(raw)]))] = True
        alone = ~cut[bounds[:-1]]
        heads = np.union1d(np.flatnonzero(alone), np.arange(0, n, JOINED))
        tails = np.append(heads[1:], n)
        data = raw.tobytes()
        texts = [data[bounds[a] : bounds[b]].decode() for a, b in zip(heads.tolist(), tails.tolist())]
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        lists = [x.ids for x in found]
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
        reach = np.append(0, np.cumsum(self._width[ids]))
        if reach[-1] != len(raw):
            raise ValueError("the tokenizer is not a byte-level one without normalisation")
        return ids, np.diff(np.searchsorted(reach, bounds))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text); null is empty."""
        raw, offsets = text_bytes(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        bounds = np.append(piece_starts(raw, offsets), len(raw)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]
        ).dictionary_encode()
        own, ends = _flat(pieces.dictionary)
        sizes, hashes = np.diff(ends), _hashes(own, ends)
        if len(self._memory.ends) > CACHED_PIECES:
            self._memory = _Memory()
        memory = self._memory
        entry = memory.find(hashes, own, ends)
        new = np.flatnonzero(entry < 0)
        fresh = own[_runs(ends[new], sizes[new])]
        new_ids, new_counts = self._encoded(fresh, np.append(0, np.cumsum(sizes[new])))
        # Ids of the distinct pieces: what memory holds, then the new ones.
        first = np.empty(len(sizes), np.int64)
        count = np.empty(len(sizes), np.int64)
        old = entry >= 0
        first[old] = memory.id_ends[entry[old]]
        count[old] = np.diff(memory.id_ends)[entry[old]]
        first[new] = len(memory.ids) + np.cumsum(new_counts) - new_counts
        count[new] = new_counts
        flat = np.concatenate([memory.ids, new_ids])
        spot = pieces.indices.to_numpy()
        ids = flat[_runs(first[spot], count[spot])]
        short = sizes[new] <= CACHED_BYTES
        memory.add(
            hashes[new[short]],
            fresh[np.repeat(short, sizes[new])],
            sizes[new[short]],
            new_ids[np.repeat(short, new_counts)],
            new_counts[short],
        )
        done = np.append(0, np.cumsum(count[spot]))
        return ids, np.diff(done[np.searchsorted(bounds, offsets)])


def _flat(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of binary values."""
    _, offsets, data = pieces.buffers()
    bounds = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One encoder per worker process and tokenizer."""
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


# --- Writing and reading ---

_FILES = "part int, seq int, uri string, docs long, ids long"


def write_packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str,
    id: str = "doc_id",
    text: str = "text",
    file_ids: int = FILE_IDS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Encode every text, `end_id` after each, and write packed files in ascending order of `id`
    (nulls first) under `folder`; returns the manifest: uri, docs, ids and `start`, the ids in all
    files before. `tokenizer` is the JSON of a byte-level BPE, a few MB.

    Texts cross the network once and are encoded where they are written. Rows with equal ids stand
    by a hash of their texts; so many of them as there may be are dealt over several ranges, since a
    row number ends the order. Memory is that of a file.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer)
    bits = bits_for(_vocabulary(tokenizer, end_id))
    kind = "<u2" if bits <= 16 else "<u4"
    root, schema = folder.rstrip("/"), _arrow(_FILES)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        part, seq = TaskContext.get().partitionId(), 0
        ids, sizes, data = [], [], []
        amount = 0

        def close() -> pa.RecordBatch:
            uri = f"{root}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            lengths, flat = np.concatenate(sizes), np.concatenate(data)
            write_file(uri, pa.concat_arrays(ids), lengths, flat, bits)
            row = {"part": part, "seq": seq, "uri": uri, "docs": len(lengths), "ids": len(flat)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                flat, counts = encoder.texts(piece.column("text"))
                ids.append(piece.column("id"))
                sizes.append(counts + 1)
                data.append(np.insert(flat, np.cumsum(counts), end_id).astype(kind))
                amount += len(data[-1])
                if amount >= file_ids:
                    yield close()
                    seq, amount, ids, sizes, data = seq + 1, 0, [], [], []
        if ids:
            yield close()

    _make_folder(root)
    order = ["id", "h", "r"]
    keyed = rows.withColumns({"h": F.xxhash64("text"), "r": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(int(total // part_bytes) + 1, *order).sortWithinPartitions(*order)
    return _with_starts(materialise(dealt.select("id", "text").mapInArrow(run, _FILES)))


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def _make_folder(uri: str) -> None:
    system, path = _opened(uri)
    system.create_dir(path, recursive=True)


def _with_starts(files: DataFrame) -> DataFrame:
    """Running sums in two levels: within groups of ranges, and over one row per group."""
    group = F.floor(F.col("part") / GROUP)
    files = files.withColumn("g", group)
    groups = files.groupBy("g").agg(F.sum("ids").alias("all"))
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select(
        "g", F.coalesce(F.sum("all").over(before(Window.orderBy("g"))), F.lit(0)).alias("base")
    )
    own = F.sum("ids").over(before(Window.partitionBy("g").orderBy("part", "seq")))
    found = files.withColumn("own", F.coalesce(own, F.lit(0))).join(bases, "g")
    return found.select("uri", "docs", "ids", (F.col("base") + F.col("own")).alias("start"))


def read_packed(manifest: DataFrame, id: StructField) -> DataFrame:
    """(`id`, start, n_tokens, ids_crc32) of every document in the files of a manifest: ids before
    it, its ids with the end, and the CRC of them as little-endian numbers of 32 bits."""
    files = materialise(manifest)
    schema = StructType(
        [id, *StructType.fromDDL("start long, n_tokens long, ids_crc32 long").fields]
    )

    def described(file: PackedFile, base: int) -> Iterator[pa.RecordBatch]:
        ends = np.append(0, file.ends)
        done = 0
        while done < file.n_docs:
            stop = int(np.searchsorted(ends, ends[done] + READ_IDS, side="right")) - 1
            stop = max(stop, done + 1)
            raw = file.tokens(int(ends[done]), int(ends[stop])).astype("<u4")
            at = ends[done : stop + 1] - ends[done]
            view = memoryview(raw).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    file.ids.slice(done, stop - done),
                    pa.array(base + ends[done:stop]),
                    pa.array(np.diff(at)),
                    pa.array(sums, pa.int64()),
                ],
                names=schema.names,
            )
            done = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = PackedFile(row["uri"])
                yield from described(file, row["start"])
                file.close()

    spread = files.repartition(max(1, files.count()))
    return spread.select("uri", "start").mapInArrow(run, schema)


def token_files(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
    file_ids: int = FILE_IDS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Encode every whole text, append `end_id`, write packed files to `folder` (a new one in the
    shared folder by default), and read each document's place and checksum back from them.

    A null or empty text is `end_id` alone. Null ids come first; rows with equal ids follow each
    other, by a hash of their texts. An empty table writes no file. Other columns are left out. A
    text without white space is one piece, and memory follows the longest text. The folder must be
    one that pyarrow opens on executors (a shared path, s3, gs, hdfs). Strings of special tokens
    become their ids, as in the library by default.
    """
    spec = Path(tokenizer_path).read_text()
    folder = folder or f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    manifest = write_packed(docs, spec, end_id, folder, id, text, file_ids, part_bytes)
    return read_packed(manifest, StructField(id, docs.schema[id].dataType))


def _vocabulary(spec: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1)
