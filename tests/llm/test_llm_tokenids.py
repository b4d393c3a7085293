import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from edges import documents, words

from kermesse.llm import tokenids
from kermesse.llm.common import text_bytes

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("bits", [1, 2, 5, 7, 8, 11, 15, 16, 17, 24, 31, 32])
def test_packing_comes_back(bits):
    draw = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = draw.integers(0, 1 << bits, n, dtype=np.uint64)
        packed = tokenids.pack(ids, bits)
        assert len(packed) == -(-n // 8) * bits
        assert tokenids.unpack(packed, bits, n).tolist() == ids.tolist()


def test_bits_for_vocabularies():
    assert [tokenids.bits_for(v) for v in (1, 2, 3, 256, 257, 50_257, 1 << 16, (1 << 16) + 1)] == [
        1, 1, 2, 8, 9, 16, 16, 17,
    ]


def texts():
    draw = random.Random(4)
    parts = [
        "the", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "日本", " ", " ", "　", " ",
        "\u0085", "'s", "'ll", "12", "!?", "😀", "ह", "\x1c", "\x7f", "<|endoftext|>", "Ab", "ﬁ", "​",
    ]
    made = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(600)]
    return [None, "", " ", "x" * 5000, " " * 300, words(3, 20_000), "a  b", *made]


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    rows = texts()
    encoder = tokenids.Encoder(open(PATH).read())
    for part in (rows[:50], rows[50:], rows):  # the third time from memory
        ids, sizes = encoder.texts(pa.array(part, pa.string()))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_pieces_cover_the_text():
    raw, offsets = text_bytes(pa.array(["a b", "", "c", None, " d  e"]))
    assert tokenids.piece_starts(raw, offsets).tolist() == [0, 1, 3, 4, 6]


def wanted(rows, tokenizer):
    """(id, start, n, crc) by plain code; rows with equal ids are compared as a set."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_against_a_plain_version(spark, tokenizer, tmp_path):
    draw = random.Random(6)
    rows = [(i * 3, t, "s") for i, t in enumerate(texts())]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = tokenids.token_files(spark, docs, PATH, 2, folder=str(tmp_path / "ids"), file_ids=4000, part_bytes=9000)
    got = sorted(tuple(r) for r in found.collect())
    assert got == wanted([r[:2] for r in rows], tokenizer)
    files = sorted((tmp_path / "ids").glob("*.ids"))
    assert len(files) > 3
    # Random access: any run of ids is what the whole file holds there.
    file = tokenids.PackedFile(str(files[0]))
    whole = file.tokens(0, file.n_ids)
    for _ in range(50):
        a, b = sorted(draw.randint(0, file.n_ids) for _ in range(2))
        assert file.tokens(a, b).tolist() == whole[a:b].tolist()
    assert np.concatenate([file.document(i) for i in range(file.n_docs)]).tolist() == whole.tolist()


def test_many_blocks_in_a_file(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_257, 3 * tokenids.BLOCK_IDS + 11, dtype=np.uint32)
    path = str(tmp_path / "one.ids")
    tokenids.write_file(path, pa.array([7, 9]), np.array([5, len(ids) - 5]), ids, 16)
    file = tokenids.PackedFile(path)
    assert file.document(0).tolist() == ids[:5].tolist()
    assert file.document(1).tolist() == ids[5:].tolist()
    at = 2 * tokenids.BLOCK_IDS - 3
    assert file.tokens(at, at + 6).tolist() == ids[at : at + 6].tolist()
    with pytest.raises(ValueError):
        (tmp_path / "bad").write_bytes(bytes(64))
        tokenids.PackedFile(str(tmp_path / "bad"))


def test_ties_nulls_clashes_and_an_empty_table(spark, tokenizer):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = sorted(
        (tuple(r) for r in tokenids.token_files(spark, docs, PATH, 2, file_ids=1000, part_bytes=50_000).collect()),
        key=lambda r: r[1],
    )
    want = wanted(rows, tokenizer)
    assert [(r[0]) for r in found] == [r[0] for r in want]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    assert sorted(map(key, found)) == sorted(map(key, want))
    assert all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:])) and found[0][1] == 0
    assert tokenids.token_files(spark, docs.limit(0), PATH, 2).collect() == []


def test_one_id_for_many_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 400 + [(2, "x")] * 20, "doc_id long, text string")
    found = tokenids.token_files(spark, docs, PATH, 2, file_ids=200, part_bytes=500).collect()
    assert sorted(r.start for r in found if r.doc_id == 1) == list(range(0, 1600, 4))
    assert {r.n_tokens for r in found if r.doc_id == 1} == {4}
