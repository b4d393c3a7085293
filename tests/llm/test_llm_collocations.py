import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from edges import documents

from kermesse.llm import collocations, common

LOW = {c: c + 32 for c in range(65, 91)}


def plain(rows, support=30, top=2000):
    """Rows of the report by counting everything."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in found.items():
            longer = [
                b for q, b in found.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * b >= 80 * a for b in longer):
                continue
            cuts = [
                (2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                for k in range(1, len(p))
            ]
            score, _, l, r = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(seed, n=400):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "日本", "x y", "W1"]
    fixed = ["w1 w2 w3 w4", "w5 w6", "w7 w8 w9", "w2 w3", "été w1 w1 w1 w1"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(0, 30)):
            parts.append(draw.choice(fixed) if draw.random() < 0.5 else draw.choice(vocabulary))
            parts.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0b", "\x1f "]))
        rows.append((draw.choice(["a", "a", "b", "", None]), "".join(parts)))
    return rows


def test_codes_against_plain_code():
    texts = [t for _, t in corpus(5, 50)] + ["", None, "a", ".", " . a.b", "a b\x1c c"]
    codes, words, counts = collocations.word_codes(pa.array(texts, pa.string()))
    names = words.to_pylist()
    got = " ".join("|" if c < 0 else names[c] for c in codes)
    pieces = []
    for text in texts:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            if found := re.findall(r"[^ \t]+", piece):
                pieces.append(" ".join(found))
    assert got == " | ".join(pieces)
    assert dict(zip(names, counts.tolist())) == dict(Counter(w for p in pieces for w in p.split(" ")))


def test_tries_against_a_dictionary(monkeypatch):
    monkeypatch.setattr(collocations, "WINDOW", 700)
    draw = np.random.default_rng(3)
    for length, words, n in ((2, 5, 12), (2, 400, 9000), (3, 40, 3000), (4, 9, 900), (4, 300, 5000), (2, 1, 1)):
        ids = draw.choice(10**9, words, replace=False)
        skewed = np.minimum(draw.zipf(1.3, (n, length)) - 1, words - 1)
        phrases = np.unique(ids[skewed], axis=0)
        trie = collocations.Trie(phrases)
        assert trie.phrases.tolist() == sorted(phrases.tolist())
        number = {tuple(p): i for i, p in enumerate(trie.phrases.tolist())}
        text = ids[np.minimum(draw.zipf(1.2, 3000) - 1, words - 1)]
        text = np.where(draw.random(3000) < 0.1, -5, text)
        symbols = np.where(text < 0, -1, trie.symbols_of(text))
        found = trie.rows_at(symbols.astype(np.int32))
        want = {
            i: number[key]
            for i in range(len(text) - length + 1)
            if (key := tuple(text[i : i + length].tolist())) in number
        }
        assert {i: f for i, f in enumerate(found.tolist()) if f >= 0} == want


def test_against_a_plain_version(spark):
    for seed, settings in ((1, {}), (2, {"block_bytes": 2000, "trie_phrases": 40}), (3, {"top": 5})):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
        found = sorted(tuple(r) for r in collocations.collocations(docs, **settings).collect())
        want = plain(rows, top=settings.get("top", 2000))
        assert found == want and len(want) > 10


def test_scores_do_not_overflow(spark):
    big = 10**13
    counts = spark.createDataFrame([([1], big, "a"), ([2], big, "a"), ([1, 2], big, None)], "p array<long>, n long, lang string")
    row = collocations._best_cuts(counts.where("size(p) > 1"), counts).first()
    assert (row.a, row.l, row.r, row.score, row.lang) == (big, big, big, 1_000_000, "a")


def test_nulls_clashes_nothing_frequent_and_an_empty_table(spark):
    from pyspark.sql import functions as F

    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    found = sorted(tuple(r) for r in collocations.collocations(docs, support=3).collect())
    assert found == plain(rows, support=3)
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.where("doc_id = 8")).collect() == []


def test_codes_stay_in_files_of_the_workers(spark):
    rows = [("a", " ".join(f"w{i % 90}" for i in range(20_000))), (None, "x. y"), ("a", None)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(1)
    found = collocations.blocks(docs, "lang", "text").orderBy("lang").collect()
    texts = {"a": [rows[0][1], None], "und": ["x. y"]}
    for row in found:
        codes, words, counts = collocations.word_codes(pa.array(texts[row.lang], pa.string()))
        assert collocations.load_codes(row.path).tolist() == codes.tolist()
        assert (row.words, row.counts) == (words.to_pylist(), counts.tolist())
    # What passes through the JVM is as long as the distinct words, not as the text.
    assert [len(row.words) for row in found] == [90, 2] and all("codes" not in row for row in found)


def test_written_rows_come_back_without_files_of_the_jvm(spark):
    from pathlib import Path

    df = spark.range(0, 50, 1, 3).selectExpr("id", "if(id % 7 = 0, null, array(id, null)) l", "cast(id as string) s")
    for kept in (common.written(df), common.written(df, rows_per_file=4)):
        assert kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())
    files = [Path(f.removeprefix("file://")) for f in kept.inputFiles()]
    # 16, 17 and 17 rows in a partition; Spark's own writer leaves checksums beside its files.
    assert len(files) == 4 + 5 + 5 and not list(files[0].parent.glob(".*.crc"))
    doubled = common.written(df, lambda batches: (b.select(["id"]) for b in batches), "id long")
    assert sorted(r.id for r in doubled.collect()) == list(range(50))
    assert common.written(df.where("id < 0")).collect() == [] and common.written(df.limit(0)).dtypes == df.dtypes
