import re

from edges import ROWS, documents, words

from kermesse.llm.licenses import scan_licenses

PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def by_hand(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [
        (i, label)
        for label, phrase in PHRASES.items()
        for i in range(len(found))
        if found[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(found), len(at), min(at, default=None), max(at, default=None), labels


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License. Released under the MIT License",
    "GNU General Public License, version 3; all rights reserved. ALL-RIGHTS\nreserved",
    "Licensed under CC BY-NC 4.0 by cc by",
    "Kopen cc by, İ general\tpublic licensé",  # neither sign becomes an ASCII letter
    "all all rights rights reserved ccby cc_by cc  by cc",
    "permission is hereby granted, free of charge, to any person",
    "apache license version 1",
    words(1, 5000) + " General Public License " + words(2, 5000) + " all rights reserved",
]


def test_base_places_and_labels(spark):
    rows = [*ROWS, *[(100 + i, t, "s") for i, t in enumerate(TEXTS)]]
    docs = documents(spark, rows).drop("n_words", "labels", "score")
    out = scan_licenses(docs).collect()
    assert len(out) == len(rows) and out[0].arc == "mine"
    want = sorted([(i, *by_hand(t)) for i, t, _ in rows], key=repr)
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out]
    assert sorted(got, key=repr) == want
    found = {r.doc_id: r for r in out}
    assert [found[100 + i].labels for i in range(8)] == [
        "apache-2.0", "mit", "gpl,gpl-3.0,reserved", "cc-by,cc-by-nc", "cc-by", "cc-by", "", "",
    ]
    assert all(0 <= r.score <= 1 for r in out) and found[2].score == 0 and found[100].score == 1
    assert scan_licenses(docs.limit(0)).count() == 0
    replaced = scan_licenses(documents(spark, rows))
    assert replaced.schema["score"].dataType.simpleString() == "double"
