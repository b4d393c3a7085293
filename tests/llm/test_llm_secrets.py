import hashlib
import random
import re
import time

import pytest
from edges import documents

from kermesse.llm.secrets import BASE_KINDS, RULES, Scanner, compile_rules, scan_secrets

PARTS = [
    "password", "PASSWD", "secret", "Token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "abcdef0123456789",
    "AB12", "x", "é", "\n", "ghp_", "A" * 36, "xoxb-", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "K", "ſecret", "abc123",
    "-----END ", "-", "AIza", "b" * 40, "sk_live_", "=abcdefghijkl", "Z9" * 9, "eyJa.b.c",
]


@pytest.fixture(scope="module")
def scanner():
    return Scanner()


def by_patterns(text):
    """All spans by the patterns of the standard library, rule after rule."""
    out = []
    for number, rule in enumerate(RULES):
        for match in re.finditer(rule.exact, text, re.ASCII):
            if len(match[rule.group]) >= rule.least:
                out.append((match.start(), number, match.end()))
    return sorted(out)


def test_the_automata_agree_with_the_patterns(scanner):
    draw = random.Random(5)
    scans = [re.compile(rule.scan.encode()) for rule in RULES]
    seen = set()
    for _ in range(6000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        data = text.encode()
        assert scanner.joint.scan(data) == {i for i, scan in enumerate(scans) if scan.search(data)}
        assert scanner.spans(text) == by_patterns(text)
        seen |= {number for _, number, _ in scanner.spans(text)}
    assert seen == set(range(len(RULES)))


def test_matches_that_do_not_count_are_passed_over(scanner):
    text = "token = token = 'abcdefghijkl'"
    assert scanner.spans(text) == by_patterns(text)
    assert [m for m in scanner.matches(0, text.encode())] == [
        (m.start(), m.end()) for m in re.finditer(RULES[0].exact, text)
    ]


def test_a_private_key_goes_to_its_end(scanner):
    body = "Proc-Type: 4,ENCRYPTED\n\n" + "MIIE+/=" * 30 + "\n"
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}-----END RSA PRIVATE KEY-----"
    number = [rule.kind for rule in RULES].index("private_key")
    for text, spans in (
        (f"é {key} x", [(2, 2 + len(key))]),
        (f"{key[:60]} cut", [(0, 31)]),
        (key[:31] + key, [(0, 31), (31, 31 + len(key))]),
    ):
        assert [(a, b) for a, n, b in scanner.spans(text) if n == number] == spans


@pytest.mark.parametrize(
    "text",
    [
        "eyJ" * 1_700_000, "eyJ" * 1_700_000 + ".a.b", "eyJa." * 1_000_000, "-----BEGIN PRIVATE KEY-----" * 190_000,
        "token=" * 850_000, "AIza" * 1_250_000, "xoxb-" * 1_000_000, "AKIA" * 1_250_000 + " ", "-----BEGIN " + "A " * 2_500_000,
    ],
)
def test_five_megabytes_of_starts_take_linear_time(scanner, text):
    began = time.process_time()
    scanner.spans(text)
    assert time.process_time() - began < 12  # quadratic time would be hours


def test_minimisation_joins_equal_states():
    joined = compile_rules(("abcx|abdx", "[ab]{3}"))
    assert {joined.scan(t) == {0} for t in (b"abcx", b"zabdx")} == {True}
    assert joined.scan(b"abab") == {1} and joined.scan(b"ab") == set()
    assert len(compile_rules(("ab|ab|a(b|b)",)).moves) == len(compile_rules(("ab",)).moves)


def base_spans(text):
    out = []
    rule = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, pattern, group, least in (("assign", rule, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)):
        for match in re.finditer(pattern, text or "", re.ASCII):
            if len(match[group]) >= least:
                out.append((match.start(), BASE_KINDS.index(kind), match.end()))
    return sorted(out)


def test_spans_and_edges(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choice(PARTS) for _ in range(25)) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate([None, "", *texts, "é" * 9 + " token = 'abcdefghijkl'", "f" * 100_000])]
    docs = documents(spark, rows).drop("n_spans")
    found = {r.doc_id: r for r in scan_secrets(docs).collect()}
    assert len(found) == len(rows) and found[0].arc == "mine"
    for i, text, _ in rows:
        base = base_spans(text)
        listed = ",".join(f"{BASE_KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert found[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert set(listed.split(",")) <= set(found[i].spans.split(",")) | {""}
    assert found[len(rows) - 2].spans == "assign:10:31"
    assert scan_secrets(docs.limit(0)).count() == 0
    clashing = docs.withColumn("spans", docs.text)
    assert scan_secrets(clashing).where("spans = ''").count() > 0
