import random

import pytest

from kermesse.operators import profiles


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        ("a", "x", 1.0, [1]), ("a", " x ", float("nan"), []), ("b", "y", 1.0, None), ("b", "z", 2.0, [2]),
        ("b", " ", 2.0, [2]), ("c", None, None, None), (None, "p", 1.0, None), (None, "q", 3.0, None),
    ]
    return spark.createDataFrame(rows, "uid string, t string, d double, l array<int>")


def test_duplicates(df):
    assert tuple(profiles.duplicate_profile(df, "uid").first()) == (8, 3, 7, 2)
    assert tuple(profiles.duplicate_profile(df.filter("uid = 'none'"), "uid").first()) == (0, 0, 0, 0)


def test_conflicts(df):
    got = [tuple(r) for r in profiles.conflict_profile(df, "uid").collect()]
    # Null keys do not count; NaN and blank text are no values, an empty list is one.
    assert got == [("d", 1, 50.0), ("l", 1, 50.0), ("t", 1, 50.0)]


def same_hash_texts():
    """Two texts with one XXH64 of seed 42: a lane of the second stripe makes up for the first."""
    p1, p2, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    draw = random.Random(1)
    lane = lambda: bytes(draw.randrange(33, 127) for _ in range(8))

    def turned(state, word):
        x = (state + int.from_bytes(word, "little") * p2) & full
        return ((x << 31 | x >> 33) & full) * p1 & full

    start, rest = (42 + p1 + p2) & full, bytes(b"x" * 24)
    while True:
        a, b, after = lane(), lane(), lane()
        shift = (turned(start, a) - turned(start, b)) * pow(p2, -1, 1 << 64)
        other = ((int.from_bytes(after, "little") + shift) & full).to_bytes(8, "little")
        if a != b and all(33 <= x < 127 for x in other):
            return (a + rest + after + rest).decode(), (b + rest + other + rest).decode()


def test_texts_with_equal_hashes_are_told_apart(spark):
    a, b = same_hash_texts()
    rows = [("k", a, "s"), ("k", b, "s"), ("l", a, "s"), ("l", a, "t"), ("m", a, None), ("m", b, None), ("n", b, "u")]
    df = spark.createDataFrame(rows, "uid string, t string, u string")
    assert df.where("uid = 'k'").selectExpr("count(distinct xxhash64(t))").first()[0] == 1
    got = [tuple(r) for r in profiles.conflict_profile(df, "uid").collect()]
    assert got == [("t", 2, 66.67), ("u", 1, 33.33)]


def test_many_text_columns(spark):
    a, b = same_hash_texts()
    names = [f"c{i}" for i in range(70)]
    rows = [("k", *[a] * 70), ("k", *[b if i in (0, 62, 63, 69) else a for i in range(70)])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ["uid", *names]))
    got = {r.column for r in profiles.conflict_profile(df, "uid").collect() if r.conflicting_keys}
    assert got == {"c0", "c62", "c63", "c69"}


def test_nulls_and_summary(df):
    got = [tuple(r) for r in profiles.null_profile(df).collect()]
    assert got == [("l", 0.5), ("d", 0.25), ("uid", 0.25), ("t", 0.125)]
    assert [tuple(r) for r in profiles.column_summary(df).collect()] == [
        (0, "uid", 6, "string"), (1, "t", 7, "string"), (2, "d", 7, "double"), (3, "l", 4, "array<int>"),
    ]


def test_value_counts(df):
    got = {(r.column, r.value): r.n for r in profiles.value_counts(df, ["uid", "l"]).collect()}
    assert got == {
        ("uid", "a"): 2, ("uid", "b"): 3, ("uid", "c"): 1, ("uid", None): 2,
        ("l", "[1]"): 1, ("l", "[]"): 1, ("l", "[2]"): 2, ("l", None): 4,
    }
