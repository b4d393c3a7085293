"""Merging by key, against hand-computed groups and a plain-Python rendering of the rules."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from kermesse.operators.merge import keyless_items, merge_by_key

DAY = lambda n: dt.datetime(2024, 1, n)
SCHEMA = (
    "uid string, at timestamp, n int, title string, tags array<string>, "
    "times array<struct<b:string,e:string>>, flags map<string,string>, "
    "place struct<name:string,city:string>, agenda string"
)
OPTIONS = dict(
    order_by="at",
    tie_break=["n"],
    base_only=["agenda"],
    gather={"agendas": "agenda"},
    gather_text={"names": "agenda"},
)


def frame(spark, rows):
    """Rows as a DataFrame; maps travel as JSON, which keeps their key order."""
    rows = [(*r[:6], None if r[6] is None else json.dumps(r[6]), *r[7:]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA.replace("map<string,string>", "string"))
    return df.withColumn("flags", F.from_json("flags", "map<string,string>"))


def merged(df, **options):
    out = merge_by_key(df, "uid", **{**OPTIONS, **options})
    rows = out.withColumn("keys", F.map_keys("flags")).collect()
    return {r.uid: r for r in rows}


def test_three_versions(spark):
    df = frame(
        spark,
        [
            ("a", None, 0, "oldest", ["z", "x"], [("1", None)], {"k": "0", "q": "9"}, ("N", "T"), "A "),
            ("a", DAY(3), 1, " ", [" x", "y"], None, {"k": "2", "m": "missing value"}, ("M", None), "B"),
            ("a", DAY(2), 2, "older", ["x", "y", None], [("1", None), ("2", "3")], {"p": "1"}, None, "A"),
            ("b", DAY(1), 3, None, [], [], {}, None, None),
        ],
    )
    got = merged(df)
    a, b = got["a"], got["b"]
    assert len(got) == 2
    assert a.title == "older" and a.at == DAY(3)
    # Place of the first sight (newest first), value of the last one.
    assert a.tags == ["x", "y", None, "z"]
    assert [tuple(t) for t in a.times] == [("1", None), ("2", "3")]
    # Keys in the order the oldest row on brings them; newest content wins; missing is skipped.
    assert a.keys == ["k", "q", "p"] and a.flags == {"k": "2", "q": "9", "p": "1"}
    assert tuple(a.place) == ("M", "T")
    assert a.agenda == "B" and a.agendas == ["B", "A", "A "] and a.names == ["B", "A"]
    assert all(b[f] is None for f in ("title", "tags", "times", "flags", "place", "agenda", "agendas", "names"))


def test_last_seen_value_of_equal_items(spark):
    rows = [("a", DAY(2), 0, ["x"]), ("a", DAY(1), 1, [" x "])]
    df = spark.createDataFrame(rows, "uid string, at timestamp, n int, tags array<string>")
    assert merge_by_key(df, "uid", order_by="at", tie_break=["n"]).first().tags == [" x "]


def test_null_keys_form_one_group_and_look_alikes_do_not(spark):
    rows = [(None, "a"), (None, "b"), ("null", "c"), ("", "d"), ("=", "e")]
    rows += [("x" * 65, "f"), ("x" * 65, "g"), ("x" * 66, "h")]
    df = spark.createDataFrame(rows, "uid string, v string")
    assert merge_by_key(df, "uid").count() == 6


def test_items_without_a_key_come_in_order_and_no_task_holds_them_all(spark):
    rows = [(None, i // 3, i, [f"i{i}", f"i{i - 1}"], {f"k{i % 4}": i}) for i in range(3000)]
    df = spark.createDataFrame([*rows, ("a", 1, 1, ["x"], {"y": 1})], "uid string, day int, n int, tags array<string>, m map<string,int>")
    order = {"order_by": "day", "tie_break": ["n"]}
    merged = merge_by_key(df, "uid", **order).where("uid IS NULL")
    whole = merged.select("tags", F.map_entries("m").alias("m")).first()
    items = keyless_items(df.repartition(7), "uid", **order)
    tags = items.where("column = 'tags'")
    found = [(r.place, r.tags) for r in tags.collect()]
    assert [x for _, x in sorted(found)] == whole.tags and found == sorted(found)
    entries = [tuple(r.m) for r in items.where("column = 'm'").orderBy("place").collect()]
    assert entries == [tuple(e) for e in whole.m]
    # The largest array that any step builds is a row's own.
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "RepartitionByExpression" in plan


def test_ties_go_to_the_first_ingested_and_else_to_content(spark):
    rows = [("a", None, 2, "second"), ("a", None, 1, "first")]
    df = spark.createDataFrame(rows, "uid string, at timestamp, n int, v string")
    assert merge_by_key(df, "uid", order_by="at", tie_break=["n"]).first().v == "first"
    rows = [("a", None, 1, f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "uid string, at timestamp, n int, v string")
    for ties in ([], ["n"]):
        merge = lambda d: merge_by_key(d, "uid", order_by="at", tie_break=ties, gather={"all": "v"}).first()
        assert len({(r.v, *r.all) for r in (merge(df.repartition(p, "v")) for p in (1, 2, 5))}) == 1


def test_zoneless_times_order_in_any_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # The first of these hours does not exist in New York.
        rows = [("a", "2024-03-10 02:30:00", 1, "older"), ("a", "2024-03-10 03:20:00", 2, "newer")]
        df = spark.createDataFrame(rows, "uid string, at string, n int, v string")
        df = df.withColumn("at", F.col("at").cast("timestamp_ntz"))
        assert merge_by_key(df, "uid", order_by="at", tie_break=["n"]).first().v == "newer"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_key_is_required(spark):
    with pytest.raises(ValueError):
        merge_by_key(spark.range(1), "uid")


def _random_rows(seed, rows, keys):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    out = []
    for n in range(rows):
        # One key holds a third of the rows.
        uid = "hot" if rng.random() < 0.34 else pick(None, *[f"k{i}" for i in range(keys)])
        out.append(
            (
                uid,
                pick(None, DAY(1), DAY(2), DAY(3)),
                n,
                pick(None, "", "Missing Value", "t1", "t2"),
                pick(None, [], [pick("a", " a", "b", "c", None) for _ in range(3)]),
                pick(None, [(pick("1", None), pick("2", "3"))]),
                pick(None, {}, {pick("p", "q", "r"): pick("", "1", "2"), "s": pick(None, "3")}),
                pick(None, (pick(None, "N", " "), pick("T", "U"))),
                pick(None, " ", "A", "A ", "B"),
            )
        )
    return out


def _expected(rows):
    """The merge rules over Python rows."""
    absent = lambda v: v is None or v in ([], {}) or isinstance(v, str) and v.strip().lower() in ("", "missing value")
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = {}
    for uid, group in groups.items():
        group = sorted(group, key=lambda r: (-(r[1].timestamp() if r[1] else -1e18), r[2]))
        first = lambda i: next((r[i] for r in group if not absent(r[i])), None)

        def united(i):
            seen = {}
            for r in group:
                for item in r[i] or []:
                    seen[item.strip() if isinstance(item, str) else item] = item
            return list(seen.values()) or None

        flags = {}
        for r in reversed(group):
            flags.update({k: v for k, v in (r[6] or {}).items() if not absent(v)})
        fields = [next((r[7][j] for r in group if r[7] and not absent(r[7][j])), None) for j in (0, 1)]
        agendas = list(dict.fromkeys(r[8] for r in group if r[8] is not None))
        names = list(dict.fromkeys(r[8].strip() for r in group if r[8] and r[8].strip()))
        out[uid] = (
            group[0][1], first(3), united(4), united(5), flags or None,
            tuple(fields) if any(f is not None for f in fields) else None,
            group[0][8], agendas or None, names or None,
        )
    return out


def _plain(r):
    times = r.times and [tuple(t) for t in r.times]
    return (r.at and max(r.at, r.at), r.title, r.tags, times, r.flags, r.place and tuple(r.place), r.agenda, r.agendas, r.names)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rows_with_a_hot_key(spark, seed):
    rows = _random_rows(seed, 600, 20)
    want = _expected(rows)
    for parts in (1, 7):
        got = merged(frame(spark, rows).repartition(parts))
        assert set(got) == set(want)
        for uid, expected in want.items():
            r = got[uid]
            plain = _plain(r)
            # The merged timestamp is the newest one present, the base row's.
            assert plain == expected, uid
            if expected[4]:
                assert r.keys == list(expected[4])


def test_merging_again_changes_nothing(spark):
    df = frame(spark, _random_rows(3, 200, 10)).drop("agenda")
    options = dict(order_by="at", tie_break=["n"])
    once = merge_by_key(df, "uid", **options).withColumn("n", F.lit(0))
    twice = merge_by_key(once, "uid", **options)
    show = lambda d: sorted(map(repr, d.select("uid", "at", "title", "tags", "times", "place").collect()))
    assert show(once) == show(twice)


def test_plan_never_gathers_whole_groups(spark):
    """Rows of a key meet only in partial aggregation; both sides of the join share one shuffle key."""
    df = frame(spark, _random_rows(4, 50, 5))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merge_by_key(df, "uid", **OPTIONS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3
    assert "partial_max_by" in plan and "partial_min_by" in plan and "SortMergeJoin" in plan


def test_items_have_a_value_field_per_type_and_are_sorted_without_a_comparer(spark):
    """Two lists of texts and one gathered share a field; a comparer or a key in an array function
    would be interpreted, item by item."""
    df = frame(spark, _random_rows(4, 50, 5)).drop("flags")
    plan = merge_by_key(df, "uid", **OPTIONS)._jdf.queryExecution().optimizedPlan().toString()
    assert "v0" in plan and "v1" in plan and "v2" not in plan
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_counting_first_changes_no_result(spark, monkeypatch):
    """Keys of one row, of several and of none; items twice in a row; rows dealt by key and not."""
    from kermesse.operators import merge

    lone = [(f"x{i}", *r[1:]) for i, r in enumerate(_random_rows(5, 200, 10))]
    twice = ("y", DAY(1), 1, "t", ["a", " a", "b"], [("1", None), ("1", None)], {"k": "", "l": "v"}, (" ", None), "g")
    tables = [lone, [*lone, twice], [*lone, twice, *_random_rows(6, 60, 9)], _random_rows(7, 200, 10), [], [(None, *twice[1:])]]
    show = lambda d: sorted(map(repr, d.select(*[c for c in d.columns if c != "flags"], F.to_json("flags")).collect()))
    for rows in tables:
        df = frame(spark, rows)
        for normalised in (False, True):
            options = {**OPTIONS, "normalised": normalised}
            want = show(merge_by_key(df, "uid", **options))
            for many in (10_000, 0):
                monkeypatch.setattr(merge, "MANY", many)
                found = merge_by_key(df, "uid", **options, count_first=True)
                assert found.dtypes == merge_by_key(df, "uid", **options).dtypes
                assert show(found) == want


def test_rows_alone_with_their_key_are_not_shuffled(spark):
    df = frame(spark, [(f"x{i}", *r[1:]) for i, r in enumerate(_random_rows(8, 60, 10))])
    alone = df.withColumn("tags", F.array(F.lit("a"), F.col("uid"))).drop("times")
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(merge_by_key(alone, "uid", **OPTIONS, count_first=True)) == 0
        # Dealt by key once for values and once for items, where partial results would take three.
        several = merge_by_key(alone.union(alone), "uid", **OPTIONS, count_first=True)
        assert exchanges(several) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
