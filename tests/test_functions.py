"""Column functions against hand-computed results."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kermesse.constants import (
    ATTENDANCE_LABELS,
    DEPARTMENT_ALIASES,
    REGION_ALIASES,
    STATUS_LABELS,
    WHITESPACE,
)
from kermesse.functions import formats, missing, text

c = F.col


def apply(spark, schema, values, make):
    """Result of a column function for each value, in order."""
    if schema.startswith("map"):
        # Python dicts would lose their key order on the way to the JVM.
        values = [None if v is None else json.dumps(v) for v in values]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        df = df.withColumn("v", F.from_json("v", schema))
    else:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r.out for r in df.select("i", make(c("v")).alias("out")).orderBy("i").collect()]


def test_whitespace_is_what_unicode_strips():
    assert sorted(WHITESPACE) == sorted(chr(i) for i in range(0x110000) if chr(i).isspace())


@pytest.mark.parametrize(
    "schema, values, expected",
    [
        ("string", [None, "", "  ", "Missing VALUE ", "0", "x"], [1, 1, 1, 1, 0, 0]),
        ("double", [None, float("nan"), 0.0], [1, 1, 0]),
        ("boolean", [None, False], [1, 0]),
        ("int", [None, 0], [1, 0]),
        ("array<string>", [None, [], [""]], [1, 1, 0]),
        ("map<string,int>", [None, {}, {"a": None}], [1, 1, 0]),
        ("struct<a:int,b:int>", [None, (None, None), (0, None)], [1, 1, 0]),
    ],
)
def test_is_missing(spark, schema, values, expected):
    dtype = spark.createDataFrame([], f"v {schema}").schema["v"].dataType
    got = apply(spark, schema, values, lambda v: missing.is_missing(v, dtype))
    assert got == [bool(e) for e in expected]


def test_normalise_missing_containers_only(spark):
    df = spark.createDataFrame([("", [])], "t string, a array<int>")
    assert missing.normalise_missing(df, containers_only=True).first() == ("", None)
    assert missing.normalise_missing(df).first() == (None, None)


def test_comparison_key_sorts_map_keys_and_keeps_nulls(spark):
    df = spark.createDataFrame(
        [({"b": "1", "a": "é"}, (None, 2), [" x "])],
        "m map<string,string>, s struct<p:int,q:int>, a array<string>",
    )
    keys = [missing.comparison_key(c(f.name), f.dataType) for f in df.schema.fields]
    assert df.select(*keys).first() == ('{"a":"é","b":"1"}', '{"p":null,"q":2}', '[" x "]')
    assert apply(spark, "string", ['{"b": 1, "a": {"d": 0, "c": null}}', " no "], missing.json_key) == [
        '{"a":{"c":null,"d":0},"b":1}',
        "no",
    ]


def test_clean_text(spark):
    values = ["<p>Bonjour <b>**à** tous</b></p>\n", "a -- b --- c ____d", "<>", " \t", None, "😀\x1c<br/>x"]
    assert apply(spark, "string", values, text.clean_text) == [
        "Bonjour **à** tous",
        "a -- b c d",
        "<>",
        None,
        None,
        "😀 x",
    ]


def test_clean_text_is_linear_in_unclosed_tags(spark):
    got = apply(spark, "string", ["<b>x" + "<" * 200_000, "a > b <" + "c" * 10], text.clean_text)
    assert got == ["x" + "<" * 200_000, "a > b <cccccccccc"]


def test_join_list(spark):
    values = [[" a", "b", "a ", None, "", "missing value"], [], None, [" "]]
    assert apply(spark, "array<string>", values, text.join_list) == ["a, b", None, None, None]
    loose = lambda v: text.join_list(v, distinct=False)
    assert apply(spark, "array<string>", values[:1], loose) == ["a, b, a"]


DATES = [
    ("2024-12-31T20:30:00+02:00", "31/12/2024 à 20h30", "2024-12-31 18:30:00"),
    ("2024-12-31T20:30:00Z", "31/12/2024 à 20h30", "2024-12-31 20:30:00"),
    ("2024-12-31T20:30:00.5-0500", "31/12/2024 à 20h30", "2025-01-01 01:30:00.5"),
    ("2024-12-31", "31/12/2024 à 00h00", "2024-12-31 00:00:00"),
    ("2024-12-31 07:05", "31/12/2024 à 07h05", "2024-12-31 07:05:00"),
    # This hour does not exist in New York.
    ("2024-03-10T02:30:00", "10/03/2024 à 02h30", "2024-03-10 02:30:00"),
    ("1969-12-31T23:59:59.250001", "31/12/1969 à 23h59", "1969-12-31 23:59:59.250001"),
    ("demain", None, None),
    (None, None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        values = [d[0] for d in DATES]
        assert apply(spark, "string", values, text.format_datetime) == [d[1] for d in DATES]
        utc = lambda v: F.unix_micros(text.utc_timestamp(v))
        day = lambda x: dt.datetime.fromisoformat(x).replace(tzinfo=dt.timezone.utc)
        micros = [None if d[2] is None else round(day(d[2]).timestamp() * 1e6) for d in DATES]
        assert apply(spark, "string", values, utc) == micros
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


TIMING = "struct<begin:string,end:string>"


def test_timings(spark):
    one, two = ("2024-01-02T10:00:00+02:00", None), (None, "2024-01-03")
    both = (one[0], two[1])
    values = [both, one, two, (None, "x"), None]
    assert apply(spark, TIMING, values, formats.format_timing) == [
        "Du 02/01/2024 à 10h00 au 03/01/2024 à 00h00",
        "À partir du 02/01/2024 à 10h00",
        "Jusqu'au 03/01/2024 à 00h00",
        None,
        None,
    ]
    lists = [[one, (None, None), None, two], [(None, None)], [], None]
    assert apply(spark, f"array<{TIMING}>", lists, formats.format_all_timings) == [
        "À partir du 02/01/2024 à 10h00 | Jusqu'au 03/01/2024 à 00h00",
        None,
        None,
        None,
    ]


def test_accessibility(spark):
    values = [{"vi": True, "hi": True, "zz": True}, {"mi": False}, {"ii": None}, {}, None]
    none = "Aucune information d'accessibilité"
    assert apply(spark, "map<string,boolean>", values, formats.format_accessibility) == [
        "handicap visuel, handicap auditif",
        none,
        none,
        none,
        None,
    ]


def test_codes(spark):
    status = lambda v: formats.map_codes(v, STATUS_LABELS)
    assert apply(spark, "int", [1, 6, 7, None], status) == ["Programmé", "Annulé", None, None]
    mode = lambda v: formats.map_codes(v, ATTENDANCE_LABELS)
    assert apply(spark, "int", [3, 0], mode) == ["Hybride", None]


def test_image(spark):
    schema = "struct<base:string,filename:string,variants:array<struct<type:string,filename:string>>>"
    values = [
        ("b/", "f", [("thumb", "t"), ("full", ""), ("full", "g"), ("full", "h")]),
        (None, "f", [("thumb", "t")]),
        ("b/", "f", None),
        ("b/", None, []),
        None,
    ]
    assert apply(spark, schema, values, formats.format_image) == ["b/g", "f", "b/f", None, None]


def test_registration(spark):
    schema = "array<struct<type:string,value:string>>"
    values = [
        [(" EMAIL", "a@b"), ("phone", "05"), ("link", "http"), ("sms code", "1"), (" ", "x"), (None, " y")],
        [("email", "missing value"), None, ("email", None)],
        [],
        None,
    ]
    assert apply(spark, schema, values, formats.format_registration) == [
        "Email : a@b | Téléphone : 05 | Lien : http | Sms code : 1 | Contact : x | Contact :  y",
        None,
        None,
        None,
    ]


def test_localised_text(spark):
    values = [{"en": "E", "fr": " F "}, {"de": " ", "en": "E", "it": "I", "fr": ""}, {"en": " "}, {}, None]
    assert apply(spark, "map<string,string>", values, formats.localised_text) == ["F", "E", None, None, None]
    cells = [' plain ', '{"it":"I","en":"E"}', '{"en":null}', "{not json", None]
    assert apply(spark, "string", cells, formats.localised_json) == ["plain", "I", None, "{not json", None]


def test_canonicalise(spark):
    region = lambda v: formats.canonicalise(v, REGION_ALIASES)
    assert apply(spark, "string", [" OCCITANIA ", "Bretagne", None], region) == ["Occitanie", "bretagne", None]
    department = lambda v: formats.canonicalise(v, DEPARTMENT_ALIASES)
    assert apply(spark, "string", ["Alto Garona "], department) == ["Haute-Garonne"]


def test_age(spark):
    values = [(0, 5), (0, None), (None, 12), (None, None), None]
    assert apply(spark, "struct<min:int,max:int>", values, formats.format_age) == [
        "De 0 à 5 ans",
        "À partir de 0 ans",
        "Jusqu'à 12 ans",
        None,
        None,
    ]


def test_links(spark):
    data = "struct<title:string,author:string,provider_name:string,description:string,thumbnail_url:string>"
    schema = f"array<struct<link:string,data:{data}>>"
    values = [[("l", ("t", "", "s", "d", "m")), ("k", None), None, ("", (None, "a", None, None, None))], [(None, None)]]
    assert apply(spark, schema, values, formats.format_links) == [
        "Lien : l | Titre : t | Source : s | Description : d | Lien : k | Auteur : a",
        None,
    ]
    thumb = lambda v: formats.format_links(v, thumbnail=True)
    assert apply(spark, schema, values[:1], thumb)[0].startswith(
        "Lien : l | Titre : t | Source : s | Description : d | Miniature : m | Lien : k"
    )


def test_labelled_text(spark):
    pairs = lambda v: [("A", v), ("B", F.lit(" b "))]
    assert apply(spark, "string", [" x ", " ", None], lambda v: text.labelled_text(pairs(v), "|")) == [
        "A :  x |B :  b ",
        "B :  b ",
        "B :  b ",
    ]
    stripped = lambda v: text.labelled_text(pairs(v), "|", strip_values=True)
    assert apply(spark, "string", [" x "], stripped) == ["A : x|B : b"]
    blank = lambda v: text.labelled_text(pairs(v), "|", blank_is_value=True)
    assert apply(spark, "string", [" ", ""], blank) == ["A :  |B :  b ", "B :  b "]
