import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kermesse.sources import pages, store
from kermesse.sources.schemas import conform_raw
from landing import write_landing


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    listing, events = write_landing(tmp_path_factory.mktemp("landing"))
    agendas = pages.agendas(pages.read_pages(spark, listing))
    return agendas, pages.explode_events(pages.read_pages(spark, events)), events


def test_agendas_in_listing_order(landed):
    rows = landed[0].orderBy("ingest_agenda").collect()
    assert [(r.agenda_uid, r.agenda_title) for r in rows] == [
        ("1", "Un"), ("b c", None), ("3", "Trois"), ("4", "Quatre"),
    ]
    first = pages.first_agendas(landed[0], 2).collect()
    assert {r.agenda_uid for r in first} == {"1", "b c"}


def test_unreadable_listing_is_an_error(spark):
    raw = spark.createDataFrame([('{"agendas": [',)], "value string")
    with pytest.raises(Exception, match="unreadable agenda page"):
        pages.agendas(raw).collect()


def test_agenda_with_a_bad_page_is_left_out(landed):
    events, rejects = pages.accept_events(pages.tag_pages(landed[1], landed[0]))
    got = {(r.uid, r.agenda_uid, r.agenda_title) for r in events.collect()}
    assert got == {
        ("10", "1", "Un"), ("10", "b c", "Sans titre"), ("11", "b c", "Sans titre"), ("14", "4", "Quatre"),
    }
    assert [tuple(r)[:2] for r in rejects.collect()] == [("3", 1)]


def page(number, after=None, uid=None, agenda="1"):
    one = {"agenda_uid": agenda, "events": [] if uid is None else [{"uid": uid, "title": "t"}]}
    if number is not None:
        one["page"] = number
    if after is not None:
        one["after"] = after
    return json.dumps(one)


def imported(spark, lines):
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    listed = spark.createDataFrame(
        [(str(i), "T", i) for i in range(20)], "agenda_uid string, agenda_title string, ingest_agenda long"
    )
    events, rejects = pages.accept_events(pages.tag_pages(pages.explode_landed(raw), listed))
    return {r.uid for r in events.collect()}, {tuple(r) for r in rejects.collect()}


def test_chains_of_cursors(spark):
    lines = [
        # whole, the second page without an event
        page(0, "c", 1), page(1, ["d", 2]), page(2, "", 2),
        # a gap in the middle, and one at the end; the same page twice counts once
        page(0, "c", 3, "2"), page(2, None, 4, "2"), page(2, None, 4, "2"),
        page(0, {"x": 1}, 5, "3"), page(0, {"x": 1}, 5, "3"), page(4, 7, 6, "3"),
        # cursors that hold nothing end a chain
        *[page(0, nothing, f"n{i}", "4") for i, nothing in enumerate(["", [], {}, False, 0, 0.0])],
        # a page that cannot be read has landed, if its number can be
        page(0, "c", 8, "5"), page(1, None, 9, "5")[:-1],
        # without numbers one page must end the chain
        page(None, "c", 10, "6"), page(None, None, 11, "6"),
        page(None, "c", 12, "7"), page(None, "d", 13, "7"),
    ]
    lines[-5] = '{"agenda_uid": "5", "page": 1, "events": [{"uid"'
    events, rejects = imported(spark, lines)
    assert events == {"1", "2", "10", "11", *(f"n{i}" for i in range(6))}
    assert rejects == {
        ("2", 0, 1, 1, pages.INCOMPLETE),
        ("3", 0, 2, 1, pages.INCOMPLETE),
        ("5", 1, 0, None, pages.UNREADABLE),
        ("7", 0, 1, None, pages.INCOMPLETE),
    }


def test_listing_without_a_page(spark):
    lines = [json.dumps({"page": n, "agendas": [], "after": a}) for n, a in ((0, "x"), (1, "y"), (3, None))]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.missing_page for r in pages.listing_gaps(raw).collect()] == [2]
    assert pages.listing_gaps(raw.where("value not like '%y%'")).first().missing_page == 1
    assert pages.listing_gaps(raw.where("value like '%null%'")).first() is None


def test_no_window_over_an_agenda(spark):
    raw = spark.createDataFrame([(page(0),)], "value string")
    listed = spark.createDataFrame([("1", "T", 1)], "agenda_uid string, agenda_title string, ingest_agenda long")
    rejects = pages.accept_events(pages.tag_pages(pages.explode_landed(raw), listed)).rejects
    plan = rejects._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(agenda_uid" in plan and "missing_page" in plan


@pytest.mark.parametrize(
    "cell, shown",
    [
        ({"fr": "Salle", "en": "Hall"}, "Salle"),
        ({"en": "Hall", "de": "Halle"}, "Halle"),
        ({"fr": " ", "en": "Hall"}, "Hall"),
        ({"fr": None}, None),
        ({"fr-CA": "x"}, "x"),
        ({"fr": "a", "other thing": "b"}, '{"fr":"a","other thing":"b"}'),
        ("Salle", "Salle"),
        ('{"fr":"a"}', '{"fr":"a"}'),
        ({}, None),
    ],
)
def test_language_of_texts(spark, cell, shown):
    raw = json.dumps({"agenda_uid": 1, "events": [{"uid": 1, "title": cell, "conditions": cell}]})
    row = pages.explode_events(spark.createDataFrame([(raw,)], "value string")).first()
    assert (row.title, row.conditions) == (shown, shown)


def test_another_language(spark):
    raw = json.dumps({"events": [{"uid": 1, "title": {"fr": "Salle", "en": "Hall"}, "keywords": {"en": ["x"], "fr": ["y"]}}]})
    row = pages.explode_events(spark.createDataFrame([(raw,)], "value string"), language="en").first()
    assert row.title == "Hall" and row.keywords.toPython() == ["x"]


def test_page_per_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{\n "agenda_uid": "z",\n "events": [\n {"uid": 1, "title": "t"}\n]}')
    raw = pages.read_pages(spark, str(tmp_path), page_per_file=True)
    row = pages.explode_events(raw).first()
    assert (row.agenda_uid, row.uid, row.unreadable) == ("z", "1", False)


def test_owner_of_a_cut_page_comes_from_its_text(spark):
    raw = spark.createDataFrame([('{"agenda_uid": "q-1", "events": [{"uid"',)], "value string")
    row = pages.explode_events(raw).first()
    assert row.unreadable and row.agenda_uid == "q-1"


def test_bad_page_without_an_owner_is_reported(spark, landed):
    raw = spark.createDataFrame([("[1,",), ('{"agenda_uid": "1", "events": [{"uid": 7}]}',)], "value string")
    events, rejects = pages.accept_events(pages.tag_pages(pages.explode_events(raw), landed[0]))
    assert [r.uid for r in events.collect()] == ["7"]
    assert [tuple(r)[:2] for r in rejects.collect()] == [(None, 1)]


def test_filters(landed):
    events = pages.accept_events(pages.tag_pages(landed[1], landed[0])).events
    assert [r.uid for r in pages.in_city(events, "Albi").collect()] == ["11"]
    assert [r.uid for r in pages.recent_only(events, dt.date(2025, 6, 1)).collect()] == ["10"]
    assert pages.recent_only(events, dt.date(2025, 6, 2)).count() == 0
    stale = pages.stale_events(events, dt.date(2021, 6, 2))
    assert [r.uid for r in stale.collect()] == ["11"]
    assert pages.stale_events(events, dt.date(2021, 6, 1)).count() == 0


def test_tags_join_is_not_forced(landed):
    plan = pages.accept_events(pages.tag_pages(landed[1], landed[0])).events._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" not in plan and "UnresolvedHint" not in plan


def test_conform_accepts_typed_columns(spark):
    df = spark.createDataFrame(
        [(1, "t", ["a"], 2, {"hi": False}, [("l", ("T",))])],
        "uid int, title string, keywords array<string>, status int, "
        "accessibility map<string,boolean>, links array<struct<link:string,data:struct<title:string>>>",
    )
    row = conform_raw(df).first()
    assert (row.uid, row.keywords, row.status, row.accessibility) == ("1", ["a"], 2, {"hi": False})
    assert row.links[0].data == '{"title":"T"}'
    with pytest.raises(ValueError):
        conform_raw(df.drop("title"))


def test_materialise_writes_to_the_folder_the_session_names(spark):
    out = store.materialise(spark.range(5).withColumn("x", F.lit("y")))
    folder = spark.conf.get("spark.checkpoint.dir")
    assert out.count() == 5 and all(folder in f for f in out.inputFiles())


def test_packed_pages_keep_their_owner_and_need_no_file_per_agenda(spark, tmp_path):
    cut = '{"page":1,"events":[{"uid":"x"'
    rows = [(f'{{"page":{i},"events":[{{"uid":{i}}}]}}', f"a/{i}") for i in range(50)] + [(cut, "é b")]
    landed = spark.createDataFrame([*rows, ('{"agenda_uid":7,"events":[]}', None)], "value string, folder_agenda string")
    pages.land_pages(landed.coalesce(2), str(tmp_path / "events"))
    assert len(list((tmp_path / "events").glob("part-*"))) == 2
    read = pages.read_pages(spark, str(tmp_path / "events"), packed=True)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, landed.collect()), key=str)
    bad = pages.explode_events(read).where("unreadable").first()
    assert bad.agenda_uid == "é b"
