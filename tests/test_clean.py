import datetime as dt

import pytest
from pyspark.sql import functions as F

from kermesse.constants import CLEAN_COLUMNS
from kermesse.operators import columns
from kermesse.plans.clean import clean_events
from kermesse.sources import pages
from landing import write_landing


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    listing, landed = write_landing(tmp_path_factory.mktemp("landing"))
    tagged = pages.tag_pages(
        pages.explode_events(pages.read_pages(spark, landed)),
        pages.agendas(pages.read_pages(spark, listing)),
    )
    return pages.accept_events(tagged).events


def test_clean_event(events):
    clean = clean_events(events)
    assert clean.columns == list(CLEAN_COLUMNS)
    rows = {r.uid: r.asDict() for r in clean.withColumn("updatedAt", F.col("updatedAt").cast("string")).collect()}
    assert len(rows) == 3
    assert rows["10"] == {
        "uid": "10",
        "title": " Concert ",
        "description": "Bon&nbsp;jour *tous*",
        "longDescription": "a b",
        "keywords": "jazz, piano, soul",
        "dateRange": "1 - 2 juin",
        "createdAt": "2024-01-01T00:00:00.000Z",
        "updatedAt": "2024-05-01 10:00:00",
        "timings": "Du 01/06/2024 à 20h00 au 01/06/2024 à 22h00",
        "firstTiming": "À partir du 01/06/2024 à 20h00",
        "lastTiming": "Jusqu'au 01/06/2024 à 22h00",
        "nextTiming": "À partir du 01/06/2024 à 20h00",
        "image": "https://img/full.jpg",
        "mode_participation": "Présentiel",
        "status": "Annulé",
        "registration": "Téléphone : 05",
        "age": "De 0 à 99 ans",
        # The older row brings "hi"; the newer one turns it off and adds the others.
        "accessibility_text": "handicap visuel, handicap moteur",
        "conditions": "Gratuit",
        "billetterie": "https://b",
        "links": "Lien : https://l | Titre : T | Source : P | Lien : https://k",
        "agenda_uids": ["1", "b c"],
        "agenda_titles": "Un, Sans titre",
        "location_name": "Salle",
        "location_address": "1 rue",
        "location_city": "Castres",
        "location_postal_code": "31000",
        "location_department": "Haute-Garonne",
        "location_region": "Occitanie",
        "location_latitude": 43.6,
        "location_longitude": 1.0,
        "location_text": "Lieu : Salle | Adresse : 1 rue | Description du lieu : Hall | Accès : Métro | "
        "Téléphone : 06 | Email : s@s | Site web : https://s | Image du lieu : i.png",
    }
    other = {k: v for k, v in rows["11"].items() if v is not None}
    assert other == {
        "uid": "11",
        "title": "Expo",
        "keywords": "solo",
        "timings": "À partir du 01/06/2020 à 20h00",
        "lastTiming": "Jusqu'au 01/06/2020 à 22h00",
        "image": "https://img/x.png",
        "agenda_uids": ["b c"],
        "agenda_titles": "Sans titre",
        "location_city": "Albi",
        "location_region": "bretagne",
    }


def test_constant_columns_go_but_protected_ones_stay(events):
    one = clean_events(events.filter("uid = '10'"), drop_constants=True)
    assert one.columns == ["uid", "title", "description", "longDescription", "keywords"]
    several = clean_events(events, drop_constants=True).columns
    assert "lastTiming" in several and "status" not in several and "createdAt" not in several


def test_optional_columns_may_be_absent(spark):
    df = spark.createDataFrame([("1", "t", "x"), ("1", "u", None)], "uid string, title string, foo string")
    clean = clean_events(df)
    assert clean.columns == ["uid", "title"] and clean.count() == 1
    with pytest.raises(ValueError):
        clean_events(df.drop("uid"))


def test_result_does_not_depend_on_partitioning(events):
    show = lambda df: sorted(map(repr, clean_events(df).collect()))
    assert show(events.repartition(1)) == show(events.repartition(9, "title"))


def test_object_image_beats_text_image(spark):
    rows = [("1", "t", "2024-01-02", " http://x "), ("1", "t", "2024-01-01", '{"base": "b/", "filename": "f"}')]
    df = spark.createDataFrame(rows, "uid string, title string, updatedAt string, image string")
    assert clean_events(df).first().image == "b/f"


def test_column_helpers(spark):
    df = spark.createDataFrame(
        [(i, " x " if i else "x", None, [1], i if i > 94 else None, i if i > 93 else None) for i in range(100)],
        "id int, same string, nothing string, list array<int>, at95 int, at94 int",
    )
    assert columns.constant_columns(df) == ["same", "nothing", "list"]
    assert columns.sparse_columns(df) == ["nothing", "at95"]
    assert columns.existing(df, ["list", "nope", "id"]).columns == ["list", "id"]
    assert columns.constant_columns(df.filter("id < 0"), ["id"]) == df.columns[1:]
    with pytest.raises(ValueError):
        columns.require_columns(df, ["id", "nope"])
