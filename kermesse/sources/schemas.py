"""Shape of landed pages, and conforming of raw event columns to one type each.

Cells that may hold more than one JSON type are landed as VARIANT, which keeps the type each one
has: `keywords` (list or text), `image` (object or text) and the text columns, where an empty list
or object stands for nothing but the words "[]" and "{}" are text. A location's texts and a link's
`data` are read as text, where Spark keeps an object or list as its JSON with the key order it had.
Numbers that are only shown (ids, ages) become text too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kermesse.constants import LANGUAGE, RAW_COLUMNS
from kermesse.functions.missing import json_key
from kermesse.functions.text import empty_to_null, valid_text

TIMING = "struct<begin:string,end:string>"
LINK_DATA = (
    "struct<title:string,author:string,provider_name:string,"
    "description:string,thumbnail_url:string>"
)
IMAGE_OBJECT = (
    "struct<base:string,filename:string,variants:array<struct<type:string,filename:string>>>"
)

RAW_TYPES = {
    "uid": "string",
    "title": "string",
    "description": "string",
    "longDescription": "string",
    "keywords": "string",
    "dateRange": "string",
    "createdAt": "string",
    "updatedAt": "string",
    "timings": f"array<{TIMING}>",
    "firstTiming": TIMING,
    "lastTiming": TIMING,
    "nextTiming": TIMING,
    "image": "string",
    "attendanceMode": "string",
    "status": "string",
    "registration": "array<struct<type:string,value:string>>",
    "location": (
        "struct<name:string,address:string,city:string,postalCode:string,department:string,"
        "region:string,latitude:string,longitude:string,description:string,access:string,"
        "phone:string,email:string,website:string,image:string>"
    ),
    "age": "struct<min:string,max:string>",
    "accessibility": "map<string,string>",
    "conditions": "string",
    "billetterie": "string",
    "links": "array<struct<link:string,data:string>>",
}

# Text columns of a landed event that keep their JSON type until `text_cells`.
TEXT_COLUMNS = (
    "title", "description", "longDescription", "dateRange", "createdAt", "updatedAt", "conditions",
    "billetterie",
)
LANDED_TYPES = {**RAW_TYPES, **dict.fromkeys((*TEXT_COLUMNS, "keywords", "image"), "variant")}
RAW_EVENT = "struct<" + ",".join(f"{n}:{t}" for n, t in LANDED_TYPES.items()) + ">"
AGENDA_PAGE = "page long, agendas array<struct<uid:string,title:string>>, after variant"
EVENT_PAGE = f"agenda_uid string, page long, events array<{RAW_EVENT}>, after variant"

LANGUAGE_CODE = "^[a-z]{2,3}([-_][A-Za-z]{2,4})?$"

# JSON values that count as "not set" among flags.
FALSE_TEXTS = ("false", "0", "0.0", "", "null", "[]", "{}")


def _kind(c: Column) -> Column:
    """First letters of a VARIANT's type: OBJECT, ARRAY, or that of a plain value."""
    return F.substring_index(F.schema_of_variant(c), "<", 1)


def truthy(c: Column) -> Column:
    """Whether a VARIANT holds something: no null, false, zero, empty text, list or object."""
    shown = F.try_variant_get(c, "$", "string")
    blank = (
        F.when(_kind(c) == "STRING", shown == "")
        .when(_kind(c) == "BOOLEAN", shown == "false")
        .when(_kind(c).isin("OBJECT", "ARRAY"), shown.isin("{}", "[]"))
        .when(_kind(c) == "VOID", F.lit(True))
        .otherwise(F.coalesce(shown.try_cast("double") == 0, F.lit(False)))
    )
    return c.isNotNull() & ~blank


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_language(c: Column, content: str, language: str) -> Column:
    """struct<value>: the content of a VARIANT object that is a language map: that of `language`, else
    of the first key that has some, in order of keys; null for what is no language map. Keys are two
    or three letters, perhaps with a region."""
    filled = lambda x: F.size(x) > 0 if content.startswith("array") else valid_text(x).isNotNull()

    def chosen(texts: Column) -> Column:
        codes = F.forall(F.map_keys(texts), lambda k: F.regexp_like(k, F.lit(LANGUAGE_CODE)))
        own = F.filter(F.array(F.try_element_at(texts, F.lit(language))), filled)
        others = F.filter(
            F.transform(F.array_sort(F.map_keys(texts)), lambda k: F.try_element_at(texts, k)), filled
        )
        value = F.coalesce(F.get(own, F.lit(0)), F.get(others, F.lit(0)))
        return F.when((F.size(F.map_keys(texts)) > 0) & codes, F.struct(value.alias("value")))

    return _once(F.try_variant_get(c, "$", f"map<string,{content}>"), chosen)


def _plain(c: Column) -> Column:
    """Text of a VARIANT cell; null for an empty list or object, JSON for another one."""
    shown = F.try_variant_get(c, "$", "string")
    return F.when(~(_kind(c).isin("OBJECT", "ARRAY") & shown.isin("{}", "[]")), shown)


def text_cells(events: DataFrame, language: str = LANGUAGE) -> DataFrame:
    """Landed events with their text columns as text, language maps as their text in `language`;
    other VARIANT cells stay for `conform_raw`, keywords by language as their list."""
    variants = {f.name for f in events.schema.fields if isinstance(f.dataType, T.VariantType)}

    def cell(n: str) -> Column:
        c = F.col(f"`{n}`")
        if n not in variants or n not in (*TEXT_COLUMNS, "keywords"):
            return c
        text = _by_language(c, "string", language)
        if n == "keywords":
            words = _by_language(c, "array<string>", language)
            chosen = _once(
                F.struct(words.alias("w"), text.alias("t")),
                lambda x: F.when(x["w"]["value"].isNotNull(), x["w"]["value"].cast("variant"))
                .when(x["t"].isNotNull(), x["t"]["value"].cast("variant"))
                .when(x["w"].isNull(), c),
            )
            return F.when(_kind(c) == "OBJECT", chosen).otherwise(c).alias(n)
        chosen = _once(text, lambda x: F.when(x.isNotNull(), x["value"]).otherwise(_plain(c)))
        return F.when(_kind(c) == "OBJECT", chosen).otherwise(_plain(c)).alias(n)

    return events.select(*[cell(n) for n in events.columns])


def _parsed(c: Column) -> Column:
    """Text as VARIANT where it may be a JSON list or object, by how it begins. Other text is not
    handed to the parser, which is slow to fail."""
    start = r'^\s*(\{\s*["}]|\[\s*([\[{"\]\d-]|true|false|null))'
    return F.when(F.regexp_like(c, F.lit(start)), F.try_parse_json(c))


def _keywords(c: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """(list, text) of a keywords cell. Where it is text already, a JSON list of texts is a list, and
    what does not parse as one is text, whatever it begins with."""
    if isinstance(dtype, T.VariantType):
        is_list = _kind(c) == "ARRAY"
        return F.when(is_list, F.try_variant_get(c, "$", "array<string>")), F.when(~is_list, _plain(c))
    found = F.try_variant_get(_parsed(c), "$", "array<string>")
    return found, F.when(found.isNull(), c)


def _image(c: Column, dtype: T.DataType) -> Column:
    """struct<base, filename, variants, text, object>: `text` is a plain URL cell."""
    if isinstance(dtype, T.StructType):
        fields, text, is_object = c, F.lit(None).cast("string"), c.isNotNull()
    else:
        cell = c if isinstance(dtype, T.VariantType) else _parsed(c)
        is_object = F.coalesce(_kind(cell) == "OBJECT", F.lit(False))
        fields = F.try_variant_get(F.when(is_object, cell), "$", IMAGE_OBJECT)
        is_list = F.coalesce(_kind(cell) == "ARRAY", F.lit(False))
        shown = _plain(c) if isinstance(dtype, T.VariantType) else c
        text = F.when(~is_object & ~is_list, shown)
    cell = F.struct(
        empty_to_null(fields["base"]).alias("base"),
        empty_to_null(fields["filename"]).alias("filename"),
        fields["variants"].alias("variants"),
        text.alias("text"),
        F.when(is_object, F.lit(True)).alias("object"),
    )
    return F.when(is_object | text.isNotNull(), cell)


def _location(c: Column, dtype: T.StructType) -> Column:
    types = {f.name: f.dataType for f in dtype.fields}
    wanted = T.StructType.fromDDL(RAW_TYPES["location"])
    cells = []
    for name in wanted.names:
        if name not in types:
            cell = F.lit(None).cast("string")
        elif isinstance(types[name], (T.MapType, T.StructType)):
            cell = F.to_json(c[name])
        else:
            cell = c[name].cast("string")
        if name in ("latitude", "longitude"):
            cell = cell.try_cast("double")
        cells.append(cell.alias(name))
    return F.when(c.isNotNull(), F.struct(*cells))


def _links(c: Column, dtype: T.ArrayType) -> Column:
    types = {f.name: f.dataType for f in dtype.elementType.fields}

    def item(x: Column) -> Column:
        data = F.lit(None).cast("string")
        if isinstance(types.get("data"), T.StringType):
            data = json_key(x["data"])
        elif "data" in types:
            data = F.to_json(x["data"], {"ignoreNullFields": "false"})
        return F.struct(x["link"].cast("string").alias("link"), data.alias("data"))

    return F.transform(c, lambda x: F.when(x.isNotNull(), item(x)))


def conform_raw(df: DataFrame) -> DataFrame:
    """Known raw columns that exist, each in its one working type. Other columns are kept last."""
    missing = {"uid", "title"} - set(df.columns)
    if missing:
        raise ValueError(f"required columns missing: {sorted(missing)}")
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in RAW_COLUMNS:
        if name not in types:
            continue
        c, dtype = F.col(name), types[name]
        if name == "keywords":
            if isinstance(dtype, (T.StringType, T.VariantType)):
                words, text = _keywords(c, dtype)
                out += [words.alias("keywords"), text.alias("keywords_text")]
            else:
                out.append(c.alias(name))
            continue
        if name == "image":
            c = _image(c, dtype)
        elif name == "location" and isinstance(dtype, T.StructType):
            c = _location(c, dtype)
        elif name == "links" and isinstance(dtype, T.ArrayType):
            c = _links(c, dtype)
        elif name == "accessibility" and isinstance(dtype, T.MapType):
            if not isinstance(dtype.valueType, T.BooleanType):
                c = F.transform_values(
                    c, lambda _, v: ~F.coalesce(v.cast("string"), F.lit("")).isin(*FALSE_TEXTS)
                )
        elif name in ("attendanceMode", "status"):
            number = c.try_cast("double")
            c = F.when(number == F.floor(number), number.try_cast("int"))
        elif name in ("uid", "agenda_uid", "billetterie"):
            c = _plain(c) if isinstance(dtype, T.VariantType) else c.cast("string")
        elif isinstance(dtype, T.VariantType):
            c = _plain(c)
        out.append(c.alias(name))
    out += [F.col(f"`{n}`") for n in df.columns if n not in RAW_COLUMNS]
    return df.select(*out)
