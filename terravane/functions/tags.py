"""Tag access, classification and predicates over ARRAY<STRUCT<k, v>> columns.

A lookup takes the first occurrence of a key; a filter matches any occurrence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = "array<struct<k:string,v:string>>"
#: How a predicate gets a key's value: from a tag list, or from columns of the same names.
Get = Callable[[str], Column]


def get(tags: Column, *keys: str) -> Column:
    """The value of the first tag whose key is one of keys, or null."""
    return F.try_element_at(F.filter(tags, lambda x: x["k"].isin(*keys)), F.lit(1))["v"]


def getter(tags: str | Column) -> Get:
    col = F.col(tags) if isinstance(tags, str) else tags
    return lambda key: get(col, key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def with_values(tags: Column, keys: tuple[str, ...], body: Callable[[Get], Column]) -> Column:
    """body of a getter over the first values of keys, each looked up once."""
    at = {k: f"v{i}" for i, k in enumerate(keys)}
    return let(F.struct(*[get(tags, k).alias(n) for k, n in at.items()]), lambda s: body(lambda key: s[at[key]]))


def has(tags: Column, key: str, value: str | None = None) -> Column:
    """Whether any tag has the key, and the value if one is given."""
    return F.coalesce(F.exists(tags, lambda x: (x["k"] == key) if value is None else (x["k"] == key) & (x["v"] == value)), F.lit(False))


def from_columns(*names: str) -> Column:
    """A tag list of the columns that aren't null, in order."""
    return F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for n in names]), lambda x: x["v"].isNotNull())


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# Style numbers.
STYLES = {
    "water": 0, "waterway": 1, "forest": 2, "park": 3, "building": 4, "motorway": 5, "primary": 6, "secondary": 7, "minor_road": 8, "path": 9, "rail": 10,
}
AREA_STYLES = ("water", "forest", "park", "building")


def style(v: Get, buildings: bool = True) -> Column:
    """The name of the style that a way's tags give, by the first rule that holds; null for none."""
    one = lambda key, *values: yes(v(key).isin(*values))
    highway = v("highway")
    rules = [
        (one("natural", "coastline", "water") | one("waterway", "riverbank") | one("landuse", "reservoir", "basin") | one("water", "lake", "pond", "reservoir", "basin"), "water"),
        (v("waterway").isNotNull(), "waterway"),
        (one("landuse", "forest", "orchard") | one("natural", "wood", "scrub", "tree_row"), "forest"),
        (one("leisure", "park", "garden", "nature_reserve") | one("landuse", "grass", "meadow", "recreation_ground", "village_green") | one("natural", "grassland", "heath"), "park"),
        (v("building").isNotNull(), "building" if buildings else None),
        (one("highway", "motorway", "trunk"), "motorway"),
        (one("highway", "primary"), "primary"),
        (one("highway", "secondary"), "secondary"),
        (one("highway", "footway", "path", "cycleway", "track"), "path"),
        (highway.isNotNull(), "minor_road"),
        (v("railway").isNotNull(), "rail"),
    ]
    out = F
    for cond, name in rules:
        out = out.when(cond, F.lit(name))
    return out


def style_number(name: Column) -> Column:
    out = F
    for k, n in STYLES.items():
        out = out.when(name == k, F.lit(n))
    return out


def is_coastline(v: Get) -> Column:
    return yes(v("natural") == "coastline")


def is_area(name: Column, n_refs: Column, first: Column, last: Column, coastline: Column) -> Column:
    """Closed, four references at least, a style with areas and no coastline."""
    return yes((n_refs >= 4) & (first == last) & name.isin(*AREA_STYLES) & ~coastline)


#: The keys that decide a way's style, area and walkability.
CLASS_KEYS = ("natural", "waterway", "landuse", "water", "leisure", "building", "highway", "railway", "access", "foot")


def classified(tags: Column, n_refs: Column, first: Column, last: Column) -> Column:
    """A struct of style (a number, null for none), area, coastline and walkable; each tag and the style are worked out once."""

    def of(v: Get) -> Column:
        return let(F.struct(style(v).alias("s"), is_coastline(v).alias("c"), walkable(v).alias("w")), lambda x: F.struct(
            style_number(x["s"]).alias("style"), is_area(x["s"], n_refs, first, last, x["c"]).alias("area"), x["c"].alias("coastline"), x["w"].alias("walkable")))

    return with_values(tags, CLASS_KEYS, of)


def walkable(v: Get) -> Column:
    """Whether a way can be walked: barred ways, then ways for feet, then classes."""
    h, a, f = v("highway"), v("access"), v("foot")
    barred = yes(a.isin("private", "no")) | yes(f.isin("private", "no"))
    allowed = (
        "footway", "path", "pedestrian", "steps", "residential", "living_street", "service", "track", "unclassified", "tertiary", "secondary", "primary",
        "tertiary_link", "secondary_link", "primary_link", "road",
    )
    return F.when(F.coalesce(h, F.lit("")) == "", False).when(barred, False).when(yes(f.isin("yes", "designated", "permissive", "official")), True).otherwise(h.isin(*allowed))


RESIDENTIAL = (
    "yes", "residential", "apartments", "house", "detached", "semidetached_house", "terrace", "dormitory", "farm", "bungalow", "static_caravan", "houseboat",
)
POI_KEYS = ("amenity", "shop", "office", "tourism", "leisure", "craft", "healthcare", "public_transport")


def is_building(v: Get) -> Column:
    return yes(v("building") != "no") | yes(v("building:part") != "no")


def is_residential(v: Get) -> Column:
    """Whether a building may be lived in: points of interest veto unless it is explicitly residential."""
    some = lambda *keys: F.coalesce(*[v(k) for k in keys]).isNotNull()
    value = lambda key: yes(v(key).isin(*RESIDENTIAL))
    explicit = some("building:flats", "building:apartments") | (value("building") & (v("building") != "yes")) | (value("building:part") & (v("building:part") != "yes"))
    addressed = some("addr:street", "addr:place") & v("addr:housenumber").isNotNull()
    return F.when(some(*POI_KEYS) & ~yes(explicit), False).otherwise(addressed | yes(explicit) | value("building") | value("building:part"))


def admin_level(text: Column) -> Column:
    """A level of digits only and up to 20; 0 for anything else."""
    n = F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=.)", "").try_cast("bigint"))
    return F.coalesce(F.when(n <= 20, n), F.lit(0)).cast("int")


def place_kind(place: Column, level: Column) -> Column:
    return (
        F.when(place.isin("city", "town", "village"), place)
        .when(place.isin("suburb", "quarter", "neighbourhood"), "suburb")
        .when(level == 2, "country")
        .when(level == 4, "state")
        .when(level.between(5, 10), "district")
        .otherwise("unknown")
    )


def is_place(v: Get) -> Column:
    """Whether a relation is a place: named, and administrative with a level of 1 to 10 or of a place kind."""
    level = admin_level(v("admin_level"))
    typed = v("type").isNull() | v("type").isin("boundary", "multipolygon")
    admin = yes(v("boundary") == "administrative")
    return (F.coalesce(v("name"), F.lit("")) != "") & F.when(admin, typed & level.between(1, 10)).otherwise(v("place").isNotNull() & (place_kind(v("place"), level) != "unknown"))


def place_score(kind: Column, level: Column, members: Column) -> Column:
    base = F
    for name, n in (("city", 100000), ("town", 90000), ("state", 80000), ("district", 70000), ("village", 60000), ("suburb", 50000), ("country", 40000)):
        base = base.when(kind == name, F.lit(n))
    return (base.otherwise(0) + F.when(level.between(1, 19), (20 - level) * 1000).otherwise(0) + F.least(members, F.lit(999))).cast("bigint")


def city_score(level: Column, members: Column) -> Column:
    by = F.when(level == 6, 100).when(level == 8, 90).when(level == 4, 80).when(level.isin(5, 7), 60).when(level.isin(9, 10), 20).otherwise(0)
    return (by * 1000 + F.least(members, F.lit(999))).cast("bigint")
