"""Address and building rows: tags pivoted into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tags as T

ADDRESS_KEYS = {"state": "addr:state", "city": "addr:city", "suburb": "addr:suburb", "street": "addr:street", "housenumber": "addr:housenumber", "postcode": "addr:postcode"}
# The columns of building rows in order, and the keys whose first tag gives each.
BUILDING_COLUMNS = {
    "building": ("building",), "building_part": ("building:part",), "building_levels": ("building:levels",), "roof_levels": ("roof:levels",), "building_min_level": ("building:min_level",),
    "building_flats": ("building:flats",), "building_apartments": ("building:apartments",), "building_use": ("building:use",), "start_date": ("start_date", "building:year"),
    "addr_country": ("addr:country",), "addr_state": ("addr:state",), "addr_city": ("addr:city",), "addr_suburb": ("addr:suburb",), "addr_street": ("addr:street",),
    "addr_housenumber": ("addr:housenumber",), "addr_postcode": ("addr:postcode",), "addr_place": ("addr:place",), "addr_unit": ("addr:unit",), "addr_floor": ("addr:floor",),
    "addr_door": ("addr:door",), "entrance": ("entrance",), "name": ("name",), "amenity": ("amenity",), "shop": ("shop",), "office": ("office",), "tourism": ("tourism",),
    "leisure": ("leisure",), "craft": ("craft",), "healthcare": ("healthcare",), "public_transport": ("public_transport",),
}
ADDRESS_PARTS = tuple(c for c in BUILDING_COLUMNS if c.startswith("addr_") or c == "entrance")


def complete(row: Column) -> Column:
    """Street, house number and postcode are there; an empty value is there."""
    return row["street"].isNotNull() & row["housenumber"].isNotNull() & row["postcode"].isNotNull()


def _kept(entities: DataFrame, row: Column, keep) -> DataFrame:  # noqa: ANN001
    """The entities' other columns and the fields of row where keep holds; the row is built once."""
    others = [c for c in entities.columns if c != "tags"]
    return entities.select(*others, F.inline(F.filter(F.array(row), keep)))


def address_rows(entities: DataFrame, include_incomplete: bool = False) -> DataFrame:
    """id and the address columns of entities (id, tags, ...) with a complete address, or with any part of one."""
    row = F.struct(*[T.get(F.col("tags"), key).alias(name) for name, key in ADDRESS_KEYS.items()])
    some = lambda r: F.coalesce(*[r[c] for c in ADDRESS_KEYS]).isNotNull()
    return _kept(entities, row, some if include_incomplete else complete)


def union_entities(**by_type: DataFrame) -> DataFrame:
    """Rows of several entity types with their type; missing columns are null."""
    out = None
    for kind, df in by_type.items():
        part = df.withColumn("entity_type", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def building_rows(entities: DataFrame, residential_only: bool = False) -> DataFrame:
    """The entities' other columns, has_address, has_building, residential_candidate and the building columns, of entities that are
    buildings or have any part of an address."""
    keys = tuple(dict.fromkeys(k for ks in BUILDING_COLUMNS.values() for k in ks))

    def row(v: T.Get) -> Column:
        # a value under several keys is the one whose tag comes first
        value = {c: v(ks[0]) if len(ks) == 1 else T.get(F.col("tags"), *ks) for c, ks in BUILDING_COLUMNS.items()}
        verdicts = {"has_address": F.coalesce(*[value[c] for c in ADDRESS_PARTS]).isNotNull(), "has_building": T.is_building(v), "residential_candidate": T.is_residential(v)}
        return F.struct(*[x.alias(c) for c, x in (verdicts | value).items()])

    def keep(r: Column) -> Column:
        some = r["has_address"] | r["has_building"]
        return some & r["residential_candidate"] if residential_only else some

    return _kept(entities, T.with_values(F.col("tags"), keys, row), keep)


def is_building_row(v: T.Get) -> Column:
    """Whether building_rows() keeps an entity."""
    return T.is_building(v) | F.coalesce(*[v(k) for c in ADDRESS_PARTS for k in BUILDING_COLUMNS[c]]).isNotNull()


def building_tsv(rows: DataFrame, header: bool = True) -> DataFrame:
    """One tab-separated line of 43 columns a row of building_rows() with entity_type, id and a footprint; coordinates with nine digits."""
    coord = lambda c: S.coord_text(F.col(c))
    places = {"lat": "center_lat", "lon": "center_lon", "min_lat": "min_lat", "min_lon": "min_lon", "max_lat": "max_lat", "max_lon": "max_lon"}
    verdicts = ("has_address", "has_building", "residential_candidate")
    cols = [F.col("entity_type"), F.col("id"), *[coord(c) for c in places.values()], F.col("ref_count"), F.col("missing_ref_count"), *[F.col(c).cast("int") for c in verdicts], *[F.col(c) for c in BUILDING_COLUMNS]]
    lines = rows.select(F.concat_ws("\t", *[tsv_safe(c) for c in cols]).alias("value"))
    names = "\t".join(["entity_type", "osm_id", *places, "ref_count", "missing_ref_count", *verdicts, *BUILDING_COLUMNS])
    return rows.sparkSession.createDataFrame([(names,)], "value string").union(lines) if header else lines


def written_rows(rows: DataFrame) -> DataFrame:
    """How many rows of each entity type there are, and how many with a reference that is missing."""
    return rows.groupBy("entity_type").agg(F.count("*").alias("rows"), F.count_if(F.col("missing_ref_count") > 0).alias("partial"))


def tsv_safe(c: Column) -> Column:
    """Tabs and line ends become spaces, null becomes empty."""
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), "\t\n\r", "   ")


def address_tsv(rows: DataFrame, header: bool = False) -> DataFrame:
    """One tab-separated line a row: type, id, coordinates with nine digits, the address columns; a first line of names if asked."""
    coord = lambda c: S.coord_text(F.col(c)) if c in rows.columns else F.lit("")
    cols = [F.col("entity_type"), F.col("id"), coord("lat_nano"), coord("lon_nano"), *[F.col(c) for c in ADDRESS_KEYS]]
    lines = rows.select(F.concat_ws("\t", *[tsv_safe(c) for c in cols]).alias("value"))
    names = "\t".join(["type", "id", "lat", "lon", *ADDRESS_KEYS])
    return rows.sparkSession.createDataFrame([(names,)], "value string").union(lines) if header else lines
