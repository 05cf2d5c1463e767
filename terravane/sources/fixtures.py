"""Projections of the star-schema tables onto map and timetable inputs, as portable SQL (truncating integer division is written div)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FIXTURES = {
    "node": """select cast(p_partkey as bigint) id, 52300000000 + (cast(p_partkey as bigint) * 7919 % 2500) * 100000 lat_nano,
        12850000000 + (cast(p_partkey as bigint) * 104729 % 4000) * 100000 lon_nano, p_name name, p_type amenity, p_brand brand from {part}""",
    "way_ref": """select l_orderkey way_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as bigint) - 1 pos,
        l_partkey node_id from {lineitem}""",
    "way": """select o_orderkey id,
        case o_orderpriority when '1-URGENT' then 'motorway' when '2-HIGH' then 'primary' when '3-MEDIUM' then 'residential' when '4-NOT SPECIFIED' then case o_orderkey % 4 when 0 then 'cycleway' when 1 then 'secondary' else 'footway' end end highway,
        case when o_orderkey % 37 = 0 then 'coastline' when o_orderkey % 19 = 0 then 'wood' end natural_, case when o_orderkey % 23 = 0 then 'river' end waterway,
        case when o_orderkey % 29 = 0 then 'forest' when o_orderkey % 31 = 0 then 'reservoir' when o_orderkey % 43 = 0 then 'meadow' end landuse, case when o_orderkey % 3 = 0 then 'rail' end railway,
        case when o_orderkey % 41 = 0 then 'private' when o_orderkey % 17 = 0 then 'yes' end access, case when o_orderkey % 9 = 0 then cast(o_orderkey % 8 as varchar(9)) end levels,
        case when o_orderstatus = 'P' then 'no' when o_orderstatus = 'F' and o_orderkey % 5 = 0 then 'yes' end foot,
        case when o_orderpriority = '5-LOW' and o_orderkey % 2 = 0 then 'yes' when o_orderpriority = '5-LOW' and o_orderkey % 5 < 3 then 'house' end building, case when o_orderkey % 11 = 0 then 'park' end leisure,
        case when o_orderkey % 13 = 0 then 'bakery' end shop, case when o_orderkey % 2 = 0 then 'Ring' end street, cast(o_orderkey % 60 as varchar(9)) housenumber,
        case when o_orderkey % 3 = 0 then '14467' end postcode from {orders}""",
    "member": "select c_custkey rel_id, o_orderkey member_id, 1 member_type from {customer} join {orders} on o_custkey = c_custkey",
    "relation": """select c_custkey id, c_mktsegment name, 'administrative' boundary, cast(c_nationkey % 12 as varchar(9)) admin_level,
        case when c_custkey % 4 = 0 then 'city' when c_custkey % 4 = 1 then 'suburb' end place from {customer}""",
    "stop": """select cast(s_suppkey as bigint) stop_id, s_name stop_name, 523000000 + (cast(s_suppkey as bigint) * 7919 % 2500) * 400 lat_e7,
        128500000 + (cast(s_suppkey as bigint) * 104729 % 4000) * 400 lon_e7 from {supplier}""",
    "trip": "select o_orderkey trip_id, o_custkey % 40 route_id, o_orderpriority service_id from {orders}",
    "stop_time": """select trip_id, stop_id, sequence, 21600 + (trip_id * 613 % 43200) + sequence * 420 arrival_sec, 21660 + (trip_id * 613 % 43200) + sequence * 420 departure_sec from
        (select l_orderkey trip_id, l_suppkey stop_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as bigint) sequence
         from {lineitem}) t""",
    "route": "select distinct o_custkey % 40 route_id, cast(o_custkey % 40 * 37 % 1300 as int) route_type from {orders}",
    "calendar": """select o_orderpriority service_id, case substring(o_orderpriority, 1, 1) when '1' then 31 when '2' then 127 when '3' then 96 when '4' then 31 else 64 end mask,
        case when substring(o_orderpriority, 1, 1) = '5' then 0 else 20260601 end start_date, 20260630 end_date from (select distinct o_orderpriority from {orders}) p""",
    "exception": """select o_orderpriority service_id, 20260603 date, case when substring(o_orderpriority, 1, 1) in ('1', '4') then 2 else 1 end type
        from (select distinct o_orderpriority from {orders}) p where substring(o_orderpriority, 1, 1) in ('1', '3')""",
    "address": """select c_custkey id, 1 entity_type, case when c_custkey % 7 <> 0 then 523000000 + (c_custkey * 7919 % 2500) * 400 end lat_e7,
        case when c_custkey % 7 <> 0 then 128500000 + (c_custkey * 104729 % 4000) * 400 end lon_e7, r_name state, n_name city, case when c_custkey % 3 = 0 then 'Nord' end suburb,
        case c_mktsegment when 'AUTOMOBILE' then 'Friedrich-Engels-Straße' when 'BUILDING' then 'Hauptstrasse' when 'FURNITURE' then 'Ring' when 'HOUSEHOLD' then 'Am Markt' else 'Bahnhofallee' end street,
        case when c_custkey % 5 = 0 then cast(c_custkey % 60 as varchar(9)) || '/' || cast(c_custkey % 60 + 2 as varchar(9)) else cast(c_custkey % 60 as varchar(9)) end housenumber,
        case when c_custkey % 9 <> 0 then cast(14400 + c_nationkey as varchar(9)) end postcode
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def portable_sql(name: str) -> str:
    """A projection's SQL over tables of their own names, with // for truncating division."""
    return FIXTURES[name].format(**{t: t for t in TABLES}).replace(" div ", " // ")
