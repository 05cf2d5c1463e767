"""Address resolution: normalised text, aliases of places, streets and house numbers, exact and scored matches, an alias index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIM = " \t\n\r,"


def normalize(text: Column) -> Column:
    """ASCII letters lowered, sharp s as ss; everything else stays."""
    return F.replace(F.translate(text, _UPPER, _LOWER), F.lit("ß"), F.lit("ss"))


def fold(text: Column) -> Column:
    """Umlauts of either case as two letters."""
    out = text
    for a, b in (("ä", "ae"), ("Ä", "ae"), ("ö", "oe"), ("Ö", "oe"), ("ü", "ue"), ("Ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def umlaut_variants(text: str, most: int = 16) -> list[str]:
    """A text with two-letter forms turned into umlauts in all ways, at most `most`, first places first."""
    pairs = {"ae": "ä", "oe": "ö", "ue": "ü"}
    out: list[str] = []

    def go(t: str, at: int) -> None:
        if len(out) >= most:
            return
        k = next((i for i in range(at, len(t) - 1) if t[i : i + 2] in pairs), None)
        if k is None:
            return
        turned = t[:k] + pairs[t[k : k + 2]] + t[k + 2 :]
        if turned not in out:
            out.append(turned)
        go(turned, k + 1)
        go(t, k + 2)

    go(text, 0)
    return out


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM))


def house_aliases(house: Column) -> Column:
    """The whole house number and its parts between commas, semicolons and slashes."""
    parts = F.transform(F.split(house, "[,;/]", -1), lambda x: F.btrim(x, F.lit(" \t")))
    return F.filter(F.array_distinct(F.concat(F.array(house), parts)), lambda x: x != "")


def place_aliases(place: Column) -> Column:
    """A place, its folded form, and what stands before " in " or a bracket."""
    before = lambda mark: F.when(F.instr(place, mark) > 0, trim(F.substring_index(place, mark, 1)))
    raw = F.array_compact(F.array(place, before(" in "), before("(")))
    return F.filter(F.array_distinct(F.concat(raw, F.transform(raw, fold))), lambda x: x != "")


def place_matches(field: Column, query: Column) -> Column:
    """Equal aliases, or one that goes on from the other at something that is no letter or digit."""
    goes_on = lambda long, short: F.startswith(long, short) & (F.length(long) > F.length(short)) & ~F.substr(long, F.length(short) + 1, F.lit(1)).rlike("^[a-z0-9]$")
    return F.coalesce(F.exists(place_aliases(field), lambda a: F.exists(place_aliases(query), lambda b: (a == b) | goes_on(a, b) | goes_on(b, a))), F.lit(False))


def split_query(query: Column) -> dict[str, Column]:
    """Main part and place of "street house, place"; street and house of the main part by its last word."""
    text = normalize(query)
    main = trim(F.substring_index(text, ",", 1))
    place = F.when(F.instr(text, ",") > 0, trim(F.substr(text, F.instr(text, ",") + 1))).otherwise("")
    shape = r"^(.*[^a-z0-9])([a-z0-9]+)[^a-z0-9]*$"
    return {"main": main, "place": place, "street": trim(F.regexp_extract(main, shape, 1)), "house": F.regexp_extract(main, shape, 2)}


def readings(queries: DataFrame) -> DataFrame:
    """Every way to read a query's main part as street and house number: one row for each run of whole words.

    A query has few words, so its readings are few; they turn the containment match into an equi join on (street, house).
    """
    q = split_query(F.col("query"))
    base = queries.select("query_id", q["main"].alias("main"), q["place"].alias("place"))
    n = F.length("main")
    spots = base.withColumn("a", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).withColumn("b", F.explode(F.sequence(F.col("a"), F.greatest(n, F.col("a")))))
    left = (F.col("a") == 1) | ~F.substr("main", F.col("a") - 1, F.lit(1)).rlike("^[a-z0-9]$")
    right = (F.col("b") == n) | ~F.substr("main", F.col("b") + 1, F.lit(1)).rlike("^[a-z0-9]$")
    rows = spots.where(left & right).select(
        "query_id", "place", trim(F.substr("main", F.lit(1), F.col("a") - 1)).alias("street"), F.substr("main", F.col("a"), F.col("b") - F.col("a") + 1).alias("house")
    )
    return rows.where("street <> '' and house <> ''").distinct()


def place_ok(place: Column) -> Column:
    """No place asked, or one of the record's."""
    fields = F.array_compact(F.array(*[normalize(F.col(c)) for c in ("city", "suburb", "postcode")]))
    return (place == "") | F.array_contains(fields, place)


def resolve_exact(queries: DataFrame, addresses: DataFrame) -> DataFrame:
    """query_id, matches and the best record: one with a coordinate before one without, then the least id.

    queries: query_id, query; addresses: id, lat_e7, lon_e7, city, suburb, postcode, street, housenumber.
    """
    keyed = addresses.withColumns({"street": normalize(F.col("street")), "house": normalize(F.col("housenumber"))})
    hit = readings(queries).join(keyed, ["street", "house"]).where(place_ok(F.col("place"))).dropDuplicates(["query_id", "id"])
    order = F.struct(F.col("lat_e7").isNull().alias("no"), F.col("id").alias("id"))
    return hit.groupBy("query_id").agg(F.count("*").alias("matches"), F.min(order).alias("b")).select("query_id", "matches", F.col("b.id").alias("id"))


def bytes_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance in bytes, -1 beyond most."""
    latin = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(latin(a), latin(b), most)


def similar(a: Column, b: Column) -> Column:
    """Two edits at most between texts of eight bytes at least that begin alike."""
    long = F.least(F.octet_length(a), F.octet_length(b)) >= 8
    return long & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & F.coalesce(bytes_distance(a, b, 2).between(0, 2), F.lit(False))


def score_matches(queries: DataFrame, addresses: DataFrame) -> DataFrame:
    """query_id, id and score of every address that fits a query: street 120, similar street 110, place for street 60, and 30 for the place.

    Queries and addresses meet on house-number aliases, which blocks the fuzzy comparison.
    """
    q = split_query(F.col("query"))
    asked = queries.select("query_id", q["street"].alias("q_street"), q["place"].alias("q_place"), F.explode(house_aliases(q["house"])).alias("h")).where("q_street <> ''")
    keyed = addresses.select("id", normalize(F.col("street")).alias("street"), *[normalize(F.col(c)).alias(c) for c in ("city", "suburb", "postcode")], F.explode(house_aliases(normalize(F.col("housenumber")))).alias("h"))
    met = asked.join(keyed, "h")
    a, b = fold(F.col("street")), fold(F.col("q_street"))
    fits = lambda place: place_matches(F.col("city"), place) | place_matches(F.col("suburb"), place) | place_matches(F.col("postcode"), place)
    street = F.when(a == b, 120).when(similar(a, b), 110).when(fits(F.col("q_street")), 60)
    extra = F.when((F.col("q_place") != "") & fits(F.col("q_place")), 30).otherwise(0)
    return met.withColumn("score", street + extra).where("score is not null").groupBy("query_id", "id").agg(F.max("score").cast("bigint").alias("score"))


def index_keys(addresses: DataFrame) -> DataFrame:
    """The alias index: every (street or place, house, place or none) that finds an address, with how many and which one.

    Written as a table bucketed by key it answers a query by an equi join.
    """
    n = {c: normalize(F.col(c)) for c in ("street", "city", "suburb", "postcode", "housenumber")}
    places = F.flatten(F.transform(F.array_compact(F.array(n["city"], n["suburb"], n["postcode"])), place_aliases))
    names = F.when(F.coalesce(n["street"], F.lit("")) != "", F.array_distinct(F.array(n["street"], fold(n["street"])))).otherwise(places)
    rows = addresses.select("id", "lat_e7", F.explode(names).alias("name"), F.array_distinct(F.concat(F.array(F.lit("")), places)).alias("ps"), house_aliases(n["housenumber"]).alias("hs"))
    keys = rows.withColumn("house", F.explode("hs")).withColumn("place", F.explode("ps"))
    order = F.struct(F.col("lat_e7").isNull().alias("no"), "id")
    return keys.groupBy("name", "house", "place").agg(F.countDistinct("id").alias("addresses"), F.min(order).alias("b")).select("name", "house", "place", "addresses", F.col("b.id").alias("id"))


def resolve_indexed(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Answers from the index: with the place first, without it where that finds none."""
    q = split_query(F.col("query"))
    asked = queries.select("query_id", fold(q["street"]).alias("name"), q["house"].alias("house"), fold(q["place"]).alias("p"))
    tries = asked.withColumn("t", F.explode(F.array(F.struct(F.col("p").alias("place"), F.lit(0).alias("pass")), F.struct(F.lit("").alias("place"), F.lit(1).alias("pass")))))
    hit = tries.select("query_id", "name", "house", "t.place", "t.pass").join(index, ["name", "house", "place"])
    return hit.groupBy("query_id").agg(F.min(F.struct("pass", "id", "addresses")).alias("b")).select("query_id", F.col("b.id").alias("id"), F.col("b.addresses").alias("addresses"))


def first_matches(queries: DataFrame, addresses: DataFrame, most: int = 20) -> DataFrame:
    """query_id, matches (of all) and ids: the first matches by id, most at most."""
    hit = score_matches(queries, addresses).select("query_id", "id")
    return hit.groupBy("query_id").agg(F.count("*").alias("matches"), F.slice(F.sort_array(F.collect_set("id")), 1, most).alias("ids"))


def endpoints(queries: DataFrame, addresses: DataFrame, index: DataFrame, index_only: bool = False, most: int = 64) -> DataFrame:
    """query_id, way and spots (lat_e7, lon_e7; most at most) of where asked places are, by the first way that finds any: 0 coordinates as given,
    1 the index with the place, 2 the index without it, 3 the equally best scored addresses, 4 the same without the place; addresses without
    a coordinate don't count, and index_only leaves out 3 and 4.
    """
    number = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*,\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"
    at = lambda k: (F.regexp_extract("query", number, k).try_cast("decimal(20,9)") * 10_000_000).cast("decimal(20,0)").cast("long")
    literal = queries.where(F.col("query").rlike(number)).select("query_id", F.lit(0).alias("way"), at(1).alias("lat_e7"), at(2).alias("lon_e7"))
    literal = literal.where(F.abs("lat_e7") <= 900_000_000).where(F.abs("lon_e7") <= 1_800_000_000)
    spots = addresses.where("lat_e7 is not null and lon_e7 is not null").select("id", "lat_e7", "lon_e7")
    known = addresses.join(spots.select("id"), "id", "left_semi")
    q = split_query(F.col("query"))
    asked = queries.select("query_id", fold(q["street"]).alias("name"), q["house"].alias("house"), fold(q["place"]).alias("p"))
    tries = asked.withColumn("t", F.explode(F.array(F.struct(F.col("p").alias("place"), F.lit(1).alias("way")), F.struct(F.lit("").alias("place"), F.lit(2).alias("way")))))
    by_index = tries.select("query_id", "name", "house", "t.place", "t.way").join(index.select("name", "house", "place", "id"), ["name", "house", "place"]).select("query_id", "way", "id")
    found = by_index
    if not index_only:
        bare = queries.withColumn("query", F.substring_index("query", ",", 1))
        for way, some in ((3, queries), (4, bare)):
            scored = score_matches(some, known)
            best = scored.groupBy("query_id").agg(F.max("score").alias("top")).withColumnRenamed("query_id", "q2")
            top = scored.join(best, (F.col("query_id") == F.col("q2")) & (F.col("score") == F.col("top")))
            found = found.union(top.select("query_id", F.lit(way).alias("way"), "id"))
    every = literal.union(found.join(spots, "id").select("query_id", "way", "lat_e7", "lon_e7"))
    ways = every.groupBy("query_id", "way").agg(F.slice(F.sort_array(F.collect_set(F.struct("lat_e7", "lon_e7"))), 1, most).alias("spots"))
    return ways.groupBy("query_id").agg(F.min(F.struct("way", "spots")).alias("b")).select("query_id", "b.way", "b.spots")
