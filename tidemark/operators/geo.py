"""Addresses against a public address reference, with falling precision, and the observations of the map.

Distinct addresses are resolved once, whatever number of snapshots share them. Candidates of an address are the
reference rows of its municipality, postal code, street (with or without its title) and number; of a postal code, all
of the code's. All joins are on these columns; whatever is said of a group of candidates is an aggregate of it.

Candidates: ibge, postal, title, street, number, address_code, latitude, longitude (double), level (1 best to 6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import text
from tidemark.functions.keys import address_fingerprint
from tidemark.functions.show import haversine, tax_profile

#: An address whose candidates lie farther apart, in metres, is ambiguous; more points than PAIRWISE are spanned by their box.
AMBIGUOUS, PAIRWISE = 100.0, 100
ADDRESS, POSTAL = ["ibge", "postal", "street", "number"], ["ibge", "postal"]
ACTIVE = "02"


def eligible(establishments: DataFrame) -> DataFrame:
    """Establishments of the map: in the region and active."""
    return establishments.filter((F.col("is_in_region")) & (F.col("registration_status_code") == ACTIVE))


def with_address(rows: DataFrame) -> DataFrame:
    """rows with the normalised address (ibge, postal, street, number) and its fingerprint. The street has its type's name left out."""
    out = rows.withColumns({"ibge": F.col("municipality_ibge_code"), "postal": text.address_postal_code(F.col("postal_code")), "street": text.address_text(F.col("street_name")), "number": text.address_number(F.col("street_number"))})
    return out.withColumn("fingerprint", address_fingerprint(*map(F.col, ADDRESS)))


def distinct_addresses(rows: DataFrame) -> DataFrame:
    return with_address(rows).select(*ADDRESS, "fingerprint").dropDuplicates(["fingerprint"])


def by_alias(reference: DataFrame) -> DataFrame:
    """Candidates under each name of their street, for addresses with postal code and number."""
    titled = F.trim(F.concat_ws(" ", text.address_text(F.col("title")), text.address_text(F.col("street"))))
    names = F.array_distinct(F.array(text.address_text(F.col("street")), titled))
    rows = reference.select("ibge", text.address_postal_code(F.col("postal")).alias("postal"), F.explode(names).alias("street"), text.address_number(F.col("number")).alias("number"), "address_code", "latitude", "longitude", "level")
    return rows.filter("postal <> '' AND number <> ''")


def by_postal_code(reference: DataFrame) -> DataFrame:
    return reference.select("ibge", text.address_postal_code(F.col("postal")).alias("postal"), "address_code", "latitude", "longitude", "level").filter("postal <> ''")


def unique_points(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Of each coordinate (six decimals) of a key the candidate with the lowest level and code."""
    at = candidates.withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})
    best = F.min(F.struct("level", "address_code")).alias("best")
    return at.groupBy(*key, "latitude", "longitude").agg(best).select(*key, "latitude", "longitude", "best.level", "best.address_code")


def best_level(points: DataFrame, key: list[str]) -> DataFrame:
    """The points of each key's lowest level."""
    return points.withColumn("least", F.min("level").over(W.partitionBy(*key))).filter("level = least").drop("least")


#: Coordinates are selected as whole millionths above these, by DIGITS bits at a time, twice.
LOWEST, DIGITS = {"latitude": -90_000_000, "longitude": -180_000_000}, 15


def medians(points: DataFrame, key: list[str]) -> DataFrame:
    """key, mid_lat and mid_lon: exact medians of each key's coordinates (six decimals), by digits in fixed space.

    Counts by key and first digits combine before the shuffle and say which digits hold the middle; counts by the last
    digits of these points alone say the value. So of a key at most 2 ** DIGITS counts meet in one place, however many
    points it has, and its points only where Spark splits the join."""
    axes = F.explode(F.array(*[F.struct(F.lit(axis).alias("axis"), (F.round(F.col(axis) * 1_000_000).cast("long") - low).cast("int").alias("value")) for axis, low in LOWEST.items()]))
    values = points.select(*key, axes.alias("x")).select(*key, "x.*")
    own, base = [*key, "axis"], 1 << DIGITS
    first = values.groupBy(*own, F.shiftright("value", DIGITS).alias("digits")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*own))
    before = F.sum("n").over(W.partitionBy(*own).orderBy("digits")) - F.col("n")
    # of an even number of points the two in the middle; of an odd one the same twice
    ranked = first.select(*own, "digits", "n", total.alias("total"), before.alias("before")).select(*own, "digits", "n", "before", F.posexplode(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))).alias("side", "rank"))
    held = ranked.filter("rank >= before AND rank < before + n").select(*own, "side", F.col("digits").alias("wanted"), (F.col("rank") - F.col("before")).alias("rank"))
    inside = values.join(held.select(*own, "wanted").distinct(), own).filter(F.shiftright("value", DIGITS) == F.col("wanted"))
    last = inside.groupBy(*own, "wanted", F.col("value").bitwiseAND(base - 1).alias("digits")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(*own, "wanted").orderBy("digits")) - F.col("n")
    found = last.withColumn("before", upto).join(held, [*own, "wanted"]).filter("rank >= before AND rank < before + n")
    low = F.create_map(*[F.lit(x) for item in LOWEST.items() for x in item])[F.col("axis")]
    exact = (F.col("wanted") * base + F.col("digits") + low) / 1_000_000.0
    middle = lambda axis: F.avg(F.when(F.col("axis") == axis, exact))
    return found.groupBy(*key).agg(middle("latitude").alias("mid_lat"), middle("longitude").alias("mid_lon"))


def resolved_points(points: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the representative point with its address_code and level, n and dispersion (metres).

    The representative is nearest to the medians of latitude and longitude; ties (to the millimetre) by code and coordinates.
    The dispersion is the largest distance of two points, the box's diagonal beyond PAIRWISE points, 0 under two. Keys of up
    to PAIRWISE points are held whole; of others no place holds more than counts: see medians(). Coordinates have six decimals."""
    sizes = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("latitude").alias("s"), F.min("longitude").alias("w"), F.max("latitude").alias("t"), F.max("longitude").alias("e"))
    away = lambda p: F.round(haversine(p["latitude"], p["longitude"], F.col("mid_lat"), F.col("mid_lon")), 3)
    place = lambda p: F.struct(away(p).alias("away"), p["address_code"].alias("address_code"), p["latitude"].alias("latitude"), p["longitude"].alias("longitude"), p["level"].alias("level"))
    point = F.struct("address_code", "latitude", "longitude", "level")
    few = points.join(sizes.filter(F.col("n") <= PAIRWISE).select(*key, "n"), key).groupBy(*key).agg(F.first("n").alias("n"), F.median("latitude").alias("mid_lat"), F.median("longitude").alias("mid_lon"), F.collect_list(point).alias("few"))  # PAIRWISE at most
    pair = lambda p: F.array_max(F.transform("few", lambda q: haversine(p["latitude"], p["longitude"], q["latitude"], q["longitude"])))
    near = few.select(*key, F.array_min(F.transform("few", place)).alias("x"), "n", F.when(F.col("n") > 1, F.array_max(F.transform("few", pair))).otherwise(F.lit(0.0)).alias("dispersion"))
    large = points.join(sizes.filter(F.col("n") > PAIRWISE), key)
    placed = large.join(medians(large, key), key).withColumn("p", point)
    box = haversine(F.col("s"), F.col("w"), F.col("t"), F.col("e"))
    wide = placed.groupBy(*key, "n", "s", "w", "t", "e").agg(F.min(place(F.col("p"))).alias("x")).select(*key, "x", "n", box.alias("dispersion"))
    return near.unionByName(wide).select(*key, "x.address_code", "x.latitude", "x.longitude", "x.level", "n", "dispersion")


def dispersion(points: DataFrame, key: list[str]) -> DataFrame:
    return resolved_points(points, key).select(*key, "n", "dispersion")


def representative(points: DataFrame, key: list[str]) -> DataFrame:
    return resolved_points(points, key).select(*key, "address_code", "latitude", "longitude", "level")


def resolve(addresses: DataFrame, reference: DataFrame) -> DataFrame:
    """fingerprint, address columns, method, latitude, longitude, level, address_code, candidate_count, dispersion and reason.

    The address's best candidates where they lie within AMBIGUOUS, else the postal code's point, else nothing."""
    exact = resolved_points(best_level(unique_points(by_alias(reference), ADDRESS), ADDRESS), ADDRESS)
    wide = resolved_points(unique_points(by_postal_code(reference), POSTAL), POSTAL)
    columns = ["address_code", "latitude", "longitude", "level", "n", "dispersion"]
    a = exact.select(*ADDRESS, F.struct(*columns).alias("a"))
    p = wide.select(*POSTAL, F.struct(*columns).alias("p"))
    both = addresses.join(a, ADDRESS, "left").join(p, POSTAL, "left")
    hit = F.col("a").isNotNull() & (F.col("a.dispersion") <= AMBIGUOUS)
    vague, code = F.col("a").isNotNull() & ~hit, F.col("p").isNotNull()
    point = F.when(hit, F.col("a")).when(code, F.col("p"))
    counted = F.when(F.col("a").isNotNull(), F.col("a")).when(code, F.col("p"))
    reason = F.when(hit, "address_match").when(vague & code, "ambiguous_address_postal_fallback").when(vague, "ambiguous_address_without_postal_fallback").when(code, "address_not_matched_postal_fallback").otherwise("postal_code_not_found")
    found = both.withColumns({"point": point, "counted": counted})
    return found.select(
        "fingerprint", *ADDRESS, F.when(hit, "ADDRESS").when(code, "POSTAL_CODE").otherwise("UNLOCATED").alias("method"),
        F.col("point.latitude").cast("decimal(9,6)").alias("latitude"), F.col("point.longitude").cast("decimal(10,6)").alias("longitude"), "point.level", F.coalesce("point.address_code", F.lit("")).alias("address_code"),
        F.coalesce("counted.n", F.lit(0)).alias("candidate_count"), F.col("counted.dispersion").cast("decimal(12,2)").alias("dispersion"), reason.alias("reason"),
    )


def observations(establishments: DataFrame, companies: DataFrame, resolutions: DataFrame) -> DataFrame:
    """A row for each eligible establishment and month, with its point and what the map filters by."""
    placed = with_address(eligible(establishments)).join(resolutions.select("fingerprint", F.col("method"), "latitude", "longitude", "level"), "fingerprint")
    firms = companies.select("cnpj_basic", "competence", "company_size_code", tax_profile(F.col("simples_optant"), F.col("mei_optant")).alias("tax_profile"))
    full = placed.join(firms, ["cnpj_basic", "competence"], "left")
    return full.select(
        "competence", "cnpj", "cnpj_basic", F.col("municipality_ibge_code").alias("municipality"), "municipality_name", F.col("main_cnae_code").alias("cnae_code"), "branch_type", F.coalesce("company_size_code", F.lit("")).alias("size_code"),
        F.coalesce("tax_profile", F.lit("UNKNOWN")).alias("tax_profile"), "activity_start_date", "postal", "method", "latitude", "longitude", "level", "fingerprint",
    )


def unmatched(establishments: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Eligible rows whose address has no resolution: none is to be left."""
    return with_address(eligible(establishments)).join(resolutions.select("fingerprint"), "fingerprint", "left_anti")


def quality_report(seen: DataFrame, overall: float = 0.90, municipal: float = 0.70, drop: float = 0.05, approve_drop: bool = False, expected: DataFrame | None = None, months: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """scope (total, municipality, month, structure), key, eligible, located and passed.

    Structure is sound where no observation has a point that doesn't fit its method, or a company that isn't its
    establishment's; and, of what is given, where there are as many observations as expected (the eligible establishments),
    every month of months (competence) and no other, and no municipality outside scope (municipality; of it, those without
    observations pass). located counts offences there."""
    located = F.count_if(F.col("method") != "UNLOCATED")
    count = F.count(F.lit(1))
    enough = lambda share: F.col("eligible") * F.lit(share) <= F.col("located")
    line = lambda df, scope, key: df.select(F.lit(scope).alias("scope"), key.alias("key"), "eligible", "located", "passed")
    per_month = seen.groupBy("competence").agg(count.alias("eligible"), located.alias("located"))
    before = W.orderBy("competence")  # a row for each month
    rate = F.col("located") / F.nullif(F.col("eligible"), F.lit(0))
    fallen = per_month.withColumn("passed", F.lit(approve_drop) | F.coalesce(F.lag(rate).over(before) - rate <= drop, F.lit(True)))
    missing = F.col("latitude").isNull() | F.col("longitude").isNull() | F.col("level").isNull()
    odd = F.when(F.col("method") == "UNLOCATED", F.col("latitude").isNotNull() | F.col("longitude").isNotNull()).otherwise(missing)
    owner = ~F.col("cnpj").startswith(F.col("cnpj_basic"))
    whole = seen.agg(count.alias("eligible"), located.alias("located"), F.count_if(odd).alias("odd"), F.count_if(owner).alias("owner"))
    structure = lambda df, column, key: line(df.select("eligible", F.col(column).cast("long").alias("located")).withColumn("passed", F.col("located") == 0), "structure", F.lit(key))
    cities = seen.groupBy("municipality").agg(count.alias("eligible"), located.alias("located"))
    if scope is not None:
        cities = cities.join(scope.select("municipality").distinct().withColumn("known", F.lit(True)), "municipality", "full_outer").fillna(0, ["eligible", "located"])
    out = (
        line(whole.withColumn("passed", enough(overall)), "total", F.lit("all"))
        .unionByName(line(cities.withColumn("passed", enough(municipal)), "municipality", F.col("municipality")))
        .unionByName(line(fallen, "month", F.col("competence").cast("string")))
        .unionByName(structure(whole, "odd", "points that don't fit their method"))
        .unionByName(structure(whole, "owner", "companies of other establishments"))
    )
    if scope is not None:
        out = out.unionByName(structure(cities.agg(count.alias("eligible"), F.count_if(F.col("known").isNull()).alias("outside")), "outside", "municipalities outside the scope"))
    if expected is not None:
        both = expected.agg(count.alias("wanted")).join(F.broadcast(whole.select("eligible")), F.lit(True))  # one row each
        out = out.unionByName(structure(both.withColumn("off", F.abs(F.col("wanted") - F.col("eligible"))), "off", "observations for eligible establishments"))
    if months is not None:
        met = months.select("competence").distinct().withColumn("known", F.lit(True)).join(per_month.select("competence", "eligible"), "competence", "full_outer")
        out = out.unionByName(structure(met.agg(F.count("eligible").alias("eligible"), F.count_if(F.col("known").isNull() | F.col("eligible").isNull()).alias("off")), "off", "months of the window"))
    return out


def latest_population(population: DataFrame, scope: DataFrame) -> DataFrame:
    """municipality and population of the latest year (then source) that covers every municipality of scope; empty without one. scope: municipality."""
    n = scope.select("municipality").distinct()
    inside = population.join(F.broadcast(n), "municipality", "left_semi").filter("population > 0")  # a closed set of municipalities
    full = inside.groupBy("year", "source").agg(F.countDistinct("municipality").alias("covered"))
    wanted = n.agg(F.count(F.lit(1)).alias("covered"))
    last = full.join(F.broadcast(wanted), "covered").orderBy(F.desc("year"), F.desc("source")).limit(1).select("year", "source")
    return inside.join(F.broadcast(last), ["year", "source"], "left_semi").select("municipality", "population")


def cell(latitude: Column, longitude: Column) -> Column:
    """A number in whose order points near each other mostly are so too: 16 bits of each coordinate, by turns. Null without a point."""

    def spread(x: Column) -> Column:
        for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, step)).bitwiseAND(F.lit(mask))
        return x

    whole = lambda x, low, width: F.floor((x.cast("double") - low) / width * 65535).cast("long")
    return spread(whole(longitude, -180, 360)).bitwiseOR(F.shiftleft(spread(whole(latitude, -90, 180)), 1))


def inside_box(west: float, south: float, east: float, north: float) -> Column:
    if west > east or south > north:
        raise ValueError("the box is inverted")
    return F.col("longitude").between(west, east) & F.col("latitude").between(south, north)
