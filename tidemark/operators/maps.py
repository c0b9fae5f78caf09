"""Questions that the map asks of observations."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.show import cnae_label, opening_range, percentage_change, share
from tidemark.operators.geo import inside_box
from tidemark.operators.pages import at_most, page

#: Groups that one answer holds at most; with more, the answer goes up a level.
GROUPS = 5_000
#: What a selection may name.
CHOICES = {"branch_type": ("1", "2"), "size_code": ("00", "01", "03", "05"), "tax_profile": ("MEI", "SIMPLES", "REGULAR", "UNKNOWN"), "method": ("ADDRESS", "POSTAL_CODE", "UNLOCATED"), "opening_months": (1, 3, 6, 12), "mode": ("stock", "dynamics"), "metric": ("absolute", "per_1000")}

#: What a cell of company_sets() is of.
CELLS = ("municipality", "municipality_name", "branch_type", "size_code", "tax_profile", "method")


@dataclass(frozen=True)
class Selection:
    """What to show; nothing means all. A value that isn't known is an error, as are dynamics by opening or per inhabitant.

    Codes are checked by CHOICES, municipality and activity by shape; known_in() also holds them against what there is."""

    competence: date
    municipality: str | None = None
    cnae_code: str | None = None
    branch_type: str | None = None
    size_code: str | None = None
    tax_profile: str | None = None
    method: str | None = None
    opening_months: int | None = None
    mode: str = "stock"
    metric: str = "absolute"

    def __post_init__(self):
        for name, choices in CHOICES.items():
            value = getattr(self, name)
            if value is not None and value not in choices:
                raise ValueError(f"unknown {name}: {value}")
        for name in ("municipality", "cnae_code"):
            value = getattr(self, name)
            if value is not None and not re.fullmatch(r"\d{7}", value):
                raise ValueError(f"unknown {name}: {value}")
        if self.mode == "dynamics" and (self.opening_months or self.metric != "absolute"):
            raise ValueError("dynamics take neither an opening period nor inhabitants")

    def known_in(self, months: DataFrame, scope: DataFrame) -> Selection:
        """The selection, or an error if its month isn't among months (competence) or its municipality not in scope (municipality); both are small closed sets."""
        if months.filter(F.col("competence") == F.lit(self.competence)).isEmpty():
            raise ValueError(f"unknown competence: {self.competence}")
        if self.municipality is not None and scope.filter(F.col("municipality") == self.municipality).isEmpty():
            raise ValueError(f"unknown municipality: {self.municipality}")
        return self

    @property
    def of_cells(self) -> bool:
        """Whether cells of company_sets() tell it; activities are too many for cells, and openings are by day."""
        return self.cnae_code is None and self.opening_months is None

    @property
    def condition(self) -> Column:
        out = F.col("competence") == F.lit(self.competence)
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in ("municipality", "cnae_code", "branch_type", "size_code", "tax_profile", "method") and value is not None:
                out &= F.col(f.name) == value
        if self.opening_months:
            first, last = opening_range(F.lit(self.competence), self.opening_months)
            out &= F.col("activity_start_date").between(first, last)
        return out


def selected(observations: DataFrame, selection: Selection) -> DataFrame:
    return observations.filter(selection.condition)


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts, and coverage in percent."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    out = rows.agg(
        F.count(F.lit(1)).alias("establishments"), F.countDistinct("cnpj_basic").alias("companies"), F.countDistinct("municipality").alias("municipalities"), is_("method", "ADDRESS").alias("by_address"), is_("method", "POSTAL_CODE").alias("by_postal_code"), is_("method", "UNLOCATED").alias("unlocated"),
        is_("branch_type", "1").alias("headquarters"), is_("branch_type", "2").alias("branches"), is_("tax_profile", "MEI").alias("mei"), is_("tax_profile", "SIMPLES").alias("simples"), is_("tax_profile", "REGULAR").alias("regular"), is_("tax_profile", "UNKNOWN").alias("unknown_tax"),
    )
    return out.withColumn("coverage", share(F.col("by_address") + F.col("by_postal_code"), F.col("establishments")))


def by_municipality(rows: DataFrame) -> DataFrame:
    return rows.groupBy("municipality", "municipality_name").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("cnpj_basic").alias("companies"), F.count_if(F.col("method") != "UNLOCATED").alias("located"))


def company_numbers(observations: DataFrame) -> DataFrame:
    """competence, cnpj_basic and number: the companies of each month, those of a municipality next to each other.

    Numbers are dense within a partition of the sort, and nothing but that is said of them: write them before they are used."""
    firms = observations.groupBy("competence", "cnpj_basic").agg(F.min("municipality").alias("home"))
    order = ["competence", "home", "cnpj_basic"]
    return firms.repartitionByRange(*order).sortWithinPartitions(*order).select("competence", "cnpj_basic", F.monotonically_increasing_id().alias("number"))


def company_sets(observations: DataFrame, numbers: DataFrame) -> DataFrame:
    """Of each month, value of CELLS and bucket of 32,768 company numbers: how many establishments, and the companies as a bitmap.

    Rows meet by municipality and bucket, so bitmaps are made where they stay and a large municipality is as many groups as
    its companies fill. Bitmaps of other cells are joined by or: a company of several cells counts once in any sum of them."""
    placed = observations.select("competence", "cnpj_basic", *CELLS).join(numbers, ["competence", "cnpj_basic"])
    placed = placed.select("competence", *CELLS, F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit"))
    return placed.repartition("competence", "municipality", "bucket").groupBy("competence", *CELLS, "bucket").agg(F.count(F.lit(1)).alias("establishments"), F.bitmap_construct_agg("bit").alias("companies"))


def selected_sets(cells: DataFrame, selection: Selection) -> DataFrame:
    """The cells of a selection, whose counts are those of its observations; an error if it asks for more than cells tell."""
    if not selection.of_cells:
        raise ValueError("activities and openings are told by observations only")
    return cells.filter(selection.condition)


def _companies_by(cells: DataFrame, *by: str) -> DataFrame:
    """Establishments, located ones and distinct companies of cells, by columns."""
    located = F.sum(F.when(F.col("method") != "UNLOCATED", F.col("establishments")).otherwise(0))
    each = cells.groupBy(*by, "bucket").agg(F.sum("establishments").alias("total"), F.bitmap_count(F.bitmap_or_agg("companies")).alias("companies"), located.alias("located"))
    add = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "companies", "located")]
    return each.groupBy(*by).agg(*add)


def summary_of_sets(cells: DataFrame) -> DataFrame:
    """summary() of the observations that cells are of."""
    of = lambda c, v: F.coalesce(F.sum(F.when(F.col(c) == v, F.col("establishments"))), F.lit(0))
    counts = cells.agg(
        F.coalesce(F.sum("establishments"), F.lit(0)).alias("establishments"), F.countDistinct("municipality").alias("municipalities"), of("method", "ADDRESS").alias("by_address"), of("method", "POSTAL_CODE").alias("by_postal_code"), of("method", "UNLOCATED").alias("unlocated"),
        of("branch_type", "1").alias("headquarters"), of("branch_type", "2").alias("branches"), of("tax_profile", "MEI").alias("mei"), of("tax_profile", "SIMPLES").alias("simples"), of("tax_profile", "REGULAR").alias("regular"), of("tax_profile", "UNKNOWN").alias("unknown_tax"),
    )
    firms = _companies_by(cells).select("companies")
    one = F.lit(1).alias("one")
    out = counts.select("*", one).join(firms.select("*", one), "one")  # a row each
    out = out.select("establishments", "companies", *[c for c in counts.columns if c != "establishments"])
    return out.withColumn("coverage", share(F.col("by_address") + F.col("by_postal_code"), F.col("establishments")))


def by_municipality_of_sets(cells: DataFrame) -> DataFrame:
    """by_municipality() of the observations that cells are of."""
    return _companies_by(cells, "municipality", "municipality_name")


def density(rows: DataFrame, population: DataFrame) -> DataFrame:
    """by_municipality() with population and establishments and companies per 1,000 inhabitants, and a line for all of them."""
    return _density(by_municipality(rows), rows.agg(F.countDistinct("cnpj_basic").alias("companies")), population)


def density_of_sets(cells: DataFrame, population: DataFrame) -> DataFrame:
    """density() of the observations that cells are of."""
    return _density(by_municipality_of_sets(cells), _companies_by(cells).select("companies"), population)


def _density(counted: DataFrame, firms: DataFrame, population: DataFrame) -> DataFrame:
    counted = counted.join(F.broadcast(population), "municipality", "left")  # a row for each municipality
    whole = counted.agg(F.sum("total").alias("total"), F.sum("population").alias("population"))
    firms = firms.withColumn("one", F.lit(1))
    region = whole.withColumn("one", F.lit(1)).join(firms, "one").select(F.lit("region").alias("municipality"), "total", "companies", "population")
    both = counted.select("municipality", "total", "companies", "population").unionByName(region)
    return both.withColumns({"establishments_per_1000": share(F.col("total"), F.col("population"), 1000), "companies_per_1000": share(F.col("companies"), F.col("population"), 1000)})


def ranked(rows: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The most frequent values of key, which isn't blank; stable on ties."""
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), key).limit(top)


def dynamics(observations: DataFrame, events: DataFrame, now: Selection, before: date, key: str) -> DataFrame:
    """Stock before and now, openings, closures and what else changed it, by key; keys without any movement are left out.

    Openings count if the establishment is in today's selection, closures if it is in the earlier one."""
    then = Selection(**{f.name: getattr(now, f.name) for f in fields(now) if f.name not in ("competence", "mode")} | {"competence": before})
    current, previous = selected(observations, now), selected(observations, then)
    span = events.filter((F.col("to_month") == F.lit(now.competence)) & (F.col("entity_type") == "ESTABLISHMENT"))
    of = lambda name: span.filter(F.col("event_type") == name).select("cnpj")
    tag = lambda rows, name: rows.select(F.col(key).alias("key"), F.lit(name).alias("side"))
    tagged = tag(previous, "before").unionByName(tag(current, "now")).unionByName(tag(current.join(of("ESTABLISHMENT_OPENED"), "cnpj", "left_semi"), "opened")).unionByName(tag(previous.join(of("ESTABLISHMENT_CLOSED"), "cnpj", "left_semi"), "closed"))
    n = lambda side: F.count_if(F.col("side") == side)
    out = tagged.filter("key IS NOT NULL").groupBy("key").agg(n("before").alias("previous_establishments"), n("now").alias("establishments"), n("opened").alias("openings"), n("closed").alias("closures"))
    out = out.withColumn("stock_change", F.col("establishments") - F.col("previous_establishments")).withColumn("lifecycle_balance", F.col("openings") - F.col("closures"))
    out = out.withColumns({"change_percentage": percentage_change(F.col("previous_establishments"), F.col("establishments")), "other_effects": F.col("stock_change") - F.col("lifecycle_balance")})
    return out.filter("stock_change <> 0 OR openings <> 0 OR closures <> 0")


def movement_ranking(moved: DataFrame, top: int = 10) -> DataFrame:
    return moved.orderBy(F.desc(F.abs("stock_change")), F.desc("stock_change"), "key").limit(top)


def location_clusters(rows: DataFrame) -> DataFrame:
    return rows.filter("latitude IS NOT NULL AND longitude IS NOT NULL").groupBy("latitude", "longitude", "method", "level").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("cnpj_basic").alias("companies"))


def postal_clusters(rows: DataFrame) -> DataFrame:
    """Groups of municipality and postal code, at the point of the least fingerprint in them."""
    some = rows.filter("latitude IS NOT NULL AND longitude IS NOT NULL AND postal <> ''")
    return some.groupBy("municipality", "postal").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("cnpj_basic").alias("companies"), F.min_by(F.struct("latitude", "longitude"), "fingerprint").alias("at")).select("municipality", "postal", "total", "companies", "at.latitude", "at.longitude")


def municipality_points(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """by_municipality() at the municipalities' centres (municipality, latitude, longitude)."""
    return at_centres(by_municipality(rows), centres)


def at_centres(counted: DataFrame, centres: DataFrame) -> DataFrame:
    return counted.select("municipality", "total", "companies").join(F.broadcast(centres), "municipality")  # a closed set


def clusters(rows: DataFrame, centres: DataFrame, zoom: int, box: tuple[float, float, float, float] | None = None, limit: int = GROUPS) -> tuple[str, DataFrame]:
    """The level for zoom and its groups; a level with more than limit groups gives way to the one above, and none is cut short."""
    if box:
        rows = rows.filter(inside_box(*box))
    if zoom >= 12 and (exact := at_most(location_clusters(rows), limit)) is not None:
        return "exact", exact
    if zoom >= 9 and (postal := at_most(postal_clusters(rows), limit)) is not None:
        return "postal", postal
    return "municipality", municipality_points(rows, centres)


def location_details(rows: DataFrame, latitude: str, longitude: str, establishments: DataFrame, companies: DataFrame, catalogue: DataFrame, number: int = 1, size: int = 25, method: str | None = None, level: int | None = None) -> DataFrame:
    """A page of the establishments at a point (six decimals), with their names and their activity's label; of one method and level if given.

    catalogue: code, description of activities (a national catalogue). Names are fetched for the page's rows only."""
    if method is not None and method not in CHOICES["method"]:
        raise ValueError(f"unknown method: {method}")
    if level is not None and not 1 <= level <= 6:
        raise ValueError(f"unknown level: {level}")
    six = lambda x: F.lit(Decimal(x).quantize(Decimal("0.000001")))
    here = rows.filter((F.col("latitude") == six(latitude)) & (F.col("longitude") == six(longitude)))
    if method is not None:
        here = here.filter(F.col("method") == method)
    if level is not None:
        here = here.filter(F.col("level") == level)
    few = page(here.select("competence", "cnpj", "cnpj_basic", "municipality_name", "cnae_code", "branch_type", "method", "level"), [("cnpj", False)], number, size)
    few = F.broadcast(few)  # a page
    named = establishments.join(few.select("cnpj", "competence"), ["cnpj", "competence"], "left_semi").select("cnpj", "trade_name")
    firms = companies.join(few.select("cnpj_basic", "competence"), ["cnpj_basic", "competence"], "left_semi").select("cnpj_basic", "legal_name")
    known = catalogue.join(few.select(F.col("cnae_code").alias("code")).distinct(), "code", "left_semi").select(F.col("code").alias("cnae_code"), "description")
    out = few.join(named, "cnpj", "left").join(firms, "cnpj_basic", "left").join(known, "cnae_code", "left")
    return out.withColumn("cnae_label", cnae_label(F.col("cnae_code"), F.col("description"))).drop("description")


def features(groups: DataFrame, identifier: Column) -> DataFrame:
    """GeoJSON lines of groups that have latitude and longitude."""
    properties = [c for c in groups.columns if c not in ("latitude", "longitude")]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col("longitude").cast("double"), F.col("latitude").cast("double")).alias("coordinates"))
    return groups.select(identifier.alias("id"), F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def municipality_features(rows: DataFrame, scope: DataFrame, population: DataFrame) -> DataFrame:
    """A row for each municipality of scope (municipality), zero where nothing is."""
    return features_by_municipality(by_municipality(rows), scope, population)


def features_by_municipality(counted: DataFrame, scope: DataFrame, population: DataFrame) -> DataFrame:
    counted = counted.select("municipality", "total", "companies", "located")
    out = scope.select("municipality").distinct().join(counted, "municipality", "left").fillna(0, ["total", "companies", "located"]).join(population, "municipality", "left")
    return out.withColumn("per_1000", share(F.col("total"), F.col("population"), 1000))


def adjacent(months: DataFrame) -> DataFrame:
    """competence and the month before it in the window."""
    return months.select("competence", F.lag("competence").over(W.orderBy("competence")).alias("previous"))
