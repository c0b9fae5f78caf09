"""Regional metrics, dashboard figures, search, timelines and rankings over snapshots and events."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import ids, text
from tidemark.functions.show import capital
from tidemark.operators.pages import page

#: Metric families.
TOTALS, BY_CITY, BY_CNAE, BY_STATUS = "TOTAL", "BY_MUNICIPALITY", "BY_CNAE", "BY_STATUS"


def regional_metrics(companies: DataFrame, establishments: DataFrame) -> DataFrame:
    """competence, metric_type, entity_type, municipality, cnae_code, status_code, size_code and value of every month.

    Establishments in the region are counted in total and by municipality, activity and status by grouping sets in one
    pass (null activities are a group); companies are those with such an establishment in the month, in total and by size."""
    inside = establishments.filter("is_in_region").select("competence", "cnpj_basic", F.col("municipality_ibge_code").alias("municipality"), F.col("main_cnae_code").alias("cnae_code"), F.col("registration_status_code").alias("status_code"))
    sets = [["competence"], ["competence", "municipality"], ["competence", "cnae_code"], ["competence", "status_code"]]
    counted = inside.groupingSets([[F.col(c) for c in s] for s in sets], "competence", "municipality", "cnae_code", "status_code").agg(F.count(F.lit(1)).alias("value"), F.grouping("municipality").alias("gm"), F.grouping("cnae_code").alias("gc"), F.grouping("status_code").alias("gs"))
    kind = F.when(F.col("gm") == 0, "REGIONAL_ESTABLISHMENTS_BY_MUNICIPALITY").when(F.col("gc") == 0, "REGIONAL_ESTABLISHMENTS_BY_CNAE").when(F.col("gs") == 0, "REGIONAL_ESTABLISHMENTS_BY_STATUS").otherwise("REGIONAL_ESTABLISHMENTS_TOTAL")
    no = F.lit(None).cast("string")
    places = counted.select("competence", kind.alias("metric_type"), F.lit("ESTABLISHMENT").alias("entity_type"), "municipality", "cnae_code", "status_code", no.alias("size_code"), "value")
    present = companies.join(inside.select("competence", "cnpj_basic"), ["competence", "cnpj_basic"], "left_semi")
    sized = present.groupingSets([["competence"], ["competence", "company_size_code"]], "competence", "company_size_code").agg(F.count(F.lit(1)).alias("value"), F.grouping("company_size_code").alias("g"))
    firms = sized.select("competence", F.when(F.col("g") == 0, "REGIONAL_COMPANIES_BY_SIZE").otherwise("REGIONAL_COMPANIES_TOTAL").alias("metric_type"), F.lit("COMPANY").alias("entity_type"), no.alias("municipality"), no.alias("cnae_code"), no.alias("status_code"), F.col("company_size_code").alias("size_code"), "value")
    return places.unionByName(firms)


def in_region(establishments: DataFrame, municipality: str | None = None, cnae: str | None = None) -> DataFrame:
    out = establishments.filter("is_in_region")
    if municipality:
        out = out.filter(F.col("municipality_ibge_code") == municipality)
    return out.filter(F.col("main_cnae_code") == cnae) if cnae else out


def eligible_events(events: DataFrame, regional: DataFrame, first: date, last: date) -> DataFrame:
    """Events of the months after first up to last: of establishments that the region has in a month from first to last, of others if their company has one."""
    months = regional.filter(F.col("competence").between(first, last))
    own = months.select("cnpj").distinct()
    roots = months.select("cnpj_basic").distinct()
    span = events.filter((F.col("to_month") > first) & (F.col("to_month") <= last))
    return span.filter("entity_type = 'ESTABLISHMENT'").join(own, "cnpj", "left_semi").select(span.columns).unionByName(span.filter("entity_type <> 'ESTABLISHMENT'").join(roots, "cnpj_basic", "left_semi").select(span.columns))


def of_headquarters(events: DataFrame, regional: DataFrame) -> DataFrame:
    """Events of companies whose headquarters is among the region's establishments: the narrower scope of capital changes."""
    return events.join(regional.filter("branch_type = '1'").select("cnpj_basic").distinct(), "cnpj_basic", "left_semi").select(events.columns)


def counts_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))


def trend(regional: DataFrame, months: DataFrame) -> DataFrame:
    """competence and total for every month, 0 where there are none."""
    counted = regional.groupBy("competence").agg(F.count(F.lit(1)).alias("total"))
    return months.join(counted, "competence", "left").select("competence", F.coalesce("total", F.lit(0)).alias("total"))


def opening_closing(events: DataFrame, months: DataFrame) -> DataFrame:
    """competence, openings and closings for every month."""
    both = events.groupBy(F.col("to_month").alias("competence")).agg(F.count_if(F.col("event_type") == "ESTABLISHMENT_OPENED").alias("openings"), F.count_if(F.col("event_type") == "ESTABLISHMENT_CLOSED").alias("closings"))
    return months.join(both, "competence", "left").select("competence", F.coalesce("openings", F.lit(0)).alias("openings"), F.coalesce("closings", F.lit(0)).alias("closings"))


def cnae_growth(regional: DataFrame, first: date, last: date, top: int = 5) -> DataFrame:
    """direction (growth or reduction), place, cnae_code, start, end and delta of the activities that changed most."""
    at = lambda month: F.count_if(F.col("competence") == month)
    counted = regional.filter(F.col("competence").isin(first, last) & F.col("main_cnae_code").isNotNull()).groupBy(F.col("main_cnae_code").alias("cnae_code")).agg(at(first).alias("start"), at(last).alias("end"))
    moved = counted.withColumn("delta", F.col("end") - F.col("start"))
    up = moved.filter("delta > 0").orderBy(F.desc("delta"), "cnae_code").limit(top).withColumn("direction", F.lit("growth"))
    down = moved.filter("delta < 0").orderBy("delta", "cnae_code").limit(top).withColumn("direction", F.lit("reduction"))
    both = up.unionByName(down)  # 2 * top rows
    return both.withColumn("place", F.row_number().over(W.partitionBy("direction").orderBy(F.desc(F.abs("delta")), "cnae_code"))).select("direction", "place", "cnae_code", "start", "end", "delta")


def grown_capital(events: DataFrame) -> DataFrame:
    """cnpj_basic, previous, current and delta of companies whose capital grew from the first readable change's earlier amount to the last one's later."""
    rows = events.filter("event_type = 'SHARE_CAPITAL_CHANGED'").select("cnpj_basic", "to_month", capital(F.col("previous_value")).alias("a"), capital(F.col("new_value")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return rows.groupBy("cnpj_basic").agg(F.min_by("a", "to_month").alias("previous"), F.max_by("b", "to_month").alias("current")).withColumn("delta", F.col("current") - F.col("previous")).filter("delta > 0")


def capital_growth(events: DataFrame, names: DataFrame, number: int = 1, size: int = 3) -> DataFrame:
    """A page of grown_capital(), the largest growth first, with names."""
    return named(page(grown_capital(events), [("delta", True), ("cnpj_basic", False)], number, size), names)


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with legal_name from names (cnpj_basic, legal_name), a standing text without one."""
    return rows.join(names.select("cnpj_basic", "legal_name"), "cnpj_basic", "left").withColumn("legal_name", F.coalesce("legal_name", F.lit("Empresa sem nome")))


def partner_growth(events: DataFrame, partners: DataFrame, names: DataFrame, first: date, last: date, top: int = 8) -> DataFrame:
    """The companies with most partners added over removed, with their numbers of partners at both ends."""
    count = lambda event: F.count_if(F.col("event_type") == event)
    best = events.groupBy("cnpj_basic").agg(count("PARTNER_ADDED").alias("added"), count("PARTNER_REMOVED").alias("removed")).withColumn("delta", F.col("added") - F.col("removed")).filter("delta > 0").orderBy(F.desc("delta"), "cnpj_basic").limit(top)
    # top rows are few, so they meet the partners by broadcast
    at = partners.filter(F.col("competence").isin(first, last)).join(F.broadcast(best.select("cnpj_basic")), "cnpj_basic", "left_semi").groupBy("cnpj_basic").agg(F.count_if(F.col("competence") == first).alias("previous"), F.count_if(F.col("competence") == last).alias("current"))
    return named(best.join(at, "cnpj_basic", "left").fillna(0, ["previous", "current"]), names)


def recent_companies(events: DataFrame, month: date, top: int = 8) -> DataFrame:
    """The newest events of a month, top of each kind of target, one for each company, top in all."""
    last = events.filter(F.col("to_month") == month).withColumn("seen", F.sha2(F.concat_ws("|", "event_type", "entity_key"), 256))
    kinds = [last.filter(F.col("entity_type") == k).orderBy(F.desc("seen")).limit(top) for k in ("COMPANY", "ESTABLISHMENT", "PARTICIPATION")]
    few = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])  # 3 * top rows
    one = few.withColumn("r", F.row_number().over(W.partitionBy("cnpj_basic").orderBy(F.desc("seen")))).filter("r = 1")
    return one.orderBy(F.desc("seen")).limit(top).select("cnpj_basic", "entity_type", "event_type", "entity_key")


BOARD = "section string, place int, key string, label string, before decimal(19,2), after decimal(19,2), value decimal(19,2)"
#: Size of a page of capital growth, and of the other lists of the board.
CAPITAL_PAGE, CNAES, LIST = 3, 5, 8


def board(companies: DataFrame, establishments: DataFrame, partners: DataFrame, events: DataFrame, months: list[date], municipality: str | None = None, cnae: str | None = None, headquarters: bool = False, capital_page: int = 1) -> DataFrame:
    """The whole dashboard of the months from the first to the last of months under filters, as rows of BOARD.

    What is regional is what the last month has in the region under the filters; with a filter, events count if they are of
    these establishments or of their companies, without one all of the interval do. Sections: companies, establishments,
    events (by type), status, size, trend, opened and closed (by month), growth and reduction (activities), capital (a page;
    with headquarters only companies that have theirs in the region), partners and recent.

    Counts are one aggregation of tagged rows: of each snapshot and event, what it counts for."""
    first, last = months[0], months[-1]
    inside = in_region(establishments, municipality, cnae).filter(F.col("competence").between(first, last))
    now = inside.filter(F.col("competence") == last)
    own = now.select("cnpj", "cnpj_basic", "branch_type")
    roots = own.select("cnpj_basic").distinct()
    span = events.filter((F.col("to_month") > first) & (F.col("to_month") <= last))
    if municipality or cnae:
        of_place = F.col("entity_type") == "ESTABLISHMENT"
        span = span.filter(of_place).join(own.select("cnpj"), "cnpj", "left_semi").select(span.columns).unionByName(span.filter(~of_place).join(roots, "cnpj_basic", "left_semi").select(span.columns))

    month, said = F.col("competence"), F.lit("—")
    at = lambda m: (month == m).cast("long")
    tag = lambda section, key, before, after: F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), F.lit(before).cast("long").alias("before"), F.lit(after).cast("long").alias("after"))
    when = lambda test, *rest: F.when(test, tag(*rest))
    tagged = lambda df, *tags: df.select(F.inline(F.array_compact(F.array(*tags))))
    code = F.coalesce(F.nullif("main_cnae_code", F.lit("")), said)
    rows = tagged(
        inside, tag("trend", month, 0, 1), when(month == last, "establishments", F.lit(""), 0, 1), when(month == last, "status", F.coalesce(F.nullif("registration_status_code", F.lit("")), said), 0, 1), when(month.isin(first, last), "cnae", code, at(first), at(last)),
    )
    sized = companies.filter(month == last).join(roots, "cnpj_basic", "left_semi")
    kind = F.col("event_type")
    told = tagged(span, tag("events", kind, 0, 1), *[when(kind == f"ESTABLISHMENT_{name.upper()}", name, F.col("to_month"), 0, 1) for name in ("opened", "closed")])
    none = events.sparkSession.createDataFrame([(s, str(m), 0, 0) for m in months for s in ("trend", "opened", "closed")] + [(s, "", 0, 0) for s in ("establishments", "companies")], "section string, key string, before long, after long")
    parts = [rows, tagged(sized, tag("size", F.coalesce(F.nullif("company_size_code", F.lit("")), said), 0, 1)), tagged(roots, tag("companies", F.lit(""), 0, 1)), told, none]
    counted = reduce(DataFrame.unionByName, parts).groupBy("section", "key").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    # one shuffle and as many rows as there are codes; of activities only those that moved most stay
    delta = F.col("after") - F.col("before")
    moved = F.when(F.col("section") != "cnae", F.col("section")).when(delta > 0, "growth").when(delta < 0, "reduction")
    placed = counted.withColumn("section", moved).filter("section IS NOT NULL").withColumn("place", F.row_number().over(W.partitionBy("section").orderBy(F.desc(F.abs(delta)), "key")))
    lists = F.col("section").isin("growth", "reduction")
    money = lambda c: c.cast("decimal(19,2)")
    line = lambda df, section, place, key, label, before, after, value: df.select(section.alias("section"), place.cast("int").alias("place"), key.alias("key"), label.cast("string").alias("label"), money(before).alias("before"), money(after).alias("after"), money(value).alias("value"))
    out = line(placed.filter(~lists | (F.col("place") <= CNAES)), F.col("section"), F.when(lists, F.col("place")), F.col("key"), F.lit(None), F.when(lists, F.col("before")), F.when(lists, F.col("after")), F.when(lists, delta).otherwise(F.col("after")))

    names = companies.filter(month == last).select("cnpj_basic", "legal_name")
    grown = grown_capital(of_headquarters(span, now) if headquarters else span)
    if capital_page == 1:
        best = grown.orderBy(F.desc("delta"), "cnpj_basic").limit(CAPITAL_PAGE).withColumn("place", F.row_number().over(W.orderBy(F.desc("delta"), "cnpj_basic")))
    else:
        best = page(grown, [("delta", True), ("cnpj_basic", False)], capital_page, CAPITAL_PAGE)
    people = partner_growth(span, partners, names, first, last, LIST)
    newest = recent_companies(span, last, LIST)
    ordered = lambda df, *order: df.withColumn("place", F.row_number().over(W.orderBy(*order)))  # noqa: E731  LIST rows at most
    column = F.col
    return (
        out.unionByName(line(named(best, names), F.lit("capital"), column("place"), column("cnpj_basic"), column("legal_name"), column("previous"), column("current"), column("delta")))
        .unionByName(line(ordered(people, F.desc("delta"), "cnpj_basic"), F.lit("partners"), column("place"), column("cnpj_basic"), column("legal_name"), column("previous"), column("current"), column("delta")))
        .unionByName(line(ordered(newest, F.desc(F.sha2(F.concat_ws("|", "event_type", "entity_key"), 256))), F.lit("recent"), column("place"), column("cnpj_basic"), column("event_type"), F.lit(None), F.lit(None), F.lit(None)))
    )


#: What stands before a name, so that its start is a part like others.
START_OF_NAME, GRAM = "^", 3


def search_index(companies: DataFrame, establishments: DataFrame) -> DataFrame:
    """Postings of names: competence, gram, name, cnpj_basic, legal_name and regional_establishments.

    A company is found by its own name and by those of its establishments; a row for each run of GRAM characters of each of
    its names, START_OF_NAME before it included. All that a result shows is in the row, so a search reads postings only."""
    key = ["competence", "cnpj_basic"]
    regional = establishments.filter("is_in_region").groupBy(*key).agg(F.count(F.lit(1)).alias("regional_establishments"))
    firms = companies.select(*key, "legal_name", "legal_name_search").join(regional, key, "left").fillna(0, ["regional_establishments"])
    shown, own = ["legal_name", "regional_establishments"], F.col("legal_name_search")
    # establishments' names are shuffled once, by company; a name that is also the company's own is left to it, so none is there twice
    others = establishments.select(*key, F.col("trade_name_search").alias("name")).repartition(*key).distinct().join(firms, key).filter(~F.col("name").eqNullSafe(own))
    named = firms.select(*key, *shown, own.alias("name")).unionByName(others.select(*key, *shown, "name"))
    whole = F.concat(F.lit(START_OF_NAME), "name")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (GRAM - 1), F.lit(1))), lambda i: F.substring(whole, i, F.lit(GRAM))))
    return named.filter("name <> ''").select("competence", F.explode(grams).alias("gram"), "name", "cnpj_basic", *shown)


def indexed_search(query: str, index: DataFrame, limit: int = 50) -> DataFrame | None:
    """search() by name on postings of one month; none for what isn't a name of two characters or more."""
    wanted = text.search_text(F.lit(query))
    # constants only, which need no job
    shape = index.sparkSession.sql("SELECT 1").select(ids.looks_like_id(F.lit(query)).alias("id"), wanted.alias("wanted")).first()
    if shape.id or len(query) < 2 or len(shape.wanted) < 2:
        return None
    name, said = F.col("name"), shape.wanted
    few = lambda rows: rows.select("cnpj_basic", "legal_name", "regional_establishments").distinct().orderBy("legal_name", "cnpj_basic").limit(limit)
    found = few(index.filter((F.col("gram") == START_OF_NAME + said[: GRAM - 1]) & name.startswith(said))).collect()
    if not found:
        # a name that holds the term holds each of its parts; of a term of two characters there is none, but each name starts once
        part = F.col("gram") == said[-GRAM:] if len(said) >= GRAM else F.col("gram").startswith(START_OF_NAME)
        found = few(index.filter(part & name.contains(said))).collect()  # limit rows
    return index.sparkSession.createDataFrame(found, "cnpj_basic string, legal_name string, regional_establishments long")


def search(query: str, companies: DataFrame, establishments: DataFrame, regional: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Companies of one month by id, by the start of a name, or where no name starts so by a part of it; by legal name and id.

    companies and establishments are of one month; regional, if given, holds the establishments that a result must have one of."""
    wanted = text.search_text(F.lit(query))
    # constants only, which need no job
    shape = companies.sparkSession.sql("SELECT 1").select(ids.looks_like_id(F.lit(query)).alias("id"), ids.parsed(F.lit(query)).alias("full")).first()
    if shape.id:
        found = companies.select("cnpj_basic").filter(F.col("cnpj_basic") == F.lit(shape.full or "")) if len(shape.full or "") != 14 else establishments.filter(F.col("cnpj") == shape.full).select("cnpj_basic")
    elif len(query) >= 2:
        hits = lambda test: companies.filter(test(F.col("legal_name_search"))).select("cnpj_basic").unionByName(establishments.filter(test(F.col("trade_name_search"))).select("cnpj_basic"))
        found = hits(lambda c: c.startswith(wanted))
        if found.isEmpty():
            found = hits(lambda c: c.contains(wanted))
    else:
        found = companies.select("cnpj_basic") if not query else companies.select("cnpj_basic").limit(0)
    out = companies.join(found.distinct(), "cnpj_basic", "left_semi")
    if regional is not None:
        out = out.join(regional.select("cnpj_basic"), "cnpj_basic", "left_semi")
    few = out.orderBy("legal_name", "cnpj_basic").limit(limit).select("cnpj_basic", "legal_name")
    counted = establishments.filter("is_in_region").join(F.broadcast(few.select("cnpj_basic")), "cnpj_basic", "left_semi").groupBy("cnpj_basic").agg(F.count(F.lit(1)).alias("regional_establishments"))  # limit rows
    return few.join(counted, "cnpj_basic", "left").fillna(0, ["regional_establishments"]).orderBy("legal_name", "cnpj_basic")


def target(identifier: str) -> Column:
    """Events that concern an id: of 8 characters all of the company, of 14 its company's and partners' and its own."""
    if len(identifier) == 8:
        return F.col("cnpj_basic") == identifier
    return (F.col("cnpj_basic") == identifier[:8]) & ((F.col("entity_type") != "ESTABLISHMENT") | (F.col("cnpj") == identifier))


def event_list(events: DataFrame, event_type: str | None = None, entity_type: str | None = None, month: date | None = None, identifier: str | None = None, limit: int = 200) -> DataFrame:
    """The newest events under the given filters; of one month by type and key."""
    for column, value in (("event_type", event_type), ("entity_type", entity_type), ("to_month", month)):
        if value is not None:
            events = events.filter(F.col(column) == F.lit(value))
    if identifier:
        events = events.filter(target(identifier))
    return events.orderBy(F.desc("to_month"), "event_type", "entity_key").limit(limit)


def watchlist(watched: DataFrame, companies: DataFrame, events: DataFrame, month: date) -> DataFrame:
    """user_id, cnpj_basic, the company's state in month and its number of events then."""
    state = companies.filter(F.col("competence") == month).select("cnpj_basic", "legal_name", "share_capital")
    recent = events.filter(F.col("to_month") == month).groupBy("cnpj_basic").agg(F.count(F.lit(1)).alias("recent_events"))
    return watched.join(state, "cnpj_basic", "left").join(recent, "cnpj_basic", "left").fillna(0, ["recent_events"])


def latest_state(companies: DataFrame, establishments: DataFrame, partners: DataFrame, identifier: str) -> DataFrame:
    """section, place and item of a company in the last month: itself, its establishments (those inside first), its partners by name."""
    own = lambda df: df.filter(F.col("cnpj_basic") == identifier)
    last = companies.agg(F.max("competence").alias("competence"))
    now = lambda df: own(df).join(F.broadcast(last), "competence", "left_semi")
    section = lambda df, name, item, *order: df.select(F.lit(name).alias("section"), F.row_number().over(W.partitionBy("cnpj_basic").orderBy(*order)).alias("place"), item.alias("item"))
    return (
        section(now(companies), "company", F.col("legal_name"), F.col("cnpj_basic"))
        .unionByName(section(now(establishments), "establishment", F.col("cnpj"), F.desc("is_in_region"), F.col("cnpj")))
        .unionByName(section(now(partners), "partner", F.col("display_name"), F.col("display_name"), F.col("partner_key")))
    )
