"""Snapshots of consecutive months into typed change events, for all month pairs of a window in one job.

Content hashes come first: identity, month and hash of every row are shuffled once, and a row's neighbours in time say
where content differs or a side is missing. Whole rows are fetched for these keys only, by a join that few keys make a
broadcast and many a filtered shuffle. A changed row becomes an array of the events whose condition holds, exploded once.
A row's absence never is a closure; it is a quality issue. The first month has no predecessor, so it gives no events.

Events: to_month, event_type, entity_type, dimension, entity_key, cnpj_basic, cnpj, previous_value, new_value (JSON) and
effective_date. Issues: to_month, rule_code, entity_type and entity_key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.keys import participation_key

ADDRESS = ("street_type", "street_name", "street_number", "address_complement", "neighborhood", "postal_code", "state_code", "municipality_ibge_code")
CLOSED = "08"


def month_pairs(months: DataFrame) -> DataFrame:
    """from_month and to_month of neighbours in the order of months, a table of one small row for each month."""
    return months.select("competence").distinct().select(F.lag("competence").over(W.orderBy("competence")).alias("from_month"), F.col("competence").alias("to_month")).filter("from_month IS NOT NULL")


def _of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows of the months that a pair has, with next_month, last_month and the month's place; others' would only be sorted and shuffled for nothing."""
    none, month = F.lit(None).cast("date"), F.col("competence")
    side = lambda own, after, before: F.struct(own.alias("competence"), after.alias("next_month"), before.alias("last_month"))
    both = pairs.select(F.inline(F.array(side(F.col("from_month"), F.col("to_month"), none), side(F.col("to_month"), none, F.col("from_month")))))
    each = both.groupBy("competence").agg(F.max("next_month").alias("next_month"), F.max("last_month").alias("last_month"))
    # pairs has a row for each month of a window
    return rows.join(F.broadcast(each.withColumn("place", F.row_number().over(W.orderBy(month)))), "competence")


def neighbours(snapshots: DataFrame, pairs: DataFrame, identity: list[str]) -> DataFrame:
    """identity, from_month, to_month, old_hash and new_hash (null where a side lacks the identity) of every identity and pair that either side has.

    One shuffle of identities, months and hashes; where a month has several rows of an identity, each meets each of the other month."""
    found = _met(snapshots.select(*identity, "competence", "record_hash"), pairs, identity, F.col("record_hash"))
    return found.select(*identity, "from_month", "to_month", F.col("p").alias("old_hash"), F.col("c").alias("new_hash"))


def _met(snapshots: DataFrame, pairs: DataFrame, identity: list[str], row: Column, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """identity, to_month, from_month, p and c (row before and after, null where absent) of every identity and pair that either side has; keep: of which p and c."""
    rows, month = _of_pairs(snapshots.select(*identity, "competence", row.alias("row")), pairs), F.col("competence")
    # all rows of the month before or after, however many; of a pair's months none lies between
    near = lambda n: W.partitionBy(*identity).orderBy("place").rangeBetween(n, n)
    seen = rows.select("*", F.max("competence").over(near(-1)).alias("before"), F.collect_list("row").over(near(-1)).alias("rows_before"), F.max("competence").over(near(1)).alias("after"))
    side = lambda first, last, p, c: F.struct(last.alias("to_month"), first.alias("from_month"), p.alias("p"), c.alias("c"))
    none = F.lit(None).cast(rows.schema["row"].dataType)
    old = F.when(F.col("before") == F.col("last_month"), F.col("rows_before")).otherwise(F.array(none))
    if keep:
        old = F.filter(old, lambda p: keep(p, F.col("row")))
    came = F.when(F.col("last_month").isNotNull(), F.transform(old, lambda p: side(F.col("last_month"), month, p, F.col("row"))))
    went = F.when(F.col("next_month").isNotNull() & ~F.col("after").eqNullSafe(F.col("next_month")), F.array(side(month, F.col("next_month"), F.col("row"), none)))
    return seen.select(*identity, F.inline(F.flatten(F.array_compact(F.array(came, went)))))


def each_with_each(ps: Column, cs: Column, none: Column) -> Column:
    """Of a pair's rows before and after each with each, as structs of p and c; none stands for a side without rows."""
    some = lambda rows: F.when(F.size(rows) > 0, rows).otherwise(F.array(none))
    return F.flatten(F.transform(some(ps), lambda p: F.transform(some(cs), lambda c: F.struct(p.alias("p"), c.alias("c")))))


def changed(snapshots: DataFrame, pairs: DataFrame, identity: list[str], together: bool = False) -> DataFrame:
    """identity, to_month, from_month, p and c (the rows before and after as structs, null where absent) of all rows whose content differs or that one side lacks.

    Where a month has several rows of an identity, each meets each of the other month. together: rows of an identity are
    stored in one bucket, so whole rows meet their neighbours in time without a shuffle."""
    if together:
        return _changed_in_place(snapshots, pairs, identity)
    keys = neighbours(snapshots, pairs, identity).filter(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    keys = keys.groupBy(*identity, "from_month", "to_month").agg(F.max("old_hash").alias("old_hash"), F.max("new_hash").alias("new_hash"))
    here = F.struct(F.col("from_month").alias("competence"), F.lit(True).alias("old"))
    there = F.struct(F.col("to_month").alias("competence"), F.lit(False).alias("old"))
    wanted = keys.select(*identity, "from_month", "to_month", F.inline(F.array_compact(F.array(F.when(F.col("old_hash").isNotNull(), here), F.when(F.col("new_hash").isNotNull(), there)))))
    row = F.struct(*[c for c in snapshots.columns if c not in (*identity, "competence")])
    found = snapshots.select(*identity, "competence", row.alias("row")).join(wanted, [*identity, "competence"])
    return paired(found, identity)


def paired(sides: DataFrame, identity: list[str]) -> DataFrame:
    """changed() of its sides: identity, from_month, to_month, row and whether it is the old one."""
    side = lambda old: F.collect_list(F.when(F.col("old") == F.lit(old), F.col("row")))
    held = sides.groupBy(*identity, "to_month", "from_month").agg(side(True).alias("ps"), side(False).alias("cs"))
    none = F.lit(None).cast(sides.schema["row"].dataType)
    return held.select(*identity, "to_month", "from_month", F.inline(each_with_each(F.col("ps"), F.col("cs"), none))).filter(~F.col("p.record_hash").eqNullSafe(F.col("c.record_hash")))


def _changed_in_place(snapshots: DataFrame, pairs: DataFrame, identity: list[str]) -> DataFrame:
    row = F.struct(*[c for c in snapshots.columns if c not in (*identity, "competence")])
    return _met(snapshots, pairs, identity, row, lambda p, c: ~p["record_hash"].eqNullSafe(c["record_hash"]))


def json(side: str, *fields: str) -> Column:
    """Fields of p or c as JSON with nulls."""
    values = [F.col(f"{side}.{f}").alias(f) for f in fields]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def differs(field: str) -> Column:
    return ~F.col(f"p.{field}").eqNullSafe(F.col(f"c.{field}"))


def any_differs(fields: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, map(differs, fields))


def _event(condition: Column, event: str, dimension: str, before: Column, after: Column, day: Column | None = None) -> Column:
    nothing = F.lit(None)
    return F.when(condition, F.struct(F.lit(event).alias("event_type"), F.lit(dimension).alias("dimension"), before.cast("string").alias("previous_value"), after.cast("string").alias("new_value"), (nothing if day is None else day).cast("date").alias("effective_date")))


def _explode(rows: DataFrame, entity_type: str, key: Column, basic: Column, cnpj: Column, events: list[Column]) -> DataFrame:
    found = rows.select("to_month", "from_month", key.alias("entity_key"), basic.alias("cnpj_basic"), cnpj.alias("cnpj"), F.explode(F.array_compact(F.array(*events))).alias("e"))
    return found.select("from_month", "to_month", "e.event_type", F.lit(entity_type).alias("entity_type"), "e.dimension", "entity_key", "cnpj_basic", "cnpj", "e.previous_value", "e.new_value", "e.effective_date")


def opened() -> Column:
    """Only in the later month, having started after the earlier one and up to the later one."""
    start = F.col("c.activity_start_date")
    return F.coalesce((start > F.col("from_month")) & (start <= F.col("to_month")), F.lit(False))


def establishment_events(rows: DataFrame) -> DataFrame:
    """From changed() establishments: opening, closing, status, region, address and activity; the most specific event of a dimension."""
    both = F.col("p").isNotNull() & F.col("c").isNotNull()
    new, nothing = F.col("p").isNull(), F.lit(None)
    status = both & differs("registration_status_code")
    shut = F.col("c.registration_status_code") == CLOSED
    was, now = F.col("p.is_in_region"), F.col("c.is_in_region")
    place = (json("p", *ADDRESS), json("c", *ADDRESS))
    state = (json("p", "registration_status_code"), json("c", "registration_status_code"))
    events = [
        _event(new & opened(), "ESTABLISHMENT_OPENED", "lifecycle", nothing, state[1], F.col("c.activity_start_date")),
        _event(status & shut, "ESTABLISHMENT_CLOSED", "registration_status", *state, F.col("c.registration_status_date")),
        _event(status & ~shut, "REGISTRATION_STATUS_CHANGED", "registration_status", *state),
        _event(both & ~was & now, "ENTERED_REGION", "location", *place),
        _event(both & was & ~now, "LEFT_REGION", "location", *place),
        _event(both & (was == now) & any_differs(ADDRESS), "ADDRESS_CHANGED", "location", *place),
        _event(both & differs("main_cnae_code"), "MAIN_CNAE_CHANGED", "main_cnae", json("p", "main_cnae_code"), json("c", "main_cnae_code")),
    ]
    return _explode(rows, "ESTABLISHMENT", F.col("cnpj"), F.substring("cnpj", 1, 8), F.col("cnpj"), events)


def company_events(rows: DataFrame) -> DataFrame:
    """From changed() companies in both months: capital, nature, size and the two tax regimes. An unknown capital reads None."""
    both = F.col("p").isNotNull() & F.col("c").isNotNull()
    amount = lambda side: F.to_json(F.struct(F.coalesce(F.col(f"{side}.share_capital").cast("string"), F.lit("None")).alias("share_capital")))
    tax = lambda x: (f"{x}_optant", f"{x}_option_date", f"{x}_exclusion_date")
    two = lambda *f: (json("p", *f), json("c", *f))
    events = [
        _event(both & differs("share_capital"), "SHARE_CAPITAL_CHANGED", "share_capital", amount("p"), amount("c")),
        _event(both & differs("legal_nature_code"), "LEGAL_NATURE_CHANGED", "legal_nature", *two("legal_nature_code")),
        _event(both & differs("company_size_code"), "COMPANY_SIZE_CHANGED", "company_size", *two("company_size_code")),
        _event(both & any_differs(tax("simples")), "SIMPLES_STATUS_CHANGED", "simples_status", *two(*tax("simples"))),
        _event(both & any_differs(tax("mei")), "MEI_STATUS_CHANGED", "mei_status", *two(*tax("mei"))),
    ]
    return _explode(rows, "COMPANY", F.col("cnpj_basic"), F.col("cnpj_basic"), F.lit(None).cast("string"), events)


def comparable(companies: DataFrame, pairs: DataFrame) -> DataFrame:
    """cnpj_basic and to_month of companies that both months have."""
    return neighbours(companies, pairs, ["cnpj_basic"]).filter("old_hash IS NOT NULL AND new_hash IS NOT NULL").select("cnpj_basic", "to_month")


def of_comparable(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (cnpj_basic, to_month) of comparable() companies. They meet by company alone, which is how both are stored, so neither is shuffled."""
    months = known.groupBy("cnpj_basic").agg(F.collect_set("to_month").alias("known_months"))  # one for each pair at most
    return rows.join(months, "cnpj_basic").filter(F.array_contains("known_months", F.col("to_month"))).drop("known_months")


PARTNER = ("partner_type", "display_name", "partner_cnpj_basic", "country_code", "qualification_code", "entry_date")


def partner_events(rows: DataFrame, known: DataFrame) -> DataFrame:
    """From changed() partners of comparable() companies: added, removed, other qualification."""
    rows = of_comparable(rows, known)
    here, there, nothing = F.col("c").isNotNull(), F.col("p").isNotNull(), F.lit(None)
    events = [
        _event(here & ~there, "PARTNER_ADDED", "partnership", nothing, json("c", *PARTNER), F.col("c.entry_date")),
        _event(there & ~here, "PARTNER_REMOVED", "partnership", json("p", *PARTNER), nothing),
        _event(here & there & differs("qualification_code"), "PARTNER_QUALIFICATION_CHANGED", "partner_qualification", json("p", "qualification_code"), json("c", "qualification_code")),
    ]
    return _explode(rows, "PARTICIPATION", participation_key(F.col("cnpj_basic"), F.col("partner_key")), F.col("cnpj_basic"), F.lit(None).cast("string"), events)


def missing_and_late(companies: DataFrame, establishments: DataFrame) -> DataFrame:
    """Issues of changed() companies and establishments: gone without closure, and seen first after their time."""
    gone = lambda rows, key, rule, kind: rows.filter("c IS NULL").select("to_month", F.lit(rule).alias("rule_code"), F.lit(kind).alias("entity_type"), F.col(key).alias("entity_key"))
    late = establishments.filter("p IS NULL").filter(~opened()).select("to_month", F.lit("LATE_FIRST_SEEN").alias("rule_code"), F.lit("ESTABLISHMENT").alias("entity_type"), F.col("cnpj").alias("entity_key"))
    return gone(companies, "cnpj_basic", "COMPANY_MISSING_IN_CURRENT", "COMPANY").unionByName(gone(establishments, "cnpj", "ESTABLISHMENT_MISSING_IN_CURRENT", "ESTABLISHMENT")).unionByName(late)


def window_events(companies: DataFrame, establishments: DataFrame, partners: DataFrame, pairs: DataFrame, together: bool = False) -> DataFrame:
    """All events of all pairs. together: see changed()."""
    return (
        company_events(changed(companies, pairs, ["cnpj_basic"], together))
        .unionByName(establishment_events(changed(establishments, pairs, ["cnpj"], together)))
        .unionByName(partner_events(changed(partners, pairs, ["cnpj_basic", "partner_key"], together), comparable(companies, pairs)))
    )


def affected_pairs(pairs: DataFrame, revised: DataFrame) -> DataFrame:
    """The pairs that a revised month (competence) takes part in, on either side."""
    hit = pairs.join(F.broadcast(revised), (F.col("competence") == F.col("from_month")) | (F.col("competence") == F.col("to_month")))  # months only
    return hit.select("from_month", "to_month").distinct()


def changed_packages(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """competence of packages whose content hash isn't the stored one; none means that nothing is to be done."""
    s, o = stored.select("competence", F.col("content_hash").alias("had")), offered.select("competence", "content_hash")
    return o.join(s, "competence", "left").filter(~F.col("had").eqNullSafe(F.col("content_hash"))).select("competence")


def active_revisions(revisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of each month (or by) the published revision with the highest number; the others stay, superseded."""
    published = F.col("status").isin("PUBLISHED", "PUBLISHED_WITH_WARNINGS")
    top = F.max(F.when(published, F.col("revision_number"))).over(W.partitionBy(*(by or ["competence"])))
    return revisions.withColumn("active", F.coalesce(published & (F.col("revision_number") == top), F.lit(False)))
