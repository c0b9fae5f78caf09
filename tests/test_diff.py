"""Which change of a snapshot gives which event, and which gives none: a window of three months, derived from the rules."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import cohort, diff, quality
from tidemark.operators.contracts import COMPANIES, ESTABLISHMENTS, PARTNERS, conform

MARCH, APRIL, MAY = date(2031, 3, 1), date(2031, 4, 1), date(2031, 5, 1)


def rows(spark, contract, items):
    columns = [n for n, _ in contract.columns if n != "record_hash"]
    schema = ", ".join(f"{n} {k.rstrip('*')}" for n, k in contract.columns if n != "record_hash")
    df = spark.createDataFrame([tuple(i.get(c) for c in columns) for i in items], schema)
    return conform(df.withColumn("record_hash", keys.record_hash(df)), contract)


def company(root, month, **more):
    return {"cnpj_basic": root, "legal_name": f"FIRM {root}", "legal_name_search": f"firm {root}", "legal_nature_code": "1234", "share_capital": Decimal("10.00"), "company_size_code": "01", "simples_optant": False, "mei_optant": True, "mei_option_date": date(2030, 6, 1), "competence": month} | more


def place(cnpj, month, **more):
    return {"cnpj": cnpj, "cnpj_basic": cnpj[:8], "branch_type": "2", "trade_name": "SHOP", "trade_name_search": "shop", "registration_status_code": "02", "activity_start_date": date(2029, 9, 9), "main_cnae_code": "0000001", "street_type": "WAY", "street_name": "NORTH", "street_number": "7", "address_complement": "", "neighborhood": "OLD TOWN", "postal_code": "12345678", "state_code": "XY", "municipality_tom_code": "0042", "municipality_ibge_code": "0000042", "municipality_name": "SOMEWHERE", "is_in_region": True, "competence": month} | more


def partner(root, key, month, kind="PF", **more):
    return {"cnpj_basic": root, "partner_key": key * 64, "partner_type": kind, "display_name": "SOMEONE", "qualification_code": "10", "competence": month} | more


@pytest.fixture(scope="module")
def pairs(spark):
    return diff.month_pairs(spark.createDataFrame([(MARCH,), (MAY,), (APRIL,)], "competence date"))


def in_each(make, key, *changes):
    """The same row in March, April and May, with what changes from each month on; None: not there."""
    out, now = [], {}
    for month, change in zip((MARCH, APRIL, MAY), changes, strict=True):
        if change is None:
            continue
        now = now | change
        out.append(make(key, month, **now))
    return out


def found(events):
    return sorted((r.event_type, r.entity_key[:14], r.to_month) for r in events.collect())


def test_establishments(spark, pairs):
    out = {"is_in_region": False, "municipality_ibge_code": "0000099"}
    items = [
        *in_each(place, "0000000A000101", {}, {"street_number": "8"}, {"street_number": "9", "main_cnae_code": "0000002"}),
        *in_each(place, "0000000B000102", {}, {"registration_status_code": "04"}, {"registration_status_code": "08", "registration_status_date": date(2031, 4, 20)}),
        *in_each(place, "0000000C000103", out, {"is_in_region": True, "municipality_ibge_code": "0000042"}, out),
        *in_each(place, "0000000D000104", None, {"activity_start_date": date(2031, 3, 2)}, {}),
        *in_each(place, "0000000E000105", {}, None, {}),  # absence is no closure, and its return no opening
        *in_each(place, "0000000F000106", {}, {"trade_name": "OTHER"}, {}),  # a change that no event tells of
        *in_each(place, "0000000G000107", {"main_cnae_code": None}, {"main_cnae_code": None}, {"main_cnae_code": "0000003"}),
        *in_each(place, "0000000H000108", {}, {}, {}),
    ]
    changed = diff.changed(rows(spark, ESTABLISHMENTS, items), pairs, ["cnpj"])
    got = diff.establishment_events(changed)
    assert found(got) == [
        ("ADDRESS_CHANGED", "0000000A000101", APRIL), ("ADDRESS_CHANGED", "0000000A000101", MAY), ("ENTERED_REGION", "0000000C000103", APRIL), ("ESTABLISHMENT_CLOSED", "0000000B000102", MAY), ("ESTABLISHMENT_OPENED", "0000000D000104", APRIL),
        ("LEFT_REGION", "0000000C000103", MAY), ("MAIN_CNAE_CHANGED", "0000000A000101", MAY), ("MAIN_CNAE_CHANGED", "0000000G000107", MAY), ("REGISTRATION_STATUS_CHANGED", "0000000B000102", APRIL),
    ]
    days = {r.event_type: r.effective_date for r in got.collect()}
    assert (days["ESTABLISHMENT_CLOSED"], days["ESTABLISHMENT_OPENED"], days["ADDRESS_CHANGED"]) == (date(2031, 4, 20), date(2031, 3, 2), None)
    none = diff.changed(rows(spark, COMPANIES, []), pairs, ["cnpj_basic"])
    issues = sorted((r.rule_code, r.entity_key, r.to_month) for r in diff.missing_and_late(none, changed).collect())
    assert issues == [("ESTABLISHMENT_MISSING_IN_CURRENT", "0000000E000105", APRIL), ("LATE_FIRST_SEEN", "0000000E000105", MAY)]


def test_companies(spark, pairs):
    items = [
        *in_each(company, "0000000A", {}, {"share_capital": Decimal("9.50")}, {"share_capital": None, "company_size_code": "03"}),
        *in_each(company, "0000000B", {}, {"legal_nature_code": None}, {"simples_optant": True, "simples_option_date": date(2031, 5, 1)}),
        *in_each(company, "0000000C", {}, {"mei_exclusion_date": date(2031, 4, 1)}, {"mei_optant": None}),
        *in_each(company, "0000000D", None, {}, {}),  # a company that appears raises nothing
        *in_each(company, "0000000E", {}, {}, None),
    ]
    changed = diff.changed(rows(spark, COMPANIES, items), pairs, ["cnpj_basic"])
    got = diff.company_events(changed)
    assert found(got) == [
        ("COMPANY_SIZE_CHANGED", "0000000A", MAY), ("LEGAL_NATURE_CHANGED", "0000000B", APRIL), ("MEI_STATUS_CHANGED", "0000000C", APRIL), ("MEI_STATUS_CHANGED", "0000000C", MAY),
        ("SHARE_CAPITAL_CHANGED", "0000000A", APRIL), ("SHARE_CAPITAL_CHANGED", "0000000A", MAY), ("SIMPLES_STATUS_CHANGED", "0000000B", MAY),
    ]
    values = {(r.event_type, r.to_month): (r.previous_value, r.new_value) for r in got.collect()}
    assert values["SHARE_CAPITAL_CHANGED", MAY] == ('{"share_capital":"9.50"}', '{"share_capital":"None"}')
    assert values["LEGAL_NATURE_CHANGED", APRIL] == ('{"legal_nature_code":"1234"}', '{"legal_nature_code":null}')
    none = diff.changed(rows(spark, ESTABLISHMENTS, []), pairs, ["cnpj"])
    assert [(r.rule_code, r.entity_key, r.to_month) for r in diff.missing_and_late(changed, none).collect()] == [("COMPANY_MISSING_IN_CURRENT", "0000000E", MAY)]


def test_partners(spark, pairs):
    """Only of companies that both months have."""
    firms = rows(spark, COMPANIES, in_each(company, "0000000A", {}, {}, {}) + in_each(company, "0000000B", None, {}, {}))
    of = lambda root, key: lambda _, month, **more: partner(root, key, month, **more)
    items = in_each(of("0000000A", "a"), "", {}, None, {"entry_date": date(2031, 4, 9)}) + in_each(of("0000000A", "b"), "", {}, {"qualification_code": "20"}, {"display_name": "SOMEONE ELSE"}) + in_each(of("0000000B", "c"), "", None, {}, None)
    changed = diff.changed(rows(spark, PARTNERS, items), pairs, ["cnpj_basic", "partner_key"])
    got = diff.partner_events(changed, diff.comparable(firms, pairs))
    assert sorted((r.event_type, r.entity_key[14:15], r.to_month, r.effective_date) for r in got.collect()) == [("PARTNER_ADDED", "a", MAY, date(2031, 4, 9)), ("PARTNER_QUALIFICATION_CHANGED", "b", APRIL, None), ("PARTNER_REMOVED", "a", APRIL, None), ("PARTNER_REMOVED", "c", MAY, None)]
    assert got.first().entity_key.startswith("('0000000")


def test_no_row_is_fetched_whole_for_the_comparison(spark, pairs, capsys):
    """The shuffle of all rows holds identity, month and hash only; other columns are read again for changed keys."""
    df = rows(spark, ESTABLISHMENTS, in_each(place, "0000000A000101", {}, {"street_number": "8"}, {}))
    diff.neighbours(df, pairs, ["cnpj"]).explain("formatted")
    dealt = [part for part in capsys.readouterr().out.split("\n\n") if "hashpartitioning(cnpj" in part]
    assert dealt and not any("street_name" in part for part in dealt)


@pytest.mark.parametrize("start,rule", [(APRIL, "LATE_FIRST_SEEN"), (date(2031, 4, 2), None), (MAY, None), (date(2031, 5, 2), "LATE_FIRST_SEEN"), (None, "LATE_FIRST_SEEN")])
def test_opening_interval(spark, pairs, start, rule):
    """After the earlier month's first day, up to the later one's."""
    changed = diff.changed(rows(spark, ESTABLISHMENTS, [place("0000000K000111", MAY, activity_start_date=start)]), pairs, ["cnpj"])
    none = diff.changed(rows(spark, COMPANIES, []), pairs, ["cnpj_basic"])
    assert [r.rule_code for r in diff.missing_and_late(none, changed).collect()] == ([rule] if rule else [])
    assert diff.establishment_events(changed).count() == (0 if rule else 1)


@pytest.mark.parametrize("rule,affected,eligible,limit,passed", [("COMPANY_MISSING_IN_CURRENT", 10, 50, 10, True), ("COMPANY_MISSING_IN_CURRENT", 11, 50, 10, False), ("LATE_FIRST_SEEN", 501, 100_001, 501, True), ("LATE_FIRST_SEEN", 502, 100_001, 501, False), ("SOURCE_ZERO_DATE", 26, 10_001, 26, True), ("ANY_OTHER", 27, 26_001, 27, True)])
def test_gate(spark, rule, affected, eligible, limit, passed):
    """The larger of 10 and the rule's share of eligible rows, rounded up."""
    issues = spark.createDataFrame([(MAY, rule, "X", affected)], "to_month date, rule_code string, entity_type string, affected_rows long")
    sizes = spark.createDataFrame([(MAY, "X", eligible)], "to_month date, entity_type string, eligible_rows long")
    report = quality.gate(issues, sizes)
    assert tuple(report.select("row_limit", "passed").first()) == (limit, passed)
    if not passed:
        with pytest.raises(ValueError, match=rule):
            quality.enforce(report)


def test_ambiguous_partners(spark):
    p = rows(spark, PARTNERS, [partner("0000000A", "a", MAY, display_name=n) for n in ("B", "A")] + [partner("0000000A", "b", MAY)] * 2)
    kept, issues = quality.first_of_ambiguous(p)
    assert sorted(r.display_name for r in kept.collect()) == ["A", "SOMEONE"]
    assert issues.count() == 1


def test_partner_builder_keeps_the_first_as_the_source_orders_them(spark):
    raw = [("0000000a", "2", "ANN", "x9", "10"), ("0000000A", "2", "ANN B", "x9", "20"), (" 0000000A", "2", "ZOE", "x9", "30"), ("0000000A", "2", "529.982.247-25", None, "10")]
    df = spark.createDataFrame([(*r, None, "00000000", MAY) for r in raw], "cnpj_basic string, partner_type_code string, display_name string, source_id string, qualification_code string, country_code string, entry_date string, competence date")
    kept, warnings = cohort.partner_snapshots(df, b"key")
    assert sorted((r.display_name, r.qualification_code) for r in kept.collect()) == [("NOME SUPRIMIDO", "10"), ("ZOE", "30")]  # a blank sorts before a digit
    assert sorted(r.rule_code for r in warnings.collect()) == ["AMBIGUOUS_PARTNER", "PF_WITHOUT_SOURCE_IDENTIFIER"]
    cohort.refuse(cohort.partner_offences(df))
    with pytest.raises(ValueError, match="UNKNOWN_PARTNER_TYPE: 1, such as"):
        cohort.refuse(cohort.partner_offences(df.limit(1).withColumn("partner_type_code", F.lit("4"))))


def test_active_revision(spark):
    r = spark.createDataFrame([(APRIL, 1, "PUBLISHED"), (APRIL, 2, "PUBLISHED_WITH_WARNINGS"), (APRIL, 3, "REJECTED"), (MAY, 1, "REJECTED")], "competence date, revision_number int, status string")
    assert [x.revision_number for x in diff.active_revisions(r).filter("active").collect()] == [2]


def test_empty_tables(spark, pairs):
    c, e, p = (rows(spark, t, []) for t in (COMPANIES, ESTABLISHMENTS, PARTNERS))
    assert diff.window_events(c, e, p, pairs).count() == 0
    some = rows(spark, COMPANIES, in_each(company, "0000000A", {}, {"share_capital": None}, {}))
    assert diff.window_events(some, e, p, pairs.filter(F.lit(False))).count() == 0
