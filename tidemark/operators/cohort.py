"""From source shards to the region's cohort and its typed snapshots.

The builders give the rows of all months at once, and beside them what in the source forbids a snapshot: rule_code,
competence, entity_key of each offence (bad ids, flags, dates and amounts, repeated companies, unknown partner types and
municipalities, establishments without their company). No row is dropped for an offence; refuse() raises if there is any,
and is to be called before rows are published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import ids, keys, text
from tidemark.operators.contracts import COMPANIES, ESTABLISHMENTS, PARTNERS, conform, violations
from tidemark.operators.quality import first_of_ambiguous

#: Fixed value: the name of those whose name is nothing but a personal document number.
SUPPRESSED = "NOME SUPRIMIDO"
DATES = tuple(f"{x}_{y}_date" for x in ("simples", "mei") for y in ("option", "exclusion"))
FLAGS = ("simples_optant", "mei_optant")
#: Months that a long has bits for, in years.
SPAN = 60

# Municipality names of the source, and the catalogue's names for them, by state.
ALIASES = {
    ("sao luiz", "MA"): "sao luis",
    ("fortaleza do tabocao", "TO"): "tabocao",
    ("eldorado dos carajas", "PA"): "eldorado do carajas",
    ("santa isabel do para", "PA"): "santa izabel do para",
    ("ares", "RN"): "arez",
    ("boa saude", "RN"): "januario cicco",
    ("muquem de sao francisco", "BA"): "muquem do sao francisco",
    ("amparo de sao francisco", "SE"): "amparo do sao francisco",
    ("amparo da serra", "MG"): "amparo do serra",
    ("brasopolis", "MG"): "brazopolis",
    ("parati", "RJ"): "paraty",
    ("balneario de picarras", "SC"): "balneario picarras",
    ("santana do livramento", "RS"): "sant ana do livramento",
    ("santo antonio do leverger", "MT"): "santo antonio de leverger",
    ("couto de magalhaes", "TO"): "couto magalhaes",
    ("sao valerio da natividade", "TO"): "sao valerio",
}


def full_id(df: DataFrame) -> Column:
    return F.upper(F.concat(F.trim("cnpj_basic"), F.trim("cnpj_order"), F.trim("cnpj_digits")))


def discover(establishments: DataFrame, scope: DataFrame) -> DataFrame:
    """cnpj of every establishment that any month has in the scope (tom: a small closed set)."""
    inside = F.broadcast(scope.select(F.col("tom").alias("scope_tom")).distinct())
    return establishments.join(inside, F.trim("municipality_tom_code") == F.col("scope_tom"), "left_semi").select(full_id(establishments).alias("cnpj")).distinct()


def roots(cohort: DataFrame) -> DataFrame:
    return cohort.select(F.substring("cnpj", 1, 8).alias("root")).distinct()


def of_cohort(df: DataFrame, cohort: DataFrame, by_id: bool = False) -> DataFrame:
    """Rows whose root (or full id) is in the cohort."""
    if by_id:
        return df.withColumn("cohort_key", full_id(df)).join(cohort.select(F.col("cnpj").alias("cohort_key")), "cohort_key", "left_semi").drop("cohort_key")
    return df.withColumn("cohort_key", F.upper(F.trim("cnpj_basic"))).join(roots(cohort).select(F.col("root").alias("cohort_key")), "cohort_key", "left_semi").drop("cohort_key")


def root_of(df: DataFrame) -> DataFrame:
    """df with its company's root trimmed and in upper case."""
    return df.withColumn("cnpj_basic", F.upper(F.trim("cnpj_basic")))


def last_regime(regimes: DataFrame) -> DataFrame:
    """One tax-regime row for each company and month: of several the one that sorts last."""
    columns = [c for c in regimes.columns if c not in ("cnpj_basic", "competence", "source_file")]
    key = [c for c in ("cnpj_basic", "competence") if c in regimes.columns]
    place = F.row_number().over(W.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in columns]))
    return regimes.withColumn("place", place).filter("place = 1").select(*key, *columns)


def hashed(rows: DataFrame, contract) -> DataFrame:
    """rows of a contract's columns with their record hash, which counts values as the contract types them."""
    return conform(rows.withColumn("record_hash", keys.record_hash(conform(rows.withColumn("record_hash", F.lit("")), contract))), contract)


def shown_name(c: Column) -> Column:
    return F.coalesce(F.nullif(text.without_documents(text.text(c)), F.lit("")), F.lit(SUPPRESSED))


def with_regime(raw: DataFrame, regimes: DataFrame) -> DataFrame:
    """Raw companies with their tax regime of the month, null without one; roots are compared trimmed and in upper case."""
    return root_of(raw).join(last_regime(root_of(regimes)), ["cnpj_basic", "competence"], "left")


def company_snapshots(raw: DataFrame, regimes: DataFrame) -> DataFrame:
    """Contract rows of raw companies with competence; without a tax regime its six fields are null."""
    name = shown_name(F.col("legal_name"))
    fields = {
        "cnpj_basic": F.col("cnpj_basic"), "legal_name": name, "legal_name_search": text.search_text(name), "legal_nature_code": text.nullable_text(F.col("legal_nature_code")), "share_capital": text.money(F.col("share_capital")), "company_size_code": text.nullable_text(F.col("company_size_code")),
        "competence": F.col("competence"),
    } | {c: text.flag(F.col(c)) for c in FLAGS} | {c: text.source_date(F.col(c)) for c in DATES}
    return hashed(with_regime(raw, regimes).select(*[c.alias(n) for n, c in fields.items()]), COMPANIES)


def _offences(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    found = violations(df, F.struct("competence", key.alias("entity_key")), rules)
    return found.select("rule_code", "entity_key.competence", "entity_key.entity_key")


def company_offences(raw: DataFrame, regimes: DataFrame) -> DataFrame:
    """rule_code, competence and entity_key of what forbids company snapshots."""
    key = F.coalesce("cnpj_basic", F.lit(""))
    rules = {"BAD_COMPANY_ROOT": ~ids.valid_root(F.col("cnpj_basic")), "BAD_DECIMAL:share_capital": text.bad_money(F.col("share_capital"))}
    rules |= {f"BAD_FLAG:{c}": text.bad_flag(F.col(c)) for c in FLAGS} | {f"BAD_DATE:{c}": text.bad_date(F.col(c)) for c in DATES}
    twice = root_of(raw).groupBy("competence", "cnpj_basic").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        _offences(with_regime(raw, regimes), key, rules)
        .unionByName(twice.select(F.lit("REPEATED_COMPANY").alias("rule_code"), "competence", key.alias("entity_key")))
        .unionByName(_offences(regimes, key, {"BAD_REGIME_ROOT": ~ids.valid_root(F.col("cnpj_basic"))}))
    )


def resolve_municipalities(rows: DataFrame, names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows (tom, uf) with ibge and city, null where name or catalogue miss; both sides are national catalogues of a few thousand rows."""
    alias = F.create_map(*[F.lit(x) for (name, uf), other in ALIASES.items() for x in (f"{name}/{uf}", other)])
    named = rows.join(F.broadcast(names.select("tom", text.search_text(F.col("name")).alias("source_name"))), "tom", "left")
    known = named.withColumn("name_search", F.coalesce(F.try_element_at(alias, F.concat_ws("/", "source_name", "uf")), F.col("source_name")))
    return known.join(F.broadcast(catalogue.select("name_search", "uf", "ibge", F.col("name").alias("city"))), ["name_search", "uf"], "left").drop("source_name", "name_search")


def orphans(establishments: DataFrame, companies: DataFrame) -> DataFrame:
    """Establishments whose company the month lacks: none is to be left."""
    return establishments.join(companies.select("cnpj_basic", "competence"), ["cnpj_basic", "competence"], "left_anti")


def _by_root(rows: DataFrame, name: str) -> DataFrame:
    """cnpj_basic, span, day and as name the months of the span (SPAN months, of the same day) that rows have, as bits, which combine before the shuffle; a month that is null is the first bit of no span."""
    month = F.year("competence") * 12 + F.month("competence") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(month % SPAN, F.lit(0)).cast("int"))
    return rows.groupBy("cnpj_basic", F.floor(month / SPAN).cast("int").alias("span"), F.dayofmonth("competence").alias("day")).agg(F.bit_or(bit).alias(name))


def alone_roots(establishments: DataFrame, companies: DataFrame) -> DataFrame:
    """cnpj_basic and competence of orphans(), each once."""
    both = _by_root(establishments, "asked").join(_by_root(companies, "held"), ["cnpj_basic", "span", "day"], "left")
    left = F.col("asked").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("long"))))
    some = F.filter(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda i: F.call_function("shiftright", left, i).bitwiseAND(F.lit(1).cast("long")) == 1)
    month = F.col("span") * SPAN + F.col("at")
    found = both.filter(left != 0).select("cnpj_basic", "span", "day", F.explode(some).alias("at"))
    return found.select("cnpj_basic", F.make_date(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), "day").alias("competence"))


def placed(raw: DataFrame, names: DataFrame, catalogue: DataFrame, scope: DataFrame) -> DataFrame:
    """Raw establishments with ibge, city and whether the scope (tom: a small closed set) has them."""
    found = resolve_municipalities(raw.withColumns({"tom": text.text(F.col("municipality_tom_code")), "uf": text.text(F.col("state_code"))}), names, catalogue)
    inside = F.broadcast(scope.select("tom", F.lit(True).alias("inside")).distinct())
    return found.join(inside, "tom", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def establishment_snapshots(raw: DataFrame, names: DataFrame, catalogue: DataFrame, scope: DataFrame) -> DataFrame:
    """Contract rows of raw establishments with competence. names: tom, name; catalogue: name_search, uf, ibge, name; scope: tom."""
    rows = placed(raw, names, catalogue, scope)
    t = lambda c: text.text(F.col(c))
    trade, full = text.without_documents(t("trade_name")), full_id(rows)
    plain = ("branch_type", "registration_status_code", "street_type", "street_name", "street_number", "address_complement", "neighborhood")
    fields = {c: t(c) for c in plain} | {
        "cnpj": full, "cnpj_basic": F.substring(full, 1, 8), "trade_name": trade, "trade_name_search": text.search_text(trade), "registration_status_date": text.source_date(F.col("registration_status_date")),
        "registration_status_reason_code": text.nullable_text(F.col("registration_status_reason_code")), "activity_start_date": text.source_date(F.col("activity_start_date")), "main_cnae_code": text.nullable_text(F.col("main_cnae_code")), "postal_code": text.postal_code(F.col("postal_code")),
        "state_code": F.col("uf"), "municipality_tom_code": F.col("tom"), "municipality_ibge_code": F.col("ibge"), "municipality_name": F.col("city"), "is_in_region": F.col("inside"), "competence": F.col("competence"),
    }
    return hashed(rows.select(*[c.alias(n) for n, c in fields.items()]), ESTABLISHMENTS)


def establishment_offences(raw: DataFrame, names: DataFrame, catalogue: DataFrame, scope: DataFrame, companies: DataFrame) -> DataFrame:
    """rule_code, competence and entity_key of what forbids establishment snapshots. companies: raw, for all months."""
    rules = {"BAD_ESTABLISHMENT_ID": ~ids.valid_full(full_id(raw)), "UNKNOWN_MUNICIPALITY": F.col("ibge").isNull()} | {f"BAD_DATE:{c}": text.bad_date(F.col(c)) for c in ("registration_status_date", "activity_start_date")}
    alone = alone_roots(root_of(raw), root_of(companies))
    found = _offences(placed(raw, names, catalogue, scope), F.coalesce(full_id(raw), F.lit("")), rules)
    return found.unionByName(alone.select(F.lit("COMPANY_MISSING").alias("rule_code"), "competence", F.col("cnpj_basic").alias("entity_key")))


def partner_snapshots(raw: DataFrame, secret: bytes) -> tuple[DataFrame, DataFrame]:
    """Contract rows of raw partners with competence, one for each company and key; and the warnings: competence, rule_code, entity_key.

    Of rows with one key the first by root, source type, name and source id, as the source gives them, stays."""
    # shuffled once, narrow: order, names and ambiguities of a company's rows are then found in place
    raw = raw.withColumn("own_root", F.upper(F.trim("cnpj_basic"))).repartition("own_root")
    kind = text.partner_type(F.col("partner_type_code"))
    name = shown_name(F.col("display_name"))
    basic = F.col("own_root")
    country = text.nullable_text(F.col("country_code"))
    found = keys.partner_identity(basic, kind, name, F.col("source_id"), country, secret)
    order = F.struct(*[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")).alias(c) for c in ("cnpj_basic", "partner_type_code", "display_name", "source_id")])
    fields = {"cnpj_basic": basic, "partner_key": found["partner_key"], "partner_type": kind, "display_name": name, "partner_cnpj_basic": found["partner_cnpj_basic"], "country_code": country, "qualification_code": text.nullable_text(F.col("qualification_code")), "entry_date": text.source_date(F.col("entry_date")), "competence": F.col("competence")}
    rows = raw.select(*[c.alias(n) for n, c in fields.items()], found["warning"].alias("warning"), order.alias("source_order"))
    rows = rows.withColumn("record_hash", keys.record_hash(rows, ("competence", "record_hash", "warning", "source_order")))
    first, ambiguous = first_of_ambiguous(rows, [F.col("source_order"), F.col("record_hash")])
    part = F.split("warning", ":", 2)
    named = rows.filter("warning IS NOT NULL").select("competence", part[0].alias("rule_code"), part[1].alias("entity_key")).distinct()
    return conform(first, PARTNERS), named.unionByName(ambiguous.select("competence", "rule_code", "entity_key"))


def partner_offences(raw: DataFrame) -> DataFrame:
    """rule_code, competence and entity_key of what forbids partner snapshots."""
    rules = {"BAD_COMPANY_ROOT": ~ids.valid_root(F.col("cnpj_basic")), "UNKNOWN_PARTNER_TYPE": text.partner_type(F.col("partner_type_code")).isNull(), "BAD_DATE:entry_date": text.bad_date(F.col("entry_date"))}
    return _offences(raw, F.concat_ws("/", "cnpj_basic", F.coalesce("partner_type_code", F.lit(""))), rules)


def refuse(offences: DataFrame, examples: int = 5) -> None:
    """Raise if there is any offence, with the number and a few examples of each rule."""
    counted = offences.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("competence", "entity_key")).alias("first"), F.max(F.struct("competence", "entity_key")).alias("last")).orderBy("rule_code").collect()
    if counted:
        raise ValueError("; ".join(f"{r.rule_code}: {r.n}, such as {r['first'].entity_key} of {r['first'].competence} and {r['last'].entity_key} of {r['last'].competence}" for r in counted[:examples]))
