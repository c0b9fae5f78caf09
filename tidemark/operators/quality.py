"""Quality rules: violations by row, issues by rule, and the gate on warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.functions import ids, text
from tidemark.functions.keys import record_hash
from tidemark.operators.contracts import violations

#: The share of rows that a rule may affect, and the number that it always may.
RATES, OTHER_RATE, ALWAYS = {"LATE_FIRST_SEEN": 0.005, "SOURCE_ZERO_DATE": 0.0025}, 0.001, 10
#: Columns of hashes, in which 11 digits mean nothing.
OPAQUE = ("record_hash", "partner_key")


def business_rows(companies: DataFrame, establishments: DataFrame, partners: DataFrame, scope: DataFrame) -> DataFrame:
    """rule_code and entity_key of rows that break a business rule. scope: ibge, tom of the region (a small closed set)."""
    sound = lambda df: ~F.col("record_hash").eqNullSafe(record_hash(df))
    inside = F.broadcast(scope.select(F.col("ibge").alias("municipality_ibge_code"), F.col("tom").alias("municipality_tom_code"), F.lit(True).alias("in_scope")).distinct())
    placed = establishments.join(inside, ["municipality_ibge_code", "municipality_tom_code"], "left")
    of_company = violations(companies, F.col("cnpj_basic"), {"BAD_COMPANY_ID": ~ids.canonical_root(F.col("cnpj_basic")), "BAD_RECORD_HASH": sound(companies)})
    of_place = violations(
        placed,
        F.col("cnpj"),
        {
            "BAD_ESTABLISHMENT_ID": ~ids.looks_like_id(F.col("cnpj")) | (F.length("cnpj") != 14),
            "OTHER_ROOT": ~F.col("cnpj").startswith(F.col("cnpj_basic")),
            "REGION_FLAG": F.col("is_in_region") != F.coalesce("in_scope", F.lit(False)),
            "BAD_RECORD_HASH": sound(establishments),
        },
    )
    of_partner = violations(
        partners,
        F.concat_ws("/", "cnpj_basic", "partner_key"),
        {
            "BAD_PARTNER_KEY": ~F.col("partner_key").rlike("^[0-9a-f]{64}$"),
            "BAD_PARTNER_TYPE": ~F.col("partner_type").isin("PF", "PJ", "FOREIGN"),
            "ROOT_OF_NO_COMPANY": F.col("partner_cnpj_basic").isNotNull() & (F.col("partner_type") != "PJ"),
            "BAD_RECORD_HASH": sound(partners),
        },
    )
    return of_company.unionByName(of_place).unionByName(of_partner)


def domain_rules(kind: str) -> dict[str, Column]:
    """Domain rules of a table, each true where a row breaks it."""
    c = F.col
    return {
        "company": {"NEGATIVE_CAPITAL": c("share_capital") < 0, "BAD_NATURE": ~c("legal_nature_code").rlike(r"^\d{1,4}$"), "EXCLUDED_BEFORE_OPTION": c("simples_exclusion_date") < c("simples_option_date")},
        "establishment": {"BAD_STATUS": ~c("registration_status_code").isin("01", "02", "03", "04", "08"), "BAD_CNAE": ~c("main_cnae_code").rlike(r"^\d{7}$"), "BAD_POSTAL_CODE": ~c("postal_code").rlike(r"^(\d{8})?$"), "BAD_BRANCH": ~c("branch_type").isin("1", "2")},
        "event": {"NOT_ONE_TARGET": F.when(c("entity_type") == "ESTABLISHMENT", c("cnpj").isNull()).otherwise(c("cnpj").isNotNull() | c("cnpj_basic").isNull()), "NO_VALUE": c("previous_value").isNull() & c("new_value").isNull()},
        "issue": {"AFFECTED_OVER_ELIGIBLE": c("affected_rows") > c("eligible_rows"), "NEGATIVE_ROWS": (c("affected_rows") < 0) | (c("eligible_rows") < 0)},
        "resolution": {"HALF_A_COORDINATE": c("latitude").isNull() != c("longitude").isNull(), "BAD_LATITUDE": F.abs("latitude") > 90, "BAD_LEVEL": ~c("level").between(1, 6)},
    }[kind]


def first_of_ambiguous(partners: DataFrame, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Partners with one row for each company and key, the first by order; and an issue for each key with different rows.

    order: the source's own order (root, type, name, source id), which snapshots no longer hold; without it by type, name and content."""
    key = ["competence", "cnpj_basic", "partner_key"]
    places = W.partitionBy(*key).orderBy(*(order or [F.col(c) for c in ("partner_cnpj_basic", "partner_type", "display_name", "record_hash")]))
    ordered = partners.withColumn("place", F.row_number().over(places))
    kinds = partners.groupBy(*key).agg(F.countDistinct("record_hash").alias("kinds")).filter("kinds > 1")
    issues = kinds.select("competence", F.lit("AMBIGUOUS_PARTNER").alias("rule_code"), F.concat_ws("/", "cnpj_basic", "partner_key").alias("entity_key"), "kinds")
    return ordered.filter("place = 1").drop("place"), issues


def gate(issues: DataFrame, sizes: DataFrame) -> DataFrame:
    """to_month, rule_code, entity_type, affected_rows, eligible_rows, row_limit and passed of each rule.

    issues: to_month, rule_code, entity_type, affected_rows. sizes: to_month, entity_type, eligible_rows (the larger of
    both months). The limit is ALWAYS or the share of eligible rows, rounded up, whichever is more."""
    rate = F.lit(OTHER_RATE)
    for rule, share in RATES.items():
        rate = F.when(F.col("rule_code") == rule, F.lit(share)).otherwise(rate)
    total = issues.groupBy("to_month", "rule_code", "entity_type").agg(F.sum("affected_rows").alias("affected_rows"))
    known = total.join(sizes, ["to_month", "entity_type"], "left").withColumn("eligible_rows", F.coalesce("eligible_rows", F.lit(0)))
    limit = F.greatest(F.lit(ALWAYS).cast("long"), F.ceil(F.col("eligible_rows") * rate))
    return known.withColumn("row_limit", limit).withColumn("passed", F.col("affected_rows") <= F.col("row_limit")).select("to_month", "rule_code", "entity_type", "affected_rows", "eligible_rows", "row_limit", "passed")


def enforce(report: DataFrame) -> None:
    """Raise if a rule of gate() failed; a report has a row for each rule and month."""
    failed = report.filter(~F.col("passed")).orderBy("to_month", "rule_code").limit(20).collect()
    if failed:
        raise ValueError("; ".join(f"{r.rule_code} {r.to_month}: {r.affected_rows} of {r.eligible_rows}, limit {r.row_limit}" for r in failed))


def eligible(tables: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """to_month, entity_type and eligible_rows (the larger of both months' rows) of tables by entity type."""
    counts = None
    for kind, df in tables.items():
        one = df.groupBy("competence").agg(F.count(F.lit(1)).alias("n")).withColumn("entity_type", F.lit(kind))
        counts = one if counts is None else counts.unionByName(one)
    sides = pairs.select("to_month", F.explode(F.array("from_month", "to_month")).alias("competence"))
    return counts.join(F.broadcast(sides), "competence").groupBy("to_month", "entity_type").agg(F.max("n").alias("eligible_rows"))


def privacy_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name and hits of every text column."""
    out = None
    for name, df in tables.items():
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        counted = df.agg(*[F.count_if(text.holds_document(F.col(c), c in OPAQUE)).alias(c) for c in columns])
        rows = counted.select(F.lit(name).alias("table_name"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("hits")) for c in columns])).alias("x")).select("table_name", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def zero_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and zero_dates: values that are a zero in the place of a date."""
    counted = df.agg(*[F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "0").alias(c) for c in columns])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("zero_dates")) for c in columns])).alias("x")).select("x.*")


def invalid_ids(df: DataFrame, column: str, examples: int = 5) -> DataFrame:
    """One row: the number of invalid full ids and the first few of them."""
    bad = df.select(F.col(column).alias("id")).distinct().select("id", ids.valid_full(F.col("id")).alias("valid")).filter("NOT valid").select("id")
    few = bad.orderBy("id").limit(examples).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples")).withColumn("one", F.lit(1))
    return bad.agg(F.count(F.lit(1)).alias("invalid")).withColumn("one", F.lit(1)).join(few, "one").drop("one")


def batch_summary(issues: DataFrame) -> DataFrame:
    """batch, severity and rule with count and affected rows."""
    return issues.groupBy("batch", "severity", "rule_code").agg(F.count(F.lit(1)).alias("issues"), F.sum("affected_rows").alias("affected_rows"))


def revision_artifacts(revisions: DataFrame, sources: DataFrame, packages: DataFrame) -> DataFrame:
    """revisions (competence, revision_number and more) with their numbers of distinct source and package artefacts (artifact)."""
    key = ["competence", "revision_number"]
    count = lambda df, name: df.groupBy(*key).agg(F.countDistinct("artifact").alias(name))
    out = revisions.join(count(sources, "source_count"), key, "left").join(count(packages, "package_count"), key, "left")
    return out.fillna(0, ["source_count", "package_count"])
