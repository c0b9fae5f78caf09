"""Queries on normalisation, cohort, contracts and keys."""

import re
import unicodedata

from pyspark.sql import functions as F

from tidemark.functions import ids, keys, show, text
from tidemark.operators import cohort, contracts, geo, pages, quality, spans
from tidemark.plans import adapter as A
from tidemark.plans import store as S
from tidemark.plans.changes import _ISSUES, events_sql
from tidemark.plans.registry import query
from tidemark.sources import sinks

T = "DATE '1999-01-01'"


@query("normalize_search_text", "SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS search FROM documents")
def normalize_search_text(spark, d):
    return A.table(spark, d, "documents").select("doc_id", text.search_text(F.col("text")).alias("search"))


def _forms(c: str) -> tuple[str, str]:
    """What Unicode says that search and address text make of c within a word."""
    plain = lambda x: "".join(y for y in unicodedata.normalize("NFKD", x) if not unicodedata.combining(y))
    searched = "".join(y.lower() if y.isalnum() else " " for y in plain(f"n{c}1"))
    return " ".join(searched.split()), " ".join(re.sub("[^A-Z0-9]+", " ", plain(f"N{c}1".upper())).split())


_PAGE = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(map(_forms, text.CODE_PAGE)))


@query("normalize_code_page", f"SELECT c_custkey, searched || ' ' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS searched, addressed || ' ' || trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')) AS addressed FROM customer JOIN (VALUES {_PAGE}) p(i, searched, addressed) ON c_custkey % {len(text.CODE_PAGE)} = i")
def normalize_code_page(spark, d):
    """Names behind a word with each of the source code page's characters."""
    c = F.element_at(F.array(*map(F.lit, text.CODE_PAGE)), (F.col("c_custkey") % len(text.CODE_PAGE) + 1).cast("int"))
    name = F.concat(F.lit("N"), c, F.lit("1 "), "c_name")
    return A.table(spark, d, "customer").select("c_custkey", text.search_text(name).alias("searched"), text.address_text(name).alias("addressed"))


_DOCS = "c_name || CASE c_custkey % 4 WHEN 0 THEN ' 123.456.789-09' WHEN 1 THEN ' ***456789**' WHEN 2 THEN ' 12345678909  LTDA ./-' ELSE ' ME' END"


def named(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", F.expr(_DOCS).alias("name"))


_CLEAN = f"trim(regexp_replace(regexp_replace(regexp_replace({_DOCS}, '\\*{{3}}[0-9]{{6}}\\*{{2}}', '', 'g'), '(^|[^0-9])[0-9]{{3}}\\.?[0-9]{{3}}\\.?[0-9]{{3}}-?[0-9]{{2}}($|[^0-9])', '\\1\\2', 'g'), '\\s{{2,}}', ' ', 'g'), ' ./-')"


@query("strip_personal_documents", f"SELECT c_custkey, {_CLEAN} AS name FROM customer")
def strip_personal_documents(spark, d):
    return named(spark, d).select("c_custkey", text.without_documents(F.col("name")).alias("name"))


@query("privacy_audit", "SELECT 'names' AS table_name, 'name' AS column_name, count(*) FILTER (WHERE c_custkey % 4 < 3) AS hits FROM customer UNION ALL SELECT 'conversations', c, n FROM (SELECT unnest(['role', 'text']) AS c, 0 AS n) WHERE (SELECT count(*) FROM conversations) >= 0")
def privacy_audit(spark, d):
    talks = A.table(spark, d, "conversations").select("role", F.regexp_replace("text", "[0-9]", "#").alias("text"))
    return quality.privacy_audit({"names": named(spark, d), "conversations": talks})


_ROOT = "lpad(CAST(o_custkey AS VARCHAR), 8, '0') || '0001'"


def _check(base: str, weights: tuple[int, ...]) -> str:
    total = " + ".join(f"(ascii({base}[{i + 1}:{i + 1}]) - 48) * {w}" for i, w in enumerate(weights))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


_ONE = f"SELECT o_orderkey, {_ROOT} AS base FROM orders"
_TWO = f"SELECT o_orderkey, base, base || {_check('base', ids.FIRST)} AS more FROM ({_ONE})"
_IDS = f"SELECT o_orderkey, more || CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE CAST({_check('more', ids.SECOND)} AS VARCHAR) END AS id FROM ({_TWO})"
_TRUE = f"SELECT o_orderkey, id, right(id, 1) = CAST({_check('id[1:13]', ids.SECOND)} AS VARCHAR) AS good FROM ({_IDS})"


def made_ids(spark, d):
    """Ids with right check digits, of which a third has the last one replaced by 0."""
    o = A.table(spark, d, "orders").select("o_orderkey", F.concat(A.root(F.col("o_custkey")), F.lit("0001")).alias("base"))
    more = o.withColumn("more", F.concat("base", ids._digit(F.col("base"), ids.FIRST).cast("string")))
    return more.select("o_orderkey", F.concat("more", F.when(F.col("o_orderkey") % 3 == 0, "0").otherwise(ids._digit(F.col("more"), ids.SECOND).cast("string"))).alias("id"))


@query("validate_cnpj", f"SELECT o_orderkey, id, good AS valid, CASE WHEN good THEN id[1:8] END AS root FROM ({_TRUE})")
def validate_cnpj(spark, d):
    return made_ids(spark, d).select("o_orderkey", "id", ids.valid_full(F.col("id")).alias("valid"), ids.root(F.col("id")).alias("root"))


@query("format_cnpj", f"SELECT o_orderkey, id[1:2] || '.' || id[3:5] || '.' || id[6:8] || '/' || id[9:12] || '-' || id[13:14] AS full_id, id[1:2] || '.' || id[3:5] || '.' || id[6:8] AS root FROM ({_IDS})")
def format_cnpj(spark, d):
    return made_ids(spark, d).select("o_orderkey", ids.formatted(F.col("id")).alias("full_id"), ids.formatted_root(F.substring("id", 1, 8)).alias("root"))


@query("invalid_cohort_ids", f"SELECT count(*) AS invalid, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT DISTINCT id FROM ({_TRUE}) WHERE NOT good ORDER BY id LIMIT 5)) AS examples FROM (SELECT DISTINCT id FROM ({_TRUE}) WHERE NOT good)")
def invalid_cohort_ids(spark, d):
    return quality.invalid_ids(made_ids(spark, d), "id")


@query("partner_identity", A.sql("SELECT cnpj_basic, display_name, competence, partner_key, partner_cnpj_basic FROM partner"))
def partner_identity(spark, d):
    return S.partners(spark, d).select("cnpj_basic", "display_name", "competence", "partner_key", "partner_cnpj_basic")


@query("record_hash", A.sql("SELECT cnpj_basic, competence, record_hash FROM company"))
def record_hash(spark, d):
    rows = S.companies(spark, d)
    return rows.select("cnpj_basic", "competence", keys.record_hash(rows).alias("record_hash"))


@query("parse_source_fields", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag, o_orderkey % 5 = 1 AS bad_day FROM orders""")
def parse_source_fields(spark, d):
    o = A.table(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 5 == 0, "00000000").when(F.col("o_orderkey") % 5 == 1, "19981399").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    raw = o.select("o_orderkey", day.alias("day"), F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("amount"), F.when(F.col("o_orderstatus") == "F", " s ").when(F.col("o_orderstatus") == "O", "N").otherwise("").alias("flag"))
    return raw.select("o_orderkey", text.source_date(F.col("day")).alias("day"), text.money(F.col("amount")).alias("amount"), text.flag(F.col("flag")).alias("flag"), text.bad_date(F.col("day")).alias("bad_day"))


def raw_spans(spark, d):
    """Raw establishments of one content each, with their months."""
    e = S.stored_spans(spark, d, "establishments")
    return e.select("cnpj_basic", F.substring("cnpj", 9, 4).alias("cnpj_order"), F.substring("cnpj", 13, 2).alias("cnpj_digits"), F.concat(F.lit(" "), "municipality_tom_code").alias("municipality_tom_code"), spans.MONTHS)


def raw_places(spark, d):
    return spans.by_month(raw_spans(spark, d))


def region(spark, d):
    return A.nations(spark, d).filter("inside").select("tom", "ibge")


def found(spark, d):
    return cohort.discover(raw_places(spark, d), region(spark, d))


@query("cohort_discovery", A.sql("SELECT DISTINCT cnpj FROM est WHERE is_in_region"))
def cohort_discovery(spark, d):
    return found(spark, d)


@query("cohort_companies", A.sql("SELECT DISTINCT cnpj[1:8] AS root FROM est WHERE is_in_region"))
def cohort_companies(spark, d):
    return cohort.roots(found(spark, d))


_COHORT = "coh AS (SELECT DISTINCT cnpj FROM est WHERE is_in_region AND competence < DATE '1998-04-01')"


@query("cohort_semi_join", A.sql("SELECT 'companies' AS table_name, competence, count(*) AS n FROM company WHERE cnpj_basic IN (SELECT cnpj[1:8] FROM coh) GROUP BY 2 UNION ALL SELECT 'establishments', competence, count(*) FROM est WHERE cnpj IN (SELECT cnpj FROM coh) GROUP BY 2", _COHORT))
def cohort_semi_join(spark, d):
    """Rows meet the cohort once for each content; months multiply them afterwards."""
    rows = raw_spans(spark, d)
    early = spans.kept(rows, F.filter(spans.MONTHS, lambda m: m < F.lit("1998-04-01").cast("date")))
    known = cohort.discover(early, region(spark, d))
    one = lambda name, df: spans.by_month(df).groupBy("competence").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "competence", "n")
    return one("companies", cohort.of_cohort(S.stored_spans(spark, d, "companies"), known)).unionByName(one("establishments", cohort.of_cohort(rows, known, by_id=True)))


@query("company_tax_join", A.sql("SELECT c.cnpj_basic, c.competence, r.optant AS simples_optant, r.d AS simples_option_date FROM company c LEFT JOIN (SELECT cnpj_basic, competence, max(simples_optant) AS optant, max(coalesce(simples_option_date, simples_exclusion_date)) AS d FROM company WHERE cnpj_basic[8:8] <> '3' GROUP BY ALL) r ON r.cnpj_basic = c.cnpj_basic AND r.competence = c.competence"))
def company_tax_join(spark, d):
    c = S.companies(spark, d)
    some = c.filter("substring(cnpj_basic, 8, 1) <> '3'").select("cnpj_basic", "competence", "simples_optant", F.coalesce("simples_option_date", "simples_exclusion_date").alias("simples_option_date"))
    twice = some.unionByName(some.withColumn("simples_option_date", F.lit(None).cast("date")))  # of repeated rows the one that sorts last is taken
    return c.select("cnpj_basic", "competence").join(cohort.last_regime(twice), ["cnpj_basic", "competence"], "left")


@query("orphan_establishments", A.sql("SELECT cnpj, competence FROM est WHERE cnpj_basic[8:8] = '5' OR NOT EXISTS (SELECT 1 FROM company c WHERE c.cnpj_basic = est.cnpj_basic AND c.competence = est.competence)"))
def orphan_establishments(spark, d):
    fewer = S.companies(spark, d).filter("substring(cnpj_basic, 8, 1) <> '5'")
    return cohort.orphans(S.establishments(spark, d), fewer).select("cnpj", "competence")


@query("municipality_resolution", A.sql("SELECT DISTINCT municipality_tom_code AS tom, state_code AS uf, municipality_ibge_code AS ibge, municipality_name AS city FROM est"))
def municipality_resolution(spark, d):
    n = A.nations(spark, d)
    names = n.select("tom", F.col("city").alias("name"))
    catalogue = n.select(text.search_text(F.col("city")).alias("name_search"), "uf", "ibge", F.col("city").alias("name"))
    rows = S.establishments(spark, d).select(F.col("municipality_tom_code").alias("tom"), F.col("state_code").alias("uf")).distinct()
    return cohort.resolve_municipalities(rows, names, catalogue).select("tom", "uf", "ibge", "city")


@query("scope_membership", A.sql("SELECT competence, inside AS in_scope, count(*) AS n, count(*) FILTER (WHERE is_in_region <> inside) AS wrong FROM est JOIN nat ON municipality_ibge_code = ibge GROUP BY 1, 2"))
def scope_membership(spark, d):
    inside = F.broadcast(region(spark, d).select(F.col("ibge").alias("municipality_ibge_code"), F.lit(True).alias("in_scope")))  # a closed set
    rows = S.establishments(spark, d).join(inside, "municipality_ibge_code", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    return rows.groupBy("competence", "in_scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_in_region") != F.col("in_scope")).alias("wrong"))


@query("stored_manifest", events_sql("""SELECT 'companies' AS table_name, competence, count(*) AS rows FROM company GROUP BY 2 UNION ALL SELECT 'establishments', competence, count(*) FROM est GROUP BY 2 UNION ALL SELECT 'partners', competence, count(*) FROM partner GROUP BY 2
UNION ALL SELECT 'events', to_month, count(*) FROM events_ GROUP BY 2 UNION ALL SELECT 'issues', to_month, count(*) FROM issues GROUP BY 2 UNION ALL SELECT 'observations', competence, count(*) FROM est WHERE is_in_region AND registration_status_code = '02' GROUP BY 2""", _ISSUES))
def stored_manifest(spark, d):
    """What the commit record says of the published months."""
    return S.manifest(spark, d).filter("table_name IN ('companies', 'establishments', 'partners', 'events', 'issues', 'observations')")


@query("contract_checks", A.sql("SELECT 'companies' AS table_name, count(*) AS rows, 0::BIGINT AS required_nulls, (SELECT count(*) FROM (SELECT 1 FROM company GROUP BY cnpj_basic, competence HAVING count(*) > 1)) AS repeated_identities, count(*) FILTER (WHERE competence <> DATE '1998-02-01') AS other_months FROM company UNION ALL SELECT 'establishments', count(*), count(*) FILTER (WHERE cnpj IS NULL), (SELECT count(*) FROM (SELECT 1 FROM est GROUP BY cnpj, competence HAVING count(*) > 1)), count(*) FILTER (WHERE competence <> DATE '1998-02-01') FROM est"))
def contract_checks(spark, d):
    month = F.lit("1998-02-01").cast("date")
    return contracts.contract_report(S.companies(spark, d), contracts.COMPANIES, month).unionByName(contracts.contract_report(S.establishments(spark, d), contracts.ESTABLISHMENTS, month))


@query("business_rows", A.sql("SELECT 'BAD_RECORD_HASH' AS rule_code, cnpj_basic AS entity_key, count(*) AS n FROM company WHERE cnpj_basic[8:8] = '1' GROUP BY 2 UNION ALL SELECT 'REGION_FLAG', cnpj, count(*) FROM est WHERE municipality_name = 'NATION_0' GROUP BY 2"))
def business_rows(spark, d):
    """Rows altered on purpose: other hashes, and a scope without one of its municipalities."""
    c = S.companies(spark, d).withColumn("record_hash", F.when(F.substring("cnpj_basic", 8, 1) == "1", F.sha2("cnpj_basic", 256)).otherwise(F.col("record_hash")))
    broken = quality.business_rows(c, S.establishments(spark, d), S.partners(spark, d), A.nations(spark, d).filter("inside AND city <> 'NATION_0'").select("ibge", "tom"))
    return broken.groupBy("rule_code", "entity_key").agg(F.count(F.lit(1)).alias("n"))


@query("domain_checks", events_sql("SELECT 'BAD_CNAE' AS rule_code, count(*) FILTER (WHERE main_cnae_code[7:7] = '7') AS n FROM est UNION ALL SELECT 'NO_VALUE', count(*) FROM events_ WHERE previous_value IS NULL AND event_type = 'PARTNER_ADDED'"))
def domain_checks(spark, d):
    """Activities ending in 7 and the values of added partners are spoilt on purpose."""
    e = S.establishments(spark, d).withColumn("main_cnae_code", F.regexp_replace("main_cnae_code", "7$", "x"))
    v = S.events(spark, d).withColumn("new_value", F.when(F.col("event_type") != "PARTNER_ADDED", F.col("new_value")))
    broken = contracts.violations(e, F.col("cnpj"), quality.domain_rules("establishment")).unionByName(contracts.violations(v, F.col("entity_key"), quality.domain_rules("event")))
    return broken.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))


@query("ambiguous_partners", A.sql("SELECT competence, 'AMBIGUOUS_PARTNER' AS rule_code, cnpj_basic || '/' || partner_key AS entity_key, 2::BIGINT AS kinds FROM partner WHERE qualification_code = 'R'"))
def ambiguous_partners(spark, d):
    p = S.partners(spark, d)
    other = F.when(F.col("qualification_code") == "R", F.sha2("record_hash", 256))
    return quality.first_of_ambiguous(p.withColumn("record_hash", F.explode(F.array_compact(F.array("record_hash", other)))))[1]


@query("zero_dates", "SELECT 'day' AS column_name, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS zero_dates FROM orders UNION ALL SELECT 'other', count(*) FILTER (WHERE o_orderkey % 9 = 0) FROM orders")
def zero_dates(spark, d):
    z = lambda n: F.when(F.col("o_orderkey") % n == 0, " 0 ").otherwise("19980101")
    return quality.zero_dates(A.table(spark, d, "orders").select(z(7).alias("day"), z(9).alias("other")), ["day", "other"])


@query("warning_parse", "SELECT event_id, 'RULE_' || upper(event_type) AS rule_code, CASE event_type WHEN 'click' THEN 'PACKAGE' ELSE CASE user_id % 3 WHEN 0 THEN 'partners' WHEN 1 THEN 'establishments' ELSE 'companies' END END AS entity_key, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE user_id END AS affected_rows, CASE WHEN event_type = 'click' THEN 'COMPANY' WHEN user_id % 3 = 0 THEN 'PARTICIPATION' WHEN user_id % 3 = 1 THEN 'ESTABLISHMENT' ELSE 'COMPANY' END AS entity_type FROM events")
def warning_parse(spark, d):
    e = A.table(spark, d, "events")
    rule = F.concat(F.lit("RULE_"), F.upper("event_type"))
    kind = F.element_at(F.array(F.lit("partners"), F.lit("establishments"), F.lit("companies")), (F.col("user_id") % 3 + 1).cast("int"))
    line = F.when(F.col("event_type") == "click", rule).when(F.col("event_type") == "view", F.concat_ws(":", rule, kind)).otherwise(F.concat_ws(":", rule, kind, F.col("user_id")))
    return e.select("event_id", *[c.alias(n) for n, c in show.warning_parts(line).items()])


@query("address_normalise", A.sql("SELECT DISTINCT street_name, street_number, upper(strip_accents(street_name)) AS street, CASE WHEN street_number = '0' THEN '0' ELSE ltrim(street_number, '0') END AS number, postal_code AS postal FROM est"))
def address_normalise(spark, d):
    rows = S.establishments(spark, d).select("street_name", "street_number", "postal_code").distinct()
    return rows.select("street_name", "street_number", text.address_text(F.concat(F.lit(" "), "street_name", F.lit("."))).alias("street"), text.address_number(F.concat(F.lit("000"), "street_number")).alias("number"), text.address_postal_code(F.concat(F.substring("postal_code", 1, 5), F.lit("-"), F.substring("postal_code", 6, 3))).alias("postal")).distinct()


@query("tax_profile", A.sql("SELECT tax, count(*) AS n FROM (SELECT CASE WHEN mei_optant THEN 'MEI' WHEN simples_optant THEN 'SIMPLES' ELSE 'REGULAR' END AS tax FROM company) GROUP BY 1"))
def tax_profile(spark, d):
    return S.companies(spark, d).select(show.tax_profile(F.col("simples_optant"), F.col("mei_optant")).alias("tax")).groupBy("tax").agg(F.count(F.lit(1)).alias("n"))


@query("ratios", "SELECT l_orderkey, n, q, CAST((n * 20000 + q) // nullif(2 * q, 0) / 100 AS DECIMAL(18,2)) AS ratio FROM (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1)")
def ratios(spark, d):
    rows = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return rows.withColumn("ratio", show.share(F.col("n"), F.col("q")))


@query("cnae_label", "SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 7, '0')[1:4] || '-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0')[5:5] || '/' || lpad(CAST(p_partkey AS VARCHAR), 7, '0')[6:7] || ' — ' || p_name AS label FROM part")
def cnae_label(spark, d):
    return A.table(spark, d, "part").select("p_partkey", show.cnae_label(F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.col("p_name")).alias("label"))


@query("currency", "SELECT o_orderkey, 'R$ ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS amount FROM orders")
def currency(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", show.currency(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))


_STATUS = "CASE registration_status_code WHEN '02' THEN 'Ativa (02)' WHEN '03' THEN 'Suspensa (03)' ELSE 'Baixada (08)' END"


@query("code_labels", A.sql(f"SELECT {_STATUS} AS status, CASE branch_type WHEN '1' THEN 'Matriz' ELSE 'Filial' END AS branch, count(*) AS n FROM est GROUP BY 1, 2"))
def code_labels(spark, d):
    rows = S.establishments(spark, d).select(show.status_label(F.col("registration_status_code")).alias("status"), show.label(F.col("branch_type"), show.BRANCHES, F.col("branch_type")).alias("branch"))
    return rows.groupBy("status", "branch").agg(F.count(F.lit(1)).alias("n"))


@query("opening_range", A.sql("SELECT competence, CAST(competence - INTERVAL 2 MONTH AS DATE) AS first_day, last_day(competence) AS last_day, count(*) AS n FROM est GROUP BY 1"))
def opening_range(spark, d):
    first, last = show.opening_range(F.col("competence"), 3)
    return S.establishments(spark, d).groupBy("competence").agg(F.count(F.lit(1)).alias("n")).select("competence", first.alias("first_day"), last.alias("last_day"), "n")


@query("month_spine", A.sql("SELECT competence, count(od) AS orders FROM months LEFT JOIN (SELECT CAST(date_trunc('month', od) AS DATE) AS competence, od FROM o) USING (competence) GROUP BY 1"))
def month_spine(spark, d):
    some = A.orders(spark, d).select(F.trunc("od", "month").alias("competence"), "od")
    return A.months(spark).join(some, "competence", "left").groupBy("competence").agg(F.count("od").alias("orders"))


@query("scope_hash", "SELECT sha256(string_agg(lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || ';' || n_name, chr(10) ORDER BY lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || ';' || n_name)) AS scope_hash FROM nation")
def scope_hash(spark, d):
    return keys.scope_hash(A.table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("tom"), "n_name"), "tom", "n_name")


def _sums(digest: str) -> str:
    words = " || ':' || ".join(f"coalesce(sum(('0x' || {digest}[{1 + 16 * i}:{16 + 16 * i}])::UBIGINT), 0)::VARCHAR" for i in range(4))
    return f"sha256(count(*)::VARCHAR || ':' || {words})"


@query("cohort_hash", A.sql(f"SELECT count(*) AS n, {_sums('digest')} AS set_hash FROM (SELECT sha256(cnpj) AS digest FROM (SELECT DISTINCT cnpj FROM est WHERE is_in_region))"))
def cohort_hash(spark, d):
    return keys.set_hash(found(spark, d), F.col("cnpj"))


@query("package_manifest", A.sql(f"SELECT competence, 'companies' AS table_name, count(*) AS rows, {_sums('record_hash')} AS content_hash FROM company GROUP BY 1 UNION ALL SELECT competence, 'establishments', count(*), {_sums('record_hash')} FROM est GROUP BY 1"))
def package_manifest(spark, d):
    return sinks.manifest({"companies": S.companies(spark, d), "establishments": S.establishments(spark, d)})


@query("window_problems", A.sql("""SELECT competence, 'content_hash:companies' AS problem FROM months WHERE competence = DATE '1998-04-01' UNION ALL SELECT competence, 'row_count:establishments' FROM est WHERE competence = DATE '1998-06-01' GROUP BY 1
UNION ALL SELECT competence, 'missing_table:establishments' FROM est WHERE competence = DATE '1998-09-01' GROUP BY 1 UNION ALL SELECT DATE '1998-07-01', 'identity:cohort' UNION ALL SELECT DATE '1998-11-01', 'missing_month'"""))
def window_problems(spark, d):
    """Packages spoilt on purpose: a changed row, a lost row, a lost table, another cohort and a month without a package."""
    c, e = S.companies(spark, d), S.establishments(spark, d)
    offered = sinks.manifest({"companies": c, "establishments": e})
    first = c.agg(F.min("cnpj_basic")).first()[0]
    spoilt = c.withColumn("record_hash", F.when((F.col("competence") == F.lit("1998-04-01")) & (F.col("cnpj_basic") == F.lit(first)), F.sha2("record_hash", 256)).otherwise(F.col("record_hash")))
    one = e.filter("competence = DATE '1998-06-01'").agg(F.min("cnpj")).first()[0]
    fewer = e.filter((F.col("competence") != F.lit("1998-09-01")) & ((F.col("competence") != F.lit("1998-06-01")) | (F.col("cnpj") != F.lit(one))))
    packages = A.months(spark).filter("competence <> DATE '1998-11-01'").select("competence", F.lit("s").alias("scope"), F.when(F.col("competence") == F.lit("1998-07-01"), "other").otherwise("c").alias("cohort"))
    return sinks.window_problems(offered, sinks.manifest({"companies": spoilt, "establishments": fewer}), {"scope": "s", "cohort": "c"}, packages)


@query("dimension_upsert", A.sql(f"SELECT cnpj_basic, legal_name, share_capital FROM company WHERE competence = {T} UNION ALL SELECT cnpj_basic, legal_name, share_capital FROM company WHERE competence = DATE '1998-01-01' AND cnpj_basic NOT IN (SELECT cnpj_basic FROM company WHERE competence = {T})"))
def dimension_upsert(spark, d):
    c = S.companies(spark, d)
    at = lambda day: c.filter(F.col("competence") == F.lit(day).cast("date")).select("cnpj_basic", "legal_name", "share_capital")
    return pages.upsert(at(A.FIRST), at(A.LAST), ["cnpj_basic"])


@query("dimension_conflicts", A.sql(f"SELECT a.cnpj_basic, a.company_size_code, b.company_size_code AS new_company_size_code FROM company a JOIN company b ON a.cnpj_basic = b.cnpj_basic AND a.competence = DATE '1998-01-01' AND b.competence = {T} WHERE a.company_size_code IS DISTINCT FROM b.company_size_code"))
def dimension_conflicts(spark, d):
    c = S.companies(spark, d)
    at = lambda day: c.filter(F.col("competence") == F.lit(day).cast("date")).select("cnpj_basic", "company_size_code")
    return pages.conflicts(at(A.FIRST), at(A.LAST), ["cnpj_basic"], ["company_size_code"])


@query("catalog_replace", "SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code, p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' old' END AS description FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def catalog_replace(spark, d):
    rows = A.table(spark, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("code"), "p_name")
    stored = rows.filter("p_partkey % 2 = 0").select("code", F.concat("p_name", F.lit(" old")).alias("description"))
    offered = rows.filter("p_partkey % 3 = 0").select("code", F.col("p_name").alias("description"))
    return pages.upsert(stored, offered, ["code"])


@query("set_equality", "SELECT 'missing' AS side, c_custkey AS key FROM customer WHERE c_custkey % 10 = 3 UNION ALL SELECT 'unexpected', -c_custkey FROM customer WHERE c_custkey % 10 = 3 AND c_custkey > 0")
def set_equality(spark, d):
    all_ = A.table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    seen = all_.select(F.when((F.col("key") % 10 == 3), -F.col("key")).otherwise(F.col("key")).alias("key"))
    return pages.set_differences(all_, seen).select("side", "key")


@query("eligible_addresses", A.sql("SELECT competence, count(*) AS n FROM est WHERE is_in_region AND registration_status_code = '02' GROUP BY 1"))
def eligible_addresses(spark, d):
    return geo.eligible(S.establishments(spark, d)).groupBy("competence").agg(F.count(F.lit(1)).alias("n"))


# ---- the snapshot build, from raw shapes of the snapshots


def _sd(c: str):
    """A date as the source writes it; none is zeros."""
    return F.coalesce(F.date_format(c, "yyyyMMdd"), F.lit("00000000"))


def _last(c: str, digit: str):
    return F.substring(c, 8, 1) == digit


def raw_companies(spark, d):
    """Padded roots in lower case, amounts with commas, names with document numbers or nothing else, and regimes apart; some companies have none, some two."""
    c = S.companies(spark, d)
    root = F.concat(F.lit(" "), F.lower("cnpj_basic"), F.lit(" "))
    name = F.when(_last("cnpj_basic", "3"), "123.456.789-09").when(_last("cnpj_basic", "4"), F.concat(F.lit(" "), "legal_name", F.lit(" ***456789**"))).otherwise(F.col("legal_name"))
    raw = c.select(root.alias("cnpj_basic"), name.alias("legal_name"), F.concat("legal_nature_code", F.lit(" ")).alias("legal_nature_code"), F.replace(F.col("share_capital").cast("string"), F.lit("."), F.lit(",")).alias("share_capital"), F.when(~_last("cnpj_basic", "5"), F.col("company_size_code")).otherwise(" ").alias("company_size_code"), "competence")
    flag = lambda n: F.when(F.col(n), " s").otherwise("N")
    regimes = c.filter(~_last("cnpj_basic", "6")).select("cnpj_basic", *[x for p in ("simples", "mei") for x in (flag(f"{p}_optant").alias(f"{p}_optant"), _sd(f"{p}_option_date").alias(f"{p}_option_date"), _sd(f"{p}_exclusion_date").alias(f"{p}_exclusion_date"))], "competence")
    earlier = regimes.filter(_last("cnpj_basic", "7")).withColumn("simples_optant", F.lit(""))
    return raw, regimes.unionByName(earlier)


_NAMED = "CASE WHEN cnpj_basic[8:8] = '3' THEN 'NOME SUPRIMIDO' ELSE legal_name END"
_REGIME = ", ".join(f"CASE WHEN cnpj_basic[8:8] <> '6' THEN {c} END AS {c}" for c in ("simples_optant", "simples_option_date", "simples_exclusion_date", "mei_optant", "mei_option_date", "mei_exclusion_date"))
_BUILT = f"built AS (SELECT cnpj_basic, {_NAMED} AS legal_name, CASE WHEN cnpj_basic[8:8] = '3' THEN 'nome suprimido' ELSE legal_name_search END AS legal_name_search, legal_nature_code, share_capital, CASE WHEN cnpj_basic[8:8] <> '5' THEN company_size_code END AS company_size_code, {_REGIME}, competence FROM company)"


@query("build_companies", A.sql(f"SELECT *, sha256({A._json(A.C)}) AS record_hash FROM built r", _BUILT))
def build_companies(spark, d):
    raw, regimes = raw_companies(spark, d)
    cohort.refuse(cohort.company_offences(raw, regimes))
    return cohort.company_snapshots(raw, regimes)


@query("company_offences", A.sql("SELECT 'BAD_COMPANY_ROOT' AS rule_code, count(*) FILTER (WHERE cnpj_basic[8:8] = '1') AS n FROM company UNION ALL SELECT 'BAD_DECIMAL:share_capital', count(*) FILTER (WHERE cnpj_basic[8:8] = '2') FROM company UNION ALL SELECT 'BAD_FLAG:mei_optant', count(*) FILTER (WHERE cnpj_basic[8:8] = '3') FROM company UNION ALL SELECT 'BAD_DATE:simples_option_date', count(*) FILTER (WHERE cnpj_basic[8:8] = '4') FROM company UNION ALL SELECT 'REPEATED_COMPANY', count(*) FILTER (WHERE cnpj_basic[8:8] = '5') FROM company"))
def company_offences(spark, d):
    """Raw companies spoilt on purpose."""
    raw, regimes = raw_companies(spark, d)
    kind = F.substring(F.trim("cnpj_basic"), 8, 1)
    bad = raw.withColumns({"share_capital": F.when(kind == "2", "1,x").otherwise(F.col("share_capital")), "cnpj_basic": F.when(kind == "1", F.concat("cnpj_basic", F.lit("*"))).otherwise(F.col("cnpj_basic"))})
    spoilt = regimes.filter(kind != "7").withColumns({"mei_optant": F.when(kind == "3", "X").otherwise(F.col("mei_optant")), "simples_option_date": F.when(kind == "4", "19981399").otherwise(F.col("simples_option_date"))})
    found = cohort.company_offences(bad.unionByName(raw.filter(kind == "5")), spoilt.filter(kind != "5"))
    return found.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))


def _base(e: str) -> str:
    return f"{e}.cnpj[1:12]"


_FULL1 = "full1 AS (SELECT est.*, " + _base("est") + " || " + _check("cnpj", ids.FIRST) + " AS more FROM est)"
_FULL2 = "full2 AS (SELECT * EXCLUDE (cnpj, more, record_hash, registration_status_date, street_name, trade_name, trade_name_search), more || " + _check("more", ids.SECOND) + " AS cnpj, registration_status_date, street_name, trade_name, trade_name_search FROM full1)"


def raw_establishments(spark, d):
    """Ids in three parts with their right check digits, dates as text, blanks around texts, and nothing that the catalogues say."""
    e = S.establishments(spark, d)
    base = F.substring("cnpj", 1, 12)
    digit = lambda c, w: ids._digit(c, w).cast("string")
    e = e.withColumn("d1", digit(base, ids.FIRST)).withColumn("d2", digit(F.concat(base, "d1"), ids.SECOND))
    plain = ["branch_type", "registration_status_code", "street_type", "street_number", "address_complement", "neighborhood", "postal_code", "main_cnae_code"]
    return e.select(
        F.concat(F.lit(" "), "cnpj_basic").alias("cnpj_basic"), F.substring("cnpj", 9, 4).alias("cnpj_order"), F.concat("d1", "d2", F.lit(" ")).alias("cnpj_digits"), F.concat("trade_name", F.lit(" 12345678909")).alias("trade_name"), _sd("registration_status_date").alias("registration_status_date"), F.lit("  ").alias("registration_status_reason_code"),
        F.date_format("activity_start_date", "yyyyMMdd").alias("activity_start_date"), F.concat(F.lit(" "), "street_name", F.lit(" ")).alias("street_name"), *plain, "state_code", F.concat("municipality_tom_code", F.lit(" ")).alias("municipality_tom_code"), "competence",
    )


def catalogues(spark, d):
    n = A.nations(spark, d)
    return n.select("tom", F.col("city").alias("name")), n.select(text.search_text(F.col("city")).alias("name_search"), "uf", "ibge", F.col("city").alias("name"))


@query("build_establishments", A.sql(f"SELECT *, sha256({A._json(A.E)}) AS record_hash FROM full2 r", _FULL1, _FULL2))
def build_establishments(spark, d):
    raw, known = raw_establishments(spark, d), catalogues(spark, d)
    cohort.refuse(cohort.establishment_offences(raw, *known, region(spark, d), raw_companies(spark, d)[0]))
    return cohort.establishment_snapshots(raw, *known, region(spark, d))


@query("establishment_offences", A.sql("SELECT 'BAD_ESTABLISHMENT_ID' AS rule_code, count(*) FILTER (WHERE cnpj_basic[8:8] = '1') AS n FROM est UNION ALL SELECT 'UNKNOWN_MUNICIPALITY', count(*) FILTER (WHERE municipality_name = 'NATION_3') FROM est UNION ALL SELECT 'BAD_DATE:activity_start_date', count(*) FILTER (WHERE cnpj_basic[8:8] = '2') FROM est UNION ALL SELECT 'COMPANY_MISSING', count(DISTINCT (cnpj_basic, competence)) FROM est WHERE cnpj_basic[8:8] = '5'"))
def establishment_offences(spark, d):
    """Raw establishments spoilt on purpose, companies taken away, and a catalogue without one of its municipalities."""
    kind = F.substring(F.trim("cnpj_basic"), 8, 1)
    raw = raw_establishments(spark, d).withColumns({"cnpj_digits": F.when(kind == "1", "0x").otherwise(F.col("cnpj_digits")), "activity_start_date": F.when(kind == "2", "1998").otherwise(F.col("activity_start_date"))})
    names, known = catalogues(spark, d)
    found = cohort.establishment_offences(raw, names, known.filter("name <> 'NATION_3'"), region(spark, d), raw_companies(spark, d)[0].filter(kind != "5"))
    return found.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))


def raw_partners(spark, d):
    """Codes for types, ids of companies in full form, and of some keys a second row with another name and content, which sorts last."""
    p = A.partner_rows(spark, d)
    code = F.when(F.col("partner_type") == "PJ", "1").when(F.col("partner_type") == "PF", "2").otherwise("3")
    raw = p.select("cnpj_basic", code.alias("partner_type_code"), "display_name", "source_id", "country_code", "qualification_code", _sd("entry_date").alias("entry_date"), "competence")
    second = F.when(F.expr("source_id IS NOT NULL AND partner_type_code <> '3' AND qualification_code = 'R'"), F.struct(F.concat("display_name", F.lit(" ZZ")).alias("display_name"), F.lit("19990101").alias("entry_date")))
    both = raw.withColumn("told", F.explode(F.array_compact(F.array(F.struct("display_name", "entry_date"), second))))
    return both.withColumns({c: F.col(f"told.{c}") for c in ("display_name", "entry_date")}).drop("told")


@query("build_partners", A.sql("SELECT * FROM partner"))
def build_partners(spark, d):
    raw = raw_partners(spark, d)
    cohort.refuse(cohort.partner_offences(raw))
    return cohort.partner_snapshots(raw, A.SECRET)[0]


@query("partner_warnings", A.sql("""SELECT rule_code, count(*) AS n FROM (
SELECT competence, 'AMBIGUOUS_PARTNER' AS rule_code, cnpj_basic || '/' || partner_key AS entity_key FROM partner2 WHERE qualification_code = 'R' AND display_name IN (SELECT 'SÓCIO ' || l_suppkey FROM lineitem WHERE l_suppkey % 5 <> 4) AND partner_type <> 'FOREIGN'
UNION SELECT competence, 'PF_WITHOUT_SOURCE_IDENTIFIER', cnpj_basic FROM partner1 WHERE partner_type = 'PF' AND source_id IS NULL UNION SELECT competence, 'PJ_WITHOUT_VALID_CNPJ', cnpj_basic FROM partner1 WHERE partner_type = 'PJ' AND source_id IS NULL) GROUP BY 1"""))
def partner_warnings(spark, d):
    return cohort.partner_snapshots(raw_partners(spark, d), A.SECRET)[1].groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))


@query("partner_offences", A.sql("SELECT 'UNKNOWN_PARTNER_TYPE' AS rule_code, count(*) FILTER (WHERE partner_type = 'FOREIGN') AS n FROM partner UNION ALL SELECT 'BAD_DATE:entry_date', count(*) FILTER (WHERE partner_type = 'PF') FROM partner"))
def partner_offences(spark, d):
    """Raw partners spoilt on purpose."""
    p = raw_partners(spark, d).filter("display_name NOT LIKE '% ZZ'")
    bad = p.withColumn("entry_date", F.when(F.col("partner_type_code") == "2", "2x").otherwise(F.col("entry_date"))).withColumn("partner_type_code", F.when(F.col("partner_type_code") == "3", "9").otherwise(F.col("partner_type_code")))
    return cohort.partner_offences(bad).groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))
