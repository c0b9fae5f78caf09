"""Queries of the dashboard, search and lists."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import dashboard as D
from tidemark.operators import pages, quality
from tidemark.plans import adapter as A
from tidemark.plans import store as S
from tidemark.plans.changes import events_sql
from tidemark.plans.registry import query

START, END = date(1998, 1, 1), date(1999, 1, 1)
FROM, T = "DATE '1998-01-01'", "DATE '1999-01-01'"

_METRICS = """metrics AS (
SELECT competence, 'REGIONAL_ESTABLISHMENTS_TOTAL' AS metric_type, 'ESTABLISHMENT' AS entity_type, NULL::VARCHAR AS municipality, NULL::VARCHAR AS cnae_code, NULL::VARCHAR AS status_code, NULL::VARCHAR AS size_code, count(*) AS value FROM est WHERE is_in_region GROUP BY competence
UNION ALL SELECT competence, 'REGIONAL_ESTABLISHMENTS_BY_MUNICIPALITY', 'ESTABLISHMENT', municipality_ibge_code, NULL, NULL, NULL, count(*) FROM est WHERE is_in_region GROUP BY competence, municipality_ibge_code
UNION ALL SELECT competence, 'REGIONAL_ESTABLISHMENTS_BY_CNAE', 'ESTABLISHMENT', NULL, main_cnae_code, NULL, NULL, count(*) FROM est WHERE is_in_region GROUP BY competence, main_cnae_code
UNION ALL SELECT competence, 'REGIONAL_ESTABLISHMENTS_BY_STATUS', 'ESTABLISHMENT', NULL, NULL, registration_status_code, NULL, count(*) FROM est WHERE is_in_region GROUP BY competence, registration_status_code
UNION ALL SELECT competence, 'REGIONAL_COMPANIES_TOTAL', 'COMPANY', NULL, NULL, NULL, NULL, count(*) FROM company c SEMI JOIN (SELECT competence, cnpj_basic FROM est WHERE is_in_region) e USING (competence, cnpj_basic) GROUP BY competence
UNION ALL SELECT competence, 'REGIONAL_COMPANIES_BY_SIZE', 'COMPANY', NULL, NULL, NULL, company_size_code, count(*) FROM company c SEMI JOIN (SELECT competence, cnpj_basic FROM est WHERE is_in_region) e USING (competence, cnpj_basic) GROUP BY competence, company_size_code)"""


@query("regional_metrics", A.sql("SELECT * FROM metrics", _METRICS))
def regional_metrics(spark, d):
    return D.regional_metrics(S.companies(spark, d), S.establishments(spark, d))


def _quoted(c: str) -> str:
    return f"coalesce('\"' || {c} || '\"', 'null')"


@query("metric_keys", A.sql(f"SELECT *, sha256('[' || concat_ws(',', '\"' || CAST(competence AS VARCHAR) || '\"', '\"' || metric_type || '\"', {', '.join(map(_quoted, ['municipality', 'cnae_code', 'status_code', 'size_code']))}) || ']') AS metric_key FROM metrics", _METRICS))
def metric_keys(spark, d):
    key = keys.metric_key(F.col("competence").cast("string"), F.col("metric_type"), *map(F.col, ("municipality", "cnae_code", "status_code", "size_code")))
    return S.metrics(spark, d).withColumn("metric_key", key)


_ELIGIBLE = f"""reg AS (SELECT * FROM est WHERE is_in_region),
span AS (SELECT * FROM events_ WHERE to_month > {FROM} AND to_month <= {T}),
elig AS (SELECT * FROM span WHERE entity_type = 'ESTABLISHMENT' AND cnpj IN (SELECT cnpj FROM reg) UNION ALL SELECT * FROM span WHERE entity_type <> 'ESTABLISHMENT' AND cnpj_basic IN (SELECT cnpj_basic FROM reg))"""


def eligible(spark, d):
    return D.eligible_events(S.events(spark, d), D.in_region(S.establishments(spark, d)), START, END)


@query("eligible_event_counts", events_sql("SELECT event_type, count(*) AS total FROM elig GROUP BY 1", _ELIGIBLE))
def eligible_event_counts(spark, d):
    return D.counts_by_type(eligible(spark, d))


@query("status_size_distribution", A.sql(f"SELECT metric_type, coalesce(status_code, size_code) AS code, value FROM metrics WHERE competence = {T} AND metric_type IN ('REGIONAL_ESTABLISHMENTS_BY_STATUS', 'REGIONAL_COMPANIES_BY_SIZE')", _METRICS))
def status_size_distribution(spark, d):
    last = S.metrics(spark, d).filter(F.col("competence") == END)
    return last.filter(F.col("metric_type").isin("REGIONAL_ESTABLISHMENTS_BY_STATUS", "REGIONAL_COMPANIES_BY_SIZE")).select("metric_type", F.coalesce("status_code", "size_code").alias("code"), "value")


@query("trend", A.sql("SELECT competence, count(cnpj) AS total FROM months LEFT JOIN (SELECT * FROM est WHERE is_in_region AND municipality_ibge_code = '3100000') USING (competence) GROUP BY 1"))
def trend(spark, d):
    return D.trend(D.in_region(S.establishments(spark, d), "3100000"), A.months(spark))


@query("opening_closing", events_sql("SELECT competence, count(*) FILTER (WHERE event_type = 'ESTABLISHMENT_OPENED') AS openings, count(*) FILTER (WHERE event_type = 'ESTABLISHMENT_CLOSED') AS closings FROM months LEFT JOIN elig ON competence = to_month GROUP BY 1", _ELIGIBLE))
def opening_closing(spark, d):
    return D.opening_closing(eligible(spark, d), A.months(spark))


@query("cnae_growth", A.sql(f"""SELECT direction, CAST(place AS INTEGER) AS place, cnae_code, "start", "end", delta FROM (
SELECT *, CASE WHEN delta > 0 THEN 'growth' ELSE 'reduction' END AS direction, row_number() OVER (PARTITION BY delta > 0 ORDER BY abs(delta) DESC, cnae_code) AS place FROM (
SELECT main_cnae_code AS cnae_code, count(*) FILTER (WHERE competence = {FROM}) AS "start", count(*) FILTER (WHERE competence = {T}) AS "end", "end" - "start" AS delta FROM est WHERE is_in_region AND main_cnae_code IS NOT NULL GROUP BY 1) WHERE delta <> 0) WHERE place <= 5"""))
def cnae_growth(spark, d):
    return D.cnae_growth(D.in_region(S.establishments(spark, d)), START, END)


_CAP = "TRY_CAST(json_extract_string({}, '$.share_capital') AS DECIMAL(18,2))"
_CAPITAL = f"""grown AS (SELECT cnpj_basic, arg_min(a, to_month) AS previous, arg_max(b, to_month) AS current, CAST(arg_max(b, to_month) - arg_min(a, to_month) AS DECIMAL(19,2)) AS delta
FROM (SELECT *, {_CAP.format('previous_value')} AS a, {_CAP.format('new_value')} AS b FROM events_ WHERE event_type = 'SHARE_CAPITAL_CHANGED') WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING delta > 0),
names AS (SELECT cnpj_basic, legal_name FROM company WHERE competence = {T})"""


def names(spark, d):
    return S.companies(spark, d).filter(F.col("competence") == END)


@query("capital_growth", events_sql("""SELECT cnpj_basic, previous, current, delta, CAST(place AS INTEGER) AS place, 1 AS page_number, CAST(ceil(total / 8.0) AS INTEGER) AS pages, CAST(total AS INTEGER) AS total, coalesce(legal_name, 'Empresa sem nome') AS legal_name
FROM (SELECT *, row_number() OVER (ORDER BY delta DESC, cnpj_basic) AS place, count(*) OVER () AS total FROM grown) LEFT JOIN names USING (cnpj_basic) WHERE place <= 8""", _CAPITAL))
def capital_growth(spark, d):
    return D.capital_growth(S.events(spark, d), names(spark, d), 1, 8)


@query("capital_growth_headquarters", events_sql("""SELECT cnpj_basic, previous, current, delta, CAST(place AS INTEGER) AS place, 1 AS page_number, CAST(ceil(total / 8.0) AS INTEGER) AS pages, CAST(total AS INTEGER) AS total, coalesce(legal_name, 'Empresa sem nome') AS legal_name
FROM (SELECT *, row_number() OVER (ORDER BY delta DESC, cnpj_basic) AS place, count(*) OVER () AS total FROM grown WHERE cnpj_basic IN (SELECT cnpj_basic FROM est WHERE is_in_region AND branch_type = '1')) LEFT JOIN names USING (cnpj_basic) WHERE place <= 8""", _CAPITAL))
def capital_growth_headquarters(spark, d):
    """Only companies with their headquarters in the region."""
    own = D.of_headquarters(S.events(spark, d), D.in_region(S.establishments(spark, d)))
    return D.capital_growth(own, names(spark, d), 1, 8)


@query("middle_page", events_sql("""SELECT cnpj_basic, previous, current, delta, CAST(place AS INTEGER) AS place, CAST(number AS INTEGER) AS page_number, CAST(pages AS INTEGER) AS pages, CAST(total AS INTEGER) AS total, coalesce(legal_name, 'Empresa sem nome') AS legal_name
FROM (SELECT *, row_number() OVER (ORDER BY delta DESC, cnpj_basic) AS place, count(*) OVER () AS total, ceil(count(*) OVER () / 10.0) AS pages, greatest(1, ceil(count(*) OVER () / 10.0) // 2) AS number FROM grown) LEFT JOIN names USING (cnpj_basic) WHERE place BETWEEN (number - 1) * 10 + 1 AND number * 10""", _CAPITAL))
def middle_page(spark, d):
    """A page far from both ends, of rows that no task orders as a whole."""
    grown = D.grown_capital(S.events(spark, d))
    number = max(1, -(-grown.count() // 10) // 2)
    return D.named(pages.page(grown, [("delta", True), ("cnpj_basic", False)], number, 10, near=10), names(spark, d))


@query("clamped_page", events_sql("""SELECT cnpj_basic, previous, current, delta, CAST(place AS INTEGER) AS place, CAST(pages AS INTEGER) AS page_number, CAST(pages AS INTEGER) AS pages, CAST(total AS INTEGER) AS total, coalesce(legal_name, 'Empresa sem nome') AS legal_name
FROM (SELECT *, row_number() OVER (ORDER BY delta DESC, cnpj_basic) AS place, count(*) OVER () AS total, ceil(count(*) OVER () / 100.0) AS pages FROM grown) LEFT JOIN names USING (cnpj_basic) WHERE place > (pages - 1) * 100""", _CAPITAL))
def clamped_page(spark, d):
    """A page past the end is the last one."""
    return D.capital_growth(S.events(spark, d), names(spark, d), 10_000, 100)


@query("partner_growth", events_sql(f"""SELECT cnpj_basic, added, removed, delta, (SELECT count(*) FROM partner x WHERE x.cnpj_basic = g.cnpj_basic AND competence = {FROM}) AS previous, (SELECT count(*) FROM partner x WHERE x.cnpj_basic = g.cnpj_basic AND competence = {T}) AS current, coalesce(legal_name, 'Empresa sem nome') AS legal_name
FROM (SELECT cnpj_basic, count(*) FILTER (WHERE event_type = 'PARTNER_ADDED') AS added, count(*) FILTER (WHERE event_type = 'PARTNER_REMOVED') AS removed, added - removed AS delta FROM events_ GROUP BY 1 HAVING delta > 0 ORDER BY delta DESC, cnpj_basic LIMIT 8) g LEFT JOIN names USING (cnpj_basic)""", _CAPITAL))
def partner_growth(spark, d):
    return D.partner_growth(S.events(spark, d), S.partners(spark, d), names(spark, d), START, END)


_RECENT = f"""last_ AS (SELECT *, sha256(event_type || '|' || entity_key) AS seen FROM events_ WHERE to_month = {T}),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY seen DESC) AS k FROM last_) WHERE k <= 8),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cnpj_basic ORDER BY seen DESC) AS r FROM few) WHERE r = 1)"""


@query("recent_companies", events_sql("SELECT cnpj_basic, entity_type, event_type, entity_key FROM one ORDER BY seen DESC LIMIT 8", _RECENT))
def recent_companies(spark, d):
    return D.recent_companies(S.events(spark, d), END)


def now(df):
    return df.filter(F.col("competence") == END)


def by_name(spark, d, query):
    """Search of the last month, by postings where the query is a name."""
    found = D.indexed_search(query, now(S.names(spark, d)))
    return found if found is not None else D.search(query, now(S.companies(spark, d)), now(S.establishments(spark, d)))


_SEARCH = f"""found AS (SELECT cnpj_basic FROM company WHERE competence = {T} AND starts_with(legal_name_search, 'customer 00000012') UNION SELECT cnpj_basic FROM est WHERE competence = {T} AND starts_with(trade_name_search, 'customer 00000012'))"""


@query("company_search", A.sql(f"""SELECT cnpj_basic, legal_name, (SELECT count(*) FROM est e WHERE e.cnpj_basic = c.cnpj_basic AND competence = {T} AND is_in_region) AS regional_establishments FROM company c
WHERE competence = {T} AND cnpj_basic IN (SELECT cnpj_basic FROM found) ORDER BY legal_name, cnpj_basic LIMIT 50""", _SEARCH))
def company_search(spark, d):
    return by_name(spark, d, "Customer#00000012")


@query("text_filter", A.sql(f"""SELECT cnpj_basic, legal_name, (SELECT count(*) FROM est e WHERE e.cnpj_basic = c.cnpj_basic AND competence = {T} AND is_in_region) AS regional_establishments FROM company c
WHERE competence = {T} AND (contains(legal_name_search, '00042') OR cnpj_basic IN (SELECT cnpj_basic FROM est WHERE competence = {T} AND contains(trade_name_search, '00042'))) ORDER BY legal_name, cnpj_basic LIMIT 50"""))
def text_filter(spark, d):
    """No name starts so, so parts of names count."""
    return by_name(spark, d, "00042")


@query("search_union", A.sql(f"""SELECT cnpj_basic, legal_name, (SELECT count(*) FROM est e WHERE e.cnpj_basic = c.cnpj_basic AND competence = {T} AND is_in_region) AS regional_establishments FROM company c
WHERE competence = {T} AND cnpj_basic IN (SELECT cnpj_basic FROM est WHERE competence = {T} AND starts_with(trade_name_search, 'loja 12')) ORDER BY legal_name, cnpj_basic LIMIT 50"""))
def search_union(spark, d):
    return D.search("Loja 12", now(S.companies(spark, d)), now(S.establishments(spark, d)))


@query("result_counts", A.sql(f"SELECT cnpj_basic, count(*) AS regional_establishments FROM est WHERE competence = {T} AND is_in_region GROUP BY 1"))
def result_counts(spark, d):
    return D.in_region(now(S.establishments(spark, d))).groupBy("cnpj_basic").agg(F.count(F.lit(1)).alias("regional_establishments"))


@query("company_timeline", events_sql("SELECT to_month, event_type, entity_type, entity_key FROM events_ WHERE cnpj_basic = '00000012' ORDER BY to_month DESC, event_type, entity_key"))
def company_timeline(spark, d):
    return D.event_list(S.events(spark, d), identifier="00000012", limit=100_000).select("to_month", "event_type", "entity_type", "entity_key")


@query("company_state", A.sql(f"""SELECT 'company' AS section, 1 AS place, legal_name AS item FROM company WHERE competence = {T} AND cnpj_basic = '00000012'
UNION ALL SELECT 'establishment', CAST(row_number() OVER (ORDER BY is_in_region DESC, cnpj) AS INTEGER), cnpj FROM est WHERE competence = {T} AND cnpj_basic = '00000012'
UNION ALL SELECT 'partner', CAST(row_number() OVER (ORDER BY display_name, partner_key) AS INTEGER), display_name FROM partner WHERE competence = {T} AND cnpj_basic = '00000012'"""))
def company_state(spark, d):
    return D.latest_state(S.companies(spark, d), S.establishments(spark, d), S.partners(spark, d), "00000012")


@query("event_list", events_sql("SELECT to_month, event_type, entity_type, entity_key FROM events_ WHERE event_type = 'ADDRESS_CHANGED' ORDER BY to_month DESC, event_type, entity_key LIMIT 200"))
def event_list(spark, d):
    return D.event_list(S.events(spark, d), event_type="ADDRESS_CHANGED").select("to_month", "event_type", "entity_type", "entity_key")


@query("event_target", events_sql("SELECT entity_type, event_type, count(*) AS n FROM events_ WHERE cnpj_basic = '00000012' AND (entity_type <> 'ESTABLISHMENT' OR cnpj = (SELECT min(cnpj) FROM est WHERE cnpj_basic = '00000012')) GROUP BY 1, 2"))
def event_target(spark, d):
    least = S.establishments(spark, d).filter("cnpj_basic = '00000012'").agg(F.min("cnpj")).first()[0]
    return S.events(spark, d).filter(D.target(least or "0" * 14)).groupBy("entity_type", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("watchlist", events_sql(f"""SELECT w.cnpj_basic, user_id, legal_name, share_capital, coalesce(n, 0) AS recent_events FROM (SELECT DISTINCT user_id, lpad(CAST(user_id % 97 AS VARCHAR), 8, '0') AS cnpj_basic FROM events) w
LEFT JOIN (SELECT * FROM company WHERE competence = {T}) c USING (cnpj_basic) LEFT JOIN (SELECT cnpj_basic, count(*) AS n FROM events_ WHERE to_month = {T} GROUP BY 1) e USING (cnpj_basic)"""))
def watchlist(spark, d):
    watched = A.table(spark, d, "events").select("user_id", A.root(F.col("user_id") % 97).alias("cnpj_basic")).distinct()
    return D.watchlist(watched, S.companies(spark, d), S.events(spark, d), END)


@query("quality_summary", "SELECT user_id % 5 AS batch, CASE WHEN value > 50 THEN 'WARNING' ELSE 'INFO' END AS severity, event_type AS rule_code, count(*) AS issues, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS affected_rows FROM events GROUP BY ALL")
def quality_summary(spark, d):
    rows = A.table(spark, d, "events").select((F.col("user_id") % 5).alias("batch"), F.when(F.col("value") > 50, "WARNING").otherwise("INFO").alias("severity"), F.col("event_type").alias("rule_code"), F.floor("value").alias("affected_rows"))
    return quality.batch_summary(rows)


_ARTIFACTS = """r AS (SELECT competence, CAST(s AS INTEGER) AS revision_number FROM months, range(1, 3) t(s)),
made AS (SELECT competence, revision_number, CAST(event_id % 32 AS VARCHAR) AS source, CAST(event_id % 3 AS VARCHAR) AS package FROM r JOIN events ON month(competence) = user_id % 12 + 1 AND event_id % 2 = revision_number - 1)"""


@query("revision_artifacts", A.sql("SELECT r.competence, r.revision_number, count(DISTINCT source) AS source_count, count(DISTINCT package) AS package_count FROM r LEFT JOIN made USING (competence, revision_number) GROUP BY 1, 2", _ARTIFACTS))
def revision_artifacts(spark, d):
    """Events as artefacts that a month's revisions were made from."""
    revisions = A.months(spark).select("competence", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("revision_number"))
    e = A.table(spark, d, "events").select(((F.col("user_id") % 12) + 1).alias("m"), (F.col("event_id") % 2 + 1).cast("int").alias("revision_number"), "event_id")
    made = e.join(F.broadcast(A.months(spark)), F.month("competence") == F.col("m"))  # a row for each month
    of = lambda n: made.select("competence", "revision_number", (F.col("event_id") % n).cast("string").alias("artifact"))
    return quality.revision_artifacts(revisions, of(32), of(3))


@query("row_counts", A.sql("SELECT 'companies' AS table_name, competence, count(*) AS n FROM company GROUP BY 2 UNION ALL SELECT 'establishments', competence, count(*) FROM est GROUP BY 2 UNION ALL SELECT 'partners', competence, count(*) FROM partner GROUP BY 2"))
def row_counts(spark, d):
    one = lambda name, df: df.groupBy("competence").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "competence", "n")
    return A.union([one("companies", S.companies(spark, d)), one("establishments", S.establishments(spark, d)), one("partners", S.partners(spark, d))])


@query("filter_options", A.sql("SELECT 'cnae' AS option, main_cnae_code AS value FROM est WHERE main_cnae_code IS NOT NULL GROUP BY 2 UNION ALL SELECT 'size', company_size_code FROM company GROUP BY 2"))
def filter_options(spark, d):
    one = lambda name, df, c: pages.options(df, c).select(F.lit(name).alias("option"), F.col(c).alias("value"))
    return one("cnae", S.establishments(spark, d), "main_cnae_code").unionByName(one("size", S.companies(spark, d), "company_size_code"))


@query("region_filter", A.sql("SELECT competence, count(*) AS n, count(*) FILTER (WHERE registration_status_code = '02') AS active FROM est WHERE is_in_region AND main_cnae_code = '0000002' GROUP BY 1"))
def region_filter(spark, d):
    return D.in_region(S.establishments(spark, d), cnae="0000002").groupBy("competence").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("registration_status_code") == "02").alias("active"))


_BOARD = f"""SELECT 'events' AS section, event_type AS key, CAST(count(*) AS BIGINT) AS value FROM elig GROUP BY 2
UNION ALL SELECT 'status', status_code, value FROM metrics WHERE competence = {T} AND metric_type = 'REGIONAL_ESTABLISHMENTS_BY_STATUS'
UNION ALL SELECT 'size', size_code, value FROM metrics WHERE competence = {T} AND metric_type = 'REGIONAL_COMPANIES_BY_SIZE'
UNION ALL SELECT 'trend', CAST(competence AS VARCHAR), value FROM metrics WHERE metric_type = 'REGIONAL_ESTABLISHMENTS_TOTAL'
UNION ALL SELECT 'openings', CAST(competence AS VARCHAR), count(*) FILTER (WHERE event_type = 'ESTABLISHMENT_OPENED') FROM months LEFT JOIN elig ON competence = to_month GROUP BY 2
UNION ALL SELECT 'closings', CAST(competence AS VARCHAR), count(*) FILTER (WHERE event_type = 'ESTABLISHMENT_CLOSED') FROM months LEFT JOIN elig ON competence = to_month GROUP BY 2"""


@query("dashboard", events_sql(_BOARD, _ELIGIBLE, _METRICS))
def dashboard(spark, d):
    """The board's sections as rows; unfiltered, so stock figures come from the metrics."""
    m, e = S.metrics(spark, d), eligible(spark, d)
    part = lambda df, section, key, value="value": df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("long").alias("value"))
    kind = lambda name: m.filter(F.col("metric_type") == name)
    last = lambda name: kind(name).filter(F.col("competence") == END)
    series = D.opening_closing(e, A.months(spark))
    return A.union([
        part(D.counts_by_type(e), "events", "event_type", "total"), part(last("REGIONAL_ESTABLISHMENTS_BY_STATUS"), "status", "status_code"), part(last("REGIONAL_COMPANIES_BY_SIZE"), "size", "size_code"),
        part(kind("REGIONAL_ESTABLISHMENTS_TOTAL"), "trend", "competence"), part(series, "openings", "competence", "openings"), part(series, "closings", "competence", "closings"),
    ])


def _months(first: date, last: date) -> list[date]:
    return [date(first.year + (first.month - 1 + k) // 12, (first.month - 1 + k) % 12 + 1, 1) for k in range((last.year - first.year) * 12 + last.month - first.month + 1)]


def _board_sql(first: str, last: str, place: str, filtered: bool, headquarters: bool) -> tuple[str, ...]:
    code = lambda c: f"coalesce(nullif({c}, ''), '—')"
    dec = lambda x: f"CAST({x} AS DECIMAL(19,2))"
    row = lambda section, key, value, source: f"SELECT '{section}' AS section, CAST(NULL AS INTEGER) AS place, {key} AS key, CAST(NULL AS VARCHAR) AS label, {dec('NULL')} AS before, {dec('NULL')} AS after, {dec(value)} AS value FROM {source}"
    own = " AND (CASE WHEN entity_type = 'ESTABLISHMENT' THEN cnpj IN (SELECT cnpj FROM reg) ELSE cnpj_basic IN (SELECT cnpj_basic FROM reg) END)" if filtered else ""
    scope = f" AND cnpj_basic IN (SELECT cnpj_basic FROM reg WHERE branch_type = '1')" if headquarters else ""  # noqa: F541
    by_month = lambda event: f"mon LEFT JOIN (SELECT * FROM ev WHERE event_type = '{event}') e ON e.to_month = mon.competence GROUP BY mon.competence"
    moved = lambda name, test, order: f"SELECT '{name}', CAST(rn AS INTEGER), key, NULL, {dec('a')}, {dec('b')}, {dec('b - a')} FROM (SELECT *, row_number() OVER (ORDER BY {order}, key) AS rn FROM act WHERE {test}) WHERE rn <= 5"
    tables = (
        f"mon AS (SELECT competence FROM months WHERE competence BETWEEN {first} AND {last})", f"ins AS (SELECT * FROM est WHERE is_in_region AND {place} AND competence BETWEEN {first} AND {last})", f"reg AS (SELECT * FROM ins WHERE competence = {last})",
        f"ev AS (SELECT * FROM events_ WHERE to_month > {first} AND to_month <= {last}{own})", f"names AS (SELECT cnpj_basic, legal_name FROM company WHERE competence = {last})",
        f"act AS (SELECT {code('main_cnae_code')} AS key, count(*) FILTER (WHERE competence = {first}) AS a, count(*) FILTER (WHERE competence = {last}) AS b FROM ins WHERE competence IN ({first}, {last}) GROUP BY 1)",
        f"grown AS (SELECT cnpj_basic, arg_min(a, to_month) AS previous, arg_max(b, to_month) AS current, current - previous AS delta FROM (SELECT *, {_CAP.format('previous_value')} AS a, {_CAP.format('new_value')} AS b FROM ev WHERE event_type = 'SHARE_CAPITAL_CHANGED'{scope}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING delta > 0)",
        "people AS (SELECT cnpj_basic, count(*) FILTER (WHERE event_type = 'PARTNER_ADDED') - count(*) FILTER (WHERE event_type = 'PARTNER_REMOVED') AS delta FROM ev GROUP BY 1 HAVING delta > 0 ORDER BY delta DESC, cnpj_basic LIMIT 8)",
        f"few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY seen DESC) AS k FROM (SELECT *, sha256(event_type || '|' || entity_key) AS seen FROM ev WHERE to_month = {last})) WHERE k <= 8)",
        "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cnpj_basic ORDER BY seen DESC) AS r FROM few) WHERE r = 1 ORDER BY seen DESC LIMIT 8)",
    )
    at = lambda m: f"(SELECT count(*) FROM partner x WHERE x.cnpj_basic = p.cnpj_basic AND x.competence = {m})"
    body = " UNION ALL ".join([
        row("companies", "''", "count(DISTINCT cnpj_basic)", "reg"), row("establishments", "''", "count(*)", "reg"), row("events", "event_type", "count(*)", "ev GROUP BY event_type"), row("status", code("registration_status_code"), "count(*)", "reg GROUP BY 3"),
        row("size", code("company_size_code"), "count(*)", f"company WHERE competence = {last} AND cnpj_basic IN (SELECT cnpj_basic FROM reg) GROUP BY 3"), row("trend", "CAST(mon.competence AS VARCHAR)", "count(ins.cnpj)", "mon LEFT JOIN ins ON ins.competence = mon.competence GROUP BY mon.competence"),
        row("opened", "CAST(mon.competence AS VARCHAR)", "count(e.entity_key)", by_month("ESTABLISHMENT_OPENED")), row("closed", "CAST(mon.competence AS VARCHAR)", "count(e.entity_key)", by_month("ESTABLISHMENT_CLOSED")),
        moved("growth", "b > a", "b - a DESC"), moved("reduction", "b < a", "b - a"),
        f"SELECT 'capital', CAST(rn AS INTEGER), cnpj_basic, coalesce(legal_name, 'Empresa sem nome'), {dec('previous')}, {dec('current')}, {dec('delta')} FROM (SELECT *, row_number() OVER (ORDER BY delta DESC, cnpj_basic) AS rn FROM grown) LEFT JOIN names USING (cnpj_basic) WHERE rn <= 3",
        f"SELECT 'partners', CAST(row_number() OVER (ORDER BY delta DESC, cnpj_basic) AS INTEGER), cnpj_basic, coalesce(legal_name, 'Empresa sem nome'), {dec(at(first))}, {dec(at(last))}, {dec('delta')} FROM people p LEFT JOIN names USING (cnpj_basic)",
        f"SELECT 'recent', CAST(row_number() OVER (ORDER BY seen DESC) AS INTEGER), cnpj_basic, event_type, {dec('NULL')}, {dec('NULL')}, {dec('NULL')} FROM one",
    ])
    return (body, *tables)


def board(spark, d, first=START, last=END, **filters):
    """The whole dashboard; a municipality or activity that no row has is an empty one."""
    return D.board(S.companies(spark, d), S.establishments(spark, d), S.partners(spark, d), S.events(spark, d), _months(first, last), **filters)


@query("dashboard_filtered", events_sql(*_board_sql("DATE '1998-04-01'", "DATE '1998-12-01'", "municipality_ibge_code = '3100000'", True, False)))
def dashboard_filtered(spark, d):
    return board(spark, d, date(1998, 4, 1), date(1998, 12, 1), municipality="3100000")


@query("dashboard_headquarters", events_sql(*_board_sql("DATE '1998-02-01'", "DATE '1998-07-01'", "main_cnae_code = '0000002'", True, True)))
def dashboard_headquarters(spark, d):
    """By activity, with capital of companies whose headquarters is in the region."""
    return board(spark, d, date(1998, 2, 1), date(1998, 7, 1), cnae="0000002", headquarters=True)


@query("dashboard_whole", events_sql(*_board_sql(FROM, T, "true", False, False)))
def dashboard_whole(spark, d):
    return board(spark, d)
