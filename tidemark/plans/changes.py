"""Queries on changes between months."""

from pyspark.sql import functions as F

from tidemark.functions import keys, show
from tidemark.operators import diff, quality
from tidemark.plans import adapter as A
from tidemark.plans import store as S
from tidemark.plans.registry import query
from tidemark.sources import sinks

ADDRESS = diff.ADDRESS


pairs = S.pairs


def company_rows(spark, d):
    return S.changed(spark, d, "companies")


def place_rows(spark, d):
    return S.changed(spark, d, "establishments")


# ---- SQL


def _obj(alias: str, *fields: str) -> str:
    """JSON of fields; decimals don't occur, dates are text."""
    return "CAST(to_json({" + ", ".join(f"'{f}': {alias}.{f}" for f in fields) + "}) AS VARCHAR)"


def _both(condition: str, event: str, dimension: str, table: str, key: str, basic: str, cnpj: str, before: str, after: str, day: str = "NULL", kind: str = "ESTABLISHMENT") -> str:
    return f"SELECT pr.from_month, pr.to_month, '{event}' AS event_type, '{kind}' AS entity_type, '{dimension}' AS dimension, {key} AS entity_key, {basic} AS cnpj_basic, {cnpj} AS cnpj, {before} AS previous_value, {after} AS new_value, CAST({day} AS DATE) AS effective_date FROM {table} WHERE {condition}"


_PAIRS = "pairs AS (SELECT competence AS from_month, CAST(competence + INTERVAL 1 MONTH AS DATE) AS to_month FROM months WHERE competence < (SELECT max(competence) FROM months))"
_EST = "est p JOIN pairs pr ON p.competence = pr.from_month JOIN est c ON c.cnpj = p.cnpj AND c.competence = pr.to_month"
_COM = "company p JOIN pairs pr ON p.competence = pr.from_month JOIN company c ON c.cnpj_basic = p.cnpj_basic AND c.competence = pr.to_month"
_NEW = "est c JOIN pairs pr ON c.competence = pr.to_month LEFT JOIN est p ON p.cnpj = c.cnpj AND p.competence = pr.from_month"
_KEY = ("c.cnpj", "c.cnpj[1:8]", "c.cnpj")
_CKEY = ("c.cnpj_basic", "c.cnpj_basic", "CAST(NULL AS VARCHAR)")
_ADDR = " OR ".join(f"p.{f} IS DISTINCT FROM c.{f}" for f in ADDRESS)
_ST = (_obj("p", "registration_status_code"), _obj("c", "registration_status_code"))
_PL = (_obj("p", *ADDRESS), _obj("c", *ADDRESS))
_ST_DIFF = "p.registration_status_code <> c.registration_status_code"
_IN = "c.activity_start_date > pr.from_month AND c.activity_start_date <= pr.to_month"
_EST_EVENTS = " UNION ALL ".join(
    [
        _both(f"p.cnpj IS NULL AND {_IN}", "ESTABLISHMENT_OPENED", "lifecycle", _NEW, *_KEY, "NULL", _ST[1], "c.activity_start_date"),
        _both(f"{_ST_DIFF} AND c.registration_status_code = '08'", "ESTABLISHMENT_CLOSED", "registration_status", _EST, *_KEY, *_ST, "c.registration_status_date"),
        _both(f"{_ST_DIFF} AND c.registration_status_code <> '08'", "REGISTRATION_STATUS_CHANGED", "registration_status", _EST, *_KEY, *_ST),
        _both("NOT p.is_in_region AND c.is_in_region", "ENTERED_REGION", "location", _EST, *_KEY, *_PL),
        _both("p.is_in_region AND NOT c.is_in_region", "LEFT_REGION", "location", _EST, *_KEY, *_PL),
        _both(f"p.is_in_region = c.is_in_region AND ({_ADDR})", "ADDRESS_CHANGED", "location", _EST, *_KEY, *_PL),
        _both("p.main_cnae_code IS DISTINCT FROM c.main_cnae_code", "MAIN_CNAE_CHANGED", "main_cnae", _EST, *_KEY, _obj("p", "main_cnae_code"), _obj("c", "main_cnae_code")),
    ]
)


def _tax(x: str) -> tuple[str, ...]:
    return (f"{x}_optant", f"{x}_option_date", f"{x}_exclusion_date")


def _tax_event(x: str, event: str) -> str:
    return _both(" OR ".join(f"p.{f} IS DISTINCT FROM c.{f}" for f in _tax(x)), event, f"{x}_status", _COM, *_CKEY, _obj("p", *_tax(x)), _obj("c", *_tax(x)), kind="COMPANY")


def _cap(a: str) -> str:
    return f"CAST(to_json({{'share_capital': coalesce(CAST({a}.share_capital AS VARCHAR), 'None')}}) AS VARCHAR)"


_COM_EVENTS = " UNION ALL ".join(
    [
        _both("p.share_capital IS DISTINCT FROM c.share_capital", "SHARE_CAPITAL_CHANGED", "share_capital", _COM, *_CKEY, _cap("p"), _cap("c"), kind="COMPANY"),
        _both("p.legal_nature_code IS DISTINCT FROM c.legal_nature_code", "LEGAL_NATURE_CHANGED", "legal_nature", _COM, *_CKEY, _obj("p", "legal_nature_code"), _obj("c", "legal_nature_code"), kind="COMPANY"),
        _both("p.company_size_code IS DISTINCT FROM c.company_size_code", "COMPANY_SIZE_CHANGED", "company_size", _COM, *_CKEY, _obj("p", "company_size_code"), _obj("c", "company_size_code"), kind="COMPANY"),
        _tax_event("simples", "SIMPLES_STATUS_CHANGED"),
        _tax_event("mei", "MEI_STATUS_CHANGED"),
    ]
)
_SAME = "SELECT a.cnpj_basic, pr.to_month, pr.from_month FROM company a JOIN pairs pr ON a.competence = pr.from_month JOIN company b ON b.cnpj_basic = a.cnpj_basic AND b.competence = pr.to_month"
_PKEY = "'(''' || {0}.cnpj_basic || ''', ''' || {0}.partner_key || ''')'"


def _partner(x: str, other: str, month: str, missing: str, event: str, before: str, after: str, day: str) -> str:
    source = f"partner {x} JOIN pr ON pr.cnpj_basic = {x}.cnpj_basic AND {x}.competence = pr.{month} LEFT JOIN partner {other} ON {other}.cnpj_basic = {x}.cnpj_basic AND {other}.partner_key = {x}.partner_key AND {other}.competence = pr.{missing}"
    return _both(f"{other}.cnpj_basic IS NULL", event, "partnership", source, _PKEY.format(x), f"{x}.cnpj_basic", "CAST(NULL AS VARCHAR)", before, after, day, "PARTICIPATION")


_PAR_EVENTS = " UNION ALL ".join(
    [
        _partner("c", "p", "to_month", "from_month", "PARTNER_ADDED", "NULL", _obj("c", *diff.PARTNER), "c.entry_date"),
        _partner("p", "c", "from_month", "to_month", "PARTNER_REMOVED", _obj("p", *diff.PARTNER), "NULL", "NULL"),
        _both("p.qualification_code IS DISTINCT FROM c.qualification_code", "PARTNER_QUALIFICATION_CHANGED", "partner_qualification", "pr JOIN partner p ON p.cnpj_basic = pr.cnpj_basic AND p.competence = pr.from_month JOIN partner c ON c.cnpj_basic = p.cnpj_basic AND c.partner_key = p.partner_key AND c.competence = pr.to_month", _PKEY.format("c"), "c.cnpj_basic", "CAST(NULL AS VARCHAR)", _obj("p", "qualification_code"), _obj("c", "qualification_code"), "NULL", "PARTICIPATION"),
    ]
)
EVENTS = (_PAIRS, f"est_events AS ({_EST_EVENTS})", f"com_events AS ({_COM_EVENTS})", f"pr AS ({_SAME})", f"par_events AS ({_PAR_EVENTS})", "events_ AS (SELECT * FROM est_events UNION ALL SELECT * FROM com_events UNION ALL SELECT * FROM par_events)")


def events_sql(body: str, *more: str) -> str:
    return A.sql(body, *EVENTS, *more)


@query("changed_rows", events_sql("""
SELECT coalesce(p.cnpj_basic, c.cnpj_basic) AS cnpj_basic, coalesce(p.to_month, c.competence) AS to_month, p.record_hash AS old_hash, c.record_hash AS new_hash
FROM (SELECT company.*, to_month FROM company JOIN pairs ON competence = from_month) p
FULL JOIN (SELECT company.* FROM company JOIN pairs ON competence = to_month) c ON p.cnpj_basic = c.cnpj_basic AND p.to_month = c.competence
WHERE p.record_hash IS DISTINCT FROM c.record_hash"""))
def changed_rows(spark, d):
    return company_rows(spark, d).select("cnpj_basic", "to_month", F.col("p.record_hash").alias("old_hash"), F.col("c.record_hash").alias("new_hash"))


@query("comparable_partners", events_sql("SELECT partner.cnpj_basic, partner_key, pr.to_month FROM partner JOIN pr ON partner.cnpj_basic = pr.cnpj_basic AND competence = pr.to_month"))
def comparable_partners(spark, d):
    known = diff.comparable(S.companies(spark, d), pairs(spark))
    rows = S.partners(spark, d).select("cnpj_basic", "partner_key", F.col("competence").alias("to_month"))
    return diff.of_comparable(rows, known).select("cnpj_basic", "partner_key", "to_month")


@query("establishment_events", events_sql("SELECT * FROM est_events"))
def establishment_events(spark, d):
    return diff.establishment_events(place_rows(spark, d))


@query("company_events", events_sql("SELECT * FROM com_events"))
def company_events(spark, d):
    return diff.company_events(company_rows(spark, d))


@query("partner_events", events_sql("SELECT * FROM par_events"))
def partner_events(spark, d):
    return diff.partner_events(S.changed(spark, d, "partners"), diff.comparable(S.companies(spark, d), pairs(spark)))


@query("full_recompute", events_sql("SELECT to_month, entity_type, event_type, count(*) AS n, count(DISTINCT entity_key) AS entities FROM events_ GROUP BY ALL"))
def full_recompute(spark, d):
    return S.window_events(spark, d).groupBy("to_month", "entity_type", "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_key").alias("entities"))


@query("event_counts", events_sql("SELECT to_month, event_type, count(*) AS n FROM est_events GROUP BY ALL"))
def event_counts(spark, d):
    """Establishment events by month and type."""
    return diff.establishment_events(place_rows(spark, d)).groupBy("to_month", "event_type").agg(F.count(F.lit(1)).alias("n"))


_HASH = "sha256(strftime({0}, '%Y-%m-%d'))"


@query("event_keys", events_sql(f"""SELECT entity_key, event_type, to_month, sha256('window' || chr(31) || {_HASH.format('from_month')} || chr(31) || {_HASH.format('to_month')} || chr(31) || entity_type || chr(31) || entity_key || chr(31) || dimension || chr(31) || event_type) AS event_key FROM events_"""))
def event_keys(spark, d):
    day = lambda c: F.sha2(F.date_format(c, "yyyy-MM-dd"), 256)
    key = keys.event_key(F.lit("window"), day("from_month"), day("to_month"), F.col("entity_type"), F.col("entity_key"), F.col("dimension"), F.col("event_type"))
    return S.events(spark, d).select("entity_key", "event_type", "to_month", key.alias("event_key"))


@query("affected_intervals", events_sql("SELECT e.to_month, event_type, count(*) AS n FROM events_ e JOIN pairs USING (to_month) WHERE DATE '1998-05-01' IN (pairs.from_month, to_month) GROUP BY ALL"))
def affected_intervals(spark, d):
    """Only the events of pairs that a revised month is in are made again."""
    revised = A.months(spark).filter("competence = DATE '1998-05-01'")
    hit = diff.affected_pairs(pairs(spark), revised)
    months = sorted({m for p in hit.collect() for m in p})  # of one revised month
    own = [table(spark, d).filter(F.col("competence").isin(months)) for table in (S.companies, S.establishments, S.partners)]
    made = diff.window_events(*own, hit, together=True)
    return made.groupBy("to_month", "event_type").agg(F.count(F.lit(1)).alias("n"))


_OLD = "NOT (cnpj_basic[8:8] = '7' AND competence > DATE '1998-10-01')"


@query("changed_packages", A.sql(f"SELECT competence FROM company GROUP BY 1 HAVING count(*) FILTER (WHERE NOT ({_OLD})) > 0"))
def changed_packages(spark, d):
    """Months whose stored package lacks some of the companies that are offered now."""
    offered = S.companies(spark, d)
    stored = offered.filter("NOT (substring(cnpj_basic, 8, 1) = '7' AND competence > DATE '1998-10-01')")
    return diff.changed_packages(sinks.manifest({"companies": stored}), sinks.manifest({"companies": offered}))


@query("active_revisions", A.sql("""
, r AS (SELECT competence, CAST(s AS INTEGER) AS revision_number, CASE WHEN (month(competence) + s) % 4 = 0 THEN 'REJECTED' ELSE 'PUBLISHED' END AS status FROM (SELECT DISTINCT competence FROM company), range(1, 4) t(s))
SELECT *, status = 'PUBLISHED' AND revision_number = max(revision_number) FILTER (WHERE status = 'PUBLISHED') OVER (PARTITION BY competence) AS active FROM r""".strip()))
def active_revisions(spark, d):
    tries = S.companies(spark, d).select("competence").distinct().select("competence", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("revision_number"))
    status = F.when((F.month("competence") + F.col("revision_number")) % 4 == 0, "REJECTED").otherwise("PUBLISHED")
    return diff.active_revisions(tries.withColumn("status", status))


_ISSUES = """issues AS (
SELECT pr.to_month, 'COMPANY_MISSING_IN_CURRENT' AS rule_code, 'COMPANY' AS entity_type, p.cnpj_basic AS entity_key FROM company p JOIN pairs pr ON p.competence = pr.from_month ANTI JOIN company c ON c.cnpj_basic = p.cnpj_basic AND c.competence = pr.to_month
UNION ALL SELECT pr.to_month, 'ESTABLISHMENT_MISSING_IN_CURRENT', 'ESTABLISHMENT', p.cnpj FROM est p JOIN pairs pr ON p.competence = pr.from_month ANTI JOIN est c ON c.cnpj = p.cnpj AND c.competence = pr.to_month
UNION ALL SELECT pr.to_month, 'LATE_FIRST_SEEN', 'ESTABLISHMENT', c.cnpj FROM est c JOIN pairs pr ON c.competence = pr.to_month LEFT JOIN est p ON p.cnpj = c.cnpj AND p.competence = pr.from_month
  WHERE p.cnpj IS NULL AND (c.activity_start_date IS NULL OR NOT (c.activity_start_date > pr.from_month AND c.activity_start_date <= pr.to_month)))"""
_SIZES = """sizes AS (SELECT to_month, entity_type, max(n) AS eligible_rows FROM pairs JOIN (
  SELECT competence, 'COMPANY' AS entity_type, count(*) AS n FROM company GROUP BY 1 UNION ALL SELECT competence, 'ESTABLISHMENT', count(*) FROM est GROUP BY 1) ON competence IN (from_month, to_month) GROUP BY 1, 2)"""
_GATE = """gate AS (SELECT to_month, rule_code, entity_type, count(*) AS affected_rows, any_value(eligible_rows) AS eligible_rows,
  greatest(10, CAST(ceil(any_value(eligible_rows) * CASE rule_code WHEN 'LATE_FIRST_SEEN' THEN 0.005::DOUBLE ELSE 0.001::DOUBLE END) AS BIGINT)) AS row_limit FROM issues JOIN sizes USING (to_month, entity_type) GROUP BY 1, 2, 3)"""


def issues(spark, d):
    return diff.missing_and_late(company_rows(spark, d), place_rows(spark, d))


def gate(spark, d):
    tables = {"COMPANY": S.companies(spark, d), "ESTABLISHMENT": S.establishments(spark, d)}
    return quality.gate(issues(spark, d).withColumn("affected_rows", F.lit(1)), quality.eligible(tables, pairs(spark)))


@query("missing_and_late", events_sql("SELECT * FROM issues", _ISSUES))
def missing_and_late(spark, d):
    return issues(spark, d)


@query("warning_threshold", events_sql("SELECT *, affected_rows <= row_limit AS passed FROM gate", _ISSUES, _SIZES, _GATE))
def warning_threshold(spark, d):
    return gate(spark, d)


@query("quality_recompute", events_sql("SELECT rule_code, entity_type, CAST(sum(affected_rows) AS BIGINT) AS affected_rows, CAST(sum(eligible_rows) AS BIGINT) AS eligible_rows, CAST(sum(row_limit) AS BIGINT) AS row_limit, bool_and(affected_rows <= row_limit) AS passed FROM gate GROUP BY 1, 2", _ISSUES, _SIZES, _GATE))
def quality_recompute(spark, d):
    """Figures of stored issues, made again over the window."""
    return gate(spark, d).groupBy("rule_code", "entity_type").agg(F.sum("affected_rows").alias("affected_rows"), F.sum("eligible_rows").alias("eligible_rows"), F.sum("row_limit").alias("row_limit"), F.bool_and("passed").alias("passed"))


@query("adjacent_months", A.sql("SELECT from_month, to_month FROM pairs", _PAIRS))
def adjacent_months(spark, d):
    return diff.month_pairs(S.companies(spark, d))


_LABEL = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in show.EVENTS.items()) + " END"
_AMOUNT = "TRY_CAST(json_extract_string({}, '$.share_capital') AS DECIMAL(18,2))"


def _brl(x: str) -> str:
    return f"coalesce('R$ ' || translate(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',.', '.,'), 'Não informado')"


def _text(column: str, before: bool) -> str:
    at = lambda k: f"nullif(json_extract_string({column}, '$.{k}'), '')"
    status = "CASE " + " ".join(f"WHEN {at('registration_status_code')} = '{k}' THEN '{v} ({k})'" for k, v in show.STATUSES.items()) + " END"
    size = "CASE " + " ".join(f"WHEN {at('company_size_code')} = '{k}' THEN '{v}'" for k, v in show.SIZES.items()) + f" ELSE 'Código ' || {at('company_size_code')} END"
    kind = f"CASE {at('partner_type')} WHEN 'PF' THEN 'Pessoa física' WHEN 'PJ' THEN 'Pessoa jurídica' ELSE {at('partner_type')} END"
    day = lambda k: f"strftime(CAST({at(k)} AS DATE), '%d/%m/%Y')"
    tax = lambda x: f"concat_ws(' · ', CASE {at(x + '_optant')} WHEN 'true' THEN 'Optante' WHEN 'false' THEN 'Não optante' ELSE 'Situação não informada' END, 'opção em ' || {day(x + '_option_date')}, 'exclusão em ' || {day(x + '_exclusion_date')})"
    address = f"concat_ws(' · ', concat_ws(', ', concat_ws(' ', {at('street_type')}, {at('street_name')}), {at('street_number')}), {at('address_complement')}, concat_ws(' — ', {at('neighborhood')}, {at('state_code')}), 'CEP ' || {at('postal_code')}, 'IBGE ' || {at('municipality_ibge_code')})"
    absent = "CASE event_type WHEN 'ESTABLISHMENT_OPENED' THEN 'Não constava na competência anterior' WHEN 'PARTNER_ADDED' THEN 'Participação ainda não registrada' ELSE 'Não se aplica' END" if before else "CASE event_type WHEN 'PARTNER_REMOVED' THEN 'Participação não consta mais' ELSE 'Não se aplica' END"
    return f"""CASE WHEN {column} IS NULL THEN {absent} WHEN event_type = 'SHARE_CAPITAL_CHANGED' THEN {_brl(_AMOUNT.format(column))} WHEN event_type IN ('ADDRESS_CHANGED', 'ENTERED_REGION', 'LEFT_REGION') THEN {address}
      WHEN event_type IN ('PARTNER_ADDED', 'PARTNER_REMOVED') THEN concat_ws(' · ', {at('display_name')}, {kind}, 'CNPJ básico ' || {at('partner_cnpj_basic')}, 'qualificação ' || {at('qualification_code')})
      WHEN event_type IN ('REGISTRATION_STATUS_CHANGED', 'ESTABLISHMENT_CLOSED', 'ESTABLISHMENT_OPENED') THEN {status} WHEN event_type = 'MAIN_CNAE_CHANGED' THEN coalesce('CNAE ' || {at('main_cnae_code')}, 'CNAE não informado')
      WHEN event_type = 'COMPANY_SIZE_CHANGED' THEN {size} WHEN event_type = 'LEGAL_NATURE_CHANGED' THEN 'Código ' || {at('legal_nature_code')} WHEN event_type = 'SIMPLES_STATUS_CHANGED' THEN {tax('simples')} WHEN event_type = 'MEI_STATUS_CHANGED' THEN {tax('mei')}
      ELSE 'Qualificação ' || {at('qualification_code')} END"""


_EVENT_LABEL = f"CASE WHEN event_type = 'SHARE_CAPITAL_CHANGED' AND {_AMOUNT.format('new_value')} > {_AMOUNT.format('previous_value')} THEN 'Aumento de capital social' WHEN event_type = 'SHARE_CAPITAL_CHANGED' AND {_AMOUNT.format('new_value')} < {_AMOUNT.format('previous_value')} THEN 'Redução de capital social' ELSE {_LABEL} END"


@query("event_text", events_sql(f"SELECT to_month, entity_key, event_type, {_EVENT_LABEL} AS label, {_text('previous_value', True)} AS before_text, {_text('new_value', False)} AS after_text FROM events_"))
def event_text(spark, d):
    e = F.col("event_type")
    return S.events(spark, d).select("to_month", "entity_key", "event_type", show.event_label(e, F.col("previous_value"), F.col("new_value")).alias("label"), show.event_value(e, F.col("previous_value"), True).alias("before_text"), show.event_value(e, F.col("new_value"), False).alias("after_text"))


@query("event_entity_gate", events_sql("SELECT e.entity_type, count(*) AS events, count(*) FILTER (WHERE c.cnpj_basic IS NULL) AS unresolved FROM events_ e LEFT JOIN (SELECT DISTINCT cnpj_basic FROM company) c ON e.cnpj_basic = c.cnpj_basic GROUP BY 1"))
def event_entity_gate(spark, d):
    """Events whose company no snapshot has: none is to be left."""
    known = S.companies(spark, d).select("cnpj_basic").distinct().withColumn("known", F.lit(True))
    return S.events(spark, d).join(known, "cnpj_basic", "left").groupBy("entity_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("known").isNull()).alias("unresolved"))
