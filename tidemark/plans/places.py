"""Queries on addresses and the map."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import show
from tidemark.operators import geo, maps
from tidemark.plans import adapter as A
from tidemark.plans import store as S
from tidemark.plans.changes import events_sql
from tidemark.plans.registry import query

NOW, BEFORE = date(1998, 9, 1), date(1998, 8, 1)
N, B = "DATE '1998-09-01'", "DATE '1998-08-01'"


def population(spark, d):
    people = A.table(spark, d, "customer").join(F.broadcast(A.nations(spark, d)), F.col("c_nationkey") == F.col("n_nationkey"))
    return people.groupBy(F.col("ibge").alias("municipality")).agg((F.count(F.lit(1)) * 1000).alias("population")).select("municipality", F.lit(2022).alias("year"), F.lit("census").alias("source"), "population")


def scope(spark, d):
    return A.nations(spark, d).filter("inside").select(F.col("ibge").alias("municipality"))


def centres(spark, d):
    n = F.col("n_nationkey")
    return A.nations(spark, d).select(F.col("ibge").alias("municipality"), ((n * 50000 - 20000000) / 1e6).alias("latitude"), ((n * 40000 - 48000000) / 1e6).alias("longitude"))


def hav(a, b, c, e):
    a, b, c, e = (f"({x})" for x in (a, b, c, e))
    return f"(2 * 6371008.8 * atan2(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2)), sqrt(1 - (pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2)))))"


def _points(name: str, source: str, key: str, best: bool) -> str:
    level = f"SELECT * EXCLUDE (least) FROM (SELECT *, min(level) OVER (PARTITION BY {key}) AS least FROM {name}_u) WHERE level = least" if best else f"SELECT * FROM {name}_u"
    return f"""{name}_u AS (SELECT * EXCLUDE (rn) FROM (SELECT {key}, address_code, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, level, row_number() OVER (PARTITION BY {key}, round(latitude, 6), round(longitude, 6) ORDER BY level, address_code) AS rn FROM {source}) WHERE rn = 1),
{name}_b AS ({level}),
{name}_d AS (SELECT {key}, n, CASE WHEN n > 100 THEN {hav('s', 'w', 't', 'e')} ELSE coalesce(apart, 0) END AS dispersion FROM (SELECT {key}, count(*) AS n, min(latitude) AS s, min(longitude) AS w, max(latitude) AS t, max(longitude) AS e FROM {name}_b GROUP BY ALL)
  LEFT JOIN (SELECT {key}, max({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}) AS apart FROM {name}_b a JOIN {name}_b b USING ({key}) WHERE (a.latitude, a.longitude) < (b.latitude, b.longitude) GROUP BY ALL) USING ({key})),
{name}_r AS (SELECT * EXCLUDE (rn) FROM (SELECT {key}, address_code, latitude, longitude, level, row_number() OVER (PARTITION BY {key} ORDER BY round({hav('latitude', 'longitude', 'mid_lat', 'mid_lon')}, 3), address_code, latitude, longitude) AS rn
  FROM (SELECT *, median(latitude) OVER (PARTITION BY {key}) AS mid_lat, median(longitude) OVER (PARTITION BY {key}) AS mid_lon FROM {name}_b)) WHERE rn = 1),
{name} AS (SELECT * FROM {name}_r JOIN {name}_d USING ({key}))"""


_N = "CAST(CAST({} AS BIGINT) AS VARCHAR)"
_KEY = "ibge, postal, street, number"
GEO = (
    f"""ref AS (SELECT ibge, {_N.format('30000000 + l_suppkey % 40 * 100 + l_partkey % 3')} AS postal, CASE WHEN l_partkey % 2 = 0 THEN 'DOUTOR' ELSE '' END AS title, 'RUA SAO ' || (l_suppkey % 40) AS street, {_N.format('l_partkey % 30')} AS number, lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS address_code,
  (-20000000 + n_nationkey * 50000 + l_suppkey % 40 * 1000 + l_partkey % 30 * 10 + l_partkey % 3 * 3 + CASE WHEN l_partkey % 13 = 0 THEN 900 ELSE 0 END) / 1e6::DOUBLE AS latitude,
  (-48000000 + n_nationkey * 40000 + l_suppkey % 40 * 1000 + l_partkey % 30 * 12 + l_partkey % 4 * 2 + CASE WHEN l_partkey % 13 = 0 THEN 900 ELSE 0 END) / 1e6::DOUBLE AS longitude, CAST(l_partkey % 6 + 1 AS INTEGER) AS level
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey % 11 <> 0) JOIN supplier ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = n_nationkey)""",
    """alias_ AS (SELECT ibge, postal, unnest(CASE WHEN title = '' THEN [street] ELSE [street, title || ' ' || street] END) AS street, CASE WHEN number = '0' THEN '' ELSE number END AS number, address_code, latitude, longitude, level FROM ref), cand AS (SELECT * FROM alias_ WHERE number <> '')""",
    _points("adr", "cand", _KEY, True),
    _points("pos", "ref", "ibge, postal", False),
    """elg AS (SELECT *, municipality_ibge_code AS ibge, postal_code AS postal, upper(strip_accents(street_name)) AS street, CASE WHEN street_number = '0' THEN '' ELSE street_number END AS number FROM est WHERE is_in_region AND registration_status_code = '02')""",
    """addresses AS (SELECT DISTINCT ibge, postal, street, number, sha256(ibge || chr(31) || postal || chr(31) || street || chr(31) || number) AS fingerprint FROM elg)""",
    """res AS (SELECT fingerprint, x.ibge, x.postal, x.street, x.number, CASE WHEN a.n IS NOT NULL AND a.dispersion <= 100 THEN 'ADDRESS' WHEN p.n IS NOT NULL THEN 'POSTAL_CODE' ELSE 'UNLOCATED' END AS method,
  CAST(CASE WHEN a.dispersion <= 100 THEN a.latitude ELSE p.latitude END AS DECIMAL(9,6)) AS latitude, CAST(CASE WHEN a.dispersion <= 100 THEN a.longitude ELSE p.longitude END AS DECIMAL(10,6)) AS longitude,
  CASE WHEN a.dispersion <= 100 THEN a.level ELSE p.level END AS level, coalesce(CASE WHEN a.dispersion <= 100 THEN a.address_code ELSE p.address_code END, '') AS address_code, coalesce(a.n, p.n, 0) AS candidate_count, CAST(coalesce(a.dispersion, p.dispersion) AS DECIMAL(12,2)) AS dispersion,
  CASE WHEN a.dispersion <= 100 THEN 'address_match' WHEN a.n IS NOT NULL AND p.n IS NOT NULL THEN 'ambiguous_address_postal_fallback' WHEN a.n IS NOT NULL THEN 'ambiguous_address_without_postal_fallback' WHEN p.n IS NOT NULL THEN 'address_not_matched_postal_fallback' ELSE 'postal_code_not_found' END AS reason
  FROM addresses x LEFT JOIN adr a ON (a.ibge, a.postal, a.street, a.number) = (x.ibge, x.postal, x.street, x.number) LEFT JOIN pos p ON (p.ibge, p.postal) = (x.ibge, x.postal))""",
    """obs AS (SELECT e.competence, e.cnpj, e.cnpj_basic, e.ibge AS municipality, municipality_name, main_cnae_code AS cnae_code, branch_type, coalesce(company_size_code, '') AS size_code,
  CASE WHEN mei_optant THEN 'MEI' WHEN simples_optant THEN 'SIMPLES' WHEN NOT simples_optant THEN 'REGULAR' ELSE 'UNKNOWN' END AS tax_profile, activity_start_date, e.postal, method, latitude, longitude, level, r.fingerprint
  FROM elg e JOIN res r ON (r.ibge, r.postal, r.street, r.number) = (e.ibge, e.postal, e.street, e.number) LEFT JOIN company c ON c.cnpj_basic = e.cnpj_basic AND c.competence = e.competence)""",
    """pop AS (SELECT ibge AS municipality, count(*) * 1000 AS population FROM customer JOIN nat ON c_nationkey = n_nationkey GROUP BY 1)""",
    "scope_ AS (SELECT ibge AS municipality FROM nat WHERE inside)",
    "centres AS (SELECT ibge AS municipality, (n_nationkey * 50000 - 20000000) / 1e6::DOUBLE AS latitude, (n_nationkey * 40000 - 48000000) / 1e6::DOUBLE AS longitude FROM nat)",
    f"sel AS (SELECT * FROM obs WHERE competence = {N})",
)


def geo_sql(body: str, *more: str) -> str:
    return A.sql(body, *GEO, *more)


@query("distinct_addresses", geo_sql("SELECT * FROM addresses"))
def distinct_addresses(spark, d):
    return geo.distinct_addresses(geo.eligible(S.establishments(spark, d)))


@query("candidate_dedupe", geo_sql("SELECT * FROM adr_b"))
def candidate_dedupe(spark, d):
    return geo.best_level(geo.unique_points(geo.by_alias(S.reference(spark, d)), geo.ADDRESS), geo.ADDRESS)


def best(spark, d):
    return candidate_dedupe(spark, d)


@query("representative_point", geo_sql("SELECT * FROM adr_r"))
def representative_point(spark, d):
    return geo.representative(best(spark, d), geo.ADDRESS)


@query("address_dispersion", geo_sql("SELECT ibge, postal, n, round(dispersion, 2) AS dispersion FROM pos_d"))
def address_dispersion(spark, d):
    points = geo.unique_points(geo.by_postal_code(S.reference(spark, d)), geo.POSTAL)
    return geo.dispersion(points, geo.POSTAL).withColumn("dispersion", F.round("dispersion", 2))


@query("address_resolution", geo_sql("SELECT * FROM res"))
def address_resolution(spark, d):
    return S.resolved(spark, d)


@query("observations", geo_sql("SELECT * FROM obs"))
def all_observations(spark, d):
    return geo.observations(S.establishments(spark, d), S.companies(spark, d), S.resolutions(spark, d))


_SUM = """SELECT count(*) AS establishments, count(DISTINCT cnpj_basic) AS companies, count(DISTINCT municipality) AS municipalities, count(*) FILTER (WHERE method = 'ADDRESS') AS by_address, count(*) FILTER (WHERE method = 'POSTAL_CODE') AS by_postal_code, count(*) FILTER (WHERE method = 'UNLOCATED') AS unlocated,
count(*) FILTER (WHERE branch_type = '1') AS headquarters, count(*) FILTER (WHERE branch_type = '2') AS branches, count(*) FILTER (WHERE tax_profile = 'MEI') AS mei, count(*) FILTER (WHERE tax_profile = 'SIMPLES') AS simples, count(*) FILTER (WHERE tax_profile = 'REGULAR') AS regular, count(*) FILTER (WHERE tax_profile = 'UNKNOWN') AS unknown_tax,
CAST(floor(((by_address + by_postal_code) * 20000 + count(*)) // (2 * count(*))) / 100 AS DECIMAL(18,2)) AS coverage FROM {}"""


def per(a: str, b: str, times: int) -> str:
    """Two decimals, halves up, in integers; a is not negative."""
    return f"CAST((({a}) * {times * 200} + {b}) // nullif(2 * {b}, 0) / 100 AS DECIMAL(18,2))"


@query("map_summary", geo_sql(_SUM.format("sel")))
def map_summary(spark, d):
    return maps.summary_of_sets(now_sets(spark, d))


@query("map_summary_filtered", geo_sql(_SUM.format("sel WHERE branch_type = '2' AND tax_profile = 'REGULAR' AND method = 'ADDRESS'")))
def map_summary_filtered(spark, d):
    return maps.summary_of_sets(maps.selected_sets(S.cells(spark, d), maps.Selection(NOW, branch_type="2", tax_profile="REGULAR", method="ADDRESS")))


@query("map_summary_openings", geo_sql(_SUM.format(f"sel WHERE activity_start_date BETWEEN CAST({N} - INTERVAL 11 MONTH AS DATE) AND last_day({N})")))
def map_summary_openings(spark, d):
    """Openings are told by the observations themselves."""
    return maps.summary(maps.selected(S.observations(spark, d), maps.Selection(NOW, opening_months=12)))


_FILTER = f"competence = {N} AND municipality = '3100000' AND branch_type = '1' AND tax_profile = 'REGULAR' AND activity_start_date BETWEEN CAST({N} - INTERVAL 11 MONTH AS DATE) AND last_day({N})"


@query("observation_filter", geo_sql(f"SELECT cnpj, cnae_code, size_code, level FROM obs WHERE {_FILTER}"))
def observation_filter(spark, d):
    chosen = maps.Selection(NOW, municipality="3100000", branch_type="1", tax_profile="REGULAR", opening_months=12)
    return maps.selected(S.observations(spark, d), chosen).select("cnpj", "cnae_code", "size_code", "level")


def now(spark, d):
    return maps.selected(S.observations(spark, d), maps.Selection(NOW))


def now_sets(spark, d):
    return maps.selected_sets(S.cells(spark, d), maps.Selection(NOW))


_BOX = (-47.9, -19.95, -47.3, -19.2)


@query("bbox_filter", geo_sql(f"SELECT cnpj, latitude, longitude FROM sel WHERE longitude BETWEEN {_BOX[0]} AND {_BOX[2]} AND latitude BETWEEN {_BOX[1]} AND {_BOX[3]}"))
def bbox_filter(spark, d):
    return now(spark, d).filter(geo.inside_box(*_BOX)).select("cnpj", "latitude", "longitude")


@query("municipality_density", geo_sql(f"""SELECT municipality, total, companies, population, {per('total', 'population', 1000)} AS establishments_per_1000, {per('companies', 'population', 1000)} AS companies_per_1000 FROM (
SELECT municipality, count(*) AS total, count(DISTINCT cnpj_basic) AS companies, any_value(population) AS population FROM sel LEFT JOIN pop USING (municipality) GROUP BY 1
UNION ALL SELECT 'region', (SELECT count(*) FROM sel), (SELECT count(DISTINCT cnpj_basic) FROM sel), (SELECT CAST(sum(population) AS BIGINT) FROM pop WHERE municipality IN (SELECT municipality FROM sel)))"""))
def municipality_density(spark, d):
    return maps.density_of_sets(now_sets(spark, d), geo.latest_population(population(spark, d), scope(spark, d)))


_DYN = f"""SELECT key, count(*) FILTER (WHERE side = 'b') AS previous_establishments, count(*) FILTER (WHERE side = 'n') AS establishments, count(*) FILTER (WHERE side = 'o') AS openings, count(*) FILTER (WHERE side = 'c') AS closures, establishments - previous_establishments AS stock_change, openings - closures AS lifecycle_balance,
CAST(round(CAST(stock_change * 100 AS DECIMAL(24,0)) * 1000000 / nullif(previous_establishments, 0) / 1000000, 2) AS DECIMAL(18,2)) AS change_percentage, stock_change - lifecycle_balance AS other_effects FROM (
SELECT {{0}} AS key, 'b' AS side FROM obs WHERE competence = {B} UNION ALL SELECT {{0}}, 'n' FROM sel
UNION ALL SELECT {{0}}, 'o' FROM sel WHERE cnpj IN (SELECT cnpj FROM est_events WHERE to_month = {N} AND event_type = 'ESTABLISHMENT_OPENED')
UNION ALL SELECT {{0}}, 'c' FROM obs WHERE competence = {B} AND cnpj IN (SELECT cnpj FROM est_events WHERE to_month = {N} AND event_type = 'ESTABLISHMENT_CLOSED')) WHERE key IS NOT NULL GROUP BY 1 HAVING stock_change <> 0 OR openings <> 0 OR closures <> 0"""


@query("dynamics_municipality", events_sql(_DYN.format("municipality"), *GEO))
def dynamics_municipality(spark, d):
    return maps.dynamics(S.observations(spark, d), S.events(spark, d), maps.Selection(NOW, mode="dynamics"), BEFORE, "municipality")


@query("dynamics_cnae", events_sql(_DYN.format("cnae_code") + " ORDER BY abs(stock_change) DESC, stock_change DESC, key LIMIT 10", *GEO))
def dynamics_cnae(spark, d):
    return maps.movement_ranking(maps.dynamics(S.observations(spark, d), S.events(spark, d), maps.Selection(NOW, mode="dynamics"), BEFORE, "cnae_code"))


@query("stock_ranking", geo_sql("SELECT cnae_code, count(*) AS total FROM sel WHERE coalesce(cnae_code, '') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def stock_ranking(spark, d):
    return maps.ranked(now(spark, d), "cnae_code")


@query("location_clusters", geo_sql("SELECT latitude, longitude, method, level, count(*) AS total, count(DISTINCT cnpj_basic) AS companies FROM sel WHERE latitude IS NOT NULL GROUP BY 1, 2, 3, 4"))
def location_clusters(spark, d):
    return maps.location_clusters(now(spark, d))


_POSTAL = "SELECT municipality, postal, count(*) AS total, count(DISTINCT cnpj_basic) AS companies, arg_min(latitude, fingerprint) AS latitude, arg_min(longitude, fingerprint) AS longitude FROM sel WHERE latitude IS NOT NULL GROUP BY 1, 2"


@query("postal_clusters", geo_sql(_POSTAL))
def postal_clusters(spark, d):
    return maps.postal_clusters(now(spark, d))


_CENTRES = "SELECT municipality, count(*) AS total, count(DISTINCT cnpj_basic) AS companies, latitude, longitude FROM sel JOIN (SELECT municipality, latitude, longitude FROM centres) x USING (municipality) GROUP BY ALL"


@query("municipality_points", geo_sql("SELECT municipality, count(*) AS total, count(DISTINCT cnpj_basic) AS companies, x.latitude, x.longitude FROM sel JOIN centres x USING (municipality) GROUP BY ALL"))
def municipality_points(spark, d):
    return maps.at_centres(maps.by_municipality_of_sets(now_sets(spark, d)), centres(spark, d))


@query("adaptive_level", geo_sql(f"SELECT CASE WHEN (SELECT count(*) FROM ({_POSTAL})) > 40 THEN 'municipality' ELSE 'postal' END AS level_shown, count(*) AS groups, CAST(sum(total) AS BIGINT) AS total FROM (SELECT municipality, count(*) AS total FROM sel GROUP BY 1)"))
def adaptive_level(spark, d):
    """Too many postal codes for the limit, so municipalities are shown."""
    level, groups = maps.clusters(now(spark, d), centres(spark, d), zoom=13, limit=40)
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("total").alias("total")).select(F.lit(level).alias("level_shown"), "groups", "total")


_SPOT = "spot AS (SELECT latitude, longitude, method, level FROM sel WHERE latitude IS NOT NULL GROUP BY 1, 2, 3, 4 ORDER BY count(*) DESC, 1, 2, 3, 4 LIMIT 1)"
_CNAE = "cat AS (SELECT lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 7, '0') AS cnae_code, min(p_brand) AS description FROM part GROUP BY 1)"


def catalogue(spark, d):
    """Brands as activities."""
    code = F.lpad(F.regexp_replace("p_brand", "[^0-9]", ""), 7, "0")
    return A.table(spark, d, "part").groupBy(code.alias("code")).agg(F.min("p_brand").alias("description"))


@query("location_details", geo_sql("""SELECT s.* EXCLUDE (place, total), CAST(place AS INTEGER) AS place, 1 AS page_number, CAST(ceil(total / 25.0) AS INTEGER) AS pages, CAST(total AS INTEGER) AS total, trade_name, legal_name, coalesce(cnae_code[1:4] || '-' || cnae_code[5:5] || '/' || cnae_code[6:7] || ' — ' || description, '') AS cnae_label
FROM (SELECT sel.competence, sel.cnpj, sel.cnpj_basic, sel.municipality_name, sel.cnae_code, sel.branch_type, method, level, row_number() OVER (ORDER BY cnpj) AS place, count(*) OVER () AS total FROM sel JOIN spot USING (latitude, longitude, method, level)) s
LEFT JOIN est USING (cnpj, competence) LEFT JOIN company c ON c.cnpj_basic = s.cnpj_basic AND c.competence = s.competence LEFT JOIN cat USING (cnae_code) WHERE place <= 25""", _SPOT, _CNAE))
def location_details(spark, d):
    """Of the point, method and level with most establishments."""
    rows = now(spark, d)
    spot = rows.filter("latitude IS NOT NULL").groupBy("latitude", "longitude", "method", "level").count().orderBy(F.desc("count"), "latitude", "longitude", "method", "level").first()
    at = (str(spot.latitude), str(spot.longitude)) if spot else ("0", "0")
    return maps.location_details(rows, *at, S.establishments(spark, d), S.companies(spark, d), catalogue(spark, d), method=spot and spot.method, level=spot and spot.level)


@query("map_quality_gate", geo_sql("""SELECT 'total' AS scope, 'all' AS key, count(*) AS eligible, count(*) FILTER (WHERE method <> 'UNLOCATED') AS located, eligible * 0.9 <= located AS passed FROM obs
UNION ALL SELECT 'municipality', s.municipality, count(o.cnpj), count(*) FILTER (WHERE method <> 'UNLOCATED') AS l, count(o.cnpj) * 0.7 <= l FROM scope_ s LEFT JOIN obs o USING (municipality) GROUP BY 2
UNION ALL SELECT 'month', CAST(competence AS VARCHAR), e, l, coalesce(lag(l / e) OVER (ORDER BY competence) - l / e <= 0.05, true) FROM (SELECT competence, count(*) AS e, count(*) FILTER (WHERE method <> 'UNLOCATED') AS l FROM obs GROUP BY 1)
UNION ALL SELECT 'structure', 'points that don''t fit their method', count(*), 0, true FROM obs UNION ALL SELECT 'structure', 'companies of other establishments', count(*), 0, true FROM obs
UNION ALL SELECT 'structure', 'municipalities outside the scope', count(*), 0, true FROM scope_ UNION ALL SELECT 'structure', 'observations for eligible establishments', (SELECT count(*) FROM elg), abs((SELECT count(*) FROM elg) - count(*)), (SELECT count(*) FROM elg) = count(*) FROM obs
UNION ALL SELECT 'structure', 'months of the window', count(DISTINCT competence), (SELECT count(*) FROM months) - count(DISTINCT competence), count(DISTINCT competence) = (SELECT count(*) FROM months) FROM obs"""))
def map_quality_gate(spark, d):
    wanted = geo.eligible(S.establishments(spark, d))
    return geo.quality_report(S.observations(spark, d), expected=wanted, months=A.months(spark), scope=scope(spark, d))


@query("feature_table", geo_sql(f"SELECT s.municipality, coalesce(total, 0) AS total, coalesce(companies, 0) AS companies, coalesce(located, 0) AS located, population, {per('coalesce(total, 0)', 'population', 1000)} AS per_1000 FROM scope_ s LEFT JOIN (SELECT municipality, count(*) AS total, count(DISTINCT cnpj_basic) AS companies, count(*) FILTER (WHERE method <> 'UNLOCATED') AS located FROM sel GROUP BY 1) USING (municipality) LEFT JOIN pop USING (municipality)"))
def feature_table(spark, d):
    return maps.features_by_municipality(maps.by_municipality_of_sets(now_sets(spark, d)), scope(spark, d), geo.latest_population(population(spark, d), scope(spark, d)))


@query("point_features", geo_sql("SELECT municipality || '/' || postal AS id, '[' || CAST(longitude AS DOUBLE) || ',' || CAST(latitude AS DOUBLE) || ']' AS coordinates, total FROM (" + _POSTAL + ")"))
def point_features(spark, d):
    lines = maps.features(maps.postal_clusters(now(spark, d)), F.concat_ws("/", "municipality", "postal"))
    return lines.select("id", F.get_json_object("feature", "$.geometry.coordinates").alias("coordinates"), F.get_json_object("feature", "$.properties.total").cast("long").alias("total"))


@query("haversine", f"SELECT c_custkey, round({hav('-20 + c_custkey % 100 * 0.01::DOUBLE', '-48 + c_custkey % 77 * 0.02::DOUBLE', '-19.5::DOUBLE', '-47.25::DOUBLE')}, 3) AS metres FROM customer")
def haversine(spark, d):
    key = F.col("c_custkey")
    return A.table(spark, d, "customer").select("c_custkey", F.round(show.haversine(F.lit(-20) + key % 100 * F.lit(0.01), F.lit(-48) + key % 77 * F.lit(0.02), F.lit(-19.5), F.lit(-47.25)), 3).alias("metres"))
