"""The given tables as a registry: customers are companies, orders establishments, suppliers partners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import keys
from tidemark.operators import spans
from tidemark.operators.contracts import COMPANIES, ESTABLISHMENTS, PARTNERS, conform

FIRST, LAST = "1998-01-01", "1999-01-01"
SECRET = b"a secret for tests"
REGION = ("AFRICA", "ASIA")
#: Parts that the rows of a registry are kept in, at least, where spark.tidemark.buckets doesn't say; and the bytes of given tables for each.
BUCKETS, BUCKET_BYTES = 8, 8 << 20
GIVEN = ("customer", "orders", "lineitem", "supplier", "part", "nation", "region")
_PARTS: dict[tuple[str, str], int] = {}
#: Tables of which a month may have several rows of one identity: ids of establishments hold the last six digits of an order's key.
REPEATED = ("establishments",)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def buckets(spark: SparkSession, d: str) -> int:
    """Into how many parts snapshots are shuffled and stored: with the tables' size, by doubling, so that a part is sorted in memory; as first seen by the application."""
    said, key = spark.conf.get("spark.tidemark.buckets", None), (spark.sparkContext.applicationId, d)
    if said:
        return int(said)
    if key not in _PARTS:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{d}/{name}.parquet" for name in GIVEN])
        held, n = files.agg(F.sum("length")).first()[0] or 0, BUCKETS
        while n * BUCKET_BYTES < held:
            n *= 2
        _PARTS[key] = n
    return _PARTS[key]


def months(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("competence"))


def root(key: Column) -> Column:
    return F.lpad(key.cast("string"), 8, "0")


def of_share(df: DataFrame, key: str, share: tuple[int, int] | None) -> DataFrame:
    """Rows whose key is of the i-th share of n (share: i, n; None: all), told by another hash than shuffles go by."""
    return df if share is None else df.filter(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(share[1])) == share[0])


def orders(spark: SparkSession, d: str, share: tuple[int, int] | None = None, by: str = "o_orderkey") -> DataFrame:
    o = of_share(table(spark, d, "orders"), by, share)
    return o.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("od"), F.col("o_orderstatus").alias("st"), F.substring("o_orderpriority", 1, 1).alias("pr"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


def first_month(day: Column) -> Column:
    """The first month of the window that begins on day or after it; one after the window's end where none does."""
    return F.greatest(F.add_months(F.trunc(F.date_sub(day, 1), "month"), 1), F.lit(FIRST).cast("date"))


def each_month(first: Column, last: Column) -> Column:
    """A row for each month from first to last, none where last comes first."""
    return F.explode(F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))))


def from_month(df: DataFrame, day: Column, last: Column | None = None) -> DataFrame:
    """A row of df for each month of the window from the first that begins on day or after it, up to last (by default the window's end)."""
    end = F.lit(LAST).cast("date") if last is None else F.least(last, F.lit(LAST).cast("date"))
    return df.withColumn("competence", each_month(first_month(day), end))


def companies(spark: SparkSession, d: str) -> DataFrame:
    """Companies of every month from their orders up to it."""
    return conform(spans.by_month(company_spans(spark, d)), COMPANIES)


def company_spans(spark: SparkSession, d: str, share: tuple[int, int] | None = None) -> DataFrame:
    """Companies (or a share of them) of one content each, with their months.

    Orders are shuffled once, by id, into the parts that snapshots are stored in; months come last, as a company's content
    changes only in those that an order begins to count in."""
    end = F.lit(LAST).cast("date")
    counted = orders(spark, d, share, "o_custkey").filter(F.col("od") <= end).withColumn("cnpj_basic", root(F.col("o_custkey"))).repartition(buckets(spark, d), "cnpj_basic")
    begun = counted.groupBy("cnpj_basic", "o_custkey", first_month(F.col("od")).alias("first")).agg(F.sum("price").alias("price"), F.max(F.struct("od", "o_orderkey", "pr", "st")).alias("last"))
    # of two months' orders the later month's are later, so a run's last order is its first month's
    upto = W.partitionBy("cnpj_basic", "o_custkey").orderBy("first")
    state = begun.select("cnpj_basic", "o_custkey", "first", F.add_months(F.lead("first").over(upto), -1).alias("until"), F.sum("price").over(upto).cast("decimal(18,2)").alias("share_capital"), "last")
    simples, mei, day = F.col("last.pr").isin("1", "2"), F.col("last.st") == "F", F.col("last.od")
    known = of_share(table(spark, d, "customer"), "c_custkey", share).select(root(F.col("c_custkey")).alias("cnpj_basic"), "c_custkey", "c_name")
    named = state.join(known, "cnpj_basic").filter("o_custkey = c_custkey")
    rows = named.select(
        "cnpj_basic", F.upper("c_name").alias("legal_name"), F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", " ").alias("legal_name_search"), F.col("last.pr").alias("legal_nature_code"), "share_capital",
        F.floor(F.col("share_capital") / 500000).cast("string").alias("company_size_code"), simples.alias("simples_optant"), F.when(simples, day).alias("simples_option_date"), F.when(~simples, day).alias("simples_exclusion_date"),
        mei.alias("mei_optant"), F.when(mei, day).alias("mei_option_date"), F.when(~mei, day).alias("mei_exclusion_date"), "first", F.coalesce("until", end).alias("until"),
    )
    return spans.conform(with_months(rows), COMPANIES)


def with_months(runs: DataFrame) -> DataFrame:
    """Rows of content that holds from first until a month, hashed once, with the months."""
    hashed = runs.withColumn("record_hash", keys.record_hash(runs, ("first", "until", "hides")))
    return hashed.filter("first <= until").withColumn(spans.MONTHS, F.sequence("first", "until", F.expr("INTERVAL 1 MONTH"))).drop("first", "until")


def nations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("tom"), (F.col("n_nationkey") * 17 + 3100000).cast("string").alias("ibge"), F.col("n_name").alias("city"), F.substring("r_name", 1, 2).alias("uf"), F.col("r_name").isin(*REGION).alias("inside"))


def lines(spark: SparkSession, d: str, share: tuple[int, int] | None = None, by: str = "l_orderkey") -> DataFrame:
    return of_share(table(spark, d, "lineitem"), by, share).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("date").alias("ship"))


def line_runs(spark: SparkSession, d: str, share: tuple[int, int] | None = None) -> DataFrame:
    """Orders of the window (or a share of them) with first and until of each run of months that has one latest line, and that line as x (null before any).

    Lines and orders meet once by order; of an order's lines one for each month of the window is kept at most."""
    o, start, end = orders(spark, d, share).filter(F.col("od") <= F.lit(LAST)), F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")
    shipped, latest_of = lines(spark, d, share).filter(F.col("ship") <= end), F.max(F.struct("ship", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "flag")).alias("x")
    # the latest line can be told before its order is met: if it isn't after the order's day, no line is; most lines are from before the window, and go before the shuffle
    before = shipped.filter(F.col("ship") <= start).groupBy("l_orderkey").agg(latest_of)
    latest = shipped.filter(F.col("ship") > start).repartition("l_orderkey").groupBy("l_orderkey", first_month(F.col("ship")).alias("first")).agg(latest_of)
    x = F.struct("x.ship", "x.l_partkey", "x.l_suppkey", "x.flag")
    states = latest.groupBy("l_orderkey").agg(F.collect_list(F.struct("first", x.alias("x"))).alias("states"))  # one for each month at most
    none = F.array(F.struct(F.lit(FIRST).cast("date").alias("first"), F.lit(None).cast(latest.select(x.alias("x")).schema["x"].dataType).alias("x")))
    present = first_month(F.when(F.col("o_orderkey") % 40 == 0, F.add_months("od", 1)).otherwise(F.col("od")))
    own = o.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "od", "c_nationkey")
    old = before.select(F.col("l_orderkey").alias("o_orderkey"), F.array(F.struct(start.alias("first"), x.alias("x"))).alias("old"))
    both = own.join(old, "o_orderkey", "left").join(states.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    some = F.filter(F.concat(F.coalesce("old", F.array()), F.coalesce(F.array_sort("states"), F.array())), lambda s: s["x"]["ship"] > F.col("od"))
    all_ = both.select("o_orderkey", "o_custkey", "od", "c_nationkey", F.concat(none, some).alias("states"))
    run = lambda s, i: F.struct(F.greatest(s["first"], present).alias("first"), F.coalesce(F.add_months(F.get("states", i + 1)["first"], -1), end).alias("until"), s["x"].alias("x"))
    runs = all_.select("o_orderkey", "o_custkey", "od", "c_nationkey", F.explode(F.filter(F.transform("states", run), lambda r: r["first"] <= r["until"])).alias("r"))
    return runs.select("o_orderkey", "o_custkey", "od", "c_nationkey", "r.*")


def establishments(spark: SparkSession, d: str) -> DataFrame:
    """Establishments of every month in the state of their latest line up to it."""
    return conform(spans.by_month(establishment_spans(spark, d)), ESTABLISHMENTS)


def establishment_spans(spark: SparkSession, d: str, share: tuple[int, int] | None = None) -> DataFrame:
    """Establishments (or those of a share of the orders) of one content each, with their months.

    What is shuffled by id are runs of months with one latest line, narrow; texts, hashes and months are made where they are stored."""
    number = lambda c: c.cast("long").cast("string")
    runs = line_runs(spark, d, share).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("x.l_suppkey") == F.col("s_suppkey"), "left")
    runs = runs.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("x.l_partkey") == F.col("p_partkey"), "left")
    cnpj = F.concat(root(F.col("o_custkey")), F.lpad(number(F.col("o_orderkey") % 1000000), 6, "0"))
    narrow = runs.select(cnpj.alias("cnpj"), "o_orderkey", "o_custkey", "od", F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "p_brand", "x", "first", "until").repartition(buckets(spark, d), "cnpj")
    rows = narrow.join(F.broadcast(nations(spark, d)), F.col("nation") == F.col("n_nationkey"))
    supp, part = F.coalesce("x.l_suppkey", F.lit(0)), F.coalesce("x.l_partkey", F.lit(0))
    shown = F.when(F.col("hides"), F.array_remove(spans.MONTHS, F.lit("1998-06-01").cast("date"))).otherwise(F.col(spans.MONTHS))
    out = rows.select(
        "cnpj", root(F.col("o_custkey")).alias("cnpj_basic"), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("2").alias("branch_type"),
        F.concat(F.lit("LOJA "), number(F.col("o_orderkey"))).alias("trade_name"), F.concat(F.lit("loja "), number(F.col("o_orderkey"))).alias("trade_name_search"),
        F.when(F.col("x.flag") == "R", "08").when(F.col("x.flag") == "A", "03").otherwise("02").alias("registration_status_code"), F.col("x.ship").alias("registration_status_date"), F.lit(None).cast("string").alias("registration_status_reason_code"),
        F.col("od").alias("activity_start_date"), F.lpad(F.regexp_replace("p_brand", "[^0-9]", ""), 7, "0").alias("main_cnae_code"), F.lit("RUA").alias("street_type"), F.concat(F.lit("Rua São "), number(supp % 40)).alias("street_name"), number(part % 30).alias("street_number"),
        F.lit("").alias("address_complement"), F.concat(F.lit("BAIRRO "), number(part % 7)).alias("neighborhood"), number(F.lit(30000000) + supp % 40 * 100 + part % 3).alias("postal_code"), F.col("uf").alias("state_code"),
        F.col("tom").alias("municipality_tom_code"), F.col("ibge").alias("municipality_ibge_code"), F.col("city").alias("municipality_name"), F.col("inside").alias("is_in_region"), "first", "until", (F.col("o_orderkey") % 1500 == 7).alias("hides"),
    )
    return spans.conform(with_months(out).withColumn(spans.MONTHS, shown).filter(F.size(spans.MONTHS) > 0), ESTABLISHMENTS)


def partner_rows(spark: SparkSession, d: str, share: tuple[int, int] | None = None) -> DataFrame:
    """Suppliers (or a share of them) of a customer's lines shipped in the three months up to each month, with their source_id.

    Lines outside the window aren't shuffled; the others go by company into the parts that snapshots are stored in, before months multiply them."""
    near = lines(spark, d, share, "l_suppkey").filter((F.col("ship") > F.add_months(F.lit(FIRST).cast("date"), -3)) & (F.col("ship") <= F.lit(LAST).cast("date")))
    sold = near.join(orders(spark, d).select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("cnpj_basic", root(F.col("o_custkey"))).drop("o_orderkey").repartition(buckets(spark, d), "cnpj_basic")
    seen = from_month(sold, F.col("ship"), F.add_months(F.date_sub("ship", 1), 3)).filter(F.col("ship") > F.add_months("competence", -3))
    state = seen.groupBy("cnpj_basic", "o_custkey", "l_suppkey", "competence").agg(F.max(F.struct("ship", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "flag")).alias("last"), F.min("ship").alias("entry_date"))
    kind = F.element_at(F.array(F.lit("PJ"), F.lit("PF"), F.lit("FOREIGN")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return state.select("cnpj_basic", kind.alias("partner_type"), F.concat(F.lit("SÓCIO "), "l_suppkey").alias("display_name"), F.when(F.col("l_suppkey") % 5 != 4, root(F.col("l_suppkey"))).alias("source_id"), F.when(F.col("l_suppkey") % 3 == 2, "105").alias("country_code"), F.col("last.flag").alias("qualification_code"), "entry_date", "competence")


def partners(spark: SparkSession, d: str) -> DataFrame:
    return conform(spans.by_month(partner_spans(spark, d)), PARTNERS)


def partner_spans(spark: SparkSession, d: str, share: tuple[int, int] | None = None) -> DataFrame:
    """Partners (or those of a share of the suppliers) of one content each, with their months; keys and hashes are made once for each."""
    rows = spans.gathered(partner_rows(spark, d, share))
    found = keys.partner_identity(F.col("cnpj_basic"), F.col("partner_type"), F.col("display_name"), F.col("source_id"), F.col("country_code"), SECRET)
    out = rows.withColumns({n: found[n] for n in ("partner_key", "partner_cnpj_basic")}).drop("source_id")
    return spans.conform(out.withColumn("record_hash", keys.record_hash(out, ("record_hash", spans.MONTHS))), PARTNERS)


# ---- the same in SQL

_PAD = SECRET.ljust(64, b"\0")
_IN, _OUT = (bytes(b ^ x for b in _PAD).hex() for x in (0x36, 0x5C))


def _json(columns: str, alias: str = "r") -> str:
    """Canonical JSON of named columns: sorted keys, all but booleans as text."""
    fields = sorted(columns.split())
    one = lambda c: f"'{c.rstrip('?')}': {alias}.{c.rstrip('?')}" if c.endswith("?") else f"'{c}': CAST({alias}.{c} AS VARCHAR)"
    return "CAST(to_json({" + ", ".join(map(one, fields)) + "}) AS VARCHAR)"


C = "cnpj_basic legal_name legal_name_search legal_nature_code share_capital company_size_code simples_optant? simples_option_date simples_exclusion_date mei_optant? mei_option_date mei_exclusion_date"
E = "cnpj cnpj_basic branch_type trade_name trade_name_search registration_status_code registration_status_date registration_status_reason_code activity_start_date main_cnae_code street_type street_name street_number address_complement neighborhood postal_code state_code municipality_tom_code municipality_ibge_code municipality_name is_in_region?"
P = "cnpj_basic partner_key partner_type display_name partner_cnpj_basic country_code qualification_code entry_date"
U = "chr(31)"

SQL = f"""
months AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 MONTH)) AS DATE) AS competence),
o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS od, o_orderstatus AS st, o_orderpriority[1:1] AS pr, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders),
li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag AS flag, CAST(l_shipdate AS DATE) AS ship FROM lineitem),
company0 AS (SELECT o_custkey, competence, CAST(sum(price) AS DECIMAL(18,2)) AS share_capital, arg_max(pr, od::VARCHAR || lpad(o_orderkey::VARCHAR, 18, '0')) AS pr,
               arg_max(st, od::VARCHAR || lpad(o_orderkey::VARCHAR, 18, '0')) AS st, max(od) AS day FROM o JOIN months ON od <= competence GROUP BY ALL),
company1 AS (SELECT lpad(o_custkey::VARCHAR, 8, '0') AS cnpj_basic, upper(c_name) AS legal_name, regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') AS legal_name_search, pr AS legal_nature_code, share_capital,
               CAST(CAST(floor(share_capital / 500000) AS BIGINT) AS VARCHAR) AS company_size_code, pr IN ('1', '2') AS simples_optant, CASE WHEN pr IN ('1', '2') THEN day END AS simples_option_date, CASE WHEN pr NOT IN ('1', '2') THEN day END AS simples_exclusion_date,
               st = 'F' AS mei_optant, CASE WHEN st = 'F' THEN day END AS mei_option_date, CASE WHEN st <> 'F' THEN day END AS mei_exclusion_date, competence FROM company0 JOIN customer ON o_custkey = c_custkey),
company AS MATERIALIZED (SELECT *, sha256({_json(C)}) AS record_hash FROM company1 r),
nat AS (SELECT n_nationkey, lpad(n_nationkey::VARCHAR, 4, '0') AS tom, (n_nationkey * 17 + 3100000)::VARCHAR AS ibge, n_name AS city, r_name[1:2] AS uf, r_name IN {REGION} AS inside FROM nation JOIN region ON n_regionkey = r_regionkey),
present AS (SELECT o_orderkey, o_custkey, od, competence FROM o JOIN months ON CASE WHEN o_orderkey % 40 = 0 THEN CAST(od + INTERVAL 1 MONTH AS DATE) ELSE od END <= competence WHERE NOT (competence = DATE '1998-06-01' AND o_orderkey % 1500 = 7)),
lastline AS (SELECT * FROM (SELECT l_orderkey, competence, l_partkey, l_suppkey, flag, ship, row_number() OVER (PARTITION BY l_orderkey, competence ORDER BY ship DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
               FROM li JOIN o ON l_orderkey = o_orderkey AND od < ship JOIN months ON ship <= competence) WHERE rn = 1),
est1 AS (SELECT lpad(o_custkey::VARCHAR, 8, '0') || lpad((p.o_orderkey % 1000000)::VARCHAR, 6, '0') AS cnpj, lpad(o_custkey::VARCHAR, 8, '0') AS cnpj_basic, CASE WHEN p.o_orderkey % 2 = 0 THEN '1' ELSE '2' END AS branch_type,
               'LOJA ' || p.o_orderkey AS trade_name, 'loja ' || p.o_orderkey AS trade_name_search, CASE flag WHEN 'R' THEN '08' WHEN 'A' THEN '03' ELSE '02' END AS registration_status_code, ship AS registration_status_date, CAST(NULL AS VARCHAR) AS registration_status_reason_code,
               od AS activity_start_date, lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 7, '0') AS main_cnae_code, 'RUA' AS street_type, 'Rua São ' || (coalesce(l_suppkey, 0) % 40) AS street_name, (coalesce(l_partkey, 0) % 30)::VARCHAR AS street_number,
               '' AS address_complement, 'BAIRRO ' || (coalesce(l_partkey, 0) % 7) AS neighborhood, (30000000 + coalesce(l_suppkey, 0) % 40 * 100 + coalesce(l_partkey, 0) % 3)::VARCHAR AS postal_code, uf AS state_code,
               tom AS municipality_tom_code, ibge AS municipality_ibge_code, city AS municipality_name, inside AS is_in_region, p.competence
             FROM present p LEFT JOIN lastline l ON p.o_orderkey = l.l_orderkey AND p.competence = l.competence JOIN customer ON o_custkey = c_custkey
             LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey JOIN nat ON coalesce(s_nationkey, c_nationkey) = n_nationkey),
est AS MATERIALIZED (SELECT *, sha256({_json(E)}) AS record_hash FROM est1 r),
partner0 AS (SELECT * FROM (SELECT o_custkey, l_suppkey, competence, flag, min(ship) OVER w AS entry_date, row_number() OVER (w ORDER BY ship DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, flag DESC) AS rn
               FROM li JOIN o ON l_orderkey = o_orderkey JOIN months ON ship <= competence AND ship > CAST(competence - INTERVAL 3 MONTH AS DATE) WINDOW w AS (PARTITION BY o_custkey, l_suppkey, competence)) WHERE rn = 1),
partner1 AS (SELECT lpad(o_custkey::VARCHAR, 8, '0') AS cnpj_basic, CASE l_suppkey % 3 WHEN 0 THEN 'PJ' WHEN 1 THEN 'PF' ELSE 'FOREIGN' END AS partner_type, 'SÓCIO ' || l_suppkey AS display_name, CASE WHEN l_suppkey % 5 <> 4 THEN lpad(l_suppkey::VARCHAR, 8, '0') END AS source_id,
               'socio ' || l_suppkey AS search, CASE WHEN l_suppkey % 3 = 2 THEN '105' END AS country_code, flag AS qualification_code, entry_date, competence FROM partner0),
partner2 AS (SELECT * EXCLUDE (source_id, search), CASE WHEN partner_type = 'PF' THEN sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode('PF' || {U} || cnpj_basic || {U} || coalesce(source_id, search)))))
               WHEN partner_type = 'PJ' AND source_id IS NOT NULL THEN sha256('PJ' || {U} || cnpj_basic || {U} || source_id) ELSE sha256(partner_type || {U} || cnpj_basic || {U} || search || {U} || coalesce(country_code, '')) END AS partner_key,
               CASE WHEN partner_type = 'PJ' THEN source_id END AS partner_cnpj_basic FROM partner1),
partner AS MATERIALIZED (SELECT *, sha256({_json(P)}) AS record_hash FROM partner2 r)
"""


def sql(body: str, *more: str) -> str:
    """A statement over the registry: more are further common tables."""
    return "WITH " + ",\n".join([SQL.strip(), *more]) + "\n" + body


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
