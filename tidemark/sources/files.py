"""Source files as DataFrames; paths are whatever Spark reads, globs included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text

# The columns of the source's headerless files.
LAYOUTS = {
    "companies": "cnpj_basic legal_name legal_nature_code responsible_qualification share_capital company_size_code federative_entity".split(),
    "establishments": "cnpj_basic cnpj_order cnpj_digits branch_type trade_name registration_status_code registration_status_date registration_status_reason_code foreign_city country_code activity_start_date main_cnae_code secondary_cnae_codes street_type street_name street_number address_complement neighborhood postal_code state_code municipality_tom_code area_code_1 phone_1 area_code_2 phone_2 fax_area_code fax email special_status special_status_date".split(),
    "partners": "cnpj_basic partner_type_code display_name source_id qualification_code entry_date country_code representative_id representative_name representative_qualification_code age_band".split(),
    "tax_regime": "cnpj_basic simples_optant simples_option_date simples_exclusion_date mei_optant mei_option_date mei_exclusion_date".split(),
}
#: Bytes 0x80 to 0x9F of the Windows code page; U+FFFD where it has nothing.
WINDOWS = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"
LOST = "�"


def shards(spark: SparkSession, path: str | list[str], layout: str) -> DataFrame:
    """All columns as text (empty is null) with the Windows code page decoded and undefined bytes as U+FFFD, and source_file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in LAYOUTS[layout]])
    raw = spark.read.schema(schema).csv(path, sep=";", quote='"', escape='"', nullValue="", encoding="iso-8859-1", mode="PERMISSIVE")
    control = "".join(map(chr, range(0x80, 0xA0)))
    return raw.select(*[F.translate(c, control, WINDOWS).alias(c) for c in LAYOUTS[layout]], F.input_file_name().alias("source_file"))


def encoding_losses(df: DataFrame) -> DataFrame:
    """source_file and replacements: characters that the code page has no meaning for, of files with any."""
    whole = F.concat_ws("", *[c for c in df.columns if c != "source_file"])
    lost = F.length(whole) - F.length(F.replace(whole, F.lit(LOST), F.lit("")))
    return df.groupBy("source_file").agg(F.sum(lost).alias("replacements")).filter("replacements > 0")


def municipality_names(spark: SparkSession, path: str, least: int = 5_000) -> DataFrame:
    """tom and name; four-digit codes only, and an error if there are too few."""
    raw = spark.read.schema("tom string, name string, rest string").csv(path, sep=";", quote='"', encoding="iso-8859-1")
    rows = raw.filter("rest IS NULL AND name IS NOT NULL").filter(F.col("tom").rlike(r"^\d{4}$")).select("tom", "name")
    return enough(rows, least, "municipality names")


def enough(rows: DataFrame, least: int, what: str) -> DataFrame:
    if (n := rows.count()) < least:
        raise ValueError(f"{n} {what}; {least} at least are needed")
    return rows


def ibge_catalogue(spark: SparkSession, path: str, least: int = 5_000) -> DataFrame:
    """name_search, uf, ibge and name of municipalities from nested JSON; an error on repeated names of a state."""
    uf = "STRUCT<UF: STRUCT<sigla: STRING>>"
    schema = f"id LONG, nome STRING, microrregiao STRUCT<mesorregiao: {uf}>, `regiao-imediata` STRUCT<`regiao-intermediaria`: {uf}>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(F.lpad(F.col("id").cast("string"), 7, "0").alias("ibge"), F.col("nome").alias("name"), F.coalesce(F.col("microrregiao.mesorregiao.UF.sigla"), F.col("`regiao-imediata`.`regiao-intermediaria`.UF.sigla")).alias("uf"))
    rows = enough(rows.filter("ibge IS NOT NULL AND name IS NOT NULL AND uf IS NOT NULL").withColumn("name_search", text.search_text(F.col("name"))), least, "municipalities")
    twice = rows.groupBy("name_search", "uf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated municipalities: {[(r.name_search, r.uf) for r in twice]}")
    return rows.select("name_search", "uf", "ibge", "name")


def scope(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """municipio, codigo_ibge, codigo_tom and uf of the region's closed set, by IBGE code."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    if rows.columns != ["municipio", "codigo_ibge", "codigo_tom", "uf"]:
        raise ValueError(f"unexpected header: {rows.columns}")
    bad = ~(F.col("codigo_ibge").rlike(r"^\d{7}$") & F.col("codigo_tom").rlike(r"^\d{4}$") & F.col("uf").rlike("^[A-Z]{2}$"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("codigo_ibge").alias("i"), F.countDistinct("codigo_tom").alias("t"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad")).first()
    if (seen.n, seen.i, seen.t, seen.bad) != (expected, expected, expected, 0):
        raise ValueError(f"the scope isn't {expected} distinct municipalities: {seen.asDict()}")
    return rows.orderBy("codigo_ibge")


#: Rough bounds of coordinates (west, south, east, north), and the columns that are read.
BOUNDS = (-52.5, -23.5, -39.0, -13.0)
ADDRESS_COLUMNS = "COD_UNICO_ENDERECO COD_MUNICIPIO CEP NOM_TITULO_SEGLOGR NOM_SEGLOGR NUM_ENDERECO LATITUDE LONGITUDE NV_GEO_COORD".split()


def refuse(bad: DataFrame, what: str) -> None:
    """Raise if there are bad rows (where, problem), with a few of them."""
    if few := bad.limit(5).collect():
        raise ValueError(f"{what}: " + "; ".join(f"{r.problem} in {r.where}" for r in few))


def address_reference(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Candidates of operators.geo from one file for each municipality, named by its code.

    An error on rows of other municipalities than their file's, without a code, or whose point or level doesn't parse, or
    lies outside BOUNDS or 1 to 6."""
    raw = spark.read.csv(path, sep=";", header=True, inferSchema=False)
    missing = [c for c in ADDRESS_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    lat, lon, level = F.col("LATITUDE").try_cast("double"), F.col("LONGITUDE").try_cast("double"), F.col("NV_GEO_COORD").try_cast("int")
    west, south, east, north = BOUNDS
    city, code = F.trim(F.coalesce("COD_MUNICIPIO", F.lit(""))), F.trim(F.coalesce("COD_UNICO_ENDERECO", F.lit("")))
    problem = (
        F.when(city != stem, F.concat(F.lit("municipality "), city))
        .when(lat.isNull() | lon.isNull() | level.isNull(), "a point or level that doesn't parse")
        .when(~(lon.between(west, east) & lat.between(south, north)), "a point out of bounds")
        .when(~level.between(1, 6), "a level out of bounds")
        .when(code == "", "no address code")
    )
    refuse(raw.select(F.input_file_name().alias("where"), problem.alias("problem")).filter("problem IS NOT NULL"), "address reference")
    return raw.select(city.alias("ibge"), F.col("CEP").alias("postal"), F.coalesce("NOM_TITULO_SEGLOGR", F.lit("")).alias("title"), F.coalesce("NOM_SEGLOGR", F.lit("")).alias("street"), F.coalesce("NUM_ENDERECO", F.lit("")).alias("number"), code.alias("address_code"), lat.alias("latitude"), lon.alias("longitude"), level.alias("level"))


def boundaries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """municipality (the file's name), geometry (JSON), west, south, east, north and the centre, from a collection of one feature, a feature or a geometry."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.(?:geo)?json$", 1).alias("municipality"), F.col("value").alias("json"))
    at = lambda p: F.get_json_object("json", p)
    several = at("$.features[1]").isNotNull()
    geometry = F.when(several, F.lit(None)).otherwise(F.coalesce(at("$.features[0].geometry"), at("$.geometry"), F.when(at("$.coordinates").isNotNull(), F.col("json"))))
    rows = raw.select("municipality", geometry.alias("geometry"))
    kind = F.get_json_object("geometry", "$.type")
    body = F.get_json_object("geometry", "$.coordinates")
    polygon = F.flatten(F.from_json(body, "array<array<array<double>>>"))
    multi = F.flatten(F.flatten(F.from_json(body, "array<array<array<array<double>>>>")))
    points = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi)
    boxed = rows.withColumn("points", points).filter("points IS NOT NULL AND size(points) > 0")
    x, y = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    out = boxed.select("municipality", "geometry", F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north"))
    return out.withColumns({"latitude": F.round((F.col("south") + F.col("north")) / 2, 6), "longitude": F.round((F.col("west") + F.col("east")) / 2, 6)})


#: Fixed value: the first field of the population table's header row.
POPULATION_HEADER = "Município (Código)"


def population(spark: SparkSession, path: str, expected: list[str], year: int = 2022, variable: str = "93") -> DataFrame:
    """municipality, year, source and population of the expected municipalities (a region's closed set).

    But for the header row, an error on any other municipality, variable or year, on values that are no positive number,
    and on municipalities that come twice or not at all."""
    raw = spark.read.schema("D1C string, D2C string, D3C string, V string").option("multiLine", True).json(path)
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = raw.filter(t("D1C") != POPULATION_HEADER)
    problem = (
        F.when(~t("D1C").isin(expected), "an unknown municipality")
        .when((t("D2C") != variable) | (t("D3C") != str(year)), "another variable or year")
        .when(~t("V").rlike("^[0-9]+$") | (t("V").try_cast("long") <= 0), "a bad population")
    )
    refuse(rows.select(t("D1C").alias("where"), problem.alias("problem")).filter("problem IS NOT NULL"), "population")
    out = rows.select(t("D1C").alias("municipality"), F.lit(year).alias("year"), F.lit("census").alias("source"), t("V").cast("long").alias("population"))
    seen = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("municipality").alias("distinct")).first()
    if (seen.n, seen.distinct) != (len(set(expected)), len(set(expected))):
        raise ValueError(f"population: {seen.n} rows of {seen.distinct} municipalities, {len(set(expected))} are expected")
    return out


def cnae_catalogue(spark: SparkSession, path: str, least: int = 1_000) -> DataFrame:
    """code and description (blanks collapsed); of repeated codes the last description of the file. An error on bad codes, empty descriptions and too few activities."""
    raw = spark.read.schema("id string, descricao string").option("multiLine", True).json(path)
    # a file is one task's, so its rows are numbered in their order
    rows = raw.select(F.trim(F.coalesce("id", F.lit(""))).alias("code"), F.trim(F.regexp_replace(F.coalesce("descricao", F.lit("")), r"\s+", " ")).alias("description"), F.monotonically_increasing_id().alias("place"))
    problem = F.when(~F.col("code").rlike(r"^[0-9]{7}$"), "a bad code").when(F.col("description") == "", "no description")
    refuse(rows.select(F.col("code").alias("where"), problem.alias("problem")).filter("problem IS NOT NULL"), "activities")
    return enough(rows.groupBy("code").agg(F.max_by("description", "place").alias("description")), least, "activities")


def snapshots(spark: SparkSession, path: str, contract) -> DataFrame:
    """A package's table, in the contract's types."""
    return spark.read.schema(contract.schema).parquet(path)
