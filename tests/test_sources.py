"""Source files of odd shapes, and packages written and read again."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.test_diff import MAY, company, place, rows
from tidemark.operators import cohort, contracts, geo
from tidemark.operators.contracts import COMPANIES, ESTABLISHMENTS
from tidemark.sources import files, sinks


def test_shards(spark, tmp_path):
    (tmp_path / "c0.csv").write_bytes('"11111111";"JOSÉ ""X"" – €";"2062";"";"1000,50";"03";""\n'.encode("cp1252") + b'"22222222";"A\x81B";"2062";;"";"01";""\n')
    df = files.shards(spark, f"{tmp_path}/*.csv", "companies")
    got = {r.cnpj_basic: r for r in df.collect()}
    assert got["11111111"].legal_name == 'JOSÉ "X" – €' and got["11111111"].federative_entity is None
    assert got["22222222"].legal_name == "A�B"
    assert [r.replacements for r in files.encoding_losses(df).collect()] == [1]


def test_company_rows(spark, tmp_path):
    (tmp_path / "c.csv").write_text('"11111111";"JOAO 123.456.789-09";"2062";"";"1000,5";"03";""\n')
    (tmp_path / "s.csv").write_text('"11111111";"S";"20200101";"00000000";"N";"";"0"\n"11111111";"N";"";"";"N";"";""\n')
    month = F.lit(MAY).alias("competence")
    raw, tax = (files.shards(spark, f"{tmp_path}/{n}.csv", layout).select("*", month) for n, layout in (("c", "companies"), ("s", "tax_regime")))
    out = cohort.company_snapshots(raw, tax)
    r = out.first()
    assert (r.legal_name, str(r.share_capital), r.simples_optant, r.simples_option_date, r.simples_exclusion_date) == ("JOAO", "1000.50", True, date(2020, 1, 1), None)
    assert contracts.schema_differences(out, COMPANIES) == []


def test_catalogues(spark, tmp_path):
    (tmp_path / "n.csv").write_text("0711;LAGOA FRIA\n0002;LONGE\nxx;BAD\n1;SHORT\n")
    assert sorted(r.tom for r in files.municipality_names(spark, f"{tmp_path}/n.csv", 2).collect()) == ["0002", "0711"]
    with pytest.raises(ValueError, match="2 municipality names"):
        files.municipality_names(spark, f"{tmp_path}/n.csv")
    uf = {"UF": {"sigla": "ZZ"}}
    (tmp_path / "i.json").write_text(json.dumps([{"id": 9170206, "nome": "Lagoa Fría", "microrregiao": {"mesorregiao": uf}}, {"id": 9100000, "nome": "Novo", "microrregiao": None, "regiao-imediata": {"regiao-intermediaria": uf}}]))
    got = files.ibge_catalogue(spark, f"{tmp_path}/i.json", 2)
    assert sorted((r.name_search, r.uf, r.ibge) for r in got.collect()) == [("lagoa fria", "ZZ", "9170206"), ("novo", "ZZ", "9100000")]
    people = lambda *rows: (tmp_path / "p.json").write_text(json.dumps([dict(zip(("D1C", "D2C", "D3C", "V"), r, strict=True)) for r in (("Município (Código)", "v", "a", "V"), *rows)]))
    good, other = ("0000042", "93", "2022", "812"), ("0000043", "93", "2022", "9")
    people(good, other)
    assert sorted((r.municipality, r.population) for r in files.population(spark, f"{tmp_path}/p.json", ["0000042", "0000043"]).collect()) == [("0000042", 812), ("0000043", 9)]
    for bad in ((*other[:3], "..."), (*other[:3], "0"), ("0000044", *other[1:]), ("0000043", "94", "2022", "9"), ("0000043", "93", "2021", "9"), good, None):
        people(good, *([bad] if bad else []))
        with pytest.raises(ValueError, match="population"):
            files.population(spark, f"{tmp_path}/p.json", ["0000042", "0000043"])
    acts = lambda *rows: (tmp_path / "a.json").write_text(json.dumps([dict(zip(("id", "descricao"), r, strict=True)) for r in rows]))
    acts(("0000007", "Old"), ("0000008", "Z"), ("0000007", "  Made   by hand "))
    assert sorted(tuple(r) for r in files.cnae_catalogue(spark, f"{tmp_path}/a.json", 2).collect()) == [("0000007", "Made by hand"), ("0000008", "Z")]
    for bad in (("7", "x"), ("0000009", "  "), (None, "x")):
        acts(("0000007", "Old"), bad)
        with pytest.raises(ValueError, match="activities"):
            files.cnae_catalogue(spark, f"{tmp_path}/a.json", 1)
    (tmp_path / "scope.csv").write_text("municipio,codigo_ibge,codigo_tom,uf\nLagoa Fría,9170206,0711,ZZ\n")
    assert files.scope(spark, f"{tmp_path}/scope.csv", 1).count() == 1
    with pytest.raises(ValueError):
        files.scope(spark, f"{tmp_path}/scope.csv", 2)


def test_aliases(spark):
    names = spark.createDataFrame([("1", "BRASOPOLIS"), ("2", "X")], "tom string, name string")
    catalogue = spark.createDataFrame([("brazopolis", "MG", "3108909", "Brazópolis")], "name_search string, uf string, ibge string, name string")
    asked = spark.createDataFrame([("1", "MG"), ("2", "MG"), ("9", "MG")], "tom string, uf string")
    got = {r.tom: r.ibge for r in cohort.resolve_municipalities(asked, names, catalogue).collect()}
    assert got == {"1": "3108909", "2": None, "9": None}


def test_geography(spark, tmp_path):
    ring = [[-48.3, -19.0], [-48.1, -19.0], [-48.1, -18.8], [-48.3, -19.0]]
    polygon = {"type": "Polygon", "coordinates": [ring]}
    (tmp_path / "1.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": polygon}]}))
    (tmp_path / "2.json").write_text(json.dumps({"type": "MultiPolygon", "coordinates": [[ring], [[[0, 0], [1, 1], [0, 0]]]]}))
    got = {r.municipality: r for r in files.boundaries(spark, f"{tmp_path}/*.json").collect()}
    assert (got["1"].west, got["1"].south, got["1"].east, got["1"].north, got["1"].latitude, got["1"].longitude) == (-48.3, -19.0, -48.1, -18.8, -18.9, -48.2)
    assert got["2"].east == 1.0
    head = "COD_UNICO_ENDERECO;COD_MUNICIPIO;CEP;NOM_TITULO_SEGLOGR;NOM_SEGLOGR;NUM_ENDERECO;LATITUDE;LONGITUDE;NV_GEO_COORD\n"
    file = tmp_path / "0000042.csv"
    good = "77;0000042;12345678;;NORTH;7;-20.5;-47.5;2\n"
    file.write_text(head + good)
    assert [(r.address_code, r.level) for r in files.address_reference(spark, str(file)).collect()] == [("77", 2)]
    for bad in ("78;0000043;12345678;;NORTH;7;-20.5;-47.5;2", "78;0000042;12345678;;NORTH;7;x;-47.5;2", "78;0000042;12345678;;NORTH;7;-20.5;-60.5;2", "78;0000042;12345678;;NORTH;7;-20.5;-47.5;7", ";0000042;12345678;;NORTH;7;-20.5;-47.5;2"):
        file.write_text(head + good + bad + "\n")
        with pytest.raises(ValueError, match="address reference"):
            files.address_reference(spark, str(file))


def test_resolution_cascade(spark):
    c = lambda code, lat, level, street="NORTH", number="7": ("0000042", "12345678", "SIR", street, number, code, lat, -48.2, level)
    near = [c("a", -18.9, 3), c("b", -18.9001, 1), c("c", -18.9002, 1)]
    far = [c("d", -18.9, 1, "LONGE", "1"), c("e", -18.905, 1, "LONGE", "1")]
    ref = spark.createDataFrame(near + far, "ibge string, postal string, title string, street string, number string, address_code string, latitude double, longitude double, level int")
    asked = [("0000042", "12345678", s, n) for s, n in (("NORTH", "7"), ("SIR NORTH", "7"), ("LONGE", "1"), ("OUTRA", "1"))] + [("0000042", "1", "X", "1")]
    df = spark.createDataFrame([(f"{i}", *a) for i, a in enumerate(asked)], "fingerprint string, ibge string, postal string, street string, number string")
    got = {r.fingerprint: r for r in geo.resolve(df, ref).collect()}
    assert [got[str(i)].method for i in range(5)] == ["ADDRESS", "ADDRESS", "POSTAL_CODE", "POSTAL_CODE", "UNLOCATED"]
    assert (got["0"].candidate_count, got["0"].level) == (2, 1)
    assert got["2"].reason == "ambiguous_address_postal_fallback" and got["2"].candidate_count == 2
    assert got["4"].reason == "postal_code_not_found" and got["4"].latitude is None


def test_packages(spark, tmp_path):
    c = rows(spark, COMPANIES, [company("11111111", MAY), company("22222222", MAY)])
    sinks.write_snapshots(c, COMPANIES, f"{tmp_path}/companies")
    made = sinks.manifest({"companies": c})
    again = sinks.manifest({"companies": contracts.conform(spark.read.parquet(f"{tmp_path}/companies"), COMPANIES)})
    assert again.exceptAll(made).count() == made.exceptAll(again).count() == 0
    twice = rows(spark, ESTABLISHMENTS, [place("11111111000191", MAY)] * 2)
    with pytest.raises(ValueError, match="repeated_identities"):
        sinks.write_snapshots(twice, ESTABLISHMENTS, f"{tmp_path}/places")


def test_pages(spark):
    """Any page from either end or the middle, and numbers beyond the ends."""
    from tidemark.operators.pages import page

    df = spark.range(1003).select((F.col("id") * 7919 % 1003).alias("k"), (F.col("id") % 5).alias("g")).repartition(5)
    want = sorted(((r.g, -r.k) for r in df.collect()))
    for near in (10_000, 20):
        for number in (-1, 1, 2, 50, 51, 52, 100, 101, 999):
            got = sorted(page(df, [("g", False), ("k", True)], number, 10, near).collect(), key=lambda r: r.place)
            n = min(max(1, number), 101)
            assert [(r.g, -r.k) for r in got] == want[(n - 1) * 10 : n * 10], (near, number)
            assert {(r.page_number, r.pages, r.total) for r in got} == {(n, 101, 1003)} and [r.place for r in got] == list(range((n - 1) * 10 + 1, min(n * 10, 1003) + 1))
    assert page(df.limit(0), [("k", False)], 3, 10).count() == 0


def test_selection(spark):
    from tidemark.operators.maps import Selection

    for bad in ({"size_code": "77"}, {"municipality": "42"}, {"cnae_code": "x"}, {"branch_type": "3"}, {"mode": "dynamics", "opening_months": 3}):
        with pytest.raises(ValueError):
            Selection(MAY, **bad)
    months, scope = spark.createDataFrame([(MAY,)], "competence date"), spark.createDataFrame([("0000042",)], "municipality string")
    assert Selection(MAY, municipality="0000042", size_code="05").known_in(months, scope).municipality == "0000042"
    for bad in (Selection(MAY, municipality="0000043"), Selection(date(2030, 1, 1))):
        with pytest.raises(ValueError, match="unknown"):
            bad.known_in(months, scope)


def test_digests_combine_in_any_order(spark):
    """Content hashes don't depend on order and partitions, and notice a changed, lost or repeated row."""
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("record_hash"), F.lit(MAY).alias("competence"))
    one = lambda x: sinks.manifest({"t": x}).first().content_hash
    assert one(df) == one(df.orderBy("record_hash").repartition(7))
    assert len({one(df), one(df.limit(499)), one(df.unionByName(df.limit(1))), one(df.limit(499).unionByName(df.limit(1)))}) == 4


def test_companies_are_missed_by_year_not_by_row(spark, capsys):
    """Each month that has establishments but not their company, also where years and days differ or are unknown; what is shuffled are a root's months together."""
    months = [date(1999, 12, 1), date(2000, 1, 1), date(2000, 2, 1), date(2004, 12, 1), date(2005, 1, 1), date(2005, 1, 2), None]
    rows = lambda pairs: spark.createDataFrame(pairs, "cnpj_basic string, competence date")
    places = rows([(root, m) for root in ("A", "B", None) for m in months for _ in range(3)])
    firms = rows([("A", m) for m in months[1:]] + [("B", date(2005, 1, 1)), (None, months[0]), ("C", months[0])])
    found = cohort.alone_roots(places, firms)
    want = cohort.orphans(places.distinct(), firms)
    key = lambda df: sorted(map(str, df.select("cnpj_basic", "competence").collect()))
    assert key(found) == key(want) and found.count() == 2 + 6 + 7
    found.explain()
    assert "Exchange hashpartitioning(cnpj_basic" in (plan := capsys.readouterr().out) and "competence" not in plan[plan.rindex("Exchange") :].split("Aggregate")[0]
