import hashlib
import hmac
import json
import re
import unicodedata

from pyspark.sql import functions as F

from tidemark.functions import ids, keys, show, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text(spark):
    row = one(
        spark, text.search_text(F.lit("  Ação & Cia. S/A Nº 5 ")).alias("s"), text.without_documents(F.lit("JOAO ***456789** SILVA 123.456.789-09")).alias("d"), text.without_documents(F.lit("LOJA 123456789012")).alias("long"),
        text.address_text(F.lit("  Av. João  Pinheiro ")).alias("a"), text.address_number(F.lit("00042")).alias("n"), text.address_number(F.lit("s/n")).alias("sn"), text.address_postal_code(F.lit("38.400-130")).alias("p"), text.address_postal_code(F.lit(None).cast("string")).alias("none"),
    )
    assert row.asDict() == {"s": "acao cia s a no 5", "d": "JOAO SILVA", "long": "LOJA 123456789012", "a": "AV JOAO PINHEIRO", "n": "42", "sn": "", "p": "38400130", "none": ""}


def test_whole_code_page(spark):
    """Every character of the source's code page as Unicode's decomposition says, within a word and alone."""
    def plain(x):
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    def search(x):
        return " ".join("".join(c.lower() if c.isalnum() else " " for c in plain(x)).split())

    def address(x):
        return " ".join(re.sub("[^A-Z0-9]+", " ", plain(x.strip().upper())).split())

    texts = [w for c in text.CODE_PAGE for w in (c, f"1{c}", f"a{c}b", f"RUA {c}{c} 7")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.search_text(F.col("t")).alias("s"), text.address_text(F.col("t")).alias("a")).collect()
    assert [(r.t, r.s, r.a) for r in rows] == [(t, search(t), address(t)) for t in texts]


def test_source_fields(spark):
    row = one(spark, text.source_date(F.lit("00000000")).alias("zero"), text.source_date(F.lit("19980230")).alias("bad"), text.bad_date(F.lit("19980230")).alias("is_bad"), text.money(F.lit("1000,5")).alias("m"), text.bad_money(F.lit("x")).alias("bm"), text.flag(F.lit(" ")).alias("f"), text.bad_flag(F.lit("X")).alias("bf"))
    assert (row.zero, row.bad, row.is_bad, str(row.m), row.bm, row.f, row.bf) == (None, None, True, "1000.50", True, None, True)


def test_check_digits(spark):
    row = one(spark, ids.valid_full(F.lit("12.ABC.345/01DE-35")).alias("a"), ids.valid_full(F.lit("ABCDEF12345680")).alias("b"), ids.valid_full(F.lit("ABCDEF12345681")).alias("c"), ids.valid_full(F.lit("00000000000000")).alias("d"), ids.root(F.lit("abcdef12345680")).alias("r"), ids.formatted(F.lit("ABCDEF12345680")).alias("f"), ids.valid_full(F.lit(None).cast("string")).alias("n"))
    assert (row.a, row.b, row.c, row.d, row.r, row.f, row.n) == (True, True, False, False, "ABCDEF12", "AB.CDE.F12/3456-80", False)


def test_keys(spark):
    row = one(spark, keys.hmac_sha256(F.lit("PF\x1f1\x1fé"), b"secret").alias("h"))
    assert row.h == hmac.new(b"secret", "PF\x1f1\x1fé".encode(), hashlib.sha256).hexdigest()
    df = spark.sql("SELECT 'á\"' AS b, true AS a, CAST(1 AS decimal(18,2)) AS c, CAST(NULL AS date) AS d, DATE '1998-01-01' AS competence")
    want = json.dumps({"a": True, "b": 'á"', "c": "1.00", "d": None}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert df.select(keys.record_hash(df)).first()[0] == hashlib.sha256(want.encode()).hexdigest()


def test_partner_identity(spark):
    def made(kind, name, sid):
        found = keys.partner_identity(F.lit("11111111"), F.lit(kind), F.lit(name), F.lit(sid).cast("string"), F.lit(None).cast("string"), b"k")
        return one(spark, *[c.alias(n) for n, c in found.items()])

    assert made("PJ", "X", "66666666").partner_key == made("PJ", "Y", "66.666.666").partner_key
    assert made("PJ", "X", None).warning == "PJ_WITHOUT_VALID_CNPJ:11111111"
    assert made("PF", "José", None).partner_key == made("PF", "JOSE", None).partner_key
    assert made("PF", "José", None).warning == "PF_WITHOUT_SOURCE_IDENTIFIER:11111111"


def test_show(spark):
    row = one(spark, show.currency(F.lit("1234567.5").cast("decimal(18,2)")).alias("m"), show.currency(F.lit(None).cast("decimal(18,2)")).alias("none"), show.cnae_code(F.lit("4711302")).alias("c"), show.share(F.lit(1), F.lit(0)).alias("z"), show.event_value(F.lit("PARTNER_ADDED"), F.lit(None).cast("string"), True).alias("absent"), show.capital(F.lit('{"share_capital":"None"}')).alias("cap"), show.tax_profile(F.lit(None).cast("boolean"), F.lit(False)).alias("tax"))
    assert (row.m, row.none, row.c, row.z, row.absent, row.cap, row.tax) == ("R$ 1.234.567,50", "Não informado", "4711-3/02", None, "Participação ainda não registrada", None, "UNKNOWN")


def test_warning_parts(spark):
    row = one(spark, *[c.alias(n) for n, c in show.warning_parts(F.lit("SOURCE_ZERO_DATE:partners.entry_date:17")).items()])
    assert tuple(row) == ("SOURCE_ZERO_DATE", "partners.entry_date", 17, "PARTICIPATION")


def test_any_event_as_text(spark):
    payload = F.lit('{"street_name":"NORTH","mei_optant":true,"odd_field":false,"empty":"","none":null,"n":12}')
    row = one(spark, show.event_value(F.lit("SOMETHING_NEW"), payload, True).alias("v"), show.event_value(F.lit("X"), F.lit("{}"), True).alias("none"), show.event_label(F.lit("SOMETHING_NEW_HERE"), payload, payload).alias("l"))
    assert tuple(row) == ("Logradouro: NORTH · Situação: Sim · Odd field: Não · N: 12", "Sem informação", "Something new here")
