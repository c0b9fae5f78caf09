"""Content hashes and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ids
from tidemark.functions.text import search_text

#: Fixed value: what separates the parts of a key.
UNIT = "\u001f"


def record_hash(df: DataFrame, leave_out: tuple[str, ...] = ("competence", "record_hash")) -> Column:
    """SHA-256 of a row as JSON: keys sorted, nulls kept, dates ISO, decimals as fixed text; the month is no content."""
    fields = [f for f in sorted(df.schema.fields, key=lambda f: f.name) if f.name not in leave_out]
    plain = (T.StringType, T.BooleanType, T.IntegerType, T.LongType)
    values = [F.col(f.name) if isinstance(f.dataType, plain) else F.col(f.name).cast("string").alias(f.name) for f in fields]
    return F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Keyed hash; the padded key is a constant of 64 bytes, so the secret is at most as long."""
    if len(secret) > 64:
        raise ValueError("a secret has 64 bytes at most")
    key = secret.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def partner_identity(basic: Column, kind: Column, name: Column, source_id: Column, country: Column, secret: bytes) -> dict[str, Column]:
    """partner_key, partner_cnpj_basic and warning of a partner.

    People (PF) get a keyed hash of the source id, or of the name without one; companies (PJ) with a valid id a hash of
    its root; all others a hash of type, name and country."""
    sid = F.nullif(F.trim(source_id), F.lit(""))
    join = lambda *parts: F.concat_ws(UNIT, *parts)
    person = hmac_sha256(join(F.lit("PF"), basic, F.coalesce(sid, search_text(name))), secret)
    company_root = F.when(kind == "PJ", ids.root(sid))
    named = F.sha2(join(kind, basic, search_text(name), F.coalesce(country, F.lit(""))), 256)
    key = F.when(kind == "PF", person).when(company_root.isNotNull(), F.sha2(join(F.lit("PJ"), basic, company_root), 256)).otherwise(named)
    warning = F.when((kind == "PF") & sid.isNull(), F.concat(F.lit("PF_WITHOUT_SOURCE_IDENTIFIER:"), basic)).when((kind == "PJ") & company_root.isNull(), F.concat(F.lit("PJ_WITHOUT_VALID_CNPJ:"), basic))
    return {"partner_key": key, "partner_cnpj_basic": company_root, "warning": warning}


def event_key(window: Column, from_hash: Column, to_hash: Column, entity_type: Column, entity_key: Column, dimension: Column, event: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, window, from_hash, to_hash, entity_type, entity_key, dimension, event), 256)


def participation_key(basic: Column, partner: Column) -> Column:
    """A pair as text, as it enters the event key."""
    return F.concat(F.lit("('"), basic, F.lit("', '"), partner, F.lit("')"))


def metric_key(revision_hash: Column, metric: Column, *dimensions: Column) -> Column:
    """SHA-256 of the JSON list of hash, metric and dimensions; dimensions may be null."""
    text = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", text(revision_hash), text(metric), *map(text, dimensions)), F.lit("]")), 256)


def address_fingerprint(ibge: Column, postal: Column, street: Column, number: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, ibge, postal, street, number), 256)


def digest_sums(digest: Column) -> Column:
    """An aggregate of hex SHA-256 digests in any order and in fixed space: the exact sums of their four 64-bit words, as text."""
    word = lambda i: F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")
    return F.concat_ws(":", *[F.coalesce(F.sum(word(i)), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)])


def set_hash(df: DataFrame, value: Column) -> DataFrame:
    """One row, n and set_hash, of the distinct values of df in order-free form: of their number and digest_sums()."""
    rows = df.select(value.alias("value")).distinct().select(F.sha2("value", 256).alias("digest"))
    summed = rows.agg(F.count(F.lit(1)).alias("n"), digest_sums(F.col("digest")).alias("sums"))
    return summed.select("n", F.sha2(F.concat_ws(":", "n", "sums"), 256).alias("set_hash"))


def scope_hash(df: DataFrame, *columns: str) -> DataFrame:
    """One row, scope_hash, of a small closed set: SHA-256 of its sorted rows, one to a line."""
    return df.select(F.concat_ws(";", *columns).alias("line")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("scope_hash"))
