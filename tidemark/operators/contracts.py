"""Table contracts of the snapshot packages and the checks that hold rows to them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    """Ordered columns with types (a * marks those that may be null) and the columns that name a row."""

    name: str
    columns: tuple[tuple[str, str], ...]
    identity: tuple[str, ...]

    def __post_init__(self):
        if any("cpf" in name for name, _ in self.columns):
            raise ValueError("no column may name a personal document")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T._parse_datatype_string(kind.rstrip("*")), kind.endswith("*")) for n, kind in self.columns])

    @property
    def required(self) -> list[str]:
        return [n for n, kind in self.columns if not kind.endswith("*")]

    @property
    def hash(self) -> str:
        return hashlib.sha256(json.dumps([self.name, self.columns, self.identity], separators=(",", ":")).encode()).hexdigest()


def _columns(text: str) -> tuple[tuple[str, str], ...]:
    return tuple(tuple(x.split(":")) for x in text.split())


# Names, order, types and identities of the contract's tables.
COMPANIES = Contract(
    "companies",
    _columns(
        "cnpj_basic:string legal_name:string legal_name_search:string legal_nature_code:string* share_capital:decimal(18,2)* company_size_code:string* "
        "simples_optant:boolean* simples_option_date:date* simples_exclusion_date:date* mei_optant:boolean* mei_option_date:date* mei_exclusion_date:date* "
        "competence:date record_hash:string"
    ),
    ("cnpj_basic", "competence"),
)
ESTABLISHMENTS = Contract(
    "establishments",
    _columns(
        "cnpj:string cnpj_basic:string branch_type:string trade_name:string trade_name_search:string registration_status_code:string registration_status_date:date* "
        "registration_status_reason_code:string* activity_start_date:date* main_cnae_code:string* street_type:string street_name:string street_number:string "
        "address_complement:string neighborhood:string postal_code:string state_code:string municipality_tom_code:string municipality_ibge_code:string "
        "municipality_name:string is_in_region:boolean competence:date record_hash:string"
    ),
    ("cnpj", "competence"),
)
PARTNERS = Contract(
    "partners",
    _columns("cnpj_basic:string partner_key:string partner_type:string display_name:string partner_cnpj_basic:string* country_code:string* qualification_code:string* entry_date:date* competence:date record_hash:string"),
    ("cnpj_basic", "partner_key", "competence"),
)


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """df's columns in the contract's order and types; a missing column is an error."""
    return df.select(*[F.col(n).cast(kind.rstrip("*")).alias(n) for n, kind in contract.columns])


def schema_differences(df: DataFrame, contract: Contract) -> list[str]:
    """What keeps df's names, order and types from being exactly the contract's."""
    want = [(n, kind.rstrip("*")) for n, kind in contract.columns]
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return [f"{i}: {a} is not {b}" for i, (a, b) in enumerate(zip(have + [None] * len(want), want + [None] * len(have), strict=False)) if a != b]


def required_nulls(df: DataFrame, contract: Contract) -> Column:
    """Rows with a null in a required column, as an aggregate."""
    return F.count_if(reduce(Column.__or__, [F.col(n).isNull() for n in contract.required]))


def repeated_identities(df: DataFrame, contract: Contract) -> DataFrame:
    return df.groupBy(*contract.identity).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def contract_report(df: DataFrame, contract: Contract, month: Column | None = None) -> DataFrame:
    """One row: table_name, rows, required_nulls, repeated_identities and other_months (rows whose month isn't the one given)."""
    per = df.groupBy(*contract.identity).agg(F.count(F.lit(1)).alias("n"), required_nulls(df, contract).alias("nulls"), F.count_if(F.lit(False) if month is None else F.col("competence") != month).alias("other"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("required_nulls"), F.count_if(F.col("n") > 1).alias("repeated_identities"), F.coalesce(F.sum("other"), F.lit(0)).alias("other_months"))
    return total.select(F.lit(contract.name).alias("table_name"), "*")


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """rule_code and entity_key of each row that breaks a rule (where the rule's column is true), in one pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(F.explode(broken).alias("rule_code"), key.alias("entity_key"))
