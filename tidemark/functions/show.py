"""How codes, amounts, ratios and events are shown."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of codes.
EVENTS = {
    "ADDRESS_CHANGED": "Mudança de endereço",
    "COMPANY_SIZE_CHANGED": "Mudança de porte",
    "ENTERED_REGION": "Entrada na região",
    "ESTABLISHMENT_CLOSED": "Baixa de estabelecimento",
    "ESTABLISHMENT_OPENED": "Abertura de estabelecimento",
    "LEGAL_NATURE_CHANGED": "Mudança de natureza jurídica",
    "LEFT_REGION": "Saída da região",
    "MAIN_CNAE_CHANGED": "Mudança de atividade principal",
    "MEI_STATUS_CHANGED": "Mudança no MEI",
    "PARTNER_ADDED": "Entrada de sócio",
    "PARTNER_QUALIFICATION_CHANGED": "Mudança de qualificação societária",
    "PARTNER_REMOVED": "Saída de sócio",
    "REGISTRATION_STATUS_CHANGED": "Mudança de situação cadastral",
    "SHARE_CAPITAL_CHANGED": "Alteração de capital social",
    "SIMPLES_STATUS_CHANGED": "Mudança no Simples Nacional",
}
FIELDS = {
    "address_complement": "Complemento",
    "company_size_code": "Porte",
    "country_code": "País",
    "display_name": "Sócio",
    "entry_date": "Entrada",
    "legal_nature_code": "Natureza jurídica",
    "main_cnae_code": "CNAE principal",
    "mei_exclusion_date": "Exclusão",
    "mei_optant": "Situação",
    "mei_option_date": "Opção",
    "municipality_ibge_code": "Município IBGE",
    "neighborhood": "Bairro",
    "partner_cnpj_basic": "CNPJ básico do sócio",
    "partner_type": "Tipo",
    "postal_code": "CEP",
    "qualification_code": "Qualificação",
    "registration_status_code": "Situação cadastral",
    "share_capital": "Capital social",
    "simples_exclusion_date": "Exclusão",
    "simples_optant": "Situação",
    "simples_option_date": "Opção",
    "state_code": "UF",
    "street_name": "Logradouro",
    "street_number": "Número",
    "street_type": "Tipo de logradouro",
}
STATUSES = {"01": "Nula", "02": "Ativa", "03": "Suspensa", "04": "Inapta", "08": "Baixada"}
SIZES = {"00": "Não informado", "01": "Microempresa", "03": "Empresa de pequeno porte", "05": "Demais"}
BRANCHES = {"1": "Matriz", "2": "Filial"}
PARTNERS = {"PF": "Pessoa física", "PJ": "Pessoa jurídica", "EX": "Estrangeiro"}
DIMENSIONS = {
    "company_size": "Porte da empresa",
    "legal_nature": "Natureza jurídica",
    "lifecycle": "Ciclo cadastral",
    "location": "Localização",
    "main_cnae": "Atividade principal",
    "mei_status": "MEI",
    "partner_qualification": "Qualificação do sócio",
    "partnership": "Quadro societário",
    "registration_status": "Situação cadastral",
    "share_capital": "Capital social",
    "simples_status": "Simples Nacional",
}


def label(c: Column, labels: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*labels.items()))), c), other)


def size_label(c: Column) -> Column:
    return label(F.coalesce(F.nullif(c, F.lit("")), F.lit("00")), SIZES, F.concat(F.lit("Código "), c))


def status_label(c: Column) -> Column:
    """With the code behind it."""
    return F.when(F.coalesce(c, F.lit("")) == "", "Situação não informada").otherwise(F.concat(label(c, STATUSES, F.lit("Código desconhecido")), F.lit(" ("), c, F.lit(")")))


def cnae_code(c: Column) -> Column:
    """dddd-d/dd; other shapes as they are."""
    return F.regexp_replace(c, r"^(\d{4})(\d)(\d{2})$", "$1-$2/$3")


def cnae_label(code: Column, description: Column) -> Column:
    return F.concat_ws(" — ", cnae_code(code), F.nullif(description, F.lit("")))


def currency(c: Column) -> Column:
    """R$ 1.234.567,50."""
    return F.coalesce(F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,")), F.lit("Não informado"))


def share(part: Column, whole: Column, times: int = 100) -> Column:
    """times * part / whole with two decimals, halves away from zero; null where whole is 0 or either is null.

    Of integers: rounded in decimals, so the result is the same on any engine."""
    exact = (part.cast("decimal(20,0)") * times).cast("decimal(24,0)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.round(exact, 2).cast("decimal(18,2)")


def percentage_change(before: Column, after: Column) -> Column:
    return share(after - before, before)


def tax_profile(simples: Column, mei: Column) -> Column:
    """MEI before SIMPLES before REGULAR; unknown where simples is."""
    return F.when(F.coalesce(mei, F.lit(False)), "MEI").when(simples, "SIMPLES").when(~simples, "REGULAR").otherwise("UNKNOWN")


def opening_range(month: Column, months: int) -> tuple[Column, Column]:
    """First and last day of so many months up to month."""
    return F.add_months(month, 1 - months), F.last_day(month)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_008.8) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def capital(payload: Column) -> Column:
    """The share capital in an event's JSON; null where it doesn't parse."""
    return F.get_json_object(payload, "$.share_capital").try_cast("decimal(18,2)")


def capitalised(code: Column) -> Column:
    """A code as words: underscores are blanks, the first letter upper case, all others lower case."""
    words = F.replace(code, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, F.lit(2), F.length(words))))


def event_label(event: Column, before: Column, after: Column) -> Column:
    """A change of capital is an increase or a reduction where both amounts are known."""
    up, down = capital(after) > capital(before), capital(after) < capital(before)
    plain = label(event, EVENTS, capitalised(event))
    return F.when((event == "SHARE_CAPITAL_CHANGED") & up, "Aumento de capital social").when((event == "SHARE_CAPITAL_CHANGED") & down, "Redução de capital social").otherwise(plain)


def _day(c: Column) -> Column:
    return F.coalesce(F.date_format(c.try_cast("date"), "dd/MM/yyyy"), c)


def mapping(payload: Column) -> Column:
    """Any JSON object as text: its fields in order with their labels, booleans as Sim and Não, empty and null ones left out."""
    keys = F.filter(F.json_object_keys(payload), lambda k: F.coalesce(_scalar(payload, k), F.lit("")) != "")
    shown = F.transform(keys, lambda k: F.concat(label(k, FIELDS, capitalised(k)), F.lit(": "), _scalar(payload, k)))
    return F.coalesce(F.nullif(F.array_join(shown, " · "), F.lit("")), F.lit("Sem informação"))


def _scalar(payload: Column, key: Column) -> Column:
    value = F.try_element_at(F.from_json(payload, "map<string,string>"), key)
    return F.when(value == "true", "Sim").when(value == "false", "Não").otherwise(value)


# The texts below are fixed values too: what each type of event shows.


def event_value(event: Column, payload: Column, before: bool) -> Column:
    """An event's value before or after as text, by the event's type."""
    at = lambda key: F.nullif(F.get_json_object(payload, f"$.{key}"), F.lit(""))
    prefixed = lambda text, key: F.concat(F.lit(text), at(key))
    street = F.concat_ws(", ", F.nullif(F.concat_ws(" ", at("street_type"), at("street_name")), F.lit("")), at("street_number"))
    place = F.nullif(F.concat_ws(" — ", at("neighborhood"), at("state_code")), F.lit(""))
    address = F.concat_ws(" · ", F.nullif(street, F.lit("")), at("address_complement"), place, prefixed("CEP ", "postal_code"), prefixed("IBGE ", "municipality_ibge_code"))
    kind = label(at("partner_type"), PARTNERS, F.coalesce(at("partner_type"), F.lit("Tipo não informado")))
    partner = F.concat_ws(" · ", F.coalesce(at("display_name"), F.lit("Nome não informado")), kind, prefixed("CNPJ básico ", "partner_cnpj_basic"), prefixed("qualificação ", "qualification_code"))

    def tax(prefix: str) -> Column:
        status = F.when(at(f"{prefix}_optant") == "true", "Optante").when(at(f"{prefix}_optant") == "false", "Não optante").otherwise("Situação não informada")
        return F.concat_ws(" · ", status, F.concat(F.lit("opção em "), _day(at(f"{prefix}_option_date"))), F.concat(F.lit("exclusão em "), _day(at(f"{prefix}_exclusion_date"))))

    absent = {("ESTABLISHMENT_OPENED", True): "Não constava na competência anterior", ("PARTNER_ADDED", True): "Participação ainda não registrada", ("PARTNER_REMOVED", False): "Participação não consta mais"}
    missing = reduce(lambda out, x: out.when((event == x[0][0]) & F.lit(x[0][1] == before), x[1]), absent.items(), F.when(F.lit(False), "")).otherwise("Não se aplica")
    return (
        F.when(payload.isNull(), missing)
        .when(event == "SHARE_CAPITAL_CHANGED", currency(capital(payload)))
        .when(event.isin("ADDRESS_CHANGED", "ENTERED_REGION", "LEFT_REGION"), F.coalesce(F.nullif(address, F.lit("")), F.lit("Endereço não informado")))
        .when(event.isin("PARTNER_ADDED", "PARTNER_REMOVED"), partner)
        .when(event.isin("REGISTRATION_STATUS_CHANGED", "ESTABLISHMENT_CLOSED", "ESTABLISHMENT_OPENED"), status_label(at("registration_status_code")))
        .when(event == "MAIN_CNAE_CHANGED", F.coalesce(prefixed("CNAE ", "main_cnae_code"), F.lit("CNAE não informado")))
        .when(event == "COMPANY_SIZE_CHANGED", size_label(at("company_size_code")))
        .when(event == "LEGAL_NATURE_CHANGED", F.coalesce(prefixed("Código ", "legal_nature_code"), F.lit("Não informada")))
        .when(event == "SIMPLES_STATUS_CHANGED", tax("simples"))
        .when(event == "MEI_STATUS_CHANGED", tax("mei"))
        .when(event == "PARTNER_QUALIFICATION_CHANGED", F.coalesce(prefixed("Qualificação ", "qualification_code"), F.lit("Não informada")))
        .otherwise(mapping(payload))
    )


def warning_parts(c: Column) -> dict[str, Column]:
    """RULE:key:count as rule_code, entity_key (PACKAGE without one), affected_rows (1 without a count) and the entity it speaks of."""
    parts = F.split(c, ":", 3)
    rule, key = parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit("PACKAGE"))
    said = F.upper(F.concat_ws(":", rule, key))
    names = lambda *words: said.rlike("|".join(words))
    entity = F.when(names("PARTNER", "SOCIO"), "PARTICIPATION").when(names("ESTABLISH", "ESTABELE"), "ESTABLISHMENT").otherwise("COMPANY")
    count = F.get(parts, F.lit(2))
    return {"rule_code": rule, "entity_key": key, "affected_rows": F.when(count.rlike(r"^[0-9]+$"), count.try_cast("long")).otherwise(F.lit(1).cast("long")), "entity_type": entity}
