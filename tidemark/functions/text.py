"""Text normalisation and parsing as Column expressions; none leaves the JVM.

Null in gives null out unless said otherwise. Bad dates, decimals and flags give null, so that no task fails; bad_flag(),
bad_date() and bad_money() say which they are, and the snapshot build's gate (operators.cohort) refuses them.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for "no number" in addresses, after normalisation.
NO_NUMBER = ("", "0", "SN", "S N", "SEM NUMERO", "SNUMERO")
#: A masked and a full personal document number.
MASKED_DOCUMENT = r"\*{3}[0-9]{6}\*{2}"
FULL_DOCUMENT = r"(?<![0-9])[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}(?![0-9])"


def _decomposed(c: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Characters of the source's code page, and of Unicode's Latin, Greek and Cyrillic blocks and number forms.
CODE_PAGE = bytes(range(0x20, 0x100)).decode("cp1252", errors="replace")
_KNOWN = sorted({*CODE_PAGE, *map(chr, [*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0x2070, 0x20A0), *range(0x2100, 0x2190), *range(0x2460, 0x2474)])})
_SINGLE = {c: d for c in _KNOWN if len(d := _decomposed(c)) == 1 and d != c}
#: Those of the code page that become several characters.
_SEVERAL = {c: d for c in sorted(set(CODE_PAGE)) if len(d := _decomposed(c)) > 1}


def without_accents(c: Column) -> Column:
    """Letters without their marks, ordinal signs, superscripts and fractions as the characters they stand for; combining marks that stand alone go.

    Exact for the source's whole code page; elsewhere for what one character replaces."""
    out = F.translate(c, "".join(_SINGLE), "".join(_SINGLE.values()))
    for one, several in _SEVERAL.items():
        out = F.replace(out, F.lit(one), F.lit(several))
    return F.regexp_replace(out, r"\p{M}+", "")


def search_text(c: Column) -> Column:
    """Lower case without marks, everything but letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(without_accents(c)), r"[^\p{L}\p{N}]+", " "))


def without_documents(c: Column) -> Column:
    """Masked (***dddddd**) and 11-digit personal document numbers removed, runs of white space one blank, ` ./-` stripped."""
    full = F.regexp_replace(F.regexp_replace(c, MASKED_DOCUMENT, ""), FULL_DOCUMENT, "")
    return F.btrim(F.regexp_replace(full, r"\s{2,}", " "), F.lit(" ./-"))


def holds_document(c: Column, opaque: bool = False) -> Column:
    """Whether a value shows a personal document number; opaque keys are only looked at for masked ones. Null shows none."""
    masked = c.rlike(MASKED_DOCUMENT)
    return F.coalesce(masked if opaque else masked | c.rlike(FULL_DOCUMENT), F.lit(False))


def text(c: Column) -> Column:
    """Trimmed; null is empty."""
    return F.trim(F.coalesce(c, F.lit("")))


def nullable_text(c: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.trim(c), F.lit(""))


def postal_code(c: Column) -> Column:
    """Eight digits or empty, as the source gives them."""
    return F.when(text(c).rlike(r"^\d{8}$"), text(c)).otherwise("")


def flag(c: Column) -> Column:
    """S is true, N false, blank and all else null."""
    return F.when(F.upper(F.trim(c)) == "S", True).when(F.upper(F.trim(c)) == "N", False)


def bad_flag(c: Column) -> Column:
    return (text(c) != "") & flag(c).isNull()


def source_date(c: Column) -> Column:
    """yyyyMMdd; blank, 0 and 00000000 are null."""
    return F.when(~text(c).isin("", "0", "00000000"), F.try_to_date(F.trim(c), "yyyyMMdd"))


def bad_date(c: Column) -> Column:
    return ~text(c).isin("", "0", "00000000") & source_date(c).isNull()


def money(c: Column) -> Column:
    """Decimal with comma or point, with two decimals; blank is null."""
    return F.replace(F.nullif(F.trim(c), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


def bad_money(c: Column) -> Column:
    return (text(c) != "") & money(c).isNull()


def partner_type(c: Column) -> Column:
    """1 is PJ, 2 PF, 3 FOREIGN, all else null."""
    return F.when(F.trim(c) == "1", "PJ").when(F.trim(c) == "2", "PF").when(F.trim(c) == "3", "FOREIGN")


def address_text(c: Column) -> Column:
    """Upper case, then without marks, then everything but A-Z and 0-9 one blank (so ordinal signs, which have no upper case, go); null is empty."""
    return F.trim(F.regexp_replace(without_accents(F.upper(text(c))), "[^A-Z0-9]+", " "))


def address_number(c: Column) -> Column:
    """Without leading zeros if all digits, else without blanks; empty for no number."""
    plain = address_text(c)
    return F.when(plain.isin(*NO_NUMBER), "").when(plain.rlike(r"^\d+$"), F.regexp_replace(plain, "^0+(?!$)", "")).otherwise(F.replace(plain, F.lit(" "), F.lit("")))


def address_postal_code(c: Column) -> Column:
    """The eight digits in it, or empty."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")
    return F.when(F.length(digits) == 8, digits).otherwise("")
