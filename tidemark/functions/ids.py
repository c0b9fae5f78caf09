"""Company identifiers: 8-character roots, 14-character establishments with two check digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the characters in the first and second check digit.
FIRST = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
SECOND = (6, *FIRST)


def normalised(c: Column) -> Column:
    """Upper case without blanks, points, slashes and dashes."""
    return F.upper(F.regexp_replace(F.trim(c), r"[\s./-]+", ""))


def _digit(c: Column, weights: tuple[int, ...]) -> Column:
    """Modulo 11 of the weighted values of the first characters, a character's value being its code less 48."""
    letters = F.slice(F.split(c, ""), 1, len(weights))
    terms = F.zip_with(letters, F.array(*[F.lit(w) for w in weights]), lambda x, w: (F.ascii(x) - 48) * w)
    rest = F.aggregate(terms, F.lit(0), lambda total, x: total + x, lambda total: total % 11)
    by_rest = [0 if rest < 2 else 11 - rest for rest in range(11)]
    return F.get(F.array(*[F.lit(x) for x in by_rest]), rest)


def valid_root(c: Column) -> Column:
    return F.coalesce(normalised(c).rlike("^[A-Z0-9]{8}$"), F.lit(False))


def valid_full(c: Column) -> Column:
    """12 letters or digits and the two check digits they give; not one character throughout."""
    n = normalised(c)
    shape = n.rlike(r"^[A-Z0-9]{12}\d{2}$") & ~n.rlike(r"^(.)\1{13}$")
    digits = (_digit(n, FIRST) == F.substring(n, 13, 1).try_cast("int")) & (_digit(n, SECOND) == F.substring(n, 14, 1).try_cast("int"))
    return F.coalesce(shape & digits, F.lit(False))


def looks_like_id(c: Column) -> Column:
    """The shape only: 8 characters, or 12 and two digits."""
    return F.coalesce(normalised(c).rlike(r"^([A-Z0-9]{8}|[A-Z0-9]{12}\d{2})$"), F.lit(False))


def parsed(c: Column) -> Column:
    """A valid id in normal form, else null."""
    return F.when(valid_root(c) | valid_full(c), normalised(c))


def root(c: Column) -> Column:
    """The root of a valid id, else null."""
    return F.substring(parsed(c), 1, 8)


def canonical_full(c: Column) -> Column:
    return valid_full(c) & (c == normalised(c))


def canonical_root(c: Column) -> Column:
    return valid_root(c) & (c == normalised(c))


def formatted(c: Column) -> Column:
    """00.000.000/0000-00; other lengths in normal form."""
    n = normalised(c)
    return F.when(F.length(n) == 14, F.regexp_replace(n, "^(..)(...)(...)(....)(..)$", "$1.$2.$3/$4-$5")).otherwise(n)


def formatted_root(c: Column) -> Column:
    n = normalised(c)
    return F.when(F.length(n) == 8, F.regexp_replace(n, "^(..)(...)(...)$", "$1.$2.$3")).otherwise(n)
