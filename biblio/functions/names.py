"""Similarity of person names, as ordered ladders of conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, tokens

# Names too common to tell people apart, and particles.
# fmt: off
COMMON_LAST_NAMES = [
    "silva", "santos", "oliveira", "souza", "rodrigues", "ferreira", "alves", "pereira", "lima", "gomes", "costa",
    "ribeiro", "martins", "carvalho", "almeida", "lopes", "soares", "fernandes", "vieira", "barbosa", "rocha",
    "dias", "nascimento", "andrade", "moreira", "nunes", "marques", "machado", "mendes", "freitas", "cardoso",
    "ramos", "goncalves", "santana", "teixeira", "neto", "junior", "filho", "sobrinho",
]
COMMON_FIRST_NAMES = [
    "jose", "joao", "maria", "antonio", "pedro", "rodrigo", "carlos", "paulo", "luis", "luiz", "marcos", "marcelo",
    "andre", "rafael", "fernando", "roberto", "sergio", "gilberto", "amauri",
]
PREPOSITIONS = ["de", "da", "do", "dos", "das", "e"]
# fmt: on


def _literals(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def distinctive(parts: Column) -> Column:
    """Parts that are neither common names nor particles."""
    return F.array_except(parts, _literals(COMMON_LAST_NAMES + COMMON_FIRST_NAMES + PREPOSITIONS))


def author_name_similarity(a: Column, b: Column) -> Column:
    """1 equal, 0.9 contained, 0.7 same surname (and 0.2 for the same first initial), else the share of common parts.

    Both names must be folded with ``author_name``.
    """
    p, q = tokens(a), tokens(b)
    same_initial = F.substring(F.try_element_at(p, F.lit(1)), 1, 1) == F.substring(F.try_element_at(q, F.lit(1)), 1, 1)
    common = F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.size(q))
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(a.contains(b) | b.contains(a), F.lit(0.9))
        .when(F.try_element_at(p, F.lit(-1)) == F.try_element_at(q, F.lit(-1)), F.when(same_initial, F.lit(0.7) + F.lit(0.2)).otherwise(F.lit(0.7)))
        .otherwise(common)
    )


def author_order_variants(given: Column, surname: Column) -> Column:
    """The three ways a catalogue writes a name: given first, surname first, initials first."""
    initials = F.array_join(F.transform(tokens(given), lambda t: F.substring(t, 1, 1)), " ")
    return F.array(F.concat_ws(" ", given, surname), F.concat_ws(" ", surname, given), F.concat_ws(" ", initials, surname))


def best_variant_similarity(name: Column, variants: Column) -> Column:
    return F.array_max(F.transform(variants, lambda v: author_name_similarity(name, v)))


def name_parts(name: Column) -> Column:
    """(first, last, second_to_last, all, full) of a folded name; empty strings where a part is missing."""
    t = tokens(fold(name, "combining_trim"))

    def at(i: int) -> Column:
        return F.coalesce(F.try_element_at(t, F.lit(i)), F.lit(""))

    return F.struct(at(1).alias("first"), at(-1).alias("last"), F.when(F.size(t) > 1, at(-2)).otherwise(F.lit("")).alias("second_to_last"), F.array_distinct(t).alias("all"), F.array_join(t, " ").alias("full"))


def advisor_name_similarity(advisor: Column, person: Column, short_name: Column | None = None) -> Column:
    """Ladder over two ``name_parts``: full names, containment, then only with the same first name surnames and parts."""
    shared = F.size(distinctive(F.array_intersect(advisor["all"], person["all"])))

    def telling(part: Column) -> Column:
        return ~part.isin(COMMON_LAST_NAMES) & ~part.isin(COMMON_FIRST_NAMES)

    nick = fold(F.coalesce(short_name, F.lit("")) if short_name is not None else F.lit(""), "combining_trim")
    by_nick = (nick != "") & (nick != person["first"]) & telling(nick) & F.arrays_overlap(tokens(nick), distinctive(advisor["all"]))
    within = person["full"].contains(advisor["full"]) | advisor["full"].contains(person["full"])
    last_equal = advisor["last"] == person["last"]
    second = advisor["second_to_last"]
    return (
        F.when(advisor["full"] == "", F.lit(0.0))
        .when(advisor["full"] == person["full"], F.lit(1.0))
        .when(within & (shared >= 1), F.lit(0.95))
        .when(advisor["first"] != person["first"], F.lit(0.0))
        .when(last_equal & telling(advisor["last"]), F.lit(0.9))
        .when(last_equal & (shared >= 1), F.lit(0.85))
        .when((second != "") & (second == person["last"]) & telling(second), F.lit(0.85))
        .when(by_nick, F.lit(0.85))
        .when(shared >= 2, F.lit(0.8))
        .otherwise(F.lit(0.0))
    )
