"""The lattice of vintage kinds: how sure we are that a value was known when it claims to have been."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of the vintage kinds, and what each is evidence of.
RANKS = {"OBSERVED_PIT": 2, "ASSUMED_PIT": 1, "PROVIDER_BACKTESTED": 0}
EVIDENCE = {"OBSERVED_PIT": "OBSERVED", "ASSUMED_PIT": "ASSUMED", "PROVIDER_BACKTESTED": "RESEARCH_ONLY"}
FORMAL = ("OBSERVED_PIT", "ASSUMED_PIT")


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def rank(kind: Column) -> Column:
    """2, 1 or 0; null for null and unknown kinds."""
    return F.when(kind.isin(*RANKS), F.element_at(_map(RANKS), kind))


def kind_of(rank_: Column) -> Column:
    return F.when(rank_.isNotNull(), F.element_at(_map({v: k for k, v in RANKS.items()}), rank_))


def evidence(kind: Column) -> Column:
    return F.when(kind.isin(*EVIDENCE), F.element_at(_map(EVIDENCE), kind)).otherwise(F.lit("UNKNOWN"))


def is_formal(kind: Column) -> Column:
    return F.coalesce(kind.isin(*FORMAL), F.lit(False))


def all_formal(kinds: Column) -> Column:
    """For an array: not empty and every kind formal."""
    return (F.size(kinds) > 0) & F.forall(kinds, is_formal)


def weakest(kinds: Column) -> Column:
    """The lowest kind of an array; null if it is empty."""
    return kind_of(F.array_min(F.transform(kinds, rank)))
