"""Scores of items and events as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import lexicon
from newsloom.functions.text import capped, hit_count


def important_points(text: Column, terms: Sequence[str] = lexicon.IMPORTANT) -> Column:
    return capped(text, terms, 4, 36)


def water_points(text: Column, terms: Sequence[str] = lexicon.WATER) -> Column:
    return capped(text, terms, 5, 24)


def is_digest(text: Column, terms: Sequence[str] = lexicon.DIGEST_TERMS) -> Column:
    return hit_count(text, terms) > 0


def rank_points(rank: Column, top: float) -> Column:
    """Falls with the rank as a power of 0.72; 0 without a rank."""
    return F.coalesce(F.lit(top) / F.pow(rank + 2, F.lit(0.72)), F.lit(0.0))


def item_score(title: Column, weight: Column, count: Column, rank: Column, trust: Column) -> Column:
    """Source, rank, persistence and wording of a hot-list item."""
    lasting = F.least(F.lit(18.0), F.log1p(count) * 5)
    wording = important_points(title) - water_points(title) * 0.8 - F.when(is_digest(title), 20).otherwise(0)
    return weight + rank_points(rank, 56.0) + lasting + trust / 10 + wording


def digest_item_score(weight: Column, count: Column, rank: Column) -> Column:
    return rank_points(rank, 68.0) + weight + F.least(F.lit(28.0), F.log1p(count) * 8)


def display_score(score: Column, title: Column, trust: Column) -> Column:
    return score + trust / 18 - F.when(is_digest(title), 28).otherwise(0) - water_points(title)


def domains(text: Column, of: Mapping[str, Sequence[str]] = lexicon.DOMAIN_TERMS) -> Column:
    """Every domain with a term in the text, else general; in the lexicon's order."""
    hit = F.array_compact(F.array(*(F.when(hit_count(text, terms) > 0, F.lit(d)) for d, terms in of.items())))
    return F.when(F.size(hit) == 0, F.array(F.lit("general"))).otherwise(hit)


def _pattern(p: str) -> str:
    """Letter case is ignored where there are cased letters; it makes matching slow."""
    return f"(?iu){p}" if p.lower() != p.upper() else p


def category_points(text: Column, category: str, of: Mapping[str, Sequence[tuple[str, int]]] = lexicon.CATEGORY_RULES) -> Column:
    """Weights of the category's rules that match, each once."""
    rules = [F.when(F.coalesce(text, F.lit("")).rlike(_pattern(p)), w).otherwise(0) for p, w in of.get(category, ())]
    return sum(rules[1:], rules[0]) if rules else F.lit(0)


def best_category(points: dict[str, Column]) -> Column:
    """The category with most points, the earlier one at a tie, general without any."""
    ranked = F.array_max(F.array(*(F.struct(points[c].alias("p"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(lexicon.CATEGORIES) if c in points)))
    return F.when(ranked["p"] > 0, ranked["c"]).otherwise("general")


def primary_category(text: Column) -> Column:
    return best_category({c: category_points(text, c) for c in lexicon.CATEGORY_RULES})


def topic(text: Column, tracks: Sequence[tuple[str, Sequence[str]]] = lexicon.TRACKS) -> Column:
    """The first track all of whose pattern groups match, or null."""
    out = F.lit(None).cast("string")
    for name, groups in reversed(tracks):
        match = F.lit(True)
        for g in groups:
            match = match & F.coalesce(text, F.lit("")).rlike(_pattern(g))
        out = F.when(match, F.lit(name)).otherwise(out)
    return out


def cluster_key(text: Column, key: Column) -> Column:
    return F.coalesce(topic(text), key)


def bucket(text: Column) -> Column:
    """What an item's event can only be found in: its topic, else its first important term, else a domain."""
    first = F.get(F.filter(F.array(*(F.when(hit_count(text, [t]) > 0, F.lit(t.lower())) for t in lexicon.IMPORTANT)), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(F.concat(F.lit("topic:"), topic(text)), F.concat(F.lit("term:"), first), F.concat(F.lit("domain:"), F.array_min(domains(text))))
