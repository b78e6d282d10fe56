"""Relevance scores against weighted lexicons, unrolled into expressions so that they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import text


@dataclass(frozen=True)
class Lexicon:
    """Keywords (duplicates score twice), weights (1.0 where absent) and combinations with a bonus."""

    keywords: Sequence[str]
    weights: Mapping[str, float] = field(default_factory=dict)
    combos: Sequence[tuple[Sequence[str], float]] = ()


#: Bonus for a second whole-word hit and for each further keyword, and their limits.
REPEAT, REPEAT_MOST, BREADTH, BREADTH_MOST = 0.35, 3.0, 0.35, 2.8


def relevance(c: Column, lexicon: Lexicon) -> Column:
    """struct(score, found) of normalised text."""
    score, repeat, found = F.lit(0.0), F.lit(0.0), []
    for raw in lexicon.keywords:
        k = " ".join(raw.lower().split())
        if not k:
            continue
        w = text.keyword_weight(k, lexicon.weights)
        hit = F.contains(c, F.lit(k))
        tokens = text.keyword_tokens(k)
        partial = F.lit(False)
        if len(tokens) >= 3:
            partial = ~hit & (sum((F.contains(c, F.lit(t)).cast("int") for t in tokens), F.lit(0)) >= 2)
        score = score + F.when(hit, w).when(partial, 0.5 * w).otherwise(0.0)
        # counted only where the cheap test holds
        repeat = repeat + F.when(hit, F.greatest(F.lit(0), F.least(F.when(hit, text.occurrences(c, k)), F.lit(2)) - 1) * (REPEAT * w)).otherwise(0.0)
        found.append(F.when(hit | partial, F.lit(k)))
    names = F.sort_array(F.array_distinct(F.array_compact(F.array(*found)))) if found else F.array().cast("array<string>")
    breadth = F.least(F.greatest(F.lit(0), F.size(names) - 1) * F.lit(BREADTH), F.lit(BREADTH_MOST))
    return F.struct((score + F.least(repeat, F.lit(REPEAT_MOST)) + breadth + text.combo_bonus(c, lexicon.combos)).alias("score"), names.alias("found"))


def tiered(c: Column, lexicon: Lexicon, steps: Sequence[tuple[int, float]] = ((2, 1.2), (4, 1.4))) -> Column:
    """Sum of the weights of keywords contained, times a factor for each step that the number of hits passes."""
    hits = [F.contains(c, F.lit(k)) for k in lexicon.keywords]
    total = sum((F.when(h, text.keyword_weight(k, lexicon.weights)).otherwise(0.0) for h, k in zip(hits, lexicon.keywords, strict=True)), F.lit(0.0))
    n = sum((h.cast("int") for h in hits), F.lit(0))
    for least, factor in steps:
        total = total * F.when(n > least, factor).otherwise(1.0)
    return total


def title_hits(title: Column, url: Column, keywords: Sequence[str]) -> Column:
    both = F.lower(F.concat_ws(" ", title, url))
    return sum((F.contains(both, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def verdict(score: Column, core: Column, least: float = 3.0) -> Column:
    return F.when((score > least) & core, "collected").when(score > least, "no core term").when(core, "low score").otherwise("not relevant")
