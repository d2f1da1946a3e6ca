"""Scores of a query's vector and words: features, context by prototypes, quality. All of it is DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedge.functions import vectors as V


@dataclass(frozen=True)
class Prototype:
    """A category: words that speak for it, its weight, the score it adds to (none: only a context), and what its vectors are like."""

    name: str
    words: tuple[str, ...]
    weight: float = 1.0
    score: str | None = None
    high_variance: bool = False
    positive_bias: bool = False
    clustered: bool = False


#: Kinds of scores of a vector.
SCORES = ("tech", "business", "daily", "emotion", "academic")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(w.lower())), 1).otherwise(0) for w in words), F.lit(0))


def keyword_scores(text: Column, prototypes: tuple[Prototype, ...]) -> dict[str, Column]:
    """Of each kind, the weighted number of words of its prototypes that the text holds, over the highest of all kinds (1 at least)."""
    raw = {k: sum((_hits(text, p.words) * p.weight for p in prototypes if p.score == k), F.lit(0.0)) for k in SCORES}
    most = F.greatest(*raw.values(), F.lit(1.0))
    return {k: c / most for k, c in raw.items()}


def segment_energies(v: Column) -> list[Column]:
    """Lengths of five parts of a vector, the last one with what is left over."""
    size = F.floor(F.size(v) / 5).cast("int")
    whole = [F.slice(v, size * k + 1, size) for k in range(4)]
    return [V.norm(part) for part in [*whole, F.slice(v, size * 4 + 1, F.size(v))]]


def vector_features(v: Column, stats: dict[str, Column], text: Column, prototypes: tuple[Prototype, ...]) -> dict[str, Column]:
    """Five scores from 0 to 1, information density and clarity of a vector and its text; stats as vectors.statistics() makes them.

    A score is a sigmoid of the text's keywords and of what the kind reads from the vector: the energy of its parts, and its moments.
    """
    energy, words = segment_energies(v), keyword_scores(text, prototypes)
    length = F.when(stats["l2"] == 0, 1.0).otherwise(stats["l2"])
    top, mean = F.greatest(*energy), sum(energy[1:], energy[0]) / 5
    return {
        "tech": sigmoid(words["tech"] * 3 + stats["variance"] * 10 + (energy[0] + energy[1]) / length * 2 - 2),
        "business": sigmoid(words["business"] * 3 + F.abs(stats["mean"]) * 5 + energy[2] / length * 2 - 2),
        "daily": sigmoid(words["daily"] * 3 + (1 - stats["variance"]) * 0.5 + (1 - stats["kurtosis"] * 0.1) - 1.5),
        "emotion": sigmoid(words["emotion"] * 3 + F.abs(stats["skewness"]) * 0.5 + energy[4] / length * 2 - 2),
        "academic": sigmoid(words["academic"] * 3 + stats["entropy"] * 0.1 + (1 - F.abs(stats["skewness"]) * 0.3) - 2),
        "density": F.least(F.lit(1.0), stats["entropy"] / F.log2(F.size(v).cast("double")) * (1 - stats["sparsity"])),
        "clarity": F.least(F.lit(1.0), top / F.when(mean == 0, 1.0).otherwise(mean) / 3),
    }


def context_scores(stats: dict[str, Column], text: Column, prototypes: tuple[Prototype, ...]) -> Column:
    """An array of name and score of every prototype, best first (of equal ones in their order): 0.3 a keyword and 0.4 of how far the vector is like
    the prototype's (high variance .33, positive mean .33, heavy tails .34), times its weight."""
    high, positive, heavy = stats["variance"] > 0.1, stats["mean"] > 0, stats["kurtosis"] > 0

    def score(p: Prototype) -> Column:
        like = F.when(high == p.high_variance, 0.33).otherwise(0.0) + F.when(positive == p.positive_bias, 0.33).otherwise(0.0) + F.when(heavy == p.clustered, 0.34).otherwise(0.0)
        return (_hits(text, p.words) * 0.3 + like * 0.4) * p.weight

    rows = F.array(*(F.struct((-score(p)).alias("down"), F.lit(k).alias("place"), F.lit(p.name).alias("name")) for k, p in enumerate(prototypes)))
    return F.transform(F.array_sort(rows), lambda x: F.struct(x["name"].alias("name"), (-x["down"]).alias("score")))


def context(scores: Column) -> dict[str, Column]:
    """Of context_scores(): the best name, its confidence (0.3 and 0.65 of its share, 0.95 at most), and the shares of the first three."""
    whole = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x["score"])
    whole = F.when(whole == 0, 1.0).otherwise(whole)
    return {
        "category": scores[0]["name"],
        "confidence": F.least(F.lit(0.95), 0.3 + scores[0]["score"] / whole * 0.65),
        "clusters": F.transform(F.slice(scores, 1, 3), lambda x: F.struct(x["name"].alias("name"), F.round(x["score"] / whole, 4).alias("similarity"), F.round(1 - x["score"] / whole, 4).alias("distance"))),
    }


def query_quality(v: Column, stats: dict[str, Column]) -> dict[str, Column]:
    """specificity, ambiguity, retrievability, and the quality they make up (.3, .3, .4)."""
    specificity = 1 - stats["entropy"] / F.log2(F.size(v).cast("double"))
    ambiguity = stats["sparsity"] * 0.5 + (1 - F.least(F.lit(1.0), stats["variance"] * 10)) * 0.5
    retrievability = F.least(F.lit(1.0), stats["l2"] / 10) * 0.5 + (1 - stats["sparsity"]) * 0.5
    return {"specificity": specificity, "ambiguity": ambiguity, "retrievability": retrievability, "quality": specificity * 0.3 + (1 - ambiguity) * 0.3 + retrievability * 0.4}
