"""Vector maths on array columns; all JVM-side. Empty and null vectors give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, where f uses it in a lambda over an array."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays as it is."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def similarity(raw: Column, metric: str) -> Column:
    """A store's raw score as a similarity. COSINE: as it is from 0 to 1, else 1 less it; IP: as it is; L2: 1 / (1 + d)."""
    if metric == "L2":
        return 1 / (1 + raw)
    return F.when(raw.between(0, 1), raw).otherwise(1 - raw) if metric == "COSINE" else raw


def statistics(v: Column) -> dict[str, Column]:
    """Population moments, entropy of absolute shares (bits), share of entries under .01, and norms."""
    n = F.size(v).cast("double")
    mean = total(v) / n

    def moment(k: int) -> Column:
        return let(mean, lambda m: total(F.transform(v, lambda x: F.pow(x - m, F.lit(float(k)))))) / n

    var, l1 = moment(2), total(F.transform(v, F.abs))
    share = let(l1, lambda whole: F.transform(v, lambda x: F.try_divide(F.abs(x), whole)))
    return {
        "mean": mean,
        "variance": var,
        "std": F.sqrt(var),
        "skewness": F.coalesce(F.try_divide(moment(3), F.pow(var, F.lit(1.5))), F.lit(0.0)),
        "kurtosis": F.coalesce(F.try_divide(moment(4), var * var) - 3, F.lit(0.0)),
        "entropy": -total(F.transform(share, lambda p: F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))),
        "sparsity": F.size(F.filter(v, lambda x: F.abs(x) < 0.01)) / n,
        "l1": l1,
        "l2": norm(v),
    }


def plain_cosine(a: Column, b: Column) -> Column:
    """Null where either is a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def soft_cosine(a: Column, b: Column) -> Column:
    """With 1e-8 added to the product of lengths."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-8)


def static_weight(v: Column) -> dict[str, Column]:
    """Norms, largest size, mean, population variance and the share of entries up to 1e-6."""
    n = F.size(v).cast("double")
    mean = total(v) / n
    return {
        "l2": norm(v), "l1": total(F.transform(v, F.abs)), "top": F.array_max(F.transform(v, F.abs)), "mean": mean,
        "variance": let(mean, lambda m: total(F.transform(v, lambda x: F.pow(x - m, F.lit(2.0))))) / n, "sparsity": F.size(F.filter(v, lambda x: F.abs(x) <= 1e-6)) / n,
    }


def entropy(v: Column) -> Column:
    """Bits of the entries' absolute shares; 0 for a zero vector."""
    l1 = total(F.transform(v, F.abs))
    shares = let(l1, lambda whole: F.transform(v, lambda x: F.coalesce(F.try_divide(F.abs(x), whole), F.lit(0.0))))
    return -total(F.transform(shares, lambda p: F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))))


def pseudo_embedding(seed: Column, frequency: Column, size: int) -> Column:
    """sin(seed * (i + 1) * .01) * .5 * (1 + frequency) for i below size."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.sin(seed * i * 0.01) * 0.5 * (1 + frequency))
