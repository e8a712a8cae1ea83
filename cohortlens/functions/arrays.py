"""Column functions over probability vectors and other small arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(probs: str = "probs") -> Column:
    """Index of the largest value, the first on ties."""
    return (F.array_position(F.col(probs), F.array_max(probs)) - 1).cast("int")


def confidence(probs: str = "probs") -> Column:
    return F.array_max(probs)


def true_probability(probs: str = "probs", target: str = "target") -> Column:
    return F.element_at(F.col(probs), F.col(target).cast("int") + 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def restricted(probs: str, keep: list[int]) -> Column:
    """The vector over some classes only, scaled to a sum of one; null where that sum is zero."""
    part = F.array(*(F.element_at(F.col(probs), k + 1) for k in keep))
    return F.when(total(part) > 0, F.transform(part, lambda x: x / total(part)))


def restricted_target(target: str, keep: list[int], strict: bool = False) -> Column:
    """The target's place among the kept classes; otherwise null, or an error if ``strict``."""
    place = F.array_position(F.array(*map(F.lit, keep)), F.col(target)) - 1
    outside = F.raise_error(F.lit("a target is outside the kept classes")).cast("int") if strict else F.lit(None).cast("int")
    return F.when(place >= 0, place.cast("int")).otherwise(outside)


def common_classes(ours: str, theirs: str) -> Column:
    """Classes in both lists, in our order; fewer than two are an error."""
    both = F.array_intersect(F.col(ours), F.col(theirs))
    return F.when(F.size(both) >= 2, both).otherwise(F.raise_error(F.lit("fewer than two common classes")).cast("array<string>"))


def available_mask(classes: list[str], available: str) -> Column:
    return F.array(*(F.array_contains(available, c) for c in classes))


def masked_softmax(logits: str, mask: str) -> Column:
    """Softmax over the classes whose mask is true; the others get zero."""
    pairs = F.arrays_zip(F.col(logits).alias("x"), F.col(mask).alias("m"))
    kept = F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["x"])
    weight = F.transform(pairs, lambda p: F.when(p["m"], F.exp(p["x"] - F.array_max(kept))).otherwise(0.0))
    return F.transform(weight, lambda w: w / total(weight))


def masked_cross_entropy(logits: str, mask: str, target: str) -> Column:
    """Negative log of the masked softmax at the target; an error if the target is masked or no class is left."""
    pairs = F.arrays_zip(F.col(logits).alias("x"), F.col(mask).alias("m"))
    kept = F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["x"])
    top = F.array_max(kept)
    log_sum = F.log(total(F.transform(kept, lambda x: F.exp(x - top)))) + top
    valid = F.element_at(F.col(mask), F.col(target) + 1) & (F.size(logits) == F.size(mask)) & (F.size(kept) > 0)
    bad = F.raise_error(F.lit("a target isn't available, or vectors differ in length")).cast("double")
    return F.when(valid, log_sum - F.element_at(F.col(logits), F.col(target) + 1)).otherwise(bad)
