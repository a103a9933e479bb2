"""Label mapping and prediction records (B13-B16) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
STANDARD_CLASSES = ("negative", "neutral", "positive")
NUMERIC_LABELS = {"0": "negative", "1": "positive"}
NEGATIVE_MAX_STARS = 2
NEUTRAL_STARS = 3
# ---------------------------------------------------------------------------


def stars_to_sentiment(stars: Column) -> Column:
    """<= 2 negative, == 3 neutral, anything else positive (2.5 too)."""
    return (F.when(stars <= NEGATIVE_MAX_STARS, "negative")
             .when(stars == NEUTRAL_STARS, "neutral").otherwise("positive"))


def normalize_label(label: Column, lowercase_unknown: bool = True) -> Column:
    """0 / '0' -> negative, 1 / '1' -> positive, else the text
    (lower-cased unless ``lowercase_unknown`` is off)."""
    s = label.cast("string")
    other = F.lower(s) if lowercase_unknown else s
    return (F.when(s == "0", NUMERIC_LABELS["0"]).when(s == "1", NUMERIC_LABELS["1"])
             .otherwise(other))


def expand_probabilities(classes: Column, probs: Column) -> list[Column]:
    """Class names (array) + probabilities (array, same order) ->
    prediction = normalized argmax, confidence = its probability, and one
    column per standard class (missing 0.0, unknown classes dropped; of classes
    with one normalized name the last counts)."""
    names = F.transform(classes, lambda c: normalize_label(c))
    best = F.array_max(probs)
    pred = F.element_at(names, F.array_position(probs, best).cast("int"))

    def of(name: str) -> Column:
        own = F.filter(F.arrays_zip(names.alias("n"), probs.alias("p")), lambda x: x["n"] == name)
        return F.coalesce(F.try_element_at(own, F.lit(-1))["p"], F.lit(0.0)).alias(f"p_{name}")
    return [pred.alias("prediction"), best.alias("confidence"), *map(of, STANDARD_CLASSES)]


def sql_stars_to_sentiment(stars: str) -> str:
    return (f"CASE WHEN {stars} <= {NEGATIVE_MAX_STARS} THEN 'negative' WHEN {stars} = {NEUTRAL_STARS} "
            f"THEN 'neutral' ELSE 'positive' END")


def sql_normalize_label(label: str) -> str:
    s = f"CAST({label} AS VARCHAR)"
    return f"CASE WHEN {s} = '0' THEN 'negative' WHEN {s} = '1' THEN 'positive' ELSE lower({s}) END"
