"""What a user's places say: weights of groups, role, style and interests, and what is familiar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Visits from which a place is familiar, what a place never seen gains, and the weight from which a group is an interest.
FAMILIAR, NOVEL, INTEREST = 1, 4.0, 0.3


def group_weights(weights: DataFrame, groups: DataFrame, user: str, names: list[str]) -> DataFrame:
    """A row for each user with a column for each of ``names``: the sum of the user's place weights (user, place, weight) times the place's share in the group (place, group, share).

    Weights are summed before the shuffle, so a place that many users visit costs no more than another.
    """
    rows = weights.join(groups, "place")
    total = lambda g: F.coalesce(F.sum(F.when(F.col("group") == g, F.col("weight") * F.col("share"))), F.lit(0.0))
    return weights.select(user).distinct().join(rows.groupBy(user).agg(*(F.round(total(g), 9).alias(g) for g in names)), user, "left").fillna(0.0, names)


def role_of(staff: Column, guest: Column, study: Column, fixed: Column, sport: Column) -> Column:
    """A lecturer if offices outweigh all else, a visitor if gates do and nothing else counts, else a student."""
    rest = study + fixed + sport
    return F.when(staff > rest, "lecturer").when((guest > 0.4) & (rest < 0.2), "visitor").otherwise("student")


def interests_of(pairs: list[tuple[str, Column]], default: str) -> Column:
    """The names whose weight is ``INTEREST`` or more, each once, in order of name; ``default`` if none is."""
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(w >= INTEREST, F.lit(n)) for n, w in pairs)))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def buckets(candidates: DataFrame, visits: DataFrame, user: str, item: str) -> DataFrame:
    """Candidates (user, item, place) with ``bucket`` (familiar or discovery), ``turn`` in it, and ``novelty``, from visits (user, item, visits)."""
    from pyspark.sql import Window

    rows = candidates.join(visits.groupBy(user, item).agg(F.sum("visits").alias("seen")), [user, item], "left")
    known = F.coalesce("seen", F.lit(0)) >= FAMILIAR
    rows = rows.withColumn("bucket", F.when(known, "familiar").otherwise("discovery")).withColumn("novelty", F.when(F.coalesce("seen", F.lit(0)) == 0, NOVEL).otherwise(0.0))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(user, "bucket").orderBy("place", item))).drop("seen")
