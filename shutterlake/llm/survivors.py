"""The best representative of each group of duplicates, built field by field.

Members' fields are unpivoted to long rows; each value casts a vote of its
source's trust times the decay of its age; votes are summed per normalised
value, each field's winner is taken by ``max_by``, and the winners are pivoted
back to one record a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.skew import salted_join


@dataclass(frozen=True)
class Field:
    """A field of the surviving record.

    ``value`` is what survives, ``norm`` what values are compared by (the value
    as text, unless given), ``rank`` puts some values before others whatever
    their votes: by itself for "the more the better", null for votes alone.
    """

    name: str
    value: Column
    kind: str
    norm: Column | None = None
    rank: Column | None = None


def votes(members: DataFrame, fields: list[Field], trust: Column, age_days: Column, half_life_days: float = 180.0) -> DataFrame:
    """(group, field, norm, value, rank, votes, n): the votes of every value of every field; missing values don't vote.

    A vote is ``trust`` (0 to 1) in millionths, halved for each half-life of age
    and in between by the fraction (an unknown age counts as infinite, one below
    0 as 0); integers, so that sums don't depend on their order. Among spellings
    of one normalised value the greatest text stands for it.
    """
    halvings = F.greatest(F.lit(0.0), F.coalesce(age_days.cast("double"), F.lit(1e9)) / half_life_days)
    weight = F.round(F.coalesce(trust, F.lit(0.0)) * 1_000_000 * F.pow(F.lit(2.0), -halvings)).cast("bigint")
    rows = [
        F.struct(F.lit(f.name).alias("field"), f.value.cast("string").alias("value"), (f.value.cast("string") if f.norm is None else f.norm).alias("norm"), (F.lit(None) if f.rank is None else f.rank).cast("double").alias("rank"))
        for f in fields
    ]
    long = members.where("group is not null").select("group", weight.alias("w"), F.explode(F.array(*rows)).alias("r")).select("group", "w", "r.*").where("norm is not null")
    return long.groupBy("group", "field", "norm").agg(F.max("value").alias("value"), F.max("rank").alias("rank"), F.sum("w").alias("votes"), F.count(F.lit(1)).alias("n"))


def survivors(members: DataFrame, fields: list[Field], trust: Column, age_days: Column, half_life_days: float = 180.0) -> DataFrame:
    """(group, one column a field): the record built of the winners.

    The highest rank wins, then the most votes, then the most members, then the
    greatest normalised value. A field that no member has is null. ``members``
    has group and one row a member; a repeated row would vote twice.
    """
    counted = votes(members, fields, trust, age_days, half_life_days)
    best = counted.groupBy("group", "field").agg(F.max_by("value", F.struct(F.coalesce("rank", F.lit(float("-inf"))), "votes", "n", "norm")).alias("value"))
    back = [F.max(F.when(F.col("field") == f.name, F.col("value"))).cast(f.kind).alias(f.name) for f in fields]
    groups = members.where("group is not null").select("group").distinct()
    return groups.join(best.groupBy("group").agg(*back), "group", "left")


def undisputed(members: DataFrame, built: DataFrame, fields: list[str]) -> DataFrame:
    """(group, id): groups of two members or more in which exactly one member has every winning value."""
    same = [F.col(f"won_{f}").eqNullSafe(F.col(f)) for f in fields]
    hit = same[0]
    for x in same[1:]:
        hit = hit & x
    held = salted_join(built.select("group", *[F.col(f).alias(f"won_{f}") for f in fields]), members.select("group", "id", *fields), ["group"])
    held = held.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("id"))).alias("id"))
    return held.where("n >= 2 and hits = 1").select("group", "id")
