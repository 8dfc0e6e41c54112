"""District scores: aggregates, ranks, inequality, comparisons and travel-time matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numbers import boost_percent, js_round, round_to


def _all():
    """All rows: there is one for each district, so these windows stay small by nature."""
    return W.partitionBy()


def score_districts(points: DataFrame, value: str = "score") -> DataFrame:
    """Per district: mean, least, greatest, deviation and quartiles of its points; rank and score relative to the best mean."""
    own = points.groupBy("area").agg(
        F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("stddev"),
        F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.25).alias("p25"), F.percentile(value, 0.75).alias("p75"), F.count("*").alias("samples"),
    )
    ranked = own.withColumn("rank", F.row_number().over(W.orderBy(F.desc("avg"), "area")))
    return ranked.withColumn("score", js_round(F.col("avg") * 100.0 / F.max("avg").over(_all())).cast("long"))


def best_points(points: DataFrame, value: str = "score", order: str = "point_id") -> DataFrame:
    """The best point of each district, the first of equals, at four decimals."""
    own = points.groupBy("area").agg(F.max_by(F.struct("lat", "lon", value), F.struct(value, (-F.col(order)).alias("o"))).alias("b"))
    return own.select("area", round_to(F.col("b.lat"), 4).alias("lat"), round_to(F.col("b.lon"), 4).alias("lon"), F.col(f"b.{value}").alias(value))


def lorenz(scores: DataFrame, value: str = "score", weight: str = "population") -> DataFrame:
    """Cumulative shares of weight and of weighted value in order of value."""
    w = W.orderBy(value, "name").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(weight).over(_all()), F.sum(F.col(value) * F.col(weight)).over(_all())
    return scores.select("name", value, weight, (F.sum(weight).over(w) / total[0]).alias("weight_share"), (F.sum(F.col(value) * F.col(weight)).over(w) / total[1]).alias("value_share"))


def gini(scores: DataFrame, value: str = "score", weight: str = "population") -> DataFrame:
    """Weighted Gini coefficient by trapezoids under the Lorenz curve; rows without weight are left out; 0 at least."""
    curve = lorenz(scores.where(F.col(weight) > 0), value, weight)
    w = W.orderBy(value, "name")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    part = curve.select(((F.col("weight_share") - before("weight_share")) * (F.col("value_share") + before("value_share")) / 2.0).alias("a"))
    return part.agg(F.greatest(F.lit(1.0) - F.sum("a") * 2.0, F.lit(0.0)).alias("gini"))


def weighted_change(scores: DataFrame, before: str, after: str, weight: str = "samples") -> DataFrame:
    """Percent by which the weighted mean of after differs from that of before."""
    a, b = F.sum(F.col(before) * F.col(weight)), F.sum(F.col(after) * F.col(weight))
    return scores.where(F.col(before).isNotNull() & F.col(after).isNotNull()).agg(F.when(a > 0, js_round((b - a) / a * 100.0).cast("long")).alias("change_pct"))


def city_summary(scores: DataFrame) -> DataFrame:
    """Sample-weighted reach, population-weighted score, people in poorly (under 25) and well (50 and over) served districts, best over worst."""
    people = F.sum("population")
    return scores.agg(
        (F.sum(F.col("reach") * F.col("samples")) / F.sum("samples")).alias("reach"), (F.sum(F.col("score") * F.col("population")) / people).alias("score"),
        F.sum(F.when(F.col("score") < 25, F.col("population")).otherwise(0)).alias("poor_population"), F.sum(F.when(F.col("score") >= 50, F.col("population")).otherwise(0)).alias("good_population"),
        (F.max("reach") / F.min("reach")).alias("best_to_worst"),
    )


def bands(scores: DataFrame) -> DataFrame:
    """Districts and people by band of the score: 70, 50 and 25 and over, under."""
    band = F.when(F.col("score") >= 70, "excellent").when(F.col("score") >= 50, "good").when(F.col("score") >= 25, "fair").otherwise("poor")
    return scores.groupBy(band.alias("band")).agg(F.count("*").alias("districts"), F.sum("population").alias("population"))


def evening_drop(scores: DataFrame) -> DataFrame:
    """Percent of reach that each district loses in the evening, the most first."""
    return scores.select("name", (-boost_percent(F.col("reach"), F.col("evening"))).cast("long").alias("drop_pct")).orderBy(F.desc("drop_pct"), "name")


def ranked_by(scores: DataFrame, value: str) -> DataFrame:
    """Rank by a value, and its share of the greatest."""
    return scores.select("name", value, F.row_number().over(W.orderBy(F.desc(value), "name")).alias("rank"), (F.col(value) / F.max(value).over(_all())).alias("of_best"))


def weekend_change(scores: DataFrame) -> DataFrame:
    """Per district with weekend service: change of reach in percent, and the population-weighted change of the city."""
    delta = (F.col("weekend") - F.col("reach")) / F.col("reach") * 100.0
    own = scores.where("weekend is not null and reach > 0").withColumn("_d", delta)
    return own.select("name", round_to(F.col("_d"), 1).alias("change_pct"), round_to(F.sum(F.col("_d") * F.col("population")).over(_all()) / F.sum("population").over(_all()), 1).alias("city_pct"))


def backfilled(day: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """day with nulls of the columns filled from base by name."""
    own = base.select("name", *[F.col(c).alias(f"_{c}") for c in columns])
    return day.join(own, "name", "left").select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in day.columns])


def extremes(scores: DataFrame, values: list[str]) -> DataFrame:
    """Names with the greatest and the least of each value (the first by name of equals)."""
    parts = []
    for v in values:
        top = F.min(F.struct((-F.col(v)).alias("v"), "name"))
        low = F.min(F.struct(F.col(v).alias("v"), "name"))
        parts.append(scores.where(F.col(v).isNotNull()).agg(F.lit(v).alias("value"), top.alias("t"), low.alias("l")).select("value", F.col("t.name").alias("most"), F.col("l.name").alias("least")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """Longest and shortest pair of different districts and the mean; -1 is no route."""
    own = matrix.where("origin <> dest and minutes > 0")
    return own.agg(F.min(F.struct((-F.col("minutes")).alias("m"), "origin", "dest")).alias("w"), F.min(F.struct("minutes", "origin", "dest")).alias("b"), F.avg("minutes").alias("mean")).select(
        F.concat_ws(">", "w.origin", "w.dest").alias("worst"), (-F.col("w.m")).alias("worst_min"), F.concat_ws(">", "b.origin", "b.dest").alias("best"), F.col("b.minutes").alias("best_min"), "mean"
    )


def slow_pairs(matrix: DataFrame, minutes: int = 80) -> DataFrame:
    """Unordered pairs whose slower direction takes more than minutes, the slowest first."""
    a = matrix.where("origin < dest and minutes > 0").select("origin", "dest", F.col("minutes").alias("there"))
    b = matrix.where("origin > dest and minutes > 0").select(F.col("dest").alias("origin"), F.col("origin").alias("dest"), F.col("minutes").alias("back"))
    return a.join(b, ["origin", "dest"]).select("origin", "dest", F.greatest("there", "back").alias("minutes")).where(F.col("minutes") > minutes).orderBy(F.desc("minutes"), "origin", "dest")


def connectivity_gaps(scores: DataFrame, matrix: DataFrame) -> DataFrame:
    """Two underserved districts (score under 25, over 20,000 people), two slow pairs and the largest one without trams (over 40,000): kind, name, value."""
    under = scores.where("score < 25 and population > 20000").orderBy(F.desc("population"), "name").limit(2).select(F.lit("underserved").alias("kind"), "name", F.col("population").cast("long").alias("value"))
    pairs = slow_pairs(matrix).limit(2).select(F.lit("pair").alias("kind"), F.concat_ws(">", "origin", "dest").alias("name"), F.col("minutes").cast("long").alias("value"))
    tramless = scores.where("tram_lines = 0 and population > 40000").orderBy(F.desc("population"), "name").limit(1).select(F.lit("tramless").alias("kind"), "name", F.col("population").cast("long").alias("value"))
    return under.unionByName(pairs).unionByName(tramless)


def within(matrix: DataFrame, minutes: int = 30) -> DataFrame:
    """How many other districts each one reaches within minutes."""
    return matrix.where("origin <> dest").groupBy("origin").agg(F.sum(F.col("minutes").between(1, minutes).cast("int")).alias("reached"), F.count("*").alias("districts"))


def bike_density(stations: DataFrame, areas: DataFrame) -> DataFrame:
    """Stations per area, per km2 (two decimals) and per 10,000 people (one); stations have area, areas name, km2 and population."""
    n = stations.where("area is not null").groupBy(F.col("area").alias("name")).agg(F.count("*").alias("n"))
    own = areas.join(n, "name", "left").withColumn("stations", F.coalesce("n", F.lit(0)))
    return own.select("name", "stations", round_to(F.col("stations") / F.col("km2"), 2).alias("per_km2"), round_to(F.col("stations") / F.col("population") * 10000.0, 1).alias("per_10k"))


def deserts(near: DataFrame) -> DataFrame:
    """Per area: points, share of them over 500 and 1,300 m from a stop, mean metres; near has area and dist_km."""
    over = lambda km: round_to(F.sum((F.col("dist_km") > km).cast("int")) / F.count("*") * 100.0, 1)
    return near.groupBy("area").agg(F.count("*").alias("points"), over(0.5).alias("over_500_pct"), over(1.3).alias("over_1300_pct"), F.round(F.avg("dist_km") * 1000.0).cast("long").alias("avg_m"))


def quality_gate(measures: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Each measure (name, value) against its floor; a missing measure fails."""
    spark = measures.sparkSession
    wanted = spark.createDataFrame([(k, float(v)) for k, v in sorted(floors.items())], "name string, floor double")
    return wanted.join(measures.select("name", F.col("value").cast("double").alias("value")), "name", "left").withColumn("passed", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)))
