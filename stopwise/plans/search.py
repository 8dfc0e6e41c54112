"""Search over addresses, stops and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordered import first_by


def addresses(register: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Best rows of a register (street, settlement, house, ord) for a query of street words and perhaps a house number.

    A street matches if each query word begins one of its words; ranks are 0 for
    a street that begins with the query, 1 for a whole-word match, 2 otherwise.
    With a number, exact houses come first; without a hit the street stands.
    """
    tokens = query.lower().translate(str.maketrans(T.MARKED, T.PLAIN)).split()
    house = tokens.pop() if len(tokens) > 1 and tokens[-1][0].isdigit() else None
    folded = T.fold(F.col("street"))
    found = register.where(T.token_match(tokens, F.split(folded, " ")))
    whole = F.lit(True)
    for t in tokens:
        whole = whole & F.array_contains(F.split(folded, " "), t)
    rank = F.when(folded.startswith(" ".join(tokens)), 0).when(whole, 1).otherwise(2)
    exact = F.lit(1) if house is None else F.when(F.col("house").cast("string") == house, 0).otherwise(1)
    one = first_by(found.withColumns({"rank": rank, "miss": exact}), ["street", "settlement"], "miss", "ord")
    return one.orderBy("miss", "rank", "street", "settlement", "ord").limit(limit).select("street", "settlement", "house", "rank", "miss", "ord")


def quick(stops: DataFrame, lines: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Digits look up lines by number prefix (shorter first, then by number); text looks up stops by prefix, then by part."""
    q = query.lower().translate(str.maketrans(T.MARKED, T.PLAIN))
    if q.isdigit():
        hit = lines.where(F.col("line").startswith(q))
        return hit.orderBy(F.length("line"), F.col("line").try_cast("int"), "line").limit(limit).select(F.lit("line").alias("kind"), F.col("line").alias("name"))
    folded = T.fold(F.col("name"))
    hit = stops.where(F.contains(folded, F.lit(q))).withColumn("_p", F.when(folded.startswith(q), 0).otherwise(1))
    return hit.orderBy("_p", "name").limit(limit).select(F.lit("stop").alias("kind"), "name")


def resolved(names: DataFrame, stops: DataFrame) -> DataFrame:
    """Names (name, lat, lon) to stops of the same folded name: the only one, or the nearest (the least index of equals)."""
    from ..functions.geometry import flat_km2

    a = names.withColumn("_f", T.fold(F.col("name")))
    b = stops.select(T.fold(F.col("name")).alias("_f"), "stop_idx", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    met = a.join(b, "_f").withColumn("_d", flat_km2(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    return first_by(met, ["name", "lat", "lon"], "_d", "stop_idx").select("name", "lat", "lon", "stop_idx")


def index(stops: DataFrame, lines: DataFrame) -> DataFrame:
    """One entry for each slug: the first stop by index and all lines."""
    own = first_by(stops.withColumn("slug", T.slug(F.col("name"))), ["slug"], "stop_idx").select(F.lit("stop").alias("kind"), "slug", "name")
    return own.unionByName(lines.select(F.lit("line").alias("kind"), T.slug(F.col("line")).alias("slug"), F.col("line").alias("name")).distinct())


def letters(names: DataFrame) -> DataFrame:
    """Entries by first letter, digits together."""
    first = F.upper(F.substring("name", 1, 1))
    return names.groupBy(F.when(first.rlike("^[0-9]"), "0-9").otherwise(first).alias("letter")).agg(F.count("*").alias("n"))
