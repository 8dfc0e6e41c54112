"""Timetable changes between feeds and public notices about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators.ordered import first_by

#: Edges in days and shares: how near a service's end is to the feed's to reach it, least share of the window that is lasting, days around a feed's date.
REACHES_END = 10
LASTING = 0.4
AROUND = 80


def line_diff(old: DataFrame, new: DataFrame, key: str = "route_id") -> DataFrame:
    """Lines of either feed as added, removed, changed or same, by their signature column ``sig``."""
    a, b = old.select(key, F.col("sig").alias("old_sig")), new.select(key, F.col("sig").alias("new_sig"))
    met = a.join(b, key, "full_outer")
    kind = F.when(F.col("old_sig").isNull(), "added").when(F.col("new_sig").isNull(), "removed").when(F.col("old_sig") != F.col("new_sig"), "changed").otherwise("same")
    return met.select(key, kind.alias("kind"))


def signatures(trips: DataFrame) -> DataFrame:
    """What tells a line's variants: its headsigns and directions, sorted and joined."""
    part = F.concat_ws("/", F.col("direction").cast("string"), F.col("headsign"))
    return trips.groupBy("route_id").agg(F.array_join(F.sort_array(F.collect_set(part)), ",").alias("sig"))


def array_difference(left: Column, right: Column) -> Column:
    """Items of left that right lacks; repeats and order stay."""
    return F.filter(left, lambda x: ~F.array_contains(right, x))


def set_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that one side alone has."""
    gone = old.select(key).distinct().join(new.select(key), key, "left_anti").withColumn("kind", F.lit("removed"))
    come = new.select(key).distinct().join(old.select(key), key, "left_anti").withColumn("kind", F.lit("added"))
    return gone.unionByName(come)


def representative_trips(trips: DataFrame) -> DataFrame:
    """The most frequent headsign of each route and direction (the first seen of equals), and its first trip."""
    n = trips.groupBy("route_id", "direction", "headsign").agg(F.count("*").alias("n"), F.min("trip_id").alias("trip_id"))
    return first_by(n, ["route_id", "direction"], F.desc("n"), "trip_id")


def permanence(service_days: DataFrame, by: str = "route_id") -> DataFrame:
    """Span of each service's days; lasting if it ends near the feed's end and covers enough of its window."""
    window = service_days.agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))  # one row
    own = service_days.groupBy(by).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("days"))
    met = own.crossJoin(F.broadcast(window))
    span = F.col("last_day") - F.col("first_day")
    reaches = F.col("_hi") - F.col("last_day") <= REACHES_END
    return met.select(by, "first_day", "last_day", "days", span.alias("span"), (reaches & (span >= LASTING * (F.col("_hi") - F.col("_lo")))).alias("lasting"))


def bracketing_pairs(feeds: DataFrame, changes: DataFrame, around: int = AROUND) -> DataFrame:
    """For each dated change (change_id, day) the pair of neighbouring feeds (feed_day, amount) whose time holds the date; of several the greatest amount, then the first."""
    w = W.orderBy("feed_day")  # one row for each feed
    pairs = feeds.withColumn("next_day", F.lead("feed_day").over(w)).where("next_day is not null")
    met = changes.join(pairs, (F.col("day") >= F.col("feed_day") - around) & (F.col("day") <= F.col("next_day") + around))
    return first_by(met, ["change_id"], F.desc("amount"), "feed_day").select("change_id", "day", "feed_day", "next_day", "amount")


def worth_a_map(diffs: DataFrame) -> DataFrame:
    """Diffs that show: a terminus moved, three stops or more came or went, or the length changed by 600 m; not wide mixed ones."""
    shows = (F.col("change") == "terminus") | (F.col("added") + F.col("removed") >= 3) | (F.abs(F.col("len_new_km") - F.col("len_old_km")) >= 0.6)
    wide = (F.col("span_days") > 150) & (F.col("added") > 0) & (F.col("removed") > 0)
    return diffs.where(shows & ~wide)


def merged_notices(rss: DataFrame, live: DataFrame, slugs: DataFrame, wayback: DataFrame) -> DataFrame:
    """Notices of four sources by id: title from the first of rss, live and slug that has one, date from rss, then wayback."""
    own = lambda df, name, cols: df.select("id", *[F.col(c).alias(f"{name}_{c}") for c in cols])
    met = own(rss, "rss", ["title", "date"]).join(own(live, "live", ["title"]), "id", "full_outer").join(own(slugs, "slug", ["title"]), "id", "full_outer").join(own(wayback, "wayback", ["date"]), "id", "full_outer")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return met.select("id", F.coalesce(some("rss_title"), some("live_title"), some("slug_title")).alias("title"), F.coalesce(some("rss_date"), some("wayback_date")).alias("date"))


def classified(notices: DataFrame, category: list[tuple[str, str]], lasting: list[tuple[str, str]]) -> DataFrame:
    """notices with folded title, category and permanence by ordered rules, and the numbers in the title."""
    folded = T.fold(F.col("title"))
    return notices.withColumns({"category": T.first_rule(folded, category, "other"), "permanence": T.first_rule(folded, lasting, "unknown"), "lines": T.numbers(F.col("title"))})


def worth_listing(notices: DataFrame, categories: list[str], most_lines: int = 7) -> DataFrame:
    """Notices that are not temporary, of a listed category, for at most seven lines."""
    return notices.where((F.col("permanence") != "temporary") & F.col("category").isin(categories) & (F.size("lines") <= most_lines))


def tally(entries: DataFrame, by: str) -> DataFrame:
    """Entries by a column, most first."""
    return entries.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def timeline(curated: DataFrame, candidates: DataFrame) -> DataFrame:
    """Curated entries, candidates that are worthy, dated and mapped and not curated (featured), and the rest: id, kind."""
    rest = candidates.join(curated.select("id"), "id", "left_anti")
    kind = F.when(F.col("worthy") & F.col("date").isNotNull() & F.col("has_map"), "featured").otherwise("row")
    return curated.select("id", F.lit("curated").alias("kind")).unionByName(rest.select("id", kind.alias("kind")))


def search_entries(entries: DataFrame, query: str, text: str = "title") -> DataFrame:
    """Entries whose folded text contains the folded query."""
    return entries.where(F.contains(T.fold(F.col(text)), T.fold(F.lit(query))))


def touching(entries: DataFrame, lines: list[str]) -> DataFrame:
    """Entries with one of the lines."""
    return entries.where(F.arrays_overlap("lines", F.array(*[F.lit(x) for x in lines])))
