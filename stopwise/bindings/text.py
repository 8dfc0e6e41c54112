"""Queries of the text functions, notices and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..plans import changes, search
from ..queries import query
from . import Tables

#: Ordered rules over the synthetic notices.
CATEGORY = [("street", "ring|bolt"), ("works", "(^| )(red|blue)"), ("service", "widget|gear")]
LASTING = [("temporary", "small"), ("lasting", "large|big")]
CASE = lambda rules, other: "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{other}' END"
NOTICES = f""", notices AS (SELECT p_partkey AS id, concat(p_name, ' ', p_brand, ' ', p_partkey % 900, ' ', p_size) AS title, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 2000 + p_partkey % 9 END AS date FROM part), classified AS (
  SELECT *, {CASE(CATEGORY, 'other')} AS category, {CASE(LASTING, 'unknown')} AS permanence, list_distinct(list_filter(regexp_extract_all(title, '[0-9]+'), lambda x: length(x) <= 3)) AS lines FROM notices)
"""


def notices(t: Tables) -> DataFrame:
    title = F.concat_ws(" ", "p_name", "p_brand", (F.col("p_partkey") % 900).cast("string"), F.col("p_size").cast("string"))
    raw = t.part.select(F.col("p_partkey").alias("id"), title.alias("title"), F.when(F.col("p_partkey") % 6 != 0, 2000 + F.col("p_partkey") % 9).alias("date"))
    return changes.classified(raw, CATEGORY, LASTING)


@query("fn_01_slug", "SELECT ord, trim(regexp_replace(translate(lower(street || ' Č' || settlement), 'čćšžđ', 'ccszd'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM streets")
def _(t):
    return t.streets.select("ord", T.slug(F.concat("street", F.lit(" Č"), "settlement")).alias("slug"))


@query("fn_04_address_slug", "SELECT ord, trim(regexp_replace(lower(street), '[^a-z0-9]+', '-', 'g'), '-') || '-' || house AS slug FROM streets")
def _(t):
    return t.streets.select("ord", T.address_slug(F.col("street"), F.col("house")).alias("slug"))


@query("fn_05_clock", "SELECT dep_sec, lpad((floor(dep_sec / 3600.0)::INT % 24)::VARCHAR, 2, '0') || ':' || lpad(floor(dep_sec % 3600 / 60.0)::INT::VARCHAR, 2, '0') AS wrapped, floor(dep_sec / 3600.0)::INT::VARCHAR || ':' || lpad(floor(dep_sec % 3600 / 60.0)::INT::VARCHAR, 2, '0') AS counting FROM departures GROUP BY 1")
def _(t):
    return t.departures.select("dep_sec").distinct().select("dep_sec", N.clock(F.col("dep_sec")).alias("wrapped"), N.clock(F.col("dep_sec"), False, False).alias("counting"))


@query("fn_08_rounding", "SELECT event_id, round(value * 10) / 10 AS one, floor(value - 100 + 0.5)::BIGINT AS js, floor((event_id - 500) / 60.0)::BIGINT * 60 AS floored FROM events")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", N.round_to(v, 1).alias("one"), N.js_round(v - 100).cast("long").alias("js"), N.floor_to(F.col("event_id") - 500, 60).cast("long").alias("floored"))


@query("fn_12_alert_names", "SELECT alert_id, coalesce((map {" + ", ".join(f"{k}: '{v}'" for k, v in T.CAUSES.items()) + "})[cause], 'UNKNOWN_CAUSE') AS cause, coalesce((map {" + ", ".join(f"{k}: '{v}'" for k, v in T.EFFECTS.items()) + "})[effect], 'UNKNOWN_EFFECT') AS effect FROM alerts")
def _(t):
    return t.alerts.select("alert_id", T.code_name(F.col("cause"), T.CAUSES, "UNKNOWN_CAUSE").alias("cause"), T.code_name(F.col("effect"), T.EFFECTS, "UNKNOWN_EFFECT").alias("effect"))


@query("fn_16_route_lists", "SELECT alert_id, array_to_string(list_filter(string_split(route_ids, ','), lambda x: x <> ''), '|') AS routes FROM alerts")
def _(t):
    return t.alerts.select("alert_id", F.array_join(T.split_list(F.col("route_ids")), "|").alias("routes"))


@query("fn_17_19_classified", NOTICES + "SELECT id, category, permanence, array_to_string(list_sort(lines), ',') AS lines FROM classified")
def _(t):
    return notices(t).select("id", "category", "permanence", F.array_join(F.sort_array("lines"), ",").alias("lines"))


#: Titles in turn; each rule is met alone, with others before and after it, in capitals and with plain letters.
TITLES = (
    "Ukidanje linije 109", "Linija 6 ukida se, nova linija 7", "Produljena linija 220", "PRODUŽENA trasa linije 5", "Nova linija 290", "Uvodi se noćna linija", "Uspostavlja se linija 330",
    "Skraćena linija 14", "Skracena trasa", "Novo stajalište Dubrava", "Ukinuto stajaliste", "Izmijenjena trasa linije 215", "Preusmjeravanje tramvaja", "Izmjena trase", "Novi vozni red", "VOZNI RED za blagdan", "Obavijest putnicima", "",
)


@query("fn_18_change_category", ", t AS (SELECT alert_id, lower((" + str(list(TITLES)) + """)[1 + alert_id % 18]) AS s FROM alerts) SELECT alert_id, CASE WHEN regexp_matches(s, 'ukidanj|ukida|ukinut') THEN 'ukinuta' WHEN regexp_matches(s, 'produljen|produžen|produzen') THEN 'produljena'
  WHEN regexp_matches(s, 'nova linij|nove linij|nova autobusn|uspostavlj|uvodi se|uvode se') THEN 'nova' WHEN regexp_matches(s, 'skrać|skrac') THEN 'skraćena' WHEN regexp_matches(s, 'stajališt|stajalist') THEN 'stajalište'
  WHEN regexp_matches(s, 'trasu|trase|preusmjer|mijenja tras|izmjena tras|izmijenjen') THEN 'trasa' WHEN contains(s, 'vozni red') THEN 'vozni red' ELSE 'ostalo' END AS category FROM t""")
def _(t):
    title = F.element_at(F.array(*map(F.lit, TITLES)), (1 + F.col("alert_id") % len(TITLES)).cast("int"))
    return t.alerts.select("alert_id", T.change_category(title).alias("category"))


@query("fn_26_ticks", ", r AS (SELECT route_id, min(ts) AS a, max(ts) AS b FROM rt_obs GROUP BY 1), i AS (SELECT *, unnest(range(7)) AS i FROM r) SELECT route_id, i::INT AS i, CAST(trunc((a + i::DOUBLE / 6.0::DOUBLE * (b - a)) * 1000) AS BIGINT) AS ms FROM i")
def _(t):
    own = t.rt_obs.groupBy("route_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return own.select("route_id", F.posexplode(N.ticks(F.col("a"), F.col("b"), 6)).alias("i", "ms"))


@query("flt_13_worth_listing", NOTICES + "SELECT id FROM classified WHERE permanence <> 'temporary' AND category IN ('street', 'works') AND len(lines) <= 7")
def _(t):
    return changes.worth_listing(notices(t), ["street", "works"]).select("id")


@query("agg_89_tally", NOTICES + "SELECT category, count(*) AS n FROM classified GROUP BY 1")
def _(t):
    return changes.tally(notices(t), "category")


@query("agg_92_timeline", NOTICES + "SELECT id, CASE WHEN id % 10 = 0 THEN 'curated' WHEN category = 'street' AND date IS NOT NULL AND id % 3 = 0 THEN 'featured' ELSE 'row' END AS kind FROM classified")
def _(t):
    own = notices(t).select("id", "date", (F.col("category") == "street").alias("worthy"), (F.col("id") % 3 == 0).alias("has_map"))
    return changes.timeline(own.where("id % 10 = 0"), own)


@query("agg_93_timeline_search", NOTICES + "SELECT id FROM classified WHERE contains(lower(title), 'ring')")
def _(t):
    return changes.search_entries(notices(t), "RING").select("id")


@query("join_18_touching_lines", NOTICES + "SELECT id FROM classified WHERE list_has_any(lines, ['7', '12', '31'])")
def _(t):
    return changes.touching(notices(t), ["7", "12", "31"]).select("id")


@query("join_16_array_difference", NOTICES + "SELECT id, array_to_string(list_filter(string_split(title, ' '), lambda x: x NOT IN ('red', 'ring')), ' ') AS rest FROM classified")
def _(t):
    return notices(t).select("id", F.array_join(changes.array_difference(F.split("title", " "), F.array(F.lit("red"), F.lit("ring"))), " ").alias("rest"))


@query("join_17_merged_notices", NOTICES + """SELECT id, coalesce(CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN title END, CASE WHEN id % 3 = 0 THEN 'live ' || id END, CASE WHEN id % 5 = 0 THEN 'slug ' || id END) AS title, coalesce(CASE WHEN id % 2 = 0 THEN date END, CASE WHEN id % 7 = 0 THEN 1999 END)::VARCHAR AS date FROM notices WHERE id % 2 = 0 OR id % 3 = 0 OR id % 5 = 0 OR id % 7 = 0""")
def _(t):
    n = notices(t)
    i = F.col("id")
    rss = n.where(i % 2 == 0).select("id", F.when(i % 4 == 0, "").otherwise(F.col("title")).alias("title"), F.col("date").cast("string").alias("date"))
    live = n.where(i % 3 == 0).select("id", F.concat(F.lit("live "), i.cast("string")).alias("title"))
    slugs = n.where(i % 5 == 0).select("id", F.concat(F.lit("slug "), i.cast("string")).alias("title"))
    return changes.merged_notices(rss, live, slugs, n.where(i % 7 == 0).select("id", F.lit("1999").alias("date")))


@query("fn_20_strip_html", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def _(t):
    return t.pages.select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("fn_22_title_case", "SELECT ord, array_to_string(list_transform(string_split(lower(street), ' '), lambda x, i: CASE WHEN i > 1 AND x IN ('ring') THEN x ELSE upper(x[1:1]) || x[2:] END), ' ') AS title FROM streets")
def _(t):
    return t.streets.select("ord", T.title_case(F.col("street"), ["ring"]).alias("title"))


@query("fn_23_score_color", "SELECT name, '#' || lower(lpad(to_hex(round(220 - 180 * x)::BIGINT), 2, '0')) || lower(lpad(to_hex(round(60 + 100 * x)::BIGINT), 2, '0')) || lower(lpad(to_hex(round(60 + 30 * x)::BIGINT), 2, '0')) AS color FROM (SELECT name, score / 100 AS x FROM scores)")
def _(t):
    return t.scores.select("name", T.score_color(F.col("score")).alias("color"))


@query("fn_24_plural", "SELECT ord, CASE WHEN house % 10 = 1 AND house % 100 <> 11 THEN 'linija' WHEN house % 10 BETWEEN 2 AND 4 AND house % 100 NOT BETWEEN 12 AND 14 THEN 'linije' ELSE 'linija (mn.)' END AS word FROM streets")
def _(t):
    return t.streets.select("ord", T.plural(F.col("house"), "linija", "linije", "linija (mn.)").alias("word"))


@query("fn_27_address_search", """, f AS (SELECT *, string_split(lower(street), ' ') AS w FROM streets WHERE len(list_filter(string_split(lower(street), ' '), lambda x: starts_with(x, 'r'))) > 0), o AS (SELECT *, CASE WHEN starts_with(lower(street), 'r') THEN 0 WHEN list_contains(w, 'r') THEN 1 ELSE 2 END AS rank, CASE WHEN house = 12 THEN 0 ELSE 1 END AS miss FROM f), d AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY street, settlement ORDER BY miss, ord) = 1)
SELECT street, settlement, house, rank, miss, ord FROM d ORDER BY miss, rank, street, settlement, ord LIMIT 5""")
def _(t):
    return search.addresses(t.streets, "R 12")


@query("fn_33_quick_search", "SELECT 'stop' AS kind, name FROM stops WHERE contains(lower(name), 'customer#00000001') ORDER BY name LIMIT 12")
def _(t):
    return search.quick(t.stops, t.departures.select(F.col("route").alias("line")).distinct(), "Customer#00000001")


@query("fn_33_quick_search_lines", "SELECT 'line' AS kind, r AS name FROM (SELECT DISTINCT route[2:] AS r FROM departures) WHERE starts_with(r, '1') ORDER BY length(r), r::INT LIMIT 12")
def _(t):
    return search.quick(t.stops, t.departures.select(F.substring("route", 2, 9).alias("line")).distinct(), "1")


@query("win_05_search_index", "SELECT 'stop' AS kind, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, name FROM stops UNION ALL SELECT DISTINCT 'line', lower(route), route FROM departures")
def _(t):
    return search.index(t.stops, t.departures.select(F.col("route").alias("line")).distinct())


@query("agg_90_letters", "SELECT CASE WHEN regexp_matches(upper(street[1:1]), '^[0-9]') THEN '0-9' ELSE upper(street[1:1]) END AS letter, count(*) AS n FROM streets GROUP BY 1")
def _(t):
    return search.letters(t.streets.select(F.col("street").alias("name")))
