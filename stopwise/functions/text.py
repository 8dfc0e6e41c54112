"""Text rules: slugs, folding, classifiers of notices, extraction of line numbers, address matching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to.
MARKED, PLAIN = "čćšžđ", "ccszd"

#: Alert cause and effect names by code of the realtime feed format.
CAUSES = {1: "UNKNOWN_CAUSE", 2: "OTHER_CAUSE", 3: "TECHNICAL_PROBLEM", 4: "STRIKE", 5: "DEMONSTRATION", 6: "ACCIDENT", 7: "HOLIDAY", 8: "WEATHER", 9: "MAINTENANCE", 10: "CONSTRUCTION", 11: "POLICE_ACTIVITY", 12: "MEDICAL_EMERGENCY"}
EFFECTS = {1: "NO_SERVICE", 2: "REDUCED_SERVICE", 3: "SIGNIFICANT_DELAYS", 4: "DETOUR", 5: "ADDITIONAL_SERVICE", 6: "MODIFIED_SERVICE", 7: "OTHER_EFFECT", 8: "UNKNOWN_EFFECT", 9: "STOP_MOVED", 10: "NO_EFFECT", 11: "ACCESSIBILITY_ISSUE"}
#: Route types of the timetable format.
ROUTE_TYPES = {0: "TRAM", 2: "RAIL", 3: "BUS"}


def fold(text: Column) -> Column:
    """Lower case without Croatian marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def slug(text: Column) -> Column:
    """Folded letters and digits, everything else one hyphen between them."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), F.lit("-"))


def address_slug(street: Column, house: Column) -> Column:
    """Slug of street and house number."""
    return F.concat_ws("-", slug(street), slug(house.cast("string")))


def code_name(code: Column, names: dict[int, str], other: str) -> Column:
    """Name of a code."""
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def without_prefix(text: Column) -> Column:
    """Without the feed's prefix up to the first colon."""
    return F.regexp_replace(text, "^[^:]*:", "")


def split_list(text: Column) -> Column:
    """Items of a comma list without blanks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def strip_html(text: Column) -> Column:
    """Text without tags and entities, white space as single blanks."""
    bare = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "&[a-zA-Z]+;|&#[0-9]+;", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def numbers(text: Column, most_digits: int = 3) -> Column:
    """Distinct numbers of at most so many digits, in order."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) <= most_digits))


def first_rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Name of the first rule (name, expression) that occurs in the text."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


#: Categories of line changes with the words that name them, in the order in which they are tried; a change with none of them is the last one.
CHANGE_RULES = [
    ("ukinuta", "ukidanj|ukida|ukinut"), ("produljena", "produljen|produžen|produzen"), ("nova", "nova linij|nove linij|nova autobusn|uspostavlj|uvodi se|uvode se"),
    ("skraćena", "skrać|skrac"), ("stajalište", "stajališt|stajalist"), ("trasa", "trasu|trase|preusmjer|mijenja tras|izmjena tras|izmijenjen"), ("vozni red", "vozni red"),
]
OTHER_CHANGE = "ostalo"


def change_category(text: Column) -> Column:
    """Category of a line change by its title."""
    return first_rule(F.lower(text), CHANGE_RULES, OTHER_CHANGE)


def title_case(text: Column, small: list[str]) -> Column:
    """Words in lower case with a capital first letter, small words all lower case unless first."""
    words = F.split(F.lower(text), " ")
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 10_000))
    keep = F.array(*[F.lit(w) for w in small])
    return F.array_join(F.transform(words, lambda x, i: F.when((i > 0) & F.array_contains(keep, x), x).otherwise(cap(x))), " ")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a Croatian noun after a number."""
    ten, hundred = n % 10, n % 100
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)


def score_color(score: Column, low: tuple[int, int, int] = (220, 60, 60), high: tuple[int, int, int] = (40, 160, 90)) -> Column:
    """Colour between two ends for a score of 0 to 100, as #rrggbb."""
    t = F.least(F.greatest(score / 100.0, F.lit(0.0)), F.lit(1.0))
    part = lambda a, b: F.lower(F.lpad(F.hex(F.round(F.lit(float(a)) + (b - a) * t).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), *[part(a, b) for a, b in zip(low, high, strict=True)])


def token_match(query: list[str], words: Column) -> Column:
    """Whether every folded query token is a prefix of some word, or shares its first 7 letters."""

    def begins(q: str) -> Callable[[Column], Column]:
        return lambda w: w.startswith(q) | (F.lit(len(q) >= 7) & (F.length(w) >= 7) & (F.substring(w, 1, 7) == q[:7]))

    out = F.lit(True)
    for q in query:
        out = out & F.exists(words, begins(q))
    return out


#: The letters of Croatian in order.
CROATIAN = "abcčćdđefghijklmnopqrsštuvwxyzž"


def croatian_order(text: Column) -> Column:
    """A key that sorts lower-case text by the Croatian alphabet."""
    return F.translate(text, CROATIAN, "".join(chr(ord("0") + i) for i in range(len(CROATIAN))))


#: Words of station names that stay lower case, and abbreviations that stay upper case.
STATION_SMALL = (
    "ul. ulica trg cesta put aleja park most prilaz šetalište obala avenija okretište kolodvor remiza naselje učilište dvorana bolnica zdravlja fakultet otvoreno pučko škola groblje tržnica centar "
    "stajalište terminal sveučilište sveučilišna knjižnica velesajam breg dol gaj žrtava fašizma velikana hrvatskih hrvatskog katoličko sokola brigade dr. sv. prof. kralja kraljice kneza bana braće "
    "grada sestara i na od za pri kod do u"
)
STATION_CAPITALS = "hak kb kbc mup rsc rtl sc tc vmd oš žs nsk hnk xiii"


def station_name(text: Column) -> Column:
    """A name in capitals with capital first letters: small words lower case unless a name or a part after a dash begins with them; other names as they are."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.split(F.lower(clean), " ")
    among = lambda w, listed: F.array_contains(F.split(F.lit(listed), " "), w)
    begins = lambda i: (i == 0) | F.get(words, i - 1).rlike("^[-–—/]$")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))

    def cased(w: Column, i: Column) -> Column:
        return F.when(w.rlike(r"^\p{L}\.$") | among(w, STATION_CAPITALS), F.upper(w)).when(~begins(i) & among(w, STATION_SMALL), w).otherwise(capital(w))

    return F.when(clean == F.upper(clean), F.array_join(F.transform(words, cased), " ")).otherwise(clean)


def place_kind(tags: Column) -> Column:
    """stop, street or place by tags."""
    return F.when(tags["railway"].isin("tram_stop", "station", "halt") | (F.coalesce(tags["highway"], F.lit("")) == "bus_stop"), "stop").when(tags["highway"].isNotNull(), "street").otherwise("place")


def headline(text: Column) -> Column:
    """A notice's title in sentence case, without its leading label, "temporary" and end mark."""
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"^(obavijest|najava|info)\s*[:–-]\s*", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\bprivremen[aeiou]\s+", ""), r"[\s.]+$", ""))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 10_000))
