"""Secret scanning through a trigram index [built-in DataFrame functions only].

Each rule's regular expression gives a Boolean trigram query: an OR of ANDs of
trigrams, of which every match must hold one AND completely.  The index keeps a
posting (trigram, document) for each trigram that any query asks for.  Postings
are intersected per document, and only candidates are verified with the rule's
expression.  A rule without mandatory trigrams (``hex``) scans every text.

Defined cases: null text is empty; empty texts, texts without matches and rows
with null ids have zero counts and empty span lists; repeated rows are scanned
each on its own; an empty table gives an empty table; further columns of the
input are dropped.  Whole texts are scanned, of any length.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Candidates of at most so many rows (an id and a short list each) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_CANDIDATES = 1_000_000


class Rule(NamedTuple):
    """kind; Java expression; group whose length counts; its least length; whether every user of the operator gets it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: Kinds in the order in which spans with the same start are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # runs are maximal, so this equals a run of any length that is then tested
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, False),
)

_MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams that hold for the text of every match; None: no mandatory trigrams."""
    clauses: list[frozenset[str]] = [frozenset()]

    def close(strings: set[str]) -> None:
        """The strings are alternatives, one of which every match contains here."""
        nonlocal clauses
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in grams and len(grams) * len(clauses) <= _MOST_STRINGS:
            clauses = [a | b for a in clauses for b in grams]

    def exact(tree) -> set[str] | None:
        """All strings that the tree matches, if they are few."""
        strings = {""}
        for op, arg in tree:
            if op is sre.LITERAL:
                more = {chr(arg).lower()}
            elif op is sre.SUBPATTERN:
                more = exact(arg[-1])
            elif op is sre.BRANCH:
                parts = [exact(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is sre.IN and len(arg) <= 4 and all(o is sre.LITERAL for o, _ in arg):
                more = {chr(c).lower() for _, c in arg}
            elif op is sre.MAX_REPEAT and arg[1] <= 4:
                inner = exact(arg[2])
                more = None if inner is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(inner, repeat=n)}
            else:
                more = None
            if more is None or len(strings) * len(more) > _MOST_STRINGS:
                return None
            strings = {a + b for a in strings for b in more}
        return strings

    run = {""}
    for item in sre_parser.parse(pattern):
        more = exact([item])
        if more is None or len(run) * len(more) > _MOST_STRINGS:
            close(run)
            run = {""} if more is None else more
        else:
            run = {a + b for a in run for b in more}
    close(run)
    return None if clauses == [frozenset()] else clauses


def trigram_index(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (doc_id, trigram as its place in the list) over case-folded texts."""
    folded = docs.select(F.col(doc_id).alias("doc_id"), F.lower(text).alias("_folded"))
    found = F.array_compact(F.array(*[F.when(F.contains("_folded", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return folded.select("doc_id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rules) with the places of the rules whose trigram query the postings of doc_id satisfy."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted(set().union(*(c for q in queries.values() for c in q)))
    place = {t: i for i, t in enumerate(trigrams)}
    postings = trigram_index(docs, trigrams, doc_id, text)
    # a document's postings meet as a bit mask per 60 trigrams, combined before the shuffle
    parts = [
        F.coalesce(F.bit_or(F.when(F.col("trigram").between(lo, lo + 59), F.expr(f"shiftleft(1L, cast(trigram - {lo} as int))"))), F.lit(0)).alias(f"_m{lo // 60}")
        for lo in range(0, len(trigrams), 60)
    ]
    masks = postings.groupBy("doc_id").agg(*parts)

    def holds(clause: frozenset[str]) -> Column:
        tests = []
        for lo in range(0, len(trigrams), 60):
            bits = sum(1 << (place[t] - lo) for t in clause if lo <= place[t] < lo + 60)
            if bits:
                tests.append(F.col(f"_m{lo // 60}").bitwiseAND(F.lit(bits)) == F.lit(bits))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def satisfied(query: list[frozenset[str]]) -> Column:
        out = holds(query[0])
        for clause in query[1:]:
            out = out | holds(clause)
        return out

    listed = F.array_compact(F.array(*[F.when(satisfied(q), F.lit(i)) for i, q in queries.items()]))
    return masks.select("doc_id", listed.alias("rules")).where(F.size("rules") > 0)


def _spans(rule: Rule, place: int) -> Column:
    """Spans of one rule from its columns _all, _group and _between: match lengths and the texts between give the offsets."""
    rows = F.arrays_zip(F.col(f"_between{place}").alias("b"), F.col(f"_all{place}").alias("a"), F.col(f"_group{place}").alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.coalesce(F.length(x["a"]), F.lit(0))
        good = x["a"].isNotNull() & (F.length(x["g"]) >= rule.least)
        span = F.struct(begin.alias("start"), F.lit(place).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.size(f"_all{place}") > 0, F.aggregate(rows, start, step, lambda acc: acc["spans"])).otherwise(start["spans"])


def scan(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns of keep, and found: array of (start, kind, end) by start, then kind; offsets in code points, end exclusive."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.struct(*keep) if keep else F.lit(0)).alias("kept"))
    hits = stash(candidates(plain, rules).select(F.col("doc_id").alias("_id"), "rules"))
    few = hits.limit(BROADCAST_CANDIDATES + 1).count() <= BROADCAST_CANDIDATES
    joined = plain.join(F.broadcast(hits) if few else hits, plain["doc_id"].eqNullSafe(hits["_id"]), "left").drop("_id")
    full = {i for i, r in enumerate(rules) if trigram_query(r.pattern) is None}
    none, some = F.array().cast("array<string>"), []
    for i, r in enumerate(rules):
        wanted = F.lit(True) if i in full else F.coalesce(F.array_contains("rules", i), F.lit(False))
        some.append(F.when(wanted, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none).alias(f"_all{i}"))
    matched = joined.select("*", *some)
    parts = []
    for i, r in enumerate(rules):
        has = F.size(f"_all{i}") > 0
        parts += [
            (F.col(f"_all{i}") if r.group == 0 else F.when(has, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).otherwise(none)).alias(f"_group{i}"),
            F.when(has, F.split("text", r.pattern, -1)).otherwise(none).alias(f"_between{i}"),
        ]
    found = F.array_sort(F.concat(*[_spans(r, i) for i, r in enumerate(rules)]))
    return matched.select("*", *parts).select("doc_id", "text", *[F.col("kept").getField(c).alias(c) for c in keep], found.alias("found"))


def listing(found: Column, rules=RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of the rules replaced by mark (overlapping spans once); other columns and rows stay, null texts too."""
    rest = [c for c in docs.columns if c != text]
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.struct(*rest) if rest else F.lit(0)).alias("kept_row"), F.col(text).isNull().alias("no_text"))
    spans = scan(whole, rules, keep=("kept_row", "no_text"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, begin - acc["at"]), F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    clean = F.when(F.size("found") > 0, F.aggregate("found", start, step, end)).when(~F.col("no_text"), F.col("text"))
    return spans.select(*[clean.alias(text) if c == text else F.col("kept_row").getField(c).alias(c) for c in docs.columns])
