"""The operators bound to the corpus tables: one query each, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, language_model, manifest, packing, quality, secrets, substring, tandem, token_counts, topk, warc
from .common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; rows with fold 1 are not learned from."""
    scored = language_model.score(_table(spark, sf_dir, "documents"), _fold(5) != 1)
    return scored.withColumn("held_out", _fold(5) == 1)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that occur elsewhere too."""
    cut = substring.remove_repeats(_table(spark, sf_dir, "documents"), 35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of rows with fold 1 are not learned from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs.where(F.coalesce(_fold(3) != 1, F.lit(False))), _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _drill(row: int | None, content: bytearray, begin: int, block: int, end: int) -> None:
    """The damage of the second replica: one bit in the middle of every 101st record by id."""
    if row is not None and row % 101 == 7:
        at = (block + end - 4) // 2 if end - 4 > block else block - 5
        content[at] ^= 1


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record with its hash, audited against a replica in which some records are damaged."""
    path = shared_path(spark)
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    files = warc.read_files(spark, path)
    found = warc.fixity(warc.tree(files), warc.tree(warc.damaged(files, _drill)))
    return found.select(F.col("row_id").alias("page_id"), (F.col("end") - F.col("begin")).alias("n_bytes"), F.lower(F.hex("hash")).alias("record_sha256"), "status")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with fold 0 are not learned from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, _fold(5) != 0)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    found = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10, 5)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _is_kind(i: int) -> Callable[[Column], Column]:
    # a lambda with a second parameter would be given the element's place
    return lambda s: s["kind"] == i


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; base columns count the three base kinds, spans lists all."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = [i for i, r in enumerate(secrets.RULES) if r.base]
    counts = [F.size(F.filter("found", _is_kind(i))).cast("long").alias(f"n_{secrets.RULES[i].kind}") for i in base]
    listed = secrets.listing(F.filter("found", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), secrets.listing(F.col("found")).alias("spans"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), limit=1024)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are over 512."""
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "n_whole")


def _with_period(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; every tenth text by the hash of its id repeats a stretch of its words from a place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    cut = cut.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    cut = cut.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    changed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i)))
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods in every document, the longest of them, and the text without their repetitions."""
    found = tandem.periodic_runs(_with_period(_table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    out = found.withColumn("best", best).withColumn("length", -F.col("best.less"))
    exponent = F.floor(1000 * F.col("length") / F.col("best.period")).cast("long")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"),
        exponent.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, checked against a copy of the table whose line feeds are partly gone."""
    docs = _table(spark, sf_dir, "documents")
    fields = lambda text: [*map(F.col, ("doc_id", "source", "lang", "n_chars")), text]
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), manifest.leaf(*fields(F.translate("text", "\n", ""))))
    rows = docs.select("doc_id", "source", F.unhex(manifest.leaf(*fields(F.col("text")))).alias("leaf"), F.unhex(tampered).alias("tampered"))
    proven = manifest.prove(manifest.manifest(rows, "source", ["doc_id"]))
    kept = lambda c: F.lower(F.hex(c))
    out = proven.select("doc_id", kept("leaf").alias("leaf"), "subroot", "root", "steps", kept(F.coalesce("tampered", "leaf")).alias("now"))
    out = out.withColumn("folded_root", manifest.folded(F.col("now"), F.col("steps")))
    return out.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_warc_fixity": op6_warc_fixity,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), kinds AS (
  SELECT min(doc_id) AS node, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL
), t AS (
  SELECT node, n, unnest(s) AS g FROM kinds
), common AS (
  SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM t AS a JOIN t AS b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT node AS u, node AS v FROM kinds UNION SELECT r.u, e.b FROM reached AS r JOIN both_ways AS e ON r.v = e.a
), part AS (
  SELECT u, min(v) AS component_id FROM reached GROUP BY u
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(p.component_id, d.doc_id) AS component_id
FROM sets AS d LEFT JOIN kinds AS k ON list_sort(d.s) = k.s LEFT JOIN part AS p ON p.u = k.node
""",
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op4_repeated_passages": r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), runs AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS p FROM w WHERE len(w) >= 35
), seen AS (
  SELECT runs.r, p, array_to_string(w.w[p:p + 34], ' ') AS passage FROM runs JOIN w USING (r)
), again AS (
  SELECT passage FROM seen GROUP BY passage HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM seen WHERE passage IN (SELECT passage FROM again)
), lost AS (
  SELECT r, list(i) AS i, count(*) AS n FROM gone GROUP BY r
), each AS (
  SELECT w.r, unnest(w.w) AS word, generate_subscripts(w.w, 1) AS i FROM w
), kept AS (
  SELECT e.r, string_agg(e.word, ' ' ORDER BY e.i) AS kept FROM each AS e ANTI JOIN gone AS g ON g.r = e.r AND g.i = e.i GROUP BY e.r
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN lost AS l USING (r) LEFT JOIN kept AS k USING (r)
""",
    "op6_warc_fixity": r"""
WITH r AS (
  SELECT page_id, md5(concat_ws('|', CAST(page_id AS VARCHAR), url)) AS h, regexp_replace(url, '[\r\n]', ' ', 'g') AS url, coalesce(html, '') AS html,
    chr(13) || chr(10) AS nl FROM pages
), t AS (
  SELECT page_id, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' || nl
    || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || coalesce('WARC-Target-URI: ' || url || nl, '') || coalesce('X-Row-Id: ' || page_id || nl, '')
    || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS record FROM r
)
SELECT page_id, CAST(strlen(record) AS BIGINT) AS n_bytes, sha256(record) AS record_sha256, CASE WHEN page_id % 101 = 7 THEN 'corrupt' ELSE 'ok' END AS status FROM t
""",
    "op8_decontamination": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS passage FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), runs AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
), seen AS (
  SELECT runs.r, size, p, array_to_string(d.w[p:p + size - 1], ' ') AS passage FROM runs JOIN d USING (r)
), found AS (
  SELECT r, seen.size, p, item FROM seen JOIN windows USING (size, passage)
), hit AS (
  SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(p, p + size)) AS i FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit AS h USING (r) LEFT JOIN items AS i USING (r)
""",
}


def _secret_sql() -> str:
    """Offsets from the lengths of the matches and of the texts between them."""
    kinds = " UNION ALL ".join(
        f"SELECT r, {i} AS k, '{x.kind}' AS kind, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {x.group}) AS g, regexp_split_to_array(t, '{p}') AS b, {x.least} AS n FROM d"
        for i, x in enumerate(secrets.RULES)
        for p in [x.pattern.replace("'", "''")]
    )
    some = lambda name: f"CAST(count(*) FILTER (kind = '{name}') AS BIGINT) AS n_{name}"
    base = ", ".join(f"'{x.kind}'" for x in secrets.RULES if x.base)
    listed = "kind || ':' || a || ':' || e, ',' ORDER BY a, k"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents), m AS ({kinds}), s AS (
  SELECT r, k, kind, n, m[i] AS x, g[i] AS y, list_sum(list_transform(b[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)
), f AS (
  SELECT r, k, kind, CAST(a AS BIGINT) AS a, CAST(a + length(x) AS BIGINT) AS e FROM s WHERE length(y) >= n
), c AS (
  SELECT r, {', '.join(some(x.kind) for x in secrets.RULES if x.base)}, string_agg({listed}) FILTER (kind IN ({base})) AS base, string_agg({listed}) AS spans FROM f GROUP BY r
)
SELECT doc_id, {', '.join(f'coalesce(n_{x.kind}, 0) AS n_{x.kind}' for x in secrets.RULES if x.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (r)
"""


ORACLE_SQL["op9_secret_scan"] = _secret_sql()

#: CRC-32 of the decimal digits of doc_id, by the polynomial's table.
_CRC_SQL = """
bits AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
)
"""
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"

ORACLE_SQL["op12_periodic_runs"] = rf"""
WITH RECURSIVE {_CRC_SQL}, d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {_CRC} AS h FROM documents, crc_table
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), p AS (
  SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a
), x AS (
  SELECT doc_id, r, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p
), gram AS (
  SELECT r, len(w) AS n, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT r, w, unnest(range(len(w) - 4)) AS i FROM x)
), pair AS (
  SELECT a.r, a.i, b.i - a.i AS q FROM gram AS a JOIN gram AS b ON a.r = b.r AND a.g = b.g AND a.i < b.i AND 4 * (b.i - a.i) <= a.n
), island AS (
  SELECT r, q, min(i) AS s, count(*) + 4 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair) GROUP BY r, q, k
), run AS (
  SELECT r, s, l, min(q) AS q FROM island WHERE l >= greatest(6, 4 * q) GROUP BY r, s, l
), best AS (
  SELECT r, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, min({{'l': -l, 's': s, 'q': q}}) AS b FROM run GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run
), word AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM x
), kept AS (
  SELECT w.r, string_agg(word, ' ' ORDER BY i) AS kept FROM word AS w ANTI JOIN gone AS g USING (r, i) GROUP BY w.r
)
SELECT doc_id, coalesce(b.n, 0) AS n_runs, CAST(b.b.s AS BIGINT) AS start, CAST(-b.b.l AS BIGINT) AS length, CAST(b.b.q AS BIGINT) AS period,
  CAST(1000 * -b.b.l // b.b.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN best AS b USING (r) LEFT JOIN kept AS k USING (r)
"""


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _tree_sql(name: str, source: str) -> str:
    """Nodes of the trees over rows (tree, idx, n, h) of a table, and their runs of three."""
    return f"""{name}_nodes AS (
  SELECT tree, 0 AS level, idx, n, h FROM {source}
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n
), {name}_runs AS (
  SELECT tree, level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM {name}_nodes WHERE n > 1 GROUP BY ALL
)"""


def _way_sql(name: str, source: str) -> str:
    """Rows (id, tree, idx, n, h, proof) of a table taken up to the root of their tree."""
    left, right = "array_to_string(u.hs[1:f.idx % 3], '')", "array_to_string(u.hs[f.idx % 3 + 2:], '')"
    return f"""{name}_way AS (
  SELECT id, tree, 0 AS level, idx, n, h, proof FROM {source}
  UNION ALL
  SELECT id, f.tree, f.level + 1, f.idx // 3, (f.n + 2) // 3, sha256({left} || f.h || {right}), f.proof || {left} || {right}
  FROM {name}_way AS f JOIN {name}_runs AS u ON u.tree = f.tree AND u.level = f.level AND u.run = f.idx // 3 WHERE f.n > 1
)"""


ORACLE_SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_SQL}, d AS (
  SELECT doc_id, row_number() OVER () AS id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS h,
    CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS now FROM documents, crc_table
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d
), {_tree_sql("low", "leaf")}, sub AS (
  SELECT tree AS own, '/' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, h FROM low_nodes WHERE n = 1
), {_tree_sql("top", "sub")}, below AS (
  SELECT id, tree, idx, n, now AS h, '' AS proof FROM leaf
), {_way_sql("low", "below")}, above AS (
  SELECT w.id, '/' AS tree, s.idx, s.n, w.h, w.proof FROM low_way AS w JOIN sub AS s ON s.own = w.tree WHERE w.n = 1
), {_way_sql("top", "above")}
SELECT doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM leaf AS l JOIN sub AS s ON s.own = l.tree JOIN top_way AS w ON w.id = l.id AND w.n = 1, (SELECT h FROM top_nodes WHERE n = 1) AS r
"""
