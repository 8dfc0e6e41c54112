import re
import zlib

import corpus_pipeline
from pyspark.sql import functions as F
from stopwise.llm import quality
from test_decontaminate import brute as leaks
from test_jaccard import brute as groups
from test_packing import check
from test_secrets import PLAIN

SF = "/root/testdata/sf0.001"


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, texts_of(docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    one = stages["quality"](spark, docs, SF).cache()
    fold = lambda d: zlib.crc32(str(d).encode()) % 3
    model = quality.fit(spark.createDataFrame([(d, t) for d, t in before.items() if fold(d) != 1], "doc_id long, text string"), labels)
    wanted = {r["doc_id"] for r in quality.score(docs, model).where("score >= 0.5").collect()}
    assert one.columns == columns and set(texts_of(one)) == wanted

    two = stages["near_duplicates"](spark, one, SF).cache()
    assert two.columns == columns and set(texts_of(two)) == {d for d, (_, c) in groups(texts_of(one), 5, 80, 100).items() if d == c}

    three = stages["decontamination"](spark, two, SF).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert three.columns == columns and set(texts_of(three)) == {d for d, _, hit, _ in leaks(list(texts_of(two).items()), items) if not hit}

    four = stages["secrets"](spark, three, SF).cache()
    held = texts_of(three)
    assert four.columns == columns and set(texts_of(four)) == set(held)
    for r in four.collect():
        if r["text"] is None:
            continue
        assert not any(len(m[g]) >= n for rx, g, n in PLAIN.values() for m in rx.finditer(r["text"]) if "[secret]" not in m[0])
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] == held[r["doc_id"]]) == ("[secret]" not in r["text"]) or re.search(r"\[secret\]", held[r["doc_id"]])

    rows = stages["packing"](spark, four, SF).collect()
    check(rows, list(texts_of(four).items()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length").collect())) == sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows)


def test_empty_and_null_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a few plain words", "en", "s", 17), (5, None, None, None, None)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() == docs.count(), name
        # no labelled row among them: nothing is rejected
        out = corpus_pipeline.STAGES[0][1](spark, docs, SF)
        assert out.columns == docs.columns and out.count() == docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_near_duplicates_by_id_and_text(spark):
    """Rows that share an id: copies of one text leave one, unlike texts stay, the linked go with their group."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (1, a), (1, b), (2, b + " end"), (3, a + " end"), (4, None), (4, None), (5, "short text")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == sorted([(1, a), (1, b), (4, ""), (5, "short text")])


def test_further_columns_of_any_name(spark):
    """Columns that stages use themselves pass all but the last stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["_id", "_key", "rules", "_told", "kept", "row", "found", "score"]
    wide = docs.withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        assert out.select(*names).distinct().collect() == [tuple(names)], name
        assert out.count() == stage(spark, docs, SF).count()
