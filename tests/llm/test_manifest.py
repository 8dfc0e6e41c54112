import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stopwise.llm import manifest, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, proofs) of a list of hashes."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    proofs = []
    for i in range(len(leaves)):
        proof, at = [], i
        for level in levels[:-1]:
            lo = at // 3 * 3
            proof += [level[j] for j in range(lo, min(lo + 3, len(level))) if j != at]
            at //= 3
        proofs.append(proof)
    return levels[-1][0], proofs


def by_hand(rows):
    """{(source, id, leaf): (subroot, root, proof hash)}: the rows of each source in order."""
    sources = sorted({r[0] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    each = {s: sorted((r[1:] for r in rows if r[0] == s), key=lambda x: (x[0] is not None, x)) for s in sources}
    trees = {s: tree([x[1] for x in v]) for s, v in each.items()}
    root, upper = tree([trees[s][0] for s in sources])
    return root, sorted((s or "", i or 0, leaf, trees[s][0], h(*trees[s][1][k], *upper[n])) for n, s in enumerate(sources) for k, (i, leaf) in enumerate(each[s]))


@pytest.mark.parametrize("top", [10_000, 4])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 1}, {"b": 28, "a": 1, "": 9, "č": 2, "=": 4}, {"x": 800, None: 10, "y": 81}])
def test_equals_plain_trees(spark, monkeypatch, sizes, top):
    monkeypatch.setattr(manifest, "TOP_NODES", top)
    rng = random.Random(5)
    rows = [(s, i, h(f"{s}{i}")) for s, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, id long, leaf string").withColumn("leaf", F.unhex("leaf"))
    m = manifest.manifest(df, "source", ["id"])
    got = manifest.prove(m).withColumn("leaf", F.lower(F.hex("leaf"))).select("tree", "id", "leaf", "subroot", manifest.proof_digest(F.col("steps")).alias("p"), "root", manifest.folded(F.col("leaf"), F.col("steps")).alias("f")).collect()
    root, want = by_hand(rows)
    assert sorted((r["tree"].removeprefix("=") if r["tree"] else "", r["id"], r["leaf"], r["subroot"], r["p"]) for r in got) == want
    assert {(r["root"], r["f"]) for r in got} == {(root, root)}


def test_repeated_ids_nulls_and_empty(spark):
    rows = [("a", 1, h("x")), ("a", 1, h("x")), ("a", None, h("y")), ("a", 1, h("w")), (None, None, h("z"))]
    df = spark.createDataFrame(rows, "source string, id long, leaf string").withColumn("leaf", F.unhex("leaf"))
    got = manifest.prove(manifest.manifest(df, "source", ["id"])).withColumn("leaf", F.lower(F.hex("leaf"))).select("tree", "id", "leaf", "root", "subroot", manifest.proof_digest(F.col("steps")).alias("p")).collect()
    root, want = by_hand(rows)
    assert {r["root"] for r in got} == {root}
    assert sorted((r["tree"].removeprefix("="), r["id"] or 0, r["leaf"], r["subroot"], r["p"]) for r in got) == want
    none = manifest.manifest(df.limit(0), "source", ["id"])
    assert manifest.prove(none).count() == 0 and manifest.root(none).count() == 0


def test_leaf_marks_nulls_and_counts_bytes(spark):
    r = spark.range(1).select(manifest.leaf(F.lit(7), F.lit(None).cast("string"), F.lit("čž"), F.lit("")).alias("x")).first()
    assert r["x"] == h("1:7-4:čž0:")


def test_query_on_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = [(d["source"], d["doc_id"], h(*[field(d[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])) for d in docs]
    root, want = by_hand(rows)
    got = queries.op13_merkle_manifest(spark, sf_dir).collect()
    source = {d["doc_id"]: d["source"] for d in docs}
    assert sorted((source[r["doc_id"]] or "", r["doc_id"], r["leaf"], r["subroot"], r["proof_sha256"]) for r in got) == want
    import zlib

    for r in got:
        d = next(x for x in docs if x["doc_id"] == r["doc_id"])
        damaged = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (d["text"] or "")
        assert r["root"] == root and r["verified"] == (not damaged) == (r["folded_root"] == root)
