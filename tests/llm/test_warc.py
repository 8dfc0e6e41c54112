import hashlib

from stopwise.llm import queries, warc


def stored(spark, pages, tmp_path, name, file_records=3):
    path = f"file://{tmp_path}/{name}"
    warc.write_warc(pages, path, file_records=file_records)
    return warc.read_files(spark, path)


def pages_of(spark):
    rows = [(i, f"http://h/{i}", f"<p>é {i}</p>" * (i * 40), "x") for i in range(20)]
    rows += [(None, None, None, "x"), (3, "http://a\r\nb", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n", "x"), (4, "u", "", "x"), (4, "u", "", "x"), (99, "big", "z" * 300_000, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, status string").coalesce(2)


def test_round_trip(spark, tmp_path):
    files = stored(spark, pages_of(spark), tmp_path, "a").collect()
    blocks = []
    for f in files:
        at = 0
        for begin, end, block, row in warc.records(bytes(f["content"])):
            assert begin == at and block > 0
            blocks.append((row, bytes(f["content"])[block : end - 4].decode()))
            at = end
        assert at == len(f["content"])
    want = [(r["page_id"], r["html"] or "") for r in pages_of(spark).collect()]
    assert sorted(blocks, key=str) == sorted(want, key=str)


def test_audit_finds_damage_only(spark, tmp_path):
    files = stored(spark, pages_of(spark), tmp_path, "b")
    left = warc.tree(files)
    assert warc.audit(left, warc.tree(files)).count() == 0

    def change(row, content, begin, block, end):
        if row == 7:
            content[block + 5] ^= 4
        if row == 11:
            content[begin] = 0  # header gone
        if row == 99:
            content[end - 10] ^= 1

    rows = {r["row_id"]: r["status"] for r in warc.audit(left, warc.tree(warc.damaged(files, change))).collect()}
    assert rows == {7: "corrupt", 11: "corrupt", 99: "corrupt"}


def test_missing_file_cut_file_and_empty(spark, tmp_path):
    files = stored(spark, pages_of(spark), tmp_path, "c")
    names = sorted(r["file"] for r in files.select("file").collect())
    left = warc.tree(files)
    in_first = left.where(f"level = 0 and file = '{names[0]}'").count()
    found = warc.audit(left, warc.tree(files.where(f"file <> '{names[0]}'"))).collect()
    assert len(found) == in_first and {r["status"] for r in found} == {"missing"}
    assert {r["status"] for r in warc.audit(warc.tree(files.where(f"file <> '{names[0]}'")), left).collect()} == {"extra"}
    empty = warc.tree(files.where("false"))
    assert warc.audit(empty, empty).count() == 0 and warc.fixity(empty, left).count() == 0


def test_query_on_corpus(spark, sf_dir):
    rows = queries.op6_warc_fixity(spark, sf_dir).collect()
    pages = {r["page_id"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r["page_id"] for r in rows} == pages and len(rows) == len(pages)
    assert all((r["status"] == "corrupt") == (r["page_id"] % 101 == 7) for r in rows)
    assert all(len(r["record_sha256"]) == len(hashlib.sha256().hexdigest()) for r in rows)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    from pyspark.sql import functions as F

    # 30 pages of 200,000 bytes and five longer ones, one of them 100 MB
    pages = spark.range(35).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("repeat('x', CASE WHEN id = 34 THEN 100000000 WHEN id >= 30 THEN 400000 + id ELSE 200000 END)").alias("html")).coalesce(1)
    path = f"file://{tmp_path}/bytes"
    warc.write_warc(pages, path, file_records=10)
    files = warc.read_files(spark, path)
    sizes = sorted(r[0] for r in files.select(F.length("content")).collect())
    assert len([n for n in sizes if n > 10 * 200_500]) == 1 and 100_000_000 < sizes[-1] < 100_001_000
    nodes = warc.tree(files)
    rows = nodes.where("level = 0").groupBy("file").agg(F.count("*").alias("n"), F.sum("row_id").alias("s")).collect()
    assert sorted(r["n"] for r in rows) == [1] * 5 + [10] * 3 and sum(r["s"] for r in rows) == sum(range(35))

    def flip(row, content, begin, block, end):
        if row in (3, 34):
            content[end - 9] ^= 1

    found = warc.audit(nodes, warc.tree(warc.damaged(files, flip)))
    assert {(r["row_id"], r["status"]) for r in found.collect()} == {(3, "corrupt"), (34, "corrupt")}
