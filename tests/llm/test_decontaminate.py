import random
import re

import pytest

from stopwise.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[p : p + size]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def corpus():
    rng = random.Random(2)
    word = lambda: f"t{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 40])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "..."), (103, "same same same same same same same same same same same"), (104, items[4][1])]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            own = words(items[rng.randrange(25)][1])
            lo = rng.randrange(len(own))
            w[5:5] = own[lo:]
        docs.append((d, " ".join(w)))
    docs += [(60, None), (61, ""), (62, "same " * 30), (63, items[0][1].upper().replace(" ", "--")), (64, "é " * 20), (65, docs[3][1] * 200), (66, docs[0][1]), (66, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("most", [10**6, 0])
def test_equals_brute_force(spark, most):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, items string, n_hit int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, size int")
    rows = decontaminate.hits(d, b, broadcast_windows=most).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows) == sorted(brute(docs, items))
    assert decontaminate.hits(d.limit(0), b, broadcast_windows=most).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.hits(d, b.limit(0), broadcast_windows=most).collect())


def test_keeps_columns(spark):
    d = spark.createDataFrame([(1, "a b", "s"), (None, None, None)], "doc_id long, text string, source string")
    b = spark.createDataFrame([("i", "b")], "item_id string, text string")
    rows = decontaminate.hits(d, b, keep=("text", "source")).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"], str(r["text"]), str(r["source"])) for r in rows) == [("1", 1, "a b", "s"), ("None", 0, "None", "None")]
