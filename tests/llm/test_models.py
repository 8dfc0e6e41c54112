import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stopwise.llm import language, language_model, quality, queries

fold = lambda d, n: zlib.crc32(str(d).encode()) % n


def lm_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_language_model_base_and_gain(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts, total = Counter(), 0
    for d, t in texts.items():
        if fold(d, 5) != 1:
            w = [*lm_words(t), None]
            counts.update(w)
            total += len(w)
    rows = queries.op3_lm_scoring(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = [*lm_words(texts[r["doc_id"]]), None]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (len(counts) + 1))) for x in w)
        assert r["held_out"] == (fold(r["doc_id"], 5) == 1) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(counts[x] > 0 for x in w))
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0
        size = len((texts[r["doc_id"]] or "").encode())
        assert r["bits_per_byte"] is None if not size else abs(r["bits_per_byte"] + r["score"] / math.log10(2) / size) < 1e-9
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_far_tokens_and_cases(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BROADCAST_TOKENS", 5)
    monkeypatch.setattr(language_model, "SYMBOLS", 3)
    texts = [(1, "a b c d e f g a b c"), (2, "a b q q z"), (3, None), (4, ""), (5, "a b c " * 4000), (6, "a b q q z")]
    docs = spark.createDataFrame([(*x, 0) for x in texts], "doc_id long, text string, score int")
    null_id = language_model.score(docs.selectExpr("cast(null as long) doc_id", "text"), F.lit(True)).collect()
    assert len(null_id) == len(texts) and all(r["doc_id"] is None and math.isfinite(r["score"]) for r in null_id)
    rows = {r["doc_id"]: r for r in language_model.score(docs, F.col("doc_id") % 2 == 1).collect()}
    counts = Counter(x for d, t in texts if d % 2 for x in [*lm_words(t), None])
    for d, t in texts:
        w = [*lm_words(t), None]
        assert rows[d]["n_known"] == sum(counts[x] > 0 for x in w)
        assert abs(rows[d]["base_score"] - sum(math.log10((counts[x] + 0.5) / (sum(counts.values()) + 0.5 * (len(counts) + 1))) for x in w)) < 1e-6
        assert math.isfinite(rows[d]["score"])
    assert rows[2]["score"] == rows[6]["score"]
    assert language_model.score(docs.limit(0), F.col("doc_id") > 0).count() == 0
    assert all(r["n_known"] == 0 for r in language_model.score(docs, F.lit(False)).collect())


def test_model_is_a_distribution(spark):
    """Probabilities of all one-word texts over the vocabulary and the unknown word add up to the probability of a word."""
    docs = spark.createDataFrame([(1, "a b c a b a"), (3, "a c"), (2, "a"), (4, "b"), (6, "c"), (8, "never"), (10, "")], "doc_id long, text string")
    rows = {r["doc_id"]: 10 ** r["score"] for r in language_model.score(docs, F.col("doc_id") % 2 == 1).collect()}
    # "never" stands for all unknown words, each at the share of one with no count; the empty text is the end alone
    assert 0 < sum(rows[i] for i in (2, 4, 6, 8)) < 1 and all(0 < p < 1 for p in rows.values())
    assert rows[2] > rows[8] and rows[4] > rows[8]


def test_quality_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_quality_classifier(spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in rows)
    held = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(held) / len(held) > 0.95


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "good words here", 1), (4, "x " * 20000, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (2, None), (1, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert rows[3] > rows[4] and len(rows) == 4
    assert quality.fit(docs, labels.limit(0)) is None and quality.fit(docs.limit(0), labels) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


def test_hinge_loss_separates():
    import numpy as np

    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3]), np.array([3, 2])]
    w, b = quality.dual_coordinate_descent(rows, [np.ones(len(r)) for r in rows], np.array([1.0, 1, -1, -1]), 4, 1.0, 50)
    assert [float(np.sign(w[r].sum() + b)) for r in rows] == [1, 1, -1, -1]


def test_language_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_language_id(spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(held) / len(held) > 0.98


def test_language_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "de"), (4, "12 - 3", None), (5, "", "en"), (6, "und der Hund", None)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs, F.lit(True))).collect()}
    assert [rows[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "de"]
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(docs, F.lit(False))).collect()} == {"und"}
    assert language.predict(docs.limit(0), None).count() == 0


def test_codewords_differ():
    for n in (1, 2, 4, 9, 30):
        c = language.codewords(n)
        assert len({tuple(r) for r in c}) == n


def test_mixing_learns_from_every_training_row(spark, monkeypatch):
    """The refining map's counts hold each bit of each training row, also above any number of rows."""
    import numpy as np

    seen, learn = [], language_model._mixing
    monkeypatch.setattr(language_model, "_mixing", lambda rows, *rest: (seen.append(rows.count()), learn(rows, *rest))[1])
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d"), (F.col("id") % 7).cast("string")).alias("text"))
    scored = language_model.score(docs, F.col("doc_id") % 9 != 0)
    assert scored.count() == 9_000 and seen == [8_000]
    assert np.isfinite([r["score"] for r in scored.limit(50).collect()]).all()


def plain_model(refine, code=None, bits=16):
    import numpy as np

    code = code or language_model.huffman(np.array([5, 4, 3, 1]))
    gates = language_model.DEPTHS * language_model.SEEN
    seen = [np.full(code.nodes, 1 << 16 | 1, np.uint32), *[np.zeros(1 << bits, np.uint32)] * language_model.ORDERS]
    return language_model.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), code, bits, seen, np.zeros((gates, language_model.INPUTS), np.float32), refine)


def test_refining_map_is_updated_online():
    """From a map that is wrong everywhere, the last part of a regular text costs less than with a map held fixed."""
    import numpy as np

    wrong = np.full(language_model.DEPTHS * language_model.SEEN * language_model.STEPS, 6.0, np.float32)
    m = plain_model(wrong)

    def cost(n):
        row, symbol = np.zeros(n, np.int64), np.arange(n) % 3
        return -language_model.run(language_model.events(row, symbol.astype(np.uint64), symbol, m.code, m.bits), 1, m, m.weights, False)[0][0]

    early, late = cost(640), cost(6400) - cost(5760)
    assert late < 0.7 * early
    assert (wrong == 6.0).all()


def test_scores_equal_bit_by_bit_mixing():
    """The log probabilities of run() against a loop over blocks and bits of one row, from random counts and weights."""
    import numpy as np

    rng = np.random.default_rng(3)
    L = language_model
    gates = L.DEPTHS * L.SEEN
    m = plain_model(np.tile(np.linspace(-14, 14, L.STEPS), gates).astype(np.float32) + rng.normal(0, 0.1, gates * L.STEPS).astype(np.float32))
    pairs = lambda n: (rng.integers(0, 60, n) << 16 | rng.integers(0, 60, n)).astype(np.uint32)
    counts = lambda x: (int(x) >> 16, int(x) & 0xFFFF)
    m = m._replace(seen=[pairs(m.code.nodes), pairs(1 << 16), pairs(1 << 16)], weights=rng.normal(0.2, 0.2, (gates, L.INPUTS)).astype(np.float32))
    symbol = rng.integers(0, 4, 300)
    ev = L.events(np.zeros(300, np.int64), symbol.astype(np.uint64) + np.uint64(9), symbol, m.code, m.bits)
    got = L.run(ev, 1, m, m.weights, False)[0][0]

    w, refine, own, want = m.weights.astype(float), m.refine.astype(float).copy(), {}, 0.0
    for turn, (a, b) in enumerate(zip(ev.bounds[:-1], ev.bounds[1:])):
        steps, rate = [], L.RATE / math.sqrt(2 ** max(0, turn - 1))
        for k in range(a, b):
            z, o = counts(m.seen[0][ev.node[k]])
            p0 = min(max((o + 0.4) / (o + z + 0.8), 1e-6), 1 - 1e-6)
            x = [math.log((o + 0.4) / (z + 0.4))]
            for i in (1, 2):
                zeros, ones = counts(m.seen[i][ev.slots[i - 1][k]])
                x.append(math.log((ones + 2 * p0) / (zeros + 2 - 2 * p0)))
            n = zeros + ones
            mine = own.get(int(ev.node[k]), [0, 0])
            x += [math.log((mine[1] + 3 * p0) / (mine[0] + 3 - 3 * p0)), 0.3]
            gate = int(ev.depth[k]) * L.SEEN + (n >= 3) + (n >= 30) + (n >= 300)
            dot = min(max(sum(w[gate][i] * x[i] for i in range(5)), -14), 14)
            step = (dot + 14) * (L.STEPS - 1) / 28
            left = min(int(step), L.STEPS - 2)
            cell, part = gate * L.STEPS + left, step - left
            refined = refine[cell] + (refine[cell + 1] - refine[cell]) * part
            y = int(ev.bit[k])
            mixed = 1 / (1 + math.exp(-(dot + refined) / 2))
            want += math.log2(mixed if y else 1 - mixed)
            steps.append((k, gate, x, rate * (y - 1 / (1 + math.exp(-dot))), cell, part, rate * (y - 1 / (1 + math.exp(-refined)))))
        for k, gate, x, error, cell, part, missed in steps:
            w[gate] = w[gate] + error * np.array(x)
            refine[cell + (part > 0.5)] += missed
            own.setdefault(int(ev.node[k]), [0, 0])[int(ev.bit[k])] += 1
    assert abs(got - want) < 1e-3 * abs(want)


def mixed(h):
    """The finishing step of the hashes, on plain integers."""
    m = 2**64 - 1
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
    return h ^ h >> 31


def byte_grams(text):
    """Hashed 1- to 3-grams of the folded bytes, by plain loops."""
    folded = bytes(48 if 48 <= b < 58 else 32 if b < 33 else b + 32 if 65 <= b < 91 else b for b in (text or "").encode())
    out = []
    for order in (1, 2, 3):
        salt = int(language._ORDER_SALT[order]) << 32
        out += [mixed((int.from_bytes(folded[i : i + order], "big") + salt) & (2**64 - 1)) % (1 << language.BITS) for i in range(len(folded) - order + 1)]
    return out


def test_language_equals_plain_decoding(spark):
    """Codeword bits, their weights and the decoding recomputed with dictionaries."""
    texts = [("en", "the cat and the dog were in the house"), ("de", "der Hund und die Katze sind im Haus"), ("fr", "le chat et le chien sont dans la maison"), ("en", "another 12 words of the text"), ("de", "noch ein Satz mit Umlauten: äöü")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)] + [(9, "und der kleine Hund", None), (10, "the " * 3000, None), (11, "chat chien", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs, F.lit(True))).collect()}
    names = sorted({lang for lang, _ in texts})
    counts = {lang: Counter(g for x, t in texts if x == lang for g in byte_grams(t)) for lang in names}
    slots = 1 << language.BITS
    share = lambda lang, g: (counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * slots)
    codes = language.codewords(len(names))
    weights, lost = [], []
    for b in range(codes.shape[1]):
        side = {s: [lang for k, lang in enumerate(names) if codes[k][b] == s] for s in (1, -1)}
        weights.append([math.log(sum(share(x, g) for x in side[1]) / len(side[1])) - math.log(sum(share(x, g) for x in side[-1]) / len(side[-1])) for g in range(slots)])
        lost.append(max(1e-3, min(sum(share(lang, g) * weights[b][g] for g in range(slots)) * codes[k][b] for k, lang in enumerate(names))))
    for r in docs.collect():
        grams = byte_grams(r["text"])
        z = [sum(w[g] for g in grams) / math.sqrt(max(1, len(grams))) for w in weights]
        loss = [sum(v / sum(lost) * math.log1p(math.exp(-z[b] * codes[k][b])) if z[b] * codes[k][b] > -500 else -z[b] * codes[k][b] * v / sum(lost) for b, v in enumerate(lost)) for k in range(len(names))]
        e = [math.exp(-(x - min(loss)) * len(lost)) for x in loss]
        best = loss.index(min(loss))
        assert got[r["doc_id"]]["lang_pred"] == names[best], r["doc_id"]
        assert abs(got[r["doc_id"]]["score"] - e[best] / sum(e)) < 1e-3


def test_language_learns_rare_values_and_replaces_columns(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    docs = spark.createDataFrame([(k, f"{chr(97 + k) * 30} {chr(98 + k) * 30}", f"l{k}", 0.5, "x", True) for k in range(7)] * 2, "doc_id long, text string, lang string, score double, lang_pred string, ambiguous boolean")
    out = language.predict(docs, language.fit(docs, F.lit(True)))
    assert sorted(out.columns) == sorted(docs.columns)
    assert all(r["lang_pred"] == r["lang"] for r in out.collect()) and out.count() == 14


def test_quality_equals_plain_margins(spark):
    """Log-count ratios from dictionaries, the hinge-loss optimum by its conditions, and each score from the fitted weights."""
    import numpy as np

    from stopwise.llm.common import words
    import pyarrow as pa

    rng = __import__("random").Random(2)
    word = lambda k: f"{'good' if k else 'bad'}{rng.randrange(30)}"
    rows = [(i, " ".join([word(i % 2) for _ in range(rng.randrange(1, 40))] + ["same"]), i % 2) for i in range(60)]
    rows += [(60, rows[0][1], 0), (61, "", 1)]
    docs = spark.createDataFrame([(d, t, 7.0) for d, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    feature_sets = {}
    for d, t, _ in rows:
        (w,) = words(pa.array([t]))
        feature_sets[d] = set(quality.features(w)[1].tolist())
    n = {k: sum(y == k for _, _, y in rows) for k in (0, 1)}
    have = {k: Counter(f for d, _, y in rows if y == k for f in feature_sets[d]) for k in (0, 1)}
    ratio = {f: math.log((have[1][f] + 1) / (n[1] + 2)) - math.log((have[0][f] + 1) / (n[0] + 2)) for f in set(have[0]) | set(have[1])}
    for f, r in ratio.items():
        assert abs(model.squares[f] - r * r) < 1e-5
    weight = {f: model.weights[f] / r if abs(r) > 1e-9 else 0.0 for f, r in ratio.items()}
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for d, _, y in rows:
        size = math.sqrt(sum(ratio[f] ** 2 for f in feature_sets[d]))
        margin = sum(weight[f] * ratio[f] for f in feature_sets[d]) / max(size, 1e-9) + model.bias
        assert abs(scores[d] - 1 / (1 + math.exp(-min(30, max(-30, model.slope * margin))))) < 1e-3
        assert d == 61 or (scores[d] > 0.5) == (y == 1)
    assert scores[0] == scores[60]
    assert np.array_equal(model.weights, quality.fit(docs.repartition(7), labels).weights)


def test_lm_scores_do_not_depend_on_partitions(spark, sf_dir, monkeypatch):
    """1, 4 and 16 partitions and shuffled rows, with one group of texts and with many."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    training = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    for size in (10**9, 2_000):
        monkeypatch.setattr(language_model, "GROUP_TOKENS", size)
        results = []
        for parts in (docs.coalesce(1), docs.repartition(4), docs.orderBy(F.hash("text")).repartition(16, F.hash("doc_id"))):
            results.append({r["doc_id"]: r["score"] for r in language_model.score(parts, training).collect()})
        assert len(results[0]) == docs.count()
        for other in results[1:]:
            assert other == pytest.approx(results[0], rel=1e-12)


def test_indexed_additions_of_an_unpickled_model_are_fast(monkeypatch):
    """NumPy adds at indexes 30 times as slowly to an array whose type object is not its own, such as an unpickled one's."""
    import pickle

    import numpy as np

    L = language_model
    m = pickle.loads(pickle.dumps(plain_model(np.tile(np.linspace(-14, 14, L.STEPS).astype(np.float32), L.DEPTHS * L.SEEN))))
    types = []

    class Add:
        __call__ = staticmethod(np.add)
        at = staticmethod(lambda a, i, v: (types.append(a.dtype), np.add.at(a, i, v)))

    class Spy:
        add = Add()
        __getattr__ = staticmethod(lambda name: getattr(np, name))

    monkeypatch.setattr(L, "np", Spy())
    symbol = np.arange(300) % 4
    L.run(L.events(np.zeros(300, np.int64), symbol.astype(np.uint64), symbol, m.code, m.bits), 1, m, m.weights, False)
    assert types and all(t is np.dtype(np.float32) for t in types)


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_tokens_are_found_by_their_first_bits(size):
    import numpy as np

    L, rng = language_model, np.random.default_rng(size)
    known = np.unique(rng.integers(0, 2**64, size, np.uint64))
    symbol = np.minimum(rng.permutation(len(known)), 2)
    m = plain_model(None)._replace(tokens=known, symbol=symbol, first=L.first_places(known))
    asked = np.concatenate([known, known + np.uint64(1), np.array([0, 2**64 - 1], np.uint64), rng.integers(0, 2**64, 1000, np.uint64)])
    place = {int(t): i for i, t in enumerate(known)}
    want = [place.get(int(t), -1) for t in asked]
    got_symbol, got = L._symbols(asked, m)
    assert got.tolist() == want
    rare = len(m.code.begin) - 2
    assert got_symbol.tolist() == [symbol[i] if i >= 0 else rare for i in want]


def test_places_of_bits_are_indexes_and_rows_are_scored_alone():
    """Places of another type are cast at each look; sums of rows do not depend on the rows beside them."""
    import numpy as np

    L = language_model
    m = plain_model(np.tile(np.linspace(-14, 14, L.STEPS).astype(np.float32), L.DEPTHS * L.SEEN))
    row = np.repeat(np.arange(3), [300, 1, 90])
    symbol = np.arange(len(row)) * 7 % 4
    score = lambda row, symbol, rows: L.run(L.events(row, symbol.astype(np.uint64), symbol, m.code, m.bits), rows, m, m.weights, False)[0]
    together = score(row, symbol, 3)
    assert together.tolist() == [score(row[row == r] * 0, symbol[row == r], 1)[0] for r in range(3)]
    ev = L.events(row, symbol.astype(np.uint64), symbol, m.code, m.bits)
    assert all(x.dtype == np.intp for x in (ev.row, ev.node, ev.depth, *ev.slots, L.huffman(np.arange(1, 9)).node))
    empty = np.zeros(0, np.int64)
    assert score(empty, empty, 2).tolist() == [0, 0]


def test_nodes_are_counted_by_the_counts_of_symbols():
    """Zeros and ones of each node against the bits of all tokens, also of counts beyond 16 bits."""
    import numpy as np

    L, rng = language_model, np.random.default_rng(4)
    symbol = np.minimum(rng.geometric(0.3, 3_000) - 1, 8)
    code = L.huffman(np.bincount(symbol, minlength=9))
    ev = L.events(np.zeros(len(symbol), np.int64), symbol.astype(np.uint64), symbol, code, 16)
    want = np.zeros((code.nodes, 2), np.int64)
    np.add.at(want, (ev.node, ev.bit), 1)
    got = L._node_counts(code, np.bincount(symbol, minlength=9))
    assert np.stack([got >> 16, got & 0xFFFF], axis=1).tolist() == want.tolist()
    large = L._node_counts(code, 1_000 * np.bincount(symbol, minlength=9))
    for zeros_ones, n in zip(want, large.tolist()):
        assert (n >> 16, n & 0xFFFF) == tuple(int(1_000 * x if 1_000 * max(zeros_ones) <= 65_535 else max(x * 65_535 // max(zeros_ones), x > 0)) for x in zeros_ones)


@pytest.mark.parametrize("learn", [False, True])
def test_slices_of_bits_do_not_change_results(monkeypatch, learn):
    import numpy as np

    L, rng = language_model, np.random.default_rng(5)
    m = plain_model(np.tile(np.linspace(-14, 14, L.STEPS).astype(np.float32), L.DEPTHS * L.SEEN))
    row = np.repeat(np.arange(4), [2_500, 1, 64, 300])
    symbol = rng.integers(0, 4, len(row))

    def results(size):
        monkeypatch.setattr(L, "SLICE", size)
        ev = L.events(row, symbol.astype(np.uint64), symbol, m.code, m.bits)
        return ev, L.run(ev, 4, m, m.weights, learn)

    whole, want = results(1 << 30)
    assert [int(x) for x in whole.bounds] == sorted(whole.bounds) and (whole.bounds[:-1] <= whole.ending).all() and (whole.ending <= whole.bounds[1:]).all()
    for size in (7, 100, 4_096):
        ev, got = results(size)
        for a, b in zip((whole.row, whole.node, whole.bit, whole.depth, *whole.slots, whole.bounds, whole.ending), (ev.row, ev.node, ev.bit, ev.depth, *ev.slots, ev.bounds, ev.ending)):
            assert np.array_equal(a, b)
        for a, b in zip(want, got):
            np.testing.assert_allclose(b, a, rtol=1e-4, atol=1e-5)


def test_rows_learn_nothing_from_their_last_block(monkeypatch):
    """What a row's last block would teach is never asked for, so no additions are made for it."""
    import numpy as np

    L = language_model
    m = plain_model(np.tile(np.linspace(-14, 14, L.STEPS).astype(np.float32), L.DEPTHS * L.SEEN))
    added = []

    class Add:
        __call__ = staticmethod(np.add)
        at = staticmethod(lambda a, i, v: (added.append(len(i)), np.add.at(a, i, v)))

    class Spy:
        add = Add()
        __getattr__ = staticmethod(lambda name: getattr(np, name))

    monkeypatch.setattr(L, "np", Spy())
    # the first row has two blocks, the others have one
    row = np.repeat(np.arange(3), [L.BLOCK + 9, 20, L.BLOCK])
    symbol = np.arange(len(row)) % 4
    ev = L.events(row, symbol.astype(np.uint64), symbol, m.code, m.bits)
    assert (L.run(ev, 3, m, m.weights, False)[0] < 0).all()
    early = int((m.code.begin[symbol[: L.BLOCK] + 1] - m.code.begin[symbol[: L.BLOCK]]).sum())
    assert sum(added) == (L.INPUTS + 2) * early
