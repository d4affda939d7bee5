"""Each operator against brute force, on small data with odd cases."""

import hashlib
import math
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from formloom.llm import components, exact, labelled, lengths, lm, minhash, mixing, neighbours, pieces, quality, quotes, toxicity, trees, words

SF = "/root/testdata/sf0.001"


def word_list(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = word_list(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_words_are_split_at_ascii_white_space():
    texts = [None, "", "  A b\tC\n", "x\x0by\x0cz\r", "é\xa0É Ü", "a"]
    got = words.split_words(pa.array(texts))
    names = got.vocab.to_pylist()
    assert [[names[i].encode() for i in got.ids[a:b]] for a, b in zip(got.offsets[:-1], got.offsets[1:])] == [word_list(t) for t in texts]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (5, 40, 700):
        for _ in range(30):
            both, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (n, n // 4, n // 4))
            x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
            sig = minhash.superminhash(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            errors.append((sig[0] == sig[1]).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_superminhash_permutes_lanes():
    sig = minhash.superminhash(np.array([12345], np.uint64), np.array([0, 1]))
    assert sorted((sig[0] >> np.uint64(56)).tolist()) == list(range(minhash.LANES))


def groups(docs):
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs if r["doc_id"] is not None]
    sets = components.UnionFind()
    seen = defaultdict(list)
    for n, (i, s) in enumerate(rows):
        for j, t in rows[:n]:
            if s and t and s & t and 100 * len(s & t) >= 75 * len(s | t):
                sets.union(i, j)
    del seen
    return {i: (len(s), sets.find(i)) for i, s in rows}


def test_near_duplicates_match_brute_force(docs):
    want = groups(rows_of(docs))
    got = rows_of(minhash.near_duplicates(docs))
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_across_a_crowded_bucket(spark):
    """A chain whose ends are not similar, and a crowd with a common passage that is not linked."""
    rng = np.random.default_rng(3)
    body = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    chain = [" ".join([*(f"c{k}x{j}" for j in range(12 * k)), *body[12 * k :]]) for k in range(12)]
    shared = [f"p{x}" for x in range(150)]
    crowd = [" ".join([*shared, *(f"q{k}y{j}" for j in range(100))]) for k in range(60)]
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(chain + crowd + crowd[:3])]
    want = groups(rows)
    assert len({c for _, c in want.values()}) > 50
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == want


def test_rows_that_repeat_a_doc_id_are_documents_of_their_own(spark, monkeypatch):
    """Two texts under one id are compared each by itself; a hot class and a hot head are joined in parts."""
    from formloom.llm import session

    monkeypatch.setattr(session, "HOT_ROWS", 4)
    text = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " tail"), (3, text("b") + " tail"), (4, text("c")), (None, text("a"))]
    rows += [(100 + i, text("hot")) for i in range(30)] + [(200 + i, text("hot") + f" end{i}") for i in range(30)]
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    want = Counter([(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (4, 36, 4), (None, 36, None)] + [(100 + i, 36, 100) for i in range(30)] + [(200 + i, 37, 100) for i in range(30)])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    left = rows_of(minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "1", "100", "4", "None"]


@pytest.mark.parametrize("one_task", [20_000, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    sets = components.UnionFind()
    for a, b in links:
        if a is not None:
            sets.union(a, b)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(6))
    found = {r["node"]: r["component"] for r in rows_of(got)}
    assert got.count() == len(found) and found == {i: sets.find(i) for i in found} and len(found) == 301 + 400 + 2


def test_rice_code_round_trip():
    rng = np.random.default_rng(2)
    for n, universe in ((0, 100), (1, 1), (1, 2**40), (50, 60), (5000, 2**30)):
        values = np.sort(rng.choice(universe, n, replace=False)) if universe < 10**6 else np.unique(rng.integers(0, universe, n))
        k = exact.rice_parameter(len(values), universe)
        code = exact.rice_encode(values.astype(np.int64), k)
        assert (exact.rice_decode(code, len(values), k) == values).all()
        assert n < 5000 or len(code) * 8 < 1.1 * n * (math.log2(universe / n) + 1.6)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_matches_brute_force(docs):
    want = defaultdict(list)
    for r in rows_of(docs):
        want[lower(r["text"])].append(r["doc_id"])
    got = rows_of(exact.exact_dedup(docs))
    assert len(got) == docs.count()
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        assert r["doc_id"] in ids and r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(by_hash.keys())
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    left = rows_of(exact.drop_exact_duplicates(docs))
    assert sorted(lower(r["text"]) for r in left) == sorted(want)


def test_small_owners_and_chunks(docs, monkeypatch):
    monkeypatch.setattr(exact, "OWNER_ROWS", 20)
    monkeypatch.setattr(exact, "SPARE_BITS", 1)
    got = rows_of(exact.exact_dedup(docs))
    assert sum(r["kept"] for r in got) == len({lower(r["text"]) for r in rows_of(docs)})


def test_rows_alike_but_for_a_column_are_kept_the_same_way(spark):
    rows = [(1, "Same", s) for s in "fedcba"] + [(2, None, "x"), (None, "", "y"), (3, "other", "z")]
    runs = [sorted(map(str, exact.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 3


def test_mix_targets():
    sizes = {"b": 100, "a": 10, None: 50, "é": 1000}
    got = mixing.mix_targets(sizes)
    assert got["a"] == 20 and math.isclose(sum(got.values()), 1.5 * 1160)
    assert all(got[s] <= 2 * sizes[s] for s in sizes)
    assert mixing.mix_targets({}) == {} and mixing.mix_targets({"a": 0}) == {"a": 0}


def test_mix_takes_near_its_targets(docs):
    got = rows_of(mixing.mixed(docs).select("doc_id", "source", "text", "size", "source_size", "target", "taken"))
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(word_list(r["text"])) and r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by[r["source"]].append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, rows_of(mixing.mixed(docs.repartition(3)).select("doc_id", "text", "taken"))))
    assert mixing.mix(docs).count() == sum(r["taken"] // r["size"] for r in got if r["size"]) + mixing.mix(docs).where("trim(coalesce(text, '')) = '' or text rlike '^[ \\\\s]+$'").count()
    short = rows_of(mixing.mixed_ids(docs))
    assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in short) == Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got)


def test_mix_of_one_hash_and_of_ties(spark):
    """Rows of one id can't be parted; sources without words, and null ones, are sources too."""
    rows = [(7, "a b c", "s")] * 40 + [(i, "x " * (i % 5), None) for i in range(50)] + [(1000 + i, None, "blank") for i in range(3)]
    got = rows_of(mixing.mixed_ids(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert len(got) == len(rows) and {r["taken"] for r in got if r["source"] == "s"} <= {0, 3, 6} and len({r["taken"] for r in got if r["source"] == "s"}) == 1
    own = [r for r in got if r["source"] is None]
    assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4 and all(r["taken"] == 0 for r in got if r["source"] == "blank")


@pytest.mark.parametrize("name", ["op4_mixing", "op10_exact_dedup"])
def test_sql_agrees(spark, name):
    from formloom.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    for a, b in zip(got.sort_values("doc_id")[columns].values.tolist(), want.sort_values("doc_id")[columns].values.tolist(), strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("order", [2, 3])
def test_lm_matches_brute_force(docs, order):
    """All texts, long ones too, over few and many blocks and shards."""
    rows = [(r["doc_id"], word_list(r["text"])) for r in rows_of(docs)]
    train = lambda i: i is None or crc32(str(i).encode()) % 5 != 1
    grams = lambda w, n: [tuple(x) for x in zip(*(["<s>", *w, None][k:] for k in range(n)))]
    uni, of = Counter(), {n: Counter() for n in (2, 3)}
    context = {n: Counter() for n in (2, 3)}
    for i, w in rows:
        if train(i):
            uni.update([*w, None])
            for n in of:
                of[n].update(grams(w, n))
                context[n].update(g[:-1] for g in grams(w, n))
    total, v = sum(uni.values()), len(uni)

    def p(g):
        if len(g) == 1:
            return (uni[g[0]] + 0.5) / (total + 0.5 * (v + 1))
        m = lm.PRIOR[len(g) - 1]
        return (of[len(g)][g] + m * p(g[1:])) / (context[len(g)][g[:-1]] + m)

    def score(w):
        seq = ["<s>", *w, None]
        return sum(math.log10(p(tuple(seq[max(0, k - order + 1) : k + 1]))) for k in range(1, len(seq)))

    want = sorted((str(i), len(w) + 1, sum(uni[t] > 0 for t in [*w, None]), round(sum(math.log10(p((t,))) for t in [*w, None]), 4), round(score(w), 4)) for i, w in rows)
    for sizes in ((4000, 500), (1 << 23, 1 << 24)):
        got = rows_of(lm.lm_scores(docs, *sizes, order))
        assert {r["train_tokens"] for r in got} == {total}
        assert all(r["held_out"] == (not train(r["doc_id"])) for r in got)
        mine = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4), round(r["score"], 4)) for r in got)
        assert len(mine) == len(want) and max(x[1] for x in want) > 40_000
        for a, b in zip(mine, want):
            assert a[:3] == b[:3] and math.isclose(a[3], b[3], abs_tol=1e-3) and math.isclose(a[4], b[4], abs_tol=1e-3)


def test_counts_beyond_a_byte_and_32_bits():
    counts = np.array([0, 1, 254, 255, 256, 2**33, 7], np.int64)
    assert (lm._long(*lm._short(counts)) == counts).all()


def test_automaton_probabilities_sum_to_one():
    """From any state, the arcs and what falls through the failure arcs make a distribution over words, the end and an unknown word."""
    text = "a b a b c a b b a".split()
    blocks = [lm.Block(pa.table({"text": [t], "held_out": [False]}), 3) for t in (" ".join(text),)]
    block, names = blocks[0], {w: i for i, w in enumerate(sorted(set(text), key=lambda w: words.hash_strings(pa.array([w]))[0]))}
    of = {n: block.counts[a:b] for n, (a, b) in enumerate(zip(block.bounds[:-1], block.bounds[1:]), 1)}
    uni = {**{w: int(of[1][i]) for w, i in names.items()}, None: 1, "unseen": 0}
    n, v = sum(uni.values()), 4
    seq = [*text, None]
    seen = lambda *g: sum(tuple(seq[i : i + len(g)]) == g for i in range(len(seq) - len(g) + 1))
    assert n == 10 and {w: uni[w] for w in names} == Counter(text) and int(of[2].sum()) == 10 and int(of[3].sum()) == 9
    p1 = {w: (c + 0.5) / (n + 0.5 * (v + 1)) for w, c in uni.items()}
    assert math.isclose(sum(p1.values()), 1)
    for x in names:
        p2 = {w: (seen(x, w) + lm.PRIOR[1] * p1[w]) / (uni[x] + lm.PRIOR[1]) for w in uni}
        assert math.isclose(sum(p2.values()), 1)
        for y in names:
            p3 = {w: (seen(y, x, w) + lm.PRIOR[2] * p2[w]) / (seen(y, x) + lm.PRIOR[2]) for w in uni}
            assert math.isclose(sum(p3.values()), 1)


def test_quality_learns(spark):
    d, y = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(d, y).join(y, "doc_id").where("held_out").select("quality", "predicted", "score").toPandas()
    assert len(got) > 50 and (got.quality == got.predicted).mean() > 0.93 and got.score.between(0, 1).all()


def test_quality_learns_nothing_from_held_out_labels(spark):
    """Flipping, dropping or repeating held-out labels changes no bit of any score; nor does the order of rows."""
    d, y = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    held = quality.held_out(y["doc_id"])
    scores = lambda labels, docs=d: {r["doc_id"]: r["score"] for r in rows_of(quality.quality_scores(docs, labels))}
    want = scores(y)
    assert len(set(want.values())) > 30
    for other in (y.withColumn("quality", (held.cast("int") + y["quality"]) % 2), y.where(~held), y.union(y.where(held)).union(y.where(~held))):
        assert scores(other.repartition(3), d.repartition(7)) == want


def test_quality_training_is_bounded(spark):
    d, y = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    chosen = rows_of(labelled.training_ids(y, "quality", 30, ~quality.held_out(y["doc_id"])))
    assert Counter(r["quality"] for r in chosen) == {0: 30, 1: 30} and not any(crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in chosen)
    got = quality.quality_scores(d, y, per_class=30).join(y, "doc_id").toPandas()
    assert got.score.nunique() > 10 and (got.quality == got.predicted).mean() > 0.8


def test_quality_of_odd_rows(docs, spark, empty):
    y = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 1)], "doc_id long, quality int")
    got = rows_of(quality.quality_scores(docs, y))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert quality.quality_scores(empty, y.limit(0)).count() == 0
    assert quality.quality_scores(docs, y.limit(0)).select("score").distinct().count() == 1


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < 0)).astype(float)
    model = trees.fit_trees(x, y, np.ones(len(y)), trees=20)
    assert ((model.predict(x) > 0.5) == y).mean() > 0.95
    for row in x[:50]:
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert math.isclose(total, model.margin(row[None])[0])


def test_statistics_match_a_plain_count():
    text = "The The cat.\nSAT on 12 mats!! | ok\nThe The cat."
    got = dict(zip(quality.FEATURES, quality.statistics(pa.array([text, None, "", "a"]))[0]))
    w = text.split()
    assert math.isclose(got["log_words"], math.log1p(len(w))) and math.isclose(got["word_mean"], np.mean([len(x) for x in w]))
    assert math.isclose(got["line_repeats"], 1 / 3) and math.isclose(got["pipes"], 1 / len(text)) and math.isclose(got["upper_words"], 1 / len(w))
    assert math.isclose(got["word_repeats"], sum(a == b for a, b in zip(w, w[1:])) / (len(w) - 1))
    assert (quality.statistics(pa.array([None, "", " \n"])) == 0).all()


def test_toxicity_chain(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        a = i % 3 == 0
        b = a and i % 2 == 0
        w = [f"w{x}" for x in rng.integers(0, 50, 30)] + ["Vile!!"] * a + ["Threat,"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a), int(b)))
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, rude int, threat int")
    got = {r["doc_id"]: r for r in rows_of(toxicity.toxicity(d, y, ("rude", "threat")))}
    assert len(got) == 602 and all((got[i]["p_rude"] > 0.5) == bool(a) and got[i]["predicted"] == b for i, a, b in labels)
    assert got[900]["score"] == got[901]["score"] < 0.5
    assert toxicity.toxicity(d.limit(0), y, ("rude", "threat")).count() == 0
    assert {r["score"] for r in rows_of(toxicity.toxicity(d, y.limit(0), ("rude", "threat")))} == {0.5}


def plain_chain(rows, labels, most, folds, fold_of):
    """The chain again, plainly: sets of words, terms by likelihood ratio, logistic regression by Newton steps."""
    ids = sorted(labels)
    words_of = {i: {w.strip("!#$%&'()*+,-./:;<=>?@[]^_`{|}~").lower() for w in rows[i].split()} for i in ids}

    def chosen(used):
        gains = {}
        for t in {t for i in used for t in words_of[i]}:
            have = [i for i in used if t in words_of[i]]
            for c in (0, 1):
                k, e = sum(labels[i][c] for i in have), len(have) * sum(labels[i][c] for i in used) / len(used)
                g = 2 * sum(a * math.log(a / b) for a, b in ((k, e), (len(have) - k, len(have) - e)) if a and b)
                gains[t] = max(gains.get(t, 0), g if len(have) >= 3 else 0)
        return sorted((t for t in gains if gains[t] > 10.83), key=lambda t: -gains[t])[:most]

    def fit(z, y):
        z = np.column_stack([z, np.ones(len(z))])
        b, ridge = np.zeros(z.shape[1]), np.append(np.full(z.shape[1] - 1, 0.1), 1e-3)
        for _ in range(12):
            p = 1 / (1 + np.exp(-z @ b))
            b = b + np.linalg.solve(z.T @ np.diag(np.maximum(p * (1 - p), 1e-6)) @ z + np.diag(ridge), z.T @ (y - p) - ridge * b)
        return lambda q: 1 / (1 + np.exp(-(np.column_stack([q, np.ones(len(q))]) @ b)))

    matrix = lambda terms: np.array([[t in words_of[i] for t in terms] for i in ids], float).reshape(len(ids), -1)
    y, fold, own = np.array([labels[i] for i in ids], float), np.array([fold_of[i] for i in ids]), chosen(ids)
    earlier, out = np.zeros((len(ids), 0)), []
    for c in (0, 1):
        x = np.hstack([matrix(own), earlier if c == 0 else np.array(out).T])
        out.append(fit(np.hstack([matrix(own), earlier]), y[:, c])(x))
        held = np.zeros(len(ids))
        for k in range(folds):
            z = np.hstack([matrix(chosen([i for i, f in zip(ids, fold) if f != k])), earlier])
            held[fold == k] = fit(z[fold != k], y[fold != k, c])(z[fold == k])
        earlier = np.hstack([earlier, held[:, None]])
    return {i: (a, b) for i, a, b in zip(ids, *out)}


def test_toxicity_chain_matches_a_plain_one(spark):
    """Also with a null doc_id, repeated rows, a very long text and clashing columns."""
    rng = np.random.default_rng(9)
    rows, labels = {}, {}
    for i in range(240):
        a = int(rng.random() < 0.4)
        b = int(a and rng.random() < 0.5)
        w = [f"w{x}" for x in rng.integers(0, 60, 12)] + ["Vile!!"] * (a and rng.random() < 0.8) + ["(threat,"] * (b and rng.random() < 0.7) + ["kind"] * (not a and rng.random() < 0.6)
        rows[i], labels[i] = " ".join(w), (a, b)
    rows[3] += " w1" * 50_000
    table = [(i, t, 1, 0.5) for i, t in rows.items()] + [(None, rows[5], 1, 0.5), (900, rows[7], 1, 0.5), (900, rows[7], 1, 0.5)]
    d = spark.createDataFrame(table, "doc_id long, text string, fold int, score double").repartition(4)
    y = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(None, 1, 1), (901, 1, 1), (5, None, None)], "doc_id long, rude int, threat int")
    fold_of = {r[0]: r[1] for r in spark.range(240).select("id", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int")).collect()}
    want = plain_chain(rows, labels, toxicity.TERMS, 3, fold_of)
    got = rows_of(toxicity.toxicity(d, y, ("rude", "threat")))
    assert len(got) == len(table)
    for r in got:
        p = want[{None: 5, 900: 7}.get(r["doc_id"], r["doc_id"])]
        assert math.isclose(r["p_rude"], p[0], abs_tol=1e-5) and math.isclose(r["p_threat"], p[1], abs_tol=1e-5)


def test_out_of_fold_probabilities_ignore_their_own_labels(spark):
    rng = np.random.default_rng(2)
    x, fold = (rng.random((90, 6)) < 0.4).astype(float), np.arange(90) % 3
    y = np.column_stack([x[:, 0], rng.integers(0, 2, 90)]).astype(float)
    flipped = y.copy()
    flipped[fold == 1] = 1 - flipped[fold == 1]
    own, without = np.arange(6), [np.array([0, 1, 2]), np.array([1, 3]), np.array([0, 4, 5])]
    a, b = (toxicity.fit_chain(x, v, fold, own, without)[1] for v in (y, flipped))
    assert (a[fold == 1, 0] == b[fold == 1, 0]).all() and not np.allclose(a[fold != 1, 0], b[fold != 1, 0])


def test_toxicity_on_labels(spark):
    d, y = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.op5_toxicity(spark, "/root/testdata/sf0.01").join(y, "doc_id").toPandas()
    assert d.count() >= len(got) and (got.toxic == got.predicted).mean() > 0.95


def test_pieces_match_the_reference_library(docs):
    import sentencepiece

    path = pieces.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    by = defaultdict(list)
    for r in rows_of(pieces.encoded(docs)):
        by[r["doc_id"]].append(r)
    for r in rows_of(docs):
        own = by[r["doc_id"]][0]
        text = r["text"] or ""
        assert own["ids"] == sp.encode(text) and own["exact"] and own["decoded"] == text


def test_pieces_of_odd_texts():
    path = pieces.default_model()
    built = pieces.PieceTokenizer.load(path)
    odd = [*pieces.PROBES, "▁", "▁▁a", " a ▁b  c ", "\x00\x01 �", "á é", "   ", "x" * 300, "  line", "<0xE2>"]
    assert pieces.parity_failures(built, path, odd) == []
    ids, offsets = built.encode(odd)
    assert [x.replace("▁", " ") for x in odd] == built.decode(ids, offsets)


def _field(number, value):
    """A protobuf field of a number, a float or bytes."""

    def varint(x):
        out = b""
        while x >= 0x80:
            out, x = out + bytes([x & 0x7F | 0x80]), x >> 7
        return out + bytes([x])

    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def hand_model(kind, fallback, charsmap, rng):
    """A model file written by hand: words and parts of words with drawn scores, control and unused pieces between them. Nothing is trained."""
    words = "the of and in words spark engine table data über straße été naïve here there quick brown fox a b c d e f g h i n o r s t ab th he in er an re on at nd".split()
    parts = {w[:k] for w in words for k in range(1, len(w) + 1)} | {w[k:] for w in words for k in range(len(w))} | set("abcdefghijklmnopqrstuvwxyz.,!0123456789<>/") | {c for w in words for c in w}
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * fallback
    pieces_ += [("▁", -6.0, 1), ("quicksand", -1.0, 5)] + [(p, float(-4 - 10 * rng.random()), 1) for p in sorted(parts | {"▁" + w for w in parts})] + [("<late>", 0.0, 3)]
    if kind == pieces.BPE:  # scores are ranks
        pieces_ = [(p, float(-i), t) for i, (p, s, t) in enumerate(pieces_)]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, t)) for p, s, t in pieces_)
    return data + _field(2, _field(3, kind) + _field(35, int(fallback))) + _field(3, _field(2, charsmap) + _field(3, 1) + _field(4, int(bool(charsmap))) + _field(5, 1))


def nmt_nfkc():
    """The character map that the library brings along under this name."""
    import sentencepiece

    spec = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    return dict(pieces._fields(spec))[2]


@pytest.mark.parametrize("mapped", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
def test_pieces_of_hand_written_models(kind, fallback, mapped, tmp_path, docs):
    """Ids and decoded texts are the library's for unigram and BPE models, with and without byte fallback and a character map."""
    import sentencepiece

    path = tmp_path / "own.model"
    path.write_bytes(hand_model(kind, fallback, nmt_nfkc() if mapped else b"", np.random.default_rng(8)))
    sp, built = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.PieceTokenizer.load(str(path))
    odd = ["<s> </s> <unk> <0x41> <late> quicksand", "the quick brown fox", "ﬁne Ｆｕｌｌ　ｗｉｄｔｈ ①½ e\u0301 가\u1100\u1161 \u200b x\xa0y", "xyzzy 中文 中文\U0001f600", "tab\there\r\nnew", "▁▁the", "  a  b  ", "é" * 30, "\ufeffstart \u00ad soft"]
    texts = [*pieces.PROBES, *odd, *(r["text"] or "" for r in docs.limit(120).collect())]
    assert pieces.parity_failures(built, str(path), texts) == []
    ids, offsets = built.encode(texts)
    assert built.decode(ids, offsets) == [sp.decode(sp.encode(t)) for t in texts]


def test_decoding_of_stray_bytes():
    import sentencepiece

    path = pieces.default_model()
    sp, built = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceTokenizer.load(path)
    rng = np.random.default_rng(1)
    rows = [rng.integers(3, 259, 6).tolist() for _ in range(200)]
    flat, offsets = np.concatenate([np.array(r, np.int32) for r in rows]), np.arange(0, 6 * 201, 6)
    assert built.decode(flat, offsets) == [sp.decode(r) for r in rows]


def test_encoded_ignores_clashing_columns(docs):
    clash = docs.withColumns({"ids": docs["doc_id"], "exact": docs["size"], "n_tokens": docs["size"]})
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, pieces.encoded_digests(clash).collect())) == sorted(map(key, pieces.encoded_digests(docs).collect()))


def test_length_histogram_answers_every_limit(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    n = sorted(len(sp.encode(r["text"] or "")) for r in rows_of(docs))
    table = lengths.limits(lengths.length_histogram(docs))
    got = {r["limit"]: r for r in rows_of(table)}
    assert sorted(got) == sorted(set(n))
    for limit, r in got.items():
        assert r["docs_over"] == sum(x > limit for x in n) and r["tokens_kept"] == sum(min(x, limit) for x in n) and r["tokens_total"] == sum(n)
        assert r["tokens_within"] == sum(x for x in n if x <= limit) and math.isclose(r["quantile"], sum(x <= limit for x in n) / len(n))
    for limit in (0, 1, 100, 777, 10**6):
        assert lengths.kept_at(table, limit).first()[0] == sum(min(x, limit) for x in n)
    assert lengths.quantile_length(table, 0.5).first()[0] == n[math.ceil(len(n) / 2) - 1]


def test_chi_square():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 0.01 and abs(float(neighbours.chi_square_cdf(7.344, 8)) - 0.5) < 1e-3


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            scores = {(-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), i) for i, w in good if i != q and len(w) == len(v)}
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(200, None), (201, [0.0] * 6), (202, [float("nan")] + [1.0] * 5), (203, [None] * 6), (None, [1.0] * 6), (10, rows[10][1]), (300, [1.0, 2.0]), (250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 10, 5)
    got = defaultdict(list)
    for r in sorted(rows_of(neighbours.nearest(df, 10, 5, confidence=1 - 1e-12)), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    assert all(math.isclose(a[1], b[1]) for q in got for a, b in zip(got[q], want[q]))
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 100)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, 5, 5)
    got = defaultdict(set)
    for r in rows_of(neighbours.nearest(df, 5, 5)):
        got[r["query_id"]].add(r["vec_id"])
    assert all(len(got[q]) == 5 for q in want)
    assert np.mean([len({i for i, _ in want[q]} & got[q]) / 5 for q in want]) >= 0.9


def test_quotes_link(spark):
    rows = [
        (1, 0, "user", "What is Spark?\n\nTell me more."), (1, 1, "assistant", "> What is\n> spark\n\nAn engine."), (1, 2, "user", ">> What is Spark?\n> An engine.\n\nAnd speed?"),
        (1, 3, "assistant", "> not said anywhere\nFast."), (2, 0, "user", "> Tell me more!\n\nMe too."), (2, 1, "assistant", None), (None, 5, "user", "> Fast."), (3, 0, None, ""), (1, 3, "assistant", "> not said anywhere\nFast."),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in rows_of(quotes.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))}
    assert quotes.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == len(rows)
    parent = lambda *k: (got[k]["parent_conv_id"], got[k]["parent_turn"], got[k]["linked"])
    assert parent(1, 0) == (None, None, False)
    assert parent(1, 1) == (1, 0, True) and got[1, 1]["clean_text"] == "An engine."
    assert parent(1, 2) == (1, 1, True) and got[1, 2]["n_linked"] == 2 and got[1, 2]["max_level"] == 2
    assert parent(1, 3) == (1, 2, False) and got[1, 3]["n_quotes"] == 1 and got[1, 3]["n_linked"] == 0
    assert parent(2, 0) == (1, 0, True) and parent(2, 1) == (2, 0, False) and got[2, 1]["clean_text"] == ""
    assert parent(None, 5) == (None, None, False) and parent(3, 0) == (None, None, False)


def test_empty_tables(empty, spark):
    for run in (minhash.near_duplicates, exact.exact_dedup, mixing.mixed, lm.lm_scores, pieces.encoded_digests, exact.drop_exact_duplicates, minhash.drop_near_duplicates, lambda d: lengths.limits(lengths.length_histogram(d))):
        assert run(empty).count() == 0
    assert quotes.linked_messages(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    at = rows
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, at, sf).cache()
        assert after.columns == rows.columns and after.count() > 0
        if name == "exact_dedup":
            assert after.count() == len({lower(r["text"]) for r in at.collect()})
        if name == "near_dedup":
            want = groups(rows_of(at))
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
        at = after
    assert p.STAGES[-1][1](spark, at, sf).count() == at.count()
