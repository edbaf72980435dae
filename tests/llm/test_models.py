import numpy as np
import pytest
from fixture import documents, empty, texts, words
from oracle import SF
from pyspark.sql import functions as F

from plume.llm import nearest, quality_classifier, queries, toxicity


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus():
    """400 documents: a fifth junk, a fifth with an insult."""
    rows, labels = [], []
    for i in range(400):
        junk, rude = i % 5 == 0, i % 5 == 1
        text = words(i, 40, 900)
        text = " ".join(f"{w}%%%" for w in text.split()) if junk else text + (" you idiot of a clown" if rude else "")
        rows.append((i, text, "s"))
        labels.append((i, int(not junk), int(rude)))
    return rows, labels


def test_resampling_keeps_good_documents(spark):
    rows, labels = corpus()
    got = {r.doc_id: r.kept for r in quality_classifier.importance_resample(documents(spark, rows), labelled(spark, labels[:200])).collect()}
    right = [got[i] == (quality == 1) for i, quality, _ in labels]
    assert np.mean(right) >= 0.99


def test_resampling_of_awkward_rows(spark):
    some = labelled(spark, [(1, 1, 0), (11, 0, 0), (None, 1, 1), (4, None, None)])
    assert quality_classifier.importance_resample(documents(spark), some).count() == len(texts())
    assert quality_classifier.importance_resample(empty(spark), some).count() == 0
    one_kind = quality_classifier.importance_resample(documents(spark), some.filter("quality = 1"))
    assert one_kind.filter("kept").count() == len(texts())


def test_resampling_against_brute_force(spark):
    """Counts, weights and the drawn sample, from the texts in plain Python."""
    rows, labels = corpus()
    got = {r.doc_id: r for r in quality_classifier.importance_resample(documents(spark, rows), labelled(spark, labels[:200])).collect()}
    n = quality_classifier.BUCKETS
    grams = {i: quality_classifier.ngrams(t) for i, t, _ in rows}
    raw = sum(np.bincount(g, minlength=n) for g in grams.values()) + 0.5
    target = sum(np.bincount(grams[i], minlength=n) for i, q, _ in labels[:200] if q == 1).astype(float)
    target = target + 0.5 * (target.sum() + 1) / raw.sum() * raw / raw.mean()
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, g in grams.items():
        assert got[i].n_ngrams == len(g)
        assert got[i].log_weight == pytest.approx(ratio[g].sum() * 50 / (len(g) + 50), abs=1e-9)
    k = round(400 * np.mean([q for _, q, _ in labels[:200]]))
    best = sorted(got.values(), key=lambda r: -r.key)[:k]
    assert {r.doc_id for r in got.values() if r.kept} == {r.doc_id for r in best}


def test_inclusion_follows_the_weights(spark):
    """Over 400 seeds: the frequencies of sampling one after another in proportion to the weights."""
    weights = np.array([0.0, 0.3, 0.7, 1.2, 2.0, 3.0])
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "doc_id long, w double").crossJoin(spark.range(400).toDF("seed"))
    df = df.withColumn("key", quality_classifier.gumbel_key(F.col("w"), F.col("seed").cast("string"), F.col("doc_id"))).toPandas()
    rank = df.groupby("seed").key.rank(ascending=False)
    got = df[rank <= 2].doc_id.value_counts().reindex(range(6), fill_value=0).to_numpy() / 400
    p = np.exp(weights) / np.exp(weights).sum()
    want = np.array([p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(6) if j != i) for i in range(6)])
    assert np.abs(got - want).max() < 4 * np.sqrt(0.25 / 400)
    first = df[rank <= 1].doc_id.value_counts().reindex(range(6), fill_value=0).to_numpy() / 400
    assert np.abs(first - p).max() < 4 * np.sqrt(0.25 / 400)


def test_top_threshold_is_exact(spark):
    keys = np.random.default_rng(0).normal(size=5000).tolist() + [0.5] * 10
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for most in (1, 7, 2500, 5009, 5010):
        assert quality_classifier.top_threshold(df, "key", most) == sorted(keys, reverse=True)[most - 1]


def test_toxicity_on_held_out_documents(spark):
    rows, labels = corpus()
    got = toxicity.toxicity(documents(spark, rows), labelled(spark, labels)).toPandas().set_index("doc_id")
    truth = np.array([t for _, _, t in labels])
    held = got.held_out[range(400)].to_numpy()
    assert 40 < held.sum() < 130
    assert ((got.predicted[range(400)].to_numpy() == truth)[held]).mean() >= 0.97
    assert got.score.between(0, 1).all()
    again = toxicity.toxicity(documents(spark, rows).repartition(5), labelled(spark, labels)).toPandas().set_index("doc_id")
    assert np.allclose(got.score.sort_index(), again.score.sort_index())


def test_interactions_that_no_additive_model_has(spark):
    """An insult alone and a group alone are harmless, and so is neither; the two together aren't."""
    rows, labels = [], []
    for i in range(1200):
        insult, group = i % 2, i // 2 % 2
        text = words(i, 12, 900) + (" wretched" if insult else "") + (" foreigners" if group else "")
        rows.append((i, text, "s"))
        labels.append((i, 1, insult * group if i % 4 else 1 - max(insult, group)))
    # toxic where both or neither are: no sum of a weight for each term has this order
    truth = {i: int((i % 2) == (i // 2 % 2)) for i in range(1200)}
    labels = [(i, 1, truth[i]) for i in range(1200)]
    got = toxicity.toxicity(documents(spark, rows), labelled(spark, labels)).filter("held_out").toPandas()
    assert np.mean([truth[i] == p for i, p in zip(got.doc_id, got.predicted)]) >= 0.95


def test_machine_against_brute_force():
    random = np.random.default_rng(0)
    place = np.full(toxicity.BUCKETS, -1, dtype=np.int32)
    place[:40] = np.arange(40)
    m = toxicity.Machine(place, 0.3, random.normal(size=40), random.normal(size=(40, toxicity.FACTORS)))
    for _ in range(20):
        ids = np.unique(random.integers(0, 60, 12))
        held = [i for i in ids if i < 40]
        margin = 0.3 + sum(m.weight[i] for i in held) + sum(m.factor[i] @ m.factor[j] for a, i in enumerate(held) for j in held[:a])
        assert m.score(ids) == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def test_held_out_labels_have_no_part(spark):
    rows, labels = corpus()
    df = labelled(spark, labels)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = df.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(documents(spark, rows), x).toPandas().set_index("doc_id").score.sort_index() for x in (df, turned))
    assert np.allclose(a, b)


def test_toxicity_of_awkward_rows(spark):
    none = labelled(spark, [])
    got = toxicity.toxicity(documents(spark), none).toPandas()
    assert len(got) == len(texts()) and got.score.between(0, 1).all()
    assert toxicity.toxicity(empty(spark), none).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int, score string")


def test_nearest_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.queries()["op3_nearest"](spark, SF).toPandas()
    frame = df.toPandas()
    x, ids = np.array(frame.embedding.tolist(), dtype=float), frame.vec_id.to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:10]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        place = {i: k for k, i in enumerate(ids)}
        assert np.allclose(own.score, d[[place[v] for v in own.vec_id]], rtol=0, atol=1e-12)
        hits += len(set(ids[order]) & set(own.vec_id))
        total += 10
    assert hits / total >= 0.9


def test_nearest_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0, 0.0, 0.0], 1, "x"), (1, [1.0, 0.0, 0.0, 0.0], 1, "x"), (2, [1.0, 0.0, 0.0, 0.0], 1, "x"), (3, [0.0, 1.0, 0.0, 0.0], 1, "x")]
    bad = [(4, None, 1, "x"), (5, [0.0] * 4, 1, "x"), (6, [nan, 1.0, 0.0, 0.0], 1, "x"), (7, [inf, 1.0, 0.0, 0.0], 1, "x"), (8, [1.0, None, 0.0, 0.0], 1, "x"), (None, [1.0, 0.0, 0.0, 0.0], 1, "x")]
    got = nearest.nearest_neighbours(vectors(spark, good + bad)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert got[2].score == pytest.approx(2**0.5)
    assert nearest.nearest_neighbours(vectors(spark, [])).count() == 0
    assert nearest.nearest_neighbours(vectors(spark, bad)).count() == 0
    same = [(i, [1.0, 2.0, 3.0, 4.0], 1, "x") for i in range(300)]
    got = nearest.nearest_neighbours(vectors(spark, same)).filter("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10))


def test_small_blocks_and_a_hot_cell(spark, monkeypatch):
    """Over many blocks and parts, a third of all vectors being one: the same neighbours as one by one."""
    monkeypatch.setattr(nearest, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 3)
    random = np.random.default_rng(4)
    x = random.normal(size=(1500, 6)).round(3)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, [float(c) for c in v], 0, "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, cell int, score string")
    got = nearest.nearest_neighbours(df, aim=0.99).toPandas()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 10 and np.allclose(own.score, d[own.vec_id], rtol=0, atol=1e-12)
        hits += len(set(want) & set(own.vec_id))
    assert hits / 150 >= 0.9


def test_blocks_hold_all_vectors():
    counts = np.array([5, 0, 250, 30, 90, 60, 1])
    first, spread = nearest.block_table(counts, 100)
    held = {}
    for cell, n in enumerate(counts):
        for s in range(spread[cell]):
            held[first[cell] + s] = held.get(first[cell] + s, 0) + n / spread[cell]
    assert max(held.values()) <= 100 and sum(held.values()) == counts.sum() and spread[2] == 3


def test_cells_are_visited_in_order_of_distance():
    random = np.random.default_rng(3)
    index = nearest.MultiIndex(2, random.normal(size=(9, 2)), random.normal(size=(7, 2)))
    x = random.normal(size=4)
    order = index.visit(x, np.ones(63, dtype=int), 63)
    sums = (nearest.squares(x[None, :2], index.first)[0][:, None] + nearest.squares(x[None, 2:], index.second)[0]).ravel()
    assert sorted(order) == list(range(63)) and (np.diff(sums[order]) >= 0).all()
