"""Scores on held-out rows, segments against brute force."""

import numpy as np
import pytest

from sumi.llm import quality, toxicity


def maximal_by_brute_force(x, low=0):
    """The best segment (the shortest of equal ones), then the same left and right of it."""
    best = max(((x[i:j].sum(), i - j, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return [*maximal_by_brute_force(x[:i], low), (best[0], low + i, low + j), *maximal_by_brute_force(x[j:], low + j)]


def test_segments():
    """All maximal segments, against the definition."""
    rng = np.random.default_rng(0)
    for n, shift in [(0, 0), (1, 0), (5, 0), (40, 0.3), (40, 0.0), (40, -0.2), (30, 0.8)]:
        for _ in range(4):
            x = rng.normal(-shift, 1, n)
            got, want = toxicity.segments(x), maximal_by_brute_force(x)
            assert [g[1:] for g in got] == [w[1:] for w in want]
            assert [g[0] for g in got] == pytest.approx([w[0] for w in want])


def test_counts_and_log_odds(spark):
    rows = [(1, "Bad bad word", 1), (2, "good word", 0), (3, "word", None), (4, None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, y int")
    counts, docs0, docs1 = toxicity.count_cells(frame, "y", 10)
    assert (docs0, docs1) == (2, 1)
    want = {k: np.zeros(1 << 10) for k in ("n", "n0", "n1")}
    for _, text, y in rows:
        for c in {c for w in toxicity.words(text) for c in toxicity.cells(w, 1023)}:
            want["n"][c] += 1
            if y is not None:
                want[f"n{y}"][c] += 1
    assert all((counts[k] == want[k]).all() for k in want)
    ratio, z = toxicity.cell_scores(counts, docs0, docs1, prior=10.0)
    total = sum(n + 0.01 for n in want["n"])
    for w in ("bad", "good", "word"):
        c = toxicity.cells(w, 1023)[0]
        share = [(want[k][c] + 10 * (want["n"][c] + 0.01) / total) / (want[k].sum() + 10) for k in ("n0", "n1")]
        assert ratio[c] == pytest.approx(np.log(share[1] / share[0]))
    assert z[toxicity.cells("bad", 1023)[0]] > 0 > z[toxicity.cells("good", 1023)[0]]


def test_karlin_lambda():
    scores, counts = np.array([-1.0, 0.5, 2.0]), np.array([90.0, 8.0, 2.0])
    root = toxicity.karlin_lambda(scores, counts)
    assert (counts / 100) @ np.exp(root * scores) == pytest.approx(1) and root > 0
    assert toxicity.karlin_lambda(scores, counts * 0) == 1.0


def test_logistic_fit_finds_the_curve():
    x = np.linspace(-4, 4, 81)
    p = 1 / (1 + np.exp(-(0.5 + 1.5 * x)))
    a, b = toxicity.fit_logistic(x, 1e5 * (1 - p), 1e5 * p)
    assert (a, b) == (pytest.approx(0.5, abs=1e-2), pytest.approx(1.5, abs=1e-2))


def test_context_vectors_by_brute_force(spark):
    """Neighbours within a document only, whatever lies beside it."""
    texts = ["A red fox, a RED fox!", "one", "", None, "red 12 fox", "fox"]
    index, want = quality.index_vectors(8, 8).astype(int), np.zeros((256, 8), int)
    for t in texts:
        words, shapes = quality.TokenCells(8).of(t)
        for i in range(len(words)):
            near = sum((index[words[j]] + index[shapes[j]] for j in (i - 1, i + 1) if 0 <= j < len(words)), np.zeros(8, int))
            want[words[i]] += near + index[shapes[i]]
            want[shapes[i]] += near + index[words[i]]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for some in (frame.coalesce(1), frame.repartition(3)):
        assert (quality.context_vectors(some, 8, 8) == want).all()


def test_pooling_by_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(256, 4)).astype(np.float32)
    texts = ["A red fox, a RED fox!", "", None, "one\ntwo"]
    got = quality.pooled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vectors).collect()
    for r, t in zip(sorted(got), texts, strict=True):
        words, shapes = quality.TokenCells(8).of(t)
        if not len(words):
            assert not any(r.features)
            continue
        n, pairs = len(words), list(zip(words, words[1:], strict=False))
        rates = [np.log1p(n), np.mean([a == b for a, b in pairs]), len(set(pairs)) / (n - 1), len(set(words)) / n, t.count("\n") / n, len(t) / n, len(set(shapes)) / n, np.mean([vectors[a] @ vectors[b] for a, b in pairs])]
        assert r.features == pytest.approx([*np.mean([vectors[w] for w in words], axis=0), *np.mean([vectors[s] for s in shapes], axis=0), *rates], abs=1e-5)


def test_network_by_brute_force():
    """The forward pass as loops, on a task that is easy to learn."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0).astype(float)
    net = quality.Network(x, y, hidden=6, epochs=150)
    z = (x[0] - net.mean) / net.scale
    hidden = [np.tanh(sum(z[i] * net.w[0][i, j] for i in range(5)) + net.w[1][j]) for j in range(6)]
    logit = (sum(h * w for h, w in zip(hidden, net.w[2], strict=True)) + net.w[3]) / net.temperature
    assert net.probability(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-logit)))
    assert ((net.probability(x) > 0.5) == y).mean() > 0.85


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_do_not_depend_on_layout(spark, module):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    one, other = (dict(module.score(d, labels).select("doc_id", "score").collect()) for d in (docs, docs.repartition(7)))
    assert one.keys() == other.keys()
    assert max(abs(one[k] - other[k]) for k in one) < 1e-9


def test_string_and_decimal_ids(spark, odd):
    labels = spark.createDataFrame([(4, 1), (8, 0)], "doc_id long, toxic int")
    for kind in ("string", "decimal(20,0)"):
        d, y = odd.withColumn("doc_id", odd.doc_id.cast(kind)), labels.withColumn("doc_id", labels.doc_id.cast(kind))
        assert toxicity.score(d, y).count() == 10
        assert quality.score(d, y.withColumnRenamed("toxic", "quality")).count() == 10


def auc(y, p):
    order = np.argsort(np.argsort(p)) + 1
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.85), (quality, "quality", 0.98)])
def test_held_out(spark, module, label, least):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = module.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(both[label].to_numpy(), both.score.to_numpy()) > least
    assert both.predicted[both[label] == 0].mean() < 0.05


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd(spark, odd, none, module, label):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (6, None), (8, 0), (5, 1)], f"doc_id long, {label} int")
    got = module.score(odd, labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert module.score(odd, labels.limit(0)).count() == 10
    assert module.score(none, labels).count() == 0


def test_repeats_of_a_word_count_less():
    """The k-th occurrence of a positive word counts 1 / k, negative scores stay, and no words give no scores."""
    got = toxicity.damp(["a", "b", "a", "c", "a", "b"], np.array([6.0, 1.0, 6.0, -0.05, 6.0, 1.0]))
    assert got.tolist() == [6.0, 1.0, 3.0, -0.05, 2.0, 0.5]
    assert toxicity.damp([], np.zeros(0)).tolist() == []
