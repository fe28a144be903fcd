"""Near duplicates of texts and vectors, and components, against brute force."""

import numpy as np
import pytest

from sumi.llm import minhash, vectors
from sumi.llm.graph import components

from .conftest import make


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(ids, x, cosine):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    low = ids.copy()
    while True:
        new = np.array([min(low[i], low[near[i]].min()) if near[i].any() else low[i] for i in range(len(ids))])
        if (new == low).all():
            return near.sum(axis=1), low
        low = new


@pytest.mark.parametrize("block", [1024, 32])
def test_vectors(spark, block):
    """A group larger than a small block, equal copies, and vectors on their own."""
    rng = np.random.default_rng(0)
    alone = rng.normal(size=(150, 16))
    x = np.vstack([alone, alone[0] + rng.normal(size=(160, 16)) * 0.12, np.repeat(alone[5:6], 60, 0)]).astype(np.float32)
    ids = rng.permutation(len(x))
    frame = spark.createDataFrame([(int(i), [float(v) for v in row], "e") for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, uid string")
    got = vectors.near_vectors(frame, block=block).toPandas().set_index("vec_id").loc[ids]
    links, low = brute(ids, x.astype(np.float64), 0.95)
    assert (got.n_links.to_numpy() == links).all()
    assert (got.component_id.to_numpy() == low).all()
    assert (got.kept.to_numpy() == (low == ids)).all()


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, []), (8, [float("inf"), 1.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vectors.near_vectors(frame).collect())
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (8, 0, 8, True), (8, 1, 8, True), (8, 1, 8, True)]
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def groups_by_brute_force(frame):
    shingler = minhash.Shingler(minhash.word_idf(frame))
    rows = [(r.doc_id, shingler.of(r.text)) for r in frame.select("doc_id", "text").collect()]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (x, a), (y, b) = rows[i][1], rows[j][1]
            if x == y or (len(a) and len(b) and minhash.similarity(a, b) >= 0.8):
                p, q = sorted((root(i), root(j)))
                low[q] = p
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    return sorted(sorted(x, key=lambda v: (v is None, v or 0)) for x in members.values())


def copies(spark):
    """Copies with a few words changed, many texts that share a long passage only, and equal texts."""
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    base, rows = word(400), []
    for _ in range(40):
        t = list(base)
        for k in rng.integers(0, 400, 4):
            t[k] = f"c{rng.integers(0, 10**6)}"
        rows.append(" ".join(t))
    passage = word(60)
    rows += [" ".join([*word(15), *passage, *word(15)]) for _ in range(60)]
    rows += [" ".join(word(80)) for _ in range(30)] + [" ".join(base)] * 20 + ["Three words, only", "three words ONLY"]
    return make(spark, [(i, t, "a") for i, t in enumerate(rows)])


def test_near_duplicates(spark, docs):
    for frame in (copies(spark), docs):
        got = minhash.near_duplicates(frame).toPandas()
        assert sorted(sorted(x) for x in got.groupby("class_id").doc_id.apply(list)) == groups_by_brute_force(frame)
        assert (got[got.kept].doc_id == got[got.kept].class_id).all()
        assert got.kept.sum() == got.class_id.nunique()


def test_odd_texts(odd, none):
    got = minhash.near_duplicates(odd).toPandas()
    assert len(got) == 10
    classes = got.assign(doc_id=got.doc_id.fillna(-1)).groupby(got.class_id.fillna(-1)).doc_id.apply(sorted)
    assert classes.tolist() == [[-1], [1, 2, 3], [4, 5, 5], [6], [7], [8]]
    assert got.kept.sum() == 6
    assert minhash.near_duplicates(none).count() == 0


def test_texts_without_words(spark):
    got = minhash.near_duplicates(make(spark, [(1, "!!!", "a"), (2, "???", "a"), (3, " !!!\n", "a"), (4, "", "a"), (5, None, "a")])).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_sampling_estimates_weighted_similarity():
    rng = np.random.default_rng(4)
    sampler = minhash.Sampler(bands=400, rows=1)
    draw = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    a = np.sort(np.repeat(draw(600), rng.integers(1, 4, 600)))
    b = np.sort(np.concatenate([np.unique(a)[:400], np.unique(a)[:100], draw(200)]))
    keys = [sampler.keys(kinds, minhash.grid_steps(n, level)) for kinds, n, level in map(minhash.weigh, (a, b))]
    assert abs((keys[0] == keys[1]).mean() - minhash.similarity(a, b)) < 0.09


def test_similarity_by_brute_force():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 32, 40, dtype=np.uint64).astype(np.uint32)
    for _ in range(20):
        a, b = (np.sort(rng.choice(pool, n)) for n in rng.integers(1, 60, 2))
        weight = lambda k: float(minhash.LEVELS[k & 15])
        counts = [{k: int((x == k).sum()) for k in pool} for x in (a, b)]
        low, high = (sum(f(counts[0][k], counts[1][k]) * weight(k) for k in pool) for f in (min, max))
        assert minhash.similarity(a, b) == pytest.approx(low / high)


def test_idf_depends_on_shares_not_on_counts(spark):
    """Weights of a corpus and of the same ten times over are alike."""
    rows = [(i, f"the common word {'often' if i % 3 else 'seldom'} w{i} and the end of it", "a") for i in range(300)]
    one, ten = make(spark, rows), make(spark, rows * 10)
    a, b = minhash.word_idf(one).astype(int), minhash.word_idf(ten).astype(int)
    cell = lambda w: minhash.WordHashes()[w] >> (64 - minhash.TABLE_BITS)
    assert a[cell("common")] == b[cell("common")] == 0
    assert abs(a[cell("often")] - b[cell("often")]) < 5 and abs(a[cell("seldom")] - b[cell("seldom")]) < 5
    assert a[cell("common")] < a[cell("often")] < a[cell("seldom")] < a[cell("w7")]


def test_one_bucket_of_unlike_members(spark):
    """Documents that share a passage of half their words, dealt into small blocks; a few are copies."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"u{k}" for k in rng.integers(0, 10**6, n)]
    passage, rows = word(40), []
    for i in range(700):
        rows.append([*word(12), *passage, *word(12)])
    for i in range(0, 700, 100):
        rows.append([*rows[i][:-1], "changed"])
    frame = make(spark, [(i, " ".join(t), "a") for i, t in enumerate(rows)])
    got = minhash.near_duplicates(frame, bands=6, samples=1).toPandas()
    want = groups_by_brute_force(frame)
    assert sorted(sorted(x) for x in got.groupby("class_id").doc_id.apply(list)) == want
    assert len(want) == 700
