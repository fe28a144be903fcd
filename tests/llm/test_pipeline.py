"""The pipeline's stages on small tables, each against its own input and against what its operator should do there."""

from collections import Counter

import corpus_pipeline
import pytest
from sumi.llm import base, mixing, secret_scan, toxicity
from sumi.llm.base import materialize

from .test_near import groups_by_brute_force
from .test_texts import all_spans


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, materialize(stage(spark, docs, sf_dir), name))
        docs = seen[name][1]
    return seen


def test_columns(stages):
    for name, (_, after) in stages.items():
        if name != "pack":
            assert after.columns == list(corpus_pipeline.COLUMNS)


def test_toxicity_drops_what_the_score_rejects(spark, sf_dir):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    after = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    assert after == {k for k, v in scores.items() if v == 0} and 0 < len(after) < len(scores)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(toxic - after) > 0.6 * len(toxic) and len(clean - after) < 0.02 * len(clean)


def test_near_dedup_keeps_one_row_of_each_class(stages):
    before, after = stages["near_dedup"]
    assert after.exceptAll(before).count() == 0
    kept = [r.doc_id for r in after.collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {min(c) for c in groups_by_brute_force(before)}


def test_secrets_are_masked_where_they_stand(stages):
    before, after = stages["secrets"]
    got = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    assert len(got) == before.count()
    for r in before.collect():
        text, at, out = r.text or "", 0, ""
        for start, _, end in all_spans(text):
            if start >= at:
                out += text[at:start] + secret_scan.MASK
            at = max(at, end)
        assert got[r.doc_id] == (out + text[at:], len(out + text[at:]))


def test_mix_meets_its_targets(stages):
    before, after = stages["mix"]
    plan = mixing.plan_mix(before).collect()
    source, target, taken = {r.doc_id: r.source for r in before.collect()}, {}, Counter()
    for r in plan:
        target[source[r.doc_id]] = r.target
        taken[source[r.doc_id]] += r.taken
    largest = {s: max(r.size for r in plan if source[r.doc_id] == s) for s in target}
    # ten documents or so in a source here: what is left open is less than one of them
    assert all(abs(taken[s] - t) <= largest[s] / 2 for s, t in target.items())
    want = Counter({r.doc_id: r.taken // r.size for r in plan if r.taken})
    assert Counter(r.doc_id for r in after.collect()) == want
    assert after.distinct().exceptAll(before.distinct()).count() == 0


def test_pack_takes_every_row(stages):
    before, after = stages["pack"]
    first = Counter(r.doc_id for r in after.where("piece = 0").collect())
    assert first == Counter(r.doc_id for r in before.collect())


def test_stages_do_not_depend_on_what_is_broadcast(spark, sf_dir, monkeypatch):
    """With a broadcast limit of one row the rows are the same, and no text is shuffled but behind the key filter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    want = {name: key(stage(spark, docs, sf_dir)) for name, stage in corpus_pipeline.STAGES[:4]}
    monkeypatch.setattr(base, "BROADCAST_ROWS", 1)
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert key(stage(spark, docs, sf_dir)) == want[name], name
    plan = corpus_pipeline.drop_toxic(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_odd_tables(spark, odd, none, tmp_path):
    for frame, rows in ((odd, True), (none, False)):
        folder = str(tmp_path / ("odd" if rows else "none"))
        frame.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert (corpus_pipeline.run(spark, folder).count() > 0) == rows
