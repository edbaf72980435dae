import corpus_pipeline
import numpy as np
import pytest
from fixture import documents, empty
from oracle import SF

from plume.llm import common, near_duplicates, packing, personal


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.stored(stage(spark, docs, SF), "test")
        out.append((name, before.toPandas(), docs.toPandas()))
    return out


def test_columns_stay_until_the_last(stages):
    for _, before, after in stages[:-1]:
        assert list(before.columns) == list(after.columns)


def test_quality_only_takes_away(stages):
    _, before, after = stages[0]
    assert set(after.doc_id) <= set(before.doc_id)


def test_quality_keeps_the_good(spark):
    """On the next larger tables: the smallest have eleven bad labels."""
    sf_dir = SF.replace("0.001", "0.01")
    after = corpus_pipeline.quality(spark, common.table(spark, sf_dir, "documents"), sf_dir).select("doc_id").toPandas()
    labels = common.table(spark, sf_dir, "labels").toPandas().set_index("doc_id").quality
    kept = labels.index.isin(after.doc_id)
    assert kept[labels == 1].mean() >= 0.98 and kept[labels == 0].mean() <= 0.1


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    sets = [(i, set(near_duplicates.shingle_set(t, 5).tolist())) for i, t in zip(before.doc_id, before.text)]
    root = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    least = {}
    for (doc_id, _), r in zip(sets, root):
        least[r] = min(doc_id, least.get(r, doc_id))
    assert sorted(after.doc_id) == sorted(least.values())


def test_personal_data_is_gone(stages, spark):
    _, before, after = stages[2]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    left = personal.personal(spark.createDataFrame(after[["doc_id", "text"]])).toPandas()
    assert left[["n_email", "n_ip", "n_card", "n_phone"]].sum().sum() == 0
    changed = before.set_index("doc_id").text.sort_index() != after.set_index("doc_id").text.sort_index()
    assert after.set_index("doc_id").text.sort_index()[changed].str.contains("<(?:email|ip|card|phone|context)>").all()
    assert (after.n_chars == after.text.str.len()).all()


def test_copies_are_at_most_two(stages):
    _, before, after = stages[3]
    assert after.doc_id.value_counts().max() <= 2 and set(after.doc_id) <= set(before.doc_id)


def test_sequences_hold_the_mix(stages):
    _, before, after = stages[4]
    tokens = [len(b) // 4 + 1 for b in packing.token_bytes(before.text.tolist(), packing.default_tokenizer())]
    assert after.length.sum() == sum(tokens)
    assert after.groupby("sequence_id").length.sum().max() <= 4096
    assert after.sequence_id.nunique() <= np.ceil(sum(tokens) / 4096) * 1.1 + 2


def test_awkward_and_empty_tables_pass_all_stages(spark, tmp_path):
    for name, docs in (("awkward", documents(spark)), ("empty", empty(spark))):
        for kind, table in (("documents", docs), ("labels", spark.createDataFrame([(1, 1, 0), (11, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))):
            table.write.parquet(f"{tmp_path}/{name}/{kind}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").toPandas()
        assert (len(out) > 0) == (name == "awkward")
        assert out.empty or out.groupby("sequence_id").length.sum().max() <= 4096


def test_stages_take_effect_on_rows_without_doc_id(spark):
    text = "mail x.y@z.org now " + " ".join(f"v{k}" for k in range(60))
    docs = documents(spark, [(None, text, "s"), (None, text + " end", "s"), (3, text, "s"), (3, "two of one id", "s"), (4, None, None)])
    clean = corpus_pipeline.personal_data(spark, docs, "").collect()
    assert not any("@" in (r.text or "") for r in clean) and len(clean) == 5
    once = corpus_pipeline.deduplicate(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in once if r.text) == [(3, text), (3, "two of one id")] or len(once) == 3
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.filter("text is null").count() == 0
