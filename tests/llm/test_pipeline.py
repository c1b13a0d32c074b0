import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from grovecast.llm import pii, quality  # noqa: E402

from .test_decontam import brute as contaminated  # noqa: E402
from .test_packing import check as packed_right  # noqa: E402
from .test_simhash import brute_similar  # noqa: E402


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        texts = [(d, r.text) for d, r in before.items()]
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == names
            after = {r.doc_id: r for r in docs.collect()}
            assert set(after) <= set(before) and docs.count() == len(after)
        if name == "quality":
            base = spark.read.parquet(f"{sf_dir}/documents.parquet")
            want = {r.doc_id for r in quality.score(base, quality.fit(base, labels)).where("kept").collect()}
            assert set(after) == want and 0 < len(after) < len(before)
            told = {r.doc_id: r for r in labels.collect()}
            fine = [d for d in before if d in told and told[d].quality == 1 and told[d].toxic == 0]
            assert sum(d in after for d in fine) >= 0.95 * len(fine)
        elif name == "near_duplicates":
            assert set(after) == {d for d, c in brute_similar(texts).items() if d == c}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in contaminated(texts, bench) if not r[5]}
        elif name == "personal_data":
            model = pii.fit()
            assert set(after) == set(before)
            for d, r in after.items():
                assert not any(pii.base_spans(r.text).values())
                assert r.text == pii.mask(before[d].text, pii.find(before[d].text, model)[1])
        if name != "packing":
            assert all(after[d][c] == before[d][c] for d in after for c in names if name != "personal_data" or c not in ("text", "n_chars"))
        else:
            rows = docs.collect()
            packed_right(rows, texts, 8192)
            whole = {}
            for r in sorted(rows, key=lambda r: r.piece):
                whole[r.doc_id] = whole.get(r.doc_id, "") + r.text
            assert whole == {d: t for d, t in texts if t and t.strip()}


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "batch" in out.columns and "text" in out.columns
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file://"))
    assert os.listdir(os.path.dirname(folder)) == [os.path.basename(folder)]  # what the earlier stages wrote is gone
