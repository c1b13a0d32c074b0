import numpy as np

from grovecast.llm import quality
from grovecast.llm.suffixdedup import Powers


def test_look_counts():
    texts = [b"The cat\nthe CAT ###", b"", b"a\na\nb", "é 1".encode()]
    t = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    doc, feature, weight, page = quality.look(t, bounds, Powers())
    assert page.shape == (4, 14) and np.isfinite(page).all()
    # 5 tokens: the cat the cat ### in three kinds, with their prefixes
    assert abs((weight[doc == 0] ** 2).sum() / quality.SCALE**2 - 2) < 1e-5
    assert not (doc == 1).any()
    assert abs(page[2, 12] - 1 / 3) < 1e-9  # one of three lines repeats
    alone = quality.look(np.frombuffer(texts[0], np.uint8), np.array([0, len(texts[0])]), Powers())
    assert (alone[1] == feature[doc == 0]).all() and np.allclose(alone[3][0], page[0])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    some = labels.where("doc_id % 4 <> 0")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, some)).collect()}
    held = labels.where("doc_id % 4 = 0").collect()
    right = [(got[r.doc_id].score >= 0.5) == (r.quality == 1) for r in held]
    assert np.mean(right) > 0.95
    clean = [got[r.doc_id].kept for r in held if r.quality == 1 and r.toxic == 0]
    assert np.mean(clean) > 0.93


def plain(doc, head, pages):
    """Both views' sums of one document, by loops over its features."""
    t = np.frombuffer((doc.text or "").encode(), np.uint8)
    _, col, val, page = quality.look(t, np.array([0, len(t)]), Powers())
    text = sum(head.w["text"][c] * float(np.float32(np.float16(v))) for c, v in zip(col, val)) + head.w["text"][-1]
    x = pages.matrix(quality.described(page, [doc.lang], [doc.source]))[0]
    page = sum(a * b for a, b in zip(x, head.w["page"])) + head.w["page"][-1]
    return 1 / (1 + np.exp(-np.array([text, page])))


def test_rounds_against_brute_force(spark, sf_dir, monkeypatch):
    """Every round takes, of all unlabelled documents, those with the least hashes among the ones a view is sure of."""
    monkeypatch.setattr(quality, "SURE", 0.8)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.createDataFrame([(r.doc_id, k % 2, int(k % 3 == 0)) for k, r in enumerate(docs.orderBy("doc_id").limit(90).collect())], "doc_id long, quality int, toxic int")
    seen = []
    was = quality.Head.fit

    def spy(self, xs, rows):
        was(self, xs, rows)
        if not self.constant:
            seen.append((self, {v: dict(t) for v, t in self.told.items()}, {v: w.copy() for v, w in self.w.items()}))

    monkeypatch.setattr(quality.Head, "fit", spy)
    model = quality.fit(docs, labels, rounds=1, grow=7)
    told = {r.doc_id for r in labels.collect()}
    order = {r.doc_id: (r.o, r.key) for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text) key").selectExpr("doc_id", "key", "xxhash64(5, key) o").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in told]
    heads = list(dict.fromkeys(h for h, _, _ in seen))
    assert heads and len(seen) == 2 * len(heads)
    for head in heads:
        (_, _, first), (_, given, _) = [x for x in seen if x[0] is head]
        last, head.w = head.w, first
        p = {r.doc_id: plain(r, head, model.pages) for r in rows}
        head.w = last
        for v, other in ((0, "page"), (1, "text")):
            want = [min(7, sum((x[v] > 0.8) if c else (x[v] < 0.2) for x in p.values())) for c in (0, 1)]
            assert [list(given[other].values()).count(c) for c in (0.0, 1.0)] == want
    assert set(model.heads) == {"quality", "toxic"}


def test_edges(spark):
    rows = [(1, None, None, "a", 1.0), (2, "", "en", None, 2.0), (3, "word " * 50000, "en", "a", 3.0), (3, "x", "en", "a", 3.0), (None, "y", "fr", "b", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0), (2, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for told in (labels, none):
        m = quality.fit(docs, told)
        got = quality.score(docs, m).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        kept = quality.keep_good(docs, m)
        assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert all(r.kept for r in got)
    assert quality.score(docs.limit(0), m).count() == 0
