import math

import numpy as np
import pytest

from grovecast.llm import lmscore
from grovecast.llm.suffixdedup import Powers


def small():
    rng = np.random.default_rng(0)
    net = lmscore.Net(64)
    net = lmscore.Net(64, net.flat.astype(np.float64))
    return rng, net, rng.integers(0, 65, (40, 4)).astype(np.uint16), rng.integers(0, lmscore.IDS, 40).astype(np.int32)


def test_gradient():
    rng, net, around, ids = small()
    grads = lmscore.Net(64, np.zeros_like(net.flat))
    net.run(around, ids, grads)
    grads.e[grads.touched] = grads.moves
    for k in rng.choice(np.flatnonzero(np.abs(grads.flat) > 1e-4), 80):
        was, eps = net.flat[k], 1e-5
        net.flat[k] = was + eps
        up = -net.run(around, ids).mean()
        net.flat[k] = was - eps
        down = -net.run(around, ids).mean()
        net.flat[k] = was
        assert abs((up - down) / (2 * eps) - grads.flat[k]) < 1e-6


def test_probabilities_sum_to_one():
    _, net, around, _ = small()
    for scale in (1, 400):  # with and without scores that have to be shifted
        net.g *= scale
        lp = net.run(np.repeat(around[:1], lmscore.IDS, 0), np.arange(lmscore.IDS, dtype=np.int32))
        assert abs(np.exp(lp).sum() - 1) < 1e-6


def plain_tokens(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff\x20\x09-\x0d]+", low)


def hashed(token):
    t = np.frombuffer(token.encode(), np.uint8)
    return lmscore.tokens(t, np.array([0, len(t)]), Powers())[1]


def by_hand(docs, words, flat, counts):
    """Scores by loops over tokens; counts by token."""
    net = lmscore.Net(words.rows, flat)
    sums = np.zeros(lmscore.RARE)
    for token, n in counts.items():
        h = hashed(token)
        i = int(words.ids(h)[0][0])
        if i >= lmscore.OWN:
            sums[i - lmscore.OWN] += n
    out = {}
    for d, text in docs:
        got = [(t, *(int(x[0]) for x in words.ids(hashed(t))[:2])) for t in plain_tokens(text)]
        pad = [words.rows] * 2
        r, total = [*pad, *(x[2] for x in got), *pad], 0.0
        for k, (token, i, _) in enumerate(got):
            x = np.concatenate([net.e[j] for j in (r[k], r[k + 1], r[k + 3], r[k + 4])]).astype(float)
            h = np.tanh(x @ net.w + net.b)
            z, y = h @ net.g + net.gb, h @ net.i[i // 32] + net.ib[i // 32]
            total += z[i // 32] - math.log(np.exp(z).sum()) + y[i % 32] - math.log(np.exp(y).sum())
            if i >= lmscore.OWN:
                total += math.log(counts.get(token, 1) / (sums[i - lmscore.OWN] + 1))
        out[d] = (len(got), total)
    return out


def test_scores_by_hand(spark, monkeypatch):
    """Tokens with ids, cached ones of the classes, ones that are joined, and unknown ones."""
    monkeypatch.setattr(lmscore, "CACHED", 1000)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) if x < 10**6) + "; É!" for _ in range(120)] + ["The cat, the CAT", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {}
    for t in texts:
        for x in plain_tokens(t):
            counts[x] = counts.get(x, 0) + 1
    assert len(counts) > 1000
    model = lmscore.fit(docs)
    assert {r.token: r.n for r in model.counted.collect()} == {int(hashed(t).view(np.int64)[0]): n for t, n in counts.items()}
    other = [*enumerate(texts), (900, "never seen w1 before w2")]
    want = by_hand(other, model.words, model.flat, counts)
    got = lmscore.score(spark.createDataFrame(other, "doc_id long, text string").repartition(3), model).collect()
    for r in got:
        assert r.n_tokens == want[r.doc_id][0] and abs(r.log_prob - want[r.doc_id][1]) < 1e-3 + 1e-5 * abs(r.log_prob)
        assert r.mean_log_prob is None if not r.n_tokens else abs(r.mean_log_prob * r.n_tokens - r.log_prob) < 1e-6


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "SHARD_BYTES", 200_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").select("doc_id", "text")
    three, seven = (sorted((r.doc_id, r.log_prob) for r in (lambda d: lmscore.score(d, lmscore.fit(d)))(docs.repartition(k)).collect()) for k in (3, 7))
    # weights are the same; 32-bit sums of a batch depend in their last bits on the rows beside
    assert [d for d, _ in three] == [d for d, _ in seven] and np.allclose([x for _, x in three], [x for _, x in seven], rtol=1e-6, atol=1e-6)


def test_a_second_copy_is_seen(spark):
    """A text of rare words that occurs twice is likelier than one that occurs once."""
    rng = np.random.default_rng(6)
    rare = lambda k: " ".join(f"q{k}x{int(x)}" for x in rng.permutation(60))
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(200).collect()]
    once, twice = [rare(k) for k in range(20)], [rare(100 + k) for k in range(20)]
    rows = list(enumerate([*base, *once, *twice, *twice]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in lmscore.score(docs, lmscore.fit(docs)).collect()}
    assert min(got[200 + 20 + k] for k in range(40)) > max(got[200 + k] for k in range(20))


def test_learns(spark):
    """Held-out texts get likelier by training, and likelier than with their words in another order."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang = 'en'")
    rng = np.random.default_rng(1)
    fit = docs.where("doc_id % 5 <> 0")
    held = [(r.doc_id, r.text) for r in docs.where("doc_id % 5 = 0 and length(text) > 400").limit(60).collect()]
    mixed = [(d, " ".join(rng.permutation(t.split()))) for d, t in held]
    model = lmscore.fit(fit)
    raw = lmscore.Model(model.counted, model.words, lmscore.Net(model.words.rows).flat)
    mean = lambda rows, m: sum(r.log_prob for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()) / sum(len(t.split()) for _, t in rows)
    trained = mean(held, model)
    assert trained > mean(held, raw) + 1
    assert trained > mean(mixed, model)


def test_edges(spark):
    rows = [(1, None, 1), (2, " \n", 2), (3, "a b", 3), (3, "a b", 3), (None, "w " * 200000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = lmscore.score(docs, lmscore.fit(docs)).collect()
    assert sorted((r.n_tokens, r.mean_log_prob is None) for r in got) == [(0, True), (0, True), (2, False), (2, False), (200000, False)]
    none = docs.limit(0)
    model = lmscore.fit(none)
    assert lmscore.score(none, model).count() == 0 and lmscore.score(docs, model).count() == 5
    with pytest.raises(ValueError):
        lmscore.Net(64, np.zeros(3, np.float32))
