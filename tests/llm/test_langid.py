import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from grovecast.llm import langid


def full(n, t, i, o, s):
    """Blended probability of s at order o."""
    if o < 0:
        return 1 / 256
    whole = n[o][t[i - o : i]]
    if not whole:
        return full(n, t, i, o - 1, s)
    kinds, sums = len(whole), sum(whole.values())
    if s in whole:
        return whole[s] / (sums + kinds)
    return kinds / (sums + kinds) * full(n, t, i, o - 1, s) / (1 - sum(full(n, t, i, o - 1, x) for x in whole))


def slow_full(train, text, order):
    n = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        t = b"\0" * order + t
        for i in range(order, len(t)):
            for o in range(order + 1):
                n[o][t[i - o : i]][t[i]] += 1
    t = b"\0" * order + text
    return -sum(math.log2(full(n, t, i, order, t[i])) for i in range(order, len(t)))


def model_of(spark, train, **how):
    df = spark.createDataFrame(train, "text string, lang string")
    return langid.train(df, **how)


def test_code_lengths(spark):
    train = [("abracadabra", "x"), ("banana é", "x"), ("lorem ipsum", "y"), ("", "y"), (None, "y"), ("zzz", None)]
    texts = ["abra", "", "zq", "ipsum lo", "é"]
    offs, data = langid.text_buffers(pa.array(texts))
    for order in (2, 3, 5):
        m = model_of(spark, train, order=order)
        assert m.langs == ["x", "y"]
        got = m.bits(data, offs)
        for k, t in enumerate(texts):
            for x, lang in enumerate(m.langs):
                want = slow_full([a.encode() for a, b in train if b == lang and a], t.encode(), order)
                assert abs(got[k, x] - want) < 1e-3 * (1 + want), (t, lang, got[k, x], want)


def test_lengths_are_a_code(spark):
    train = [("abcabcabd", "x"), ("abc and cab, é", "y")]
    for rows in (1 << 22, 24):  # all contexts, and only the frequent ones
        m = model_of(spark, train, rows=rows)
        for context in (b"\0\0\0", b"\0ab", b"abc", b"bca", b"zzz", b"\xc3ab", b"\0\0a"):
            codes = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
            assert np.allclose(np.exp2(-m.lengths(codes).astype(float)).sum(0), 1, atol=1e-4)
    assert len(m.seen[2][0].keys) < len(model_of(spark, train).seen[2][0].keys)


def test_index():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    index = langid.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(2**63)) == -1).all()
    assert (langid.Index(keys[:0]).find(keys) == -1).all()


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = langid.op7_langid(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)


def test_edges(spark):
    m = model_of(spark, [("the cat and the dog", "en"), ("der hund und die katze", "de")])
    rows = [(1, None, "q"), (2, "", "q"), (3, "12 ! 3", "q"), (5, "½ ² ③ Ⅷ", "q"), (4, "the dog", "q"), (4, "the dog", "q"), (None, "die katze " * 20000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = [tuple(r)[:2] for r in langid.identify(df, m, piece=1000).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (5, "und"), (4, "en"), (4, "en"), (None, "de")]
    assert {r.lang_pred for r in langid.identify(df, langid.Model([])).collect()} == {"und"}
    assert langid.identify(df.limit(0), m).count() == 0
