import hashlib

import numpy as np
import pytest

from grovecast.llm import suffixdedup as sd


def brute(rows, length=100):
    """Rows (doc_id, text) with distinct doc_ids; every window looked up in all earlier ones."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: r[0]):
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_cover():
    assert sd.IN_COVER.sum() == len(sd.COVER_SET)


def test_bucket_exact():
    rng = np.random.default_rng(0)
    for alphabet in (1, 2, 26):
        t = rng.integers(97, 97 + alphabet, 3000).astype(np.uint8)
        t[1500:2200] = t[100:800]
        first, count = np.array([0, 1400]), np.array([1300, 1500])
        got = sd.repeated(t, first, count, np.array([3, 7]), np.array([0, 0]), 100, sd.Powers())
        seen, want = set(), []
        for f, c in zip(first, count):
            for i in range(f, f + c):
                want.append(bytes(t[i : i + 100]) in seen)
                seen.add(bytes(t[i : i + 100]))
        assert got.tolist() == want


def test_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, sd.op4_suffix(spark, sf_dir).collect()))
    assert got == brute(rows)


@pytest.mark.parametrize("block", [300, 5000])
def test_small_blocks(spark, block):
    """Texts longer than a block, runs of one letter, and matches that begin in another document."""
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdé "), 2500))
    rows = [(5, base), (2, base[700:1500] + "x" * 400), (9, "x" * 900), (7, ""), (8, None), (3, "short"), (11, base[:99]), (12, base[50:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    runs, repeats = sd.repeated_runs(df, 100, block_bytes=block, bucket_bytes=2000)
    assert not repeats
    by = {}
    for r in runs.collect():
        by.setdefault(r.doc_id, []).append((bytes(r.first), bytes(r.last)))
    for d, n, gone, spans, _ in brute(rows):
        lo, hi = sd.removed_ranges([x for x, _ in by.get(d, [])], [y for _, y in by.get(d, [])], 100)
        assert (int((hi - lo).sum()), len(lo)) == (gone, spans), d


def test_edges(spark):
    long = "lorem ipsum dolor sit amet " * 8
    rows = [(1, long, 0, "a"), (1, long, 1, "b"), (1, "other " + long, 2, "c"), (None, long, 3, "d"), (2, "", 4, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int, bucket string")
    got = sd.remove_repeats(df, keep_text=True).collect()
    assert len(got) == 5
    for r in got:
        assert r.n_bytes - r.n_removed == len(r.kept)
    assert [r.n_removed for r in got if r.doc_id is None] == [len(long)]
    assert sd.remove_repeats(df.limit(0)).count() == 0
