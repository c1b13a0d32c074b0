import itertools
import re
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from grovecast.llm import packing


def padding(lengths, counts, bounds):
    return sum(c * (next(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_bounds_against_all_choices(histogram, buckets):
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[n] for n in lengths])
    bounds, cost = packing.best_bounds(lengths, counts, buckets)
    assert len(bounds) <= buckets and bounds == sorted(set(bounds)) and padding(lengths, counts, bounds) == cost
    rest = lengths[:-1].tolist()
    want = min(padding(lengths, counts, [*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(rest, k))
    assert cost == want


def check(rows, docs, budget):
    got = defaultdict(list)
    batches = defaultdict(list)
    for r in rows:
        assert 0 <= r.padding == r.bound - r.n_tokens and r.n_tokens <= r.bound <= budget
        got[r.doc_id].append((r.piece, r.start, r.n_tokens))
        batches[r.bucket, r.batch].append(r)
    for (bucket, _), b in batches.items():
        assert sum(r.bound for r in b) <= budget
        assert sorted(r.slot for r in b) == list(range(len(b)))
    for bucket in {k for k, _ in batches}:
        numbers = sorted(n for k, n in batches if k == bucket)
        assert numbers == list(range(len(numbers)))  # only the last batch may have room
        full = budget // batches[bucket, 0][0].bound
        assert all(len(batches[bucket, n]) == full for n in numbers[:-1])
    want = defaultdict(int)
    for d, t in docs:
        want[d] += len(re.findall(r"\w+|[^\s\w]", t or ""))
    assert {d: sum(n for _, _, n in p) for d, p in got.items()} == {d: n for d, n in want.items() if n}


def test_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = packing.op3_packing(spark, sf_dir).collect()
    check(rows, docs, packing.BUDGET)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 5)
    rows = [(1, None, 1), (2, "", 2), (3, " \n", 3), (4, "one two", 4), (4, "one two", 4), (None, "a b c", 5), (6, "w " * 1000, 6)] + [(10 + i, "x " * (i % 7), 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    got = packing.pack(df, budget=64, buckets=3).collect()
    check(got, [r[:2] for r in rows], 64)
    assert packing.pack(df.limit(0)).count() == 0 and packing.pack(df.where("doc_id < 4")).count() == 0
