import math
import re
from collections import Counter

import duckdb
import pytest

from grovecast.llm import rules


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    g = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def oracle(sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return sorted(con.execute(rules.ORACLE).fetchall())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_tables(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sorted(map(tuple, rules.op6_rules(spark, sf).collect()))
    for r in got[:400]:
        assert r[1:6] == brute(texts[r[0]])
    assert got == oracle(sf)
    if sf.endswith("0.1"):  # enough labels for cutoffs
        assert any(not r[6] and not r[7] for r in got)


def test_tail(spark):
    for n, k, p in ((50, 0, 0.01), (400, 3, 0.02), (2000, 11, 0.01)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        sql = rules._tail("n", "k", p)
        got = spark.sql(f"SELECT exp({sql}) AS p FROM (SELECT {n}L AS n, {k}L AS k)").first().p
        assert abs(got - want) < 1e-9


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "a b c a b c a b", "en"), (3, "a b c a b c a b", "en"), (None, "x\n\nx\ny\n \n \nx", "en"), (5, "é a\x0b# <b>\tq " * 30000, None), (6, "a b a b a", "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(1, 1), (3, None)], "doc_id long, quality int")
    got = rules.verdicts(docs, labels).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((d, *brute(t)) for d, t, _ in rows), key=key)
    assert all(r.kept is not None and r.base_failed is not None for r in got)
    assert rules.verdicts(docs.limit(0), labels.limit(0)).count() == 0
