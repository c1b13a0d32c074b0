import hashlib
import re

from grovecast.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench):
    grams = {}
    for i, t in bench:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    items |= grams[g]
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_brute_force(spark, sf_dir):
    read = lambda n, k: [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").select(k, "text").collect()]
    want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    got = sorted(map(tuple, decontam.op8_decontam(spark, sf_dir).collect()))
    assert got == sorted(want) and any(r[5] for r in got)


def test_built_size(spark):
    """What is sent has the size that the slices are cut by, and repeats in an item do not add up."""
    text = " ".join(f"word{k % 5000}" for k in range(60_000))
    b = spark.createDataFrame([(None, text), (2, "x " * 40_000)], "item_id long, text string")
    parts = list(decontam.slices(b, 1 << 30))
    grams = decontam.Grams(parts[0], 13)
    flat = grams.seq.nbytes + sum(x.nbytes for v in grams.by_width.values() for x in v[1:])
    assert len(parts) == 1 and flat < 30 * 100_000 and len(list(decontam.slices(b, 1 << 20))) == 2
    spans, items = grams.hits([b"x"] * 14)
    assert spans == [(0, 13), (1, 14)] and items == {"2"}
    assert grams.hits(decontam.words(text.encode())[:13]) == ([(0, 13)], {""})


def test_edges_and_slices(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = [(1, item), (2, "Short one."), (3, None), (4, "... !"), (10, item), (5, "é1 x")]
    docs = [(1, "say short ONE now"), (2, None), (3, ""), (4, item.upper() + " tail" * 400), (5, item), (5, item), (None, "é1, X"), (6, "word " * 50000 + item), (7, "short")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame([(*r, 1, "t") for r in docs], "doc_id long, text string, n_hit int, items string")
    key = lambda r: str(r)
    for most in (10, 1 << 20):
        got = decontam.verdicts(decontam.scan(d, b, slice_bytes=most)).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(docs, bench), key=key)
        kept = decontam.decontaminate(d, b, slice_bytes=most)
        assert kept.columns == d.columns
        assert sorted((r.doc_id for r in kept.collect())) == [2, 3, 4, 6, 7]
    cut = {r.doc_id: r.text for r in decontam.decontaminate(d, b, spans_only=True).collect()}
    assert cut[1] == "say  now" and cut[5] == "" and cut[2] is None
    assert decontam.scan(d.limit(0), b).count() == 0
    assert sum(r.n_hit for r in decontam.scan(d, b.limit(0)).collect()) == 0
