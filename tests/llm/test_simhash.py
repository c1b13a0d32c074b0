import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from grovecast.llm import simhash
from grovecast.llm.common import components


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fp = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, f"{fp[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def test_anchor_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        rx, kx = simhash.anchors(x[:, None])
        ry, ky = simhash.anchors(y[:, None])
        home = [simhash.at_home(simhash.half(x[:, None], p))[1] | np.uint64(p << 32) for p in (0, 1)]
        for i in range(len(x)):
            assert {int(home[0][i]), int(home[1][i])} & set(ky[ry == i].tolist()) and int(home[0][i]) in kx[rx == i]


def brute_similar(rows, similarity=0.8):
    """(doc_id, least doc_id of its group) by comparing all sketches."""
    fp = np.array([simhash.sketch((t or "").encode()) for _, t in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    most = int((1 - similarity) / 2 * fp.shape[1] * 64)
    for i in range(len(rows)):
        other = fp[:i] ^ fp[i]
        near = np.bitwise_count(other).sum(1) <= most
        halves = np.bitwise_count(np.ascontiguousarray(other).view("<u4")).min(1, initial=32) <= 1
        for j in np.flatnonzero(near & halves).tolist():
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_similar_against_jaccard(spark, sf_dir):
    """Copies with some words replaced: nearly all from 0.85 on are found, most from 0.8 on, and nothing below 0.6."""
    rng = np.random.default_rng(8)
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(400).collect()]
    found = {0.6: [], 0.8: [], 0.85: [], 0.9: [], 1.0: []}
    for k, t in enumerate(base):
        w = t.split()
        for at in rng.choice(len(w), max(1, int(len(w) * 0.05 * rng.random())), replace=False):
            w[at] = f"new{at}"
        s = jaccard(t, " ".join(w))
        x = simhash.sketch(t.lower().encode()) ^ simhash.sketch(" ".join(w).lower().encode())
        hit = np.bitwise_count(x).sum() <= int(0.1 * 192) and np.bitwise_count(x.view("<u4")).min() <= 1
        found[next(c for c in found if s <= c)].append(bool(hit))
        other = simhash.sketch(t.lower().encode()) ^ simhash.sketch(base[k - 1].lower().encode())
        assert np.bitwise_count(other).sum() > 19 or jaccard(t, base[k - 1]) > 0.6
    assert not any(found[0.6]) and np.mean(found[0.9]) > 0.8 and np.mean(found[1.0]) > 0.97


def test_similar_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, n)) for n in (3, 30, 80, 200, 200)]
    rows = [(k, t) for k, t in enumerate([None, "", *base, *base])]
    for _ in range(150):
        w = base[rng.integers(1, 5)].split()
        for at in rng.integers(0, len(w), rng.integers(1, 4)):
            w[at] = "x" + str(rng.integers(0, 3))
        rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df.repartition(5)).collect()}
    assert got == brute_similar(rows) and len(set(got.values())) < len(rows) / 2
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == sorted(set(got.values()))


@given(st.text(alphabet="aB \t\n\x0bé0", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fp(text)


def test_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, simhash.op1_simhash(spark, sf_dir).collect()))
    assert got == brute(rows)


def test_random_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = []
    for b in base:
        for _ in range(40):
            y = b
            for k in rng.choice(64, rng.integers(0, 4), replace=False):
                y ^= np.uint64(1) << np.uint64(k)
            fps.append(int(y.astype(np.int64)))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    for i in range(len(fps)):
        for j in range(i):
            if np.bitwise_count(u[i] ^ u[j]) <= 3:
                assert got[fps[i]] == got[fps[j]]


def test_links_of_sketches_are_whole(spark):
    """All pairs of up to 19 of 192 bits are linked, also where the bits are spread evenly over the words."""
    rng = np.random.default_rng(6)
    fps = []
    for k in range(200):
        x = rng.integers(0, 2**64, 3, dtype=np.uint64)
        y = x.copy()
        for n in range(19):  # a third of the bits in each word, by turns in each half of it
            y[n % 3] ^= np.uint64(1) << np.uint64(32 * (n // 3 % 2) + (n // 6) * 7 + k % 7)
        fps += [x, y]
        if k < 20:  # more of them at one anchor than are compared one by one
            for _ in range(20):
                z = y.copy()
                for b in rng.choice(192, rng.integers(1, 20), replace=False):
                    z[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
                fps.append(z)
    u = np.unique(np.array(fps, np.uint64), axis=0)
    df = spark.createDataFrame([tuple(r) for r in u.view(np.int64).tolist()], "fp long, fp1 long, fp2 long")
    got = {r.node: r.root for r in components(simhash.links(df.repartition(3), 19, 3)).collect()}
    root = [got.get(n, n) for n in simhash.node(u).tolist()]
    pairs = [(i, j) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]).sum(1) <= 19).tolist()]
    assert len(pairs) > 500 and all(root[i] == root[j] for i, j in pairs)


def test_links_of_a_large_group_are_few(spark):
    """Near copies of one text: their edges grow with the group, not with its pairs, and still hold it together."""
    rng = np.random.default_rng(8)
    base, count = rng.integers(0, 2**64, 3, dtype=np.uint64), {}
    for size in (300, 1200):
        u = np.tile(base, (size, 1))
        for row in u:
            for b in rng.choice(192, 6, replace=False):
                row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        u = np.unique(u, axis=0)
        df = spark.createDataFrame([tuple(r) for r in u.view(np.int64).tolist()], "fp long, fp1 long, fp2 long")
        edges = simhash.links(df, 19, 3).distinct().cache()
        count[size] = edges.count()
        assert {r.root for r in components(edges).collect()} == {int(simhash.node(u).min())}
        assert components(edges).count() == len(u)
    assert count[1200] < 12 * 1200 and count[1200] < 5 * count[300]


def test_edges(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", "z"), (None, "", "q"), (4, "one", "s"), (4, "one", "s"), (5, "A b " * 30000, "t"), (6, "a B " * 30000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert [g[2] for g in got if g[0] in (1, 2, 3, None)] == [1, 1, 1, 1]
    assert [g[2] for g in got if g[0] == 4] == [4, 4]
    assert {g[2] for g in got if g[0] in (5, 6)} == {5}
    kept = simhash.deduplicate(df)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5]
    none = df.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0
