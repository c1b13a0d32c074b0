"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit majority votes over the XXH64 of word shingles. Two fingerprints that differ in at most three
bits differ in at most one bit in one of their two 32-bit halves. Each half has the perfect Hamming(31, 26) code as
anchors (radius 1; bit 31 is kept as it is), so every half lies within the radius of exactly one anchor, its home. A
half is replicated to every anchor within radius + 1, at most 17 of them; two halves that differ in one bit meet at
the home of either. Rows are then compared per anchor.

Majority votes tell a similarity of 0.8 poorly: at three bits of 64 most such pairs are missed. Where documents are to be
deduplicated by similarity (`similar`, `deduplicate`), fingerprints of WORDS words serve whose bits come from min-wise samples
of the shingles. Of their quarter words (16 bits, Hamming(15, 11) as anchors) one at least differs in at most one bit where
the whole differs in fewer than two bits for each quarter, so that anchors of radius 1 find all such pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut

SMALL = 8
HELD = 1 << 18  # edges that a task holds to fold them into stars


def _pair_table(bits: int) -> np.ndarray:
    """By syndrome: the masks that lead to the codewords at distance two (15 of 32 bits, 7 of 16)."""
    out = np.zeros((bits, bits // 2 - 1), np.uint64)
    for s in range(1, bits):
        out[s] = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, bits) if (i ^ s) > i]
    return out


#: by the bits of a part: the masks of its code's checks, and its pair table
_MASKS = {bits: np.array([sum(1 << (j - 1) for j in range(1, bits) if j >> k & 1) for k in range(bits.bit_length() - 1)], np.uint64) for bits in (16, 32)}
_FLIPS = {bits: _pair_table(bits) for bits in (16, 32)}


def shingle_hashes(text: bytes | None, width: int = 3) -> list[int]:
    words = text.lower().split() if text else []
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts[: len(words) - width + 1], stops[width - 1 :], strict=True)]


def fingerprint(text: bytes | None, width: int = 3, block: int = 65536) -> int:
    """Majority bits over the shingles of one text; 0 for a text without words."""
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        h = np.array(hashes[at : at + block], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of docs. Null or empty texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def anchors(fp: np.ndarray, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor key) of all replicas of the fingerprints, one row of 64-bit words each: 17 at most of each half word, 9 of each quarter."""
    rows, keys = [], []
    index = np.arange(len(fp))
    for part in range(64 // bits * fp.shape[1]):
        x = half(fp, part, bits)
        syndrome, home = at_home(x, bits)
        tag = np.uint64(part) << np.uint64(32)
        off = np.flatnonzero(syndrome)
        far = (x[off, None] ^ _FLIPS[bits][syndrome[off]]).ravel()
        rows += [index, index, np.repeat(index[off], bits // 2 - 1)]
        keys += [home | tag, home ^ np.uint64(1 << (bits - 1)) | tag, far | tag]
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def half(fp: np.ndarray, part, bits: int = 32) -> np.ndarray:
    """The bits of each fingerprint, a half word or a quarter, that have the number `part` (one for all, or one for each)."""
    at = part // (64 // bits)
    word = fp[:, at] if isinstance(part, int) else fp[np.arange(len(fp)), at]
    return word >> (np.uint64(bits) * np.asarray(part % (64 // bits)).astype(np.uint64)) & np.uint64((1 << bits) - 1)


def at_home(x: np.ndarray, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(syndrome, home anchor) of halves or quarters."""
    syndrome = sum((np.bitwise_count(x & m) & 1).astype(np.int64) << k for k, m in enumerate(_MASKS[bits]))
    return syndrome, x ^ np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - 1).astype(np.uint64), np.uint64(0))


def _linked(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= most


def _forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that span the linked parts of one anchor's rows: each row is compared with those not yet reached."""
    links, left = [], np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = _linked(fp[left], fp[i], most)
            if near.any():
                hit = left[near]
                links += [(i, j) for j in hit.tolist()]
                queue += hit.tolist()
                left = left[~near]
    return links


def _meet(fp: np.ndarray, home: np.ndarray, most: int) -> list[tuple[int, int]]:
    """All links between the rows at home and the rest of one large anchor; edges that span its links where those are many."""
    links: list[tuple[int, int]] = []
    for at in range(0, len(home), 128):
        mine = home[at : at + 128]
        # words after the first are only compared where that one is near enough
        a, b = np.nonzero(np.bitwise_count(fp[mine, None, 0] ^ fp[None, :, 0]) <= most)
        a = mine[a]
        ok = a != b
        a, b = a[ok], b[ok]
        ok = _linked(fp[a], fp[b], most)
        links += zip(a[ok].tolist(), b[ok].tolist(), strict=True)
        if len(links) > 8 * len(fp):
            return _forest(fp, most)
    return links


def _compare(key: np.ndarray, fp: np.ndarray, most: int, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of fp that are linked, for whole anchors in a row; where links are many, edges that span them."""
    a, b = [], []
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts = np.concatenate([[0], cuts])
    size = np.diff(np.concatenate([starts, [len(key)]]))
    of = np.repeat(size, size)
    home = at_home(half(fp, key >> 32, bits), bits)[1].astype(np.int64) == key & 0xFFFFFFFF
    for d in range(1, SMALL):
        i = np.flatnonzero((key[:-d] == key[d:]) & (of[:-d] <= SMALL)) if len(key) > d else np.zeros(0, int)
        i = i[home[i] | home[i + d]]
        i = i[_linked(fp[i], fp[i + d], most)]
        a.append(i)
        b.append(i + d)
    for g in np.flatnonzero(size > SMALL):
        s = slice(starts[g], starts[g] + size[g])
        if pairs := _meet(fp[s], np.flatnonzero(home[s]), most):
            p = np.array(pairs) + starts[g]
            a.append(p[:, 0])
            b.append(p[:, 1])
    return np.concatenate(a), np.concatenate(b)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the closure of the edges (a, b), one for each node but the least of each linked part, which all lead to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    i = np.flatnonzero(root != np.arange(len(ids)))
    return ids[i], ids[root[i]]


def node(fp: np.ndarray) -> np.ndarray:
    """One 64-bit number for each fingerprint: itself if it has one word, else a hash of its words."""
    out = fp[:, 0]
    for w in range(1, fp.shape[1]):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + fp[:, w] * np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64)


def _words(b: pa.RecordBatch, count: int) -> np.ndarray:
    return np.stack([b.column(b.schema.get_field_index(f"fp{w}" if w else "fp")).to_numpy(zero_copy_only=False).view(np.uint64) for w in range(count)], axis=1)


def links(fps: DataFrame, most: int = 3, words: int = 1) -> DataFrame:
    """Edges (a, b) between the nodes of distinct fingerprints (columns fp, fp1, ... of `words` words).

    Linked are all pairs of fingerprints that differ in at most `most` bits, fewer than two for each part, so that some part
    differs in at most one. The edges have the closure of all links: a task sends stars, so that their number follows that of
    the rows it compared, never that of a group's pairs.
    """
    bits = 32 if words == 1 else 16
    if not 0 <= most < 2 * (64 // bits) * words:
        raise ValueError(f"radius-one anchors of {bits} bits serve fewer than {2 * (64 // bits) * words} differing bits")
    names = ["fp", *(f"fp{w}" for w in range(1, words))]

    def replicate(batches):
        for b in batches:
            fp = _words(b, words)
            for at in range(0, len(fp), 10000):
                part = fp[at : at + 10000]
                row, key = anchors(part, bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(part[row, w].view(np.int64)) for w in range(words))], ["anchor", *names])

    def edges(parts):
        key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, b = _compare(key, fp, most, bits)
        return _stars(node(fp[a]), node(fp[b]))

    def compare(batches):
        held: list = []
        for stars in found(batches):
            held.append(stars)
            if sum(len(a) for a, _ in held) > HELD:
                held = [_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > HELD // 2:
                    yield sent(held.pop())
        if held:
            yield sent(_stars(*(np.concatenate(x) for x in zip(*held, strict=True))))

    def sent(stars):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars], ["a", "b"])

    def found(batches):
        open_: list = []  # the last anchor may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            key, fp = b.column(0).to_numpy(), _words(b, words)
            if key[0] != key[-1] or (open_ and open_[-1][0][-1] != key[0]):
                whole = int(np.searchsorted(key, key[-1], "left"))
                done = [*open_, (key[:whole], fp[:whole])]
                if sum(len(k) for k, _ in done):
                    yield edges(done)
                open_ = [(key[whole:], fp[whole:])]
            else:
                open_.append((key, fp))
        if open_:
            yield edges(open_)

    spread = fps.select(*names).mapInArrow(replicate, "anchor long, " + ", ".join(f"{n} long" for n in names))
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): near-duplicate groups of docs (doc_id, text, any other columns, which are ignored).

    A null, empty or blank text has fingerprint 0 and is linked like any other; a text of fewer than `width` words is
    one shingle. Repeated rows give repeated rows with one component. A null doc_id stays null and never names a
    component unless its whole group has none. An empty table gives an empty table. Ties cannot occur: a component is
    named by its least doc_id. Equal fingerprints are one node, so copies are never paired with each other.
    """
    fps = cut(fingerprints(docs, width))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(nodes, most))
    named = nodes.join(roots, nodes["fp"] == roots["node"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    # written out, so that both sides of the last join are plain exchanges and Spark can split a hot fingerprint
    of = cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


WORDS = 3  # 64-bit words of a sketch
_BINS = 64 * WORDS
_TRIES = np.random.default_rng(77).integers(0, _BINS, (_BINS, 48))


def sketch(text: bytes | None, width: int = 5) -> np.ndarray:
    """A fingerprint whose bits agree for a share (1 + s) / 2 of texts with the similarity s of their shingle sets.

    Each bit has a bin of the shingles' hashes and is one bit of a hash of the least in it; an empty bin takes another's.
    Zero for a text without words.
    """
    hashes = np.unique(np.array(shingle_hashes(text, width), np.uint64))
    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    which = ((hashes >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    used, first = np.unique(which, return_index=True)
    from_ = np.full(_BINS, -1)
    from_[used] = first
    empty = np.flatnonzero(from_ < 0)
    for t in range(_TRIES.shape[1]):
        if not len(empty):
            break
        got = np.where(np.isin(_TRIES[empty, t], used), from_[_TRIES[empty, t]], -1)
        from_[empty] = got
        empty = empty[got < 0]
    from_[empty] = first[np.searchsorted(used, empty) % len(used)]
    h = hashes[from_] ^ np.arange(_BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.packbits((h >> np.uint64(63)).astype(np.uint8), bitorder="little").view("<u8")


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): groups of documents whose sets of `width`-word shingles are alike, by their sketches.

    Two documents are linked if their sketches agree in the share of bits that the similarity asks for; the anchors find
    all of these. A null or empty text is like any other of them. Rows without a doc_id are left out; rows that share one
    are in one group.
    """
    most = int((1 - similarity) / 2 * _BINS)
    names = ["fp", *(f"fp{w}" for w in range(1, WORDS))]

    def run(batches):
        for b in batches:
            fp = np.array([sketch(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node(fp)), *(pa.array(fp[:, w].view(np.int64)) for w in range(WORDS))], ["doc_id", "node", *names])

    told = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    fps = cut(told.mapInArrow(run, "doc_id long, node long, " + ", ".join(f"{n} long" for n in names)))
    nodes = cut(fps.groupBy("node").agg(F.min("doc_id").alias("rep"), *(F.min(n).alias(n) for n in names)))
    edges = links(nodes.select(*names), most, WORDS)
    twice = fps.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    roots = components(edges.union(twice))
    named = nodes.join(roots, "node").groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(named, "root").select("node", "component_id")
    of = cut(nodes.join(linked, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")))
    return fps.join(of, "node").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that keep one document of each group of `similar`: its least doc_id.

    Rows without a doc_id cannot be told apart and stay. Rows that share a doc_id stand or fall together, and of those
    that stand one stays: the one whose text comes first in byte order.
    """
    found = similar(docs, width, similarity)
    # each doc_id once, and whether it names several rows
    keep = found.groupBy("doc_id").agg(F.min("component_id").alias("root"), F.count("*").alias("rows")).where("doc_id = root")
    keep = cut(keep.select(F.col("doc_id").alias("__keep"), F.col("rows").alias("__rows")))
    kept = docs.join(keep.select("__keep"), docs["doc_id"] == F.col("__keep"), "left_semi")
    if not keep.where("__rows > 1").isEmpty():
        first = Window.partitionBy("doc_id").orderBy("text")
        kept = kept.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
