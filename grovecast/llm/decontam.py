"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised word n-grams.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. Training texts are scanned window by
window; a rolling hash over the ids of benchmark words proposes hits and the words themselves verify them. Benchmark
texts are broadcast in slices, cut by the size of what is built of them; a task has one slice in memory at a time.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SLICE_BYTES = 64 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class Grams:
    """The n-grams of a slice of the benchmark as flat arrays: sorted rolling hashes, one place of each gram, its items.

    Distinct grams always have distinct hashes (the hash is drawn anew until they have), so a window is verified by
    comparing its words with one gram. A word takes one entry of a dictionary, each of its occurrences about 30 bytes.
    """

    def __init__(self, items: list[tuple], width: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        seq, place, size, owner = [], [], [], []
        at = 0
        for name, text in items:
            w = words(text)
            if not w:
                continue
            n = min(width, len(w))
            seq.append(np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.uint32))
            place.append(np.arange(at, at + len(w) - n + 1, dtype=np.int64))
            size.append(np.full(len(w) - n + 1, n, np.int32))
            owner.append(np.full(len(w) - n + 1, len(self.names), np.int32))
            self.names.append("" if name is None else str(name))
            at += len(w)
        self.seq = np.concatenate(seq) if seq else np.zeros(0, np.uint32)
        self.by_width: dict[int, tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        if not seq:
            return
        place, size, owner = map(np.concatenate, (place, size, owner))
        for n in np.unique(size).tolist():
            self.by_width[n] = self._sorted(place[size == n], owner[size == n], n)

    def _sorted(self, place: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(base, hash and first place of each distinct gram, where its items begin, items)."""
        base = _BASE
        while True:
            h = self.rolled(self.seq, n, base)[place]
            by = np.lexsort((owner, h))
            hs, ps, os = h[by], place[by], owner[by]
            new = np.ones(len(hs), bool)
            new[1:] = hs[1:] != hs[:-1]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            if self.same(self.seq, ps, self.seq, ps[head], n).all():
                break
            base = base * np.uint64(0xD1342543DE82EF95) | np.uint64(1)
        first = new.copy()
        first[1:] |= os[1:] != os[:-1]  # an item once for each gram
        kept = np.flatnonzero(first)
        starts = np.searchsorted(kept, np.flatnonzero(new))
        return base, hs[new], ps[new], np.append(starts, len(kept)), os[kept]

    @staticmethod
    def same(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        ok = np.ones(len(i), bool)
        for k in range(n):
            ok &= a[i + k] == b[j + k]
        return ok

    @staticmethod
    def rolled(ids: np.ndarray, n: int, base: np.uint64 = _BASE, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the n ids from each place on, or from the places `at`; the last n - 1 places have none of their own."""
        h = np.zeros(len(ids) if at is None else len(at), np.uint64)
        for k in range(n):
            h *= base
            if at is None:
                h[: len(ids) - k] += ids[k:]
            else:
                h += ids[at + k]
            h ^= h >> np.uint64(32)
        return h

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of verified windows, and the items they belong to."""
        found, items = [], set()
        if not self.by_width or len(w) < min(self.by_width):
            return found, items
        get = self.ids.get
        ids = np.array([get(x, 0) for x in w], np.uint32)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, (base, hashes, place, starts, owner) in self.by_width.items():
            if len(w) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = self.rolled(ids, n, base)[at] if len(at) * 3 > len(ids) else self.rolled(ids, n, base, at)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            maybe = hashes[k] == h
            at, k = at[maybe], k[maybe]
            ok = self.same(ids, at, self.seq, place[k], n)
            found += [(i, i + n) for i in at[ok].tolist()]
            for g in np.unique(k[ok]).tolist():
                items.update(self.names[o] for o in owner[starts[g] : starts[g + 1]].tolist())
        return found, items


def slices(benchmark: DataFrame, most: int = SLICE_BYTES):
    """Lists of (item_id, text), read one after the other; what Grams builds of one takes about `most` bytes at most."""
    part, size, seen = [], 0, set()
    for name, raw in benchmark.select(F.col("item_id").cast("string"), F.encode(F.col("text").cast("string"), "UTF-8")).toLocalIterator():
        w = words(bytes(raw)) if raw is not None else []
        if not w:
            continue
        here = 30 * len(w) + 120 * len(set(w) - seen)
        if part and size + here > most:
            yield part
            part, size, seen = [], 0, set()
            here = 30 * len(w) + 120 * len(set(w))
        part.append((name, bytes(raw)))
        seen.update(w)
        size += here
    yield part


HITS = "doc_id long, n_words long, n_hit long, items array<string>, hit_from array<int>, hit_to array<int>"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def sliced(spark, benchmark: DataFrame, width: int, slice_bytes: int) -> list:
    return [spark.sparkContext.broadcast(Grams(part, width)) for part in slices(benchmark, slice_bytes)]


def batch_hits(sent: list, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """(words, merged hit ranges, items) of each text, over all slices; one slice is in memory at a time."""
    of = [words(t) for t in texts]
    spans: list[list] = [[] for _ in of]
    items: list[set] = [set() for _ in of]
    for b in sent:
        grams = b.value
        for k, w in enumerate(of):
            found, names = grams.hits(w)
            spans[k] += found
            items[k] |= names
        if len(sent) > 1:
            del b._value
    return [(len(w), merged(s), i) for w, s, i in zip(of, spans, items, strict=True)]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 13, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """HITS for each row of docs: word ranges inside benchmark windows, and the items whose windows occur.

    Benchmark items of fewer than `width` words, but not none, are one window. A null or empty text has no words and no
    hits. Repeated rows give repeated results; a benchmark item that repeats is one item; a null item_id is named "".
    Other columns are ignored.
    An empty benchmark hits nothing; empty docs give an empty table.
    """
    sent = sliced(docs.sparkSession, benchmark, width, slice_bytes)

    def run(batches):
        for b in batches:
            rows = [
                (n, sum(y - x for x, y in spans), sorted(items), [x for x, _ in spans], [y for _, y in spans])
                for n, spans, items in batch_hits(sent, b.column(1).cast(pa.binary()).to_pylist())
            ]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            cols = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_words", "n_hit", "items", "hit_from", "hit_to"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, HITS)


def verdicts(hits: DataFrame, share: int = 20) -> DataFrame:
    """Contract columns: contaminated if a hit word occurs and at least one word in `share` is hit."""
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, spans_only: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs without the contaminated ones; or, with spans_only, all rows with the hit words cut from their texts.

    All columns stay. Null and empty texts stay. Documents whose few hit words are under the share are clean.
    """
    sent = sliced(docs.sparkSession, benchmark, width, slice_bytes)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            found = batch_hits(sent, texts)
            if spans_only:
                cut = [cut_words(t, spans) if spans else t for t, (_, spans, _) in zip(texts, found, strict=True)]
                yield b.set_column(at, b.schema.field(at), pa.array(cut, pa.binary()).cast(b.schema.field(at).type))
            else:
                hit = [sum(y - x for x, y in spans) for _, spans, _ in found]
                yield b.filter(pa.array([not (h and share * h >= n) for h, (n, _, _) in zip(hit, found, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [m.span() for m in WORD.finditer(text.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def op8_decontam(spark, sf_dir: str) -> DataFrame:
    return verdicts(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT doc_id, x.n, i, item FROM x JOIN g USING (n, gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
