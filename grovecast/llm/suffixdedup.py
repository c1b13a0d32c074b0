"""Removal of repeated byte strings by blockwise sorting of suffix buckets with difference-cover tie breaking.

Every start of a `length`-byte string (a window) falls into the suffix bucket of its minimiser, the least hash of its
16-byte strings; equal windows share a bucket, and neighbouring windows mostly do, so a bucket gets runs of windows
with one copy of their text. One bucket at a time is sorted: its windows by a rolling fingerprint, and what is left
tied is resolved exactly by comparing the first and last COVER bytes and, for all that lies between, the precomputed
ranks of the difference-cover sample: for any two starts i and j some d < COVER puts both i + d and j + d into the
sample, so one comparison of ranks stands for length - COVER bytes. Memory is bounded by the bucket.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_buffers

GRAM = 16
COVER = 32
#: difference cover modulo 32: every difference occurs between two members
COVER_SET = (0, 1, 2, 4, 8, 13, 18)


def _cover() -> tuple[np.ndarray, np.ndarray]:
    """Is a residue in the cover; and for residues (r, s) the least d with r + d and s + d both in it."""
    members = set(COVER_SET)
    shift = np.full((COVER, COVER), -1, np.int64)
    for r in range(COVER):
        for s in range(COVER):
            shift[r, s] = next((d for d in range(COVER) if (r + d) % COVER in members and (s + d) % COVER in members), -1)
    if (shift < 0).any():
        raise AssertionError("not a difference cover")
    return np.isin(np.arange(COVER), COVER_SET), shift


IN_COVER, SHIFT = _cover()
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_BYTES = np.random.default_rng(2024).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


class Powers:
    """Powers of the rolling fingerprint's base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _R), ("down", _R_INVERSE)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


def prefix_sums(t: np.ndarray, powers: Powers) -> np.ndarray:
    out = np.zeros(len(t) + 1, np.uint64)
    up, _ = powers.get(len(t) + 1)
    np.cumsum(_BYTES[t] * up[: len(t)], out=out[1:])
    return out


def rolled(sums: np.ndarray, starts: np.ndarray, lengths, powers: Powers) -> np.ndarray:
    """64-bit fingerprints of the strings that begin at starts."""
    _, down = powers.get(len(sums))
    h = (sums[starts + lengths] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def words_at(t: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position, as an unaligned view; t is padded by 8 bytes at least."""
    return np.ndarray((len(t) - 7,), "<u8", t.data if t.flags.c_contiguous else np.ascontiguousarray(t).data, strides=(1,))


def minimisers(t: np.ndarray, length: int) -> np.ndarray:
    """For each window the least hash of its GRAM-byte strings; t is not padded."""
    w = words_at(np.concatenate([t, np.zeros(8, np.uint8)]))
    h = w[: len(t) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += w[8 : len(t) - GRAM + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    span, have = length - GRAM + 1, 1
    while have * 2 <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < span:
        h = np.minimum(h[: len(h) - (span - have)], h[span - have :])
    return h


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after the other."""
    ends = np.cumsum(sizes)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if not len(out):
        return out
    full = sizes > 0
    s, z = starts[full], sizes[full]
    at = np.concatenate([[0], np.cumsum(z)[:-1]])
    out[at] = s - np.concatenate([[0], s[:-1] + z[:-1] - 1])
    out[0] = s[0]
    return np.cumsum(out)


def super_windows(t: np.ndarray, doc_start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, last + 1, minimiser) of the runs of windows with one minimiser; doc_start has n + 1 entries."""
    if len(t) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    m = minimisers(t, length)
    size = np.diff(doc_start)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    pos = ranges(doc_start[:-1], np.maximum(size - length + 1, 0))
    m = m[pos]
    new = np.ones(len(pos), bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(pos)]]) - 1
    return doc[first], pos[first], pos[last] + 1, m[first]


def repeated(t: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray, place: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """One bucket: which windows have an equal window that starts earlier.

    Run k has count[k] windows from byte first[k] of t on; order[k] and place[k] say where its first window is in the
    corpus (document rank, byte). The result follows the windows, run after run.
    """
    pos = ranges(first, count)
    n = len(pos)
    dup = np.zeros(n, bool)
    if n < 2:
        return dup
    sums = prefix_sums(t, powers)
    h = rolled(sums, pos, length, powers)
    bits = max(1, int(n - 1).bit_length())
    keyed = np.sort((h >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    who = (keyed & np.uint64((1 << bits) - 1)).astype(np.int64)
    same = (keyed[1:] ^ keyed[:-1]) >> np.uint64(bits) == 0
    tied = np.zeros(n, bool)
    tied[1:] |= same
    tied[:-1] |= same
    who = who[tied]
    if not len(who):
        return dup
    run = np.repeat(np.arange(len(first)), count)
    at_order, at_place = order[run[who]], place[run[who]] + (pos[who] - first[run[who]])
    who = who[np.lexsort((at_place, at_order, h[who]))]
    p, hh = pos[who], h[who]
    new = np.ones(len(who), bool)
    new[1:] = hh[1:] != hh[:-1]
    # the head of each group of equal fingerprints is its earliest window; every other is compared with it exactly
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    other = np.flatnonzero(~new)
    if not len(other):
        return dup
    i, j = p[other], p[head[other]]
    ok = equal(t, sums, i, j, length, powers)
    run_of, run_head = run[who[other]], run[who[head[other]]]
    later = (order[run_of] != order[run_head]) | (place[run_of] + i - first[run_of] > place[run_head] + j - first[run_head])
    dup[who[other[ok & later]]] = True
    for k in other[~ok]:  # unequal strings with one fingerprint: compare with all earlier ones of the group
        a = bytes(t[p[k] : p[k] + length])
        dup[who[k]] = any(bytes(t[p[x] : p[x] + length]) == a for x in range(head[k], k))
    return dup


def equal(t: np.ndarray, sums: np.ndarray, i: np.ndarray, j: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Exactly: are the strings at i and j equal. Ranks of the cover sample stand for the bytes between both ends."""
    span = length - COVER
    w = words_at(np.concatenate([t, np.zeros(8, np.uint8)]))
    ok = np.ones(len(i), bool)
    for d in [*range(0, COVER, 8), *range(span, length, 8)]:
        d = min(d, length - 8)
        ok &= w[i + d] == w[j + d]
    d = SHIFT[i % COVER, j % COVER]
    need = np.unique(np.concatenate([i + d, j + d]))
    rank = cover_ranks(t, w, sums, need, span, powers)
    return ok & (rank[np.searchsorted(need, i + d)] == rank[np.searchsorted(need, j + d)])


def cover_ranks(t: np.ndarray, w: np.ndarray, sums: np.ndarray, sample: np.ndarray, span: int, powers: Powers) -> np.ndarray:
    """Ranks of the span-byte strings at the sample: equal strings, and only those, have one rank.

    Sorted by fingerprint, each is compared with its predecessor byte by byte (eight at a time).
    """
    h = rolled(sums, sample, span, powers)
    by = np.argsort(h, kind="stable")
    s = sample[by]
    differs = np.ones(len(by), bool)
    differs[1:] = h[by][1:] != h[by][:-1]
    tie = np.flatnonzero(~differs)
    bad = np.zeros(len(tie), bool)
    for d in range(0, span, 8):
        d = min(d, span - 8)
        bad |= w[s[tie] + d] != w[s[tie - 1] + d]
    differs[tie[bad]] = True  # one fingerprint for two strings: at worst equal strings get two ranks and are told apart below
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(differs)
    if bad.any():
        names: dict[bytes, int] = {}
        for k in np.flatnonzero(np.isin(h, h[by][tie[bad]])):
            rank[k] = -1 - names.setdefault(bytes(t[sample[k] : sample[k] + span]), len(names))
    return rank


def _runs(flags: np.ndarray, run: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flagged neighbours within one run of windows: (run, first place, last place + 1)."""
    f = np.flatnonzero(flags)
    if not len(f):
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.ones(len(f), bool)
    new[1:] = (np.diff(f) != 1) | (run[f][1:] != run[f][:-1])
    a = f[new]
    b = f[np.concatenate([np.flatnonzero(new)[1:], [len(f)]]) - 1]
    return run[a], place[a], place[b] + 1


#: buckets that travel together: a block's windows of all of them are compressed as one, so that the size of what is
#: moved does not grow as the buckets become many and a block's share of each becomes small
TOGETHER = 8
BLOB = "bucket int, sure binary, meta binary, body binary"


def _pack(level: int, arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(a.astype("<i8").tobytes() for a in arrays))


def _unpack(raw: bytes) -> list[np.ndarray]:
    a = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8")
    out, at = [], 1 + int(a[0])
    for n in a[1 : 1 + int(a[0])]:
        out.append(a[at : at + int(n)])
        at += int(n)
    return out


def repeated_runs(docs: DataFrame, length: int = 100, block_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, mark, first, last): starts of repeated windows, as runs from first to last - 1, in binary lists.

    mark is the CRC-32 of the text where a doc_id names several rows, else 0.
    """
    if length < COVER + 8 + GRAM:
        raise ValueError(f"length must be {COVER + 8 + GRAM} at least")
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    repeats = not plain.groupBy("doc_id").count().where("count > 1").isEmpty()
    span = length - GRAM + 1
    buckets = max(1, int(total * (1 + 2 * length / (span + 1)) / bucket_bytes))

    def cut_up(batches):
        powers = Powers()
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            offs, data = text_buffers(batch.column(1))
            size = np.diff(offs)
            row = 0
            by = np.argsort(ids, kind="stable")
            while row < len(ids):
                end, room = row, block_bytes
                while end < len(ids) and (end == row or room >= size[by[end]]):
                    room -= size[by[end]]
                    end += 1
                rows = by[row:end]
                row = end
                if size[rows].sum() <= 2 * block_bytes:
                    t = data[ranges(offs[rows], size[rows])]
                    yield from emit(t, np.concatenate([[0], np.cumsum(size[rows])]), ids[rows], None, powers)
                else:  # one very long text, in pieces that overlap
                    whole = data[offs[rows[0]] : offs[rows[0] + 1]]
                    mark = zlib.crc32(whole.tobytes()) if repeats else 0
                    for a in range(0, len(whole), block_bytes):
                        part = whole[a : a + block_bytes + length - 1]
                        yield from emit(part, np.array([0, len(part)]), ids[rows[:1]], (a, mark), powers)

    def emit(t, doc_start, ids, piece, powers):
        doc, a, b, m = super_windows(t, doc_start, length)
        if not len(doc):
            return
        sums = prefix_sums(t, powers)
        h = rolled(sums, a, b - a + length - 1, powers)
        shift, mark = piece or (0, None)
        if mark is not None:
            marks = np.full(len(ids), mark)
        elif repeats:
            marks = np.array([zlib.crc32(t[x:y].tobytes()) for x, y in zip(doc_start[:-1], doc_start[1:], strict=True)])
        else:
            marks = np.zeros(len(ids), np.int64)
        place = a - doc_start[doc] + shift
        # runs that repeat a whole earlier run of this block need not travel
        _, head, back = np.unique(h, return_index=True, return_inverse=True)
        head = head[back]
        late = np.flatnonzero(head != np.arange(len(h)))
        raw, sure = t.tobytes(), []
        for k, x in zip(late.tolist(), head[late].tolist(), strict=True):
            if b[k] - a[k] == b[x] - a[x] and raw[a[k] : b[k] + length - 1] == raw[a[x] : b[x] + length - 1] and (ids[doc[k]] != ids[doc[x]] or place[k] > place[x]):
                sure.append(k)
        sure = np.array(sure, np.int64)
        stay = np.ones(len(h), bool)
        stay[sure] = False
        k = np.flatnonzero(stay)
        bucket = (m[k] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        k, bucket = k[by], bucket[by]
        crate = bucket // TOGETHER
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(crate)) + 1, [len(crate)]])
        packer = zstandard.ZstdCompressor(level=3)
        rows = []
        if len(sure):
            known = _pack(1, [ids[doc[sure]], marks[doc[sure]], place[sure], place[sure] + b[sure] - a[sure]])
            rows.append((int(m[sure[0]] % np.uint64(buckets)) // TOGETHER, known, None, None))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            part = k[x:y]
            body = packer.compress(t[ranges(a[part], b[part] - a[part] + length - 1)].tobytes())
            meta = _pack(1, [b[part] - a[part], ids[doc[part]], marks[doc[part]], place[part], bucket[x:y]])
            rows.append((int(crate[x]), None, meta, body))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "sure", "meta", "body"])

    def spans(ids, marks, first, last):
        """One row for each document; ids in any order."""
        by = np.lexsort((first, marks, ids))
        ids, marks, first, last = ids[by], marks[by], first[by], last[by]
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(marks) != 0)) + 1, [len(ids)]]) if len(ids) else np.zeros(1, int)
        packed = [[x[p:q].astype("<i8").tobytes() for p, q in zip(cuts[:-1], cuts[1:], strict=True)] for x in (first, last)]
        return pa.table([pa.array(ids[cuts[:-1]], pa.int64()), pa.array(marks[cuts[:-1]], pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], ["doc_id", "mark", "first", "last"])

    def sort_buckets(group):
        sure = [_unpack(x) for x in group.column("sure").to_pylist() if x is not None]
        metas = [_unpack(x) for x in group.column("meta").to_pylist() if x is not None]
        known = [np.concatenate(x) for x in zip(*sure, strict=True)] if sure else [np.zeros(0, np.int64)] * 4
        if not metas:
            return spans(*known)
        count, ids, marks, place, bucket = (np.concatenate(x) for x in zip(*metas, strict=True))
        unzip = zstandard.ZstdDecompressor()
        t = np.frombuffer(b"".join(unzip.decompress(x) for x in group.column("body").to_pylist() if x is not None), np.uint8)
        first = np.concatenate([[0], np.cumsum(count + length - 1)[:-1]])
        by = np.argsort(bucket, kind="stable")
        powers, found = Powers(), [known]
        for k in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            size = count[k] + length - 1
            text = t[ranges(first[k], size)]
            # rows that share a doc_id count as one document: neither removes the other's equal starts
            dup = repeated(text, np.concatenate([[0], np.cumsum(size)[:-1]]), count[k], ids[k], place[k], length, powers)
            run = np.repeat(np.arange(len(k)), count[k])
            r, a, b = _runs(dup, run, ranges(place[k], count[k]))
            found.append([ids[k][r], marks[k][r], a, b])
        return spans(*(np.concatenate(x) for x in zip(*found, strict=True)))

    pieces = plain.mapInArrow(cut_up, BLOB)
    return pieces.groupBy("bucket").applyInArrow(sort_buckets, "doc_id long, mark long, first binary, last binary"), repeats


def removed_ranges(first: list[bytes], last: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte ranges from the runs of repeated starts of one document."""
    if not first:
        z = np.zeros(0, np.int64)
        return z, z
    a = np.frombuffer(b"".join(first), "<i8")
    b = np.frombuffer(b"".join(last), "<i8") + length - 1
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return a[at], b[np.concatenate([at[1:], [len(a)]]) - 1]


def _zip_texts(batches):
    """Texts as compressed bytes: a join moves half as much."""
    for b in batches:
        zip_ = zstandard.ZstdCompressor(level=3)
        texts = [zip_.compress(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], ["doc_id", "mark", "text"])


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, starts, stops, kept]) of each row of docs (doc_id, text).

    Every byte covered by a `length`-byte string that also starts earlier (smaller doc_id, or the same document before)
    goes; matches never cross documents and are judged on the input. A null or empty text has no bytes. Rows with one
    doc_id are one document to this rule: equal starts in them do not remove each other. A null doc_id counts as larger
    than all others. Other columns are ignored. An empty table gives an empty table. With keep_text the removed ranges
    and the remaining bytes come too.
    """
    runs, repeats = repeated_runs(docs, length)
    far = np.iinfo(np.int64).max
    found = runs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    mark = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).cast("long") if repeats else F.lit(0).cast("long")
    left = docs.select(F.col("doc_id").cast("long"), mark.cast("long").alias("mark"), F.col("text").cast("string"))
    left = left.mapInArrow(_zip_texts, "doc_id long, mark long, text binary").withColumn("key", F.coalesce("doc_id", F.lit(int(far))))
    both = left.join(found.withColumnRenamed("doc_id", "key"), ["key", "mark"], "left").select("doc_id", "text", F.col("runs.first").alias("first"), F.col("runs.last").alias("last"))
    extra = ", starts array<long>, stops array<long>, kept binary" if keep_text else ""

    def finish(batches):
        for b in batches:
            unzip = zstandard.ZstdDecompressor()
            rows = []
            for z, x, y in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                t = np.frombuffer(unzip.decompress(z), np.uint8)
                lo, hi = removed_ranges(x or [], y or [], length)
                gone = int((hi - lo).sum())
                if gone:
                    keep = np.ones(len(t), bool)
                    keep[ranges(lo, hi - lo)] = False
                    kept = t[keep].tobytes()
                else:
                    kept = t.tobytes()
                rows.append((len(t), gone, len(lo), hashlib.sha256(kept).hexdigest()) + ((lo.tolist(), hi.tolist(), kept) if keep_text else ()))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops", "kept"][: 7 if keep_text else 4]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            cols = [pa.array([r[c] for r in rows], kinds[c]) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    return both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)


def op4_suffix(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
