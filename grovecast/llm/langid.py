"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree (orders ORDER down to 0, and uniform) with escape method C and
exclusion is counted over all training texts. The counts are frozen: what a context has seen has its exact code length,
and a context has one escape length for all else, which goes on at the next shorter context; with exclusion this is the
escape over the mass that the shorter context leaves. So a byte costs one look-up for all languages if its longest
context has seen it in any of them, and one more for each escape.

The counts are aggregated in tasks. The tree is grown below a context only where it occurs often enough: the least power
of two for which an order has at most ROWS entries (context, byte, language), so the model that is broadcast has a bound
whatever the corpus; up to that size every context stays.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_buffers

ORDER = 3
ROWS = 1 << 22
_LETTER = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Is any character a letter; fractions, superscripts and number signs are none."""
    return any(any(map(str.isalpha, m.group())) for m in _LETTER.finditer(text))


def _codes(data: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """(previous `order` bytes, byte) of every byte as one number; zero bytes stand before every text."""
    t = data[offs[0] : offs[-1]]
    full = np.diff(offs) > 0
    starts, ends = offs[:-1][full] - offs[0], offs[1:][full] - offs[0]
    code = t.astype(np.uint64)
    for d in range(1, order + 1):
        before = np.zeros(len(t), np.uint64)
        before[d:] = t[: max(0, len(t) - d)]
        for j in range(d):
            at = starts + j
            before[at[at < ends]] = 0
        code |= before << np.uint64(8 * d)
    return code


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, code, n): how often each byte follows each `order` bytes, over all texts of (text, lang)."""

    def run(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            lang = np.array(b.column(1).to_pylist(), object)
            offs, data = text_buffers(b.column(0))
            for name in dict.fromkeys(lang.tolist()):
                rows = np.flatnonzero(lang == name)
                # rows of one language, in pieces of bounded size
                size = np.diff(offs)[rows]
                cuts = np.flatnonzero(np.diff(np.cumsum(size) // (8 << 20))) + 1
                for part in np.split(rows, cuts):
                    o = np.concatenate([[0], np.cumsum(np.diff(offs)[part])])
                    if not o[-1]:
                        continue
                    joined = np.concatenate([data[offs[r] : offs[r + 1]] for r in part])
                    key, n = np.unique(_codes(joined, o, order), return_counts=True)
                    if name in total:
                        had = total[name]
                        key, back = np.unique(np.concatenate([had[0], key]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([had[1], n]), len(key)).astype(np.int64)
                    total[name] = (key, n)
        for name, (key, n) in total.items():
            for a in range(0, len(key), 50000):
                part = key[a : a + 50000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(n[a : a + 50000])], ["lang", "code", "n"])

    return docs.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Index:
    """Rows of distinct 64-bit keys by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], at[lost] + 1 & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        left, at = None, self.slot(keys)
        while len(at):
            row = self.slots[at]
            wanted = keys if left is None else keys[left]
            used = row >= 0
            hit = used & (self.keys[row] == wanted) if len(self.keys) else used
            if left is None:
                out[hit] = row[hit]
                left = np.arange(len(keys))
            else:
                out[left[hit]] = row[hit]
            on = used & ~hit
            left, at = left[on], at[on] + 1 & self.mask
        return out


def _low(order: int) -> np.uint64:
    return np.uint64((1 << 8 * (order + 1)) - 1)


class Model:
    """Code lengths in bits for all languages at once: of what a context has seen in any of them, and of its escape."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """levels[o]: (language, code, n) of order o; codes are unsigned."""
        self.langs = sorted(set(levels[0][0].tolist())) if levels else []
        self.order = len(levels) - 1
        if not self.langs:
            return
        seen = np.zeros((256, len(self.langs)))
        name, code, n = levels[0]
        seen[code.astype(np.int64), np.searchsorted(self.langs, name.tolist())] = n
        kinds = (seen > 0).sum(0)
        free = 1 - kinds / 256
        escape = np.where(free > 1e-15, kinds / (seen.sum(0) + kinds) / np.maximum(free, 1e-15) / 256, 0)
        self.base = -np.log2(np.maximum(np.where(seen > 0, seen / (seen.sum(0) + kinds), escape), 2.0**-60)).astype(np.float32)
        self.seen: list = []
        self.escapes: list = []
        for o in range(1, self.order + 1):
            name, code, n = levels[o]
            lang = np.searchsorted(self.langs, name.tolist())
            keys = np.unique(code)
            below = 2.0 ** -self.lengths(keys, o - 1).astype(float)
            whole, at = np.unique(code >> np.uint64(8), return_inverse=True)
            row = np.searchsorted(keys, code)
            total, kinds, used = (np.zeros((len(whole), len(self.langs))) for _ in range(3))
            np.add.at(total, (at, lang), n)
            np.add.at(kinds, (at, lang), 1)
            np.add.at(used, (at, lang), below[row, lang])
            free = 1 - used
            # a context that a language lacks costs it nothing
            escape = np.where(kinds > 0, np.where(free > 1e-12, kinds / np.maximum(total + kinds, 1) / np.maximum(free, 1e-12), 2.0**-60), 1.0)
            p = below * escape[np.searchsorted(whole, keys >> np.uint64(8))]
            p[row, lang] = n / (total + kinds)[at, lang]
            self.seen.append((Index(keys), -np.log2(np.maximum(p, 2.0**-60)).astype(np.float32)))
            self.escapes.append((Index(whole), -np.log2(escape).astype(np.float32)))

    def lengths(self, codes: np.ndarray, order: int | None = None) -> np.ndarray:
        """Exact code length of each byte after its context: (codes, languages)."""
        order = self.order if order is None else order
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        left = np.arange(len(codes))
        for o in range(order, 0, -1):
            index, cost = self.seen[o - 1]
            code = codes[left] & _low(o)
            row = index.find(code)
            hit = row >= 0
            out[left[hit]] += cost[row[hit]]
            left, code = left[~hit], code[~hit]
            index, cost = self.escapes[o - 1]
            row = index.find(code >> np.uint64(8))
            hit = row >= 0
            out[left[hit]] += cost[row[hit]]
        out[left] += self.base[(codes[left] & np.uint64(255)).astype(np.int64)]
        return out

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Exact code length of each text under each language: (texts, languages)."""
        size = np.diff(offs)
        sums = np.zeros((len(size), len(self.langs)))
        full = np.flatnonzero(size > 0)
        if len(full):
            sums[full] = np.add.reduceat(self.lengths(_codes(data, offs, self.order)), offs[:-1][full] - offs[0], axis=0, dtype=np.float64)
        return sums


def train(docs: DataFrame, order: int = ORDER, rows: int = ROWS) -> Model:
    """Fit on docs (text, lang); rows without text or language are skipped. At most `rows` entries an order reach the driver."""
    if not 0 <= order <= 6:
        raise ValueError("order must be 0 to 6")
    known = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    every = cut(counts(known, order))
    langs = every.select("lang").distinct().count()
    levels = []
    for o in range(order + 1):
        level = every if o == order else every.groupBy("lang", F.col("code").bitwiseAND(F.lit(int(_low(o)))).alias("code")).agg(F.sum("n").alias("n"))
        if o:
            contexts = level.groupBy("lang", F.shiftrightunsigned("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
            sizes = {r[0]: r[1] for r in contexts.groupBy(F.floor(F.log2("total")).cast("int").alias("e")).agg(F.sum("entries")).collect()}
            least = min((e for e in range(65) if sum(v for k, v in sizes.items() if k >= e) * langs <= rows), default=64)
            if any(k < least for k in sizes):
                often = contexts.where(F.col("total") >= float(2**least)).select(F.col("lang").alias("__lang"), "context")
                level = level.join(often, (level["lang"] == F.col("__lang")) & (F.shiftrightunsigned(level["code"], 8) == F.col("context")), "left_semi")
        got = level.orderBy("lang", "code").toArrow()
        levels.append((np.array(got.column("lang").to_pylist(), object), got.column("code").to_numpy().view(np.uint64), got.column("n").to_numpy()))
    return Model(levels)


def identify(docs: DataFrame, model: Model, piece: int = 1 << 20) -> DataFrame:
    """(doc_id, lang_pred, score, bits) of each row of docs (doc_id, text).

    The shortest code wins, ties by name; score is the posterior of the winner under equal priors. A text that is null
    or has no letter (`½ ²` has none), and any text under a model without languages, is `und` with score 0. Whole texts are scored, in
    pieces of bounded size. Repeated rows give repeated results; other columns are ignored; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            offs, data = text_buffers(b.column(1))
            texts = b.column(1)
            size = np.diff(offs)
            bits = np.zeros((len(size), len(m.langs)))
            row = 0
            while row < len(size) and m.langs:
                end, room = row, piece
                while end < len(size) and (end == row or room >= size[end]):
                    room -= size[end]
                    end += 1
                bits[row:end] = m.bits(data, offs[row : end + 1])
                row = end
            best = bits.argmin(1) if m.langs else np.zeros(len(size), int)
            pred, score = [], []
            for k, t in enumerate(texts):
                s = t.as_py()
                if s is None or not m.langs or not has_letter(s):
                    pred.append("und")
                    score.append(0.0)
                else:
                    pred.append(m.langs[best[k]])
                    score.append(float(1 / np.exp2(np.maximum(bits[k, best[k]] - bits[k], -1000)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits.min(1) if m.langs else np.zeros(len(size)))], ["doc_id", "lang_pred", "score", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
