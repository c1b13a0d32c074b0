"""Quality classifier by co-training of a text view and a page view.

The text view sees hashed tokens (and their first bytes) of the whole text; the page view sees size, layout, language
and source, but no token. Two logistic models are fitted on labelled documents. In each round both score all unlabelled documents of the table, and each adds to the other's
training set GROW documents a class, by the least hashes of id and text among all that it is sure of. One part of the
labelled documents fits the views, a second calibrates each, a third fits the combination of the calibrated views; then
all documents are scored in one pass. The same is done for each label column; a document is kept if it is likely good and
not likely toxic.

The features of the texts are kept for the rounds in a written table, so texts are read once by fitting and once by
scoring. Only the labelled documents of fitting are bounded: LABELLED, those with the least hashes of their ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_buffers
from .suffixdedup import Powers, prefix_sums, rolled

LABELLED = 12000
BITS = 15
ROUNDS, GROW = 3, 400
BLOCK = 2 << 20
_CLASS = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits and all bytes of longer characters, 2 others
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SCALE = 3.0
SURE = 0.95
SIZE = 1 << BITS  # features of the text view


def _sums(flags: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (c[stops] - c[starts]).astype(float)


def look(t: np.ndarray, bounds: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, weight) of the distinct tokens and prefixes of each document, and its layout numbers.

    t has the bytes of the texts one after the other, bounds (n + 1) where they begin and end.
    """
    n = len(bounds) - 1
    starts, stops = bounds[:-1], bounds[1:]
    kind = _CLASS[t]
    new = np.ones(len(t), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[bounds[bounds < len(t)]] = True
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(t)]]).astype(np.int64)
    word = kind[first] > 0
    first, last, wordy = first[word], last[word], kind[first][word] == 1
    doc = np.searchsorted(bounds, first, "right") - 1
    low = _LOWER[t]
    sums = prefix_sums(low, powers)
    if len(first):
        whole = rolled(sums, first, last - first, powers)
        short = rolled(sums, first, np.minimum(last - first, 6), powers)
    else:
        whole = short = np.zeros(0, np.uint64)
    size = np.uint64(64 - BITS)
    feature = np.concatenate([whole >> size, (short * np.uint64(0x9E3779B97F4A7C15)) >> size]).astype(np.int32)
    length = np.maximum(stops - starts, 1)
    lines = _sums(t == 10, starts, stops) + 1
    tokens = np.maximum(np.bincount(doc, minlength=n), 1)
    words = np.maximum(np.bincount(doc[wordy], minlength=n), 1)
    by = np.lexsort((whole, doc))
    d, h = doc[by], whole[by]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    # lines that repeat an earlier one of their document
    ends = np.flatnonzero(t == 10)
    cut = np.unique(np.concatenate([starts[stops > starts], ends + 1]))
    cut = cut[cut < len(t)]
    line_doc = np.searchsorted(bounds, cut, "right") - 1
    line_end = np.minimum(np.concatenate([cut[1:], [len(t)]]), stops[line_doc]) if len(cut) else cut
    lh = rolled(sums, cut, line_end - cut, powers) if len(cut) else np.zeros(0, np.uint64)
    by = np.lexsort((lh, line_doc))
    ld, lh = line_doc[by], lh[by]
    same = np.zeros(len(ld), bool)
    same[1:] = (ld[1:] == ld[:-1]) & (lh[1:] == lh[:-1])
    page = np.stack(
        [
            np.log1p(stops - starts),
            np.log1p(lines),
            np.log1p(length / lines),
            _sums((t >= 65) & (t < 91), starts, stops) / length,
            _sums((t >= 48) & (t < 58), starts, stops) / length,
            _sums(kind == 2, starts, stops) / length,
            _sums(np.isin(t, np.frombuffer(b"#*$%&|<>", np.uint8)), starts, stops) / length,
            _sums(kind == 0, starts, stops) / length,
            _sums(t >= 128, starts, stops) / length,
            length / tokens / 10,
            words / tokens,
            np.bincount(d[fresh], minlength=n) / tokens,
            np.bincount(ld[same], minlength=n) / lines,
            _sums(t == 33, starts, stops) / length,
        ],
        axis=1,
    )
    key, count = np.unique(np.concatenate([doc, doc]).astype(np.int64) << BITS | feature, return_counts=True)
    of = key >> BITS
    return of, (key & ((1 << BITS) - 1)).astype(np.int32), (np.sqrt(count / tokens[of]) * SCALE).astype(np.float32), page


def _named(values: list, buckets: int) -> np.ndarray:
    known = {v: zlib.crc32(str(v).encode()) % buckets for v in set(values)}
    return np.array([known[v] for v in values], np.int64)


LANGS, SOURCES = 16, 64


def described(page: np.ndarray, lang: list, source: list) -> np.ndarray:
    """The layout numbers with the hashes of language and source."""
    return np.concatenate([page, _named(lang, LANGS)[:, None], _named(source, SOURCES)[:, None]], axis=1)


class Pages:
    """The page view's matrix: layout numbers and their quantile bins over the rows of fitting, language and source by hash."""

    def __init__(self, rows: np.ndarray, bins: int = 8) -> None:
        page = rows[:, :-2]
        self.edges = [np.unique(np.quantile(page[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(page.shape[1])]
        self.mean, self.dev = page.mean(0), page.std(0) + 1e-6

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        page = rows[:, :-2]
        z = np.clip((page - self.mean) / self.dev, -5, 5)
        parts = [z, z * z / 5]
        parts += [np.eye(len(e) + 1)[np.searchsorted(e, page[:, c], "right")] for c, e in enumerate(self.edges)]
        parts += [np.eye(LANGS)[rows[:, -2].astype(int)], np.eye(SOURCES)[rows[:, -1].astype(int)]]
        return np.concatenate(parts, axis=1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Sparse:
    """Rows of token weights, in compressed form, in blocks of PART rows: the mini-batches of fitting."""

    PART = 250

    def __init__(self) -> None:
        self.n, self.parts, self.open = 0, [], []

    def add(self, col: np.ndarray, val: np.ndarray) -> None:
        self.open.append((col, val))
        self.n += 1
        if len(self.open) == self.PART:
            self.close()

    def close(self) -> None:
        if self.open:
            size = np.array([len(c) for c, _ in self.open])
            self.parts.append((size, np.concatenate([c for c, _ in self.open]), np.concatenate([v for _, v in self.open])))
            self.open = []

    def dot(self, w: np.ndarray) -> np.ndarray:
        self.close()
        out, at = np.zeros(self.n), 0
        for size, col, val in self.parts:
            out[at : at + len(size)] = np.bincount(np.repeat(np.arange(len(size)), size), w[col] * val, len(size))
            at += len(size)
        return out

    def fit(self, y: np.ndarray, weight: np.ndarray, ridge: float, epochs: int, start: np.ndarray | None) -> np.ndarray:
        """Logistic weights and a last bias, by Adam over the blocks; blocks without weight are passed over."""
        self.close()
        w = np.zeros(SIZE + 1) if start is None else start.copy()
        m, v, k = np.zeros_like(w), np.zeros_like(w), 0
        mean = weight.sum() / max(1, (weight > 0).sum())
        for epoch in range(epochs):
            at, rate = 0, 0.04 / (1 + 0.2 * epoch)
            for size, col, val in self.parts:
                rows = slice(at, at + len(size))
                at += len(size)
                live = weight[rows]
                if not live.any():
                    continue
                row = np.repeat(np.arange(len(size)), size)
                z = np.bincount(row, w[col] * val, len(size)) + w[-1]
                e = (sigmoid(z) - y[rows]) * live / (mean * len(size))
                g = np.append(np.bincount(col, e[row] * val, SIZE) + ridge * w[:-1], e.sum())
                k += 1
                m = 0.9 * m + 0.1 * g
                v = 0.99 * v + 0.01 * g * g
                w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        return w


class Dense:
    def __init__(self, x: np.ndarray) -> None:
        self.x = x

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, g: np.ndarray) -> np.ndarray:
        return self.x.T @ g


def logistic(x, y: np.ndarray, weight: np.ndarray, size: int, ridge: float, steps: int = 120, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and a last bias, by full gradients with Adam."""
    w = np.zeros(size + 1) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = max(weight.sum(), 1e-9)
    for k in range(1, steps + 1):
        e = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) * weight / total
        g = np.append(x.back(e) + ridge * w[:-1], e.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same say."""
    p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    return np.where(y > 0.5, 0.5 / p, 0.5 / (1 - p))


VIEWS = ("text", "page")


class Head:
    """Both views' models of one label, their calibration and their combination."""

    def __init__(self, y: np.ndarray, part: np.ndarray) -> None:
        """y: the labels of the labelled rows, NaN where this one is missing; part: 0 fits, 1 calibrates, 2 combines."""
        self.y, self.part = y, part
        known = ~np.isnan(y)
        self.constant = any(len(set(y[known & (part == k)])) < 2 for k in range(3))
        if self.constant:  # one class only, or too few labels
            p = float(np.clip(np.nanmean(y), 0.02, 0.98)) if known.any() else 0.5
            self.mix = np.array([0.0, 0.0, np.log(p / (1 - p))])
        self.told = {v: {} for v in VIEWS}  # pseudo-labels by row, for each view
        self.w: dict[str, np.ndarray | None] = dict.fromkeys(VIEWS)

    def fit(self, xs: dict, rows: int) -> None:
        """Both views, on the labelled rows of part 0 and on the rows that the other view has labelled."""
        if self.constant:
            return
        n = len(self.y)
        train = ~np.isnan(self.y) & (self.part == 0)
        for name in VIEWS:
            target = np.full(rows, np.nan)
            target[:n][train] = self.y[train]
            for row, value in self.told[name].items():
                target[row] = value
            use = ~np.isnan(target)
            weight = np.zeros(rows)
            weight[use] = balanced(target[use]) * np.where(np.flatnonzero(use) < n, 1.0, 0.3)
            first = self.w[name] is None
            batches = -(-rows // Sparse.PART)
            if name == "text":
                self.w[name] = xs[name].fit(np.nan_to_num(target), weight, 3e-6, max(16, 800 // batches) if first else max(6, 200 // batches), self.w[name])
            else:
                self.w[name] = logistic(xs[name], np.nan_to_num(target), weight, xs[name].x.shape[1], 1e-3, 150 if first else 60, self.w[name])

    def raw(self, xs: dict, rows: int) -> np.ndarray:
        return np.stack([xs[v].dot(self.w[v][:-1])[:rows] + self.w[v][-1] for v in VIEWS], axis=1)

    def settle(self, xs: dict) -> None:
        """Platt's calibration of each view on part 1, the combination on part 2."""
        if self.constant:
            return
        n = len(self.y)
        z = self.raw(xs, n)
        known = ~np.isnan(self.y)
        first, second = known & (self.part == 1), known & (self.part == 2)
        calm = 0.3 / first.sum()  # few labels must not make a view too sure
        self.scale = [logistic(Dense(z[first][:, [c]] / 5), self.y[first], np.ones(first.sum()), 1, calm, 300) for c in range(2)]
        both = self.calibrated(z[second])
        self.mix = logistic(Dense(both), self.y[second], np.ones(len(both)), 2, 0.3 / len(both), 300)
        del self.y, self.part, self.told

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return np.stack([np.clip(z[:, c] / 5 * self.scale[c][0] + self.scale[c][1], -12, 12) for c in range(2)], axis=1)

    def scores(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, page view, combined) probabilities."""
        if self.constant:
            p = np.full(len(z), sigmoid(self.mix[-1]))
            return p, p, p
        both = self.calibrated(z)
        return sigmoid(both[:, 0]), sigmoid(both[:, 1]), sigmoid(both @ self.mix[:-1] + self.mix[-1])

    def sums(self, doc: np.ndarray, col: np.ndarray, val: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Both views' sums of documents given by their tokens and the rows of the page view's matrix."""
        if self.constant:
            return np.zeros((len(page), 2))
        return np.stack([np.bincount(doc, self.w["text"][col] * val, len(page)) + self.w["text"][-1], page @ self.w["page"][:-1] + self.w["page"][-1]], axis=1)


def batches_of(b: pa.RecordBatch, at: int, powers: Powers):
    """(row slice, documents, features, weights, layout numbers) in blocks of bounded size."""
    offs, data = text_buffers(b.column(at))
    size = np.diff(offs)
    row = 0
    while row < len(size):
        end, room = row, BLOCK
        while end < len(size) and (end == row or room >= size[end]):
            room -= size[end]
            end += 1
        t = data[offs[row] : offs[end]]
        yield (slice(row, end), *look(t, offs[row : end + 1] - offs[row], powers))
        row = end


FEATURES = "key long, doc_id long, quality double, toxic double, col binary, val binary, page array<double>"
_META = ("lang", "source")


def _meta(docs: DataFrame) -> list:
    """Language and source; null where docs have no such column."""
    return [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in _META]


def features(docs: DataFrame) -> DataFrame:
    """FEATURES of (doc_id, text, lang, source, quality, toxic); key is a hash of id and text."""

    def run(batches):
        powers = Powers()
        for b in batches:
            lang, source = (b.column(c).to_pylist() for c in (3, 4))
            for rows, doc, col, val, page in batches_of(b, 2, powers):
                page = described(page, lang[rows], source[rows])
                n = rows.stop - rows.start
                cuts = np.searchsorted(doc, np.arange(n + 1))
                col, val = col.astype("<u2"), val.astype("<f2")
                pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(rows.start, n) for c in (0, 1, 5, 6)), pa.array([col[x:y].tobytes() for x, y in pieces], pa.binary()), pa.array([val[x:y].tobytes() for x, y in pieces], pa.binary()), pa.array(list(page), pa.list_(pa.float64()))],
                    ["key", "doc_id", "quality", "toxic", "col", "val", "page"],
                )

    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text", *_META, "quality", "toxic").mapInArrow(run, FEATURES)


def sure_rows(kept: DataFrame, pages: Pages, heads: list[Head]) -> DataFrame:
    """(key, doc_id, sure): of all rows of features, those that a view is sure of; bit 4 * head + 2 * view + class."""
    sent = kept.sparkSession.sparkContext.broadcast((pages, heads))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.frombuffer(x, "<u2") for x in b.column(2).to_pylist()]
            vals = np.concatenate([np.frombuffer(x, "<f2") for x in b.column(3).to_pylist()]).astype(np.float32)
            doc = np.repeat(np.arange(b.num_rows), [len(x) for x in cols])
            pages, heads = sent.value
            col, page = np.concatenate(cols), pages.matrix(np.array(b.column(4).to_pylist()))
            bits = np.zeros(b.num_rows, np.int32)
            for k, head in enumerate(heads):
                if head.constant:
                    continue
                p = sigmoid(head.sums(doc, col, vals, page))
                for v in range(2):
                    bits |= (p[:, v] < 1 - SURE).astype(np.int32) << 4 * k + 2 * v | (p[:, v] > SURE).astype(np.int32) << 4 * k + 2 * v + 1
            some = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some)), pa.array(bits[some])], ["key", "doc_id", "sure"])

    return kept.select("key", "doc_id", "col", "val", "page").mapInArrow(run, "key long, doc_id long, sure int")


class Model:
    def __init__(self, pages: Pages | None, heads: dict[str, Head]) -> None:
        self.pages, self.heads = pages, heads


def _read(rows: DataFrame, text: Sparse, page: list) -> list:
    """Adds feature rows to the driver's views; a bounded number."""
    out = []
    for r in rows.orderBy("doc_id", "key").toLocalIterator():
        text.add(np.frombuffer(r.col, "<u2").astype(np.int32), np.frombuffer(r.val, "<f2").astype(np.float32))
        page.append(list(r.page))
        out.append(r)
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, grow: int = GROW) -> Model:
    """Fit on documents (doc_id, text, lang, source) and labels (doc_id, quality, toxic); nulls in labels are unlabelled."""
    told = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double"), F.col("toxic").cast("double")).where("doc_id is not null")
    told = told.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality is not null or toxic is not null")
    ids = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    yes = ids.join(told, "doc_id").orderBy(F.xxhash64(F.lit(11), "doc_id")).limit(labelled)
    none = [F.lit(None).cast("double").alias(c) for c in ("quality", "toxic")]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_meta(docs))
    text, page = Sparse(), []
    known = _read(features(texts.join(F.broadcast(yes), "doc_id")), text, page)
    if not known:
        return Model(None, {})
    part = np.array([(0, 0, 0, 0, 1, 2)[(r.doc_id * 2654435761 >> 7) % 6] for r in known])
    pages = Pages(np.array(page))
    heads = {name: Head(np.array([np.nan if r[name] is None else float(r[name] > 0) for r in known]), part) for name in ("quality", "toxic")}
    at = {}  # rows of the views by key, of unlabelled documents
    kept = None
    for r in range(rounds + 1):
        xs = {"text": text, "page": Dense(pages.matrix(np.array(page)))}
        for head in heads.values():
            head.fit(xs, len(page))
        live = [h for h in heads.values() if not h.constant]
        if r == rounds or not live:
            break
        if kept is None:
            kept = cut(features(texts.where("doc_id is not null").select("*", *none)))
        # only ids travel here; rows that have a label are none to be guessed
        sure = cut(sure_rows(kept, pages, live).join(told.select("doc_id"), "doc_id", "left_anti"))
        picks = {}
        for k, head in enumerate(live):
            for v, other in ((0, "page"), (1, "text")):
                had = [key for key, row in at.items() if row in head.told[other]]
                for value in (0, 1):
                    bit = 1 << 4 * k + 2 * v + value
                    best = sure.where(F.col("sure").bitwiseAND(F.lit(bit)) > 0).select("key").distinct().orderBy(F.xxhash64(F.lit(5), "key"), "key").limit(grow + len(had))
                    for key in [x.key for x in best.collect() if x.key not in set(had)][:grow]:
                        picks.setdefault(key, []).append((head, other, float(value)))
        new = kept.sparkSession.createDataFrame([(key,) for key in picks if key not in at], "key long")
        for row in _read(kept.join(F.broadcast(new), "key").dropDuplicates(["key"]), text, page) if picks else ():
            at[row.key] = len(known) + len(at)
        for key, said in picks.items():
            for head, other, value in said:
                head.told[other].setdefault(at[key], value)
    for head in heads.values():
        head.settle(xs)
    return Model(pages, heads)


SCORES = "score double, text_score double, page_score double, toxic_score double, kept boolean"


def judged(b: pa.RecordBatch, at: dict[str, int], model: Model, powers: Powers, least: float, most_toxic: float) -> list[np.ndarray]:
    n = b.num_rows
    out = [np.full(n, 0.5), np.full(n, 0.5), np.full(n, 0.5), np.zeros(n), np.ones(n, bool)]
    if not model.heads:
        return out
    lang, source = (b.column(at[c]).to_pylist() if c in at else [None] * n for c in _META)
    for rows, doc, col, val, page in batches_of(b, at["text"], powers):
        matrix = model.pages.matrix(described(page, lang[rows], source[rows]))
        for name, head in model.heads.items():
            t, p, both = head.scores(head.sums(doc, col, val, matrix))
            if name == "quality":
                out[0][rows], out[1][rows], out[2][rows] = both, t, p
            else:
                out[3][rows] = both
    out[4] = (out[0] >= least) & (out[3] <= most_toxic)
    return out


def score(docs: DataFrame, model: Model, least: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """doc_id and SCORES for each row of docs (doc_id, text, lang, source); kept is False for what is to be rejected.

    A null or empty text is scored as an empty page. Without labels every score is 0.5 and all is kept. Repeated rows
    give repeated results, other columns are ignored, an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        powers = Powers()
        for b in batches:
            cols = judged(b, {"text": 1, "lang": 2, "source": 3}, sent.value, powers, least, most_toxic)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], ["doc_id", "score", "text_score", "page_score", "toxic_score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_meta(docs)).mapInArrow(run, "doc_id long, " + SCORES)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that the model does not reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = {c: docs.columns.index(c) for c in ("text", *_META) if c in docs.columns}

    def run(batches):
        powers = Powers()
        for b in batches:
            yield b.filter(pa.array(judged(b, at, sent.value, powers, least, most_toxic)[4]))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
