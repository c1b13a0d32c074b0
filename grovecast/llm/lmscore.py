"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Tokens are runs of letters and digits (lower-cased) or of other characters; all of them are counted over all documents,
and the counts stay in a table. A network predicts each token from SIDE tokens on both sides: embeddings, a hidden
layer, and a two-level softmax (a group of ids, then the id in its group). The OWN most frequent tokens have ids of their
own, all others share RARE classes by hash; inside its class a token has its share of the counts, so that every token of
the corpus has a probability of its own, however rare. As neighbours, tokens have more rows than ids: their number
follows the number of distinct tokens. Counts of the CACHED most frequent tokens are sent to the tasks, those of all
others are joined to the tokens that need them.

Documents fall into shards by a hash of id and text and are read there in its order, so scores do not depend on how the
input is split. Every shard trains on all of its tokens; a first round over one document in PORTION gives a common start,
the second round takes all others, and after each the shards' weights are averaged by token count, in levels, so that no
task holds more than a bounded number of them. The sum of the conditional log-probabilities of all tokens scores a
document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_buffers
from .langid import Index
from .suffixdedup import Powers, prefix_sums, rolled

KINDS = 32  # ids in a group, and groups
IDS = KINDS * KINDS
RARE = 128  # ids that the infrequent tokens share
OWN = IDS - RARE
CACHED = 1 << 17
SIDE, WIDTH, HIDDEN = 2, 16, 24
PORTION = 8
SHARD_BYTES, MOST_SHARDS = 24 << 20, 1 << 16
BLOCK = 2 << 20
CHUNK = 8192
FAN = (4096, 64, 1)
LOG_UNIT = 1 << 20  # logarithms of counts are added as whole numbers of this fraction: any order gives one sum
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(t: np.ndarray, bounds: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every token of the texts between bounds."""
    if not len(t):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = _CLASS[t]
    new = np.ones(len(t), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[bounds[bounds < len(t)]] = True
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(t)]]).astype(np.int64)
    word = kind[first] > 0
    first, last = first[word], last[word]
    sums = prefix_sums(_LOWER[t], powers)
    return np.searchsorted(bounds, first, "right") - 1, rolled(sums, first, last - first, powers)


def blocks(b: pa.RecordBatch, at: int, powers: Powers):
    """(rows, document, hash) of the tokens of rows of bounded size together."""
    offs, data = text_buffers(b.column(at))
    size = np.diff(offs)
    row = 0
    while row < len(size):
        end, room = row, BLOCK
        while end < len(size) and (end == row or room >= size[end]):
            room -= size[end]
            end += 1
        yield slice(row, end), *tokens(data[offs[row] : offs[end]], offs[row : end + 1] - offs[row], powers)
        row = end


def rare_class(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(RARE)).astype(np.int64)


class Vocabulary:
    """The most frequent tokens by rank with their counts, the number of rows of neighbours, and the sums of the classes."""

    def __init__(self, ranked: np.ndarray, n: np.ndarray, types: int, sums: np.ndarray) -> None:
        self.index, self.n = Index(ranked), n
        self.rows = int(min(max(1024, 1 << int(types // 64).bit_length()), 1 << 14))
        self.told = self.rows - self.rows // 4  # rows of one token each
        self.log_sums = np.log(sums + 1.0)  # one more for what was never counted

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, row as a neighbour, rank or -1) of each token."""
        rank = self.index.find(h)
        ids = np.where((rank >= 0) & (rank < OWN), rank, OWN + rare_class(h)).astype(np.int32)
        shared = self.told + (h >> np.uint64(20)) % np.uint64(self.rows - self.told)
        return ids, np.where((rank >= 0) & (rank < self.told), rank, shared).astype(np.uint16), rank


def count(docs: DataFrame) -> DataFrame:
    """(token, n) of all tokens of all documents."""

    def run(batches):
        powers = Powers()
        for b in batches:
            hashes = [h for _, _, h in blocks(b, 0, powers)]
            key, n = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["token", "n"])

    return cut(docs.select(F.col("text").cast("string")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))


def vocabulary(counted: DataFrame) -> Vocabulary:
    """The CACHED most frequent tokens, ties by hash; all others are summed by class."""
    top = counted.orderBy(F.desc("n"), "token").limit(CACHED).toArrow()
    ranked = top.column("token").to_numpy().view(np.uint64)
    kind = F.pmod(F.shiftrightunsigned("token", 40), F.lit(RARE))
    sums = np.zeros(RARE)
    types = 0
    for r in counted.groupBy(kind.alias("kind")).agg(F.sum("n"), F.count("*")).collect():
        sums[r[0]], types = r[1], types + r[2]
    n = top.column("n").to_numpy()
    np.subtract.at(sums, rare_class(ranked[:OWN]), n[:OWN])
    return Vocabulary(ranked, n, types, sums)


def windows(doc: np.ndarray, rows: np.ndarray, none: int) -> np.ndarray:
    """The rows of SIDE tokens before and after each token; none beyond its document."""
    n = len(rows)
    out = np.full((n, 2 * SIDE), none, np.uint16)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -d), min(n, n - d)
        if b > a:
            out[a:b, k] = np.where(doc[a:b] == doc[a + d : b + d], rows[a + d : b + d], none)
    return out


class Net:
    """Weights in one array; e has a row for each kind of neighbour and one for none."""

    def __init__(self, rows: int, flat: np.ndarray | None = None) -> None:
        self.rows, self.rooms = rows, {}
        shapes = {"w": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "g": (HIDDEN, KINDS), "gb": (KINDS,), "i": (KINDS, HIDDEN, KINDS), "ib": (KINDS, KINDS), "e": (rows + 1, WIDTH)}
        sizes = [int(np.prod(s)) for s in shapes.values()]
        self.dense = sum(sizes[:-1])
        fresh = flat is None
        self.flat = np.zeros(sum(sizes), np.float32) if fresh else flat
        if len(self.flat) != sum(sizes):
            raise ValueError("the weights are not those of this vocabulary")
        for name, shape, part in zip(shapes, shapes.values(), np.split(self.flat, np.cumsum(sizes)[:-1]), strict=True):
            setattr(self, name, part.reshape(shape))
        if fresh:
            rng = np.random.default_rng(5)
            self.e[:] = rng.normal(0, 0.3, self.e.shape)
            self.w[:] = rng.normal(0, (2 * SIDE * WIDTH) ** -0.5, self.w.shape)
            self.g[:] = rng.normal(0, 0.1, self.g.shape)
            self.i[:] = rng.normal(0, 0.1, self.i.shape)

    def room(self, name: str, n: int, *shape: int) -> np.ndarray:
        """Working space of a name, kept from call to call: fresh pages cost more than the arithmetic."""
        had = self.rooms.get(name)
        if had is None or len(had) < n:
            had = self.rooms[name] = np.empty((n, *shape), self.flat.dtype)
        return had[:n]

    def run(self, around: np.ndarray, ids: np.ndarray, grads: Net | None = None) -> np.ndarray:
        """Log-probability of each id, given the rows around it.

        With grads, the gradient of the mean negative log-probability is put there, that of the embeddings as
        grads.touched (rows) and grads.moves (their gradients).
        """
        n = len(ids)
        by = np.argsort((ids // KINDS).astype(np.uint8), kind="stable")  # in order of groups, so that a group is a slice
        around, ids = around[by], ids[by]
        group, inner, at = ids // KINDS, ids % KINDS, np.arange(n)
        cuts = np.searchsorted(group, np.arange(KINDS + 1))
        live = [(k, slice(cuts[k], cuts[k + 1])) for k in range(KINDS) if cuts[k] < cuts[k + 1]]
        x = self.e.take(around, axis=0, mode="clip", out=self.room("x", n, 2 * SIDE, WIDTH)).reshape(n, -1)
        h = np.matmul(x, self.w, out=self.room("h", n, HIDDEN))
        h += self.b
        np.tanh(h, out=h)
        z = np.matmul(h, self.g, out=self.room("z", n, KINDS))
        z += self.gb
        y = self.ib.take(group, axis=0, mode="clip", out=self.room("y", n, KINDS))
        for k, s in live:
            y[s] += h[s] @ self.i[k]
        logs = np.zeros(n, self.flat.dtype)
        for scores, pick in ((z, group), (y, inner)):
            if max(scores.max(initial=0), -scores.min(initial=0)) > 60:  # else exponentials and their sums stay in range
                scores -= scores.max(1, keepdims=True)
            logs += scores[at, pick]
            np.exp(scores, out=scores)
            total = scores.sum(1)
            logs -= np.log(total)
            if grads is not None:
                scores *= (1 / (total * n))[:, None]
                scores[at, pick] -= scores.dtype.type(1 / n)
        if grads is not None:
            grads.g[:] = h.T @ z
            grads.gb[:] = z.sum(0)
            dh = np.matmul(z, self.g.T, out=self.room("dh", n, HIDDEN))
            grads.i[:] = 0
            grads.ib[:] = 0
            grads.ib[[k for k, _ in live]] = np.add.reduceat(y, [s.start for _, s in live], 0)
            for k, s in live:
                grads.i[k] = h[s].T @ y[s]
                dh[s] += y[s] @ self.i[k].T
            np.multiply(h, h, out=h)
            np.subtract(1, h, out=h)
            dh *= h
            grads.w[:] = x.T @ dh
            grads.b[:] = dh.sum(0)
            dx = np.matmul(dh, self.w.T, out=self.room("dx", n, 2 * SIDE * WIDTH)).reshape(-1, WIDTH)
            flat = around.ravel()
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            first = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1])
            sorted_ = dx.take(order, axis=0, mode="clip", out=self.room("sorted", len(order), WIDTH))
            grads.touched, grads.moves = flat[first], np.add.reduceat(sorted_, first, 0)
        out = np.empty_like(logs)
        out[by] = logs
        return out


class Trainer:
    """Adagrad over mini-batches; without a state to go on from they grow after the first steps. Only touched embeddings move.

    The state is the weights, then the sums of squared gradients.
    """

    def __init__(self, rows: int, state: np.ndarray, rate: float = 0.08) -> None:
        size = len(Net(rows).flat)
        self.state, warm = np.full(2 * size, 1e-6, np.float32), len(state) > size
        self.state[: len(state)] = state
        net = self.net = Net(rows, self.state[:size])
        self.grads, self.rate = Net(rows, np.zeros(size, np.float32)), rate
        self.seen, self.seen_e = self.state[size : size + net.dense], self.state[size + net.dense :].reshape(net.e.shape)
        self.steps, self.tokens = 400 if warm else 0, 0
        if warm:
            self.state[size:] *= 0.1
        self.rng = np.random.default_rng(9)

    def train(self, around: np.ndarray, ids: np.ndarray) -> None:
        order = self.rng.permutation(len(ids))
        at, net, grads = 0, self.net, self.grads
        while at < len(order):
            n = 256 if self.steps < 200 else 1024 if self.steps < 600 else 4096
            r = order[at : at + n]
            at += n
            net.run(around[r], ids[r], grads)
            g = grads.flat[: net.dense]
            self.seen += g * g
            net.flat[: net.dense] -= self.rate * g / np.sqrt(self.seen)
            rows, g = grads.touched, grads.moves
            seen = self.seen_e[rows] + g * g
            self.seen_e[rows] = seen
            net.e[rows] -= self.rate * g / np.sqrt(seen)
            self.steps += 1
        self.tokens += len(ids)


def train(docs: DataFrame, words: Vocabulary) -> np.ndarray:
    """Weights averaged over the shards; every token of every document is trained on once.

    The second round goes on from the averages of the first one's weights and of its sums of squared gradients.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h")).where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    state = Net(words.rows).flat
    weights = len(state)
    first = F.pmod(F.shiftrightunsigned("h", 32), F.lit(PORTION)) == 0
    for mine, share in ((first, size / PORTION), (~first, size)):
        shards = int(min(max(1, -(-share // SHARD_BYTES)), MOST_SHARDS))
        sent = spark.sparkContext.broadcast((words, state))
        keep = weights if mine is not first else 2 * weights

        def run(batches, sent=sent, keep=keep):
            words, state = sent.value
            powers, shard, trainer = Powers(), None, None

            def done():
                w = trainer.state[:keep]
                part = [w[a : a + CHUNK] for a in range(0, len(w), CHUNK)]
                return pa.RecordBatch.from_arrays(
                    [pa.array(range(len(part)), pa.int32()), pa.array([shard] * len(part), pa.int32()), pa.array([float(trainer.tokens)] * len(part)), pa.array([p.astype("<f4").tobytes() for p in part], pa.binary())],
                    ["chunk", "shard", "tokens", "means"],
                )

            for b in batches:
                of = b.column(1).to_numpy()
                edges = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]) if len(of) else [0]
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    if of[x] != shard:
                        if trainer is not None and trainer.tokens:
                            yield done()
                        shard, trainer = int(of[x]), Trainer(words.rows, state)
                    for _, doc, h in blocks(b.slice(x, y - x), 0, powers):
                        if len(h):
                            ids, rows, _ = words.ids(h)
                            trainer.train(windows(doc, rows, words.rows), ids)
            if trainer is not None and trainer.tokens:
                yield done()

        def add(group):
            group = group.sort_by("shard")
            n = group.column("tokens").to_pylist()
            means = sum(np.frombuffer(x, "<f4").astype(float) * (k / sum(n)) for x, k in zip(group.column("means").to_pylist(), n, strict=True))
            return pa.table([group.column("chunk").slice(0, 1), group.column("shard").slice(0, 1), pa.array([sum(n)]), pa.array([means.astype("<f4").tobytes()], pa.binary())], ["chunk", "shard", "tokens", "means"])

        kind = "chunk int, shard int, tokens double, means binary"
        placed = texts.where(mine).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
        parts = placed.repartitionById(shards, "shard").sortWithinPartitions("shard", "h", "text").select("text", "shard").mapInArrow(run, kind)
        for fan in [f for f in FAN if f < shards or f == 1]:
            parts = parts.withColumn("shard", F.pmod("shard", F.lit(fan))).groupBy("chunk", "shard").applyInArrow(add, kind)
        rows = sorted(parts.collect(), key=lambda r: r.chunk)  # as many as the network has chunks
        if rows:
            state = np.concatenate([np.frombuffer(r.means, "<f4") for r in rows]).astype(np.float32)
    return state[:weights]


class Model:
    def __init__(self, counted: DataFrame, words: Vocabulary, flat: np.ndarray) -> None:
        self.counted, self.words, self.flat = counted, words, flat


def fit(docs: DataFrame) -> Model:
    """Counts and weights of docs (doc_id, text, any other columns)."""
    counted = count(docs)
    words = vocabulary(counted)
    return Model(counted, words, train(docs, words))


def score(docs: DataFrame, model: Model, rows: int = 4096) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of each row of docs (doc_id, text).

    log_prob sums the natural logarithms over all tokens of the whole text; a null text, or one without tokens, has 0
    tokens, log_prob 0 and no mean. A token that the model never counted has the share of one occurrence. Repeated rows
    give repeated results; other columns are ignored; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.words, model.flat))

    def run(batches):
        words, flat = sent.value
        net, powers = Net(words.rows, flat), Powers()
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            rare: list = [np.zeros(0, np.int64)] * b.num_rows
            for at, doc, h in blocks(b, 1, powers):
                m = at.stop - at.start
                if not len(h):
                    continue
                ids, own, rank = words.ids(h)
                around = windows(doc, own, words.rows)
                lp = np.concatenate([net.run(around[a : a + rows], ids[a : a + rows]) for a in range(0, len(ids), rows)]).astype(float)
                classed = ids >= OWN
                lp[classed] -= words.log_sums[ids[classed] - OWN]
                cached = classed & (rank >= 0)
                lp[cached] += np.log(words.n[rank[cached]])
                n[at], total[at] = np.bincount(doc, minlength=m), np.bincount(doc, lp, m)
                other = np.flatnonzero(rank < 0)
                cuts = np.searchsorted(doc[other], np.arange(m + 1))
                left = h[other].view(np.int64)
                rare[at] = [left[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare])]), pa.int32()), pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total), lists], ["doc_id", "n_tokens", "part", "rare"])

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, part double, rare array<long>")
    parts = cut(parts).withColumn("row", F.monotonically_increasing_id())  # over files that are written, so the same in every attempt
    logs = F.round(F.log(F.coalesce("n", F.lit(1)).cast("double")) * LOG_UNIT).cast("long")
    more = parts.select("row", F.explode("rare").alias("token")).join(model.counted, "token", "left").groupBy("row").agg(F.sum(logs).alias("more"))
    whole = F.col("part") + F.coalesce(F.col("more") / LOG_UNIT, F.lit(0.0))
    out = parts.select("row", "doc_id", "n_tokens", "part").join(more, "row", "left").select("doc_id", "n_tokens", whole.alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def op2_lmscore(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
