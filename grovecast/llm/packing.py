"""Sequence packing into length buckets whose bounds minimise padding.

Texts are cut into pieces of at most `budget` tokens, so lengths have a bound and so has their global histogram (one
partial aggregate). Dynamic programming over it finds the bucket bounds of least total padding exactly; the cost is
Monge, so each layer is solved by divide and conquer. Inside each bucket pieces are numbered and every `budget // bound`
of them form one batch. The numbering is distributed: pieces are counted by bucket and hash shard, shards get offsets
from a running sum over the counts alone, and rows are ranked inside their shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

BUDGET, BUCKETS, SHARD_ROWS = 8192, 16, 50000
#: a token: a run of letters, digits and underscores, or one other character that is not white space
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """(ascending bounds, padding) of at most `buckets` buckets; every length fits the first bound not below it.

    lengths are distinct and ascending. Exact; ties prefer the earlier cut.
    """
    n = len(lengths)
    if not n:
        return [], 0
    c = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    s = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.int64)])
    cost = lambda i, j: lengths[j - 1] * (c[j] - c[i]) - (s[j] - s[i])  # noqa: E731  lengths i to j - 1 in one bucket
    best = np.concatenate([[0], [cost(0, j) for j in range(1, n + 1)]]).astype(np.int64)
    cuts = []
    for _ in range(1, min(buckets, n)):
        nxt, cut = best.copy(), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            total = best[i] + cost(i, j)
            k = int(total.argmin())
            nxt[j], cut[j] = total[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        cuts.append(cut)
        best = nxt
    bounds, j = [], n
    for cut in [*reversed(cuts), None]:
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j]) if cut is not None else 0
    return bounds[::-1], int(best[n])


def counter(vocabulary: str | None):
    """Token counts of texts: by TOKEN, or by a public tokenizer's vocabulary file (tokenizers' JSON) at a given path."""
    if vocabulary is None:
        return None
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs with n_tokens (0 for null and empty texts)."""
    if vocabulary is None:
        return docs.withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long"))
    from pyspark.sql import types as T

    at = docs.columns.index("text")

    def run(batches):
        count = counter(vocabulary)
        for b in batches:
            n = count([x or "" for x in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))


def cut_texts(counted: DataFrame, budget: int, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, text) of the pieces of (doc_id, n_tokens, text): together they are the text.

    A piece begins at its first token, the first at the text's start. A text of more than one piece is counted again
    where it is cut, so that both agree.
    """

    def run(batches):
        import regex

        token = regex.compile(TOKEN)
        if vocabulary is not None:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(vocabulary)
        for b in batches:
            rows = []
            for d, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n <= budget:
                    rows.append((d, 0, 0, n, t))
                    continue
                starts = [m.start() for m in token.finditer(t)] if vocabulary is None else [a for a, _ in tok.encode(t, add_special_tokens=False).offsets]
                cuts = [0, *starts[budget::budget], len(t)]
                rows += [(d, k, k * budget, min(budget, len(starts) - k * budget), t[x:y]) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["doc_id", "piece", "start", "n_tokens", "text"])

    return counted.select("doc_id", "n_tokens", "text").mapInArrow(run, "doc_id long, piece long, start long, n_tokens long, text string")


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS, vocabulary: str | None = None, keep_text: bool = False) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, bound, batch, slot, padding[, text]): one row for each piece of each text.

    With keep_text the text of each piece comes too; the batch of a row is named by bucket and batch together. A piece has the tokens from start on, at most `budget` of them; a batch holds budget // bound pieces of its bucket,
    each padded to bound. Null and empty texts, and texts of white space only, have no pieces. Repeated rows are packed
    each. Pieces of a bucket are numbered by a hash shard of doc_id, piece and text, and inside a shard by length (longest
    first), doc_id and piece. A null doc_id is packed like any other. Other columns are ignored; an empty table gives an empty table.
    """
    counted = token_counts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), vocabulary).where("n_tokens > 0")
    key = F.xxhash64("text").alias("key")  # so that rows without a doc_id, or that share one, spread over the shards
    if keep_text:
        pieces = cut(cut_texts(counted, budget, vocabulary).select("doc_id", "piece", "start", "n_tokens", key, "text"))
    else:
        pieces = cut(counted.select("doc_id", "n_tokens", key)).select(
            "doc_id", "n_tokens", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {budget}"))).alias("piece")
        ).select("doc_id", "piece", "key", (F.col("piece") * budget).alias("start"), F.least(F.lit(budget), F.col("n_tokens") - F.col("piece") * budget).cast("long").alias("n_tokens"))
    more = ["text"] if keep_text else []
    # at most `budget` rows, since no piece is longer
    histogram = pieces.groupBy("n_tokens").count().orderBy("n_tokens").collect()
    bounds, _ = best_bounds(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), buckets)
    if not bounds:
        return pieces.select("doc_id", "piece", "start", "n_tokens", *(F.lit(None).cast(k).alias(c) for c, k in (("bucket", "int"), ("bound", "long"), ("batch", "long"), ("slot", "long"), ("padding", "long"))), *more)
    which = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        which = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(which)
    shards = max(1, sum(r[1] for r in histogram) // SHARD_ROWS + 1)
    shard = F.pmod(F.xxhash64("doc_id", "piece", "key"), F.lit(shards)).cast("int")
    placed = pieces.withColumn("bucket", which.cast("int")).withColumn("bound", F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1).cast("long")).withColumn("shard", shard)
    # buckets times shards rows
    sizes = placed.groupBy("bucket", "shard").count()
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.desc("n_tokens"), "doc_id", "piece", "key")) - 1
    numbered = placed.withColumn("rank", rank).join(offsets, ["bucket", "shard"]).withColumn("rank", F.col("rank") + F.col("before"))
    room = F.expr(f"{budget} div bound")
    return numbered.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "bound", F.expr(f"rank div ({budget} div bound)").alias("batch"), (F.col("rank") % room).alias("slot"), (F.col("bound") - F.col("n_tokens")).alias("padding"), *more
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
