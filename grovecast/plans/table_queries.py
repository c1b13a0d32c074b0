"""Queries over samples, points and forests, and their SQL (recursive where a forest is rebuilt)."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..operators import distance, forest, sampling, summary
from ..operators.forest_kernel import damp, log_normalizer, seen, unseen

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEED, TREES, SIZE = 42, 5, 32


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# samples ------------------------------------------------------------------------------------------------------------
L_SQL = "(SELECT event_id AS seq, user_id AS series, value AS x, abs(value) + 0.5 AS w FROM events)"


def L(spark, sf):
    return read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("series"), F.col("value").alias("x"), (F.abs("value") + 0.5).alias("w"))


def key_sql(tree, decay, weight="1"):
    return f"(-{decay} * seq + ln(-ln({uniform_sql('seq', tree, '1', str(SEED))}) / ({weight})))"


def topk_sql(decay, weight="1", size=SIZE, source=L_SQL, trees=TREES):
    return f"(SELECT seq, series, x, w, tree, {key_sql('tree', decay, weight)} AS key FROM {source}, (SELECT unnest(range(0, {trees})) AS tree) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY key, seq) <= {size})"


OUT = "SELECT tree::BIGINT AS tree, seq, round(key, 6) AS key FROM "


def out(df):
    return df.select(F.col("tree").cast("long").alias("tree"), "seq", F.round("key", 6).alias("key"))


query("reservoir_keys", f"SELECT tree::BIGINT AS tree, seq, round({key_sql('tree', 0.001, 'w')}, 6) AS key FROM {L_SQL}, (SELECT unnest(range(0, 2)) AS tree)")(lambda s, sf: out(sampling.keyed(L(s, sf), 2, 0.001, "w", SEED)))
query("reservoir_topk", OUT + topk_sql(0.001, "w"))(lambda s, sf: out(sampling.reservoir(L(s, sf), TREES, SIZE, 0.001, "w", SEED)))
query("reservoir_uniform", OUT + topk_sql(0))(lambda s, sf: out(sampling.reservoir(L(s, sf), TREES, SIZE, 0.0, None, SEED)))
query("reservoir_evicted", OUT + topk_sql(0, size=SIZE - 1))(lambda s, sf: out(sampling.least(sampling.reservoir(L(s, sf), TREES, SIZE, 0.0, None, SEED), SIZE - 1, ["tree"])))
query(
    "reservoir_by_series",
    f"SELECT series, tree::BIGINT AS tree, seq, round(key, 6) AS key FROM (SELECT *, {key_sql('tree', 0.01)} AS key FROM {L_SQL}, (SELECT unnest(range(0, 2)) AS tree)) QUALIFY row_number() OVER (PARTITION BY series, tree ORDER BY key, seq) <= 8",
)(lambda s, sf: sampling.reservoir(L(s, sf), 2, 8, 0.01, None, SEED, by=["series"]).select("series", F.col("tree").cast("long").alias("tree"), "seq", F.round("key", 6).alias("key")))
query(
    "sampler_merge",
    OUT + topk_sql(0.001),
)(lambda s, sf: out(sampling.merge(sampling.reservoir(L(s, sf).where("seq % 3 = 0"), TREES, SIZE, 0.001, None, SEED), sampling.reservoir(L(s, sf).where("seq % 3 <> 0"), TREES, SIZE, 0.001, None, SEED), SIZE, ["tree"])))
query("sampler_rebase", f"SELECT tree::BIGINT AS tree, seq, round(key - 0.001 * 500, 6) AS key FROM {topk_sql(0.001)}")(lambda s, sf: out(sampling.rebased(sampling.reservoir(L(s, sf), TREES, SIZE, 0.001, None, SEED), 0.001, 100, 600)))
query(
    "reservoir_decay_change",
    f"SELECT series, seq, round(-e + ln(-ln({uniform_sql('seq', '0', '1', str(SEED))})), 6) AS key FROM (SELECT *, sum(CASE WHEN seq % 5 = 0 THEN 0.01 ELSE 0.001 END) OVER (PARTITION BY series ORDER BY seq) AS e FROM {L_SQL}) QUALIFY row_number() OVER (PARTITION BY series ORDER BY -e + ln(-ln({uniform_sql('seq', '0', '1', str(SEED))})), seq) <= 8",
)(
    lambda s, sf: sampling.least(
        sampling.elapsed_decay(L(s, sf).withColumn("d", F.when(F.col("seq") % 5 == 0, 0.01).otherwise(0.001)), "d", ["series"]).withColumn("key", sampling.sample_key(F.col("seq"), 0, seed=SEED, elapsed=F.col("elapsed"))), 8, ["series"]
    ).select("series", "seq", F.round("key", 6).alias("key"))
)
query("accept_ramp", "SELECT n::BIGINT AS n, round(CASE WHEN n / 32 < 0.25 THEN 1 WHEN n / 32 >= 1 THEN 0 ELSE 1 - (n / 32 - 0.25) / 0.75 END, 6) AS p FROM (SELECT unnest(range(0, 40)) AS n)")(
    lambda s, sf: s.range(40).select(F.col("id").alias("n"), F.round(sampling.accept_probability(F.col("id"), 32, 0.25), 6).alias("p"))
)
_heavy = f"(SELECT *, w > 0.005 * sum(w) OVER () AS heavy FROM {L_SQL})"
_rate = f"(SELECT *, least(1, greatest(0, 200 - count(*) FILTER (heavy) OVER ()) / nullif(count(*) FILTER (NOT heavy) OVER (), 0)) AS p FROM {_heavy})"
query("importance_downsample", f"SELECT seq, round(CASE WHEN heavy THEN w ELSE w / p END, 6) AS sampled_weight FROM {_rate} WHERE heavy OR {uniform_sql('seq', '0', '2', str(SEED))} < p")(
    lambda s, sf: sampling.downsample(L(s, sf), "w", 200, SEED).select("seq", F.round("sampled_weight", 6).alias("sampled_weight"))
)
_P = "(SELECT p_partkey AS seq, p_name AS o, p_retailprice AS w FROM part)"
query("object_sampler", f"SELECT seq, o FROM (SELECT *, {key_sql('0', 0, 'w')} AS key FROM {_P}) QUALIFY row_number() OVER (ORDER BY key, seq) <= 50")(
    lambda s, sf: sampling.reservoir(read(s, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("o"), F.col("p_retailprice").alias("w")), 1, 50, 0.0, "w", SEED).select("seq", "o")
)

# summaries ----------------------------------------------------------------------------------------------------------
_W = "(SELECT l_returnflag AS k, l_quantity AS x, l_discount + 0.01 AS w FROM lineitem)"
query(
    "weighted_percentile_summary",
    f"""WITH g AS (SELECT k, x, sum(w) AS w FROM {_W} GROUP BY k, x), c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY x) AS cum, sum(w) OVER (PARTITION BY k) AS total FROM g)
SELECT k, round(sum(w * x) / sum(w), 3) AS mean, round(sqrt(greatest(0, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) * (sum(w * x) / sum(w)))), 3) AS deviation, round(max(total), 3) AS total,
  min(x) FILTER (cum >= 0.1 * total - 1e-9) AS lower, min(x) FILTER (cum >= 0.5 * total - 1e-9) AS median, min(x) FILTER (cum >= 0.9 * total - 1e-9) AS upper FROM c GROUP BY k""",
)(
    lambda s, sf: summary.weighted_percentiles(read(s, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_discount") + 0.01).alias("w")), ["k"], "x", "w", {"lower": 0.1, "median": 0.5, "upper": 0.9}).select(
        "k", *(F.round(c, 3).alias(c) for c in ("mean", "deviation", "total")), "lower", "median", "upper"
    )
)
query("weighted_dedup", "SELECT l_quantity, l_discount, round(sum(l_tax), 6) AS weight, count(*) AS copies FROM lineitem GROUP BY 1, 2")(
    lambda s, sf: summary.weighted_dedup(read(s, sf, "lineitem"), ["l_quantity", "l_discount"], "l_tax").select("l_quantity", "l_discount", F.round("weight", 6).alias("weight"), "copies")
)
query("neighbour_merge", "SELECT l_returnflag AS q, l_quantity AS p, min(l_extendedprice) AS distance, count(DISTINCT l_partkey) AS n_seqs, min(l_partkey) AS first_seq, max(l_partkey) AS last_seq, count(*) AS count FROM lineitem GROUP BY 1, 2")(
    lambda s, sf: summary.merge_neighbours(read(s, sf, "lineitem").select(F.col("l_returnflag").alias("q"), F.col("l_quantity").alias("p"), "l_extendedprice", "l_partkey"), ["q"], ["p"], "l_extendedprice", "l_partkey").select(
        "q", "p", "distance", F.size("seqs").cast("long").alias("n_seqs"), F.col("seqs")[0].alias("first_seq"), F.element_at("seqs", -1).alias("last_seq"), "count"
    )
)


def _vectors(s, sf):
    df = read(s, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount").alias("h"), F.array("l_tax", "l_quantity").alias("l"))
    high, low = summary.renormalised(F.col("h"), F.col("l"), F.lit(2.0))
    both = summary.vector_add(high, summary.vector_scale(low, F.lit(3.0)))
    return df.select("l_orderkey", "l_linenumber", F.round(summary.vector_sum(F.col("h"), F.col("l")), 6).alias("total"), F.round(both[0], 6).alias("b0"), F.round(both[1], 6).alias("b1"))


query(
    "divector_ops",
    "SELECT l_orderkey, l_linenumber, round(2 * l_quantity + l_discount + l_tax, 6) AS total, round((l_quantity + 3 * l_tax) * 2 / (2 * l_quantity + l_discount + l_tax), 6) AS b0, round((l_discount + 3 * l_quantity) * 2 / (2 * l_quantity + l_discount + l_tax), 6) AS b1 FROM lineitem",
)(_vectors)

# distances ----------------------------------------------------------------------------------------------------------
DIMS = None  # all coordinates
WIDTH = 64  # coordinates that the SQL spells out


def V(spark, sf, dims=DIMS):
    x = F.col("embedding") if dims is None else F.slice("embedding", 1, dims)
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), "label", x.cast("array<double>").alias("x"))


_I = range(WIDTH)
_V = ", ".join(f"v{i}" for i in _I)


def each(form: str, between: str = ", ") -> str:
    """form for every coordinate number {i}."""
    return between.join(form.format(i=i) for i in _I)


def pick(form: str, last: str, ranges: str = "r{i}") -> str:
    """The branches of a CASE that finds r in the running sum of ranges; {before} is the sum up to a coordinate."""
    sums, out = "0", []
    for i in _I:
        upto = f"{sums} + {ranges.format(i=i)}" if i else ranges.format(i=0)
        value = form.format(i=i, before=f"({sums})")
        out.append(f"WHEN r < {upto} AND {ranges.format(i=i)} > 0 THEN {value}" if i < WIDTH - 1 else f"ELSE {last.format(i=i, before=f'({sums})')} END")
        sums = upto
    return " ".join(out)


_E = f"(SELECT vec_id AS id, label, {', '.join(f'embedding[{i + 1}]::DOUBLE AS v{i}' for i in _I)} FROM embeddings)"
_C = f"(SELECT label AS centre, {each('avg(v{i}) AS c{i}')} FROM {_E} GROUP BY label)"
_L2C = f"sqrt({each('(v{i} - c{i}) ** 2', ' + ')})"


def centres(spark, sf):
    v = V(spark, sf).groupBy("label").agg(*(F.avg(F.col("x")[i]).alias(f"c{i}") for i in _I))
    return v.select(F.col("label").alias("centre"), F.array(*(f"c{i}" for i in _I)).alias("c"))


query(
    "distance_l1_l2_linf",
    f"SELECT id, centre, round({each('abs(v{i} - c{i})', ' + ')}, 6) AS l1, round({_L2C}, 6) AS l2, round(greatest({each('abs(v{i} - c{i})')}), 6) AS linf FROM {_E}, {_C}",
)(
    lambda s, sf: V(s, sf).join(distance.small(centres(s, sf)), how="cross").select("id", "centre", *(F.round(f(F.col("x"), F.col("c")), 6).alias(n) for n, f in (("l1", distance.l1), ("l2", distance.l2), ("linf", distance.linf))))
)
_DC = f"(SELECT id, centre, {_L2C} AS d FROM {_E}, {_C})"
query(
    "soft_assign",
    f"WITH n AS (SELECT * FROM (SELECT *, min(d) OVER (PARTITION BY id) AS m FROM {_DC}) WHERE d <= 1.25 * m) SELECT id, centre, round(d, 6) AS distance, round(CASE WHEN m > 0 THEN (1 / d) / sum(1 / d) OVER (PARTITION BY id) ELSE 1 / count(*) OVER (PARTITION BY id) END, 6) AS share FROM n",
)(lambda s, sf: distance.soft_assign(V(s, sf), centres(s, sf)).select("id", "centre", F.round("distance", 6).alias("distance"), F.round("share", 6).alias("share")))
query(
    "knn_in_sample",
    f"SELECT id, seq, round(d, 6) AS distance, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, seq) AS r FROM (SELECT q.id, s.id AS seq, sqrt({each('(q.v{i} - s.v{i}) ** 2', ' + ')}) AS d FROM {_E} q, {_E} s)) WHERE r <= 4",
)(lambda s, sf: distance.nearest(V(s, sf), V(s, sf).select("seq", F.col("x").alias("point")), 4).select("id", "seq", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")))
query("bbox_per_label", f"SELECT label, round(min(v0), 6) AS a0, round(max(v0), 6) AS a1, round(max(v1) - min(v1), 6) AS rb, round({each('max(v{i}) - min(v{i})', ' + ')}, 6) AS range_sum FROM {_E} GROUP BY label")(
    lambda s, sf: distance.separation_vector(V(s, sf), ["label"]).select("label", F.round(F.col("low")[0], 6).alias("a0"), F.round(F.col("high")[0], 6).alias("a1"), F.round(F.col("ranges")[1], 6).alias("rb"), F.round("range_sum", 6).alias("range_sum"))
)
_BOX = f"(SELECT label AS bl, {each('min(v{i}) AS l{i}, max(v{i}) AS h{i}')} FROM {_E} GROUP BY label)"
_OUT = each("greatest(0, v{i} - h{i}, l{i} - v{i})", " + ")
_RNG = each("h{i} - l{i}", " + ")
_FAR = f"sqrt({each('(v{i} - l{i}) ** 2', ' + ')})"
query("prob_of_separation", f"SELECT id, bl AS box, round(CASE WHEN {_OUT} + {_RNG} > 0 THEN ({_OUT}) / ({_OUT} + {_RNG}) ELSE 0 END, 6) AS p FROM {_E}, {_BOX}")(
    lambda s, sf: V(s, sf)
    .join(distance.small(distance.separation_vector(V(s, sf), ["label"]).withColumnRenamed("label", "box")), how="cross")
    .select("id", "box", F.round(distance.separation_probability(F.col("low"), F.col("high"), F.col("x"), F.col("range_sum")), 6).alias("p"))
)
_REP = "(SELECT p_brand AS cluster, min(p_name) AS r, 5.0::DOUBLE AS radius FROM part GROUP BY p_brand)"
query(
    "cluster_score_no_occlusion",
    f"SELECT id, cluster, round(score, 6) AS score FROM (SELECT p_partkey AS id, cluster, least(10, levenshtein(p_name, r) / radius) AS score FROM part, {_REP}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score, cluster) = 1",
)(
    lambda s, sf: distance.cluster_scores(
        read(s, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("o")), read(s, sf, "part").groupBy(F.col("p_brand").alias("cluster")).agg(F.min("p_name").alias("r"), F.lit(5.0).alias("radius")), F.levenshtein
    ).select("id", "cluster", F.round("score", 6).alias("score"))
)

# forests ------------------------------------------------------------------------------------------------------------
OPTIONS = dict(trees=TREES, sample_size=SIZE, decay=0.001, seed=SEED)


def nodes(spark, sf, dims=DIMS, **more):
    return forest.train(V(spark, sf, dims), forest.Options(**(OPTIONS | more)))


#: the same trees by recursion: every step cuts all boxes of one depth
_S = f"(SELECT id AS seq, 0 AS series, {_V}, tree, {key_sql('tree', 0.001).replace('seq', 'id')} AS key FROM {_E}, (SELECT unnest(range(0, {TREES})) AS tree) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY key, seq) <= {SIZE})"
_SIDES = "(h{i} - l{i})"
FOREST = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT tree, seq, {_V} FROM {_S}),
part AS (
  SELECT tree, 1::BIGINT AS path, 0 AS depth, seq, {_V} FROM s
  UNION ALL
  SELECT tree, CASE WHEN v <= cut THEN (2 * path) % 2147483647 ELSE (2 * path + 1) % 2147483647 END, depth + 1, seq, {_V} FROM (
    SELECT *, CASE {pick('v{i}', 'v{i}')} AS v, CASE {pick('m{i} + (r - {before})', 'm{i} + (r - {before})')} AS cut FROM (
      SELECT *, {uniform_sql('path', 'tree', '3', str(SEED))} * ({each('r{i}', ' + ')}) AS r FROM (
        SELECT *, {each('max(v{i}) OVER w - min(v{i}) OVER w AS r{i}, min(v{i}) OVER w AS m{i}')}
        FROM part WINDOW w AS (PARTITION BY tree, path)) WHERE {each('r{i}', ' + ')} > 0))
),
box AS MATERIALIZED (SELECT tree, path, depth, count(*) AS mass, {each('min(v{i}) AS l{i}, max(v{i}) AS h{i}')}, min(seq) AS first_seq,
  CASE WHEN {each('max(v{i}) = min(v{i})', ' AND ')} THEN NULL ELSE {uniform_sql('path', 'tree', '3', str(SEED))} * ({each('max(v{i}) - min(v{i})', ' + ')}) END AS r
  FROM part GROUP BY tree, path, depth),
node AS MATERIALIZED (SELECT *, CASE WHEN r IS NULL THEN NULL {pick('{i}', '{i}', _SIDES)} AS dim, CASE WHEN r IS NULL THEN NULL {pick('l{i} + (r - {before})', 'l{i} + (r - {before})', _SIDES)} AS cut FROM box)"""
_WALK = (
    FOREST
    + f""", q AS (SELECT id, {_V} FROM {_E}),
way AS (
  SELECT q.*, n.* EXCLUDE (r) FROM q, node n WHERE n.path = 1
  UNION ALL
  SELECT w.id, {each('w.v{i}')}, n.* EXCLUDE (r) FROM way w JOIN node n ON n.tree = w.tree AND n.depth = w.depth + 1
    AND n.path = CASE WHEN (CASE w.dim {each('WHEN {i} THEN w.v{i}', ' ')} END) <= w.cut THEN (2 * w.path) % 2147483647 ELSE (2 * w.path + 1) % 2147483647 END
  WHERE w.dim IS NOT NULL
),
p AS (SELECT *, {_OUT} AS o, {_RNG} AS g, max(depth) OVER (PARTITION BY id, tree) AS deepest, max(mass) OVER (PARTITION BY id, tree) AS total FROM way),
e AS (SELECT *, CASE WHEN o > 0 THEN o / (o + g) ELSE 0 END AS pr, coalesce(sum(ln(1 - CASE WHEN o > 0 AND depth < deepest THEN o / (o + g) ELSE 0 END)) OVER (PARTITION BY id, tree ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM p)"""
)


def fold_sql(leaf_seen, unseen_sql, norm):
    """Sum over the way of what each node adds, times what is left by the nodes above it."""
    return f"""{_WALK}
SELECT id, round(avg(s), 6) AS score FROM (SELECT id, tree, {norm.replace('{s}', f"sum(exp(above) * CASE WHEN depth < deepest THEN pr * ({unseen_sql}) WHEN o > 0 THEN ({unseen_sql}) ELSE ({leaf_seen}) END)")} AS s FROM e GROUP BY id, tree) GROUP BY id"""


query("tree_build_nodes", f"{FOREST} SELECT tree::BIGINT AS tree, path, depth::BIGINT AS depth, mass, dim::BIGINT AS dim, round(cut, 6) AS cut, round(l0, 6) AS a0, round(h{WIDTH - 1}, 6) AS c1 FROM node")(
    lambda s, sf: nodes(s, sf).select(*(F.col(c).cast("long").alias(c) for c in ("tree", "path", "depth", "mass")), F.when(F.col("left") >= 0, F.col("dim").cast("long")).alias("dim"), F.when(F.col("left") >= 0, F.round("cut", 6)).alias("cut"), F.round(F.col("low")[0], 6).alias("a0"), F.round(F.col("high")[WIDTH - 1], 6).alias("c1"))
)
query("forest_center_of_mass", f"{FOREST} SELECT tree::BIGINT AS tree, depth::BIGINT AS depth, count(*) AS n, round(sum(v0), 6) AS sa, round(sum(v2), 6) AS sc FROM part GROUP BY tree, depth")(
    lambda s, sf: (lambda n: forest.centres_of_mass(n).join(n.select("tree", "node", "depth"), ["tree", "node"]).groupBy(F.col("tree").cast("long").alias("tree"), F.col("depth").cast("long").alias("depth")).agg(
        F.sum("mass").alias("n"), F.round(F.sum(F.col("mass") * F.col("centre")[0]), 6).alias("sa"), F.round(F.sum(F.col("mass") * F.col("centre")[2]), 6).alias("sc")
    ))(nodes(s, sf))
)
query("tree_leaf_of_point", f"{_WALK} SELECT id, tree::BIGINT AS tree, depth::BIGINT AS depth, mass, round({_FAR}, 6) AS distance FROM p WHERE depth = deepest")(
    lambda s, sf: forest.query(
        V(s, sf), nodes(s, sf), lambda f, q: {"l": [[{"tree": k, "depth": int(t.depth[i]), "mass": int(t.mass[i]), "distance": float(((x - t.low[i]) ** 2).sum() ** 0.5)} for k, t in enumerate(f.trees) for i in [t.descend(x[None])[-1][0]]] for x in q]},
        "l array<struct<tree:bigint,depth:bigint,mass:bigint,distance:double>>", keep=["id"],
    ).select("id", F.inline("l")).select("id", "tree", "depth", "mass", F.round("distance", 6).alias("distance"))
)
NEAR = 1.0
R6 = lambda df: df.select("id", F.round("score", 6).alias("score"))
_SEEN = "(1 - mass / (2 * total)) / (depth + log2(mass + 1))"
query("anomaly_score", fold_sql(_SEEN, "1 / (depth + 1)", "{s} * log2(max(total) + 1)"))(lambda s, sf: R6(forest.scores(V(s, sf), nodes(s, sf), keep=["id"])))
query("displacement_score", fold_sql("1 / (1 + mass)", "mass", "{s} / (1 + max(total))"))(lambda s, sf: R6(forest.displacements(V(s, sf), nodes(s, sf), keep=["id"])))
query("dynamic_score", fold_sql("1 / (depth + 2)", "1 / (depth + 1.5)", "{s}"))(lambda s, sf: R6(forest.dynamic_scores(V(s, sf), nodes(s, sf), lambda d, m: 1 / (d + 2.0), lambda d, m: 1 / (d + 1.5), lambda a, b: 1.0, keep=["id"])))
query("generic_score_normalized", fold_sql(_SEEN, "1 / (depth + 1)", "{s} * log2(max(total) + 1)"))(lambda s, sf: R6(forest.dynamic_scores(V(s, sf), nodes(s, sf), seen, unseen, damp, normalizer=log_normalizer, keep=["id"])))
query("readiness", f"SELECT id, score, 0::DOUBLE AS early FROM ({fold_sql(_SEEN, '1 / (depth + 1)', '{s} * log2(max(total) + 1)')})")(
    lambda s, sf: R6(forest.scores(V(s, sf), nodes(s, sf), after=SIZE, keep=["id"])).join(forest.scores(V(s, sf), nodes(s, sf), after=SIZE + 1, keep=["id"]).select("id", F.col("score").alias("early")), "id")
)
query(
    "attribution_sums_to_score", fold_sql(_SEEN, "1 / (depth + 1)", "{s} * log2(max(total) + 1)"),
)(lambda s, sf: forest.attributions(V(s, sf), nodes(s, sf), keep=["id"]).select("id", F.round(summary.vector_sum(F.col("high"), F.col("low")), 6).alias("score")))
query(
    "near_neighbors",
    f"{_WALK} SELECT id, round(min(d), 6) AS nearest, count(*) AS trees FROM (SELECT id, tree, {_FAR} AS d FROM p WHERE depth = deepest) WHERE d < {NEAR} GROUP BY id",
)(
    lambda s, sf: forest.neighbours(V(s, sf), nodes(s, sf), NEAR, keep=["id"]).where(F.size("near") > 0).select("id", F.round(F.col("near")[0]["distance"], 6).alias("nearest"), F.aggregate("near", F.lit(0), lambda a, e: a + e["count"]).cast("long").alias("trees"))
)
query("validate_restored", f"SELECT unnest(range(0, {TREES})) AS tree, true AS valid")(lambda s, sf: forest.valid(nodes(s, sf)).select(F.col("tree").cast("long").alias("tree"), "valid"))

query("model_size", f"{FOREST} SELECT tree::BIGINT AS tree, count(*) AS nodes, count(*) FILTER (dim IS NULL) AS leaves, sum(CASE WHEN dim IS NULL THEN mass ELSE 0 END)::BIGINT AS points, max(depth)::BIGINT AS depth FROM node GROUP BY tree")(
    lambda s, sf: forest.sizes(nodes(s, sf)).select(F.col("tree").cast("long").alias("tree"), "nodes", "leaves", "points", "depth")
)
query(
    "point_store_weights",
    f"SELECT seq, count(*) AS trees FROM {topk_sql(0.001)} GROUP BY seq",
)(lambda s, sf: sampling.reservoir(L(s, sf), TREES, SIZE, 0.001, None, SEED).groupBy("seq").agg(F.count("*").alias("trees")))

WIDE = dict(trees=20, sample_size=64)
_wide = lambda s, sf: nodes(s, sf, None, **WIDE)
query("anomaly_attribution")(lambda s, sf: forest.attributions(V(s, sf, None), _wide(s, sf), keep=["id"]))
query("approximate_score")(lambda s, sf: forest.approximate_scores(V(s, sf, None), _wide(s, sf), keep=["id"]))
query("approximate_attribution")(lambda s, sf: forest.approximate_attributions(V(s, sf, None), _wide(s, sf), keep=["id"]).select("id", "total", "trees_used"))
_OWN = {"seen_f": lambda d, m: 1 / (d + 2.0), "unseen_f": lambda d, m: 1 / (d + 1.5), "damp_f": lambda a, b: 1.0, "normalizer": lambda s, m: s}
query("approximate_dynamic_score")(lambda s, sf: forest.approximate_scores(V(s, sf, None), _wide(s, sf), score=_OWN, keep=["id"]))
query("approximate_dynamic_attribution")(lambda s, sf: forest.approximate_attributions(V(s, sf, None), _wide(s, sf), score=_OWN | {"ignore": 1}, keep=["id"]))
query("dynamic_attribution")(lambda s, sf: forest.dynamic_attributions(V(s, sf, None), _wide(s, sf), seen, unseen, damp, 1, keep=["id"]))
_WHOLE = each("(greatest(v{i}, h{i}) - least(v{i}, l{i})) ** 2", " + ")
_NEW = each("greatest(0, (greatest(v{i}, h{i}) - least(v{i}, l{i})) ** 2 - (h{i} - l{i}) ** 2)", " + ")
query(
    "simulated_score",
    f"""{_WALK},
z AS (SELECT *, CASE WHEN depth < deepest THEN ({_NEW}) / ({_WHOLE}) ELSE 0 END AS cutoff FROM p),
y AS (SELECT *, coalesce(sum(ln(1 - cutoff)) OVER (PARTITION BY id, tree ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
SELECT id, round(avg(s), 6) AS score FROM (SELECT id, tree, sum(exp(before) * CASE WHEN depth < deepest THEN cutoff / (depth + 1) WHEN o > 0 THEN 1 / (depth + 1) ELSE {_SEEN} END) * log2(max(total) + 1) AS s FROM y GROUP BY id, tree) GROUP BY id""",
)(lambda s, sf: R6(forest.simulated_scores(V(s, sf), nodes(s, sf), lambda lo, hi: (hi - lo) ** 2, keep=["id"])))
query("simple_density")(lambda s, sf: forest.densities(V(s, sf, None), nodes(s, sf, None), keep=["id"]))
query("impute_missing")(lambda s, sf: forest.imputed(V(s, sf, None), nodes(s, sf, None), [2], keep=["id"]))
query("conditional_summary")(lambda s, sf: forest.conditional_summaries(V(s, sf, None), nodes(s, sf, None), [1, 2], keep=["id"]))
query("forest_attributes", f"{FOREST} SELECT tree::BIGINT AS tree, path, depth::BIGINT AS depth, count(*) AS mass, sum(label)::DOUBLE AS sum_label FROM part JOIN (SELECT vec_id, label FROM embeddings) ON vec_id = seq GROUP BY tree, path, depth")(
    lambda s, sf: forest.train(V(s, sf), forest.Options(**OPTIONS), attributes=["label"]).select(*(F.col(c).cast("long").alias(c) for c in ("tree", "path", "depth", "mass")), "sum_label")
)
#: one forest for each label: its number and the tree's make one number, of which draws see the tree's part only
_PER = f"(SELECT id AS seq, 0 AS series, {_V}, label * 1000 + k.tree AS tree, {key_sql('k.tree', 0.001).replace('seq', 'id')} AS key FROM {_E}, (SELECT unnest(range(0, {TREES})) AS tree) k QUALIFY row_number() OVER (PARTITION BY label, k.tree ORDER BY {key_sql('k.tree', 0.001).replace('seq', 'id')}, id) <= {SIZE})"
_PER_LABEL = fold_sql(_SEEN, "1 / (depth + 1)", "{s} * log2(max(total) + 1)").replace(_S, _PER).replace("((tree) %", "((tree % 1000) %").replace(f"SELECT id, {_V} FROM {_E}", f"SELECT id, {_V}, label FROM {_E}").replace("SELECT q.*, n.*", f"SELECT id, {_V}, n.*").replace("WHERE n.path = 1", "WHERE n.path = 1 AND n.tree // 1000 = q.label")
query("forest_per_label", f"SELECT label, id, score FROM ({_PER_LABEL}) JOIN (SELECT vec_id AS id, label FROM embeddings) USING (id)")(
    lambda s, sf: forest.scores(V(s, sf), forest.train(V(s, sf), forest.Options(**OPTIONS), by=["label"]), keep=["label", "id"], by=["label"]).select("label", "id", F.round("score", 6).alias("score"))
)


def _extrapolate(s, sf):
    from . import series_queries as sq
    from ..operators import framing

    return forest.own_extrapolations(framing.shingle(sq.E(s, sf), 4), forest.Options(10, 32, 0.001), 1, 5, ["series"], x="shingle")


query("extrapolate")(_extrapolate)
