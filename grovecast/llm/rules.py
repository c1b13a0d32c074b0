"""Quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

Counts of each text are SQL expressions over the whole text. A rule rejects where a ratio passes a cutoff. Cutoffs are
chosen for each language on labelled good documents: the grid of a rule is walked from the loosest cutoff on, and a
cutoff is valid while the exact binomial test rejects a false-rejection rate above RISK / rules, that is while
P(Bin(n, rate) <= false rejections) <= DELTA / (rules * languages). Walking in a fixed order and stopping at the first
failure needs no correction inside a grid; Bonferroni's corrects over rules and languages. So with probability
1 - DELTA no language loses more than RISK of its good documents. A rule without a valid cutoff does not apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

RISK, DELTA = 0.02, 0.05
#: ratio of each rule, and its grid from loose to tight; a text is rejected where the ratio is greater
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02]),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "long": ("word_chars / greatest(n_words, 1)", [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0]),
    "short": ("0 - word_chars / greatest(n_words, 1)", [-1.5, -2.0, -2.5, -3.0, -3.5]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1]),
}

_REPEATS = """
transform(array(
  if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))
), h -> if(size(array_distinct(h)) = size(h), 0L,
  transform(array(array_sort(transform(h, (x, i) -> struct(x as x, i as i)))), s ->
    aggregate(
      array_sort(transform(filter(transform(s, (e, k) -> struct(e.i as i, coalesce(get(s, k - 1).x = e.x, false) or coalesce(get(s, k + 1).x = e.x, false) as f)), e -> e.f), e -> e.i)),
      struct(0L as n, 0L as stop),
      (a, i) -> struct(a.n + i + 3 - greatest(cast(i as bigint), a.stop) as n, cast(i + 3 as bigint) as stop)
    ).n
  )[0]
))[0]
"""


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (long).

    Words are runs without white space (space, tab to carriage return). A null text counts as empty.
    """
    base = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    base = base.select(*keep, "t", F.expr(r"array_remove(split(t, '[\\x20\\x09-\\x0D]+'), '')").alias("w"))
    return base.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.expr(r"transform(array(filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')), x -> struct(size(x) as n, size(x) - size(array_distinct(x)) as d))[0]").alias("lines"),
        F.expr(_REPEATS).cast("long").alias("n_repeat_words"),
        (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
    ).select("*", F.col("lines.n").cast("long").alias("n_lines"), F.col("lines.d").cast("long").alias("n_dup_lines")).drop("lines")


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _tail(n: str, k: str, rate: float) -> str:
    """Logarithm of P(Bin(n, rate) <= k), as SQL; terms by recurrence, summed in logarithms."""
    return f"""aggregate(if({k} < 1, cast(array() as array<bigint>), sequence(1L, {k})),
      struct(cast({n} * ln(1 - {rate}D) as double) as t, cast({n} * ln(1 - {rate}D) as double) as s),
      (a, i) -> transform(array(a.t + ln(({n} - i + 1) / i) + ln({rate}D / (1 - {rate}D))), t -> struct(t as t, greatest(a.s, t) + ln(1 + exp(-abs(a.s - t))) as s))[0]
    ).s"""


def cutoffs(metrics: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(lang, good, one column for each rule): the tightest valid cutoff, null where there is none.

    metrics has doc_id, lang and the counts; good documents are those that a label calls good and the base rules keep.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).groupBy("doc_id").agg(F.min("q").alias("q")).where("q > 0").select("doc_id")
    held = metrics.where(~base_failed()).join(good, "doc_id")
    rate = risk / len(RULES)
    sums = [F.count("*").alias("good")]
    for name, (ratio, grid) in RULES.items():
        sums.append(F.array(*(F.sum(F.expr(f"if({ratio} > {c}D, 1L, 0L)")) for c in grid)).alias(name))
    told = held.groupBy("lang").agg(*sums)
    told = told.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1))))
    level = f"ln({delta}D / ({len(RULES)} * strata))"
    out = []
    for name, (_, grid) in RULES.items():
        valid = f"k <= good * {rate}D and {_tail('good', 'k', rate)} <= {level}"
        walk = f"aggregate(transform({name}, k -> {valid}), struct(0 as n, true as go), (a, v) -> struct(a.n + if(a.go and v, 1, 0) as n, a.go and v as go)).n"
        out.append(F.expr(f"get(array({', '.join(f'{c}D' for c in grid)}), {walk} - 1)").alias(name))
    return told.select("lang", "good", *out)


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs (doc_id, text, lang).

    A null text has no words and fails the base rules, as every text of fewer than 50 words does. A null language is a
    stratum of its own; languages without labelled good documents have no cutoffs, so their texts are judged by the
    base rules alone. Repeated rows give repeated results; other columns are ignored; an empty table gives an empty one.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    metrics = cut(counts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), lang.alias("lang")), "doc_id", "lang"))
    chosen = cutoffs(metrics, labels, risk, delta)
    hit = F.lit(False)
    for name, (ratio, _) in RULES.items():
        hit = hit | F.coalesce(F.expr(f"{ratio}") > F.col(name), F.lit(False))
    judged = metrics.join(chosen, "lang", "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~hit).alias("kept")
    )


def op6_rules(spark, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    """The same in DuckDB's SQL: windows by row, the binomial tail by log-gamma."""
    rate = RISK / len(RULES)
    grids = " UNION ALL ".join(f"SELECT '{n}' AS rule, {k} AS step, {c}::DOUBLE AS cutoff" for n, (_, g) in RULES.items() for k, c in enumerate(g))
    ratios = " UNION ALL ".join(f"SELECT doc_id, lang, '{n}' AS rule, ({r})::DOUBLE AS v FROM m" for n, (r, _) in RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
tri AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS r FROM tri),
cov AS (SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM rep),
rw AS (SELECT doc_id, sum(c)::BIGINT AS n FROM cov GROUP BY doc_id),
ln_ AS (SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
m AS (SELECT d.doc_id, d.lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')))::BIGINT AS n_capitals
  FROM d JOIN ln_ USING (doc_id) LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
v AS ({ratios}),
grid AS ({grids}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) > 0),
held AS (SELECT v.* FROM v JOIN b USING (doc_id) JOIN good USING (doc_id) WHERE NOT b.base_failed),
cnt AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k FROM held JOIN grid USING (rule) GROUP BY ALL),
tail AS (SELECT lang, rule, step, cutoff, n, k, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate})))
  FROM generate_series(0, k) AS s(i)) AS p FROM cnt),
ok AS (SELECT *, p <= {DELTA} / ({len(RULES)} * (SELECT count(DISTINCT lang) FROM held)) AND k <= n * {rate} AS good FROM tail),
walk AS (SELECT *, bool_and(good) OVER (PARTITION BY lang, rule ORDER BY step) AS go FROM ok),
chosen AS (SELECT lang, rule, arg_max(cutoff, step) AS cutoff FROM walk WHERE go GROUP BY lang, rule),
hit AS (SELECT DISTINCT doc_id FROM v JOIN chosen USING (lang, rule) WHERE v.v > chosen.cutoff)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit.doc_id IS NULL AS kept
FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id
"""


ORACLE = _oracle()
