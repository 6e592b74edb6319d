"""ROUGE, BLEU, embedding match and system comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestry.catalog.registry import query
from digestry.catalog.views import (
    PREDICTIONS,
    TALK_PREDICTIONS,
    kept,
    norm,
    prediction_rows,
    predictions,
    talk_pairs,
    token_vectors,
    word_list,
)
from digestry.operators import metrics, scores
from digestry.plans.evaluate import cross_comparison

IDS = ["row_id", "system", "strategy"]
BY = ["system", "strategy"]
DIGITS = 6

# ---- SQL building blocks ------------------------------------------------------------------------


def rouge_list(c: str) -> str:
    return kept(f"string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' ')")


# The "13a" tokenization rules as SQL has them.
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
RULES = (
    (r"([\{-~\[-`!-&\(-\+:-@/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)


def bleu_list(c: str) -> str:
    line = f"replace(replace(replace({c}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, plain in ENTITIES:
        line = f"replace({line}, '{entity}', '{plain}')"
    line = f"(' ' || {line} || ' ')"
    for pattern, replacement in RULES:
        line = f"regexp_replace({line}, '{pattern}', '{replacement}', 'g')"
    return kept(f"string_split({norm(line)}, ' ')")


def clip_ctes(src: str, ids: str, tokens, orders, tag: str) -> str:
    """CTEs ``tok_tag`` (token lists p, r) and ``clip_tag`` (ids, n, m)."""
    sides = " UNION ALL ".join(
        f"SELECT {ids}, '{side}' AS side, unnest({side}) AS w1, generate_subscripts({side}, 1) AS i "
        f"FROM tok_{tag}"
        for side in ("p", "r")
    )
    leads = "".join(f", lead(w1, {k}) OVER (PARTITION BY {ids}, side ORDER BY i) AS w{k + 1}"
                    for k in range(1, max(orders)))
    grams = " UNION ALL ".join(
        f"SELECT {ids}, {n} AS n, side, {' || chr(32) || '.join(f'w{k}' for k in range(1, n + 1))} AS g "
        f"FROM led_{tag} WHERE w{n} IS NOT NULL"
        for n in orders
    )
    return f"""
tok_{tag} AS MATERIALIZED (
  SELECT {ids}, {tokens("prediction")} AS p, {tokens("reference")} AS r FROM {src}),
led_{tag} AS MATERIALIZED (SELECT *{leads} FROM ({sides})),
gram_{tag} AS ({grams}),
clip_{tag} AS (
  SELECT {ids}, n, sum(least(cp, cr)) AS m FROM (
    SELECT {ids}, n, g, count(*) FILTER (WHERE side = 'p') AS cp,
           count(*) FILTER (WHERE side = 'r') AS cr
    FROM gram_{tag} GROUP BY {ids}, n, g)
  GROUP BY {ids}, n)"""


def f_sql(m: str, predicted: str, expected: str) -> str:
    p, r = f"({m} / greatest({predicted}, 1))", f"({m} / greatest({expected}, 1))"
    return f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


def rouge_ctes(src: str, ids: list[str], orders=(1, 2)) -> str:
    """``rouge_n``: ids and one column per order."""
    names = ", ".join(ids)
    values = ", ".join(
        f_sql(
            f"coalesce(max(m) FILTER (WHERE n = {n}), 0)",
            f"greatest(max(len(p)) - {n - 1}, 0)",
            f"greatest(max(len(r)) - {n - 1}, 0)",
        )
        + f" AS rouge{n}"
        for n in orders
    )
    return f"""{clip_ctes(src, names, rouge_list, orders, "rg")},
rouge_n AS (
  SELECT {names}, {values} FROM tok_rg LEFT JOIN clip_rg USING ({names}) GROUP BY {names})"""


def lcs_ctes(src: str, ids: list[str], shorter: str = "r") -> str:
    """``rouge_l``: the smallest end position in the longer side (p or r) per common length, for
    each word of the shorter one."""
    names = ", ".join(ids)
    longer = "p" if shorter == "r" else "r"
    return f"""
tok_l AS MATERIALIZED (
  SELECT row_number() OVER () AS k, {names}, {rouge_list("prediction")} AS p,
         {rouge_list("reference")} AS r FROM {src}),
pt AS (SELECT k, unnest({shorter}) AS w, generate_subscripts({shorter}, 1) AS i FROM tok_l),
rt AS (SELECT k, unnest({longer}) AS w, generate_subscripts({longer}, 1) AS j FROM tok_l),
ends AS (
  SELECT k, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS j FROM tok_l
  UNION ALL
  SELECT k, i + 1, m, min(j) FROM (
    SELECT e.k, e.i, e.m, e.j FROM ends e JOIN pt ON pt.k = e.k AND pt.i = e.i + 1
    UNION ALL
    SELECT e.k, e.i, e.m + 1, min(rt.j)
    FROM ends e JOIN pt ON pt.k = e.k AND pt.i = e.i + 1
                JOIN rt ON rt.k = e.k AND rt.w = pt.w AND rt.j > e.j
    GROUP BY e.k, e.i, e.m)
  GROUP BY k, i, m),
lcs AS (SELECT k, max(m) AS lcs FROM ends GROUP BY k),
rouge_l AS (
  SELECT {names}, {f_sql("lcs", "len(p)", "len(r)")} AS rougeL FROM tok_l JOIN lcs USING (k))"""


def whole_lcs_ctes(src: str, ids: list[str]) -> str:
    """``rouge_l`` for whole documents. A list holds, for each common length from 0, the smallest end
    position in the prediction; each word of the reference brings its next position after any other there
    and updates the list.
    """
    names = ", ".join(ids)
    return f"""
tok_l AS MATERIALIZED (
  SELECT row_number() OVER () AS k, {names}, {rouge_list("prediction")} AS p,
         {rouge_list("reference")} AS r FROM {src}),
found AS (
  SELECT k, w, flatten(list_transform(range(1, len(js) + 1), lambda x: list_transform(
           range(js[x] - coalesce(js[x - 1], 0)), lambda y: js[x]))) AS later
  FROM (SELECT k, w, list(j ORDER BY j) AS js
        FROM (SELECT k, unnest(p) AS w, generate_subscripts(p, 1) AS j FROM tok_l)
        WHERE (k, w) IN (SELECT k, unnest(r) FROM tok_l) GROUP BY k, w)),
met AS (
  SELECT k, list_prepend([CAST(0 AS BIGINT)], list(later ORDER BY i)) AS met
  FROM (SELECT k, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM tok_l) JOIN found USING (k, w)
  GROUP BY k),
lcs AS (
  SELECT k, len(list_reduce(met, lambda ends, later: list_prepend(CAST(0 AS BIGINT), list_filter(
           list_transform(list_zip(list_transform(ends, lambda e: later[e + 1]), ends[2:]), lambda z: least(z[1], z[2])),
           lambda e: e IS NOT NULL)))) - 1 AS lcs
  FROM met),
rouge_l AS (
  SELECT {names}, {f_sql("coalesce(lcs, 0)", "len(p)", "len(r)")} AS rougeL
  FROM tok_l LEFT JOIN lcs USING (k))"""


def bleu_ctes(src: str, ids: list[str], by: list[str]) -> str:
    """``bleu_sums`` and ``bleu_by``."""
    names, group = ", ".join(ids), ", ".join(by)
    match = ", ".join(
        f"coalesce(max(m) FILTER (WHERE n = {n}), 0) AS m{n}, greatest(max(len(p)) - {n - 1}, 0) AS t{n}"
        for n in (1, 2, 3, 4)
    )
    sums = ", ".join(f"sum(m{n}) AS match_{n}, sum(t{n}) AS total_{n}" for n in (1, 2, 3, 4))
    opens, missed = [], []
    for n in (1, 2, 3, 4):
        opens.append("(" + " AND ".join(f"total_{k} > 0" for k in range(1, n + 1)) + ")")
        missed.append(f"(CASE WHEN {opens[-1]} AND match_{n} = 0 THEN 1 ELSE 0 END)")
    logs = " + ".join(
        f"(CASE WHEN NOT {opens[n - 1]} THEN 0.0 WHEN match_{n} = 0 THEN "
        f"ln(100.0 / (pow(2, {' + '.join(missed[:n])}) * greatest(total_{n}, 1))) "
        f"ELSE ln(100.0 * greatest(match_{n}, 1) / greatest(total_{n}, 1)) END)"
        for n in (1, 2, 3, 4)
    )
    usable = " + ".join(f"(CASE WHEN {o} THEN 1 ELSE 0 END)" for o in opens)
    return f"""{clip_ctes(src, names, bleu_list, (1, 2, 3, 4), "bl")},
bleu_pair AS (
  SELECT {names}, max(len(p)) AS np, max(len(r)) AS nr, {match}
  FROM tok_bl LEFT JOIN clip_bl USING ({names}) GROUP BY {names}),
bleu_sums AS (
  SELECT {group}, sum(np) AS sys_len, sum(nr) AS ref_len, {sums} FROM bleu_pair GROUP BY {group}),
bleu_by AS (
  SELECT {group}, CASE WHEN match_1 + match_2 + match_3 + match_4 = 0 THEN 0.0 ELSE
    (CASE WHEN sys_len >= ref_len THEN 1.0 ELSE exp(1 - ref_len / greatest(sys_len, 1)) END)
    * exp(({logs}) / greatest({usable}, 1)) END AS bleu4
  FROM bleu_sums)"""


def ngram_ctes(src: str, ids: list[str], by: list[str]) -> str:
    """``scored``: by and the metrics that need no common subsequence, rounded as reported."""
    names, group = ", ".join(ids), ", ".join(by)
    return f"""{rouge_ctes(src, ids)}, {bleu_ctes(src, ids, by)},
scored AS (
  SELECT {group}, round(avg(rouge1), 4) AS rouge1, round(avg(rouge2), 4) AS rouge2,
         round(max(bleu4), 2) AS bleu4
  FROM rouge_n JOIN bleu_by USING ({group}) GROUP BY {group})"""


def score_ctes(
    src: str, ids: list[str], by: list[str], shorter: str = "r", whole: bool = False
) -> str:
    """``scored``: by and the four text metrics, rounded as reported."""
    names, group = ", ".join(ids), ", ".join(by)
    common = whole_lcs_ctes(src, ids) if whole else lcs_ctes(src, ids, shorter)
    return f"""{rouge_ctes(src, ids)}, {common}, {bleu_ctes(src, ids, by)},
scored AS (
  SELECT {group}, round(avg(rouge1), 4) AS rouge1, round(avg(rouge2), 4) AS rouge2,
         round(avg(rougeL), 4) AS rougeL, round(max(bleu4), 2) AS bleu4
  FROM rouge_n JOIN rouge_l USING ({names}) JOIN bleu_by USING ({group}) GROUP BY {group})"""


# ---- queries ------------------------------------------------------------------------------------


@query(
    "rouge1",
    f"""WITH {PREDICTIONS}, {rouge_ctes("predictions", IDS, (1,))}
        SELECT system, strategy, round(avg(rouge1), {DIGITS}) AS rouge1 FROM rouge_n GROUP BY ALL""",
)
def rouge1(spark, sf):
    table = scores.rouge(predictions(spark, sf), BY, ("rouge1",), stemmed=False)
    return table.withColumn("rouge1", F.round("rouge1", DIGITS))


@query(
    "rouge2",
    f"""WITH {PREDICTIONS}, {rouge_ctes("predictions", IDS, (2,))}
        SELECT system, strategy, round(avg(rouge2), {DIGITS}) AS rouge2 FROM rouge_n GROUP BY ALL""",
)
def rouge2(spark, sf):
    table = scores.rouge(predictions(spark, sf), BY, ("rouge2",), stemmed=False)
    return table.withColumn("rouge2", F.round("rouge2", DIGITS))


# ``score_ngrams`` has the metrics that need no common subsequence; ``*_turns`` score conversation turns.
NGRAMS = ("rouge1", "rouge2")


@query("rouge_l")
def rouge_l(spark, sf):
    return _mean_rouge_l(predictions(spark, sf))


@query(
    "rouge_l_turns",
    f"""WITH RECURSIVE {TALK_PREDICTIONS}, {lcs_ctes("predictions", IDS)}
        SELECT system, strategy, round(avg(rougeL), {DIGITS}) AS rougeL FROM rouge_l GROUP BY ALL""",
)
def rouge_l_turns(spark, sf):
    return _mean_rouge_l(predictions(spark, sf, talk_pairs))


def _mean_rouge_l(rows):
    table = scores.rouge(rows, BY, ("rougeL",), stemmed=False)
    return table.withColumn("rougeL", F.round("rougeL", DIGITS))


@query(
    "rouge_per_pair",
    f"""WITH {PREDICTIONS}, {rouge_ctes("predictions", IDS)}, {whole_lcs_ctes("predictions", IDS)}
        SELECT row_id, system, strategy, round(rouge1, {DIGITS}) AS rouge1,
               round(rouge2, {DIGITS}) AS rouge2, round(rougeL, {DIGITS}) AS rougeL
        FROM rouge_n JOIN rouge_l USING (row_id, system, strategy)""",
)
def rouge_per_pair(spark, sf):
    return _pair_scores(predictions(spark, sf))


@query(
    "rouge_per_pair_turns",
    f"""WITH RECURSIVE {TALK_PREDICTIONS}, {rouge_ctes("predictions", IDS)},
        {lcs_ctes("predictions", IDS)}
        SELECT row_id, system, strategy, round(rouge1, {DIGITS}) AS rouge1,
               round(rouge2, {DIGITS}) AS rouge2, round(rougeL, {DIGITS}) AS rougeL
        FROM rouge_n JOIN rouge_l USING (row_id, system, strategy)""",
)
def rouge_per_pair_turns(spark, sf):
    return _pair_scores(predictions(spark, sf, talk_pairs))


def _pair_scores(rows):
    table = scores.rouge_pairs(rows, IDS, stemmed=False)
    return table.select(*IDS, *[F.round(c, DIGITS).alias(c) for c in scores.ROUGE_KINDS])


@query("rouge_stemmed")
def rouge_stemmed(spark, sf):
    return scores.rouge(predictions(spark, sf), BY)


@query(
    "bleu_counts",
    f"""WITH {PREDICTIONS}, {bleu_ctes("predictions", IDS, BY)}
        SELECT * REPLACE ({", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in
          ["sys_len", "ref_len"] + [f"{k}_{n}" for k in ("match", "total") for n in (1, 2, 3, 4)])})
        FROM bleu_sums""",
)
def bleu_counts(spark, sf):
    return scores.bleu_counts(predictions(spark, sf), BY)


@query(
    "bleu4",
    f"""WITH {PREDICTIONS}, {bleu_ctes("predictions", IDS, BY)}
        SELECT system, strategy, round(bleu4, {DIGITS}) AS bleu4 FROM bleu_by""",
)
def bleu4(spark, sf):
    table = scores.bleu(predictions(spark, sf), BY)
    return table.withColumn("bleu4", F.round("bleu4", DIGITS))


@query(
    "bertscore_greedy",
    f"""WITH vectors AS (
          SELECT vec_id // 20 AS pair_id, vec_id % 2 AS side, vec_id, embedding::DOUBLE[] AS v
          FROM embeddings),
        met AS (
          SELECT a.pair_id, a.vec_id AS pv, b.vec_id AS rv, list_cosine_similarity(a.v, b.v) AS c
          FROM vectors a JOIN vectors b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1),
        pr AS (SELECT pair_id, avg(best) AS precision FROM (
          SELECT pair_id, pv, max(c) AS best FROM met GROUP BY ALL) GROUP BY pair_id),
        rc AS (SELECT pair_id, avg(best) AS recall FROM (
          SELECT pair_id, rv, max(c) AS best FROM met GROUP BY ALL) GROUP BY pair_id)
        SELECT pair_id, round(precision, {DIGITS}) AS precision, round(recall, {DIGITS}) AS recall,
               round(2 * precision * recall / (precision + recall), {DIGITS}) AS f1
        FROM pr JOIN rc USING (pair_id)""",
)
def bertscore_greedy(spark, sf):
    matched = scores.embedding_match(token_vectors(spark, sf), ["pair_id"])
    return matched.select(
        "pair_id", *[F.round(c, DIGITS).alias(c) for c in ("precision", "recall", "f1")]
    )


@query("score_all")
def score_all(spark, sf):
    return scores.score(predictions(spark, sf), BY, stemmed=False)


@query(
    "score_ngrams",
    f"WITH {PREDICTIONS}, {ngram_ctes('predictions', IDS, BY)} SELECT * FROM scored",
)
def score_ngrams(spark, sf):
    return scores.score(predictions(spark, sf), BY, stemmed=False, kinds=NGRAMS)


@query(
    "score_all_turns",
    f"""WITH RECURSIVE {TALK_PREDICTIONS}, {score_ctes("predictions", IDS, BY)}
        SELECT * FROM scored""",
)
def score_all_turns(spark, sf):
    return scores.score(predictions(spark, sf, talk_pairs), BY, stemmed=False)


def compare_sql(src: str = "scored", metrics: str = "rouge1, rouge2, rougeL, bleu4") -> str:
    return f"""
long AS (UNPIVOT {src} ON {metrics} INTO NAME metric VALUE value),
both_systems AS (
  SELECT b.strategy, b.metric, b.value AS base, a.value AS adapter, a.value - b.value AS delta
  FROM long b JOIN long a ON a.strategy = b.strategy AND a.metric = b.metric
    AND b.system = 'base' AND a.system = 'adapter')
SELECT strategy, metric, base, adapter, round(delta, {DIGITS}) AS delta,
       CASE WHEN delta > 0 THEN 'adapter' WHEN delta < 0 THEN 'base' ELSE 'tie' END AS winner
FROM both_systems"""


@query(
    "compare_systems",
    f"WITH {PREDICTIONS}, {score_ctes('predictions', IDS, BY, whole=True)}, {compare_sql()}",
)
def compare_systems(spark, sf):
    return _compared(scores.score(predictions(spark, sf), BY, stemmed=False))


@query(
    "compare_systems_turns",
    f"WITH RECURSIVE {TALK_PREDICTIONS}, {score_ctes('predictions', IDS, BY)}, {compare_sql()}",
)
def compare_systems_turns(spark, sf):
    return _compared(scores.score(predictions(spark, sf, talk_pairs), BY, stemmed=False))


def _compared(table):
    compared = scores.compare_systems(scores.long_scores(table, BY), ["strategy", "metric"])
    return compared.withColumn("delta", F.round("delta", DIGITS))


@query(
    "strategy_pairs",
    f"""WITH RECURSIVE {PREDICTIONS}, duo AS (
          SELECT a.row_id, a.strategy || ' vs ' || b.strategy AS pair,
                 a.prediction AS prediction, b.prediction AS reference
          FROM predictions a JOIN predictions b ON a.row_id = b.row_id
            AND a.system = 'adapter' AND b.system = 'adapter' AND a.strategy_rank < b.strategy_rank),
        {rouge_ctes("duo", ["row_id", "pair"])},
        {bleu_ctes("duo", ["row_id", "pair"], ["row_id", "pair"])}
        SELECT row_id, pair, round(rouge1, {DIGITS}) AS rouge1, round(rouge2, {DIGITS}) AS rouge2,
               round(bleu4, {DIGITS}) AS bleu4
        FROM rouge_n JOIN bleu_by USING (row_id, pair)""",
)
def strategy_pairs(spark, sf):
    return _strategy_scores(spark, sf, ("rouge1", "rouge2", "bleu4"))


@query("strategy_pairs_lcs")  # SQL is too slow for two whole texts; tested by brute force
def strategy_pairs_lcs(spark, sf):
    return _strategy_scores(spark, sf, ("rougeL",))


def _strategy_scores(spark, sf, metrics):
    kinds = [m for m in metrics if m in scores.ROUGE_KINDS]
    rows = prediction_rows(spark, sf, systems=("adapter",))
    table = cross_comparison(rows, stemmed=False, rounded=False, kinds=kinds)
    return table.select("row_id", "pair", *[F.round(c, DIGITS).alias(c) for c in metrics])




def _new_words(prediction: str, reference: str) -> tuple[int, int]:
    said = set(prediction.split())
    return len(said - set(reference.split())), len(said)


def _length_ratio(prediction: str, reference: str) -> float:
    return len(prediction) / max(len(reference), 1)


_LONGEST = metrics.PairMetric(
    "longest", lambda: 0, lambda s, p, r: max([s, *map(len, p)]), max, float
)
OWN_METRICS = (
    metrics.ratio_of("new_words", _new_words), metrics.mean_of("length_ratio", _length_ratio), _LONGEST,
)


@query(
    "own_metrics",
    f"""WITH {PREDICTIONS}, said AS (
          SELECT system, strategy, prediction, reference,
                 list_distinct({word_list("prediction")}) AS p, list_distinct({word_list("reference")}) AS r
          FROM predictions),
        scored AS (
          SELECT system, strategy,
                 sum(len(list_filter(p, lambda w: NOT list_contains(r, w)))) / sum(len(p)) AS new_words,
                 avg(length(prediction) / greatest(length(reference), 1)) AS length_ratio,
                 CAST(max(length(prediction)) AS DOUBLE) AS longest
          FROM said GROUP BY ALL),
        long AS (UNPIVOT scored ON new_words, length_ratio, longest INTO NAME metric VALUE value)
        SELECT b.strategy, b.metric, round(b.value, {DIGITS}) AS base, round(a.value, {DIGITS}) AS adapter,
               round(a.value - b.value, {DIGITS}) AS delta,
               CASE WHEN a.value = b.value THEN 'tie'
                    WHEN (a.value > b.value) = (b.metric <> 'new_words') THEN 'adapter' ELSE 'base' END
                 AS winner
        FROM long b JOIN long a ON a.strategy = b.strategy AND a.metric = b.metric
          AND b.system = 'base' AND a.system = 'adapter'""",
)
def own_metrics(spark, sf):
    table = metrics.pair_metrics(predictions(spark, sf), BY, OWN_METRICS)
    compared = scores.compare_systems(
        table, ["strategy", "metric"], lower_is_better=("new_words",)
    )
    return compared.select(
        "strategy", "metric", *[F.round(c, DIGITS).alias(c) for c in ("base", "adapter", "delta")], "winner"
    )
