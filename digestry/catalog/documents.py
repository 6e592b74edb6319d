"""Chunking, sentence ranking, summarization strategies and end-to-end evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestry.catalog.registry import query
from digestry.catalog.scoring import BY, DIGITS, IDS, compare_sql, score_ctes
from digestry.catalog.views import PAIRS, dealt_pairs, pairs, table, wc, word_list
from digestry.functions import prompts, text, tokens
from digestry.operators import chunks, rank, scores, summarize
from digestry.plans import evaluate
from digestry.session import stored, work_path
from digestry.sources import results

# A small context, so that the long-document strategies run on the documents at hand.
CONTEXT, MAX_SEQUENCE, MIN_SUMMARY, MAX_SUMMARY = 160, 1024, 14, 48
LEADS = {"base": 5, "adapter": 15}
#: Words of each chunk after the first, as ``summarize.gathered`` takes them.
SECTION = 2
#: Longer summaries: a quarter as many words of each chunk after the first.
LONG_LEADS = {"base": 30, "adapter": 40}
LONG_SECTION = "(n // 4)"
OVERHEAD = tokens.WORDS.count_text(prompts.SUMMARIZE.text(""))
ROOM = CONTEXT - OVERHEAD - MAX_SUMMARY
SIZE, OVERLAP = tokens.chunk_budget(CONTEXT, MAX_SEQUENCE, MAX_SUMMARY)
OPTIONS = dict(
    context=CONTEXT,
    max_sequence=MAX_SEQUENCE,
    min_summary=MIN_SUMMARY,
    max_summary=MAX_SUMMARY,
    boundary="none",
    tokenizer=tokens.CLEAN_WORDS,
)


# ---- SQL building blocks ------------------------------------------------------------------------


def chunk_ctes(src: str, column: str, tag: str) -> str:
    """``chunked_tag``: row_id and the list of fixed-width chunks."""
    return f"""
sized_{tag} AS (
  SELECT row_id, body, CAST(floor({SIZE} * cpt) AS BIGINT) AS size,
         CAST(floor({OVERLAP} * cpt) AS BIGINT) AS overlap FROM (
    SELECT row_id, {column} AS body,
           CASE WHEN {column} = '' THEN 4.0::DOUBLE
                ELSE greatest(1.0::DOUBLE, length({column}) / {wc(column)}) END AS cpt
    FROM {src})),
chunked_{tag} AS (
  SELECT row_id, list_filter(list_transform(
      range(0, 1 + CAST(greatest(ceil((length(body) - size) / greatest(size - overlap, 1)), 0) AS BIGINT)),
      lambda i: substring(body, i * greatest(size - overlap, 1) + 1, size)),
      lambda c: trim(c) <> '') AS chunks
  FROM sized_{tag})"""


def lead_sql(body: str, count: str) -> str:
    """``count`` words that lie evenly over the text."""
    w = word_list(body)
    k = f"least({count}, len({w}))"
    places = f"list_transform(range({k}), lambda i: i * len({w}) // greatest({k}, 1) + 1)"
    return f"array_to_string(list_select({w}, {places}), ' ')"


def lead_count(n: str, least: str) -> str:
    return f"least(greatest({n}, {least}), {MAX_SUMMARY})"


def fold_ctes(tag: str, leads: str = "leads", section: str | int = SECTION) -> str:
    """``folded_tag``: row_id, system, summary. Needs ``chunked_tag`` and ``leads(system, n)``.

    The first chunk gives its words that lie evenly, each later one a few more, the last one as many as
    the minimum still asks for.
    """
    count = f"CASE WHEN pos = parts AND pos > 1 THEN greatest(k, {MIN_SUMMARY} - before) ELSE k END"
    return f"""
opened_{tag} AS (
  SELECT row_id, system, pos, parts, chunk, len({word_list("chunk")}) AS words,
         CASE WHEN pos = 1 THEN {lead_count("n", "0")} ELSE {section} END AS k
  FROM (SELECT row_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS pos,
               len(chunks) AS parts FROM chunked_{tag}), {leads}),
held_{tag} AS (
  SELECT *, CAST(coalesce(sum(least(k, words)) OVER (
             PARTITION BY row_id, system ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM opened_{tag}),
folded_{tag} AS (
  SELECT row_id, system, string_agg({lead_sql("chunk", count)}, ' ' ORDER BY pos) AS summary
  FROM held_{tag} GROUP BY row_id, system)"""


def tree_ctes(tag: str, leads: str = "leads") -> str:
    """``merged_tag``: row_id, system, summary; each merge stands in brackets."""
    return f"""
tree_{tag} AS (
  SELECT row_id, system, CAST(pos AS BIGINT) AS pos, CAST(parts AS BIGINT) AS parts,
         {lead_sql("chunk", lead_count("n", "0"))} AS s
  FROM (SELECT row_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS pos,
               len(chunks) AS parts FROM chunked_{tag}), {leads}
  UNION ALL
  SELECT row_id, system, pos, (parts + 1) // 2,
         '[ ' || array_to_string({word_list("joined")}, ' ') || ' ]' FROM (
    SELECT row_id, system, pos // 2 AS pos, parts,
           string_agg(s, chr(10) || chr(10) ORDER BY pos) AS joined
    FROM tree_{tag} WHERE parts > 1 GROUP BY row_id, system, pos // 2, parts)),
merged_{tag} AS (SELECT row_id, system, s AS summary FROM tree_{tag} WHERE parts = 1)"""


def leads_sql(leads: dict[str, int]) -> str:
    return "leads(system, n) AS (VALUES " + ", ".join(f"('{s}', {n})" for s, n in leads.items()) + ")"


def long_summarizers() -> dict[str, summarize.Summarizer]:
    return {s: summarize.gathered(n, n // 4) for s, n in LONG_LEADS.items()}


LEADS_SQL = leads_sql(LEADS)
ONE_LEAD = f"leads(system, n) AS (VALUES ('base', {LEADS['base']}))"

INCIDENCE = rf"""
sentence AS (
  SELECT row_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM (
    SELECT row_id, list_filter(string_split(
      regexp_replace(document, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: s <> '') AS ss
    FROM pairs)),
lined AS (
  SELECT *, regexp_extract_all(lower(s), '\p{{L}}+(?:[''-]\p{{L}}+)*') AS ws FROM sentence),
incidence AS (
  SELECT row_id, i, w, length, count(*) AS c FROM (
    SELECT row_id, i, unnest(ws) AS w, len(ws) AS length FROM lined) GROUP BY ALL)"""

WALK = f"""{INCIDENCE},
mass0 AS (SELECT row_id, w, length AS other, sum(c) AS m FROM incidence GROUP BY ALL),
degree AS (
  SELECT a.row_id, a.i, sum(a.c * b.m / CASE WHEN a.length = 1 AND b.other = 1 THEN 1.0
           ELSE ln(a.length) + ln(b.other) END) AS deg
  FROM incidence a JOIN mass0 b USING (row_id, w) GROUP BY a.row_id, a.i),
node AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id) AS n,
         coalesce(deg, 0.0) + 1e-7 AS deg
  FROM sentence LEFT JOIN degree USING (row_id, i)),
walk AS (
  SELECT 0 AS t, row_id, i, n, deg, 1.0::DOUBLE / n AS r, false AS settled FROM node
  UNION ALL
  SELECT t, row_id, i, n, deg, following,
         sqrt(sum((following - r) * (following - r)) OVER (PARTITION BY row_id)) <= 1e-4
  FROM (
    SELECT k.t + 1 AS t, k.row_id, k.i, k.n, k.deg, k.r,
           (1 - 0.85::DOUBLE) / k.n + 0.85::DOUBLE * coalesce(x.v, 0.0) AS following
    FROM walk k LEFT JOIN (
      SELECT a.row_id, a.i, sum(a.c * b.m / CASE WHEN a.length = 1 AND b.other = 1 THEN 1.0
               ELSE ln(a.length) + ln(b.other) END) AS v
      FROM incidence a JOIN (
        SELECT e.row_id, e.w, e.length AS other, sum(e.c * k2.r / k2.deg) AS m
        FROM incidence e JOIN walk k2 ON k2.row_id = e.row_id AND k2.i = e.i
        GROUP BY e.row_id, e.w, e.length) b ON a.row_id = b.row_id AND a.w = b.w
      GROUP BY a.row_id, a.i) x ON x.row_id = k.row_id AND x.i = k.i
    WHERE NOT k.settled AND k.t < 62)),
ranked AS (
  SELECT row_id, i, n, r FROM walk WHERE settled OR t = 62),
best AS (
  SELECT row_id, i, r, s FROM ranked JOIN sentence USING (row_id, i)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(r, 10) DESC, i)
          <= greatest(5, n // 4)),
extracts AS (
  SELECT row_id, string_agg(s, ' ' ORDER BY i) AS extracted FROM best GROUP BY row_id)"""


def direct_sql(body: str) -> str:
    return lead_sql(body, lead_count("n", str(MIN_SUMMARY)))


_NAMES = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(summarize.STRATEGIES))


def strategy_ctes(section: str | int = SECTION) -> str:
    return f"""{WALK}, {chunk_ctes("pairs", "document", "doc")},
{chunk_ctes("extracts", "extracted", "ext")},
{fold_ctes("doc", section=section)}, {tree_ctes("doc")}, {fold_ctes("ext", section=section)},
generated AS MATERIALIZED (
  SELECT p.row_id, l.system, CASE k.rank {_NAMES} END AS strategy, k.rank AS strategy_rank,
         p.summary AS reference, p.document,
         CASE WHEN {wc("p.document")} <= {ROOM} THEN '{summarize.DIRECT}'
              ELSE CASE k.rank {_NAMES} END END AS route,
         CASE WHEN {wc("p.document")} <= {ROOM} THEN {direct_sql("p.document")}
              WHEN k.rank = 0 THEN f.summary WHEN k.rank = 1 THEN m.summary
              WHEN {wc("x.extracted")} <= {ROOM} THEN {direct_sql("x.extracted")}
              ELSE g.summary END AS prediction
  FROM pairs p CROSS JOIN leads l CROSS JOIN (VALUES (0), (1), (2)) k(rank)
  LEFT JOIN folded_doc f ON f.row_id = p.row_id AND f.system = l.system
  LEFT JOIN merged_doc m ON m.row_id = p.row_id AND m.system = l.system
  LEFT JOIN folded_ext g ON g.row_id = p.row_id AND g.system = l.system
  LEFT JOIN extracts x ON x.row_id = p.row_id)"""


STRATEGY_CTES = strategy_ctes()


# ---- queries ------------------------------------------------------------------------------------


@query(
    "fits_context",
    f"""WITH {PAIRS} SELECT row_id, {wc("document")} AS n_tokens,
          {wc("document")} <= {ROOM} AS fits FROM pairs""",
)
def fits_context(spark, sf):
    n = tokens.CLEAN_WORDS.count(F.col("document"))
    return pairs(spark, sf).select(
        "row_id", n.alias("n_tokens"), tokens.fits(n, CONTEXT, MAX_SUMMARY).alias("fits")
    )


def chunked(spark, sf, boundary="none"):
    return chunks.with_chunks(
        pairs(spark, sf), SIZE, OVERLAP, boundary, tokenizer=tokens.CLEAN_WORDS
    )


@query(
    "chunk_chars",
    f"""WITH {PAIRS}, {chunk_ctes("pairs", "document", "doc")}
        SELECT row_id, unnest(chunks) AS chunk,
               CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS pos FROM chunked_doc""",
)
def chunk_chars(spark, sf):
    return chunks.explode_chunks(chunked(spark, sf), ["row_id"]).select("row_id", "pos", "chunk")


@query("chunk_words")
def chunk_words(spark, sf):
    return chunks.explode_chunks(chunked(spark, sf, "word"), ["row_id"]).select("row_id", "pos", "chunk")


@query(
    "last_chunk",
    f"""WITH {PAIRS}, {chunk_ctes("pairs", "document", "doc")}
        SELECT row_id, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS pos,
               generate_subscripts(chunks, 1) = len(chunks) AS is_last FROM chunked_doc""",
)
def last_chunk(spark, sf):
    return chunks.explode_chunks(chunked(spark, sf), ["row_id"]).select("row_id", "pos", "is_last")


@query(
    "token_windows",
    f"""WITH {PAIRS}, listed AS (SELECT row_id, {word_list("document")} AS w FROM pairs),
        opened AS (SELECT row_id, w, unnest(range(0, len(w), {SIZE - OVERLAP})) AS start FROM listed)
        SELECT row_id, CAST(start // {SIZE - OVERLAP} AS INTEGER) AS pos,
               array_to_string(list_slice(w, start + 1, start + {SIZE}), ' ') AS chunk FROM opened""",
)
def token_windows(spark, sf):
    windows = chunks.token_windows(F.col("document"), SIZE, OVERLAP, normalized=True)
    rows = pairs(spark, sf).select("row_id", windows.alias("chunks"))
    return chunks.explode_chunks(rows, ["row_id"]).select("row_id", "pos", "chunk")


@query(
    "sentence_degrees",
    f"""WITH {PAIRS}, {INCIDENCE}
        SELECT a.row_id, CAST(a.i AS INTEGER) AS i, round(sum(a.c * b.c / CASE
                 WHEN a.length = 1 AND b.length = 1 THEN 1.0
                 ELSE ln(a.length) + ln(b.length) END), {DIGITS}) AS degree
        FROM incidence a JOIN incidence b USING (row_id, w) GROUP BY a.row_id, a.i""",
)
def sentence_degrees(spark, sf):
    listed = rank.with_sentences(pairs(spark, sf))
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"))
    return rank.sentence_degrees(listed, "row_id", ids).select(
        "row_id", "i", F.round("value", DIGITS).alias("degree")
    )


@query(
    "textrank_topk",
    f"""WITH RECURSIVE {PAIRS}, {WALK}
        SELECT row_id, CAST(i AS INTEGER) AS pos, s AS sentence, round(r, 8) AS rank FROM best""",
)
def textrank_topk(spark, sf):
    ranked = rank.textrank(pairs(spark, sf), "row_id")
    rows = ranked.select("row_id", F.explode_outer("extract").alias("e")).where("e is not null")
    return rows.select("row_id", "e.pos", "e.sentence", F.round("e.rank", 8).alias("rank"))


@query(
    "route_documents",
    f"""WITH {PAIRS} SELECT row_id, s AS strategy,
          CASE WHEN {wc("document")} <= {ROOM} THEN '{summarize.DIRECT}' ELSE s END AS route
        FROM pairs, (VALUES {", ".join(f"('{s}')" for s in summarize.STRATEGIES)}) v(s)""",
)
def route_documents(spark, sf):
    n = tokens.CLEAN_WORDS.count(F.col("document"))
    fan = F.explode(F.array(*[F.lit(s) for s in summarize.STRATEGIES]))
    return (
        pairs(spark, sf)
        .select("row_id", n.alias("n"), fan.alias("strategy"))
        .select(
            "row_id",
            "strategy",
            summarize.route(F.col("n"), F.col("strategy"), CONTEXT, MAX_SUMMARY).alias("route"),
        )
    )


@query(
    "map_refine_lead",
    f"""WITH RECURSIVE {PAIRS}, {ONE_LEAD}, {chunk_ctes("pairs", "document", "doc")},
        {fold_ctes("doc")} SELECT row_id, summary FROM folded_doc""",
)
def map_refine_lead(spark, sf):
    cut = chunked(spark, sf)
    folded = summarize.refine(
        F.col("chunks"), summarize.gathered(LEADS["base"], SECTION), MIN_SUMMARY, MAX_SUMMARY
    )
    return cut.select("row_id", folded.alias("summary"))


_MERGED = f"""WITH RECURSIVE {PAIRS}, {ONE_LEAD}, {chunk_ctes("pairs", "document", "doc")},
        {tree_ctes("doc")} SELECT row_id, summary FROM merged_doc"""


@query("hier_merge_lead", _MERGED)
def hier_merge_lead(spark, sf):
    cut = chunked(spark, sf)
    merged = summarize.merge_tree(
        F.col("chunks"), summarize.gathered(LEADS["base"], SECTION), MIN_SUMMARY, MAX_SUMMARY
    )
    return cut.select("row_id", merged.alias("summary"))


@query("hier_merge_rounds", _MERGED)
def hier_merge_rounds(spark, sf):
    cut = chunked(spark, sf)
    return summarize.merge_by_rounds(
        chunks.explode_chunks(cut, ["row_id"]),
        "row_id",
        summarize.gathered(LEADS["base"], SECTION),
        MIN_SUMMARY,
        MAX_SUMMARY,
    )


def opening_words(asked: list[str], least: int, most: int) -> list[str]:
    """A model that reads its prompts: the first words of a document, or the summary so far with the first
    words of the new section."""
    answers = []
    for prompt in asked:
        template = prompts.REFINE if prompt.startswith(prompts.REFINE.parts[0]) else prompts.SUMMARIZE
        body = prompt[len(template.parts[0]) : -len(template.parts[-1])]
        if template is prompts.SUMMARIZE:
            answers.append(" ".join(body.split()[: LEADS["base"]]))
        else:
            existing, section = body.split(template.parts[1], 1)
            answers.append(" ".join([existing, *section.split()[:SECTION]]))
    return answers


@query(
    "model_plugin",
    f"""WITH {PAIRS}, {chunk_ctes("pairs", "document", "doc")}, parts AS (
          SELECT row_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS pos FROM chunked_doc),
        folded AS (
          SELECT row_id, string_agg(array_to_string(list_slice({word_list("chunk")}, 1,
                   CASE WHEN pos = 1 THEN {LEADS["base"]} ELSE {SECTION} END), ' '), ' ' ORDER BY pos)
                   AS summary FROM parts GROUP BY row_id)
        SELECT row_id, CASE WHEN {wc("document")} <= {ROOM}
                 THEN array_to_string(list_slice({word_list("document")}, 1, {LEADS["base"]}), ' ')
                 ELSE folded.summary END AS summary
        FROM pairs LEFT JOIN folded USING (row_id)""",
)
def model_plugin(spark, sf):
    staged = summarize.stage(
        pairs(spark, sf), "row_id", ("map-refine",), CONTEXT, MAX_SEQUENCE, MAX_SUMMARY, "none",
        tokens.CLEAN_WORDS,
    )
    return summarize.summarize_batches(
        staged, "row_id", opening_words, "map-refine", CONTEXT, MIN_SUMMARY, MAX_SUMMARY,
        tokens.CLEAN_WORDS, live=16,
    )


@query(
    "extract_abstract",
    f"""WITH RECURSIVE {PAIRS}, {leads_sql(LONG_LEADS)}, {strategy_ctes(LONG_SECTION)}
        SELECT row_id, route, prediction AS summary FROM generated
        WHERE strategy_rank = 2 AND system = 'base'""",
)
def extract_abstract(spark, sf):
    rows = summarize.summarize(
        dealt_pairs(spark, sf).select("row_id", "document"),
        "row_id",
        long_summarizers()["base"],
        ("extract-abstract",),
        **OPTIONS,
    )
    return rows.select("row_id", "route", "summary")


@query(
    "gen_record",
    f"""WITH RECURSIVE {PAIRS}, {ONE_LEAD}, {STRATEGY_CTES}
        SELECT row_id, strategy, prediction AS summary, 'gathered-5' AS model,
               {wc("document")} AS tokens_in, len({word_list("prediction")}) AS tokens_out
        FROM generated""",
)
def gen_record(spark, sf):
    rows = summarize.summarize(
        pairs(spark, sf).select("row_id", "document"),
        "row_id",
        summarize.gathered(LEADS["base"], SECTION),
        **OPTIONS,
    )
    named = rows.withColumn("path", F.lit("models/gathered-5"))
    records = summarize.generation_record(named, "gathered-5")
    return records.select(
        "row_id",
        "strategy",
        "summary",
        text.short_name(F.col("path")).alias("model"),
        "metadata.tokens_in",
        "metadata.tokens_out",
    )


@query(
    "strategy_predictions",
    f"""WITH RECURSIVE {PAIRS}, {LEADS_SQL}, {STRATEGY_CTES}
        SELECT row_id, system, strategy, route, prediction FROM generated""",
)
def strategy_predictions(spark, sf):
    rows = evaluate.predictions(
        dealt_pairs(spark, sf), {s: summarize.gathered(n, SECTION) for s, n in LEADS.items()}, **OPTIONS
    )
    return rows.select("row_id", "system", "strategy", "route", "prediction")


_EVALUATED = f"""WITH RECURSIVE {PAIRS}, {LEADS_SQL}, {STRATEGY_CTES},
        {score_ctes("generated", IDS, BY, "p")}"""


@query("evaluate_all", f"{_EVALUATED}, {compare_sql()}")
def evaluate_all(spark, sf):
    compared = evaluate.evaluate_and_compare(
        dealt_pairs(spark, sf),
        {s: summarize.gathered(n, SECTION) for s, n in LEADS.items()},
        stemmed=False,
        **OPTIONS,
    )
    return compared.withColumn("delta", F.round("delta", DIGITS))


@query(
    "result_table",
    f"""{_EVALUATED} SELECT strategy, system, metric, value FROM (
        UNPIVOT scored ON rouge1, rouge2, rougeL, bleu4 INTO NAME metric VALUE value)""",
)
def result_table(spark, sf):
    """Scores saved strategy by strategy, as they finish, and read back."""
    out = work_path(spark, "scores")
    rows = stored(dealt_pairs(spark, sf), "pairs")
    for strategy in summarize.STRATEGIES:
        table = evaluate.evaluate(
            rows,
            {s: summarize.gathered(n, SECTION) for s, n in LEADS.items()},
            stemmed=False,
            strategies=(strategy,),
            **OPTIONS,
        )
        results.append_scores(table, out)
    return spark.read.parquet(out).select("strategy", "system", "metric", "value")


@query(
    "result_json",
    f"""WITH RECURSIVE {PAIRS}, {leads_sql(LONG_LEADS)}, {strategy_ctes(LONG_SECTION)},
        {score_ctes("generated", IDS, BY, whole=True)} SELECT strategy, system, metric, value FROM (
        UNPIVOT scored ON rouge1, rouge2, rougeL, bleu4 INTO NAME metric VALUE value)""",
)
def result_json(spark, sf):
    """The nested export, written and parsed back."""
    table = scores.score(
        evaluate.predictions(dealt_pairs(spark, sf), long_summarizers(), **OPTIONS),
        BY,
        stemmed=False,
    )
    out = work_path(spark, "json")
    results.write_json(scores.long_scores(table, BY), out)
    nested = F.from_json("value", "map<string,map<string,map<string,double>>>")
    return (
        spark.read.text(out)
        .select(F.explode(nested).alias("strategy", "s"))
        .select("strategy", F.explode("s").alias("system", "m"))
        .select("strategy", "system", F.explode("m").alias("metric", "value"))
    )
