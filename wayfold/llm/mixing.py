"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A tree domain - language - source carries a token budget. At each level the children of a
node share its budget by weight, none above what it can supply; what a child cannot supply
goes to its siblings by their weights, and reaches the parent's siblings only when the whole
family is exhausted (the parent's own limit is the sum of its children's). Each leaf then
takes whole epochs of its documents and, of the last one, the prefix of a seeded order whose
running token count stays within the leaf's budget.

Tokens are runs of characters that are not white space; a null or empty text has none and
costs nothing; texts of any length are counted whole. A null language or source is the name ''.
Weights are positive whole numbers; names without one have the weight 1. Repeated rows are
separate rows of the leaf; equal ones (same id) stay or go together. Ties in a leaf's seeded
order go by the id. An empty table gives an empty result. Extra columns stay; a column named
like one of those that mix() adds is replaced by it there, and returned as it was by mixed().

Domains and languages share by one window over a family. Sources may be as many as there are
hosts, so they share by rounds of aggregates over the leaves: what the full ones leave is
divided again until no other is full. No task sorts a family of sources.

The running count is built from sums per (leaf, epoch, slot) and a window inside each slot
only, slots being summed in two steps; slots are equal ranges of the seeded hash, so a leaf with
a third of all rows is spread over all of them and no task holds a leaf, nor all its slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import checkpoints, fresh, table

SEED = 17
#: The budget, as hundredths of the tokens there are.
BUDGET_PERCENT = 60
#: How often a document may be repeated at most.
MAX_EPOCHS = 2
#: Hexadecimal digits of the seeded hash that make a slot.
SLOT_DIGITS = 3
NAME = ["mix_domain", "mix_lang", "mix_source"]
ADDED = [*NAME, "mix_epoch", "mix_tokens", "mix_before"]
#: A leaf's documents meet its budget in so many shares.
SALTS = 64
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
DOMAINS = ("web", "books", "code")
WORD = "[^\\x20\\x09-\\x0D]+"


def domain_of(source: F.Column) -> F.Column:
    """The domain of a source: by the first hexadecimal digit of its MD5, in thirds."""
    digit = F.conv(F.substring(F.md5(source), 1, 1), 16, 10).cast("int")
    return F.when(digit < 6, DOMAINS[0]).when(digit < 11, DOMAINS[1]).otherwise(DOMAINS[2])


def _weight(column: str, weights: dict[str, int]) -> F.Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, weight).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str, weight: F.Column) -> DataFrame:
    """Divide column budget of a family (parent) among its children, each capped by column cap.

    With children in ascending order of cap/weight, child k is filled up if and only if
    cap_k * W_k <= w_k * B_k, where B_k and W_k are the budget and the weight that its
    predecessors leave. The rest share what remains by weight, rounded down.
    """
    key = [F.col(c) for c in parent]
    order = W.partitionBy(*key).orderBy(F.col("cap") / F.col("w"), F.col(name))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    family = W.partitionBy(*key)
    walk = nodes.withColumn("w", weight).withColumn("left_w", F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    walk = walk.withColumn("left_b", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    walk = walk.withColumn("full", F.col("cap").cast("double") * F.col("left_w") <= F.col("w").cast("double") * F.col("left_b"))
    rest_b = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))
    rest_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(family)
    walk = walk.withColumn("rest_b", rest_b).withColumn("rest_w", rest_w)
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("rest_b").cast("double") * F.col("w") / F.col("rest_w")).cast("long"))
    return walk.withColumn("given", given).drop("w", "left_w", "left_b", "full", "rest_b", "rest_w")


def _fill(nodes: DataFrame, parent: list[str], weight: F.Column) -> DataFrame:
    """As _share(), for families of any size: rounds over what the full children leave to the others.

    Each round but the last finds more full children, and takes two narrow aggregates.
    """
    nodes = nodes.withColumn("w", weight).checkpoint()
    full = F.col("cap").cast("double") * F.col("rest_w") <= F.col("w").cast("double") * F.col("rest_b")
    state = nodes.groupBy(*parent).agg(F.max("budget").alias("rest_b"), F.sum("w").alias("rest_w"))
    last = None
    while True:
        spent, used = (F.coalesce(F.sum(F.when(full, F.col(c))), F.lit(0)) for c in ("cap", "w"))
        state = nodes.join(state, parent).groupBy(*parent).agg((F.max("budget") - spent).alias("rest_b"), (F.sum("w") - used).alias("rest_w")).checkpoint()
        left = state.agg(F.sum("rest_w")).first()[0]
        if left == last:
            break
        last = left
    given = F.when(full, F.col("cap")).otherwise(F.floor(F.col("rest_b").cast("double") * F.col("w") / F.col("rest_w")).cast("long"))
    return nodes.join(state, parent).withColumn("given", given).drop("w", "rest_b", "rest_w")


def budgets(leaves: DataFrame, percent: int, epochs: int, domain_weights: dict, lang_weights: dict, source_weights: dict) -> DataFrame:
    """leaves (mix_domain, mix_lang, mix_source, supply) with column budget, in tokens."""
    leaves = leaves.withColumn("cap", F.col("supply") * epochs).checkpoint()
    langs = leaves.groupBy("mix_domain", "mix_lang").agg(F.sum("cap").alias("cap"))
    domains = leaves.groupBy("mix_domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    domains = domains.withColumn("budget", F.floor(F.sum("supply").over(W.partitionBy()) * percent / 100).cast("long"))
    domains = _share(domains, [], "mix_domain", _weight("mix_domain", domain_weights)).select("mix_domain", F.col("given").alias("budget"))
    langs = _share(langs.join(domains, "mix_domain"), ["mix_domain"], "mix_lang", _weight("mix_lang", lang_weights)).select("mix_domain", "mix_lang", F.col("given").alias("budget"))
    return _fill(leaves.join(langs, ["mix_domain", "mix_lang"]), ["mix_domain", "mix_lang"], _weight("mix_source", source_weights)).select(*NAME, "supply", F.col("given").alias("budget"))


def _named(docs: DataFrame) -> DataFrame:
    """docs with the columns that name a row's leaf."""
    names = {"mix_lang": F.coalesce(F.col("lang"), F.lit("")), "mix_source": F.coalesce(F.col("source"), F.lit(""))}
    return docs.drop(*ADDED).withColumns(names).withColumn("mix_domain", domain_of(F.col("mix_source")))


def _tokens() -> F.Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _thin(docs: DataFrame) -> DataFrame:
    """doc_id, leaf and tokens of every row: the words are counted once, and only this is summed and ordered."""
    checkpoints(docs.sparkSession)
    return _named(docs).select("doc_id", *NAME, _tokens().alias("mix_tokens")).checkpoint()


def _choose(thin: DataFrame, percent: int, epochs: int, seed: int, domain_weights: dict, lang_weights: dict, source_weights: dict | None) -> DataFrame:
    """doc_id and leaf of what is chosen, with mix_epoch and mix_before."""
    leaves = thin.groupBy(*NAME).agg(F.sum("mix_tokens").alias("supply"))
    planned = budgets(leaves, percent, epochs, domain_weights, lang_weights, source_weights or {})
    planned = planned.withColumn("whole", F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(F.lit(epochs)).cast("int"))
    planned = planned.withColumn("rest", F.col("budget") - F.col("whole") * F.col("supply"))
    # Whole epochs take every document; the epoch after them takes a prefix.
    laps = planned.select(*NAME, "whole", "rest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).select(
        *NAME, "whole", "rest", "salt", F.explode(F.sequence(F.lit(0), F.least(F.col("whole"), F.lit(epochs - 1)))).alias("mix_epoch")
    )
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col("mix_epoch").cast("string"), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    each = thin.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(laps, [*NAME, "salt"]).withColumn("order", key).withColumn("slot", F.substring("order", 1, SLOT_DIGITS))
    # Equal ids count as one unit, so that equal rows stay or go together.
    leaf = [*NAME, "mix_epoch"]
    units = each.groupBy(*leaf, "whole", "rest", "slot", "order", "doc_id").agg(F.sum("mix_tokens").alias("unit"))
    slots = units.groupBy(*leaf, "slot").agg(F.sum("unit").alias("tokens")).withColumn("range", F.substring("slot", 1, 1))
    ranges = slots.groupBy(*leaf, "range").agg(F.sum("tokens").alias("range_tokens"))
    up_to = lambda column, key, by: F.sum(column).over(W.partitionBy(*key).orderBy(by)) - F.col(column)
    base = slots.withColumn("in_range", up_to("tokens", [*leaf, "range"], "slot")).join(ranges.withColumn("before", up_to("range_tokens", leaf, "range")), [*leaf, "range"])
    base = base.select(*leaf, "slot", (F.col("before") + F.col("in_range")).alias("base"))
    running = F.sum("unit").over(W.partitionBy(*leaf, "slot").orderBy("order", F.col("doc_id").asc_nulls_last()))
    placed = units.join(base, [*leaf, "slot"]).withColumn("mix_before", F.col("base") + running - F.col("unit"))
    chosen = placed.where((F.col("mix_epoch") < F.col("whole")) | (F.col("mix_before") + F.col("unit") <= F.col("rest")))
    return chosen.select("doc_id", *leaf, "mix_before")


def _taken(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows (with their leaf) that are chosen, with mix_epoch and mix_before."""
    mine = {c: fresh(rows.columns, f"{c}_of") for c in ["doc_id", *NAME]}
    chosen = chosen.withColumnsRenamed(mine)
    match = F.col("doc_id").eqNullSafe(F.col(mine["doc_id"]))
    for c in NAME:
        match = match & (F.col(c) == F.col(mine[c]))
    return rows.join(chosen, match).drop(*mine.values())


def mix(
    docs: DataFrame,
    percent: int = BUDGET_PERCENT,
    epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    domain_weights: dict = DOMAIN_WEIGHTS,
    lang_weights: dict = LANG_WEIGHTS,
    source_weights: dict | None = None,
) -> DataFrame:
    """The chosen rows of docs, with mix_domain, mix_lang, mix_source, mix_epoch, mix_tokens, mix_before.

    mix_before is the number of tokens chosen before the row in its leaf's epoch.
    """
    chosen = _choose(_thin(docs), percent, epochs, seed, domain_weights, lang_weights, source_weights)
    return _taken(_named(docs).withColumn("mix_tokens", _tokens()), chosen)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The chosen rows with the columns of docs only, as they were."""
    kept, names = {}, list(docs.columns)
    for c in [c for c in docs.columns if c.lower() in ADDED]:
        kept[c] = fresh(names, "own_" + c)
        names.append(kept[c])
    out = mix(docs.withColumnsRenamed(kept), **options)
    return out.select(*[F.col(f"`{kept.get(c, c)}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = _thin(table(spark, sf_dir, "documents"))
    chosen = _choose(thin, BUDGET_PERCENT, MAX_EPOCHS, SEED, DOMAIN_WEIGHTS, LANG_WEIGHTS, None)
    return _taken(thin, chosen).select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_epoch", "mix_tokens", "mix_before")


def oracle(percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS, seed: int = SEED, table: str = "documents", tail: str = "") -> str:
    """DuckDB SQL with the same rows as query() (or, given a tail, what the tail makes of them)."""
    case = lambda col, ws: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in ws.items()) + " ELSE 1 END"

    def share(cte: str, source: str, parent: str, name: str, weight: str, keep: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        return f"""
{cte}_1 AS (SELECT *, CAST({weight} AS BIGINT) AS w FROM {source}),
{cte}_2 AS (SELECT *, CAST(sum(w) OVER ({part}) - coalesce(sum(w) OVER ({part} ORDER BY CAST(cap AS DOUBLE) / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS left_w,
  CAST(budget - coalesce(sum(cap) OVER ({part} ORDER BY CAST(cap AS DOUBLE) / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS left_b FROM {cte}_1),
{cte}_3 AS (SELECT *, CAST(cap AS DOUBLE) * left_w <= CAST(w AS DOUBLE) * left_b AS is_full FROM {cte}_2),
{cte}_4 AS (SELECT *, CAST(budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS DOUBLE) AS rest_b, CAST(sum(CASE WHEN NOT is_full THEN w END) OVER ({part}) AS DOUBLE) AS rest_w FROM {cte}_3),
{cte} AS (SELECT {keep}, CASE WHEN is_full THEN cap ELSE CAST(floor(rest_b * w / rest_w) AS BIGINT) END AS budget FROM {cte}_4)"""

    return rf"""
WITH mix_rows AS (
  SELECT d.*, coalesce(lang, '') AS mix_lang, coalesce(source, '') AS mix_source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS mix_tokens,
         CASE WHEN instr('012345', left(md5(coalesce(source, '')), 1)) > 0 THEN '{DOMAINS[0]}'
              WHEN instr('6789a', left(md5(coalesce(source, '')), 1)) > 0 THEN '{DOMAINS[1]}' ELSE '{DOMAINS[2]}' END AS mix_domain
  FROM {table} d
), leaves AS (SELECT mix_domain, mix_lang, mix_source, CAST(sum(mix_tokens) AS BIGINT) AS supply, CAST(sum(mix_tokens) * {epochs} AS BIGINT) AS cap FROM mix_rows GROUP BY ALL
), d_in AS (SELECT mix_domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(floor(sum(supply) * {percent} / 100) AS BIGINT) FROM leaves) AS budget FROM leaves GROUP BY ALL
), {share('d_out', 'd_in', '', 'mix_domain', case('mix_domain', DOMAIN_WEIGHTS), 'mix_domain')}
, l_in AS (SELECT mix_domain, mix_lang, CAST(sum(cap) AS BIGINT) AS cap, any_value(budget) AS budget FROM leaves JOIN d_out USING (mix_domain) GROUP BY ALL
), {share('l_out', 'l_in', 'mix_domain', 'mix_lang', case('mix_lang', LANG_WEIGHTS), 'mix_domain, mix_lang')}
, s_in AS (SELECT leaves.*, budget FROM leaves JOIN l_out USING (mix_domain, mix_lang)
), {share('s_out', 's_in', 'mix_domain, mix_lang', 'mix_source', '1', 'mix_domain, mix_lang, mix_source, supply')}
, planned AS (SELECT *, CAST(CASE WHEN supply > 0 THEN budget // supply ELSE {epochs} END AS INTEGER) AS whole FROM s_out
), laps AS (SELECT planned.*, budget - whole * supply AS rest, CAST(e.e AS INTEGER) AS mix_epoch FROM planned JOIN (SELECT unnest(range({epochs})) AS e) e ON e.e <= whole
), units AS (
  SELECT mix_domain, mix_lang, mix_source, mix_epoch, whole, rest, doc_id, md5('{seed}|' || mix_epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord, sum(mix_tokens) AS unit
  FROM mix_rows JOIN laps USING (mix_domain, mix_lang, mix_source) GROUP BY ALL
), placed AS (
  SELECT *, CAST(sum(unit) OVER (PARTITION BY mix_domain, mix_lang, mix_source, mix_epoch ORDER BY ord, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - unit AS BIGINT) AS mix_before FROM units
), chosen AS (SELECT mix_domain, mix_lang, mix_source, doc_id, mix_epoch, mix_before FROM placed WHERE mix_epoch < whole OR mix_before + unit <= rest
){tail or '''
SELECT r.doc_id, r.mix_domain, r.mix_lang, r.mix_source, c.mix_epoch, r.mix_tokens, c.mix_before
FROM mix_rows r JOIN chosen c ON r.doc_id IS NOT DISTINCT FROM c.doc_id AND r.mix_domain = c.mix_domain AND r.mix_lang = c.mix_lang AND r.mix_source = c.mix_source'''}
"""
