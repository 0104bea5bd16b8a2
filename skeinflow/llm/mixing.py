"""Mixing sources to target weights: hierarchical budgets over a tree of domain, language and source.

Budgets. The token budget runs down the tree: each node splits what it gets among its children in proportion to their
weights. A leaf can give its tokens times the epochs allowed. What a leaf cannot give goes to its siblings first, in
proportion to their weights, until all of them are full; only then does the shortage rise to the parent's siblings. That is
bottom-up capacities, then top-down water-filling of the children of each node.

Selection. A leaf of budget B takes whole epochs of itself, and of the next epoch the documents before B in an order seeded
by (seed, epoch, document): those whose preceding tokens are under the remaining budget, so the prefix ends with the document
that reaches it. Prefixes need no sort of a leaf: documents are summed in 16^``BUCKET_DIGITS`` ranges of their seeded hash, the ranges
before the one in which the budget ends are taken whole, and only that range is put in order.

The tree has one row for each (domain, language, source); all budget work is on those rows, in joins and windows by parent.

Defined results: null languages, sources and texts are values of their own (a null text has no tokens); documents without
tokens go with the range or place their hash gives; a leaf without tokens has no budget and gives no rows; repeated rows are
documents of their own, in the order of their hash and then of doc_id and text hash; an empty table gives no rows; weights
that name no leaf of the data are ignored, their share goes to the siblings; columns named like the outputs give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .passing import hidden_pass
from .store import settle

BUCKET_DIGITS = 3
SEED = 7
#: Shares of the domains, of the languages in a domain and of the sources in a language; what is not named weighs 1.
DOMAIN_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}
SOURCE_WEIGHTS: dict[str, float] = {}
BUDGET_SHARE = 0.5
MAX_EPOCHS = 2


def token_count(text: Column) -> Column:
    """Words between spaces, tabs and newlines."""
    plain = F.trim(F.regexp_replace(text.cast("string"), "[ \\t\\r\\n]+", " "))
    return F.when(text.isNull() | (plain == ""), 0).otherwise(F.length(plain) - F.length(F.translate(plain, " ", "")) + 1).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: ``d`` and the number at its end modulo 4; ``d0`` for others."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("long") % 4, F.lit(0)).cast("string"))


def _weight(column: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out


def _fill(children: DataFrame, parent: list[str], budget: str, weight: str, capacity: str) -> DataFrame:
    """``children`` with column ``given``: their parent's budget, water-filled by weight up to their capacities.

    Children fill up in order of capacity / weight; with F the capacity of those before and W the weight of the others, the
    level is (budget - F) / W, and a child is full if its own ratio is at most the level at its place. Siblings are few;
    one window by parent orders them."""
    order = Window.partitionBy(*parent).orderBy(F.col(capacity) / F.col(weight), *[c for c in ("domain", "lang", "source") if c in children.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0))) / F.sum(weight).over(rest)
    rows = children.withColumn("_level", level).withColumn("_ratio", F.col(capacity) / F.col(weight))
    # the level of those that are not full is the one at the first of them
    open_level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", F.col("_level").alias("at")))).over(Window.partitionBy(*parent))["at"]
    return rows.withColumn("given", F.when(F.col("_ratio") <= F.col("_level"), F.col(capacity)).otherwise(F.round(F.greatest(F.lit(0.0), open_level * F.col(weight)), 3))).drop("_level", "_ratio")


def leaf_budgets(leaves: DataFrame, total: float | Column, max_epochs: int = MAX_EPOCHS, domains=None, languages=None, sources=None) -> DataFrame:
    """(domain, lang, source, tokens, budget) for leaves (domain, lang, source, tokens); null keys are values."""
    capacity = (F.col("tokens") * max_epochs).cast("double")
    leaf = leaves.where("tokens > 0").withColumn("cap", capacity).withColumn("w", _weight("source", SOURCE_WEIGHTS if sources is None else sources))
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("lang", LANGUAGE_WEIGHTS if languages is None else languages))
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("domain", DOMAIN_WEIGHTS if domains is None else domains))
    root = domain.agg(F.sum("cap").alias("_all")).select(F.least(F.col("_all"), total if isinstance(total, Column) else F.lit(float(total))).alias("b"))
    domain = _fill(domain.crossJoin(F.broadcast(root)).withColumn("_root", F.lit(0)), ["_root"], "b", "w", "cap").select("domain", F.col("given").alias("b"))
    lang = _fill(lang.join(domain, "domain"), ["domain"], "b", "w", "cap").select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("given").alias("b"))
    leaf = leaf.join(lang, F.col("domain").eqNullSafe(F.col("_d")) & F.col("lang").eqNullSafe(F.col("_l"))).drop("_d", "_l")
    return _fill(leaf, ["domain", "lang"], "b", "w", "cap").select("domain", "lang", "source", "tokens", F.col("given").alias("budget"))


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, **weights) -> DataFrame:
    """Rows (doc_id, domain, lang, source, epoch, n_tokens, row_hash): each document for each epoch that takes it."""
    lang, source = (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source"))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"), token_count(F.col("text")).alias("n_tokens"), F.xxhash64(text).alias("row_hash"))
    rows = settle(rows, "mix")
    leaves = rows.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg((F.sum("tokens") * budget_share).alias("t")).first()["t"] or 0.0
    budgets = settle(leaf_budgets(leaves, total, max_epochs, **weights), "budgets")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("domain", "lang", "source")]
    # an epoch has a part of the budget: the tokens of the leaf, or what is left for the last one
    epochs = budgets.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("part", F.least(F.col("budget") - F.col("epoch") * F.col("tokens"), F.col("tokens").cast("double"))).where("part > 0")
    epochs = epochs.select(*[F.col(c).alias(f"_{c}") for c in ("domain", "lang", "source")], "epoch", "part", (F.col("part") >= F.col("tokens")).alias("whole"))
    placed = rows.join(epochs, same[0] & same[1] & same[2])
    hashed = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string")))
    placed = placed.withColumn("_hash", hashed).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    full = placed.where("whole")
    cut = placed.where("not whole")
    keys = ["_domain", "_lang", "_source", "epoch"]
    sums = cut.groupBy(*keys, "part", "_bucket").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("_bucket"))
    ends = sums.withColumn("before", upto - F.col("n")).withColumn("after", upto).where("before < part").select(*[F.col(k).alias(f"e{k}") for k in [*keys, "_bucket"]], "before", "after")
    at = F.lit(True)
    for k in [*keys, "_bucket"]:
        at = at & F.col(k).eqNullSafe(F.col(f"e{k}"))
    cut = cut.join(ends, at)
    inside = cut.where("after <= part")
    edge = cut.where("after > part")
    order = Window.partitionBy(*keys).orderBy("_hash", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_so_far", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("_so_far < part")
    out = ["doc_id", "domain", "lang", "source", "epoch", "n_tokens", "row_hash"]
    return full.select(*out).unionAll(inside.select(*out)).unionAll(edge.select(*out))


@hidden_pass
def select_mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns, once for each epoch that takes them.

    Of rows alike in id, text, language and source as many stand as the mix takes, those with the smallest hashes first."""
    key = ["_mix_id", "_mix_row", "_mix_lang", "_mix_source"]
    lang, source = (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source"))
    own = [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), lang, source]
    taken = mix(docs, **parameters).groupBy(F.col("doc_id").alias(key[0]), F.col("row_hash").alias(key[1]), F.col("lang").alias(key[2]), F.col("source").alias(key[3]), F.col("epoch").alias("_mix_epoch")).agg(F.count("*").alias("_mix_n"))
    taken = taken.withColumn("_mix_key", F.xxhash64(*key))
    rows = docs.select("*", F.xxhash64(*own).alias("_own_key"), *[c.alias(f"_own{n}") for c, n in zip(own, key)])
    same = F.col("_own_key") == F.col("_mix_key")
    for n in key:
        same = same & F.col(f"_own{n}").eqNullSafe(F.col(n))
    alike = Window.partitionBy("_own_key", *key, "_mix_epoch").orderBy(F.xxhash64(*docs.columns))
    return rows.join(taken, same).withColumn("_mix_place", F.row_number().over(alike)).where("_mix_place <= _mix_n").select(*docs.columns)


def _sql_weight(column: str, weights: dict[str, float]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in weights.items()) + " ELSE CAST(1 AS DOUBLE) END" if weights else "CAST(1 AS DOUBLE)"


def _sql_fill(table: str, parent: str, own: str) -> str:
    level = f"SELECT *, cap / w AS r, (b - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM {table}"
    return f"SELECT *, CASE WHEN r <= lvl THEN cap ELSE round(greatest(0, arg_min(lvl, r) FILTER (WHERE r > lvl) OVER (PARTITION BY {parent}) * w), 3) END AS given FROM ({level})"


#: The same for DuckDB, with one window over each leaf.
ORACLE = f"""
WITH t AS (SELECT doc_id, text, lang, source, 'd' || coalesce(CAST(TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4 AS VARCHAR), '0') AS domain,
    trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS plain FROM documents),
d AS (SELECT doc_id, lang, source, domain, CASE WHEN text IS NULL OR plain = '' THEN 0 ELSE length(plain) - length(replace(plain, ' ', '')) + 1 END AS n_tokens FROM t),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS DOUBLE) AS cap, {_sql_weight("source", SOURCE_WEIGHTS)} AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
la AS (SELECT domain, lang, sum(cap) AS cap, {_sql_weight("lang", LANGUAGE_WEIGHTS)} AS w FROM leaf GROUP BY ALL),
dm AS (SELECT domain, sum(cap) AS cap, {_sql_weight("domain", DOMAIN_WEIGHTS)} AS w FROM la GROUP BY ALL),
dm1 AS (SELECT *, least((SELECT sum(cap) FROM dm), (SELECT sum(tokens) * {BUDGET_SHARE} FROM leaf)) AS b, 0 AS root FROM dm), dm2 AS ({_sql_fill("dm1", "root", "domain")}),
la1 AS (SELECT la.*, dm2.given AS b FROM la JOIN dm2 USING (domain)), la2 AS ({_sql_fill("la1", "domain", "lang")}),
leaf1 AS (SELECT leaf.*, la2.given AS b FROM leaf JOIN la2 ON leaf.domain = la2.domain AND leaf.lang IS NOT DISTINCT FROM la2.lang), leaf2 AS ({_sql_fill("leaf1", "domain, lang", "source")}),
ep AS (SELECT domain, lang, source, e AS epoch, least(given - e * tokens, tokens) AS part FROM leaf2, range({MAX_EPOCHS}) r(e)),
p AS (SELECT d.*, epoch, part, coalesce(sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source, epoch ORDER BY md5('{SEED}-' || epoch || '-' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far,
    part >= sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source, epoch) AS whole
  FROM d JOIN ep ON d.domain = ep.domain AND d.lang IS NOT DISTINCT FROM ep.lang AND d.source IS NOT DISTINCT FROM ep.source WHERE part > 0)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens FROM p WHERE whole OR so_far < part
"""
