"""Mixing sources to target weights (DataFrame functions only).

A token budget flows down a tree domain -> language -> source. At each node it is dealt to the children in proportion
to their integer weights; a child that cannot use its share (its subtree holds fewer than `max_epochs` passes over its
tokens) keeps what it can use, and its siblings share the rest in proportion to theirs. Since a parent's own share is
bounded by what its subtree can use, a shortage reaches the ancestors' siblings only when all siblings are full.

Each leaf then reads its documents in seeded epochs, each epoch in the order of a hash of (seed, epoch, doc_id), and
takes the longest prefix of whole documents within its budget. Whole epochs are counted, so only one epoch per leaf is
cut, and that cut is one (hash, doc_id) pair per leaf: rows are compared with it, no leaf is ever sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

LEVELS = ("mix_domain", "mix_lang", "mix_source")
BROADCAST_LEAVES = 20_000  # a leaf is a row of some 200 bytes
MOST_WEIGHT = 10_000
CELL_DIGITS = 3  # hash prefix of the cells in which a leaf's tokens are first summed: 4096 cells


@dataclass(frozen=True)
class MixPlan:
    """Weights are positive integers under MOST_WEIGHT; a node without one has weight 1."""

    share: tuple[int, int] = (3, 5)  # budget as a fraction of all tokens, unless `budget` is set
    budget: int | None = None
    max_epochs: int = 4
    seed: str = "mix"
    domain_weights: Mapping[str, int] = field(default_factory=dict)
    lang_weights: Mapping[str, int] = field(default_factory=dict)
    source_weights: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        weights = [w for level in (self.domain_weights, self.lang_weights, self.source_weights) for w in level.values()]
        if any(w != int(w) or not 0 < w < MOST_WEIGHT for w in weights):
            raise ValueError(f"weights must be integers from 1 to {MOST_WEIGHT - 1}")


def hashed_domain(source: Column) -> Column:
    """One of four domains, dealt by a hash of the source's name: the tables have no column for it."""
    digit = F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("d"), F.floor(digit / 4).cast("string"))


def count_tokens(text: Column) -> Column:
    """Words between blanks, tabs and line ends; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for key, value in sorted(weights.items()):
        out = F.when(F.col(name) == key, F.lit(int(value))).otherwise(out)
    return out.cast("long")


def _deal(nodes: DataFrame, parents: Sequence[str], name: str, given: str, out: str) -> DataFrame:
    """Deals column `given` (the same for all children of a parent) to children with columns `cap` and `w`.

    In the order of cap / w, a child is full if even an equal rate over all later children would fill it. Products of
    tokens and weights are decimals of 37 digits.
    """
    keys = [F.col(p) for p in parents] or [F.lit(0)]
    order = W.partitionBy(*keys).orderBy(F.col("cap") / F.col("w"), F.col(name))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    tokens, weight = "decimal(23,0)", "decimal(13,0)"
    rate = F.col("cap").cast(tokens) * (F.col("_all_w") - F.col("_w_before")).cast(weight)
    full = rate <= F.col("w").cast(weight) * (F.col(given) - F.col("_cap_before")).cast(tokens)
    return (
        nodes.withColumn("_all_w", F.sum("w").over(whole))
        .withColumn("_w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("_cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("_full", full)
        .withColumn("_full_cap", F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0)))
        .withColumn("_full_w", F.coalesce(F.sum(F.when(F.col("_full"), F.col("w"))).over(whole), F.lit(0)))
        .withColumn(
            out,
            F.when(F.col("_full"), F.col("cap")).otherwise(
                F.expr(f"(cast(w as {weight}) * cast({given} - _full_cap as {tokens})) div cast(greatest(_all_w - _full_w, 1) as {weight})")
            ),
        )
        .drop("_all_w", "_w_before", "_cap_before", "_full", "_full_cap", "_full_w")
    )


def with_leaf(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """Adds the three tree columns; a null language or source is the leaf named by the empty text."""
    return docs.withColumns(
        {
            LEVELS[0]: hashed_domain(F.col("source")) if domain is None else F.coalesce(domain, F.lit("")),
            LEVELS[1]: F.coalesce(F.col("lang"), F.lit("")),
            LEVELS[2]: F.coalesce(F.col("source"), F.lit("")),
        }
    )


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """From one row per leaf (tree columns, `tokens`) to the same with `quota`, the leaf's token budget."""
    d, l, s = LEVELS
    leaves = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs)
    total = W.partitionBy(F.lit(0))
    wanted = F.lit(plan.budget).cast("long") if plan.budget is not None else F.expr(
        f"(_tokens * {int(plan.share[0])}) div {int(plan.share[1])}"
    )
    domains = (
        leaves.groupBy(d).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("_own"))
        .withColumn("_tokens", F.sum("_own").over(total))
        .withColumn("_given", F.least(wanted, F.col("_tokens") * plan.max_epochs))
        .withColumn("w", _weight(d, plan.domain_weights))
    )
    domains = _deal(domains, (), d, "_given", "_domain_quota").select(d, "_domain_quota")
    langs = (
        leaves.groupBy(d, l).agg(F.sum("cap").alias("cap")).join(domains, d).withColumn("w", _weight(l, plan.lang_weights))
    )
    langs = _deal(langs, (d,), l, "_domain_quota", "_lang_quota").select(d, l, "_lang_quota")
    out = leaves.join(langs, [d, l]).withColumn("w", _weight(s, plan.source_weights))
    return _deal(out, (d, l), s, "_lang_quota", "quota").select(d, l, s, "tokens", "quota")


def _epoch_hash(seed: str, epochs: str = "epochs") -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.col(epochs).cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.md5(key.cast("binary"))


def _beside(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Joins leaf columns to rows: broadcast if the leaves are few, else by a salted key so that no leaf is one task."""
    if leaves.count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(leaves), list(LEVELS))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")
    salted = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.withColumn("_salt", salt).join(salted, [*LEVELS, "_salt"]).drop("_salt")


def leaf_cuts(narrow: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per leaf: `epochs` that it reads whole, and where it stops within the next one.

    narrow: a cheap table with the tree columns, doc_id and n_tokens.
    """
    keys = list(LEVELS)
    leaves = narrow.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))
    budgets = (
        leaf_budgets(leaves, plan)
        .withColumn("epochs", F.expr("if(tokens > 0, quota div tokens, 0L)"))
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
    )
    budgets = materialize(budgets, "mix-budgets")
    rows = _beside(narrow, budgets.filter("rest > 0").select(*keys, "epochs", "rest")).withColumn("hash", _epoch_hash(plan.seed))
    rows = rows.withColumn("cell", F.substring("hash", 1, CELL_DIGITS))
    cells = rows.groupBy(*keys, "cell").agg(F.sum("n_tokens").alias("_n"), F.first("rest").alias("rest"))
    upto = W.partitionBy(*keys).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    cut_cells = (
        cells.withColumn("_upto", F.sum("_n").over(upto))
        .filter("_upto > rest")
        .groupBy(*keys)
        .agg(F.min(F.struct("cell", (F.col("rest") - (F.col("_upto") - F.col("_n"))).alias("left"))).alias("_c"))
        .select(*keys, F.col("_c.cell").alias("cut_cell"), F.col("_c.left").alias("left"))
    )
    cut_cells = materialize(cut_cells, "mix-cells")
    # Rows of one doc_id are one unit: the range frame counts all peers of a (hash, doc_id) pair.
    units = W.partitionBy(*keys).orderBy("hash", "_id").rangeBetween(W.unboundedPreceding, 0)
    points = (
        _beside(rows.drop("rest"), cut_cells)
        .filter(F.col("cell") == F.col("cut_cell"))
        .withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
        .withColumn("_sum", F.sum("n_tokens").over(units))
        .filter("_sum <= left")
        .groupBy(*keys)
        .agg(F.max(F.struct("hash", "_id")).alias("_p"))
        .select(*keys, F.col("_p.hash").alias("cut_hash"), F.col("_p._id").alias("cut_id"))
    )
    return (
        budgets.join(cut_cells.drop("left"), keys, "left")
        .join(points, keys, "left")
        .select(*keys, "epochs", "quota", "cut_cell", "cut_hash", "cut_id")
    )


def with_copies(docs: DataFrame, cuts: DataFrame, plan: MixPlan, domain: Column | None = None) -> DataFrame:
    """Adds the tree columns and `copies`, how often the mix reads the row; rows that it does not read are gone."""
    named = cuts.select(*LEVELS, *[F.col(c).alias(f"_mix_{c}") for c in ("epochs", "cut_cell", "cut_hash", "cut_id")])
    rows = _beside(with_leaf(docs, domain), named).withColumn("_mix_hash", _epoch_hash(plan.seed, "_mix_epochs"))
    own, own_id = F.col("_mix_hash"), F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    early = F.substring(own, 1, CELL_DIGITS) < F.col("_mix_cut_cell")
    upto = (own < F.col("_mix_cut_hash")) | ((own == F.col("_mix_cut_hash")) & (own_id <= F.col("_mix_cut_id")))
    more = F.coalesce(early, F.lit(False)) | F.coalesce(upto, F.lit(False))
    return (
        rows.withColumn("copies", (F.col("_mix_epochs") + more.cast("int")).cast("long"))
        .filter("copies > 0")
        .drop("_mix_hash", *[c for c in named.columns if c not in LEVELS])
    )


def mix(docs: DataFrame, plan: MixPlan, domain: Column | None = None) -> DataFrame:
    """All columns of docs, the tree columns, and `copies`.

    docs needs doc_id, text, lang and source. Null texts have no tokens; zero-token documents come along when they
    stand before the cut. Rows that repeat a doc_id within a leaf are taken or left together. An empty table gives an
    empty one.
    """
    narrow = with_leaf(docs, domain).select(*LEVELS, "doc_id", count_tokens(F.col("text")).alias("n_tokens"))
    cuts = materialize(leaf_cuts(materialize(narrow, "mix-tokens"), plan), "mix-cuts")
    return with_copies(docs, cuts, plan, domain)
