"""Line dedup by a log-template tree of fixed depth (DataFrame functions only).

The tree's levels are a line's number of tokens and its leading tokens; tokens with a digit are variable fields and
count as `<*>`. A leaf has as many templates as its lines show. One comes from majorities: a position is constant if one
token holds at least half of the leaf's distinct lines. The others come from frequent tokens: each line keeps, as the
constants of its own template, those tokens that stand in the same position in `min_docs` documents or more (each
distinct line counted with its documents). A template of too few constants is none. A template that occurs in `min_docs`
documents or more recurs, and so does any single masked line that does; the lines of recurring templates are dropped from
every document. Lines of more than `long_tokens` tokens recur from `long_min_docs` documents on.

A leaf is never gathered: templates come from counts by (leaf, position, token), and lines are matched one by one. Those
counts are joined with the tokens of distinct lines; tokens that a large share of them has are broadcast, 1,000 at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_counted, materialize

FIELD = "<*>"


@dataclass(frozen=True)
class LineRules:
    depth: int = 3  # leading tokens in the tree
    min_tokens: int = 1  # shorter lines are always kept
    min_docs: int = 10
    long_tokens: int | None = 50  # longer lines recur from long_min_docs documents on; None: all lines alike
    long_min_docs: int = 2
    constant_share: tuple[int, int] = (1, 2)  # of a leaf's distinct lines that a constant token needs
    min_constants: tuple[int, int] = (1, 2)  # of a template's positions that must be constant

    def least(self) -> Column:
        return F.when(F.col("long"), self.long_min_docs).otherwise(self.min_docs)


SQL_RULES = LineRules(min_tokens=3, long_tokens=None)  # those of the SQL of op1_line_templates


def _own(doc_id: Column, text: Column) -> Column:
    """Tells rows without an id apart by their text, so that what they drop is never gathered under one key."""
    return F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def _masked(line: Column) -> Column:
    """The line with single blanks between tokens and fields for tokens with digits; most lines need neither step."""
    uneven = F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))
    spaced = F.trim(F.when(uneven, F.regexp_replace(line, r"[ \t\r]+", " ")).otherwise(line))
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, "(?<![^ ])[^ 0-9]*[0-9][^ ]*", FIELD)).otherwise(spaced)


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, own, line_hash, line."""
    lines = docs.select("doc_id", _own(F.col("doc_id"), F.col("text")).alias("own"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", "own", F.xxhash64("line").alias("line_hash"), "line")


def _described(lines: DataFrame, rules: LineRules) -> DataFrame:
    """The lines that are long enough: doc_id, own, line_hash, masked, leaf, masked_hash, long. Tokens are counted by blanks."""
    masked = lines.select("doc_id", "own", "line_hash", _masked(F.col("line")).alias("masked"))
    n = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return masked.withColumn("_n", n).filter((F.col("masked") != "") & (F.col("_n") >= rules.min_tokens)).select(
        "doc_id",
        "own",
        "line_hash",
        "masked",
        F.xxhash64("_n", F.substring_index("masked", " ", rules.depth)).alias("leaf"),
        F.xxhash64("masked").alias("masked_hash"),
        (F.lit(False) if rules.long_tokens is None else F.col("_n") > rules.long_tokens).alias("long"),
    )


def _in_documents(rows: DataFrame, key: str, rules: LineRules) -> DataFrame:
    counts = rows.select(key, "doc_id", "long").distinct().groupBy(key, "long").count()
    return counts.filter(F.col("count") >= rules.least()).select(key)


def _majority_templates(counts: DataFrame, rules: LineRules) -> DataFrame:
    """leaf and the constants (pos, tok) of its template by majorities."""
    best = counts.groupBy("leaf", "long", "pos").agg(F.max(F.struct("n", "tok")).alias("m"), F.sum("n").alias("all"))
    a, b = rules.constant_share
    # More than the share where two lines may make a template: else all their positions were constant.
    share = F.col("m.n") * b - F.col("all") * a
    constant = F.when(F.col("long"), share > 0).otherwise(share >= 0) & (F.col("m.tok") != FIELD)
    constants = F.collect_list(F.when(constant, F.struct(F.col("pos"), F.col("m.tok").alias("tok"))))
    c, d = rules.min_constants
    found = best.groupBy("leaf").agg(F.count("*").alias("size"), constants.alias("constants"))
    return found.filter(F.size("constants") * d >= F.col("size") * c).select("leaf", "constants")


def _frequent_templates(tokens: DataFrame, counts: DataFrame, rules: LineRules) -> DataFrame:
    """leaf, masked_hash and the template of that line by frequent tokens."""
    often = counts.filter((F.col("docs") >= rules.least()) & (F.col("tok") != FIELD)).select("leaf", "pos", "tok", "n")
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    kept = join_counted(tokens.drop("docs"), often, ["leaf", "pos", "tok"], "n", total, how="inner")
    per_line = kept.groupBy("leaf", "masked_hash", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "tok"))).alias("constants"))
    c, d = rules.min_constants
    enough = per_line.filter(F.size("constants") * d >= F.col("size") * c)
    return enough.select("leaf", "masked_hash", F.xxhash64("leaf", "constants").alias("template"))


def recurring_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id, own (0, or for rows without an id the hash of their text) and line_hash of the lines to drop."""
    lines = _lines(docs)
    narrow = materialize(_described(lines, rules).select("doc_id", "own", "line_hash", "leaf", "masked_hash", "long"), "lines")
    known = materialize(_in_documents(narrow, "masked_hash", rules), "known-lines")
    rest = narrow.join(known, "masked_hash", "left_anti")
    leaves = materialize(_in_documents(rest, "leaf", rules), "leaves")
    # The second reading of the texts hashes its lines and describes only those that are wanted.
    wanted = materialize(rest.join(leaves, "leaf", "left_semi").select("line_hash").distinct(), "wanted-lines")
    inside = _described(lines.join(wanted, "line_hash", "left_semi"), rules)
    inside = materialize(inside.withColumn("tokens", F.split("masked", " ")).drop("masked"), "leaf-lines")
    # A line left here is in fewer than min_docs documents, so its set of them is small.
    in_docs = F.size(F.collect_set(F.struct("doc_id")))
    variants = inside.groupBy("leaf", "masked_hash", "long").agg(F.first("tokens").alias("tokens"), in_docs.alias("docs"))
    variants = materialize(variants.withColumn("size", F.size("tokens")), "line-variants")
    tokens = variants.select("leaf", "masked_hash", "long", "docs", "size", F.posexplode("tokens").alias("pos", "tok"))
    counts = materialize(tokens.groupBy("leaf", "long", "pos", "tok").agg(F.count("*").alias("n"), F.sum("docs").alias("docs")), "leaf-tokens")
    fits = F.expr("forall(constants, x -> tokens[x.pos] = x.tok)")
    by_majority = inside.join(_majority_templates(counts, rules), "leaf").filter(fits).withColumn("template", F.col("leaf"))
    by_tokens = inside.join(_frequent_templates(tokens, counts, rules), ["leaf", "masked_hash"])
    matched = [rows.select("doc_id", "own", "line_hash", "long", F.lit(i).alias("kind"), "template") for i, rows in enumerate((by_majority, by_tokens))]
    matched = materialize(matched[0].unionByName(matched[1]).withColumn("template", F.xxhash64("kind", "template")).drop("kind"), "template-lines")
    again = _in_documents(matched, "template", rules)
    return (
        narrow.join(known, "masked_hash", "left_semi").select("doc_id", "own", "line_hash")
        .union(matched.join(again, "template", "left_semi").select("doc_id", "own", "line_hash"))
        .distinct()
    )


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """All columns of docs with `text` without its recurring lines, and `n_lines`, `n_dropped`.

    docs needs doc_id and text. A null text stays null with 0 lines; an empty one is one empty line. Rows that repeat a
    doc_id count as one document, and so do all null ids. Of tokens that are equally frequent in a position the last in
    byte order is its constant. Texts of any length are taken whole; an empty table stays empty. Columns n_lines and
    n_dropped are replaced, other columns of any name stay.
    """
    gone = recurring_lines(docs.select(F.col("doc_id"), F.col("text")), rules)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row = F.struct(*[F.col(c) for c in own])  # so that no column name can clash
    per_doc = gone.groupBy(F.col("doc_id").alias("gone_id"), "own").agg(F.collect_set("line_hash").alias("gone"))
    rows = docs.select(row.alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (_own(F.col("row.doc_id"), F.col("row.text")) == F.col("own"))
    joined = rows.join(per_doc, same, "left")
    lines = joined.select("row", "gone", F.split("row.text", "\n").alias("lines"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("gone", F.xxhash64(x))))
    lines = lines.withColumn("kept", kept)
    n_lines, n_kept = F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size("kept"), F.lit(0))
    some = F.col("row.text").isNotNull()
    return lines.select(
        *[F.array_join("kept", "\n").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own],
        F.when(some, n_lines).otherwise(0).alias("n_lines"),
        F.when(some, n_lines - n_kept).otherwise(0).alias("n_dropped"),
    )
