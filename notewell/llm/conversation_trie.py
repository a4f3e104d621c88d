"""Trie of conversations: which of them begin with the same turns.

Every conversation is rebuilt from the first turns of its family's conversation and its own later turns. Polynomial
rolling fingerprints of all prefixes come from one scan of the turns (see `running`); since they are sums of powers, the
prefixes of a rebuilt conversation follow from those of its two parts. Rows of one depth and fingerprint are a candidate
node. They are grouped once more by the bytes of their last turn and by their parent, with a combine before the shuffle:
a candidate with more than one such variant is a collision and is split by bytes, level by level.

A node is named by its least member and its depth. The nodes of one name are a chain down that conversation, and chains
hang on nodes of other chains, so sums over subtrees are sums along chains plus those of the chains that hang there;
the latter are found by doubling the distance to an ancestor chain, in as many rounds as the logarithm of their depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import Rolling, running
from .shared import drop_scratch, join_counted, materialize, trimmed

FAMILY = 100  # conversations c - c % FAMILY give their first turns to their family
MOST_HEAD = 5  # of them
CHUNK_IDS = 4096


def head_turns(conv_id: Column) -> Column:
    """How many of a conversation's first turns are its family's."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_HEAD + 1))


def _named(prefix: str, rolling: Rolling) -> list[str]:
    return [f"{prefix}{k}" for k in range(len(rolling.bases))]


def _choose(at: Column, values: list[Column | int]) -> Column:
    """values[at]."""
    out = F.lit(None).cast("long")
    for n, value in enumerate(values):
        out = F.when(at == n, value if isinstance(value, Column) else F.lit(value).cast("long")).otherwise(out)
    return out


def _scanned(turns: DataFrame, rolling: Rolling) -> DataFrame:
    """Turns in order with their index `idx`, the fingerprint up to them (`sum`) and their own term."""
    halves = [F.xxhash64(F.lit(seed), "role", "text") for seed in range((len(rolling.bases) + 1) // 2)]
    lanes = [x for h in halves for x in (h, F.shiftrightunsigned(h, 32))][: len(rolling.bases)]
    names = _named("t", rolling)
    values = {c: F.pmod(x.bitwiseAND(F.lit((1 << 31) - 1)), F.lit(rolling.prime)) for c, x in zip(names, lanes)}
    typed = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    typed = typed.withColumn("chars", F.length("text").cast("long")).withColumns(values)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    begins = [order[0], F.col("role"), F.substring("text", 1, 32)]  # agrees with the order
    return running(typed, "conv_id", order, names, rolling, begins).drop("turn")


def _rebuilt(scanned: DataFrame, rolling: Rolling) -> DataFrame:
    """One row per conversation: base, len, h, k (turns of the family's that there are), depth (turns when rebuilt) and
    the fingerprints at k (`base`), of its own first h turns (`own`), and of the whole (`end`), and factors of its own."""
    lanes, p = range(len(rolling.bases)), F.lit(rolling.prime)
    heads = scanned.groupBy("conv_id").agg(
        F.count("*").alias("len"),
        *[F.max_by(f"sum{k}", "idx").alias(f"all{k}") for k in lanes],
        *[F.max(F.when(F.col("idx") == m, F.col(f"sum{k}"))).alias(f"p{m}_{k}") for m in range(MOST_HEAD) for k in lanes],
    )
    heads = materialize(heads, "heads")
    family = heads.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"),
        F.col("len").alias("_len"),
        *[F.col(f"p{m}_{k}").alias(f"b{m}_{k}") for m in range(MOST_HEAD) for k in lanes],
    )
    rows = heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", head_turns(F.col("conv_id")))
    rows = rows.join(family, "base", "left").withColumn("k", F.least("h", F.coalesce("_len", F.lit(0))))
    shift = F.col("h") - F.col("k")
    for k in lanes:
        rows = rows.withColumn(f"base{k}", _choose(F.col("k"), [0, *[F.col(f"b{m}_{k}") for m in range(MOST_HEAD)]]))
        rows = rows.withColumn(f"own{k}", _choose(F.col("h"), [0, *[F.col(f"p{m}_{k}") for m in range(MOST_HEAD)]]))
        rows = rows.withColumn(f"inv{k}", _choose(shift, [rolling.power(-n)[k] for n in range(MOST_HEAD + 1)]))
        whole = _moved(F.col(f"all{k}"), k, p)
        rows = rows.withColumn(f"end{k}", F.when(F.col("len") > F.col("h"), whole).otherwise(F.col(f"base{k}")))
    rows = rows.withColumn("depth", F.col("k") + F.greatest(F.col("len") - F.col("h"), F.lit(0)))
    columns = [f"{c}{k}" for c in ("base", "own", "inv", "end") for k in lanes]
    rows = materialize(rows.select("conv_id", "base", "len", "h", "k", "depth", *columns), "rebuilt")
    drop_scratch(heads)
    return rows


def _moved(sum_: Column, k: int, p: Column) -> Column:
    """A fingerprint of own turns, those before h taken away, behind the family's turns."""
    return F.pmod(F.col(f"base{k}") + F.pmod(F.col(f"inv{k}") * F.pmod(sum_ - F.col(f"own{k}"), p), p), p)


def _own_rows(scanned: DataFrame, convs: DataFrame, rolling: Rolling, total: int) -> DataFrame:
    """Own turns of rebuilt conversations: conv_id, depth, fingerprint `f`, parent's `g`, role, text, chars."""
    lanes, p = range(len(rolling.bases)), F.lit(rolling.prime)
    later = scanned.filter(F.col("idx") >= head_turns(F.col("conv_id")))
    columns = [f"{c}{k}" for c in ("base", "own", "inv") for k in lanes]
    rows = join_counted(later, convs.select("conv_id", "len", "h", "k", *columns), ["conv_id"], "len", total, "inner")
    return rows.select(
        "conv_id",
        (F.col("k") + F.col("idx") - F.col("h") + 1).alias("depth"),
        *[_moved(F.col(f"sum{k}"), k, p).alias(f"f{k}") for k in lanes],
        *[_moved(F.col(f"sum{k}") - F.col(f"term{k}"), k, p).alias(f"g{k}") for k in lanes],
        "role",
        "text",
        "chars",
    )


def _family_rows(scanned: DataFrame, members: DataFrame, rolling: Rolling) -> DataFrame:
    """The family's turns within `members` (base, h and other columns): depth, f, g, role, text, chars, those columns."""
    lanes, p = range(len(rolling.bases)), F.lit(rolling.prime)
    first = scanned.filter((F.col("conv_id") % FAMILY == 0) & (F.col("idx") < MOST_HEAD)).withColumnRenamed("conv_id", "base")
    return first.join(members, "base").filter("h > idx").select(
        *[c for c in members.columns if c not in ("base", "h")],
        (F.col("idx") + 1).alias("depth"),
        *[F.col(f"sum{k}").alias(f"f{k}") for k in lanes],
        *[F.pmod(F.col(f"sum{k}") - F.col(f"term{k}"), p).alias(f"g{k}") for k in lanes],
        "role",
        "text",
        "chars",
    )


def _split(scanned: DataFrame, convs: DataFrame, collided: DataFrame, rolling: Rolling, total: int) -> tuple[DataFrame, DataFrame]:
    """Nodes, and convs with new ends, where some fingerprints have several prefixes.

    Conversations with such a node are told apart by the bytes of their turns from there on, one level after the other;
    a class gets the key (least member, -1, ...), which no fingerprint equals.
    """
    f, g = _named("f", rolling), _named("g", rolling)
    both = _family_rows(scanned, convs.select("base", "h", "conv_id"), rolling)
    rows = materialize(_own_rows(scanned, convs, rolling, total).unionByName(both), "members")
    where = rows.join(collided, ["depth", *f], "left_semi").groupBy("conv_id").agg(F.min("depth").alias("_from"))
    some = materialize(rows.join(where, "conv_id").filter("depth >= _from").drop("_from"), "unsure")
    least, most = some.agg(F.min("depth"), F.max("depth")).first()
    tags: DataFrame | None = None
    before: DataFrame | None = None

    def keyed(df: DataFrame, tag: str, names: list[str]) -> DataFrame:
        own = [F.col(tag), *[F.lit(-k).cast("long") for k in range(1, len(names))]]
        return df.withColumns({c: F.when(F.col(tag).isNotNull(), x).otherwise(F.col(c)) for c, x in zip(names, own)})

    for depth in range(least, most + 1):
        level = some.filter(F.col("depth") == depth)
        if before is not None:
            above = before.select("conv_id", F.col("tag").alias("_above"))
            level = keyed(level.join(above, "conv_id", "left"), "_above", g).drop("_above")
        classes = level.groupBy(*g, "role", "text").agg(F.min("conv_id").alias("tag"))
        before = materialize(level.join(classes, [*g, "role", "text"]).select("conv_id", "depth", "tag"), "level")
        tags = before if tags is None else tags.union(before)
    tags = materialize(tags, "classes")
    above = tags.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("tag").alias("_above"))
    split = rows.join(tags, ["conv_id", "depth"], "left").join(above, ["conv_id", "depth"], "left")
    split = keyed(keyed(split, "tag", f), "_above", g)
    nodes = split.groupBy("depth", *f, *g).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("chars").alias("chars"))
    nodes = materialize(nodes, "split")
    ends = keyed(convs.join(tags, ["conv_id", "depth"], "left"), "tag", _named("end", rolling)).select(*convs.columns)
    ends = materialize(ends, "rebuilt")
    drop_scratch(rows, some, tags, convs)
    return nodes, ends


def _nodes(scanned: DataFrame, convs: DataFrame, rolling: Rolling, total: int) -> tuple[DataFrame, DataFrame]:
    """All nodes: depth, f, g (null for the root), conv_id (least member), n (members), chars; and convs."""
    f, g = _named("f", rolling), _named("g", rolling)
    families = convs.groupBy("base", "h").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    rows = _own_rows(scanned, convs, rolling, total).withColumn("n", F.lit(1).cast("long"))
    rows = rows.unionByName(_family_rows(scanned, families, rolling))
    nodes = rows.groupBy("depth", *f, *g, "role", "text").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.max("chars").alias("chars")
    )
    nodes = materialize(nodes.drop("role", "text"), "nodes")
    collided = nodes.groupBy("depth", *f).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    if collided.limit(1).count():
        found = materialize(collided, "collided")
        old = nodes
        nodes, convs = _split(scanned, convs, found, rolling, total)
        drop_scratch(found, old)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).filter("n > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(zero.alias("depth"), *[zero.alias(c) for c in f], *[none.alias(c) for c in g], "conv_id", "n", zero.alias("chars"))
    return nodes.select("depth", *f, *g, "conv_id", "n", "chars").union(root), convs


def _chains(nodes: DataFrame, rolling: Rolling) -> DataFrame:
    """Chains by conv_id: top and end (depths), saved (their own), parent (conv_id of the node above the top, or null)."""
    f, g = _named("f", rolling), _named("g", rolling)
    chains = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"),
        F.max("depth").alias("end"),
        F.sum("saved").alias("saved"),
        *[F.min_by(y, "depth").alias(x) for x, y in zip(f, g)],
    )
    chains = materialize(chains.withColumn("depth", F.col("top") - 1), "tops")
    hanging = chains.filter("top > 0")
    above = hanging.groupBy("depth", *f).agg(F.count("*").alias("_n"))
    above = above.join(nodes.select("depth", *f, F.col("conv_id").alias("parent")), ["depth", *f])
    columns = ["conv_id", "top", "end", "saved", "parent"]
    found = join_counted(hanging, materialize(above, "above"), ["depth", *f], "_n", chains.count(), "inner").select(*columns)
    root = chains.filter("top = 0").withColumn("parent", F.lit(None).cast("long")).select(*columns)
    out = materialize(found.union(root), "chains")
    drop_scratch(chains)
    return out


def subtree_sums(rows: DataFrame, values: list[str]) -> DataFrame:
    """conv_id and values, each summed over the row and all rows below it; `parent` is the row above or null.

    Sums over descendants nearer than 2 ** k grow to those nearer than 2 ** (k + 1) by adding the sums of the rows that
    have this one as ancestor at distance 2 ** k.
    """
    total = rows.count()
    now = materialize(rows.select("conv_id", "parent", *values), "subtree")
    while now.filter("parent IS NOT NULL").limit(1).count():
        live = now.filter("parent IS NOT NULL")
        below = live.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
        below = materialize(below, "below")
        summed = now.join(below.drop("_n"), "conv_id", "left")
        summed = summed.select("conv_id", "parent", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        further = below.select("conv_id", "_n").join(now.select("conv_id", F.col("parent").alias("_up")), "conv_id")
        further = materialize(further.select(F.col("conv_id").alias("parent"), "_n", "_up"), "further")
        moved = join_counted(summed.filter("parent IS NOT NULL"), further, ["parent"], "_n", total, "inner")
        moved = moved.select("conv_id", F.col("_up").alias("parent"), *values)
        after = materialize(moved.union(summed.filter("parent IS NULL")), "subtree")
        drop_scratch(now, below, further)
        now = after
    return now.select("conv_id", *values)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of node, depth and member: the members of each node in comma-joined portions."""
    names = ["node", "depth", "least", "ids"]
    for batch in batches:
        if not batch.num_rows:
            continue
        node, depth, member = (batch.column(k).to_numpy() for k in range(3))
        new = (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        starts = np.unique(np.concatenate([starts, *[np.arange(a, b, CHUNK_IDS) for a, b in zip(starts, np.append(starts[1:], len(node)))]]))
        texts = member.astype(str).tolist()
        joined = [",".join(texts[a:b]) for a, b in zip(starts, np.append(starts[1:], len(node)))]
        yield pa.RecordBatch.from_arrays([pa.array(x[starts]) for x in (node, depth, member)] + [pa.array(joined, pa.string())], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted portions to one digest per node; what is held is one hash state."""
    key, state = None, None
    names = ["conv_id", "depth", "ends_sha256"]

    def made(out: list[tuple]) -> pa.RecordBatch:
        node, depth, digest = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], names=names)

    for batch in batches:
        out = []
        for node, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (node, depth) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256()
            state.update(ids.encode())
        yield made(out)
    if key is not None:
        yield made([(*key, state.hexdigest())])


def _ends(nodes: DataFrame, convs: DataFrame, chains: DataFrame, rolling: Rolling) -> DataFrame:
    """conv_id, depth and digest of the nodes at which conversations end."""
    spark, f = nodes.sparkSession, _named("f", rolling)
    mine = convs.join(chains.select("conv_id"), "conv_id", "left_semi")
    mine = mine.select(F.col("conv_id").alias("node"), "depth", F.col("conv_id").alias("member"))
    # The others end within a chain of a conversation with a lesser id.
    others = convs.join(chains.select("conv_id"), "conv_id", "left_anti")
    others = others.select(F.col("conv_id").alias("member"), "depth", *[F.col(f"end{k}").alias(x) for k, x in enumerate(f)])
    others = materialize(others, "others")
    at = others.groupBy("depth", *f).agg(F.count("*").alias("_n")).join(nodes.select("depth", *f, F.col("conv_id").alias("node")), ["depth", *f])
    found = join_counted(others, materialize(at, "at"), ["depth", *f], "_n", others.count(), "inner")
    ends = mine.union(found.select("node", "depth", "member"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ends.repartitionByRange(parts, "node", "depth", "member").sortWithinPartitions("node", "depth", "member")
    portions = materialize(ordered.mapInArrow(trimmed(_chunks), "node long, depth long, least long, ids string"), "portions")
    dealt = portions.repartition(parts, "node", "depth").sortWithinPartitions("node", "depth", "least")
    digests = materialize(dealt.mapInArrow(trimmed(_digests), "conv_id long, depth long, ends_sha256 string"), "digests")
    drop_scratch(others, portions)
    return digests


def conversation_trie(turns: DataFrame, rolling: Rolling = Rolling()) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    turns: conv_id, turn, role, text; other columns are not read. Turns are in the order of turn (null first), then role,
    then text; null roles and texts are empty, repeated rows are turns of their own. Rows without conv_id take no part.
    Texts and conversations may have any length. An empty table gives no row; otherwise the root is there, and has the
    conversations that are rebuilt without turns among its members and ends.
    """
    scanned = _scanned(turns, rolling)
    total = scanned.count()
    convs = _rebuilt(scanned, rolling)
    nodes, convs = _nodes(scanned, convs, rolling, total)
    drop_scratch(scanned)
    nodes = materialize(nodes.withColumn("saved", (F.col("n") - 1) * F.col("chars")), "trie")
    chains = _chains(nodes, rolling)
    hanging = chains.filter("parent IS NOT NULL").withColumn("at", F.col("top") - 1)
    with_some = hanging.select(F.col("parent").alias("conv_id"), F.col("at").alias("end")).distinct().withColumn("_some", F.lit(0))
    valued = chains.join(with_some, ["conv_id", "end"], "left").withColumn("leaves", F.coalesce("_some", F.lit(1)).cast("long"))
    sums = subtree_sums(valued, ["saved", "leaves"])
    below = hanging.select("conv_id", "parent", "at").join(sums, "conv_id").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth"))
    below = below.agg(F.count("*").alias("_chains"), F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
    spans = chains.select("conv_id", "top", "end", "parent", (F.col("end") - F.col("top") + 1).alias("_n"))
    rows = nodes.select("conv_id", "depth", "n", "saved").join(below, ["conv_id", "depth"], "left")
    rows = materialize(rows, "hung")
    rows = join_counted(rows, spans, ["conv_id"], "_n", rows.count(), "inner")
    children = (F.col("depth") < F.col("end")).cast("long") + F.coalesce("_chains", F.lit(0))
    rows = rows.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        children.alias("n_children"),
        (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("all_saved"),
        ((children == 0).cast("long") + F.coalesce("_leaves", F.lit(0))).alias("all_leaves"),
    )
    summed = running(rows, "conv_id", [F.col("depth").desc()], ["all_saved", "all_leaves"])
    digests = _ends(nodes, convs, chains, rolling)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(digests, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("sum1").alias("n_leaves"),
        F.col("sum0").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
