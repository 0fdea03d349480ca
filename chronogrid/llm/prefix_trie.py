"""The trie of conversations' prefixes, with subtree totals by parallel tree contraction.

A turn's place in its conversation comes from one range sort by (conversation, turn): places and prefix keys are counted within
sorted pieces and added up over a conversation's pieces, so a conversation of any length is never in one task. A prefix's key
is the XOR of 128-bit hashes of its turns, each with its place; prefixes with equal keys and depth are one node.

Totals over subtrees are found by contraction. Rounds alternate: rake ends all leaves and adds their totals to their
parents; compress takes nodes out of chains of only children, those whose random priority exceeds their parent's and their
child's, and hands what they hold to the child's link. Each round takes a part of all that is left, whether the tree is wide or
deep. What was taken out is then put back, last round first: a node's total is that of its child at the time, and what the
node held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogrid.shared import materialise

#: Turns of a conversation whose prefix keys are made in one piece; conversations that share a list of member ids.
PIECE, IDS = 1 << 12, 12


def _turn_hash(salt: int, *cols: Column | str) -> Column:
    return F.xxhash64(F.lit(salt), *cols)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, n): every turn's place from 0 by turn, null first, then by its hashes; the hash of (role, text) and
    the text's code points. Null roles and texts are empty; rows without conv_id are left out."""
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", _turn_hash(1, role, text).alias("h1"), _turn_hash(2, text, role).alias("h2"), F.char_length(text).cast("long").alias("n"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "h1", "h2", "n", F.monotonically_increasing_id().alias("at"))
    held = materialise(sorted_.withColumn("part", F.shiftright("at", 33)))  # the number's upper bits are the partition's
    starts = held.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("conv_id", "part", "start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    return held.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("start") + F.col("before")).alias("pos"), "h1", "h2", "n")


def rebuilt_turns(turns: DataFrame, modulus: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, pos, h1, h2, n) of their rebuilt turns: the first h turns of conversation
    conv_id - conv_id % modulus (% of a negative id is not positive), then those of their own after the first h; h is crc32 of the decimal id, modulo ``most``."""
    convs = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    plan = convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % modulus).alias("base"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    plan = plan.join(lengths, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("base_own", F.lit(0))).alias("lent"))
    plan = materialise(plan)
    placed = materialise(ordered_turns(turns))
    heads = placed.filter(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    lent = plan.filter("lent > 0").join(heads, "base").filter("pos < lent").select("conv_id", "pos", "h1", "h2", "n")
    kept = placed.join(plan, "conv_id").filter("pos >= h").select("conv_id", (F.col("lent") + F.col("pos") - F.col("h")).alias("pos"), "h1", "h2", "n")
    return plan.select("conv_id"), lent.unionAll(kept)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n): the key of each prefix and of the prefix before, and its last turn's code points."""
    own = rebuilt.withColumn("g1", _turn_hash(3, "pos", "h1", "h2")).withColumn("g2", _turn_hash(4, "h2", "pos", "h1"))
    own = own.withColumn("piece", F.expr(f"pos div {PIECE}"))
    totals = own.groupBy("conv_id", "piece").agg(F.bit_xor("g1").alias("t1"), F.bit_xor("g2").alias("t2"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "piece", *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    keyed = own.select("conv_id", "piece", "pos", "n", "g1", "g2", *[F.bit_xor(f"g{i}").over(upto).alias(f"r{i}") for i in (1, 2)]).join(totals, ["conv_id", "piece"])
    keys = [F.col(f"b{i}").bitwiseXOR(F.col(f"r{i}")) for i in (1, 2)]
    return keyed.select("conv_id", (F.col("pos") + 1).alias("depth"), *[k.alias(f"k{i}") for i, k in enumerate(keys, 1)], *[k.bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i, k in enumerate(keys, 1)], "n")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's pieces of ids, which come sorted by (node, piece)."""
    node, running = None, hashlib.sha256()
    for pdf in batches:
        out = []
        for one, ids in zip(pdf["node"], pdf["ids"], strict=True):
            if one != node:
                if node is not None:
                    out.append((node, running.hexdigest()))
                node, running = one, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, running.hexdigest())], columns=["node", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) over the sorted ids of (node, conv_id). Ids are joined in pieces of 2^IDS neighbours; a digest is one
    sequence by its nature, so what goes through one task for a node is those pieces, in a stream."""
    spark = ends.sparkSession
    pieces = ends.groupBy("node", F.shiftright("conv_id", IDS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "node").sortWithinPartitions("node", "piece").select("node", "ids").mapInPandas(_digests, "node long, ends_sha256 string")


def subtree_sums(tree: DataFrame, values: list[str], max_rounds: int = 400) -> DataFrame:
    """(node, values) summed over each node's subtree. tree: (node long, parent long, values long); roots' parent is null."""
    spent = [f"e_{v}" for v in values]  # what is to be added on the way from a node to its parent
    live = materialise(tree.select("node", "parent", *values, *[F.lit(0).cast("long").alias(e) for e in spent]))
    leaves, spliced = [], []
    for number in range(max_rounds):
        # rake: leaves are those that no live node has as parent
        kids = live.groupBy("parent").agg(F.count("*").alias("kids")).withColumnRenamed("parent", "node")
        told = live.join(kids, "node", "left")
        gone = told.filter("kids is null").groupBy(F.col("parent").alias("node"))
        gifts = gone.agg(F.count("*").alias("gone"), *[F.sum(F.col(v) + F.col(e)).alias(f"g_{v}") for v, e in zip(values, spent, strict=True)])
        given = [(F.col(v) + F.coalesce(f"g_{v}", F.lit(0))).alias(v) for v in values]
        raked = materialise(told.join(gifts, "node", "left").select("node", "parent", *given, *spent, F.col("kids").isNull().alias("leaf"), (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids")))
        leaves.append(raked.filter("leaf").select("node", *values))
        rest = raked.filter("not leaf")
        if rest.isEmpty():
            break
        # compress: no two neighbours go at once, as only one can have the higher rank
        child = rest.groupBy(F.col("parent").alias("node")).agg(F.max("node").alias("child"))
        rank = lambda c: F.xxhash64(F.lit(number), c)  # noqa: B023, E731
        goes = (F.col("kids") == 1) & F.col("parent").isNotNull() & (rank("node") > rank("parent")) & (rank("node") > rank("child"))
        told = rest.join(child, "node", "left").withColumn("goes", F.coalesce(goes, F.lit(False)))
        out = told.filter("goes").select(F.col("child").alias("node"), F.col("node").alias("out"), F.col("parent").alias("over"), *[F.col(v).alias(f"o_{v}") for v in values], *[F.col(e).alias(f"o_{e}") for e in spent])
        moved = materialise(told.join(out, "node", "left"))
        spliced.append(moved.filter("out is not null").select(F.col("out").alias("node"), F.col("node").alias("child"), *[(F.col(f"o_{v}") + F.col(e)).alias(v) for v, e in zip(values, spent, strict=True)]))
        onward = [F.when(F.col("out").isNull(), F.col(e)).otherwise(F.col(e) + F.col(f"o_{v}") + F.col(f"o_{e}")).alias(e) for v, e in zip(values, spent, strict=True)]
        live = moved.filter("not goes").select("node", F.when(F.col("out").isNull(), F.col("parent")).otherwise(F.col("over")).alias("parent"), *values, *onward)
    else:
        raise RuntimeError(f"the tree did not contract in {max_rounds} rounds")
    # expand: what was left out last is resolved first
    known = leaves.pop()
    while leaves or spliced:
        if spliced:
            back = spliced.pop()
            total = known.select(F.col("node").alias("child"), *[F.col(v).alias(f"t_{v}") for v in values])
            found = back.join(total, "child").select("node", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values])
            known = known.unionAll(materialise(found))
        known = known.unionAll(leaves.pop())
    return known


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for every distinct sequence of first rebuilt turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. turns: (conv_id, turn, role, text).

    conv_id is the smallest member, parent_conv_id the parent's. Turns that tie go by the hashes of role and text. Repeated rows
    are turns like others; a null turn comes first; null roles and texts are empty; rows without conv_id are left out; an
    empty table has no node, not even the root. Other columns are not read.
    """
    convs, rebuilt = rebuilt_turns(turns.select("conv_id", "turn", "role", "text"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("n"))
    paths = materialise(root.unionAll(prefixes(rebuilt)))
    ids = ["depth", "k1", "k2"]
    groups = paths.groupBy(*ids).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n").alias("n"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = materialise(groups.withColumn("node", F.monotonically_increasing_id()))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    held = materialise(nodes.join(above.filter("depth > 0"), ["depth", "p1", "p2"], "left"))
    kids = held.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")).filter("node is not null")
    held = materialise(held.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)))

    own = ((F.col("n_convs") - 1) * F.col("n")).alias("saved_tokens")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves")
    sums = subtree_sums(held.select("node", "parent", leaf, own), ["n_leaves", "saved_tokens"])
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("m")).select("conv_id", "m.*")
    ends = ends_digests(last.join(held.select("node", *ids), ids).select("node", "conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    none = F.lit(hashlib.sha256().hexdigest())
    return held.join(sums, "node").join(ends, "node", "left").select(*columns, F.coalesce("ends_sha256", none).alias("ends_sha256"))
