"""Prefix trie of conversations: sizes, leaves and savings of all subtrees by an Euler tour."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import Layout, over_rows, row_index, running_sums
from tapeloom.session import pin

# Members whose ids are joined to one string before the strings of a node are digested in order.
CHUNK_IDS = 256
# One link in so many is a ruler; a list of up to LOCAL_LINKS is ranked as it is, a longer one is contracted.
RULERS, LOCAL_LINKS = 16, 4_096
FAMILY, HEADS = 100, 6


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, i, t1, t2, chars``: every turn with its place in its conversation, two hashes of role and
    text, and the code points of its text.

    Order is by turn (null first), then role, then text; a null role or text is empty.  Rows without a
    conv_id belong to no conversation and are left out.  Hot conversations are numbered in blocks.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = row_index(rows, ["conv_id"], ["turn", "role", "text"], "i")
    return rows.select(
        "conv_id", "i", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(7), "text", "role").alias("t2"),
        F.length("text").cast("long").alias("chars"),
    )


def shared_heads(turns: DataFrame) -> DataFrame:
    """Rebuilt conversations: conversation c starts with the first h turns of c - c % 100 (all if fewer, none
    if that one is not there) and goes on with its own turns after its first h; h = crc32(c as text) % 6.

    Takes :func:`numbered_turns`.  Returns ``conv_id, depth, t1, t2, chars, size``, where ``depth`` counts
    from 1 and ``size`` is the rebuilt length; a conversation without a turn has one row of depth 0.
    """
    turns = pin(turns)
    heads = turns.where((F.col("i") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("i", "t1", "t2", "chars"))).alias("head"))
    convs = turns.groupBy("conv_id").agg((F.max("i") + 1).alias("own")).withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % FAMILY,
        "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"),
    })
    convs = convs.join(heads, "base", "left")
    convs = convs.withColumn("head", F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.greatest("h", F.lit(1)))).otherwise(F.slice(F.coalesce("head", F.array()), 1, 0)))
    convs = convs.withColumn("size", F.size("head") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    convs = pin(convs.select("conv_id", "h", "head", F.col("size").cast("long").alias("size")))
    first = convs.select("conv_id", "size", F.explode("head").alias("turn"))
    first = first.select("conv_id", (F.col("turn.i") + 1).alias("depth"), "turn.t1", "turn.t2", "turn.chars", "size")
    rest = turns.join(convs.select("conv_id", "h", F.size("head").alias("n"), "size"), "conv_id").where("i >= h")
    rest = rest.select("conv_id", (F.col("i") - F.col("h") + F.col("n") + 1).alias("depth"), "t1", "t2", "chars", "size")
    zero = F.lit(0).cast("long")
    silent = convs.where("size = 0").select("conv_id", zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), zero.alias("chars"), "size")
    return first.union(rest).union(silent)


def prefix_keys(turns: DataFrame) -> DataFrame:
    """Name the prefix that ends at each turn: ``x1, x2``, and ``p1, p2`` for the one a turn shorter.

    A name is the exclusive or of two hashes over (place, turn) of all turns so far, so that it can be
    carried from block to block; with 128 bits two different prefixes of one length do not meet in
    practice.  The empty prefix is 0, 0."""
    named = turns.withColumns({f"e{k}": F.when(F.col("depth") > 0, F.xxhash64("depth", f"t{k}")).otherwise(F.lit(0)) for k in (1, 2)})

    def build(rows: DataFrame, lay: Layout) -> DataFrame:
        rows = lay.carry(
            rows,
            {f"_s{k}": F.bit_xor(f"e{k}") for k in (1, 2)},
            {f"_b{k}": (lambda w, k=k: F.bit_xor(f"_s{k}").over(w)) for k in (1, 2)},
        )
        return rows.withColumns({
            f"x{k}": F.bit_xor(f"e{k}").over(lay.so_far()).bitwiseXOR(F.coalesce(f"_b{k}", F.lit(0))) for k in (1, 2)
        }).drop("_b1", "_b2")

    keyed = over_rows(named.drop("t1", "t2"), ["conv_id"], ["depth"], build)
    return keyed.withColumns({f"p{k}": F.col(f"x{k}").bitwiseXOR(F.col(f"e{k}")) for k in (1, 2)}).drop("e1", "e2")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            at = (row.depth, row.x1, row.x2)
            if at != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(row.ids.encode())
            else:
                state.update(b"," + row.ids.encode())
        if out:
            yield pd.DataFrame(out, columns=["depth", "x1", "x2", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["depth", "x1", "x2", "ends_sha256"])


def member_digests(members: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """SHA-256 of the comma-joined ids of each key, ascending; ``members`` has ``depth, x1, x2, conv_id``.

    Ids are numbered in blocks and joined in strings of ``chunk_ids``, so that a key with a third of all
    members is sorted by many tasks; what one task reads of it in order, as the digest needs, is a row
    per string, and it holds one at a time."""
    key = ["depth", "x1", "x2"]
    placed = row_index(members.select(*key, "conv_id"), key, ["conv_id"], "_i")
    chunks = placed.groupBy(*key, F.floor(F.col("_i") / chunk_ids).alias("_chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select(*key, "_chunk", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))
    in_order = chunks.repartition(*key).sortWithinPartitions(*key, "_chunk").drop("_chunk")
    return in_order.mapInPandas(_digest, "depth long, x1 long, x2 long, ends_sha256 string")


def nodes_of(prefixes: DataFrame) -> DataFrame:
    """The nodes of the trie: ``node, depth, x1, x2, p1, p2, conv_id, n_convs, chars, ends_sha256``.

    ``node`` is any unique number, ``conv_id`` the smallest member, ``chars`` the length of the last turn.
    The root has depth 0; no conversations make no root."""
    prefixes = pin(prefixes)
    key = ["depth", "x1", "x2"]
    made = prefixes.where("depth > 0").groupBy(*key).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"),
    )
    zero = F.lit(0).cast("long")
    ends = prefixes.where("depth = size")
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in (*key, "p1", "p2")], "conv_id", "n_convs", zero.alias("chars"))
    nodes = made.unionByName(root).join(member_digests(ends), key, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    nodes = nodes.withColumns({"ends_sha256": F.coalesce("ends_sha256", F.lit(nothing)), "node": F.monotonically_increasing_id()})
    return pin(nodes)


def _enter(node: Column) -> Column:
    return node * 2


def _exit(node: Column) -> Column:
    return node * 2 + 1


def tour(nodes: DataFrame) -> DataFrame:
    """The Euler tour as a linked list: ``arc, next, node, parent, parent_conv_id, leaf``.

    Each node has an enter arc (2 node) and an exit arc (2 node + 1).  One sort puts every node before its
    children, so that the row after a node is its first child and the row after a child is its next
    sibling: a node's row makes its enter arc, its row as a child its exit arc, and the parent is the last
    node seen.  Rows are cut into blocks, so a node with a third of all nodes as children is many tasks.
    The exit arc of the root ends the list (null)."""
    own = nodes.select("depth", "x1", "x2", F.lit(0).alias("child"), "node", "conv_id")
    under = nodes.where("depth > 0").select(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), F.lit(1).alias("child"), "node", "conv_id"
    )

    def build(rows: DataFrame, lay: Layout) -> DataFrame:
        rows = rows.withColumn("_parent", F.when(F.col("child") == 0, F.struct("node", "conv_id")))
        rows = lay.carry(
            rows,
            {"_s": F.max_by("_parent", F.when(F.col("child") == 0, F.col("_pos")))},
            {"_b": lambda w: F.last("_s", ignorenulls=True).over(w)},
        )
        ahead = F.lead(F.struct("depth", "x1", "x2", "child", "node")).over(lay.ordered())
        here = F.last("_parent", ignorenulls=True).over(lay.so_far())
        return rows.withColumns({"_next": ahead, "_parent": F.coalesce(here, "_b")}).drop("_b")

    rows = over_rows(own.union(under), [], ["depth", "x1", "x2", "child", "node"], build, after=1)
    child_next = (F.col("_next.child") == 1) & (F.col("_next.depth") == F.col("depth")) & (F.col("_next.x1") == F.col("x1")) & (F.col("_next.x2") == F.col("x2"))
    child_next = F.coalesce(child_next, F.lit(False))
    down = F.when(child_next, _enter(F.col("_next.node")))
    is_child = F.col("child") == 1
    arcs = rows.select(
        F.when(is_child, _exit(F.col("node"))).otherwise(_enter(F.col("node"))).alias("arc"),
        F.coalesce(down, F.when(is_child, _exit(F.col("_parent.node"))).otherwise(_exit(F.col("node")))).alias("next"),
        "node",
        F.when(is_child, F.col("_parent.node")).alias("parent"),
        F.when(is_child, F.col("_parent.conv_id")).alias("parent_conv_id"),
        (~is_child & ~child_next).alias("leaf"),
    )
    null = F.lit(None).cast("long")
    last = nodes.where("depth = 0").select(
        _exit(F.col("node")).alias("arc"), null.alias("next"), "node", null.alias("parent"), null.alias("parent_conv_id"), F.lit(False).alias("leaf")
    )
    return arcs.union(last)


def distances(links: DataFrame, rulers: int = RULERS, local: int = LOCAL_LINKS, level: int = 0) -> DataFrame:
    """``arc, dist``: the sum of ``step`` from each link of one linked list to its end.

    ``links`` has ``arc, next, step``, with a null next at the end.  Links whose hash says so are rulers;
    pointers are doubled until each meets the next ruler, which takes a number of rounds that grows with
    the logarithm of the longest run between rulers, and the list of rulers, a part in ``rulers``, is
    ranked the same way.  Joins are on links, each of which is pointed to by one link, so no key is hot.
    A list of at most ``local`` links, a constant, is walked at once.
    """
    spark = links.sparkSession
    links = pin(links)
    size = links.count()
    if size <= local:
        known = {r["arc"]: (r["next"], r["step"]) for r in links.collect()}
        before = {n: a for a, (n, _) in known.items()}
        out, at, total = [], before.get(None), 0
        while at is not None:
            total += known[at][1]
            out.append((at, total))
            at = before.get(at)
        return spark.createDataFrame(out, "arc long, dist long")
    last = links.where("next is null").select("arc").first()["arc"]

    def rules(arc: str) -> Column:
        return (F.pmod(F.xxhash64(arc, F.lit(level)), F.lit(rulers)) == 0) | (F.col(arc) == last)

    # At the end of the list the step is 0 or its own weight; it is added with the rulers.
    state = links.where("next is not null").select("arc", F.col("next").alias("to"), F.col("step").alias("d"))
    while True:
        open_ = state.where(~rules("to"))
        known = state.where(~rules("arc")).select(F.col("arc").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        jumped = open_.join(known, "to").select("arc", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"))
        state = pin(state.where(rules("to")).union(jumped))
        if state.where(~rules("to")).isEmpty():
            break
    short = state.where(rules("arc")).select("arc", F.col("to").alias("next"), F.col("d").alias("step"))
    short = short.union(links.where("next is null").select("arc", "next", "step"))
    ranked = distances(short, rulers, local, level + 1)
    far = state.join(ranked.select(F.col("arc").alias("to"), F.col("dist").alias("rest")), "to")
    far = far.select("arc", (F.col("d") + F.col("rest")).alias("dist"))
    return far.union(ranked.where(F.col("arc") == last))


def conversation_trie(prefixes: DataFrame, rulers: int = RULERS, local: int = LOCAL_LINKS) -> DataFrame:
    """One row per distinct prefix of conversations, from the root down.

    Takes :func:`prefix_keys`.  Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null
    for the root), ``n_convs``, ``n_children``, ``n_leaves`` (nodes without children in the subtree, which
    its top is part of), ``saved_tokens`` (sum over the subtree of (members - 1) times the code points of
    the node's last text) and ``ends_sha256`` (digest of the ids of members that end here, ascending and
    comma-joined).  All conversations count as members of the root; none of them make no rows.

    The tour is ranked as a linked list, leaves and savings are summed up along it, and a subtree's value
    is the sum at its exit less the sum before its enter.
    """
    nodes = nodes_of(prefixes)
    arcs = pin(tour(nodes))
    ranks = distances(arcs.select("arc", "next", F.when(F.col("next").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("step")), rulers, local)
    weights = nodes.select(_enter(F.col("node")).alias("arc"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    on_tour = arcs.select("arc", F.col("leaf").cast("long").alias("leaf")).join(ranks, "arc").join(weights, "arc", "left")
    zero = F.lit(0).cast("long")
    on_tour = on_tour.select("arc", (-F.col("dist")).alias("at"), "leaf", F.coalesce("saved", zero).alias("saved"))
    summed = running_sums(on_tour, [], ["at"], {"leaves": F.col("leaf"), "saves": F.col("saved")})
    leaving = F.col("arc") % 2 == 1
    null = F.lit(None).cast("long")

    def part(rows: DataFrame, **given: Column) -> DataFrame:
        fields = ("leaves", "saves", "leaves_before", "saves_before", "parent_conv_id", "children")
        return rows.select("node", *[given.get(f, null).alias(f) for f in fields])

    sums = part(
        summed.withColumn("node", F.shiftright("arc", 1)),
        leaves=F.when(leaving, F.col("leaves")), saves=F.when(leaving, F.col("saves")),
        leaves_before=F.when(~leaving, F.col("leaves") - F.col("leaf")), saves_before=F.when(~leaving, F.col("saves") - F.col("saved")),
    )
    kin = arcs.where("parent is not null")
    parents = part(kin, parent_conv_id=F.col("parent_conv_id"))
    children = part(kin.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n")), children=F.col("n"))
    facts = sums.unionByName(parents).unionByName(children).groupBy("node").agg(
        *[F.max(f).alias(f) for f in ("leaves", "saves", "leaves_before", "saves_before", "parent_conv_id", "children")]
    )
    return nodes.join(facts, "node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", zero).alias("n_children"),
        (F.col("leaves") - F.col("leaves_before")).alias("n_leaves"), (F.col("saves") - F.col("saves_before")).alias("saved_tokens"), "ends_sha256",
    )
