"""Parent-child links to full hierarchies.

The nodes are range-partitioned by (tree, start, id), so a partition holds whole trees, or a run of a
tree too large for one. Every partition contracts its own parent chains to the fragment's exits: a
root, a circle, or a parent that lies in another partition. The parents that other fragments point at
form a much smaller quotient forest, which is solved in the same way over fewer partitions, down to one of bounded size.
Its answers are then joined back to the exits only. A large quotient that hardly shrinks (links that jump to and fro between
partitions) is solved by doubling its links in joins instead, so no task ever takes more than its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hex_id, materialize, parent_id

#: Nodes of a quotient forest that one task solves whole.
ONE_TASK = 400_000

_LOCAL = (
    "tree string, node string, ord bigint, end_state string, top string, exit_to string, hops bigint, "
    "circle boolean, chain array<string>"
)


def _contract(keep_chains: bool):
    """Contraction of one partition; ``keep_chains`` keeps the chain of every node, else of the exits only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        n = t.num_rows
        key = pc.binary_join_element_wise(t["tree"], t["node"], "\u0001")
        parent_key = pc.binary_join_element_wise(t["tree"], t["parent"], "\u0001")
        found = pc.index_in(parent_key, value_set=pc.fill_null(key, "")).combine_chunks()
        has_parent = t["parent"].is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        parent = np.where(has_parent, pc.fill_null(found, -1).to_numpy(zero_copy_only=False), -1).astype(np.int64)
        weight = t["weight"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)

        me = np.arange(n, dtype=np.int64)
        jump = np.where(parent >= 0, parent, me)
        hops = np.where(parent >= 0, weight, 0)
        for _ in range(int(n).bit_length() + 1):  # pointer doubling
            step = jump[jump]
            if np.array_equal(step, jump):
                break
            hops = hops + hops[jump]
            jump = step
        trapped = parent[jump] >= 0
        circle = np.zeros(n, dtype=bool)
        circle[jump[trapped]] = True  # n steps on, every trapped node stands on its circle, and all of it is reached

        top = jump
        exits = ~trapped & has_parent[top]
        state = t["end_state"].combine_chunks().to_numpy(zero_copy_only=False)
        ends = np.where(trapped, np.where(circle, "circle", "trapped"), np.where(exits, "exit", state[top]))
        want = ~trapped & (exits | keep_chains)
        ids = t["node"].combine_chunks()
        length = np.where(want, 1, 0).astype(np.int64)
        cur = np.where(want & (parent >= 0), parent, -1)
        active = np.flatnonzero(cur >= 0)
        while len(active):
            length[active] += 1
            cur[active] = parent[cur[active]]
            active = active[cur[active] >= 0]
        offsets = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(length, out=offsets[1:])
        flat = np.zeros(int(offsets[-1]), dtype=np.int64)
        active, cur, k = np.flatnonzero(want), me.copy(), 0
        while len(active):
            flat[offsets[active + 1] - 1 - k] = cur[active]
            k += 1
            active = active[parent[cur[active]] >= 0]
            cur[active] = parent[cur[active]]

        size = 20_000
        top_ids, exit_ids = ids.take(pa.array(top)), t["parent"].combine_chunks().take(pa.array(top, mask=~exits))
        trees, order = t["tree"].combine_chunks(), t["ord"].combine_chunks()
        for a in range(0, n, size):
            b = min(n, a + size)
            part = flat[offsets[a] : offsets[b]]
            chain = pa.ListArray.from_arrays(
                pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32)), ids.take(pa.array(part))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    trees.slice(a, b - a), ids.slice(a, b - a), order.slice(a, b - a), pa.array(ends[a:b], pa.string()),
                    top_ids.slice(a, b - a),
                    exit_ids.slice(a, b - a),
                    pa.array(hops[a:b]), pa.array(circle[a:b]), chain,
                ],
                names=["tree", "node", "ord", "end_state", "top", "exit_to", "hops", "circle", "chain"],
            )

    return run


def _solve(nodes: DataFrame, keep_chains: bool, partitions: int | None, n_nodes: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Contract and, as long as fragments point at each other, solve their quotient forest.

    ``nodes`` has (tree, node, parent, ord, weight, end_state). Returns the contraction and the solved
    quotient nodes, or None if nothing crosses fragments.
    """
    if partitions == 1:
        spread = nodes.coalesce(1)
    elif partitions:
        spread = nodes.repartitionByRange(partitions, "tree", "ord", "node")
    else:
        spread = nodes.repartitionByRange("tree", "ord", "node")
    local = materialize(spread.mapInArrow(_contract(keep_chains), _LOCAL))
    exits = local.where("exit_to IS NOT NULL")
    wanted = exits.select(F.col("tree"), F.col("exit_to").alias("node")).distinct()
    targets = local.join(wanted, ["tree", "node"], "left_semi")
    quotient = materialize(
        targets.select(
            "tree", "node", F.col("exit_to").alias("parent"), "ord", "chain", "end_state",
            (F.col("hops") + 1).alias("weight"),
        )
    )
    size = quotient.count()
    if not size:
        return local, None
    smaller = quotient.select("tree", "node", "parent", "ord", "weight", "end_state")
    if size > ONE_TASK and n_nodes is not None and size > n_nodes // 2:
        answer = _doubled(smaller, size)
    else:
        answer = _expand(*_solve(smaller, True, -(-size // ONE_TASK), size))
    own = quotient.select("tree", "node", F.col("chain").alias("own_chain"))
    links = answer.where(~F.col("end_state").isin("circle", "trapped")).select(
        "tree", "node", F.posexplode("chain").alias("k", "link")
    )
    part = own.select("tree", F.col("node").alias("link"), F.col("own_chain").alias("part"))
    whole = (
        links.join(part, ["tree", "link"])
        .groupBy("tree", "node")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])).alias("whole"))
    )
    solved = answer.join(own, ["tree", "node"]).join(whole, ["tree", "node"], "left")
    solved = solved.select(
        "tree", "node", "end_state", "circle", "own_chain", F.col("whole").alias("chain"),
        F.coalesce(F.try_element_at("whole", F.lit(1)), F.col("root")).alias("root"),
        F.when(F.size("whole") > 0, F.size("whole") - 1).cast("bigint").alias("depth"),
    )
    return local, materialize(solved)


def _reached(nodes: DataFrame, n: int, chains: bool) -> DataFrame:
    """Pointer doubling: (tree, node, to, lost, top, end_state, chain). Every round joins the nodes still on their way with those they have reached.

    At the end ``to`` is null for chains that end in a root, ``lost`` true where the parent is not there, and the others run in circles:
    after n steps or more ``to`` stands on the circle.
    """
    chain = F.array("node") if chains else F.array().cast("array<string>")
    cur = materialize(
        nodes.select("tree", "node", F.col("parent").alias("to"), F.lit(False).alias("lost"), F.col("node").alias("top"), "end_state", chain.alias("chain"))
    )
    for _ in range(int(n).bit_length() + 1):
        moving = cur.where("to IS NOT NULL AND NOT lost")
        if moving.isEmpty():
            break
        there = cur.select(*[F.col(c).alias(f"{c}_") for c in cur.columns])
        met = moving.join(there, (F.col("tree") == F.col("tree_")) & (F.col("to") == F.col("node_")), "left")
        hit = F.col("node_").isNotNull()
        onward = lambda c: F.when(hit, F.col(f"{c}_")).otherwise(F.col(c)).alias(c)
        step = met.select(
            "tree", "node", onward("to"), F.when(hit, F.col("lost_")).otherwise(True).alias("lost"), onward("top"), onward("end_state"),
            F.when(hit, F.concat("chain_", "chain")).otherwise(F.col("chain")).alias("chain"),
        )
        cur = materialize(cur.where("to IS NULL OR lost").unionByName(step))
    return cur


def _doubled(nodes: DataFrame, n: int) -> DataFrame:
    """Answers as of ``_expand`` by pointer doubling; circles are found first, as the chains of what runs in them would never end."""
    ends = _reached(nodes, n, False)
    stuck = ends.where("to IS NOT NULL AND NOT lost").select("tree", "node", "to")
    ring = stuck.select("tree", F.col("to").alias("node")).distinct().withColumn("circle", F.lit(True))
    loops = stuck.join(ring, ["tree", "node"], "left").select(
        "tree", "node", F.when(F.col("circle"), "circle").otherwise("trapped").alias("end_state"), F.col("node").alias("root"),
        F.lit(None).cast("bigint").alias("depth"), F.coalesce("circle", F.lit(False)).alias("circle"), F.array("node").alias("chain"),
    )
    free = _reached(nodes.join(stuck, ["tree", "node"], "left_anti"), n, True)
    return materialize(
        free.select(
            "tree", "node", F.when(F.col("lost"), "orphan").otherwise(F.col("end_state")).alias("end_state"), F.col("top").alias("root"),
            (F.size("chain") - 1).cast("bigint").alias("depth"), F.lit(False).alias("circle"), "chain",
        ).unionByName(loops)
    )


def _expand(local: DataFrame, above: DataFrame | None) -> DataFrame:
    """Answers (tree, node, end_state, root, depth, circle, chain) of a contraction from those of its quotient."""
    done = local.where("exit_to IS NULL").select(
        "tree", "node", "end_state", F.col("top").alias("root"), F.col("hops").alias("depth"), "circle", "chain"
    )
    exits = local.where("exit_to IS NOT NULL")
    orphan = exits.select(
        "tree", "node", F.lit("orphan").alias("end_state"), F.col("top").alias("root"), F.col("hops").alias("depth"),
        "circle", "chain", "exit_to",
    )
    if above is None:
        return done.unionByName(orphan.drop("exit_to"))
    up = above.select(
        F.col("tree").alias("__tree"), F.col("node").alias("__node"), F.col("end_state").alias("__end"),
        F.col("root").alias("__root"), F.col("depth").alias("__depth"), F.col("chain").alias("__chain"),
    )
    joined = orphan.join(up, (F.col("tree") == F.col("__tree")) & (F.col("exit_to") == F.col("__node")), "left")
    hit = F.col("__end").isNotNull()
    stuck = F.col("__end").isin("circle", "trapped")
    rest = joined.select(
        "tree",
        "node",
        F.when(stuck, F.lit("trapped")).when(hit, F.col("__end")).otherwise(F.lit("orphan")).alias("end_state"),
        F.when(hit, F.col("__root")).otherwise(F.col("root")).alias("root"),
        F.when(hit, F.col("depth") + 1 + F.col("__depth")).otherwise(F.col("depth")).alias("depth"),
        "circle",
        F.when(hit & ~stuck, F.concat("__chain", "chain")).otherwise(F.col("chain")).alias("chain"),
    )
    # a circle through several fragments holds the chains of the quotient nodes on it
    ring = above.where("circle").select("tree", F.explode("own_chain").alias("node")).distinct()
    ring = ring.withColumn("__ring", F.lit(True))
    rest = rest.join(ring, ["tree", "node"], "left")
    on = F.coalesce("__ring", F.lit(False))
    rest = rest.withColumn("end_state", F.when(on, F.lit("circle")).otherwise(F.col("end_state"))).withColumn(
        "circle", F.col("circle") | on
    )
    return done.unionByName(rest.drop("__ring"))


def span_nodes(spans: DataFrame) -> DataFrame:
    """One node per span: copies are folded, the first delivery's parent counts. Rows without ids cannot be linked."""
    ids = spans.select(
        hex_id("trace_id").alias("tree"), hex_id("span_id").alias("node"), parent_id("parent_span_id").alias("parent"),
        F.coalesce("start_time_unix_nano", F.lit(0)).alias("ord"), "wal_seq",
    )
    return (
        ids.where(F.col("tree").isNotNull() & F.col("node").isNotNull())
        .groupBy("tree", "node")
        .agg(F.min(F.struct("wal_seq", "parent", "ord")).alias("f"))
        .select(
            "tree", "node", "f.parent", "f.ord", F.lit(1).cast("bigint").alias("weight"), F.lit("root").alias("end_state")
        )
    )


def resolve(nodes: DataFrame, chains: bool = True) -> DataFrame:
    """Solve (tree, node, parent, ord, weight, end_state) rows, unique by (tree, node).

    Without ``chains`` only ``circle`` is to be used: chains, and what is derived from them, are then kept
    for the nodes whose chain leaves its fragment.

    Returns tree, node, end_state, root, depth, circle and chain. ``end_state`` is root (the chain ends in
    a node without a parent), orphan (in a node whose parent is not there), circle (the node lies on a
    circle) or trapped (its chain runs into one); the last two have no root, depth or chain.
    """
    local, above = _solve(nodes, chains, None)
    out = _expand(local, above)
    loop = F.col("end_state").isin("circle", "trapped")
    return out.select(
        "tree", "node", "end_state", "circle", F.when(~loop, F.col("root")).alias("root"),
        F.when(~loop, F.col("depth")).alias("depth"),
        F.when(~loop, F.col("chain")).alias("chain"),
    )


def span_hierarchy(spans: DataFrame) -> DataFrame:
    """Per span its root, depth and path (span ids from the root down, joined by slashes), or how it fails to have them."""
    return resolve(span_nodes(spans)).select(
        F.col("tree").alias("trace_id"), F.col("node").alias("span_id"), "end_state",
        F.col("root").alias("root_span_id"), "depth", F.array_join("chain", "/").alias("path"),
    )


def span_descendants(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, descendant_id, distance): every span below every span; circles have none."""
    solved = resolve(span_nodes(spans)).where("chain IS NOT NULL")
    pairs = solved.select(
        F.col("tree").alias("trace_id"), F.col("node").alias("descendant_id"), "depth",
        F.posexplode("chain").alias("at", "span_id"),
    )
    return pairs.where("at < depth").select(
        "trace_id", "span_id", "descendant_id", (F.col("depth") - F.col("at")).cast("bigint").alias("distance")
    )


def spans_on_circles(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id) of spans from which following the parent links leads back to the span."""
    solved = resolve(span_nodes(spans), chains=False)
    return solved.where("circle").select(F.col("tree").alias("trace_id"), F.col("node").alias("span_id"))
