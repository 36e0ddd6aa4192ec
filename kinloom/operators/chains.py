"""Best collinear chains of anchors, and flow clustering of a weighted graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinloom.functions.scratch import Workspace
from kinloom.operators.graph import components

#: Ranks of a block of chaining, and rounds before it gives up.
SIDE, ROUNDS = 4_096, 256
#: Anchors of a task, in whole blocks, and anchors that it compares at once with what may come before them.
TASK, PAIRS = 250_000, 1_000_000
#: Entries of a component, in both directions, that a task clusters; it is given so many, of one component or several.
WHOLE = 50_000
CHAIN = "pair string, id long, x long, y long, w double, score double, chain long, ord long, moved boolean"


def chained(anchors: DataFrame, workspace: Workspace, reach: int = 10, gap: float = 1.0, least: float = 0.0, side: int = SIDE) -> DataFrame:
    """(pair, id, score, chain, ord): for each anchor the best chain that ends in it.

    anchors are (pair, id, x, y, w): a pair of chromosomes, an id, unique in it, the ranks of both genes and a weight. An anchor may follow another if both ranks
    are greater, by `reach` at most; a chain's score is the sum of its weights less `gap` for each rank that the longer of two steps passes over. A chain goes on only
    where that leaves more than `least`; of equal predecessors that of the smaller id counts. `chain` is the id of the chain's first anchor, ord the place in it, from 1.
    Rows without a pair, id, rank or weight take no part. For chains that run backwards give y with its sign changed.

    No pair of chromosomes is brought together. Ranks x are cut into blocks of `side`; blocks are solved many at a time inside tasks, and see, of the block before, the last
    `reach` ranks with the scores of the round before. The next round takes only those blocks that saw a rank whose score has changed since, so a pair of chromosomes of n
    ranks takes n / side rounds at most, however many anchors and pairs there are, and one that fits a block takes one.
    """
    side = max(side, reach)
    cols = [F.col("pair").cast("string").alias("pair"), *[F.col(c).cast("long").alias(c) for c in ("id", "x", "y")], F.col("w").cast("double").alias("w")]
    a = anchors.select(*cols).filter("pair IS NOT NULL AND id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL")
    held = Observation()
    state = workspace.write(a.observe(held, F.count("*").alias("n")), "chains-0").select("*", F.col("w").alias("score"), F.col("id").alias("chain"), F.lit(1).cast("long").alias("ord"))
    tasks = max(1, -(-held.get["n"] // TASK))
    block = lambda c: F.floor(c / side)
    due: DataFrame | None = None

    def solve(table: pa.Table) -> pa.Table:
        return best_in_blocks(table, side, reach, gap, least)

    for k in range(1, ROUNDS + 1):
        dealt = state.drop("moved").select("*", F.explode(F.array_distinct(F.array(block(F.col("x")), block(F.col("x") + reach)))).alias("block")).withColumn("mine", F.col("block") == block(F.col("x")))
        dealt = dealt if due is None else dealt.join(due, ["pair", "block"], "left_semi")
        found = dealt.groupBy(F.pmod(F.xxhash64("pair", "block"), F.lit(tasks)).alias("deal")).applyInArrow(solve, CHAIN)
        if due is not None:
            rest = state.withColumn("block", block(F.col("x"))).join(due, ["pair", "block"], "left_anti")
            found = found.unionByName(rest.drop("block").withColumn("moved", F.lit(False)))
        border, left = F.col("moved") & (block(F.col("x")) != block(F.col("x") + reach)), Observation()
        state = workspace.write(found.observe(left, F.count_if(border).alias("n")), f"chains-{k}")
        if not left.get["n"]:
            workspace.drop(f"chains-{k - 1}")
            return state.select("pair", "id", "score", "chain", "ord")
        due = workspace.write(state.filter(border).select("pair", block(F.col("x") + reach).alias("block")).distinct(), f"chains-due-{k}")
        workspace.drop(f"chains-{k - 1}")
    raise RuntimeError(f"chains did not settle in {ROUNDS} rounds: give larger blocks")


def best_in_blocks(table: pa.Table, side: int, reach: int, gap: float, least: float) -> pa.Table:
    """The anchors that are their block's own with their best scores, and whether these moved; the others have theirs already.

    All blocks go on together, a rank at a time: those of one rank do not follow each other.
    """
    col = lambda c: table.column(c).to_numpy()
    names = table.column("pair").combine_chunks().dictionary_encode()
    pair = names.indices.to_numpy()
    order = np.lexsort((col("id"), col("y"), col("x"), col("block"), pair))
    pair, block, x, y, w, ids, mine = (c[order] for c in (pair, *map(col, ("block", "x", "y", "w", "id", "mine"))))
    score, chain, place = (col(c)[order].copy() for c in ("score", "chain", "ord"))
    old = score.copy(), chain.copy(), place.copy()
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])])[: len(x)]
    rank = x - block * side + reach  # not below 0, as no guest is further away
    at = (np.cumsum(new) - 1) * (side + reach) + rank
    # what may come before an anchor lies side by side: its block's ranks from `reach` before it up to it
    first, stop = np.searchsorted(at, at - np.minimum(rank, reach)), np.searchsorted(at, at)
    own = np.flatnonzero(mine)
    own = own[np.argsort(rank[own], kind="stable")]
    starts = np.flatnonzero(np.diff(rank[own], prepend=-1))
    for s, e in zip(starts.tolist(), np.append(starts, len(own))[1:].tolist(), strict=True):
        while s < e:
            held = np.cumsum(stop[own[s:e]] - first[own[s:e]])
            cut = s + max(1, int(np.searchsorted(held, PAIRS, "right")))
            _follow(own[s:cut], first, stop, x, y, w, ids, score, chain, place, reach, gap, least)
            s = cut
    moved = (score != old[0]) | (chain != old[1]) | (place != old[2])
    out = {"pair": names.dictionary.take(pa.array(pair[mine])), **dict(zip(("id", "x", "y", "w", "score", "chain", "ord", "moved"), (c[mine] for c in (ids, x, y, w, score, chain, place, moved)), strict=True))}
    return pa.table(out, schema=pa.schema([("pair", pa.string()), *[(c, pa.int64()) for c in ("id", "x", "y")], *[(c, pa.float64()) for c in ("w", "score")], *[(c, pa.int64()) for c in ("chain", "ord")], ("moved", pa.bool_())]))


def _follow(i, first, stop, x, y, w, ids, score, chain, place, reach: int, gap: float, least: float) -> None:
    """Gives anchors i their best predecessors, whose scores are known."""
    n = stop[i] - first[i]
    of = np.repeat(np.arange(len(i)), n)
    before = np.arange(len(of)) - (n.cumsum() - n - first[i])[of]
    dy = y[i][of] - y[before]
    fits = ((dy > 0) & (dy <= reach)).nonzero()[0]
    score[i], chain[i], place[i] = w[i], ids[i], 1
    if not len(fits):
        return
    of, before, dy = of[fits], before[fits], dy[fits]
    gain = score[before] - gap * (np.maximum(x[i][of] - x[before], dy) - 1)
    new = of[1:] != of[:-1]
    top = np.maximum.reduceat(gain, np.concatenate([[0], new.nonzero()[0] + 1]))
    best = ((gain == top[np.concatenate([[0], new.cumsum()])]) & (gain > least)).nonzero()[0]
    if not len(best):
        return
    best = best[np.lexsort((ids[before[best]], of[best]))]
    best = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])]
    to, by = i[of[best]], before[best]
    score[to], chain[to], place[to] = w[to] + gain[best], chain[by], place[by] + 1


def chain_ends(found: DataFrame, score: float = 0.0, anchors: int = 1) -> DataFrame:
    """(pair, chain, end, score, n) of chains with at least such a score and so many anchors: of those with one first anchor the best, ties to the smaller id."""
    best = found.groupBy("pair", "chain").agg(F.max_by(F.struct("id", "score", "ord"), F.struct("score", -F.col("id"))).alias("b"))
    return best.select("pair", "chain", F.col("b.id").alias("end"), F.col("b.score").alias("score"), F.col("b.ord").alias("n")).filter((F.col("score") >= score) & (F.col("n") >= anchors))


def flow_clusters(edges: DataFrame, workspace: Workspace, inflation: float = 2.0, keep: int = 32, least: float = 1e-4, digits: int = 6, rounds: int = 60, whole: int = WHOLE) -> DataFrame:
    """(node, cluster): Markov clustering of edges (a, b, w), which count in both directions; cluster is its least node.

    Columns of the matrix are where a walk from a node goes. Each round squares the matrix (a join of entries on the node in between, summed), raises entries to
    the power `inflation`, lets those below `least` and all but the `keep` greatest of a column go (ties to the smaller node), and makes columns sum to 1.
    So no column has more than `keep` entries, and a round multiplies no more than `keep` for each entry. It ends when no entry changes in `digits` places; what still moves then
    after `rounds` is taken as it is. Clusters are the components of the entries that are left. Each node has a loop as heavy as its heaviest edge. Edges
    without an end or with a weight that is not above 0 do not count, nor do those from a node to itself; of repeated edges the weights are summed.

    A walk stays in its component, so components of at most `whole` entries are clustered many at a time inside tasks, and no product of theirs moves. Larger ones, if
    there are any, take the rounds together.
    """
    e = edges.select("a", "b", F.col("w").cast("double").alias("w")).filter("a <> b AND w > 0")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    both = workspace.write(both, "flow-edges")
    parts = components(both.select("a", "b"), workspace, "flow-parts").select(F.col("node").alias("a"), "component")
    both = workspace.write(both.join(parts.hint("merge"), "a"), "flow-of")
    large = workspace.write(both.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > whole).select("component"), "flow-large")
    kind = both.schema["a"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        return flow_inside(table, inflation, keep, least, digits, rounds)

    deal = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-both.count() // max(1, whole)))))
    out = both.join(large, "component", "left_anti").select(deal.alias("deal"), "a", "b", "w").groupBy("deal").applyInArrow(solve, f"node {kind}, cluster {kind}")
    if large.isEmpty():
        return out
    return out.unionByName(_flow_rounds(both.join(large, "component", "left_semi").select("a", "b", "w"), workspace, inflation, keep, least, digits, rounds))


def _flow_rounds(both: DataFrame, workspace: Workspace, inflation: float, keep: int, least: float, digits: int, rounds: int) -> DataFrame:
    loops = both.groupBy("a").agg(F.max("w").alias("w")).select("a", F.col("a").alias("b"), "w")
    m = workspace.write(_columns(both.unionByName(loops).select(F.col("b").alias("row"), F.col("a").alias("col"), F.col("w").alias("v")), 1.0, keep, 0.0, digits), "flow-0")
    seen = None
    for k in range(1, rounds + 1):
        left, right = m.select("row", F.col("col").alias("mid"), F.col("v").alias("v1")), m.select(F.col("row").alias("mid"), "col", F.col("v").alias("v2"))
        squared = left.join(right, "mid").groupBy("row", "col").agg(F.sum(F.col("v1") * F.col("v2")).alias("v"))
        m = workspace.write(_columns(squared, inflation, keep, least, digits), f"flow-{k}")
        state = tuple(m.agg(F.count("*"), F.sum(F.xxhash64("row", "col", "v").cast("decimal(38,0)"))).first())
        workspace.drop(f"flow-{k - 1}")
        if state == seen:
            break
        seen = state
    nodes = both.select(F.col("a").alias("node")).distinct()
    found = components(m.select(F.col("row").alias("a"), F.col("col").alias("b")), workspace, "flow-components")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def flow_inside(table: pa.Table, inflation: float, keep: int, least: float, digits: int, rounds: int) -> pa.Table:
    """(node, cluster) of whole components (a, b, w), edges in both directions: the rounds on arrays, in order of column and row."""
    names, a = np.unique(np.array(table.column("a").to_pylist(), object), return_inverse=True)
    b, w, n = np.searchsorted(names, np.array(table.column("b").to_pylist(), object)), table.column("w").to_numpy(), len(names)
    loops = np.zeros(n)
    np.maximum.at(loops, a, w)

    def pruned(row: np.ndarray, col: np.ndarray, v: np.ndarray, power: float, least: float) -> tuple[np.ndarray, ...]:
        v = v**power
        v = v / np.bincount(col, v, n)[col]
        some = np.flatnonzero(v >= least)
        some = some[np.lexsort((row[some], -v[some], col[some]))]
        sizes = np.bincount(col[some], minlength=n)
        some = some[np.arange(len(some)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < keep]
        row, col, v = row[some], col[some], v[some]
        v = np.floor(v / np.bincount(col, v, n)[col] * 10.0**digits + 0.5) / 10.0**digits
        some = np.flatnonzero(v > 0)
        some = some[np.lexsort((row[some], col[some]))]
        return row[some], col[some], v[some]

    m = pruned(np.concatenate([b, np.arange(n)]), np.concatenate([a, np.arange(n)]), np.concatenate([w, loops]), 1.0, 0.0)
    for _ in range(rounds):
        row, col, v = m
        sizes = np.bincount(col, minlength=n)
        k = sizes[row]  # an entry meets the column of the node that it leads to
        at = np.repeat((np.cumsum(sizes) - sizes)[row], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        key, place = np.unique(np.repeat(col, k) * n + row[at], return_inverse=True)
        before, m = m, pruned(key % n, key // n, np.bincount(place, v[at] * np.repeat(v, k)), inflation, least)
        if all(map(np.array_equal, m, before)):
            break
    label, before = np.arange(n), None
    while before is None or not np.array_equal(label, before):
        before = label.copy()
        np.minimum.at(label, m[0], before[m[1]])
        np.minimum.at(label, m[1], before[m[0]])
        label = label[label]
    kind = table.schema.field("a").type
    return pa.table({"node": pa.array(names, kind), "cluster": pa.array(names[label], kind)})


def _columns(entries: DataFrame, power: float, keep: int, least: float, digits: int) -> DataFrame:
    """Columns raised, pruned and made to sum to 1. Columns are gathered as their `keep` greatest entries, of which partial results hold no more."""
    whole = entries.groupBy("col").agg(F.sum(F.pow("v", F.lit(power))).alias("total"))
    share = entries.join(whole, "col").select("col", "row", (F.pow("v", F.lit(power)) / F.col("total")).alias("v")).filter(F.col("v") >= least)
    top = share.groupBy("col").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("o"), "row"))), 1, keep).alias("t"))
    top = top.withColumn("sum", F.aggregate("t", F.lit(0.0), lambda s, x: s - x["o"]))
    one = top.select("col", F.explode("t").alias("t"), "sum").select(F.col("t.row").alias("row"), "col", F.round(-F.col("t.o") / F.col("sum"), digits).alias("v"))
    return one.filter("v > 0")
