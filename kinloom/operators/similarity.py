"""k-mer similarity, average-linkage order, and trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a k-mer and classes of its checksum. Fixed values.
K, CLASSES = 5, 4_096
#: Sequences that one task orders, at most.
LARGEST_GROUP = 2_000


def kmer_classes(seq: Column, k: int = K) -> Column:
    """The distinct checksum classes of a sequence's k-mers, letters only, in upper case.

    The checksum's high half is a multiple of 65,536, so modulo 4,096 it is one more than the sum of the letters' codes.
    """
    s = F.regexp_replace(F.upper(F.coalesce(seq, F.lit(""))), "[^A-Z]", "")
    code = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii)
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(s) - k)))
    sums = F.transform(starts, lambda i: F.aggregate(F.slice(code, i + 1, k), F.lit(1), lambda a, c: a + c) % CLASSES)
    return F.coalesce(F.array_sort(F.array_distinct(sums)), F.array().cast("array<int>"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets: 1 for two empty ones, 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both))


def distances(rows: DataFrame) -> DataFrame:
    """1 - similarity of each two sequences (grp, gene_id, seq) of a group. Groups are views of at most some 150 sequences; all of
    their pairs are the result."""
    sets = rows.select("grp", "gene_id", kmer_classes(F.col("seq")).alias("k"))
    x, y = sets.alias("x"), sets.alias("y")
    pairs = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.gene_id") < F.col("y.gene_id")))
    return pairs.select(F.col("x.grp").alias("grp"), F.col("x.gene_id").alias("a"), F.col("y.gene_id").alias("b"), F.round(1 - jaccard(F.col("x.k"), F.col("y.k")), 6).alias("distance"))


def average_linkage(d: np.ndarray) -> list[int]:
    """Leaves from left to right. The closest two clusters merge, the first pair of equals in order of creation; a new cluster's
    distances are means weighted by size."""
    n = len(d)
    if n < 2:
        return list(range(n))
    size, leaves = {i: 1 for i in range(n)}, {i: [i] for i in range(n)}
    full = np.full((2 * n - 1, 2 * n - 1), np.inf)
    full[:n, :n] = d
    alive = list(range(n))
    for new in range(n, 2 * n - 1):
        sub = full[np.ix_(alive, alive)]
        sub[np.tril_indices(len(alive))] = np.inf
        i, j = (alive[k] for k in divmod(int(np.argmin(sub)), len(alive)))
        rest = [m for m in alive if m not in (i, j)]
        size[new], leaves[new] = size[i] + size[j], leaves[i] + leaves[j]
        mean = (size[i] * full[i, rest] + size[j] * full[j, rest]) / size[new]
        full[new, rest], full[rest, new] = mean, mean
        alive = [*rest, new]
    return leaves[alive[0]]


def track_order(rows: DataFrame) -> DataFrame:
    """(grp, gene_id, rank): sequences of a group in the order of average linkage of their distances, from 0.

    One task orders one group. A view has some 150 tracks; a group of more than LARGEST_GROUP is an error, found before any task has it whole.
    """
    n = F.count("*").over(Window.partitionBy("grp"))  # dealt as the ordering is: no shuffle of its own
    sets = rows.select("grp", "gene_id", kmer_classes(F.col("seq")).alias("k"), n.alias("n"))
    sets = sets.select("grp", "gene_id", F.when(F.col("n") <= LARGEST_GROUP, F.col("k")).otherwise(F.raise_error(F.format_string("%d sequences are too many to order", "n"))).alias("k"))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene_id").reset_index(drop=True)
        bags = [set(k) for k in pdf["k"]]
        d = np.zeros((len(bags), len(bags)))
        for i, a in enumerate(bags):
            for j in range(i + 1, len(bags)):
                b = bags[j]
                d[i, j] = d[j, i] = 0.0 if not a and not b else 1.0 - len(a & b) / len(a | b)
        found = average_linkage(d)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "gene_id": pdf["gene_id"].iloc[found].to_numpy(), "rank": range(len(found))})

    return sets.groupBy("grp").applyInPandas(order, "grp string, gene_id string, rank int")


class Node:
    """A node of a tree: name, length of the branch above, children."""

    __slots__ = ("children", "length", "name")

    def __init__(self, name: str = "", length: float = 0.0, children: list[Node] | None = None):
        self.name, self.length, self.children = name, length, children or []

    def leaves(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.children:
                todo.extend(reversed(node.children))
            else:
                yield node


def parsed(newick: str) -> Node:
    """A tree from its text; quotes, comments in brackets and lengths are understood."""
    root = now = Node()
    above: list[Node] = []
    i, n = 0, len(newick)
    while i < n and newick[i] != ";":
        c = newick[i]
        if c == "(":
            child = Node()
            now.children.append(child)
            above.append(now)
            now = child
        elif c == ",":
            now = Node()
            above[-1].children.append(now)
        elif c == ")":
            now = above.pop()
        elif c == "[":
            i = newick.find("]", i) if "]" in newick[i:] else n
        elif c == "'":
            end = newick.find("'", i + 1)
            end = n if end < 0 else end
            now.name, i = newick[i + 1 : end], end
        elif c == ":":
            end = i + 1
            while end < n and newick[end] not in ",()[;":
                end += 1
            now.length, i = float(newick[i + 1 : end] or 0), end - 1
        elif not c.isspace():
            end = i
            while end < n and newick[end] not in ",():[;":
                end += 1
            now.name, i = newick[i:end].strip(), end - 1
        i += 1
    return root


def leaf_order(trees: DataFrame) -> DataFrame:
    """(tree, rank, leaf, depth): leaves of (tree, newick) from left to right, with the length of the way from the root."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tree, newick in zip(pdf["tree"], pdf["newick"], strict=True):
                todo, rank = [(parsed(newick or ""), 0.0)], 0
                while todo:
                    node, depth = todo.pop()
                    if node.children:
                        todo.extend((c, depth + c.length) for c in reversed(node.children))
                    elif node.name:
                        out.append((tree, rank, node.name, depth))
                        rank += 1
            yield pd.DataFrame(out, columns=["tree", "rank", "leaf", "depth"])

    return trees.select("tree", "newick").mapInPandas(rows, "tree string, rank int, leaf string, depth double")


def midpoint(newick: str) -> str:
    """The tree rooted in the middle of its longest path between leaves."""
    root = parsed(newick)
    links: dict[int, list[tuple[int, float]]] = {}
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(node.children)
    at = {id(x): k for k, x in enumerate(nodes)}
    for x in nodes:
        for c in x.children:
            links.setdefault(at[id(x)], []).append((at[id(c)], c.length))
            links.setdefault(at[id(c)], []).append((at[id(x)], c.length))
    tips = sorted((k for k, x in enumerate(nodes) if not x.children), key=lambda k: nodes[k].name)
    if len(tips) < 2:
        return newick

    def far(start: int) -> tuple[int, dict[int, float], dict[int, int]]:
        dist, back, todo = {start: 0.0}, {start: -1}, [start]
        while todo:
            k = todo.pop()
            for m, w in links.get(k, []):
                if m not in dist:
                    dist[m], back[m] = dist[k] + w, k
                    todo.append(m)
        return max(tips, key=lambda k: (dist[k], -tips.index(k))), dist, back

    a = far(tips[0])[0]
    b, dist, back = far(a)
    half, k = dist[b] / 2, b
    while back[k] != -1 and dist[back[k]] > half:
        k = back[k]
    up = back[k]

    def text(k: int, came: int, length: float) -> str:
        parts = [text(m, k, w) for m, w in links.get(k, []) if m != came]
        return f"{'(' + ','.join(parts) + ')' if parts else ''}{nodes[k].name if not parts else ''}:{length:g}"

    return f"({text(k, up, dist[k] - half)},{text(up, k, half - dist[up])});"


def layout(newick: str) -> list[tuple[str, float, float]]:
    """(name, x, y) of each node: x its way from the root, y the leaf's number, or the mean of the first and last child's."""
    out, leaves = [], 0

    def place(node: Node, x: float) -> float:
        nonlocal leaves
        if not node.children:
            y = float(leaves)
            leaves += 1
        else:
            ys = [place(c, x + c.length) for c in node.children]
            y = (ys[0] + ys[-1]) / 2
        out.append((node.name, x, y))
        return y

    place(parsed(newick), 0.0)
    return out


def layouts(trees: DataFrame) -> DataFrame:
    """(tree, name, x, y): places of the nodes of (tree, newick), rooted in the middle of the longest path."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, *node) for t, n in zip(pdf["tree"], pdf["newick"], strict=True) for node in layout(midpoint(n or ""))]
            yield pd.DataFrame(out, columns=["tree", "name", "x", "y"])

    return trees.select("tree", "newick").mapInPandas(rows, "tree string, name string, x double, y double")


def most_similar(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Of each group's members in each accession the one most like the group's reference (grp, ref), the least id of equals."""
    pairs = distances(rows)
    both = pairs.unionByName(pairs.select("grp", F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    from kinloom.operators.pick import pick

    near = both.join(references, (both["grp"] == references["grp"]) & (both["a"] == references["ref"])).select(both["grp"], F.col("b").alias("gene_id"), "distance")
    return pick(near.join(rows.select("grp", "gene_id", "accession"), ["grp", "gene_id"]), ["grp", "accession"], [F.col("distance"), F.col("gene_id")])
