"""Ranked prefix search that reads only the blocks of postings that can reach the first places.

Every term is listed under each of its prefixes, so a token that may end early is one list. A list is cut into blocks by texts, the same blocks for all lists; a block is
one row: how many texts it has, the greatest share of a token's weight that any of them gets, and the texts with their counts and lengths as arrays. The weights of a
query follow from the counts; a block's bound is the sum over tokens of weight times greatest share. Blocks are read in falling order of bound until
the worst score of the first places is no less than any bound left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import snapshot
from kinloom.functions.snapshot import Snapshot
from kinloom.operators.keyword import B, K1, retrieved

#: Shortest and longest prefix with a list; texts of a block; blocks of the first reading; blocks that are named to the scan one by one; blocks that a task lists.
SHORTEST, LONGEST, BLOCK, FIRST, NAMED, DEALT = 2, 16, 128, 8, 512, 8
#: Postings that are listed at once, and tokens that are handed on at once.
RUN, TOKENS = 500_000, 4_096
#: Scores are rounded to six decimals, so a bound may lie so much lower.
ROOM = 2e-6
#: Small pages and row groups: a block of one list is a row.
STORAGE = {"parquet.page.row.count.limit": "64", "parquet.block.row.count.limit": "4096"}


def share(tf: Column, length: Column, mean: Column) -> Column:
    """The part of a token's weight that a text gets for so many occurrences, below 1."""
    return tf / (tf + K1 * (1 - B + B * length / mean))


def lists(posts: DataFrame, key: str, whole: DataFrame, blocks: int) -> DataFrame:
    """(token, block, n, top, keys, tfs, lengths): the texts with a term that starts with the token, by block.

    whole is one row with the mean length. A text is in a block by the hash of its key, so a block has no more than some BLOCK texts of any list.
    Postings are dealt by block, DEALT neighbours a task, and a task's lists are made whole there, in order of token and block: what moves is each posting once, not once
    for each prefix, and lists are neither dealt nor sorted again. A task's file has few blocks, so a scan that names blocks leaves out the files without them.
    """
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    dealt = posts.filter(F.length("term") >= SHORTEST).select(block.alias("block"), "term", F.col(key).alias("key"), F.col("length").cast("int").alias("length"), F.col("tf").cast("long").alias("tf"))
    of, kind = whole.first().mean or 1.0, dealt.schema["key"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b for run in _runs(batches) for b in _listed(run, of))

    found = dealt.repartitionById(-(-blocks // DEALT), F.expr(f"block div {DEALT}").cast("int")).mapInArrow(made, f"token string, lists array<struct<block: int, n: bigint, top: double, keys: array<{kind}>, tfs: array<int>, lengths: array<int>>>")
    return found.select("token", F.explode("lists").alias("l")).select("token", "l.block", "l.n", "l.top", "l.keys", "l.tfs", "l.lengths")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's postings in runs of whole blocks, of some RUN postings each, so that lists of a run fit into memory."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    every = pa.Table.from_batches(held)
    if every.num_rows <= RUN:
        yield every
        return
    block = every["block"].to_numpy()
    number, n = np.unique(block, return_counts=True)
    run = ((np.cumsum(n) - n) // RUN)[np.searchsorted(number, block)]
    for r in np.unique(run):
        yield every.filter(pa.array(run == r))


def _ranked(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones in order, and these."""
    coded = values.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _listed(run: pa.Table, mean: float) -> Iterator[pa.RecordBatch]:
    """(token, lists) of whole blocks, tokens in order, and blocks in order for each.

    Terms are sorted, so those that start alike are neighbours: a token is named by the first of its terms and its number of letters, and these in order are the tokens in order.
    """
    term, terms = _ranked(run["term"])
    who, keys = _ranked(run["key"])
    n = len(terms)
    letters = np.array(terms.to_pylist(), f"U{LONGEST}").view(np.uint32).reshape(n, LONGEST)
    has = letters[:, SHORTEST - 1 :] != 0
    begins = has.copy()
    begins[1:] &= np.logical_or.accumulate(letters[1:] != letters[:-1], axis=1)[:, SHORTEST - 1 :]
    token = np.cumsum(begins.ravel()).reshape(begins.shape) - 1
    token = np.maximum.accumulate(np.where(begins, token, -1), axis=0)
    first, cut = np.nonzero(begins)
    # Texts: a key may come with several lengths, which are several texts. In order of block and key.
    block, length, tf = run["block"].to_numpy(), run["length"].to_numpy(), run["tf"].to_numpy()
    order = np.lexsort((length, who, block))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(block[order]) != 0) | (np.diff(who[order]) != 0) | (np.diff(length[order]) != 0)
    text = np.empty(len(order), np.int64)
    text[order] = np.cumsum(new) - 1
    texts = order[new]
    # A row for each posting and prefix; rows of one token and text are one.
    at, times = [], []
    for k in range(has.shape[1]):
        some = np.flatnonzero(has[term, k])
        at.append(token[term[some], k] * len(texts) + text[some])
        times.append(tf[some])
    at, times = np.concatenate(at), np.concatenate(times)
    order = np.argsort(at)
    at, times = at[order], times[order]
    start = np.flatnonzero(np.diff(at, prepend=-1))
    times = np.add.reduceat(times, start)
    token, text = np.divmod(at[start], len(texts))
    rows = texts[text]
    # Lists: rows of one token and block; and the lists of a token.
    long = length[rows]
    top = times / (times + K1 * (1 - B + B * long / mean))
    cell = np.flatnonzero((np.diff(token, prepend=-1) != 0) | (np.diff(block[rows], prepend=-1) != 0))
    ends = np.append(cell, len(rows))
    head = np.append(np.flatnonzero(np.diff(token[cell], prepend=-1)), len(cell))
    top, size, of = np.maximum.reduceat(top, cell), np.diff(ends), block[rows[cell]]
    who, times = who[rows], times.astype(np.int32)
    for low in range(0, len(first), TOKENS):
        high = min(low + TOKENS, len(first))
        c0, c1 = head[low], head[high]
        r0, r1 = ends[c0], ends[c1]
        names = letters[first[low:high]]
        names[np.arange(LONGEST) >= cut[low:high, None] + SHORTEST] = 0
        inner = pa.array(ends[c0 : c1 + 1] - r0, pa.int32())
        fields = {
            "block": pa.array(of[c0:c1], pa.int32()), "n": pa.array(size[c0:c1], pa.int64()), "top": pa.array(top[c0:c1]),
            "keys": pa.ListArray.from_arrays(inner, keys.take(pa.array(who[r0:r1]))),
            "tfs": pa.ListArray.from_arrays(inner, pa.array(times[r0:r1])), "lengths": pa.ListArray.from_arrays(inner, pa.array(long[r0:r1], pa.int32())),
        }
        cells = pa.StructArray.from_arrays(list(fields.values()), list(fields))
        yield pa.RecordBatch.from_arrays([pa.array(names.view(f"U{LONGEST}").ravel().tolist(), pa.string()), pa.ListArray.from_arrays(pa.array(head[low : high + 1] - c0, pa.int32()), cells)], ["token", "lists"])


def write(snap: Snapshot, posts: DataFrame, key: str, whole: DataFrame) -> None:
    """The lists as a table `prefixes` of an index: each file has the lists of some blocks, in order of token."""
    blocks = max(1, -(-int(whole.first().n) // BLOCK))
    snap.write(lists(posts, key, whole, blocks), "prefixes", options=STORAGE)


def bounds(table: DataFrame, tokens: list[str]) -> DataFrame:
    """(block, token, n, top) of the blocks that have texts of every token; the arrays are not read."""
    heads = table.filter(F.col("token").isin(*tokens)).select("token", "block", "n", "top")
    whole = heads.groupBy("block").agg(F.count("*").alias("tokens")).filter(F.col("tokens") == len(tokens)).select("block")
    return heads.join(whole, "block", "left_semi")


def weights(table: DataFrame, tokens: list[str], n: int) -> dict[str, float]:
    """The weight of each token: its idf, kept above 0, times K1 + 1."""
    df = {r.token: r.df for r in table.filter(F.col("token").isin(*tokens)).groupBy("token").agg(F.sum("n").alias("df")).collect()}
    if len(df) < len(tokens):
        return {}
    spark = table.sparkSession
    rows = spark.createDataFrame(list(df.items()), "token string, df long").select("token", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("plain"))
    return {r.token: (r.plain if r.plain is not None and r.plain > 0 else 1e-6) * (K1 + 1) for r in rows.collect()}


def scored(table: DataFrame, key: str, weight: dict[str, float], mean: float, blocks: list[int] | DataFrame) -> DataFrame:
    """(key, score) of the texts of some blocks that have every token."""
    some = table.filter(F.col("token").isin(*weight))
    some = some.join(blocks, "block", "left_semi") if isinstance(blocks, DataFrame) else some.filter(F.col("block").isin(*blocks))
    one = some.select("token", F.explode(F.arrays_zip("keys", "tfs", "lengths")).alias("t")).select("token", F.col("t.keys").alias(key), F.col("t.tfs").alias("tf"), F.col("t.lengths").alias("length"))
    w = F.element_at(F.create_map(*[F.lit(x) for pair in weight.items() for x in pair]), F.col("token"))
    hits = one.groupBy(key).agg(F.sum(w * share(F.col("tf"), F.col("length"), F.lit(mean))).alias("score"), F.count("*").alias("tokens"))
    return hits.filter(F.col("tokens") == len(weight)).select(key, F.round("score", 6).alias("score"))


def best(spark: SparkSession, root: str, key: str, tokens: list[str], limit: int, read: list[int] | None = None) -> DataFrame:
    """(key, score): as keyword.retrieved over the postings of an index, from its lists. Tokens shorter or longer than the lists' are looked for in the postings.

    read, where given, gets the numbers of blocks that were read in each turn. The driver sees counts of the tokens, `FIRST` blocks' numbers a turn and one score.
    """
    tokens = list(dict.fromkeys(t.lower() for t in tokens))
    whole = snapshot.read(spark, root, "numbers")
    if not tokens or any(not SHORTEST <= len(t) <= LONGEST for t in tokens):
        return retrieved(snapshot.read(spark, root, "postings"), key, tokens, limit, whole)
    table, corpus = snapshot.read(spark, root, "prefixes"), whole.first()
    weight = weights(table, tokens, corpus.n)
    none = table.select(F.explode("keys").alias(key), F.lit(0.0).alias("score")).limit(0)
    if not weight or limit < 1:
        return none
    w = F.element_at(F.create_map(*[F.lit(x) for pair in weight.items() for x in pair]), F.col("token"))
    bound = bounds(table, tokens).groupBy("block").agg(F.sum(w * F.col("top")).alias("bound"), F.min("n").alias("n"))
    ahead = bound.orderBy(F.desc("bound"), "block").limit(max(FIRST, -(-2 * limit // BLOCK))).collect()
    if not ahead:
        return none
    first = [r.block for r in ahead]
    found = scored(table, key, weight, corpus.mean, first).orderBy(F.desc("score"), key).limit(limit)
    worst = found.agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
    left = bound.filter(~F.col("block").isin(*first))
    if worst.n >= limit:
        left = left.filter(F.col("bound") >= worst.score - ROOM)
    more = left.select("block").limit(NAMED + 1).collect()
    if read is not None:
        read += [len(first), len(more)]
    if not more:
        return found
    rest = [r.block for r in more] if len(more) <= NAMED else left.select("block")
    return found.unionByName(scored(table, key, weight, corpus.mean, rest)).orderBy(F.desc("score"), key).limit(limit)
