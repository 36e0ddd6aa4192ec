"""Periodic runs of words by probing harmonic grids.

A run is a stretch of words with smallest period q, at least POWER * q and LEAST words long, that cannot be made longer. Every POWER * q
consecutive places hold POWER consecutive multiples of q, so a run of period p has equal words at jp, (j+1)p, ... (j+POWER-1)p for some j: testing
these grid points takes n / p steps for each p, and n log n for all. What survives is tested at the next few places inside the grid step,
and is then extended both ways by comparing pieces of the array of growing length. Grid points inside a run of a smaller period that
divides p are skipped: the run of period p through them is that run itself.

Texts of an Arrow batch are probed together: their words become numbers in one array, a number of its own between texts, longer texts first,
so that period p is probed in those texts only that have POWER * p words. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, words

#: A run has at least so many words, and so many times its period.
LEAST, POWER = 6, 4
#: Words that are probed together (one text can have more), places tested before extending, and the first piece compared.
WORDS, NEAR, PIECE = 400_000, 12, 32
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def same_to_the_right(w: np.ndarray, i: int, p: int) -> int:
    """How many places from i on have the word that stands p further."""
    at, size = i, PIECE
    while at + p < len(w):
        stop = min(at + size, len(w) - p)
        other = np.flatnonzero(w[at:stop] != w[at + p : stop + p])
        if len(other):
            return at + int(other[0]) - i
        at, size = stop, 2 * size
    return at - i


def same_to_the_left(w: np.ndarray, i: int, p: int) -> int:
    """How many places before i have the word that stands p further."""
    at, size = i, PIECE
    while at > 0:
        first = max(0, at - size)
        other = np.flatnonzero(w[first:at] != w[first + p : at + p])
        if len(other):
            return i - (first + int(other[-1]) + 1)
        at, size = first, 2 * size
    return i


class Found:
    """Runs found so far, by start, as arrays that are merged when some have come in."""

    def __init__(self) -> None:
        self.start = self.stop = self.period = np.zeros(0, "i8")

    def add(self, runs: list[tuple[int, int, int]]) -> None:
        both = [np.concatenate([old, np.array(new, "i8")]) for old, new in zip((self.start, self.stop, self.period), zip(*runs, strict=True), strict=True)]
        order = np.lexsort((both[2], both[0]))
        self.start, self.stop, self.period = (x[order] for x in both)

    def outside(self, at: np.ndarray, p: int) -> np.ndarray:
        """The grid points of at (in order) that are not inside a run of a smaller period dividing p, with the whole stretch to be tested."""
        some = (p % self.period == 0) & (self.stop - self.start >= POWER * p)
        if not some.any() or not len(at):
            return at
        start, stop = self.start[some], self.stop[some] - (POWER - 1) * p  # the last grid point must lie inside as well
        inside = np.zeros(len(at) + 1, "i8")
        np.add.at(inside, np.searchsorted(at, start), 1)
        np.add.at(inside, np.maximum(np.searchsorted(at, stop), np.searchsorted(at, start)), -1)
        return at[np.cumsum(inside[:-1]) == 0]


def probe(w: np.ndarray, ends: np.ndarray) -> Found:
    """All runs in an array of word numbers. ends: of the texts in it, which stand in falling order of length; each ends with a number of its own."""
    found = Found()
    lengths = np.diff(ends, prepend=0) - 1
    for p in range(1, int(lengths[0]) // POWER + 1 if len(lengths) else 0):
        n = int(ends[np.searchsorted(-lengths, -max(LEAST, POWER * p), "right") - 1]) if lengths[0] >= max(LEAST, POWER * p) else 0
        grid = w[:n:p]
        m = len(grid) - POWER + 1
        if m <= 0:
            continue
        j = np.flatnonzero(grid[:m] == grid[1 : m + 1])
        for k in range(1, POWER - 1):
            j = j[grid[j + k] == grid[j + k + 1]]
        at = j * p
        for t in range(1, min(p, NEAR)):
            if not len(at):
                break
            at = at[w[at + t] == w[at + t + p]]
        at = found.outside(at, p)
        new, k = [], 0
        while k < len(at):
            i = int(at[k])
            right = same_to_the_right(w, i, p)
            start, stop = i - same_to_the_left(w, i, p), i + right + p
            if stop - start >= max(LEAST, POWER * p) and i + (POWER - 1) * p < stop:  # else other grid points find it
                new.append((start, stop, p))
            k = int(np.searchsorted(at, max(i + 1, i + right)))
        if new:
            found.add(list(dict.fromkeys(new)))
    return found


def groups_of(sizes: list[int]) -> Iterator[list[int]]:
    """Places of texts, longest first, in groups of about WORDS words."""
    group, held = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        group.append(i)
        held += sizes[i]
        if held >= WORDS:
            yield group
            group, held = [], 0
    if group:
        yield group


def runs_of(texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """For each text, as its words: its runs (start, length, period) by start and period, and which words stay when each run keeps its first period."""
    out: list = [None] * len(texts)
    for group in groups_of([len(t) for t in texts]):
        numbers: dict[bytes, int] = {}
        parts = []
        for k, i in enumerate(group):
            parts.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in texts[i]), "i8", len(texts[i])))
            parts.append(np.array([-1 - k], "i8"))
        w, ends = np.concatenate(parts), np.cumsum([len(texts[i]) + 1 for i in group])
        found = probe(w, ends)
        change = np.zeros(len(w) + 1, "i8")
        np.add.at(change, found.start + found.period, 1)
        np.add.at(change, found.stop, -1)
        stays = np.cumsum(change[:-1]) == 0
        cut = np.searchsorted(found.start, np.concatenate([[0], ends]))
        for k, i in enumerate(group):
            base, some = int(ends[k]) - len(texts[i]) - 1, slice(int(cut[k]), int(cut[k + 1]))
            rows = zip((found.start[some] - base).tolist(), (found.stop[some] - found.start[some]).tolist(), found.period[some].tolist(), strict=True)
            out[i] = (list(rows), stays[base : base + len(texts[i])])
    return out


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n_words, runs, collapsed) for each row of docs: row is the row itself, runs are (start, length, period) by start and period, and collapsed is the
    text, its words joined by one space, with each run cut to its first period.

    Words are what lies between ASCII white space, unchanged. A null or empty text has no words, no runs and an empty collapsed text. Runs may overlap; a
    word goes if any run drops it. Rows that repeat are treated each by itself; an empty table gives no rows; other columns, whatever their names, stay
    inside row. A text is held whole by the task that reads it, with eight bytes a word.
    """
    schema = f"row {docs.select(F.struct('*').alias('row')).schema['row'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            first = 0
            while first < batch.num_rows:  # pieces of a batch, by bytes of text
                stop = max(first + 1, int(np.searchsorted(np.cumsum(size[first:]), 8 * WORDS, "right")) + first)
                part = batch.slice(first, stop - first)
                texts = [(t.as_py() or "").encode().split() for t in part.column(2)]
                got = runs_of(texts)
                kept = [b" ".join([x for x, s in zip(t, stays, strict=True) if s] if not stays.all() else t).decode() for t, (_, stays) in zip(texts, got, strict=True)]
                runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r, _ in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, _RUN), pa.array(kept, pa.string())], names=["row", "n_words", "runs", "collapsed"])
                first = stop

    text = F.col(text_col).cast("string")
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"), text.alias("text")).mapInArrow(work, schema)


def longest(runs: Column) -> Column:
    """The run of the greatest length, of those the first by start and period; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of which every tenth, by the checksum of its id, is made periodic from some word on; a row without an id keeps its text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    n = lambda w: F.size(w).cast("long")

    def periodic(w: Column) -> Column:
        a = g % n(w)
        p = 1 + F.floor((n(w) - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n(w) - 1), lambda i: F.element_at(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int") + 1)), " ")

    made = F.transform(F.array(words(F.col("text"))), lambda w: F.when(n(w) > 0, periodic(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(made, F.col("text"))).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(documents(spark, sf_dir)))
    best = longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return found.withColumn("best", best).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
