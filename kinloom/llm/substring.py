"""Substring dedup by a log-structured fingerprint index.

A window is WINDOW consecutive words of a document. Its anchor is the least hash of the GRAM-word groups inside it, so equal windows have
equal anchors, and about two anchors stand for GRAM + WINDOW words. The index is a folder of generations, which are sorted
and never changed: of anchors, each with the document that has it or, once two have it, marked as shared; and of fingerprints, one for each
window that is the first of its kind under a shared anchor. A batch of new documents is dealt into runs and added in one job:

1. Merge-join: in each bucket of anchors the batch's sorted runs are merged with all generations. An anchor that another run, another
   document or an earlier batch has is shared, and its windows are candidates.
2. An anchor that was one old document's own until now is promoted: that document is read again, once, and its windows under
   the anchor join the candidates. History is scanned for these documents, as what is read there
   are their ids and no more than their texts; without it a batch would miss copies, so it must be given.
3. Verification: candidates send two fingerprints, of 64 and 32 bits, each of its own hashes of all their words. In each bucket they are merged
   with the fingerprints of all generations: what history has, or an earlier document of the batch, is a copy.
4. Each run removes what is covered by copies, whether found there or inside the run; new anchors and fingerprints are written as a generation.

A batch's texts are dealt to their runs once, as a table in buckets of the run, and read from there by the three passes over them. Generations are merged before a batch
when there are FANOUT of them. Two windows count as equal if both fingerprints are: of W windows some W * W / 2^97 pairs
are taken for equal that are not, which is 1e-9 at 10^10 windows and below 0.01 at 100 TB.

Buckets hold some BUCKET_BYTES of text each, so a run writes a blob for every bucket of the corpus, however many there are; a run keeps one entry for
equal windows however often they occur in it, so a passage that a third of all documents share gives each bucket one entry a run.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import buckets
from kinloom.functions.scratch import listed

from . import packing
from .common import Scratch, documents, drop, run_count, text_bytes

WINDOW, GRAM = 20, 6
#: Generations that an index keeps before it merges them, and batches that a whole table is added in.
FANOUT, BATCHES = 2, 3
#: Text of a bucket.
BUCKET_BYTES = 64_000_000
NO_ID = np.iinfo("i8").max
#: In place of a document: an anchor that is shared.
SHARED = -1
#: Odd multipliers of the two fingerprints and of the groups; fixed, so that runs made at different times agree.
_BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Words of more bytes are hashed one by one. The first bytes of eight, so many of them.
LONG = 256
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], "u8")
#: How words are hashed; an index that was made otherwise cannot be read.
HASHES = 2
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
COLUMNS = {"kind": "string", "bucket": "int", "run": "long", "n": "long", "keys": "binary", "others": "binary", "ids": "binary", "bits": "binary", "doc_id": "long", "n_words": "long", "n_removed": "long", "kept_sha256": "string"}
ROWS = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())


def made(rows: list[dict]) -> pd.DataFrame:
    """Rows of which each has some of the columns; the others are null, and places and sizes 0."""

    def column(name: str, kind: str) -> pd.Series:
        values = [r.get(name) for r in rows]
        if name in ("bucket", "run", "n"):
            return pd.Series([0 if v is None else int(v) for v in values], dtype="i8")
        if kind == "long":
            return pd.Series(pd.array([None if pd.isna(v) else int(v) for v in values], "Int64"))
        return pd.Series(values, dtype=object)

    return pd.DataFrame({c: column(c, t) for c, t in COLUMNS.items()})


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of bytes start, and where they end; the last byte is a space."""
    word = ~((data - np.uint8(9) < 5) | (data == 32))
    edges = np.flatnonzero(np.diff(word.view("i1"), prepend=np.int8(0)))
    return edges[0::2], edges[1::2]


def word_hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word, which take eight bytes of all words at a time; for words of up to eight bytes both are one-to-one among those of one length.
    Eight bytes follow the last word. A word of more than LONG bytes is hashed by itself."""
    size = ends - starts
    one, two = (packing.mixed(size.astype("u8") ^ b) for b in _BASES[:2])
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    x = eight[starts] & _LOW[np.minimum(size, 8)]
    one, two = packing.mixed(one ^ x), packing.mixed((two ^ x) * _BASES[2])
    rest, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(rest):
        x = eight[starts[rest] + done] & _LOW[np.minimum(size[rest] - done, 8)]
        one[rest], two[rest] = packing.mixed(one[rest] ^ x), packing.mixed((two[rest] ^ x) * _BASES[2])
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        one[i], two[i] = np.frombuffer(xxhash.xxh3_128_digest(buffer[starts[i] : ends[i]]), "<u8")
    return one, two


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a base and of its inverse modulo 2^64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        grown = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype="u8")
        have = _POWERS[int(base)] = grown(base), grown(np.uint64(pow(int(base), -1, 2**64)))
    return have[0][:n], have[1][:n]


def rolled(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of each width neighbours: their sum by powers of the base, mixed."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, "u8")
    up, down = powers(base, len(h))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up, dtype="u8")])
    return packing.mixed((sums[width:] - sums[:-width]) * down[:n])


class Run:
    """The documents of a run in order of id and text, hashes of their words, and the windows that lie in one document."""

    def __init__(self, rows: pd.DataFrame, size: int = WINDOW, gram: int = GRAM):
        run = int(rows["run"].iloc[0]) if len(rows) else 0
        self.real = rows["doc_id"].notna().to_numpy()
        # rows without an id come after all others, in order of run and text
        self.ids = rows["doc_id"].astype("Int64").fillna(NO_ID - (1 << 32) + run).to_numpy("i8")
        data = [t.encode() if isinstance(t, str) else b"" for t in rows["text"]]
        order = sorted(range(len(data)), key=lambda i: (self.ids[i], data[i]))
        self.ids, self.real = self.ids[order], self.real[order]
        self.data = [data[i] for i in order]
        buffer = b" ".join([*self.data, bytes(8)])
        starts, ends = word_places(np.frombuffer(buffer, "u1")[:-8])
        after = np.cumsum(np.fromiter(map(len, self.data), "i8", len(self.data)) + 1)
        self.counts = np.diff(np.searchsorted(starts, after), prepend=0)
        h, self.other = word_hashes(buffer, starts, ends)
        n = max(0, len(h) - size + 1)
        doc = np.repeat(np.arange(len(self.data)), self.counts)
        self.starts = np.flatnonzero(doc[:n] == doc[size - 1 : size - 1 + n]) if n else np.zeros(0, "i8")
        self.doc = doc[self.starts]
        self.size, self.h = size, h
        span, width = size - gram + 1, 1
        least = rolled(packing.mixed(h), gram, _BASES[2]) if n else np.zeros(span, "u8")
        while 2 * width <= span:
            least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        self.anchor = packing.mixed(least[self.starts] ^ _BASES[0])
        # neighbours mostly have the same anchor: where another one, or another document, begins
        self.heads = np.flatnonzero(np.concatenate([[True], (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])])) if len(self.anchor) else np.zeros(0, "i8")

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted anchors, and of each the document that has it, or SHARED if several have or it has no id."""
        anchor, doc = self.anchor[self.heads], self.doc[self.heads]
        order = np.argsort(anchor)
        keys = anchor[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, "i8")
        if not len(starts):
            return np.zeros(0, "u8"), np.zeros(0, "i8")
        low, high = (f.reduceat(doc[order], starts) for f in (np.minimum, np.maximum))
        return keys[starts], np.where((low == high) & self.real[low], self.ids[low], SHARED)

    def firsts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows without an equal before in this run, in order of fingerprint; all others; both fingerprints of all."""
        first, second = (rolled(h, self.size, b)[self.starts] for h, b in zip((self.h, self.other), _BASES, strict=False))
        second = (second >> np.uint64(32)).astype("u4")
        order = np.argsort(first)
        f, s = first[order], second[order]
        same = f[1:] == f[:-1]
        if (same & (s[1:] != s[:-1])).any():
            order = np.lexsort((second, first))
            f, s = first[order], second[order]
            same = (f[1:] == f[:-1]) & (s[1:] == s[:-1])
        starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, "i8")
        firsts = np.minimum.reduceat(order, starts) if len(starts) else np.zeros(0, "i8")
        copy = np.ones(len(order), bool)
        copy[firsts] = False
        return firsts, np.flatnonzero(copy), first, second

    def candidates(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """firsts(), of which only those under one of the sorted anchors are candidates."""
        firsts, copies, first, second = self.firsts()
        under = np.repeat(among(self.anchor[self.heads], keys), np.diff(self.heads, append=len(self.anchor)))
        return firsts[under[firsts]], copies, first, second

    def results(self, copies: np.ndarray) -> list[dict]:
        """Counts and hash of what each document keeps, if the given windows are copies."""
        change = np.zeros(len(self.h) + 1, "i4")
        np.add.at(change, self.starts[copies], 1)
        np.add.at(change, self.starts[copies] + self.size, -1)
        keep = np.cumsum(change[:-1]) == 0
        ends = np.cumsum(self.counts)
        sums = np.concatenate([[0], np.cumsum(keep)])
        kept = sums[ends] - sums[ends - self.counts]
        out = []
        for text, end, n, k, i, real in zip(self.data, ends.tolist(), self.counts.tolist(), kept.tolist(), self.ids.tolist(), self.real.tolist(), strict=True):
            left = text.split() if k == n else compress(text.split(), keep[end - n : end]) if k else ()
            out.append({"kind": "result", "doc_id": i if real else None, "n_words": n, "n_removed": n - k, "kept_sha256": hashlib.sha256(b" ".join(left)).hexdigest()})
        return out


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def blobs(kind: str, run: int, bits: int, keys: np.ndarray, others: np.ndarray, ids: np.ndarray | None = None) -> list[dict]:
    """Sorted keys, and what goes with them, by bucket."""
    edge = packing.cuts(keys, bits).tolist()
    return [
        {"kind": kind, "bucket": b, "run": run, "n": e - s, "keys": packing.packed_sorted(keys[s:e]), "others": packing.packed(others[s:e]), "ids": None if ids is None else packing.packed(ids[s:e])}
        for b, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if e > s
    ]


def together(rows: pd.DataFrame, column: str, kind: str) -> np.ndarray:
    if not len(rows):
        return np.zeros(0, kind)
    return np.concatenate([packing.unpacked_sorted(k) if column == "keys" else packing.unpacked(k, kind) for k in rows[column]])


def flagged(rows: pd.DataFrame, kind: str, flags: np.ndarray) -> list[dict]:
    """A row of bits for each blob."""
    ends = np.cumsum(rows["n"].to_numpy("i8")).tolist()
    return [{"kind": kind, "bucket": b, "run": r, "bits": np.packbits(flags[e - n : e]).tobytes()} for e, n, r, b in zip(ends, rows["n"].tolist(), rows["run"].tolist(), rows["bucket"].tolist(), strict=True)]


def told(rows: pd.DataFrame, bits: int, keys: np.ndarray) -> np.ndarray:
    """The bits that came back for sorted keys, in their order."""
    out, edge = np.zeros(len(keys), bool), packing.cuts(keys, bits)
    for b, data in zip(rows["bucket"], rows["bits"], strict=True):
        out[edge[b] : edge[b + 1]] = np.unpackbits(np.frombuffer(data, "u1"), count=int(edge[b + 1] - edge[b])).astype(bool)
    return out


def merged_anchors(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
    """Merges a bucket's anchors of the batch with those of all generations: bits for the runs, anchors to promote by their document, and the new generation."""
    if not len(ours):
        return made([])
    bucket = int(ours["bucket"].iloc[0])
    keys, owners = together(ours, "keys", "u8"), together(ours, "others", "<i8")
    old, of = together(theirs, "keys", "u8"), together(theirs, "others", "<i8")
    order = np.argsort(old, kind="stable")
    old, of = old[order], of[order]
    every, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    low, high = np.searchsorted(old, every), np.searchsorted(old, every, "right")
    marks = np.concatenate([[0], np.cumsum(of == SHARED)])
    met, known = high > low, marks[high] > marks[low]
    shared = (count > 1) | met | (np.bincount(inverse, owners == SHARED, len(every)) > 0)
    out = flagged(ours, "shared", shared[inverse])
    risen = np.flatnonzero(met & ~known)
    if len(risen):
        owner = of[low[risen]]
        by = np.argsort(owner, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], owner[by][1:] != owner[by][:-1]])).tolist()
        for s, e in zip(cut, [*cut[1:], len(by)], strict=True):
            out.append({"kind": "promoted", "doc_id": int(owner[by[s]]), "n": e - s, "keys": packing.packed_sorted(every[risen[by[s:e]]])})
    new = ~known
    if new.any():
        out.append({"kind": "anchors", "bucket": bucket, "n": int(new.sum()), "keys": packing.packed_sorted(every[new]), "others": packing.packed(np.where(shared, SHARED, owners[first])[new])})
    return made(out)


def merged_prints(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
    """Merges a bucket's candidates with the fingerprints of all generations: bits for the runs, and what history lacked as the new generation.
    Candidates of old documents are part of history."""
    out = [{"kind": "under", "run": r, "bits": b} for r, b in zip(*(ours.loc[ours["kind"] == "under", c] for c in ("run", "bits")), strict=True)]
    sent = ours[ours["kind"] == "windows"].reset_index(drop=True)
    if not len(sent):
        return made(out)
    bucket = int(sent["bucket"].iloc[0])
    first = np.concatenate([together(theirs, "keys", "u8"), together(sent, "keys", "u8")])
    second = np.concatenate([together(theirs, "others", "<u4"), together(sent, "others", "<u4")])
    known = len(first) - int(sent["n"].sum())
    ids = np.concatenate([np.full(known, -2, "i8"), together(sent, "ids", "<i8")])
    order = np.lexsort((ids, second, first))
    again = np.zeros(len(first), bool)
    again[order[1:]] = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    mine = sent[sent["run"] >= 0]
    place = np.repeat((sent["run"] >= 0).to_numpy(), sent["n"].to_numpy("i8"))
    out += flagged(mine, "copies", again[known:][place])
    fresh = order[~again[order] & (order >= known)]
    if len(fresh):
        run = int(mine["run"].iloc[0]) if len(mine) else 0
        out.append({"kind": "prints", "bucket": bucket, "run": run, "n": len(fresh), "keys": packing.packed_sorted(first[fresh]), "others": packing.packed(second[fresh])})
    return made(out)


def merged_generations(rows: pd.DataFrame) -> pd.DataFrame:
    """The blobs of one kind and bucket as one: an anchor is shared if any generation says so, a fingerprint is there once."""
    kind, bucket = rows["kind"].iloc[0], int(rows["bucket"].iloc[0])
    keys, others = together(rows, "keys", "u8"), together(rows, "others", "<i8" if kind == "anchors" else "<u4")
    order = np.lexsort((others, keys))
    keys, others = keys[order], others[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1] if kind == "anchors" else (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])
    return made([{"kind": kind, "bucket": bucket, "n": int(new.sum()), "keys": packing.packed_sorted(keys[new]), "others": packing.packed(others[new])}])


def keyed(docs: DataFrame, runs: int, id_col: str, text_col: str) -> DataFrame:
    """(run, doc_id, text): rows of one id are in one run, rows without an id are dealt by their texts."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    place = F.when(id_.isNull(), F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(id_))
    return docs.select(F.pmod(place, F.lit(runs)).cast("long").alias("run"), id_.alias("doc_id"), text.alias("text"))


class FingerprintIndex:
    """Generations of anchors and fingerprints in a folder, which may be opened again: a manifest says which of them count.

    add() removes from a batch what earlier batches, or earlier documents of the batch, have. bits is the number of leading bits that make a
    bucket; it cannot change later.
    """

    def __init__(self, spark: SparkSession, folder: str, size: int = WINDOW, gram: int = GRAM, bits: int = 4):
        self.spark, self.folder, self.size, self.gram, self.bits = spark, folder.rstrip("/"), size, gram, bits
        self._next, self._names = 0, []
        manifests = [p for n, p, _ in listed(spark, self.folder) if n.startswith("manifest-")]
        if manifests:
            last = max(manifests, key=lambda p: int(p.rsplit("-", 1)[1]))
            rows = {r.k: r.v for r in spark.read.parquet(last).collect()}
            if (rows["size"], rows["gram"]) != (str(size), str(gram)):
                raise ValueError(f"the index has windows of {rows['size']} words and groups of {rows['gram']}")
            if rows.get("hashes") != str(HASHES):
                raise ValueError("the index was made with other hashes of words")
            self.bits, self._next, self._names = int(rows["bits"]), int(rows["next"]), [n for n in rows["generations"].split(",") if n]

    def generations(self) -> list[str]:
        return list(self._names)

    def _commit(self, names: list[str]) -> None:
        """The manifest is written after what it names: a batch counts as a whole or not at all."""
        self._next, self._names = self._next + 1, names
        rows = {"size": self.size, "gram": self.gram, "hashes": HASHES, "bits": self.bits, "next": self._next, "generations": ",".join(names)}
        self.spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "k string, v string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest-{self._next}")

    def part(self, kind: str, *names: str) -> DataFrame:
        """The rows of a kind that generations have: anchors, prints; result and promoted of a batch."""
        folders = [p for n in names for sub, p, _ in listed(self.spark, f"{self.folder}/{n}") if sub == f"kind={kind}"]
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        rows = self.spark.read.schema(ROWS.split(", ", 1)[1]).option("recursiveFileLookup", "true").parquet(*folders)
        return rows.select(F.lit(kind).alias("kind"), *list(COLUMNS)[1:])

    def _stored(self, kind: str) -> DataFrame:
        return self.part(kind, *self._names)

    def add(self, new: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) for each row of new, as a table in the folder; history holds the documents of earlier calls."""
        if self._names and history is None:
            raise ValueError("the index has documents: give the history, or copies of what only one of them has are missed")
        if len(self._names) >= FANOUT:
            self.compact()
        size, gram, bits = self.size, self.gram, self.bits
        if runs is None:
            runs = run_count(text_bytes(new, text_col))
        dealt, where, n = keyed(new, runs, id_col, text_col), f"{self.folder}/rows-{uuid.uuid4().hex}", 2 * runs
        buckets.write(dealt, where, ("run",), n)
        rows = buckets.read(self.spark, where, dealt.schema, ("run",), n)

        def entries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return made(blobs("entries", key[0], bits, *Run(pdf, size, gram).entries()))

        anchors = rows.groupBy("run").applyInPandas(entries, ROWS).groupBy("bucket").cogroup(self._stored("anchors").groupBy("bucket")).applyInPandas(merged_anchors, ROWS)

        def windows(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return made([])
            run = Run(left, size, gram)
            keys = run.entries()[0]
            shared = told(right, bits, keys)
            send, _, first, second = run.candidates(keys[shared])
            under = {"kind": "under", "bucket": key[0] % (1 << bits), "run": key[0], "bits": np.packbits(shared).tobytes()}
            return made([under, *blobs("windows", key[0], bits, first[send], second[send], run.ids[run.doc[send]])])

        sent = rows.groupBy("run").cogroup(anchors.filter("kind = 'shared'").groupBy("run")).applyInPandas(windows, ROWS)
        if self._names:
            promoted = anchors.filter("kind = 'promoted'").select("doc_id", "keys").withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("long"))
            old = keyed(history.filter(F.col(id_col).isNotNull()), runs, id_col, text_col).join(promoted.select("doc_id").distinct(), "doc_id", "left_semi").select("run", "doc_id", "text")

            def again(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                if not len(left) or not len(right):
                    return made([])
                run = Run(left, size, gram)
                send, _, first, second = run.candidates(np.unique(np.concatenate([packing.unpacked_sorted(k) for k in right["keys"]])))
                return made(blobs("windows", -1, bits, first[send], second[send], np.full(len(send), -1, "i8")))

            sent = sent.unionByName(old.groupBy("run").cogroup(promoted.groupBy("run")).applyInPandas(again, ROWS))
        judged = sent.groupBy("bucket").cogroup(self._stored("prints").groupBy("bucket")).applyInPandas(merged_prints, ROWS)

        def cleaned(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = right.loc[right["kind"] == "prints"].to_dict("records")
            if len(left):
                run = Run(left, size, gram)
                keys = run.entries()[0]
                under = right.loc[right["kind"] == "under", "bits"].iloc[0]
                shared = np.unpackbits(np.frombuffer(under, "u1"), count=len(keys)).astype(bool)
                send, copies, first, _ = run.candidates(keys[shared])
                found = told(right[right["kind"] == "copies"], bits, first[send])
                out += run.results(np.concatenate([copies, send[found]]).astype("i8"))
            return made(out)

        done = rows.groupBy("run").cogroup(judged.groupBy("run")).applyInPandas(cleaned, ROWS)
        name = f"generation-{self._next}"
        done.unionByName(anchors.filter("kind IN ('anchors', 'promoted')")).write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{self.folder}/{name}")
        self._commit([*self._names, name])
        buckets.forget(self.spark, where)
        drop(self.spark, where)
        return self.part("result", name).select("doc_id", "n_words", "n_removed", "kept_sha256")

    def compact(self) -> None:
        """Merges all generations into one. The batches' results stay where they are."""
        name = f"generation-{self._next}"
        both = self._stored("anchors").unionByName(self._stored("prints"))
        both.groupBy("kind", "bucket").applyInPandas(merged_generations, ROWS).write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{self.folder}/{name}")
        old = self._names
        self._commit([name])
        for n in old:
            for kind in ("anchors", "prints"):
                drop(self.spark, f"{self.folder}/{n}/kind={kind}")


def deduplicated(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs, which an index takes in batches in order of id.

    A word goes if a window that covers it starts earlier too: in a smaller id, or earlier in the same document. A null or empty text has
    no words, keeps nothing and has the hash of the empty string. Rows of one id are taken in order of their texts, as one log: of equal
    rows the first is the original. Rows without an id come after all others. An empty table gives no rows, and other columns of docs
    are not read. A text is never cut, however long.
    """
    id_ = F.col(id_col).cast("long")
    ends, total = docs.agg(F.percentile_approx(id_, [(k + 1) / batches for k in range(batches - 1)], 1_000), F.sum(F.octet_length(F.col(text_col)))).first()
    total = int(total or 0)
    index = FingerprintIndex(docs.sparkSession, scratch.path("index"), size, gram, max(4, (-(-total // BUCKET_BYTES) - 1).bit_length()))
    edges = sorted(set(ends or ()))
    out, before = None, None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = docs if low is None else docs.filter((id_ > low) | id_.isNull())
        part = part if high is None else part.filter(id_ <= high)
        got = index.add(part, before, id_col, text_col, run_count(total // (len(edges) + 1)))
        before = docs.filter(id_ <= high) if high is not None else None  # nothing comes after the last
        out = got if out is None else out.unionByName(got)
    return out


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir), Scratch(spark, "substring"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)
), copies AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS at FROM copies
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.at) AS text, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d) p
  LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.at = g.at WHERE g.at IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
