"""MinHash near-dedup by min-max hashing.

A document is the set of its distinct k-word shingles, each a 64-bit hash. Under every one of PERMUTATIONS keyed permutations both the least
and the greatest value are kept, so a hash evaluation gives two signature values; two sets agree in either with a
probability equal to their similarity. BANDS bands of ROWS values each make buckets: a pair at the threshold 0.8
shares no bucket with probability (1 - 0.8^ROWS)^BANDS = 3e-6, one at 0.9 with 1e-14.

Links are never taken from signatures: the full sets are compared. To do that without all pairs of a bucket,

1. texts with equal sets form a class, and one document stands for it from then on;
2. each bucket links its members to its least document (a star), and links that hold on the full sets merge components;
3. documents of buckets that still hold more than one component are compared across components. Their sets are ordered by how rare
   shingles are, and pairs meet on a shared shingle of their prefixes if its places leave room for enough others: an exact
   filter, so no link between components is passed over, and no bucket is capped.

Before links are confirmed a star's pairs pass two conditions that a true link cannot break, or breaks with a probability below 1e-9: the
ratio of the set sizes, and the distance of 256-bit sketches (one bit of each signature value).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.graph import components

from . import packing
from .common import Scratch, documents, sliced

PERMUTATIONS, ROWS, BANDS = 128, 6, 42
#: Of the 256 bits of two sketches so many differ at most: at similarity 0.8 the mean is 25.6 and 55 lies six deviations off.
MOST_BITS = 55
_MUL = packing.mixed(np.arange(1, PERMUTATIONS + 1, dtype="u8")) | np.uint64(1)
_ADD = packing.mixed(np.arange(1001, 1001 + PERMUTATIONS, dtype="u8"))
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = packing.mixed(np.arange(2001, 2004, dtype="u8"))
#: Bits of the filter of ids, as a power of two (4 MB).
FILTER_BITS = 25
#: Shingles hashed at a time.
BLOCK = 2_048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, k: int, cache: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a text, sorted: k words each, or all words as one if there are fewer; A-Z lower-cased."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter((cache[w] for w in words), "u8", len(words))
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = packing.mixed(out * _FOLD + h[i : i + len(out)])
    return np.unique(out)


class _Hashes(dict):
    """Hashes of words; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def signature(s: np.ndarray) -> np.ndarray:
    """The least value under each permutation, then the greatest under each: a band has values of different permutations only, as the
    two of one permutation agree together more often than not in small sets."""
    low, high = np.full(PERMUTATIONS, np.uint64(2**64 - 1)), np.zeros(PERMUTATIONS, "u8")
    for i in range(0, len(s), BLOCK):
        x = s[i : i + BLOCK, None] * _MUL + _ADD
        x ^= x >> np.uint64(32)
        x *= _FOLD
        np.minimum(low, x.min(0), out=low)
        np.maximum(high, x.max(0), out=high)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = packing.mixed(sig[: BANDS * ROWS]).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype="u8")
    for i in range(ROWS):
        out = packing.mixed(out * _FOLD + parts[:, i])
    return out


def sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each value, as four words."""
    return np.packbits((packing.mixed(sig) & np.uint64(1)).astype(bool)).view("i8")


SIGNED = "doc_id long, n_shingles long, d0 long, d1 long, sketch array<long>, bands array<long>"


def signed(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Size, digest of the set, sketch and band keys of each document; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in sliced(batches):
            n, d, sk, bands = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), k, cache)
                n.append(len(s))
                d.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "i8"))
                if len(s):
                    sig = signature(s)
                    sk.append(sketch(sig))
                    bands.append(band_keys(sig).view("i8"))
                else:
                    sk.append(None)
                    bands.append(None)
            two = np.array(d, "i8").reshape(-1, 2)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(sk, many), pa.array(bands, many)], names=["doc_id", "n_shingles", "d0", "d1", "sketch", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, SIGNED)


def filter_places(ids: np.ndarray) -> np.ndarray:
    """The bits of each id in the filter."""
    return (packing.mixed(ids.view("u8")[None] ^ _SALTS[:, None]) >> np.uint64(64 - FILTER_BITS)).reshape(-1).astype("i8")


def id_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids (doc_id), of fixed size: 2^FILTER_BITS bits. Parts are joined block by block before they go to the driver."""
    block = 1 << 12

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[filter_places(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)))] = True
        data = np.packbits(bits).reshape(-1, block)
        some = np.flatnonzero(data.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([packing.compressed(data[i].tobytes()) for i in some], pa.binary())], names=["block", "data"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        all_ = np.bitwise_or.reduce([np.frombuffer(packing.decompressed(x), "u1") for x in pdf["data"]])
        return pd.DataFrame({"block": [key[0]], "data": [packing.compressed(all_.tobytes())]})

    out = np.zeros((1 << FILTER_BITS) // 8, "u1").reshape(-1, block)
    for row in nodes.mapInArrow(part, "block long, data binary").groupBy("block").applyInPandas(merge, "block long, data binary").toLocalIterator():
        out[row.block] = np.frombuffer(packing.decompressed(bytes(row.data)), "u1")
    return out.reshape(-1)


def sets_of(docs: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles) of the documents in nodes (doc_id).

    Texts that the filter of nodes excludes do not move; the join decides about the rest. The filter spares most texts the shuffle as
    long as the nodes are fewer than its bits, and changes nothing else.
    """
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(nodes))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = filter_places(np.ascontiguousarray(ids)).reshape(3, -1)
            yield batch.filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7)) & 1).all(0)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in sliced(batches):
            sets = [shingles(t.as_py(), k, cache).view("i8") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(likely, "doc_id long, text string")
    return texts.join(nodes, "doc_id", "left_semi").mapInArrow(work, "doc_id long, shingles array<long>")


def alike(n_a: Column, n_b: Column, a: Column, b: Column, threshold: int) -> Column:
    """What a link must satisfy: sizes within the threshold's ratio, sketches near."""
    far = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(4)), F.lit(0))
    return (100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b)) & (far <= MOST_BITS)


def prefixes(rest: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(shingle, at, doc_id, label, n): the rarest shingles of each document of rest (doc_id, label), with their places in the order of rarity.

    Two sets that are similar enough share a shingle among the first n - threshold * n + 1 of either, in any common order; in that of
    rarity most documents' first shingles are their own, and those meet nothing.
    """
    one = sets.join(rest, "doc_id").select("doc_id", "label", F.xxhash64("shingles").alias("text"), F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = one.groupBy("shingle").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "shingle")))
    ranked = one.join(often, "shingle").groupBy("doc_id", "text", "label", "n").agg(order.alias("order"))
    n = F.col("n")
    first = F.slice("order", F.lit(1), (n - F.ceil(n * threshold / 100) + 1).cast("int"))
    return ranked.select("doc_id", "label", "n", F.posexplode(first).alias("at", "s")).filter("s.df > 1").select(F.col("s.shingle").alias("shingle"), "at", "doc_id", "label", "n")


def across(first: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of documents with different labels that can still be similar enough, by sizes and by the places of a shared shingle.

    If the first shared shingle has places i and j, the sets share at most 1 + min(n_a - i - 1, n_b - j - 1) shingles. Of the
    documents with a shingle those of its most frequent label are not compared with each other, so a large component
    costs each other document one comparison a member, and itself none.
    """
    counts = first.groupBy("shingle", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("shingle").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    marked = first.join(main.select("shingle", "main"), "shingle").withColumn("minor", F.col("label") != F.col("main")).drop("main")
    x, y = marked.filter("minor").alias("x"), marked.alias("y")
    c = lambda name: F.col(name)
    sizes = 100 * F.least(c("x.n"), c("y.n")) >= threshold * F.greatest(c("x.n"), c("y.n"))
    room = (100 + threshold) * F.least(c("x.n") - c("x.at"), c("y.n") - c("y.at")) >= threshold * (c("x.n") + c("y.n"))
    on = (c("x.shingle") == c("y.shingle")) & (c("x.label") != c("y.label")) & (~c("y.minor") | (c("x.doc_id") < c("y.doc_id"))) & sizes & room
    return x.join(y, on).select(c("x.doc_id").alias("a"), c("y.doc_id").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.withColumn("both", both).filter(100 * F.col("both") >= threshold * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def linked(docs: DataFrame, scratch: Scratch, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked if 100 * intersection >= threshold * union of their shingle sets; component_id is the smallest id
    that can be reached, the document's own included, and kept marks the row that has it. A null or empty text has no
    shingles and is linked with nothing. Rows of one id are one document: they share their component, and the kept mark.
    Rows without an id are linked with nothing, have no component and are kept. An empty table gives no rows; other
    columns of docs are not read.
    """
    sig = scratch.write(signed(docs, k, id_col, text_col), "signed")
    usable = sig.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = usable.groupBy("d0", "d1", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    classes = scratch.write(classes, "classes")
    many = classes.filter("c > 1")
    copies = usable.join(many, ["d0", "d1", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")

    reps = usable.join(classes.select("d0", "d1", F.col("rep").alias("doc_id")), ["d0", "d1", "doc_id"]).dropDuplicates(["doc_id", "d0", "d1"])
    bands = reps.select("doc_id", F.explode("bands").alias("band"))
    least = bands.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("band", "a")
    members = scratch.write(bands.join(least, "band"), "members")
    slim = reps.select("doc_id", F.col("n_shingles").alias("n"), "sketch")
    slim = scratch.write(slim.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "slim")
    sets = scratch.write(sets_of(docs, slim.select("doc_id").distinct(), k, id_col, text_col), "sets")

    stars = members.select("a", F.col("doc_id").alias("b")).filter("a <> b").distinct()
    side = lambda n: slim.select(F.col("doc_id").alias(n), F.col("n").alias(f"n_{n}"), F.col("sketch").alias(f"s_{n}"))
    near = alike(F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"), threshold)
    first = stars.join(side("b"), "b").join(side("a"), "a").filter(near).select("a", "b").distinct()
    edges = scratch.write(confirmed(first, sets, threshold).unionByName(copies), "edges-1")
    found = scratch.write(components(edges, scratch, "first"), "components-1")

    labelled = members.select("band", "doc_id").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
    split = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band")
    rest = scratch.write(labelled.join(split, "band", "left_semi").select("doc_id", "label").distinct(), "rest")
    pairs = scratch.write(across(scratch.write(prefixes(rest, sets, threshold), "prefixes"), threshold), "pairs")
    more = scratch.write(confirmed(pairs, sets, threshold), "edges-2")
    if more.isEmpty():
        final = found
    else:
        final = scratch.write(components(edges.unionByName(more), scratch, "second"), "components-2")

    out = sig.select("doc_id", "n_shingles").join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir), Scratch(spark, "neardup"), k=2)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1
  )
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM reach r JOIN ways e ON r.node = e.a
), least AS (
  SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id
)
SELECT l.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, l.component_id, l.doc_id = l.component_id AS kept FROM least l LEFT JOIN n ON n.doc_id = l.doc_id
"""
