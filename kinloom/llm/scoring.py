"""Language-model scores by online logistic context mixing.

A document is coded as its kind, which is one of KINDS classes of its most frequent pair of bytes and costs their logarithm, then the sequence of its
lower-cased words, each as its bytes and a space, and one end, a line feed. The kind tells languages and registers apart. Every bit of
every byte is predicted by several predictors, one for each context inside the word: the last one to four bytes; two bytes and the kind; all of
the word so far, up to HEAD bytes; and all of the word so far and the kind. A predictor holds how often 0 and 1 followed its context and the bits of the byte before. Short contexts
are hashed into tables of fixed size, which are summed over all tasks and broadcast (TABLE_BYTES bounds them). Longer beginnings of words are counted
exactly and stay where they are: the vocabulary is dealt by the first HEAD bytes of a word, so all words with such a beginning are in one
bucket. A unit of the vocabulary is a word behind the byte of its kind.

Predictions are mixed in the logistic domain with weights that a gate selects (place in the word, and how often its beginning was seen), learned online over
all training words, each predicted without its own occurrence. The mix is then refined by an adaptive map from (gate, prediction) to what came true.
All bits' probabilities multiply to a word's probability, so unseen words have one too.

Across words, the hashed context of the two words before (or the start of the text) predicts the next word as often as training has seen it follow.
Its share in the final probability is gated by how often the context was seen and how many words followed it, and learned from what came true when each
occurrence is left out. So order matters: phrases and passages that training repeats are cheap, shuffled words are not. A training document's own occurrence of a
word is left out as well. Followers are known by a short code, whose share is dealt to the learned words of that code by their counts; so the probabilities of all next
words sum to no more than 1, whatever codes coincide. Contexts, their followers and the vocabulary grow with the corpus and are never in one place.

The model does not depend on how rows are dealt to tasks: counts are whole numbers, buckets follow the bytes of text, and weights are learned in LANES lanes of buckets,
each in its order.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import buckets

from . import packing
from .common import Scratch, documents, run_count, text_bytes

END = b"\n"
ORDERS = 4
#: Predictors: the orders, two bytes with the kind, the beginning, the beginning with the kind.
PREDICTORS, WHOLE, OWN = ORDERS + 3, ORDERS + 1, ORDERS + 2
KINDS = 128
#: Slots of a hashed table, as a power of two; two counts of 4 bytes in each.
SLOT_BITS = 18
TABLE_BYTES = PREDICTORS * 2 * 4 << SLOT_BITS
#: Bytes by which words are dealt; longer beginnings are counted in the bucket.
HEAD = 4
GATES, CELLS = 32, 33
#: Bytes of a training step, its rate, what keeps steps on few bits small, and the prior counts of a bit.
STEP, RATE, CALM, PRIOR = 10_000, 0.06, 300.0, 0.4
#: Distinct words, or tokens, after which a task passes on what it has counted.
FLUSH, FLUSH_TOKENS = 400_000, 4_000_000
#: Text of a bucket of the vocabulary and of one of contexts, and the lanes in which weights are learned, as a power of two: there are no fewer buckets.
BUCKET_BYTES, CONTEXT_BYTES, LANE_BITS = 8_000_000, 16_000_000, 6
#: Bits of the follower's hash in a key; the others are the context's.
FOLLOWER_BITS = 20
#: Gates of the words before: how often the context was seen, and how many words followed it.
SEEN, CONTEXT_GATES = np.array([1, 2, 3, 5, 9, 17, 65]), 28
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_R = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.uint64(0xA0761D6478BD642F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
VOCABULARY = "bucket int, n long, total long, words binary, counts binary"
ASKED = "bucket int, run long, words binary, counts binary"
TOLD = "run long, bucket int, counts binary, scores binary, followers binary"
#: Lower-cases A-Z and makes white space one character.
_PLAIN = bytes(32 if c in b"\t\n\x0b\x0c\r" else _LOWER[c] for c in range(256))


def kind_of(data: bytes) -> bytes:
    """One byte from 128 for the most frequent pair of bytes inside words (each by its lower six bits; the first of equals)."""
    b = np.frombuffer(data, "u1").astype("u2") & np.uint16(63)
    if len(b) < 2:
        return b"\x80"
    pairs = np.bincount(b[:-1] << np.uint16(6) | b[1:], minlength=4096)
    pairs[2048:2112], pairs[32::64] = 0, 0
    return bytes([128 + (int(pairs.argmax()) * 40_503 >> 5) % KINDS])


def parsed(text: str | None) -> tuple[bytes, list[bytes]]:
    """The kind of a text, and its tokens with the end."""
    data = (text or "").encode().translate(_PLAIN)
    return kind_of(data), [*data.split(), END]


def laid(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words side by side, some at a time: (the bytes of all, a space after each, where each starts, its size with the space)."""
    for at in range(0, len(words), 50_000):
        data = np.frombuffer(b" ".join(words[at : at + 50_000]) + b" ", "u1")
        ends = np.flatnonzero(data == 32) + 1
        yield data, np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word: a polynomial of its bytes, spread."""
    out = [np.zeros(0, "u8")]
    for data, starts, sizes in laid(words):
        power = np.cumprod(np.full(int(sizes.max()), _R), dtype="u8")
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        out.append(packing.mixed(np.add.reduceat((data.astype("u8") + np.uint64(1)) * power[place], starts)))
    return np.concatenate(out)


def buckets_of(words: list[bytes], bits: int) -> np.ndarray:
    """The bucket of each word, by its first HEAD bytes."""
    out = [np.zeros(0, "i8")]
    for data, starts, sizes in laid(words):
        first = np.zeros(len(starts), "u8")
        for k in range(HEAD):
            first = first << np.uint64(8) | np.where(k < sizes - 1, data[np.minimum(starts + k, len(data) - 1)], 0).astype("u8")
        out.append((packing.mixed(first * _R + _KIND) >> np.uint64(64 - bits)).astype("i8"))
    return np.concatenate(out)


def by_bucket(units: Iterable[bytes], bits: int) -> dict[int, list[bytes]]:
    """The units in their order, by the bucket of their words."""
    out: dict[int, list[bytes]] = {}
    units = list(units)
    for u, b in zip(units, buckets_of([u[1:] for u in units], bits).tolist(), strict=True):
        out.setdefault(b, []).append(u)
    return out


def joined(words: list[bytes]) -> bytes:
    return packing.compressed(b" ".join(words))


def split(blob: bytes) -> list[bytes]:
    return packing.decompressed(blob).split(b" ")


class _Numbers(dict):
    """Numbers of a kind's words, which become units in the order in which they are first asked for."""

    def __init__(self, kind: bytes, units: list[bytes]):
        self.kind, self.units = kind, units

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self.units)
        self.units.append(self.kind + word)
        return out


def followers(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key for each token of texts of so many tokens: the hash of the two words before it in its text, and that of the token; the last bit is free."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two = np.zeros(len(h), "u8"), np.zeros(len(h), "u8")
    one[1:], two[2:] = h[:-1], h[:-2]
    one[place < 1], two[place < 2] = 0, 0
    context = packing.mixed((one ^ (two >> np.uint64(17))) * _R + two * _MIX + _KIND)
    low = np.uint64(FOLLOWER_BITS)
    return (context >> low << low) | (packing.mixed(h + _R) >> np.uint64(64 - FOLLOWER_BITS) & ~np.uint64(1))


def follower_codes(h: np.ndarray) -> np.ndarray:
    """What a key holds of a word, given its hash: a number below 2^(FOLLOWER_BITS - 1)."""
    return (packing.mixed(h + _R) >> np.uint64(65 - FOLLOWER_BITS)).astype("i8")


def code_totals(vocab: DataFrame) -> np.ndarray:
    """How often words of each code occur in training texts. A context's share for a code is dealt to the words of the code by their own counts, so that what all
    next words get is no more than the share, however many have one code; words that were never learned from get nothing of it."""
    part, size = 1 << 12, 1 << (FOLLOWER_BITS - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, "i8")
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                ws, cs = bucket_words(words.as_py(), counts.as_py())
                if len(ws):
                    np.add.at(total, follower_codes(word_hashes([w[1:] for w in ws])), cs)
        blocks = total.reshape(-1, part)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packing.packed(blocks[i]) for i in some], pa.binary())], names=["block", "data"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "data": [packing.packed(np.sum([packing.unpacked(x, "<i8") for x in pdf["data"]], 0))]})

    out = np.zeros((size // part, part), "i8")
    for row in vocab.select("words", "counts").mapInArrow(count, "block int, data binary").groupBy("block").applyInPandas(add, "block int, data binary").toLocalIterator():
        out[row.block] = packing.unpacked(bytes(row.data), "<i8")
    return out.reshape(-1)


def code_of(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact up to 31, then in steps of an eighth of a doubling."""
    n = n.astype("f8")
    return np.where(n <= 31, n, np.minimum(255, 31 + np.floor(8 * np.log2(np.maximum(n, 31) / 31)))).astype("u1")


#: The least count of each code, and of one more than the last.
AT_LEAST = np.where(np.arange(257) <= 31, np.arange(257), 31 * 2.0 ** ((np.arange(257) - 31) / 8))


def context_gate(seen: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """By how often a context was seen (1 or more), and by the words that followed it: one, few or many for that."""
    often = np.searchsorted(SEEN, seen, "right") - 1
    share = kinds / np.maximum(seen, 1)
    return often * 4 + np.where(kinds <= 1, 0, np.where(share <= 0.25, 1, np.where(share <= 0.6, 2, 3)))


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of keys in any order: (order, first place of each distinct one in that order, its count, its context's count and number of followers)."""
    order = packing.order_of(keys)
    sorted_ = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(keys) else np.zeros(0, "i8")
    per = np.add.reduceat(counts[order], starts) if len(starts) else np.zeros(0, "i8")
    context = sorted_[starts] >> np.uint64(FOLLOWER_BITS)
    new = np.concatenate([[True], context[1:] != context[:-1]]) if len(starts) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    seen = np.bincount(group, per)[group].astype("i8") if len(starts) else np.zeros(0, "i8")
    kinds = np.bincount(group, per > 0)[group].astype("i8") if len(starts) else np.zeros(0, "i8")
    return order, starts, per, seen, kinds


def gate_counts(per: np.ndarray, seen: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """How often a word that follows a context had followed it before, and how often it stands there at all, by gate, when each occurrence is left out. Of what counted() gives for whole contexts."""
    left = (seen > 1) & (per > 0)
    per, seen, kinds = per[left], seen[left], kinds[left]
    gate = context_gate(seen - 1, kinds - (per == 1))
    return np.concatenate([np.bincount(gate, per * (per > 1), CONTEXT_GATES), np.bincount(gate, per, CONTEXT_GATES)]).astype("<i8")


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def vocabulary(docs: DataFrame, bits: int, id_col: str, text_col: str) -> DataFrame:
    """Units and counts of all training documents, a row for each bucket; n: its distinct words. Tasks count first, so a frequent word moves once a task."""

    def rows(seen: dict[bytes, Counter]) -> pa.RecordBatch:
        flat = {k + w: n for k, c in seen.items() for w, n in c.items()}
        parts = by_bucket(flat, bits)
        out = [(b, len(ws), sum(flat[w] for w in ws), joined(ws), packing.packed(np.array([flat[w] for w in ws], "<i8"))) for b, ws in parts.items()]
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "n", "total", "words", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, Counter] = {}
        tokens = 0
        for batch in batches:
            for i, text in enumerate(batch.column(0)):
                kind, words = parsed(text.as_py())
                seen.setdefault(kind, Counter()).update(words)
                tokens += len(words)
                if i % 256 == 255 and (sum(map(len, seen.values())) > FLUSH or tokens > FLUSH_TOKENS):
                    yield rows(seen)
                    seen, tokens = {}, 0
        if seen:
            yield rows(seen)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for words, counts in zip(pdf["words"], pdf["counts"], strict=True):
            for w, c in zip(split(words), unpacked_counts(counts), strict=True):
                total[w] += c
        words = sorted(total)
        counts = np.array([total[w] for w in words], "<i8")
        return pd.DataFrame({"bucket": [key[0]], "n": [len({u[1:] for u in words})], "total": [int(counts.sum())], "words": [joined(words)], "counts": [packing.packed(counts)]})

    counted_ = docs.filter(~held_out(id_col)).select(text_col).mapInArrow(count, VOCABULARY)
    return counted_.groupBy("bucket").applyInPandas(merge, VOCABULARY)


def context_shares(gates: DataFrame) -> np.ndarray:
    """The share of the words before in a word's probability, by gate: how often the word had followed before."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CONTEXT_GATES, "i8")
        for batch in batches:
            for counts in batch.column(0):
                total += packing.unpacked(counts.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "value"])

    total = np.zeros(2 * CONTEXT_GATES)
    for row in gates.select("counts").mapInArrow(add, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[row.at] = row.value
    return np.minimum(0.999, (total[:CONTEXT_GATES] + 0.05) / (total[CONTEXT_GATES:] + 1.0))


def unpacked_counts(blob: bytes) -> list[int]:
    return packing.unpacked(blob, "<i8").tolist()


class Bits:
    """The bits that code words, with the keys of their contexts. A beginning that several words share is coded once: what
    follows it is predicted alike, so its bits stand for all of them (`inverse` leads from each byte of each word to its bits)."""

    def __init__(self, words: list[bytes]):
        coded = [w[1:] if w[1:] == END else w[1:] + b" " for w in words]
        sizes = np.fromiter(map(len, coded), "i8", len(coded))
        data = np.frombuffer(b"".join(coded), "u1")
        n = len(data)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(n) - first
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _R)]), dtype="u8")[:n]
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _R_INVERSE)]), dtype="u8")[:n]
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype("u8") + np.uint64(1)) * power, dtype="u8")])
        so_far = lambda ends, length: (sums[ends] - sums[first]) * inverse[first] + length.astype("u8") * np.uint64(7919)
        kind = np.repeat(np.frombuffer(b"".join(w[:1] for w in words), "u1"), sizes).astype("u8") * _KIND
        at = np.arange(n)
        shared = packing.mixed(so_far(at + 1, place + 1) + kind)
        order = packing.order_of(shared)
        new = np.diff(shared[order], prepend=~shared[order[:1]]) != 0
        pick, self.inverse = order[new], np.empty(n, "i8")
        self.inverse[order] = np.cumsum(new) - 1
        self.word = np.repeat(np.arange(len(words)), sizes)
        before = [np.where(place[pick] >= k, data[np.maximum(pick - k, 0)], 0).astype("u8") for k in range(1, ORDERS + 1)]
        keys, past = [], np.zeros(len(pick), "u8")
        for k in range(ORDERS):
            past = past * np.uint64(256) + before[k]
            keys.append(packing.mixed(past * _R + np.uint64(k + 1)))
        beginning, kind = so_far(at, place)[pick], kind[pick]
        keys += [packing.mixed((before[0] * np.uint64(256) + before[1]) * _R + kind), packing.mixed(beginning), packing.mixed(beginning + kind)]
        own, level = data[pick], np.arange(8)
        node = ((1 << level) | (own[:, None].astype("i8") >> (8 - level))).astype("u8") * _R
        self.bit = ((own[:, None] >> (7 - level)) & 1).reshape(-1).astype(bool)
        self.place, self.far = np.repeat(place[pick], 8), np.repeat(place[pick] >= HEAD, 8)
        spread = lambda k: ((k[:, None] ^ node) * _MIX).reshape(-1)
        # of each byte after a long beginning: that beginning under its kind, and the byte
        far = place[pick] >= HEAD
        self.own = keys[OWN][far], own[far]
        self.slots = [(spread(k) >> np.uint64(64 - SLOT_BITS)).astype("i4") for k in keys]

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """How often each bit is coded if the words occur so often."""
        return np.repeat(np.bincount(self.inverse, counts.astype("f8")[self.word], len(self.bit) // 8), 8)

    def word_sums(self, values: np.ndarray, words: int) -> np.ndarray:
        """Sums over each word's bits."""
        return np.bincount(self.word, values.reshape(-1, 8).sum(1)[self.inverse], words)


def chunks(words: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of words of about `size` bytes each."""
    at, held = 0, 0
    for i, w in enumerate(words):
        held += len(w) + 1
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(words):
        yield at, len(words)


CHUNK = 200_000


def added_tables(tables: np.ndarray, words: list[bytes], counts: np.ndarray) -> None:
    """Adds a bucket's words to the hashed counts."""
    for s, e in chunks(words, CHUNK):
        bits = Bits(words[s:e])
        weight = bits.weights(counts[s:e])
        for k in range(PREDICTORS):
            use = slice(None) if k < WHOLE else ~bits.far
            at = bits.slots[k][use] * 2 + bits.bit[use]
            tables[k] += np.bincount(at, weight[use], 2 << SLOT_BITS)


class Beginnings:
    """Exact counts of the bits that follow beginnings of HEAD bytes or more under each kind, in one bucket: of (bits, their weights). All bits that are asked for
    are among those given, some with weight 0. Bytes are sorted by beginning and value, so what shares a beginning and the first bits of its byte lies side by side."""

    def __init__(self, parts: list[tuple[Bits, np.ndarray]]):
        keys, values, weights = [np.zeros(0, "u8")], [np.zeros(0, "u1")], [np.zeros(0)]
        for bits, weight in parts:
            keys.append(bits.own[0])
            values.append(bits.own[1])
            weights.append(weight[::8][bits.far[::8]])
            bits.own = None
        ends = np.cumsum([len(k) for k in keys])
        keys, values, weights = (np.concatenate(c) for c in (keys, values, weights))
        order = np.argsort(values, kind="stable")
        order = order[packing.order_of(keys[order])]
        keys, values, weights = keys[order], values[order], weights[order]
        apart = keys[1:] != keys[:-1]
        self.zeros, self.ones = np.empty((len(keys), 8), "f4"), np.empty((len(keys), 8), "f4")
        for level in range(8 if len(keys) else 0):
            node = values >> np.uint8(8 - level) if level else np.zeros(len(values), "u1")
            starts = np.concatenate([[0], np.flatnonzero(apart | (node[1:] != node[:-1])) + 1])
            one = np.add.reduceat(weights * (values >> np.uint8(7 - level) & np.uint8(1)), starts)
            zero, sizes = np.add.reduceat(weights, starts) - one, np.diff(np.append(starts, len(keys)))
            self.zeros[order, level], self.ones[order, level] = np.repeat(zero, sizes), np.repeat(one, sizes)
        self.places = dict(zip((id(bits) for bits, _ in parts), zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), strict=True))

    def counts(self, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
        """How often 0 and 1 followed the far ones of these bits; 0 and 0 for what was never seen."""
        s, e = self.places[id(bits)]
        return self.zeros[s:e].reshape(-1), self.ones[s:e].reshape(-1)


def logits(tables: np.ndarray) -> np.ndarray:
    """The logit of each slot."""
    pairs = tables.reshape(len(tables), -1, 2).astype("f4")
    return np.log((pairs[:, :, 1] + PRIOR) / (pairs[:, :, 0] + PRIOR))


def inputs(bits: Bits, tables: np.ndarray, beginnings: Beginnings, ready: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The predictors' logits and a bias, and the gate. With ready (the logits of all slots) all counts are used; without, one
    occurrence of each bit is left out, as if its word had been met for the first time."""
    out = np.empty((PREDICTORS + 1, len(bits.bit)), "f4")
    for k in range(PREDICTORS):
        slot = bits.slots[k]
        if ready is not None and k < OWN:
            out[k] = ready[k][slot]
        else:
            pair = tables[k].view("<i8")[slot].view("<i4")  # both counts of a slot at once
            zero, one = pair[::2].astype("f4"), pair[1::2].astype("f4")
            if k == OWN:
                zero[bits.far], one[bits.far] = beginnings.counts(bits)
            if ready is None:
                one = np.maximum(0, one - bits.bit)
                zero = np.maximum(0, zero - ~bits.bit)
            out[k] = np.log((one + PRIOR) / (zero + PRIOR))
        if k == WHOLE:
            out[k][bits.far] = 0
    seen = zero + one
    out[-1] = 0.3
    gate = np.minimum(bits.place, 7) * 4 + (seen > 0) + (seen > 3) + (seen > 31)
    return out, gate


def mixed_logit(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1], "f4")
    for k in range(len(x)):
        out += x[k] * weights[:, k].astype("f4")[gate]
    return out


def squashed(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -18, 18)))


def cell_of(logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return gate * CELLS + np.clip(np.rint(logit * 2) + CELLS // 2, 0, CELLS - 1).astype("i8")


def first_weights() -> np.ndarray:
    """Before learning: short contexts together count about as much as the whole beginning."""
    out = np.zeros((GATES, PREDICTORS + 1))
    out[:, :WHOLE], out[:, WHOLE], out[:, OWN] = 0.08, 0.3, 0.6
    return out


def trained(words: list[bytes], counts: np.ndarray, tables: np.ndarray, weights: np.ndarray, map_ones: np.ndarray, map_all: np.ndarray) -> None:
    """Goes through a bucket's words once, a step at a time; changes weights and the map. Every training occurrence weighs the same."""
    parts = [(bits := Bits(words[s:e]), bits.weights(counts[s:e])) for s, e in chunks(words, STEP)]
    beginnings = Beginnings(parts)
    for bits, w in parts:
        x, gate = inputs(bits, tables, beginnings)
        logit = mixed_logit(x, weights, gate)
        p = squashed(logit)
        cell = cell_of(logit, gate)
        map_ones += np.bincount(cell, w * bits.bit, GATES * CELLS)
        map_all += np.bincount(cell, w, GATES * CELLS)
        error = w * (bits.bit - p)
        sharp = w * np.maximum(p * (1 - p), 1e-3)
        for k in range(len(x)):
            weights[:, k] += RATE * np.bincount(gate, error * x[k], GATES) / (np.bincount(gate, sharp * x[k] ** 2, GATES) + CALM)
    np.clip(weights, -2, 4, out=weights)


class Model:
    """What is broadcast: hashed tables, weights, map. Its size does not depend on the corpus."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray, refined: np.ndarray):
        self.tables, self.ready, self.weights, self.refined = tables, logits(tables), weights, refined

    def scores(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 of each unit's probability, rounded down to what four bytes hold; words are all units of a bucket that training saw (so often), and any others (0)."""
        out = np.zeros(len(words))
        cuts = list(chunks(words, CHUNK))
        parts = [(bits := Bits(words[s:e]), bits.weights(counts[s:e])) for s, e in cuts]
        beginnings = Beginnings(parts)
        for (s, e), (bits, _) in zip(cuts, parts, strict=True):
            x, gate = inputs(bits, self.tables, beginnings, self.ready)
            logit = mixed_logit(x, self.weights, gate)
            p = (squashed(logit).astype("f8") + self.refined[cell_of(logit, gate)]) / 2
            out[s:e] = bits.word_sums(np.log10(np.where(bits.bit, p, 1 - p)), e - s)
        near = out.astype("f4")
        return np.where(near > out, np.nextafter(near, np.float32(-np.inf)), near).astype("f8")


def bucket_words(row_words: bytes, row_counts: bytes) -> tuple[list[bytes], np.ndarray]:
    return split(row_words), packing.unpacked(row_counts, "<i8")


def learned(vocab: DataFrame, bits: int) -> Model:
    """The model of a vocabulary. The driver gets sums of fixed size: tables once, then weights and map."""
    spark = vocab.sparkSession
    part = 1 << 12
    shape = (PREDICTORS, 2 << SLOT_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, some = np.zeros(shape), False
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                added_tables(tables, *bucket_words(words.as_py(), counts.as_py()))
                some = True
        flat = tables.reshape(-1, part)
        full = [i for i in range(len(flat)) if flat[i].any()] if some else []
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packing.packed(flat[i].astype("<i8")) for i in full], pa.binary())], names=["block", "data"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sum(packing.unpacked(x, "<i8") for x in pdf["data"]).reshape(-1, 2)
        # both counts of a slot lose the same bits, so that what they say of a bit stays
        shift = np.maximum(0, np.ceil(np.log2(pairs.max(1) + 1.0)) - 31).astype("i8")
        return pd.DataFrame({"block": [key[0]], "data": [packing.packed((pairs >> shift[:, None]).reshape(-1).astype("<i4"))]})

    blocks = vocab.select("words", "counts").mapInArrow(count, "block int, data binary").groupBy("block").applyInPandas(add, "block int, data binary")
    tables = np.zeros((shape[0] * shape[1] // part, part), "i4")
    for row in blocks.toLocalIterator():
        tables[row.block] = packing.unpacked(bytes(row.data), "<i4")
    tables = tables.reshape(shape)
    sent = spark.sparkContext.broadcast(tables)
    lanes = vocab.select(F.shiftright("bucket", bits - LANE_BITS).alias("lane"), "bucket", "words", "counts")
    dealt = lanes.repartition(1 << LANE_BITS, "lane").sortWithinPartitions("lane", "bucket")
    size = GATES * (PREDICTORS + 1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, state = None, None

        def told() -> pa.RecordBatch:
            weights, ones, alls, mass = state
            values = np.concatenate([weights.reshape(-1) * mass, ones, alls, [mass]]).astype("<f8")
            return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["lane", "data"])

        for batch in batches:
            for here, words, counts in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if here != lane:
                    if state:
                        yield told()
                    lane, state = here, [first_weights(), np.zeros(GATES * CELLS), np.zeros(GATES * CELLS), 0.0]
                ws, cs = bucket_words(words.as_py(), counts.as_py())
                trained(ws, cs, sent.value, *state[:3])
                state[3] += float(cs.sum())
        if state:
            yield told()

    # one row a lane, added in order, so that the sums do not depend on which task was first
    values = np.zeros(size + 2 * GATES * CELLS + 1)
    for row in sorted(dealt.mapInArrow(train, "lane int, data binary").collect(), key=lambda r: r.lane):
        values += np.frombuffer(bytes(row.data), "<f8")
    weights = values[:size].reshape(GATES, -1) / values[-1] if values[-1] else first_weights()
    ones, alls = values[size : size + GATES * CELLS], values[size + GATES * CELLS : -1]
    middle = squashed((np.arange(CELLS) - CELLS // 2) / 2)
    refined = (ones + 20 * np.tile(middle, GATES)) / (alls + 20)
    return Model(tables, weights, np.clip(refined, 1e-7, 1 - 1e-7))


def mixed_scores(spelled: np.ndarray, codes: np.ndarray, learned_: np.ndarray, shares: np.ndarray, portion: np.ndarray) -> np.ndarray:
    """log10 of each token's probability: that of its spelling (given as log10), mixed with how often it followed the words before.

    portion is the token's part of all occurrences of words with its code, 0 for a word that was never learned from. codes are those of (the token after its context, the context, its distinct followers); a token that was learned from is left out of its own counts.
    """
    out = spelled.copy()
    some = np.flatnonzero(codes[1] > learned_)
    per, seen, kinds = codes[:, some]
    learned_, spelled = learned_[some], spelled[some]
    follows = AT_LEAST[per] - (learned_ & (per <= 31))
    # a long count is rounded up, so that shares of all followers do not exceed the whole
    before = np.where(seen <= 31, seen - learned_.astype("f8"), AT_LEAST[seen.astype("i4") + 1])
    share = shares[context_gate(before, kinds - (learned_ & (per == 1)).astype("f8"))]
    with np.errstate(divide="ignore", under="ignore"):
        both = np.log10((1 - share) * 10.0**spelled + share * follows / before * portion[some])
    # where all of a word's bits are too unlikely for a double, its logarithm stands
    out[some] = np.where(np.isfinite(both), both, np.log10(1 - share) + spelled)
    return out


def scored(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score, n_bytes, bits_per_byte) for each row of docs.

    spelled_score is what the score would be without the words before. The model learns from the documents that are not held out and scores all. A null or empty text is its end alone. A row without
    an id counts as one whose id is the empty string (not held out). Rows that repeat are learned from as often as they occur.
    Without training documents all counts are 0 and the model has its first weights. An empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    size = text_bytes(docs, text_col)
    runs = run_count(size)
    bits, context_bits = (max(LANE_BITS, (-(-size // b) - 1).bit_length()) for b in (BUCKET_BYTES, CONTEXT_BYTES))
    vocab = scratch.write(vocabulary(docs, bits, id_col, text_col), "vocabulary").filter("bucket >= 0")
    n, distinct = vocab.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    model = spark.sparkContext.broadcast(learned(vocab, bits))
    sums_of_codes = spark.sparkContext.broadcast(code_totals(vocab))
    whole = n + distinct + 1

    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    place = F.when(id_.isNull(), F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(id_))
    rows = docs.select(F.pmod(place, F.lit(runs)).cast("long").alias("run"), id_.alias("doc_id"), held_out(id_col).alias("held_out"), text.alias("text"))

    class Read:
        """A run's rows in order of id and text, their tokens as numbers of units, the units by bucket, and the key of each token with the words before."""

        def __init__(self, pdf: pd.DataFrame, placed: bool):
            self.rows = pdf.sort_values(["doc_id", "text"])
            texts = [parsed(t) for t in self.rows["text"]]
            self.units: list[bytes] = []
            at: dict[bytes, _Numbers] = {}
            for kind, _ in texts:
                if kind not in at:
                    at[kind] = _Numbers(kind, self.units)
            self.sizes = np.fromiter((len(ws) for _, ws in texts), "i8", len(texts))
            self.token = np.concatenate([np.zeros(0, "i8"), *[np.fromiter(map(at[kind].__getitem__, ws), "i8", len(ws)) for kind, ws in texts]])
            del texts, at
            words = [u[1:] for u in self.units]
            self.bucket = buckets_of(words, bits)
            self.order = np.argsort(self.bucket, kind="stable")
            keys = followers(word_hashes(words)[self.token], self.sizes)
            self.learned = np.repeat(~self.rows["held_out"].to_numpy(bool), self.sizes)
            if placed:
                order = packing.order_of(keys)
                new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
                self.entry = np.empty(len(keys), "i8")
                self.entry[order] = np.cumsum(new) - 1
                return
            # the last bit of a key is free and says whether the token is learned from
            both = np.sort(keys | self.learned)
            keys = both & ~np.uint64(1)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.times = keys[starts], np.add.reduceat((both & np.uint64(1)).astype("i8"), starts).astype("<i4")

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        run = Read(pdf, placed=False)
        bucket = run.bucket[run.order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        placed = [run.units[i] for i in run.order.tolist()]
        out = [(int(bucket[s]), key[0], joined(placed[s:e]), None) for s, e in zip(cut, [*cut[1:], len(placed)], strict=True)]
        counts = run.times
        # contexts have buckets of their own, below 0
        edge = packing.cuts(run.keys, context_bits).tolist()
        out += [(b - (1 << context_bits), key[0], packing.packed_sorted(run.keys[s:e]), packing.packed(counts[s:e])) for b, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if e > s]
        return pd.DataFrame(out, columns=["bucket", "run", "words", "counts"])

    def answer(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        pairs = asked[asked["counts"].notna()]
        if len(pairs):
            parts = [packing.unpacked_sorted(k) for k in pairs["words"]]
            keys, counts = np.concatenate(parts), np.concatenate([packing.unpacked(c, "<i4") for c in pairs["counts"]]).astype("i8")
            order, starts, per, seen, kinds = counted(keys, counts)
            # a context is in one bucket with all that follows it in the whole corpus, so this is where its gates are counted: under no run
            out.append((-1, key[0], packing.packed(gate_counts(per, seen, kinds)), None, None))
            codes = np.empty((3, len(keys)), "u1")
            lengths = np.diff(np.append(starts, len(keys)))
            for row, values in zip(codes, (per, seen, kinds), strict=True):
                row[order] = np.repeat(code_of(values), lengths)
            ends = np.cumsum([len(p) for p in parts]).tolist()
            out += [(r, key[0], None, None, packing.compressed(codes[:, e - len(p) : e].tobytes())) for r, e, p in zip(pairs["run"], ends, parts, strict=True)]
        asked = asked[asked["counts"].isna()]
        if len(asked):
            words, counts = bucket_words(known["words"].iloc[0], known["counts"].iloc[0]) if len(known) else ([], np.zeros(0, "i8"))
            lists = [split(x) for x in asked["words"]]
            every = sorted(set(words).union(*lists))
            at = dict(zip(every, range(len(every)), strict=True))
            trained_ = np.zeros(len(every), "i8")
            trained_[[at[u] for u in words]] = counts
            of_word: Counter = Counter()
            for u, c in zip(words, counts.tolist(), strict=True):
                of_word[u[1:]] += c
            count = np.fromiter((of_word[u[1:]] for u in every), "i8", len(every))
            score = model.value.scores(every, trained_)
            for r, us in zip(asked["run"], lists, strict=True):
                i = np.fromiter(map(at.__getitem__, us), "i8", len(us))
                out.append((r, key[0], packing.packed(count[i]), packing.packed(score[i].astype("<f4")), None))
        return pd.DataFrame(out, columns=["run", "bucket", "counts", "scores", "followers"])

    def total(key: tuple, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        run = Read(pdf, placed=True)
        told = told.sort_values("bucket")
        spelled_rows, pair_rows = told[told["followers"].isna()], told[told["followers"].notna()]
        count, score = np.zeros(len(run.units), "i8"), np.zeros(len(run.units))
        count[run.order] = np.concatenate([packing.unpacked(c, "<i8") for c in spelled_rows["counts"]])
        score[run.order] = np.concatenate([packing.unpacked(c, "<f4") for c in spelled_rows["scores"]])
        codes = np.concatenate([np.zeros((3, 0), "u1"), *[np.frombuffer(packing.decompressed(f), "u1").reshape(3, -1) for f in pair_rows["followers"]]], 1)
        words = word_hashes([u[1:] for u in run.units])
        portion = count / np.maximum(sums_of_codes.value[follower_codes(words)], 1)
        logs = mixed_scores(score[run.token], codes[:, run.entry], run.learned, shares, portion[run.token])
        size = np.fromiter((1 if u[1:] == END else len(u) for u in run.units), "i8", len(run.units))
        ends = np.cumsum(run.sizes)
        sums = lambda values: np.add.reduceat(values, ends - run.sizes)
        base = np.log10((count + 1) / whole)[run.token]
        got = pd.DataFrame({"doc_id": run.rows["doc_id"].astype("Int64").to_numpy(object, na_value=None), "held_out": run.rows["held_out"].to_numpy(), "n_tokens": run.sizes})
        got["n_known"], got["train_tokens"] = sums((count[run.token] > 0).astype("i8")), n
        got["base_score"], got["score"] = sums(base), sums(logs) - math.log10(KINDS)
        got["spelled_score"], got["n_bytes"] = sums(score[run.token]) - math.log10(KINDS), sums(size[run.token])
        got["bits_per_byte"] = -got["score"] * math.log2(10) / got["n_bytes"]
        return got

    where, n_buckets, layout = scratch.path(f"rows-{uuid.uuid4().hex}"), 2 * runs, rows.schema
    buckets.write(rows, where, ("run",), n_buckets)
    rows = buckets.read(spark, where, layout, ("run",), n_buckets)
    asked = rows.groupBy("run").applyInPandas(ask, ASKED)
    told = asked.groupBy("bucket").cogroup(vocab.select("bucket", "words", "counts").groupBy("bucket")).applyInPandas(answer, TOLD)
    told = scratch.write(told, f"told-{uuid.uuid4().hex}")
    # what the gates learned goes to the vocabulary, under the buckets of contexts
    gates = told.filter("run < 0").selectExpr("bucket", "0L n", "0L total", "CAST('' AS BINARY) words", "counts")
    gates.write.mode("append").option("compression", "zstd").parquet(scratch.path("vocabulary"))
    shares = context_shares(gates)
    told = told.filter("run >= 0")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double, n_bytes long, bits_per_byte double"
    return rows.groupBy("run").cogroup(told.groupBy("run")).applyInPandas(total, schema)


def op9_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), Scratch(spark, "scoring"))
