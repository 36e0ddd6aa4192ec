"""Byte-level BPE by a monoid tree reduction.

A text is halved until its parts are short; parts are encoded alone and neighbours are joined on the way up. A join
re-encodes a window over the boundary and lets it grow until what stands outside can be proved not to change:

* Splitting. The pattern has no lookbehind, so how a text is split from a position on depends on what follows only. All
  pieces of the left part but its last two are final: a match looks at no more than the end of its own run and, for
  the contractions, at two characters after the apostrophe. On the right, once a final piece of the window ends where
  a piece of the right part starts, all pieces from there on are the right part's own.
* Merging inside a long piece. A sequence of tokens is the encoding of its bytes if and only if each pair of neighbours
  is the encoding of that pair's bytes. Inside either half all pairs are known to be so; the window grows until the
  pairs at its two ends are so as well.

Decoding concatenates bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import documents, sliced

#: Texts of up to so many characters, and pieces of up to so many bytes, are leaves; most documents have several.
LEAF_CHARS, LEAF_BYTES = 1_024, 256
#: Pieces whose tokens are remembered by a worker, and the longest of them in characters.
CACHE_PIECES, CACHE_CHARS = 200_000, 24


def read_ranks(path: str) -> bytes:
    """The rank file as it is, to be sent to the workers (below 1 MB for 50,000 tokens)."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Encodes and decodes by a rank file and a pattern without lookbehind."""

    def __init__(self, rank_file: bytes, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self._whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._piece = self._whole._core_bpe.encode_single_piece
        self._bytes = {i: b for b, i in ranks.items()}
        self._split = regex.compile(pattern).findall
        self._cache: dict[str, list[int]] = {}
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes

    def encode(self, text: str) -> np.ndarray:
        """The ids, as unsigned 32-bit integers."""
        if len(text) <= self.leaf_chars:
            return np.asarray(self._whole.encode_to_numpy(text), "<u4")
        pieces = self._tree(text)
        return np.fromiter((t for p in pieces for t in self._tokens(p)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, concatenated up a tree whose leaves are runs of ids."""
        step = max(1, self.leaf_chars)
        parts = [b"".join(map(self._bytes.__getitem__, ids[i : i + step].tolist())) for i in range(0, len(ids), step)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""

    def _tree(self, text: str) -> list[str]:
        """The pieces of a text, from those of its halves."""
        if len(text) <= self.leaf_chars:
            return self._split(text)
        middle = len(text) // 2
        return self._join(self._tree(text[:middle]), self._tree(text[middle:]))

    def _join(self, left: list[str], right: list[str]) -> list[str]:
        final, tail = left[:-2], "".join(left[-2:])
        take = 4
        while True:
            window = self._split(tail + "".join(right[:take]))
            last = take >= len(right)
            starts, at = {}, len(tail)
            for j, piece in enumerate(right[:take]):
                starts[at] = j
                at += len(piece)
            at = 0
            for i, piece in enumerate(window if last else window[:-2]):
                at += len(piece)
                if at in starts:
                    return final + window[: i + 1] + right[starts[at] :]
            if last:
                return final + window
            take *= 2

    def _tokens(self, piece: str) -> list[int]:
        if (known := self._cache.get(piece)) is not None:
            return known
        out = self._merge_tree(piece.encode())
        if len(piece) <= CACHE_CHARS and len(self._cache) < CACHE_PIECES:
            self._cache[piece] = out
        return out

    def _merge_tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self._piece(piece)
        middle = len(piece) // 2
        return self._merge_join(self._merge_tree(piece[:middle]), self._merge_tree(piece[middle:]))

    def _stands(self, a: int, b: int) -> bool:
        return self._piece(self._bytes[a] + self._bytes[b]) == [a, b]

    def _merge_join(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 2
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._piece(b"".join(map(self._bytes.__getitem__, left[len(left) - i :] + right[:j])))
            before = i == len(left) or self._stands(left[-i - 1], window[0])
            after = j == len(right) or self._stands(window[-1], right[j])
            if before and after:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if before else 2 * i, j if after else 2 * j


_made: dict[tuple, Encoder] = {}


def encoder(rank_file: bytes, pattern: str, leaf_chars: int = LEAF_CHARS) -> Encoder:
    """One for each worker process."""
    key = (hash(rank_file), pattern, leaf_chars)
    if key not in _made:
        _made[key] = Encoder(rank_file, pattern, leaf_chars)
    return _made[key]


def coded(batches: Iterator[pa.RecordBatch], enc: Encoder, id_col: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """What comes of batches (id, text), in short ones: a text's ids take more than the text."""
    for batch in sliced(batches):
        n, hashes, plain, kept = [], [], [], []
        for text in batch.column(1):
            ids = enc.encode(text.as_py() or "")
            n.append(len(ids))
            hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
            plain.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            if with_ids:
                kept.append(ids.astype("i4"))
        out = [batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(plain, pa.string())]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            out, names = [*out, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(out, names=names)


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each whole text, without a shuffle.

    One row for each row of docs: the id column as it is (null stays null), n_tokens, ids_sha256 and decoded_sha256, and
    with_ids the ids themselves. A null text is encoded as an empty one: no tokens. Repeated rows give repeated rows, an
    empty table gives none, and columns of docs other than the two named are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return coded(batches, encoder(rank_file, pattern), id_col, with_ids)

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
