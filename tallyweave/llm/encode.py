"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

A pair of bytes that stands inside no token of the vocabulary can never be merged across, so a text may be cut there for
certain: the fragments are encoded independently and their ids concatenated. Cuts are found by one table look-up per
byte over a whole Arrow batch; of the fragments only the distinct ones are encoded, then ids are gathered by position.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct fragments whose ids a worker keeps between batches.
CACHE = 200_000
#: Pieces of more bytes are merged by a heap, in n log n steps, as the library's own loop is quadratic.
LONG = 2_000
#: Texts are worked on in slices of about so many bytes, to bound memory whatever the batch holds.
SLICE = 8 << 20

# Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one piece: always the pair of least rank, of equal ones the leftmost."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        alive[j] = 0
        end[i] = end[j]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and (right := after[left]) < n and (r := ranks.get(piece[left : end[right]])) is not None:
                heapq.heappush(heap, (r, left, end[right]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """The tokenizer of one worker process."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        self.ranks = read_ranks(path)
        inside = np.zeros(65536, bool)
        for token in self.ranks:
            b = np.frombuffer(token, np.uint8).astype(np.int64)
            inside[b[:-1] * 256 + b[1:]] = True
        lead = np.arange(256)
        space = np.isin(lead, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
        alnum = np.array([chr(c).isalnum() and c < 128 for c in lead])
        left, right = np.arange(65536) >> 8, np.arange(65536) & 255
        # Never within a character, nor after white space (how a run of it splits depends on what follows), nor before an
        # apostrophe that would begin a contraction of its own fragment only.
        self.cut = ~inside & ~space[left] & ((right < 128) | (right >= 192)) & ~((right == 39) & ~alnum[left])
        self.split = regex.compile(PATTERN)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.kept: dict[bytes, list[int]] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions before which `data` (UTF-8 bytes) is certain to be cut."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.cut[data[:-1].astype(np.int64) * 256 + data[1:]]) + 1
        # After a character of white space beyond ASCII no cut is certain either.
        last = data[at - 1]
        wide = np.flatnonzero(last >= 128)
        if len(wide):
            p = at[wide]
            a, b, c = (np.where(p >= k, data[np.maximum(p - k, 0)], 0) for k in (3, 2, 1))
            blank = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            blank |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
            at = np.delete(at, wide[blank])
        return at

    def encode(self, fragment: bytes) -> list[int]:
        """Ids of one fragment."""
        if (ids := self.kept.get(fragment)) is None:
            text = fragment.decode()
            if len(fragment) <= LONG:
                ids = self.fast.encode_ordinary(text)
            else:
                ids = []
                for piece in self.split.findall(text):
                    raw = piece.encode()
                    ids += heap_merge(raw, self.ranks) if len(raw) > LONG else self.fast._encode_single_piece(raw)
            if len(self.kept) >= CACHE:
                self.kept.clear()
            if len(fragment) <= LONG:
                self.kept[fragment] = ids
        return ids

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text in them) of a string column; null and empty texts have none."""
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        if low == high:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
        ends = offsets - low
        bounds = np.union1d(self.cuts(data), ends)
        fragments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = fragments.dictionary_encode()
        which = coded.indices.to_numpy()
        ids = [self.encode(f) for f in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for one in ids for x in one), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        length = sizes[which]
        end = np.cumsum(length)
        place = np.arange(end[-1]) - np.repeat(end - length, length) + np.repeat(starts[which], length)
        total = np.concatenate([[0], end])
        return flat[place], total[np.searchsorted(bounds, ends)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file."""
    return Encoder(path)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE bytes of text each, at least a row each."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's whole text, without special tokens; an empty list for null and empty texts.

    One row per row of `df`, repeated keys included; strings of special tokens are ordinary text. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for part in _slices(batch, text):
                ids, offsets = own.encode_column(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens): the number of tokens of each row's whole text; 0 for null and empty texts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for part in _slices(batch, text):
                _, offsets = own.encode_column(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(np.diff(offsets))], names=[key, "tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens long")
