"""Byte-level BPE by ranks: encoding with a hierarchical-bitmap rank queue, and decoding.

A text is cut into pieces by the pattern; a piece that is a token itself is that id, any other starts as its bytes in a linked list. Each
pair of neighbours whose joined bytes are a token stands in the bucket of that token's rank, by the place of its left part. Which buckets hold
something is kept in a bitmap of three levels of 64-bit words, so the lowest rank is found by three find-first-set steps whatever the number
of pairs. A pair's entry isn't taken out when a neighbour merges: the place remembers which rank it stands for now, and entries of another rank
are skipped. A bucket is taken from left to right; if a merge makes a pair of a lower rank, that one comes first. So n bytes take O(n) queue steps and
memory, and a piece of a megabyte costs per byte what a short one does.

All new pieces of a slice of texts go through the queue together, each a list of its own, since the order of ranks is the same for all. Pieces of up to
`SHORT` bytes are remembered with their ids in two dictionaries of at most `MEMORY` pieces: when the younger is full it becomes the older, and
pieces seen again move to the younger.

A null or empty text has no tokens, and the hashes of the empty string. Repeated and null doc_ids are rows like any other; an empty table gives
no rows; other columns are ignored. A text is held by one task at a time, with its ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import column, list_array, slices

SHORT, MEMORY = 32, 1 << 18
ENCODED = "doc_id long, ids array<int>"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of base64 tokens with their ranks, a line each."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class RankQueue:
    """Places by rank, lowest rank first. Three levels of words of 64 bits: a bit says whether the bucket, or word, below holds something."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0  # a bit for each word of mid: up to 262,144 ranks in 64 bits

    def _mark(self, rank: int) -> None:
        word = rank >> 6
        if not self.low[word]:
            if not self.mid[word >> 6]:
                self.top |= 1 << (word >> 6)
            self.mid[word >> 6] |= 1 << (word & 63)
        self.low[word] |= 1 << (rank & 63)

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self._mark(rank)
        bucket.append(place)

    def fill(self, rank: int, places: list[int]) -> None:
        """Put at least one place in an empty bucket."""
        self._mark(rank)
        self.buckets[rank] = places

    def take_first(self) -> tuple[int, list[int]]:
        """The lowest rank that has places, with its places, which leave the queue; (-1, []) of an empty queue."""
        top = self.top
        if not top:
            return -1, []
        first = top & -top
        high = first.bit_length() - 1
        mid = self.mid[high]
        middle = mid & -mid
        word = (high << 6) + middle.bit_length() - 1
        low = self.low[word]
        last = low & -low
        rank = (word << 6) + last.bit_length() - 1
        self.low[word] = low = low ^ last
        if not low:
            self.mid[high] = mid = mid ^ middle
            if not mid:
                self.top = top ^ first
        places, self.buckets[rank] = self.buckets[rank], []
        return rank, places


class RankEncoder:
    """Ids of texts by ranks, and the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        missing = [x for x in range(256) if bytes([x]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:8]}")
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.twos = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # ids as unsigned 32-bit numbers
        self.older: dict[str, bytes] = {}
        self.tokens = {rank: token for token, rank in ranks.items()}

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that are no tokens themselves, all in a row, and where each piece's begin, with the end."""
        raw, rank_of, push, take_first = b"".join(pieces), self.ranks.get, self.queue.push, self.queue.take_first
        n, byte = len(raw), np.frombuffer(raw, np.uint8).astype(np.int32)
        at = np.concatenate(([0], np.cumsum([len(x) for x in pieces])))
        edge = bytearray(n + 1)  # 1 where a piece starts
        np.frombuffer(edge, np.uint8)[at] = 1
        pairs = np.full(n, -1, np.int32)  # the rank of the pair whose left part starts here
        pairs[:-1] = self.twos[byte[:-1] * 256 + byte[1:]]
        pairs[at[1:] - 1] = -1
        first = np.flatnonzero(pairs >= 0)
        first = first[np.argsort(pairs[first], kind="stable")]
        some, begin = np.unique(pairs[first], return_index=True)
        for rank, places in zip(some.tolist(), np.split(first, begin[1:])):
            self.queue.fill(rank, places.tolist())
        stands = array("i", pairs.tobytes())
        after = array("i", range(1, n + 2))  # where the part from each place ends, and the next starts
        before = array("i", range(-1, n))
        whole = bytearray(b"\1") * n  # 0 where a part no longer starts
        while True:
            rank, places = take_first()
            if rank < 0:
                break
            if len(places) > 1:
                places.sort()
            for k, i in enumerate(places, 1):
                if stands[i] != rank:
                    continue  # a neighbour has merged since
                gone = after[i]
                end = after[i] = after[gone]
                before[end] = i
                stands[gone] = least = -1
                whole[gone] = 0
                if not edge[end]:
                    least = rank_of(raw[i : after[end]], -1)
                    if least >= 0:
                        push(least, i)
                stands[i] = least
                if not edge[i]:
                    left = before[i]
                    made = stands[left] = rank_of(raw[left:end], -1)
                    if made >= 0:
                        push(made, left)
                        if least < 0 or made < least:
                            least = made
                if 0 <= least < rank:
                    if k < len(places):
                        self.queue.fill(rank, places[k:])
                    break
        starts = np.flatnonzero(np.frombuffer(whole, np.uint8))
        cut = [*starts.tolist(), n]
        ids = np.array([rank_of(raw[a:b]) for a, b in zip(cut, cut[1:])], np.uint32)
        return ids, np.searchsorted(starts, at)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces that the younger memory doesn't have."""
        found, rest, raw = {}, [], []
        for x in new:
            ids = self.older.get(x)
            if ids is None:
                piece = x.encode()
                whole = self.ranks.get(piece)
                if whole is None:
                    rest.append(x)
                    raw.append(piece)
                    continue
                ids = whole.to_bytes(4, "little")
            found[x] = ids
        if rest:
            ids, at = self.merge(raw)
            packed, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
            found.update(zip(rest, (packed[a:b] for a, b in zip(at, at[1:]))))
        for x, ids in found.items():
            if len(x) <= SHORT:
                if len(self.known) >= MEMORY:
                    self.known, self.older = {}, self.known
                self.known[x] = ids
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text."""
        cut = [self.pieces(x) if x else [] for x in texts]
        known = self.known
        new = self._learn(list({x: None for pieces in cut for x in pieces if x not in known}))
        return [np.frombuffer(b"".join([known.get(x) or new[x] for x in pieces]), "<u4") for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@cache
def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """One encoder a worker process."""
    return RankEncoder(load_ranks(path), pattern)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks, pattern)
        for batch in slices(batches):
            ids = encoder.encode(column(batch, "text").to_pylist())
            listed = list_array(np.concatenate(ids).astype(np.int32), np.cumsum([len(x) for x in ids]), pa.int32())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), listed], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of every row of ids, null of null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks, pattern)
        for batch in batches:
            raw = [None if x is None else encoder.decode(np.array(x, np.int64)) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Each slice of texts is encoded, and its ids decoded, so that neither need be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks, pattern)
        names = {x: str(x) for x in encoder.tokens}
        for batch in slices(batches):
            ids = encoder.encode(column(batch, "text").to_pylist())
            of_ids = [hashlib.sha256(" ".join(map(names.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
            of_bytes = [hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
