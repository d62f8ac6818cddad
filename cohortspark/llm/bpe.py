"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash (hash, displace) over the vocabulary answers whole pre-tokens
that are themselves tokens; the stored bytes are compared, so a foreign pre-token is a miss.
Tier two: a miss is merged from its bytes: a heap of (rank, place) over a doubly linked list of
parts, stale entries skipped.  Ids are those of the public reference encoder for the same ranks.

Defined cases: null or empty text has no ids; the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import ChunkMemo, in_slices, mix64

#: Python's \s also counts four control characters (1C to 1F); the pattern means Unicode's.
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def own_pattern(pattern: str) -> str:
    """The pre-token pattern with white space spelled out, inside and outside of classes."""
    out = pattern.replace(r"[^\s", f"[^{SPACE}")
    return out.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: n keys fill n slots.

    A key's bucket has a displacement, found bucket by bucket from the largest, that sends all
    its keys to free slots.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        n = self.n = len(keys)
        self.buckets = max(1, -(-n // per_bucket))
        h = self._hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        self.shift = np.zeros(self.buckets, np.uint64)
        slot = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[starts[b] : starts[b + 1]]
            if not len(own):
                break
            d = 0
            while True:  # 64 displacements at a time
                tries = np.arange(d, d + 64, dtype=np.uint64)
                places = self._place(h[own][:, None], tries[None, :])
                free = ~taken[places].any(axis=0)
                if len(own) > 1:
                    s = np.sort(places, axis=0)
                    free &= ~(s[1:] == s[:-1]).any(axis=0)
                if free.any():
                    k = int(np.argmax(free))
                    self.shift[b] = tries[k]
                    slot[own] = places[:, k]
                    taken[places[:, k]] = True
                    break
                d += 64
        self.key_at = [b""] * n
        for i, s in enumerate(slot.tolist()):
            self.key_at[s] = keys[i]
        self.slot_of_key = slot

    def _hashes(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hash, keys), np.uint64, len(keys))

    def _place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix64(h ^ (d * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Slot of each key, -1 where it is not one of the hashed keys."""
        if not keys or not self.n:
            return np.full(len(keys), -1, np.int64)
        h = self._hashes(keys)
        slots = self._place(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)])
        at = self.key_at
        return np.fromiter((s if at[s] == k else -1 for s, k in zip(slots.tolist(), keys)), np.int64, len(keys))


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the bytes of one pre-token, lowest rank first, leftmost among equals."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that begins at i ends; 0: swallowed by an earlier one
    before = list(range(-1, n - 1))
    get = ranks.get
    # A heap entry is one integer, small for a short piece: rank, place of the left part, end of the right part.
    bits = n.bit_length()
    low, two = (1 << bits) - 1, 2 * bits
    heap = [r << two | i << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        stop = entry & low
        i = entry >> bits & low
        j = end[i]
        if not j or j >= n or end[j] != stop:  # stale: one of the two parts has changed
            continue
        end[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            after = end[stop]
            if (r := get(piece[i:after])) is not None:
                heappush(heap, r << two | i << bits | after)
        k = before[i]
        if k >= 0 and (r := get(piece[k:stop])) is not None:
            heappush(heap, r << two | k << bits | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.words = list(ranks)
        self.table = PerfectHash(self.words)
        self.rank_at = np.zeros(max(1, len(ranks)), np.int64)
        self.rank_at[self.table.slot_of_key] = list(ranks.values())
        self.cut = regex.compile(own_pattern(pattern)).findall
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for w, r in ranks.items():
            by_id[r] = w
        # The bytes of all tokens in one row, by id: decoding gathers from it.
        self.pool = np.frombuffer(b"".join(by_id), np.uint8)
        self.width = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.begin = np.cumsum(self.width) - self.width
        self.known: dict[str, list[int]] = {}
        self.memo = ChunkMemo(self._encode, "i", limit=400_000)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.cut(t) for t in texts]
        known = self.known
        if len(known) > self.memo.limit:
            known.clear()
        pieces = list({p for c in cut for p in c} - known.keys())
        raw = [p.encode("utf-8", "replace") for p in pieces]
        for piece, own, slot in zip(pieces, raw, self.table.find(raw).tolist()):
            known[piece] = [int(self.rank_at[slot])] if slot >= 0 else merge_bytes(own, self.ranks)
        return [[i for p in c for i in known[p]] for c in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.memo(texts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and where each id's bytes end."""
        width = self.width[ids]
        ends = np.cumsum(width)
        source = np.repeat(self.begin[ids] - (ends - width), width)
        source += np.arange(len(source))
        return self.pool[source], ends

    def decode_lists(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each list of ids; list i lies from offsets[i] to offsets[i + 1]."""
        raw, ends = self.decode(ids)
        edges = np.concatenate([[0], ends])[offsets].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)])


_CODECS: dict = {}


def codec(vocabulary: str) -> BytePairCodec:
    """The codec of a public rank file, kept for the life of a worker."""
    if vocabulary not in _CODECS:
        import public_tokenizers

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODECS[vocabulary] = BytePairCodec(ranks, public_tokenizers.PATTERN)
    return _CODECS[vocabulary]


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", with_decoded: bool = False
) -> DataFrame:
    """doc_id and the ids of the whole text; with ``with_decoded`` also the bytes that ``decode`` gives for them, in the same pass."""

    def run(batches: Iterator) -> Iterator:
        c = codec(vocabulary)
        for batch in in_slices(batches, max_bytes=2 << 20):
            ids = c.encode([t or "" for t in batch.column(1).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
            if with_decoded:
                columns.append(c.decode_lists(flat, offsets))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, ids array<int>" + (", decoded binary" if with_decoded else "")
    names = ["doc_id", "ids", "decoded"][: 3 if with_decoded else 2]
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The rows with ``decoded``, the bytes of their ids (null ids: none)."""
    keep = [c for c in rows.columns if c != "decoded"]
    place = keep.index(ids_col)

    def run(batches: Iterator) -> Iterator:
        c = codec(vocabulary)
        for batch in in_slices(batches, max_bytes=2 << 20, column=place):
            ids = batch.column(place)
            last = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
            out = c.decode_lists(ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], last]))  # null lists hold no ids
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*keep, "decoded"])

    kept = rows.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", decoded binary"
    return kept.toDF(*[f"x{i}" for i in range(len(keep))]).mapInArrow(run, schema)  # a name there may hold no dot
