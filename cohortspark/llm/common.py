"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import checkpoint_dir

#: The words of every contract: maximal runs without ASCII white space.  ``bytes.split()``
#: cuts at exactly these six characters (space, \t \n \v \f \r), so words are split on UTF-8 bytes.
ASCII_UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The folders that each open ``passing`` block deletes at its end, the innermost block last.
_PASSING: ContextVar[tuple] = ContextVar("passing", default=())


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors.

    Inside a ``passing`` block the table goes when the block ends, or with ``keep`` when the block around it does.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    for folders in _PASSING.get()[: -1 if keep else None][-1:]:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *folders: str) -> None:
    """Delete folders of the shared folder whose last reader has been saved."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``saved`` writes inside is deleted at the end: nothing that leaves the block may read it, but for tables to keep."""
    folders: list[str] = []
    before = _PASSING.set((*_PASSING.get(), folders))
    try:
        yield
    finally:
        _PASSING.reset(before)
        forget(spark, *folders)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null ids: null)."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    return (raw.translate(ASCII_UPPER_TO_LOWER) if lower else raw).split()


def in_slices(batches: Iterable, max_bytes: int = 8 << 20, column: int = 1) -> Iterator:
    """Cut Arrow record batches so that a slice holds about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        n, size = batch.num_rows, batch.column(column).nbytes
        step = max(1, n if size <= max_bytes else int(n * max_bytes / size))
        for at in range(0, n, step):
            yield batch.slice(at, step)


class WordHashes(dict):
    """Remembers the 64-bit hash of each word; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        self.hash, self.limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        self[word] = h = self.hash(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x + MIX).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes: sums with odd powers, so runs combine by doubling."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, have, part, size = None, 0, h.astype(np.uint64), 1
    n = len(h) - k + 1
    bits = k
    while bits:
        if bits & 1:
            piece = part[have : have + n]
            out = piece.copy() if out is None else mix64(out * MIX + piece)
            have += size
        bits >>= 1
        if bits:
            part = mix64(part[:-size] * MIX + part[size:])
            size *= 2
    return mix64(out)


class ChunkMemo:
    """Token ids of a text from the remembered ids of its space-separated chunks.

    The pre-token pattern of the byte-level vocabularies never matches across the start of
    " x" (one space before a non-space), so a text cut there tokenises chunk by chunk.  Texts
    with other white space after a space go whole through ``encode``.  ``encode`` maps a list
    of texts to a list of ids, ``encode_chunks`` (if given) the same for chunks, each to be read
    after a space, as bytes; ``limit`` bounds the remembered chunks (memory only: a full memo is
    emptied and filled again, results stay the same).
    """

    def __init__(self, encode: Callable[[list[str]], list], code: str = "H", limit: int = 300_000, encode_chunks=None):
        import re

        self.encode, self.code, self.limit = encode, code, limit
        self.encode_chunks = encode_chunks or (lambda new: self._bytes([" " + w for w in new]))
        self.dtype = np.dtype(code)
        self.first, self.later = {}, {}
        self.odd = re.compile(r" (?=\s|$)").search

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, ids).tobytes() for ids in self.encode(texts)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.later) + len(self.first) > self.limit:
            self.first.clear()
            self.later.clear()
        cut = [None if self.odd(t) else t.split(" ") for t in texts]
        heads = [c.pop(0) if c is not None else None for c in cut]
        first, later = self.first, self.later
        new: set = set()
        for c in cut:
            if c:
                new.update(c)
        new = list(new.difference(later))
        if new:
            later.update(zip(new, self.encode_chunks(new)))
        own = list({h for h in heads if h is not None and h not in first})
        first.update(zip(own, self._bytes(own)))
        whole = iter(self.encode([t for t, c in zip(texts, cut) if c is None]))
        return [
            np.asarray(next(whole), self.dtype)
            if c is None
            else np.frombuffer(first[h] + b"".join(map(later.__getitem__, c)), self.dtype)
            for h, c in zip(heads, cut)
        ]
