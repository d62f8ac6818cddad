"""Packing token streams into fixed windows by order-preserving dynamic programming.

Documents keep their input order inside an input split; each ends with ``end_id``.  Cuts lie at
document ends (free), sentence ends (small penalty) or, in stretches without either, on a coarse
token grid (larger penalty).  ``best[j]``, the least cost of the tokens before cut j, is

    min over i with P[j] - P[i] <= L of  best[i] + padding(P[j] - P[i])  +  penalty[j] + open_cost

with padding(n) = L - n, or 0 where n is a power of two.  As ``best[i] + P[i]`` does not depend on
j, a monotone queue over the last L tokens gives the minimum in constant time; the few windows
of exactly a power of two are looked up beside it.  Splits are packed on their own, without a
shuffle; a split streams through memory in chunks, the last window of a chunk opens the next.

Defined cases: null or empty text is the single token ``end_id``; repeated rows are packed each;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import ChunkMemo, in_slices

WINDOW, END_ID = 2048, 1
#: Penalties in tokens of padding; spacing of the grid; tokens planned at once.
SENTENCE_COST, GRID_COST, OPEN_COST, GRID, CHUNK = 6, 48, 2, 128, 400_000
EXACT = (1024, 512, 256)
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def plan_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, exact: tuple = EXACT) -> list[int]:
    """Indices into ``at`` (ascending cut positions, first 0) of the cheapest cuts, last one included."""
    n = len(at)
    pos, fee = at.tolist(), penalty.tolist()
    hits: dict[int, list[int]] = {}
    for size in exact:
        if size < window:
            i = np.searchsorted(at, at - size)
            for j in np.flatnonzero((at >= size) & (at[np.minimum(i, n - 1)] == at - size)).tolist():
                hits.setdefault(j, []).append(int(i[j]))
    best, back = [0.0] * n, [0] * n
    queue, key, head = [0], [0.0] * n, 0
    for j in range(1, n):
        p = pos[j]
        while p - pos[queue[head]] > window:
            head += 1
        i = queue[head]
        cost = key[i] + window - p
        for k in hits.get(j, ()):
            if best[k] < cost:
                cost, i = best[k], k
        best[j] = cost = cost + fee[j] + OPEN_COST
        back[j] = i
        key[j] = cost = cost + p
        while len(queue) > head and key[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, window: int = WINDOW):
    """Cut positions (0 first) and their penalties; no two lie further apart than the grid."""
    total = len(ids)
    cost = np.full(total + 1, np.inf)
    marks = np.flatnonzero(sentence_end[ids]) + 1
    cost[marks] = SENTENCE_COST
    cost[doc_ends] = 0
    cost[[0, total]] = 0
    known = np.flatnonzero(np.isfinite(cost))
    grid = min(GRID, window)
    for i in np.flatnonzero(np.diff(known) > grid).tolist():
        cost[known[i] + grid : known[i + 1] : grid] = GRID_COST
    at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def sentence_ends(vocabulary: dict[str, int]) -> np.ndarray:
    """Which ids close a sentence: their text ends with a full stop or holds a line break."""
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        out[i] = token.endswith((".", "!", "?")) or "Ċ" in token
    return out


class _Packer:
    """Packs one split; keeps the tokens and rows of the window that is still open."""

    def __init__(self, sentence_end, window: int, first_sequence: int):
        self.sentence_end, self.window, self.next = sentence_end, window, first_sequence
        self.held, self.size = [], 0  # (doc id, ids left, tokens before them, tokens of the document)

    def add(self, doc_id, ids: np.ndarray, out: list) -> None:
        self.held.append((doc_id, ids, 0, len(ids)))
        self.size += len(ids)
        if self.size >= CHUNK:
            self.flush(out, last=False)

    def flush(self, out: list, last: bool) -> None:
        if not self.size:
            return
        ids = np.concatenate([h[1] for h in self.held])
        ends = np.cumsum([len(h[1]) for h in self.held])
        at, fee = candidates(ids, ends, self.sentence_end, self.window)
        cuts = at[plan_cuts(at, fee, self.window)]
        if not last and len(cuts) > 1:
            cuts = cuts[:-1]
        # Pieces end where a window or a document ends.
        done = int(cuts[-1])
        edges = np.unique(np.concatenate([cuts, ends[ends < done]]))
        begins = np.concatenate([[0], edges[:-1]])
        row = np.searchsorted(ends, begins, "right")
        seq = np.searchsorted(cuts, begins, "right")
        opened = np.concatenate([[0], cuts])[seq]
        row_at = ends - [len(h[1]) for h in self.held]
        raw = ids.astype("<u4")
        for b, e, r, s, o, ra in zip(begins.tolist(), edges.tolist(), row.tolist(), seq.tolist(), opened.tolist(), row_at[row].tolist()):
            doc_id, _, before, tokens = self.held[r]
            out.append((doc_id, before + b - ra, e - b, raw[b:e].tobytes(), tokens, self.next + s, b - o))
        self.next += len(cuts)
        first = int(np.searchsorted(ends, done, "right"))
        rest = []
        for k, (doc_id, own, before, tokens) in enumerate(self.held[first:], first):
            skip = max(0, done - int(row_at[k]))
            rest.append((doc_id, own[skip:].copy(), before + skip, tokens))
        self.held, self.size = rest, sum(len(h[1]) for h in rest)


#: Chunks without white space or controls, in scripts whose letters all Unicode tables since 7.0 agree on.
USUAL = re.compile("[!-~\u00a1-\u052f]+")


def ranked(t):
    """The tokenizer's own vocabulary as a rank encoder, for ``USUAL`` chunks; None if it has another form.

    Merging by the rank of the merged bytes gives the ids of merging by the pair's rank where ids
    ascend with the merges and every token is what its own bytes merge to (checked by the tests):
    then no other pair of tokens with the same bytes ever stands side by side.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    form = json.loads(t.to_str())
    model, cut = form["model"], form["pre_tokenizer"] or {}
    usual = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut["use_regex"] and not form["normalizer"]
    merged = ["".join(m) for m in model["merges"]] if usual else []
    vocabulary = model["vocab"]
    if not usual or [vocabulary[m] for m in merged] != list(range(256, 256 + len(merged))):
        return None
    # Letters of the byte alphabet: printable bytes stand for themselves, the others follow from 256 on, ascending.
    letters = sorted(ByteLevel.alphabet())
    own = [c for c in letters if ord(c) < 256]
    byte = {c: ord(c) for c in own}
    byte.update(zip((c for c in letters if ord(c) >= 256), sorted(set(range(256)) - set(byte.values()))))
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merged)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """(encode of many texts through a chunk memo, sentence ends); kept for the life of a worker."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        encode = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        vocabulary = t.get_vocab()
        opens = np.zeros(max(vocabulary.values()) + 1, bool)
        opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

        plain, usual = ranked(t), USUAL.fullmatch

        def encode_chunks(words: list[str]) -> list[bytes]:
            # As one text: a chunk's first token, and no other, starts with a space.
            if plain is None:
                return cut_chunks(words, np.asarray(encode([" " + " ".join(words)])[0], np.uint16))
            easy = list(filter(usual, words))
            out = dict(zip(easy, cut_chunks(easy, plain.encode_to_numpy(" " + " ".join(easy)).astype(np.uint16)))) if easy else {}
            if len(easy) < len(words):
                hard = [w for w in words if w not in out]
                out.update(zip(hard, cut_chunks(hard, np.asarray(encode([" " + " ".join(hard)])[0], np.uint16))))
            return [out[w] for w in words]

        def cut_chunks(words: list[str], ids: np.ndarray) -> list[bytes]:
            edges = [*(2 * np.flatnonzero(opens[ids])).tolist(), 2 * len(ids)]
            if len(edges) - 1 != len(words):
                raise ValueError("the vocabulary's tokens do not end before a space")
            raw = ids.tobytes()
            return [raw[a:b] for a, b in zip(edges, edges[1:])]

        _TOKENIZERS[path] = ChunkMemo(encode, encode_chunks=encode_chunks), sentence_ends(vocabulary)
    return _TOKENIZERS[path]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json",
    window: int = WINDOW, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of documents in sequences: ids (little-endian uint32) and their place in both."""

    def run(batches: Iterator) -> Iterator:
        import public_tokenizers

        encode, ends = tokenizer(public_tokenizers.path(vocabulary))
        packer = _Packer(ends, window, TaskContext.get().partitionId() << 40)
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

        def record(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        out: list = []
        for batch in in_slices(batches, max_bytes=1 << 20):  # the words of a slice are all held
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(keys, encode(texts)):
                packer.add(doc_id, np.append(ids, np.uint16(end_id)), out)
                if len(out) > 5000:
                    yield record(out)
                    out = []
        packer.flush(out, last=True)
        if out:
            yield record(out)

    names = [p.split()[0] for p in PIECES.split(", ")]
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)
