"""A Merkle manifest of a table: a tree of SHA-256 per group, their roots under one more tree.

Nodes are hashes of up to ``ARITY`` consecutive children, written as hex.  A parent is a SHA-256
midstate tree: it retains a copy of its hash state before each child slot (``sha.absorb``; a hex
digest fills a block, so a state is 32 bytes).  A changed leaf is folded up by resuming the state
before its slot with the replacement and the right siblings only; left siblings are never hashed
again.  The retained states travel as bytes in the written path tables, so any executor resumes them.

Leaves get their places by range partitions and prefix sums (``operators.ranks``), never by a task
that sees a whole group.  ``levels`` levels are built at a time from blocks of ``ARITY ** levels``
neighbours: a group with a third of all rows is so many blocks, and rounds number
log(rows) / log(729).  In the first round leaves are folded where their block is built; later
rounds join the thin rows (digest, proof state) with the path of the node they lie in.

Defined cases: null columns hash as "-"; a null group is a tree of its own before all others; null
ids come first; rows that repeat an id are ordered by their leaf; equal rows are equal leaves in
any order; a single leaf is its own root and, alone in the table, has the empty proof; an empty
table gives no rows.  Texts of any length are hashed by Spark.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import sha
from cohortspark.llm.common import crc_bucket, saved
from cohortspark.operators.ranks import with_positions

ARITY, LEVELS = 3, 6
#: One level of a path: children, own slot, the parent's state before the slot, the other children in order.
RECORD = 2 + 32 + 32 * (ARITY - 1)


def encoded(value: Column) -> Column:
    """``-`` if null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def depth(total: int) -> int:
    """Levels above ``total`` nodes."""
    levels = 0
    while total > 1:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def build(digests: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(the nodes ``levels`` above neighbouring nodes (n, 32), the path of each node (n, levels, RECORD))."""
    n = len(digests)
    path, at = np.zeros((n, levels, RECORD), np.uint8), np.arange(n)
    for level in range(levels):
        m = len(digests)
        place = np.arange(m)
        counts = np.full(-(-m // ARITY), ARITY)
        counts[-1] = m - ARITY * (len(counts) - 1)
        state, record = sha.start(len(counts)), np.zeros((m, RECORD), np.uint8)
        record[:, 0], record[:, 1] = counts[place // ARITY], place % ARITY
        for slot in range(ARITY):
            own = np.arange(slot, m, ARITY)
            record[own, 2:34] = sha.as_bytes(state[: len(own)])
            state[: len(own)] = sha.absorb(state[: len(own)], sha.hex_block(digests[own]))
            for j, other in enumerate(s for s in range(ARITY) if s != slot):
                there = own - slot + other < m
                record[own[there], 34 + 32 * j : 66 + 32 * j] = digests[own[there] - slot + other]
        path[:, level] = record[at]
        digests, at = sha.finish(state, counts), at // ARITY
    return digests, path


def resume(path: np.ndarray, digest: np.ndarray, proof: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folds a digest (n, 32) up each path; the siblings' hex goes to the proof's state as well."""
    for level in range(path.shape[1]):
        step = path[:, level]
        count, slot = step[:, 0].astype(np.int64), step[:, 1].astype(np.int64)
        state = sha.as_state(step[:, 2:34])
        state = sha.absorb(state, sha.hex_block(digest))
        for j in range(ARITY - 1):
            sibling = step[:, 34 + 32 * j : 66 + 32 * j]
            left = j < slot
            there = left | (j + 1 < count)
            sha.absorb_where(state, sibling, there & ~left)
            sha.absorb_where(proof, sibling, there)
            blocks = blocks + there
        digest = sha.finish(state, count)
    return digest, proof, blocks


def _fixed(column: pa.Array, width: int = 32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width).copy()


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _sorted(group: pa.Table, levels: int) -> tuple[pa.Table, int]:
    group = group.sort_by("x_node").combine_chunks()
    return group, min(levels, depth(group.column("x_total")[0].as_py()))


def _first_round(group: pa.Table, levels: int) -> pa.Table:
    """A block of leaves: what stands above it, and every replacement folded up to there."""
    group, levels = _sorted(group, levels)
    n = group.num_rows
    tops, path = build(_fixed(group.column("x_top")), levels)
    fold, proof, blocks = resume(path, _fixed(group.column("x_fold")), sha.start(n), np.zeros(n, np.int64))
    new = {"x_top": _binary(tops[np.zeros(n, int)] if levels else tops), "x_fold": _binary(fold), "x_proof": _binary(sha.as_bytes(proof)), "x_blocks": pa.array(blocks)}
    for name, column in new.items():
        at = group.schema.get_field_index(name)
        group = group.append_column(name, column) if at < 0 else group.set_column(at, name, column)
    return group


def _paths(group: pa.Table, levels: int) -> pa.Table:
    group, levels = _sorted(group, levels)
    tops, path = build(_fixed(group.column("x_top")), levels)
    up = pa.array([tops[0].tobytes()] * group.num_rows, pa.binary())
    return pa.table([*(group.column(c) for c in ("x_tree", "x_node", "x_total")), _binary(path), up], names=["x_tree", "x_node", "x_total", "x_path", "x_up"])


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        lengths = np.array([len(p or b"") // RECORD for p in rows.column("x_path").to_pylist()], np.int64)
        for levels in np.unique(lengths).tolist():
            own = rows.filter(pa.array(lengths == levels))
            if levels:
                path = _fixed(own.column("x_path"), levels * RECORD).reshape(-1, levels, RECORD)
                blocks = own.column("x_blocks").to_numpy()
                fold, proof, blocks = resume(path, _fixed(own.column("x_fold")), sha.as_state(_fixed(own.column("x_proof"))), blocks)
                for name, column in (("x_fold", _binary(fold)), ("x_proof", _binary(sha.as_bytes(proof))), ("x_blocks", pa.array(blocks))):
                    own = own.set_column(own.schema.get_field_index(name), name, column)
                own = own.set_column(own.schema.get_field_index("x_top"), "x_top", own.column("x_up"))
            yield from own.drop_columns(["x_path", "x_up"]).to_batches()


def _above(n: str, block: int) -> Column:
    return F.expr(f"({n} + {block - 1}) div {block}")


def to_root(docs: DataFrame, nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Folds ``docs`` (x_tree, x_node, x_top, x_fold, x_proof, x_blocks, ...) to the root of their
    tree; ``nodes``: x_tree, x_node, x_total (nodes of the tree), x_top."""
    block = ARITY**levels
    while (nodes.agg(F.max("x_total")).first()[0] or 0) > 1:
        paths = nodes.filter("x_total > 1").withColumn("x_block", F.expr(f"x_node div {block}"))
        paths = paths.groupBy("x_tree", "x_block").applyInArrow(lambda g: _paths(g, levels), "x_tree string, x_node bigint, x_total bigint, x_path binary, x_up binary")
        paths = saved(paths, "mk-paths")
        met = docs.join(paths.drop("x_total"), ["x_tree", "x_node"], "left").select(*docs.columns, "x_path", "x_up")
        docs = met.mapInArrow(_fold_batches, docs.schema).withColumn("x_node", F.expr(f"x_node div {block}"))
        docs = saved(docs, "mk-docs")
        nodes = paths.filter(f"x_node % {block} = 0").select("x_tree", F.expr(f"x_node div {block}").alias("x_node"), _above("x_total", block).alias("x_total"), F.col("x_up").alias("x_top"))
    return docs


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Trees over ``rows`` (doc_id, x_group string, x_leaf and x_new: hex digests of the row and of its replacement).

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root (all hex) and verified: per row,
    does its replacement lead to the root?
    """
    block = ARITY**levels
    tree = F.coalesce(F.concat(F.lit("="), "x_group"), F.lit(""))  # null first, then by UTF-8 bytes
    rows = rows.select(tree.alias("x_tree"), F.col("doc_id"), F.unhex("x_leaf").alias("x_leaf"), F.unhex("x_new").alias("x_fold"))
    rows = with_positions(rows, ["x_tree"], ["doc_id", "x_leaf"], "x_node", "x_total")
    rows = rows.select("x_tree", "doc_id", "x_node", "x_total", "x_leaf", F.col("x_node").alias("x_place"), F.col("x_leaf").alias("x_top"), "x_fold")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", x_proof binary, x_blocks bigint"
    docs = rows.groupBy("x_tree", F.expr(f"x_node div {block}").alias("x_block")).applyInArrow(lambda g: _first_round(g, levels), schema)
    docs = docs.withColumn("x_node", F.expr(f"x_node div {block}")).withColumn("x_total", _above("x_total", block))
    docs = saved(docs, "mk-docs")
    heads = docs.filter(f"x_place % {block} = 0").select("x_tree", "x_node", "x_total", "x_top")
    docs = to_root(docs.drop("x_total"), heads, levels)
    # The subroots are the leaves of the last tree.
    tops = docs.filter("x_place = 0").select("x_tree", "x_top")
    tops = saved(with_positions(tops, [], ["x_tree"], "x_node", "x_total"), "mk-tops")
    last = F.lit("").alias("x_tree")
    docs = docs.drop("x_node").join(tops.select("x_tree", "x_node", F.col("x_top").alias("x_subroot")), "x_tree").withColumn("x_tree", F.lit(""))
    docs = to_root(docs, tops.select(last, "x_node", "x_total", "x_top"), levels)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                digest = sha.finish(sha.as_state(_fixed(batch.column("x_proof"))), batch.column("x_blocks").to_numpy())
                at = batch.schema.get_field_index("x_proof")
                yield batch.set_column(at, "x_proof", _binary(digest))

    docs = docs.mapInArrow(done, docs.schema)
    text = lambda c: F.lower(F.hex(c))
    return docs.select(
        "doc_id", text("x_leaf").alias("leaf"), text("x_subroot").alias("subroot"), text("x_top").alias("root"),
        text("x_proof").alias("proof_sha256"), text("x_fold").alias("folded_root"), (F.col("x_fold") == F.col("x_top")).alias("verified"),
    )


def tamper_audit(docs: DataFrame, columns: tuple = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs``, each row folded anew from a copy whose text lost its line breaks where 2 divides crc32(id)."""
    own = lambda c: docs[f"`{c}`"]
    hit = F.coalesce(crc_bucket(own("doc_id"), 2) == 0, F.lit(False))
    changed = [F.when(hit, F.replace(own(c), F.lit("\n"), F.lit(""))).otherwise(own(c)) if c == "text" else own(c) for c in columns]
    return manifest(docs.select(
        own("doc_id"), own(group_col).cast("string").alias("x_group"), leaf_hash([own(c) for c in columns]).alias("x_leaf"), leaf_hash(changed).alias("x_new")
    ), levels)
