"""Merkle manifest, filter audit and suffix-array deduplication against plain Python."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, x_row string, kept double, `a.b` int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [a + b for a in ("th", "Er", "on", "qu") for b in ("an", "is", "ou", "e")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(40), prose(9) + "\n"
    texts = [prose(rng.randint(1, 250)) + "\n" * (i % 3) for i in range(30)]
    texts += [f"{prose(20)} {passage} {prose(20)}", f"{passage} é {prose(5)}", line * 8, "a" * 900, "ab" * 300, prose(3000), "UPPER CASE #", passage]
    texts += [None, "", "", " \n ", texts[0], texts[0], texts[1], texts[5][:99], texts[5][:100], texts[5] + "x"]
    return [(i, t, "en" if i % 3 else None, [None, "", "b", "a", "é"][i % 5] if i % 2 else "big", i if i % 4 else None, "", 1.0, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 40, 2)] + [(2, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def fold(levels, pos, h):
    proof = []
    for level in levels[:-1]:
        run = level[pos // 3 * 3 : pos // 3 * 3 + 3]
        proof += run[: pos % 3] + run[pos % 3 + 1 :]
        run[pos % 3] = h
        h, pos = H(run), pos // 3
    return h, proof


def expected_manifest(rows):
    by = {}
    for d, t, lang, source, n, *_ in rows:
        leaf = lambda x: H([enc(v) for v in (d, source, lang, n, x)])
        hit = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        by.setdefault(source, []).append((d is not None, d, leaf(t), leaf(t.replace("\n", "") if hit and t else t)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    last = tree([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for pos, (_, d, leaf, new) in enumerate(sorted(by[s])):
            h, proof = fold(trees[s], pos, new)
            h, more = fold(last, names.index(s), h)
            out.append((d, leaf, trees[s][-1][0], last[-1][0], H(proof + more), h, h == last[-1][0]))
    return sorted(out, key=str)


def test_manifest(spark, docs, rows):
    from cohortspark.llm import merkle

    assert sorted(map(tuple, merkle.tamper_audit(docs).collect()), key=str) == expected_manifest(rows)
    # several rounds of small blocks, repeated rows, null and repeated ids, another text under a known id
    odd = rows + rows[:7] + [(None, *rows[3][1:]), (None, *rows[4][1:]), (3, "other\n", *rows[3][2:])]
    got = sorted(map(tuple, merkle.tamper_audit(spark.createDataFrame(odd, SCHEMA), levels=1).collect()), key=str)
    assert [g[:4] for g in got] == [e[:4] for e in expected_manifest(odd)] and {g[6] for g in got} == {True, False}
    one = merkle.tamper_audit(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert [tuple(r) for r in one] == expected_manifest(rows[:1]) and one[0]["proof_sha256"] == H([])
    assert merkle.tamper_audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hash_states_resume():
    from cohortspark.llm import sha

    raw = np.random.default_rng(0).integers(0, 256, (50, 32)).astype(np.uint8)
    state = sha.start(50)
    for k in range(4):
        assert [d.tobytes().hex() for d in sha.finish(state, np.full(50, k))] == [H([d.tobytes().hex()] * k) for d in raw]
        state = sha.as_state(sha.as_bytes(state))
        sha.absorb_where(state, raw, np.ones(50, bool))


def test_filter_audit(spark, docs, rows, labels):
    from cohortspark.llm.audit import audit_filters

    def expected(rows):
        texts = {}
        for r in rows:
            if r[0] is not None:
                texts[r[1] or ""] = min(r[0], texts.get(r[1] or "", r[0]))
        found = []
        for d, t, _, source, *_ in rows:
            t = t or ""
            w = t.encode().split()
            fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                     "D": any(c in "#$%&*|" for c in t), "E": d is not None and texts[t] < d}
            known = [(q, x) for i, q, x in marks if i == d and d is not None]
            found.append((source or "", "".join(k for k in "ABCDE" if fails[k]), any(q for q, _ in known), any(x for _, x in known)))
        out, took = {}, {}
        for part in {f[0] for f in found}:
            own = [f for f in found if f[0] == part]
            for o in map("".join, permutations("ABCDE")):
                left = own
                for i, k in enumerate(o):
                    gone = [f for f in left if k in f[1]]
                    failing = sum(k in f[1] for f in own)
                    left = [f for f in left if k not in f[1]]
                    out[part, o, i + 1] = [len(left), len(gone), failing - len(gone), sum(f[1] == k for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                    took[part, k] = took.get((part, k), 0) + len(gone)
        return {key: (*v, took[key[0], key[1][key[2] - 1]]) for key, v in out.items()}

    marks = [tuple(r) for r in labels.collect()]
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    for given in (rows, rows + rows[:9] + [(None, *rows[0][1:]), (None, None, *rows[1][2:]), (4, "other text", *rows[4][2:])]):
        got = audit_filters(spark.createDataFrame(given, SCHEMA), labels)
        assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in got.collect()} == expected(given)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | {c: "bigint" for c in columns}
    assert audit_filters(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert audit_filters(docs, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[:] == (0, 0)


def test_suffix_array_is_sorted():
    from cohortspark.llm.suffixes import common_prefixes, suffix_array

    rng = random.Random(2)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        array, data, end_of = suffix_array(texts)
        raw = data.tobytes()
        key = lambda p: (raw[p : end_of[p]], p)  # noqa: E731  equal suffixes stand in the order of their texts
        body = [p for p in array.tolist() if p != end_of[p]]
        assert sorted(body) == [p for p in range(len(raw)) if p != end_of[p]] and [key(p) for p in body] == sorted(key(p) for p in body)
        order = np.array([p for p in body if p + 3 <= end_of[p]])
        for a, b, n in zip(order, order[1:], common_prefixes(order, data, 3)[1:] if len(order) else ()):
            assert n == next((k for k in range(3) if raw[a + k] != raw[b + k]), 3)


def expected_cut(rows, length):
    seen, out = {}, {}
    for d, t in sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}, key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest())):
        b = t.encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = [True] * length
            seen[b[p : p + length]] = 1
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, t] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length, shard", [(100, 1 << 18), (100, 500), (37, 2000)])
def test_suffix_dedup(spark, rows, length, shard):
    from cohortspark.llm import suffixes

    given = rows + rows[:5] + [(7, rows[0][1] + "?", *rows[7][2:]), (None, rows[0][1], *rows[0][2:])]
    got = suffixes.dedup_bytes(spark.createDataFrame(given, SCHEMA).repartition(3), length=length, shard_bytes=shard).collect()
    want = expected_cut(given, length)
    assert len(got) == len(given)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(tuple(r)[1:5])
    for d in {k[0] for k in want}:
        assert by[d] == {v for k, v in want.items() if k[0] == d}, d
    raw = rows[0][1].encode()
    assert by[None] == {(len(raw), 0, 0, hashlib.sha256(raw).hexdigest())}
    assert all(r["kept"] is None or hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert suffixes.dedup_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sort_shard_keeps_the_first():
    from cohortspark.llm.suffixes import sort_shard

    rows = pa.table({"x_raw": [b"xxabcdyy", b"abcd", b"zabcdz"], "x_slice": [1, 2, 3], "x_id": [9, 5, 9], "x_tie": [0, 0, 0], "x_start": [0, 7, 20]})
    got = sort_shard(rows, 4).to_pylist()
    assert sorted((r["x_id"], r["x_start"], r["x_windows"]) for r in got) == [(9, 2, 1), (9, 21, 1)]


def test_pieces_share_no_window(monkeypatch):
    from cohortspark.llm import suffixes

    monkeypatch.setattr(suffixes, "PIECE_BYTES", 70)
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(97, 100, n).astype(np.uint8).tobytes()) for i, n in enumerate([5, 39, 40, 41, 300, 700, 109, 110])]
    lots = [suffixes.Stretches(lot, 40) for lot in suffixes.pieces(docs, 40)]
    windows = sorted((d, s + k) for x in lots for d, s, n in zip(x.doc.tolist(), x.start.tolist(), x.windows.tolist()) for k in range(n))
    assert windows == [(i, s) for i, raw in docs for s in range(len(raw) - 39)]
    for x in lots:
        for d, s, n, a in zip(x.doc.tolist(), x.start.tolist(), x.windows.tolist(), x.at.tolist()):
            assert x.raw[a : a + n + 39] == docs[d][1][s : s + n + 39]


def test_rank_encoder_equals_the_tokenizer():
    """The condition of ``packing.ranked``: every token is what its own bytes merge to, and the ids of words agree."""
    import json
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from cohortspark.llm.packing import ranked, tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    plain = ranked(t)
    by_id = {i: token for token, i in json.loads(t.to_str())["model"]["vocab"].items()}
    for i in range(256, 50_256):
        assert [x.id for x in t.model.tokenize(by_id[i])] == [i]
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdluETA,.'-0123<|>\"éüßøłžαβγдёж²¼ª\u00ad\u0300") for _ in range(rng.randint(1, 30))) for _ in range(20_000)]
    text = " " + " ".join(words)
    assert plain.encode_to_numpy(text).tolist() == t.encode(text, add_special_tokens=False).ids
    encode, _ = tokenizer(path)
    texts = ["", " a", "café naïve\nline 中文 x\x1cy", "two  spaces", "a\tb <|endoftext|> c ", *words[:50]]
    assert [a.tolist() for a in encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_likely_keeps_every_wanted_row(spark):
    from cohortspark.llm.minhash import likely

    ids = spark.range(-500, 2000).withColumnRenamed("id", "doc_id").filter("doc_id % 3 = 0")
    rows = spark.range(-1000, 50_000).selectExpr("id AS own", "cast(id AS string) AS text")
    got = {r.own for r in likely(rows, "own", ids).collect()}
    want = {r.doc_id for r in ids.collect()}
    assert want <= got and len(got - want) < 50
    assert likely(rows, "own", ids.filter("false")).count() == 0
