"""Small fixtures against brute force; nulls, empty texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id bigint, text string, lang string, x_row string, score double"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [a + b for a in ("th", "er", "on", "qu") for b in ("an", "is", "ou", "e", "")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(70)
    long = prose(300)
    out = [prose(rng.randint(1, 120)) for _ in range(20)]
    out += [long, long + " tail", long.replace("than", "THAN"), f"{prose(30)} {passage} {prose(9)}", f"{passage} {prose(40)}", passage]
    return [*out, None, "", "", "  \n ", "x y  z", out[0], out[0], "42 ! ?"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, None, 1.0) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_covers_every_id_once(docs, empty, texts):
    from cohortspark.llm.packing import pack, tokenizer

    import public_tokenizers

    rows = sorted(pack(docs, window=64).collect(), key=lambda r: (r["doc_id"], r["start"]))
    encode = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))[0]
    for i, t in enumerate(texts):
        want = [*encode([t or ""])[0].tolist(), 1]
        own = [r for r in rows if r["doc_id"] == i]
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist() == want
        assert {r["doc_tokens"] for r in own} == {len(want)}
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(empty).count() == 0


def test_cuts_are_the_cheapest():
    from cohortspark.llm.packing import OPEN_COST, plan_cuts

    rng = np.random.default_rng(0)
    for _ in range(30):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 25))])
        fee = rng.integers(0, 5, len(at)).astype(float)
        best = [0.0] + [math.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= 16:
                    best[j] = min(best[j], best[i] + (0 if n == 8 else 16 - n) + fee[j] + OPEN_COST)
        cost, i = 0.0, 0
        for j in plan_cuts(at, fee, 16, (8,)):
            n = int(at[j] - at[i])
            cost, i = cost + (0 if n == 8 else 16 - n) + fee[j] + OPEN_COST, j
        assert cost == best[-1]


def test_bpe_is_the_public_encoding(docs, texts):
    import base64

    import public_tokenizers as P
    import tiktoken

    from cohortspark.llm.bpe import codec, decode, encode

    name = "byte_bpe_multi_50k.tiktoken"
    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in decode(encode(docs)).collect():
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == known.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    rng = random.Random(1)
    signs = "ab \n\t\r\x0b\x1c\x1f\x85    　​'sß1²漢é!?"
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    assert [x.tolist() for x in codec(name).encode(odd)] == [known.encode_ordinary(t) for t in odd]


def test_exact_dedup(spark, docs, empty, texts):
    from cohortspark.llm.common import scratch
    from cohortspark.llm.exact_dedup import dedup_table, exact_dedup

    path = scratch(spark, "t")
    docs.write.parquet(path)
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(t or "", []).append(i)
    for bits, files in ((256, None), (4, 1)):  # the second: one file at a time, digests that collide
        for r in dedup_table(spark, path, bits=bits, max_files=files).collect():
            own = same[texts[r["doc_id"]] or ""]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
    kept = exact_dedup(docs.union(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(v) for v in same.values()) and kept.columns == docs.columns
    assert exact_dedup(empty).count() == 0


def test_near_duplicates(docs, empty, texts):
    from cohortspark.llm.minhash import drop_near_duplicates, least_matches, near_duplicates

    def shingles(t):
        w = (t or "").lower().encode().split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    for r in near_duplicates(docs, shingle=4).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), label[i], label[i] == i)
    assert drop_near_duplicates(empty).count() == 0
    assert least_matches(0.8, 1e-6)[32] < 32 * 0.8


def test_substrings(docs, empty, texts):
    from cohortspark.llm.substring import dedup_substrings, remove_repeats

    got = {r["doc_id"]: r for r in dedup_substrings(docs, length=12).collect()}
    seen: set = set()
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        windows = [tuple(w[s : s + 12]) for s in range(len(w) - 11)]
        gone = {k for s, x in enumerate(windows) if x in seen for k in range(s, s + 12)}
        seen.update(windows)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone))
        sha = hashlib.sha256((got[i]["kept_text"] or "").encode()).hexdigest() if gone else got[i]["sha256"]
        assert sha == hashlib.sha256(kept).hexdigest()
    assert remove_repeats(docs, length=12).columns == docs.columns
    assert remove_repeats(empty).count() == 0


def test_sharding(docs, empty, texts):
    from cohortspark.llm.sharding import shard

    rows = shard(docs, n_shards=4, min_ranges=8).collect()
    assert len(rows) == len(texts)
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
    assert shard(empty).count() == 0


def test_language(docs, empty, texts):
    from cohortspark.llm.langid import fit_centroids, identify

    rows = identify(docs, fit_centroids(docs)).collect()
    for r in rows:
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert r["lang_pred"] == ("en" if letters else "und") and 0 <= r["score"] <= 1 and (letters or r["rejected"])
    assert identify(empty, fit_centroids(empty)).count() == 0


def test_quality(spark, docs, empty, texts):
    from cohortspark.llm.quality import Trees, quality_filter, statistics

    t = "a b c d e f g h x a b c d e f g h\n \nsame #\nsame #"
    assert statistics(t)[:5] == (21, sum(map(len, t.split())), 2, 1, 16)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    rows = quality_filter(docs, labels).collect()
    assert len(rows) == len(texts) and all(not r["kept"] for r in rows if r["n_words"] < 20)
    assert quality_filter(empty, labels.limit(0)).count() == 0
    rng = np.random.default_rng(0)
    x = rng.random((500, 2))
    trees = Trees(rounds=20).fit(x, (x[:, 0] + 0.3 * rng.standard_normal(500) > 0.5).astype(float), np.array([1, 0]))
    line = np.stack([np.linspace(0, 1, 50), np.full(50, 0.4)], axis=1)
    assert (np.diff(trees.predict(line)) >= -1e-12).all()


def test_language_model(docs, empty, texts):
    from cohortspark.llm.lm import score_texts

    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    count: dict = {}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in score_texts(docs).collect():
        w = tokens[r["doc_id"]]
        base = sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in count for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base) and r["score"] < 0
    assert score_texts(empty).count() == 0


def test_page_text(spark):
    from cohortspark.llm.wrapper import extract

    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><div>Always here</div>'
        '<div class="cookie-notice">Cookies</div><article><h1>Head {0} &amp; more</h1><p>One<br>two  {0}<p><b>bold</b> end'
        '<div class="comments">Nice!</div></article><aside>Side</aside><footer>F</footer>'
    )
    plain = "<body><div>Always here</div><div>Own words {0}</div><nav><a>x</a></nav></body>"
    rows = [(i, "http://a.example/x", page.format(i)) for i in range(5)]
    rows += [(10 + i, "http://b.example/x", plain.format(i)) for i in range(6)]
    rows += [(20, None, None), (21, "http://c.example", ""), (22, "", "no markup")]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Head 3 & more\n\nOne two 3\n\nbold end"
    assert got[12] == "Own words 2"
    assert (got[20], got[21], got[22]) == ("", "", "no markup")


def test_pipeline_stages_keep_the_columns(spark, docs):
    import corpus_pipeline

    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == docs.columns, name
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_leave_only_the_tables_that_their_result_reads(spark, docs):
    """Every table of a stage stayed on disk through the stages after it."""
    import os
    import re

    import corpus_pipeline
    from cohortspark.session import checkpoint_dir

    folder = re.sub("^file:/*", "/", checkpoint_dir(spark))
    left = {"exact_dedup": {"xd-checked", "xd-rows"}, "near_dedup": {"mh-dropped"}, "substring_dedup": {"ss-cut"}}
    rows = docs.union(docs.limit(4))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = set(os.listdir(folder))
        rows = stage(spark, rows, "")
        new = {at[:-33] for at in set(os.listdir(folder)) - before}
        assert {at for at in new if "-" in at} == left.get(name, set()), name
        assert rows.count() > 0


def test_blocks_hand_kept_tables_to_the_block_around(spark):
    from cohortspark.llm.common import passing, saved

    rows = spark.range(5)
    with passing(spark):
        with passing(spark):
            gone, kept = saved(rows, "a"), saved(rows, "b", keep=True)
            assert gone.count() == 5
        assert kept.count() == 5 and saved(kept, "c").count() == 5
        with pytest.raises(Exception, match="does not exist|not found|FAILED_READ"):
            gone.count()
    with pytest.raises(Exception, match="does not exist|not found|FAILED_READ"):
        kept.count()


def test_page_slots_decide_inside_and_outside_articles(spark):
    from cohortspark.llm.wrapper import extract

    whole = "<body><main><h1>Head {0}</h1><p>Text {0}</p><div>Sign our letter</div></main></body>"
    cards = "<body><div><p>Long text {0} of the page</p><p>and more {0}</p></div><div>Always here</div><article>Card</article></body>"
    rows = [(i, "http://a.example/x", whole.format(i)) for i in range(12)] + [(20 + i, "http://b.example/x", cards.format(i)) for i in range(12)]
    rows += [(40, "http://c.example/x", "<body><div>Few</div><article>Most of the text of this page</article></body>")]
    rows += [(41, "http://d.example/x", "<body><div>Most of the text of this page</div><article>Few</article></body>")]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Head 3\n\nText 3"
    assert got[23] == "Long text 3 of the page\n\nand more 3"
    assert got[40] == "Most of the text of this page"
    assert got[41] == "Most of the text of this page\n\nFew"


def test_substrings_of_a_hot_minimizer_do_not_meet_in_one_shard(spark, docs, texts, monkeypatch):
    from cohortspark.llm import substring

    rng = random.Random(5)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line, tail = noise(15), noise(30)
    own = [f"{noise(40)} {line} {noise(40)}" for _ in range(60)] + [f"{noise(9)} {line} {tail}", f"{noise(9)} {line} {tail} x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(own + texts)], "doc_id bigint, text string").repartition(3)
    want = substring.dedup_substrings(rows, length=20).collect()
    real, hot = substring.match_windows, []
    monkeypatch.setattr(substring, "match_windows", lambda reference, length: (hot.append(reference.groupBy("key").count().count()), real(reference, length))[1])
    got = substring.dedup_substrings(rows, length=20, shard_words=300).collect()
    assert hot and hot[0] > 0
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    by = {r["doc_id"]: r["n_removed"] for r in got}
    assert by[61] == 45 and not any(by[i] for i in range(60))


def test_training_visits_every_window_once(spark, tmp_path, monkeypatch):
    from cohortspark.llm import lm

    rng, folder = np.random.default_rng(2), str(tmp_path / "seen")
    (tmp_path / "seen").mkdir()
    texts = [rng.integers(0, 300, n).astype(np.uint16).tobytes() for n in [5, 40, 70, 700, 0, 33] * 9]
    want = sorted(t.tobytes() for t in lm.windows([np.frombuffer(b, np.uint16).astype(np.int64) for b in texts])[1])

    class Noting(lm.Model):
        __module__ = "__main__"  # sent to the workers by value

        def train(self, texts, adam, every, phase, rng):
            import os
            import uuid

            picked = lm.windows(texts, every, phase)[1]
            picked.tofile(os.path.join(folder, uuid.uuid4().hex))
            return len(picked)

    monkeypatch.setattr(lm, "Model", Noting)
    spark.createDataFrame([(t,) for t in texts], "ids binary").repartition(3).write.parquet(f"{tmp_path}/ids")
    lm.fit(spark.read.parquet(f"{tmp_path}/ids"), np.zeros(300, np.int64))
    seen = [w.tobytes() for f in (tmp_path / "seen").iterdir() for w in np.fromfile(f, np.int64).reshape(-1, lm.STRIDE)]
    assert sorted(seen) == want


def test_scores_do_not_depend_on_the_list_of_frequent_words(docs, monkeypatch):
    from cohortspark.llm import lm

    want = sorted(map(tuple, lm.score_texts(docs).collect()), key=str)
    monkeypatch.setattr(lm, "FREQUENT", 4)
    got = sorted(map(tuple, lm.score_texts(docs).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_page_layouts_of_a_host_have_their_own_references(spark):
    from cohortspark.llm.wrapper import extract

    one = "<body><div><div>Always here</div><p>Own words {0}</p></div></body>"
    two = "<body><table><tr><td>Fixed cell</td><td>Cell {0}</td></tr></table></body>"
    rows = [(i, "http://a.example/x", one.format(i)) for i in range(20)] + [(20 + i, "http://a.example/x", two.format(i)) for i in range(9)]
    rows += [(40 + i, "http://a.example/x", one.format("copied")) for i in range(60)] + [(110, "http://a.example/x", "<body><p>Error</p></body>")]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(20)] == [f"Own words {i}" for i in range(20)]
    assert [got[20 + i] for i in range(9)] == [f"Cell {i}" for i in range(9)]
    assert (got[45], got[110]) == ("Own words copied", "Error")


def test_substrings_of_repeated_ids_are_cut_each_on_its_own(spark):
    from cohortspark.llm.substring import dedup_substrings, remove_repeats

    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b = words(30), words(30)
    rows = [
        (1, " ".join(a)), (1, " ".join(words(40) + b)), (1, " ".join(words(5) + b + words(5))), (2, " ".join(words(7) + a)),
        (2, " ".join(b + words(80))), (2, " ".join(words(60))), (3, " ".join(words(3) + a + words(3) + b)), (3, " ".join(a)), (3, "  ".join(a)), (None, " ".join(a)),
    ]
    docs = spark.createDataFrame([(i, t, k, "m", k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, x_kept int, x_found string, `at.x` int").repartition(3)
    want = []
    for i, t in rows:
        w = t.split()
        windows = lambda v: {tuple(v[s : s + 12]) for s in range(len(v) - 11)}
        less = set().union(*(windows(u.split()) for j, u in rows if i is not None and j is not None and j < i), set())
        gone = {k for s in range(len(w) - 11) if tuple(w[s : s + 12]) in less for k in range(s, s + 12)}
        want.append((i, len(w), len(gone), t if not gone else " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = dedup_substrings(docs, length=12).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted((x[:3] for x in want), key=str)
    kept = remove_repeats(docs, length=12)
    assert kept.columns == docs.columns
    assert {r["x_kept"]: (r["doc_id"], r["text"]) for r in kept.collect()} == {k: (x[0], x[3]) for k, x in enumerate(want)}


def test_languages_and_names_with_dots(spark):
    from cohortspark.llm.langid import fit_centroids, identify

    rng = random.Random(4)
    sounds = {"aa": "kanu sipo tela", "bb": "strv gdzx czbr", "cc": "oeiu auie iaoe", "dd": "wyth hwll gwyn"}
    word = lambda l: "".join(rng.choice(sounds[l].replace(" ", "")) for _ in range(5))
    rows = [(k, " ".join(word(l) for _ in range(40)), l if k % 4 else None, k) for k in range(400) for l in [list(sounds)[k // 4 % 4]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `a.b` int").repartition(3)
    got = identify(docs, fit_centroids(docs)).collect()
    assert len(got) == 400 and all(r["lang_pred"] == list(sounds)[r["doc_id"] // 4 % 4] and not r["rejected"] for r in got)
