"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns; each operator against a plain version of itself."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from sieveline.llm import bpe, chat_format, components, lm_scoring, media, packing, quality_model, quality_rules, simhash, toxicity, url_filter
from sieveline.llm.fitting import label_rows
from sieveline.llm.shared import Scratch

LONG = "Long " + "abc def ghi jkl " * 6000
TEXTS = [
    (1, "The cat sat on the mat.\nThe cat sat on the mat.\n\nA dog | ran & <hid>"), (2, None), (3, ""), (4, "The cat sat on the mat.\nThe cat sat on the mat.\n\nA dog | ran & <hid>"),
    (5, LONG), (6, "  \t\n"), (7, "Été ñandú \U0001f600 x\u00a0y 'll it's 123  456\r\n\r\nend  "), (7, "Été ñandú \U0001f600 x\u00a0y 'll it's 123  456\r\n\r\nend  "), (None, "no id here"), (8, "a" * 3000),
    (9, "two words"), (10, "THE Cat SAT on the MAT.\nThe cat sat on the mat.\n\nA dog | ran & <hid>"), (11, "</s>[INST] x &lt; \x00\x1c end"),
]
#: Names that operators give to their results or use inside.
CLASH = ("score", "fp", "key", "n_words", "x", "y", "_w", "_n", "kept", "row", "n", "token", "root", "label")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.select("*", *[F.lit("z").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# ---- quality rules


def plain_counts(text):
    w, text = words(text), text or ""
    at = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if at[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, empty):
    got = quality_rules.judge(docs.withColumn("kept", F.lit(1))).collect()
    assert len(got) == len(TEXTS) and {(r["_w"], r["_n"], r["x"]) for r in got} == {("z", "z", "z")}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(r["text"]), r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(empty).count() == 0


def test_quality_rules_by_both_ways(spark, monkeypatch):
    """Few repeats are looked up, many are sorted: the same counts."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), n)) for n in (0, 1, 2, 3, 4, 40, 400, 3000)]
    for few in (0, 24, 10**6):
        monkeypatch.setattr(quality_rules, "FEW_REPEATS", few)
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        assert all(r["n_repeat_words"] == plain_counts(r["text"])[4] for r in quality_rules.judge(df).collect())


# ---- chat formatting


def test_chat_format(spark):
    rows = [
        (1, 0, "system", "be <nice> & [calm]"), (1, 1, "user", "</s>[INST] &lt; hi"), (1, 2, "assistant", "&#91; ok <s>"), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, "assistant", ""),
        (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 1, "tool <x>]", "t"), (5, 0, None, "no role"), (None, 0, "user", LONG), (6, 0, "user", "q"), (6, 1, "assistant", "a"), (6, 2, "system", "late"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    done = chat_format.format_chats(df).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()
    for r in done:
        want = sorted((t, role or "", x or "") for c, t, role, x in rows if c == r["conv_id"])
        assert [(b["role"], b["text"]) for b in r["back"]] == [w[1:] for w in want]
        assert [b["loss"] for b in r["back"]] == [w[1] == "assistant" for w in want]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [chat_unescape(s["text"]) for s in r["segments"] if s["loss"]] == [w[2] for w in want if w[1] == "assistant"]
    state = {r["conv_id"]: (r["valid"], r["first_error"]) for r in done}
    assert state == {1: (True, -1), 2: (False, 0), 3: (True, -1), 4: (False, 1), 5: (False, 0), None: (True, -1), 6: (False, 2)}
    assert chat_format.format_chats(df.filter("false")).count() == 0
    with pytest.raises(ValueError, match="markers"):
        chat_format.Template({"a": chat_format.Role("<x>", "<x>")}, {}, ())


def chat_unescape(t):
    return t.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")


# ---- packing and tokenizers


def test_ids_equal_the_library():
    path = packing.tokenizer_file()
    fast, library = packing.Ids(path, keep=20), packing.Ids(path, library=True)
    texts = [t or "" for _, t in TEXTS] + ["  a  b   c\n\n  d \n", "\n \n", " x", "x ", "  ", "a \t b", "x\x1c y \x1c z", "a\u2003 \u2003b", "<|endoftext|> <|endoftext|>"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert fast.by_ranks and library.by_ranks is None
    assert [fast.encode(t) for t in texts] == want == [library.encode(t) for t in texts]


def test_packing(docs, empty):
    path = packing.tokenizer_file()
    library = packing.Ids(path, library=True).tokenizer
    rows = packing.pack(docs, path, group=4).collect()
    windows, pieces = {}, {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in w] == np.concatenate([[0], np.cumsum([r["length"] for r in w])[:-1]]).tolist() and sum(r["length"] for r in w) <= 1024
    seen = Counter((d, t) for d, t in TEXTS)
    for (d, t), times in seen.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = [r for r in pieces[d, len(ids)]]
        assert sum(r["length"] for r in mine) == times * len(ids)
        assert Counter(i for r in mine for i in range(r["start"], r["start"] + r["length"])) == Counter({i: times for i in range(len(ids))})
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    assert packing.pack(empty, path).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 257, 900).tolist()
    sums, members = packing.differencing(sizes, 110)
    assert sorted(i for m in members for i in m) == list(range(900)) and [sum(sizes[i] for i in m) for m in members] == sums.tolist() and sums.max() - sums.min() <= 8
    assert packing.part([]) == [] and packing.part([600, 600, 600]) == [[0], [1], [2]] or len(packing.part([600, 600, 600])) == 3
    for m in packing.part(sizes):
        assert sum(sizes[i] for i in m) <= 1024


def test_bpe(docs, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, path, P.PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((d, np.array(known.encode_ordinary(t or ""), "<u4").tobytes()) for d, t in TEXTS)
    e = bpe.Encoder(ranks, P.PATTERN)
    e.KEEP = 3
    assert all(e.decode(e.encode(t)).decode() == (t or "") for _, t in TEXTS) and len(e) <= 3
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def test_bpe_as_higher_order_functions(spark):
    """The Column form of the fold gives the same ids."""
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    words = [w.encode() for _, t in TEXTS for w in re.findall(r" ?\w+|\W", t or "") if len(w) < 40][:400] + [bytes([b]) for b in range(256)]
    df = spark.createDataFrame([([w.decode("latin-1") for w in words],)], "words array<string>")
    got = df.select(bpe.fold_words(F.col("words"), ranks).alias("e")).first()["e"]
    assert [list(x) for x in got] == [bpe.merge(w, ranks) for w in words]


@pytest.mark.parametrize("word", [b"a", b"a" * 700, b"abcab" * 99, bytes(range(256)), "é日本".encode() * 50])
def test_long_words_merge_the_same(word):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.merge_long(word, ranks) == known._encode_single_piece(word) == bpe.merge(word, ranks)


# ---- language model


def plain_tree(learnt, depth):
    """log10 of the probability of a byte behind bytes, by the definition of context-tree weighting."""
    counts, kids = {}, {}
    for s in learnt:
        s = b"\n" * depth + s
        for at in range(depth, len(s)):
            for d in range(depth + 1):
                ctx = s[at - d : at]
                if d:
                    kids.setdefault(ctx[1:], set()).add(ctx)
                for k in range(8):
                    counts.setdefault((ctx, k, s[at] >> (8 - k)), [0, 0])[s[at] >> (7 - k) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def weighted(ctx, k, prefix):
        if (ctx, k, prefix) not in counts:
            return 0.0
        own = kt(*counts[ctx, k, prefix])
        return own if len(ctx) == depth else float(np.logaddexp(own, sum(weighted(x, k, prefix) for x in kids[ctx]))) - math.log(2)

    def one(full, d, k, prefix):
        ctx = full[depth - d :]
        if (ctx, k, prefix) not in counts:
            return 0.5
        a, b = counts[ctx, k, prefix]
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        own = math.exp(kt(a, b) - math.log(2) - weighted(ctx, k, prefix))
        return own * p + (1 - own) * one(full, d + 1, k, prefix)

    @functools.cache
    def log_p(full, byte):
        return sum(math.log10(p if byte >> (7 - k) & 1 else 1 - p) for k in range(8) for p in [one(full, 0, k, byte >> (8 - k))])

    return log_p


def plain_score(log_p, s, depth):
    s = b"\n" * depth + s
    return sum(log_p(s[at - depth : at], s[at]) for at in range(depth, len(s)))


def lm_words(t):
    return [x.encode() for x in words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [b"\n"]


def test_the_tree_is_a_distribution():
    log_p = plain_tree([b"abab abc\n", b"ba\n"], 2)
    assert all(sum(10 ** log_p(c, y) for y in range(256)) == pytest.approx(1) for c in (b"ab", b"b ", b"zz"))


def test_positions_come_in_pieces():
    streams = [b"abcdefghij\n", b"\n", b"xy z\n", b"q" * 30 + b"\n"]
    for piece in (1, 7, 10**6):
        got = [(int(k), int(i) + lead) for key, i, lead in lm_scoring.positions(iter(streams), 3, piece) for k, i in zip(key, i, strict=True)]
        want = [(sum(p[at - k] << 8 * k for k in range(4)), i) for i, s in enumerate(streams) for p in [b"\n" * 3 + s] for at in range(3, len(p))]
        assert got == want
    assert list(lm_scoring.positions(iter([]), 3)) == []
    assert [(len(key), lead, int(i.max())) for key, i, lead in lm_scoring.positions(iter([b"a\n"] * 300), 2, many=128)] == [(256, 0, 127), (256, 128, 127), (88, 256, 43)]


@pytest.mark.parametrize(("depth", "common", "common_keys"), [(4, 0, 0), (3, 3, 40), (2, 10**5, 10**6), (0, 3, 0)])
def test_lm_scoring(docs, empty, depth, common, common_keys):
    """Against the definition, text by text; the levels of the tree are in tables (4, 3) or in one group (2, 0)."""
    learnt = [lm_words(t) for d, t in TEXTS if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    seen = Counter(w for x in learnt for w in x)
    n, v = sum(seen.values()), len(seen)
    log_p = plain_tree([b" ".join(w[:-1]) + b"\n" for w in learnt], depth)
    got = lm_scoring.score(docs, depth, common, common_keys).collect()
    assert len(got) == len(TEXTS) and {r["train_tokens"] for r in got} == {n}
    want = Counter()
    for d, t in TEXTS:
        w = lm_words(t)
        s = b" ".join(w[:-1]) + b"\n"
        want[d, len(w), sum(seen[x] > 0 for x in w), round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 5), round(plain_score(log_p, s, depth), 5)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want
    assert all(r["bits_per_byte"] > 0 for r in got)
    assert lm_scoring.score(empty, depth).count() == 0


def test_lm_scoring_without_teaching_rows(spark):
    held = next(d for d in range(100) if lm_scoring.held_out(d))
    r = lm_scoring.score(spark.createDataFrame([(held, "Two  words")], "doc_id long, text string")).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and r["score"] == pytest.approx(-10 * 8 * math.log10(2)) and r["bits_per_byte"] == pytest.approx(8)


def test_word_order_counts(spark):
    """Contexts run over word boundaries, so the same words in another order have another score."""
    rows = [(d, "one two three four") for d in range(12)] + [(100 + d, x) for d in range(7) for x in ("one two three four", "four three two one")]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), common_keys=0).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 100]
    assert held and len({round(r["score"], 3) for r in held}) == 2 * len({r["doc_id"] for r in held}) == 2


# ---- media


def test_media(spark, docs, empty, tmp_path):
    assert media.write_archives(media.payloads(docs), str(tmp_path / "a"))[0] == len(TEXTS)
    got = media.read_archives(spark, str(tmp_path / "a"), rangeBytes=300, batchBytes=500)
    assert got.rdd.getNumPartitions() > 3
    rows = got.collect()
    assert all(r["error"] is None for r in rows)
    want = Counter((str(d) if d is not None else "null", media.pad((t or "").encode()), len((t or "").encode())) for d, t in TEXTS)
    assert Counter((r["member"][10:-4], *media.from_png(r["media"])) for r in rows) == want
    again = media.read_archives(spark, str(tmp_path / "a")).count()
    assert again == len(TEXTS)
    media.write_archives(media.payloads(empty), str(tmp_path / "b"))
    assert media.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_one_bad_member_leaves_the_others(spark, docs, tmp_path):
    media.write_archives(media.payloads(docs.coalesce(1)), str(tmp_path / "a"))
    path = next((tmp_path / "a").glob("*.zip"))
    raw = bytearray(path.read_bytes())
    at = raw.index(b"IDAT")
    raw[at + 10] ^= 255
    path.write_bytes(raw)
    rows = media.read_archives(spark, str(tmp_path / "a"), tries=2).collect()
    assert len(rows) == len(TEXTS) and [r["media"] is None for r in rows].count(True) == 1 and "checksum" in next(r["error"] for r in rows if r["error"])


def test_a_reader_tries_again(tmp_path, spark, docs, monkeypatch):
    media.write_archives(media.payloads(docs.coalesce(1)), str(tmp_path / "a"))
    reader = media.ArchiveReader({"path": str(tmp_path / "a")})
    real, failed = media.ArchiveReader.member, []

    def once(handle, m):
        if m.filename not in failed:
            failed.append(m.filename)
            raise OSError("gone")
        return real(handle, m)

    monkeypatch.setattr(media.ArchiveReader, "member", staticmethod(once))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == len(TEXTS) == len(failed) and all(r["error"] is None for r in rows)


def test_png_is_a_png():
    payload = bytes(range(64)) * 3
    png = media.to_png(payload, 190)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and media.from_png(png) == (payload, 190)
    with pytest.raises(ValueError, match="PNG"):
        media.from_png(b"nothing")


# ---- near duplicates


def plain_roots(points, radius=3):
    n = len(points)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(points[i] ^ points) <= radius):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize(("n", "bits"), [(1, 62), (700, 62), (2500, 12), (1800, 16), (1500, 24)])
def test_vantage_points_find_all(n, bits):
    rng = np.random.default_rng(n)
    p = np.unique(rng.integers(0, 1 << bits, n).astype(np.uint64))
    p = np.unique(np.concatenate([p, p[: n // 4] ^ np.uint64(9)]))
    assert simhash.link_points(p).tolist() == plain_roots(p)


@pytest.mark.parametrize("most", [20_000, 40, 6])
def test_shards_keep_all_links(spark, most):
    rng = np.random.default_rng(5)
    p = [rng.integers(0, 1 << 62, 150).astype(np.uint64)]
    for _ in range(5):
        p.append(p[-1] ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64) for _ in range(3)]))
    p = np.unique(np.concatenate([*p, rng.integers(0, 1 << 10, 300).astype(np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.links(df, 3, most)).collect()}
    groups: dict = {}
    for x in p.view(np.int64).tolist():
        groups.setdefault(roots.get(x, x), set()).add(x)
    want: dict = {}
    for x, r in zip(p.view(np.int64).tolist(), plain_roots(p), strict=True):
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_shards_of_a_table_are_searched_by_trees(spark, monkeypatch):
    """On the registered table shards are larger than a leaf, so trees part them at vantage points; and more points have more vantage points."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    points = simhash.cut(simhash.fingerprints(d).select("fp").distinct(), "test-points")
    sizes = {r["shard"]: r["count"] for r in simhash.shard(points).groupBy("shard").count().collect()}
    assert sum(sizes.values()) == 4 * points.count() and max(sizes.values()) > 2 * simhash.LEAF
    fp = np.array([r["fp"] for r in points.collect()], np.int64).view(np.uint64)
    crossed = []
    real = simhash._cross
    monkeypatch.setattr(simhash, "_cross", lambda p, a, b, r, f: (crossed.append((len(a), len(b))), real(p, a, b, r, f)))
    assert simhash.link_points(fp).tolist() == plain_roots(fp)
    assert crossed and sum(a + b for a, b in crossed[:1]) < len(fp)  # the triangle bound leaves points out
    assert [len(simhash.vantage_points(n)) for n in (10, 10_000, 200_000, 10**7, 10**12)] == [1, 1, 3, 5, 5]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 3), (3, 7)]
    for one_task in (0, 10**6):
        got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long"), one_task=one_task).collect()}
        assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 160)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    fps = np.array([plain_fingerprint(t) for _, t in TEXTS], np.uint64)
    points = np.unique(fps)
    root = dict(zip(points.tolist(), plain_roots(points), strict=True))
    least: dict = {}
    for (d, _), f in zip(TEXTS, fps.tolist(), strict=True):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = Counter((d, f, least.get(root[f])) for (d, _), f in zip(TEXTS, fps.tolist(), strict=True))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    component = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert ids == Counter({None: 1} | {c: 1 for d, c in component.items() if d is not None})
    assert simhash.keep_one(empty).count() == 0


# ---- classifiers


def sentences(n, seed=1):
    rng = np.random.default_rng(seed)
    common = ["tree", "river", "stone", "walks", "under", "light", "green", "house", "over", "small", "women", "muslims"]
    rows = []
    for i in range(n):
        w = list(rng.choice(common, 30))
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            w[rng.integers(30)] = str(rng.choice(["vilewort", "vilestuff", "grubling"]))
        bad = int(i % 3 == 0)
        rows.append((i, " ".join(w) if not bad else "$$$ ".join(w).upper(), toxic, 1 - bad))
    return rows


@pytest.fixture(scope="module")
def taught(spark):
    rows = sentences(400)
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return rows, d, spark.createDataFrame([(r[0], r[3], r[2]) for r in rows], "doc_id long, quality int, toxic int")


def test_toxicity(taught, docs, empty, spark):
    rows, d, labels = taught
    got = {r["doc_id"]: r for r in toxicity.classify(d, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]]["held_out"] == (r in held) for r in rows)
    assert np.mean([got[r[0]]["predicted"] == r[2] for r in held]) >= 0.97 and all(got[r[0]]["predicted"] == (got[r[0]]["score"] >= 0.7) for r in rows)
    model = toxicity.fit(d, label_rows(labels, "toxic", 3, 1))
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scored)
    pair = toxicity.score(spark.createDataFrame([(1, "tree women river"), (2, "tree men river")], "doc_id long, text string"), model).collect()
    assert abs(pair[0]["score"] - pair[1]["score"]) < 0.05
    assert toxicity.classify(empty, labels).count() == 0 and {r["score"] for r in toxicity.classify(docs, labels.filter("false")).collect()} == {0.0}
    kept = toxicity.reject(d.withColumn("score", F.lit("z")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["predicted"]}


def test_counterfactuals_shrink_the_change(spark):
    rows = [(i, f"the {'women' if i % 2 else 'men'} walk here", int(i % 2)) for i in range(80)]
    d, y = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, y int")

    def gap(fairness):
        score = toxicity.Scorer(toxicity.fit(d, y, fairness=fairness))
        return abs(score("the women walk here") - score("the men walk here"))

    assert gap(5.0) < 0.5 * gap(0.0)


def test_quality_model(taught, docs, empty):
    rows, d, labels = taught
    got = {r["doc_id"]: r for r in quality_model.classify(d, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]]["held_out"] == (r in held) for r in rows)
    assert np.mean([got[r[0]]["predicted"] == r[3] for r in held]) >= 0.97 and all(got[r[0]]["predicted"] == (got[r[0]]["score"] >= 0.3) for r in rows)
    mixed = quality_model.classify(docs, labels).collect()
    assert len(mixed) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in mixed)
    assert quality_model.classify(empty, labels).count() == 0 and {r["score"] for r in quality_model.classify(docs, labels.filter("false")).collect()} == {0.5}
    kept = quality_model.reject(d.withColumn("x", F.lit("z")), labels)
    assert kept.columns == ["doc_id", "text", "x"] and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["predicted"]}


def test_normal_equations_and_pooling(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, len(quality_model.NAMES)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int)
    df = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y, strict=True)], "x array<float>, y int").repartition(5)
    m = quality_model.fit(df, features=32)
    z = m.features(x.astype(np.float32).astype(float))
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    assert m.beta == pytest.approx(np.linalg.solve((z.T * w) @ z + np.eye(33), (z.T * w) @ y), rel=1e-6, abs=1e-8)
    assert (np.diff(m.levels) >= 0).all() and (np.diff(m.edges) > 0).all()
    assert quality_model.pool(np.array([1.0, 0.0, 2.0]), np.array([1.0, 3.0, 1.0])).tolist() == [0.25, 0.25, 2.0]


def test_label_rows_are_whole_numbers_once(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 7), (4, 0)], "doc_id long, toxic int")
    assert {(r["doc_id"], r["y"]) for r in label_rows(df, "toxic", 1000, -1).collect()} == {(1, 1), (4, 0)}


# ---- url filter


def test_url_filter(spark):
    rows = [
        (1, "https://www.Example.com/en/x?y#z", ""), (2, "http://a.example.com/en/1", None), (3, "http://a.com", "<p>"), (4, "ftp://x.net/fr/", ""), (5, "http://x.net/de/", ""), (6, None, None), (7, "no url", ""), (8, "http://notexample.com/en/", ""),
        (9, "http://good.org/a", '<a href="https://fine.com/x">'), (10, "http://fine.com/", '<a href="http://friend.org/">'), (11, "http://friend.org/", ""), (12, "http://evil.org/", '<a href=http://spam.net/es/1>'), (13, "http://spam.net/es/1", ""), (13, "http://spam.net/es/1", ""),
        (14, "http://q.org?a://b.com/", ""), (15, "http://", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("rule", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/1", "example.com/en/", "block"), 3: ("a.com", "", None, "allow"), 4: ("x.net", "/fr/", "net/fr/", "block"), 5: ("x.net", "/de/", None, "block"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notexample.com", "/en/", "com/", "allow"), 9: ("good.org", "/a", None, "allow"), 10: ("fine.com", "/", "com/", "allow"), 11: ("friend.org", "/", None, "allow"),
        12: ("evil.org", "/", None, "block"), 13: ("spam.net", "/es/1", "net/es/", "block"), 14: ("q.org", "", None, "allow"), 15: ("", "", None, "allow"),
    }
    assert url_filter.judge(df).count() == len(rows) and url_filter.judge(df.filter("false")).count() == 0


def test_propagation_equals_matrices(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 8, (20, 2)) if a != b})
    w = {e: float(rng.integers(1, 4)) for e in edges}
    m = np.zeros((8, 8))
    for (a, b), x in w.items():
        m[a, b] = x
    s, r = np.eye(8)[0], np.eye(8)[3]
    out, into = m / np.maximum(m.sum(1, keepdims=True), 1e-12), m.T / np.maximum(m.T.sum(1, keepdims=True), 1e-12)
    t, d = (0.15 * v @ np.linalg.inv(np.eye(8) - 0.85 * step) for v, step in ((s, out), (r, into)))
    seeds = spark.createDataFrame([(str(i), float(s[i]), float(r[i])) for i in range(8)], "host string, good double, bad double")
    links = spark.createDataFrame([(str(a), str(b), x) for (a, b), x in w.items()], "src string, dst string, w double")
    with Scratch(spark) as scratch:
        got = {row["host"]: row for row in url_filter.propagate(seeds, links, scratch).collect()}
    for i in range(8):
        assert got[str(i)]["trust"] == pytest.approx(t[i], abs=1e-3) and got[str(i)]["distrust"] == pytest.approx(d[i], abs=1e-3)


def test_a_long_chain_is_followed_to_its_end(spark):
    """Each host links to the next, the last one is blocked by a rule: all are. A host between equal trust and distrust is allowed."""
    n = 20
    rows = [(k, f"http://h{k}.org/", f'<A HREF="//h{k + 1}.org/x">') for k in range(n)] + [(n, f"http://h{n}.org/", '<a href="http://end.net/fr/">'), (n + 1, "http://end.net/fr/1", "")]
    rows += [(100, "http://mid.biz/", '<a href="http://end.net/fr/">')]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"block"} and len(got) == n + 3
    even = [(1, "http://good.com/", '<a href="http://mid.biz/">'), (2, "http://mid.biz/", '<a href="http://bad.net/fr/">'), (3, "http://bad.net/fr/", "")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(even, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block"}
