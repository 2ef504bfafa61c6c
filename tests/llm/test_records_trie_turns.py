"""Records, prefix trie and turn reassembly against plain versions, and their edge cases."""

import hashlib
import json
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import prefix_trie, records, registry, turn_reassembly

WORDS = P.path("word_bpe_49k.json")
ODD = ["Hello  World\n\tΣΑΣ ab <|endoftext|> \x1cq", "", None, "  ", "don't!'s it's I'LL", "été İstanbul 12½ ×÷ªº", "日本語 text", "a" * 300 + " 😀😀 b", "#$%  '' 's", "tab\x0bvt\x0cff\rcr\x85nel", "ﬁn Ǆ ß ẞ ÿ Ÿ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


# ---- records


def plain_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def plain_masked(data: bytes) -> int:
    c = plain_crc(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_crc():
    assert records.crc32c([bytes(32), b"\xff" * 32, b"123456789"]).tolist() == [0x8A9136AA, 0x62A8AB43, 0xE3069283]  # published check values
    some = [np.random.default_rng(n).bytes(n) for n in (0, 1, 3, 4, 5, 1023, 1024, 1025, 5000, 17)]
    assert records.crc32c(some).tolist() == [plain_crc(x) for x in some] and len(records.crc32c([])) == 0


@pytest.mark.parametrize("keep", [20, 10**6])
def test_ids_are_the_librarys(library, keep):
    r = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(r.choice("aZé'sÉ 1.\ń日Σ<|_-½tvemlrd") for _ in range(r.randrange(60))) for _ in range(1500)]
    ids = records.WordIds(WORDS, keep)
    for at in range(0, len(texts), 150):
        some = texts[at : at + 150]
        assert [np.frombuffer(x, ids.dtype).tolist() for x in ids.encode(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_slices():
    text = "ab cd  efg h" * 50
    assert all("".join(records.slices(text, n)) == text for n in (1, 7, 100, 10_000))
    assert all(s[0] == " " for s in list(records.slices(text, 7))[1:])


def test_other_files_go_to_the_library(tmp_path, library):
    spec = json.load(open(WORDS))
    spec["normalizer"]["normalizers"].pop()  # keeps case
    (tmp_path / "t.json").write_text(json.dumps(spec))
    own, theirs = records.WordIds(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not own.by_pieces
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(["Ab cd"])] == [theirs.encode("Ab cd", add_special_tokens=False).ids]


@pytest.fixture(scope="module")
def written(spark, library, tmp_path_factory):
    rows = [(k * 7 % 50, t) for k, t in enumerate(ODD * 3)] + [(None, "none"), (3, "twice"), (3, "twice"), (-5, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 ids", "2 start", "'a' width")
    path = str(tmp_path_factory.mktemp("rec"))
    records.write_records(records.sequences(df.repartition(5), WORDS), path)
    return rows, path


def test_records_round_trip(spark, library, written):
    rows, path = written
    got = records.read_records(spark, path, rangeBytes=200, batchBytes=64).orderBy("start", "shard", "record").collect()
    want = sorted(((d, [*library.encode(t or "", add_special_tokens=False).ids, records.END]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    found = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4


def test_framing(written):
    """A shard read by the framing's definition alone."""
    _, path = written
    for s in records.read_manifest(path):
        raw, index = open(f"{path}/{s.name}.rec", "rb").read(), open(f"{path}/{s.name}.idx", "rb").read()
        at, rows = 0, []
        while at < len(raw):
            (n,) = struct.unpack_from("<Q", raw, at)
            data = raw[at + 12 : at + 12 + n]
            assert struct.unpack_from("<I", raw, at + 8)[0] == plain_masked(raw[at : at + 8]) and struct.unpack_from("<I", raw, at + 12 + n)[0] == plain_masked(data)
            rows.append((at, n + 16))
            at += n + 16
        assert np.frombuffer(index[:-4], "<u8").reshape(-1, 3)[:, :2].tolist() == [list(r) for r in rows] and len(rows) == s.records


def test_shuffled(spark, written):
    rows, path = written
    order = {}
    for seed in (1, 2):
        got = records.shuffled(spark, path, seed).orderBy("place").collect()
        order[seed] = [(r["shard"], r["record"], bytes(r["ids"])) for r in got]
        assert order[seed] == [(r["shard"], r["record"], bytes(r["ids"])) for r in records.shuffled(spark, path, seed).orderBy("place").collect()]
    plain = {(r["shard"], r["record"], bytes(r["ids"])) for r in records.read_records(spark, path).collect()}
    assert set(order[1]) == set(order[2]) == plain and order[1] != order[2] and len(order[1]) == len(rows)


def test_damage_is_told(spark, written, tmp_path):
    import shutil

    _, path = written
    shutil.copytree(path, tmp_path / "d")
    name = records.read_manifest(path)[0].name
    raw = bytearray((tmp_path / "d" / f"{name}.rec").read_bytes())
    raw[30] ^= 1
    (tmp_path / "d" / f"{name}.rec").write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(spark, str(tmp_path / "d")).collect()


def test_unfinished_files_are_no_data(spark, written, tmp_path):
    rows, path = written
    (tmp_path / "x").write_text("")
    open(f"{path}/part-000000-deadbeef.rec", "wb").write(b"half a rec")  # of a lost task
    assert records.read_records(spark, path).count() == len(rows)


def test_no_records(spark, tmp_path):
    records.write_records(records.sequences(spark.createDataFrame([], "doc_id long, text string"), WORDS), str(tmp_path / "r"))
    assert records.read_records(spark, str(tmp_path / "r")).count() == records.shuffled(spark, str(tmp_path / "r")).count() == 0


def test_op11(spark, sf_dir, library):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()))
    want, at = [], 0
    for (d, _), e in zip(docs, library.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, registry.QUERIES["op11_records"](spark, sf_dir).collect())) == want


# ---- prefix trie


def plain_trie(convs: dict[int, list[tuple[str, str]]]) -> dict[tuple[int, int], tuple]:
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for path, ids in members.items():
        below = [p for p in members if len(p) >= len(path) and p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaf = lambda p: not any(len(x) == len(p) + 1 and x[: len(p)] == p for x in members)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(convs[c]) == len(path)))
        out[min(ids), len(path)] = (min(members[path[:-1]]) if path else None, len(ids), len(children), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)  # turns of one conversation in several blocks
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    r = random.Random(4)
    rows, convs = [], defaultdict(list)
    for c in range(60):
        for t in range(r.choice([1, 2, 3, 6, 9])):
            rows.append((c, t * 3 if t else None, r.choice(["user", "assistant", None]) if t > 1 else "user", r.choice(["é", "b", ""]) if t < 4 else "x"))
    rows += [(c, t, "user", "same") for c in range(100, 120) for t in range(4)] + [(200, 1, "user", "again"), (200, 1, "user", "again"), (None, 1, "user", "lost")]
    for c, t, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        convs[c].append((role or "", text or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 depth", "2 digest", "3 cls").repartition(4)
    turns = prefix_trie.turns_of(df)
    assert {(x["conv_id"], x["depth"]): (x["role"], x["text"]) for x in turns.collect()} == {(c, i + 1): x for c, ts in convs.items() for i, x in enumerate(ts)}
    convs[500] = []  # a member without turns
    members = turns.select("conv_id").distinct().union(spark.createDataFrame([(500,)], "conv_id long"))
    nodes = prefix_trie.trie(members, turns)
    got = {(x["conv_id"], x["depth"]): tuple(x)[2:] for x in nodes.collect()}
    assert got == plain_trie(convs) and nodes.count() == len(got)
    last = {(x["conv_id"], x["depth"]): (x["role"], x["text"]) for x in prefix_trie.with_turns(nodes, turns).collect()}
    assert all(x == (convs[c][d - 1] if d else (None, None)) for (c, d), x in last.items())


def test_small_tries(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = prefix_trie.turns_of(none)
    assert prefix_trie.trie(turns.select("conv_id").distinct(), turns).count() == 0
    one = prefix_trie.turns_of(spark.createDataFrame([(7, 1, "user", "a"), (7, 2, "user", "b" * 100_000)], none.schema))
    assert {(x["conv_id"], x["depth"]): tuple(x)[2:] for x in prefix_trie.trie(one.select("conv_id").distinct(), one).collect()} == plain_trie({7: [("user", "a"), ("user", "b" * 100_000)]})


# ---- turn reassembly


def plain_events(batches: list[list[tuple]], first: dict[int, int]) -> list[tuple]:
    """batches: rows (conv, turn, role, text) as they arrive. Events of every batch, and of the end."""
    open_, closed, out = {}, set(), []
    for b, rows in enumerate([*batches, None]):
        arrivals = {}
        for c, t, role, text in rows or []:
            x = f"{role}|{text}".encode(), role, text
            arrivals[c, t] = min(arrivals.get((c, t), x), x)
        for (c, t), (_, role, text) in arrivals.items():
            if c in closed:
                out.append(("reject", c, t, b, role, text, None, None, None))
                continue
            o = open_.setdefault(c, {"kept": {}, "next": first[c]})
            o["seen"] = b
            o["kept"].setdefault(t, (role, text))
        for c, o in open_.items():
            while o["next"] in o["kept"]:
                out.append(("release", c, o["next"], b, *o["kept"][o["next"]], None, None, None))
                o["next"] += 1
        for c in [c for c, o in open_.items() if rows is None or o["seen"] <= b - 2]:
            o = open_.pop(c)
            closed.add(c)
            kept = o["kept"]
            missing = sum(t not in kept for t in range(first[c], max(kept) + 1))
            breaks = sum(t - 1 in kept and kept[t - 1][0] == kept[t][0] for t in kept)
            out.append(("close", c, -1, b, None, None, tuple(sorted(t for t in kept if t >= o["next"])), missing, breaks))
    return sorted(out, key=repr)


def made_batches(seed: int, convs: int = 30, n: int = 9) -> tuple[list[list[tuple]], dict[int, int]]:
    r = random.Random(seed)
    batches, first = [[] for _ in range(n)], {}
    for c in range(convs):
        start, turns = r.randrange(-3, 5), r.randrange(1, 12)
        first[c] = start
        about = r.randrange(n)
        for t in range(start, start + turns):
            for _ in range(r.choice([1, 1, 2, 3])):
                at = min(n - 1, max(0, about + r.choice([0, 0, 0, 1, -1, 2, 4])))
                batches[at].append((c, t, r.choice(["user", "assistant", ""]), r.choice(["é", "", "long " * 50, "a|b"])))
    return batches, first


def rows_of(event) -> tuple:
    e = dict(event)
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else v
    pending = e["pending"]
    return (e["event"], int(e["conv_id"]), int(e["turn"]), int(e["batch"]), clean(e["role"]), clean(e["text"]), None if pending is None else tuple(int(x) for x in pending), *(None if clean(e[k]) is None else int(e[k]) for k in ("n_missing", "n_breaks")))


@pytest.mark.parametrize("seed", range(8))
def test_bucket(seed):
    """The merge alone, its state written and read between batches."""
    batches, first = made_batches(seed)
    state, got = turn_reassembly.Bucket().dump(), []
    for b, rows in enumerate([*batches, []]):
        bucket = turn_reassembly.Bucket.load(state)
        frame = pd.DataFrame([(c, t, first[c], role, text) for c, t, role, text in rows], columns=["conv_id", "turn", "first", "role", "text"])
        once = frame.assign(p=[f"{a}|{x}".encode() for a, x in zip(frame.role, frame.text, strict=True)]).sort_values(["conv_id", "turn", "p"], kind="stable").drop_duplicates(["conv_id", "turn"])
        late = frame["conv_id"].isin(bucket.closed)  # late rows are told one by one; the feed leaves one a turn
        mixed = pd.concat([frame[~late], once[once["conv_id"].isin(bucket.closed)].drop(columns="p")]).astype({"conv_id": "int64", "turn": "int64", "first": "int64"})
        for events in bucket.take(mixed, b, last=b == len(batches)):
            got += [rows_of(e) for e in events.to_dict("records")]
        state = bucket.dump()
    assert sorted(got, key=repr) == plain_events(batches, first)


def test_stream(spark, tmp_path):
    batches, first = made_batches(99, convs=40, n=4)
    rows = [(b, c, t, first[c], role, text) for b, some in enumerate(batches) for c, t, role, text in some]
    df = spark.createDataFrame(rows, "batch int, conv_id long, turn long, first long, role string, text string")
    turn_reassembly.feed(df, 4, 3, f"{tmp_path}/s/staged")
    got = [rows_of(r.asDict()) for r in turn_reassembly.run_batches(spark, f"{tmp_path}/s/staged", 4, f"{tmp_path}/s").collect()]
    assert sorted(got, key=repr) == plain_events(batches, first)


def test_arrivals(spark):
    rows = [(1, None, "user", "x"), (None, 1, "user", "x"), (5, 3, None, None), (5, 4, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 batch", "2 first", "3 h")
    got = turn_reassembly.arrivals_of(df).collect()
    assert {(r["conv_id"], r["turn"], r["first"], r["role"], r["text"]) for r in got if r["turn"] == 3} >= {(5, 3, 3, "", "")}
    for c, t in ((5, 3), (5, 4)):
        h = int(hashlib.sha256(f"{c}:{t}".encode()).hexdigest()[:8], 16)
        assert sorted(r["batch"] for r in got if r["turn"] == t) == sorted([h % 12] + [(h + 5) % 12] * (h % 7 < 2))
    assert turn_reassembly.arrivals_of(df.limit(0)).count() == 0 and turn_reassembly.buckets_for(0) == 16


def test_empty_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert registry.QUERIES["op12_prefix_trie"](spark, str(tmp_path)).count() == 0
    assert registry.QUERIES["op13_turn_reassembly"](spark, str(tmp_path)).count() == 0


def test_shared_folder_is_used(spark, sf_dir):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    plan = registry.QUERIES["op13_turn_reassembly"](spark, sf_dir)
    assert all(f.startswith(("file:" + base, "file://" + base)) for f in plan.inputFiles()) and plan.filter(F.col("event") == "close").count() > 0
