"""LM scoring by context-tree weighting over the bytes of a text.

A text is coded as the bytes of its words, one space between words and one line break as its end. Each byte is eight binary decisions along the
prefix of its bits, and each decision is predicted in every context of the last 0 to `DEPTH` bytes, which run over word boundaries (before a
text stand line breaks). A node is a context with a bit prefix and keeps a Krichevsky-Trofimov estimate; its weighted probability is half its own
estimate and half the product of its children's, so all depths are mixed by how well each codes the training texts. A child without counts
predicts one half. The trained mixture is fixed before scoring; the score of a text is the sum over its bytes.

The tree is never in one place. Tasks count (context, byte) keys of all texts with bounded memory and Spark adds them up. The tree's lowest
levels are built from the keys of one context of `DEPTH - 2` bytes, a group that holds 256 * 256 contexts at most; the levels above are merges of at most
256 children, level by level. What the upper levels give is passed down the same way, and each group then names the log probability of each
of its keys. Texts meet these in two ways that cover all positions: the `COMMON_KEYS` most frequent keys (a bounded number) go to the tasks, the
others are joined as (row, key, times); those are rare by choice, so no key is hot. Tokens, for the base score, are met likewise.
The depth and all else are the same at every size of the corpus.

Defined results: null and empty texts are one end token; a null doc id counts as an empty string for the split; repeated rows are learnt and
scored as often as they stand there; tokens or keys of one frequency are common or rare together; with nothing to learn from, all decisions are even;
texts of any length are scored whole, in pieces of bounded size; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.shared import Scratch, cut, table

DEPTH = 6
#: The most tokens and keys that go to the tasks.
COMMON, COMMON_KEYS = 150_000, 3_000_000
#: Different tokens or keys that a task holds before it passes its counts on.
HELD, HELD_KEYS = 400_000, 2_000_000
#: Positions of texts, and keys of groups, that are worked on at once.
PIECE, SLICE = 3_000_000, 500_000
#: Texts of a piece that are told apart by as many low bits behind the key.
TEXTS = 7

#: The end of a text as a token: no word has it.
END = b"\n"
LN10, LN2 = float(np.log(10.0)), float(np.log(2.0))


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def texts_of(b: pa.RecordBatch) -> list[bytes | None]:
    """The texts of a batch in UTF-8."""
    return b["text"].cast(pa.binary()).to_pylist()


def tokens(text: bytes | None) -> list[bytes]:
    found = (text or b"").lower().split()
    found.append(END)
    return found


# ---- positions of texts


def keys_of(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, part) of each position behind the first `depth` bytes of each part. A key is the byte, above it the byte before, and so on."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    key = flat.copy()
    for k in range(1, depth + 1):
        key[k:] |= flat[:-k] << (8 * k)
    inside = np.ones(len(flat), bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(depth):
        inside[starts + k] = False
    return key[inside], np.repeat(np.arange(len(parts)), sizes - depth)


def positions(streams: Iterator[bytes], depth: int, piece: int = PIECE, many: int = 1 << 40) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(key, number of the stream counted from a first one, that first one) of all positions, about `piece` and at most `many` streams at a time;
    long streams come in several."""
    parts, owners, held = [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, int]:
        key, part = keys_of(parts, depth)
        return key, (np.array(owners) - owners[0])[part], owners[0]

    for i, s in enumerate(streams):
        s = END * depth + s
        for at in range(0, len(s) - depth, piece):
            if parts and (held >= piece or i - owners[0] >= many):
                yield out()
                parts, owners, held = [], [], 0
            parts.append(s[at : at + piece + depth])
            owners.append(i)
            held += len(parts[-1]) - depth
    if parts:
        yield out()


def stream(found: list[bytes]) -> bytes:
    """What is coded: found ends with END."""
    return b" ".join(found[:-1]) + END


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where a value stands for the first time."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the sums of values over them."""
    if not len(key):
        return key, *values
    order = np.argsort(key)
    key = key[order]
    first = _firsts(key)
    return key[first], *(np.add.reduceat(v[order], first) for v in values)


# ---- counts


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n, c): n times in all texts, c of them in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, other = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for counter, learns in ((learnt, True), (other, False)):
                if counter:
                    n = np.fromiter(counter.values(), np.int64, len(counter))
                    yield pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.binary()), pa.array(n), pa.array(n if learns else np.zeros_like(n))], names=["token", "n", "c"])
                    counter.clear()

        for b in batches:
            for d, t in zip(b["doc_id"].to_pylist(), texts_of(b), strict=True):
                (other if held_out(d) else learnt).update(tokens(t))
                if len(learnt) + len(other) > HELD:
                    yield from out()
        yield from out()

    rows = docs.select("doc_id", "text").mapInArrow(run, "token binary, n long, c long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def key_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, c): n times in all texts, c of them in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0  # of (keys, n << 32 | c)

        def out() -> Iterator[pa.RecordBatch]:
            key, both = parts[0]
            for at in range(0, len(key), 200_000):
                k, x = key[at : at + 200_000], both[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(x >> 32), pa.array(x & 0xFFFFFFFF)], names=["key", "n", "c"])

        def merge() -> None:
            parts[:] = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]

        for b in batches:
            learns = np.array([not held_out(d) for d in b["doc_id"].to_pylist()], np.int64)
            for key, i, lead in positions((stream(tokens(t)) for t in texts_of(b)), depth):
                marked = np.sort(key << 1 | learns[lead:][i])
                first = _firsts(marked)
                n = np.diff(np.append(first, len(marked)))
                marked = marked[first]
                both = n << 32 | n * (marked & 1)
                first = _firsts(marked >> 1)
                parts.append((marked[first] >> 1, np.add.reduceat(both, first)))
                held += len(first)
                if held > HELD_KEYS + HELD_KEYS // 2:
                    merge()
                    held = len(parts[0][0])
                    if held > HELD_KEYS:
                        yield from out()
                        parts, held = [], 0
        if parts:
            merge()
            yield from out()

    rows = docs.select("doc_id", "text").mapInArrow(run, "key long, n long, c long")
    return rows.repartition(F.col("key")).groupBy("key").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))  # tasks have summed already


# ---- nodes


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; x > 0."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - 1.1447298858494002  # ln pi


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def _within(ctx: np.ndarray, depth: int) -> np.ndarray:
    return ctx & ((1 << (8 * depth)) - 1)


def nodes_at(key: np.ndarray, c: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones) of one depth: a node is context << 8 | bit prefix with a leading one."""
    pair, c = _summed(_within(key >> 8, depth) << 8 | key & 255, c)
    ctx, byte = pair >> 8 << 8, pair & 255
    parts = []
    for k in range(8):  # pairs are in order, so are their prefixes of one length
        bit = (byte >> (7 - k)) & 1
        parts.append(_summed(ctx | (1 << k) | byte >> (8 - k), c * (1 - bit), c * bit))
    node, zeros, ones = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(node)
    return node[order], zeros[order].astype(float), ones[order].astype(float)


def _up(node: np.ndarray, depth: int) -> np.ndarray:
    """The node above, in the context of `depth` bytes."""
    return _within(node >> 8, depth) << 8 | node & 255


class Levels:
    """Nodes of the depths top to depth, with weighted probabilities and the share of each node's own estimate."""

    def __init__(self, key: np.ndarray, c: np.ndarray, top: int, depth: int):
        self.top, self.depth = top, depth
        self.nodes, self.share, self.weighted = {}, {}, {}
        for d in range(depth, top - 1, -1):
            at, zeros, ones = self.nodes[d] = nodes_at(key, c, d)
            kt = _kt(zeros, ones)
            if d == depth:
                self.share[d], self.weighted[d] = np.ones(len(at)), kt
            else:
                below = np.bincount(np.searchsorted(at, _up(self.nodes[d + 1][0], d)), weights=self.weighted[d + 1], minlength=len(at))
                self.weighted[d] = np.logaddexp(kt, below) - LN2
                self.share[d] = np.exp(kt - LN2 - self.weighted[d])

    def log_p(self, key: np.ndarray, groups: np.ndarray, given: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key. groups: contexts of `top` bytes in order; given, rest: what the depths above give by group and prefix."""
        one = {}
        g = r = np.empty(0)
        for d in range(self.top, self.depth + 1):
            at, zeros, ones = self.nodes[d]
            if d == self.top:
                group = np.searchsorted(groups, at >> 8)
                g, r = given[group, at & 255], rest[group, at & 255]
            else:
                above = np.searchsorted(self.nodes[d - 1][0], _up(at, d - 1))
                g, r = g[above], r[above]
            g, r = g + r * self.share[d] * _estimate(zeros, ones), r * (1 - self.share[d])
            one[d] = g + r * 0.5  # a child without counts
        out = np.zeros(len(key))
        ctx, byte = key >> 8, key & 255
        group = np.searchsorted(groups, _within(ctx, self.top))
        for k in range(8):
            prefix, bit = (1 << k) | byte >> (8 - k), (byte >> (7 - k)) & 1
            p, todo = given[group, prefix] + rest[group, prefix] * 0.5, np.arange(len(key))
            for d in range(self.depth, self.top - 1, -1):
                at = self.nodes[d][0]
                if not len(todo) or not len(at):
                    continue
                want = _within(ctx[todo], d) << 8 | prefix[todo]
                place = np.minimum(np.searchsorted(at, want), len(at) - 1)
                hit = at[place] == want
                p[todo[hit]] = one[d][place[hit]]
                todo = todo[~hit]
            out += np.log(np.where(bit == 1, p, 1 - p))
        return out / LN10


# ---- the tree in tables

#: A node of a row's context, and what a context and the shorter ones give: by prefix, the probability of a one so far and the share left to longer contexts.
NODE = np.dtype([("prefix", "u1"), ("zeros", "<f8"), ("ones", "<f8"), ("weighted", "<f8")])
NOTHING = np.concatenate([np.zeros(256), np.ones(256)])


def _prefix_of(context: str, depth: int) -> Column:
    return F.col(context).bitwiseAND((1 << (8 * depth)) - 1)


def grouped(counts: DataFrame, top: int) -> DataFrame:
    """(ctx, data): for each context of `top` bytes its keys in order, and their n and c, as three arrays of int64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.empty(0, np.int64) for _ in range(4))

        def out(upto: int) -> Iterator[pa.RecordBatch]:
            ctx = held[0][:upto]
            cuts = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1], [True]])) if upto else np.zeros(1, np.int64)
            for at in range(0, len(cuts) - 1, 2000):
                ends = cuts[at : at + 2001].tolist()
                data = [b"".join(x[a:z].tobytes() for x in held[1:]) for a, z in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(ctx[ends[:-1]]), pa.array(data, pa.binary())], names=["ctx", "data"])

        for b in batches:
            held = tuple(np.concatenate([x, b[i].to_numpy()]) for i, x in enumerate(held))
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last group may go on
            if whole > SLICE // 4:
                yield from out(whole)
                held = tuple(x[whole:] for x in held)
        yield from out(len(held[0]))

    rows = counts.select(F.shiftright("key", 8).bitwiseAND((1 << (8 * top)) - 1).alias("ctx"), "key", "n", "c")
    return rows.repartition(F.col("ctx")).sortWithinPartitions("ctx", "key").mapInArrow(run, "ctx long, data binary")


def _slices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their ctx, keys, n, c) of some rows of a batch at a time, by ctx."""
    ctx, data = b["ctx"].to_numpy(), b["data"]
    order, some, held = np.argsort(ctx), [], 0
    for i in order.tolist():
        some.append(i)
        held += len(data[i].as_buffer()) // 24
        if held >= SLICE or i == order[-1]:
            parts = [np.frombuffer(data[j].as_buffer(), np.int64).reshape(3, -1) for j in some]
            yield np.array(some), ctx[some], *np.concatenate(parts, axis=1)
            some, held = [], 0


def _node_rows(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """One value of NODEs for each row; node >> 8 is a place in rows."""
    out = np.empty(len(node), NODE)
    out["prefix"], out["zeros"], out["ones"], out["weighted"] = node & 255, zeros, ones, weighted
    ends = np.searchsorted(node >> 8, np.arange(len(rows) + 1)).tolist()
    return [out[a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)]


def lowest(groups: DataFrame, top: int, depth: int) -> DataFrame:
    """(ctx, nodes) at depth top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ctx, key, _, c in _slices(b):
                known = c > 0
                x = Levels(key[known], c[known], top, depth)
                node, zeros, ones = x.nodes[top]
                place = np.searchsorted(ctx, node >> 8) << 8 | node & 255
                yield pa.RecordBatch.from_arrays([pa.array(ctx), pa.array(_node_rows(place, zeros, ones, x.weighted[top], ctx), pa.binary())], names=["ctx", "nodes"])

    return groups.select("ctx", "data").mapInArrow(run, "ctx long, nodes binary")


def merged(children: DataFrame, depth: int) -> DataFrame:
    """(ctx, nodes) one level up, at `depth`: each row of at most 256 children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows, owner = [], []
            for i, many in enumerate(b["kids"].to_pylist()):
                rows.append(np.frombuffer(b"".join(x["nodes"] for x in many), NODE))
                owner.append(np.full(len(rows[-1]), i, np.int64))
            x = np.concatenate(rows)
            node, zeros, ones, below = _summed(np.concatenate(owner) << 8 | x["prefix"], x["zeros"], x["ones"], x["weighted"])
            weighted = np.logaddexp(_kt(zeros, ones), below) - LN2
            yield pa.RecordBatch.from_arrays([b["ctx"], pa.array(_node_rows(node, zeros, ones, weighted, np.arange(b.num_rows)), pa.binary())], names=["ctx", "nodes"])

    kids = children.groupBy(_prefix_of("ctx", depth).alias("up")).agg(F.sort_array(F.collect_list(F.struct("ctx", "nodes"))).alias("kids"))
    return kids.select(F.col("up").alias("ctx"), "kids").mapInArrow(run, "ctx long, nodes binary")


def passed_down(level: DataFrame, above: DataFrame | None, depth: int) -> DataFrame:
    """(ctx, state): for each context of the level what it and the shorter ones give. above: the same one level up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for nodes, state in zip(b["nodes"].to_pylist(), b["state"].to_pylist(), strict=True):
                given, rest = np.frombuffer(state).reshape(2, 256)
                x = np.frombuffer(nodes, NODE)
                share = np.exp(_kt(x["zeros"], x["ones"]) - LN2 - x["weighted"])
                at, g, r = x["prefix"], given + rest * 0.5, np.zeros(256)
                g[at], r[at] = given[at] + rest[at] * share * _estimate(x["zeros"], x["ones"]), rest[at] * (1 - share)
                out.append(np.concatenate([g, r]).tobytes())
            yield pa.RecordBatch.from_arrays([b["ctx"], pa.array(out, pa.binary())], names=["ctx", "state"])

    return _with_state(level, above, depth).mapInArrow(run, "ctx long, state binary")


def _with_state(rows: DataFrame, above: DataFrame | None, depth: int) -> DataFrame:
    """rows of contexts of `depth` bytes with the state of the context one byte shorter."""
    if above is None:
        return rows.withColumn("state", F.lit(bytearray(NOTHING.tobytes())))
    return rows.withColumn("up", _prefix_of("ctx", depth - 1)).join(above.select(F.col("ctx").alias("up"), "state"), "up").drop("up")


def key_scores(groups: DataFrame, above: DataFrame | None, top: int, depth: int) -> DataFrame:
    """(key, n, lp): log10 of the probability of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, ctx, key, n, c in _slices(b):
                state = np.stack([np.frombuffer(b["state"][i].as_buffer()) for i in rows.tolist()])
                known = c > 0
                lp = Levels(key[known], c[known], top, depth).log_p(key, ctx, state[:, :256], state[:, 256:])
                for at in range(0, len(key), 200_000):
                    part = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(n[part]), pa.array(lp[part])], names=["key", "n", "lp"])

    return _with_state(groups, above, top).select("ctx", "data", "state").mapInArrow(run, "key long, n long, lp double")


def train(docs: DataFrame, scratch: Scratch, depth: int = DEPTH) -> DataFrame:
    """(key, n, lp) of all keys of all texts, learnt from the training texts."""
    top = max(depth - 2, 0)
    groups = scratch.cut(grouped(key_counts(docs, depth), top), "lm-groups")
    levels = {top: scratch.cut(lowest(groups, top, depth), "lm-nodes")} if top else {}
    for d in range(top - 1, -1, -1):
        levels[d] = scratch.cut(merged(levels[d + 1], d), "lm-nodes")
    state = None
    for d in range(top):
        state = scratch.cut(passed_down(levels[d], state, d), "lm-state")
    return key_scores(groups, state, top, depth)


# ---- texts


def most_frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows above a frequency n that at most `most` rows reach. Frequencies are binned by a hundredth of their logarithm, so few bins are counted."""
    bin_ = F.floor(F.log(F.col("n").cast("double")) * 100)
    left, cutoff = most, None
    for r in sorted(rows.groupBy(bin_.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        left -= r["count"]
        if left < 0:
            break
        cutoff = r["bin"]
    return rows.filter(bin_ >= cutoff) if cutoff is not None else rows.filter(F.lit(False))


OWN = (("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()))
RARE = (("token", pa.binary()), ("key", pa.int64()), ("times", pa.int64()))
SEEN = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, lp double, token binary, key long, times long"


def _batch(**columns) -> pa.RecordBatch:
    """Columns of SEEN; those not given are null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], k) if n in columns else pa.nulls(size, k) for n, k in (*OWN, *RARE)], names=[n for n, _ in (*OWN, *RARE)])


def met(docs: DataFrame, tokens_: tuple, keys: tuple, depth: int) -> DataFrame:
    """SEEN: a row for each text with the sums over its common tokens and keys, and (row, token or key, times) of the others.

    tokens_: broadcast (token, base score, known); keys: broadcast (key, lp), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, base_, known_ = tokens_.value
        key_, lp_ = keys.value
        place = {t: i for i, t in enumerate(names)}
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            own: dict[str, list] = {n: [] for n, _ in OWN}
            rare: dict[str, list] = {n: [] for n in ("row", "token", "times")}
            texts = []
            for i, (d, t) in enumerate(zip(b["doc_id"].to_pylist(), texts_of(b), strict=True)):
                found = tokens(t)
                at = list(map(place.get, found))
                others = Counter(w for w, i in zip(found, at, strict=True) if i is None) if None in at else {}
                common = np.array([x for x in at if x is not None] if others else at, np.int64)
                texts.append(stream(found))
                for n, v in zip(own, (row + i, d, held_out(d), len(found), len(texts[-1]), int(known_[common].sum()), float(base_[common].sum()), 0.0), strict=True):
                    own[n].append(v)
                rare["row"] += [row + i] * len(others)
                rare["token"] += others.keys()
                rare["times"] += others.values()
            total = np.zeros(len(texts))
            for key, i, lead in positions(iter(texts), depth, many=1 << TEXTS):
                pair = np.sort(key << TEXTS | i)  # a key and its text, in order: no place of a key needs to be found again
                first = _firsts(pair)
                times, pair = np.diff(np.append(first, len(pair))), pair[first]
                key, i = pair >> TEXTS, (pair & ((1 << TEXTS) - 1)) + lead
                first = _firsts(key)
                kind = key[first]
                at = np.minimum(np.searchsorted(key_, kind), max(len(key_) - 1, 0))
                hit = key_[at] == kind if len(key_) else np.zeros(len(kind), bool)
                lp = np.zeros(len(kind))
                lp[hit] = lp_[at[hit]]
                each = np.diff(np.append(first, len(key)))
                total += np.bincount(i, weights=np.repeat(lp, each) * times, minlength=len(texts))
                left = np.repeat(~hit, each)
                if left.any():
                    yield _batch(row=i[left] + row, key=key[left], times=times[left])
            own["lp"] = total
            yield _batch(**own)
            if rare["row"]:
                yield _batch(**rare)
            row += len(texts)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SEEN)


def score(docs: DataFrame, depth: int = DEPTH, common: int = COMMON, common_keys: int = COMMON_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, a row for each row of docs."""
    spark: SparkSession = docs.sparkSession
    with Scratch(spark) as scratch:
        with Scratch(spark) as model:
            keys = scratch.cut(train(docs, model, depth), "lm-keys")
        words = scratch.cut(token_counts(docs), "lm-tokens")
        total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
        floor = float(np.log10(total + 1 * (kinds + 1)))
        top = most_frequent(words, common).select("token", "c").toArrow()
        tokens_ = spark.sparkContext.broadcast((top["token"].to_pylist(), np.log10(top["c"].to_numpy() + 1.0) - floor, top["c"].to_numpy() > 0))
        top = most_frequent(keys, common_keys).select("key", "lp").toArrow()
        order = np.argsort(top["key"].to_numpy())
        keys_ = spark.sparkContext.broadcast((top["key"].to_numpy()[order], top["lp"].to_numpy()[order]))
        del top, order
        seen = scratch.cut(met(docs, tokens_, keys_, depth), "lm-texts")
        tokens_.destroy()
        keys_.destroy()
        by_token = seen.filter("token is not null").select("row", "token", "times").join(words.select("token", "c"), "token").select(
            "row", F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"), ((F.log10(F.col("c") + 1.0) - floor) * F.col("times")).alias("base"), F.lit(0.0).alias("lp"))
        by_key = seen.filter("key is not null").select("row", "key", "times").join(keys.select("key", F.col("lp").alias("each")), "key").select(
            "row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("each") * F.col("times")).alias("lp"))
        sums = [F.sum(c).alias(c) for c in ("known", "base", "lp")]
        rare = by_token.unionByName(by_key).groupBy("row").agg(*sums)
        none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_bytes")]
        parts = seen.filter("n_tokens is not null").select(*[n for n, _ in OWN]).unionByName(rare.select("row", *none, "known", "base", "lp"))
        done = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"), *sums)
        bits = -F.col("lp") * float(np.log2(10.0)) / F.col("n_bytes")
        return cut(
            done.select(
                "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score"),
                bits.alias("bits_per_byte"),
            ),
            "lm-scores",
        )


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
