"""Problem 3: records that recur with small edits, insertions or moved parts.

Method: signature trees. Every text has a token bitmap over its three-word shingles and a size; nodes hold the OR of
their children's bitmaps, their size range and their largest count of tokens hidden by bit collisions. A dual traversal
drops a pair of nodes when sizes or the largest possible overlap cannot reach the threshold. Nodes hold BITS bits; a text
has SPREAD bits for each shingle, by which the pairs of leaves are tested again: in BITS bits all long texts look alike,
and every pair of them that shares a window would be written and checked. One tree over the whole
collection would compare all pairs of leaves, so texts are first routed to shards: a shard holds the texts that share an
eight-word window (windows are picked by their hash, so both texts of a pair pick the same ones). Only ids travel to the
shards; shards that another one contains are dropped, and a bitmap is attached once for each text and shard that is left.
Trees of many shards are built and traversed together in numpy. Surviving pairs are checked on their exact shingle sets.

Skew: exact copies (equal shingle sets) are one class with a representative. Windows that heavy-hitter summaries find on
very many texts are salted before they are grouped; a shard of more than SHARD texts is cut into blocks by size, and only
blocks whose sizes can reach the threshold meet, so every text stays in the shards of all its windows.

Defined results: null ids, null and short texts (fewer than MIN_WORDS words) take part in no pair; repeated ids count
once; identical texts are pairs with similarity 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import distinct_in, windows, word_hashes
from corpusloom.operators.keys import measured_broadcast, one_per_key
from corpusloom.session import cut, cut_and_release

MIN_WORDS, SHINGLE, THRESHOLD = 50, 3, 0.6
ROUTE, ROUTE_LEAST = 8, 24  #: words of a routing window; windows that every text keeps at least
BITS = 1024
SPREAD = 2  #: bits of a text's own bitmap for each of its shingles, rounded up to BITS times a power of two
FAN = 8
MATRIX = 3  #: level whose pairs of nodes, if they hold MATRIX_PAIRS pairs of texts, are compared as matrices
MATRIX_PAIRS = 4096
SHARD = 1 << 15  #: texts of a shard; larger ones are cut into blocks of half the size, and each block travels once for each other one
HEAVY = SHARD  #: texts on a window from which it is salted before it is grouped
CLUSTER = 4096  #: pairs of a cluster in the exact check
COUNTERS = 1 << 16  #: counters of a heavy-hitter summary
FULL = 64  #: classes of up to so many copies are written out pair by pair; larger ones as links to their representative
SLICE = 1 << 17
LEAST = 8  #: a summary keeps smaller counts to itself
HELD = 1 << 17  #: rows that a task holds before it works on them


# --- texts to sizes, windows and bitmaps ---------------------------------------------------------------------------


def _shapes(texts: list[str | None], shingle: int, min_words: int) -> tuple[np.ndarray, ...]:
    h, n = word_hashes(texts)
    keep = n >= min_words
    sh, doc = distinct_in(*windows(h, n, shingle)[:2])
    ok = keep[doc]
    return h, n, keep, sh[ok], doc[ok]


def bitmaps(sh: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """(texts, BITS / 64) words of the token bitmaps."""
    bits = np.zeros((texts, BITS), np.uint8)
    bits[doc, ((sh >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


class Wide:
    """Bitmaps of a width that follows the text's size: uint64 words one text after the other, as many as words_of says."""

    def __init__(self, flat: np.ndarray, words: np.ndarray) -> None:
        self.flat, self.words = flat, words
        self.at = np.cumsum(words) - words

    @staticmethod
    def words_of(size: np.ndarray) -> np.ndarray:
        """Words of a bitmap over `size` shingles."""
        return (BITS // 64) << np.ceil(np.log2(np.maximum(1, SPREAD * size / BITS))).astype(np.int64)

    @classmethod
    def of(cls, sh: np.ndarray, doc: np.ndarray, size: np.ndarray) -> Wide:
        words = cls.words_of(size)
        out = cls(np.zeros(int(words.sum()), np.uint64), words)
        bit = (sh >> np.uint64(20)) % (np.uint64(64) * words.astype(np.uint64))[doc]
        np.bitwise_or.at(out.flat, out.at[doc] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        return out

    def folded(self, rows: np.ndarray, words: int) -> np.ndarray:
        """(rows, words): bitmaps of texts of `words` words or more, the wider ones folded to that width."""
        out = np.empty((len(rows), words), np.uint64)
        for w in np.unique(self.words[rows]):
            i = np.flatnonzero(self.words[rows] == w)
            out[i] = np.bitwise_or.reduce(self.flat[self.at[rows[i]][:, None] + np.arange(w)].reshape(len(i), -1, words), axis=1)
        return out

    def may_reach(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, t: float) -> np.ndarray:
        """Whether the bitmaps of the texts a and b leave it open that their overlap reaches t."""
        ok = np.ones(len(a), bool)
        least = np.minimum(self.words[a], self.words[b])
        for w in np.unique(least):
            if w == BITS // 64:  # that is what the tree has compared
                continue
            at = np.flatnonzero(least == w)
            for lo in range(0, len(at), max(1, SLICE * BITS // 64 // int(w) // 8)):
                i = at[lo : lo + max(1, SLICE * BITS // 64 // int(w) // 8)]
                x, y = self.folded(a[i], int(w)), self.folded(b[i], int(w))
                hidden = np.minimum(size[a[i]] - np.bitwise_count(x).sum(axis=1, dtype=np.int64), size[b[i]] - np.bitwise_count(y).sum(axis=1, dtype=np.int64))
                ok[i] = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64) + hidden >= t / (1 + t) * (size[a[i]] + size[b[i]]) - 1e-9
        return ok


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["src", "id", "c1", "c2", "n", "wins", "sig"]
    for whole in batches:
        for lo in range(0, whole.num_rows, 2000):
            b = whole.slice(lo, 2000)
            texts = b.column(2).to_pylist()
            h, n, keep, sh, doc = _shapes(texts, SHINGLE, MIN_WORDS)
            size = np.bincount(doc, minlength=len(n))
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
            c1, c2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(doc):
                c1[doc[starts]] = np.add.reduceat(sh, starts)
                c2[doc[starts]] = np.add.reduceat((sh ^ (sh >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ (sh >> np.uint64(7)), starts)
            rate = 2.0 ** np.floor(np.log2(np.maximum(size, ROUTE_LEAST) / ROUTE_LEAST))
            win, wdoc = distinct_in(*windows(h, n, ROUTE)[:2])
            ok = keep[wdoc] & (win % rate[wdoc].astype(np.uint64) == 0)
            win, wdoc = win[ok], wdoc[ok]
            wide = Wide.of(sh, doc, size)
            sig = [wide.flat[i : i + k].tobytes() for i, k in zip(wide.at[keep].tolist(), wide.words[keep].tolist())]
            offs = np.concatenate([[0], np.cumsum(np.bincount(wdoc, minlength=len(n))[keep])]).astype(np.int32)
            at = pa.array(keep)
            wins = pa.ListArray.from_arrays(pa.array(offs), pa.array(win.view(np.int64)))
            sigs = pa.array(sig, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(at), b.column(1).filter(at), pa.array(c1.view(np.int64)[keep]), pa.array(c2.view(np.int64)[keep]), pa.array(size[keep], pa.int32()), wins, sigs], names)


def describe(texts: DataFrame) -> DataFrame:
    """texts (src int, id bigint, text) to sizes, routing windows and bitmaps."""
    few = texts.filter("id is not null and text is not null").select("src", "id", "text")
    return few.mapInArrow(_describe, "src int, id bigint, c1 bigint, c2 bigint, n int, wins array<bigint>, sig binary")


# --- signature trees -----------------------------------------------------------------------------------------------


def _starts(group: np.ndarray) -> np.ndarray:
    """Where chunks of FAN nodes of one group begin; groups are contiguous."""
    new = np.r_[True, group[1:] != group[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    return np.flatnonzero((np.arange(len(group)) - first) % FAN == 0)


def tree_pairs(group: np.ndarray, size: np.ndarray, sig: np.ndarray, side: np.ndarray | None = None, t: float = THRESHOLD, wide: Wide | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that the dual traversal of each group's tree leaves; rows are sorted by group and size.

    side: if given, only pairs of different sides inside a group count. wide: if given, pairs of leaves have to pass it too.
    The traversal goes down slice by slice, so what it holds does not grow with the pairs of nodes.
    """
    hidden = size - np.bitwise_count(sig).sum(axis=1, dtype=np.int64)
    levels = [(group, size, size, sig, hidden, np.empty(0, np.int64))]
    while True:
        g, lo, hi, s, x, _ = levels[-1]
        at = _starts(g)
        if len(levels) > 1 and len(at) == len(g):
            break
        levels.append((g[at], lo[at], np.maximum.reduceat(hi, at), np.bitwise_or.reduceat(s, at, axis=0), np.maximum.reduceat(x, at), np.r_[at, len(g)]))
    first = [np.arange(len(size) + 1)]  # of every level: the first text of each node
    for level in levels[1:]:
        first.append(first[-1][level[5]])
    outs: list[tuple[np.ndarray, np.ndarray]] = []

    def leave(a: np.ndarray, b: np.ndarray) -> None:
        if wide is not None:
            ok = wide.may_reach(a, b, size, t)
            a, b = a[ok], b[ok]
        outs.append((a, b))

    def matrix(i: slice, j: slice) -> None:
        """The pairs of texts of two nodes; counts are whole numbers, exact in single precision."""
        x, y = (np.unpackbits(sig[r].view(np.uint8), axis=1).astype(np.float32) for r in (i, j))
        most = x @ y.T + np.minimum(hidden[i, None], hidden[None, j]).astype(np.float32)
        need = (t / (1 + t)) * (size[i, None] + size[None, j])
        ok = most >= need - 1e-9
        if side is not None:
            ok &= side[i, None] != side[None, j]
        a, b = np.nonzero(np.triu(ok, 1) if i == j else ok)
        leave(a + i.start, b + j.start)

    per = max(1, SLICE // (FAN * FAN))

    def down(k: int, a: np.ndarray, b: np.ndarray) -> None:
        """The children of the node pairs (a, b) of level k that may hold a pair of texts."""
        if k == MATRIX:
            f = first[k]
            large = (f[a + 1] - f[a]) * (f[b + 1] - f[b]) >= MATRIX_PAIRS
            for p, q in zip(a[large].tolist(), b[large].tolist()):
                matrix(slice(f[p], f[p + 1]), slice(f[q], f[q + 1]))
            a, b = a[~large], b[~large]
        edges = levels[k][5]
        _, lo, hi, s, x, _ = levels[k - 1]
        for i in range(0, len(a), per):
            pa_, pb_ = a[i : i + per], b[i : i + per]
            na, nb = edges[pa_ + 1] - edges[pa_], edges[pb_ + 1] - edges[pb_]
            each = np.repeat(np.arange(len(pa_)), na * nb)
            off = np.arange(len(each)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            ca, cb = edges[pa_][each] + off // nb[each], edges[pb_][each] + off % nb[each]
            ok = (ca < cb) if k == 1 else (ca <= cb)
            ca, cb = ca[ok], cb[ok]
            ok = (hi[ca] >= t * lo[cb]) & (hi[cb] >= t * lo[ca])
            if k == 1 and side is not None:
                ok &= side[ca] != side[cb]
            ca, cb = ca[ok], cb[ok]
            most = np.bitwise_count(s[ca] & s[cb]).sum(axis=1, dtype=np.int64) + np.minimum(x[ca], x[cb])
            ok = most >= t / (1 + t) * (lo[ca] + lo[cb]) - 1e-9
            ca, cb = ca[ok], cb[ok]
            if k > 1:
                down(k - 1, ca, cb)
            else:
                leave(ca, cb)

    roots = np.arange(len(levels[-1][0]))
    down(len(levels) - 1, roots, roots)
    a = np.concatenate([o[0] for o in outs]) if outs else np.empty(0, np.int64)
    b = np.concatenate([o[1] for o in outs]) if outs else np.empty(0, np.int64)
    return a, b


def _join_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, side, src, id, n, sig) sorted by shard to the pairs (src, a, b) that each shard's tree leaves."""

    def join(t: pa.Table) -> pa.RecordBatch:
        shard, side, src, ids, n = (t.column(i).to_numpy() for i in range(5))
        o = np.lexsort((n, shard))
        shard, side, src, ids, n = shard[o], side[o], src[o], ids[o], n[o].astype(np.int64)
        flat = np.frombuffer(b"".join(t.column(5).take(pa.array(o)).to_pylist()), np.uint64)
        wide = Wide(flat, Wide.words_of(n))
        sig = np.bitwise_or.reduceat(flat.reshape(-1, BITS // 64), wide.at // (BITS // 64), axis=0)
        cross = np.where(side < 0, -1 - np.arange(len(side)), side)  # inside one block every text is its own side
        a, b = tree_pairs(shard, n, sig, cross, wide=wide)
        lo, hi = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        p = np.unique(np.stack([src[a].astype(np.int64), lo, hi], axis=1), axis=0) if len(a) else np.empty((0, 3), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0], pa.int32()), pa.array(p[:, 1]), pa.array(p[:, 2])], ["src", "a", "b"])

    for t in _whole_groups(batches, HELD // 4):
        yield join(t)


def _whole_groups(batches: Iterator[pa.RecordBatch], held_rows: int = HELD) -> Iterator[pa.Table]:
    """Tables of about held_rows rows in which no value of the first column, by which rows are sorted, is cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= held_rows:
            t = pa.Table.from_batches(held)
            key = t.column(0).to_numpy()
            last = np.flatnonzero(key != key[-1])
            if len(last):
                end = int(last[-1]) + 1
                yield t.slice(0, end)
                rest = t.slice(end).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


# --- shards --------------------------------------------------------------------------------------------------------


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): heavy-hitter counters of a partition's windows, too low by a bounded amount; small ones stay here."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        more, n = np.unique(b.column(0).to_numpy(), return_counts=True)
        keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        if len(keys) > 2 * COUNTERS:
            counts -= np.partition(counts, len(counts) - COUNTERS - 1)[len(counts) - COUNTERS - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
    ok = counts >= LEAST
    yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), pa.array(counts[ok])], ["key", "n"])


def _blocks(src: int, ids: np.ndarray, n: np.ndarray, half: int) -> list[tuple[int, list[int], int]]:
    """A large shard as pairs of blocks (src, ids, how many of them belong to the first block; 0 where it is one)."""
    o = np.lexsort((ids, n))
    parts = [o[i : i + half] for i in range(0, len(o), half)]
    out = []
    for i, x in enumerate(parts):
        out.append((src, np.sort(ids[x]).tolist(), 0))
        out += [(src, ids[np.r_[x, y]].tolist(), len(x)) for y in parts[i + 1 :] if n[x[-1]] >= THRESHOLD * n[y[0]]]
    return out


def _group_windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, side, src, id, n) sorted by key to shards (src, ids, first) of two texts or more."""
    names = ["src", "ids", "first"]
    for t in _whole_groups(batches):
        key, side, src, ids, n = (t.column(i).to_numpy() for i in range(5))
        o = np.lexsort((ids, side, key))
        key, side, src, ids, n = key[o], side[o], src[o], ids[o], n[o]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        c = np.diff(np.r_[at, len(key)])
        plain = side[at] < 0
        small = plain & (c > 1) & (c <= most)
        rows = np.repeat(small, c)
        offs = np.r_[0, np.cumsum(c[small])].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(src[at[small]], pa.int32()), pa.ListArray.from_arrays(pa.array(offs), pa.array(ids[rows])), pa.array(np.zeros(small.sum(), np.int32))], names)
        for g in np.flatnonzero((c > 1) & ~small):
            r = slice(at[g], at[g] + c[g])
            if plain[g]:
                rest = _blocks(int(src[at[g]]), ids[r], n[r], max(1, most // 2))
            else:  # two salts of a heavy window
                first = int((side[r] == side[at[g]]).sum())
                rest = [(int(src[at[g]]), ids[r].tolist(), first)] if first < c[g] else []
            for x in rest:
                yield pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int32()), pa.array([x[1]], pa.list_(pa.int64())), pa.array([x[2]], pa.int32())], names)


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (least, src, ids, first) sorted by their least id: shards that another one with the same least id contains go.

    A text has a bounded number of windows, and so of shards of which it is the least.
    """
    for t in _whole_groups(batches, HELD // 16):
        least, src, ids = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (least[i], src[i], -len(ids[i])))
        kept: list[int] = []
        sets: list[set[int]] = []
        now = None
        for i in order:
            if now != (least[i], src[i]):
                now, sets = (least[i], src[i]), []
            mine = set(ids[i])
            if not any(mine <= s for s in sets):
                sets.append(mine)
                kept.append(i)
        yield from pa.table({"src": t.column(1), "ids": t.column(2), "first": t.column(3)}).take(pa.array(kept, pa.int64())).to_batches()


def shards(reps: DataFrame) -> DataFrame:
    """(src, ids, first): the texts that share a window; with first > 0 only pairs of one of the first ids and a later one count."""
    most, heavy_from = SHARD, HEAVY
    rows = reps.select(F.explode("wins").alias("win"), "src", "id", "n").select(F.xxhash64("src", "win").alias("key"), F.lit(-1).alias("side"), "src", "id", "n")
    heavy = rows.select("key").mapInArrow(_heavy, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > heavy_from)
    heavy = cut(heavy.select("key", F.ceil(F.col("n") / max(1, heavy_from // 2)).cast("int").alias("salts")))
    if heavy.count():
        hint = measured_broadcast(heavy)
        salted = rows.drop("side").join(hint, "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        salted = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        same = F.col("mine") == F.col("other")
        salted = salted.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), F.when(same, F.lit(-1)).otherwise(F.col("mine")).alias("side"), "src", "id", "n")
        rows = rows.join(hint, "key", "left_anti").select("key", "side", "src", "id", "n").unionByName(salted)
    grouped = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _group_windows(it, most), "src int, ids array<bigint>, first int")
    grouped = cut_and_release(grouped)
    one = grouped.filter("first = 0").select(F.col("ids")[0].alias("least"), "src", "ids", "first")
    largest = one.repartition("least", "src").sortWithinPartitions("least").mapInArrow(_largest, "src int, ids array<bigint>, first int")
    return grouped.filter("first > 0").unionByName(largest)


def candidates(reps: DataFrame) -> DataFrame:
    """(src, a, b), a < b: the pairs of representatives that their shards' trees leave."""
    each = cut_and_release(shards(reps).withColumn("shard", F.monotonically_increasing_id()))
    each = each.select("shard", "src", "first", F.posexplode("ids").alias("at", "id"))
    side = F.when(F.col("first") == 0, F.lit(-1)).otherwise((F.col("at") >= F.col("first")).cast("int"))
    rows = each.select("shard", side.alias("side"), "src", "id").join(reps.select("src", "id", "n", "sig"), ["src", "id"]).select("shard", "side", "src", "id", "n", "sig")
    sorted_ = rows.repartition("shard").sortWithinPartitions("shard")
    return sorted_.mapInArrow(_join_shards, "src int, a bigint, b bigint").distinct()


# --- exact check, classes ------------------------------------------------------------------------------------------


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, src, a, b, text) sorted by cluster, texts (b null) and pairs, to (src, a, b, similarity); a text is cut into shingles once."""
    for t in _whole_groups(batches, 4000):
        is_text = np.asarray(t.column(3).is_null())
        cluster, src, a = (t.column(i).to_numpy() for i in range(3))
        rows = t.filter(pa.array(is_text))
        _, n, _, sh, doc = _shapes(rows.column(4).to_pylist(), SHINGLE, MIN_WORDS)
        code = np.unique(sh, return_inverse=True)[1]
        edge = np.searchsorted(doc, np.arange(len(n) + 1))
        place = {k: i for i, k in enumerate(zip(cluster[is_text].tolist(), src[is_text].tolist(), a[is_text].tolist()))}
        pairs = t.filter(pa.array(~is_text))
        seen = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
        marked, size, out = None, 0, []
        for c, s, x, y in sorted(zip(*(pairs.column(i).to_pylist() for i in range(4)))):
            i, j = place[c, s, x], place[c, s, y]
            if marked != i:
                if marked is not None:
                    seen[mine] = False
                mine = code[edge[i] : edge[i + 1]]
                seen[mine] = True
                marked, size = i, len(mine)
            other = code[edge[j] : edge[j + 1]]
            both = int(np.count_nonzero(seen[other]))
            out.append((s, x, y, both / max(1, size + len(other) - both)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], ty) for k, ty in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.float64()))], ["src", "a", "b", "similarity"])


def clustered(pairs: DataFrame) -> DataFrame:
    """(cluster, src, a, b): the pairs with a cluster that most pairs of the same texts share; one of very many pairs is salted."""
    ends = pairs.select("src", F.col("a").alias("id"), F.col("b").alias("o")).union(pairs.select("src", "b", "a"))
    least = cut(ends.groupBy("src", "id").agg(F.least(F.min("o"), F.col("id")).alias("m")))
    ma, mb = least.select("src", F.col("id").alias("a"), F.col("m").alias("x")), least.select("src", F.col("id").alias("b"), F.col("m").alias("y"))
    named = cut(pairs.join(ma, ["src", "a"]).join(mb, ["src", "b"]).select("src", "a", "b", F.least("x", "y").alias("m")))
    large = cut(named.groupBy("src", "m").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > CLUSTER))
    salt = F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("c") / CLUSTER), F.lit(1)))
    return named.join(measured_broadcast(large), ["src", "m"], "left").select(F.xxhash64("src", "m", salt).alias("cluster"), "src", "a", "b")


class NearCopies:
    """The classes of equal texts and the links between their representatives; both are written tables.

    texts (src int, id bigint, text and, where rows are delivered again, at) counts every src and id once, by its latest `at`.
    """

    def __init__(self, texts: DataFrame, threshold: float = THRESHOLD) -> None:
        texts = one_per_key(texts.select("src", "id", "text", *(["at"] if "at" in texts.columns else [])), ["src", "id"], "at" if "at" in texts.columns else None)
        docs = cut_and_release(describe(texts))
        ids = docs.select("src", "id", "c1", "c2", "n")
        classes = ids.groupBy("src", "c1", "c2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k"))
        several = cut(classes.filter("k > 1"))
        #: (src, rep, id, k): the members of classes of more than one text
        self.members = cut(ids.join(measured_broadcast(several), ["src", "c1", "c2", "n"]).select("src", "rep", "id", "k"))
        copies = self.members.filter("id <> rep").select("src", "id")
        reps = docs.join(measured_broadcast(copies), ["src", "id"], "left_anti").select("src", "id", "n", "wins", "sig")
        pairs = cut_and_release(candidates(reps))
        wanted = cut(pairs.select("src", F.col("a").alias("id")).union(pairs.select("src", F.col("b").alias("id"))).distinct())
        some = texts.select("src", "id", "text").join(measured_broadcast(wanted), ["src", "id"], "left_semi")
        # a text goes once to each of its clusters; texts take less room than sets
        named = cut_and_release(clustered(pairs))
        places = named.select("cluster", "src", F.col("a").alias("id")).union(named.select("cluster", "src", "b")).distinct()
        rows = places.join(some, ["src", "id"]).select("cluster", "src", F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "text")
        rows = rows.unionByName(named.withColumn("text", F.lit(None).cast("string")).select("cluster", "src", "a", "b", "text"))
        checked = rows.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_similar, "src int, a bigint, b bigint, similarity double")
        #: (src, a, b, similarity): links between representatives
        self.links = cut_and_release(checked.filter(F.col("similarity") >= threshold - 1e-12))
        self.ids = ids.select("src", "id")

    def pairs(self) -> DataFrame:
        """(src, id_a, id_b): the pairs above the threshold.

        Classes of up to FULL copies are written out in full; a larger class as one link from each copy to the
        representative, and its links to other classes as one row for each copy: rows stay linear in copies and links.
        """
        m = self.members
        small, large = m.filter(F.col("k") <= FULL), m.filter(F.col("k") > FULL)
        x, y = small.select("src", "rep", F.col("id").alias("id_a")), small.select("src", "rep", F.col("id").alias("id_b"))
        within = x.join(y, ["src", "rep"]).filter("id_a < id_b").select("src", "id_a", "id_b")
        star = large.filter("id <> rep").select("src", F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
        links = self.links.select("src", "a", "b")
        ma, mb = m.select("src", F.col("rep").alias("a"), F.col("id").alias("ia"), F.col("k").alias("ka")), m.select("src", F.col("rep").alias("b"), F.col("id").alias("ib"), F.col("k").alias("kb"))
        fa, fb = ma.filter(F.col("ka") <= FULL), mb.filter(F.col("kb") <= FULL)
        full = links.join(fa, ["src", "a"], "left").join(fb, ["src", "b"], "left").select("src", F.coalesce("ia", "a").alias("p"), F.coalesce("ib", "b").alias("q"))
        more = links.join(ma.filter(F.col("ka") > FULL), ["src", "a"]).select("src", F.col("ia").alias("p"), F.col("b").alias("q")).unionByName(
            links.join(mb.filter(F.col("kb") > FULL), ["src", "b"]).select("src", F.col("a").alias("p"), F.col("ib").alias("q")))
        cross = full.unionByName(more).select("src", F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
        return within.unionByName(star).unionByName(cross).distinct()

    def groups(self) -> DataFrame:
        """(src, id, class_id, links): the connected group of every text and the number of its representative's links."""
        label = components(self.links.select("src", "a", "b"))
        degree = self.links.select("src", F.col("a").alias("rep")).union(self.links.select("src", F.col("b").alias("rep"))).groupBy("src", "rep").agg(F.count(F.lit(1)).alias("links"))
        rep = self.ids.join(self.members.select("src", "id", "rep"), ["src", "id"], "left").withColumn("rep", F.coalesce("rep", "id"))
        out = rep.join(label.withColumnRenamed("id", "rep"), ["src", "rep"], "left").join(degree, ["src", "rep"], "left")
        return out.select("src", "id", F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(src, id, label): the least id of the connected group of every end of an edge, by alternating stars; rounds are written tables."""
    e = cut(edges.select("src", F.col("a").alias("u"), F.col("b").alias("v")))
    while True:
        both = e.union(e.select("src", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("src", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(least, ["src", "u"]).filter("v > u").select("src", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        down = large.select("src", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("src", "u").agg(F.min("v").alias("m"))
        small = down.join(low, ["src", "u"]).select("src", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("src", "u", F.col("m").alias("v"))).distinct()
        nxt = cut(small)
        same = nxt.count() == e.count() and not nxt.exceptAll(e).take(1)
        e = nxt
        if same:
            break
    return e.select("src", F.col("u").alias("id"), F.col("v").alias("label")).union(e.select("src", F.col("v").alias("id"), F.col("v").alias("label"))).groupBy("src", "id").agg(F.min("label").alias("label"))


SOURCES = ("scraped_pages", "doc_records")


def texts(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Both tables as (src, id, text, at)."""
    return pages.select(F.lit(0).alias("src"), F.col("page_id").alias("id"), F.col("content").alias("text"), F.col("loaded_at").alias("at")).unionByName(
        records.select(F.lit(1).alias("src"), F.col("row_id").alias("id"), "text", F.lit(None).cast("timestamp").alias("at")))


def _name(src: Column) -> Column:
    return F.when(src == 0, F.lit(SOURCES[0])).otherwise(F.lit(SOURCES[1]))


def found(pages: DataFrame, records: DataFrame) -> DataFrame:
    return NearCopies(texts(pages, records)).pairs().withColumn("src", _name(F.col("src")))


def groups(pages: DataFrame, records: DataFrame) -> DataFrame:
    return NearCopies(texts(pages, records)).groups().withColumn("src", _name(F.col("src")))
