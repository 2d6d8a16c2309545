"""Similarity join of documents on n-gram sets by prefix trees, and the groups its links form.

A document's set holds 64-bit numbers of its distinct word n-grams. All sets are sorted in one global order: rare n-grams
first, by number; then the ``COMMON`` n-grams that most documents share, by frequency. Any order gives the same
result, this one gives few candidates. Documents of equal sets are one *node*, looked at once.

1. *Meetings.* Two sets that are similar enough share ``least_shared`` of their first ``n - ceil(t * n) + 1`` n-grams (half of
   these for large sets of like sizes), so that the rarest n-gram they share there has ``least_shared - 1`` more frequent
   ones beside it in either. Nodes need only meet under n-grams that far down. And what stands before a shared n-gram in the
   one set and in no other prefix is missing in the other set, so that few such may stand before the last of those
   ``least_shared``: that leaves each node a range of sizes (``sizes_met``), for most nodes none, whatever chance
   meetings a large corpus brings. What meets in this way, chained through, is a
   *block*: nodes of different blocks have no link. Under an n-gram chains are handed on, a link for each node, never pairs;
   under one of more than ``MANY`` nodes that is done by bands of sizes with DataFrame operations, so that no task gets them all.
2. *Trees.* The texts of a block come together once, in one task, and their sets are stored as paths in a compressed prefix tree
   (``joined``). One walk takes all probes down the tree, shares the overlap of a common beginning among all paths below it,
   and leaves a subtree with each probe whose overlap so far and shorter rest can't reach the bound, or that is already
   linked with all below. What leaves the task is one link for each node at most.
3. *Large blocks*: those of more than ``PART`` sets or ``ROOM`` n-grams are dealt to up to ``TILES`` tiles, any two of which meet
   in a task. Still larger ones are divided first. Each set becomes its difference from
   the block's centre, the n-grams that most of its sets hold; distances between sets stay the same by that, but what a
   group of near copies has in common is gone. Sets near enough are linked to the one nearest to the centre; any other set can
   only be similar to sets whose differences meet its own (``least_met``), which makes parts as in step 1. Where chains
   leave more than half of the block in one part, it is dealt by the n-grams of the differences, each of which less than
   half of the sets hold: a level down in a tree of n-grams. This goes on until all parts are small, which takes
   a number of levels that is the logarithm of the block's size; no link is lost and no pairs are made.

Null texts and texts without words have an empty set and link with nothing. A shorter text is one n-gram. Rows with
a null id take the group of equal sets, else null, and link nothing themselves. Rows that repeat an id are rows each;
where their texts differ, the id joins both groups. Ids may be of any type that has an order.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked, discard, each_text, in_arrow, read, written
from .components import components

NGRAM, PERCENT, COMMON = 3, 90, 1 << 19
MANY, PART, ROOM, TILES, FEW, CELLS, WIDTH = 4096, 512, 2_000_000, 16, 8, 8_000_000, 1.02
#: What makes near copies in the pipeline; ``NGRAM`` and ``PERCENT`` are those of op3.
STAGE_NGRAM, STAGE_PERCENT = 5, 80
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Grams:
    """Sets of n-gram numbers of texts. Words get their number once and are kept, up to ``room`` of them."""

    def __init__(self, n: int = NGRAM, room: int = 150_000):
        from xxhash import xxh3_64_intdigest

        class Numbers(dict):
            def __missing__(self, w):
                if len(self) >= room:
                    self.clear()
                x = self[w] = xxh3_64_intdigest(w)
                return x

        self.n, self.of, self.digest = n, Numbers(), xxh3_64_intdigest

    def set(self, text: bytes) -> np.ndarray:
        """Distinct, ascending; empty without words."""
        words = text.translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        x = np.array(list(map(self.of.__getitem__, words)), np.uint64)
        k = min(self.n, len(x))
        out = np.full(len(x) - k + 1, k, np.uint64) * MIX[0]
        for i in range(k):
            out = _mix(out * MIX[2] + x[i : len(x) - k + 1 + i])
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) > 1 else out

    def node(self, grams: np.ndarray) -> int:
        """A signed 64-bit number of a set."""
        x = self.digest(grams.tobytes())
        return x - (1 << 64) if x >> 63 else x


class Order:
    """The global order: n-grams by number, behind them the common ones by rising frequency."""

    def __init__(self, common: np.ndarray):
        self.by_number = np.argsort(common, kind="stable")
        self.common = common[self.by_number]

    def path(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.common) or not len(grams):
            return grams
        at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
        hit = self.common[at] == grams
        if not hit.any():
            return grams
        rank = self.by_number[at[hit]]
        return np.concatenate([grams[~hit], grams[hit][np.argsort(rank, kind="stable")]])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def least_shared(n, m, percent: int, floor=lambda x, y: x // y, both=np.minimum, one=np.maximum):
    """Prefix n-grams that sets of n and m have in common if they are similar enough; on arrays, or on columns with their functions."""
    ceil = lambda x, y: floor(x + (y - 1), y)
    need = ceil((n + m) * percent, 100 + percent)
    return one(both(need - ceil(n * percent, 100), need - ceil(m * percent, 100)) + 1, 1)


def _least_shared(n: "F.Column", m: "F.Column", percent: int) -> "F.Column":
    div = lambda x, y: F.floor(x / F.lit(y)).cast("long")
    return least_shared(n, m, percent, div, F.least, lambda x, y: F.greatest(x, F.lit(y)))


def sizes_met(n: np.ndarray, before: np.ndarray, alone: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest size of sets that may be similar to one of size n where the last prefix n-gram that both share has
    ``before`` n-grams up to it, itself included, that other prefixes have too, and ``alone`` that none has; least > largest: none.

    The ``alone`` ones aren't in the other set either, so that n - alone is all they can share; and it shares
    ``least_shared`` of the ``before`` ones at least. Rounded to the safe side."""
    q = 100 + percent
    most = (n - alone) * q // percent - n  # (n + m) * percent <= (n - alone) * q
    low, high = -(-percent * n // 100), 100 * n // percent
    upto = np.minimum(np.minimum(most, (before - 1 - (-percent * n // 100)) * q // percent - n), n)  # of those up to n
    above, top = np.maximum(n + 1, (100 * n * percent - 100 * before * q) // percent**2 - 1), np.minimum(most, high)
    small, large = low <= upto, above <= top
    return np.where(small, low, np.where(large, above, 1)), np.where(large, top, np.where(small, upto, 0))


def least_met(apart: np.ndarray, a: np.ndarray, least: np.ndarray, d: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams the difference (of size d) of a set of n from a centre must share with another one if their sets are
    similar and not both close to the block's nearest set. ``apart``: the set itself isn't; ``a``: as in ``joined``; ``least``:
    that of the nearest set.

    Similar sets share (a_x + a_y) / (2 q) with q = 100 + percent. If x is apart, a_y >= least; if x is close, y isn't, so that
    a_y > -least. And x and y differ in (100 - percent) / percent n at most, so that the rest of d is shared."""
    q = 2 * (100 + percent)
    bound = np.where(apart, -(-(a + least) // q), (a - least) // q + 1)
    return np.maximum(np.maximum(bound, d - (100 - percent) * n // percent), 1)


def joined(sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one (by number) that links reach.

    ``sets`` are sets, or their differences from one hub (``sizes``: of the sets themselves): x and y link if
    2 (100 + percent) |x & y| >= a_x + a_y with a = (100 + percent) |set| - (100 - percent) size."""
    m = len(sets)
    lengths = np.array([len(s) for s in sets], np.int64)
    a, twice = (100 + percent) * lengths - (100 - percent) * np.asarray(sizes, np.int64), 2 * (100 + percent)
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    _, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
    # n-grams of one set alone are only a length; the others in order, those of most sets first
    rank = np.full(len(counts), -1, np.int64)
    shared = np.flatnonzero(counts > 1)
    rank[shared[np.argsort(-counts[shared], kind="stable")]] = np.arange(len(shared))
    ends = np.cumsum(lengths)
    paths = []
    for lo, hi in zip(ends - lengths, ends, strict=True):
        p = rank[which[lo:hi]]
        paths.append(np.sort(p[p >= 0]))
    order = sorted(range(m), key=lambda i: paths[i].astype(">u4").tobytes())
    paths, a = [paths[i] for i in order], a[order]
    size = np.array([len(p) for p in paths], np.int64)
    common = np.zeros(m, np.int64)  # with the path before
    for i in range(1, m):
        k = min(size[i], size[i - 1])
        differ = np.flatnonzero(paths[i][:k] != paths[i - 1][:k])
        common[i] = differ[0] if len(differ) else k
    root, width = np.arange(m), max(1, len(shared))
    step = max(1, CELLS // width)
    for first in range(0, m, step):
        probes = range(first, min(m, first + step))
        has = np.zeros((len(probes), width), bool)
        for k, i in enumerate(probes):
            has[k, paths[i]] = True
        seen = np.cumsum(has, axis=1, dtype=np.int32)
        # a node of the tree: paths lo to hi - 1 share their first n-grams; probes come down with their overlap
        stack = [(0, m, 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while stack:
            lo, hi, start, on, overlap = stack.pop()
            end = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(size[lo])
            below = root[lo:hi]
            keep = on + first < hi - 1  # a pair is looked at from its earlier path
            if below[0] == below[-1] and (below == below[0]).all():
                keep &= root[on + first] != below[0]
            on, overlap = on[keep], overlap[keep]
            if not len(on):
                continue
            if end > start:
                edge = paths[lo][start:end]
                overlap = overlap + has[np.ix_(on, edge)].sum(1)
                rest = size[on + first] - seen[on, edge[-1]]
            else:
                rest = size[on + first] - (seen[on, paths[lo][end - 1]] if end else 0)
            rest = np.minimum(rest, int(size[lo:hi].max()) - end)
            keep = twice * (overlap + rest) >= a[on + first] + int(a[lo:hi].min())
            on, overlap = on[keep], overlap[keep]
            if not len(on):
                continue
            if hi - lo == 1:
                met = np.unique(np.append(root[on + first], root[lo]))
                if len(met) > 1:
                    root[np.isin(root, met)] = met[0]
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == end)).tolist(), hi]
            stack += [(x, y, end, on, overlap) for x, y in zip(cuts, cuts[1:], strict=False)]
    out = np.zeros(m, np.int64)
    at = np.array(order, np.int64)
    least = np.full(m, m, np.int64)
    np.minimum.at(least, root, at)
    out[at] = least[root]
    return out


def _order_of(docs: DataFrame, n: int) -> "np.ndarray":
    """Common n-grams by rising frequency, bounded by ``COMMON``."""
    at = docs.columns.index("text")

    def count(batches):
        grams = Grams(n)

        def flush(parts):
            x, c = np.unique(np.concatenate(parts), return_counts=True)
            x, c = x[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(c.astype(np.int64))], names=["g", "n"])

        parts, size = [], 0
        for b in batches:
            for t in each_text(b.column(at)):
                parts.append(grams.set(t))
                size += len(parts[-1])
                if size > 1_000_000:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    sums = in_arrow(docs, count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 8")
    rows = sums.orderBy(F.desc("n"), "g").limit(COMMON).toPandas()
    return rows["g"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def _ranked(met: DataFrame, key: list[str]) -> DataFrame:
    """With ``rank`` of an n-gram among those of the same ``key``: 1 is met most often."""
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("k"), "g")))


def _meetings(posts: DataFrame, percent: int) -> DataFrame:
    """(node, n, g, k, rank, lo, hi) from prefixes (node, n, pos, g), one for each node: n-grams that k > 1 of them have and under
    which a node may meet its like. ``rank``: as in ``_ranked``; lo to hi: the sizes of sets that it may be similar to."""
    shared = posts.withColumn("k", F.count("*").over(Window.partitionBy("g"))).where("k > 1")

    def run(batches):
        def rows(node, n, pos, g, k):
            """Of whole nodes, sorted by node and pos."""
            new = np.concatenate([[True], node[1:] != node[:-1]])
            starts, of = np.flatnonzero(new), np.cumsum(new) - 1
            before = np.arange(len(node)) - starts[of] + 1
            lo, hi = sizes_met(n, before, pos + 1 - before, percent)
            none = lo > hi
            lo = np.minimum.reduceat(np.where(none, np.iinfo(np.int64).max, lo), starts)[of]
            hi = np.maximum.reduceat(hi, starts)[of]
            # every shared n-gram, not only the last, has no more than the n-grams missing in the other set before it
            hi = np.minimum(hi, (n - (pos + 1 - before)) * (100 + percent) // percent - n)
            by = np.lexsort((g, -k, of))
            rank = np.empty(len(node), np.int64)
            rank[by] = before
            keep = lo <= hi
            x, y = np.where(keep, lo, n), np.where(keep, hi, n)
            # of the sizes in the range, the ends need least, but for rounding
            keep &= rank >= np.minimum(least_shared(n, x, percent), least_shared(n, y, percent)) - 2
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (node, n, g, k, rank, lo, hi)], names=["node", "n", "g", "k", "rank", "lo", "hi"])

        held = [np.empty(0, np.int64)] * 5
        for b in batches:
            held = [np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(held)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # where the node begins that may go on
            if last:
                yield rows(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield rows(*held)

    by_node = shared.select("node", "n", F.col("pos").cast("long").alias("pos"), "g", "k").repartition("node").sortWithinPartitions("node", "pos")
    return in_arrow(by_node, run, "node long, n long, g long, k long, rank long, lo long, hi long")


def _chained(met: DataFrame, percent: int, many: int, least) -> DataFrame:
    """(a, b): nodes that may be similar, chained under each n-gram, from rows (g, node, n, a, rank, lo, hi). ``least(n, m, a, b)``: how
    many n-grams similar sets must share; where that is so, the one met least often has that rank or a higher one in either.
    lo to hi: sizes that each of both must have for the other."""

    def chain(batches):
        def pairs(g, node, n, a, rank, lo, hi):
            """Of whole groups, sorted by g and n."""
            out_a, out_b = [], []
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sizes = np.diff(np.append(starts, len(g)))
            few = np.repeat(sizes <= FEW, sizes)

            def fits(i, j):
                like = (100 * n[i] >= percent * n[j]) & (lo[i] <= n[j]) & (n[j] <= hi[i]) & (lo[j] <= n[i]) & (n[i] <= hi[j])
                return like & (np.minimum(rank[i], rank[j]) >= least(n[i], n[j], a[i], a[j]))

            for d in range(1, min(FEW, len(g))):
                i = np.flatnonzero(few[:-d] & (g[:-d] == g[d:]))
                i = i[fits(i, i + d)]
                out_a.append(node[i])
                out_b.append(node[i + d])
            for at, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
                root = np.arange(size)
                for i in range(size - 1):
                    j = np.arange(i + 1, size)
                    j = j[: np.searchsorted(n[at + i + 1 : at + size], 100 * n[at + i] // percent, side="right")]
                    j = j[root[j] != root[i]]
                    j = j[fits(at + i, at + j)] if len(j) else j
                    if len(j):
                        touched = np.unique(np.append(root[j], root[i]))
                        root[np.isin(root, touched)] = touched[0]
                own = np.flatnonzero(root != np.arange(size))
                out_a.append(node[at + root[own]])
                out_b.append(node[at + own])
            both = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1) if out_a else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        held = [np.empty(0, np.int64)] * 7
        for b in batches:
            held = [np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(held)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # where the group begins that may go on
            if last > 100_000 or (last and len(held[0]) - last > many):
                yield pairs(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield pairs(*held)

    some = met.select("g", "node", "n", "a", F.col("rank").cast("long").alias("rank"), "lo", "hi")
    return in_arrow(some.repartition("g").sortWithinPartitions("g", "n", "node"), chain, "a long, b long")


def _chains(met: DataFrame, percent: int, many: int) -> DataFrame:
    """(a, b): nodes that may be similar, chained under each n-gram, from the rows of ``_meetings``."""
    plain = _chained(met.where(F.col("k") <= many).withColumn("a", F.lit(0).cast("long")), percent, many, lambda n, m, a, b: least_shared(n, m, percent))
    # for sizes of bands i and i + d, each ``WIDTH`` wide, the least that must be shared leaves each node under few n-grams
    rows = met.where(F.col("k") > many).withColumn("band", F.floor(F.log("n") / F.log(F.lit(WIDTH)) + 1e-9).cast("long"))
    most = int(math.log(100 / percent) / math.log(WIDTH)) + 2
    top = lambda band: F.floor(F.pow(F.lit(WIDTH), band + 1) + 1e-6).cast("long") + 1
    bottom = lambda band: F.greatest(F.floor(F.pow(F.lit(WIDTH), band) - 1e-6).cast("long"), F.lit(1).cast("long"))
    # rounding lets the bound for the farthest size of a band exceed that for a nearer one, by less than 2
    least = lambda x, y: F.greatest(_least_shared(x, y, percent) - 2, F.lit(1))
    n, d = F.col("n"), F.col("d")
    same = F.least(least(n, top(F.col("band"))), least(bottom(F.col("band")), n))
    dealt = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(most)).cast("array<bigint>")))
    like = lambda band: (F.col("lo") <= top(band)) & (F.col("hi") >= bottom(band))
    small = dealt.where(like(F.col("band") + d)).where(F.col("rank") >= F.when(d == 0, same).otherwise(least(n, top(F.col("band") + d)))).select("g", "band", "d", "node", F.lit(0).alias("side"))
    large = dealt.where((d > 0) & like(F.col("band") - d) & (F.col("rank") >= least(bottom(F.col("band") - d), n))).select("g", (F.col("band") - d).alias("band"), "d", "node", F.lit(1).alias("side"))
    key = ["g", "band", "d"]
    sides = small.union(large)
    first = sides.groupBy(*key).agg(F.min("node").alias("a"), F.min("side").alias("lo"), F.max("side").alias("hi")).where("d = 0 or lo < hi")
    hot = sides.join(first.select(*key, "a"), key).select("a", F.col("node").alias("b"))
    return plain.union(hot).where("a <> b").distinct()


GRAMS = T.ArrayType(T.LongType())


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as unsigned numbers."""
    values, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return [values[x:y] for x, y in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


def _array(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))


def _trees(rows: DataFrame, percent: int, ngram: int = 0) -> DataFrame:
    """(a, b): links that join what is similar in each block of rows (block, node, n, grams); blocks are small. With ``ngram``,
    of rows (block, node, text), whose sets of so many words are made where they meet, as texts take less room than sets."""

    def walk(batches):
        made = Grams(ngram) if ngram else None
        held: list[tuple[int, int, np.ndarray]] = []
        block = None

        def links():
            if len(held) < 2:
                return []
            root = joined(np.array([n for _, n, _ in held]), [s for _, _, s in held], percent)
            return [(held[r][0], held[i][0]) for i, r in enumerate(root.tolist()) if r != i]

        for b in batches:
            out = []
            sets = map(made.set, each_text(b.column(2))) if made else _lists(b.column(3))
            sizes = repeat(None) if made else b.column(2).to_pylist()
            for x, node, n, grams in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sizes, sets):  # noqa: B905
                if made and made.node(grams) != node:  # another text of a repeated id
                    continue
                if x != block:
                    out += links()
                    block, held = x, []
                if not held or held[-1][0] != node:
                    held.append((node, len(grams) if made else n, grams if made else grams.copy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        if out := links():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return in_arrow(rows.select("block", "node", *(["text"] if ngram else ["n", "grams"])).repartition("block").sortWithinPartitions("block", "node"), walk, "a long, b long")


def _sized(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(F.count("*").alias("sets"), F.sum("n_grams").alias("room"))


def _divided(rows: DataFrame, sizes: DataFrame, percent: int, many: int) -> tuple[DataFrame, DataFrame]:
    """Links to the nearest set of each (large) block of rows (block, node, n, grams), and the rows of its parts, each of
    half its size at most. ``sizes``: (block, sets)."""
    most = rows.select("block", F.explode("grams").alias("g")).groupBy("block", "g").agg(F.count("*").alias("k")).join(sizes.select("block", "sets"), "block")
    centre = most.where("2 * k > sets").groupBy("block").agg(F.sort_array(F.collect_list("g")).alias("centre"))

    def differ(batches):
        for b in batches:
            n = b.column(2).to_numpy()
            diff = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(_lists(b.column(3)), _lists(b.column(4)), strict=True)]
            a = (100 + percent) * np.array([len(x) for x in diff], np.int64) - (100 - percent) * n
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(a), _array(diff)], names=["block", "node", "n", "a", "grams"])

    both = rows.join(centre, "block", "left").select("block", "node", "n", "grams", F.coalesce("centre", F.array().cast(GRAMS)).alias("centre"))
    schema = T.StructType([*rows.select("block", "node", "n").schema.fields, T.StructField("a", T.LongType()), T.StructField("grams", GRAMS)])
    level = written(in_arrow(both, differ, schema), "level")
    nearest = level.groupBy("block").agg(F.min(F.struct("a", "node")).alias("nearest"))
    level = level.join(nearest, "block").withColumn("apart", F.col("a") + F.col("nearest.a") > 0)
    links = level.where("not apart and node <> nearest.node").select(F.col("nearest.node").alias("a"), F.col("node").alias("b"))
    some = level.select("block", "node", "n", "a", "apart", F.col("nearest.a").alias("least"), "grams")
    bound = F.pandas_udf(lambda x, a, m, d, n: pd.Series(least_met(*(c.to_numpy() for c in (x, a, m, d, n)), percent)), "long")
    posts = some.select("block", "node", "n", "a", "apart", bound("apart", "a", "least", F.size("grams").cast("long"), "n").alias("least"), F.explode("grams").alias("g"))
    shared = posts.groupBy("block", "g").agg(F.count("*").alias("k"), F.max("apart").alias("open")).where("k > 1 and open")
    met = _ranked(posts.join(shared.drop("open"), ["block", "g"]), ["block", "node"]).where("rank >= least")
    again = met.groupBy("block", "g").agg(F.count("*").alias("k"), F.max("apart").alias("open"), F.min("node").alias("first")).where("k > 1 and open")
    met = met.select("block", "node", "g", "n", "a", "rank").join(again.drop("open"), ["block", "g"])
    met = written(met.withColumns({"at": F.xxhash64("block", "node"), "under": F.xxhash64("block", "g")}), "meetings")
    # what meets, chained through, is a part; one that is still more than half of the block is dealt by each n-gram
    q = 2 * (100 + percent)
    any_size = F.lit(0).cast("long").alias("lo"), F.lit(1 << 62).alias("hi")
    some = met.where(F.col("k") <= many).select(F.col("under").alias("g"), F.col("at").alias("node"), "n", "a", "rank", *any_size)
    chains = _chained(some, percent, many, lambda n, m, a, b: -(-(a + b) // q))
    chains = chains.union(met.where(F.col("k") > many).select(F.xxhash64("block", "first").alias("a"), F.col("at").alias("b")))
    chained = components(chains).select(F.col("node").alias("at"), F.col("root").alias("part"))
    of = written(met.select("block", "node", "at").distinct().join(chained, "at").drop("at"), "parts")
    counts = of.groupBy("block", "part").agg(F.count("*").alias("n_part")).join(sizes.select("block", "sets"), "block")
    halves = of.join(counts.select("block", "part", (F.col("n_part") * 2 <= F.col("sets")).alias("half")), ["block", "part"])
    whole = halves.where("half").select("block", "node", "part")
    dealt = met.join(halves.where("not half"), ["block", "node"]).select("block", "node", F.col("under").alias("part"))
    parts = whole.union(dealt).join(level.select("block", "node", "n", "grams"), ["block", "node"])
    return links, parts.select(F.col("part").alias("block"), "node", "n", "grams")


def _resolved(rows: DataFrame, percent: int, many: int, part: int, room: int) -> DataFrame:
    """Links of the blocks of rows (block, node, n, grams), of whatever size."""
    found, level = None, rows.withColumn("n_grams", F.size("grams"))
    while True:
        level = written(level, "parts")
        tiles = F.ceil(F.greatest(F.col("sets") / F.lit(part), F.col("room") / F.lit(room)))
        sizes = written(_sized(level).where("sets > 1").withColumn("tiles", F.least(tiles, F.lit(TILES + 1)).cast("long")), "sizes")
        # blocks of a few times what a task takes: dealt to tiles, any two of which meet in one task
        of = level.join(sizes.where(F.col("tiles") <= TILES).select("block", "tiles"), "block").withColumn("i", F.pmod(F.xxhash64("node"), F.col("tiles")))
        other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: (j != F.col("i")) | (F.col("tiles") == 1))
        of = of.withColumn("j", F.explode(other)).withColumn("block", F.when(F.col("tiles") == 1, F.col("block")).otherwise(F.xxhash64("block", F.least("i", "j"), F.greatest("i", "j"))))
        small = _trees(of, percent)
        if done := sizes.where(F.col("tiles") > TILES).isEmpty():
            links = small
        else:
            large = written(level.join(sizes.where(F.col("tiles") > TILES).select("block"), "block").dropDuplicates(["block", "node"]), "large")
            links, parts = _divided(large, sizes, percent, many)
            links = links.union(small)
        links = written(links.distinct(), "links")
        found = links if found is None else found.union(links)
        if done:
            discard(level)
            return found
        level = parts.withColumn("n_grams", F.size("grams"))


def groups(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, many: int = MANY, part: int = PART, room: int = ROOM) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    order = spark.sparkContext.broadcast(Order(_order_of(docs, n)))  # bounded by COMMON

    def sign(batches):
        grams = Grams(n)
        for b in batches:
            size, node, prefix = [], [], []
            for t in each_text(b.column(1)):
                s = grams.set(t)
                size.append(len(s))
                node.append(grams.node(s))
                prefix.append(order.value.path(s)[: prefix_length(len(s), percent)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(node, pa.int64()), _array(prefix)], names=["doc_id", "n", "node", "prefix"])

    kinds = [docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("prefix", GRAMS)]
    prefixes = written(in_arrow(docs, sign, T.StructType(kinds)), "prefixes")
    order.destroy()
    signed = written(prefixes.drop("prefix"), "signed")
    usable = signed.where("doc_id is not null and n > 0")
    # a row for each prefix n-gram of each distinct set; n-grams that only one has find no partner
    alone = written(usable.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("n").alias("n")), "alone")
    # one row of each node; those of the nodes that several rows have are few and are sorted out by themselves
    several = written(alone.where("rows > 1").select("node", F.col("first").alias("doc_id")), "several")
    some = prefixes.where("doc_id is not null and n > 0").select("doc_id", "node", "n", "prefix")
    again = some.join(checked(several), ["node", "doc_id"], "left_semi").dropDuplicates(["node"])
    first = some.join(checked(several.select("node")), "node", "left_anti").unionByName(again)
    posts = first.select("node", "n", F.posexplode("prefix").alias("pos", "g"))
    met = written(_meetings(posts, percent), "met")
    chains = written(_chains(met, percent, many), "chains")
    blocks = components(chains).select("node", F.col("root").alias("block"))
    members = written(blocks.join(alone, "node").select("block", "node", F.col("first").alias("doc_id"), F.col("n").alias("n_grams")), "members")
    discard(prefixes, several, met, chains)
    # small blocks are gathered as texts; the sets of others are written, as tasks read them several times
    sizes = _sized(members).withColumn("small", F.expr(f"sets <= {part} and room <= {room}"))
    members = written(members.join(sizes.select("block", "small"), "block").select("block", "node", "doc_id", "small"), "members")

    def cut(batches):
        grams = Grams(n)
        for b in batches:
            sets = [grams.set(t) for t in each_text(b.column(2))]
            own = pa.array([grams.node(s) == x for s, x in zip(sets, b.column(1).to_pylist(), strict=True)])
            out = pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([len(s) for s in sets], pa.int64()), _array(sets)], names=["block", "node", "n", "grams"])
            yield out.filter(own)

    texts = lambda small: docs.join(checked(members.where("small" if small else "not small")), "doc_id").select("block", "node", "text")
    links = written(_trees(texts(True), percent, n), "links")
    if not members.where("not small").isEmpty():
        schema = T.StructType([*members.select("block", "node").schema.fields, T.StructField("n", T.LongType()), T.StructField("grams", GRAMS)])
        links = links.union(_resolved(in_arrow(texts(False), cut, schema), percent, many, part, room))
    # an id that repeats with different texts joins their groups
    twice = usable.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    twice = usable.join(twice, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    roots = components(links.union(twice))
    # nodes of one row that nothing links stand for themselves
    named = alone.join(roots, "node", "left").where("rows > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(named.join(least, "root").select("node", "component_id"), "named")
    out = signed.select("doc_id", "n", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word sets of a similarity of 0.8 or more) stays, that of the smallest
    id (rows that repeat it stay too); documents without an id or words stay. Columns stay."""
    found = groups(docs, STAGE_NGRAM, STAGE_PERCENT).where("n_shingles > 0 and doc_id <> component_id")
    gone = written(found.select("doc_id").distinct(), "gone")
    return docs.join(checked(gone), "doc_id", "left_anti").select(*docs.columns)
