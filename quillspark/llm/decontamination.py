"""Benchmark decontamination with an FM-index per training shard.

Test phrases are windows of 8 words (a shorter item is one window). A task cuts its documents into shards and indexes
each: words become numbers of the phrases' vocabulary, words outside it end a run (no phrase can cross them), runs shorter
than the shortest phrase are left out, and over the rest stand a suffix order, its Burrows-Wheeler transform in a wavelet
matrix, and every ``SAMPLE``-th suffix position. All phrases are searched backward at once through the matrix' ranks,
their rows are walked to the nearest sampled position, and the spans that they cover are merged for each document.

Phrases are held in blocks of at most ``BLOCK_WORDS`` words, each broadcast by itself. A worker that has several to go
through keeps one at a time, so that a large benchmark costs more passes over a shard and readings of blocks from the
executor's disk, not more memory.

Null and empty texts have no words, no hits and no items. Items without words (null, empty) have no phrases. A null
item_id counts as ''; rows that repeat an item_id are one item. Repeated documents are judged each for itself. Empty
tables of documents give no rows, empty benchmarks no hits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, free_name, in_arrow, read, texts_of

WINDOW, SAMPLE, SHARD_BYTES, BLOCK_WORDS, MIN_ITEMS = 8, 8, 16 << 20, 1_000_000, 2
WORD = re.compile(rb"[^\x20]+")


class WaveletMatrix:
    """Ranks of any symbol in any prefix of a sequence of small non-negative integers, for many queries at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            one = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            zeros = len(seq) - int(ones[-1])
            self.levels.append((level, ones, zeros))
            seq = np.concatenate([seq[one == 0], seq[one == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``end``."""
        start = np.zeros_like(end)
        for level, ones, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """The suffixes of ``seq`` in order, by prefix doubling; the end sorts before every symbol."""
    n, k = len(seq), 1
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        found, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        if len(found) == n or k >= n:
            return np.argsort(rank, kind="stable")
        k *= 2


class FMIndex:
    """Counts and places of phrases in ``seq``, whose symbols are 0 (a break) to ``top``. Within, all are one higher and
    a 0 that stands nowhere else ends the sequence: only so do steps back keep the order of equal symbols."""

    def __init__(self, seq: np.ndarray, top: int, sample: int = SAMPLE):
        seq = np.concatenate([seq + 1, [0]])
        order = suffix_order(seq)
        self.n = len(seq)
        self.bwt = seq[order - 1]
        self.matrix = WaveletMatrix(self.bwt, int(top + 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 2))])
        kept = order % sample == 0
        self.kept, self.kept_rank, self.places = kept, np.cumsum(kept) - 1, order[kept]

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.matrix.rank(symbol, row)

    def rows(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last row of each phrase; phrases stand at the right end of their rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1]):
            on = np.flatnonzero((lengths > j) & (low < high))
            if not len(on):
                break
            c = phrases[on, phrases.shape[1] - 1 - j] + 1
            low[on], high[on] = self._step(c, low[on]), self._step(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of each row, by steps back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        on = np.arange(len(rows))
        while len(on):
            done = self.kept[rows[on]]
            at = on[done]
            out[at] = self.places[self.kept_rank[rows[at]]] + steps[at]
            on = on[~done]
            rows[on] = self._step(self.bwt[rows[on]], rows[on])
            steps[on] += 1
        return out


class Phrases:
    """A block of items as windows over their own vocabulary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(number[item])
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.table = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.table[k, window - len(p) :] = p
        self.shortest = int(self.lengths.min()) if len(found) else 0
        owners = [sorted(x) for x in found.values()]
        self.owner_at = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.owners = np.array([x for own in owners for x in own], np.int64)

    def search(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """docs: their words as numbers of the vocabulary, 0 for any other. Hit words of all documents together, one
        break behind each document; and the (document, item) pairs."""
        seq = np.zeros(sum(map(len, docs)) + len(docs), np.int64)
        doc_of = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
        at = 0
        for d in docs:
            seq[at : at + len(d)] = d
            at += len(d) + 1
        none = np.empty(0, np.int64)
        inside = np.concatenate([[False], seq != 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts) or not self.shortest:
            return np.zeros(len(seq), bool), none, none
        size = ends - starts + 1  # each run with the break behind it
        place = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        index = FMIndex(seq[place], len(self.vocabulary))
        low, high = index.rows(self.table, self.lengths)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        word = place[index.locate(rows)]
        cover = np.zeros(len(seq) + 1, np.int64)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + self.lengths[which], -1)
        pairs = np.unique(doc_of[word] * len(self.lengths) + which)
        d, w = pairs // len(self.lengths), pairs % len(self.lengths)
        k = self.owner_at[w + 1] - self.owner_at[w]
        own = self.owners[np.repeat(self.owner_at[w] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())]
        both = np.unique(np.repeat(d, k) * len(self.items) + own)
        return np.cumsum(cover[:-1]) > 0, both // len(self.items), both % len(self.items)


def phrase_blocks(bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """The items' phrases, each block in a broadcast of its own; the driver holds one block at a time."""
    sc, out, block, size = bench.sparkSession.sparkContext, [], [], 0
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").where("text is not null")
    for r in rows.toLocalIterator():
        words = r["text"].encode().translate(WORD_TABLE).split()
        if block and size + len(words) > block_words:
            out.append(sc.broadcast(Phrases(block, window)))
            block, size = [], 0
        block.append((r["i"], words))
        size += len(words)
    return [*out, *([sc.broadcast(Phrases(block, window))] if block else [])]


def opened(blocks: list):
    """The blocks one after another. A broadcast's value stays with the worker once read: of several, each is let go, where
    the worker can read it from its file again (with encryption it can't)."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1 and getattr(b, "_path", None):
            del b._value


def spans_of(text: bytes, hit: np.ndarray) -> tuple[list[dict], str]:
    """Merged runs of hit words as code points, end exclusive, and the text without them."""
    places = [m.span() for m in WORD.finditer(text.translate(WORD_TABLE))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, rest, seen, chars = [], [], 0, 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        first, last = places[a][0], places[b - 1][1]
        rest.append(text[seen:first].decode())
        start = chars + len(rest[-1])
        chars, seen = start + len(text[first:last].decode()), last
        out.append({"start": start, "end": chars})
    return out, "".join([*rest, text[seen:].decode()])


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def contamination(docs: DataFrame, blocks: list, name: str = "found", rest: bool = False) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_hit, items (whose phrases occur, sorted as strings), spans; with
    ``rest`` also the text without its spans, null where it has none. A name that ``docs`` has gets underscores behind."""
    at, name = docs.columns.index("text"), free_name(docs, name)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *([("rest", pa.string())] if rest else [])])
    found_type = T.StructType([*FOUND.fields, *([T.StructField("rest", T.StringType())] if rest else [])])

    def shard(texts: list[bytes]) -> list[dict]:
        words = [None] * len(texts)
        hits, items = [None] * len(texts), [set() for _ in texts]
        for p in opened(blocks):
            get, docs_ = p.vocabulary.get, []
            for k, t in enumerate(texts):
                ids = np.array([get(w, 0) for w in t.translate(WORD_TABLE).split()], np.int64)
                words[k] = len(ids)
                docs_.append(ids)
            hit, d, i = p.search(docs_)
            for x, y in zip(d.tolist(), i.tolist(), strict=True):
                items[x].add(p.items[y])
            start = np.cumsum([0, *(len(x) + 1 for x in docs_)])
            for k in set(d.tolist()):
                own = hit[start[k] : start[k + 1] - 1]
                hits[k] = own if hits[k] is None else hits[k] | own
        out = []
        for k, t in enumerate(texts):
            spans, left = ([], None) if hits[k] is None else spans_of(t, hits[k])
            n = len(t.translate(WORD_TABLE).split()) if words[k] is None else words[k]
            out.append({"n_words": n, "n_hit": 0 if hits[k] is None else int(hits[k].sum()), "items": sorted(items[k]), "spans": spans} | ({"rest": left} if rest else {}))
        return out

    def run(batches):
        for b in batches:
            texts, found, part, size = texts_of(b.column(at)), [], [], 0
            for t in texts:
                if part and size + len(t) > SHARD_BYTES:
                    found += shard(part)
                    part, size = [], 0
                part.append(t)
                size += len(t)
            found += shard(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, name])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, found_type)]))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), phrase_blocks(read(spark, sf_dir, "benchmark")))
    n = F.size("found.items").cast("long")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", n.alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n >= MIN_ITEMS).alias("contaminated"), "found.spans",
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents (two or more items) go; passages of an item are cut from the others. Columns stay."""
    name = free_name(docs, "contamination")
    found = contamination(docs, phrase_blocks(read(spark, sf_dir, "benchmark")), name, rest=True).where(F.size(f"{name}.items") < MIN_ITEMS)
    rest = F.col(f"{name}.rest")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(rest.isNull(), F.col("n_chars")).otherwise(F.length(rest).cast(docs.schema["n_chars"].dataType)))
    return found.withColumn("text", F.coalesce(rest, "text")).drop(name)
