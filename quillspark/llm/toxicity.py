"""Toxicity by the nearest labelled examples.

Exact TF-IDF cosine through a block-max inverted index; distance-weighted votes, calibrated on leave-one-out votes, give
the score and the evidence.

* The examples are a bounded sample (``per_class`` of each label, the smallest hashes of the ids), the only thing that
  is sent to every task. Terms are words and the 4- and 5-byte beginnings of longer words. All terms of the examples span the
  space; none is left out. A term's idf is multiplied by ``FLOOR`` plus how surely it is more frequent in toxic examples (0 to
  1, half at a chi-square of ``SURE``), so that what marks toxic texts outweighs what they are about.
* The index has postings for each term, in blocks of ``BLOCK`` like examples (parted along their main directions), and
  the largest weight of each term in each block. Bounds of all blocks come from these maxima; the ``FIRST`` blocks of the
  highest bounds are scored, then all blocks whose bound reaches the k-th best cosine so far, so that what is
  returned is exact.
* Null and empty texts, and texts with no term of the examples, have no neighbour; they get the calibrated share of toxic
  examples among labelled texts of that kind. Ties in cosine go to the lower example number. With no usable label, or
  labels of one class only, each score is that class's share (0 without any label). Repeated rows are scored each; of examples
  that repeat an id one counts, and where labels of an id differ it is toxic. Empty tables give no rows. Ids may be of any type.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, arrow_table, crc_fold, free_name, give_back, in_arrow, read, texts_of

PER_CLASS, NEIGHBOURS, BLOCK, FIRST, OFTEN, FLOOR, SURE, THRESHOLD, GROUP, WORDS, SLICE = 1500, 31, 128, 2, 0.07, 0.05, 25.0, 0.7, 32, 200_000, 512


def terms_of_word(w: bytes) -> list[bytes]:
    return [w, *(w[:n] + b"*" for n in (4, 5) if len(w) > n)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same from start[1], and so on."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def like_order(rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> np.ndarray:
    """An order of the vectors in which like ones stand together: parted again and again at the middle of their main direction."""
    sizes = np.array([len(t) for t, _ in rows], np.int64)
    start = np.cumsum(sizes) - sizes
    terms, weights = (np.concatenate([np.empty(0, k), *(r[i] for r in rows)]) for i, k in ((0, np.int32), (1, np.float64)))
    out, todo = [], [np.arange(len(rows))]
    while todo:
        part = todo.pop()
        if len(part) <= block:
            out.append(part)
            continue
        at = _ranges(start[part], sizes[part])
        t, w, own = terms[at], weights[at], np.repeat(np.arange(len(part)), sizes[part])
        mean = np.bincount(t, w, n_terms) / len(part)
        x = np.cos(np.arange(len(part)))  # any start; the mean is taken out, so that the next direction isn't what all share
        for _ in range(8):
            v = np.bincount(t, w * x[own], n_terms) - x.sum() * mean
            x = np.bincount(own, w * v[t], len(part)) - mean @ v
            x /= max(np.linalg.norm(x), 1e-12)
        part = part[np.argsort(x, kind="stable")]
        middle = -(-len(part) // (2 * block)) * block
        todo += [part[middle:], part[:middle]]
    return np.concatenate([np.empty(0, np.int64), *out])


class BlockMaxIndex:
    """Postings (example, weight) by term and block, and the largest weight of each term in each block. Terms of more than
    ``OFTEN`` of the examples are rows with a weight for each example; they are summed up first, so that a block's bound is
    the most that its examples have so far and the maxima of the other terms."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.size, self.block, self.n_blocks = len(rows), block, max(1, -(-len(rows) // block))
        term = np.concatenate([np.empty(0, np.int32), *(t for t, _ in rows)])
        weight = np.concatenate([np.empty(0), *(w for _, w in rows)])
        example = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t, _ in rows])
        # terms of many examples as whole rows, the others as postings
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) > OFTEN * len(rows))
        self.row = np.full(n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(rows)), np.float32)
        full = self.row[term] >= 0
        self.dense[self.row[term[full]], example[full]] = weight[full]
        term, weight, example = term[~full], weight[~full], example[~full]
        self.first = np.arange(0, max(1, len(rows)), block)
        by = np.lexsort((example, term))
        term, self.weight, self.example = term[by], weight[by], example[by]
        del by, full, weight, example
        part = term.astype(np.int64) * self.n_blocks + self.example // block
        self.start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
        self.length = np.diff(np.append(self.start, len(part)))
        self.largest = np.maximum.reduceat(self.weight, self.start) if len(part) else np.empty(0)
        self.of_block = (part[self.start] % self.n_blocks).astype(np.int64)
        self.at = np.searchsorted(part[self.start] // self.n_blocks, np.arange(n_terms + 1))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of largest positive cosine, ties by number; ``skip`` names one to leave out of each.

        Terms of many examples are one product for ``GROUP`` queries. The product is always of that many rows, so that what
        a query gets doesn't depend on those beside it."""
        out = []
        for at in range(0, len(queries), GROUP):
            group = queries[at : at + GROUP]
            weights = np.zeros((GROUP, len(self.dense)), np.float32)
            for i, (t, w) in enumerate(group):
                row = self.row[t]
                weights[i, row[row >= 0]] = w[row >= 0]
            summed = weights @ self.dense
            out += [self._nearest(*q, c.astype(float), k, skip[at + i] if skip else -1) for i, (q, c) in enumerate(zip(group, summed, strict=False))]
        return out

    def _nearest(self, terms: np.ndarray, w: np.ndarray, cosine: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        if skip >= 0:
            cosine[skip] = 0.0
        few = self.row[terms] < 0
        terms, w = terms[few], w[few]
        size = self.at[terms + 1] - self.at[terms]
        entry, query = _ranges(self.at[terms], size), np.repeat(w, size)
        block = self.of_block[entry]
        bound = np.maximum.reduceat(cosine, self.first) + np.bincount(block, self.largest[entry] * query, self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        worst = 0.0
        for now in (order[:FIRST], order[FIRST:]):
            on = np.zeros(self.n_blocks, bool)
            on[now[bound[now] + 1e-6 >= worst]] = True
            pick = on[block]
            length = self.length[entry[pick]]
            place = _ranges(self.start[entry[pick]], length)
            cosine += np.bincount(self.example[place], self.weight[place] * np.repeat(query[pick], length), self.size)
            if skip >= 0:
                cosine[skip] = 0.0
            if len(cosine) > k:
                worst = float(np.partition(cosine, -k)[-k])
        hit = np.flatnonzero(cosine > 0) if worst <= 0 else np.flatnonzero(cosine >= worst)
        best = hit[np.lexsort((hit, -cosine[hit]))[:k]]
        return best, cosine[best]


class Model:
    """What ``fit`` learns. ``ids``, ``y``: the examples and their labels; ``rows``: numbers and counts of their terms in ``names``,
    a list that is empty afterwards, as the vectors take its place in memory."""

    def __init__(self, ids: list, y: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], names: list[bytes], share: float, k: int = NEIGHBOURS):
        self.k, n = k, len(ids)
        n1 = int(y.sum())
        n0 = n - n1
        self.trivial = None if n0 and n1 else float(n1 > 0)
        # each example stands for as many documents as its class was thinned by
        self.mass = np.where(y == 1, share / max(n1, 1), (1 - share) / max(n0, 1)) * n
        of = lambda label: np.bincount(np.concatenate([np.empty(0, np.int32), *(t for (t, _), v in zip(rows, y, strict=True) if v == label)]), minlength=len(names))
        a, b = of(1).astype(float), of(0).astype(float)
        c, d = n1 - a, n0 - b
        chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1)
        sure = np.where(a * n0 > b * n1, chi2**4 / (chi2**4 + SURE**4), 0.0)
        self.term = {t: i for i, t in enumerate(names)}
        self.weight = (np.log((1 + n) / (1 + a + b)) + 1) * (FLOOR + sure)
        vectors = [self.weigh(t, m) for t, m in rows]
        rows.clear()
        order = like_order(vectors, len(names))
        self.y, self.mass, self.ids, vectors = y[order], self.mass[order], [ids[i] for i in order], [vectors[i] for i in order]
        self.index = BlockMaxIndex(vectors, len(names))
        none = np.array([not len(v[0]) for v in vectors], bool)
        self.bare = float((self.mass * self.y)[none].sum() + share) / float(self.mass[none].sum() + 1)
        self.slope, self.shift = 1.0, 0.0
        if self.trivial is None:
            votes = np.array([self.vote(*v) for v in self.index.nearest(vectors, self.k, list(range(len(vectors))))])
            self.slope, self.shift = platt(votes, self.y, self.mass)
        self.forget()

    def forget(self) -> None:
        """Words that hold terms are numbered as they come; row n of ``of_word`` has the terms of word n, row 0 none. ``WORDS`` words
        are kept, 0 for those without a term."""
        self.number: dict[bytes, int] = {}
        self.numbered = 0
        self.of_word = np.full((1024, 3), len(self.term), np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "numbered", "of_word")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def _learn(self, word: bytes) -> int:
        found = [self.term[t] for t in terms_of_word(word) if t in self.term]
        if not found:
            self.number[word] = 0
            return 0
        self.numbered += 1
        if self.numbered >= len(self.of_word):
            self.of_word = np.concatenate([self.of_word, np.full_like(self.of_word, len(self.term))])
        self.of_word[self.numbered, : len(found)] = found
        self.number[word] = self.numbered
        return self.numbered

    def weigh(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A vector of length 1, by ascending term."""
        by = np.argsort(t, kind="stable")
        t = t[by]
        w = (1 + np.log(counts[by])) * self.weight[t]
        return t, w / max(float(np.linalg.norm(w)), 1e-12)

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        if not len(ids):
            return self.bare
        w = sims / (1.05 - np.minimum(sims, 1)) * self.mass[ids]
        return float((w * self.y[ids]).sum() / w.sum())

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = Counter(text.translate(WORD_TABLE).split())
        if len(self.number) >= WORDS:
            self.forget()
        number = [self.number.get(w, -1) for w in words]
        if -1 in number:
            number = [self._learn(w) if n < 0 else n for w, n in zip(words, number, strict=True)]
        terms = self.of_word[number].reshape(-1)
        counts = np.repeat(np.fromiter(words.values(), np.int64, len(words)), 3)
        real = terms < len(self.term)
        terms, at = np.unique(terms[real], return_inverse=True)
        return self.weigh(terms, np.bincount(at, counts[real], len(terms)))

    def scores(self, texts: list[bytes]) -> list[tuple[float, list]]:
        """For each text its score and the ids of the examples that spoke for it, nearest first."""
        if self.trivial is not None:
            return [(self.trivial, [])] * len(texts)
        out = []
        for at in range(0, len(texts), GROUP):
            for ids, sims in self.index.nearest([self.vector(t) for t in texts[at : at + GROUP]], self.k):
                x = self.slope * logit(self.vote(ids, sims)) + self.shift
                out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), [self.ids[i] for i in ids]))
        return out


def logit(p):
    p = np.clip(p, 0.001, 0.999)
    return np.log(p / (1 - p))


def platt(votes: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the votes, by damped Newton steps; a small ridge pulls to (1, 0)."""
    x, (a, b) = logit(votes), (1.0, 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = mass * (p - y), mass * p * (1 - p)
        g = np.array([r @ x + (a - 1), r.sum() + b])
        m = np.array([[h @ (x * x) + 1, h @ x], [h @ x, h.sum() + 1]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 0.05), b


def fit(docs: DataFrame, labels: DataFrame, train: "F.Column | None" = None, per_class: int = PER_CLASS, label: str = "toxic") -> Model:
    """Learns from ``labels`` (doc_id, ``label``) and the texts of ``docs``. ``train``: a condition on doc_id."""
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(train) if train is not None else known
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    take = pa.concat_tables([known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).toArrow() for y in (0, 1)])
    if not len(take):
        return Model([], np.empty(0), [], [], 0.0)
    some = arrow_table(spark, take, T.StructType([known.schema["doc_id"], T.StructField("y", T.IntegerType())]))
    wanted = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # 2 * per_class rows of two numbers

    def count(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            cs = [Counter(t.translate(WORD_TABLE).split()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(2), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                    pa.array([list(c.keys()) for c in cs], pa.list_(pa.binary())), pa.array([list(c.values()) for c in cs], pa.list_(pa.int32())),
                ],
                names=["doc_id", "y", "mark", "t", "n"],
            )

    kinds = T.StructType([wanted.schema["doc_id"], *T.StructType.fromDDL("y int, mark binary, t array<binary>, n array<int>").fields])
    found = in_arrow(wanted.select("doc_id", "text", "y"), count, kinds).toArrow()
    order = found.select(["doc_id", "mark"]).append_column("at", pa.array(range(len(found)))).sort_by([("doc_id", "ascending"), ("mark", "ascending")])
    number: dict[bytes, int] = {}
    ids, y, rows = [], [], []
    for i, at in zip(order["doc_id"].to_pylist(), order["at"].to_pylist(), strict=True):
        if ids and ids[-1] == i:
            continue  # of rows that repeat an id one, always the same
        tf: Counter = Counter()
        for w, m in zip(found["t"][at].as_py(), found["n"][at].as_py(), strict=True):
            for t in terms_of_word(w):
                tf[number.setdefault(t, len(number))] += m
        ids.append(i)
        y.append(found["y"][at].as_py())
        rows.append((np.fromiter(tf.keys(), np.int32, len(tf)), np.fromiter(tf.values(), np.int32, len(tf))))
    names = list(number)
    del found, order, number
    model = Model(ids, np.array(y, float), rows, names, total.get(1, 0) / sum(total.values()))
    give_back()  # the driver's Python too keeps what is freed, several times the model
    return model


def scored(docs: DataFrame, model: Model, score: str = "score", evidence: str | None = "evidence") -> DataFrame:
    """``docs`` with its score, and if asked for the ids of the nearest examples; a name that ``docs`` has gets underscores behind."""
    score, evidence = free_name(docs, score), evidence and free_name(docs, evidence)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the terms of 2 * per_class examples
    at = docs.columns.index("text")
    kind = docs.schema["doc_id"].dataType if "doc_id" in docs.columns else T.LongType()
    fields = [T.StructField(score, T.DoubleType())] + ([T.StructField(evidence, T.ArrayType(kind))] if evidence else [])
    as_ids = pa.list_(docs.select("doc_id").limit(0).toArrow().schema.field(0).type) if evidence else None

    def run(batches):
        m = shared.value
        for b in batches:
            got = [x for k in range(0, b.num_rows, SLICE) for x in m.scores(texts_of(b.column(at).slice(k, SLICE)))]
            cols = [pa.array([g[0] for g in got], pa.float64())] + ([pa.array([g[1] for g in got], as_ids)] if evidence else [])
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *(f.name for f in fields)])
        m.forget()

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, *fields]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"), train=crc_fold("doc_id") != 1)
    return scored(docs, model).select(
        "doc_id", (crc_fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence"
    )


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold, with the columns they came with."""
    name = free_name(docs, "toxicity_score")
    clean = scored(docs, fit(docs, read(spark, sf_dir, "labels")), name, None).where(F.col(name) < THRESHOLD).drop(name)
    give_back()  # the model, which the broadcast has in a file; later stages need the room
    return clean
