"""Fuzzy top-k join (RO-10): Ratcliff-Obershelp ratio of subjects to the summaries of a reference table.

The reference table is collected in blocks of at most ``BLOCK`` rows, each broadcast by itself, of which a worker holds one at
a time; every subject keeps its best ``top`` while the blocks go by, so that a larger table costs time, not memory. Bounds from lengths and from letter counts,
which no ratio exceeds, spare most comparisons; those that remain give up once what is left can't reach the ratio asked for. Ties
keep the order of the table, as a stable sort does.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 20_000
#: Letters are counted by their code's remainder; letters that share one only loosen a bound.
LETTERS = 128
#: Stands for letters too frequent in a summary to begin a match; no character of Unicode text.
POPULAR = "\U0010ffff"
PIECE = 6


def _counts(texts: list[str]) -> np.ndarray:
    code = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS
    return np.stack([np.bincount(code(s), minlength=LETTERS) for s in texts]).astype(np.int32)


def seeds(r: str) -> str:
    """``r`` with the letters from which difflib starts no match, those of more than 1 % of 200 letters or more, blotted out."""
    if len(r) < 200:
        return r
    return r.translate({ord(c): POPULAR for c, k in Counter(r).items() if k > len(r) // 100 + 1})


def shares(s: str, pieces: set[str], r: str, least: int) -> bool:
    """Whether ``s`` and ``r`` have a run of ``least`` letters or more in common (true if ``least`` is under ``PIECE``). ``pieces``:
    all of ``PIECE`` letters in ``s``. A run of ``r`` holds one of its pieces that stand ``least - PIECE + 1`` apart."""
    if least < PIECE:
        return True
    for i in range(0, len(r) - PIECE + 1, least - PIECE + 1):
        if r[i : i + PIECE] in pieces and any(r[a : a + least] in s for a in range(max(0, i + PIECE - least), min(i, len(r) - least) + 1)):
            return True
    return False


def ratio(s: str, r: str, seed: str, floor: float) -> float:
    """``SequenceMatcher(None, s, r).ratio()``, exactly where that is ``floor`` or more, else that or 0. ``seed``: ``seeds(r)``.

    As there, the longest run of letters of ``seed`` in both, the first in ``s`` and then in ``r``, is made longer by what is
    equal around it, and the parts before and behind it are treated alike. A run is found by looking for ever longer pieces of
    ``s``, which strings do fast; parts not yet treated count as if all of the shorter one matched."""
    total, found, left = len(s) + len(r), 0, min(len(s), len(r))
    if POPULAR in s:
        seed = seed.replace(POPULAR, "\0" if "\0" not in s else next(c for c in map(chr, range(0xE000, 0x10FFFF)) if c not in s and c not in seed))
    parts = [(0, len(s), 0, len(r))] if left else []
    while parts:
        if 2.0 * (found + left) / total < floor:
            return 0.0
        alo, ahi, blo, bhi = parts.pop()
        left -= min(ahi - alo, bhi - blo)
        part, k, i = seed[blo:bhi], 0, alo
        for at in range(alo, ahi):
            end = at + k + 1
            if end > ahi:
                break
            if s[at:end] in part:
                k, i, end = k + 1, at, end + 1
                while end <= ahi and s[at:end] in part:
                    k, end = k + 1, end + 1
        j = blo + part.index(s[i : i + k]) if k else blo
        while i > alo and j > blo and s[i - 1] == r[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and s[i + k] == r[j + k]:
            k += 1
        if k:
            found += k
            if alo < i and blo < j:
                parts.append((alo, i, blo, j))
                left += min(i - alo, j - blo)
            if i + k < ahi and j + k < bhi:
                parts.append((i + k, ahi, j + k, bhi))
                left += min(ahi - i - k, bhi - j - k)
    return 2.0 * found / total if total else 1.0


def similar(docs: DataFrame, reference: DataFrame, key: str, text: str, top: int = 3, least: float = 0.45) -> DataFrame:
    """(key, rank, ref_id, ratio). ``reference``: (ord, id, summary), ord its order. Null and empty texts find nothing;
    white space runs of a subject count as one space, those of a summary as they are."""
    sc, blocks, block = docs.sparkSession.sparkContext, [], []
    for r in reference.select("ord", "id", "summary").orderBy("ord").toLocalIterator():
        if s := (r["summary"] or "").lower():
            block.append((r["id"], s))
        if len(block) == BLOCK:
            blocks.append(sc.broadcast(block))
            block = []
    blocks += [sc.broadcast(block)] if block else []

    def run(batches):
        for pdf in batches:
            subjects = [" ".join((t or "").lower().split()) for t in pdf[text]]
            best: list[list[tuple[float, int, object]]] = [[] for _ in subjects]
            before = 0
            for b in blocks:
                refs = sorted((len(r), -before - n, i, r, seeds(r)) for n, (i, r) in enumerate(b.value))
                before += len(refs)
                sizes, counts = np.array([x[0] for x in refs]), _counts([x[3] for x in refs])
                rare = _counts([x[4].replace(POPULAR, "") for x in refs])
                for s, own in zip(subjects, best, strict=True):
                    floor = own[0][0] if len(own) == top else least
                    most = 2.0 * np.minimum(len(s), sizes) / (len(s) + sizes)
                    near = np.flatnonzero(most >= floor) if s else ()
                    if not len(near):
                        continue
                    near = slice(near[0], near[-1] + 1)  # by length, what may reach the floor lies together
                    letters, pieces = _counts([s]), None
                    most = 2.0 * np.minimum(counts[near], letters).sum(1) / (len(s) + sizes[near])
                    runs = np.minimum(rare[near], letters).sum(1) + 1
                    for k in np.argsort(-most, kind="stable"):  # likely ones first: they raise the floor for others
                        if most[k] < floor:
                            break
                        _, n, i, r, seed = refs[near.start + k]
                        if seed is not r:  # each run of equal letters but one that begins both texts has a letter that isn't too frequent
                            pieces = pieces or {s[a : a + PIECE] for a in range(len(s) - PIECE + 1)}
                            if not shares(s, pieces, r, int(floor * (len(s) + len(r)) / 2 / runs[k])):
                                continue
                        x = ratio(s, r, seed, floor)
                        if x >= least and (len(own) < top or (x, n) > own[0][:2]):
                            heapq.heappush(own, (x, n, i))
                            if len(own) > top:
                                heapq.heappop(own)
                            floor = own[0][0] if len(own) == top else least
                if len(blocks) > 1 and getattr(b, "_path", None):  # else each block that was read stays with the worker
                    del b._value
            out = [(k, rank, i, x) for k, own in zip(pdf[key], best, strict=True) for rank, (x, _, i) in enumerate(sorted(own, reverse=True), 1)]
            yield pd.DataFrame(out, columns=["key", "rank", "ref_id", "ratio"])

    kind, ref = docs.schema[key].dataType.simpleString(), reference.schema["id"].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"key {kind}, rank int, ref_id {ref}, ratio double").withColumnRenamed("key", key)
