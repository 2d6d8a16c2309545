"""Token ids in binary files, by an adaptive context-mixing range coder.

File: ``MAGIC``, blocks, a footer with each document's id and number of token ids, and the footer's length. A block holds up
to ``BLOCK`` ids and is coded from an empty model, so that it can be read alone; it carries the crc32 of its ids. In a block,
lanes of consecutive ids are coded side by side, one id of each lane a step, and share the model, which learns after each step:

* order 2 and order 1: the id last seen after the two ids (the one id) before, with a confidence from 0 to 3;
* a first part says which of the two was right, or neither. Its frequencies mix, by integer weights, the counts under
  both confidences with those under either one;
* order 0: an id that neither foresaw is coded by the adaptive frequencies of all such ids, which are set anew after each of
  the first steps, then after every fourth.

All arithmetic is on integers, so that files read the same on any machine. Frequencies are brought to powers of two as their
sum, and both parts of an id make one interval, so that a step of all lanes is coded at once and without a division. The range
coder keeps 64 bits a lane and gives out 16 at a time; carries go to the words before, once a block's words are known. A block has
the first words of all lanes, then the others in the order in which a reader of all lanes asks for them.

Files are written under a name of the attempt and renamed when whole, so that repeated or lost tasks leave one good file.
Null and empty texts are just the end id. Documents come in ascending id (null first), rows that repeat an id in
the order of their texts. No documents, no files. Ids must be under 2**20.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked, in_arrow, read, shared_dir, written

MAGIC, BLOCK, LANES, LANE_IDS, END_ID, CACHE = b"QTOK0002", 1 << 21, 1 << 14, 128, 2, 300_000
ALL, TOP, SMALL, FIRST = ~np.uint64(0), np.uint64(48), np.uint64(1 << 48), 4  # FIRST: words that fill a register
S16, ID_MASK, NONE = np.uint64(16), np.uint32((1 << 20) - 1), np.uint32((1 << 20) - 1)
HEAD = struct.Struct("<IIIIII")  # ids, crc32, lanes, ids of a lane, words behind the first ones, size of the vocabulary


class Model:
    """Shared by the lanes of a block; coder and reader make the same calls in the same order."""

    HASH, WHICH, BUCKETS = 20, 12, 15  # bits: of slots, of the first part's frequencies, of places where the search of an id begins

    def __init__(self, vocabulary: int, lanes: int, ids: int):
        self.two = np.full(1 << self.HASH, NONE, np.uint32)
        self.one = np.full(vocabulary + 1, NONE, np.uint32)
        self.zero = np.ones(vocabulary, np.int64)
        self.bits = (vocabulary + 2 * ids).bit_length()  # no frequency gets 0
        self.total = np.uint64(self.WHICH + self.bits)
        self.right = np.zeros((32, 3), np.int64)
        self.b = np.full(lanes, vocabulary, np.int64)
        self.a = np.zeros(lanes, np.uint32)
        # of each id where its interval starts and how wide it is, and last an entry for none: all there is
        self.start, self.width = np.zeros(vocabulary + 1, np.uint64), np.full(vocabulary + 1, 1 << self.bits, np.uint64)
        self.vocabulary, self.steps = vocabulary, 0
        self._spread()

    def _spread(self) -> None:
        ends = np.cumsum(self.zero)
        self.ends = (ends << self.bits) // ends[-1]
        self.start[1:-1] = self.ends[:-1]
        self.width[:-1] = np.diff(self.ends, prepend=0)
        self.from_ = None

    def foresee(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the first n lanes: the ids of order 2 and 1, and for each case one after another (four numbers each) where the
        intervals of {order 2, order 1, neither} start, in units of all parts, and how wide they are, in units of the first."""
        self.b, a = self.b[:n], self.a[:n]
        b = self.b.astype(np.uint32) * np.uint32(0x85EBCA6B)
        self.slot = (a + b >> np.uint32(32 - self.HASH)).astype(np.int64)
        self.a = b * np.uint32(0x9E3779B1)
        self.of2, self.of1 = self.two.take(self.slot), self.one.take(self.b)
        self.p2, self.p1 = self.of2 & ID_MASK, self.of1 & ID_MASK
        self.case = ((self.of2 >> 20 << 3) + (self.of1 >> 20 << 1) + (self.p2 == self.p1)).astype(np.int64) * 4
        by = self.right.reshape(4, 4, 2, 3)
        mixed = (8 * by + 2 * by.sum((1, 2))[:, None, None] + by.sum((0, 2))[None, :, None] + 1).reshape(32, 3)
        at, size = np.zeros((32, 4), np.int64), np.zeros((32, 4), np.uint64)
        at[:, 1:] = np.cumsum(mixed, 1) * ((1 << self.WHICH) - 3) // mixed.sum(1)[:, None] + (1, 2, 3)
        size[:, :3] = np.diff(at)
        return self.p2, self.p1, (at << self.bits).astype(np.uint64).reshape(-1), size.reshape(-1)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids in whose intervals the numbers v are. For most it is the one at the beginning of their bucket; others are searched."""
        shift = max(0, self.bits - self.BUCKETS)
        if self.from_ is None:
            last = np.zeros((1 << self.BUCKETS) + 1, np.int64)
            last[(self.ends[:-1] >> shift) + 1] = np.arange(1, len(self.ends))  # of those that start in a bucket, the last stays
            self.from_ = np.maximum.accumulate(last)
        x = self.from_.take(v >> shift)
        if len(more := np.flatnonzero(self.ends.take(x) <= v)):
            w = v[more]
            by = np.argsort(w)  # a search for ascending values stays within the cache
            x[more[by]] = np.searchsorted(self.ends, w[by], side="right")
        return x

    def learn(self, ids: np.ndarray, which: np.ndarray, new: np.ndarray) -> None:
        """``new``: numbers of the lanes whose id neither order foresaw."""
        self.right += np.bincount(self.case + which, minlength=128).reshape(32, 4)[:, :3]
        self.right[self.right.sum(1) > 1 << 15] >>= 1
        np.add.at(self.zero, ids.take(new), 2)
        self.steps += 1
        if self.steps < 16 or self.steps % 4 == 0:
            self._spread()
        u = ids.astype(np.uint32)
        for table, slot, entry, p in ((self.two, self.slot, self.of2, self.p2), (self.one, self.b, self.of1, self.p1)):
            c, hit = entry >> 20, p == u
            sure = c > 1
            more = (hit & (c < 3)).astype(np.uint32)
            more -= sure & ~hit
            table[slot] = u + (hit | sure) * (entry + (more << 20) - u)  # where neither, the new id without confidence
        self.b = ids


class Coder:
    def __init__(self, lanes: int):
        self.low, self.range, self.carry = np.zeros(lanes, np.uint64), np.full(lanes, ALL), np.zeros(lanes, bool)
        self.lanes, self.words, self.carries = [], [], []

    def put(self, start: np.ndarray, size: np.ndarray, bits: np.uint64) -> None:
        """For the first lanes, one interval each, of ``2**bits`` in all."""
        low, range_, carry = (x[: len(start)] for x in (self.low, self.range, self.carry))
        range_ >>= bits
        more = start * range_
        low += more
        carry |= low < more
        range_ *= size
        at = np.flatnonzero(range_ < SMALL)
        while len(at):
            self._out(at)
            range_[at] = g = range_[at] << S16
            at = at[g < SMALL]

    def _out(self, at: np.ndarray) -> None:
        l = self.low[at]
        self.lanes.append(at.astype(np.uint16))
        self.words.append((l >> TOP).astype(np.uint16))
        self.carries.append(self.carry[at])  # belongs to the word before
        self.low[at], self.carry[at] = l << S16, False

    def words_by_lane(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends the code: all words lane by lane, how many each lane has, and as the how manieth each was given out."""
        for _ in range(FIRST):
            self._out(np.arange(len(self.low)))
        lanes = np.concatenate(self.lanes)
        by = np.argsort(lanes, kind="stable")
        words = np.concatenate(self.words)[by].astype(np.int32)
        words[:-1] += np.concatenate(self.carries)[by[1:]]
        while len(over := np.flatnonzero(words >> 16)):
            words[over] -= 1 << 16
            words[over - 1] += 1
        return words, np.bincount(lanes, minlength=len(self.low)), by

    def words_as_read(self) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all lanes, and the others: a reader takes one whenever the coder gave one out, but is ``FIRST`` ahead."""
        words, counts, by = self.words_by_lane()
        first = words[(np.cumsum(counts) - counts)[:, None] + np.arange(FIRST)]
        others = np.empty(len(words), np.uint16)
        others[by[:-FIRST]] = words[FIRST:]
        return first, others[: len(words) - first.size]


class Decoder:
    def __init__(self, first: np.ndarray, others: np.ndarray):
        self.code, self.range, self.others, self.at = np.zeros(len(first), np.uint64), np.full(len(first), ALL), others.astype(np.uint64), 0
        for k in range(FIRST):
            self.code = self.code << S16 | first[:, k].astype(np.uint64)

    def lanes(self, n: int, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Code and range of the first n lanes, to be narrowed in place; the ranges are in parts of ``2**bits``."""
        self.code, self.range = self.code[:n], self.range[:n]
        self.range >>= bits
        return self.code, self.range

    def refill(self) -> None:
        at = np.flatnonzero(self.range < SMALL)
        while len(at):
            self.code[at] = self.code[at] << S16 | self.others[self.at : self.at + len(at)]
            self.at += len(at)
            self.range[at] = g = self.range[at] << S16
            at = at[g < SMALL]


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """``ids``: unsigned 32-bit, at least one, each under ``vocabulary``."""
    lanes, steps = _shape(len(ids))
    lanes = -(-len(ids) // steps)
    grid = np.zeros((lanes, steps), np.int64)
    grid.reshape(-1)[: len(ids)] = ids
    full = len(ids) - (lanes - 1) * steps  # ids of the last lane
    model, coder = Model(vocabulary, lanes, len(ids)), Coder(lanes)
    for t, row in enumerate(np.ascontiguousarray(grid.T)):
        row = row[: lanes if t < full else lanes - 1]  # noqa: PLW2901
        p2, p1, start, size = model.foresee(len(row))
        which = (p2 != row).view(np.uint8) * (2 - (p1 == row).view(np.uint8))
        neither = which == 2
        k, x = model.case + which, vocabulary + (row - vocabulary) * neither
        size = size.take(k)
        coder.put(start.take(k) + size * model.start.take(x), size * model.width.take(x), model.total)
        model.learn(row, which, np.flatnonzero(neither))
    first, others = coder.words_as_read()
    raw = ids.astype("<u4").tobytes()
    return HEAD.pack(len(ids), zlib.crc32(raw), lanes, steps, len(others), vocabulary) + first.astype("<u2").tobytes() + others.astype("<u2").tobytes()


def decode_block(read) -> np.ndarray:
    """``read(n)`` gives the next n bytes. Raises ValueError where the checksum doesn't hold."""
    n, crc, lanes, steps, size, vocabulary = HEAD.unpack(read(HEAD.size))
    first = np.frombuffer(read(2 * FIRST * lanes), "<u2").reshape(lanes, FIRST)
    decoder, model = Decoder(first, np.frombuffer(read(2 * size), "<u2")), Model(vocabulary, lanes, n)
    grid, full, most = np.zeros((steps, lanes), np.int64), n - (lanes - 1) * steps, np.uint64((1 << model.bits) - 1)
    for t in range(steps):
        m = lanes if t < full else lanes - 1
        p2, p1, start, size = model.foresee(m)
        code, range_ = decoder.lanes(m, model.total)
        which = (code >= start.take(model.case + 1) * range_).view(np.uint8) + (code >= start.take(model.case + 2) * range_)
        k = model.case + which
        code -= start.take(k) * range_
        range_ *= size.take(k)
        row, x = (p1 + (which == 0) * (p2 - p1)).astype(np.int64), np.full(m, vocabulary)
        if len(new := np.flatnonzero(which == 2)):
            x[new] = row[new] = model.find(np.minimum(code[new] // range_[new], most).astype(np.int64))
        code -= model.start.take(x) * range_
        range_ *= model.width.take(x)
        decoder.refill()
        model.learn(row, which, new)
        grid[t, :m] = row
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block of token ids is damaged")
    return ids


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same from start[1], and so on."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


class Merges:
    """Byte-pair merges of many pre-tokens side by side: those of a length are the columns of an array, and in each step every
    column joins its pair of the lowest rank, of equal ones the first. Ranks of pairs are in a table in which a pair has two
    possible places."""

    NO_RANK, LONGEST, BITS = np.int64(1 << 40), 255, 8

    def __init__(self, vocabulary: dict[str, int], merges: list):
        self.byte = np.array([vocabulary[chr(byte_letters().get(b, b))] for b in range(256)], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges] + [0], np.int64)
        self.none = max(vocabulary.values()) + 1  # beside the first and the last symbol
        pairs = [vocabulary[a] * (self.none + 1) + vocabulary[b] for a, b in merges]
        self.shift = 64 - max(4, (4 * len(pairs)).bit_length())
        while not self._place(pairs):
            self.shift -= 1
        self.first = self.rank(np.repeat(self.byte, 256), np.tile(self.byte, 256))

    def _places(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = pair.view(np.uint64)
        return tuple((u * np.uint64(m) >> np.uint64(self.shift)).view(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

    def _place(self, pairs: list[int]) -> bool:
        one, two = (x.tolist() for x in self._places(np.array(pairs, np.int64)))
        held: dict[int, int] = {}
        for k in range(len(pairs)):
            at = one[k]
            for _ in range(200):
                k, held[at] = held.get(at, -1), k  # noqa: PLW2901
                if k < 0:
                    break
                at = two[k] if at == one[k] else one[k]
            else:
                return False
        self.pairs, self.ranks = np.full(1 << 64 - self.shift, -1, np.int64), np.full(1 << 64 - self.shift, self.NO_RANK)
        for at, k in held.items():
            self.pairs[at], self.ranks[at] = pairs[k], k
        return True

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * (self.none + 1) + b
        one, two = self._places(pair)
        at = np.where(self.pairs[one] == pair, one, two)
        return np.where(self.pairs[at] == pair, self.ranks[at], self.NO_RANK)

    def __call__(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, how many each has, and which begin with a space. No piece is null or empty."""
        _, offsets, data = pieces.buffers()
        offset = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data, start, length = np.frombuffer(data, np.uint8), offset[:-1], np.diff(offset)
        size, parts = np.empty(len(length), np.int64), []
        for n in np.unique(length).tolist():
            for some in np.array_split(every := np.flatnonzero(length == n), -(-len(every) // 8192)):
                got = self._joined(data[start[some] + np.arange(n)[:, None]]) if n <= self.LONGEST else self._long(data, start[some], n)
                keep = got >= 0
                size[some] = keep.sum(1)
                parts.append((some, got[keep]))
        flat, at = np.empty(int(size.sum()), np.uint32), np.cumsum(size) - size
        for some, ids in parts:
            flat[_ranges(at[some], size[some])] = ids
        return flat, size, data[start] == 32

    def _joined(self, letters: np.ndarray) -> np.ndarray:
        """``letters``: bytes by place and piece. Ids by piece and place; -1 where a place was joined to one before."""
        n, wide = letters.shape
        symbol = np.full((n + 2, wide), self.none, np.int64)
        symbol[1:-1] = self.byte[letters]
        place = np.arange(n + 2)[:, None]
        best = np.full((n + 2, wide), self.NO_RANK << self.BITS)
        best[1:-2] = (self.first[letters[:-1].astype(np.int64) * 256 + letters[1:]] << self.BITS) + place[1:-2]
        after, before = np.repeat(place + 1, wide, 1), np.repeat(place - 1, wide, 1)
        symbol_, best_, after_, before_ = (x.reshape(-1) for x in (symbol, best, after, before))
        least = best.min(0)
        while len(on := np.flatnonzero(least < self.NO_RANK)):
            x = least[on]
            p = x & ((1 << self.BITS) - 1)
            at = p * wide + on
            gone = after_[at] * wide + on
            new = self.made[x >> self.BITS]
            right = after_[gone]
            past = right * wide + on
            left = before_[at]
            back = left * wide + on
            symbol_[at], symbol_[gone], best_[gone] = new, -1, self.NO_RANK << self.BITS
            after_[at], before_[past] = right, p
            best_[at] = (self.rank(new, symbol_[past]) << self.BITS) + p
            best_[back] = (self.rank(symbol_[back], new) << self.BITS) + left
            least = best.min(0)
        return symbol[1:-1].T

    def _long(self, data: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """Long pieces, one by one, by a heap of their pairs."""
        out = np.full((len(start), n), -1, np.int64)
        for k, s in enumerate(start.tolist()):
            out[k] = self._heap(data[s : s + n])
        return out

    def _heap(self, letters: np.ndarray) -> np.ndarray:
        symbol, n = self.byte[letters].tolist(), len(letters)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        first = self.first[letters[:-1].astype(np.int64) * 256 + letters[1:]].tolist()
        none = int(self.NO_RANK)
        heap = [(r, p, symbol[p], symbol[p + 1]) for p, r in enumerate(first) if r < none]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(p: int, q: int) -> None:
            pair = symbol[p], symbol[q]
            if pair not in known:
                known[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] < none:
                heapq.heappush(heap, (known[pair], p, *pair))

        while heap:
            r, p, a, b = heapq.heappop(heap)
            q = after[p]
            if symbol[p] != a or q >= n or symbol[q] != b:
                continue
            symbol[p], symbol[q], after[p] = int(self.made[r]), -1, after[q]
            if after[p] < n:
                before[after[p]] = p
                push(p, after[p])
            if before[p] >= 0:
                push(before[p], p)
        return np.array(symbol)


class Encoder:
    """Byte-level BPE as the tokenizers library has it, for a batch of texts at a time: Arrow splits the texts into runs and numbers
    the different ones, each of these is looked up once a batch, and the ids are put together by their numbers. The ids of
    runs are kept for later batches (up to ``CACHE`` runs before a batch, then it starts anew).

    * Pre-tokens never cross from a non-space into a space, so a text may be cut before a space that stands alone between
      two other characters. A text with other white space beside a space is encoded whole.
    * A run of characters below ``PLAIN`` is cut into pre-tokens by the tokenizer's own pattern, which
      ``Merges`` joins many at a time; other runs, whose classes depend on the version of Unicode, go to the library as they are.

    This holds for byte-level files without a normalizer; with any other file whole texts go to the library."""

    PLAIN = "\u0250"
    LEAD = PLAIN.encode()[0]  # no byte of text reaches it: all characters are plain

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        kind = json.loads(tokenizer.to_str())
        bpe, cutter = kind["model"], kind.get("pre_tokenizer") or {}
        odd = any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        self.cuts = kind.get("normalizer") is None and bpe.get("type") == "BPE" and level and not odd
        vocabulary, merges = bpe.get("vocab") or {}, [m.split(" ") if isinstance(m, str) else m for m in bpe.get("merges") or []]
        self.cuts = self.cuts and len(set(map(tuple, merges))) == len(merges) and all(chr(byte_letters().get(b, b)) in vocabulary for b in range(256))
        self.merges = Merges(vocabulary, merges) if self.cuts else None
        self.special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        self.cut, self.size = regex.compile(public_tokenizers.PATTERN).findall, tokenizer.get_vocab_size()
        self.encode = lambda s: array("I", tokenizer.encode(s, add_special_tokens=False).ids).tobytes()
        self.forget()

    def forget(self) -> None:
        """Drops the answers kept, so that a worker that goes on to other work doesn't hold them. ``number``: of runs, -1 for those that
        need their whole text encoded; run n has ``length[n]`` ids in ``flat`` from ``start[n]`` on, run 0 none."""
        self.number: dict[str, int] = {"": -1}
        self.flat, self.start, self.length = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _numbers(self, runs: list[str]) -> np.ndarray:
        if len(self.number) >= CACHE:
            self.forget()
        numbers = np.fromiter(map(self.number.get, runs, itertools.repeat(-2)), np.int64, len(runs))
        new = np.flatnonzero(numbers == -2)
        if not len(new):
            return numbers
        own, plain, special = [runs[k] for k in new.tolist()], self.PLAIN, self.special
        found, together = np.full(len(own), -1), " ".join(own)
        if np.frombuffer(together.encode(), np.uint8).max(initial=0) < self.LEAD and not special(together) and "" not in own and own == [*map(str.strip, own)]:
            kind = np.full(len(own), 2)
        else:  # 0: asks for its whole text, 1: by the library, 2: cut here
            kind = np.array([0 if not x or x[0].isspace() or x[-1].isspace() else 2 if max(x) < plain and not special(x) else 1 for x in own])
        kind[(kind == 2) & np.fromiter(map(str.isalpha, own), bool, len(own))] = 3  # letters alone are one piece
        if len(some := np.append(letters := np.flatnonzero(kind == 3), np.flatnonzero(kind == 2))):
            found[some] = len(self.start) + np.arange(len(some))
            self._cut([own[k] for k in some.tolist()], len(letters))
        if len(some := np.flatnonzero(kind == 1)):
            found[some] = len(self.start) + np.arange(len(some))
            self._add([self.encode(" " + own[k]) for k in some.tolist()])
        self.number.update(zip(own, found.tolist(), strict=True))
        numbers[new] = found
        return numbers

    def _cut(self, runs: list[str], letters: int) -> None:
        """Adds runs of plain characters, the first ``letters`` of letters alone. Behind a space each, the others are cut in one go;
        just the first pieces of runs begin with one."""
        pieces = [" " + x for x in runs[:letters]]
        if len(runs) > letters:
            pieces += self.cut(" " + " ".join(runs[letters:]))
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        of = coded.indices.to_numpy()
        flat, size, head = self.merges(coded.dictionary)
        start = np.cumsum(size) - size
        ids = np.add.reduceat(size[of], np.flatnonzero(head[of]))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(ids) - ids])
        self.length = np.concatenate([self.length, ids])
        self.flat = np.concatenate([self.flat, flat[_ranges(start[of], size[of])]])

    def _add(self, found: list[bytes]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), "<u4")])

    def batch(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column (null: empty) one after another, ``end`` behind each, and how many each has."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if not self.cuts:
            whole = [self.encode(t or "") + end for t in texts.to_pylist()]
            return np.frombuffer(b"".join(whole), "<u4"), np.fromiter(map(len, whole), np.int64, len(whole)) // 4
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        runs, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        at = first[:-1] - first[0]
        numbers = self._numbers(runs)[of]
        begins = [runs[k] for k in of[at].tolist()]
        # a text is encoded whole if a run behind its first one asks for it, or the first one ends in white space and others follow
        numbers[at] = 0
        several = np.diff(first) > 1
        odd = np.add.reduceat(numbers == -1, at) > 0
        odd |= several & np.fromiter((not x or x[-1].isspace() for x in begins), bool, len(begins))
        kept = len(self.flat), len(self.start)
        numbers[np.repeat(odd, np.diff(first))] = 0
        numbers[at] = len(self.start) + np.arange(len(at))
        # the first run of each text, or all of it, and the end are numbered for this batch only
        self._add([*(self.encode(texts[k].as_py() if o else x) for k, (x, o) in enumerate(zip(begins, odd.tolist(), strict=True))), end])
        numbers = np.insert(numbers, np.append(at[1:], len(numbers)), len(self.start) - 1)
        size, start = self.length[numbers], self.start[numbers]
        ids, sizes = self.flat[_ranges(start, size)], np.add.reduceat(size, at + np.arange(len(at)))
        self.flat, self.start, self.length = self.flat[: kept[0]], self.start[: kept[1]], self.length[: kept[1]]
        return ids, sizes

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()


@functools.cache
def byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a visible letter: itself, or the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in seen)}


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker; each task drops the answers that it kept."""
    return Encoder(path)


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes files of the token ids of ``docs`` (doc_id, text) into ``folder``; returns (file, part, n_docs, n_ids)."""
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        import pyarrow.fs  # noqa: F401

        encoder, end, out, buffer, held, ids, sizes = _encoder(tokenizer), np.array([end_id], "<u4").tobytes(), None, [], 0, [], []
        vocabulary = max(encoder.size, end_id + 1)
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}.qtok"
        fs, path = None, None

        def flush(least: int):
            nonlocal buffer, held
            raw = np.concatenate(buffer)
            at = 0
            while len(raw) - at >= least and len(raw) > at:
                out.write(encode_block(raw[at : at + BLOCK], vocabulary))
                at += BLOCK
            buffer, held = [raw[at:].copy()], max(0, len(raw) - at)

        for b in batches:
            if out is None:
                fs, path = _fs(folder)
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(own := f"{path}/.part-{part:06d}-{uuid.uuid4().hex}")
                out.write(MAGIC)
            x, n = encoder.batch(b.column(1), end)
            buffer.append(x)
            held += len(x)
            ids += b.column(0).to_pylist()
            sizes += n.tolist()
            if held >= BLOCK:
                flush(BLOCK)
        encoder.forget()
        if out is not None:
            flush(1)
            sink = pa.BufferOutputStream()
            footer = pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "n"])
            with pa.ipc.new_stream(sink, footer.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(footer)
            raw = sink.getvalue().to_pybytes()
            out.write(struct.pack("<I", 0) + raw + struct.pack("<Q", len(raw)))
            out.close()
            fs.move(own, f"{path}/part-{part:06d}.qtok")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["file", "part", "n_docs", "n_ids"])

    return written(in_arrow(ranged, run, "file string, part long, n_docs long, n_ids long"), "token-files")


def read_file(name: str):
    """Yields (doc_id, start in the file, token ids) of each document of a file, a block at a time."""
    fs, path = _fs(name)
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 8)
        (n,) = struct.unpack("<Q", f.read(8))
        f.seek(size - 8 - n)
        footer = pa.ipc.open_stream(f.read(n)).read_all()
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{name} is no file of token ids")

        def take(k: int) -> bytes:
            got = f.read(k)
            if len(got) != k:
                raise ValueError(f"{name} ends too soon")
            return got

        parts, have, start = [], 0, 0
        for i, k in zip(footer["doc_id"].to_pylist(), footer["n"].to_pylist(), strict=True):
            while have < k:
                block = decode_block(take)
                parts.append(block)
                have += len(block)
            if len(parts) > 1 or len(parts[0]) > 4 * BLOCK:
                parts = [np.concatenate(parts)]
            yield i, start, parts[0][:k]
            parts, have, start = [parts[0][k:]], have - k, start + k


def read_documents(files: DataFrame) -> DataFrame:
    """(part, doc_id, at, n_tokens, ids_crc32) of each document in ``files`` (see ``write_files``), from the files alone."""

    def run(batches):
        for b in batches:
            for name, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(part, i, at, len(x), zlib.crc32(x.tobytes())) for i, at, x in read_file(name)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return in_arrow(files.select("file", "part").repartition(n), run, "part long, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    files = write_files(docs, tokenizer, f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))  # a row for each file
    return read_documents(files).join(checked(offsets), "part").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token files: a row for each, with its place, number of ids and checksum as read back. Null and empty
    texts, repeated ids and empty tables as in ``write_files``; columns beside doc_id and text aren't carried on."""
    return token_documents(docs, tokenizer_path())
