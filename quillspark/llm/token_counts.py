"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi over Aho-Corasick matches.

The best segmentation of a text maximises the sum of its pieces' scores. An Aho-Corasick automaton lists the vocabulary's
matches at each end; the dynamic program keeps, for each end, the best score and how many pieces it took, and nothing else.
The rules are those of the tokenizer: at one end the piece that starts first is looked at first and only a greater score
replaces it, so that the longest last piece wins ties; a character that is no piece of its own costs the least score
less 10 and counts as one piece for each of its UTF-8 bytes where the vocabulary has byte pieces, else as one.

Spaces become U+2581, one is put in front. No piece goes on from another character into U+2581 (this is checked), so a text
falls into words with the spaces before them, whose best segmentations are independent; each distinct word is computed
once while ``CACHE`` of them are kept. Scores are summed up exactly (double), word by word, where the library's single
precision would start to round in long texts.

Null and empty texts have 0 tokens. Texts are counted whole; the program needs memory for one word at a time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, free_name, read

CACHE, SPACE, UNKNOWN_COST = 300_000, "▁", 10.0
WORD = re.compile("▁*[^▁]+|▁+$")


class Vocabulary:
    """Pieces and scores of a sentencepiece model, whatever its own type, read as a unigram model."""

    def __init__(self, pieces: dict[str, float], byte_pieces: bool):
        import ahocorasick

        self.pieces, self.byte_pieces = pieces, byte_pieces
        if crossing := next((p for p in pieces if re.search(f"[^{SPACE}]{SPACE}", p)), None):
            raise ValueError(f"piece {crossing!r} holds the end of one word and the start of another")
        self.unknown = min(pieces.values()) - UNKNOWN_COST
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        normal = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        return cls({m.id_to_piece(i): m.get_score(i) for i in normal}, any(map(m.is_byte, ids)))

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of ``word``, which is normalised."""
        n = len(word)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        at: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(word):
            at[end + 1].append(match)
        for end in range(1, n + 1):
            top, took, single = None, 0, False
            for length, score in sorted(at[end], reverse=True) if len(at[end]) > 1 else at[end]:
                single = single or length == 1
                s = best[end - length] + score
                if top is None or s > top:
                    top, took = s, pieces[end - length] + 1
            if not single:
                s = best[end - 1] + self.unknown
                if top is None or s > top:
                    top, took = s, pieces[end - 1] + (len(word[end - 1].encode()) if self.byte_pieces else 1)
            best[end], pieces[end] = top, took
        return pieces[n]


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        count = vocabulary.count

        class Words(dict):
            def __missing__(self, word):
                if len(self) >= CACHE:
                    self.clear()
                n = self[word] = count(word)
                return n

        self.words = Words()

    def __call__(self, text: str) -> int:
        return sum(map(self.words.__getitem__, WORD.findall(SPACE + text.replace(" ", SPACE)))) if text else 0


def counted(docs: DataFrame, model: str, name: str = "n_tokens", text: str = "text") -> DataFrame:
    """``docs`` with the number of tokens of each text, under ``name`` or, where ``docs`` has that, with underscores behind.
    Repeated rows are counted each; an empty table gives no rows."""

    def make():
        counter = Counter(Vocabulary.load(model))
        return lambda texts: [pa.array([counter(t.decode()) for t in texts], pa.int64())]

    return add_columns(docs, text, [T.StructField(free_name(docs, name), T.LongType())], make)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counted(read(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
    return rows.select("doc_id", "n_tokens", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
