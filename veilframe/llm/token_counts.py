"""Token counts under a unigram vocabulary, without building the tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import documents
from veilframe.llm.tokens import ChunkCoder, segments

SPACE = "▁"       # the piece alphabet's sign for a space
UNK_PENALTY = 10.0     # fixed value of unigram tokenizers: below the lowest score


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a public vocabulary with their scores, without control pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not sp.is_control(i) and not sp.is_unknown(i)]


class UnigramCounter:
    """Number of pieces of the best segmentation of a text.

    An Aho-Corasick automaton lists all vocabulary matches; the dynamic program
    carries, for each position, the best score and its number of pieces. The tie
    rules are the tokenizer's: candidates come in ascending order of their start and
    only a strictly better score replaces one; a character that is no piece itself
    may also stand alone at the unknown score, and counts one piece per UTF-8 byte.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"a piece runs across a space: {piece!r}")
        self.auto.make_automaton()
        self.unk = min(s for _, s in vocabulary) - UNK_PENALTY

    def count(self, text: str) -> int:
        """Pieces of one chunk, already written with the space sign."""
        n = len(text)
        if not n:
            return 0
        ends: list[list] = [[] for _ in range(n)]
        for e, match in self.auto.iter(text):
            ends[e].append(match)  # longest, that is earliest start, first
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(n):
            top, size = None, 1
            for size, score in ends[e]:
                got = best[e + 1 - size] + score
                if top is None or got > top:
                    top, k = got, pieces[e + 1 - size] + 1
            if top is None or size != 1:
                got = best[e] + self.unk
                if top is None or got > top:
                    top, k = got, pieces[e] + len(text[e].encode("utf-8", "surrogatepass"))
            best[e + 1], pieces[e + 1] = top, k
        return pieces[n]


_RUNS = re.compile(" *[^ ]+| +")
_FIRST_SPACE = re.compile("(?<! ) ")


class RunCoder(ChunkCoder):
    """Chunks are words with all the spaces before them; the tokenizer puts one
    space before the text, so the first word is like any other."""

    HEAD = ""

    def split(self, text: str) -> list[str]:
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [r[1:] for r in _RUNS.findall(" " + text)]
        return text.split(" ")

    def irregular(self, chunk: str) -> bool:
        return False

    def written(self, chunk: str) -> str:
        return SPACE + chunk.replace(" ", SPACE)


_COUNTERS: dict[str, RunCoder] = {}


def _coder(path: str) -> RunCoder:
    if path not in _COUNTERS:
        counter = UnigramCounter(unigram_vocabulary(path))
        _COUNTERS[path] = RunCoder(lambda chunks: list(map(counter.count, chunks)))
    return _COUNTERS[path]


def text_count(text: str, coder: RunCoder) -> int:
    """Pieces of a whole text. No piece runs from another character into a space,
    so the best segmentation of the text is that of its words, each with the
    spaces before it (scores are whole numbers: sums are exact)."""
    if not text:
        return 0
    if SPACE in text:
        text = text.replace(SPACE, " ")
    return sum(sum(coder.coded([s[1:] if k else s])[0]) for k, s in enumerate(segments(text, cut=_FIRST_SPACE)))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) per row: pieces of the best unigram segmentation.

    Null and empty texts have none. Repeated rows and null ids are counted like any
    other; an empty table gives an empty result. Only the two named columns are read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": [text_count(t or "", coder) for t in b["text"]]})

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInPandas(run, "doc_id long, n_tokens long")


def op9_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
