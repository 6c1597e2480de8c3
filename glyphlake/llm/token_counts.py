"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character; dynamic programming carries
the best score and the number of pieces so far. No segmentation is built. Ties go as in the tokenizer: of equal scores the
candidate that starts earliest stays, because later ones must be strictly better. A character that no single-character
piece covers may be taken as unknown at ``min(score) - 10`` and then counts its UTF-8 bytes (byte fallback).

Scores are integers, so sums are exact and a text may be cut where no piece can cross: pieces hold the space mark only at
their front. Words repeat, so a task remembers their counts. Nothing is shuffled.

Defined results: a null or empty text has 0 tokens; repeated rows each give a row; a null doc_id stays null; an empty
table gives an empty table; other columns are ignored. Every step is linear in the text's length.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_texts

SPACE = "▁"
UNKNOWN_PENALTY = 10
#: Words whose counts a task remembers; the memory is emptied when full, which changes no result.
WORDS_HELD = 1_000_000
LONGEST_HELD = 64

SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
SCHEMA = "doc_id long, n_tokens long, score double, n_chars long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("n_chars", pa.int64())])


def read_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece model with their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in plain}


class Counter(dict):
    """Word -> (score, pieces), filled as words are met."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        for piece, score in pieces.items():
            if SPACE in piece.lstrip(SPACE) or not float(score).is_integer():
                raise ValueError("pieces hold the space mark only at their front and have integer scores")
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)
        self.longest = max(map(len, pieces), default=1)
        # A line break that is in no piece is unknown wherever it stands, so a text can be cut there.
        if any("\n" in p for p in pieces):
            raise ValueError("pieces hold no line break")

    def best(self, word: str) -> tuple[float, int]:
        """Only the last places that a piece can reach back to are held, and the matches of one place, so a word of any length takes the same room."""
        ring = self.longest + 1
        score, count = [0.0] * ring, [0] * ring
        found = self.automaton.iter(word) if self.any else iter(())
        match = next(found, None)
        n = len(word)
        for end in range(1, n + 1):
            ends = []
            while match is not None and match[0] == end - 1:
                ends.append(match[1])
                match = next(found, None)
            best, pieces, first = 0.0, 0, True
            for size, value in sorted(ends, reverse=True):  # the earliest start first
                total = score[(end - size) % ring] + value
                if first or total > best:
                    best, pieces, first = total, count[(end - size) % ring] + 1, False
            char = word[end - 1]
            if char not in self.single:
                total = score[(end - 1) % ring] + self.unknown
                if first or total > best:
                    best, pieces = total, count[(end - 1) % ring] + len(char.encode("utf-8", "surrogatepass"))
            score[end % ring], count[end % ring] = best, pieces
        return score[n % ring], count[n % ring]

    def __missing__(self, word: str) -> tuple[float, int]:
        found = self.best(word)
        if len(word) <= LONGEST_HELD:
            if len(self) >= WORDS_HELD:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text. A mark goes before it, as the tokenizer adds one."""
        if not text:
            return 0, 0.0
        score, count = 0.0, 0
        for s, c in map(self.__getitem__, SEGMENT.findall(SPACE + text.replace(" ", SPACE))):
            score += s
            count += c
        return count, score


_COUNTERS: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """One for each Python worker, kept from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(read_pieces(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of pieces of the best segmentation and its score. ``model`` is a path all executors have."""

    def kernel():
        counter = counter_of(model)

        def one(text: str) -> tuple:
            pieces, score = counter.of(text)
            return pieces, score, len(text)

        return one

    return map_texts(id_and_text(docs, id_col, text_col), kernel, SCHEMA, ARROW)
