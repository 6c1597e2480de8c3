"""Harmonic packing of token ids into sequences.

A document is cut into whole sequences and a tail. Tails fall into reciprocal-capacity classes: class k holds those of more than
capacity / (k + 1) and at most capacity / k tokens, and each of its bins takes exactly k of them; tails of at most capacity / ``CLASSES``
tokens make the last class. A bin that has its k tails is short of the capacity by less than one more of its class would need. This
gap is closed by the first tokens of the next document, or by whole documents if they fit, so a document is cut at most once to close a gap, and once more where
its tail begins, besides its whole sequences. Every task fills the bins of each class on its own: nothing is shuffled, a document of any length streams through, and at most
``CLASSES`` bins are open, a few hundred tails of one task in all.

At the end of a task the tails of bins that are not full are laid one after another into sequences, cut at the capacity, and the last
few tokens are cut into powers of two, which need no padding. So no task pads anything.

Defined results: a null or empty text is the one end id; repeated rows are packed each; a null doc_id stays null; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_and_text, raw_texts, release, small_batches

CAPACITY = 4096
CLASSES = 32
END_ID = 2
#: Bytes of text and rows whose distinct words are encoded together.
BYTES, ROWS = 4_000_000, 10_000
#: Words outside ``LETTERS`` whose ids a task remembers. The memory is emptied when full, which changes no result.
WORDS_HELD = 500_000
#: Longer runs without a space are encoded each time.
LONGEST_HELD = 64
#: Words handed to the tokenizer at a time.
AT_ONCE = 2000
#: Lower-case letters of ASCII, Latin-1, Greek and Cyrillic: the normaliser leaves them as they are, and a run of them is one word to the tokenizer.
LETTERS = "^[a-zß-öø-ÿα-ωа-џ]+$"
#: Behind such letters a run of ASCII marks is a word of its own.
MARKS = string.punctuation

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes.

    No token of this tokenizer spans white space and its normaliser works inside words, so a text's ids are those of its words in turn; of many texts
    each distinct word is encoded once. Runs of letters go to the tokenizer's model alone, many at a time; the model closes each by a token that ends in its suffix.
    Marks behind them, and all other words, pass through the whole tokenizer with a special token between them, and are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.between = next(t for t in self.tokenizer.get_added_tokens_decoder().values() if t.special).content
        self.between_id = self.tokenizer.token_to_id(self.between)
        self.held: dict[bytes, bytes] = {}
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = Tokenizer(self.tokenizer.model)  # the same model, not a copy
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocab = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words not held yet."""
        found: dict[bytes, bytes] = {}
        plain = []
        for w in words:
            text = w.decode("utf-8", "replace")
            if self.between in text:
                found[w] = self.plain(text)
            else:
                plain.append((w, text))
        for at in range(0, len(plain), AT_ONCE):
            some = plain[at : at + AT_ONCE]
            one, of = [], iter(some)
            for i in [*self.tokenizer.encode_batch_fast([self.between.join(t for _, t in some)], add_special_tokens=False)[0].ids, self.between_id]:
                if i == self.between_id:
                    found[next(of)[0]] = b"".join(one)
                    one = []
                else:
                    one.append(i.to_bytes(4, "little"))
        return found

    def known(self, words: list[bytes]) -> list[bytes]:
        held = self.held
        new = set(words).difference(held)  # looks up each word; a key view would be walked whole
        found = {}
        if new:
            if len(held) + len(new) > WORDS_HELD:
                held.clear()
                new = set(words)
            found = self.learn(new)
            held.update((w, i) for w, i in found.items() if len(w) <= LONGEST_HELD)
        return [found[w] if w in found else held[w] for w in words]

    def of_letters(self, words: pa.Array) -> pa.Array:
        """Ids of words that are ``LETTERS``."""
        parts = [np.zeros(0, dtype="<u4")]
        for at in range(0, len(words), AT_ONCE):
            text = " ".join(words.slice(at, AT_ONCE).to_pylist())
            parts.append(np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"))
        ids = np.concatenate(parts)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer's model doesn't close each word by one token")
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(4 * np.append(0, ends)), pa.py_buffer(ids)])

    def of_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        stems = pc.ascii_rtrim(words, characters=MARKS)
        lettered = pc.match_substring_regex(stems, LETTERS)
        marked = pc.and_(lettered, pc.not_equal(pc.binary_length(stems), pc.binary_length(words)))
        marks = [w[n:] for w, n in zip(raw_texts(words.filter(marked)), pc.binary_length(stems.filter(marked)).to_pylist(), strict=True)]
        stems = stems.filter(lettered).dictionary_encode()
        bodies = pa.concat_arrays([self.of_letters(stems.dictionary), pa.array(self.known(raw_texts(words.filter(pc.invert(lettered)))), type=pa.large_binary())])
        is_lettered, body = lettered.to_numpy(zero_copy_only=False), np.zeros(len(words), dtype=np.int64)
        body[is_lettered] = stems.indices.to_numpy()
        body[~is_lettered] = np.arange(len(stems.dictionary), len(bodies))
        ends = {m: k for k, m in enumerate(dict.fromkeys(marks), 1)}
        end = np.zeros(len(words), dtype=np.int64)
        end[marked.to_numpy(zero_copy_only=False)] = [ends[m] for m in marks]
        tails = pa.array([b"", *self.known(list(ends))], type=pa.large_binary())
        return pc.binary_join_element_wise(bodies.take(pa.array(body)), tails.take(pa.array(end)), pa.scalar(b"", pa.large_binary()))

    def lowered(self, raw: bytes) -> bytes:
        """ASCII letters are lowered first, as the tokenizer would.

        A word that holds a special token in any case stays as it is, since only the exact case is special.
        """
        low = raw.lower()
        if any(x in low for x in self.special):
            return b" ".join(own if any(x in w for x in self.special) else w for own, w in zip(raw.split(), low.split(), strict=True))
        return low

    def of_all(self, raws: list[bytes]) -> list[memoryview]:
        """The ids of each text; only ASCII white space parts words here."""
        parted = pc.ascii_split_whitespace(pa.array(map(self.lowered, raws), type=pa.large_binary()).view(pa.large_string()))
        words = parted.values.dictionary_encode()
        ids = self.of_words(words.dictionary).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], dtype=np.int64)[parted.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(raws) + 1)
        raw = memoryview(ids.buffers()[2] or b"")
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def of(self, raw: bytes) -> bytes:
        return bytes(self.of_all([raw])[0])


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker, kept from task to task."""
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def class_of(tail: int, capacity: int) -> int:
    """k, if the tail has more than capacity / (k + 1) and at most capacity / k tokens; CLASSES for all shorter ones."""
    return min(CLASSES, capacity // tail)


class Bins:
    """The bins of one task. A piece is (document, start, its ids); ``placed`` collects rows of pieces with sequence and offset."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}  # by class: tails that wait for the others of their bin
        self.gap: list[tuple] = []  # a bin that has its tails and isn't full
        self.room = 0  # in it
        self.placed: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        """A sequence of these pieces."""
        at = 0
        for doc, start, ids in pieces:
            self.placed.append((doc[0], start, len(ids) // 4, zlib.crc32(ids), doc[1], self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id: int | None, ids: memoryview) -> None:
        capacity, total, at = self.capacity, len(ids) // 4, 0
        doc = (doc_id, total)
        if self.room:
            at = min(self.room, total)
            self.gap.append((doc, 0, bytes(ids[: 4 * at])))
            self.room -= at
            if not self.room:
                self.close(self.gap)
        while total - at >= capacity:
            self.close([(doc, at, ids[4 * at : 4 * (at + capacity)])])
            at += capacity
        if at < total:
            k = class_of(total - at, capacity)
            held = self.open.setdefault(k, [])
            held.append((doc, at, bytes(ids[4 * at :])))
            if len(held) == k:
                self.gap = self.open.pop(k)
                self.room = capacity - sum(len(ids) // 4 for _, _, ids in self.gap)
                if not self.room:
                    self.close(self.gap)

    def rest(self) -> None:
        """What is left at the end of the task, in whole sequences and then powers of two."""
        pieces = [*(self.gap if self.room else ()), *(p for k in sorted(self.open) for p in self.open[k])]
        full, last = divmod(sum(len(ids) // 4 for _, _, ids in pieces), self.capacity)
        sizes = [self.capacity] * full + [1 << k for k in range(last.bit_length() - 1, -1, -1) if last >> k & 1]
        pieces.reverse()
        for size in sizes:
            own = []
            while size:
                doc, start, ids = pieces.pop()
                n = min(size, len(ids) // 4)
                own.append((doc, start, ids[: 4 * n]))
                size -= n
                if 4 * n < len(ids):
                    pieces.append((doc, start + n, ids[4 * n :]))
            self.close(own)


def _pack(tokenizer: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (zip(*bins.placed, strict=True) if bins.placed else [[]] * 7)], schema=ARROW)
            bins.placed.clear()
            return out

        for batch in small_batches(batches, ROWS, BYTES):
            for doc_id, own in zip(batch.column(0).to_pylist(), ids.of_all(raw_texts(batch.column(1))), strict=True):
                bins.add(doc_id, memoryview(bytes(own) + end))
            yield rows()
        bins.rest()
        yield rows()
        release()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, place in it, checksum of its ids, and its sequence and offset there.

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    return id_and_text(docs, id_col, text_col).mapInArrow(_pack(tokenizer, capacity, end_id), SCHEMA)
