import random
import zlib
from collections import Counter as Counts

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from glyphlake.llm.packing import CAPACITY, Bins, WordIds, class_of, pack
from glyphlake.llm.token_counts import SPACE, Counter, count_tokens, read_pieces

MODEL, WORDS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def real():
    pieces = read_pieces(MODEL)
    everything = [("<unk>", 0.0), *((f"<0x{b:02X}>", -1e9) for b in range(256)), *pieces.items()]
    return Counter(pieces), Tokenizer(models.Unigram(everything, 0, True))


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from([*"the quick brown fox aeiou.,  \n", "é", "ß", "漢", "😀", SPACE]), max_size=60))
def test_counts_equal_the_tokenizer(real, text):
    counter, tokenizer = real
    expect = len(tokenizer.encode(SPACE + text.replace(" ", SPACE)).ids) if text else 0
    assert counter.of(text)[0] == expect


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=1, max_size=3), st.integers(-4, 0).map(float), min_size=1, max_size=8), st.text("abc", max_size=12))
def test_tie_rules_equal_the_tokenizer(pieces, text):
    """Small integer scores make ties the rule."""
    everything = [("<unk>", 0.0), *((f"<0x{b:02X}>", -1e9) for b in range(256)), *pieces.items()]
    tokenizer = Tokenizer(models.Unigram(everything, 0, True))
    lowest = min(0.0, *pieces.values())
    counter = Counter(pieces)
    # The library's lowest score is that of its byte pieces; any unknown is then as bad, which the count must not depend on.
    counter.unknown = -1e9 - 10
    assert lowest <= 0 and counter.best(text)[1] == len(tokenizer.encode(text).ids)


def test_word_ids_equal_the_tokenizer():
    ids, whole = WordIds(WORDS), Tokenizer.from_file(WORDS)
    r = random.Random(5)
    parts = ["Hello", "world.", "it's", "DON'T", "été", "Ångström,", "ΟΔΟΣ", "a,b", "...", "x.,", "12,5.", "<|endoftext|>", "a<|startoftext|>.", "\x1c", " ", "　", "İ.", "ß.", "K̸,", "漢字.", "😀,", "z" * 100, "\t", "\r\n", "l'été."]
    for _ in range(300):
        text = "".join(r.choice(parts) + r.choice([" ", "", "\n", "  "]) for _ in range(r.randrange(12)))
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def check_pack(spark, rows, capacity):
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3), WORDS, capacity).toPandas()
    whole = Tokenizer.from_file(WORDS)
    texts = {}
    for i, t in rows_of(rows):
        texts.setdefault(i, []).append([*whole.encode(t or "", add_special_tokens=False).ids, 2])
    for i, ids in texts.items():
        own = out[out.doc_id == i] if i is not None else out[out.doc_id.isna()]
        assert own.length.sum() == sum(map(len, ids))
        if len(ids) == 1:
            own, at = own.sort_values("start"), 0
            for p in own.itertuples():
                assert p.start == at and p.doc_tokens == len(ids[0])
                assert p.ids_crc32 == zlib.crc32(np.array(ids[0][at : at + p.length], "<u4").tobytes())
                at += p.length
    for _, s in out.groupby("sequence_id"):
        s, at = s.sort_values("offset"), 0
        for p in s.itertuples():
            assert p.offset == at
            at += p.length
        assert at == capacity or at < capacity and at & (at - 1) == 0  # no padding
    return out


def rows_of(rows):
    return [(i, t) for i, t, _ in rows]


def test_pack_round_trip(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(["the", "cat", "sat,", "éa", "Xyz."], k=r.randrange(90))), "s") for i in range(80)]
    rows += [(200, None, "s"), (201, "", "s"), (None, "a b", "s"), (202, "dup", "s"), (202, "dup", "s"), (203, "long " * 30_000, "s")]
    check_pack(spark, rows, 64)
    check_pack(spark, rows, CAPACITY)
    assert pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "doc_id long, text string"), WORDS, 0)


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_bins(capacity):
    """Each class's bins hold their number of tails; a document has at most one piece for a gap, its whole sequences and a tail, but for the end of the task."""
    r = random.Random(capacity)
    bins, sizes = Bins(capacity, 5), [r.choice([1, 2, 3, r.randrange(1, 3 * capacity + 1)]) for _ in range(900)]
    for i, n in enumerate(sizes):
        bins.add(i, memoryview(np.arange(n, dtype="<u4").tobytes()))
    before = len(bins.placed)
    bins.rest()
    last = {p[0] for p in bins.placed[before:]}
    tails = {}
    for i, start, n, crc, total, sequence, _ in bins.placed:
        assert total == sizes[i] and crc == zlib.crc32(np.arange(start, start + n, dtype="<u4").tobytes())
        if start + n == total and n < capacity and i not in last and start:
            tails.setdefault(sequence, []).append(n)
    assert all(len({class_of(n, capacity) for n in x}) == 1 for x in tails.values())
    pieces = Counts(p[0] for p in bins.placed)
    assert sum(p[2] for p in bins.placed) == sum(sizes)
    assert all(pieces[i] <= 2 + n // capacity for i, n in enumerate(sizes) if i not in last)
    assert len(last) <= 32 * 33
    assert [class_of(n, 64) for n in (64, 33, 32, 22, 21, 2, 1)] == [1, 1, 2, 2, 3, 32, 32]


WORD_PARTS = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "a<|STARTOFTEXT|>", "<|", "|>", "Foo", "BAR.", "é", "É,", "1", " ", "\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORD_PARTS), max_size=10))
def test_special_tokens_in_any_case(word_ids, parts):
    ids, whole = word_ids
    text = "".join(parts)
    assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def word_ids():
    return WordIds(WORDS), Tokenizer.from_file(WORDS)


LETTER_PARTS = ["the", "λόγος", "σς", "Σ", "ὀ", "ёжик", "џа", "Ѐ", "и\u0306", "Й", "schön", "ñandú", "ß", "ÿ", "÷", "É", "é", "e\u0301", "\u0301", "K\u0338", "क़", "ﬁ", "ª", "'", "'s", "'T", "*", "$$$", ".,", "</w>", "<w", "7", "x" * 70, "\x1c", "\u0085", " ", "  ", "\t", "\x0b\x0c", "\n"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LETTER_PARTS), max_size=9).map("".join), max_size=4))
def test_ids_of_many_texts(word_ids, texts):
    """Letters and the marks behind them, encoded apart, for several texts at once, as the tokenizer does it text by text."""
    ids, whole = word_ids
    found = [np.frombuffer(x, "<u4").tolist() for x in ids.of_all([t.encode() for t in texts])]
    assert found == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_broken_texts():
    """Bytes that are no UTF-8 become U+FFFD, as before."""
    ids, whole = WordIds(WORDS), Tokenizer.from_file(WORDS)
    raws = [b"", b" ", b"caf\xc3. caf\xe9 \xff", b"\xc3\xa9\xc3 ok"]
    expect = [[i for w in x.split() for i in whole.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids] for x in raws]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.of_all(raws)] == expect


def test_letters_bypass_the_whole_tokenizer():
    """What op6 spends is words through the whole tokenizer: only marks and words that aren't letters take that way, each once."""

    class Spy:
        def __init__(self, inner):
            self.inner, self.words = inner, []

        def encode_batch_fast(self, texts, **more):
            self.words += [w for t in texts for w in t.split(ids.between)]
            return self.inner.encode_batch_fast(texts, **more)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    ids, whole = WordIds(WORDS), Tokenizer.from_file(WORDS)
    spy = ids.tokenizer = Spy(ids.tokenizer)
    text = " ".join(f"{stem}{mark}" for stem in ("erndea", "schüß", "ñosíar", "the") for mark in ("", ".", ",", "$$$", ".%%%")) + " it's 12"
    for _ in range(2):
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert sorted(spy.words) == sorted([".", ",", "$$$", ".%%%", "it's", "12"])


def test_token_counts_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "the end", 7), (3, "x" * 200_000, 8), (3, "x" * 200_000, 8)]
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, score int"), MODEL).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 5 and by[1].n_tokens == by[2].n_tokens == 0 and by[None].n_tokens == Counter(read_pieces(MODEL)).of("the end")[0]
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
