import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphlake.llm import pii
from glyphlake.llm.pii import digest_columns, disclosing_terms, entities, luhn, parsed, sanitise_documents, sanitised


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 16 <= len(digits) <= 19 and luhn(digits) else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def sanitise(text, spans):
    return sanitised(text, [x for x in parsed(spans) if x[0] != "term"], [(a, b) for k, a, b in parsed(spans) if k == "term"])


PARTS = ["a", "b.c", "@", "@@", ".", "..", "-", "+", "1", "12.34.56.78", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", " ", "x@y.zz", "é", "\n", "0", "255", "٣"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16))
def test_base_spans_equal_plain_expressions(parts):
    text = "".join(parts)
    assert entities(text) == brute(text)


def test_long_numbers():
    assert entities("0" * 5000 + "1.1.1.1") == [("ip", 0, 5007)] and entities("9" * 10_000 + ".1.1.1") == []


def test_long_texts_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "1.2.3." * 60_000, "+1" + "(" * 300_000):
        entities(text)


def test_terms_above_the_threshold(spark):
    """A term that stands beside e-mails only is added; a common one isn't; a document without an entity is left alone."""
    rows = [(i, f"hear zorblat u{i}@mail.example.com the end of it all for now and then the rest of it goes on") for i in range(8)]
    rows += [(100 + i, "the end of it all for now and then " * 40) for i in range(20)] + [(200, "zorblat here")]
    out = {r.doc_id: r for r in digest_columns(sanitise_documents(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    text = rows[0][1]
    assert "term:5:12" in out[0].spans and out[0].n_email == 1
    assert "zorblat" not in sanitise(text, out[0].spans) and "[EMAIL]" in sanitise(text, out[0].spans)
    assert f"term:{text.index('the')}:" not in out[0].spans
    assert out[200].spans == "" and all(out[100 + i].spans == "" for i in range(20))


@pytest.mark.parametrize("listed", [20_000, 0])
def test_every_place_of_a_disclosing_term(spark, monkeypatch, listed):
    """Far from the entity too, in any document that holds its kind; a document with another kind only keeps the term."""
    monkeypatch.setattr(pii, "TERMS_LISTED", listed)
    far = "the end of it all for now and then the rest of it goes on"
    rows = [(i, f"hear zorblat u{i}@mail.example.com {far} Zorblat {far} zorblat@zorblat.example.com") for i in range(8)]
    rows += [(50, f"a@b.cc {far} zorblat"), (51, f"10.0.0.1 {far} zorblat"), (200, "zorblat here")] + [(100 + i, f"{far} " * 40) for i in range(20)]
    out = {r.doc_id: r for r in digest_columns(sanitise_documents(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    text = dict(rows)
    places = lambda i: [text[i][a:b].lower() for a, b in ((int(x.split(":")[1]), int(x.split(":")[2])) for x in out[i].spans.split(",") if x.startswith("term:"))]
    assert all(places(i).count("zorblat") == 2 for i in range(8)) and places(50) == ["zorblat"]
    assert places(51) == [] and out[200].spans == "" and "zorblat" not in sanitise(text[3], out[3].spans).lower()


def plain_spans(rows, window=4, alpha=1.5, contexts=5, chance=0.01):
    """Added spans by the definitions, without any of the operator's code but the base spans."""
    lower, words, near = Counter(), {}, Counter()
    seen = defaultdict(set)
    for i, text in rows:
        base = brute(text)
        words[i] = [(m.group().lower(), *m.span()) for m in re.finditer(r"[^\W\d_]+", text)]
        lower.update(w for w, _, _ in words[i])
        outside = lambda w: all(w[2] <= a or w[1] >= b for _, a, b in base)  # noqa: E731, B023
        taken = set()
        for k, a, b in base:
            own = [j for j, w in enumerate(words[i]) if w[1] < a][-window:] + [j for j, w in enumerate(words[i]) if w[1] >= b][:window]
            own = [j for j in own if outside(words[i][j])]
            context = (text[a:b], *(words[i][j][0] for j in own))
            for j in own:
                if (k, j) not in taken:
                    taken.add((k, j))
                    for c in ((k, None), (k, text[a:b])):
                        near[words[i][j][0], c] += 1
                        seen[words[i][j][0], c].add(context)
    total, slots = sum(lower.values()), Counter()
    for (_, c), n in near.items():
        slots[c] += n
    gives = defaultdict(set)
    for (t, c), n in near.items():
        ic = -math.log2(slots[c] / total)
        k = len({x[0] for x in seen[t, c]})
        rare = k * math.log(lower[t]) - ((k + 0.5) * math.log(k) - k + 0.5 * math.log(2 * math.pi) + 1 / (12 * k + 1)) + k * math.log(slots[c] / total) + math.log(4 * len(lower)) < math.log(chance)
        if ic > 0 and math.log2(n * total / (lower[t] * slots[c])) >= ic / alpha - 1e-12 and (len(seen[t, c]) >= contexts or c[1] is None and rare):
            gives[t].add(c)
    out = {}
    for i, text in rows:
        base = brute(text)
        own = {(k, None) for k, _, _ in base} | {(k, text[a:b]) for k, a, b in base}
        out[i] = [(a, b) for w, a, b in words[i] if gives[w] & own and all(b <= x or a >= y for _, x, y in base)]
    return out


@pytest.mark.parametrize("listed", [20_000, 0])
def test_added_spans_equal_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(pii, "TERMS_LISTED", listed)
    r = random.Random(3)
    common, rows = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)], []
    fill = lambda n: " ".join(r.choice(common) for _ in range(n))
    for i in range(120):
        who = r.randrange(6)
        text = fill(r.randrange(5, 60))
        if r.random() < 0.6:
            text += f" nick{chr(97 + who)} " + r.choice([f"u{who}@mail.example.com", f"10.0.0.{who}"]) + " " + fill(5)
        rows.append((i, text + (f" nick{chr(97 + who)}" if r.random() < 0.3 else "")))
    rows += [(500 + i, rows[3][1]) for i in range(9)]
    out = sanitise_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expect = plain_spans(rows)
    assert sum(map(len, expect.values())) > 20
    for x in out:
        assert [(y.a, y.b) for y in x.added] == expect[x.doc_id]
        assert x.text == sanitised(dict(rows)[x.doc_id], brute(dict(rows)[x.doc_id]), expect[x.doc_id])


def test_rare_terms_beyond_chance(spark):
    """Three documents are enough if their entities differ; three copies, or one document, are not."""
    far = "the end of it all for now and then the rest of it goes on"
    rows = [(i, f"{far} zorblat u{i}@mail.example.com {far}") for i in range(3)]
    rows += [(10 + i, f"{far} quibbon same@mail.example.com {far}") for i in range(3)] + [(20, f"{far} wexel one@mail.example.com {far}")]
    rows += [(100 + i, f"{far} " * 100) for i in range(40)]
    out = {r.doc_id: r for r in digest_columns(sanitise_documents(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    words = lambda i: [dict(rows)[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in out[i].spans.split(",") if x) if k == "term"]
    assert all("zorblat" in words(i) for i in range(3))
    assert not any("quibbon" in words(10 + i) for i in range(3)) and "wexel" not in words(20)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a@b.cc", "z"), (3, "a@b.cc", "z"), (3, "a@b.cc", "z")]
    out = digest_columns(sanitise_documents(spark.createDataFrame(rows, "doc_id long, text string, near string"))).collect()
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in out) == [("1", 0, ""), ("2", 0, ""), ("3", 1, "email:0:6"), ("3", 1, "email:0:6"), ("None", 1, "email:0:6")]
    assert digest_columns(sanitise_documents(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    assert callable(disclosing_terms)
