import random
import re

import duckdb
import pandas as pd

from glyphlake.llm.decontaminate import contamination_report, find_contamination
from glyphlake.llm.queries import ORACLE


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for p in range(len(w) - n + 1) if wins else ():
                if tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
                    found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(3)
    vocab = ["alpha", "Beta", "gam-ma", "é", "Delta9", "the", "of", "zu"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(30)] + [(7, "the of"), (50, None)]
    docs = [(i, " ".join(r.choices([*vocab, "x1", "y2"], k=r.randrange(60)))) for i in range(60)]
    for i in range(60, 90):
        t = items[r.randrange(len(items))][1] or ""
        docs.append((i, f"q1 {t}. q2"))
    return docs + [(500, None), (501, ""), (501, ""), (None, "the of"), (502, "zz " * 100_000 + (items[4][1] or "the"))], items


def test_equals_brute_force_in_one_block_and_in_many(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*x, "h") for x in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    expect = brute(docs, items)
    for size in (10**7, 150):
        got = find_contamination(d, b, block_chars=size).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(set(r["items"]))) for r in got), key=str) == expect


def brute_matches(docs, items):
    """Extend every pair of places to the right as far as words agree, from where they don't agree to the left."""
    out = []
    for doc_id, text in docs:
        w, own = words(text), []
        for item, t in items:
            v = words(t)
            for p in range(len(w)):
                for q in range(len(v)):
                    if w[p] != v[q] or p and q and w[p - 1] == v[q - 1]:
                        continue
                    n = 1
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if n >= min(10, len(v)):
                        own.append((p, str(item), q, n))
        out.append((doc_id, sorted(own)))
    return sorted(out, key=str)


def test_longest_matches_equal_brute_force(spark):
    docs, items = fixture()
    long = " ".join(f"w{k}" for k in range(40))
    docs = [*docs[:-1], (600, f"x1 {long} y2"), (601, f"w5 {long.replace('w20', 'zz')}")]
    items = [*items, (90, f"start {long}")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (10**7, 150):
        got = find_contamination(d, b, block_chars=size, with_matches=True).collect()
        expect = brute_matches(docs, items)
        assert sorted(((r.doc_id, sorted(map(tuple, r.matches))) for r in got), key=str) == expect
        best = [(i, min(((-n, p, item, q) for p, item, q, n in own), default=None)) for i, own in expect]
        assert sorted(((r.doc_id, (-r.longest.length, r.longest.doc_start, r.longest["item"], r.longest.item_start) if r.longest else None) for r in got), key=str) == sorted(best, key=str)
    own = {r.doc_id: [tuple(m) for m in r.matches] for r in got}
    assert own[600] == [(1, "90", 1, 40)] and sorted(own[601]) == [(1, "90", 1, 20), (22, "90", 22, 19)]


def test_report_equals_its_sql(spark):
    """Longest matches too, with ties and repeated words."""
    docs, items = fixture()
    docs = [(i, t) for i, t in docs if i not in (None, 501)] + [(700, "the the the " * 9), (701, "of the of the " * 30)]
    items = [*items, (91, "the " * 14), (92, "of the " * 12)]
    own, bench = pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"])
    con = duckdb.connect()
    con.register("documents", own)
    con.register("benchmark", bench)
    expect = con.execute(ORACLE["op4_benchmark_decontamination"]).fetchall()
    got = contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, expect)) == sorted(str(tuple(r)) for r in got.collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination_report(docs, none).collect()] == [(2, 0, False)]
    assert contamination_report(docs.limit(0), none).collect() == []
