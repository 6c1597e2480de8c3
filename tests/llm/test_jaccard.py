import random
import re

from glyphlake.llm.jaccard import keep_one, near_groups


def sets_of(rows):
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((i, frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows):
    own = sets_of(rows)
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            a, b = own[i][1], own[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for k, (i, s) in enumerate(own):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(own)), key=str)


def fixture():
    r = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    fresh = lambda n: [r.choice(vocab) for _ in range(n)]
    passage, rows = fresh(40), []
    for k in range(40):  # chains and stars about the threshold
        base = fresh(r.choice([5, 6, 12, 40, 90]))
        rows.append(base)
        for _ in range(r.randrange(6)):
            copy = list(rows[-1] if r.random() < 0.5 else base)
            for _ in range(r.randrange(1, 1 + len(copy) // 18 + 1)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append(copy if r.random() < 0.7 else copy + fresh(r.randrange(8)))
    rows += [fresh(r.randrange(4, 10)) + passage + fresh(r.randrange(4, 10)) for _ in range(120)]  # a shared passage, no links by it
    rows += [passage + fresh(k) for k in range(9)] + [fresh(3) for _ in range(3)] + [["a", "b"], ["A", "b"], ["a"]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_components_equal_brute_force(spark):
    rows = fixture()
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (5, rows[5][1]), (903, rows[5][1].upper()), (904, "x " * 60_000), (905, "y é" * 3)]
    d = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, n int").repartition(5)
    got = sorted((tuple(r) for r in near_groups(d).collect()), key=str)
    assert got == brute(rows)
    # Ranges are split a second time.
    assert sorted((tuple(r) for r in near_groups(d, coarse=3).collect()), key=str) == got


def test_empty_and_kept(spark):
    d = spark.createDataFrame(fixture(), "doc_id long, text string")
    assert near_groups(d.limit(0)).collect() == []
    kept = keep_one(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(fixture())})
