import hashlib
import random

import pytest
from pyspark.sql import functions as F

from glyphlake.llm import fixity, line_chunks, naming

PLAN_WORDS = ("Python", "Pandas", "Arrow")


def texts(seed=2):
    r = random.Random(seed)
    base = ["".join(r.choices("abé\n", k=r.randrange(120))) for _ in range(25)] + ["", None, "x" * 64, "x" * 65, "x" * 128]
    return [(i, r.choice(base)) for i in range(160)] + [(7, "x" * 64), (7, "x" * 64), (None, "x" * 64), (None, None), (900, "long " * 3000), (901, "long " * 3000)]


@pytest.mark.parametrize("case", ["plain", "hot", "clash"])
def test_exact_groups_equal_brute_force(spark, tmp_path, monkeypatch, case):
    """Small blocks make many levels; with a low bound every repeated text takes the hot path; with a weak hash, contents share it."""
    if case == "hot":
        monkeypatch.setattr(naming, "LEAST_HOT", 1)
    weak = (lambda *c: F.xxhash64(*c) % 5) if case == "clash" else F.xxhash64
    rows = texts()
    spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, h string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = naming.exact_groups(docs, block=8, hashed=weak)
    assert not any(w in out._jdf.queryExecution().executedPlan().toString() for w in PLAN_WORDS)
    got = [tuple(r) for r in out.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        mine = [g for g in got if g[4] == sha]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, (g[0] for g in mine))) == sorted(map(str, ids))
        assert {(g[1], g[2]) for g in mine} == {(keep, len(ids))} and [g[0] for g in mine if g[3]] == [keep]
    named = docs.withColumns({"keep_n": F.lit(6), "keep_sha": F.col("text"), "row": F.lit("own"), "doc": F.lit(2)})
    named.write.parquet(str(tmp_path / "n"))
    left = naming.keep_one(spark.read.parquet(str(tmp_path / "n")))
    assert left.columns == named.columns and {(r.keep_n, r.row, r.doc) for r in left.collect()} == {(6, "own", 2)} and all(r.keep_sha == r.text for r in left.collect())
    kept = naming.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(groups)
    assert naming.exact_groups(docs.limit(0)).collect() == []


def brute_lines(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        lines = (text or "").split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        chunks = []
        for k, line in enumerate(lines):
            if k == 0 or (hashes[k - 1] * 31 + hashes[k]) % 2**32 % 4 == 0:
                chunks.append([])
            chunks[-1].append(line)
        keep = []
        for c in chunks:
            key = "\n".join(c)
            if len(c) > 1 and key in seen:
                continue
            keep.append(key)
            seen.add(key)
        out.setdefault(i, []).append(("\n".join(keep), len(lines), len(chunks)))
    return out


@pytest.mark.parametrize("case", ["plain", "hot", "clash"])
def test_line_chunks_equal_brute_force(spark, tmp_path, monkeypatch, case):
    if case == "hot":
        monkeypatch.setattr(naming, "LEAST_HOT", 1)
    weak = (lambda c: F.xxhash64(c) % 3) if case == "clash" else F.xxhash64
    r = random.Random(4)
    lines = [f"line {k}" for k in range(40)]
    passages = [[r.choice(lines) for _ in range(9)] for _ in range(4)]
    rows = []
    for i in range(60):
        body = [r.choice(lines) for _ in range(r.randrange(6))]
        rows.append((i, "\n".join(body + r.choice(passages) + [f"own {i}", ""])))
    rows += [(100, None), (101, ""), (None, rows[0][1]), (102, "a\n" * 20_000)]
    spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, chunk string").coalesce(1).write.parquet(str(tmp_path / "d"))
    out = line_chunks.deduplicate_lines(spark.read.parquet(str(tmp_path / "d")), hashed=weak)
    assert not any(w in out._jdf.queryExecution().executedPlan().toString() for w in PLAN_WORDS)
    expect = brute_lines(rows)
    got = out.collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g.text, g.n_lines, g.n_chunks) in expect[g.doc_id]
    assert sum(g.n_removed_lines for g in got) > 0
    assert line_chunks.deduplicate_lines(spark.read.parquet(str(tmp_path / "d")).limit(0)).collect() == []


def brute_passages(rows):
    """Lines left of each row, in the order of (doc_id, row); ``rows`` is in the order of the table."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    first, out = {}, {}
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        gone = set()
        for i in range(len(lines)):
            for n in (1, 2):
                if i + n > len(lines) or n == 1 and len(lines[i].encode()) <= line_chunks.LONG_LINE:
                    continue
                row, at = first.setdefault((n, *lines[i : i + n]), (k, i))
                if row != k or i >= at + n:
                    gone |= set(range(i, i + n))
        out[k] = (rows[k][0], len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("case", ["plain", "hot", "clash"])
def test_passages_equal_brute_force(spark, tmp_path, monkeypatch, case):
    """With a weak hash every line clashes with others and is told apart by its bytes."""
    if case == "hot":
        monkeypatch.setattr(naming, "LEAST_HOT", 1)
    if case == "clash":
        monkeypatch.setattr(line_chunks, "name_line", lambda line: F.xxhash64(line) % 3)
    r = random.Random(5)
    lines = [f"line {k}" for k in range(60)] + ["é" * 60, "w " * 60]
    rows = [(i, "\n".join(r.choices(lines, k=r.randrange(1, 9)) + [f"own {i}", ""])) for i in range(80)]
    rows += [(100, None), (101, ""), (None, rows[0][1]), (3, rows[3][1]), (102, "a\n" * 5000)]
    spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, line string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = line_chunks.deduplicate_passages(docs)
    assert not any(w in out._jdf.queryExecution().executedPlan().toString() for w in PLAN_WORDS)
    assert sorted(map(tuple, out.collect()), key=str) == brute_passages(rows)
    assert line_chunks.deduplicate_passages(docs.limit(0)).collect() == []


def test_planted_passages_are_removed_whole(spark, tmp_path):
    """Passages of 2 to 8 lines, and one long line, between lines of each document's own: all are removed but for their first place."""
    planted = [[f"passage {n} line {k}" for k in range(n)] for n in range(2, 9)] + [["long " * 60]]
    rows = [(i * 8 + k, "\n".join([f"before {i} {k}", *p, f"after {i} {k}"])) for i in range(6) for k, p in enumerate(planted)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = {x.doc_id: x for x in line_chunks.deduplicate_passages(docs).collect()}
    for i, k in ((i, k) for i in range(6) for k in range(8)):
        left = [f"before {i} {k}", *(planted[k] if i == 0 else []), f"after {i} {k}"]
        assert out[i * 8 + k].text.split("\n") == left
    chunks = {x.doc_id: x for x in line_chunks.deduplicate_lines(docs).collect()}
    assert sum(chunks[i].n_removed_lines for i in chunks) < sum(out[i].n_removed_lines for i in out)


def test_fixity_finds_each_difference(spark):
    rows = [(i, f"u{i}", f"body {i}" * (i % 5)) for i in range(300) if i % 7] + [(None, None, None), (8, "u8", "again"), (8, "u8", "again"), (5000, "far", "")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    changed = [("x" if r[0] == 40 else r[0], r[1], r[2]) for r in rows if r[0] != 41]
    changed = [(40 if i == "x" else i, u, ("!" + (t or "")[1:]) if i == "x" else t) for i, u, t in changed][:-1] + [(9000, "new", "n"), (8, "u8", "again")]
    b = spark.createDataFrame(changed, "page_id long, url string, html string")
    out = {r.id: r for r in fixity.audit(fixity.warc_records(a), fixity.warc_records(b), fanout=4).collect()}
    assert {i: r.status for i, r in out.items()} == {40: "corrupt", 41: "missing", 5000: "missing", 9000: "extra", 8: "corrupt"}
    size = {}
    for r in fixity.warc_records(a).select("id", F.octet_length("record").alias("n")).collect():
        size[r.id] = size.get(r.id, 0) + r.n
    order = sorted(size, key=lambda i: (i is not None, i))
    for i in (40, 41, 8, 5000):
        assert out[i].offset == sum(size[j] for j in order[: order.index(i)]) and out[i].expected_bytes == size[i]
    assert fixity.audit(fixity.warc_records(a), fixity.warc_records(a)).collect() == []
    none = a.limit(0)
    assert fixity.audit(fixity.warc_records(none), fixity.warc_records(none)).collect() == []
    assert fixity.audit(fixity.warc_records(a), fixity.warc_records(none)).count() == len(size)


def test_fixity_over_wide_ids(spark):
    """The smallest and the largest id there are, long bodies, and other columns called like the operator's own."""
    rows = [(-(2**63), "u", "a", 1, "x"), (-(2**63) + 1, "u", "b", 1, "x"), (-1, "u", "c", 1, "x"), (0, "u", "d", 1, "x"), (2**63 - 1, "u", "e" * 3_000_000, 1, "x"), (None, "u", "f", 1, "x")]
    make = lambda x: fixity.warc_records(spark.createDataFrame(x, "page_id long, url string, html string, slot int, hash string"))
    other = [(i, u, "!" if i in (0, 2**63 - 1) else t, n, h) for i, u, t, n, h in rows if i != -(2**63) and i is not None]
    out = {r.id: r for r in fixity.audit(make(rows), make(other), fanout=256).collect()}
    assert {i: r.status for i, r in out.items()} == {None: "missing", -(2**63): "missing", 0: "corrupt", 2**63 - 1: "corrupt"}
    assert out[2**63 - 1].expected_bytes > 3_000_000 and out[None].offset == 0 and out[0].offset == sum(len(r.record) for r in make([x for x in rows if x[0] is None or x[0] < 0]).collect())


@pytest.mark.parametrize("hot", [False, True])
def test_fixity_ends_at_the_record(spark, monkeypatch, hot):
    """One rotten record among many of an id, one copy less of another, and a lost null id; other records and order don't count."""
    if hot:
        monkeypatch.setattr(naming, "LEAST_HOT", 1)
    rows = [(8, f"u{k}", f"body {k}") for k in range(200)] + [(9, "u", "twin")] * 3 + [(None, None, None)] + [(i, "u", "b") for i in range(20, 60)]
    changed = [(i, u, "!" + t[1:]) if u == "u77" else (i, u, t) for i, u, t in rows if i is not None]
    changed.remove((9, "u", "twin"))
    a, b = (fixity.warc_records(spark.createDataFrame(x, "page_id long, url string, html string")) for x in (rows, changed[::-1]))
    sha = lambda x, where: x.where(where).select(F.sha2("record", 256).alias("s"), F.octet_length("record").alias("n")).first()
    rot, new, twin, none = sha(a, "record like '%URI: u77\r%'"), sha(b, "record like '%URI: u77\r%'"), sha(a, "id = 9"), sha(a, "id is null")
    expect = {(8, *rot, 1, 0), (8, *new, 0, 1), (9, *twin, 3, 2), (None, *none, 1, 0)}
    got = [tuple(r) for r in fixity.audit_records(a, b, fanout=4).collect()]
    assert len(got) == 4 and set(got) == expect
    assert fixity.audit_records(a, a).collect() == []
