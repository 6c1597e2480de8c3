import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard import brute as brute_near


def test_pipeline_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    vocab = [f"word{k}" for k in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(15)) for i in range(5)]
    clean = [text(r.randrange(30, 80)) for _ in range(80)]
    bad = [text(20) + " vile grub vile grub " + text(15) for _ in range(20)]
    texts = clean + bad + clean[:10] + [t + " tail" for t in clean[10:20]] + [clean[20 + i] + " " + items[i % 5][1] for i in range(5)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, int(80 <= i < 100)) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    left = [(i, t) for i, t, *_ in docs if "vile" not in t]
    last = {}
    for i, t in left:
        last[t] = max(i, last.get(t, i))
    left = [(i, t) for i, t in left if last[t] == i]
    near = {i: c for i, _, c in brute_near(left)}
    left = [(i, t) for i, t in left if near[i] == i]
    hits = {i: n for i, _, n, _ in brute_hits(left, items)}
    left = [(i, t) for i, t in left if not hits[i]]

    stage_docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, stage_docs, str(tmp_path)).columns == stage_docs.columns
        assert f(spark, stage_docs.limit(0), str(tmp_path)).collect() == []
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    whole = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    assert set(out.doc_id) == {i for i, _ in left}
    for i, t in left:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own, at = out[out.doc_id == i].sort_values("start"), 0
        for p in own.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and columns called as the operators' own, through every stage in turn."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "row", "doc", "keep_n", "sid", "near_gone", "hits", "term", "start"]
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    texts = [(1, None), (2, ""), (None, "alone in the text with no id"), (3, "twice the same row in here"), (3, "twice the same row in here"), (4, long), (5, long + " tail"), (6, "vile grub vile grub vile grub"), (7, "plain words of no harm at all"), (None, None), (8, " \n\t "), (9, "x" * 300_000)]
    texts += [(20 + i, f"clean words number {i} and more of them") for i in range(30)] + [(60 + i, f"vile grub {i} vile grub here") for i in range(20)]
    rows = [(i, t, "en", "s", 0, "own", 5, 6, 7, 8, None, "t", 9) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, doc int, keep_n int, sid long, near_gone int, hits string, term string, start int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "plain words of no"), (None, "clean"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(20 + i, 0) for i in range(30)] + [(60 + i, 1) for i in range(20)] + [(6, 1), (None, 1), (7, None)]
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert {(r.row, r.doc, r.keep_n, r.sid, r.near_gone, r.start) for r in kept[name]} == {("own", 5, 6, 7, 8, 9)}
    ids = {name: sorted(str(r.doc_id) for r in own) for name, own in kept.items()}
    assert "6" not in ids["toxicity"] and ids["toxicity"].count("3") == 2 and {"1", "2", "4", "5", "7", "9", "None"} <= set(ids["toxicity"])
    assert ids["exact_dedup"].count("3") == 1 and "1" not in ids["exact_dedup"] and "2" in ids["exact_dedup"]  # of no text, the largest id
    assert "5" not in ids["near_dedup"] and "4" in ids["near_dedup"] and "None" in ids["near_dedup"]
    assert "7" not in ids["decontamination"] and {"2", "4", "9"} <= set(ids["decontamination"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert packed[packed.doc_id == 2].length.tolist() == [1] and packed.length.sum() == packed.drop_duplicates("doc_id").doc_tokens.sum()
