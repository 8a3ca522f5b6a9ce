"""Each stage of the corpus pipeline against a plain version, on nulls, ties, repeats, clashing columns and empty tables."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block long, score double, label string"


def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    line = lambda n=40: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, line() + (" hideous vile" * 3 if i % 5 == 0 else "")) for i in range(400)]
    base = line(120)
    rows += [(400, base), (401, base + " tail"), (402, base.replace(" ", "  ")), (403, "start " + base), (404, None), (405, ""), (406, " \n"), (407, line(20000)), (None, line()), (1, rows[1][1])]
    return rows


def tables(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, "x") for i, t in rows], DOCS)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(400 if rows else 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    tables(spark, path, corpus())
    return path


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def bare(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def test_toxicity_drops_marked_rows_only(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage("toxicity")(spark, docs, folder)
    assert out.columns == corpus_pipeline.COLUMNS
    assert kept(out) == Counter(x for x in corpus() if "hideous" not in (x[1] or ""))


def test_exact_dedup_keeps_one_row_of_equal_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(corpus_pipeline.COLUMNS)
    groups = {}
    for i, t in set(corpus()):
        groups.setdefault(bare(t), []).append((-len(t or ""), i is not None, i or 0, i, t))
    want = Counter(min(g)[3:] for g in groups.values())
    out = stage("exact dedup")(spark, docs, folder)
    assert out.columns == corpus_pipeline.COLUMNS and kept(out) == want


def test_near_dedup_keeps_the_smallest_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(corpus_pipeline.COLUMNS).where("doc_id IS NOT NULL AND doc_id >= 380")
    rows = [x for x in set(corpus()) if (x[0] or 0) >= 380]
    words = {i: (t or "").split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert len(set(label.values())) == len(label) - 3
    assert kept(stage("near dedup")(spark, docs, folder)) == Counter(x for x in rows if label[x[0]] == x[0])


def test_mixing_keeps_clean_rows_as_they_are(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(corpus_pipeline.COLUMNS)
    out = stage("mixing")(spark, docs, folder)
    got = kept(out)
    assert out.columns == corpus_pipeline.COLUMNS and not got - Counter(corpus())
    assert got == kept(stage("mixing")(spark, docs.repartition(7), folder))  # the draw depends on the rows alone


def test_packing_holds_every_token_once(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet").select(corpus_pipeline.COLUMNS)
    tok = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(corpus_pipeline.packing.TOKENIZER))
    out = stage("packing")(spark, docs, folder)
    want = Counter()
    for i, t in corpus():
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == dict(want)
    sizes = [r.n for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)


def test_run_and_empty_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    packed = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    left = {min(i for i, u in corpus() if i is not None and bare(u) == bare(t)) for i, t in corpus() if i is not None and "hideous" not in (t or "")} - {401, 402, 403, 400}
    assert packed - {None, 400, 402, 401} <= left and not packed & {403}
    none = tables(spark, str(tmp_path), [])
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none.select(corpus_pipeline.COLUMNS), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
