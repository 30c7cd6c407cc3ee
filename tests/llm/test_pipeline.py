"""The corpus pipeline, stage by stage and as a whole, against plain Python."""

import hashlib
from collections import Counter

import corpus_pipeline
from llm_helpers import DOCS, edited, prose
from pyspark.sql import functions as F

from tidegraph.llm import quality, secrets


def tables(spark, put):
    rows, labels = [], []
    for k in range(240):
        text = prose(k, 60)
        if k % 6 == 0:
            text = " ".join(w + "###" for w in text.upper().split())
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, int(k % 6 != 0), 0))
    rows += [(1000 + k, rows[1][1], "en", "s1", 0) for k in range(5)]  # exact copies
    rows += [(2000 + k, edited(rows[2][1], k), "en", "s2", 0) for k in range(5)]  # near copies
    rows.append((3000, prose(3000, 60) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "s3", 0))
    rows.append((3001, None, None, None, None))
    docs = spark.createDataFrame(rows, DOCS)
    return put(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), rows


def test_stages_are_named_and_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_against_plain_python(spark, put):
    folder, rows = tables(spark, put)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        outs.append(docs)
        if k < 4:
            assert docs.columns == before.columns, name
    ids = [{r["doc_id"] for r in o.select("doc_id").collect()} for o in outs]
    # Quality: junk goes, clean texts stay, just as the model scores them.
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    import numpy as np

    wanted = {i for i, t, *_ in rows if model.score(np.array([quality.features(t or "")]))[0] >= quality.THRESHOLD}
    assert ids[0] == wanted and not ids[0] & {k for k in range(240) if k % 6 == 0} and {k for k in range(240) if k % 6} <= ids[0]
    # Near copies: one of each group.
    assert ids[0] - ids[1] == {i for i in ids[0] if 1000 <= i < 1005 or 2000 <= i < 2005}
    # Secrets: gone from the texts, all else as it was.
    texts = {r["doc_id"]: r["text"] for r in outs[2].collect()}
    assert ids[2] == ids[1] and all(not secrets.scan(t or "") for t in texts.values())
    assert sum(texts[i] != t for i, t, *_ in rows if i in texts) == (3000 in texts)
    # Mixing: whole rows, near one and a half times the words.
    words = lambda o: sum(len((r["text"] or "").split()) for r in o.collect())
    assert abs(words(outs[3]) - 1.5 * words(outs[2])) <= 4 * 62
    assert max(Counter(r["doc_id"] for r in outs[3].collect()).values()) <= 2
    # Encoding: a row for each row of the mix.
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in outs[4].collect()) == sorted((r["doc_id"], digest(lib.encode(r["text"] or "", add_eos=True))) for r in outs[3].collect())
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, outs[4].collect()))


def test_stages_of_no_rows(spark, put):
    folder = put(documents=spark.createDataFrame([], DOCS).withColumn("fp", F.lit(1)), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_python_stages_begin_with_collected_heaps(spark):
    """In local mode the executor's JVM is the driver's, which counts its collections."""
    from tidegraph.llm.common import give_back_heap

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before = count()
    give_back_heap(spark)
    assert count() >= before + spark.sparkContext.defaultParallelism
    docs = spark.createDataFrame([(1, "a text", "en", "s", 6)], DOCS)
    for stage in (corpus_pipeline.redact_secrets, corpus_pipeline.encode_pieces):
        before = count()
        stage(spark, docs, "")
        assert count() > before
