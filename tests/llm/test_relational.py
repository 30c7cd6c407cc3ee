"""Operators that SQL can express, against their SQL: chat formatting, the archive and the mix."""

from llm_helpers import DOCS, in_duckdb, prose, rows_of
from pyspark.sql import functions as F

from tidegraph.llm import chat, mixing, warc

TURNS = "conv_id long, turn long, role string, text string"
CHAT = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "<|im_end|> a <\\| b <|"),
    (1, 2, "assistant", "x<"),
    (1, 3, "assistant", "|y"),
    (1, 4, "user", None),
    (2, 0, "assistant", ""),
    (2, 1, None, "no role"),
    (2, 1, None, "no role"),
    (3, None, "us\ner<|", "null turn"),
    (3, 5, "assistant", "\U0001d11e" * 3),
    (4, 0, "user", "q " * 50_000),
    (None, 0, "user", "nobody"),
]

def same(query, sql, folder, spark):
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    assert rows_of(frame, columns) == in_duckdb(folder, sql, columns)

def test_chat_against_sql(spark, put):
    folder = put(conversations=spark.createDataFrame(CHAT, TURNS).withColumn("segments", F.lit(1)).withColumn("t", F.lit(2)))
    same(chat.op2_chat_format, chat.OP2_SQL, folder, spark)

def test_chat_merges_and_masks(spark):
    done = chat.format_chat(spark.createDataFrame(CHAT[:5], TURNS)).first()
    assert done["formatted"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\n<\\|im_end|> a <\\\\| b <\\|<|im_end|>\n<|im_start|>assistant\nx<<|im_sep|>|y<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [s["text"] for s in done["segments"] if s["loss"]] == ["x<", "|y"]

def test_chat_of_no_rows_is_the_probe_alone(spark, put):
    folder = put(conversations=spark.createDataFrame([], TURNS))
    assert [r["conv_id"] for r in chat.op2_chat_format(spark, folder).collect()] == [-1]

PAGES = "page_id long, url string, html string"
WEB = [(1, "http://a/x y\r\n", "same"), (2, None, "same"), (2, None, "same"), (3, "http://b", ""), (4, "http://c", None), (None, "u", "null id"), (None, "u", "same"), (7, "http://d", "é" * 70_000), (8, "e", "a\r\n\r\nb")]

def test_archive_against_sql(spark, put):
    folder = put(pages=spark.createDataFrame(WEB, PAGES).withColumn("digest", F.lit("clash")).withColumn("header", F.lit("clash")))
    same(warc.op4_warc_archive, warc.OP4_SQL, folder, spark)
    assert warc.op4_warc_archive(spark, put(pages=spark.createDataFrame([], PAGES))).count() == 0

def test_archive_stores_payloads_once_and_gives_records_back(spark, tmp_path):
    folder = f"{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(WEB, PAGES), folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 5
    warc.export_warc(spark, folder, f"{folder}/files")
    read = warc.parse_warc(spark, f"{folder}/files").collect()
    assert len(read) == len(WEB) and not any(r["error"] for r in read)
    blocks = {r["header"].split("urn:page:")[1].split(":")[0]: r["block"].decode() for r in read if "WARC-Type: response" in r["header"]}
    assert blocks["7"] == warc.HTTP + "é" * 70_000 and blocks["8"] == warc.HTTP + "a\r\n\r\nb"

def test_archive_of_large_payloads_only_has_no_small_revisits(spark, tmp_path):
    warc.write_archive(spark.createDataFrame(WEB, PAGES), f"{tmp_path}/big", min_bytes=5)
    assert {r["record_type"] for r in warc.read_archive(spark, f"{tmp_path}/big").collect()} == {"response"}

def test_urls_and_record_ids_are_exact(spark, tmp_path):
    urls = ["http://a/x y", "http://a/x%20y", "http://a/x\ty", "a\r\nWARC-Type: x", "\x00\x7f", "", None]
    rows = [(k, u, "p") for k, u in enumerate(urls)] + [(9, "r", "q")] * 3
    warc.write_archive(spark.createDataFrame(rows, PAGES), f"{tmp_path}/a")
    read = warc.described(warc.read_records(spark, f"{tmp_path}/a")).collect()
    assert sorted(((r["page_id"], r["url"]) for r in read), key=repr) == sorted(((i, u) for i, u, _ in rows), key=repr)
    assert len({r["id"] for r in read}) == len(rows) and {r["refers"] for r in read} - {None} <= {r["id"] for r in read if r["kind"] == "response"}

def test_files_with_bad_records(spark, tmp_path):
    good = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(good + b"WARC/1.0\r\nWARC-Type: x\r\n\r\nno length\r\n\r\n" + good + b"junk" + b"\r\n\r\n\r\n" + good + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut")
    read = [tuple(r)[1:] for r in warc.parse_warc(spark, str(tmp_path / "x.warc")).collect()]
    assert [None if b is None else bytes(b) for b, _ in read] == [b"abc", None, b"abc", None, b"abc", None]
    assert [e and e.split(" at ")[0] for _, e in read] == [None, "no length", None, "no version line", None, "cut off"]

def test_mix_against_sql(spark, put, clashing):
    folder = put(documents=clashing)
    same(mixing.op5_source_mix, mixing.OP5_SQL, folder, spark)
    many = spark.createDataFrame([(k, prose(k, 1 + k % 50), "en", None if k % 11 == 0 else f"s{k % 7 * (k % 3)}", 0) for k in range(600)], DOCS)
    same(mixing.op5_source_mix, mixing.OP5_SQL, put(documents=many), spark)
    assert mixing.op5_source_mix(spark, put(documents=many.limit(0))).count() == 0

def test_mix_meets_targets_and_caps(spark, put):
    rows = [(k, prose(k, 5 + k % 40), "en", "big" if k % 3 == 0 else f"s{k % 5}", 0) for k in range(900)]
    found = mixing.op5_source_mix(spark, put(documents=spark.createDataFrame(rows, DOCS))).toPandas()
    assert (found.taken <= 2 * found["size"]).all()
    for target, group in found.groupby("target"):
        assert abs(group.taken.sum() - round(target) * (group.source_size.nunique())) <= 1
    assert abs(found.groupby("source_size").target.first().sum() - 1.5 * found["size"].sum()) < 1e-6 * found["size"].sum()

def test_mix_of_documents_repeats_whole_rows(spark, clashing):
    rows = spark.createDataFrame([(k, prose(k, 5 + k % 40), "en", f"s{k % 3}", 0) for k in range(300)], DOCS)
    mixed = mixing.mix_documents(rows).toPandas()
    assert set(mixed.text) <= {r["text"] for r in rows.collect()} and list(mixed.columns) == rows.columns
    words = lambda texts: sum(len(t.split()) for t in texts)
    assert abs(words(mixed.text) - 1.5 * words(r["text"] for r in rows.collect())) <= 3 * 45
    assert mixing.mix_documents(clashing).columns == clashing.columns and mixing.mix_documents(clashing.limit(0)).count() == 0


def test_mix_of_rows_without_or_with_equal_ids(spark, put):
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    for ids in (lambda k: None, lambda k: 7, lambda k: k // 40):
        for text in (lambda k: "a b c d e", lambda k: f"w{k} b c d e"):
            rows = spark.createDataFrame([(ids(k), text(k), "en", "s", k) for k in range(400)], DOCS).repartition(5)
            mixed = mixing.mix_documents(rows).collect()
            assert len(mixed) == 600 and words(mixed) == 3000
            counts = {}
            for r in mixed:
                counts[r["n_chars"]] = counts.get(r["n_chars"], 0) + 1
            assert max(counts.values()) <= 2 and len(counts) == 400
            folder = put(documents=rows)
            same(mixing.op5_source_mix, mixing.OP5_SQL, folder, spark)
    repeated = spark.createDataFrame([(1, "a b", "en", "s", 2)] * 301, DOCS).repartition(4)
    assert len(mixing.mix_documents(repeated).collect()) in (451, 452)
