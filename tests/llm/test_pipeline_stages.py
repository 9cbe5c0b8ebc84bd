"""The corpus pipeline on small tables: every stage's decision takes effect, and odd inputs pass."""

from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import near_dups, pieces

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def test_stages_in_order(spark, tmp_path):
    rows = [(i, " ".join(WORDS[(i * k + k * k) % 12] + str(i % 7) for k in range(60)), "en" if i % 2 else "de", f"src{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[3][1], "en", "src0", 1), (101, None, "en", None, None), (102, "123 !!!", "en", "src1", 7),
             (103, "token = abcdef123456 " + rows[5][1] + " more", "en", "src1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("kept"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in at.select("doc_id").collect()}
        if name == "near_duplicates":
            kept = {r["doc_id"] for r in near_dups.near_duplicates(before).where("kept").collect()}
            assert seen[name] == kept and 100 not in kept
        if name == "secret_scan":
            marked = {r["doc_id"]: r for r in at.collect()}
            assert seen[name] == seen["near_duplicates"]
            assert all("abcdef123456" not in r["text"] for r in marked.values())
            assert all(r["n_chars"] == len(r["text"]) for r in marked.values())
    assert not {101, 102} & seen["language_id"] and {0, 1, 2} <= seen["language_id"]
    back = pieces.decode(at).collect()
    assert back and all(r["decoded"] == r["text"] for r in back)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_empty_tables_pass(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_stage_takes_pairs_from_80_percent(spark, tmp_path):
    """Ten changed words in 500 leave 446 of 546 shingles (0.817); thirteen leave 431 of 561 (0.768)."""
    rows = []
    for k in range(40):
        base = [f"d{k}w{i}" for i in range(500)]
        for copy, changes in ((1, 10), (2, 13)):
            text = list(base)
            for c in range(changes):
                text[20 + 30 * c] = f"new{k}x{copy}x{c}"
            rows.append((1000 * copy + k, " ".join(text)))
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == {*range(40), *range(2000, 2040)}
    assert near_dups.near_duplicates(docs).where("kept").count() == len(rows)
