from auditweave.plans.catalog import QUERIES
from auditweave.sources.files import source_files


def test_a_document_over_a_million_bytes_is_scanned(spark, tmp_path):
    text = "plain words\n" * 100_000 + "write to someone@example.org\n"
    docs = spark.createDataFrame([(1, text, "en", "web"), (2, "a@b.org", "en", "web"), (3, None, "en", "web")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    got = {(r.file, r.line, r.evidence) for r in QUERIES["q01_scan_findings"](spark, str(tmp_path / "in")).collect()}
    assert got == {("web/1.en", 100_001, "write to someone@example.org"), ("web/2.en", 1, "a@b.org")}


def test_source_files_keep_the_size_rule(spark, tmp_path):
    (tmp_path / "big.py").write_text("x" * 1_000_001)
    (tmp_path / "most.py").write_text("x" * 1_000_000)
    assert [r.file for r in source_files(spark, str(tmp_path)).select("file").collect()] == ["most.py"]
