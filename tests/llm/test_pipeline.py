import hashlib
import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_ngram_join import brute as brute_components
from tests.llm.test_secrets import brute as brute_secrets

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run_against_brute_force(spark):
    from auditweave.llm.mixing import mixed
    from auditweave.llm.rulefit import quality_scores

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources", "BPE encoding"]
    docs, texts = documents, {r.doc_id: r.text for r in documents.collect()}

    good = {r.doc_id for r in quality_scores(documents, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert 0 < len(good) < len(texts)
    comps = brute_components([(i, texts[i]) for i in sorted(good)])
    single = {d for _, d, _, c in comps if d == c}

    def clean(t):
        at, out = 0, ""
        for s in filter(None, brute_secrets(t)[4].split(",")):
            a, b = map(int, s.split(":")[1:])
            out += t[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        return out + t[at:]

    want = {i: clean(texts[i]) for i in single}
    assert any("[SECRET]" in t for t in want.values())
    left = spark.createDataFrame([(r.doc_id, want[r.doc_id], r.lang, r.source, r.n_chars) for r in documents.collect() if r.doc_id in single], documents.schema)
    copies = {r.doc_id: r.copies for r in mixed(left).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, n in copies.items():
        ids = library.encode(want[i], add_special_tokens=False).ids
        expected += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), ids)] * n
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.ids) for r in pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(expected)

    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns, name
        assert out.limit(0).count() == 0
        docs = out


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, "a b c d e f " * 3, "en", "s", 3), (1, "a b c d e f " * 3, "en", "s", 3), (None, None, None, None, None), (2, "", "en", None, 0), (3, "token = abcdefghijklmnop", "en", "s", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            stage(spark, d, SF).collect()
    once = pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in once) == ["1", "2", "3", "None"]
    assert {r.doc_id: (r.text, r.n_chars) for r in pipeline.secrets(spark, docs, SF).collect()}[3] == ("[SECRET]", 8)
