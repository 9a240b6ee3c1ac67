"""Nulls, empty and long texts, ties and repeats, empty tables, clashing columns: every operator gives its defined result."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from oxbow.llm import chat, decontaminate, html, licenses, mix, pii, quality, simhash, toxicity, url_filter
from oxbow.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} of the" for i in range(40_000))
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (None, "a b c d e f", None, "b", 11), (5, LONG, "en", "a", len(LONG)), (6, LONG, "fr", "b", len(LONG))]


def clashing(df):
    """df with columns named as operators name theirs."""
    for c in ("size", "copies", "fingerprint", "score", "_ox_row", "_OX_RATED", "verdict", "f_fences", "lang_", "target", "kept", "mix_Copies", "g_fp"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module", params=["plain", "clashing", "empty"])
def docs(spark, request):
    df = spark.createDataFrame([] if request.param == "empty" else ROWS, DOCS)
    return clashing(df) if request.param == "clashing" else df


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "a b c d e f"), (4, "a b c d e f")], "item_id long, text string")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_documents(spark, docs, items):
    n = docs.count()
    q = quality.rate_documents(docs).collect()
    assert len(q) == n
    assert {(r.doc_id, r.n_words, r.base_failed) for r in q if r.doc_id in (1, 2, 3)} == ({(1, 0, True), (2, 0, True), (3, 0, True)} if n else set())
    s = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    if n:
        assert s[1].fingerprint == "0" * 16
        assert s[1].component_id == s[2].component_id == s[3].component_id == 1
        assert s[5].component_id == s[6].component_id == 5
        assert s[None].component_id is None
    lic = licenses.scan(docs, licenses.templates(spark)).collect()
    assert len(lic) == n and all(r.labels == "" and r.score == 0 and r.first_word is None for r in lic)
    leaks = by_id(decontaminate.leaks(docs, items).select("doc_id", "item_id", "similarity"))
    assert leaks == (sorted([(4, 3, 1.0), (4, 3, 1.0), (None, None, 1.0), (None, 4, 1.0)], key=repr) if n else [])
    assert decontaminate.clean(docs, items).count() == max(0, n - 3)
    found = pii.find(docs).collect()
    assert len(found) == n and all((r.spans, r.n_spans) == ("", 0) for r in found)
    rows = docs.select("doc_id", "source", mix.size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    from oxbow.llm._common import stage

    m = mix.schedule(stage(rows, "rows")).collect()
    assert len(m) == n and all(0 <= r.copies <= 3 for r in m)
    assert all(r.copies == 0 for r in m if r.size == 0)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        scored = toxicity.score(docs, toxicity.train(docs, known)).collect()
        assert len(scored) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored)


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        out.count()
    assert "mix_time" in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns


def test_pages(spark):
    kind = "page_id long, url string, html string, host string, rule string, text string"
    rows = [(1, None, None, "h", "r", "t"), (2, "", "", "h", "r", "t"), (2, "", "", "h", "r", "t"), (None, "HTTP://A.Com/x?y", "<p>", "h", "r", "t"), (3, "x://WWW.example.COM/en/a://b", "<article><p>a<p>b", "h", "r", "t")]
    for df in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        n = df.count()
        got = by_id(url_filter.judge(df, url_filter.rule_table(spark)))
        assert got == (sorted([(1, "", "", None, "allow"), (2, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "a.com", "/x", "com/", "allow"), (3, "www.example.com", "/en/a://b", "www.example.com/en/", "allow")], key=repr) if n else [])
        text = {r.page_id: r.text for r in html.extract(df).collect()}
        assert text == ({1: "", 2: "", None: "", 3: "a\nb"} if n else {})


def test_rules_with_any_path(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/yz/w"), (2, "http://a.b.c/x/y"), (3, "http://b.c"), (4, "http://xb.c/x/yz")], "page_id long, url string")
    rules = spark.createDataFrame([("block", "B.c", "/x/yz"), ("allow", "b.c", "/x/yz"), ("block", "c", "/x/"), ("allow", "b.c", None), ("block", None, "/"), ("block", "", "/")], "verdict string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: ("b.c/x/yz", "block"), 2: ("c/x/", "block"), 3: ("b.c", "allow"), 4: ("c/x/", "block")}


def test_conversations(spark):
    kind = "conv_id long, turn long, role string, text string, piece string"
    rows = [(1, 1, "assistant", "<|end|> <|| <|", "x"), (1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (None, None, None, "a", "x"), (2, 0, "assistant", '[{"type":"image"}]', "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.conversations(spark.createDataFrame(rows, kind))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[2].loss_chars) == (3, 14, 1, 18)
    assert chat.conversations(spark.createDataFrame([], kind)).count() == 0


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
