"""The whole pipeline against SQL and brute force, stage by stage, over the smallest documents."""

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
from conftest import SMALL
from oracle import connect
from test_operators import brute, classes, slow_fingerprint, slow_spans

from oxbow.llm import decontaminate, mix, pii, quality


def leaks(text, items):
    w = decontaminate.words_of(text)
    mine = set(decontaminate.shingles(w))
    for iw, s in items:
        if mine & set(s) and any(decontaminate.similarity(decontaminate.shingles(w[k : k + len(iw)]), s) >= 0.8 for k in range(len(w) - len(iw) + 1)):
            return True
    return False


def redacted(text):
    out, pos = "", 0
    for a, k, b in slow_spans(text):
        if b > pos:
            out += text[pos:a] + f"<{pii.KINDS[k].upper()}>" if a >= pos else ""
            pos = b
    return out + text[pos:]


def test_pipeline_equals_brute_force(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    con = connect(SMALL)
    docs = con.sql(f"with {quality.RATED_SQL} select doc_id, text, source from judged where not base_failed and not beyond order by doc_id").fetchall()
    fps = np.array([slow_fingerprint(t) for _, t, _ in docs], np.uint64)
    docs = [d for k, (d, r) in enumerate(zip(docs, classes(len(docs), brute(fps)), strict=True)) if r == k]
    items = [(w, decontaminate.shingles(w)) for (t,) in con.sql("select text from benchmark").fetchall() if (w := decontaminate.words_of(t))]
    docs = [(d, redacted(t), s) for d, t, s in docs if not leaks(t, items)]
    frame = pd.DataFrame(docs, columns=["doc_id", "text", "source"])  # noqa: F841  read by the SQL
    sized = r"select row_number() over () as rid, doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as size from frame"
    want = dict(duckdb.sql(f"with docs as ({sized}), {mix.MIX_SQL} select doc_id, copies from mixed where copies > 0 and size > 0").fetchall())
    assert {d: r.mix_copies for d, r in got.items()} == want
    texts = {d: t for d, t, _ in docs}
    assert all(r.text == texts[d] and r.n_chars == len(texts[d]) for d, r in got.items())
