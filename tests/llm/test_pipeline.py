"""The pipeline against its stages' plain versions, one after the other."""

import os
from collections import Counter

import pytest
from conftest import DATA
from test_brute import classes, fingerprint, secret_base

import corpus_pipeline
from migrascope.llm import mixing, quality

SF = f"{DATA}/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs)
        if i < 4:
            assert docs.columns == COLUMNS
    start = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [{r.doc_id: r for r in d.collect()} for d in seen[:3]]

    kept = {r.doc_id for r in quality.digest(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    assert rows[0] == {i: start[i] for i in kept}
    ids = sorted(kept)
    root = classes(ids, [fingerprint(start[i].text) for i in ids])
    assert rows[1] == {i: start[i] for i in set(root.values())}

    for i, r in rows[2].items():
        text, at, out = rows[1][i].text, 0, ""
        for a, _, _, b in secret_base(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        out += text[at:]
        assert r.text == out and r.n_chars == len(out) and (r.lang, r.source) == (rows[1][i].lang, rows[1][i].source)
    assert rows[2].keys() == rows[1].keys()

    copies = {r.doc_id: r.copies for r in mixing.digest(seen[2]).collect() if r.copies}
    assert Counter(r.doc_id for r in seen[3].collect()) == Counter(copies)
    assert all(rows[2][r.doc_id] == r for r in seen[3].collect())

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tokens = {i: len(tok.encode(rows[2][i].text, add_special_tokens=False).ids) + 1 for i in copies}
    got = Counter()
    for r in seen[4].collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == tokens[r.doc_id]
    assert got == Counter({i: copies[i] * tokens[i] for i in copies})

    whole = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in whole.where("start = 0").collect()) == Counter(copies)
