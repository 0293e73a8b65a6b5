"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import importlib
from collections import Counter

import public_tokenizers

from folia.llm import decontaminate, near_dup, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append((docs, out))
        docs = out
    assert all(out.columns == columns for _, out in seen[:-1])
    assert all(0 < out.count() <= before.count() for before, out in seen[:-1])

    for r in seen[0][1].collect():  # no document that fails the base tests is left
        n, _, _, _, again, *_ = quality_rules.text_stats(r.text)
        assert n >= 50 and 100 * again <= 50 * n

    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in seen[2])
    from tests.llm.test_ops_small import brute_classes

    groups = {}
    for row, c in zip(before, brute_classes(before), strict=True):
        groups.setdefault(c, []).append(row[0])
    assert sorted(i for i, _ in after) == sorted(min(g) for g in groups.values())

    bench = [(r.item_id, near_dup.plain_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = lambda t: any(" ".join(w) in " ".join(near_dup.plain_words(t)) for _, w in bench)
    left = {r.doc_id for r in seen[3][1].collect()}
    assert all(r.doc_id not in left for r in seen[3][0].collect() if held(r.text))
    index = decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 5, 0.8)
    assert left == {r.doc_id for r in seen[3][0].collect() if not index.search(r.text)}

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter({r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen[4][0].collect()})
    got = Counter()
    for r in seen[4][1].collect():
        got[r.doc_id] += r.length
    assert got == want
