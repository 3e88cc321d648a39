from __future__ import annotations

from collections import Counter

import corpus_pipeline as p
import pytest
from larkspur.llm import quality_classifier
from larkspur.llm.common import written

from . import plain
from .test_operators import WORDS, empty, nasty  # noqa: F401  fixtures


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_names():
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "bpe"]


@pytest.mark.parametrize("where", ["nasty", "sf", "clashing"])
def test_stages_against_plain_versions(spark, sf, nasty, where, tmp_path):  # noqa: F811
    at = sf if where == "sf" else nasty
    docs = spark.read.parquet(f"{at}/documents.parquet")
    if where == "clashing":
        # Names that the stages use for columns of their own.
        docs = docs.selectExpr("doc_id", "text", "source", *[f"'own' AS `{c}`" for c in ("_id", "_source", "_size", "_times", "_kept", "_none", "_key", "key", "none", "own", "times", "n_lines", "n_dropped", "score", "kept", "size", "id", "words", "of", "version", "own_0")])
    docs = written(docs, "docs")
    rows = lambda df: df.select("doc_id", "text", "source").collect()
    texts = lambda some: [(r.doc_id, r.text) for r in some]

    before = rows(docs)
    sample = [t for _, t in sorted(set(texts(before)), key=str) if t and WORDS.search(t)]
    scores = plain.quality_scores([r.text for r in before], sample)
    good = written(p.classify(spark, docs, at), "good")
    assert good.columns == docs.columns and all(abs(x - 0.5) > 0.01 for x in scores)
    assert Counter(texts(rows(good))) == Counter((r.doc_id, r.text) for r, x in zip(before, scores, strict=True) if x >= quality_classifier.KEEP_FROM)

    before = rows(good)
    lines = written(p.dedup_lines(spark, good, at), "lines")
    assert lines.columns == docs.columns
    assert Counter((i, t or "") for i, t in texts(rows(lines))) == Counter((i, left) for (i, _), (_, left) in zip(texts(before), plain.lines_left(texts(before)), strict=True))

    before = rows(lines)
    near = written(p.dedup_near(spark, lines, at), "near")
    # Each row without an id is a document of its own here.
    ids = [(n, r.text) if r.doc_id is None else (r.doc_id - 10**9, r.text) for n, r in enumerate(before)]
    root = plain.components(ids, 5)
    heads = {r for i, r in root.items() if i == r}
    want = Counter(i + 10**9 if i < 0 else None for i in heads)
    assert near.columns == docs.columns and Counter(r.doc_id for r in rows(near)) == want

    before = rows(near)
    mix = written(p.mix(spark, near, at), "mix")
    whole = [(r.doc_id, r.source, len(WORDS.findall(r.text or ""))) for r in before]
    want = Counter()
    for r, n in zip(before, plain.times(whole), strict=True):
        want[r.doc_id, r.text, r.source] += n
    assert mix.columns == docs.columns and Counter(map(tuple, rows(mix))) == +want

    if where == "clashing":
        assert all(v == "own" for r in mix.collect() for v in r[3:])
    tok = library()
    want = Counter()
    for r in rows(mix):
        own = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, tuple(own), len(own)] += 1
    last = p.encode(spark, mix, at)
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in last.collect()) == want


def test_whole_pipeline(spark, nasty, empty):  # noqa: F811
    assert p.run(spark, empty).count() == 0
    assert p.run(spark, nasty).count() > 5
