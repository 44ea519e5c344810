"""Every stage of the pipeline against brute force on its own input."""

import re

import pytest

import corpus_pipeline
from palimpsest.llm import quality

from . import test_bpe, test_exact, test_mixing, test_neardup, test_quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "simhash near-dedup", "source mix", "byte-level bpe"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(~quality.held_out())
    model = quality.fit(docs, labels)
    rows, frame = docs.collect(), docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, sf)
        got = out.collect()
        if k < 4:
            assert out.columns == docs.columns
            ids = sorted(r.doc_id for r in got)
        plain = [(r.doc_id, r.text) for r in rows]
        if k == 0:
            assert ids == sorted(d for d, t in plain if test_quality.plain_score(model, (t or "").encode()) >= 0.5)
            assert len(ids) > 0.8 * len(rows) - 5
        elif k == 1:
            assert ids == sorted(x[0] for x in test_exact.brute(plain) if x[3])
        elif k == 2:
            fps = [(d, test_neardup.fingerprint(t)) for d, t in plain]
            assert ids == sorted(set(test_neardup.components(fps)))
        elif k == 3:
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            total, taken, most = {}, {}, {}
            for r in rows:
                total[r.source] = total.get(r.source, 0) + size(r.text)
                most[r.source] = max(most.get(r.source, 0), size(r.text))
            for r in got:
                taken[r.source] = taken.get(r.source, 0) + size(r.text)
            want = test_mixing.water(total)
            assert max(ids.count(i) for i in set(ids)) <= 2
            assert all(abs(taken.get(s, 0) - want[s]) <= 1.1 * most[s] for s in want)
        else:
            import public_tokenizers as P
            import tiktoken

            enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=test_bpe.V.ranks, special_tokens={})
            assert sorted(map(tuple, got)) == sorted((d, *test_bpe.brute(enc, t)) for d, t in plain)
        rows, frame = got, spark.createDataFrame(got, out.schema)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, fp long, size int"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, and columns with names of the stages' own."""
    prose = lambda k: " ".join(f"word{(k * 37 + i * i) % 991}" for i in range(60))
    rows = [(1, prose(1), "s"), (1, prose(1), "s"), (2, prose(2), "t"), (5, prose(1), "s"), (5, prose(5), "s"), (6, None, None), (7, "", "t"), (8, " \n\t ", "t"), (None, prose(9), None), (None, prose(1), "s"), (None, None, "t"), (9, prose(3) * 4000, "t"), (10, prose(4), None)]
    return spark.createDataFrame([(d, t, None, s, None, "x", None, 3) for d, t, s in rows], SCHEMA)


def test_stages_on_odd_rows(spark, sf, odd_docs):
    rows = {str((r.doc_id, r.text)) for r in odd_docs.collect()}
    of = lambda df: sorted((r.doc_id, r.text) for r in df.collect() if r.doc_id is not None)
    every = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd_docs, sf)
        assert out.columns == odd_docs.columns and {str((r.doc_id, r.text)) for r in out.collect()} <= rows, name
    prose = {d: t for d, t in every if t}
    left = of(corpus_pipeline.drop_exact(spark, odd_docs, sf))
    assert left.count((1, prose[1])) == 2 and (5, prose[5]) in left and (5, prose[1]) not in left and {d for d, _ in left} == {1, 2, 5, 8, 9, 10}
    left = of(corpus_pipeline.drop_near(spark, odd_docs, sf))
    assert left.count((1, prose[1])) == 2 and (5, prose[5]) in left and (5, prose[1]) not in left and {d for d, _ in left} == {1, 2, 5, 6, 9, 10}
    assert sum(r.doc_id is None for r in corpus_pipeline.drop_near(spark, odd_docs, sf).collect()) == 1
    out = corpus_pipeline.encode(spark, odd_docs, sf).collect()
    assert len(out) == len(every) and [r.n_tokens for r in out if r.doc_id == 6] == [0]
    none = spark.createDataFrame([], odd_docs.schema)
    assert all(stage(spark, none, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)
