"""Every stage against plain code, on its own input; then the whole run against the stages in turn."""

from collections import defaultdict

import corpus_pipeline as cp
from depthframe.llm import quality
from depthframe.llm.common import materialize
from depthframe.llm.decontamination import Matcher

from test_mixing import brute as mixing_brute
from test_near_copies import common, roots, shingle_set
from test_secret_scan import redacted


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pipeline(spark, testdata):
    sf = f"{testdata}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    outs = [docs]
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, outs[-1], sf), "test-stage")
        if name != cp.STAGES[-1][0]:
            assert out.schema == docs.schema
        outs.append(out)

    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert rows(outs[1]) == [r for r in rows(docs) if r[0] in good]

    kept = sorted(rows(outs[1]), key=lambda r: r[0])
    sets = [shingle_set(r[1]) for r in kept]
    root = roots(sets, common(sets))
    assert rows(outs[2]) == sorted((r for i, r in enumerate(kept) if root[i] == i), key=str)

    matcher = Matcher([r.text for r in bench.collect()])
    assert rows(outs[3]) == [r for r in rows(outs[2]) if not matcher.find(r[1])]

    assert outs[4].select("doc_id", "lang", "source").exceptAll(outs[3].select("doc_id", "lang", "source")).count() == 0
    assert outs[4].count() == outs[3].count()
    before, after = ({r.doc_id: r for r in x.collect()} for x in (outs[3], outs[4]))
    assert {i: r.text for i, r in after.items()} == dict(redacted([(r.doc_id, r.text, r.source) for r in before.values()]))
    for i, r in after.items():
        assert (r.text == before[i].text) == ("[secret]" not in r.text)
        assert r.n_chars == (len(r.text) if "[secret]" in r.text else before[i].n_chars)

    mixed = [(r.doc_id, r.text, r.source) for r in outs[4].collect()]
    size, by, total, target = mixing_brute(mixed)
    taken = defaultdict(int)
    for r in outs[5].collect():
        taken[(r.source is None, r.source or "")] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in by)

    assert rows(cp.run(spark, sf)) == rows(outs[5])
