"""The pipeline's stages one by one against the operators' own brute-force rules, and its whole result."""

import collections
import re

import pytest

import corpus_pipeline
from lobspark.llm import pii, quality
from lobspark.llm.common import stored, table
from tests.llm.test_operators import EDGE, brute_components
from lobspark.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stored(stage(spark, docs, SF))
    return [*out, docs]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, kept):
    raw, good, single, clean, masked, packed = kept
    for df in (good, single, clean, masked):
        assert df.columns == raw.columns
    a, b, c, d, e = map(rows, (raw, good, single, clean, masked))
    score = {r.doc_id: r.score for r in quality.scored(raw, quality.learned(raw, table(spark, SF, "labels"))).collect()}
    assert set(b) == {i for i in a if score[i] >= 0.5}
    root = brute_components({i: fingerprint(r.text) for i, r in b.items()})
    assert set(c) == set(root.values())
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = collections.defaultdict(set)
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[n].add(tuple(w[k : k + n]))
    for i, r in c.items():
        w = words(r.text)
        hit = {j for n, ws in windows.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in ws for j in range(k, k + n)}
        assert (i in d) == (not hit or 20 * len(hit) < len(w))
    assert set(e) == set(d) and all(e[i].text == pii.masked_text(d[i].text) and e[i].n_chars == len(e[i].text) for i in d)
    at = collections.defaultdict(list)
    for r in packed.collect():
        at[r.sequence_id].append((r.offset, r.length))
    assert {r.doc_id for r in packed.collect()} == set(e)
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_run(spark, kept):
    assert corpus_pipeline.run(spark, SF).count() == kept[-1].count()


def test_empty_input(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0


def test_near_duplicates_without_id(spark):
    """One row of each component stays, whatever ids its rows have or share."""
    texts = [f"{w} " * 3 + " ".join(f"{w}{i}" for i in range(40)) for w in ("ant", "bee", "cow", "doe", "elk")]
    a, b, c, d, e = texts
    assert len(set(brute_components({i: fingerprint(t) for i, t in enumerate(texts)}).values())) == 5
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (4, c), (None, c), (9, c), (4, d), (3, e), (4, e), (3, e)], "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(None, a), (None, b), (4, c), (4, d), (3, e)])


def test_decontamination_by_row(spark):
    """A contaminated row goes also without id, and no other row of its id goes with it."""
    item = next(r.text for r in table(spark, SF, "benchmark").collect() if len((r.text or "").split()) > 15)
    docs = spark.createDataFrame([(None, item), (None, "qq ww zz"), (5, item), (5, "qq ww zz")], "doc_id long, text string")
    got = corpus_pipeline.decontamination_stage(spark, docs, SF).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(None, "qq ww zz"), (5, "qq ww zz")])


def test_stages_on_odd_rows(spark):
    """Nulls anywhere, empty and long texts, repeated rows, and further columns with names that the stages use."""
    docs = spark.createDataFrame([*EDGE, (7, None), (None, "x y z")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "'s' AS source", "CAST(NULL AS BIGINT) AS n_chars", "'a' AS score", "2 AS keep_id", "'b' AS contaminated", "1 AS sequence_id", "'c' AS fingerprint")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
            assert docs.where("score <> 'a' OR keep_id <> 2 OR contaminated <> 'b'").count() == 0
    assert docs.count() > 0
