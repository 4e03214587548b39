"""The pipeline's stages against brute force on a small table."""

import collections

import pytest
from oracle import SF, database, same

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from test_near_copies import brute_kept  # noqa: E402
from test_text import brute_substring  # noqa: E402

from tilewright.llm.queries import ORACLES, QUERIES  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SF), database(SF), ORACLES[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = f(spark, docs, SF)
        if name == "best-fit packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(out.collect(), SCHEMA)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "SimHash near-dedup":
            rows = [(i, before[i].text) for i in sorted(before)]
            assert set(after) == {rows[k][0] for k in brute_kept(rows)} and all(after[i] == before[i] for i in after)
        elif name == "substring dedup":
            want = brute_substring([(i, r.text) for i, r in before.items()], 20)
            assert {i: r.text for i, r in after.items()} == {i: v[0][2] for i, v in want.items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            # What each document's own score says, whatever other documents are there.
            rows = {i: one_by_one(spark, name, r) for i, r in list(before.items())[::9]}
            assert set(after) <= set(before) and all(after[i] == before[i] for i in after) and all((i in after) == stays for i, stays in rows.items())


CHAIN = {}


def one_by_one(spark, name, row):
    """Whether a classifier keeps a document, by its score in a table of its own."""
    from tilewright.llm import quality, toxicity
    from tilewright.llm.common import table

    if not CHAIN:
        docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
        CHAIN.update(toxicity=toxicity.fit(docs, labels), quality=quality.fit(docs, quality.grades(labels)))
    one = spark.createDataFrame([row], SCHEMA)
    return toxicity.score(one, CHAIN["toxicity"]).filter("NOT is_toxic").count() == 1 if name == "toxicity" else quality.score(one, CHAIN["quality"]).filter("keep").count() == 1


def test_columns_that_clash(spark):
    """Columns with the names that stages use for their own."""
    names = ["_row", "node", "component", "component_id", "fp", "key", "bands", "family", "kept", "n_words", "is_toxic", "keep", "length", "piece", "sequence_id", "_s"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = docs.select("*", *[docs["doc_id"].alias(n) for n in names])
    for name, f in corpus_pipeline.STAGES[:-1]:
        plain, out = f(spark, docs, SF), f(spark, wide, SF)
        assert out.columns == wide.columns
        assert {tuple(r)[:5] for r in out.collect()} == {tuple(r) for r in plain.collect()} and all(r["_row"] == r["family"] == r.doc_id for r in out.collect()), name
    assert corpus_pipeline.pack(spark, wide, SF).count() == corpus_pipeline.pack(spark, docs, SF).count()


def test_edge_rows(spark):
    rows = [(None, "a b c", None, None, None), (None, None, "en", "s", 1), (7, None, None, None, None), (8, "", "en", "s", 0), (9, "x y z", "en", "s", 5), (9, "x y z", "en", "s", 5), (10, "long word " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() > 0
        assert f(spark, docs.limit(0), SF).count() == 0
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert collections.Counter(r.doc_id for r in near.collect()) == {None: 2, 7: 1, 9: 1, 10: 1}
