"""The pipeline's stages on the smallest tables: columns, odd rows, and what each stage decides."""

import pytest

import corpus_pipeline
from strandmill.llm import decontamination, near_dups
from strandmill.llm.base import Scratch, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output, with rows added that have nulls and columns that clash."""
    odd = spark.createDataFrame([(None, "", None, None, 0), (None, None, None, None, None), (10**6, None, "en", None, 0), (10**6 + 1, "word " * 20_000, None, "web", 5), (10**6 + 1, "word " * 20_000, None, "web", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = table(spark, SF, "documents")
    odd = odd.select(*[odd[f.name].cast(f.dataType) for f in docs.schema])
    docs = docs.unionByName(odd).selectExpr("*", "'t' AS topic", "1 AS kept", "2 AS component_id", "'s' AS score")
    scratch, out = Scratch(spark, "t"), []
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.save(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [name for name, _, _ in stages] == ["toxicity", "near_dups", "decontamination", "mixing", "sharding"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_near_dups_keep_the_smallest(spark, stages):
    _, before, after = stages[1]
    kept = near_dups.near_duplicates(before, Scratch(spark, "t"), 5).where("kept")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in after.collect())


def test_no_contamination_left(spark, stages):
    _, _, after = stages[2]
    found = decontamination.decontaminate(after, table(spark, SF, "benchmark"), Scratch(spark, "t"))
    assert found.where("contaminated").count() == 0


def test_shards(stages):
    _, before, after = stages[-1]
    rows = after.collect()
    counts = [sum(r.shard == s for r in rows) for s in range(16)]
    assert len(rows) == before.count() and max(counts) - min(counts) <= 1
