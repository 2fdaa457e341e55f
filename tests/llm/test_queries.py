import sys

import pytest


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_one_query_for_each_operator(entry):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns and docs.count() <= count
            count = docs.count()
    assert docs.select("doc_id").distinct().count() == count
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_stages_on_odd_and_empty_tables(spark, sf_dir, documents, odd):
    """Null, repeated and clashing: no stage fails, filters keep columns, rows without an id survive the duplicates."""
    import corpus_pipeline

    for rows in (odd, []):
        docs = documents(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            got = out.collect()
            if name == "packing":
                assert {r.doc_id for r in got} == {i for i, _ in rows}
                continue
            assert out.columns == docs.columns and len(got) <= len(rows)
            if name == "near_duplicates":
                assert {(r.doc_id, r.text) for r in got} <= set(rows) and len({r.doc_id for r in got}) == len(got)
            if name == "personal_data":
                assert len(got) == len(rows)


def test_chat_query_holds_the_added_conversation(spark, sf_dir, entry):
    row = entry.queries()["op4_chat_windows"](spark, sf_dir).where("conv_id = -1").first()
    assert (row.n_turns, row.loss_chars) == (2, 21)


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(sys.modules["cubitgrid"].__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "cubitgrid.llm" in p.read_text()]


def test_packing_of_the_pipeline_remembers_little(spark, sf_dir, monkeypatch):
    """Workers that ran the other stages took more than an executor's memory with 250,000 pieces."""
    import corpus_pipeline

    asked = []
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, **k: asked.append(k["remembered"]))
    corpus_pipeline.packed(spark, spark.range(1), sf_dir)
    assert asked[0] <= 100_000
