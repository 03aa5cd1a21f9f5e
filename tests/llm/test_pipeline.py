import glob
import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from weftline.llm import near_dup, quality, queries, secret_scan, toxicity

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


def test_stages_do_what_their_operators_say(spark):
    """Each stage by plain steps over collected rows, from the scores and groups of its operator."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "minhash near-dedup", "secret scans", "packing"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF_DIR).cache())
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert all(f.columns == names for f in frames[:5])
    assert ids[1] == {r["doc_id"] for r in quality.quality_scores(frames[0]).where("kept").collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert ids[2] == {r["doc_id"] for r in toxicity.toxicity_scores(frames[1], labels).where("predicted = 0").collect()}
    assert ids[3] == {r["doc_id"] for r in near_dup.near_duplicates(frames[2]).where("kept").collect()}
    before, after = ({r["doc_id"]: r for r in f.collect()} for f in frames[3:5])
    assert {i: r["text"] for i, r in after.items()} == {i: secret_scan.redacted(r["text"]) for i, r in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert ids[5] == ids[4] == ids[3]
    run = corpus_pipeline.run(spark, SF_DIR)
    assert run.columns == frames[5].columns and run.select("doc_id", "start", "ids").exceptAll(frames[5].select("doc_id", "start", "ids")).isEmpty()


def test_sharding_query_names_its_law(spark):
    rows = queries.op2_sharding(spark, SF_DIR).select("law", "grown_shard", "shard").distinct().collect()
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)} and {r["shard"] for r in rows} == set(range(24))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.isEmpty()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = queries.QUERIES[name](spark, SF_DIR).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(str, ours[columns].itertuples(index=False))) == sorted(map(str, theirs[columns].itertuples(index=False)))


def test_all_are_registered():
    known = __spark_entry__.queries()
    for n in range(1, 11):
        assert any(q.startswith(f"op{n}_") for q in known)
    assert known["pipeline"] is corpus_pipeline.run
