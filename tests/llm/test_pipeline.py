from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from strandline.llm import near_duplicates, quality, toxicity
from strandline.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_classifiers import corpus
from tests.llm.test_mixing import targets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs, labels = corpus(300, seed=9)
    docs += [(1000 + i, t + ("." if i % 2 else ""), lang, source) for i, (_, t, lang, source) in enumerate(docs[:40])]
    docs += [(2000, None, None, None), (2001, "", "en", "s1")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append([tuple(r) for r in docs.collect()])
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
    packed = docs.collect()
    raw, good, civil, distinct, mixed = seen
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    # each stage does its work on all that the one before kept, and little else
    assert set(good) < set(raw) and sum(labels[r[0]].quality == 0 for r in good if r[0] in labels) <= 2
    assert sum(labels[r[0]].quality == 1 for r in raw if r[0] in labels) - sum(labels[r[0]].quality == 1 for r in good if r[0] in labels) <= 4
    assert set(civil) < set(good) and sum(labels[r[0]].toxic for r in civil if r[0] in labels) <= 3
    assert set(distinct) < set(civil) and not any(1000 <= r[0] < 1040 and (r[0] - 1000) in {c[0] for c in civil} for r in distinct)
    sizes = Counter()
    for r in distinct:
        sizes[r[3]] += len((r[1] or "").split())
    taken = Counter()
    for r in mixed:
        taken[r[3]] += len(r[1].split())
    longest = max(len((r[1] or "").split()) for r in distinct)
    for source, want in targets(sizes).items():
        assert abs(taken[source] - want) <= longest
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in mixed)


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert not got.isEmpty()


def test_registration():
    names = __spark_entry__.queries()
    assert sum(n.startswith("op") for n in names) == 10 and "pipeline" in names
    assert set(QUERIES) <= set(names) and set(ORACLE_SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stage_functions_are_those_of_the_operators(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    by_query = {r.doc_id for r in quality.classify(docs, labels).filter("keep").collect()}
    assert by_query == {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, folder).collect()}
    by_query = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect()}
    assert by_query == {r.doc_id for r in corpus_pipeline.keep_civil(spark, docs, folder).collect()}
    by_query = {r.class_key for r in near_duplicates.near_duplicates(docs).collect()}
    assert len(by_query) == corpus_pipeline.keep_distinct(spark, docs, folder).count()
