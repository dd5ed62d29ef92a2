"""Null ids, repeated rows, ties, long texts, clashing columns and empty tables, operator by operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import decontaminate, language_id, licenses, lm_scoring, packing, pii, secrets, simhash

from .util import SCHEMA, table

TOKEN = "9aKd83JsLq02MzXcVbNwErTyUiOp4821GhQx"
LONG = "these are many words that go on and on until the end of it " * 3000
TEXTS = [
    (1, "Write to ann@example.com, or call +44 20 7946 0958.", "en"),
    (2, f'token = "{TOKEN}" and more words to make it long enough', "en"),
    (3, "Released under the MIT License.", "en"),
    (4, LONG, "en"),
    (5, None, None),
    (6, "", "de"),
    (7, "der Hund und die Katze gehen über die Straße", "de"),
    (7, "der Hund und die Katze gehen über die Straße", "de"),
    (None, "der Hund und die Katze gehen über die Straße", "de"),
    (None, None, None),
    (8, "the cat and the dog go over the street", "en"),
]
NAMES = ("path", "row", "row2", "id", "k", "node", "fp", "key", "pair", "block", "piece", "start", "length", "offset", "ids", "value", "before", "after", "features", "score", "held_out", "h", "n", "w", "kind", "spans", "base", "size", "item_id", "shared", "component", "least")


def docs(spark):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(df):
    return sorted(str(tuple(r[c] for c in sorted(r.asDict()))) for r in df.collect())


OPERATORS = {
    "personal_data": lambda spark, d: pii.digest(pii.personal_data(d)),
    "simhash": lambda spark, d: simhash.simhash_components(d),
    "packing": lambda spark, d: packing.best_fit_packing(d, added=True).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "secrets": lambda spark, d: secrets.secret_scan(d.drop("path"), secrets.labelled_findings(spark, 1500)),
    "decontamination": lambda spark, d: decontaminate.contaminated(d, table(spark, [(1, "the cat and the dog go over the street"), (2, "on until the end of it these are many words"), (3, None), (3, "")], "item_id long, text string")),
    "language": lambda spark, d: language_id.language_id(d),
    "licences": lambda spark, d: licenses.licence_scan(d.withColumn("path", F.concat(F.lit("a/"), F.col("lang")))),
    "scoring": lambda spark, d: lm_scoring.lm_scores(d).select("doc_id", "n_tokens", "n_known", F.round("score", 6).alias("score")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_clashing_columns(spark, name):
    run, d = OPERATORS[name], docs(spark)
    plain = rows_of(run(spark, d))
    assert rows_of(run(spark, d.withColumns({c: F.lit("!") for c in NAMES}))) == plain
    if name in ("personal_data", "simhash", "language", "licences", "scoring"):  # a row for each
        assert len(plain) == len(TEXTS)
    got = [r for r in run(spark, d).collect()]
    repeated = [tuple(r)[1:] for r in got if r.doc_id == 7]
    if name not in ("secrets", "decontamination", "packing"):
        assert len(repeated) == 2 and repeated[0] == repeated[1] and sum(r.doc_id is None for r in got) == 2
    if name == "packing":
        assert sum(r.length for r in got if r.doc_id == 4) > 30_000 and sum(r.doc_id == 7 for r in got) == 2
    if name == "decontamination":
        assert {(r.doc_id, r.item_id) for r in got} == {(8, 1), (4, 2)}
    if name == "secrets":
        assert [r.value for r in got if r.doc_id == 2] == [TOKEN]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_pipeline_on_empty_tables_and_repeated_rows(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "empty" / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    again = str(tmp_path / "again")
    table(spark, [(1, "a text that nobody has")], "item_id long, text string").write.parquet(f"{again}/benchmark.parquet")
    docs(spark).write.parquet(f"{again}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, again).collect()}
    assert 8 in left and 5 not in left and 6 not in left
