"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketflow.llm import language, secrets, stages, toxicity
from marketflow.llm.common import fold_of
from marketflow.llm.decontaminate import contaminated
from marketflow.llm.graph_ann import nearest
from marketflow.llm.mixing import pareto_mix
from marketflow.llm.prefix_free import remove_repeats
from marketflow.llm.sentences import dedup_spans
from marketflow.llm.simhash import near_duplicates
from marketflow.llm.wrapper import extract

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, fp long, block long, key long, size string, "
          "spans string, score string, root int, label int, hash string, u int, taken long, row int, item_id string")
LONG = " ".join(random.Random(5).choice(["the", "of", "and", "sentence.", "word", "other"]) for _ in range(30_000))


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 2, 3, "x", "y", "z", 4, 5, "h", 6, 7, 8, "i")


ROWS = [_row(1, "One two three four five. Six seven eight nine! Ten eleven twelve thirteen? " * 3), _row(2, None), _row(3, ""), _row(4, " \n\t "),
        _row(None, "No id here at all. It has some words. And a few more."), _row(None, None, None, None),
        _row(5, LONG, "de", None), _row(6, LONG, "de", "b"), _row(7, "same text"), _row(7, "same text"), _row(7, "other text of the id"),
        _row(8, "1234 !!! ???", None, "b"), _row(9, "password = abcdef123456 end"), _row(10, "\U0001F600 été token: ABCDEFGH", "fr")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 0, 0), (7, 1, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (None, "the of and " * 20)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def ids(df, col="doc_id"):
    return sorted((r[0] for r in df.select(col).collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_simhash(docs, none):
    got = near_duplicates(docs)
    assert ids(got) == ALL
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in got.collect()}
    zero = "0" * 16
    assert rows[(2, zero)] == rows[(3, zero)] == rows[(4, zero)] == rows[(None, zero)] == 2
    assert len({r.component_id for r in got.where("doc_id IN (5, 6)").collect()}) == 1
    assert near_duplicates(none).count() == 0


def test_toxicity(docs, none, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lex = toxicity.train(toxicity.training_rows(docs, labels))
    scored = docs.select("doc_id", toxicity.scorer(lex)("text").alias("s"))
    assert ids(scored) == ALL and scored.where("s BETWEEN 0 AND 1").count() == len(ROWS)
    empty = toxicity.train(toxicity.training_rows(none, labels))
    assert none.select(toxicity.scorer(empty)("text")).count() == 0


def test_decontamination(docs, none, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert contaminated(docs, bench).count() == 0
    assert contaminated(none, bench).count() == 0
    assert contaminated(docs, bench.where("false")).count() == 0
    held = spark.createDataFrame([(1, "x the of and " + "the of and " * 20), (None, "y A  B, c! z"), (2, "a b")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(held, bench).collect()} == {(1, None), (None, 1)}


def test_sentences(docs, none):
    got = dedup_spans(docs)
    assert ids(got) == ALL
    rows = {(r.doc_id, r.n_sentences): r for r in got.collect()}
    assert rows[(2, 0)].text is None and rows[(3, 0)].text == ""
    assert [r.n_removed for r in got.where("doc_id = 6").collect()] == [rows[(5, rows_n(got, 5))].n_sentences]
    first = got.where("doc_id = 1").first()
    assert first.n_removed == 0  # three copies of 15 words: its later spans are shorter than a passage
    thrice = docs.where("doc_id = 1").select("doc_id", F.repeat("text", 6).alias("text"))
    more = dedup_spans(thrice).first()
    assert more.n_sentences / 2 < more.n_removed < more.n_sentences
    assert got.where("doc_id = 7 AND n_removed > 0").count() == 0
    assert dedup_spans(none).count() == 0


def rows_n(got, doc_id):
    return got.where(F.col("doc_id") == doc_id).first().n_sentences


def test_prefix_free(docs, none):
    got = remove_repeats(docs)
    assert ids(got) == ALL
    rows = {r.doc_id: r for r in got.collect() if r.doc_id != 7}
    assert rows[2].n_bytes == 0 and rows[6].n_removed == rows[6].n_bytes == len(LONG) and rows[6].n_spans == 1
    assert rows[5].n_removed == 0 and rows[None].n_removed == 0
    assert remove_repeats(none).count() == 0


def test_mixing(docs, none):
    got = pareto_mix(docs)
    assert ids(got) == ALL
    assert got.where("taken > 2 * size OR taken < 0 OR source_size IS NULL OR target > 2 * source_size").count() == 0
    assert pareto_mix(none).count() == 0
    assert pareto_mix(docs.where("text IS NULL")).where("taken = 0 AND target = 0").count() == 2
    tilted = pareto_mix(docs, weight_col="fp")
    assert sorted(map(str, tilted.collect())) == sorted(map(str, got.collect()))


def test_secrets(docs, none):
    got = secrets.scan(docs, secrets.train(docs))
    assert ids(got) == ALL
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[9].spans == "assign:0:23" and rows[10].spans == "assign:6:21" and rows[2].spans == ""
    assert secrets.scan(none, secrets.train(none)).count() == 0


def test_language(docs, none):
    got = language.identify(docs, fold_of(F.col("doc_id"), 4) == 2)
    assert ids(got) == ALL
    rows = {r.doc_id: r for r in got.collect() if r.doc_id != 7}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (2, 3, 4, 8))
    assert got.where("score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    assert language.identify(none, F.lit(False)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, F.lit(True)).collect()} == {"und"}


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, "http://h/a", "<p>One &amp; two<p>three<br>four"), (1, "http://h/a", "<p>One &amp; two<p>three<br>four"), (2, None, None), (None, "x", ""),
         (3, "http://h/b", "<article><p>" + "long " * 50_000)], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rules", F.lit(2))
    rows = [(r.page_id, r.text, r.n_chars) for r in extract(pages).collect()]
    assert rows.count((1, "One & two\n\nthree four", 21)) == 2 and (2, "", 0) in rows and (None, "", 0) in rows
    assert (3, ("long " * 50_000).strip(), 249_999) in rows
    assert extract(pages.where("false")).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (None, [1.0, 1.0]), (9, []), (10, [1.0, 0.0]), (11, [1.0, 2.0, 3.0]), (12, [1e200, 1e200])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).withColumn("shard", F.lit(0))
    got = nearest(v, v, 3).collect()
    by = {q: [(r.vec_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 3, 11, 12)}
    half = round(0.5 ** 0.5, 9)
    assert by[1] == [(2, 1.0), (10, 1.0), (12, half)] and by[3] == [(12, half), (1, 0.0), (2, 0.0)]
    assert by[11] == [] and by[12] == [(1, half), (2, half), (3, half)]
    assert {r.query_id for r in got} == {1, 2, 3, 10, 12}
    assert nearest(v.where("false"), v, 3).count() == 0 and nearest(v, v.where("false"), 3).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(stage, docs, none, spark, sf_dir):
    got = stage(spark, docs, sf_dir)
    assert got.columns == docs.columns and set(ids(got)) <= set(ALL)
    assert stage(spark, none, sf_dir).count() == 0


def test_stage_decisions(docs, spark, sf_dir):
    one = stages.simhash_near_dedup(spark, docs, sf_dir)
    assert ids(one) == [1, 2, 5, 7, 7, 8, 9, 10, None]  # blank texts and copies are one each; two texts share the id 7
    told = {r.doc_id: r for r in stages.redact_secrets(spark, docs, sf_dir).collect()}
    assert told[9].text == "[REDACTED] end" and told[9].n_chars == 14
    assert told[2].text is None and told[1].n_chars == len(ROWS[0][1])
    assert stages.decontaminate(spark, docs, sf_dir).count() == len(ROWS)
    assert ids(stages.mixing(spark, docs, sf_dir)) == ALL
