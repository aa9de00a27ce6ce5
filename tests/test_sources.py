from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quillmesh.config import Options
from quillmesh.functions import text as X
from quillmesh.plans import runs
from quillmesh.sources import tables as S

D = "/root/testdata/sf0.001"


def test_split_takes_the_head_of_each_label(spark):
    rows = spark.createDataFrame([(k, "x") for k in range(5)] + [(9, "y"), (9, "y"), (None, "x"), (8, None)], "q bigint, l string")
    got = {r.rec_id: r.split for r in S.split(rows, "q", "l", dev=1, test=1).collect()}
    assert got == {0: "test", 1: "dev", 2: "train", 3: "train", 4: "train", 9: "test"}


def test_answers(spark):
    a = spark.createDataFrame([("u", 1, "x", 1, 0), ("u", 1, "x", 1, 0), ("v", 1, "x", 0, 0), ("default", 1, "x", 1, 1), (None, 1, "x", 1, 1)], "username string, question_id bigint, text string, correct int, reference int")
    r = S.responses(a).first()
    assert (r.reference_rows, r.human_rows, r.right, r.wrong) == (2, 2, 1, 1)


def test_lookup_and_override(spark):
    q = spark.createDataFrame([(1,), (2,), (None,)], "question_id bigint")
    m = spark.createDataFrame([(1, 7), (1, 9), (3, 7)], "question_id bigint, answer_id bigint")
    c = spark.createDataFrame([(7, "seven", 5), (9, "nine", 4)], "answer_id bigint, answer_text string, answer_count bigint")
    got = {tuple(r) for r in S.answer_lookup(q, S.canonical_answers(m, c)).collect()}
    assert got == {(1, 9, "nine"), (2, -1, "")}
    assert [tuple(r) for r in S.frequent(q, m, c).collect()] == [(1, 7, "seven", 5)]
    labels = spark.createDataFrame([(1, 9), (2, 7)], "rec_id bigint, label bigint")
    over = spark.createDataFrame([(2, "two")], "rec_id bigint, label string")
    assert {tuple(r) for r in S.overridden(labels, over).collect()} == {(1, "9"), (2, "two")}


def test_vocabulary_ends_with_the_start_symbol(spark):
    v = S.vocabulary(spark.createDataFrame([("a", 0, 4), ("b", 1, 9)], "feature string, censored int, word_id int"))
    assert ("", 0, 10) in {tuple(r) for r in v.collect()}


def test_features(spark):
    f = spark.createDataFrame([(1, 2, "B "), (1, 1, "a"), (1, 1, "A"), (1, 3, None), (1, 4, "ftp"), (1, 7, "FTP"), (2, 1, " ")], "question_id bigint, token_offset int, feature string")
    assert [tuple(r) for r in S.ordered_features(f).collect()] == [(1, ["a", "b", "ftp", "ftp"])]
    assert [tuple(r) for r in S.marker_position(f).collect()] == [(1, 7)]


def test_disambiguations_keep_good_lines(spark, tmp_path):
    (tmp_path / "d.csv").write_text("5,ethics (work)\nbroken,entropy\n6,pragmatism\n")
    assert {tuple(r) for r in S.disambiguations(spark, str(tmp_path / "d.csv")).collect()} == {(5, "ethics (work)"), (6, "pragmatism")}
    assert S.broken_lines(spark, str(tmp_path / "d.csv")) == 1


def test_ids_are_written_plain(spark, tmp_path):
    S.write_ids(spark.createDataFrame([(0, 5, "a b", 3)], "i int, q int, l string, a int").coalesce(1), str(tmp_path / "o"))
    part = next(p for p in (tmp_path / "o").iterdir() if p.name.startswith("part"))
    assert part.read_text() == "0,5,a b,3\n"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
@pytest.mark.parametrize("method", ["NONE", "CANOPIES", "LEGO"])
def test_runs(spark, method):
    r = runs.Run(spark, D, Options(blocking_method=method, algorithm="MAXCLUSTER", feature_distance_threshold=3.0))
    row = r.report().first()
    assert 0 <= row.f1 <= 1
    assert row.threshold == 3.0
    assert r.clusters().count() == r.records.count()


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
def test_entry_and_catalog(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert runs.grid(spark).count() == 15


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
def test_runs_from_the_command_line(spark, tmp_path):
    from quillmesh.__main__ import main, parser

    assert main(["--column-names"]).endswith("Threshold,Limit")
    with pytest.raises(ValueError, match="CANOPIES"):
        main([D, "--blocking-method", "none such"])
    some = [D, "--limit", "12", "--log-file", str(tmp_path / "log")]
    text = main([*some, "--blocking-method", "lego"])  # mean linkage is the default
    assert "cluster f1" in text
    out = main([*some, "--output-format", "merge-csv", "--output", str(tmp_path / "trace")])
    merges = spark.read.csv(out, header=True, inferSchema=True)
    assert merges.columns == ["threshold", "precision", "recall", "f1"]
    assert 0 < merges.count() < 12
    assert merges.where("threshold <= 0.5").count() == 0
    curve = spark.read.csv(main([*some, "--write-thresholds", "--output", str(tmp_path / "curve")]), header=True)
    assert merges.count() <= curve.count() <= 66
    assert "pairs that share something" in (tmp_path / "log").read_text()
    assert set(vars(parser().parse_args([]))) >= set(Options.names())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
def test_a_taxonomy_raises_the_scores(spark):
    o = Options(limit=12)
    phrases = [r[0] for r in spark.read.parquet(f"{D}/questions.parquet").select(F.explode(X.referers(F.col("body")))).distinct().collect()]
    lemmas = spark.createDataFrame([(p, 1) for p in phrases], "lemma string, synset bigint")
    ancestors = spark.createDataFrame([(1, 1, 2.0)], "synset bigint, ancestor bigint, ic double")
    plain, wide = runs.Run(spark, D, o), runs.Run(spark, D, o, taxonomy=(lemmas, ancestors))
    assert plain.pairs.where("referers <> 0.5").count() == 0
    assert wide.pairs.where("referers > 0.99").count() > 0
    assert wide.pairs.count() >= plain.pairs.count()


def test_sinks(spark, tmp_path):
    from quillmesh.sources import sinks

    df = spark.createDataFrame([(1, "a")], "question_id bigint, text string")
    sinks.save(df, str(tmp_path / "m.parquet"))
    assert sinks.load(spark, str(tmp_path / "m.parquet")).collect() == df.collect()
    assert sinks.sql(spark, str(tmp_path), "select count(*) as n from m").first().n == 1
    assert sinks.rendered(df).first().value == '{"question_id":1,"text":"a"}'
    (tmp_path / "d.json").write_text('{"id": 1, "t": "x"}\nbroken\n')
    assert {tuple(r) for r in sinks.json_documents(spark, str(tmp_path / "d.json"), "id bigint, t string").collect()} == {(1, "x"), (None, None)}
    row = spark.createDataFrame([(0.5,) * 7], ", ".join(f"{k} double" for k in sinks.FIGURES))
    assert sinks.report_text(row, Options(output_format="csv")).endswith("0.500000,2.0,-1")
    assert sinks.report_text(row, Options(output_format="none")) == ""
    assert "cluster f1: 0.500000" in sinks.report_text(row, Options())
    assert sinks.header(Options()).endswith("vi,Threshold,Limit")
