import json

from burstframe.sources import readers


def test_json_lines(spark):
    good = json.dumps({"id_str": "1", "text": "x" * 30, "entities": {"hashtags": [{"text": "a"}]}, "user": {"id_str": "u"}, "extra": 1})
    rows = [("01", 0, good), ("01", 1, good), ("01", 2, good[:-5]), ("01", 3, "{}"), ("01", 4, '{"text": "no id at all here"}'), ("01", 5, None), ("01", 6, "")]
    df = spark.createDataFrame(rows, "day string, line_no bigint, line string")
    out = readers.json_lines(df).collect()
    assert [(r.line_no, r.id_str, r.entities.hashtags[0].text) for r in out] == [(1, "1", "a")]
    flat = readers.tweet_projection(readers.json_lines(df)).collect()
    assert flat[0].hashtags == ["a"] and flat[0].user_id_str == "u" and flat[0].urls is None
    assert readers.user_projection(readers.json_lines(df)).count() == 1
    assert readers.json_lines(df.limit(0)).count() == 0


def test_text_tables(spark, tmp_path):
    lines = spark.createDataFrame([("a\tx\tb",), ("lonely",), ("",), (None,)], "line string")
    assert [tuple(r) for r in readers.tsv(lines).collect()] == [("a", "b")]
    words = spark.createDataFrame([("u you all",), ("  ",)], "line string")
    assert [tuple(r) for r in readers.pairs(words).collect()] == [("u", "you all")]
    tagged = readers.tagged(spark.createDataFrame([("a/b/NN c/VB",)], "line string")).first().tokens
    assert [(t.word, t.tag) for t in tagged] == [("a/b", "NN"), ("c", "VB")]


def test_chunk_spans(spark):
    df = spark.createDataFrame([("[ a/DT b/NN ] c/VB [ d/NN]",), ("a/VB b/IN",), ("[ a/NN ] [ b/NN ]",)], "line string")
    assert [[(s.st, s.ed) for s in r.spans] for r in readers.chunk_spans(df).collect()] == [[(0, 1), (3, 3)], [], [(0, 0), (1, 1)]]


def test_files(spark, tmp_path):
    folder = tmp_path / "c" / "news" / "en"
    folder.mkdir(parents=True)
    (folder / "d1").write_text("one\n\ntwo")
    corpus = readers.corpus_from_paths(spark, str(tmp_path / "c"))
    assert [tuple(r) for r in corpus.collect()] == [("news", "en", "d1", "one\n\ntwo")]
    assert sorted(r.text for r in readers.corpus_lines(corpus).collect()) == ["one", "two"]
    assert [(r.line_no, r.line) for r in readers.text_lines(spark, str(folder)).collect()] == [(0, "one"), (1, ""), (2, "two")]
    df = spark.createDataFrame([("01", "b", 2.0), ("02", "a", float("nan"))], "day string, term string, weight double")
    readers.write_by_day(df, str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).where("day = '02'").count() == 1
    readers.write_lines(df, str(tmp_path / "lines"), "term", "weight", order=("term",))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a\tNaN", "b\t2.0"]
    readers.write_feature_csv(df.select("term", "weight"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["term", "weight"]
    readers.write_table(df, str(tmp_path / "table"))
    (tmp_path / "w.csv").write_text("x,NaN\ny,1.5\n")
    assert sorted(tuple(r) for r in readers.read_weights(spark, str(tmp_path / "w.csv")).collect()) == [("x", 0.0), ("y", 1.5)]


def test_parts_of_folders(spark, tmp_path):
    for name in ("tweet_01", "tweet_02", "other_01", "tweet_03"):
        (tmp_path / name).write_text(f"{name}\nsecond")
    got = readers.day_lines(spark, str(tmp_path), ["01", "03"], "tweet_").where("line_no = 0")
    assert sorted(r.line for r in got.collect()) == ["tweet_01", "tweet_03"]
    folder = tmp_path / "c" / "news" / "en"
    folder.mkdir(parents=True)
    (folder / "d1").write_text("one")
    (folder / "d2").write_text("two")
    (tmp_path / "list").write_text(f"{folder}/d2\n\n")
    assert [tuple(r) for r in readers.corpus_from_list(spark, str(tmp_path / "list")).collect()] == [("news", "en", "d2", "two")]
    (tmp_path / "none").write_text("\n")
    assert readers.corpus_from_list(spark, str(tmp_path / "none")).count() == 0


def test_vectors_and_pairs_of_files(spark, tmp_path):
    df = spark.createDataFrame([("b", [1.0, float("nan")]), ("a", [2.0])], "term string, weight array<double>")
    readers.write_weights(df, str(tmp_path / "v"))
    assert sorted((r.term, r.weight) for r in readers.read_vectors(spark, str(tmp_path / "v"), 2).collect()) == [("a", [2.0, None]), ("b", [1.0, 0.0])]
    rows = spark.createDataFrame([("2", "x\ny"), ("1", None), ("2", "x\ny")], "id string, text string")
    readers.write_id_text(rows, str(tmp_path / "p"), "id", "text")
    read = lambda name: [r.value for r in spark.read.text(str(tmp_path / "p" / name)).collect()]
    assert read("ids") == ["1", "2", "2"] and read("texts") == ["", "x y", "x y"]


def test_files_in_parts(spark, tmp_path):
    """However small the parts are, each file loses its first line only."""
    for k in range(3):
        (tmp_path / f"f{k}").write_text("".join(f"{k}-{i} " + "x" * (i % 40) + "\n" for i in range(400)))
    (tmp_path / "empty").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1500b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted(r.line.split()[0] for r in readers.data_lines(spark, str(tmp_path)).collect())
            assert got == sorted(f"{k}-{i}" for k in range(3) for i in range(1, 400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
