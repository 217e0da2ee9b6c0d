import glob
import json

import pytest

from sievework.sources import arff


def labels(spark, kind, *values):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.v for r in df.select("i", arff.label_text(df, "v").alias("v")).orderBy("i").collect()]


def test_labels(spark):
    assert labels(spark, "string", "5", " 5 ", "1_2", "x", " y ", "3.7", "_5", None, "-4") == [
        "_5", "_ 5", "_1_2", "x", "y", "3.7", "_5", "None", "_-4",
    ]
    assert labels(spark, "int", 12, None) == ["_12", "None"]
    assert labels(spark, "double", 3.7, float("nan"), float("inf"), None) == ["_3.7", "nan", "inf", "None"]
    assert labels(spark, "boolean", True, False) == ["_True", "_False"]


def test_config(tmp_path):
    path = tmp_path / "arff.json"
    path.write_text(json.dumps({"relation": "R", "attributes": {"a": "numeric", "b": "Nominal"}}))
    assert arff.ArffConfig.parse(str(path)).attributes == {"a": "NUMERIC", "b": "NOMINAL"}
    for bad in ({"relation": 1, "attributes": {}}, {"relation": "R", "attributes": []}):
        with pytest.raises(ValueError):
            arff.ArffConfig.parse(bad)
    with pytest.raises(ValueError, match="unknown ARFF types"):
        arff.ArffConfig.parse({"relation": "R", "attributes": {"a": "date"}})


def test_written_file(spark, tmp_path):
    rows = [(1.5, "b, c", "it", 1), (None, 'say "x"', "it", 0), (2.0, "", None, 1)]
    df = spark.createDataFrame(rows, "score double, text string, `the 'tag'` string, flag int").coalesce(1)
    config = arff.ArffConfig.parse(
        {
            "relation": "MY DATA",
            "attributes": {"score": "numeric", "text": "string", "the 'tag'": "nominal", "flag": "nominal"},
        }
    )
    arff.dataframe_as_arff(df, config, str(tmp_path / "out"), missing="?")
    parts = sorted(glob.glob(f"{tmp_path}/out/header/part*")) + sorted(glob.glob(f"{tmp_path}/out/body/part*"))
    text = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert text.splitlines() == [
        "@RELATION MY_DATA",
        "",
        "@ATTRIBUTE score NUMERIC",
        "@ATTRIBUTE text STRING",
        "@ATTRIBUTE the_tag {None,it}",
        "@ATTRIBUTE flag {_0,_1}",
        "",
        "@DATA",
        '1.5,"b, c",it,_1',
        '?,"say ""x""",it,_0',
        "2.0,,None,_1",
    ]


def test_no_nominal_attribute(spark):
    df = spark.createDataFrame([(1,)], "a int")
    config = arff.ArffConfig.parse({"relation": "R", "attributes": {"a": "numeric"}})
    assert [tuple(r) for r in arff.arff_header(df, config).collect()] == [(0, "a", "NUMERIC", None)]
    with pytest.raises(ValueError, match="no such columns"):
        arff.arff_body(df.withColumnRenamed("a", "b"), config)


def test_written_files_read_back(spark, tmp_path):
    rows = [(1.5, "b, c\nd", "it", 1), (None, 'say "x"', "it", 0), (2.0, "", None, 1), (-1e300, "@data", "é 'f'", 0), (0.1, "{not sparse", "it", 1)]
    df = spark.createDataFrame(rows, "score double, text string, `the 'tag'` string, flag int").repartition(3)
    config = arff.ArffConfig.parse({"relation": "R", "attributes": {"score": "numeric", "text": "string", "the 'tag'": "nominal", "flag": "nominal"}})
    arff.dataframe_as_arff(df, config, str(tmp_path / "out"), missing="?")
    back = arff.scan_arff(spark, str(tmp_path / "out"))
    assert back.dtypes == [("score", "double"), ("text", "string"), ("the_tag", "string"), ("flag", "string")]
    expected = sorted(map(tuple, arff.arff_body(df, config).collect()), key=str)
    assert sorted(map(tuple, back.collect()), key=str) == expected
    # the concatenated file, cut into ranges
    parts = sorted(glob.glob(f"{tmp_path}/out/header/part*")) + sorted(glob.glob(f"{tmp_path}/out/body/part*"))
    (tmp_path / "one.arff").write_text("% a comment\n" + "".join(open(p, encoding="utf-8").read() for p in parts), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (40, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(map(tuple, arff.scan_arff(spark, str(tmp_path / "one.arff")).collect()), key=str) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_of_other_writers(spark, tmp_path):
    (tmp_path / "a.arff").write_text(
        "%c\n@relation 'x y'\n\n@attribute 'the label' {yes, 'no, never', \"it's\"}\n@ATTRIBUTE n integer\n@attribute r REAL\n@Data\n"
        "yes,1,2.5\n'no, never',?,1e3\n?,3,?\n\"it's\",-4,0\n"
    )
    found = arff.scan_arff(spark, str(tmp_path / "a.arff"))
    assert found.dtypes == [("the label", "string"), ("n", "bigint"), ("r", "double")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("yes", 1, 2.5), ("no, never", None, 1000.0), (None, 3, None), ("it's", -4, 0.0)], key=str)


def test_values_that_do_not_fit(spark, tmp_path):
    header = "@relation r\n@attribute a {x,y}\n@attribute n numeric\n@data\n"
    for name, row in (("label", "z,1"), ("number", "x,one"), ("sparse", "{0 x, 1 2}")):
        (tmp_path / f"{name}.arff").write_text(header + "x,1\n" + row + "\n")
        with pytest.raises(Exception, match="domain|CAST_INVALID_INPUT|sparse"):
            arff.scan_arff(spark, str(tmp_path / f"{name}.arff")).collect()
    loose = [sorted(map(tuple, arff.scan_arff(spark, str(tmp_path / f"{n}.arff"), strict=False).collect()), key=str) for n in ("label", "number")]
    assert loose == [[("x", 1.0), (None, 1.0)], [("x", 1.0), ("x", None)]] or loose == [sorted([("x", 1.0), (None, 1.0)], key=str), sorted([("x", 1.0), ("x", None)], key=str)]
    (tmp_path / "bad.arff").write_text("@relation r\n@attribute a date\n@data\n1\n")
    with pytest.raises(ValueError, match="unknown ARFF types"):
        arff.scan_arff(spark, str(tmp_path / "bad.arff"))
    (tmp_path / "none.arff").write_text("1,2\n")
    with pytest.raises(ValueError, match="no ARFF header"):
        arff.scan_arff(spark, str(tmp_path / "none.arff"))
