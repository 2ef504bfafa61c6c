"""A JSON object by ranges of any size, against the parser."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.sources import bigjson, issues
from tests import data

ODD = {
    "a": [1, -2.5, "x,]}", 'q"\\"', "\\\\", {"k": [1, {"z": "}"}], "e": []}, [], [[]], None, True, "é日😀", ""],
    "empty": [], "scalar": 5, "text": 'a "quoted" [list], {it}', "o": {}, "members": {'k"1': {"v": [1, 2]}, "two": "x", "é": None, "": [1, 2]}, "last": [{"deep": {"er": [{"a": ["]"]}]}}],
}


@pytest.mark.parametrize("indent", [None, 3])
def test_elements(spark, tmp_path, indent):
    raw = json.dumps(ODD, indent=indent, ensure_ascii=indent is None)
    (tmp_path / "x.json").write_text(raw)
    want = sorted((n, i, None, json.dumps(v)) for n in ("a", "last") for i, v in enumerate(ODD[n])) + sorted(("members", i, k, json.dumps(v)) for i, (k, v) in enumerate(ODD["members"].items()))
    for size in (1 << 20, 7, 23) if indent else (1 << 20, 40, 11):
        got = bigjson.elements(spark, str(tmp_path / "x.json"), size).collect()
        assert sorted(((r["name"], r["ord"], r["member"], json.dumps(json.loads(r["element"]))) for r in got), key=repr) == sorted(want, key=repr), size


def test_every_range_size(tmp_path):
    """All boundaries, also between the bytes of a character and behind backslashes, without Spark."""
    (tmp_path / "x.json").write_text(json.dumps(ODD, ensure_ascii=False))
    text = bigjson.Text(str(tmp_path / "x.json"))
    whole = None
    for size in range(1, text.size + 1):
        inside, stack, got = False, [], []
        for start in range(0, text.size, size):
            end = min(text.size, start + size)
            second = stack[1] if len(stack) > 1 else None
            own = bigjson.Open(second.kind, second.at, second.commas) if second else None
            got += [(o.at, o.commas, e) for o, e in bigjson.Walker(text, start, end, inside, len(stack), own).elements()]
            s = bigjson.summarise(text.read(start, end), start, inside, text.escaped(start))
            inside, stack = s.inside, bigjson.entered(stack, s)
        assert not inside and not stack
        whole = whole or got
        assert got == whole, size
    assert len(whole) == len(ODD["a"]) + len(ODD["members"]) + len(ODD["last"])


@pytest.mark.parametrize("size", [100, 4096])
def test_corpus_and_profiles(spark, tmp_path, size):
    a, b = data.write(tmp_path)
    by_ranges, plain = bigjson.load_corpus(spark, a, size), issues.load_corpus(spark, a)
    assert by_ranges.domains == plain.domains and by_ranges.issues.dtypes == plain.issues.dtypes
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(by_ranges.issues) == rows(plain.issues)
    assert rows(bigjson.load_profiles(spark, b, size)) == rows(issues.load_profiles(spark, b))


def test_broken_text_is_an_error(spark, tmp_path):
    for raw in ('{"a": [1, 2', '{"a": ["x', '{"a": []}}'):
        (tmp_path / "x.json").write_text(raw)
        with pytest.raises(ValueError):
            bigjson.elements(spark, str(tmp_path / "x.json"), 4)
    with pytest.raises(FileNotFoundError):
        bigjson.elements(spark, str(tmp_path / "none.json"))


def test_written_in_parts(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("ord"), F.to_json(F.struct("id", F.lit('a "b" ,').alias("t"))).alias("element"))
    none = rows.limit(0)
    named = rows.filter("ord < 3").withColumn("member", F.concat(F.lit('m"'), "ord"))
    bigjson.write_object(str(tmp_path / "o"), {"xs": rows.repartition(4), "none": none, "ys": named}, {"statuses": ["a", "b"]})
    got = bigjson.elements(spark, str(tmp_path / "o"), 1000).collect()
    assert sorted((r["ord"], json.loads(r["element"])["id"]) for r in got if r["name"] == "xs") == [(i, i) for i in range(500)]
    assert sorted(((r["name"], r["member"]) for r in got if r["name"] != "xs"), key=repr) == [("statuses", None)] * 2 + [("ys", f'm"{i}') for i in range(3)]
    text = bigjson.Text(str(tmp_path / "o"))
    whole = json.loads(text.read(0, text.size))
    assert set(whole) == {"xs", "none", "ys", "statuses"} and whole["ys"]['m"2'] == {"id": 2, "t": 'a "b" ,'}


def test_only_ranges_of_asked_members_are_read(spark, tmp_path):
    """The declared domains of a large object lie in few of its ranges, and a first row that is there twice gets one comma."""
    rows = spark.range(500).select(F.greatest(F.col("id"), F.lit(1)).alias("ord"), F.to_json(F.struct("id")).alias("element"))
    path = str(tmp_path / "o")
    bigjson.write_object(path, {"xs": rows}, {"statuses": ["a", "b"]})
    found = bigjson.ranges(spark, path, 200)
    few = bigjson.cut(spark, path, found, 200, ("statuses",))
    assert [r["element"] for r in few.orderBy("ord").collect()] == ['"a"', '"b"']
    assert few.rdd.getNumPartitions() <= 2 < len(found)
    assert bigjson.cut(spark, path, found, 200, ("xs",)).count() == 500
    assert bigjson.range_bytes_for(path, 100) == 100 and bigjson.range_bytes_for(path, 1, 2) > 1000
