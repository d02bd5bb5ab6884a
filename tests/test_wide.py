"""Layouts of wide files, read by position."""

import pytest
from pyspark.sql import functions as F

from gradus.sources import wide


def write(path, lines, end="\n"):
    path.write_text(end.join(lines) + end)
    return str(path)


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    return tmp_path_factory.mktemp("wide")


def test_5000_columns_by_position(spark, at):
    names = ["Sample", "Age", "Sex", *[f"genus_{i}" for i in range(5000)]]
    lines = [",".join(names)] + [",".join([f"s{k}", str(20 + k), "" if k == 1 else "f", *[str((i * k) % 97 / 4) if (i + k) % 10 else "NA" for i in range(5000)]]) for k in range(40)]
    table = wide.read(spark, write(at / "big.csv", lines))
    assert table.layout == "wide" and len(table.header) == 5003
    df = wide.records(table)
    got = {r["sample_id"]: r for r in df.collect()}
    assert len(got) == 40 and all(len(r["features"]) == 4500 for r in got.values())
    assert got["s3"]["features"]["genus_4999"] == (4999 * 3) % 97 / 4 and got["s3"]["label"] == "23" and got["s3"]["metadata"] == {"Sex": "f"} and got["s1"]["metadata"] == {}
    assert {r["modality"] for r in got.values()} == {"metagenomics"}
    nodes = lambda n: len(wide.records(wide.Wide("x.csv", names[: 3 + n], table.rows, table.first))._jdf.queryExecution().analyzed().toString().split("#"))
    assert nodes(5000) == nodes(10)  # as many attributes in the plan
    each = wide.long_rows(table, names[3:], wide.cell(0), "sample", "feature")
    assert each.count() == 40 * 4500 and each.columns == ["sample", "feature", "value"]


def test_maf_rows_are_features(spark, at):
    lines = ["database_identifier\tmetabolite_identification\tmass_to_charge\tmodifications\tS1\tS2\tA long sample name x\tUnnamed: 9",
             "D1\tglucose\t180.1\t\t1.5\t2\t9\t9", "D2\tglucose\t181\tNa\t3\tnan\t9\t9", "\t\t99.5\t\t4\t\t9\t9", "\tNaN\t\t\t5\t6\t9\t9", "D5\t\t\t\t\t7\t9\t9", "D6\tglucose\t181\tNa\t8\t1\t9\t9"]
    table = wide.read(spark, write(at / "m_maf.tsv", lines))
    assert table.layout == "maf"
    assert [r["name"] for r in wide.feature_names(table).orderBy("pos").collect()] == ["glucose", "glucose_181_Na", "mz_99.5", "feature_unknown", "D5", "glucose_181_Na"]
    got = {r["sample_id"]: (r["features"], r["modality"], r["label"]) for r in wide.records(table).collect()}
    assert set(got) == {"S1", "S2"} and got["S2"] == ({"glucose": 2.0, "feature_unknown": 6.0, "D5": 7.0, "glucose_181_Na": 1.0}, "metabolomics", None)
    assert got["S1"][0]["mz_99.5"] == 4.0 and got["S1"][0]["glucose"] == 1.5


def test_roles_by_a_callback_and_odd_lines(spark, at):
    lines = ['who,"note, quoted",x,y,group', 'a,"hello, ""you""",1,2,g', "", "b,,inf,3.5", ",n,5,6,h,extra"]
    table = wide.read(spark, write(at / "odd.csv", lines))
    assert table.layout == "generic" and table.header[1] == "note, quoted"
    seen = []

    def roles(header, first):
        seen.append((header, first))
        return {"who": "id", "note, quoted": "meta", "x": "feature", "y": "label"}

    got = [tuple(r) for r in wide.records(table, roles).select("sample_id", "features", "label", "metadata").collect()]
    assert got == [("a", {"x": 1.0}, "2", {"note, quoted": 'hello, "you"'}), ("b", {}, "3.5", {}), ("sample_2", {"x": 5.0}, "6", {"note, quoted": "n"})]
    assert len(seen) == 1 and len(seen[0][1]) == 3
    assert wide.roles_of(table, lambda h, r: {"x": "id", "y": "id"})["y"] == "ignore" and wide.roles_of(table, lambda h, r: {})["who"] == "sample_id"


def test_nothing_and_a_header_alone(spark, at):
    assert wide.records(wide.read(spark, write(at / "none.csv", []))).count() == 0
    table = wide.read(spark, write(at / "head.csv", ["id,age,f1"]))
    assert table.layout == "generic" and wide.records(table).count() == 0


def test_contents(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "3", 4.5)], "id int, s string, `d.e` double")
    assert sorted(map(tuple, wide.contents(df).collect())) == [(0, "id", 2, 2), (1, "s", 2, 1), (2, "d.e", 1, 1)]
    assert wide.contents(df.filter(F.lit(False))).count() == 0
