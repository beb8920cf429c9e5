"""Loading, cleaning, encoding and splitting on hand-made edge frames."""

import os

import pytest
from pyspark.sql import functions as F

from churnframe.operators.clean import clean
from churnframe.operators.encode import align_features, encode, fit_encoders
from churnframe.operators.split import stratified_split, test_rows as rows_in_test
from churnframe.sources.conform import enrich_base_wins
from churnframe.sources.tenant_files import (
    duplicate_ids,
    load_tenant,
    read_tenant,
    require_columns,
    require_unique_key,
)
from churnframe.spec import BANKING, TELCO, TenantSpec


def test_coercion_and_zero_tenure(spark):
    rows = [
        ("a", 0, "20.0", " "),
        ("b", 0, "30.0", ""),
        ("c", 5, "12.5", "62.5"),
        ("d", 3, " 2.5 ", "1d"),
        ("e", 1, "abc", "1e3"),
        ("f", 2, None, None),
        ("g", 0, "7", "7"),
    ]
    df = spark.createDataFrame(rows, "customerID string, tenure long, MonthlyCharges string, TotalCharges string")
    df = df.withColumn("Churn", F.lit("No"))
    out = {r["customerID"]: r for r in clean(df, TELCO).collect()}
    # zero tenure and blank total: takes the monthly charge
    assert out["a"]["TotalCharges"] == 20.0 and out["b"]["TotalCharges"] == 30.0
    assert out["c"]["TotalCharges"] == 62.5
    # '1d' is not a number (Spark alone would read 1.0): becomes 0.0
    assert out["d"]["TotalCharges"] == 0.0 and out["d"]["MonthlyCharges"] == 2.5
    assert out["e"]["TotalCharges"] == 1000.0
    # in the tenure branch a missing revenue is left missing
    assert out["e"]["MonthlyCharges"] is None and out["f"]["MonthlyCharges"] is None
    assert out["f"]["TotalCharges"] == 0.0
    assert out["g"]["TotalCharges"] == 7.0


def test_revenue_fill_without_tenure_branch(spark):
    df = spark.createDataFrame([(1, 1, "5.5"), (2, 0, None), (3, 1, "x")], "CustomerId long, Exited long, Balance string")
    out = {r["CustomerId"]: r["Balance"] for r in clean(df, BANKING).collect()}
    assert out == {1: 5.5, 2: 0.0, 3: 0.0}


def test_csv_load_null_tokens_and_validation(spark, scratch):
    path = os.path.join(scratch, "t.csv")
    with open(path, "w") as f:
        f.write("customerID,Churn,MonthlyCharges,note\n")
        f.write("A,Yes,1.0,NA\nB,No,2.0,N/A\nC,No,3.0,ok\n")
    df = load_tenant(spark, TELCO, path)
    notes = {r["customerID"]: r["note"] for r in df.collect()}
    assert notes == {"A": None, "B": None, "C": "ok"}


def test_missing_columns_are_named_by_role(spark):
    df = spark.createDataFrame([(1,)], "x long")
    with pytest.raises(ValueError, match="telco: no id column 'customerID', no label column 'Churn', no revenue column 'MonthlyCharges'"):
        require_columns(df, TELCO)


def test_duplicate_and_null_ids(spark):
    one_null = spark.createDataFrame([("a",), (None,)], "id string")
    require_unique_key(one_null, "id")
    two_null = spark.createDataFrame([("a",), (None,), (None,)], "id string")
    with pytest.raises(ValueError):
        require_unique_key(two_null, "id")
    dup = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert [tuple(r) for r in duplicate_ids(dup, "id").collect()] == [("a", 2)]


def test_missing_path_raises(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_tenant(spark, "/tmp/churnframe-no-such-file.csv")


def test_encoders_unseen_and_null(spark):
    train = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), (None, 4)], "cat string, n long")
    enc = fit_encoders(train, ["cat"])
    codes = {r["value"]: r["code"] for r in enc.collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}
    test = spark.createDataFrame([("c", 1), ("z", 2), (None, 3)], "cat string, n long")
    out = [r["cat"] for r in encode(test, enc, ["cat"]).orderBy("n").collect()]
    assert out == [2.0, -1.0, -1.0]


def test_align_features_fills_absent(spark):
    df = spark.createDataFrame([(1, 2.0, 9)], "id long, a double, extra long")
    out = align_features(df, ["b", "a"], keep=["id"])
    assert out.columns == ["id", "b", "a"]
    assert tuple(out.collect()[0]) == (1, 0.0, 2.0)


def test_split_class_sizes(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 1409)], "n long")
    assert [r[0] for r in df.select(rows_in_test(F.col("n"), 0.2)).collect()] == [0, 1, 1, 1, 282]
    assert [r[0] for r in df.select(rows_in_test(F.col("n"), 1.0)).collect()] == [0, 1, 1, 2, 704]


def test_split_small_classes_and_row_order(spark):
    rows = [(f"id{i}", lab) for lab, n in (("A", 1), ("B", 2), ("C", 3), ("D", 5)) for i in range(n * 10, n * 10 + n)]
    spec = TenantSpec("t", "cid", "y", "A", "rev")
    df = spark.createDataFrame(rows, "cid string, y string")
    m = {r["label"]: r["n"] for r in stratified_split(df, spec).filter("split = 'test'").groupBy("label").count().withColumnRenamed("count", "n").collect()}
    assert m.get("A", 0) == 0 and m["B"] == 1 and m["C"] == 1 and m["D"] == 1
    a = {tuple(r) for r in stratified_split(df, spec).collect()}
    b = {tuple(r) for r in stratified_split(df.orderBy(F.rand(7)).repartition(3), spec).collect()}
    assert a == b


def test_enrich_base_wins(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "id long, Contract string")
    ext = spark.createDataFrame([(1, "other", 5.0), (1, "other", 5.0), (3, "z", 7.0)], "id long, Contract string, CLTV double")
    out = {r["id"]: tuple(r) for r in enrich_base_wins(base, ext, "id", ["CLTV"]).collect()}
    assert out == {1: (1, "x", 5.0), 2: (2, "y", None)}
    # as in any left join, both rows of id 1 are there
    assert enrich_base_wins(base, ext, "id", ["CLTV"]).count() == 3
    with pytest.raises(ValueError):
        enrich_base_wins(base, ext, "id", ["Contract"])


def test_numeric_column_is_not_categorical(spark):
    from churnframe.operators.encode import categorical_columns

    df = spark.createDataFrame([("a", 1, 2.0, True)], "s string, i long, d double, b boolean")
    assert categorical_columns(df, df.columns) == ["s", "b"]


def test_relabel_edge_cases(spark):
    from churnframe.operators.feedback import append_feedback, relabel

    spec = TenantSpec("t", "id", "y", "Yes", "rev")
    df = spark.createDataFrame([(1, "Yes"), (2, "Yes"), (3, "No")], "id long, y string")
    outcomes = spark.createDataFrame([(1, "No"), (1, "No"), (9, "No")], "id long, new_label string")
    out = {r["id"]: r["y"] for r in relabel(df, outcomes, spec).collect()}
    assert out == {1: "No", 2: "Yes", 3: "No"}  # one row per id, unknown id ignored
    assert sorted(r["y"] for r in df.collect()) == ["No", "Yes", "Yes"]  # source untouched
    batch = spark.createDataFrame([(1, "No", "tag")], "id long, y string, data_source string")
    both = append_feedback(df, batch)
    assert both.count() == 4 and both.filter("data_source IS NULL").count() == 3


def test_numeric_tokens_like_pandas(spark):
    import pandas as pd

    from churnframe.functions.columns import coerce_numeric
    from pyspark.sql import types as T

    tokens = ["inf", "-Infinity", "+5", ".5", "5.", "1E3", "1_000", "0x10", "nan", "1d", " 7 ", "--1"]
    df = spark.createDataFrame([(t,) for t in tokens], "s string")
    got = [r[0] for r in df.select(coerce_numeric(F.col("s"), T.StringType())).collect()]
    want = pd.to_numeric(pd.Series([t.strip() for t in tokens]), errors="coerce").tolist()
    want = [None if w != w else w for w in want]  # NaN is missing
    assert got == want


def test_encoder_gives_minus_one_without_a_code(spark):
    from churnframe.operators import encode as E

    train = spark.createDataFrame([(f"v{i % 37}", None) for i in range(300)], "a string, b string")
    test = spark.createDataFrame([(1, "v3", "w9"), (2, "zz", None), (3, None, "w0")], "id long, a string, b string")
    enc = E.fit_encoders(train, ["a", "b"])
    codes = {r["value"]: r["code"] for r in enc.collect()}
    assert codes == {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(37)))}
    got = {r["id"]: (r["a"], r["b"]) for r in E.encode(test, enc, ["a", "b"]).collect()}
    # a column without a value at fitting gives -1, as unseen values do
    assert got == {1: (float(codes["v3"]), -1.0), 2: (-1.0, -1.0), 3: (-1.0, -1.0)}


def test_strict_recode_fails_on_other_values(spark):
    from churnframe.sources.conform import conform_schema

    df = spark.createDataFrame([("a", "Yes"), ("b", "Maybe")], "id string, `Senior Citizen` string")
    slim, _full = conform_schema(df, {"Senior Citizen": "SeniorCitizen"}, ["id", "SeniorCitizen"], ["SeniorCitizen"])
    with pytest.raises(Exception, match="cannot recode"):
        slim.collect()
    ok, _ = conform_schema(df.filter("id = 'a'"), {"Senior Citizen": "SeniorCitizen"}, ["id", "SeniorCitizen"], ["SeniorCitizen"])
    assert ok.collect()[0]["SeniorCitizen"] == 1


def test_missing_numeric_feature_fails_before_fit(spark):
    from churnframe.operators.models import fit_churn

    spec = TenantSpec("t", "id", "y", "Yes", "rev")
    df = spark.createDataFrame([(1, "Yes", 1.0, None), (2, "No", 2.0, 3.0)], "id long, y string, rev double, x double")
    with pytest.raises(ValueError, match=r"missing values in features: \['x'\]"):
        fit_churn(df, spec)


def test_enrich_keeps_every_extended_row(spark):
    base = spark.createDataFrame([(1, "x"), (None, "y")], "id long, Contract string")
    ext = spark.createDataFrame([(1, 9.0, "b"), (1, None, "z"), (None, 5.0, "a")], "id long, CLTV double, City string")
    out = enrich_base_wins(base, ext, "id", ["CLTV", "City"]).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "x", 9.0, "b"), (1, "x", None, "z"), (None, "y", None, None)], key=str)


def test_csv_types_like_pandas(spark, scratch):
    import pandas as pd

    path = os.path.join(scratch, "t.csv")
    text = "id,age,whole,city,flag,note,gone\n1,30,1,Rome,True,NA,\n2,NA,2,None,False,x,NA\n3,41.5,3,NULL,True,,nan\n"
    with open(path, "w") as f:
        f.write(text)
    got = read_tenant(spark, path)
    want = pd.read_csv(path)
    kinds = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string"}
    assert {c: t for c, t in got.dtypes if c != "gone"} == {c: kinds[str(t)] for c, t in want.dtypes.items() if c != "gone"}
    rows = [tuple(r) for r in got.orderBy("id").collect()]
    assert rows == [(1, 30.0, 1, "Rome", True, None, None), (2, None, 2, None, False, "x", None), (3, 41.5, 3, None, True, None, None)]
    typed = read_tenant(spark, path, schema="id long, age double, city string")
    assert typed.dtypes == [("id", "bigint"), ("age", "double"), ("city", "string")]
    assert [tuple(r) for r in typed.orderBy("id").collect()] == [(1, 30.0, "Rome"), (2, None, None), (3, 41.5, None)]


def test_parquet_text_keeps_na_words(spark, scratch):
    path = os.path.join(scratch, "t.parquet")
    spark.createDataFrame([("NA", 1.0), ("None", float("nan"))], "s string, x double").write.parquet(path)
    assert sorted(map(tuple, read_tenant(spark, path).collect()), key=str) == [("NA", 1.0), ("None", None)]


def test_telco_export_conforms_and_enriches(spark):
    from churnframe.sources.conform import TELCO_COLUMNS, TELCO_ENRICHMENT, TELCO_RENAME, conform_schema

    values = {old: "x" for old in TELCO_RENAME} | {"CustomerID": "c1", "Senior Citizen": "Yes", "Count": "1"}
    values |= {c: f"new {c}" for c in TELCO_ENRICHMENT}
    export = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{c}` string" for c in values))
    slim, full = conform_schema(export, TELCO_RENAME, TELCO_COLUMNS, ["SeniorCitizen"], drop_from_full=["Count"])
    assert slim.columns == TELCO_COLUMNS and slim.collect()[0]["SeniorCitizen"] == 1
    assert set(full.columns) == {*TELCO_COLUMNS, *TELCO_ENRICHMENT}
    base = spark.createDataFrame([("c1", "kept")], "customerID string, City2 string")
    out = enrich_base_wins(base, full, "customerID", TELCO_ENRICHMENT).collect()[0]
    assert out["CLTV"] == "new CLTV" and out["City2"] == "kept"
