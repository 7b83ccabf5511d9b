import pytest

from screenflow.operators import truth as t
from screenflow.sources.truth import NO_VALUE, read_truth_csv, write_csv
from screenflow.spec import CLASSIFY

COL = CLASSIFY.truth_col


def test_csv_dialect(spark, tmp_path):
    path = tmp_path / "truth.csv"
    path.write_text(
        f'" url ","{COL}","use","rationale"\n'
        '"a","TRUE","test","line one\nline ""two"", end"\n'
        '"b"," true ","Train","  spaced  "\n'
        'c,False,TEST,\\back\n',
        encoding="utf8",
    )
    rows = {r["url"]: r for r in read_truth_csv(spark, str(path)).collect()}
    assert rows["a"]["rationale"] == 'line one\nline "two", end'
    assert rows["b"]["rationale"] == "  spaced  " and rows["b"][COL] == " true "
    assert rows["c"]["rationale"] == "\\back"
    assert rows["a"]["ord"] < rows["b"]["ord"] < rows["c"]["ord"]


@pytest.mark.parametrize("multiline", [True, False])
def test_later_files_come_later(spark, tmp_path, multiline):
    head = f"url,{COL},use\n"
    (tmp_path / "a.csv").write_text(head + "k,FALSE,test\n")
    (tmp_path / "b.csv").write_text(head + "".join(f"u{i},TRUE,test\n" for i in range(200)) + "k,TRUE,test\nk,FALSE,test\nk,TRUE,test\n")
    rows = read_truth_csv(spark, str(tmp_path), multiline).orderBy("ord")
    assert [r[COL] for r in rows.filter("url = 'k'").collect()] == ["FALSE", "TRUE", "FALSE", "TRUE"]
    assert [r["url"] for r in rows.collect()] == ["k", *(f"u{i}" for i in range(200)), "k", "k", "k"]
    assert rows.columns == ["url", COL, "use", "ord"]


def test_no_value_strings_become_null(spark, tmp_path):
    path = str(tmp_path / "t")
    kept = [" ", "na", "NAN", "none", "0", "N/A ", "nul"]
    cells = [(f"u{i}", x) for i, x in enumerate([*NO_VALUE, *kept])]
    write_csv(spark.createDataFrame(cells, "url string, rationale string"), path, quote_all=True)
    got = [r["rationale"] for r in read_truth_csv(spark, path).orderBy("url").collect()]
    assert sorted(x for x in got if x is not None) == sorted(kept)
    assert got.count(None) == len(NO_VALUE)


def frame(spark, rows):
    return spark.createDataFrame(rows, f"url string, {COL} string, use string, ord bigint")


def test_normalise_and_split(spark):
    rows = frame(spark, [("a", "\u3000true ", " Train", 1), ("b", "FALSE", "TEST\n", 2)])
    clean = t.normalise_truth(rows, [COL, "absent"])
    assert t.train_rows(clean).first()[COL] == "TRUE"
    assert t.held_out_rows(clean).first()["url"] == "b"


def test_missing_labels_are_dropped_with_a_warning(spark):
    rows = t.normalise_truth(
        frame(spark, [("a", None, "odd", 1), ("b", "true", "test", 2)]), [COL]
    )
    with pytest.warns(UserWarning, match="dropping 1 rows"):
        assert [r["url"] for r in t.validate_truth(rows, COL).collect()] == ["b"]


@pytest.mark.parametrize(
    ("label", "use", "message"),
    [
        ("maybe", "test", "invalid_label 'MAYBE'"),
        ("  ", "test", "invalid_label ''"),
        ("TRUE", "dev", "invalid_use 'dev'"),
        ("TRUE", None, "invalid_use None"),
    ],
)
def test_invalid_values_raise(spark, label, use, message):
    rows = t.normalise_truth(frame(spark, [("a", label, use, 1)]), [COL])
    with pytest.raises(ValueError, match=message):
        t.validate_truth(rows, COL)


def test_missing_columns_are_listed_sorted(spark):
    rows = spark.createDataFrame([("x",)], "other string")
    with pytest.raises(ValueError, match=f"lacks columns: {COL}, url, use"):
        t.validate_truth(rows, COL)


def test_issue_report_counts_a_frequent_value_once(spark):
    rows = spark.range(9000).selectExpr(
        "cast(id as string) as url",
        f"case when id % 3 = 0 then 'MAYBE' else 'TRUE' end as {COL}",
        "'test' as use",
    )
    issues = t.truth_issues(rows, COL).collect()
    assert [(r["check"], r["value"], r["n"]) for r in issues] == [("invalid_label", "MAYBE", 3000)]
