"""Report runs (B2): one run of each distinct query, failures as block outcomes."""

import datetime as dt

import pytest

from reportlake.plans import reports as R

NOW = dt.datetime(1998, 3, 10, 9, 30)


@pytest.fixture
def run(spark):
    history = spark.createDataFrame([], "timestamp timestamp_ntz, vuln_severity string, zone_id bigint, value bigint")
    spark.createDataFrame([("High", 3, 1), ("Low", 5, 0), ("High", 2, 0)], "severity string, n bigint, d bigint"
                          ).createOrReplaceTempView("facts")

    def go(queries, types=None, library=True):
        blocks = spark.createDataFrame(
            [(1, i, (types or ["table"] * len(queries))[i], q) for i, q in enumerate(queries)],
            "template_id bigint, block_idx int, type string, query string")
        for c, ty in (("days", "int"), ("zone_id", "int"), ("title", "string"), ("description", "string"),
                      ("show_legend", "boolean"), ("width", "string")):
            blocks = blocks.selectExpr("*", f"CAST(NULL AS {ty}) AS {c}")
        return R.run_reports(spark, blocks, history, NOW, queries=queries if library else None)
    return go


def outcomes(out):
    return [(r.status, r.message, r.n_rows) for r in out["results"].orderBy("block_idx").collect()]


def test_a_query_that_fails_while_it_runs_fails_its_blocks_only(run):
    good, bad = "SELECT severity, n FROM facts", "SELECT severity, n / d AS q FROM facts"
    out = run([good, bad, "SELECT severity, raise_error('no luck') AS x FROM facts", "SELECT nothing FROM nowhere", "", bad],
              ["table", "table", "pie_chart", "table", "table", "vertical_bar"])
    got = outcomes(out)
    assert got[0] == ("ok", "Displaying 3 records", 3)
    assert got[1][:2] == got[5][:2] == ("error", "Error: DIVIDE_BY_ZERO")
    assert got[2][:2] == ("error", "Error: USER_RAISED_EXCEPTION")
    assert got[3][:2] == ("error", "Error: TABLE_OR_VIEW_NOT_FOUND") and got[4][0] == "error"
    assert out["tables"].count() == 3 and "pies" in out and out["pies"].isEmpty()


def test_equal_queries_of_different_text_run_once(run, spark, monkeypatch):
    ran = []
    kept = R._materialised
    monkeypatch.setattr(R, "_materialised", lambda s, f, tag: (ran.append(tag), kept(s, f, tag))[1])
    texts = ["SELECT severity, sum(n) AS total FROM facts GROUP BY severity",
             "select  severity,\n sum(n) as total from facts group by severity",
             "SELECT severity, total FROM (SELECT severity, sum(n) AS total FROM facts GROUP BY severity)",
             "SELECT severity, sum(n) AS other FROM facts GROUP BY severity"]
    out = run(texts, ["traffic_lights", "pie_chart", "table", "horizontal_bar"], library=False)
    assert 2 <= len(ran) <= 3 and len(set(ran)) == len(ran)  # the last has a column of another name
    assert [x[2] for x in outcomes(out)] == [2, 2, 2, 2]
    assert sorted((r.label, r.value) for r in out["tiles"].collect()) == [("High", 5), ("Low", 5)]
    assert out["bars"].count() == out["pies"].count() == out["tables"].count() == 2


def test_odd_results_are_written(run):
    got = outcomes(run(["SELECT n, n FROM facts", "SELECT NULL AS x, severity FROM facts",
                        "SELECT map('a', n) AS `odd name, (x)` FROM facts", "SELECT n FROM facts WHERE n > 99"]))
    assert [x[0] for x in got] == ["ok", "ok", "ok", "empty"] and [x[2] for x in got] == [3, 3, 3, 0]
