from pyspark.sql import functions as F

from seqloom.llm.line_dedup import drop_boilerplate, host_of, lines_of_html


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, text string, host string, lines string")
    return {r.page_id: r for r in drop_boilerplate(df, df["text"], df["host"], **kw).collect()}


def test_ratio_by_host(spark):
    rows = [(i, f"menu\n unique {i} \n{'rare' if i < 2 else ''}\nmenu", "a", "x") for i in range(10)]
    rows += [(100 + i, "menu\nbody", "b", "x") for i in range(3)]  # too few pages to judge
    got = run(spark, rows)
    assert got[0].text == "unique 0\nrare" and got[0].n_lines == 4 and got[0].n_dropped == 2
    assert got[5].text == "unique 5" and got[100].text == "menu\nbody"


def test_edges(spark):
    rows = [(1, None, "a", "x"), (2, "", None, "x"), (3, "\n \t\n", "a", "x"), (4, "x" * 200_000 + "\r\nend", "a", "x"), (5, "one", "a", "x"), (5, "one", "a", "x")]
    df = spark.createDataFrame(rows, "page_id long, text string, host string, lines string")
    got = drop_boilerplate(df, df["text"], df["host"]).collect()
    assert len(got) == 6 and sum(r.n_dropped for r in got) == 0
    assert {r.text for r in got if r.page_id in (1, 2, 3)} == {""}
    assert drop_boilerplate(df.limit(0), df["text"], df["host"]).count() == 0


def test_hosts_and_html(spark):
    df = spark.createDataFrame([("http://User@WWW.Example.com:80/a?b#c", "<head><title>t</title></head><p>A &amp; B<br>c<script>x</script> <b>d</b></p><!-- no -->"), ("no url", None), (None, "plain")], "u string, h string")
    got = df.select(host_of(F.col("u")).alias("u"), lines_of_html(F.col("h")).alias("h")).collect()
    assert [r.u for r in got] == ["example.com", "", None]
    assert got[0].h.split() == ["A", "&", "B", "c", "d"] and got[1].h is None and got[2].h == "plain"
