"""A caller's own checks, handlers and the table function."""

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from paperloom.operators.user_functions import Checks, Sites, line_function


def test_checks_of_a_row_run_together_and_may_fail(spark):
    checks = Checks()

    @checks.register("long", "text")
    def long(text):
        return len(text) > 3, f"{len(text)}"

    @checks.register("agrees", "n", "text")
    def agrees(n, text):
        return n == len(text), "counted"

    df = spark.createDataFrame([(1, "abcd", 4, "z"), (2, None, 1, "z"), (2, "a", 2, "z")], "id int, text string, n int, name string")
    got = sorted(map(tuple, checks.run(df).collect()))
    error = "TypeError: object of type 'NoneType' has no len()"
    assert got == [(1, "agrees", True, "counted"), (1, "long", True, "4"), (2, "agrees", False, error), (2, "agrees", False, "counted"), (2, "long", False, "1"), (2, "long", False, error)]
    assert checks.run(df.limit(0)).collect() == []


def test_handlers_see_only_their_sites(spark):
    sites = Sites()

    @sites.register("Blog.Example.org")
    def blog(url):
        return "blog"

    @sites.register("example.org")
    def all_of_it(url):
        if "bad" in url:
            raise ValueError("bad page")
        return None if "empty" in url else url

    urls = ["http://blog.example.org/x", "https://BLOG.example.org:80", "http://example.org", "http://a.example.org/bad", "http://u:p@example.org/empty", "http://notexample.org", None, "no url"]
    df = spark.createDataFrame([(i, u, "s") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r["page_id"]: (r["site"], r["answer"], r["error"]) for r in sites.answers(df, "url").collect()}
    assert got == {0: ("blog.example.org", "blog", None), 1: ("blog.example.org", "blog", None), 2: ("example.org", "http://example.org", None),
                   3: ("example.org", None, "ValueError: bad page"), 4: ("example.org", None, None)}
    assert Sites().answers(df, "url").count() == 0


def test_table_function_follows_table_and_checks(spark):
    checks = Checks()
    checks.register("even", "n")(lambda n: (n % 2 == 0, "looked"))
    checks.register("named", "name")(lambda name: (bool(name), "named"))
    line_function(spark, "looked_at", checks)
    spark.createDataFrame([(1, "a"), (2, "")], "n int, name string").createOrReplaceTempView("looked_lines")
    got = spark.sql("SELECT * FROM looked_at(TABLE(looked_lines), 'named, even')")
    assert got.columns == ["n", "name", "named_passed", "named_message", "even_passed", "even_message"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", True, "named", False, "looked"), (2, "", False, "named", True, "looked")]
    for call in ("looked_at(TABLE(looked_lines), 'nothing')", "looked_at(TABLE(SELECT 1 AS x), 'even')"):
        with pytest.raises((AnalysisException, PySparkException)):
            spark.sql(f"SELECT * FROM {call}").collect()
    assert spark.sql("SELECT * FROM looked_at(TABLE(looked_lines), '')").select(F.count("*")).first()[0] == 2
