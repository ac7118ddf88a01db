import pytest
from pyspark.sql import functions as F

from joblume.sources import pages
from joblume.sources.replies import read_replies
from joblume.sources.titles import LISTING_TYPE, scan_titles
from joblume.sources.url_list import first_lines, read_url_list


def test_url_list(spark, tmp_path):
    text = "http://a \n# no\n  # kept\n\n   \n#x\n\thttp://b\r\nhttp://a"
    path = tmp_path / "urls.txt"
    path.write_bytes(text.encode())
    expected = [line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    urls = read_url_list(spark, str(path))
    assert [r.url for r in urls.orderBy("line_no").collect()] == expected
    firsts = {r.url: (r.url_no, r.n_lines) for r in first_lines(urls).collect()}
    assert firsts["http://a"][1] == 2 and len(firsts) == 3


def test_missing_list_is_empty(spark, tmp_path):
    assert read_url_list(spark, str(tmp_path / "none.txt")).count() == 0


@pytest.fixture
def snapshots(spark):
    rows = [(1, "a", "old"), (2, "a", "new"), (3, "b", ""), (4, "c", None), (5, "d", " "), (6, "e", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_latest_snapshot_with_content(spark, snapshots):
    wanted = spark.createDataFrame([("a", 7), ("b", 8), ("c", 9), ("d", 10), ("z", 11)], "url string, n int")
    found = pages.has_content(pages.fetch(snapshots, wanted))
    assert sorted((r.url, r.html, r.n) for r in found.collect()) == [("a", "new", 7), ("d", " ", 10)]


def test_lookup_keeps_lines_and_tells_missing(spark, snapshots):
    urls = spark.createDataFrame([(1, "a"), (2, "z"), (3, "a")], "line_no long, url string")
    assert sorted((r.line_no, r.html) for r in pages.lookup(urls, snapshots).collect()) == [(1, "new"), (2, None), (3, "new")]
    assert [r.line_no for r in pages.missing(urls, snapshots).collect()] == [2]


def test_settling_snapshots_does_not_read_content(spark, tmp_path, snapshots):
    snapshots.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = pages.fetch(stored, stored.select("url").distinct())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("html:string") == 1 and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("limit, wanted, reduced_first", [(10**6, "abcd", False), (0, "abcd", True), (0, "a", False)])
def test_short_and_long_lists_fetch_the_same(spark, snapshots, limit, wanted, reduced_first):
    listed = spark.createDataFrame([(u, ord(u)) for u in wanted], "url string, n int")
    reduce = lambda rows: rows.select("url", "page_id", F.length("html").alias("size"))
    found = pages.fetch(snapshots, listed, reduce, limit)
    plan = found._jdf.queryExecution().executedPlan().toString()
    expected = {"a": (2, 3), "b": (3, 0), "c": (4, None), "d": (5, 1)}
    assert {r.url: (r.page_id, r.size, r.n) for r in found.collect()} == {u: (*expected[u], ord(u)) for u in wanted}
    assert ("SortMergeJoin" in plan) == (limit == 0)      # a bit filter may be broadcast before it
    assert (plan.count("SortMergeJoin") == 1) == reduced_first


def test_titles_until_the_first_failing_page(spark):
    node = lambda t: {"content": {"title": t}}
    listing = [(0, [node(" [Web] Dev @ ACME "), None, {"content": None}, node(None), node("")]), (1, [node("b"), node("B ")]),
               (2, None), (3, [node("never")])]
    frame = spark.createDataFrame(listing, LISTING_TYPE)
    assert sorted(r.title for r in scan_titles(frame).collect()) == ["[web] dev @ acme", "b"]
    assert scan_titles(frame.where("page_no < 2")).count() == 2


def test_landed_replies(spark, tmp_path):
    (tmp_path / "r.txt").write_text('1\t{"vagas": []}\n2\n\nx\ty\n3\ta\tb\n')
    got = read_replies(spark, str(tmp_path / "r.txt"), "text").orderBy("batch_id").collect()
    assert [tuple(r) for r in got] == [(1, '{"vagas": []}'), (2, None), (3, "a\tb")]
