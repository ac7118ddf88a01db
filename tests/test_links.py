import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from joblume.operators import links, skew

NOW = datetime(2024, 1, 15, 12)
CARD = "pos int, href string, has_time boolean, datetime_attr string, time_text string"


AGES = {"": 0, "1 day": 24, "3 days": 72, "2 weeks": 336}     # hours of the texts below
MOMENTS = {"2024-01-15": 12, "2024-01-10": 132, "2024-01-14T00:00:00+05:00": 36}    # hours before NOW, offsets dropped


def hours_old(card):
    _, _, has_time, attr, text = card
    return MOMENTS.get(attr, AGES.get(text, 0)) if has_time else 0


def expected_links(cards, anchors, fallback_recency=False):
    """By places: the first of each link's fresh places, then of its places among the anchors."""
    def firsts(hrefs):
        absolute = [href or "" for href in hrefs]
        return sorted({href for href in absolute if "http" in href}, key=absolute.index)

    links = firsts([card[1] for card in cards if hours_old(card) <= 36])
    skipped = {card[1] for card in cards} if fallback_recency else set()
    return links or [href for href in firsts(anchors) if href not in skipped]


def random_pages(n=200):
    rng = random.Random(5)
    pages = []
    for page in range(n):
        cards = [(i, rng.choice([None, "", "/job/1", "http://a", "http://b", "x?u=http", "HTTP://c"]), rng.random() < 0.7,
                  rng.choice([None, "bad", "2024-01-15", "2024-01-10", "2024-01-14T00:00:00+05:00"]),
                  rng.choice(["", "2 weeks", "3 days", "1 day"])) for i in range(rng.randint(0, 6))]
        cards = [c if c[2] else (*c[:3], None, None) for c in cards]
        pages.append((page, cards, [c[1] for c in cards if c[1] is not None] + rng.choices(["http://z", "/job/9"], k=2)))
    return pages


@pytest.mark.parametrize("fallback_recency", [False, True])
def test_page_links_match_a_loop(spark, fallback_recency):
    pages = random_pages()
    frame = spark.createDataFrame(pages, f"page_id int, cards array<struct<{CARD.replace(' ', ': ').replace(',: ', ', ')}>>, anchors array<string>")
    found = links.with_links(frame, F.col("cards"), F.col("anchors"), NOW, fallback_recency)
    assert {r.page_id: r.links for r in found.collect()} == {p: expected_links(c, a, fallback_recency) for p, c, a in pages}


def test_flat_rows_give_the_same_links_and_batches(spark):
    pages = random_pages()
    flat = spark.createDataFrame([(p, *c) for p, cards, _ in pages for c in cards], f"listing_id int, {CARD}")
    batched = links.assign_batches(links.distinct_links(links.fresh_cards(flat, NOW)), batch_size=2)
    got = {}
    for row in batched.orderBy("listing_id", "link_no").collect():
        got.setdefault(row.listing_id, []).append((row.href, row.link_no, row.batch_no))
    expected = {p: [(h, i, i // 2) for i, h in enumerate(expected_links(c, []))] for p, c, _ in pages}
    assert got == {p: rows for p, rows in expected.items() if rows}


def test_array_batches(spark):
    page = spark.createDataFrame([(1, [f"h{i}" for i in range(7)])], "url_no int, links array<string>")
    rows = links.explode_links(page, ["url_no"], 5).orderBy("pos").collect()
    assert [r.batch_no for r in rows] == [0, 0, 0, 0, 0, 1, 1]


def test_one_link_is_not_followed(spark):
    got = spark.range(3).select(links.follows_links(F.col("id"))).collect()
    assert [r[0] for r in got] == [False, False, True]


def test_numbering_in_chunks(spark):
    rng = random.Random(6)
    places = sorted(rng.sample(range(-50, 3000), 700))
    rows = [(g, p) for g in range(3) for p in places[g::2]]
    frame = spark.createDataFrame(rows, "g int, p bigint").repartition(7)
    got = sorted(tuple(r) for r in skew.number_within(frame, ["g"], "p", "n", chunk=64).collect())
    expected = [(g, p, n) for g in range(3) for n, p in enumerate(sorted(q for h, q in rows if h == g))]
    assert got == sorted(expected)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_is_a_join(spark, how):
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 90)).alias("k"))
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 90, 2)], "k string, v int")
    plain = sorted(map(str, left.join(right, "k", how).collect()))
    for rows_per_slot in (10, 100, 10**6):
        spread = skew.spread_join(left, right, "k", how, ["id"], rows_per_slot)
        assert sorted(map(str, spread.select(*left.join(right, "k", how).columns).collect())) == plain


def test_spread_join_keeps_null_keys_of_a_left_join(spark):
    left = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    right = spark.createDataFrame([("a", 1)], "k string, v int")
    assert sorted((r.id, r.v) for r in skew.spread_join(left, right, "k", "left", ["id"]).collect()) == [(1, None), (2, 1)]


def test_a_hot_key_is_split(spark):
    left = spark.range(4000).select("id", F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.spread_join(left, right, "k", "inner", ["id"], rows_per_slot=100)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_row_per_key_and_map_task_is_shuffled(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    plan = skew.first_per_key(rows, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
