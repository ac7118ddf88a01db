import random
from urllib.parse import urlparse

from joblume.operators import records

SCHEMA = ("url_no long, batch_no long, pos long, titulo string, empresa string, localizacao string, origem string, "
          "salario string, requisitos array<string>, link_inscricao string, source_url string")


def loop(items):
    seen, out = set(), []
    for i in sorted(items, key=lambda i: i[:3]):
        key = i[3].lower() + "|" + i[4].lower()
        if key in seen:
            continue
        seen.add(key)
        if not i[3].strip() or not i[4].strip():
            continue
        url = urlparse(i[10])
        link = i[9]
        if not link or "http" not in link:
            link = f"{url.scheme}://{url.netloc}" + (link if link.startswith("/") else "/" + link)
        origin = i[6]
        if not origin or origin.lower() in ("desconhecida", "unknown"):
            origin = url.netloc.replace("www.", "").split(".")[0].capitalize()
        out.append((*i[:6], origin, *i[7:9], link, i[10]))
    return out


def random_items(n=600):
    rng = random.Random(8)
    return [(rng.randint(0, 5), rng.randint(0, 3), n_, rng.choice(["Dev", "dev", "DÉV", " Dev", "", "\t", "a|b", "a", " "]),
             rng.choice(["Acme", "acme", "", "b|c", "c", "　", "|b"]), "", rng.choice(["", "UNKNOWN", " unknown", "Desconhecida", "Web"]),
             "", ["x"], rng.choice(["", "/a", "a/b", "http://q", "ahttp", "HTTP://Q"]),
             rng.choice(["https://www.x.com/p", "HTTP://m.Y.org:8080", "http://z"])) for n_ in range(n)]


def test_finalize_matches_a_loop(spark):
    items = random_items()
    got = records.finalize(spark.createDataFrame(items, SCHEMA).repartition(5)).drop("item_key").collect()
    assert sorted(map(tuple, got)) == sorted(loop(items))


def test_blank_record_takes_its_key(spark):
    row = lambda pos, t, e: (0, 0, pos, t, e, "", "", "", [], "", "http://x")
    items = [row(0, "", "b|c"), row(1, "|b", "c")]
    assert records.finalize(spark.createDataFrame(items, SCHEMA)).collect() == []


def test_stored_keys_are_left_out(spark):
    items = records.dedupe_first(spark.createDataFrame(random_items(), SCHEMA))
    stored = spark.createDataFrame([("dev|acme",), ("dev|acme",)], "item_key string")
    left = {r.item_key for r in records.drop_stored(items, stored).collect()}
    assert "dev|acme" not in left and len(left) == items.count() - 1
