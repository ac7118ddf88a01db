"""Inputs of the registered queries, derived from the given tables.

The SQL runs in Spark and in DuckDB alike; ``{name}`` stands for a table.
Everything is derived from whole tables, row by row or in small groups, so that
it grows with them.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = "2024-01-15 12:00:00"

URLS = """
SELECT page_id AS line_no,
       CASE page_id % 10 WHEN 0 THEN concat('# ', url) WHEN 1 THEN '   '
            WHEN 2 THEN concat('  #', url) ELSE concat(url, ' ') END AS value
FROM {pages}
"""

TIMES = """
SELECT event_id,
  CASE event_id % 4
    WHEN 0 THEN concat(substr(CAST(ts AS VARCHAR(40)),1,10), 'T', substr(CAST(ts AS VARCHAR(40)),12,8), 'Z')
    WHEN 1 THEN concat(substr(CAST(ts AS VARCHAR(40)),1,10), 'T', substr(CAST(ts AS VARCHAR(40)),12,8), '-03:00')
    WHEN 2 THEN 'bad' ELSE NULL END AS datetime_attr,
  concat('há ', CAST(user_id % 40 AS VARCHAR(20)), ' ',
    CASE event_id % 9 WHEN 0 THEN 'dias' WHEN 1 THEN 'day' WHEN 2 THEN 'semana'
      WHEN 3 THEN 'meses' WHEN 4 THEN 'mês' WHEN 5 THEN 'horas' WHEN 6 THEN 'anos'
      WHEN 7 THEN '+ days' ELSE 'minutos' END) AS time_text
FROM {events}
"""

CARDS = """
SELECT page_id % 10 AS listing_id, page_id AS pos,
  CASE WHEN page_id % 11 = 0 THEN concat('/job/', CAST(page_id AS VARCHAR(20)))
       WHEN page_id % 7 = 0 THEN 'https://dup.example/job/1' ELSE url END AS href,
  CASE page_id % 3 WHEN 0 THEN '2024-01-14T12:00:00Z' WHEN 1 THEN '2024-01-10' ELSE NULL END AS datetime_attr,
  CASE page_id % 4 WHEN 0 THEN '2 weeks ago' WHEN 1 THEN '1 day ago' ELSE 'just now' END AS time_text
FROM {pages}
"""

ITEMS = """
SELECT p.p_partkey AS pos,
  CASE WHEN p.p_partkey % 97 = 0 THEN '  ' ELSE p.p_name END AS titulo,
  CASE WHEN p.p_partkey % 89 = 0 THEN '' ELSE p.p_brand END AS empresa,
  'Remoto' AS localizacao,
  CASE p.p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Desconhecida' WHEN 2 THEN 'UNKNOWN' ELSE 'LinkedIn' END AS origem,
  CAST(p.p_size AS VARCHAR(20)) AS salario,
  CASE p.p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('/apply/', CAST(p.p_partkey AS VARCHAR(20)))
    WHEN 2 THEN concat('apply/', CAST(p.p_partkey AS VARCHAR(20)))
    ELSE concat('https://x.example/', CAST(p.p_partkey AS VARCHAR(20))) END AS link_inscricao,
  concat(p.p_type, ' ', p.p_name) AS skills,
  g.url AS source_url
FROM (SELECT part.*, p_partkey % (SELECT count(*) FROM {pages}) AS page_no FROM {part} part) p
JOIN {pages} g ON g.page_id = p.page_no
"""

# documents, every other one of those without markup as a paragraph of HTML
ROUTED = """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND NOT contains(text, '<') AND NOT contains(text, '&')
  THEN concat('<p>', text, '</p>') ELSE text END AS text FROM {documents}
"""

# titles of an earlier run: same names, but companies by another column
TITLES = """
SELECT p_partkey,
  CASE WHEN p_partkey % 7 = 0 THEN NULL
       WHEN p_partkey % 11 = 0 THEN ''
       WHEN p_partkey % 13 = 0 THEN concat(p_name, ' at ', p_brand)
       WHEN p_partkey % 3 = 0 THEN concat(' [Web] ', p_name, ' @ Brand#', CAST(p_size AS VARCHAR(20)), ' ')
       ELSE concat('[Web] Senior ', p_name, ' (closed) @ ', p_brand) END AS title
FROM {part}
"""

FAILING_PAGE = "CAST(floor(count(*) * 3 / 200) AS BIGINT)"

# replies hold the records of five parts; the batch (here times five) picks the variant
_BATCH = "((p_partkey - p_partkey % 5) % 50)"
RECORD_JSON = f"""concat('{{"titulo": ', CASE {_BATCH} WHEN 25 THEN '7' WHEN 30 THEN 'null' ELSE concat('"', p_name, '"') END,
    ', "empresa": "', p_brand, '", "localizacao": "Remoto", "origem": "", "salario": "', CAST(p_size AS VARCHAR(20)), '"',
    CASE {_BATCH} WHEN 5 THEN ', "requisitos": null' WHEN 10 THEN concat(', "requisitos": "', p_type, '"') WHEN 15 THEN ''
        WHEN 20 THEN concat(', "requisitos": ["', p_type, '", 1]') ELSE concat(', "requisitos": ["', p_type, '", "x"]') END,
    ', "link_inscricao": "/apply/', CAST(p_partkey AS VARCHAR(20)), '"',
    CASE {_BATCH} WHEN 35 THEN ', "extra": {{"a": 1}}' ELSE '' END, '}}')"""
RESPONSE_JSON = """CASE batch_id % 10 WHEN 8 THEN '{"vagas": []}' WHEN 9 THEN
    concat('{"vagas": [', list, CASE WHEN batch_id % 20 = 9 THEN ']' ELSE ']},1]' END)
    ELSE concat('{"vagas": [', list, ']}') END"""

# keys stored by an earlier run, with repeats
STORED = """
SELECT lower(concat(p_name, '|Brand#', CAST(p_size AS VARCHAR(20)))) AS item_key FROM {part}
"""

# three snapshots of each URL: the first is cut short, the second has a mark before the page, the last is empty for some
SNAPSHOTS = """
SELECT page_id * 3 + k AS page_id, url,
  CASE k WHEN 0 THEN left(html, 200) WHEN 1 THEN concat('<!-- ', CAST(page_id AS VARCHAR(20)), ' -->', html)
         ELSE CASE WHEN page_id % 9 = 0 THEN '' ELSE replace(html, '<p>', '<p>again ') END END AS html
FROM {pages} CROSS JOIN (VALUES (0), (1), (2)) AS v(k)
"""

# the cards of one listing page per page, by place k; `kind` picks the variant
_KIND = "((page_id * 7 + k) % 8)"
_ID = "concat(CAST(page_id AS VARCHAR(20)), '-', CAST(k AS VARCHAR(20)))"
N_CARDS = "(6 + page_id % 3)"
LISTING_COLUMNS = {
    "href": f"""CASE WHEN page_id % 6 = 4 AND k > 0 THEN NULL WHEN {_KIND} = 6 THEN NULL
                WHEN {_KIND} IN (0, 7) THEN concat('/job/', {_ID})
                WHEN {_KIND} = 1 THEN 'https://dup.example/job/1'
                ELSE concat('https://x.example/job/', {_ID}) END""",
    # a second link that is never tried, as the first one is relative
    "other_href": f"""CASE WHEN {_KIND} = 7 AND NOT (page_id % 6 = 4 AND k > 0)
                THEN concat('https://x.example/vaga/', {_ID}) ELSE NULL END""",
    "datetime_attr": f"""CASE WHEN page_id % 6 = 5 OR {_KIND} = 2 THEN '2024-01-10'
                WHEN {_KIND} IN (1, 3) THEN '2024-01-14T12:00:00Z' WHEN {_KIND} = 5 THEN 'bad' ELSE NULL END""",
    "time_text": f"""CASE WHEN {_KIND} = 5 THEN '2 weeks ago' WHEN page_id % 6 = 5 OR {_KIND} IN (1, 2, 3, 7)
                THEN '1 day ago' ELSE NULL END""",
    "label": "concat('Card ', CAST(k AS VARCHAR(20)))",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture's rows in Spark."""
    names = [n for n in ("pages", "events", "part", "documents") if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (fixture(spark, sf_dir, ITEMS)
            .withColumn("requisitos", F.split("skills", " ")).drop("skills"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): the pages with listing cards at the top of their bodies.  Their own list items are cards, too."""
    c = LISTING_COLUMNS
    card = f"""concat('<li class="job-search-card">',
        coalesce(concat('<a class="base-card__full-link" href="', {c['href']}, '"> ', {c['label']}, '</a>'), ''),
        coalesce(concat('<a href="', {c['other_href']}, '">more</a>'), ''),
        coalesce(concat('<time', coalesce(concat(' datetime="', {c['datetime_attr']}, '"'), ''), '> ',
                        {c['time_text']}, '</time>'), ''),
        '<p>at <b>', url, '</b></p></li>')"""
    listing = f"""concat('<body><header><b>top</b></header><ul>',
        array_join(transform(sequence(0L, {N_CARDS} - 1), k -> {card}), ''), '</ul>')"""
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"replace(html, '<body>', {listing}) AS html")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, response): replies of five records in ten variants."""
    return (table(spark, sf_dir, "part")
            .selectExpr("p_partkey div 5 AS batch_id", f"struct(p_partkey, {RECORD_JSON} AS json) AS entry")
            .groupBy("batch_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["json"]), ", ").alias("list"))
            .selectExpr("batch_id", f"{RESPONSE_JSON} AS response"))


def hardware_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, response): one hardware record per reply, in nine variants."""
    head = """concat('{"produto": "', p_name, '", "marca": "', p_brand, '"'"""
    price = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING)"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS batch_id", f"""CASE p_partkey % 9
        WHEN 0 THEN concat('{{"produtos": [', {head}, ', "preco_vista": ', {price}, ', "preco_parcelado": ', {price},
                           ', "loja": "L", "em_estoque": true}}]}}'))
        WHEN 1 THEN '{{"produtos": [{{}}]}}'
        WHEN 2 THEN concat('{{"produtos": [', {head}, ', "preco_parcelado": null}}]}}'))
        WHEN 3 THEN concat('{{"produtos": [', {head}, ', "preco_vista": null}}]}}'))
        WHEN 4 THEN concat('{{"produtos": [', {head}, ', "preco_vista": "', {price}, '"}}]}}'))
        WHEN 5 THEN concat('{{"produtos": [', {head}, ', "preco_vista": "R$ 1"}}]}}'))
        WHEN 6 THEN concat('{{"produtos": [', {head}, ', "em_estoque": "yes"}}]}}'))
        WHEN 7 THEN concat('{{"produtos": [', {head}, ', "em_estoque": 2}}]}}'))
        ELSE '{{}}' END AS response""")


def title_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_no, body): the remote title list page by page, 50 nodes each; three quarters on, a page is broken off."""
    content = """CASE WHEN p_partkey % 17 = 0 THEN NULL
        ELSE named_struct('content', CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE named_struct('title', title) END) END"""
    pages = (fixture(spark, sf_dir, TITLES)
             .selectExpr("p_partkey div 50 AS page_no", f"{content} AS node")
             .groupBy("page_no").agg(F.collect_list(F.struct("node")).alias("nodes")))
    last = fixture(spark, sf_dir, TITLES).agg(F.expr("max(p_partkey) div 50"))
    broken = fixture(spark, sf_dir, TITLES).agg(F.expr(FAILING_PAGE))
    body = F.to_json(F.struct(F.transform("nodes", lambda n: n["node"]).alias("nodes"), F.when(
        F.col("page_no") < last.scalar(), F.col("page_no") + 1).alias("next_page")), {"ignoreNullFields": "false"})
    return pages.select("page_no", F.when(F.col("page_no") == broken.scalar(), F.left(body, F.lit(30))).otherwise(body).alias("body"))


def job_site(spark: SparkSession, sf_dir: str, links: int = 7) -> tuple[DataFrame, DataFrame]:
    """(urls, pages) of a whole run: for each page a listing that links to the pages from it on.

    The fourth link of every listing is stale there, but not in other listings.
    """
    pages = table(spark, sf_dir, "pages")
    total = pages.agg(F.count(F.lit(1)))
    targets = (pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(links - 1))).alias("k"))
               .withColumn("target", (F.col("page_id") + F.col("k")) % total.scalar()))
    cards = (targets.join(pages.select(F.col("page_id").alias("target"), "url"), "target")
             .selectExpr("page_id", """struct(k, concat('<div class="base-search-card"><a class="base-card__full-link" href="',
                 replace(url, '&', '&amp;'), '">vaga</a><time datetime="',
                 CASE WHEN k = 3 THEN '2024-01-10' ELSE '2024-01-15T08:00:00' END, '">x</time></div>') AS html) AS card""")
             .groupBy("page_id").agg(F.array_sort(F.collect_list("card")).alias("cards")))
    listings = cards.select(
        (-1 - F.col("page_id")).alias("page_id"),
        F.concat(F.lit("https://list.example/vagas/"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit("<html><body>"), F.array_join(F.transform("cards", lambda c: c["html"]), ""),
                 F.lit("</body></html>")).alias("html"))
    urls = listings.select((-1 - F.col("page_id")).alias("line_no"), "url")
    return urls, pages.unionByName(listings)


def echo_extractor(system: str, text: str) -> str:
    """Stands in for a model: of each advert its first line, the host of its URL, and a digest of all its lines."""
    import hashlib
    import json
    import re
    found = []
    for advert in text.split("=== NOVA VAGA ==="):
        url, lines = "", [line for line in advert.strip().split("\n") if line]
        if lines and lines[0].startswith("URL: "):
            url, lines = lines[0][5:], lines[1:]
        if lines:
            host = re.search("//([^/?#]*)", url)
            found.append({"titulo": lines[0], "empresa": host.group(1) if host else "self", "localizacao": "",
                          "origem": "unknown", "salario": hashlib.md5("\n".join(lines).encode()).hexdigest(),
                          "requisitos": None, "link_inscricao": url})
    return json.dumps({"vagas": found})
