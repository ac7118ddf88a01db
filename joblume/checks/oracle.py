"""The registered queries in DuckDB SQL, written from the rules, on the same tables."""

from __future__ import annotations

from joblume.checks import fixtures as fx

NAMES = {name: name for name in ("pages", "events", "part", "documents")}
URLS, TIMES, CARDS, ITEMS, TITLES, STORED, SNAPSHOTS, ROUTED = (sql.format(**NAMES) for sql in (
    fx.URLS, fx.TIMES, fx.CARDS, fx.ITEMS, fx.TITLES, fx.STORED, fx.SNAPSHOTS, fx.ROUTED))
NOW = f"TIMESTAMP '{fx.NOW}'"
# Fixed values, written out here so that the SQL does not borrow what it checks.
_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
          "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_BREAKS = "[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85\u2028\u2029]+"
_PROMPT = (
    "Você é um extrator de dados estruturados especialista. Extraia as informações detalhadas do texto, prestando "
    "MUITA ATENÇÃO a Salário e Requisitos. O texto pode conter múltiplas vagas separadas por '=== NOVA VAGA ==='. "
    "Extraia os detalhes de CADA UMA.")


def _strip(x):
    return f"trim({x}, '{_SPACE}')"


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _lines(x):
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{_BREAKS}'), lambda l: {_strip('l')}), lambda l: l <> '')"


def _compact(x):
    return f"array_to_string({_lines(x)}, chr(10))"


# text of a piece of HTML: removed elements, line breaks at blocks, no tags, entities last
_REMOVED = ["script", "style", "svg", "noscript", "header", "footer", "nav", "iframe", "button", "aside", "form"]


def _html_text(x):
    x = f"regexp_replace({x}, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g')"
    for tag in _REMOVED:
        x = f"regexp_replace({x}, '(?s)<{tag}[ >].*?</{tag}>', '', 'g')"
    x = f"regexp_replace({x}, '</?(p|h1|h2|h3|br|div|li|ul|ol|table|tr|td|th|title|head|body|html|article)( [^>]*)?/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    # old entities are read without their semicolon, too
    for entity, char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "''"), ("&#x27;?", "''"),
                         ("&nbsp;?", " "), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{entity}', '{char}', 'g')"
    return x


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"


def _clean(x):
    return f"left({_compact(_html_text(x))}, 18000)"


def _moment():
    return """CASE WHEN regexp_matches(datetime_attr, '^\\d{4}-\\d{2}-\\d{2}')
        THEN try_cast(regexp_replace(datetime_attr, '(Z|[+-]\\d\\d:\\d\\d)$', '') AS TIMESTAMP) END"""


_STALE_TEXT = """(regexp_matches(lower(coalesce(time_text, '')), '(^|[^\\p{L}\\p{N}_])(week|month|year|semana|mês|mes|ano)s?($|[^\\p{L}\\p{N}_])')
    OR regexp_matches(lower(coalesce(time_text, '')), '(^|[^\\p{L}\\p{N}_])([2-9]|[1-9]\\d+)\\s+(day|dia)s?($|[^\\p{L}\\p{N}_])'))"""


def _fresh(has_time="true"):
    return f"""(CASE WHEN NOT ({has_time}) THEN true
        WHEN ({_moment()}) IS NOT NULL THEN ({_moment()}) >= {NOW} - INTERVAL 36 HOUR
        ELSE NOT {_STALE_TEXT} END)"""


def _site(url):
    host = f"replace(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"
    label = f"split_part({host}, '.', 1)"
    return f"(upper(left({label}, 1)) || lower(substr({label}, 2)))"


_KEY = "(lower(titulo) || '|' || lower(empresa))"
_LINK = """(CASE WHEN contains(link_inscricao, 'http') THEN link_inscricao
    ELSE lower(regexp_extract(source_url, '^([A-Za-z]+)://', 1)) || '://'
      || regexp_extract(source_url, '^[A-Za-z]+://([^/?#]*)', 1)
      || CASE WHEN starts_with(link_inscricao, '/') THEN '' ELSE '/' END || link_inscricao END)"""
_ORIGIN = f"""(CASE WHEN origem = '' OR lower(origem) IN ('desconhecida', 'unknown')
    THEN {_site('source_url')} ELSE origem END)"""
_KNOWN = f"""SELECT DISTINCT {_strip('lower(title)')} AS title FROM ({TITLES}) WHERE title IS NOT NULL AND title <> ''"""
_SEARCH = _strip("lower(titulo || ' @ ' || empresa)")

FRESH_LINKS = f"""
fx_cards AS ({CARDS}),
links AS (SELECT listing_id, min(pos) AS pos, href FROM fx_cards
          WHERE contains(href, 'http') AND {_fresh()} GROUP BY listing_id, href),
numbered AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY pos) - 1 AS link_no FROM links)
"""

FINAL = f"""
fx_items AS ({ITEMS}),
keyed AS (SELECT *, {_KEY} AS item_key FROM fx_items),
firsts AS (SELECT k.* FROM keyed k JOIN (SELECT item_key, min(pos) AS pos FROM keyed GROUP BY item_key) f
           ON f.item_key = k.item_key AND f.pos = k.pos),
final AS (SELECT pos, item_key, titulo, empresa, localizacao, {_ORIGIN} AS origem, salario, skills,
                 {_LINK} AS link_inscricao, source_url
          FROM firsts WHERE {_strip('titulo')} <> '' AND {_strip('empresa')} <> ''),
searched AS (SELECT *, {_SEARCH} AS search, {_strip("lower('[' || origem || '] ' || titulo || ' @ ' || empresa)")} AS full_title
             FROM final)
"""
_NOT_KNOWN = f"NOT EXISTS (SELECT 1 FROM ({_KNOWN}) t WHERE contains(t.title, i.search))"

_COLS = fx.LISTING_COLUMNS
LISTING = f"""
placed AS (SELECT page_id, url, unnest(range({fx.N_CARDS})) AS k FROM pages),
cards AS (SELECT page_id AS listing_id, k AS pos, url, {_COLS['href']} AS href, {_COLS['other_href']} AS other_href,
                 {_COLS['datetime_attr']} AS datetime_attr, {_COLS['time_text']} AS time_text, {_COLS['label']} AS label
          FROM placed),
own_items AS (SELECT page_id AS listing_id, {fx.N_CARDS} + unnest(range(len(regexp_extract_all(html, '<li[ >]')))) AS pos FROM pages),
fresh AS (SELECT listing_id, min(pos) AS pos, href FROM cards
          WHERE contains(href, 'http') AND {_fresh('time_text IS NOT NULL')} GROUP BY listing_id, href),
anchors AS (SELECT listing_id, pos * 2 AS pos, href FROM cards WHERE contains(href, 'http')
            UNION ALL SELECT listing_id, pos * 2 + 1, other_href FROM cards WHERE contains(other_href, 'http')),
chosen AS (SELECT * FROM fresh
           UNION ALL SELECT listing_id, min(pos), href FROM anchors
           WHERE listing_id NOT IN (SELECT listing_id FROM fresh) GROUP BY listing_id, href),
page_links AS (SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY pos) - 1 AS pos, href FROM chosen)
"""

# replies: of ten kinds of batches five are good and one of those is empty
_KIND = "((p_partkey // 5) % 10)"
_GOOD = "(0, 1, 2, 7)"
_SKILLS = f"""CASE WHEN {_KIND} = 1 THEN '' WHEN {_KIND} = 2 THEN p_type ELSE p_type || ', x' END"""
REPLIES = f"""
batches AS (SELECT p_partkey // 5 AS batch_id, count(*) AS n FROM part GROUP BY 1),
judged AS (SELECT batch_id, batch_id % 10 AS kind, n, batch_id % 10 IN (0, 1, 2, 7, 8) AS valid,
                  CASE WHEN batch_id % 10 IN {_GOOD} THEN n ELSE 0 END AS n_records FROM batches),
records AS (SELECT p_partkey // 5 AS batch_id, row_number() OVER (PARTITION BY p_partkey // 5 ORDER BY p_partkey) - 1 AS pos,
                   p_name AS titulo, p_brand AS empresa, CAST(p_size AS VARCHAR) AS salario, {_SKILLS} AS requisitos,
                   '/apply/' || p_partkey AS link_inscricao
            FROM part WHERE {_KIND} IN {_GOOD})
"""
_HW = "(p_partkey % 9)"
_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE)"
HARDWARE = f"""
hardware AS (SELECT p_partkey AS batch_id, {_HW} AS kind, {_HW} IN (0, 1, 2, 4, 6, 8) AS valid,
    CASE WHEN {_HW} IN (3, 5, 7, 8) THEN NULL WHEN {_HW} = 1 THEN 'Não informado' ELSE p_name END AS produto,
    CASE WHEN {_HW} IN (3, 5, 7, 8) THEN NULL WHEN {_HW} = 1 THEN 'Desconhecida' ELSE p_brand END AS marca,
    CASE WHEN {_HW} IN (3, 5, 7, 8) THEN NULL WHEN {_HW} IN (0, 4) THEN {_PRICE} ELSE 0.0 END AS preco_vista,
    CASE WHEN {_HW} IN (3, 5, 7, 8) THEN NULL WHEN {_HW} = 0 THEN {_PRICE} ELSE 0.0 END AS preco_parcelado,
    CASE WHEN {_HW} IN (3, 5, 7, 8) THEN NULL WHEN {_HW} = 0 THEN 'L' ELSE 'Loja não identificada' END AS loja,
    CASE WHEN {_HW} IN (3, 5, 7, 8) THEN NULL ELSE {_HW} IN (0, 6) END AS em_estoque FROM part)
"""

_NOTE_PATH = """('jobs_' || replace(trim(regexp_replace(titulo, '[^\\p{L}\\p{N} _]', '', 'g')), ' ', '_')
    || '_20240115_120000_000000_' || pos || '.md')"""
_NOTE = """('---' || chr(10) || 'titulo: ' || titulo || chr(10) || 'empresa: ' || empresa || chr(10) || 'localizacao: ' || localizacao
    || chr(10) || 'origem: ' || origem || chr(10) || 'salario: ' || salario || chr(10) || 'link_inscricao: ' || link_inscricao
    || chr(10) || 'extraido_em: 2024-01-15T12:00:00' || chr(10) || 'nicho: jobs' || chr(10) || '---' || chr(10) || chr(10)
    || '# ' || titulo || ' @ ' || empresa)"""
_TITLE = "('[' || origem || '] ' || titulo || ' @ ' || empresa)"
_BODY = "('Empresa: ' || empresa || chr(10) || 'Local: ' || localizacao || chr(10) || 'Link: ' || link_inscricao)"
_LIST_URLS = f"(SELECT line_no, {_strip('value')} AS url FROM ({URLS}) WHERE NOT starts_with(value, '#') AND {_strip('value')} <> '')"
_LATEST = f"(SELECT * FROM ({SNAPSHOTS}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)"
_FIRST_LINE = f"split_part({_clean(_ARTICLE)}, chr(10), 1)"
_HOST = "regexp_extract(url, '//([^/?#]*)', 1)"


def oracle_sql() -> dict[str, str]:
    return {
        "url_list_scan": f"SELECT line_no, url FROM {_LIST_URLS}",
        "page_snapshot_lookup": f"""SELECT u.line_no, u.url, p.page_id, length(p.html) AS n_chars, md5(p.html) AS digest
            FROM {_LIST_URLS} u LEFT JOIN ({_LATEST}) p ON p.url = u.url""",
        "missing_pages": f"""SELECT line_no, url FROM {_LIST_URLS} u
            WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = u.url AND html <> '')""",
        "url_first_lines": f"SELECT url, min(line_no) AS url_no, count(*) AS n_lines FROM {_LIST_URLS} GROUP BY url",
        "existing_titles_scan": f"""SELECT DISTINCT {_strip('lower(title)')} AS title FROM ({TITLES})
            WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AND title IS NOT NULL AND title <> ''
              AND p_partkey // 50 < (SELECT {fx.FAILING_PAGE} FROM part)""",
        "response_scan": f"""SELECT batch_id, {fx.RESPONSE_JSON} AS response FROM (
            SELECT p_partkey // 5 AS batch_id, string_agg({fx.RECORD_JSON}, ', ' ORDER BY p_partkey) AS list FROM part GROUP BY 1)""",
        "empty_content_filter": "SELECT page_id FROM pages WHERE html IS NOT NULL AND html <> ''",
        "recency_absolute": f"""SELECT event_id, ({_moment()}) IS NOT NULL AS readable,
            ({_moment()}) >= {NOW} - INTERVAL 36 HOUR AS fresh FROM ({TIMES})""",
        "recency_relative": f"SELECT event_id, NOT {_STALE_TEXT} AS fresh FROM ({TIMES})",
        "recency_filter": f"SELECT event_id FROM ({TIMES}) WHERE {_fresh()}",
        "absolute_link_filter": f"SELECT listing_id, pos, href FROM ({CARDS}) WHERE contains(href, 'http')",
        "required_fields_filter": f"""SELECT pos, titulo, empresa FROM ({ITEMS})
            WHERE {_strip('titulo')} <> '' AND {_strip('empresa')} <> ''""",
        "empty_result_guard": f"WITH {REPLIES} SELECT batch_id, n_records FROM judged WHERE n_records > 0",
        "text_route": f"""SELECT 'page' AS kind, page_id AS id,
              contains(html, '=== NOVA VAGA ===') OR NOT starts_with({_strip('html')}, '<') AS ready,
              CASE WHEN contains(html, '=== NOVA VAGA ===') OR NOT starts_with({_strip('html')}, '<') THEN html
                   ELSE {_clean(_ARTICLE)} END AS text FROM pages
            UNION ALL SELECT 'document', doc_id,
              contains(text, '=== NOVA VAGA ===') OR NOT starts_with({_strip('text')}, '<'),
              CASE WHEN contains(text, '=== NOVA VAGA ===') OR NOT starts_with({_strip('text')}, '<') THEN text
                   ELSE {_clean('text')} END
            FROM ({ROUTED})""",
        "card_explode": f"""WITH {LISTING} SELECT listing_id, pos, href FROM cards
            UNION ALL SELECT listing_id, pos, NULL FROM own_items""",
        "card_link_select": f"WITH {LISTING} SELECT listing_id, pos, href FROM cards WHERE contains(href, 'http')",
        "card_time_select": f"""WITH {LISTING} SELECT listing_id, pos, time_text IS NOT NULL AS has_time,
            CASE WHEN time_text IS NOT NULL THEN datetime_attr END AS datetime_attr, time_text FROM cards
            UNION ALL SELECT listing_id, pos, false, NULL, NULL FROM own_items""",
        "link_fallback": f"WITH {LISTING} SELECT listing_id, pos, href FROM page_links",
        "boilerplate_prune": f"SELECT page_id, {_clean('html')} AS clean_text FROM pages",
        "main_content_select": """SELECT page_id, CASE WHEN contains(html, '<main') THEN 'main'
            WHEN contains(html, '<article') THEN 'article' END AS main_selector FROM pages""",
        "card_text_project": f"""WITH {LISTING} SELECT listing_id, left(string_agg(
              CASE WHEN href IS NOT NULL THEN label || ' ' ELSE '' END || CASE WHEN other_href IS NOT NULL THEN 'more ' ELSE '' END
              || coalesce(time_text || ' ', '') || 'at ' || url, chr(10) || '---' || chr(10) ORDER BY pos), 18000) AS clean_text
            FROM cards GROUP BY listing_id""",
        "markdown_render": f"""SELECT page_id, left(array_to_string(flatten(list_transform(
              string_split(replace(replace({_ARTICLE}, '*', chr(92) || '*'), '_', chr(92) || '_'), '<p>'), lambda p: CASE
              WHEN starts_with(p, '<h1>') THEN ['# ' || array_to_string(regexp_extract_all({_html_text('p')}, '\\S+'), ' ')]
              WHEN starts_with(p, '<b>') THEN list_transform({_lines(_html_text('p'))}, lambda b: '**' || b || '**')
              ELSE {_lines(_html_text('p'))} END)), chr(10)), 18000) AS clean_text FROM pages""",
        "line_compact": f"SELECT doc_id, {_compact('text')} AS compact FROM documents",
        "text_truncate": """SELECT doc_id, substr(text, 1, 18000) AS configured, substr(text, 1, 12000) AS standard
            FROM documents""",
        "page_clean": f"SELECT page_id, {_clean(_ARTICLE)} AS clean_text FROM pages",
        "row_isolation": f"""SELECT page_id, kind, kind <> 'absent' AS ok,
            CASE WHEN kind <> 'absent' THEN length({_clean(_ARTICLE)}) END AS n_chars
            FROM pages, (VALUES ('good'), ('broken'), ('absent')) k(kind)""",
        "link_distinct": f"WITH {FRESH_LINKS} SELECT listing_id, pos, href FROM links",
        "listing_route": f"""WITH {LISTING} SELECT p.page_id AS listing_id, count(l.href) AS n_links,
            count(l.href) > 1 AS follows FROM pages p LEFT JOIN page_links l ON l.listing_id = p.page_id GROUP BY p.page_id""",
        "detail_join": f"""WITH {FRESH_LINKS} SELECT href, listing_id, pos, page_id FROM links JOIN pages ON url = href""",
        "missing_details": f"""WITH {FRESH_LINKS} SELECT href, listing_id, pos FROM links
            WHERE href NOT IN (SELECT url FROM pages)""",
        "item_key": f"SELECT pos, {_KEY} AS item_key FROM ({ITEMS})",
        "item_dedupe_first": f"WITH {FINAL} SELECT item_key, pos, titulo, empresa FROM firsts",
        "ticket_history_anti": f"WITH {FINAL} SELECT pos, titulo, empresa FROM searched i WHERE {_NOT_KNOWN}",
        "ticket_self_suppress": f"""WITH {FINAL} SELECT pos, titulo, empresa FROM searched i
            WHERE NOT EXISTS (SELECT 1 FROM searched j WHERE j.pos < i.pos AND contains(j.full_title, i.search))""",
        "cross_run_anti": f"""WITH {FINAL} SELECT item_key, pos FROM final
            WHERE item_key NOT IN (SELECT item_key FROM ({STORED}))""",
        "batch_assign": f"WITH {FRESH_LINKS} SELECT listing_id, pos, link_no, link_no // 5 AS batch_no FROM numbered",
        "batch_text": f"""WITH {FRESH_LINKS},
            texts AS (SELECT n.listing_id, n.link_no // 5 AS batch_no, n.pos, n.href, {_clean(_ARTICLE)} AS clean_text
                      FROM numbered n LEFT JOIN ({_LATEST}) p ON p.url = n.href)
            SELECT listing_id, batch_no,
              coalesce(string_agg('URL: ' || href || chr(10) || clean_text,
                chr(10) || chr(10) || '=== NOVA VAGA ===' || chr(10) || chr(10) ORDER BY pos)
                FILTER (WHERE clean_text IS NOT NULL), '') AS batch_text,
              count(*) AS n_links, count(clean_text) AS n_texts FROM texts GROUP BY listing_id, batch_no""",
        "request_build": f"""SELECT doc_id, 'gemini-2.5-flash' AS model, 'system' AS first_role,
            {_quoted(_PROMPT)} AS system, 'user' AS second_role, text AS content,
            CAST(0.1 AS DOUBLE) AS temperature, CAST(4096 AS BIGINT) AS max_output_tokens FROM documents""",
        "run_counters": f"""WITH {FRESH_LINKS}, {REPLIES},
            listed AS (SELECT listing_id, link_no // 5 AS batch_no, count(*) AS n_links FROM numbered GROUP BY 1, 2),
            turns AS (SELECT *, row_number() OVER (ORDER BY listing_id, batch_no) - 1 AS turn, count(*) OVER () AS total FROM listed),
            answered AS (SELECT j.*, listing_id AS url_no, url, n_links FROM judged j
                         JOIN turns ON turn = batch_id % total JOIN pages ON page_id = listing_id),
            counted AS (SELECT url AS source_url, count(*) AS n_batches, CAST(sum(n_links) AS BIGINT) AS n_links,
                        CAST(sum(n_records) AS BIGINT) AS n_records, count(*) FILTER (WHERE kind = 8) AS n_empty,
                        CAST(0 AS BIGINT) AS n_failed, count(*) FILTER (WHERE NOT valid) AS n_invalid FROM answered GROUP BY url),
            keyed AS (SELECT r.*, a.url_no, {_KEY} AS item_key, {_site('a.url')} AS origem FROM records r
                      JOIN answered a ON a.batch_id = r.batch_id),
            firsts AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY url_no, batch_id, pos) AS place FROM keyed),
            numbered_firsts AS (SELECT *, row_number() OVER (ORDER BY url_no, batch_id, pos) AS at, {_SEARCH} AS search,
                        {_strip("lower('[' || origem || '] ' || titulo || ' @ ' || empresa)")} AS full_title
                        FROM firsts WHERE place = 1),
            unknown AS (SELECT * FROM numbered_firsts i WHERE {_NOT_KNOWN}),
            accepted AS (SELECT * FROM unknown i WHERE NOT EXISTS (
                        SELECT 1 FROM unknown j WHERE j.at < i.at AND contains(j.full_title, i.search))),
            run AS (SELECT (SELECT count(*) FROM keyed) AS n_records, (SELECT count(*) FROM numbered_firsts) AS n_items,
                        (SELECT count(*) FROM ({TITLES}) WHERE title <> '') AS n_known, (SELECT count(*) FROM accepted) AS n_sent)
            SELECT source_url, name, value FROM (UNPIVOT counted ON n_batches, n_links, n_records, n_empty, n_failed, n_invalid)
            UNION ALL SELECT NULL, v.name, v.value FROM run, LATERAL (VALUES ('n_records', n_records),
              ('n_repeats', n_records - n_items), ('n_stored', 0), ('n_blank', 0), ('n_items', n_items), ('n_known', n_known),
              ('n_suppressed', n_items - n_sent)) v(name, value)""",
        "response_parse": f"WITH {REPLIES} SELECT batch_id, valid, n_records FROM judged",
        "requisitos_normalise": f"""SELECT p_partkey // 5 AS batch_id, '/apply/' || p_partkey AS link, {_KIND} NOT IN (3, 4) AS valid,
            CASE WHEN {_KIND} NOT IN (3, 4) THEN {_SKILLS} END AS requisitos FROM part WHERE {_KIND} NOT IN (8, 9)""",
        "batch_quarantine": f"""WITH {REPLIES} SELECT batch_id, CASE WHEN kind = 9 THEN 'no JSON' ELSE 'invalid record' END AS reason
            FROM judged WHERE NOT valid""",
        "items_explode": f"WITH {REPLIES} SELECT batch_id, 'https://list.example/' AS source_url, pos, titulo, empresa, salario, requisitos, link_inscricao FROM records",
        "hardware_normalise": f"""WITH {HARDWARE} SELECT batch_id, valid, produto, marca, preco_vista, preco_parcelado, loja, em_estoque
            FROM hardware""",
        "hardware_explode": f"WITH {HARDWARE} SELECT batch_id, produto, preco_vista, em_estoque FROM hardware WHERE valid AND kind <> 8",
        "site_name": f"SELECT page_id, {_site('url')} AS site FROM pages",
        "link_repair": f"SELECT pos, {_LINK} AS link_inscricao FROM ({ITEMS})",
        "origin_fill": f"SELECT pos, {_ORIGIN} AS origem FROM ({ITEMS})",
        "item_finalize": f"WITH {FINAL} SELECT pos, item_key, titulo, empresa, origem, link_inscricao, source_url FROM final",
        "safe_name": f"""SELECT pos, replace(trim(regexp_replace(titulo || ' (é½/_) ' || empresa, '[^\\p{{L}}\\p{{N}} _]', '', 'g')), ' ', '_') AS safe
            FROM ({ITEMS})""",
        "note_filename": f"SELECT pos, {_NOTE_PATH} AS filename FROM ({ITEMS})",
        "note_render": f"WITH {FINAL} SELECT {_NOTE_PATH} AS path, {_NOTE} AS content FROM final",
        "ticket_fields": f"WITH {FINAL} SELECT pos, {_TITLE} AS title, search, {_BODY} AS body FROM searched",
        "requisitos_join": f"SELECT pos, replace(skills, ' ', ', ') AS requisitos FROM ({ITEMS})",
        "note_sink": f"WITH {FINAL} SELECT 'jobs' AS niche, {_NOTE_PATH} AS path, {_NOTE} AS content FROM final",
        "jobs_table_sink": f"""WITH {FINAL}, flat AS (SELECT pos, titulo, empresa,
              CASE WHEN pos % 41 <> 0 THEN localizacao END AS localizacao, origem, salario,
              replace(skills, ' ', ', ') AS requisitos, link_inscricao, '2024-01-15 12:00:00' AS extraido_em FROM final),
            judged AS (SELECT *, array_to_string(list_filter([CASE WHEN localizacao IS NULL THEN 'place' END,
              CASE WHEN salario IN ('13', '14') THEN 'pay' END], lambda x: x IS NOT NULL), ', ') AS reason FROM flat),
            good AS (SELECT *, row_number() OVER (ORDER BY pos) AS place, count(*) OVER () AS n FROM judged WHERE reason = '')
            SELECT place + n * run AS id, titulo, empresa, localizacao, origem, salario, requisitos, link_inscricao, extraido_em,
              NULL AS reason FROM good, (VALUES (0), (1)) runs(run)
            UNION ALL SELECT NULL, titulo, empresa, localizacao, origem, salario, requisitos, link_inscricao, extraido_em, reason
            FROM judged, (VALUES (0), (1)) runs(run) WHERE reason <> ''""",
        "ticket_outbox_sink": f"""WITH {FINAL}, unknown AS (SELECT * FROM searched i WHERE {_NOT_KNOWN})
            SELECT {_TITLE} AS title, {_BODY} AS body FROM unknown i
            WHERE NOT EXISTS (SELECT 1 FROM unknown j WHERE j.pos < i.pos AND contains(j.full_title, i.search))""",
        "output_reset": f"""WITH {FINAL} SELECT CAST(0 AS BIGINT) AS n_rows, 'notes' AS store
            UNION ALL SELECT count(*), 'jobs' FROM final""",
        "fan_out": f"""WITH {FINAL}, accepted AS (SELECT * FROM searched i
              WHERE NOT EXISTS (SELECT 1 FROM searched j WHERE j.pos < i.pos AND contains(j.full_title, i.search)))
            SELECT 'NoteTable' AS sink, true AS ok, count(*) AS n_rows FROM final
            UNION ALL SELECT 'JobsTable', true, count(*) FROM final
            UNION ALL SELECT 'TicketOutbox', true, count(*) FROM accepted
            UNION ALL SELECT 'BrokenSink', false, NULL""",
        "sink_protocol": f"WITH {FINAL} SELECT item_key || ' jobs' AS content, CAST(1 AS BIGINT) AS n_failed FROM final",
        "stream_page_dedupe": f"""WITH cleaned AS (SELECT page_id, url, {_clean(_ARTICLE)} AS clean, {_site('url')} AS empresa FROM pages),
            keyed AS (SELECT page_id, url, md5(clean) AS digest, length(clean) AS n_chars, left(clean, 1) AS titulo, empresa,
                      lower(left(clean, 1)) || '|' || lower(empresa) AS item_key FROM cleaned)
            SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY page_id) = 1""",
        "stream_recency": f"SELECT event_id FROM ({TIMES}) WHERE {_fresh()}",
        "stream_fan_out": f"""WITH {REPLIES}, ranked AS (SELECT *, {_KEY} AS item_key, '' AS localizacao, 'List' AS origem,
              row_number() OVER (PARTITION BY {_KEY} ORDER BY batch_id, pos) AS place,
              'https://list.example' || link_inscricao AS link FROM records),
            stored AS (SELECT * REPLACE ('Remoto' AS localizacao, link AS link_inscricao) FROM ranked
              WHERE place = 1 AND {_strip('titulo')} <> '' AND {_strip('empresa')} <> '')
            SELECT item_key, titulo, empresa, localizacao, origem, salario, requisitos, link_inscricao,
              '2024-01-15 12:00:00' AS extraido_em,
              replace({_NOTE_PATH}, '_' || pos || '.md', '_' || batch_id || '_' || pos || '.md') AS path, {_NOTE} AS content,
              true AS gapless, CAST(0 AS BIGINT) AS n_unsent FROM stored""",
        "schema_spec": f"""WITH {REPLIES}, {HARDWARE}
            SELECT count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_rejected, 'jobs' AS niche FROM judged
            UNION ALL SELECT count(*) FILTER (WHERE valid), count(*) FILTER (WHERE NOT valid), 'hardware' FROM hardware""",
        "extractor_seam": f"""SELECT page_id, {_FIRST_LINE} AS titulo, 'self' AS empresa, md5({_clean(_ARTICLE)}) AS digest,
            CAST(0 AS BIGINT) AS n_requisitos FROM pages""",
        "whole_run": f"""WITH latest AS (SELECT page_id, url, {_clean(_ARTICLE)} AS clean FROM pages
              QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1),
            targets AS (SELECT p.page_id AS url_no, k, (p.page_id + k) % (SELECT count(*) FROM pages) AS target
              FROM pages p, (VALUES (0), (1), (2), (4), (5), (6)) cards(k)),
            hrefs AS (SELECT url_no, min(k) AS k, url FROM targets JOIN pages ON page_id = target GROUP BY url_no, url),
            listed AS (SELECT url_no, url, row_number() OVER (PARTITION BY url_no ORDER BY k) - 1 AS link_no FROM hrefs),
            found AS (SELECT url_no, link_no // 5 AS batch_no,
                row_number() OVER (PARTITION BY url_no, link_no // 5 ORDER BY link_no) - 1 AS pos,
                'https://list.example/vagas/' || url_no AS source_url, split_part(clean, chr(10), 1) AS titulo, {_HOST} AS empresa,
                md5(clean) AS digest, url AS link_inscricao FROM listed JOIN latest USING (url) WHERE clean <> ''),
            keyed AS (SELECT *, {_KEY} AS item_key FROM found)
            SELECT url_no, batch_no, pos, source_url, item_key, titulo, empresa, '' AS localizacao, 'List' AS origem, digest,
              '' AS requisitos, link_inscricao FROM keyed
            QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY url_no, batch_no, pos) = 1""",
    }
