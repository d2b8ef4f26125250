"""Inputs of the checks, derived from the driver's tables by SQL that both engines run as it is.

Each may use driver tables and those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from datatrawl.sources.tables import read_table

DRIVER_TABLES = {"pages": "page_id", "documents": "doc_id", "benchmark": None,
                 "events": "event_id", "supplier": None}

FIXTURES: dict[str, str] = {}

FIXTURES["pages_gis"] = """
SELECT page_id, url,
  html || '<div class="rec"><h1>Data set ' || CAST(page_id AS STRING) || '</h1><ul><li>'
  || CASE page_id % 6
       WHEN 0 THEN '<a href="/data/d' || CAST(page_id AS STRING) || '.zip">Download</a>'
       WHEN 1 THEN '<a href="https://files.example.org/d' || CAST(page_id AS STRING) || '.CSV">Download</a>'
       WHEN 2 THEN '<a href="d' || CAST(page_id AS STRING) || '.tar.gz?session=1">Download</a>'
       WHEN 3 THEN '<a href="foo:d' || CAST(page_id AS STRING) || '.zip">Download</a>'
       WHEN 4 THEN '<a href="../d' || CAST(page_id AS STRING) || '.kml">Download</a><a href="/data/common.zip">All</a>'
       ELSE '<a href="/about">About</a>' END
  || '</li><li><a href="'
  || CASE WHEN page_id % 2 = 0 THEN '/meta/d' ELSE 'https://meta.example.org/d' END
  || CAST(page_id AS STRING) || '.xml">Metadata</a></li></ul></div>' AS html
FROM pages
"""

# Organizations in the title of some pages and in a sentence of all.
FIXTURES["pages_org"] = """
SELECT page_id, url,
  replace(html, '<title>', CASE WHEN page_id % 3 = 0 THEN '<title>Ohio State University: '
                                ELSE '<title>' END)
  || '<p>Maps created by Acme Data Inc. for <b>all</b> of us.</p>' AS html
FROM pages_gis
"""

# Links from each page to itself and to five later ones; few of them are on the same site.
FIXTURES["pages_linked"] = """
SELECT p.page_id, p.url,
  p.html || '<p><a href="' || p.url || '">Self</a><a href="' || coalesce(a.url, '/none')
  || '">1</a><a href="' || coalesce(b.url, '/none') || '">2</a><a href="' || coalesce(c.url, '/none')
  || '">3</a><a href="' || coalesce(d.url, '/none') || '">4</a><a href="' || coalesce(e.url, '/none')
  || '">5</a></p>' AS html
FROM pages p
LEFT JOIN pages a ON a.page_id = p.page_id + 1
LEFT JOIN pages b ON b.page_id = p.page_id + 2
LEFT JOIN pages c ON c.page_id = p.page_id + 3
LEFT JOIN pages d ON d.page_id = p.page_id + 4
LEFT JOIN pages e ON e.page_id = p.page_id + 5
"""

FIXTURES["probes"] = """
SELECT url, CAST(CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 301 END AS INT) AS http_code,
  'text/html' AS content_type,
  CASE WHEN page_id % 4 = 3 THEN 'timeout' END AS error
FROM pages
"""

FIXTURES["link_probes"] = """
SELECT regexp_replace(regexp_replace(url, '/[^/]*$', ''), '/[^/]*$', '') || '/d' || CAST(page_id AS STRING) || '.tar.gz?session=1' AS url,
  CASE WHEN page_id % 4 = 0 THEN 'application/x-gzip' ELSE 'application/x-gzip; charset=binary' END AS content_type
FROM pages WHERE page_id % 6 = 2
UNION ALL
SELECT CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/meta/d' ELSE 'https://meta.example.org/d' END
  || CAST(page_id AS STRING) || '.xml' AS url,
  CASE WHEN page_id % 5 = 0 THEN 'text/html' ELSE 'text/xml' END AS content_type
FROM pages
"""

FIXTURES["url_status"] = """
SELECT CAST(page_id AS INT) AS id, url, CAST(NULL AS STRING) AS parent_url, CAST(page_id % 6 AS INT) AS status,
  CASE WHEN page_id % 2 = 0 THEN 'MANUAL_ENTRY' ELSE 'SOCIAL_MEDIA' END AS source
FROM pages
"""

# What is stored already when a batch begins.
FIXTURES["stored_urls"] = "SELECT * FROM url_status WHERE id % 5 = 3"

FIXTURES["known_links"] = """
SELECT CAST(page_id * 2 + 5 AS INT) AS id, 'https://files.example.org/d' || CAST(page_id AS STRING) || '.CSV' AS url,
  CAST(NULL AS STRING) AS metadata_file
FROM pages WHERE page_id % 3 = 1
"""

# Collector URLs (some twice), sub-pages, and URLs without a page.
FIXTURES["frontier"] = """
SELECT CAST(NULL AS STRING) AS parent_url, url,
  CASE WHEN page_id % 2 = 0 THEN 'MANUAL_ENTRY' ELSE 'SOCIAL_MEDIA' END AS source, TRUE AS from_queue
FROM pages WHERE page_id % 4 <> 3
UNION ALL
SELECT 'http://parent.example.org/' AS parent_url, url, 'MANUAL_ENTRY' AS source, FALSE AS from_queue
FROM pages WHERE page_id % 4 >= 2
UNION ALL
SELECT CAST(NULL AS STRING) AS parent_url, 'http://gone.example.org/' || CAST(page_id AS STRING) AS url,
  'MANUAL_ENTRY' AS source, TRUE AS from_queue
FROM pages WHERE page_id % 9 = 0
"""

FIXTURES["seed_lines"] = """
SELECT CASE page_id % 8 WHEN 1 THEN '' WHEN 3 THEN 'no url at all' WHEN 5 THEN '/only/a/path'
  WHEN 6 THEN 'gopher://old.example.org/' || CAST(page_id AS STRING) ELSE url END AS value
FROM pages
"""

# One of many shapes of link for each page.
FIXTURES["hrefs"] = """
SELECT p.page_id, p.url, s.href
FROM pages p JOIN (VALUES (0, 'x.zip'), (1, '/top/x.zip'), (2, '../up/x.kml'), (3, './x'), (4, '//cdn.example.org/a/../x'),
  (5, 'http://Other.example.org/a/./b/../c?q=../1#f'), (6, 'foo:x.zip'), (7, '#part'), (8, 'a/b/../../../../x'),
  (9, 'HTTPS://UP.example.org/x'), (10, 'mailto:a@example.org'), (11, 'ftp://f.example.org:21/x.zip'),
  (12, 'x/y/'), (13, '/../x?u=http://h/p')) AS s(shape, href) ON s.shape = p.page_id % 14
"""

FIXTURES["search_payload"] = """
SELECT a.event_id AS response_id, a.event_type AS term,
  '{"statuses":[{"id_str":"' || CAST(a.event_id + 1000 AS STRING) || '","entities":{"urls":[{"expanded_url":"http://sho.rt/' || CAST(a.user_id AS STRING)
  || '"},{"expanded_url":"http://long.example.org/e/' || CAST(a.event_id % 50 AS STRING) || '"}]}},{"id_str":"' || CAST(b.event_id + 1000 AS STRING)
  || '","entities":{"urls":[]}}],"search_metadata":{"max_id_str":"' || CAST(b.event_id + 1000 AS STRING) || '","count":' || CAST(a.event_id % 12 AS STRING) || '}}' AS payload
FROM events a JOIN events b ON b.event_id = a.event_id + 1
WHERE a.event_id % 2 = 0
"""

FIXTURES["legacy_payload"] = """
SELECT event_id AS response_id,
  '{"results":[{"entities":{"urls":[{"expanded_url":"http://sho.rt/' || CAST(user_id AS STRING)
  || '"},{"expanded_url":""}]}},{"entities":{"urls":[]}}]}' AS payload
FROM events
"""

FIXTURES["redirects"] = """
SELECT DISTINCT 'http://sho.rt/' || CAST(user_id AS STRING) AS url,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'http://long.example.org/u/' || CAST(user_id AS STRING) END AS location
FROM events
"""

FIXTURES["metadata_docs"] = """
SELECT 'https://meta.example.org/d' || CAST(s_suppkey AS STRING) || '.xml' AS url,
  '<metadata><idinfo><bounding><westbc>' || CAST(s_suppkey % 200 - 190 AS STRING) || '</westbc><eastbc> '
  || CAST(s_suppkey % 90 AS STRING) || '.5 </eastbc><NorthBC>' || CAST(s_suppkey % 60 AS STRING) || '</NorthBC><southbc>'
  || CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(s_suppkey % 30 AS STRING) END
  || '</southbc></bounding></idinfo></metadata>' AS xml
FROM supplier
"""

# Values in wrappers, on lines of their own, behind a comment and an empty element.
FIXTURES["metadata_nested"] = """
SELECT url, '<?xml version="1.0"?>' || chr(10) || xml AS xml FROM metadata_docs
UNION ALL
SELECT 'https://meta.example.org/w' || CAST(s_suppkey AS STRING) || '.xml' AS url,
  '<gmd:box><!-- box --><gmd:westBound><gco:Decimal>' || CAST(s_suppkey % 180 AS STRING) || '</gco:Decimal></gmd:westBound>'
  || chr(10) || ' <gmd:eastBound><gco:Decimal>' || CAST(s_suppkey % 170 AS STRING) || '.25</gco:Decimal></gmd:eastBound>'
  || '<gmd:southBound> <gco:Decimal>1e1</gco:Decimal> </gmd:southBound><gmd:northBound><gco:Decimal>'
  || CASE WHEN s_suppkey % 3 = 0 THEN '0x1F' ELSE '-12.f' END || '</gco:Decimal><gco:nil/></gmd:northBound></gmd:box>' AS xml
FROM supplier
"""

FIXTURES["org_gazetteer"] = """
SELECT DISTINCT split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS phrase, 'organization' AS major_type
FROM benchmark
UNION ALL
SELECT 'blue river' AS phrase, 'organization' AS major_type
"""

FIXTURES["gazetteer"] = """
SELECT phrase, major_type FROM org_gazetteer
UNION ALL
SELECT DISTINCT split_part(text, ' ', 3) AS phrase, 'GISformat' AS major_type FROM benchmark
"""

FIXTURES["lemmas"] = """
SELECT * FROM (VALUES ('create','create'),('created','create'),('creates','create'),('publish','publish'),
 ('published','publish'),('the','create'),('distribution','distribution'),('produced','produce'),('provides','provide')) AS t(form, root)
"""

# Documents with a sentence on organizations behind them.
FIXTURES["org_docs"] = """
SELECT doc_id, text || ' Maps were ' || CASE WHEN doc_id % 2 = 0 THEN 'created' ELSE 'drawn' END || ' by '
  || CASE doc_id % 5 WHEN 3 THEN 'eBay Inc, iPhone Maker Ltd and X-Ray Labs Inc''s heirs' WHEN 4
     THEN 'One Two Three Four Five Six Seven University Ltd Friends' ELSE
     CASE doc_id % 3 WHEN 0 THEN 'Ohio State University' WHEN 1 THEN 'Acme Data Inc, formerly ACME Data Ltd' ELSE 'the council' END END
  || ' for all. Thanks. Dr. A. B. Smith of the ' || CASE doc_id % 7 WHEN 0 THEN 'Institute of Maps and Data' WHEN 1 THEN 'Smith & Jones Inc'
     WHEN 2 THEN 'Department of Ohio State University' WHEN 3 THEN 'Ministry for the Sea''s board' WHEN 4 THEN 'blue river Data Institute'
     WHEN 5 THEN 'Land and Water Council of Acme Data Inc and Rio Bank' ELSE 'Society' END
  || ' is ' || CASE WHEN doc_id % 3 = 0 THEN 'creating' ELSE 'mapping' END || ' 3.5 maps, e.g. of roads.' AS text
FROM documents
"""

# Documents that name one organization in several ways.
FIXTURES["alias_gazetteer"] = """
SELECT phrase, major_type FROM org_gazetteer
UNION ALL
SELECT phrase, 'organization' AS major_type
FROM (VALUES ('OSU'), ('osu'), ('IMD'), ('Ohio State'), ('Maps and Data')) AS t(phrase)
"""

FIXTURES["alias_docs"] = """
SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' By staff of Ohio State University, of OSU, of Ohio State, of Ohio State University Press Council.'
  WHEN 1 THEN ' See the Institute of Maps and Data Inc; Institute for Maps & Data; IMD, Maps and Data.'
  WHEN 2 THEN ' From Open Street Union Inc, Ohio State University or OSU.'
  WHEN 3 THEN ' From Ohio State Council, Ohio State University, Ohio State; osu.' ELSE '' END AS text
FROM org_docs
"""


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived one."""
    for table, key in DRIVER_TABLES.items():
        if name == table or any(table in FIXTURES[n] for n in needed(name)):
            read_table(spark, f"{sf_dir}/{table}.parquet", key).createOrReplaceTempView(table)
    if name in DRIVER_TABLES:
        return spark.table(name)
    for other in needed(name):
        spark.sql(FIXTURES[other]).createOrReplaceTempView(other)
    return spark.table(name)


def needed(*names: str) -> list[str]:
    """The fixtures that the named ones rest on, and they themselves, in order."""
    wanted = set(names)
    for other in reversed(FIXTURES):
        if other in wanted:
            wanted |= {n for n in FIXTURES if n != other and n in FIXTURES[other].split()}
    return [n for n in FIXTURES if n in wanted]


def with_fixtures(names: list[str], ctes: dict[str, str], query: str) -> str:
    """One SQL text: fixtures and steps as common tables, then the query."""
    parts = [f"{n} AS ({FIXTURES[n].strip()})" for n in needed(*names)]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in ctes.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query.strip()
