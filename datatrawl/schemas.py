"""Schemas of the tables that flow between operators."""

FRONTIER = "parent_url STRING, url STRING, source STRING, from_queue BOOLEAN"

SEARCH_PAYLOAD = (
    "statuses ARRAY<STRUCT<id_str: STRING,"
    " entities: STRUCT<urls: ARRAY<STRUCT<expanded_url: STRING>>>>>,"
    " search_metadata STRUCT<max_id_str: STRING, count: INT>, _bad STRING"
)

LEGACY_PAYLOAD = (
    "results ARRAY<STRUCT<entities: STRUCT<urls: ARRAY<STRUCT<expanded_url: STRING>>>>>,"
    " _bad STRING"
)

# `text` is filled on the root row only; the other rows point into it.
TREE_NODES = (
    "page_id BIGINT, node_id INT, parent_id INT, last_id INT, tag STRING,"
    " attrs MAP<STRING, STRING>, start INT, end INT, text STRING"
)

PAGES = "page_id BIGINT, url STRING, html STRING"

TAB_URL = (
    "id BIGINT, url STRING, parent_url STRING, status INT, source STRING, updated_at TIMESTAMP"
)
TAB_LINKS = "id BIGINT, url STRING, metadata_file STRING, updated_at TIMESTAMP"
TAB_URL_LINK_MAP = "url_id BIGINT, link_id BIGINT, updated_at TIMESTAMP"
TAB_SPATIALEXTENT = "id BIGINT, url_id BIGINT, extent STRING"
METADATA_FILES = "file_name STRING, line_no INT, line STRING"


def entity_table(value: str) -> str:
    return f"id BIGINT, url_id BIGINT, {value} STRING, updated_at TIMESTAMP"


CATALOGUE = {
    "tab_url": TAB_URL,
    "tab_abstract": entity_table("abstract"),
    "tab_format": entity_table("format"),
    "tab_authors": entity_table("author"),
    "tab_title": entity_table("title"),
    "tab_spatialextent": TAB_SPATIALEXTENT,
    "tab_links": TAB_LINKS,
    "tab_url_link_map": TAB_URL_LINK_MAP,
    "metadata_files": METADATA_FILES,
}
