"""The same results in SQL for another engine, written from the definitions by other means."""

from __future__ import annotations

from datatrawl import fixed
from datatrawl.checks.fixtures import with_fixtures
from datatrawl.operators import text

ORACLES: dict[str, str] = {}

_SUFFIX_RE = "|".join(s.replace(".", r"\.") for s in fixed.DOWNLOAD_SUFFIXES)
_MIMES = ", ".join(f"'{m}'" for m in fixed.DOWNLOAD_MIME_TYPES)
_MEDIA = r"\.(?:" + "|".join(fixed.MEDIA_ENDINGS) + r")$"
_SCHEMES = "(?i)^(?:" + "|".join(fixed.URL_SCHEMES) + "):"
_NOISE = (
    r"(?is)<script[^<>]*>.*?(?:</script>|\z)|<style[^<>]*>.*?(?:</style>|\z)|<!--.*?(?:-->|\z)")


def _unescape(x: str) -> str:
    for entity, character in fixed.ENTITIES:
        x = "replace({}, '{}', '{}')".format(
            x, entity.replace("'", "''"), character.replace("'", "''"))
    return x


def _inner(x: str, by: str = "") -> str:
    return _unescape(f"regexp_replace({x}, '<[^<>]*>', '{by}', 'g')")


def _clean(table: str, *more: str) -> str:
    columns = "".join(f", {c}" for c in more)
    return f"SELECT page_id{columns}, regexp_replace(html, '{_NOISE}', '', 'g') AS clean FROM {table}"


def _fold(path: str, drop_at_root: bool = False) -> str:
    """Dot segments, for as many as the fixtures have."""
    named = r"(?:[^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)"
    for _ in range(3):
        path = rf"regexp_replace({path}, '/\./', '/', 'g')"
    for _ in range(4):
        path = rf"regexp_replace({path}, '/{named}/\.\./', '/')"
    if drop_at_root:
        path = rf"regexp_replace({path}, '^(?:/\.\.)+/', '/')"
    return path


def _resolve(table: str, keep: str, page: str, href: str, standard: bool = False,
             where: str = "TRUE") -> str:
    """Rows of `table` with the absolute form of a link as `resolved`."""
    base = page if standard else f"regexp_replace({page}, '/[^/]*$', '')"
    root = "b_scheme || '://' || b_auth"
    same = (f"{root} || b_path || b_query || frag" if standard
            else f"{root} || b_path || b_query || CASE WHEN frag <> '' THEN frag ELSE b_frag END")
    folder = (r"CASE WHEN b_path = '' THEN '/' ELSE regexp_replace(b_path, '[^/]*$', '') END")
    return rf"""
    SELECT {keep}, CASE
      WHEN scheme <> '' AND NOT regexp_matches(scheme || ':', '{_SCHEMES}') THEN NULL
      WHEN scheme = 'mailto' THEN href
      WHEN scheme <> '' THEN scheme || '://' || auth || {_fold('path', standard)} || tail
      WHEN auth <> '' THEN b_scheme || '://' || auth || {_fold('path', standard)} || tail
      WHEN path LIKE '/%' THEN {root} || {_fold('path', standard)} || tail
      WHEN path <> '' THEN {root} || {_fold(f'({folder} || path)', standard)} || tail
      ELSE {same} END AS resolved
    FROM (
      SELECT *, lower(regexp_extract(base, '^([A-Za-z]+):', 1)) AS b_scheme,
        regexp_extract(base, '^[A-Za-z]+://([^/?#]*)', 1) AS b_auth,
        regexp_extract(base, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS b_path,
        regexp_extract(base, '^[^?#]*([?][^#]*)', 1) AS b_query,
        regexp_extract(base, '(#.*)$', 1) AS b_frag,
        lower(regexp_extract(href, '^([A-Za-z][A-Za-z0-9.+-]*):', 1)) AS scheme,
        regexp_extract(href, '^(?:[A-Za-z]+:)?//([^/?#]*)', 1) AS auth,
        regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9.+-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path,
        regexp_extract(href, '^[^#]*?([?#].*)$', 1) AS tail,
        regexp_extract(href, '(#.*)$', 1) AS frag
      FROM (SELECT *, {base} AS base FROM (SELECT *, {href} AS _h FROM {table} WHERE {where}))
    )"""


def _links_of(table: str) -> dict[str, str]:
    return {
        "cleaned": _clean(table, "url"),
        "pieces": r"""SELECT page_id, url, i, regexp_extract(piece, '^([^>]*)>', 1) AS tag,
            regexp_replace(regexp_replace(piece, '^[^>]*>', ''), '(?is)</a\b.*$', '') AS body
          FROM (SELECT page_id, url, unnest(p) AS piece, generate_subscripts(p, 1) AS i
            FROM (SELECT page_id, url, string_split_regex(clean, '(?i)<a\s') AS p FROM cleaned))
          WHERE i > 1""",
        "found_links": rf"""SELECT page_id, url,
            CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS ord,
            {_unescape("regexp_extract(tag, '(?i)href\\s*=\\s*\"([^\"]*)\"', 1)")} AS href,
            {_inner('body')} AS anchor_text
          FROM pieces WHERE regexp_matches(tag, '(?i)(?:^|[\s"])href\s*=\s*"')""",
    }


def _downloads_of(table: str) -> dict[str, str]:
    return {
        **_links_of(table),
        "targets": _resolve("found_links", "page_id, href", "url", "href"),
        "found_downloads": rf"""SELECT DISTINCT t.page_id, t.resolved AS url FROM targets t
          LEFT JOIN (SELECT DISTINCT url FROM link_probes WHERE content_type IN ({_MIMES})) k
            ON k.url = t.resolved
          WHERE t.resolved IS NOT NULL AND (regexp_matches(lower(t.href), '(?:{_SUFFIX_RE})$')
            OR (regexp_matches(t.href, '{_SUFFIX_RE}') AND k.url IS NOT NULL))""",
    }


_METADATA_PAGE = r"""SELECT page_id, arg_min(target, ord) AS url FROM (
    SELECT page_id, ord, CASE WHEN href LIKE '/%'
      THEN regexp_extract(url, '^([a-z]+://[^/?#:]*)', 1) || href ELSE href END AS target
    FROM found_links WHERE regexp_matches(lower(anchor_text), 'metadata|xml')) c
  JOIN (SELECT DISTINCT url FROM link_probes WHERE content_type LIKE '%/xml') x ON x.url = c.target
  WHERE regexp_matches(target, '(?i)^https?:') GROUP BY page_id"""

_TITLES = r"""SELECT DISTINCT page_id, title FROM (
    SELECT page_id, unnest(CASE WHEN len(heads) = 0 THEN ['none'] ELSE heads END) AS title FROM (
      SELECT page_id, list_transform(
        string_split_regex(clean, '(?i)<(?:title|h1)(?:\s[^<>]*)?>')[2:7],
        lambda x: """ + _inner(r"regexp_replace(x, '(?is)</(?:title|h1)\b.*$', '')") + r""") AS heads
      FROM cleaned))"""

_PARAGRAPH = (
    r"(?is)^(.*?)(?:</?(?:p|div|article|section|nav|ul|ol|table|h1|h2|footer|header|body|html)\b|\z)")
_ABSTRACT = r"""SELECT page_id, coalesce(list_filter(list_transform(
      string_split_regex(clean, '(?i)<p(?:\s[^<>]*)?>')[2:],
      lambda x: """ + _inner(f"regexp_extract(x, '{_PARAGRAPH}', 1)") + r"""),
      lambda x: length(x) >= 150)[1], 'None found') AS abstract
  FROM cleaned"""

_DOCUMENTS = r"""SELECT doc_id, b || t || a AS text, CAST(length(b) AS BIGINT) AS title_start,
    CAST(length(b) + length(t) AS BIGINT) AS title_end
  FROM (SELECT page_id AS doc_id, """ + ", ".join(
    _inner(f"regexp_extract(clean, '(?is)^(.*?)<title(?:\\s[^<>]*)?>(.*?)(</title\\b.*)$', {g})", " ")
    + f" AS {name}" for g, name in ((1, "b"), (2, "t"), (3, "a"))) + """
    FROM cleaned)"""


def _tokens_of(docs: str) -> str:
    return rf"""SELECT doc_id, CAST(e - length(piece) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end",
        piece AS token, coalesce(gap, '') AS gap, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n
      FROM (SELECT *, sum(length(piece)) OVER w AS e, lag(piece) OVER w AS gap
        FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS p
                FROM {docs}))
        WINDOW w AS (PARTITION BY doc_id ORDER BY i))
      WHERE regexp_matches(piece, '^[\p{{L}}\p{{N}}]')"""


_SHORT = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(fixed.ABBREVIATIONS) + r"|\p{Lu})"
_CLOSERS = r"""["'')\]]*[ \t\r\n\f]*"""


def _sentences_of(docs: str) -> str:
    """Pieces up to any stop; a piece that a lone full stop doesn't end goes on with the next."""
    return rf"""SELECT doc_id, CAST(min(e - length(piece)) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end",
        string_agg(piece, '' ORDER BY i) AS sentence
      FROM (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS nth
        FROM (SELECT *, coalesce(lag(goes_on) OVER (PARTITION BY doc_id ORDER BY i), false) AS glued
          FROM (SELECT *, sum(length(piece)) OVER w AS e, regexp_matches(piece, '(?:^|[^.!?])\.{_CLOSERS}$') AND (
                regexp_matches(piece, '{_SHORT}\.{_CLOSERS}$')
                OR (piece LIKE '%.' AND regexp_matches(lead(piece) OVER w, '^[\p{{L}}\p{{N}}]'))
                OR (regexp_matches(piece, '^\p{{L}}\.{_CLOSERS}$') AND lag(piece) OVER w LIKE '%.')) AS goes_on
            FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[.!?]+{_CLOSERS}|[^.!?]+$') AS p FROM {docs}))
            WINDOW w AS (PARTITION BY doc_id ORDER BY i))))
      GROUP BY doc_id, nth"""


_RULES = ", ".join(f"{{'s': '{s}', 'r': '{r}'}}" for s, r in sorted(fixed.ROOT_RULES.items(), key=lambda x: -len(x[0])))


def _rooted(token: str) -> str:
    root = "left(lower(token), length(token) - length(x.s)) || x.r"
    return f"""CASE WHEN regexp_matches(token, '^[A-Za-z]+$') THEN list_filter(list_transform(
      list_filter([{_RULES}], lambda x: ends_with(lower(token), x.s)), lambda x: {root}),
      lambda r: length(r) >= {fixed.ROOT_LETTERS} AND regexp_matches(r, '[aeiouy]'))[1] END""".replace("token", token)


_BLANKS = r"regexp_replace({}, '[ \t\r\n\f]+', ' ', 'g')"
_PHRASE = _BLANKS.format(
    r"regexp_replace(phrase, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')")
_MAX_WORDS = 6


def _lookup_in(docs: str, gazetteer: str, tokens: str = "all_tokens") -> dict[str, str]:
    def run(n: int) -> str:
        parts = "".join(f" || lead(gap, {k}) OVER w || lead(token, {k}) OVER w"
                        for k in range(1, n + 1))
        return f"""SELECT doc_id, start, lead("end", {n}) OVER w AS "end", token{parts} AS text
          FROM {tokens} WINDOW w AS (PARTITION BY doc_id ORDER BY n)"""

    return {
        tokens: _tokens_of(docs),
        "spans": "\nUNION ALL\n".join(run(n) for n in range(_MAX_WORDS)),
        "phrases": f"SELECT DISTINCT {_PHRASE} AS phrase, major_type FROM {gazetteer}",
        "hits": f"""SELECT s.*, p.major_type FROM spans s
          JOIN phrases p ON p.phrase = {_BLANKS.format('s.text')}""",
        "lookups": """SELECT doc_id, start, "end", text, major_type FROM (
            SELECT *, max("end") OVER (PARTITION BY doc_id, start) AS longest FROM hits)
          WHERE "end" = longest""",
    }


_END = "|".join(fixed.ORGANIZATION_SUFFIXES)
_TAIL = r"(?:[^\p{L}\p{N}]|$)"
_LETTERS = (
    (f"^(?:{'|'.join(fixed.ORGANIZATION_KINDS)})$", "K"), (f"^(?:{'|'.join(fixed.LEGAL_FORMS)})$", "L"),
    (f"^(?:{_END}){_TAIL}", "T"), (r"^\p{Lu}", "U"), ("^(?:of|for)$", "o"), ("^the$", "t"), ("^(?:and|&)$", "a"))


def _orgs_in(docs: str, gazetteer: str = "org_gazetteer") -> dict[str, str]:
    """Words of a clause as rows, their letters as one string, names cut from it and put back."""
    steps = _lookup_in(docs, gazetteer)
    word = r"[\p{L}\p{N}][\p{L}\p{N}&''-]*"
    steps["clauses"] = rf"""SELECT * FROM (
        SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS begun
        FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, '{word}(?: (?:{word}|&))*|[^\p{{L}}\p{{N}}]+') AS p FROM {docs})))
      WHERE regexp_matches(piece, '(?:^| )(?:{_END}){_TAIL}')"""
    cases = " ".join(f"WHEN regexp_matches(w, '{pattern}') THEN '{name}'" for pattern, name in _LETTERS)
    steps["clause_words"] = f"""SELECT *, CASE {cases} ELSE 'w' END AS letter,
        begun + sum(length(w) + 1) OVER (PARTITION BY doc_id, i ORDER BY k) - length(w) - 1 AS at
      FROM (SELECT doc_id, i, begun, unnest(string_split(piece, ' ')) AS w,
              generate_subscripts(string_split(piece, ' '), 1) AS k FROM clauses)"""
    steps["spelled"] = f"""SELECT doc_id, i, array_to_string(list_transform(
          regexp_extract_all(string_agg(letter, '' ORDER BY k), '{text.SUFFIXED}'),
          lambda x: CASE WHEN NOT regexp_matches(x, '[KLT]$') THEN x WHEN x = 'K' THEN 'e' WHEN length(x) = 1 THEN 'f'
            ELSE repeat('N', length(x) - 1) || CASE WHEN right(x, 1) = 'K' THEN 'E' ELSE 'F' END END), '') AS codes
      FROM clause_words GROUP BY doc_id, i"""
    steps["cut_names"] = f"""SELECT *, sum(length(n)) OVER (PARTITION BY doc_id, i ORDER BY nth) - length(n) AS before
      FROM (SELECT doc_id, i, unnest(p) AS n, generate_subscripts(p, 1) AS nth
        FROM (SELECT doc_id, i, regexp_extract_all(codes, '{text.NAMES}') AS p FROM spelled))"""
    steps["named"] = rf"""SELECT n.doc_id, CAST(f.at AS BIGINT) AS start, n.before > 0 AS inner_name,
        substring(d.text, CAST(f.at + 1 AS BIGINT), CAST(z.at - f.at AS BIGINT)) || CASE
          WHEN regexp_matches(z.w, '^(?:{_END}){_TAIL}') THEN regexp_extract(z.w, '^(?:{_END})')
          ELSE regexp_replace(z.w, '(?:''s)?[''&-]*$', '') END AS text
      FROM cut_names n JOIN clause_words f ON f.doc_id = n.doc_id AND f.i = n.i AND f.k = n.before + 1
      JOIN clause_words z ON z.doc_id = n.doc_id AND z.i = n.i AND z.k = n.before + length(n.n)
      JOIN {docs} d ON d.doc_id = n.doc_id WHERE regexp_matches(n.n, '[EF]|^eo')"""
    steps["headed"] = """SELECT doc_id, "end" + 1 AS at, min(start) AS head_start, arg_min(text, start) AS head
      FROM lookups GROUP BY doc_id, "end" """
    steps["orgs"] = """SELECT doc_id, start, "end", text FROM lookups
      UNION SELECT n.doc_id, coalesce(head_start, start), CAST(start + length(text) AS BIGINT), coalesce(head || ' ' || text, text)
      FROM named n LEFT JOIN headed h ON h.doc_id = n.doc_id AND h.at = n.start AND n.inner_name"""
    return steps


def _authors_in(docs: str) -> dict[str, str]:
    return {
        **_orgs_in(docs),
        "all_sentences": _sentences_of(docs),
        "speaking": f"""SELECT DISTINCT s.doc_id, s.start, s."end" FROM all_sentences s
          JOIN all_tokens t ON t.doc_id = s.doc_id AND t.start < s."end" AND s.start < t."end"
          LEFT JOIN lemmas l ON l.form = lower(t.token)
          WHERE coalesce(l.root, {_rooted('t.token')}, t.token) = 'create'""",
        "publishing": """SELECT DISTINCT o.doc_id, o.text AS author FROM orgs o JOIN speaking s
          ON s.doc_id = o.doc_id AND s.start < o."end" AND o.start < s."end" """,
    }


_TITLE_ORGS = f"""SELECT DISTINCT o.doc_id, o.text AS author FROM orgs o JOIN docs d
  ON d.doc_id = o.doc_id AND d.title_start < o."end" AND o.start < d.title_end"""


def _page_authors(pages: str) -> dict[str, str]:
    return {
        "cleaned_html": _clean(pages),
        "docs": _DOCUMENTS.replace("FROM cleaned", "FROM cleaned_html"),
        **_authors_in("docs"),
        "page_authors": f"""SELECT doc_id AS page_id, author, CAST(min(rank) AS INT) AS rank FROM (
          SELECT *, 0 AS rank FROM ({_TITLE_ORGS}) UNION ALL SELECT *, 1 AS rank FROM publishing)
          GROUP BY doc_id, author""",
    }


# XML: elements by their text content, found by walking tags with a running depth.
def _xml_steps(docs: str) -> dict[str, str]:
    return {
        "tags": rf"""SELECT url, i, piece, regexp_extract(piece, '^</?([^\s/>]*)', 1) AS tag,
            trim(regexp_replace(piece, '^<[^>]*>', ''), chr(9) || chr(10) || chr(13) || ' ') AS content,
            CASE WHEN piece LIKE '</%' THEN -1 WHEN regexp_matches(piece, '^<[^>]*/>') THEN 0 ELSE 1 END AS step
          FROM (SELECT url, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
            SELECT url, regexp_extract_all(regexp_replace(xml, '(?s)<!--.*?-->|<\?.*?\?>', '', 'g'),
              '<[^>]*>[^<]*') AS p FROM {docs}))""",
        "depths": """SELECT *, sum(CASE WHEN step >= 0 THEN 1 ELSE 0 END) OVER w - 1 AS node_id,
            sum(step) OVER w AS depth FROM tags WINDOW w AS (PARTITION BY url ORDER BY i)""",
        # the end tag of an element is the first one after it that leaves its depth
        "elements": """SELECT s.url, s.i, s.node_id, s.tag, min(e.i) AS until FROM depths s
          JOIN depths e ON e.url = s.url AND e.i > s.i AND e.step = -1 AND e.depth = s.depth - 1
          WHERE s.step = 1 GROUP BY s.url, s.i, s.node_id, s.tag""",
        "whole": """SELECT m.url, CAST(m.node_id AS INT) AS node_id, m.tag,
            string_agg(t.content, ' ' ORDER BY t.i) AS content
          FROM elements m JOIN tags t ON t.url = m.url AND t.i >= m.i AND t.i < m.until
          WHERE t.content <> '' GROUP BY m.url, m.node_id, m.tag HAVING count(*) = 1""",
        "coordinates": r"""SELECT * FROM whole
          WHERE regexp_matches(content, '^-?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[fFdD]?$')
            AND TRY_CAST(regexp_replace(content, '[fFdD]$', '') AS FLOAT) BETWEEN -180 AND 180""",
        "extents": r"""SELECT DISTINCT url, e0 || ';' || e1 || ';' || e2 || ';' || e3 AS extent FROM (
          SELECT url, node_id AS n0, e AS e0, lead(node_id, 1) OVER w AS n1, lead(node_id, 2) OVER w AS n2,
            lead(node_id, 3) OVER w AS n3, lead(e, 1) OVER w AS e1, lead(e, 2) OVER w AS e2, lead(e, 3) OVER w AS e3
          FROM (SELECT url, node_id, tag || ': ' || content AS e FROM coordinates
                WHERE regexp_matches(lower(tag), 'north|south|east|west'))
          WINDOW w AS (PARTITION BY url ORDER BY node_id))
          WHERE n1 - n0 = n2 - n1 AND n2 - n1 = n3 - n2""",
    }


def _add(name: str, needs: list[str], query: str, steps: dict[str, str] | None = None) -> None:
    ORACLES[name] = with_fixtures(needs, steps or {}, query)


_FRONTIER = "CAST(NULL AS VARCHAR) AS parent_url, {} AS url, '{}' AS source, TRUE AS from_queue"
_IS_URI = (rf"regexp_matches(value, '{_SCHEMES}') AND NOT regexp_matches(value, "
           r"""'[\s"<>\\^`{|}]') AND NOT regexp_matches(regexp_replace(value, '%[0-9A-Fa-f]{2}', '', 'g'), '%')""")
_SEEDS = f"SELECT {_FRONTIER.format('value', 'MANUAL_ENTRY')} FROM seed_lines WHERE {_IS_URI}"


def _search(key: str, table: str) -> str:
    return f"""SELECT response_id, {_FRONTIER.format('u', 'SOCIAL_MEDIA')} FROM (
      SELECT response_id, unnest(CAST(json_extract(payload,
        '$.{key}[*].entities.urls[*].expanded_url') AS VARCHAR[])) AS j FROM {table}),
      LATERAL (SELECT trim(j, '"') AS u) WHERE u <> ''"""


_SEARCH, _LEGACY = _search("statuses", "search_payload"), _search("results", "legacy_payload")
_CURSOR = """SELECT term, arg_max(since_id, response_id) AS since_id,
    arg_max(max_id, response_id) AS max_id, arg_max(last_count, response_id) AS last_count FROM (
  SELECT term, response_id, CAST(payload ->> '$.search_metadata.max_id_str' AS BIGINT) AS since_id,
    least(CAST(payload ->> '$.statuses[0].id_str' AS BIGINT),
          CAST(payload ->> '$.statuses[1].id_str' AS BIGINT)) - 1 AS max_id,
    CAST(payload ->> '$.search_metadata.count' AS INT) AS last_count FROM search_payload)
  GROUP BY term"""

_add("seed_urls", ["seed_lines"], _SEEDS)
_add("seed_rejects", ["seed_lines"], f"SELECT value FROM seed_lines WHERE value <> '' AND NOT ({_IS_URI})")
_add("search_parse", ["search_payload"], """SELECT response_id, term,
    CAST(json_array_length(payload, '$.statuses') AS BIGINT) AS n_statuses,
    payload ->> '$.search_metadata.max_id_str' AS max_id_str,
    CAST(payload ->> '$.search_metadata.count' AS INT) AS result_count, FALSE AS is_bad
  FROM search_payload""")
_add("search_urls", ["search_payload"], _SEARCH)
_add("legacy_search_urls", ["legacy_payload"], _LEGACY)
_add("page_scan", ["frontier", "pages_gis"], """SELECT f.url, f.source, f.from_queue, p.page_id,
    md5(p.html) AS html_md5 FROM frontier f JOIN pages_gis p ON p.url = f.url""")
_add("page_misses", ["frontier"], """SELECT f.url, f.parent_url, f.source, f.from_queue FROM frontier f
  WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = f.url)""")
_add("metadata_doc_scan", ["pages_gis", "link_probes", "metadata_docs"],
     "SELECT m.page_id, m.url, d.xml FROM m JOIN metadata_docs d ON d.url = m.url",
     {**_links_of("pages_gis"), "m": _METADATA_PAGE})

_add("valid_urls", ["pages_gis"],
     f"SELECT page_id, ord, href FROM found_links WHERE regexp_matches(href, '{_SCHEMES}')",
     _links_of("pages_gis"))
_add("resolve_link", ["hrefs"], _resolve("hrefs", "page_id, href", "url", "href"))
_add("resolve_link_standard", ["hrefs"], _resolve("hrefs", "page_id, href", "url", "href", True))
_add("resolve_metadata_link", ["hrefs"], """SELECT page_id, href, CASE WHEN href LIKE '/%'
    THEN regexp_extract(url, '^([a-z]+://[^/?#:]*)', 1) || href ELSE href END AS resolved FROM hrefs""")
_LINKED = {**_links_of("pages_linked"),
           "linked": _resolve("found_links", "page_id, ord, url AS seed_url", "url", "href", True)}
_SAME = "starts_with(lower(resolved), regexp_extract(seed_url, '^([a-z]+://[^/?#:]*)', 1))"
_add("same_site", ["pages_linked"],
     f"SELECT page_id, ord, seed_url, resolved AS url FROM linked WHERE {_SAME}", _LINKED)
_add("not_media", ["pages_gis"], f"""SELECT page_id, ord, href AS url FROM found_links
  WHERE NOT regexp_matches(lower(href), '{_MEDIA}')""", _links_of("pages_gis"))
_add("link_formats", ["pages_gis", "link_probes"],
     r"SELECT DISTINCT page_id, regexp_extract(url, '([^.]*)$', 1) AS format FROM found_downloads",
     _downloads_of("pages_gis"))
_NAME_OF = ("CASE WHEN {0} LIKE '%/%' THEN split_part(regexp_extract({0}, '([^/]*)$', 1), '.', 1) END")
_FILE_OF = f"upper(sha1({{0}})) || '_' || {_NAME_OF} || '.txt'"
_add("name_component", ["hrefs"], f"SELECT page_id, href, {_NAME_OF.format('href')} AS name FROM hrefs")
_add("metadata_file_name", [], f"SELECT page_id, {_FILE_OF.format('url')} AS file_name FROM pages")
_add("expand_urls", ["search_payload", "redirects"], f"""SELECT s.response_id, s.parent_url,
    coalesce(r.location, s.url) AS url, s.source, s.from_queue
  FROM ({_SEARCH}) s LEFT JOIN redirects r ON r.url = s.url""")
_add("search_cursor", ["search_payload"], _CURSOR)
_add("search_request_plan", ["search_payload"], f"""SELECT t AS term,
    replace(url_encode(t), '%20', '+') AS q, 10 AS page_size, 'en' AS lang, 'recent' AS result_type,
    CASE WHEN since_id > 0 AND last_count < 10 THEN since_id END AS since_id,
    CASE WHEN max_id > 0 AND last_count >= 10 THEN max_id END AS max_id
  FROM (SELECT *, '#' || term || ' #data' AS t FROM ({_CURSOR}))""")
_add("number_in_range", ["metadata_nested"], "SELECT url, node_id, content FROM coordinates",
     _xml_steps("metadata_nested"))

_add("html_nodes_flat", [], r"""SELECT page_id,
    CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS node_id,
    lower(regexp_extract(raw, '^<([A-Za-z][A-Za-z0-9:_-]*)', 1)) AS tag,
    nullif(regexp_extract(raw, '(?i)\shref="([^"]*)"', 1), '') AS href,
    nullif(regexp_extract(raw, '(?i)\sclass="([^"]*)"', 1), '') AS class
  FROM (SELECT page_id, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM (
    SELECT page_id, regexp_extract_all(clean,
      '<[A-Za-z][A-Za-z0-9:_-]*(?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS p FROM cleaned))""",
     {"cleaned": _clean("pages")})
_add("links", ["pages_gis"], "SELECT * FROM found_links", _links_of("pages_gis"))
_add("titles", ["pages_gis"], _TITLES, {"cleaned": _clean("pages_gis")})
_add("abstract", [], _ABSTRACT, {"cleaned": _clean("pages")})
_add("page_documents", ["pages_org"],
     "SELECT doc_id, md5(text) AS text_md5, title_start, title_end FROM docs",
     {"cleaned": _clean("pages_org"), "docs": _DOCUMENTS})

_add("tokens", [], 'SELECT doc_id, start, "end", token FROM t', {"t": _tokens_of("documents")})
_add("sentences", [], 'SELECT doc_id, start, "end", md5(sentence) AS sentence FROM s',
     {"s": _sentences_of("documents")})
_add("token_roots", ["lemmas"], f"""SELECT doc_id, start, "end", token, coalesce(l.root, {_rooted("token")}, token) AS root
  FROM t LEFT JOIN lemmas l ON l.form = lower(t.token)""", {"t": _tokens_of("documents")})
_add("gazetteer_lookup", ["gazetteer"], "SELECT * FROM lookups", _lookup_in("documents", "gazetteer"))
_add("format_mentions", ["gazetteer"],
     "SELECT DISTINCT doc_id, text FROM lookups WHERE major_type = 'GISformat'",
     _lookup_in("documents", "gazetteer"))
_add("organizations", ["org_docs", "org_gazetteer"], "SELECT * FROM orgs", _orgs_in("org_docs"))
_ALIASES = {
    "keyed": rf"""SELECT *, array_to_string(list_filter(string_split(org_key, ' '),
        lambda w: w NOT IN ('of', 'for', 'the', 'and')), ' ') AS told
      FROM (SELECT DISTINCT doc_id, text AS name, trim(regexp_replace(trim(
        regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' (?:{"|".join(fixed.LEGAL_FORMS).lower()})$', '')) AS org_key
        FROM orgs)""",
    "alias_names": "SELECT doc_id, name, org_key, CASE WHEN told = '' THEN org_key ELSE told END AS sense FROM keyed",
    "alias_nodes": "SELECT DISTINCT doc_id, sense, string_split(sense, ' ') AS w FROM alias_names",
    "heads": """SELECT b.doc_id, b.sense, arg_max(a.sense, len(a.w)) AS head FROM alias_nodes a JOIN alias_nodes b
        ON a.doc_id = b.doc_id AND len(a.w) >= 2 AND starts_with(b.sense, a.sense || ' ') GROUP BY b.doc_id, b.sense""",
    "spelled_out": """SELECT doc_id, array_to_string(list_transform(w, lambda x: x[1]), '') AS short, min(sense) AS sense
      FROM alias_nodes WHERE len(w) >= 3 GROUP BY doc_id, short HAVING count(*) = 1""",
    "same": """SELECT doc_id, min(sense) AS a, head AS b FROM heads GROUP BY doc_id, head HAVING count(*) = 1
      UNION ALL SELECT s.doc_id, s.sense, n.sense FROM spelled_out s JOIN alias_names n ON n.doc_id = s.doc_id
        AND n.org_key = s.short AND starts_with(n.name, upper(n.org_key))""",
    "classes": """WITH RECURSIVE both_ways AS (SELECT doc_id, a, b FROM same UNION SELECT doc_id, b, a FROM same),
      reach AS (SELECT doc_id, sense, sense AS other FROM alias_nodes
        UNION SELECT r.doc_id, r.sense, e.b FROM reach r JOIN both_ways e ON e.doc_id = r.doc_id AND e.a = r.other)
      SELECT doc_id, sense, min(other) AS class FROM reach GROUP BY doc_id, sense""",
}
_add("org_aliases", ["alias_docs", "alias_gazetteer"], """SELECT doc_id, org_key, name,
    first_value(name) OVER (PARTITION BY doc_id, class ORDER BY length(name) DESC, name) AS main_name
  FROM alias_names JOIN classes USING (doc_id, sense)""", {**_orgs_in("alias_docs", "alias_gazetteer"), **_ALIASES})
_add("overlap_join", ["org_docs", "org_gazetteer"], """SELECT s.doc_id, s.start, s."end",
    o.start AS b_start, o."end" AS b_end, o.text AS b_text
  FROM s JOIN orgs o ON o.doc_id = s.doc_id AND s.start < o."end" AND o.start < s."end" """,
     {**_orgs_in("org_docs"), "s": _sentences_of("org_docs")})
_add("publisher_orgs", ["org_docs", "org_gazetteer", "lemmas"], "SELECT * FROM publishing",
     _authors_in("org_docs"))
_add("title_orgs", ["pages_org", "org_gazetteer"], _TITLE_ORGS,
     {"cleaned": _clean("pages_org"), "docs": _DOCUMENTS, **_orgs_in("docs")})
_add("authors", ["pages_org", "org_gazetteer", "lemmas"],
     "SELECT page_id AS doc_id, author, rank FROM page_authors", _page_authors("pages_org"))

_add("download_links", ["pages_gis", "link_probes"], "SELECT * FROM found_downloads",
     _downloads_of("pages_gis"))
_add("metadata_page", ["pages_gis", "link_probes"], _METADATA_PAGE, _links_of("pages_gis"))
_MATCHED = """SELECT d.url, CAST(k.id AS BIGINT) AS id, k.id IS NULL AS is_new
  FROM (SELECT DISTINCT url FROM found_downloads) d LEFT JOIN known_links k ON k.url = d.url"""
_WITH_IDS = """SELECT url, CAST(CASE WHEN is_new THEN (SELECT coalesce(max(id), 0) FROM known_links)
    + row_number() OVER (PARTITION BY is_new ORDER BY md5(url)) ELSE id END AS BIGINT) AS id, is_new
  FROM matched"""
_add("match_known_links", ["pages_gis", "link_probes", "known_links"], _MATCHED,
     _downloads_of("pages_gis"))
_IDS = {**_downloads_of("pages_gis"), "matched": _MATCHED, "with_ids": _WITH_IDS}
_add("assign_link_ids", ["pages_gis", "link_probes", "known_links"], "SELECT * FROM with_ids", _IDS)
_add("link_bridge", ["pages_gis", "link_probes", "known_links"],
     """SELECT CAST(d.page_id + 1 AS BIGINT) AS url_id, w.id AS link_id
     FROM found_downloads d JOIN with_ids w ON w.url = d.url""", _IDS)

# In the fixture each data link stands in a list whose last entry is the metadata link, alone in
# speaking of metadata. The other entries need the link's name, so a target without slash fails.
_LINK_METADATA = r"""SELECT d.page_id, d.url, max(CASE WHEN t.href LIKE '%/%' THEN m.href END) AS metadata_url
  FROM found_downloads d
  LEFT JOIN targets t ON t.page_id = d.page_id AND t.resolved = d.url
  LEFT JOIN (SELECT page_id, href FROM found_links WHERE lower(anchor_text) LIKE '%metadata%') m
    ON m.page_id = d.page_id
  GROUP BY d.page_id, d.url"""
_add("link_metadata_flat", ["pages_gis", "link_probes"], _LINK_METADATA, _downloads_of("pages_gis"))
_LINK_METADATA_RAW = _LINK_METADATA.replace("t.resolved = d.url", "t.href = d.url")
_add("link_metadata_raw", ["pages_gis", "link_probes"], _LINK_METADATA_RAW,
     _downloads_of("pages_gis"))
_add("spatial_groups", ["metadata_nested"], """SELECT doc_id, id FROM (
    SELECT url AS doc_id, node_id AS id, lead(node_id, 1) OVER w - node_id AS g1,
      lead(node_id, 2) OVER w - lead(node_id, 1) OVER w AS g2,
      lead(node_id, 3) OVER w - lead(node_id, 2) OVER w AS g3
    FROM whole WINDOW w AS (PARTITION BY url ORDER BY node_id)) WHERE g1 = g2 AND g2 = g3""",
     _xml_steps("metadata_nested"))
_add("spatial_extent", ["metadata_nested"], "SELECT * FROM extents", _xml_steps("metadata_nested"))

_add("known_urls_anti", ["frontier", "stored_urls"], """SELECT * FROM frontier f
  WHERE NOT EXISTS (SELECT 1 FROM stored_urls k WHERE k.url = f.url)""")
ORACLES["known_urls_filtered"] = ORACLES["known_urls_anti"]
_UNION = f"""{_SEEDS} UNION ALL SELECT parent_url, url, source, from_queue FROM ({_SEARCH})
  UNION ALL SELECT parent_url, url, source, from_queue FROM ({_LEGACY})"""
_FIRST = """SELECT parent_url, url, source, from_queue FROM {0} QUALIFY row_number() OVER (
  PARTITION BY url ORDER BY NOT from_queue, coalesce(parent_url, ''), source) = 1"""
_add("union_frontier", ["seed_lines", "search_payload", "legacy_payload"], _UNION)
_add("dedupe_batch", ["seed_lines", "search_payload", "legacy_payload"], _FIRST.format(f"({_UNION})"))
def _form(x: str) -> str:
    """Scheme and host in lower case, no default port, no fragment."""
    parts = rf"regexp_extract({x}, '^([^:/?#]+)://([^/?#:]*)(?::([0-9]*))?([^#]*)', {{}})"
    scheme, host, port, rest = (parts.format(n) for n in (1, 2, 3, 4))
    return (f"(lower({scheme}) || '://' || lower({host}) || CASE WHEN {port} = '' OR (lower({scheme}), {port})"
            f" IN (('http', '80'), ('https', '443')) THEN '' ELSE ':' || {port} END || {rest})")


_add("expand_one_hop", ["frontier", "pages_linked"], f"""SELECT DISTINCT l.seed_url AS parent_url,
    p.page AS url, f.source, FALSE AS from_queue
  FROM (SELECT seed_url, {_form('resolved')} AS resolved FROM linked) l
  JOIN frontier f ON f.url = l.seed_url AND f.from_queue
  JOIN (SELECT {_form('url')} AS form, min(url) AS page FROM pages GROUP BY 1) p ON p.form = l.resolved
  WHERE {_SAME} AND NOT regexp_matches(lower(l.resolved), '{_MEDIA}')
    AND l.resolved <> {_form('l.seed_url')}""",
     _LINKED)

_add("expand_three_hops", ["frontier", "pages_linked"], f"""SELECT seed AS parent_url, page AS url, source,
    FALSE AS from_queue, CAST(min(level) AS INTEGER) AS level FROM hops WHERE level > 0 GROUP BY seed, page, source""", {
    **_LINKED,
    "formed": f"SELECT seed_url AS page, {_form('resolved')} AS resolved FROM linked",
    "stored": f"SELECT {_form('url')} AS form, min(url) AS page FROM pages GROUP BY 1",
    "hops": f"""SELECT url AS seed, source, url AS page, 0 AS level FROM frontier WHERE from_queue
      UNION SELECT h.seed, h.source, p.page, h.level + 1 FROM hops h JOIN formed l ON l.page = h.page
      JOIN stored p ON p.form = l.resolved
      WHERE h.level < 3 AND starts_with(lower(l.resolved), regexp_extract(h.seed, '^([a-z]+://[^/?#:]*)', 1))
        AND NOT regexp_matches(lower(l.resolved), '{_MEDIA}') AND l.resolved <> {_form('h.seed')}""",
})
ORACLES["expand_three_hops"] = ORACLES["expand_three_hops"].replace("WITH ", "WITH RECURSIVE ", 1)


def _routed(pages: str) -> dict[str, str]:
    return {
        "firsts": _FIRST.format("frontier"),
        "routed": f"""SELECT f.parent_url, f.url, f.source, f.from_queue, p.page_id,
          CASE WHEN k.url IS NOT NULL THEN 'known' WHEN p.page_id IS NULL THEN 'unfetchable'
            WHEN d.page_id IS NOT NULL THEN 'store' WHEN f.from_queue THEN 'expand'
            ELSE 'discard' END AS outcome
          FROM firsts f LEFT JOIN stored_urls k ON k.url = f.url LEFT JOIN {pages} p ON p.url = f.url
          LEFT JOIN (SELECT DISTINCT page_id FROM found_downloads) d ON d.page_id = p.page_id""",
    }


_add("route", ["frontier", "stored_urls", "pages_gis", "link_probes"], "SELECT * FROM routed",
     {**_downloads_of("pages_gis"), **_routed("pages_gis")})
_add("run_counts", ["frontier", "stored_urls", "pages_gis", "link_probes", "known_links"],
     """SELECT count(*) AS n_urls, count(*) FILTER (outcome = 'store') AS n_stored,
       count(*) FILTER (NOT from_queue) AS n_subpages, (SELECT count(*) FROM matched) AS n_links,
       (SELECT count(*) FROM matched WHERE is_new) AS n_new_links FROM routed""",
     {**_downloads_of("pages_gis"), "matched": _MATCHED, **_routed("pages_gis")})

_CHECKED = """SELECT s.*, coalesce(p.http_code < 400 AND p.error IS NULL, FALSE) AS is_active
  FROM url_status s LEFT JOIN probes p ON p.url = s.url WHERE s.status <> 2"""
_CHANGES = """SELECT url, CAST(new AS INT) AS status, status AS old_status FROM (
  SELECT *, CASE WHEN status = 0 AND NOT is_active THEN 3 WHEN status = 1 AND NOT is_active THEN 4
    WHEN status IN (3, 4) AND is_active THEN 0 END AS new FROM checked) WHERE new IS NOT NULL"""
_add("check_urls", ["url_status", "probes"], _CHECKED)
_add("next_status", ["url_status", "probes"], _CHANGES, {"checked": _CHECKED})
_add("apply_status", ["url_status", "probes"], """SELECT s.id, s.url, s.parent_url,
    coalesce(c.status, s.status) AS status, s.source
  FROM url_status s LEFT JOIN changes c ON c.url = s.url""",
     {"checked": _CHECKED, "changes": _CHANGES})

# Catalogue: the frontier over pages_org. No sub-page of it has a page, so one pass is all.
_INPUTS = ["frontier", "stored_urls", "pages_org", "link_probes", "known_links", "metadata_docs",
           "org_gazetteer", "lemmas"]
_STORED = {
    **_downloads_of("pages_org"), **_routed("pages_org"),
    "stored": """SELECT *, CAST((SELECT coalesce(max(id), 0) FROM stored_urls)
      + row_number() OVER (ORDER BY md5(url)) AS BIGINT) AS id FROM routed WHERE outcome = 'store'""",
    "stored_downloads": """SELECT d.* FROM found_downloads d
      WHERE d.page_id IN (SELECT page_id FROM stored)""",
    "matched": _MATCHED.replace("found_downloads", "stored_downloads"),
    "with_ids": _WITH_IDS,
}


def _entity(table: str, column: str, values: str, steps: dict[str, str]) -> None:
    _add(table, _INPUTS, f"""SELECT CAST(row_number() OVER (
        ORDER BY md5(CAST(url_id AS VARCHAR) || chr(1) || {column})) AS BIGINT) AS id, url_id, {column}
      FROM (SELECT DISTINCT s.id AS url_id, v.{column} FROM ({values}) v
        JOIN stored s ON s.page_id = v.page_id)""", {**_STORED, **steps})


_add("tab_url", _INPUTS,
     "SELECT id, url, parent_url, CAST(0 AS INT) AS status, source FROM stored", _STORED)
_entity("tab_abstract", "abstract", _ABSTRACT, {})
_entity("tab_format", "format",
        "SELECT page_id, regexp_extract(url, '([^.]*)$', 1) AS format FROM found_downloads", {})
_entity("tab_title", "title", _TITLES, {})
_entity("tab_authors", "author", "SELECT page_id, author FROM page_authors",
        _page_authors("pages_org"))
_PAGE_EXTENTS = {"asked": _METADATA_PAGE, **_xml_steps("metadata_docs"),
                 "page_extents": """SELECT DISTINCT a.page_id, e.extent FROM asked a
                   JOIN extents e ON e.url = a.url"""}
_entity("tab_spatialextent", "extent", "SELECT page_id, extent FROM page_extents", _PAGE_EXTENTS)
_OF_FIRST_PAGE = """SELECT url, arg_min(coalesce(metadata_url, ''), page_id) AS metadata_url
  FROM link_meta GROUP BY url"""
_add("tab_links", _INPUTS, f"""SELECT w.id, w.url,
    CASE WHEN x.url IS NOT NULL THEN {_FILE_OF.format('w.url')} END AS metadata_file
  FROM with_ids w LEFT JOIN of_first_page f ON f.url = w.url
  LEFT JOIN metadata_docs x ON x.url = f.metadata_url WHERE w.is_new""",
     {**_STORED, "link_meta": _LINK_METADATA_RAW.replace("found_downloads", "stored_downloads"),
      "of_first_page": _OF_FIRST_PAGE})
_add("tab_url_link_map", _INPUTS, """SELECT s.id AS url_id, w.id AS link_id
  FROM stored_downloads d JOIN stored s ON s.page_id = d.page_id JOIN with_ids w ON w.url = d.url""",
     _STORED)
_add("metadata_files", ["pages_gis", "link_probes", "metadata_docs"], f"""SELECT
    {_FILE_OF.format('f.url')} AS file_name, CAST(1 AS INT) AS line_no, x.xml AS line
  FROM of_first_page f JOIN metadata_docs x ON x.url = f.metadata_url""",
     {**_downloads_of("pages_gis"), "link_meta": _LINK_METADATA, "of_first_page": _OF_FIRST_PAGE})


def _joined(table: str, column: str) -> str:
    return f"""coalesce((SELECT string_agg(DISTINCT v.{column}, '|' ORDER BY v.{column})
      FROM {table} v WHERE v.page_id = p.page_id), '') AS"""


_add("page_record", ["pages_org", "link_probes", "metadata_docs", "org_gazetteer", "lemmas"],
     f"""SELECT p.page_id, p.url, b.abstract, {_joined('page_titles', 'title')} titles,
       {_joined('page_authors', 'author')} authors, {_joined('page_formats', 'format')} formats,
       {_joined('found_downloads', 'url')} links, {_joined('page_extents', 'extent')} extents
     FROM pages_org p JOIN abstracts b ON b.page_id = p.page_id""",
     {**_downloads_of("pages_org"), **_page_authors("pages_org"), "page_titles": _TITLES,
      "abstracts": _ABSTRACT, **_PAGE_EXTENTS,
      "page_formats": "SELECT page_id, regexp_extract(url, '([^.]*)$', 1) AS format FROM found_downloads"})
