"""URL expressions. Every function takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datatrawl import fixed

_KNOWN_SCHEME = "(?i)^(?:" + "|".join(fixed.URL_SCHEMES) + "):"
_MEDIA = r"\.(?:" + "|".join(fixed.MEDIA_ENDINGS) + r")\z"
# scheme, authority, path, query, fragment of a hierarchical URL
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9.+-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
_NOT_IN_URI = r'[\s"<>\\^`{|}]'


def is_valid_url(url: Column) -> Column:
    """The URL has a known scheme."""
    return F.coalesce(url.rlike(_KNOWN_SCHEME), F.lit(False))


def is_uri(url: Column) -> Column:
    """Absolute, with a known scheme, and free of characters that a URI may not hold."""
    escapes_removed = F.regexp_replace(url, "%[0-9A-Fa-f]{2}", "")
    return is_valid_url(url) & ~url.rlike(_NOT_IN_URI) & ~F.contains(escapes_removed, F.lit("%"))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def site_root(url: Column) -> Column:
    """`scheme://host`: no user, no port, scheme in lower case."""
    host = F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), host)


def _fold_dots(path: Column, drop_at_root: bool) -> Column:
    """Take `.` and `..` segments out of a path.

    A `..` with nothing before it stays in the path, or goes if `drop_at_root`.
    """
    segments = F.split(path, "/", -1)

    def step(kept: Column, segment: Column) -> Column:
        can_pop = (F.size(kept) > 1) & (F.element_at(kept, -1) != "..")
        popped = F.slice(kept, F.lit(1), F.size(kept) - 1)
        stuck = kept if drop_at_root else F.concat(kept, F.array(segment))
        return (
            F.when(segment == ".", kept)
            .when((segment == "..") & can_pop, popped)
            .when(segment == "..", stuck)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_on_dots = path.rlike(r"/\.\.?\z") & (F.element_at(folded, -1) != "..")
    joined = F.array_join(F.when(ends_on_dots, F.concat(folded, F.array(F.lit(""))))
                          .otherwise(folded), "/")
    return F.when(F.contains(path, F.lit("/.")), joined).otherwise(path)


def _assemble(scheme: Column, authority: Column, path: Column, tail: Column) -> Column:
    return F.concat(
        scheme, F.lit(":"),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(F.lit("")),
        path, tail,
    )


def resolve_link(page_url: Column, href: Column, rfc3986: bool = False) -> Column:
    """The absolute form of `href` on a page, null where it has an unknown scheme.

    By default the base is the page URL cut before its last slash. As the base then ends without
    a slash, a relative target loses one more segment, and a `..` that has nothing to remove
    stays. `rfc3986` resolves by the standard instead.
    """
    spec = F.regexp_replace(href, r"^[\x00- ]+|[\x00- ]+\z", "")
    base = page_url if rfc3986 else F.regexp_replace(page_url, r"/[^/]*\z", "")
    base_scheme, base_auth = F.lower(_part(base, 1)), _part(base, 2)
    base_path = _part(base, 3)
    scheme, auth, path = F.lower(_part(spec, 1)), _part(spec, 2), _part(spec, 3)
    query, fragment = _part(spec, 4), _part(spec, 5)
    tail = F.concat(query, fragment)

    absolute = (scheme != "") & ((scheme != base_scheme) | (auth != ""))
    hierarchical = scheme.isin("http", "https", "ftp", "file")
    folder = F.regexp_replace(base_path, r"[^/]*\z", "")
    folder = F.when((folder == "") & (base_auth != ""), F.lit("/")).otherwise(folder)
    if rfc3986:
        query_only_path = base_path
        same_page = F.when(fragment != "", fragment).otherwise(F.lit(""))
    else:
        query_only_path = F.concat(F.regexp_replace(base_path, r"/?[^/]*\z", ""), F.lit("/"))
        same_page = F.when(fragment != "", fragment).otherwise(_part(base, 5))

    own_path = absolute | (auth != "") | path.startswith("/")
    full_path = F.when(own_path, path).otherwise(F.concat(folder, path))
    resolved = (
        F.when(absolute & ~hierarchical, spec)
        .when(own_path | (path != ""), _assemble(
            F.when(absolute, scheme).otherwise(base_scheme),
            F.when(absolute | (auth != ""), auth).otherwise(base_auth),
            _fold_dots(full_path, rfc3986), tail))
        .when(query != "", _assemble(base_scheme, base_auth, query_only_path, tail))
        .otherwise(_assemble(base_scheme, base_auth, base_path,
                             F.concat(_part(base, 4), same_page)))
    )
    known = (scheme == "") | scheme.isin(*fixed.URL_SCHEMES)
    return F.when(known & is_valid_url(page_url), resolved)


def resolve_metadata_link(page_url: Column, href: Column) -> Column:
    """A leading slash means the page's own host (its port is lost); the rest stays as it is."""
    return F.when(href.startswith("/"), F.concat(site_root(page_url), href)).otherwise(href)


def crawl_form(url: Column) -> Column:
    """The form in which two URLs of one page agree: scheme and host in lower case, without a
    default port and without a fragment."""
    root = F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9.+-]*://[^/?#]*)", 1)
    rest = F.regexp_replace(F.substr(url, F.length(root) + 1), r"(?s)#.*\z", "")
    bare = F.regexp_replace(F.lower(root), r"^(http://.*?):(?:80)?\z", "$1")
    return F.concat(F.regexp_replace(bare, r"^(https://.*?):(?:443)?\z", "$1"), rest)


def on_same_site(url: Column, seed_url: Column, exact_host: bool = False) -> Column:
    """The lower-cased URL begins with the seed's `scheme://host`, or has that very host."""
    if exact_host:
        return F.lower(site_root(url)) == F.lower(site_root(seed_url))
    return F.lower(url).startswith(site_root(seed_url))


def is_media(url: Column) -> Column:
    return F.lower(url).rlike(_MEDIA)


def link_format(url: Column) -> Column:
    """What follows the last dot; the whole URL if it has none."""
    return F.substring_index(url, ".", -1)


def name_component(url: Column) -> Column:
    """File name up to its first dot; null if the URL has no slash."""
    return F.when(F.contains(url, F.lit("/")),
                  F.substring_index(F.substring_index(url, "/", -1), ".", 1))


def metadata_file_name(url: Column) -> Column:
    return F.concat(F.upper(F.sha1(url)), F.lit("_"), name_component(url), F.lit(".txt"))


def ends_with_download_suffix(href: Column) -> Column:
    endings = "|".join(s.replace(".", r"\.") for s in fixed.DOWNLOAD_SUFFIXES)
    return F.lower(href).rlike(f"(?:{endings})\\z")


def contains_download_suffix(href: Column) -> Column:
    """Case counts here."""
    return href.rlike("|".join(s.replace(".", r"\.") for s in fixed.DOWNLOAD_SUFFIXES))
