"""Metadata of data links: which document belongs to a link, its file, and spatial extents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datatrawl import fixed
from datatrawl.functions import markup as m
from datatrawl.functions import numbers, urls as u
from datatrawl.operators.overlap import overlap_join
from datatrawl.operators.tree import ancestors_up, nodes_containing

WORD = "metadata"


def _linking(nodes: DataFrame) -> DataFrame:
    """Elements with a target, and the lower-cased name of it (null if it has no slash)."""
    href = F.col("attrs")["href"]
    return nodes.filter(F.map_contains_key("attrs", "href")).select(
        "page_id", "node_id", "parent_id", "last_id", href.alias("href"),
        F.lower(u.name_component(href)).alias("name"))


def _mentions(nodes: DataFrame, linking: DataFrame) -> DataFrame:
    """For each linking element the elements in it that speak of metadata."""
    flagged = nodes_containing(nodes, WORD)
    href = F.coalesce(F.col("attrs")["href"], F.lit(""))
    speaking = nodes.select("page_id", "node_id", href.alias("m_href")).join(
        flagged, ["page_id", "node_id"]).select(
        "page_id", F.col("node_id").alias("m_id"), F.col("node_id").alias("b_start"),
        (F.col("node_id") + 1).alias("b_end"), "m_href",
        F.lower(u.name_component(F.col("m_href"))).alias("m_name"))
    spans = linking.select("page_id", F.col("node_id").alias("l_id"),
                           F.col("node_id").alias("start"), (F.col("last_id") + 1).alias("end"))
    return overlap_join(spans, speaking, "page_id").select(
        "page_id", "l_id", "m_id", "m_href", "m_name")


def _state_at(points: DataFrame, events: DataFrame, keys: list[str], last: str,
              counts: list[str]) -> DataFrame:
    """State of a page at each point: the last `last` so far and running sums of `counts`.

    Both sides have `pos`; one ordered pass per key does it, and no pair is built.
    """
    columns = [*keys, "pos", last, *counts]
    point_fields = [c for c in points.columns if c not in (*keys, "pos")]
    as_events = events.select(*columns, F.lit(None).alias("_point"), F.lit(0).alias("_kind"))
    as_points = points.select(
        *keys, "pos", F.lit(None).alias(last), *(F.lit(0).alias(c) for c in counts),
        F.struct(*point_fields).alias("_point"), F.lit(1).alias("_kind"))
    so_far = Window.partitionBy(*keys).orderBy("pos", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    states = as_points.unionByName(as_events).select(
        *keys, "pos", "_point", F.last(last, ignorenulls=True).over(so_far).alias(last),
        *(F.sum(c).over(so_far).alias(c) for c in counts))
    return states.filter(F.col("_point").isNotNull()).select(
        *keys, "pos", "_point.*", last, *counts)


def link_metadata(downloads: DataFrame, nodes: DataFrame, pages: DataFrame,
                  match_on: str = "raw") -> DataFrame:
    """The metadata target of each data link: page_id, url, metadata_url (null if none).

    An element of the page whose target is the data link opens a scope: all below its
    grandparent. Each linking element of the scope with exactly one element that speaks of
    metadata gives its target; one with none or several gives the target of the first of them
    that has the data link's name. A later linking element replaces an earlier one. A name that
    is needed and missing leaves the data link without metadata. The first element of the page
    that gives anything counts.

    `match_on`: "raw" compares targets as written, so relative ones find nothing; "resolved"
    compares them in absolute form (`pages` has page_id and url for that).
    """
    linking = _linking(nodes)
    if match_on == "resolved":
        targets = linking.join(
            pages.select("page_id", F.col("url").alias("_page_url")), "page_id").withColumn(
            "url", u.resolve_link(F.col("_page_url"), F.col("href"))).drop("_page_url")
    else:
        targets = linking.withColumn("url", F.col("href"))
    elements = targets.join(downloads.select("page_id", "url"), ["page_id", "url"])
    scoped = ancestors_up(elements.select("page_id", "node_id", "url", "name"), nodes, 2)

    mentions = _mentions(nodes, linking)
    per_link = mentions.groupBy("page_id", "l_id").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.when(F.col("m_name").isNull(), F.col("m_id")))
        .alias("nameless"))
    judged = linking.select("page_id", F.col("node_id").alias("l_id"), "href").join(
        per_link, ["page_id", "l_id"], "left")
    several = F.coalesce(F.col("k") > 1, F.lit(False))
    events = judged.select(
        "page_id", F.col("l_id").alias("pos"),
        F.when(F.col("k") == 1, F.struct(F.col("l_id").alias("at"), "href")).alias("single"),
        F.when(F.col("k") == 1, 0).otherwise(1).alias("unsure"),
        (several & F.col("nameless").isNotNull()).cast("int").alias("broken"))

    usable = mentions.join(per_link.filter("k > 1"), ["page_id", "l_id"]).filter(
        F.col("nameless").isNull() | (F.col("m_id") < F.col("nameless")))
    by_name = usable.groupBy("page_id", "l_id", F.col("m_name").alias("name")).agg(
        F.min_by("m_href", "m_id").alias("href"),
        F.max(F.col("nameless").isNotNull().cast("int")).alias("saved"))
    name_events = by_name.select(
        "page_id", "name", F.col("l_id").alias("pos"),
        F.struct(F.col("l_id").alias("at"), "href").alias("match"), "saved")

    edges = scoped.select(
        "page_id", "node_id", "url", "name", "scope_id",
        F.explode(F.array(
            F.struct((F.col("scope_id") - 1).alias("pos"), F.lit(False).alias("is_end")),
            F.struct(F.col("scope_last").alias("pos"), F.lit(True).alias("is_end")))).alias("e")
    ).select("page_id", "node_id", "url", "name", "scope_id", "e.pos", "e.is_end")
    general = _state_at(edges, events, ["page_id"], "single", ["unsure", "broken"])
    named = _state_at(edges.filter(F.col("name").isNotNull()), name_events,
                      ["page_id", "name"], "match", ["saved"])

    def within(column: str):
        return F.sum(F.when(F.col("is_end"), F.col(column)).otherwise(-F.col(column)))

    def last_of(column: str):
        return F.max(F.when(F.col("is_end") & (F.col(column)["at"] >= F.col("scope_id")),
                            F.col(column)))

    key = ["page_id", "node_id", "url"]
    one = general.groupBy(*key).agg(
        F.max("name").alias("name"), last_of("single").alias("single"),
        within("unsure").alias("unsure"), within("broken").alias("broken"))
    two = named.groupBy(*key).agg(
        last_of("match").alias("match"), within("saved").alias("saved"))
    failed = (F.col("name").isNull() & (F.col("unsure") > 0)) | (
        F.col("broken") > F.coalesce("saved", F.lit(0)))
    winner = F.greatest("single", "match")["href"]
    outcomes = one.join(two, key, "left").select(
        *key, failed.alias("failed"), winner.alias("found")).filter("failed or found is not null")
    first = outcomes.groupBy("page_id", "url").agg(
        F.min_by(F.when(~F.col("failed"), F.col("found")), "node_id").alias("metadata_url"))
    return downloads.select("page_id", "url").join(first, ["page_id", "url"], "left")


def metadata_of_new_links(link_metadata_rows: DataFrame) -> DataFrame:
    """One row per link URL: the metadata that its first page gives, or null."""
    return link_metadata_rows.groupBy("url").agg(
        F.min_by("metadata_url", "page_id").alias("metadata_url"))


def save_metadata(link_rows: DataFrame, metadata_docs: DataFrame) -> DataFrame:
    """Lines of the metadata text of each link, under its file name: file_name, line_no, line.

    `link_rows` has url and metadata_url, one row per url. Many links may share one document.
    """
    wanted = link_rows.filter(F.col("metadata_url").isNotNull()).select(
        u.metadata_file_name(F.col("url")).alias("file_name"), "metadata_url")
    docs = metadata_docs.select(F.col("url").alias("metadata_url"), "xml")
    found = wanted.filter(F.col("file_name").isNotNull()).join(docs, "metadata_url")
    lines = F.split(F.regexp_replace("xml", r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)
    return found.select("file_name", F.posexplode(lines).alias("no", "line")).select(
        "file_name", (F.col("no") + 1).alias("line_no"), "line")


def number_in_range(df: DataFrame, column: str = "content") -> DataFrame:
    """Rows whose trimmed text is a number within the range of coordinates."""
    return df.filter(numbers.coordinate(F.col(column)).isNotNull())


def xml_elements(metadata_docs: DataFrame) -> DataFrame:
    """Elements of well-formed XML whose whole text is one piece: url, node_id, tag, content.

    Elements are numbered from 0 in document order. The text of an element is that of its
    descendants too, so a wrapper around one value has that value. A running depth pairs start
    and end tags: at one depth they alternate. Documents are spread before they are cut up, so
    the ordered passes need no shuffle of tags.
    """
    clean = F.regexp_replace("xml", r"(?s)<!--.*?-->|<\?.*?\?>|<![A-Z].*?>", "")
    tags = F.regexp_extract_all(clean, F.lit(r"(<[^>]*>[^<]*)"), 1)
    events = metadata_docs.select("url", "xml").repartition("url").select(
        "url", F.posexplode(tags).alias("pos", "piece"))
    raw = F.regexp_extract("piece", r"^(<[^>]*>)", 1)
    events = events.select(
        "url", "pos", m.tag_name(raw).alias("lower_tag"),
        F.regexp_extract("piece", r"^</?([^\s/>]*)", 1).alias("tag"),
        F.when(raw.startswith("</"), -1).when(raw.endswith("/>"), 0).otherwise(1).alias("step"),
        numbers.trimmed(m.unescape(F.regexp_replace("piece", r"^<[^>]*>", ""))).alias("content"))
    so_far = Window.partitionBy("url").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    has_text = F.col("content") != ""
    walked = events.select(
        "*", (F.sum((F.col("step") >= 0).cast("int")).over(so_far) - 1).alias("node_id"),
        (F.sum("step").over(so_far) + (F.col("step") < 0).cast("int")).alias("depth"),
        F.sum(has_text.cast("int")).over(so_far).alias("n_texts"))
    pieces = walked.filter(has_text).select("url", F.col("n_texts").alias("text_no"), "content")
    at_depth = Window.partitionBy("url", "depth").orderBy("pos")
    # Texts before the element are those counted so far without its own; texts up to its end are
    # those before the end tag.
    before_own = F.col("n_texts") - has_text.cast("int")
    closed = walked.filter(F.col("step") != 0).withColumn(
        "_before", before_own).withColumn("_until", F.lead("_before").over(at_depth))
    single = closed.filter((F.col("step") == 1) & (F.col("_until") - F.col("_before") == 1))
    return single.select("url", "node_id", "tag", (F.col("_before") + 1).alias("text_no")).join(
        pieces, ["url", "text_no"]).select("url", "node_id", "tag", "content")


def spatial_groups(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids that begin a group of four at equal distances; groups may overlap: key, id."""
    in_order = Window.partitionBy(key).orderBy("id")
    nexts = [F.lead("id", n).over(in_order) for n in (1, 2, 3)]
    gaps = [b - a for a, b in zip([F.col("id"), *nexts], nexts)]
    return ids.select(key, "id", *(g.alias(f"_g{i}") for i, g in enumerate(gaps))).filter(
        "_g0 = _g1 and _g1 = _g2").select(key, "id")


def spatial_extent(metadata_docs: DataFrame) -> DataFrame:
    """Distinct groups of four coordinates whose tags name a direction: url, extent."""
    directed = reduce(lambda a, b: a | b, (
        F.contains(F.lower("tag"), F.lit(word)) for word in fixed.DIRECTION_WORDS))
    found = number_in_range(xml_elements(metadata_docs).filter(directed))
    in_order = Window.partitionBy("url").orderBy("node_id")
    entry = F.concat("tag", F.lit(": "), "content")
    ahead = found.select(
        "url", "node_id", entry.alias("_e0"),
        *(F.lead("node_id", n).over(in_order).alias(f"_n{n}") for n in (1, 2, 3)),
        *(F.lead(entry, n).over(in_order).alias(f"_e{n}") for n in (1, 2, 3)))
    even = ahead.filter("_n1 - node_id = _n2 - _n1 and _n2 - _n1 = _n3 - _n2")
    return even.select("url", F.concat_ws(";", "_e0", "_e1", "_e2", "_e3").alias("extent")).distinct()
