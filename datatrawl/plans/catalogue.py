"""The tables of the catalogue for one batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datatrawl import fixed, schemas
from datatrawl.functions import urls as u
from datatrawl.operators import links as ln
from datatrawl.operators import metadata as md
from datatrawl.operators.authors import authors
from datatrawl.operators.ids import dense_ids, highest_id
from datatrawl.operators.markup import feature_documents, feature_links
from datatrawl.operators.tree import html_tree
from datatrawl.plans.counts import RunCounts
from datatrawl.plans.extraction import Pass
from datatrawl.plans.inputs import Inputs


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of a catalogue table; the write time is filled in if there is one."""
    if "updated_at" in schemas.CATALOGUE[table]:
        df = df.withColumn("updated_at", F.current_timestamp())
    columns = [part.strip().split(" ") for part in schemas.CATALOGUE[table].split(",")]
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in columns))


def page_extents(features: DataFrame, inputs: Inputs) -> DataFrame:
    """Spatial extents from the metadata page of each page: page_id, extent."""
    wanted = ln.metadata_page(feature_links(features), inputs.link_probes)
    asked = inputs.metadata_docs.join(wanted.select("url").distinct(), "url", "left_semi")
    return wanted.join(md.spatial_extent(asked), "url").select("page_id", "extent").distinct()


def page_authors(features: DataFrame, inputs: Inputs, keep=lambda df: df) -> DataFrame:
    found = authors(feature_documents(features), inputs.gazetteer, inputs.lemmas,
                    lengths=inputs.lengths(), keep=keep)
    return found.select(F.col("doc_id").alias("page_id"), "author", "rank")


def link_files(links: DataFrame, metadata: DataFrame, metadata_docs: DataFrame) -> DataFrame:
    """Links with their metadata: url, id, is_new, metadata_url (kept only if it was fetched)."""
    docs = metadata_docs.select(F.col("url").alias("metadata_url")).distinct()
    fetched = md.metadata_of_new_links(metadata).join(docs, "metadata_url", "left_semi")
    return links.join(fetched.select("url", "metadata_url"), "url", "left")


class Catalogue:
    """The tables of one batch, each worked out when it is asked for.

    `last` may hold the stored tables whose ids go on; without one, ids begin at 1. `keep` is
    applied to what several tables or several steps of one table use: ids of URLs and links,
    and the element tree. Pass `stage` to write these, so that a page is parsed once.
    """

    def __init__(self, found: Pass, inputs: Inputs, last: dict[str, DataFrame] | None = None,
                 match_on: str = "raw",
                 keep: Callable[[DataFrame], DataFrame] = lambda df: df, counts: RunCounts | None = None) -> None:
        self.found, self.inputs, self.last = found, inputs, last or {}
        self.match_on, self.keep, self.counts = match_on, keep, counts

    @cached_property
    def urls(self) -> DataFrame:
        stored = self.found.routed.filter(F.col("outcome") == "store")
        return self.keep(dense_ids(
            stored.select("page_id", "url", "parent_url", "source"), ["url"],
            highest_id(self.inputs.tab_url)))

    @cached_property
    def links(self) -> DataFrame:
        known = self.inputs.tab_links
        links = ln.assign_link_ids(ln.match_known_links(self.found.downloads, known), known)
        return self.keep(self.counts.links(links) if self.counts else links)

    @cached_property
    def filed(self) -> DataFrame:
        """Links with their metadata."""
        pages = self.inputs.pages.join(self.urls.select("page_id"), "page_id", "left_semi")
        nodes = self.keep(html_tree(pages))
        metadata = md.link_metadata(self.found.downloads, nodes, pages, self.match_on)
        return self.keep(link_files(self.links, metadata, self.inputs.metadata_docs))

    def _entities(self, values: DataFrame, table: str, column: str) -> DataFrame:
        """A row per page and value, with an id of its own."""
        page_ids = self.urls.select("page_id", F.col("id").alias("url_id"))
        rows = values.join(page_ids, "page_id").select("url_id", column)
        after = highest_id(self.last[table]) if table in self.last else None
        return dense_ids(rows, ["url_id", column], after)

    def _rows(self, table: str) -> DataFrame:
        features, downloads, inputs = self.found.features, self.found.downloads, self.inputs
        match table:
            case "tab_url":
                return self.urls.withColumn("status", F.lit(fixed.FROM_EXTRACTOR))
            case "tab_abstract":
                return self._entities(features.select("page_id", "abstract"), table, "abstract")
            case "tab_format":
                return self._entities(ln.link_formats(downloads), table, "format")
            case "tab_authors":
                return self._entities(page_authors(features, inputs, self.keep), table, "author")
            case "tab_title":
                titles = features.select("page_id", F.explode_outer("titles").alias("title"))
                return self._entities(titles, table, "title")
            case "tab_spatialextent":
                return self._entities(page_extents(features, inputs), table, "extent")
            case "tab_links":
                name = F.when(F.col("metadata_url").isNotNull(), u.metadata_file_name(F.col("url")))
                return ln.new_links_only(self.filed).withColumn("metadata_file", name)
            case "tab_url_link_map":
                return ln.link_bridge(self.urls, downloads, self.links)
            case "metadata_files":
                return md.save_metadata(self.filed, inputs.metadata_docs)
        raise KeyError(table)

    def table(self, name: str) -> DataFrame:
        return _shaped(self._rows(name), name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schemas.CATALOGUE}
