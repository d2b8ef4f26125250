"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datatrawl import fixed
from datatrawl.checks.fixtures import fixture
from datatrawl.functions import urls as u
from datatrawl.operators import frontier as fr
from datatrawl.operators import links as ln
from datatrawl.operators import markup as mk
from datatrawl.operators import metadata as md
from datatrawl.operators import status as st
from datatrawl.operators import text as tx
from datatrawl.operators import tree as tr
from datatrawl.operators.aliases import org_aliases as org_aliases_of
from datatrawl.operators.authors import authors, publisher_orgs, title_orgs
from datatrawl.operators.overlap import as_b, overlap_join
from datatrawl.operators.url_filter import build_filter, merge_filters
from datatrawl.plans.catalogue import Catalogue
from datatrawl.plans.extraction import extract
from datatrawl.plans.inputs import Inputs
from datatrawl.plans.page_record import page_records
from datatrawl.session import stage
from datatrawl.sources import pages as pg
from datatrawl.sources import search as se
from datatrawl.sources import seeds as sd

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Data:
    """Fixtures by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self._spark, self._sf_dir, name)

    def inputs(self) -> Inputs:
        return Inputs(pages=self.pages_org, link_probes=self.link_probes,
                      metadata_docs=self.metadata_docs, gazetteer=self.org_gazetteer,
                      lemmas=self.lemmas, tab_url=self.stored_urls, tab_links=self.known_links)


def query(function: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    QUERIES[function.__name__] = lambda spark, sf_dir: function(Data(spark, sf_dir))
    return function


# Sources

@query
def seed_urls(d: Data) -> DataFrame:
    return sd.accept_seed_lines(d.seed_lines)


@query
def seed_rejects(d: Data) -> DataFrame:
    return sd.reject_seed_lines(d.seed_lines)


@query
def search_parse(d: Data) -> DataFrame:
    return se.parse_search_payload(d.search_payload).select(
        "response_id", "term", F.size("statuses").cast("bigint").alias("n_statuses"),
        "max_id_str", "result_count", "is_bad")


@query
def search_urls(d: Data) -> DataFrame:
    return se.search_urls(se.parse_search_payload(d.search_payload))


@query
def legacy_search_urls(d: Data) -> DataFrame:
    return se.legacy_search_urls(d.legacy_payload)


@query
def page_scan(d: Data) -> DataFrame:
    return pg.page_scan(d.frontier, d.pages_gis).select(
        "url", "source", "from_queue", "page_id", F.md5("html").alias("html_md5"))


@query
def page_misses(d: Data) -> DataFrame:
    return pg.page_misses(d.frontier, d.pages_gis)


@query
def metadata_doc_scan(d: Data) -> DataFrame:
    wanted = ln.metadata_page(mk.links(d.pages_gis), d.link_probes)
    return pg.metadata_doc_scan(wanted, d.metadata_docs).select("page_id", "url", "xml")


# URLs

@query
def valid_urls(d: Data) -> DataFrame:
    return fr.valid_urls(mk.links(d.pages_gis), "href").select("page_id", "ord", "href")


@query
def resolve_link(d: Data) -> DataFrame:
    return d.hrefs.select("page_id", "href",
                          u.resolve_link(F.col("url"), F.col("href")).alias("resolved"))


@query
def resolve_link_standard(d: Data) -> DataFrame:
    return d.hrefs.select("page_id", "href", u.resolve_link(
        F.col("url"), F.col("href"), rfc3986=True).alias("resolved"))


@query
def resolve_metadata_link(d: Data) -> DataFrame:
    return d.hrefs.select("page_id", "href", u.resolve_metadata_link(
        F.col("url"), F.col("href")).alias("resolved"))


def _linked_targets(d: Data) -> DataFrame:
    return mk.links(d.pages_linked).select(
        "page_id", "ord", F.col("url").alias("seed_url"),
        u.resolve_link(F.col("url"), F.col("href"), rfc3986=True).alias("url"))


@query
def same_site(d: Data) -> DataFrame:
    return fr.same_site(_linked_targets(d))


@query
def not_media(d: Data) -> DataFrame:
    return fr.not_media(mk.links(d.pages_gis).select("page_id", "ord", F.col("href").alias("url")))


def _downloads(d: Data) -> DataFrame:
    return ln.download_links(mk.links(d.pages_gis), d.link_probes)


@query
def link_formats(d: Data) -> DataFrame:
    return ln.link_formats(_downloads(d))


@query
def name_component(d: Data) -> DataFrame:
    return d.hrefs.select("page_id", "href", u.name_component(F.col("href")).alias("name"))


@query
def metadata_file_name(d: Data) -> DataFrame:
    return d.pages.select("page_id", u.metadata_file_name(F.col("url")).alias("file_name"))


@query
def expand_urls(d: Data) -> DataFrame:
    return se.expand_urls(se.search_urls(se.parse_search_payload(d.search_payload)), d.redirects)


@query
def search_cursor(d: Data) -> DataFrame:
    return se.search_cursor(se.parse_search_payload(d.search_payload))


@query
def search_request_plan(d: Data) -> DataFrame:
    return se.search_request_plan(search_cursor(d).withColumn(
        "term", F.concat(F.lit("#"), "term", F.lit(" #data"))))


@query
def number_in_range(d: Data) -> DataFrame:
    return md.number_in_range(md.xml_elements(d.metadata_nested)).select(
        "url", "node_id", "content")


# Markup

@query
def html_nodes_flat(d: Data) -> DataFrame:
    return mk.html_nodes(d.pages).select(
        "page_id", "node_id", "tag", F.col("attrs")["href"].alias("href"),
        F.col("attrs")["class"].alias("class"))


@query
def links(d: Data) -> DataFrame:
    return mk.links(d.pages_gis)


@query
def titles(d: Data) -> DataFrame:
    return mk.titles(d.pages_gis)


@query
def abstract(d: Data) -> DataFrame:
    return mk.abstracts(d.pages)


@query
def page_documents(d: Data) -> DataFrame:
    return mk.page_documents(d.pages_org).select(
        "doc_id", F.md5("text").alias("text_md5"), "title_start", "title_end")


@query
def html_tree(d: Data) -> DataFrame:
    return tr.html_tree(d.pages_gis).select(
        "page_id", "node_id", "parent_id", "last_id", "tag", "start", "end")


@query
def nodes_containing(d: Data) -> DataFrame:
    return tr.nodes_containing(tr.html_tree(d.pages_gis), "metadata")


@query
def scope_nodes(d: Data) -> DataFrame:
    nodes = stage(tr.html_tree(d.pages_gis))
    downloads = nodes.filter(u.ends_with_download_suffix(F.col("attrs")["href"]))
    return tr.scope_nodes(nodes, downloads)


# Text

@query
def tokens(d: Data) -> DataFrame:
    return tx.tokens(d.documents)


@query
def sentences(d: Data) -> DataFrame:
    return tx.sentences(d.documents).withColumn("sentence", F.md5("sentence"))


@query
def token_roots(d: Data) -> DataFrame:
    return tx.token_roots(tx.tokens(d.documents), d.lemmas)


@query
def gazetteer_lookup(d: Data) -> DataFrame:
    return tx.gazetteer_lookup(d.documents, d.gazetteer)


@query
def format_mentions(d: Data) -> DataFrame:
    return tx.format_mentions(tx.gazetteer_lookup(d.documents, d.gazetteer))


@query
def organizations(d: Data) -> DataFrame:
    return tx.organizations(d.org_docs, d.org_gazetteer)


@query
def org_aliases(d: Data) -> DataFrame:
    return org_aliases_of(tx.organizations(d.alias_docs, d.alias_gazetteer))


@query
def overlap(d: Data) -> DataFrame:
    orgs = tx.organizations(d.org_docs, d.org_gazetteer)
    spans = tx.sentences(d.org_docs).select("doc_id", "start", "end")
    return overlap_join(spans, as_b(orgs, "text"))


QUERIES["overlap_join"] = QUERIES.pop("overlap")


@query
def publishers(d: Data) -> DataFrame:
    return publisher_orgs(
        tx.sentences(d.org_docs), tx.token_roots(tx.tokens(d.org_docs), d.lemmas, fixed.PUBLISH_ROOTS),
        tx.organizations(d.org_docs, d.org_gazetteer))


QUERIES["publisher_orgs"] = QUERIES.pop("publishers")


@query
def in_titles(d: Data) -> DataFrame:
    docs = mk.page_documents(d.pages_org)
    return title_orgs(docs, tx.organizations(docs, d.org_gazetteer))


QUERIES["title_orgs"] = QUERIES.pop("in_titles")


@query
def page_authors(d: Data) -> DataFrame:
    return authors(mk.page_documents(d.pages_org), d.org_gazetteer, d.lemmas, keep=stage)


QUERIES["authors"] = QUERIES.pop("page_authors")


# Links

@query
def download_links(d: Data) -> DataFrame:
    return _downloads(d)


@query
def metadata_page(d: Data) -> DataFrame:
    return ln.metadata_page(mk.links(d.pages_gis), d.link_probes)


@query
def match_known_links(d: Data) -> DataFrame:
    return ln.match_known_links(_downloads(d), d.known_links)


@query
def assign_link_ids(d: Data) -> DataFrame:
    return ln.assign_link_ids(match_known_links(d), d.known_links)


@query
def link_bridge(d: Data) -> DataFrame:
    page_urls = d.pages.select("page_id", (F.col("page_id") + 1).alias("id"))
    return ln.link_bridge(page_urls, _downloads(d), assign_link_ids(d))


def _link_metadata(d: Data, match_on: str) -> DataFrame:
    pages = d.pages_gis
    return md.link_metadata(_downloads(d), stage(tr.html_tree(pages)), pages, match_on)


@query
def link_metadata_flat(d: Data) -> DataFrame:
    return _link_metadata(d, "resolved")


@query
def link_metadata_raw(d: Data) -> DataFrame:
    return _link_metadata(d, "raw")


@query
def spatial_groups(d: Data) -> DataFrame:
    return md.spatial_groups(md.xml_elements(d.metadata_nested).select(
        F.col("url").alias("doc_id"), F.col("node_id").alias("id")))


@query
def spatial_extent(d: Data) -> DataFrame:
    return md.spatial_extent(d.metadata_nested)


# Frontier

@query
def known_urls_anti(d: Data) -> DataFrame:
    return fr.known_urls_anti(d.frontier, d.stored_urls)


@query
def known_urls_filtered(d: Data) -> DataFrame:
    """By the merged filters of two parts of what is stored."""
    parts = [build_filter(d.stored_urls.filter(F.col("id") % 2 == k)) for k in (0, 1)]
    return fr.known_urls_anti(d.frontier, d.stored_urls, merge_filters(parts[0].unionByName(parts[1])))


@query
def union_frontier(d: Data) -> DataFrame:
    return fr.union_frontier(seed_urls(d), search_urls(d), legacy_search_urls(d))


@query
def dedupe_batch(d: Data) -> DataFrame:
    return fr.first_per_url(union_frontier(d))


@query
def expand_one_hop(d: Data) -> DataFrame:
    seeds = pg.page_scan(d.frontier.filter("from_queue"), d.pages_linked)
    return fr.expand_one_hop(seeds, mk.links(d.pages_linked), d.pages_linked)


@query
def expand_three_hops(d: Data) -> DataFrame:
    seeds = pg.page_scan(d.frontier.filter("from_queue"), d.pages_linked)
    return fr.expand(seeds, mk.links(d.pages_linked), d.pages_linked, depth=3)


@query
def route(d: Data) -> DataFrame:
    return fr.route(fr.first_per_url(d.frontier), d.stored_urls, d.pages_gis, _downloads(d))


@query
def run_counts(d: Data) -> DataFrame:
    return ln.run_counts(match_known_links(d), route(d))


# Status

@query
def check_urls(d: Data) -> DataFrame:
    return st.check_urls(d.url_status, d.probes)


@query
def next_status(d: Data) -> DataFrame:
    return st.next_status(check_urls(d))


@query
def apply_status(d: Data) -> DataFrame:
    return st.apply_status(d.url_status, next_status(d))


# Catalogue

def _table(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Data(spark, sf_dir)
        inputs = d.inputs()
        batch = Catalogue(extract(d.frontier, inputs), inputs, keep=stage)
        return batch.table(name).drop("updated_at")
    QUERIES[name] = run


for _name in ("tab_url", "tab_abstract", "tab_format", "tab_authors", "tab_title",
              "tab_spatialextent", "tab_links", "tab_url_link_map"):
    _table(_name)


@query
def metadata_files(d: Data) -> DataFrame:
    metadata = md.metadata_of_new_links(link_metadata_flat(d))
    return md.save_metadata(metadata, d.metadata_docs)


@query
def page_record(d: Data) -> DataFrame:
    records = page_records(d.pages_org, d.inputs(), keep=stage)
    sets = ("titles", "authors", "formats", "links", "extents")
    return records.select("page_id", "url", "abstract",
                          *(F.array_join(s, "|").alias(s) for s in sets))
