"""From frontier to the pages worth storing, in two passes at most."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datatrawl.operators import frontier as fr
from datatrawl.operators.links import download_links
from datatrawl.operators.markup import feature_links, page_features
from datatrawl.plans.counts import RunCounts
from datatrawl.plans.inputs import Inputs
from datatrawl.session import stage
from datatrawl.sources.pages import page_scan


def _as_is(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Pass:
    """routed(frontier columns, page_id, outcome), page features, data links (page_id, url)."""

    routed: DataFrame
    features: DataFrame
    downloads: DataFrame


def one_pass(frontier: DataFrame, inputs: Inputs, keep=_as_is, counts: RunCounts | None = None) -> Pass:
    """Known URLs go first, then pages are read once, and the route is decided by data links.

    No language work is done here, so pages that are dropped or expanded cost none.
    `keep` is applied where a result is used more than once; pass `stage` to write it.
    """
    rows = fr.first_per_url(frontier)
    unknown = fr.known_urls_anti(rows, inputs.tab_url, inputs.url_filter)
    fetched = page_scan(unknown.select("url"), inputs.pages)
    features = keep(page_features(fetched))
    downloads = keep(download_links(feature_links(features), inputs.link_probes))
    routed = fr.route(rows, inputs.tab_url, features, downloads)
    routed = keep(counts.routed(routed) if counts else routed)
    return Pass(routed, features, downloads)


def extract(frontier: DataFrame, inputs: Inputs, staged: bool = True, counts: RunCounts | None = None) -> Pass:
    """Both passes: the frontier, then the sub-pages of collector URLs without data links.

    The depth is one, so this is a fixed plan and no loop. `routed` holds all decisions,
    features and data links those of pages that are stored. `counts` watches `routed`, if staged.
    """
    keep = stage if staged else _as_is
    first = one_pass(frontier, inputs, keep, counts)
    seeds = first.routed.filter(F.col("outcome") == "expand")
    seed_links = feature_links(first.features.join(
        seeds.select("page_id"), "page_id", "left_semi"))
    sub_pages = fr.expand_one_hop(seeds, seed_links, inputs.pages, keep=keep)
    fresh = sub_pages.join(frontier.select("url").distinct(), "url", "left_anti")
    second = one_pass(fresh.select(*sub_pages.columns), inputs, keep, counts)
    routed = first.routed.unionByName(second.routed)
    stored = routed.filter(F.col("outcome") == "store").select("page_id")
    features = first.features.unionByName(second.features).join(stored, "page_id", "left_semi")
    downloads = first.downloads.unionByName(second.downloads).join(stored, "page_id", "left_semi")
    return Pass(routed, features, downloads)
