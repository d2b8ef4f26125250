"""What one batch works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Inputs:
    """Fetched content, dictionaries, and what the catalogue holds so far.

    pages(page_id, url, html), link_probes(url, content_type), metadata_docs(url, xml),
    gazetteer(phrase, major_type), lemmas(form, root), tab_url(url, id, ...),
    tab_links(id, url, ...). `phrase_lengths` ends the look-up of phrases after the longest one;
    `url_filter` tells which URLs `tab_url` surely lacks.
    """

    pages: DataFrame
    link_probes: DataFrame
    metadata_docs: DataFrame
    gazetteer: DataFrame
    lemmas: DataFrame
    tab_url: DataFrame
    tab_links: DataFrame
    phrase_lengths: tuple[int, ...] | None = None
    url_filter: DataFrame | None = None

    def lengths(self) -> list[int] | None:
        return None if self.phrase_lengths is None else list(self.phrase_lengths)
