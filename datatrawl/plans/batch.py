"""One batch from frontier to committed tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from datatrawl.plans.catalogue import Catalogue
from datatrawl.plans.counts import RunCounts
from datatrawl.plans.extraction import extract
from datatrawl.plans.inputs import Inputs
from datatrawl.plans.store import Store
from datatrawl.session import stage


def run_batch(store: Store, batch_id: int, frontier: DataFrame, inputs: Inputs,
              match_on: str = "raw") -> bool:
    """Extract and store; false if the batch is there already.

    Known URLs and ids come from the store. Intermediate tables are written to the checkpoint
    folder, as the nine tables would otherwise each read the pages again.
    """
    if store.is_committed(batch_id):
        return False
    last = {name: store.table(name, batch_id) for name in (
        "tab_abstract", "tab_format", "tab_authors", "tab_title", "tab_spatialextent")}
    inputs = replace(inputs, tab_url=store.table("tab_url", batch_id).drop("batch_id"),
                     tab_links=store.table("tab_links", batch_id).drop("batch_id"),
                     url_filter=store.url_filter())
    counts = RunCounts()
    batch = Catalogue(extract(frontier, inputs, counts=counts), inputs, last, match_on, keep=stage, counts=counts)
    return store.commit_batch(batch_id, batch.tables(), counts)
