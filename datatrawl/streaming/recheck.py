"""Revisit stored URLs. An outside scheduler runs this every so often."""

from __future__ import annotations

from pyspark.sql import DataFrame

from datatrawl.operators.status import check_urls, next_status
from datatrawl.plans.store import Store


def recheck(store: Store, probes: DataFrame, version: int) -> bool:
    """Compare all stored URLs with their probes and store what changes."""
    changes = next_status(check_urls(store.current_tab_url(), probes))
    return store.commit_status(version, changes)
