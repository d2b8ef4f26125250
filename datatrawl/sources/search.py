"""Search responses (JSON) as frontier rows, and the state of each search term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datatrawl import fixed, schemas
from datatrawl.session import stage
from datatrawl.sources.seeds import as_frontier

_NO_STATUS = 2**63 - 1


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return df.filter(F.col("payload").isNotNull()).withColumn(
        "_json", F.from_json("payload", schema, options))


def parse_search_payload(responses: DataFrame) -> DataFrame:
    """response_id, term, statuses, max_id_str, result_count, is_bad. Null responses are no rows."""
    parsed = _parsed(responses, schemas.SEARCH_PAYLOAD)
    body = F.col("_json")
    bad = (body["_bad"].isNotNull() | body["statuses"].isNull()
           | body["search_metadata"].isNull())
    return parsed.select(
        "response_id", "term", body["statuses"].alias("statuses"),
        body["search_metadata"]["max_id_str"].alias("max_id_str"),
        body["search_metadata"]["count"].alias("result_count"), bad.alias("is_bad"))


def _expanded_urls(df: DataFrame, groups: Column) -> DataFrame:
    urls = F.flatten(F.transform(groups, lambda s: F.coalesce(
        F.transform(s["entities"]["urls"], lambda u: u["expanded_url"]),
        F.array().cast("array<string>"))))
    rows = df.select("response_id", F.explode_outer(urls).alias("url"))
    return as_frontier(rows.filter(F.col("url") != ""), F.col("url"), fixed.SOURCE_SOCIAL,
                       "response_id")


def search_urls(parsed: DataFrame) -> DataFrame:
    """Every non-empty URL of every status of the good responses."""
    return _expanded_urls(parsed.filter(~F.col("is_bad")), F.col("statuses"))


def legacy_search_urls(responses: DataFrame) -> DataFrame:
    """The same for the old response shape, `results` in place of `statuses`."""
    return _expanded_urls(_parsed(responses, schemas.LEGACY_PAYLOAD), F.col("_json.results"))


def expand_urls(frontier: DataFrame, redirects: DataFrame) -> DataFrame:
    """Follow one redirect: url becomes its location, if it has one; of several the first in order."""
    # Written, so that the join shuffles both sides and a short URL of many rows is split.
    known = stage(redirects.filter(F.col("location").isNotNull()).groupBy("url").agg(
        F.min("location").alias("location")))
    expanded = frontier.join(known, "url", "left")
    return expanded.withColumn("url", F.coalesce("location", "url")).select(*frontier.columns)


def response_cursors(parsed: DataFrame) -> DataFrame:
    """What each good response makes of its term: term, response_id, since_id, max_id, last_count."""
    ids = F.transform("statuses", lambda s: s["id_str"].cast("bigint"))
    return parsed.filter(~F.col("is_bad")).select(
        "term", "response_id", F.col("max_id_str").cast("bigint").alias("since_id"),
        (F.coalesce(F.array_min(ids), F.lit(_NO_STATUS)) - 1).alias("max_id"),
        F.col("result_count").alias("last_count"))


def search_cursor(parsed: DataFrame) -> DataFrame:
    """State of each term after its newest response: since_id, max_id, last_count."""
    state = F.struct("since_id", "max_id", "last_count")
    newest = response_cursors(parsed).groupBy("term").agg(F.max_by(state, "response_id").alias("s"))
    return newest.select("term", "s.since_id", "s.max_id", "s.last_count")


def search_request_plan(cursors: DataFrame, count: int = fixed.SEARCH_COUNT,
                        lang: str = fixed.SEARCH_LANGUAGE,
                        result_type: str = fixed.SEARCH_RESULT_TYPE) -> DataFrame:
    """Parameters of the next request of each term.

    A short last page asks for what is newer, a full one for what is older.
    """
    newer = (F.col("since_id") > 0) & (F.col("last_count") < count)
    older = (F.col("max_id") > 0) & (F.col("last_count") >= count)
    return cursors.select(
        "term", F.url_encode("term").alias("q"), F.lit(count).alias("page_size"),
        F.lit(lang).alias("lang"), F.lit(result_type).alias("result_type"),
        F.when(newer, F.col("since_id")).alias("since_id"),
        F.when(older, F.col("max_id")).alias("max_id"))
