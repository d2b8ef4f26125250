"""Tokens, sentences, phrases and organizations of `docs(doc_id, text)`.

Tokenising and the rules for organizations are this engine's own definitions.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datatrawl import fixed
from datatrawl.functions import text as tx
from datatrawl.operators.joins import salted_join
from datatrawl.session import stage


def tokens(docs: DataFrame) -> DataFrame:
    """Runs of letters and digits: doc_id, start, end, token. No shuffle."""
    words = tx.word_rows(tx.text_blocks(docs, tx.WORD_BLOCKS), "start", "end", "word")
    return words.withColumnRenamed("word", "token")


def sentences(docs: DataFrame) -> DataFrame:
    """Sentences with the closing punctuation, quotes and blanks behind them: doc_id, start, end, sentence.

    A full stop doesn't end one behind an abbreviation, an initial or a letter of "e.g." or "U.S.",
    nor within a number or an address.
    """
    blocks = tx.text_blocks(docs, tx.SENTENCE_BLOCKS)
    pieces = F.regexp_extract_all("block", F.lit(f"({tx.SENTENCE_PIECES})"), 1)
    rows = tx.piece_rows(blocks, ["doc_id"], pieces, F.col("block_start"))
    return rows.select(
        "doc_id", F.col("p.start").alias("start"),
        (F.col("p.start") + F.length("p.text")).alias("end"), F.col("p.text").alias("sentence"))


def token_roots(token_rows: DataFrame, lemmas: DataFrame, wanted: Iterable[str] | None = None) -> DataFrame:
    """Add the root of each token: its lemma, else what the rules for endings give, else the token.

    The lemmas are thus the exceptions to the rules. With `wanted`, only the tokens with one of these
    roots: the rules are then tried on no other words than those that may have them.
    """
    # Of several roots of a form the first in order counts.
    forms = lemmas.groupBy(F.lower("form").alias("_form")).agg(F.min("root").alias("root"))
    keyed = token_rows.withColumn("_form", F.lower("token"))
    joined = salted_join(keyed, forms, "_form", "left")
    if wanted is not None:
        wanted = list(wanted)
        by_rules = F.col("_form").isin(tx.forms_by_rules(wanted)) | F.col("token").isin(wanted)
        joined = joined.filter(F.when(F.col("root").isNull(), by_rules).otherwise(F.col("root").isin(wanted)))
    rooted = joined.select(*token_rows.columns, F.coalesce("root", tx.root_by_rules(F.col("token")), "token").alias("root"))
    return rooted if wanted is None else rooted.filter(F.col("root").isin(wanted))


def _blanks_as_one(column: Column) -> Column:
    return F.regexp_replace(column, r"[ \t\r\n\f]+", " ")


def _phrase_key(column: Column) -> Column:
    """From the first to the last word, white space as one blank."""
    return _blanks_as_one(
        F.regexp_replace(column, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", ""))


def _word_count(column: Column | str) -> Column:
    return F.size(F.regexp_extract_all(column, F.lit(r"([\p{L}\p{N}]+)"), 1))


def phrase_lengths(gazetteer: DataFrame) -> list[int]:
    """The word counts that occur in a gazetteer: a handful of integers."""
    counts = gazetteer.select(_word_count("phrase").alias("n")).filter("n > 0").distinct()
    return sorted(row.n for row in counts.collect())


def phrase_trie(gazetteer: DataFrame) -> DataFrame:
    """The gazetteer as a trie by words: `parent`, `piece`, `node`, `word`.

    A node is a prefix of phrases, known by its hash; the root is the empty one. `piece` is the word
    that leads to it with the gap before, white space as one blank.
    """
    key = gazetteer.select(_phrase_key("phrase").alias("phrase")).distinct()
    pieces = F.regexp_extract_all("phrase", F.lit(f"({tx.WORD_PIECES})"), 1)
    steps = key.select(pieces.alias("pieces")).select("pieces", F.posexplode("pieces").alias("i", "piece"))
    upto = lambda n: F.xxhash64(F.array_join(F.slice("pieces", F.lit(1), n), ""))
    return steps.select(upto(F.col("i")).alias("parent"), "piece", upto(F.col("i") + 1).alias("node"),
                        tx.without_leading_gap(F.col("piece")).alias("word")).distinct()


def gazetteer_lookup(docs: DataFrame, gazetteer: DataFrame, lengths: list[int] | None = None,
                     longest_only: bool = True) -> DataFrame:
    """Spans whose words are a phrase of the gazetteer: doc_id, start, end, text, major_type.

    Words must be parted as in the phrase; any white space counts as one blank. Of the phrases
    that begin at one place the longest is kept.

    All places walk the trie of the phrases together, a word in each round, and only those that
    are still on a path go on; so a word costs the same however long the longest phrase is. The
    rounds end when no place is left, or after the last of `lengths` if given.
    """
    trie = stage(phrase_trie(gazetteer))
    root = F.xxhash64(F.lit(""))
    onward = trie.select(F.col("parent").alias("node")).distinct().withColumn("goes_on", F.lit(True))
    edges = trie.filter(F.col("parent") != root).select(F.col("parent").alias("node"), "piece", F.col("node").alias("to")).join(
        onward.withColumnRenamed("node", "to"), "to", "left")
    # Of a word: the node it leads to from the root, whether paths go on from there, and if it stands on other paths.
    leads = stage(trie.join(onward, "node", "left").withColumn("first", F.col("parent") == root).groupBy("word").agg(
        F.max(F.when(F.col("first"), F.col("node"))).alias("node"), F.bool_or(F.col("first") & F.col("goes_on")).alias("goes_on"),
        F.bool_or(~F.col("first")).alias("follows")))
    words = tx.word_rows(tx.text_blocks(docs, tx.WORD_BLOCKS), "begin", "end", "gap", "word")
    # Other words are on no path. A gap of one blank comes as null.
    words = stage(words.join(leads, "word").select(
        "doc_id", "begin", "end", "gap", F.when(F.col("follows"), _blanks_as_one(F.col("gap"))).alias("parted_by"),
        "word", "node", "goes_on", "follows"))
    paths = words.filter("node is not null").select(
        "doc_id", (F.col("end") - F.length("word")).alias("start"), "end", F.col("word").alias("text"), "node", "goes_on")
    step = words.filter("follows").select(
        "doc_id", F.col("begin").alias("end"), F.col("end").alias("next"),
        *(F.concat(F.coalesce(gap, F.lit(" ")), "word").alias(name) for gap, name in (("gap", "more"), ("parted_by", "piece"))))
    most = max(lengths, default=0) if lengths is not None else None
    walked = []
    while most is None or len(walked) < most:
        if walked:
            paths = paths.filter("goes_on").drop("goes_on")
            if paths.isEmpty():
                break
            paths = stage(paths.join(step, ["doc_id", "end"]).join(edges, ["node", "piece"]).select(
                "doc_id", "start", F.col("next").alias("end"), F.concat("text", "more").alias("text"), F.col("to").alias("node"), "goes_on"))
        if paths.isEmpty():
            break
        walked.append(paths)
    spans = reduce(DataFrame.unionByName, walked or [paths.limit(0)])
    # The node that a phrase leads to is its hash.
    phrases = gazetteer.select(F.xxhash64(_phrase_key("phrase")).alias("node"), "major_type").distinct()
    hits = spans.join(phrases, "node").select("doc_id", "start", "end", "text", "major_type")
    if longest_only and len(walked) > 1:
        here = Window.partitionBy("doc_id", "start")
        hits = hits.withColumn("_longest", F.max("end").over(here)).filter(
            F.col("end") == F.col("_longest")).drop("_longest")
    return hits


def format_mentions(lookups: DataFrame, major_type: str = "GISformat") -> DataFrame:
    """Distinct texts of the lookups of one type, per document."""
    return lookups.filter(F.col("major_type") == major_type).select("doc_id", "text").distinct()


def suffix_organizations(docs: DataFrame) -> DataFrame:
    """Capitalised words in a row, up to the last that names a kind of organization.

    A text is cut in runs of two capitalised words or more, parted by one blank, and what lies
    between, so each character is read once however long a run is.
    """
    more = r"[\p{L}\p{N}&'-]*+"
    word = rf"\p{{Lu}}{more}"
    run = rf"{word}(?: {word})++"
    between = rf"(?:(?!{word} \p{{Lu}})[\p{{L}}\p{{N}}]{more}|[^\p{{L}}\p{{N}}]++)++"
    endings = "|".join(fixed.ORGANIZATION_SUFFIXES)
    pieces = F.regexp_extract_all("text", F.lit(f"({run}|{between})"), 1)
    rows = tx.piece_rows(docs, ["doc_id"], pieces, F.lit(0))
    runs = rows.filter(F.col("p.text").rlike(rf"^{word} \p{{Lu}}"))
    named = runs.select("doc_id", F.col("p.start").alias("start"), F.split("p.text", " ").alias("w"))
    last = F.array_max(F.transform("w", lambda word, i: F.when(
        (i > 0) & word.rlike(rf"^(?:{endings})(?![\p{{L}}\p{{N}}])"), i)))
    named = named.select("doc_id", "start", "w", last.alias("last")).filter("last is not null").select(
        "doc_id", "start", F.concat_ws(
            " ", F.slice("w", F.lit(1), F.col("last")),
            F.regexp_extract(F.get("w", F.col("last")), f"^({endings})", 1)).alias("text"))
    return named.select(
        "doc_id", "start", (F.col("start") + F.length("text")).alias("end"), "text")


# What a word is to the grammar of names: Kind, Legal form, one of both with a tail (T), other
# capitalised word (U), of and for, the, and, any other word.
_KIND = "|".join(fixed.ORGANIZATION_KINDS)
_ENDING = "|".join(fixed.ORGANIZATION_SUFFIXES)
WORD_CLASSES = (
    (f"^(?:{_KIND})$", "K"), (f"^(?:{'|'.join(fixed.LEGAL_FORMS)})$", "L"), (rf"^(?:{_ENDING})(?![\p{{L}}\p{{N}}])", "T"),
    (r"^\p{Lu}", "U"), ("^(?:of|for)$", "o"), ("^the$", "t"), ("^(?:and|&)$", "a"), ("", "w"),
)
# First phase: a run of capitalised words up to its last kind or legal form is a name of its own
# (N..E after a kind, N..F after another; alone e, f). Second phase: names go on with "of ...", and
# what is joined to them by "and" belongs to them.
SUFFIXED = "[UKL]*[KLT]|[UKL]+|."
_OF = "ot?(?:N+[EF]|U+(?:aU+)?)"
NAMES = f"(?:(?:U+a)?N+E|e)(?:{_OF})+|(?:U+a)?N+[EF]|U+|."


# No clause goes on over the last character of a block.
_BETWEEN = r"[^\p{L}\p{N}&' -]"
_WITHIN = r"[\p{L}\p{N}&' -]"
CLAUSE_BLOCKS = rf"(?s:.){{0,500}}{_BETWEEN}|{_WITHIN}++(?:{_BETWEEN}|\z)"


def grammar_organizations(docs: DataFrame) -> DataFrame:
    """Names of organizations by a grammar over classes of words: doc_id, start, end, text, inner.

    A clause is a row of words parted by one blank, an "&" between them too. Its words become a
    string of class letters, which the rules above cut in two phases; of the names that begin at a
    word the longest by the rules counts, and the search goes on behind it. `inner` tells that a
    word of the clause stands before the name.
    """
    more = r"[\p{L}\p{N}&'-]*+"
    word = rf"[\p{{L}}\p{{N}}]{more}"
    clause = rf"{word}(?: (?:{word}|&))*+"
    # Every name has a kind or a legal form in it, and most clauses have none. So a text is first cut, at
    # characters that are in no clause, in blocks of some 500 characters, and only those with such a word go on.
    some = rf"(?:^| )(?:{_ENDING})(?![\p{{L}}\p{{N}}])"
    initials = "".join(sorted({w[0] for w in fixed.ORGANIZATION_SUFFIXES}))
    telling = rf"(?=[{initials}])(?<![\p{{L}}\p{{N}}])(?:{_ENDING})(?![\p{{L}}\p{{N}}])"
    blocks = tx.text_blocks(docs, CLAUSE_BLOCKS).filter(F.col("block").rlike(telling)).withColumnRenamed("block", "text")
    pieces = F.regexp_extract_all("text", F.lit(rf"({clause}|[^\p{{L}}\p{{N}}]++)"), 1)
    clauses = tx.piece_rows(blocks, ["doc_id"], pieces, F.col("block_start")).filter(F.col("p.text").rlike(some)).select(
        "doc_id", F.col("p.start").alias("start"), F.split("p.text", " ").alias("w"))

    def letter(w: Column) -> Column:
        out = F.lit(WORD_CLASSES[-1][1])
        for pattern, name in reversed(WORD_CLASSES[:-1]):
            out = F.when(w.rlike(pattern), name).otherwise(out)
        return out

    def suffixed(run: Column) -> Column:
        n, kind = F.length(run), run.endswith("K")
        return F.when(~run.rlike("[KLT]$"), run).when(n == 1, F.when(kind, "e").otherwise("f")).otherwise(
            F.concat(F.repeat(F.lit("N"), n - 1), F.when(kind, "E").otherwise("F")))

    letters = F.array_join(F.transform("w", letter), "")
    phase1 = F.array_join(F.transform(F.regexp_extract_all(letters, F.lit(f"({SUFFIXED})"), 1), suffixed), "")
    # A column of its own, as `starts` names its array several times and would work it out as often.
    spaced = clauses.select("doc_id", "start", "w", F.transform("w", lambda w: F.concat(w, F.lit(" "))).alias("spaced"))
    coded = spaced.select("doc_id", "w", tx.starts(F.col("spaced"), F.col("start")).alias("at"), phase1.alias("codes"))
    cut = tx.with_offsets(coded, ["doc_id", "w", "at"], F.regexp_extract_all("codes", F.lit(f"({NAMES})"), 1), F.lit(0), "names")

    def name(p: Column) -> Column:
        first, n = p["start"].cast("int"), F.length(p["text"])
        last = F.get("w", first + n - 1)
        tail = F.when(last.rlike(rf"^(?:{_ENDING})(?![\p{{L}}\p{{N}}])"), F.regexp_extract(last, f"^({_ENDING})(?![\\p{{L}}\\p{{N}}])", 1)).otherwise(
            F.regexp_replace(last, "(?:'s)?['&-]*$", ""))
        return F.struct(F.get("at", first).alias("start"), (first > 0).alias("inner"), F.concat(
            F.array_join(F.slice("w", first + 1, n - 1), " "), F.lit(" "), tail).alias("text"))

    found = F.transform(F.filter("names", lambda p: p["text"].rlike("[EF]|^eo")), name)
    return cut.select("doc_id", F.explode(found).alias("n")).select(
        "doc_id", "n.start", (F.col("n.start") + F.length("n.text")).alias("end"), "n.text", "n.inner")


def organizations(docs: DataFrame, gazetteer: DataFrame,
                  lengths: list[int] | None = None) -> DataFrame:
    """Organization spans: phrases of that type, and names by the grammar.

    A listed phrase one blank before a name by the grammar is the head of it.
    """
    listed = gazetteer.filter(F.col("major_type") == "organization")
    phrases = gazetteer_lookup(docs, listed, lengths).select("doc_id", "start", "end", "text")
    heads = phrases.groupBy("doc_id", (F.col("end") + 1).alias("start")).agg(
        F.min("start").alias("head_start"), F.min_by("text", "start").alias("head")).withColumn("inner", F.lit(True))
    names = grammar_organizations(docs).join(heads, ["doc_id", "start", "inner"], "left").select(
        "doc_id", F.coalesce("head_start", "start").alias("start"), "end",
        F.coalesce(F.concat("head", F.lit(" "), "text"), "text").alias("text"))
    return phrases.unionByName(names).distinct()
