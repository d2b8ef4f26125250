"""Names of one organization within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datatrawl import fixed
from datatrawl.session import stage

# Small words that tell no names apart.
FILLERS = ("of", "for", "the", "and")
LEGAL_FORM = f" (?:{'|'.join(form.lower() for form in fixed.LEGAL_FORMS)})$"
# Words that a leading part has at least, and a name that goes by its initials.
LEADING_WORDS, SPELLED_OUT_WORDS = 2, 3


def _leading_parts(nodes: DataFrame) -> DataFrame:
    """doc_id, sense, top: the shortest name that each one is an extension of, if there is one.

    Of the names that lead a name the longest is its head. A head of one extension only is the same
    organization; with several (*Ohio State* of *Ohio State University* and *Ohio State Council*)
    it can't be told whose part it is, and the line of heads ends before it.
    """
    several = nodes.filter(F.size("w") >= LEADING_WORDS)
    # Only parts as long as some name of the document are built.
    lengths = stage(several.groupBy("doc_id").agg(F.collect_set(F.size("w")).alias("lengths")))
    shorter = F.filter("lengths", lambda n: n < F.size("w"))
    parts = several.join(lengths, "doc_id").select("doc_id", "sense", "w", F.explode(shorter).alias("n")).select(
        "doc_id", "sense", "n", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("head"))
    held = stage(parts.join(nodes.select("doc_id", F.col("sense").alias("head")), ["doc_id", "head"]))
    heads = held.groupBy("doc_id", "sense").agg(F.max_by("head", "n").alias("head"))
    extensions = stage(heads.groupBy("doc_id", "head").agg(F.count("*").alias("extensions")))
    line = held.join(extensions, ["doc_id", "head"]).groupBy("doc_id", "sense").agg(
        F.coalesce(F.max(F.when(F.col("extensions") > 1, F.col("n"))), F.lit(0)).alias("open"),
        F.collect_list(F.struct("n", "head")).alias("heads"))
    top = F.array_min(F.filter("heads", lambda h: h["n"] > F.col("open")))["head"]
    return line.select("doc_id", "sense", top.alias("top")).filter("top is not null")


def org_aliases(orgs: DataFrame) -> DataFrame:
    """Names of one organization within a document: doc_id, org_key, name, main_name.

    `org_key` is the name in small letters, with one blank for all that is no letter or digit and
    without a closing legal form. Names of a document are the same organization
    * if their keys agree but for the words *of, for, the, and*;
    * if one leads the other by two words at least, and leads no other (see `_leading_parts`);
    * if one is a word that begins with its key in capitals, and these are the initials of the
      other's three words or more; not if they are those of several names.
    The longest name of a class is its main name, of equally long ones the first in order. Rows
    without a name or a document are left out. Nothing is compared in pairs: each rule is a join on
    what two names share.
    """
    names = orgs.filter("doc_id is not null").select("doc_id", F.col("text").alias("name")).filter(
        "name is not null").distinct()
    bare = F.trim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " "))
    told = F.array_join(F.filter(F.split("org_key", " "), lambda w: ~w.isin(*FILLERS)), " ")
    keyed = stage(names.withColumn("org_key", F.trim(F.regexp_replace(bare, LEGAL_FORM, ""))).withColumn(
        "sense", F.when(told == "", F.col("org_key")).otherwise(told)))
    nodes = keyed.select("doc_id", "sense", F.split("sense", " ").alias("w")).distinct()
    tops = nodes.join(_leading_parts(nodes), ["doc_id", "sense"], "left").select(
        "doc_id", "sense", "w", F.coalesce("top", "sense").alias("class"))
    initials = F.array_join(F.transform("w", lambda w: F.substring(w, 1, 1)), "")
    spelled_out = tops.filter(F.size("w") >= SPELLED_OUT_WORDS).groupBy("doc_id", initials.alias("sense")).agg(
        F.min("class").alias("spelled_out"), F.count("*").alias("n")).filter("n = 1").drop("n")
    one_word = keyed.filter((F.instr("org_key", " ") == 0) & (F.col("org_key") != "")
                            & F.col("name").startswith(F.upper("org_key"))).select("doc_id", "sense").distinct()
    short = one_word.join(spelled_out, ["doc_id", "sense"])
    classes = tops.join(short, ["doc_id", "sense"], "left").select(
        "doc_id", "sense", F.coalesce("spelled_out", "class").alias("class"))
    classed = stage(keyed.join(classes, ["doc_id", "sense"]))
    mains = stage(classed.groupBy("doc_id", "class").agg(
        F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("main_name")))
    return classed.join(mains, ["doc_id", "class"]).select("doc_id", "org_key", "name", "main_name")
