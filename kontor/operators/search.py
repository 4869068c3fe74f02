"""Contact name search: an inverted token index over contact names.

The data model keeps a full-text index on contact names. Here the index is a
Spark job: lower-case, take the words (letters, marks and digits of any
script), drop English stop words, ``explode``. Scripts written without spaces
(Han, Hiragana, Katakana) are indexed by their single characters and pairs of
neighbouring ones, and a query's run of them is looked up by its pairs, so a
name is found by any part of it. A query intersects the postings of its tokens,
the rarest first. Stemming is not reproduced (Spark SQL has no English
stemmer), so "services" does not match "service"; accents count, so "Muller"
does not match "M\u00fcller".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: English stop words dropped before indexing ------------------------------
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its",
    "of", "on", "or", "that", "the", "to", "was", "were", "will", "with",
]

UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
RUNS = UNSPACED + r"+|[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"


def tokens(text: Column, query: bool = False) -> Column:
    """Distinct tokens of a text; of a run without spaces the pairs, and for the index the single characters too."""
    def of_run(run):
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        single = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)))
        many = F.length(run) > 1
        parts = F.when(many, pairs).otherwise(single) if query else F.when(many, F.concat(pairs, single)).otherwise(single)
        return F.when(run.rlike("^" + UNSPACED), parts).otherwise(F.array(run))

    runs = F.regexp_extract_all(F.lower(text), F.lit(RUNS), F.lit(0))
    found = F.array_distinct(F.flatten(F.transform(runs, of_run)))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def name_tokens(contacts: DataFrame, name_col: str = "name") -> DataFrame:
    """Postings: (contact id, token) for every distinct indexed token of a name."""
    return contacts.select(F.col("id").alias("contact_id"), F.explode(tokens(F.col(name_col))).alias("token"))


def build_name_index(contacts: DataFrame) -> DataFrame:
    """token -> number of contacts (the postings stay as rows, not one array per token,
    so a very common token never becomes one oversized value)."""
    return name_tokens(contacts).groupBy("token").agg(F.count(F.lit(1)).alias("contacts"))


def search_contacts(contacts: DataFrame, query: str, postings: DataFrame | None = None) -> DataFrame:
    """Contacts whose name contains every indexed token of ``query``.

    ``postings`` may be a stored ``name_tokens`` table (written sorted by token,
    a lookup reads only the files that hold it). One small job counts the
    query's tokens; their postings are then intersected from the rarest on, so
    a common word only tests what the rare ones left.
    """
    postings = name_tokens(contacts) if postings is None else postings
    wanted = [t for r in contacts.sparkSession.range(1).select(tokens(F.lit(query), query=True).alias("t")).collect()
              for t in r["t"]]
    if not wanted:
        return contacts.limit(0)
    sizes = {r["token"]: r["n"] for r in postings.where(F.col("token").isin(*wanted)).groupBy("token")
             .agg(F.count("*").alias("n")).collect()}  # a row a token of the query
    if len(sizes) < len(wanted):
        return contacts.limit(0)
    first, *others = sorted(wanted, key=lambda t: (sizes[t], t))
    hits = postings.where(F.col("token") == first).select("contact_id")
    for token in others:
        hits = hits.join(postings.where(F.col("token") == token).select("contact_id"), "contact_id", "left_semi")
    return contacts.join(hits.select(F.col("contact_id").alias("id")), "id", "left_semi")
