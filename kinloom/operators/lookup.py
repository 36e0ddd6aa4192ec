"""Lookups that reach few rows of a stored table: keys by Bloom filters, parts of identifiers by trigrams.

A table that is looked up by a key holds that key as a plain column, in lower case where case does not matter, as only plain columns are filters of a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.spread import spread

#: Spark hands the scan lists of at most so many values as they are; longer ones it would turn into a range.
VALUES = 10
#: So many of a query's trigrams, the rarest, are looked up; ids that have them are compared as a whole.
RAREST = 3
#: Ids of a task that lists them under their trigrams, some ten rows each.
IDS = 200_000


def keyed(df: DataFrame, id_col: str = "gene_id", key: str = "gene_key") -> DataFrame:
    """df with its id in lower case as a column of its own."""
    return df.withColumn(key, F.lower(id_col))


def among(column: str, values: list[str]) -> Column:
    """Whether the column is one of a few values, as filters that reach the scan's statistics and Bloom filters."""
    values, out = list(dict.fromkeys(values)), F.lit(False)
    for i in range(0, len(values), VALUES):
        out = out | F.col(column).isin(*values[i : i + VALUES])
    return out


def rows_of(table: DataFrame, asked: DataFrame, variants: Column, column: str) -> DataFrame:
    """The rows of a stored table that any variant of the asked keys names. asked is a request, whose size is guarded; its keys become filters of the scan."""
    keys = [r.k for r in asked.select(F.explode(variants).alias("k")).filter("k IS NOT NULL").distinct().collect()]
    return table.filter(among(column, keys)) if keys else table.limit(0)


def postings(ids: DataFrame, id_col: str = "gene_id") -> DataFrame:
    """(term, id): each distinct id under its trigrams.

    Ids are dealt before they are listed, so that they move and not their trigrams, and sorted by term where they are: a file of an index has a part of the ids, and a
    lookup reads the pages of its terms in each. Ranges of terms would list all ids twice, as their bounds are taken from a run over the lists.
    """
    each = spread(ids.select(id_col).filter(F.col(id_col).isNotNull()), id_col, of=ids, rows=IDS).distinct()
    # in order of id first: short to sort, and then lists need the order of terms only
    low = each.sortWithinPartitions(id_col).select(id_col, F.lower(id_col).alias("_low"))
    at = low.filter(F.length("_low") >= 3).select(id_col, "_low", F.explode(F.sequence(F.lit(1), F.length("_low") - 2)).alias("_at"))
    term = F.substring("_low", F.col("_at"), F.lit(3))
    # a trigram that comes again is listed where it stands first
    return at.select(term.alias("term"), id_col, "_low", "_at").filter(F.expr("locate(term, _low) = _at")).select("term", id_col)


def frequencies(posts: DataFrame) -> DataFrame:
    """(term, df): how many ids have a trigram."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def containing(posts: DataFrame, terms: DataFrame, part: str, id_col: str = "gene_id") -> DataFrame:
    """Ids that contain a part of three characters or more, in any case, from stored postings and frequencies.

    The frequencies of the part's trigrams, a row for each, tell the rarest; only their postings are read and intersected, and what has them all is compared
    with the part. A trigram that no id has ends the search.
    """
    q = part.lower()
    asked = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    if not asked:
        raise ValueError("a part of fewer than three characters has no trigram")
    df = {r.term: r.df for r in terms.filter(among("term", asked)).collect()}
    if len(df) < len(asked):
        return posts.select(id_col).limit(0)
    rare = sorted(asked, key=lambda t: (df[t], t))[:RAREST]
    met = posts.filter(among("term", rare)).groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col("n") == len(rare))
    return met.filter(F.contains(F.lower(id_col), F.lit(q))).select(id_col)


def search(genes: DataFrame, posts: DataFrame, terms: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """Genes (gene_id, gene_key, ...) whose id equals the query, in any case; only if there is none, those that contain it. By id, the first `limit`.

    Equality is a filter on the stored key. Parts of fewer than three characters have no trigrams, and are looked for in all ids.
    """
    exact = genes.filter(F.col("gene_key") == query.lower())
    if not exact.isEmpty():
        return exact.orderBy("gene_id").limit(limit)
    return matching(genes, posts, terms, query, limit)


def matching(genes: DataFrame, posts: DataFrame, terms: DataFrame, part: str, limit: int) -> DataFrame:
    """Genes whose id contains the part, by id, the first `limit`: their ids are the answer's size, and are filters of the scan of genes."""
    if len(part) < 3:
        return genes.filter(F.contains("gene_key", F.lit(part.lower()))).orderBy("gene_id").limit(limit)
    ids = [r.gene_id for r in containing(posts, terms, part).orderBy("gene_id").limit(limit).collect()]
    return genes.filter(among("gene_id", ids)).orderBy("gene_id").limit(limit) if ids else genes.limit(0)


def suggestions(genes: DataFrame, posts: DataFrame, terms: DataFrame, part: str, limit: int = 15) -> DataFrame:
    """As matching; nothing for fewer than three characters."""
    return matching(genes, posts, terms, part, limit) if len(part) >= 3 else genes.limit(0)
