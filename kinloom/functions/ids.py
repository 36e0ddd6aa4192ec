"""Identifier algebra: every join depends on it. All functions are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of cluster ids by species. Fixed values.
CLUSTER_PREFIXES = {"wheat": "Traes_", "barley": "HORVU_", "oat": "Avena_"}


def _group(c: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def canonical_id(c: Column) -> Column:
    """What stands after the first bar, if that is not blank; else the id itself, trimmed."""
    return F.coalesce(_group(c, r"^[^|]*\|\s*(.*\S)\s*$"), F.trim(c))


def id_variants(c: Column) -> Column:
    """Keys to try for a gene id, in order: itself, then without its transcript number, or with number 1 if it has none."""
    bare = F.regexp_replace(c, r"\.\d+$", "")
    return F.array(c, F.when(bare == c, F.concat(c, F.lit(".1"))).otherwise(bare))


def normalised_id(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\.\d+$", ""))


def cluster_id(species: Column, c: Column) -> Column:
    """The cluster id with its species' prefix; ids that have it already, in any case, and blank ones stay. Oat's lose an underscore after `pan`."""
    c = F.trim(c)
    out = c
    for name, prefix in CLUSTER_PREFIXES.items():
        plain = F.regexp_replace(c, "(?i)^pan_", "pan") if name == "oat" else c
        out = F.when((F.lower(F.trim(species)) == name) & (c != "") & ~F.lower(c).startswith(prefix.lower()), F.concat(F.lit(prefix), plain)).otherwise(out)
    return out


def asked_cluster_id(species: Column, c: Column) -> Column:
    """The stored id of a cluster that a user names: one that starts with `pan` loses an underscore after it and gets the species' prefix; others stay."""
    c = F.trim(c)
    bare = F.when(F.lower(F.trim(species)).isin(*CLUSTER_PREFIXES), F.regexp_replace(c, "(?i)^pan_", "pan")).otherwise(c)
    return F.when(F.lower(c).startswith("pan"), cluster_id(species, bare)).otherwise(c)


def species_tab(species: Column) -> Column:
    """The place of a species among the tabs: those with a prefix in their order, then all others (by name, among themselves)."""
    out = F.lit(len(CLUSTER_PREFIXES))
    for k, name in enumerate(CLUSTER_PREFIXES):
        out = F.when(F.lower(species) == name, k).otherwise(out)
    return out


def chromosome(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "(?i)^chr", "")


def subgenome(c: Column) -> Column:
    """The letter A to D beside a chromosome's number; null without."""
    name = F.regexp_replace(F.upper(F.trim(c)), "^CHR", "")
    return F.coalesce(_group(name, r"^\d+([ABCD])$"), _group(name, r"^([ABCD])\d+$"))


def chromosome_group(c: Column) -> Column:
    return _group(c, r"(?i)^(?:chr)?(\d+)[ABCDH]$")


def locus(c: Column) -> Column:
    """Loci of the two model species in one spelling; others trimmed."""
    at = F.upper(F.regexp_extract(c, r"(?i)\b(AT[1-5CM]G\d{5})", 1))
    rice = F.concat(F.regexp_extract(c, r"(?i)\b(Os\d{2})[gt](\d{7})", 1), F.lit("g"), F.regexp_extract(c, r"(?i)\b(Os\d{2})[gt](\d{7})", 2))
    return F.when(at != "", at).when(rice != "g", rice).otherwise(F.trim(c))


def dotted_accession(c: Column) -> Column:
    """The second part of an id of three parts or more, else the id."""
    parts = F.split(c, r"\.")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(c)


def packed_gene(c: Column) -> Column:
    """chr__gene__start__end[__strand] as a struct; null unless there are four or five parts and both places are numbers."""
    p = F.split(c, "__")
    start, end = F.get(p, F.lit(2)).try_cast("long"), F.get(p, F.lit(3)).try_cast("long")
    whole = F.struct(F.get(p, F.lit(0)).alias("chr"), F.get(p, F.lit(1)).alias("gene_id"), start.alias("begin_pos"), end.alias("end_pos"), F.get(p, F.lit(4)).alias("strand"))
    return F.when(F.size(p).between(4, 5) & start.isNotNull() & end.isNotNull(), whole)


def minus(strand: Column) -> Column:
    return F.lower(F.trim(strand)).isin("-", "rev", "reverse", "r", "minus")
