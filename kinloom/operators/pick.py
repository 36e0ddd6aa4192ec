"""Choosing one row a key, and lookups by keys tried in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.scratch import Workspace


def pick(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first row of each key in the order, or the last. An aggregation with partial results, not a sort of each key;
    give a total order for a defined result."""
    rest = [c for c in df.columns if c not in keys]
    best = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))
    return df.groupBy(*keys).agg((F.max if last else F.min)(best).alias("best")).select(*keys, *[F.col(f"best.row.{c}").alias(c) for c in rest])


def prioritised_lookup(asked: DataFrame, table: DataFrame, variants: Column, table_key: Column, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """asked, alike rows once, with the columns of the table's row that its first matching variant finds; null without.

    variants is an array of keys in order of preference, table_key an expression over the table, which holds each key once;
    extra are further (asked, table) columns that must be equal. A row is known by its own values, not by a number, so a stage that is computed
    again cannot mix rows up.
    """
    names = [c for c in table.columns]
    tried = asked.select(F.xxhash64(*asked.columns).alias("_row"), F.struct(*asked.columns).alias("_asked"), *[F.col(a).alias(f"_x{i}") for i, (a, _) in enumerate(extra or [])], F.posexplode_outer(variants).alias("_pos", "_key"))
    found = table.select(F.struct(*names).alias("_found"), table_key.alias("_tkey"), *[F.col(t).alias(f"_y{i}") for i, (_, t) in enumerate(extra or [])])
    on = tried["_key"] == found["_tkey"]
    for i in range(len(extra or [])):
        on = on & (tried[f"_x{i}"] == found[f"_y{i}"])
    hit = tried.join(found, on, "left")
    best = hit.groupBy("_row", "_asked").agg(F.min(F.when(F.col("_found").isNotNull(), F.struct("_pos", "_found"))).alias("_best"))
    return best.select("_asked.*", *[F.col(f"_best._found.{n}").alias(n if n not in asked.columns else f"{n}_found") for n in names])


def ranked(df: DataFrame, order: list[str], workspace: Workspace, name: str) -> DataFrame:
    """df with `rank`, the place of each row in a total order, from 1.

    Rows are dealt by range and ranked inside each part; the parts' sizes, one row a part, give the offsets. No task ranks all. The
    dealt rows are written, as places are taken from where a row stands.
    """
    dealt = workspace.write(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("_seq", 33), F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    below = sizes.alias("x").join(F.broadcast(sizes.select(F.col("_part").alias("_p2"), F.col("_n").alias("_n2"))), F.col("_p2") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_n2"), F.lit(0)).alias("_offset"))
    return dealt.withColumn("_part", part).join(F.broadcast(below), "_part").withColumn("rank", F.col("_offset") + inside + 1).drop("_part", "_seq", "_offset")
