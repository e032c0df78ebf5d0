"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws ln(u) / weight from a hash of the row's key and the
child's path, and the row descends into the largest draw. A child's draws depend on
nothing but its own path and weight, so changing the weight of one subtree moves rows
only into it or out of it, and a new subtree only takes rows.

The law is `key`: the row's id and the shards alone decide. A tree grows by hanging each
further shard into a region of its own, so rows move only into the new shard.

Edge cases: a null id is a key of its own; a null text has size 1 and the checksum of
the empty text; equal ids always share a shard; repeated rows get slots of their own;
an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAW = "key"
#: Rows that one bucket of a shard holds about, when slots are dealt out.
BUCKET_ROWS = 50_000
#: 13 hexadecimal digits are 52 bits, which a double holds exactly.
HASH_DIGITS = 13


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int = 8, regions: int = 2, racks: int = 2) -> list[Shard]:
    """`shards` of weight 1, dealt in order over regions and, within them, racks."""
    out = []
    for s in range(shards):
        region = s * regions // shards
        first, last = -(-region * shards // regions), -(-(region + 1) * shards // regions)
        out.append(Shard(region, (s - first) * racks // max(1, last - first), s))
    return out


def grown(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The same tree with one more shard, in a region of its own."""
    return [*shards, Shard(max(s.region for s in shards) + 1, 0, max(s.shard for s in shards) + 1, weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{path}|"), key).cast("binary")), 1, HASH_DIGITS)
    unit = (F.conv(digits, 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(2 ** (4 * HASH_DIGITS)))
    return F.log(unit) / F.lit(float(weight))


def _best(key: Column, children: dict[int, tuple[str, float]]) -> Column:
    """The child with the largest draw; between equal draws the larger number wins."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct(_draw(key, path, w).alias("draw"), F.lit(child).alias("child")) for child, (path, w) in children.items()]
    return F.greatest(*draws)["child"]


def _choose(at: Column, cases: dict[int, Column]) -> Column:
    out = None
    for value, then in cases.items():
        out = F.when(at == value, then) if out is None else out.when(at == value, then)
    return out


def place(df: DataFrame, key: Column, shards: list[Shard], out: str) -> DataFrame:
    """Append column `out`: the shard that `key` descends to. One projection per level.

    Only the draws of the chosen subtree are evaluated, so the cost follows the depth
    and the fan-out of the tree, not the number of shards.
    """
    regions: dict[int, dict[int, list[Shard]]] = {}
    for s in shards:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    weight = lambda group: sum(s.weight for s in group)
    top = _best(key, {r: (f"{r}", sum(map(weight, racks.values()))) for r, racks in regions.items()})
    rack = _choose(F.col("_region"), {r: _best(key, {k: (f"{r}/{k}", weight(g)) for k, g in racks.items()}) for r, racks in regions.items()})
    leaf = _choose(
        F.col("_region"),
        {r: _choose(F.col("_rack"), {k: _best(key, {s.shard: (f"{r}/{k}/{s.shard}", s.weight) for s in g}) for k, g in racks.items()}) for r, racks in regions.items()},
    )
    return df.withColumn("_region", top).withColumn("_rack", rack).withColumn(out, leaf).drop("_region", "_rack")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Slots are gapless within a shard without sorting a shard in one task: rows are
    numbered within (shard, bucket) groups of about BUCKET_ROWS rows, and each group
    starts after the sizes of the buckets before it, which come from an aggregate of
    one row per group.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(1)).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    base = tree(n_shards)
    rows = place(place(rows, key, base, "shard"), key, grown(base), "grown_shard")
    n_buckets = max(16, -(-docs.select(id_col).count() // (n_shards * BUCKET_ROWS)))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_buckets)))
    before = (
        rows.groupBy("shard", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .selectExpr("shard", "_bucket", "sum(_n) over (partition by shard order by _bucket) - _n as _before")
    )
    numbered = rows.selectExpr("*", "row_number() over (partition by shard, _bucket order by doc_id, text_crc32, size) - 1 as _at")
    return numbered.join(before, ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("_before") + F.col("_at")).cast("long").alias("slot"), "grown_shard"
    )
