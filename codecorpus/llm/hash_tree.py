"""Sharding by a hierarchical weighted hash tree.

A shard is found by descending region, rack and shard. Each node has a draw of its own at each key: -ln(u) / weight, u a
hash of the key and the node in (0, 1], weight that of its whole subtree. At each level a row goes to the child of the
least draw: children are chosen in proportion to their weights, and only the draws of nodes whose weight changes change.
So where a subtree's weight grows, rows come into it from outside, those inside stay, and no row moves between others.

A shard that is added after a tree was built stands in a region of its own. Then no other draw changes, and whatever
moves, moves into the new shard: that is the law `key`. Added inside a region, its neighbours would take rows as well.

Everything is DataFrame expressions; the only shuffles number the rows of a shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal rows that one task numbers at most.
PIECE = 1 << 20


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(n_shards: int, built: int | None = None, racks: int = 3, regions: int = 2, weight: float = 1.0) -> list[Leaf]:
    """The first `built` shards (all, if not given) dealt in turn to the racks of the regions, each later one in a region of its own."""
    built = n_shards if built is None else built
    return [Leaf(i % regions, i // regions % racks, i, weight) if i < built else Leaf(regions + i - built, 0, i, weight) for i in range(n_shards)]


def draw(key: Column, node: list[Column], weight: Column) -> Column:
    """An exponential draw with the weight as its rate, from 52 bits of a hash of key and node."""
    u = (F.shiftrightunsigned(F.xxhash64(key, *node), 12) + F.lit(1)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _children(leaves: list[Leaf], level: int) -> list[list[tuple[int, float, int]]]:
    """Of each node above a level, in order: its children's names, weights of their subtrees, and places among those of their level."""
    paths = {x: (x.region, x.rack, x.shard) for x in leaves}
    own = sorted({p[: level + 1] for p in paths.values()})
    weight = {node: sum(x.weight for x, p in paths.items() if p[: level + 1] == node) for node in own}
    return [[(n[level], weight[n], own.index(n)) for n in own if n[:level] == parent] for parent in sorted({n[:level] for n in own})]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard that the descent from the root ends in. A null key is a key like any other; leaves of weight 0 get nothing."""
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    node = lambda n, w, p: F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(p).alias("place"))
    tables = [F.array(*[F.array(*[node(*x) for x in own]) for own in _children(live, level)]) for level in range(3)]

    def least(level: int, parent: Column, path: dict[str, Column]) -> Column:
        """The child of the least draw, with the names on the way to it."""
        names = [c.alias(n) for n, c in path.items()]
        drawn = F.transform(F.element_at(tables[level], parent + 1), lambda x: F.struct(draw(key, [F.lit(level), *path.values(), x["name"]], x["weight"]).alias("draw"), *names, x["name"].alias("name"), x["place"].alias("place")))
        return F.array_min(drawn)

    # each level's choice is bound to a variable, so it is made once
    region = least(0, F.lit(0), {})
    rack = F.transform(F.array(region), lambda r: least(1, r["place"], {"region": r["name"]}))[0]
    return F.transform(F.array(rack), lambda r: least(2, r["place"], {"region": r["region"], "rack": r["name"]}))[0]["name"]


def assign(rows: DataFrame, key: str, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    return rows.withColumn(out, shard_of(F.col(key), leaves))


def number(rows: DataFrame, shard: str, rows_per_bucket: int = 50_000, out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 in each shard, in the order of the rows' hashes and then columns.

    Equal rows are counted first and numbered together, however many there are. A shard is cut into buckets of hashes, so
    that no task holds a whole shard; a bucket's offset comes from the small table of bucket counts."""
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    sizes = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("most")).first()["most"]
    buckets = max(1, -(-(sizes or 0) // rows_per_bucket))
    cut = counted.withColumn("_hash", F.xxhash64(*columns)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    counts = cut.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("_shard"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_bucket").orderBy("_hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = numbered.join(offsets, F.col(shard).eqNullSafe(F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
    # pieces of equal rows, dealt out where one row stands for very many
    pieces = joined.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / PIECE))))
    last = F.least(F.col("_n"), (F.col("_piece") + 1) * PIECE) - 1
    return pieces.withColumn("_row", F.explode(F.sequence(F.col("_piece") * PIECE, last))).select(*columns, (F.col("_first") + F.col("_in") + F.col("_row")).alias(out))


def shard_documents(docs: DataFrame, n_shards: int = 24, built: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs.

    The law is `key`: doc_id and the number of shards decide, for a tree that was built with `built` of them (all, if not
    given), and a shard more takes rows only into itself. A null text has size 8 and the CRC of no bytes, as an empty
    one; very long texts are only measured; a repeated row is numbered like any other; a null doc_id is a key of its own.
    Columns other than doc_id and text are ignored, whatever their names. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    built = n_shards if built is None else built
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign(assign(sized, "doc_id", tree(n_shards, built)), "doc_id", tree(n_shards + 1, built), "grown_shard")
    return number(placed, "shard").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
