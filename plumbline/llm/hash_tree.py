"""Sharding by a weighted hash tree of regions, racks and shards.

A row descends the tree. At each level every node below the one it is in draws an exponential waiting
time from a hash of the level, the node's number and the row's key, divided by the node's weight,
which is the sum of the weights of the shards below it; the least draw wins. Nodes draw for themselves, so
a changed weight of one shard changes the draws of that shard, its rack and its region, and no other:

* a region's rows move only into the region whose weight grew, or out of the one whose weight fell;
* among the rows that stay in that region, the same holds for its racks, and in the rack for its shards;
* rows that neither leave nor enter the changed region, rack and shard stay where they are.

A shard that joins a running tree opens a region of its own, so all rows that move, move into it (law
``key``): in a region with older shards it would draw rows for these as well.

All of it is DataFrame expressions. There is no shuffle but one count of shards and
slots: within a shard, rows are numbered by chunk of the key's hash, and the chunks' counts
give each chunk's first slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import settle

ROWS_PER_CHUNK = 20_000
FOUNDED = 24
REGION, RACK, SHARD = 1, 2, 3


@dataclass(frozen=True)
class Shard:
    number: int
    rack: int
    region: int
    weight: float = 1.0


def layout(shards: int, per_rack: int = 4, racks_per_region: int = 3, founded: int = FOUNDED) -> list[Shard]:
    """Shards from 0 on. The first ``founded`` fill racks and regions one after the other; each later one has
    a rack and a region of its own."""
    founded = min(founded, shards)
    per_region = per_rack * racks_per_region
    first = [Shard(i, i // per_rack, i // per_region) for i in range(founded)]
    racks, regions = -(-founded // per_rack), -(-founded // per_region)
    return first + [Shard(i, racks + i - founded, regions + i - founded) for i in range(founded, shards)]


def _least(level: int, key: str, nodes: dict[int, float]) -> str:
    """SQL of the node (number and weight) with the least draw of a level, the smaller number of equals."""
    if len(nodes) == 1:
        return str(next(iter(nodes)))
    draws = []
    for number, weight in nodes.items():
        unit = f"(CAST(shiftrightunsigned(xxhash64({level}, {number}, {key}), 11) AS DOUBLE) + 0.5D) / 9007199254740992D"
        draw = f"-ln({unit}) / {float(weight)!r}D" if weight > 0 else "CAST('Infinity' AS DOUBLE)"
        draws.append(f"named_struct('draw', {draw}, 'node', {number})")
    return f"least({', '.join(draws)}).node"


def descend(rows: DataFrame, key: str, tree: list[Shard], name: str) -> DataFrame:
    """``rows`` with the shard of the SQL expression ``key`` in ``tree`` as column ``name``.

    A null key is a key like any other. ``rows`` must have no column that begins with ``_tree``.
    """
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    for s in tree:
        regions[s.region] = regions.get(s.region, 0.0) + s.weight
        own = racks.setdefault(s.region, {})
        own[s.rack] = own.get(s.rack, 0.0) + s.weight
        shards.setdefault(s.rack, {})[s.number] = s.weight

    def below(level: int, of: str, nodes: dict[int, dict[int, float]]) -> str:
        cases = " ".join(f"WHEN {n} THEN {_least(level, key, own)}" for n, own in nodes.items())
        return f"CASE {of} {cases} END"

    kept = [f"`{c}`" for c in rows.columns]
    out = rows.selectExpr(*kept, f"{_least(REGION, key, regions)} AS _tree_region")
    out = out.selectExpr("*", f"{below(RACK, '_tree_region', racks)} AS _tree_rack")
    return out.selectExpr(*kept, f"CAST({below(SHARD, '_tree_rack', shards)} AS INT) AS `{name}`")


def slots(placed: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``placed (shard, mark, ...)`` with ``slot``, a gapless number from 0 within each shard.

    Rows are numbered within chunks of the hash ``mark``; how many chunks a shard has
    follows from the number of rows, so no task orders a whole shard. Rows with equal marks
    (repeated rows) share a chunk and take any order among themselves.
    """
    total = placed.agg(F.count("*")).first()[0]
    chunks = max(1, total // rows_per_chunk)
    cut = placed.withColumn("chunk", F.pmod("mark", F.lit(chunks)))
    order = Window.partitionBy("shard", "chunk").orderBy("mark")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("shard", "chunk").agg(F.count("*").alias("size"))
    firsts = sizes.select("shard", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    numbered = cut.withColumn("place", F.row_number().over(order) - 1)
    return (
        numbered.join(firsts, ["shard", "chunk"])
        .withColumn("slot", (F.col("first") + F.col("place")).cast("long"))
        .drop("first", "place", "chunk", "mark")
    )


def assign(
    docs: DataFrame,
    shards: int = 24,
    weights: list[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    founded: int = FOUNDED,
) -> DataFrame:
    """Every row's shard under the law ``key``, with its slot and its shard after growth by one.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size`` is the
    text's UTF-8 bytes plus 8, ``text_crc32`` their unsigned check sum; a null text has no
    bytes. Only the id and the shards decide, so repeated rows and rows with equal ids lie
    together, and rows with a null id all lie in one shard. An empty table gives no rows.
    ``weights`` (all 1 if not given) are the shards' shares. ``founded`` is how many shards
    the tree was built with; fewer shards than that are all founders.
    """
    founded = min(founded, shards)
    tree = layout(shards, founded=founded)
    if weights is not None:
        tree = [Shard(s.number, s.rack, s.region, w) for s, w in zip(tree, weights, strict=True)]
    body = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    placed = descend(rows, "doc_id", tree, "shard")
    placed = descend(placed, "doc_id", [*tree, layout(shards + 1, founded=founded)[-1]], "grown_shard")
    placed = settle(placed.withColumn("mark", F.xxhash64("doc_id", "size", "text_crc32")), "placed")
    return slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
