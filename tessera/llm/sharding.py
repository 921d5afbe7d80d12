"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. A key hashes to a cell; the first virtual node clockwise names its shard; when that
shard is full the key continues clockwise to the next virtual node whose shard has room. Rows are counted per cell (a table
bounded by the ring, never by the data), the loads are settled on those counts, and each row finds its shard by its rank in
its cell. With slack 0 every shard holds the same number of rows, give or take one (the law `rows`); with more slack no shard
holds more than its share of rows and the slack (`rows_bounded`), and fewer keys move when shards are added.

Ranks are found in two steps, so that a cell in which very many rows meet (a frequent key, or all null keys) is not one task:
rows of a cell are dealt to PARTS parts by a hash of all that tells them apart, ranked within their part, and moved up by the
rows of the parts before it. Cells and parts bound the table of counts.

Nulls: a null key is a key like any other; a null text has no bytes. Rows with equal keys lie in one cell; rows that are equal
in key, size and checksum take neighbouring places, and which of them takes which makes no difference. Very long texts count
with their bytes, only size and checksum are kept of them. An empty table gives an empty table. Only the columns asked for
are returned, so that names in the input can't clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

CELLS, PARTS = 1 << 12, 16


def ring(shards: int, vnodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; two nodes of one cell stay in the order of their full hash."""
    nodes = []
    for shard in range(shards):
        for copy in range(vnodes):
            digest = hashlib.blake2b(f"{shard}/{copy}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big"), shard))
    nodes.sort()
    return [(at * cells >> 64, shard) for at, shard in nodes]


def settle(counts: dict[int, int], shards: int, vnodes: int, slack: float, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): which ranks of each cell go to which shard.

    Cells are taken clockwise, and what a full shard can't take goes on clockwise at once.
    """
    total, nodes = sum(counts.values()), ring(shards, vnodes, cells)
    if slack:
        room = [-int(-(1 + slack) * total // shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    starts, used, out = [at for at, _ in nodes], [0] * shards, []
    for cell in sorted(counts):
        first, left = 0, counts[cell]
        node = bisect_left(starts, cell)
        while left:
            shard = nodes[node % len(nodes)][1]
            if take := min(left, room[shard] - used[shard]):
                out.append((cell, first, first + take, shard, used[shard]))
                first, left, used[shard] = first + take, left - take, used[shard] + take
            node += 1
    return out


def shard_rows(rows: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """key, size (UTF-8 bytes of the text and 16), text_crc32, law, shard, slot and grown_shard for every row."""
    spark = rows.sparkSession
    body = F.coalesce(rows[text], F.lit(""))
    point = F.xxhash64(rows[key].cast("string"))
    facts = rows.select(
        rows[key].alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        point.alias("point"),
        F.shiftrightunsigned(point, 64 - CELLS.bit_length() + 1).cast("int").alias("cell"),
    )
    part = F.pmod(F.xxhash64("point", "doc_id", "size", "text_crc32"), F.lit(PARTS)).cast("int")
    placed = written(facts.withColumn("part", part), "ring-rows")  # without texts: a few bytes a row, read twice
    sums = placed.groupBy("cell", "part").count().groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("part", "count"))).alias("parts"))
    counts = {r["cell"]: r["parts"] for r in sums.collect()}  # CELLS rows of PARTS numbers at most
    before = [(cell, part, sum(n for p, n in own.items() if p < part)) for cell, own in counts.items() for part in own]
    # bounded by the ring: as many rows as cells (and parts), and one more for each time that a shard runs full
    segments = spark.createDataFrame(settle({c: sum(own.values()) for c, own in counts.items()}, shards, vnodes, slack), "cell int, first long, end long, shard int, slot long")
    moved = spark.createDataFrame(before, "cell int, part int, before long")
    order = Window.partitionBy("cell", "part").orderBy("point", "doc_id", "size", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(F.broadcast(moved), ["cell", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    on = (ranked["cell"] == segments["cell"]) & (ranked["rank"] >= segments["first"]) & (ranked["rank"] < segments["end"])
    return ranked.join(F.broadcast(segments), on).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows_bounded" if slack else "rows").alias("law"),
        segments["shard"].alias("shard"),
        (segments["slot"] + ranked["rank"] - segments["first"]).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
