"""Sharding by Karmarkar-Karp differencing: equal texts stay together, bytes are as even as can be.

Groups of equal texts are counted by digest. Each task differences its own groups: of the partial
partitions held, the two with the largest spread are combined, their parts in opposite orders, until
one is left. The driver then differences the tasks' partitions in the same way (tasks x shards numbers).
A group's shard follows from its part, and the rows of a group are spread over salts, so that no group,
however many copies it has, meets in one task.

Cases: null text: size 1, a group of its own beside the empty text (which has size 1 too). Repeated
rows: each gets a slot. Null doc_id: like any other. An empty table stays empty. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.llm.shared import cut, text_or_empty

SHARDS = 8


def difference(items: list[tuple[list[int], list[list]]], k: int) -> list[list]:
    """items: (loads, members) of k parts each, loads descending. The k lists of members of the one
    partition that differencing leaves."""
    heap = [(loads[-1] - loads[0], i, loads, parts) for i, (loads, parts) in enumerate(items)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = sorted(((a[j] + b[k - 1 - j], j) for j in range(k)), reverse=True)
        parts = []
        for _, j in both:
            large, small = (x[j], y[k - 1 - j]) if len(x[j]) >= len(y[k - 1 - j]) else (y[k - 1 - j], x[j])
            if small:
                large.extend(small)
            parts.append(large)
        loads = [load for load, _ in both]
        heapq.heappush(heap, (loads[-1] - loads[0], n, loads, parts))
        n += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


#: Groups whose single partitions a task holds at once; the chunks' partitions are differenced next.
CHUNK = 50_000


def _difference_sizes(size: np.ndarray, k: int) -> list[list[int]]:
    """The k lists of places in ``size`` after differencing in chunks."""
    zero, made = [0] * (k - 1), []
    for a in range(0, len(size), CHUNK):
        parts = difference([([s, *zero], [[a + i], *[()] * (k - 1)]) for i, s in enumerate(size[a : a + CHUNK].tolist())], k)
        parts = sorted(((int(size[list(p)].sum()), list(p)) for p in parts), key=lambda x: -x[0])
        made.append(([load for load, _ in parts], [p for _, p in parts]))
    return difference(made, k)


def _local(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held = [[b.column(c).to_numpy() for c in ("d1", "d2", "group_bytes")] for b in batches if b.num_rows]
        if not held:
            return
        d1, d2, size = (np.concatenate(x) for x in zip(*held, strict=True))
        parts = _difference_sizes(size, k)
        at = np.concatenate([np.array(p, np.int64) for p in parts])
        part = np.repeat(np.arange(k), [len(p) for p in parts])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[at]) for x in (d1, d2, size)] + [pa.array(np.full(len(at), task, np.int64)), pa.array(part)],
            ["d1", "d2", "group_bytes", "task", "part"],
        )

    return run


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    spark = docs.sparkSession
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    digest = F.sha2(F.concat(F.when(F.col("text").isNull(), "-").otherwise("+"), text_or_empty()).cast("binary"), 256)
    long = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        long(1).alias("d1"),
        long(16).alias("d2"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"),
    )
    rows = cut(rows, "rows")
    salted = rows.groupBy("d1", "d2", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    salted = cut(salted, "salted")
    groups = salted.groupBy("d1", "d2").agg(F.sum("bytes").alias("group_bytes"))
    local = cut(groups.mapInArrow(_local(shards), "d1 long, d2 long, group_bytes long, task long, part long"), "local")
    loads = local.groupBy("task", "part").agg(F.sum("group_bytes").alias("bytes")).collect()
    tasks: dict[int, list[tuple[int, int]]] = {}
    for task, part, load in loads:
        tasks.setdefault(task, []).append((load, part))
    items = []
    for task, parts in sorted(tasks.items()):
        parts += [(0, p) for p in set(range(shards)) - {p for _, p in parts}]
        parts.sort(reverse=True)  # loads descend
        items.append(([load for load, _ in parts], [[(task, p)] for _, p in parts]))
    shard_of = [(task, part, s) for s, members in enumerate(difference(items, shards)) for task, part in members]
    table = spark.createDataFrame(shard_of, "task long, part long, shard int")
    placed = local.join(F.broadcast(table), ["task", "part"]).select("d1", "d2", "shard")
    # slots: rows of a shard in the order of (digest bits, group, salt), then doc_id
    placed = cut(salted.join(placed, ["d1", "d2"]).withColumn("run", F.pmod(F.xxhash64("d1", "d2", "salt"), F.lit(salts)).cast("int")), "placed")
    runs = placed.groupBy("shard", "run").agg(F.sum("n").alias("n")).collect()
    before, base = dict.fromkeys(range(shards), 0), []
    for shard, run, n in sorted(runs):
        base.append((shard, run, before[shard]))
        before[shard] += n
    base_table = spark.createDataFrame(base, "shard int, run int, base long")
    within = Window.partitionBy("shard", "run").orderBy("d1", "d2", "salt")
    starts = placed.withColumn("start", F.sum("n").over(within) - F.col("n")).join(F.broadcast(base_table), ["shard", "run"])
    starts = starts.select("d1", "d2", "salt", "shard", (F.col("start") + F.col("base")).alias("first_slot"))
    order = Window.partitionBy("d1", "d2", "salt").orderBy("doc_id")
    numbered = rows.withColumn("k", F.row_number().over(order) - 1)
    return numbered.join(starts, ["d1", "d2", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
