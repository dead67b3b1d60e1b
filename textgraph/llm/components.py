"""Connected components of a table of links, as tables: no link reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgraph.llm.common import remove, saved

#: Links up to which one executor task joins them all (16 bytes a link); beyond, tasks work on shares of the links.
TASK_LINKS = 1_000_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimum labels over one task's links, by repeated hooking of roots and pointer jumping."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    x, y = (np.concatenate(p) for p in zip(*parts))
    names, flat = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = flat[: len(x)], flat[len(x) :]
    root = np.arange(len(names))
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "comp"])


def components(links: DataFrame, folder: str, task_links: int = TASK_LINKS) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of a link (x, y).

    Up to task_links links one task joins them.  More links are first contracted: tasks replace their share of the
    links by stars of their local components, until labels of all stars agree (minimum labels with jumps).
    """
    if links.count() <= task_links:
        return saved(links.select("x", "y").coalesce(1).mapInArrow(_union, "node long, comp long"), f"{folder}/labels")
    stars = saved(links.select("x", "y").mapInArrow(_union, "node long, comp long"), f"{folder}/stars")
    edges = saved(stars.filter("node <> comp").distinct(), f"{folder}/edges0")
    labels = saved(edges.select(F.explode(F.array("node", "comp")).alias("node")).distinct().withColumn("comp", F.col("node")), f"{folder}/labels0")
    both = edges.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(edges.select(F.col("comp").alias("a"), F.col("node").alias("b")))
    r = 0
    while True:
        r += 1
        seen = both.join(labels.withColumnsRenamed({"node": "b", "comp": "c"}), "b").groupBy("a").agg(F.min("c").alias("c"))
        hooked = labels.join(seen, F.col("node") == F.col("a")).select("node", F.least("comp", "c").alias("to"), F.col("comp").alias("old"))
        # the root that a node belonged to follows the least label found next to any of its nodes
        roots = hooked.groupBy("old").agg(F.min("to").alias("down"))
        named = hooked.join(roots.withColumnRenamed("old", "root"), F.col("old") == F.col("root")).select("node", "old", F.least("to", "down").alias("comp"))
        named = saved(named, f"{folder}/named{r}")
        jump = named.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        step = saved(named.join(jump, F.col("comp") == F.col("to")).select("node", "old", F.least("comp", "next").alias("comp")), f"{folder}/labels{r}")
        changed = step.filter("old <> comp").head(1)
        remove(step.sparkSession, f"{folder}/named{r}", *([f"{folder}/labels{r - 1}"] if r > 1 else []))
        labels = step.select("node", "comp")
        if not changed:
            return labels
