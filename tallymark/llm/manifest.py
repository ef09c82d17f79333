"""Merkle manifest of a dataset: a content-addressed store of digest-to-children records, and proofs that descend through it.

Every row is a leaf. Leaves of a group ascend by their order column; runs of three become their digest until
one node, the group's subroot, is left, and the subroots become the root likewise. Records are stored in pages of up to five
levels: a page is addressed by the digest of its top node and lists the nodes at its bottom, from which the
records in between follow. A proof starts at the root: a request goes down by the base-3 digits of the leaf's rank,
collects the children it does not select, and its path is reversed at the end. Requests of one page
travel as one row, so a join per page level moves a few hundredths of the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tallymark.llm.arrow import rows_to_batch
from tallymark.session import broadcast_if_small, durable

FAN = 3
PAGE_LEVELS = 5
PAGE = FAN ** PAGE_LEVELS


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 over the values in order, each as its UTF-8 byte count, ``:`` and the text, or ``-`` for null."""
    shown = [v.cast("string") for v in values]
    framed = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown]
    return F.sha2(F.concat(*framed), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def levels_of(children: Sequence[str], n: int) -> list[list[str]]:
    """The nodes of a page, bottom level first; ``n`` is the number of nodes of the whole group at that level."""
    levels = [list(children)]
    for _ in range(min(PAGE_LEVELS, height(n))):
        below = levels[-1]
        levels.append([digest(below[k:k + FAN]) for k in range(0, len(below), FAN)])
    return levels


def descend(records: dict[str, list[str]], top: str, digits: Sequence[int]) -> tuple[str, list[tuple[int, str]]]:
    """The node that ``digits`` lead to from ``top``, and per step, lowest first, its place in its run and the run's others."""
    node, path = top, []
    for at in digits:
        run = records[node]
        path.append((at, "".join(run[:at] + run[at + 1:])))
        node = run[at]
    return node, path[::-1]


def fold(node: str, path: Sequence[tuple[int, str]]) -> str:
    """The digest at the end of ``path`` if ``node`` stands at its start."""
    for at, others in path:
        node = digest((others[:64 * at], node, others[64 * at:]))
    return node


def _digits(rank: int, levels: int) -> list[int]:
    """The lowest ``levels`` base-3 digits of ``rank``, highest first."""
    return [rank // FAN ** k % FAN for k in reversed(range(levels))]


def _map_rows(df: DataFrame, make: Callable[..., Iterator[Sequence]], schema: str) -> DataFrame:
    """Rows that ``make`` yields per row, through Arrow in batches of about a page."""
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(kind)
        for batch in batches:
            for n in range(batch.num_rows):
                made = list(make(*(batch.column(c)[n].as_py() for c in range(batch.num_columns))))
                yield rows_to_batch(made, kinds)

    return df.mapInArrow(run, kind)


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``order``, nulls first) and ``n`` (rows) within ``group``.

    Rows are sorted in range partitions, so a group of any size spreads over tasks; partitions number their rows, and the
    sums of the partitions before shift the numbers. ``df`` is read twice, so give a written one.
    """
    sorted_rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = durable(sorted_rows.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("place", 33)))
    parts = placed.groupBy(F.col(group).alias("g"), F.col("part").alias("p")).agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    in_group = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(in_group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = durable(parts.select("g", "p", (before - F.col("first")).alias("shift"), F.sum("rows").over(in_group).alias("n")))
    joined = placed.join(broadcast_if_small(shifts), (F.col(group) == F.col("g")) & (F.col("part") == F.col("p")))
    return joined.withColumn("rank", F.col("place") + F.col("shift")).drop("place", "part", "g", "p", "shift")


@dataclass
class Trees:
    """One tree per group: pages by level (bottom first) and the groups' subroots, ``tree, digest, n``."""

    pages: list[DataFrame]
    tops: DataFrame


_PAGE_ROWS = "tree string, pos long, n long, digest string, children array<string>"


def _pages(runs: DataFrame) -> DataFrame:
    """Pages over ``tree, pos, n, children``: ``pos`` counts the pages of a tree, ``n`` its nodes at the pages' bottom."""

    def page(tree: str, pos: int, n: int, children: list[str]) -> Iterator[tuple]:
        yield tree, pos, n, levels_of(children, n)[-1][0], children

    return durable(_map_rows(runs, page, _PAGE_ROWS))


def runs_of(nodes: DataFrame, *more: str) -> DataFrame:
    """``tree, pos, n, rows``: the nodes (``tree, rank, n, digest``, and ``more`` columns) of each page in order."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "digest", *more))).alias("rows")
    return nodes.groupBy("tree", F.expr(f"rank div {PAGE}").alias("pos"), "n").agg(rows)


def build(runs: DataFrame) -> Trees:
    """The trees over the runs of their leaves: a round per page level, so a few however many leaves there are."""
    pages, tops = [], []
    while True:
        made = _pages(runs.select("tree", "pos", "n", "rows.digest"))
        pages.append(made)
        tops.append(made.where(f"n <= {PAGE}").select("tree", "digest", F.lit(len(pages) - 1).alias("level"), "n"))
        nodes = made.where(f"n > {PAGE}").select("tree", F.col("pos").alias("rank"), F.ceil(F.col("n") / PAGE).cast("long").alias("n"), "digest")
        if nodes.isEmpty():
            return Trees(pages, reduce(DataFrame.unionByName, tops))
        runs = runs_of(nodes)


_REQUEST = "tree string, pos long, digest string, ats array<int>, others array<string>"


def _through(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests for pages, by digest, become requests for all nodes at the pages' bottoms."""
    store = pages.groupBy("digest").agg(F.any_value("n").alias("n"), F.any_value("children").alias("children"))

    def down(tree: str, pos: int, top: str, ats: list[int], others: list[str], n: int, children: list[str]) -> Iterator[tuple]:
        records, levels = _records(children, n, top)
        for k in range(len(children)):
            node, path = descend(records, top, _digits(k, levels))
            yield tree, pos * PAGE + k, node, [at for at, _ in path] + ats, [run for _, run in path] + others

    asked = requests.join(store, "digest").select("tree", "pos", "digest", "ats", "others", "n", "children")
    return _map_rows(asked, down, _REQUEST)


def _records(children: list[str], n: int, top: str) -> tuple[dict[str, list[str]], int]:
    """Digest to children for every node of a page, checked against its address."""
    levels = levels_of(children, n)
    if levels[-1] != [top]:
        raise ValueError(f"the page stored under {top} has another digest")
    records = {node: below[FAN * k:FAN * k + FAN] for above, below in zip(levels[1:], levels, strict=False) for k, node in enumerate(above)}
    return records, len(levels) - 1


def page_requests(trees: Trees, start: DataFrame) -> DataFrame:
    """Requests for every bottom page, from ``start`` (``tree, ats, others``: the way from each subroot to the root)."""
    asked = None
    for level in reversed(range(len(trees.pages))):
        own = trees.tops.where(F.col("level") == level).join(start, "tree").select(
            "tree", F.lit(0).cast("long").alias("pos"), "digest", "ats", "others")
        asked = own if asked is None else asked.unionByName(own)
        if level:
            asked = durable(_through(asked, trees.pages[level]))
    return asked


_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(df: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
             group_col: str = "source", altered: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: one row per input row, proofs against one root.

    A leaf is the digest of ``fields``. ``altered`` gives other values for some fields as they are found later; the
    digest over them is folded with the stored siblings, and ``verified`` says if the root comes out.
    Null groups come first, null ids too; rows with equal group and id go by their leaf, so repeated rows have
    neighbouring places. A single row is its own subroot and root and has no siblings. An empty table
    gives no rows. Columns beyond ``fields`` are ignored, whatever their names.
    """
    values = [F.col(f"`{c}`") for c in fields]
    later = [(altered or {}).get(c, v) for c, v in zip(fields, values, strict=True)]
    changed = F.lit(False)
    for now, then in zip(values, later, strict=True):
        changed = changed | ~now.eqNullSafe(then)
    group = F.col(f"`{group_col}`").cast("string")
    leaves = durable(df.select(
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("."), group)).alias("tree"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        row_digest(values).alias("digest"), F.when(changed, row_digest(later)).alias("altered")))
    batches = durable(runs_of(ranked(leaves, "tree", "doc_id", "digest"), "doc_id", "altered"))
    trees = build(batches)

    sources = durable(ranked(durable(trees.tops.select(F.lit("").alias("all"), "tree", "digest")), "all", "tree"))
    above = build(runs_of(sources.select(F.col("all").alias("tree"), "rank", "n", "digest")))
    top = above.tops.first()
    whole = df.sparkSession.createDataFrame([("", [], [])], "tree string, ats array<int>, others array<string>")
    places = _through(page_requests(above, whole), above.pages[0]).select(F.col("pos").alias("rank"), "ats", "others")
    start = durable(sources.join(places, "rank").select("tree", "ats", "others", F.col("digest").alias("subroot")))

    store = trees.pages[0].groupBy("digest").agg(F.any_value("children").alias("children"))
    requests = page_requests(trees, start).join(store, "digest").join(start.select("tree", "subroot"), "tree")
    ready = batches.join(requests, ["tree", "pos"]).select(
        "pos", "n", "rows.rank", "rows.doc_id", "rows.altered", "digest", "children", "ats", "others", "subroot",
        F.lit(top and top["digest"]).cast("string").alias("root"))
    return _map_rows(ready, _prove, _PROOFS)


def _prove(pos: int, n: int, ranks: list[int], ids: list[int | None], altered: list[str | None], top: str, children: list[str],
           ats: list[int], others: list[str], subroot: str, root: str) -> Iterator[tuple]:
    records, levels = _records(children, n, top)
    beyond = list(zip(ats, others, strict=True))
    for rank, doc_id, later in zip(ranks, ids, altered, strict=True):
        leaf, path = descend(records, top, _digits(rank - pos * PAGE, levels))
        path += beyond
        folded = fold(leaf if later is None else later, path)
        yield doc_id, leaf, subroot, root, digest([run for _, run in path]), folded, folded == root
