"""Filling fixed-capacity containers with items (problem 7): bounded-space online packing.

Each partition keeps at most ``windows`` open containers per capacity. An item goes into the fullest open
container that still takes it; if none does, a new one is opened, and when too many are open the fullest is
closed. Items come to the packer ``windows`` at a time, the largest first. What is open at the end of a partition is
merged: the half-filled containers are themselves packed, by the same rule and fullest first, within groups of
partitions, then within groups of groups and so on, so that no task ever merges more than about ``MERGED`` of them. Only an
item larger than the capacity is split, into full pieces and a rest that is packed like any other item.

The placements are worked out once and kept, as a second run of the same plan may meet the items in another order;
merges refer to the containers of that run.

Sizes are tokens of the byte-level tokenizer: UTF-8 bytes plus one end token. Pieces are ranges of tokens.
Rows with a null id are packed like others. A null text has the size of its end token only; repeated items are packed each; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpoint, ship

MERGED = 65_536


class Packer:
    """Best fit into a bounded number of open containers; ``closed`` gets the numbers of the closed ones."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows, self.next = capacity, windows, 0
        self.open: list[tuple[int, int]] = []  # (space left, container), sorted

    def put(self, size: int) -> int:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            space, container = self.open.pop(at)
            space -= size
        else:
            if len(self.open) >= self.windows:
                self.open.pop(0)
            space, container = self.capacity - size, self.next
            self.next += 1
        if space:
            insort(self.open, (space, container))
        return container


_ROWS = "container_kind string, capacity long, container long, item long, piece int, start_token long, tokens long, fill long"
_ROW_SCHEMA = pa.schema(
    [("container_kind", pa.string()), ("capacity", pa.int64()), ("container", pa.int64()), ("item", pa.int64()), ("piece", pa.int32())]
    + [(k, pa.int64()) for k in ("start_token", "tokens", "fill")]
)


def _pack(kinds: list[tuple[str, int]], windows: int):
    """Items to placements; a row with fill tells of a container left open and how full it is."""

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, sizes = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
            while len(ids) >= windows:
                yield ids[:windows], sizes[:windows]
                ids, sizes = ids[windows:], sizes[windows:]
        yield ids, sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        packers = [Packer(capacity, windows) for _, capacity in kinds]
        for ids, sizes in portions(batches):
            for (kind, capacity), packer in zip(kinds, packers, strict=True):
                container, item, piece, start, tokens = [], [], [], [], []
                put = packer.put
                # by what is left to place once the full pieces of a larger item are cut
                for i, size in sorted(zip(ids, sizes, strict=True), key=lambda x: (x[1] - 1) % capacity, reverse=True):
                    begin, k = 0, 0
                    while size - begin > capacity:  # only what does not fit whole is cut
                        container.append(base + packer.next)
                        packer.next += 1
                        item.append(i), piece.append(k), start.append(begin), tokens.append(capacity)
                        begin, k = begin + capacity, k + 1
                    container.append(base + put(size - begin))
                    item.append(i), piece.append(k), start.append(begin), tokens.append(size - begin)
                n = len(item)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(([kind] * n, [capacity] * n, container, item, piece, start, tokens, [None] * n), _ROW_SCHEMA.types, strict=True)],
                    schema=_ROW_SCHEMA,
                )
        for (kind, capacity), packer in zip(kinds, packers, strict=True):
            n = len(packer.open)
            columns = ([kind] * n, [capacity] * n, [base + c for _, c in packer.open], *[[None] * n] * 4, [capacity - s for s, _ in packer.open])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _ROW_SCHEMA.types, strict=True)], schema=_ROW_SCHEMA)

    return run


_MOVE = "container_kind string, capacity long, container long, goes_to long, fill long"


def _merge(windows: int):
    """Open containers of one kind into fewer: (container, goes_to), and fill for those still open at the end."""

    def run(table: pa.Table) -> pa.Table:
        kind, capacity = table.column("container_kind")[0].as_py(), table.column("capacity")[0].as_py()
        rows = sorted(zip(table.column("fill").to_pylist(), table.column("container").to_pylist(), strict=True), reverse=True)
        packer, first, full = Packer(capacity, windows), {}, {}
        out = []
        for fill, container in rows:
            place = packer.put(fill)
            first.setdefault(place, container)
            full[place] = full.get(place, 0) + fill
            out.append((container, place))
        still = {c for _, c in packer.open}
        goes = [first[p] for _, p in out]
        fills = [full[p] if p in still and first[p] == c else None for c, p in out]
        n = len(out)
        return pa.table({"container_kind": [kind] * n, "capacity": pa.array([capacity] * n, pa.int64()), "container": [c for c, _ in out], "goes_to": goes, "fill": pa.array(fills, pa.int64())})

    return run


def pack(items: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", windows: int = 4096) -> DataFrame:
    """(container_kind, capacity_tokens, container_id, id, piece, start_token, tokens) of every item and capacity."""
    ship(items.sparkSession)
    # the kinds of containers are a list that people keep, and each is a packing of its own
    kinds = [(r[0], int(r[1])) for r in containers.select("container_kind", "capacity_tokens").collect()]
    if any(c < 1 for _, c in kinds):
        raise ValueError("a container has a capacity of one token or more")
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long") + 1
    sized = items.select(F.col(f"`{id_col}`").cast("long").alias("item"), size.alias("size"))
    rows = checkpoint(sized.mapInArrow(_pack(kinds, windows), _ROWS))
    placed = rows.filter("fill is null")
    left = rows.filter("fill is not null").select("container_kind", "capacity", "container", "fill")
    fan = max(2, MERGED // windows)
    width, parts, moves = 1, max(1, rows.rdd.getNumPartitions()), None
    while width < parts or moves is None:
        width *= fan
        group = F.floor(F.shiftright("container", 36) / width)
        step = checkpoint(left.groupBy("container_kind", "capacity", group).applyInArrow(_merge(windows), _MOVE))
        left = step.filter("fill is not null").select("container_kind", "capacity", "container", "fill")
        if moves is None:
            moves = step.select("container_kind", "container", F.col("goes_to").alias("moved"))
        else:
            more = step.select("container_kind", F.col("container").alias("moved"), "goes_to")
            moves = moves.join(more, ["container_kind", "moved"], "left")
            moves = moves.select("container_kind", "container", F.coalesce("goes_to", "moved").alias("moved"))
    return placed.join(moves, ["container_kind", "container"], "left").select(
        "container_kind", F.col("capacity").alias("capacity_tokens"), F.coalesce("moved", "container").alias("container_id"),
        F.col("item").alias(id_col), "piece", "start_token", "tokens",
    )


def filling_report(placed: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, containers, tokens, free_share, split_items) of every kind."""
    by = placed.groupBy("container_kind", "capacity_tokens", "container_id").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.expr("case when piece = 1 then 1 else 0 end")).alias("splits")
    )
    return by.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"),
        (1 - F.sum("tokens") / (F.count("*") * F.col("capacity_tokens"))).alias("free_share"), F.sum("splits").alias("split_items"),
    )
