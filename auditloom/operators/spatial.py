"""Boxes that meet: joins whose cells are as large as the boxes, areas by cells that split where they are crowded, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.sources.tables import shared_dir

#: Sizes of cells are powers of two between these.
LEAST, MOST = -30, 60
#: Boxes of a cell that are compared with each other; a cell that is crowded beyond this is split in so many parts by each axis.
CROWD, PARTS = 64, 8
#: Reaches are made so much wider where they only choose what is compared, as sums of doubles are rounded.
WIDER = 1 + 2.0**-20
#: Left and right boxes of a cell that one task compares at least; a cell with more is dealt in blocks.
LEFT_BLOCK, RIGHT_BLOCK = 16384, 4096
SIDES = ("x0", "y0", "x1", "y1")


def _size(low: Column, high: Column) -> Column:
    """The power of two that is no smaller than an extent."""
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(F.log2(F.greatest(high - low, F.lit(2.0**LEAST)))))).cast("int")


def _cells(left: DataFrame, right: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides, a row for each cell that a box touches (own columns as _l_c and _r_c), and the columns that name a cell."""
    sides = []
    for name, df in (("l", left), ("r", right)):
        fit = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in SIDES) + " AND x1 >= x0 AND y1 >= y0")
        sides.append(fit.select(*by, *[F.col(c).alias(f"_{name}_{c}") for c in df.columns], _size(F.col("x0"), F.col("x1")).alias("_w"), _size(F.col("y0"), F.col("y1")).alias("_h")))
    kinds = [sorted((r["_w"], r["_h"]) for r in s.select("_w", "_h").distinct().collect()) for s in sides]  # 91 * 91 rows at most

    def cells(df: DataFrame, name: str, others: list[tuple[int, int]], tags: tuple[str, ...]) -> DataFrame:
        kind = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in others])) if others else F.explode(F.array().cast("array<struct<w:int,h:int>>"))
        both = df.withColumn("_o", kind).withColumns({"_ow": F.col("_o.w"), "_oh": F.col("_o.h")}).drop("_o").withColumns({"_cw": F.pow(F.lit(2.0), F.greatest("_w", "_ow")), "_ch": F.pow(F.lit(2.0), F.greatest("_h", "_oh"))})
        at = lambda c, size: F.floor(F.col(f"_{name}_{c}") / F.col(size))
        spread = both.withColumn("_cx", F.explode(F.sequence(at("x0", "_cw"), at("x1", "_cw")))).withColumn("_cy", F.explode(F.sequence(at("y0", "_ch"), at("y1", "_ch"))))
        spread = spread.withColumnsRenamed(dict(zip(("_w", "_h", "_ow", "_oh"), tags)))
        return spread if name == "l" else spread.drop("_cw", "_ch")

    here = cells(sides[0], "l", kinds[1], ("_lw", "_lh", "_rw", "_rh"))
    there = cells(sides[1], "r", kinds[0], ("_rw", "_rh", "_lw", "_lh"))
    return here, there, [*by, "_lw", "_lh", "_rw", "_rh", "_cx", "_cy"]


def _dealt(here: DataFrame, there: DataFrame, cell: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of `_cells` with the blocks of crowded cells (_a of left, _b of right boxes), a side once for each block of the other, and the columns that name a pair of blocks."""
    nothing = F.lit(0).cast("long")
    crowds = here.groupBy(*cell).agg(F.count("*").alias("_nl"), nothing.alias("_nr")).unionByName(there.groupBy(*cell).agg(nothing.alias("_nl"), F.count("*").alias("_nr")))
    crowds = crowds.groupBy(*cell).agg(F.ceil(F.sum("_nl") / LEFT_BLOCK).alias("_na"), F.ceil(F.sum("_nr") / RIGHT_BLOCK).alias("_nb"))
    crowds = F.broadcast(crowds.filter("_na > 1 OR _nb > 1"))  # a row for some thousand boxes at most
    n = lambda x: F.greatest(F.lit(1), F.coalesce(f"_n{x}", F.lit(1))).cast("int")

    def deal(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(*[c for c in df.columns if c.startswith(f"_{name}_")]), n(own)).cast("int")
        return df.join(crowds, cell, "left").withColumn(f"_{own}", block).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), n(other) - 1))).drop("_na", "_nb")

    return deal(here, "l", "a", "b"), deal(there, "r", "b", "a"), [*cell, "_a", "_b"]


def met(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by, l, r): pairs of boxes of one group that overlap or touch, as structs of all columns of both sides. Boxes: x0, y0, x1, y1.

    A box belongs to a kind, the powers of two that hold its width and its height. Two kinds meet in a grid whose cells are, on
    each axis, as large as the larger of both; so a box touches few cells of each grid, and what else lies in them is near
    for its size, however many boxes a group has and however unlike they are. A pair counts in the cell where what both
    cover begins. Boxes with a null side meet nothing. Cells with many boxes are dealt to several tasks.
    """
    here, there, cell = _dealt(*_cells(left, right, by))
    # cells are few bytes and many pairs: adaptive planning, which goes by bytes, would give them to a few tasks
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = here.repartition(tasks, *cell).join(there.repartition(tasks, *cell), cell)
    touch = (F.col("_l_x0") <= F.col("_r_x1")) & (F.col("_r_x0") <= F.col("_l_x1")) & (F.col("_l_y0") <= F.col("_r_y1")) & (F.col("_r_y0") <= F.col("_l_y1"))
    begins = (F.col("_cx") == F.floor(F.greatest("_l_x0", "_r_x0") / F.col("_cw"))) & (F.col("_cy") == F.floor(F.greatest("_l_y0", "_r_y0") / F.col("_ch")))
    whole = lambda name, df: F.struct(*[F.col(f"_{name}_{c}").alias(c) for c in df.columns]).alias(name)
    return pairs.filter(touch & begins).select(*by, whole("l", left), whole("r", right))


class Leading:
    """Takes right boxes of a cell, then left ones bit by bit, and keeps the left box that is first for each right one. Boxes: id, x0, y0, x1, y1.

    A subclass says how good a pair is (`near`, up to `slack`, and `exact`) and which left box goes first among equals (`ties`, ids last).
    """

    slack = 0.0
    #: Boxes of each side that are compared at once, so that what is worked out stays in a core's cache.
    tile = (512, 128)

    def near(self, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """How good each pair is (a row for each right box), -inf where it doesn't count, then what `exact` needs of the pairs, of the same shape."""
        raise NotImplementedError

    def exact(self, left: tuple[np.ndarray, ...], *found: np.ndarray) -> np.ndarray:
        """How good pairs are, of their left boxes and what `near` found."""
        raise NotImplementedError

    def ties(self, left: tuple[np.ndarray, ...]) -> np.ndarray:
        """What left boxes of equally good pairs go by, least first; their ids come after it."""
        raise NotImplementedError

    def __init__(self, right: list[np.ndarray]) -> None:
        n = len(right[0])
        self.right, self.best, self.tie = right, np.full(n, -np.inf), np.full(n, np.inf)
        self.left = [np.zeros(n, c.dtype) for c in right]

    def add(self, left: list[np.ndarray]) -> None:
        tie = self.ties(tuple(left))
        order = np.lexsort((left[0], tie))
        left, tie = [c[order] for c in left], tie[order]
        high, wide = self.tile
        for r in range(0, len(self.best), high):
            rows = slice(r, r + high)
            right = tuple(c[rows] for c in self.right)
            for c in range(0, len(tie), wide):
                self._meet(rows, right, tuple(x[c : c + wide] for x in left), tie[c : c + wide])

    def _meet(self, rows: slice, right: tuple[np.ndarray, ...], left: tuple[np.ndarray, ...], tie: np.ndarray) -> None:
        good, *found = self.near(left, right)
        most = good.max(axis=1)
        least = np.maximum(most, self.best[rows])
        with np.errstate(invalid="ignore"):
            least = np.where(np.isneginf(most), np.inf, np.where(np.isfinite(least), least - self.slack - 1e-12 * np.abs(least), least))
        if not (most >= least).any():
            return
        at, by = np.nonzero(good >= least[:, None])
        key = self.exact(tuple(x[by] for x in left), *[x[at, by] for x in found])
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        first = np.flatnonzero(key == np.repeat(np.maximum.reduceat(key, starts), np.diff(np.r_[starts, len(at)])))
        first = first[np.r_[True, at[first[1:]] != at[first[:-1]]]]  # left boxes are in order of ties
        key, by, at = key[first], by[first], at[first] + rows.start
        was, same = self.best[at], tie[by] == self.tie[at]
        new = (key > was) | (key == was) & ((tie[by] < self.tie[at]) | same & (left[0][by] < self.left[0][at]))
        key, by, at = key[new], by[new], at[new]
        self.best[at], self.tie[at] = key, tie[by]
        for kept, x in zip(self.left, left):
            kept[at] = x[by]

    def found(self) -> list[np.ndarray]:
        """Columns of the pairs that are left: of the left box, then of the right one."""
        some = np.flatnonzero(self.best > -np.inf)
        return [c[some] for c in (*self.left, *self.right)]


def leading_met(left: DataFrame, right: DataFrame, by: list[str], id: str, order: Callable[[list[np.ndarray]], Leading]) -> DataFrame:
    """Of the pairs of `met` a few that hold the first of each right box, by `order`: one for each right box in each block of a cell, so a pair can come more than once. `id` is a long.

    Boxes of a cell are compared in blocks inside a task, without a row for any other pair, so what is sorted and
    shuffled is the boxes alone. Cells with many boxes are dealt to several tasks.
    """
    own = [id, *SIDES]
    here, there, group = _dealt(*_cells(left.select(*by, *own), right.select(*by, *own), by))
    one = lambda df, name: df.select(*group, F.lit(name == "l").alias("_left"), *[F.col(f"_{name}_{c}").alias(c) for c in own])
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = one(there, "r").unionByName(one(here, "l"))
    rows = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*by, id])).repartition(tasks, *group).sortWithinPartitions(*group, "_left")
    types = dict(left.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], *[f"_{name}_{c} {types[c]}" for name in "lr" for c in own]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met_by, targets, state, done = None, None, [], None, []

        def close() -> None:
            if state is not None and len((columns := state.found())[0]):
                n = len(columns[0])
                done.append(pa.RecordBatch.from_arrays([*[pa.repeat(v, n) for v in met_by], *map(pa.array, columns)], names=[*by, *[f"_{name}_{c}" for name in "lr" for c in own]]))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            keys = [batch.column(c) for c in group]
            for k in keys:
                new[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
            now = tuple(k[0].as_py() for k in keys)
            new[0] = now != last
            last = tuple(k[-1].as_py() for k in keys)
            is_left = batch.column("_left").to_numpy(zero_copy_only=False)
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in own]
            # cut where a group begins and where its left boxes begin
            cuts = np.flatnonzero(new | np.r_[True, is_left[1:] != is_left[:-1]])
            for start, end in zip(cuts, np.r_[cuts[1:], batch.num_rows]):
                if new[start]:
                    close()
                    met_by, targets, state = [batch.column(c)[int(start)] for c in by], [], None
                part = [c[start:end] for c in columns]
                if not is_left[start]:
                    targets.append(part)
                elif targets:
                    state = state or order([np.concatenate(x) for x in zip(*targets)])
                    state.add(part)
            if done:
                yield from done
                done.clear()
        close()
        yield from done

    out = rows.mapInArrow(run, schema)
    whole = lambda name: F.struct(*[F.col(c) for c in by], *[F.col(f"_{name}_{c}").alias(c) for c in own]).alias(name)
    return out.select(*by, whole("l"), whole("r"))


def union_area(boxes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(case_id, area): exact area of the union of each case's boxes (x0, y0, x1, y1), to nine places. Boxes without area are left out.

    A case is one cell at first. A cell shrinks to what its boxes cover together; one that a single box fills counts whole. A cell of
    at most `crowd` different boxes, or with few edges inside, is measured in slabs between neighbouring x edges. Any other is
    split in PARTS by each axis that has many edges inside it, and its boxes are cut to the parts; so cells become small
    where boxes crowd, and strips aren't cut along their length.
    """
    shared_dir(boxes.sparkSession)
    cell = ["case_id", "node"]
    rows = boxes.filter("x1 > x0 AND y1 > y0").select("case_id", F.lit("").alias("node"), *SIDES).distinct()
    whole: list[DataFrame] = []
    leaves: list[DataFrame] = []
    while True:
        bounds = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))
        held = rows.join(bounds, cell)
        inner = lambda a: (F.col(f"{a}0") > F.col(f"b{a}0")).cast("int") + (F.col(f"{a}1") < F.col(f"b{a}1")).cast("int")
        fills = (F.col("x0") <= F.col("bx0")) & (F.col("y0") <= F.col("by0")) & (F.col("x1") >= F.col("bx1")) & (F.col("y1") >= F.col("by1"))
        facts = held.groupBy(*cell, "n", "bx0", "by0", "bx1", "by1").agg(F.bool_or(fills).alias("full"), F.sum(inner("x")).alias("ex"), F.sum(inner("y")).alias("ey"))
        few = (F.col("n") <= crowd) | ((F.col("ex") * 2 <= crowd) & (F.col("ey") * 2 <= crowd))
        facts = facts.withColumn("what", F.when(F.col("full"), "whole").when(few, "leaf").otherwise("split")).checkpoint()
        counts = {r["what"]: r["count"] for r in facts.groupBy("what").count().collect()}  # three rows
        if counts.get("whole"):
            whole.append(facts.filter("what = 'whole'").select("case_id", ((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))).alias("area")))
        if counts.get("leaf"):
            leaves.append(rows.join(facts.filter("what = 'leaf'").select(*cell), cell))
        if not counts.get("split"):
            break
        split = rows.join(facts.filter("what = 'split'").drop("what", "full", "n"), cell)
        for a, e in (("x", "ex"), ("y", "ey")):
            n = F.when(F.col(e) * 2 > crowd, PARTS).otherwise(1)
            step = (F.col(f"b{a}1") - F.col(f"b{a}0")) / n
            at = lambda c: F.greatest(F.lit(0), F.least(n - 1, F.floor((F.col(c) - F.col(f"b{a}0")) / step))).cast("int")  # noqa: B023, E731
            part = split.withColumn("_n", n).withColumn("_step", step).withColumn(f"_{a}", F.explode(F.sequence(at(f"{a}0"), at(f"{a}1"))))
            low, high = F.col(f"b{a}0") + F.col(f"_{a}") * F.col("_step"), F.when(F.col(f"_{a}") == F.col("_n") - 1, F.col(f"b{a}1")).otherwise(F.col(f"b{a}0") + (F.col(f"_{a}") + 1) * F.col("_step"))
            split = part.withColumns({f"{a}0": F.greatest(f"{a}0", low), f"{a}1": F.least(f"{a}1", high)}).filter(f"{a}1 > {a}0").drop("_n", "_step")
        rows = split.select("case_id", F.concat_ws(".", "node", F.col("_x").cast("string"), F.col("_y").cast("string")).alias("node"), *SIDES).distinct().checkpoint()
    found = [*whole, *[_slabs(x, cell) for x in leaves]]
    if not found:
        return facts.select("case_id", F.lit(0.0).alias("area"))  # no rows
    total = found[0]
    for x in found[1:]:
        total = total.unionByName(x)
    return total.groupBy("case_id").agg(F.round(F.sum("area"), 9).alias("area"))


def _slabs(boxes: DataFrame, cell: list[str]) -> DataFrame:
    """The area of each cell's boxes in slabs between neighbouring x edges, gaps and islands of y in each."""
    edges = boxes.select(*cell, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    slabs = edges.withColumn("to", F.lead("x").over(Window.partitionBy(*cell).orderBy("x"))).filter("to IS NOT NULL")
    inside = slabs.join(boxes, cell).filter("x0 <= x AND x1 >= to")
    upto = F.max("y1").over(Window.partitionBy(*cell, "x").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    lines = inside.withColumn("upto", upto).withColumn("new", F.greatest(F.lit(0.0), F.col("y1") - F.greatest("y0", F.coalesce("upto", F.col("y0")))))
    return lines.groupBy("case_id").agg(F.sum(F.col("new") * (F.col("to") - F.col("x"))).alias("area"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that can be reached over edges (id, other), each in both directions.

    Labels move to the least neighbour and jump to their label's label, with a checkpoint each round, until none changes.
    """
    shared_dir(nodes.sparkSession)
    edges = edges.checkpoint()
    label = nodes.select("id", F.col("id").alias("component")).checkpoint()
    while True:
        low = edges.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("low"))
        moved = label.join(low, "id", "left").select("id", "component", F.least("component", "low").alias("new"))
        jump = label.select(F.col("id").alias("new"), F.col("component").alias("over"))
        moved = moved.join(jump, "new").select("id", "component", F.least("new", "over").alias("new")).checkpoint()
        if moved.filter("new <> component").isEmpty():
            return label
        label = moved.select("id", F.col("new").alias("component"))


def word_components(boxes: DataFrame, least: float = 24.0, wide: float = 2.5, high: float = 2.0) -> DataFrame:
    """(id, component): connected components of a case's words. boxes: case_id, id (unique), x0, y0, x1, y1.

    Two words are neighbours if the gap between them is at most max(least, wide * h) across and max(least, high * h) down, h being the
    height of the taller one. Words whose own reach is alike meet in grid cells no larger than it, so all words of a
    cell are neighbours: they are tied to the least of them, and no pairs are made. Then only cells that these ties have not
    brought together are compared, and of their words those that the other cell is in reach of.
    """
    h = F.col("y1") - F.col("y0")
    reach_x, reach_y = F.greatest(F.lit(least), wide * h), F.greatest(F.lit(least), high * h)
    words = boxes.select("case_id", "id", *SIDES).withColumns({"rx": reach_x, "ry": reach_y, "level": F.floor(F.log2(F.greatest(F.lit(least), min(wide, high) * h))).cast("int")}).checkpoint()
    size = F.pow(F.lit(2.0), "level")
    at = lambda c: F.floor(F.col(c) / size)
    cells = words.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    cell = ["case_id", "level", "cx", "cy"]
    hubs = cells.groupBy(*cell).agg(F.min("id").alias("other"))
    ties = cells.join(hubs, cell).select("id", "other").filter("id <> other").distinct()
    ties = ties.unionByName(ties.select(F.col("other").alias("id"), F.col("id").alias("other"))).checkpoint()
    first = components(words, ties)
    # each cell as one box: what its words cover of it, its component, and the farthest reach of its words
    held = cells.join(first, "id").withColumns({"x0": F.greatest("x0", F.col("cx") * size), "x1": F.least("x1", (F.col("cx") + 1) * size), "y0": F.greatest("y0", F.col("cy") * size), "y1": F.least("y1", (F.col("cy") + 1) * size)})
    crowds = held.groupBy(*cell, "component").agg(*[f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), SIDES)], (F.max("rx") * WIDER).alias("rx"), (F.max("ry") * WIDER).alias("ry")).checkpoint()
    grown = crowds.withColumns({"x0": F.col("x0") - F.col("rx"), "x1": F.col("x1") + F.col("rx"), "y0": F.col("y0") - F.col("ry"), "y1": F.col("y1") + F.col("ry")})
    apart = met(grown, crowds, ["case_id"]).filter("l.component <> r.component")
    key = lambda s: [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in cell[1:]]
    pairs = apart.select("case_id", *key("l"), *key("r"), F.struct(*[f"l.{c}" for c in SIDES]).alias("a"), F.struct(*[f"r.{c}" for c in SIDES]).alias("b")).checkpoint()
    touches = lambda s, dx, dy: (F.col("x0") - dx <= F.col(f"{s}.x1")) & (F.col("x1") + dx >= F.col(f"{s}.x0")) & (F.col("y0") - dy <= F.col(f"{s}.y1")) & (F.col("y1") + dy >= F.col(f"{s}.y0"))
    of = lambda s: cells.select("case_id", *[F.col(c).alias(f"{s}_{c}") for c in cell[1:]], "id", *SIDES, "rx", "ry")
    both = ["case_id", *[f"{s}_{c}" for s in "lr" for c in cell[1:]]]
    left = pairs.join(of("l"), ["case_id", *[f"l_{c}" for c in cell[1:]]]).filter(touches("b", F.col("rx") * WIDER, F.col("ry") * WIDER)).select(*both, F.struct("id", *SIDES, "rx", "ry").alias("p"))
    right = pairs.join(of("r"), ["case_id", *[f"r_{c}" for c in cell[1:]]]).filter(touches("a", F.lit(0.0), F.lit(0.0))).select(*both, F.struct("id", *SIDES).alias("q"))
    gap = lambda a: F.greatest(F.col(f"q.{a}0") - F.col(f"p.{a}1"), F.col(f"p.{a}0") - F.col(f"q.{a}1"))
    near = left.join(right, both).filter((gap("x") <= F.col("p.rx")) & (gap("y") <= F.col("p.ry"))).select(F.col("p.id").alias("id"), F.col("q.id").alias("other")).distinct()
    # words of one component are one from here on
    label = first.withColumnRenamed("id", "_id")
    joined = near.join(label, F.col("id") == F.col("_id")).select("other", F.col("component").alias("a")).join(label, F.col("other") == F.col("_id")).select(F.col("a").alias("id"), F.col("component").alias("other")).distinct()
    joined = joined.unionByName(joined.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    final = components(first.select(F.col("component").alias("id")).distinct(), joined).withColumnsRenamed({"id": "_c", "component": "_to"})
    return first.join(final, F.col("component") == F.col("_c")).select("id", F.col("_to").alias("component"))
