"""Clusters of overlapping rectangles and calls made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import intersects
from .rangejoin import box_join


def islands(rows: DataFrame, keys: list[str], start: str, end: Column, tie: list[str], gap: int = 0) -> DataFrame:
    """Adds island: a number for each group of intervals, cut where one starts more than gap after all before it."""
    order = W.partitionBy(*keys).orderBy(start, *tie)
    before = F.max("__end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("__end", end).withColumn("__new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    return marked.withColumn("island", F.sum("__new").over(order)).drop("__end", "__new")


def overlap_edges(boxes: DataFrame, keys: list[str], cell: int = 64) -> DataFrame:
    """(a, b): ids of rectangles that touch, a < b, equal in keys."""
    narrow = boxes.select("id", *keys, "x", "y", "w", "h")
    pairs = box_join(narrow, narrow, intersects() & (F.col("a_id") < F.col("b_id")), keys, cell=cell)
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def components(edges: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """(id, component): the smallest id of each connected component, over edges (a, b) of numbers.

    Each round every node takes the smallest label among its neighbours, and then that label's label, which halves paths;
    rounds go on until a sum over labels stays. Labels are written each round, so that the plan doesn't grow.
    """
    both = _written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), checkpoint)
    labels = _written(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("l")).select(F.col("a").alias("id"), "l"), checkpoint)
    before = None
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("l", "m").alias("l"))
        up = step.select(F.col("id").alias("l"), F.col("l").alias("ll"))
        labels = _written(step.join(up, "l").select("id", F.least("l", "ll").alias("l")), checkpoint)
        now = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels.withColumnRenamed("l", "component")
        before = now


def _written(df: DataFrame, folder: str | None) -> DataFrame:
    """df cut from its lineage, through the shared checkpoint folder."""
    import tempfile

    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder or df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="seqloom-"))
    kept = df.persist()  # else a checkpoint computes its rows twice
    try:
        return kept.checkpoint()
    finally:
        kept.unpersist()


def combine(calls: DataFrame, keys: list[str], insert_gap: int, cell: int = 128) -> DataFrame:
    """Overlapping calls of equal keys whose inserted sizes differ by at most insert_gap, merged transitively: bounding boxes with
    summed support and the highest ambiguity, named after the smallest id. Rows of one id count as one call of several boxes.

    Calls are dealt to the cells that they touch. Each cell joins its calls without listing their pairs and gives one row for
    each group; only calls listed in several cells link groups, so that components are sought among groups, not calls.
    """
    from ..llm.common import bounded, stage

    box, sums = ["x", "y", "w", "h", "inserted_size"], ["reads", "nt", "ambiguity"]
    rows = calls.select("id", *keys, *[F.col(c).cast("long").alias(c) for c in box + sums])
    known = lambda names: F.concat(*[F.col(c).isNotNull().cast("string") for c in names]).contains("false") == F.lit(False)
    twice = stage(calls.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit(True).alias("__again")), "twice")
    placed = rows.filter(known(["id", *keys, *box]))
    placed = placed.join(bounded(twice, 24), "id", "left") if twice.head(1) else placed.withColumn("__again", F.lit(None).cast("boolean"))
    whole = known(sums)
    first = {c: F.floor(F.col(c) / cell) for c in ("x", "y")}
    last = {c: F.floor((F.col(c) + F.col(size)) / cell) for c, size in (("x", "w"), ("y", "h"))}
    linked = F.coalesce(F.col("__again"), F.lit(False)) | ~whole | (first["x"] != last["x"]) | (first["y"] != last["y"])
    dealt = placed.withColumn("linked", linked).withColumn("cx", F.explode(F.sequence(first["x"], last["x"]))).withColumn("cy", F.explode(F.sequence(first["y"], last["y"])))
    home = whole & (F.col("cx") == first["x"]) & (F.col("cy") == first["y"])
    dealt = dealt.select("id", *keys, "cx", "cy", *box, *[F.when(home, F.col(c)).alias(c) for c in sums], "linked")
    place = [*keys, "cx", "cy"]
    local = stage(dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(_local_groups(place, insert_gap), f"id {_kind(calls)}, rep {_kind(calls)}, x long, y long, x1 long, y1 long, reads long, nt long, ambiguity long, n long"), "groups")

    # rows with unknown values are groups of their own, linked by their id
    odd = rows.filter(~known(["id", *keys, *box, *sums]))
    groups = local.filter("n is not null").drop("id").unionByName(odd.select(
        F.col("id").alias("rep"), "x", "y", (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), *sums, F.lit(1).cast("long").alias("n")
    ))
    links = local.filter("n is null").select("id", "rep").unionByName(odd.filter("id is not null").select("id", F.col("id").alias("rep")))
    met = links.groupBy("id").agg(F.collect_set("rep").alias("reps")).filter(F.size("reps") > 1).select(F.explode("reps").alias("a"), F.array_min("reps").alias("b"))
    labels = components(met.filter("a <> b").distinct())
    named = groups.join(bounded(labels, 32), F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rep"))
    return named.groupBy("component").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x")).alias("w"), (F.max("y1") - F.min("y")).alias("h"), F.sum("reads").alias("reads"), F.sum("nt").alias("nt"),
        F.max("ambiguity").alias("ambiguity"), F.sum("n").alias("n"),
    ).withColumnRenamed("component", "id")


def _kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def _local_groups(place: list[str], insert_gap: int):
    """Of calls that come cell by cell: a row (rep, ..., n) for each group with calls at home in the cell, and (id, rep) for each linked call."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["x", "y", "x1", "y1", "reads", "nt", "ambiguity", "n"]

        def result(ids, reps, values):
            blank = pa.nulls(len(reps), pa.int64())
            return pa.RecordBatch.from_arrays([ids, reps, *(values or [blank] * len(names))], names=["id", "rep", *names])

        def of_cells(table):
            """Rows of whole cells."""
            get = lambda c: table.column(c).to_numpy()
            ids, x, y, z = get("id"), get("x"), get("y"), get("inserted_size")
            x1, y1 = x + get("w"), y + get("h")
            starts = np.concatenate(([0], _changes(table, place), [len(ids)]))
            group = np.empty(len(ids), np.int64)
            n = 0
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                group[lo:hi] = _touching_alike(x[lo:hi], x1[lo:hi], y[lo:hi], y1[lo:hi], z[lo:hi], insert_gap) + n
                n = int(group[lo:hi].max()) + 1
            rep = np.full(n, np.iinfo(ids.dtype).max, ids.dtype)
            np.minimum.at(rep, group, ids)
            linked = get("linked")
            if linked.any():
                yield result(pa.array(ids[linked]), pa.array(rep[group[linked]]), None)
            at_home = table.column("reads").is_valid().to_numpy()
            g = group[at_home]
            if not len(g):
                return
            reached = np.unique(g)
            out = []
            for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x1), (np.maximum, y1), (np.add, "reads"), (np.add, "nt"), (np.maximum, "ambiguity"), (np.add, None)):
                if v is None:
                    v = np.ones(len(ids), np.int64)
                elif isinstance(v, str):
                    v = table.column(v).fill_null(0).to_numpy()
                info = np.iinfo(np.int64)
                total = np.full(n, {np.minimum: info.max, np.maximum: info.min, np.add: 0}[f], np.int64)
                f.at(total, g, v[at_home])
                out.append(pa.array(total[reached]))
            yield result(pa.nulls(len(reached), pa.from_numpy_dtype(ids.dtype)), pa.array(rep[reached]), out)

        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            if kept.num_rows < 20_000:
                continue
            kept = kept.combine_chunks()
            cuts = _changes(kept, place)
            if len(cuts):  # the last cell may go on
                yield from of_cells(kept.slice(0, int(cuts[-1])))
                kept = kept.slice(int(cuts[-1]))
        if kept is not None and kept.num_rows:
            yield from of_cells(kept.combine_chunks())

    return run


def _changes(table, place: list[str]):
    """Rows that lie in another cell than the row before."""
    import numpy as np

    differs = np.zeros(max(0, table.num_rows - 1), bool)
    for c in place:
        v = table.column(c).to_numpy()
        differs |= v[1:] != v[:-1]
    return np.flatnonzero(differs) + 1


def _touching_alike(x, x1, y, y1, z, gap: int):
    """A group number for each closed box: boxes touch if also their z differ by at most gap; groups are transitive.

    Few boxes are compared all with all. Of many each is looked for only until it is found: the dense are found soon.
    """
    import numpy as np

    n = len(x)
    if n == 1:
        return np.zeros(1, np.int64)
    meets = lambda i, j: (x[i, None] <= x1[j]) & (x[j] <= x1[i, None]) & (y[i, None] <= y1[j]) & (y[j] <= y1[i, None]) & (np.abs(z[i, None] - z[j]) <= gap)
    label = np.arange(n)
    if n <= 512:
        every = np.arange(n)
        a, b = np.nonzero(np.triu(meets(every, every), 1))
        if len(a) <= 16 * n:
            parent = list(range(n))

            def find(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                i, j = find(i), find(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
            label = np.array([find(i) for i in range(n)])
            return np.unique(label, return_inverse=True)[1]
    rest, number = np.arange(n), 0
    while len(rest):
        front, rest = rest[:1], rest[1:]
        label[front] = number
        while len(front) and len(rest):
            some, front = front[:32], front[32:]
            found = meets(some, rest).any(axis=0)
            if found.any():
                label[rest[found]] = number
                front, rest = np.concatenate([front, rest[found]]), rest[~found]
        number += 1
    return label


def order_statistic(column: str, share: float) -> Column:
    """The value at floor(n * share) of the sorted values of a group."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, F.floor(F.size(values) * share).cast("int") + 1)


def one_per_read(members: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """Of the jumps of one read in a cluster the first by `by`."""
    order = W.partitionBy(*keys, "read_id").orderBy(*by)
    return members.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def sweep(jumps: DataFrame, least_reads: int = 2, cell: int = 1024) -> DataFrame:
    """Clusters of rectangles of one section that touch transitively: (section, x, y, w, h, n_reads, nt, n_jumps, first_id).

    jumps: (id, read_id, nt, section, x, y, w, h). Rectangles are dealt to the cells of the x axis that they touch; in each
    cell a sweep joins what touches and hands on one edge for each rectangle; components over these edges are the clusters.
    So no cluster need fit into one task, and dense ones don't give all their pairs.
    """
    import pandas as pd

    first, last = F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("w")) / cell)
    dealt = jumps.select("id", "section", "x", "y", "w", "h", F.explode(F.sequence(first, last)).alias("cell"))

    def local(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["id"].tolist()
        out = []
        for members in touching(list(zip(part["x"], part["y"], part["w"], part["h"], strict=True))):
            least = min(ids[i] for i in members)
            out += [(ids[i], least) for i in members if ids[i] != least]
        return pd.DataFrame(out, columns=["a", "b"])

    labels = components(dealt.groupBy("section", "cell").applyInPandas(local, "a long, b long"))
    named = jumps.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    right, top = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    per = named.groupBy("section", "component").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (top - F.min("y")).alias("h"), F.countDistinct("read_id").alias("n_reads"),
        F.sum("nt").alias("nt"), F.count(F.lit(1)).alias("n_jumps"),
    )
    return per.filter(F.col("n_reads") >= least_reads).withColumnRenamed("component", "first_id")


def touching(boxes: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Indices of closed boxes, grouped by transitive contact. A sweep over x with the open boxes in order of y."""
    import bisect

    parent = list(range(len(boxes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    events = sorted([(b[0], 0, i) for i, b in enumerate(boxes)] + [(b[0] + b[2], 1, i) for i, b in enumerate(boxes)])
    open_: list[tuple[int, int]] = []
    tallest = max((b[3] for b in boxes), default=0)
    for _, closing, i in events:
        y = boxes[i][1]
        if closing:
            open_.pop(bisect.bisect_left(open_, (y, i)))
            continue
        top = y + boxes[i][3]
        for k in range(bisect.bisect_left(open_, (y - tallest, -1)), len(open_)):
            other_y, j = open_[k]
            if other_y > top:
                break
            if other_y + boxes[j][3] >= y:
                parent[find(j)] = find(i)
        bisect.insort(open_, (y, i))
    groups: dict[int, list[int]] = {}
    for i in range(len(boxes)):
        groups.setdefault(find(i), []).append(i)
    return sorted(groups.values())


def merge_one_sided(dummies: DataFrame, calls: DataFrame, blur: int, least: float) -> DataFrame:
    """For each one-sided call the best two-sided call in a vertical or horizontal strip around it: (dummy_id, call_id, score, x, y).

    dummies(id, run, pos, from_known, from_fwd, to_fwd), calls(id, run, x, y, w, h, from_fwd, to_fwd, score). Strands of the
    known end agree and the score exceeds `least`; ties go to the smallest id. The coordinate that both have is averaged.
    All dummies see the calls as they were, where a sequential rule would show later ones the changes of earlier ones.
    """
    parts = []
    for known, axis, strand in ((True, "x", "from_fwd"), (False, "y", "to_fwd")):
        asked = dummies.filter(F.col("from_known") == known).select(F.col("id").alias("dummy_id"), "run", "pos", F.col(strand).alias("fwd"))
        # of the calls of one position only the best can be taken, and dummies of one position take the same
        place = ["run", "fwd", "pos"]
        best = F.struct((-F.col("score")).alias("s"), F.col("id").alias("call_id"), "score", "x", "y")
        best = calls.filter(F.col("score") > least).select("run", F.col(strand).alias("fwd"), F.col(axis).alias("pos"), best.alias("best")).groupBy(*place).agg(F.min("best").alias("best"))
        cell = lambda to: F.floor((F.col("pos") + to) / blur)
        strips = asked.select(place).distinct().withColumn("cell", F.explode(F.sequence(cell(-blur), cell(blur))))
        there = best.select("run", "fwd", F.col("pos").alias("at"), "best", cell(0).alias("cell"))
        found = strips.join(there, ["run", "fwd", "cell"]).filter(F.abs(F.col("pos") - F.col("at")) <= blur).groupBy(*place).agg(F.min("best").alias("best"))
        near = asked.join(found, place).select("dummy_id", "best.call_id", "best.score", "best.x", "best.y", "pos")
        middle = F.floor((F.col("pos") + F.col(axis)) / 2)
        parts.append(near.select("dummy_id", "call_id", "score", *[middle.alias(c) if c == axis else F.col(c) for c in ("x", "y")]))
    best = F.row_number().over(W.partitionBy("dummy_id").orderBy(F.desc("score"), "call_id"))
    return parts[0].unionByName(parts[1]).withColumn("n", best).filter("n = 1").drop("n")
