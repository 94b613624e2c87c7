"""Local explanations.

Inside the engine a sample keeps its contributions in one array column, ``drivers``:
``array<struct<k, feature, feature_value, model_input_value, contribution>>``. ``k`` is the negated
magnitude, so the array is stored in rank order: magnitude descending, then feature. Choosing the
strongest driver and cutting to the top k are row-local, and the long table (one row per sample
and feature) is only produced on request.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.labels import direction, predicted, ratio_or_zero, snap
from riskloom.functions.text import sample_id
from riskloom.schemas import EXPLANATION_COLUMNS, SAMPLE_KEYS
from riskloom.staging import stage

SAMPLE_COLUMNS = ["sample_id", *SAMPLE_KEYS]


def driver(feature: str, value: Column, model_value: Column, contribution: Column) -> Column:
    size = snap(contribution.cast("double"))
    return F.struct(
        (-F.abs(size)).alias("k"), F.lit(feature).alias("feature"),
        value.cast("double").alias("feature_value"),
        model_value.cast("double").alias("model_input_value"), size.alias("contribution"))


def linear_drivers(df: DataFrame, model: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """Coefficient times standardized value; ``model`` maps feature to (coef, centre, scale)."""
    entries = []
    for feature, (coefficient, centre, scale) in model.items():
        value = F.col(feature).cast("double")
        standard = (value - F.lit(float(centre))) / F.lit(float(scale))
        entries.append(driver(feature, value, standard, F.lit(float(coefficient)) * standard))
    return df.withColumn("drivers", F.sort_array(F.array(*entries))).withColumns({
        "explanation_method": F.lit("linear_coefficient_transformed"),
        "contribution_space": F.lit("log_odds")})


def linear_facts(df: DataFrame, model: Mapping[str, tuple[float, float, float]], known: Sequence[str]) -> DataFrame:
    """Add what ``top_drivers_of`` and ``guidance_facts_of`` take from the drivers of a linear model, without their lists.

    The features of a linear model are the same for all rows, so the strongest contribution of a side is a maximum over
    plain numbers in the order of the names; equal ones go by feature, NaN loses, as in the order of the lists. ``known`` are the features with guidance.
    """
    def terms(features: list[str]) -> Column:
        return F.array(*[snap(F.lit(float(b)) * ((F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s))))
                         for f, b, m, s in ((f, *model[f]) for f in features)]).cast("array<double>")

    def most(values: Column) -> Column:
        largest = F.array_max(values)
        real = F.when(F.isnan(largest), F.array_max(F.filter(values, lambda x: ~F.isnan(x)))).otherwise(largest)
        return F.when(real > 0, real).when(F.isnan(largest), largest)

    def least(values: Column) -> Column:
        lowest = F.array_min(values)
        return F.when(lowest < 0, lowest)

    def owner(features: list[str], values: str, value: str) -> Column:
        return F.try_element_at(F.array(*map(F.lit, features)).cast("array<string>"), place(F.col(values), F.col(value)))

    def count(values: str, kept) -> Column:
        return F.size(F.filter(values, kept)).cast("long")

    names = sorted(model)
    told = [f for f in names if f in known]
    up, down, held = "top_risk_contribution", "top_protective_contribution", "_terms"
    rows = df.withColumn("_terms", terms(names)).withColumns({up: most(F.col("_terms")), down: least(F.col("_terms"))})
    if told != names:
        up, down, held = "_up", "_down", "_told"
        rows = rows.withColumn("_told", terms(told)).withColumns({up: most(F.col("_told")), down: least(F.col("_told"))})
    return rows.withColumns({
        "top_risk_feature": owner(names, "_terms", "top_risk_contribution"),
        "top_protective_feature": owner(names, "_terms", "top_protective_contribution"),
        "_g": F.struct(owner(told, held, up).alias("up"), owner(told, held, down).alias("down"),
                       count(held, lambda c: c > 0).alias("ups"), count(held, lambda c: c < 0).alias("downs")),
    }).drop("_terms", "_told", "_up", "_down")


def total_magnitude(drivers: Column) -> Column:
    return F.aggregate(drivers, F.lit(0.0), lambda acc, d: acc + F.abs(d["contribution"]))


def strongest(drivers: Column, keep) -> Column:
    """First driver in rank order that satisfies ``keep``, or null."""
    return F.try_element_at(F.filter(drivers, keep), F.lit(1))


def driver_rows(samples: DataFrame, *keep: str, drivers: str = "drivers") -> DataFrame:
    """The ``keep`` columns with every driver ``_x`` of a sample and its place ``_at``, from 0.

    An inner explode lets the optimizer test the size of the list first. That computes the list a second time, and in a method
    that is too large to be compiled.
    """
    return samples.select(*keep, F.posexplode_outer(drivers).alias("_at", "_x")).where(F.col("_at").isNotNull())


def to_long(samples: DataFrame, top_k: int | None = None) -> DataFrame:
    """One row per sample and feature, ranked and normalized over the retained rows."""
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be positive.")
    drivers = F.col("drivers")
    kept = samples.withColumn("_d", drivers if top_k is None else F.slice(drivers, 1, top_k))
    kept = kept.withColumn("_total", total_magnitude(F.col("_d")))
    rows = driver_rows(kept, "*", drivers="_d")
    contribution = F.col("_x.contribution")
    return rows.withColumns({
        "sample_id": sample_id(F.col("project"), F.col("file_path"), F.col("snapshot_date")),
        "predicted_label": predicted(F.col("risk_score"), F.col("decision_threshold")),
        "feature": F.col("_x.feature"), "feature_value": F.col("_x.feature_value"),
        "model_input_value": F.col("_x.model_input_value"), "contribution": contribution,
        "absolute_contribution": F.abs(contribution),
        "normalized_contribution": ratio_or_zero(F.abs(contribution), F.col("_total")),
        "direction": direction(contribution),
        "feature_rank": (F.col("_at") + 1).cast("long"),
    }).select(*EXPLANATION_COLUMNS)


def from_long(explanations: DataFrame) -> DataFrame:
    """Back to one row per sample; a sample has at most one row per predictor."""
    first = ["sample_id", *SAMPLE_KEYS, "explanation_method", "contribution_space"]
    return explanations.groupBy(*first).agg(
        F.max("risk_score").alias("risk_score"),
        F.max("predicted_label").alias("predicted_label"),
        F.max("true_label").alias("true_label"),
        F.sort_array(F.collect_list(F.struct(
            (-F.abs("contribution")).alias("k"), "feature", "feature_value", "model_input_value",
            "contribution"))).alias("drivers"))


def limit_explanations(explanations: DataFrame, top_k: int | None) -> DataFrame:
    """Keep the top k rows of each sample of a long table and renormalize them."""
    if top_k is None:
        return explanations
    if top_k <= 0:
        raise ValueError("top_k must be positive.")
    kept = explanations.where(F.col("feature_rank") <= top_k)
    sample = Window.partitionBy("sample_id", "model", "evaluation_mode")
    return kept.withColumn("normalized_contribution", ratio_or_zero(
        F.col("absolute_contribution"), F.sum("absolute_contribution").over(sample)))


def canonical_order() -> list[Column]:
    return [F.desc("risk_score"), F.asc_nulls_last("project"), F.asc_nulls_last("file_path"),
            F.asc_nulls_last("snapshot_date"), F.asc_nulls_last("model"), F.asc_nulls_last("evaluation_mode")]


DRIVER_COLUMNS = ["top_risk_feature", "top_risk_contribution", "top_protective_feature",
                  "top_protective_contribution"]


def place(values: Column, first: Column) -> Column:
    """Place, from 1, of the first entry equal to ``first``, or null."""
    return F.nullif(F.array_position(values, first), F.lit(0).cast("long")).cast("int")


def plain(samples: DataFrame) -> DataFrame:
    """Add ``_c`` and ``_f``, the contributions and features of the drivers as plain arrays: they are cheaper to search and copy."""
    return samples.withColumns({"_c": F.col("drivers.contribution"), "_f": F.col("drivers.feature")})


def top_drivers_of(rows: DataFrame) -> DataFrame:
    """The columns of ``with_top_drivers`` on rows of ``plain``."""
    c = F.col("_c")
    return rows.withColumns({
        "top_risk_contribution": F.get(F.filter(c, lambda x: x > 0), F.lit(0)),
        "top_protective_contribution": F.get(F.filter(c, lambda x: x < 0), F.lit(0)),
    }).withColumns({
        "top_risk_feature": F.try_element_at("_f", place(c, F.col("top_risk_contribution"))),
        "top_protective_feature": F.try_element_at("_f", place(c, F.col("top_protective_contribution")))})


def with_top_drivers(samples: DataFrame) -> DataFrame:
    """Add the strongest risk and protective driver of every sample."""
    return top_drivers_of(plain(samples)).drop("_c", "_f")


def add_top_drivers(ranking: DataFrame, explanations: DataFrame) -> DataFrame:
    """Left join the strongest drivers of a long explanation table onto a ranking."""
    drivers = F.sort_array(F.collect_list(F.struct(
        (-F.abs("contribution")).alias("k"), "feature", "contribution")))
    samples = explanations.groupBy(*SAMPLE_KEYS).agg(drivers.alias("drivers"))
    tops = with_top_drivers(samples).select(*SAMPLE_KEYS, *DRIVER_COLUMNS)
    return ranking.drop(*DRIVER_COLUMNS).join(tops, SAMPLE_KEYS, "left")


def explanation_totals(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("explained_samples"),
                       F.sum(F.size("drivers")).alias("contributions"))


def _exploded(samples: DataFrame, *keep: str) -> DataFrame:
    return driver_rows(samples, *keep).select(
        *keep, "_x.feature", "_x.contribution", direction(F.col("_x.contribution")).alias("direction"))


def common_directions(samples: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent features per direction: (direction, feature, sample_count, position)."""
    counts = (
        _exploded(samples).where(F.col("direction") != "neutral")
        .groupBy("direction", "feature").agg(F.count(F.lit(1)).alias("sample_count"))
    )
    # One row per direction and predictor: the window holds a handful of rows.
    order = Window.partitionBy("direction").orderBy(F.desc("sample_count"), "feature")
    return counts.withColumn("position", F.row_number().over(order).cast("long")).where(
        F.col("position") <= limit)


def average_magnitudes(samples: DataFrame) -> DataFrame:
    return (
        _exploded(samples).groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("average_absolute_contribution"))
        .orderBy(F.desc("average_absolute_contribution"), "feature")
    )


def method_usage(samples: DataFrame) -> DataFrame:
    return samples.groupBy("model", "explanation_method", "contribution_space").agg(
        F.count(F.lit(1)).alias("explained_samples"))


def tree_nodes(model, path: str) -> DataFrame:
    """Node table of a fitted forest: (tree, node, left, right, feature, threshold, p)."""
    if hasattr(model, "nodes"):  # stored in pages already
        return model.nodes()
    spark = SparkSession.active()
    model.write().overwrite().save(path)
    stats = F.col("nodeData.impurityStats")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        (F.element_at(stats, 2) / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)).alias("p"))


PAGE_NODES = 4_096
WALK_ROWS = 100_000
#: Thresholds that a task holds at most; rows of larger forests walk one by one.
MOST_CUTS = 1_000_000


def node_pages(nodes: DataFrame, size: int = PAGE_NODES) -> DataFrame:
    """Stored pages of a node table: ``size`` successive numbers of one tree a row, in (tree, page) order.

    Nodes are numbered from the root, 0, and a child must have a higher number than its parent, as in the
    trees Spark fits. A walk therefore only moves on to later pages.
    """
    ahead = F.when((F.col("left") >= 0) & (F.least("left", "right") <= F.col("node")),
                   F.raise_error(F.lit("A child must have a higher number than its parent."))).otherwise(F.col("left"))
    cells = nodes.select("tree", F.floor(F.col("node") / size).alias("page"),
                         F.struct("node", ahead.alias("left"), "right", "feature", "threshold", "p").alias("cell"))
    paged = cells.groupBy("tree", "page").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    return stage(paged.repartitionByRange("tree", "page").sortWithinPartitions("tree", "page"), "nodes")


def forest_drivers(df: DataFrame, nodes: DataFrame, features: Sequence[str],
                   page_nodes: int = PAGE_NODES) -> DataFrame:
    """Path contributions of a forest, averaged over its trees.

    Every step from a node to its child adds the change in positive share to the split feature. The node
    table is stored in pages. A task reads them in order from the shared folder, a page at a time for up to
    WALK_ROWS of its rows, and moves those whose walk has come to the page; a forest of any size passes
    neither through the driver nor whole through memory, and rows are not shuffled. Rows that lie between
    the same thresholds take the same paths, so one of them walks for all.
    """
    pages = node_pages(nodes, page_nodes)
    return paged_drivers(df, pages, features, page_nodes, pages.select("tree").distinct().count())


def paged_drivers(df: DataFrame, pages: DataFrame, features: Sequence[str], page_nodes: int, trees: int,
                  cuts: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """``forest_drivers`` of ``trees`` trees that are stored in pages; ``cuts`` are their thresholds by feature, if known."""
    names, trees = list(features), max(trees, 1)
    paths = _walked(df, pages, names, page_nodes, cuts, False)
    entries = [driver(n, F.col(n), F.col(n), F.col("_paths")[i] / trees) for i, n in enumerate(names)]
    return paths.withColumns({
        "drivers": F.sort_array(F.array(*entries)),
        "explanation_method": F.lit("tree_path_probability"),
        "contribution_space": F.lit("probability_delta")}).drop("_paths")


def page_shares(df: DataFrame, pages: DataFrame, features: Sequence[str], page_nodes: int,
                cuts: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Add ``_paths``, an array of one: the sum over the trees of the positive share of the leaf that a row falls in."""
    return _walked(df, pages, list(features), page_nodes, cuts, True)


def _walked(df: DataFrame, pages: DataFrame, names: list[str], page_nodes: int, cuts, leaves: bool) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("_paths", T.ArrayType(T.DoubleType()), True)])
    files = sorted(pages.inputFiles(), key=lambda name: name.rsplit("/", 1)[-1])
    return df.mapInArrow(_page_walk(files, names, page_nodes, cuts, leaves), schema)


def _read_pages(files: Sequence[str]):
    """(tree, page, columns) of the stored pages, one held at a time."""
    from pyarrow import fs, parquet

    for name in files:
        store, path = fs.FileSystem.from_uri(name)
        with store.open_input_file(path) as source:
            for batch in parquet.ParquetFile(source).iter_batches(batch_size=8):
                for tree, page, cells in zip(*(batch.column(c) for c in ("tree", "page", "cells"))):
                    yield tree.as_py(), page.as_py(), {
                        c: cells.values.field(c).to_numpy(zero_copy_only=False)
                        for c in ("node", "left", "right", "feature", "threshold", "p")}


def _cuts(files: Sequence[str], features: int):
    """The thresholds of every feature in order, or None where they are too many to number the cells between them."""
    import numpy as np

    cuts = [np.empty(0)] * features
    for _, _, cells in _read_pages(files):
        inner = cells["left"] >= 0
        split, threshold = cells["feature"][inner], cells["threshold"][inner].astype(float)
        for f in np.unique(split):
            cuts[int(f)] = np.union1d(cuts[int(f)], threshold[split == f])
        if sum(map(len, cuts)) > MOST_CUTS:
            return None
    return cuts if math.prod(len(c) + 1 for c in cuts) < 1 << 62 else None


def _page_sums(table, features: int):
    """Per node of a page the sums of the steps that lead to it from where its path enters the page."""
    import numpy as np

    size = len(table["left"])
    sums = np.zeros((size, features))
    low, high = table["low"], table["low"] + size
    inner = np.flatnonzero(table["left"] >= 0)
    kids = np.concatenate([table["left"][inner], table["right"][inner]])
    parents = np.concatenate([inner, inner])
    here = kids < high
    kids, parents = kids[here] - low, parents[here]
    above = np.full(size, -1)
    above[kids] = parents
    level = kids[above[parents] < 0]
    while level.size:
        up = above[level]
        sums[level] = sums[up]
        sums[level, table["feature"][up]] += table["p"][level] - table["p"][up]
        next_level = np.zeros(size, dtype=bool)
        next_level[level] = True
        level = kids[next_level[parents]]
    return sums


def _page_walk(files: Sequence[str], names: list[str], size: int, known=None, leaves: bool = False):
    """A batch function that adds ``_paths``, the path sums of all trees, or the sum of the shares of their ``leaves``."""
    import numpy as np
    import pyarrow as pa

    def portions(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= WALK_ROWS:
                yield held
                held, rows = [], 0
        if rows:
            yield held

    def paths(x):
        flat, width = x.ravel(), x.shape[1]
        out = np.zeros((len(x), 1 if leaves else width))
        tree, waiting = None, np.empty(0, dtype=int)
        for number, page, cells in _read_pages(files):
            low, high = page * size, (page + 1) * size
            if number != tree:
                if waiting.size:
                    raise ValueError(f"Tree {tree} names a node that it does not hold.")
                tree, waiting = number, np.arange(len(x))
                at, split, share = np.zeros(len(x), dtype=int), np.full(len(x), -1), np.zeros(len(x))
            here = waiting[at[waiting] < high]
            waiting = waiting[at[waiting] >= high]
            if not here.size:
                continue
            table = {c: np.full(size, -1) for c in ("left", "right", "feature")}
            table |= {c: np.full(size, np.nan) for c in ("threshold", "p")}
            for c, column in table.items():
                column[cells["node"] - low] = cells[c]
            sums = None if leaves else _page_sums(table | {"low": low}, width)
            left, right, feature, threshold, p = (table[c] for c in ("left", "right", "feature", "threshold", "p"))
            node = at[here] - low
            if node.min() < 0:
                raise ValueError(f"Tree {tree} names a node that it does not hold.")
            if not leaves:
                moved = split[here] >= 0
                out[here[moved], split[here[moved]]] += (p[node] - share[here])[moved]
            start = here * width
            while here.size:
                if np.isnan(p.take(node)).any():
                    raise ValueError(f"Tree {tree} names a node that it does not hold.")
                after = np.where(flat.take(start + feature.take(node)) <= threshold.take(node), left.take(node), right.take(node))
                inner, far = left.take(node) >= 0, after >= high
                done = ~inner | far
                if done.any():
                    if leaves:
                        out[here[~inner], 0] += p[node[~inner]]
                    else:
                        out[here[done]] += sums[node[done]]
                    leave = inner & far
                    gone, last = here[leave], node[leave]
                    at[gone], split[gone], share[gone] = after[leave], feature[last], p[last]
                    waiting = np.concatenate([waiting, gone])
                    here, start, after = here[~done], start[~done], after[~done]
                node = after - low
        if waiting.size:
            raise ValueError(f"Tree {tree} names a node that it does not hold.")
        return out

    def walk(batches):
        cuts = [np.array(c, float) for c in known] if known is not None else _cuts(files, len(names))
        for held in portions(batches):
            x = np.column_stack([np.concatenate([
                b.column(b.schema.get_field_index(n)).cast(pa.float64()).to_numpy(zero_copy_only=False) for b in held]) for n in names])
            if leaves and np.isnan(x).any():
                raise ValueError("A forest scores rows with a value of every predictor.")
            if cuts is None:
                out = paths(x)
            else:
                cell = np.zeros(len(x), dtype=np.int64)
                for i, c in enumerate(cuts):  # NaN goes right everywhere, as beyond the last threshold
                    cell = cell * (len(c) + 1) + np.searchsorted(c, x[:, i], side="left")
                _, first, which = np.unique(cell, return_index=True, return_inverse=True)
                out = paths(x[first])[which]
            done = 0
            for b in held:
                part = out[done:done + b.num_rows]
                done += b.num_rows
                sums = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1], part.ravel())
                yield pa.RecordBatch.from_arrays([*b.columns, sums], names=[*b.schema.names, "_paths"])

    return walk


def median_drivers(df: DataFrame, score, medians: Mapping[str, float],
                   features: Sequence[str]) -> DataFrame:
    """Fallback for other models: score minus the score with one feature at its median.

    ``score`` maps a DataFrame with the feature columns to the same rows plus ``risk_score``.
    """
    moved = df.withColumnRenamed("risk_score", "_base").withColumns({f"_raw_{f}": F.col(f) for f in features})
    for f in features:
        moved = (
            score(moved.withColumn(f, F.lit(float(medians[f]))))
            .withColumnRenamed("risk_score", f"_moved_{f}").withColumn(f, F.col(f"_raw_{f}"))
        )
    named = moved.withColumnRenamed("_base", "risk_score").drop(*[f"_raw_{f}" for f in features])
    named = named.withColumns({f"_moved_{f}": F.col("risk_score") - F.col(f"_moved_{f}") for f in features})
    entries = [driver(f, F.col(f), F.col(f), F.col(f"_moved_{f}")) for f in features]
    return named.withColumns({
        "drivers": F.sort_array(F.array(*entries)),
        "explanation_method": F.lit("local_median_perturbation"),
        "contribution_space": F.lit("probability_delta"),
    }).drop(*[f"_moved_{f}" for f in features])
