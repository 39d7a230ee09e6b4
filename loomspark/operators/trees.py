"""Trees that explain labels: exact splits by Gini impurity, found on the executors.

For each level one aggregation counts the labels of every distinct value of every axis within every node; running sums
over these, in sorted order, give both sides of every threshold at once, and one row for each node comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import workspace
from .sequences import running_sums

#: Digits to which gains are compared, so that equal splits tie in spite of rounding.
DIGITS = 12


def _finite(x: Column) -> Column:
    """The value as a double; what is not finite counts as missing."""
    v = x.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _route(rules: dict[int, dict], axis_of) -> Column:
    """The node that a row reaches from its node by the rules of that node."""
    out = F.col("node")
    for node, rule in rules.items():
        v = axis_of(rule["axis"])
        left = F.when(v.isNull(), F.lit(rule["missing_goes"] == "left")).otherwise(v <= rule["threshold"])
        out = F.when(F.col("node") == node, F.when(left, F.lit(2 * node)).otherwise(F.lit(2 * node + 1))).otherwise(out)
    return out


def best_splits(cells: DataFrame, axes: list[str], n_labels: int, least: int) -> DataFrame:
    """node, gain, axis (place), threshold, left: the split of each node that gains most, if any gains.

    cells: node, axis (place), value, c0, c1, ... (counts of each label among the node's rows with that value, null where it
    is missing). Thresholds lie midway between neighbouring values that the node has; missing values go to the left or to
    the right as one; both sides have `least` rows or more. Ties go to the earlier axis, the smaller threshold, missing left.
    """
    names = [f"c{k}" for k in range(n_labels)]
    run = running_sums(cells.where("value is not null"), ["node", "axis"], "value", {c: F.col(c) for c in names}).where("following is not null")
    # A row for each node and axis.
    missing = cells.where("value is null").groupBy("node", "axis").agg(*[F.sum(c).alias(f"m_{c}") for c in names])
    met = run.join(F.broadcast(missing), ["node", "axis"], "left").withColumn("left", F.explode(F.array(F.lit(1), F.lit(0))))
    counts = lambda kind, c: F.col(f"{kind}_{c}").cast("double")
    m = {c: F.coalesce(counts("m", c), F.lit(0.0)) for c in names}
    lefts = [counts("upto", c) + m[c] * F.col("left") for c in names]
    rights = [counts("all", c) - counts("upto", c) + m[c] * (1 - F.col("left")) for c in names]
    total = lambda xs: sum(xs[1:], xs[0])
    sides = [(total(xs), total([x * x for x in xs])) for xs in (lefts, rights)]
    n, squares = total([a + b for a, b in zip(lefts, rights, strict=True)]), total([(a + b) * (a + b) for a, b in zip(lefts, rights, strict=True)])
    (nl, sl), (nr, sr) = sides
    gain = F.round((F.try_divide(sl, nl) + F.try_divide(sr, nr)) / n - squares / (n * n), DIGITS)
    value, following = F.col("value"), F.col("following")
    middle = value + (following - value) / 2
    middle = F.when(middle < following, middle).otherwise(value)  # of neighbouring doubles the lower one
    found = met.where((nl >= least) & (nr >= least)).select("node", gain.alias("gain"), "axis", middle.alias("threshold"), "left")
    best = found.where("gain > 0").groupBy("node").agg(F.max(F.struct("gain", -F.col("axis"), -F.col("threshold"), "left")).alias("s"))
    s = lambda k: F.col("s").getField(k)
    return best.select("node", s("gain").alias("gain"), (-s("col2")).alias("axis"), (-s("col3")).alias("threshold"), (s("left") == 1).alias("left"))


def explain_labels(df: DataFrame, label: str, axes: list[str], depth: int = 3, least: int = 5) -> list[dict]:
    """A tree as rows: node (1 is the root, 2k and 2k + 1 are the children of k), depth, axis, threshold, missing_goes, gain
    (all null for a leaf), label (the node's most frequent, ties: the smaller), n, and counts of each label.

    A node with one label only, at the greatest depth, or with fewer than 2 * least rows is a leaf. Values above a threshold
    go right; null, NaN and infinite ones are missing. Rows with a null label are left out; an empty table gives no rows.
    Labels are as few as clusters are: the driver holds a count for each node and label, and one split for each node.
    """
    spark, where = df.sparkSession, workspace(df.sparkSession)
    df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), *[_finite(F.col(a)).alias(f"x{k}") for k, a in enumerate(axes)]).write.parquet(where)
    rows = spark.read.parquet(where).withColumn("node", F.lit(1))
    labels, out = None, []
    for level in range(depth + 1):
        sizes: dict[int, dict] = {}
        for r in rows.groupBy("node", "label").agg(F.count("*").alias("n")).collect():  # nodes x labels
            sizes.setdefault(r["node"], {})[r["label"]] = r["n"]
        if labels is None:
            labels = sorted({x for c in sizes.values() for x in c})
        open_ = [k for k, c in sizes.items() if level < depth and len(c) > 1 and sum(c.values()) >= 2 * least]
        rules = {}
        if open_:
            long = rows.where(F.col("node").isin(open_)).select("node", "label", F.posexplode(F.array(*[f"x{k}" for k in range(len(axes))])).alias("axis", "value"))
            cells = long.groupBy("node", "axis", "value").agg(*[F.count_if(F.col("label") == x).alias(f"c{k}") for k, x in enumerate(labels)])
            rules = {r["node"]: {"axis": axes[r["axis"]], "threshold": r["threshold"], "missing_goes": "left" if r["left"] else "right", "gain": r["gain"]} for r in best_splits(cells, axes, len(labels), least).collect()}
        for node in sorted(sizes):
            counts = sizes[node]
            most = max(counts.values())
            none = {"axis": None, "threshold": None, "missing_goes": None, "gain": None}
            out.append({"node": node, "depth": level, **(rules.get(node) or none), "label": min(x for x in counts if counts[x] == most), "n": sum(counts.values()), "counts": [counts.get(x, 0) for x in labels]})
        if not rules:
            break
        rows = rows.where(F.col("node").isin(list(rules))).withColumn("node", _route(rules, lambda a: F.col(f"x{axes.index(a)}")))
    return out


def predicted(df: DataFrame, tree: list[dict], name: str = "tree_prediction") -> DataFrame:
    """Adds the label of the leaf that each row reaches."""
    split = {r["node"]: r for r in tree if r["axis"] is not None}
    leaf = {r["node"]: r["label"] for r in tree}

    def walk(node: int) -> Column:
        if node not in split:
            return F.lit(leaf[node])
        r = split[node]
        v = _finite(F.col(r["axis"]))
        left = F.when(v.isNull(), F.lit(r["missing_goes"] == "left")).otherwise(v <= r["threshold"])
        return F.when(left, walk(2 * node)).otherwise(walk(2 * node + 1))

    return df.withColumn(name, walk(1) if tree else F.lit(None))


def tree_lines(tree: list[dict], node: int = 1, indent: str = "") -> list[str]:
    """The tree as text, a line for each node."""
    at = {r["node"]: r for r in tree}
    if node not in at:
        return []
    r = at[node]
    if r["axis"] is None:
        return [f"{indent}label {r['label']} ({r['n']} rows, {r['counts']})"]
    head = f"{indent}{r['axis']} <= {r['threshold']:.6g}, missing goes {r['missing_goes']}"
    return [head, *tree_lines(tree, 2 * node, indent + "    yes: "), *tree_lines(tree, 2 * node + 1, indent + "    no: ")]
