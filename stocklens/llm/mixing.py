"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Minimise ``sum(size * (r log r - r))`` over the documents' rates r, subject to
token constraints: ``sum(size * r) = target`` over the documents of each
constraint. Constraints may overlap (a source, a language, a band of sizes).
The convex dual is ``sum(size * exp(x's of a document's constraints)) - x * target``,
and rates tilt exponentially: ``r = exp(sum of x)``.

``balance`` solves the dual by damped Newton steps. Documents of the same
constraints have the same rate, so they are summed to a group once, in one
distributed aggregate; each step is one more aggregate, over the groups, which
gives the objective, the gradient and the Hessian at a point. The driver holds
the dual variables and the Hessian of at most ``MOST_CONSTRAINTS`` constraints.
Targets that no rates meet are reported. op7 has a constraint for each source;
for more sources than that the dual falls apart into one variable per source, and
the same steps run for each in a column expression.

Rates become copies without randomness. Documents of one source and size form
a class; from the largest size down, each class gets the whole number of
copies nearest to its rate plus what larger classes left over, so a source
ends within about half its smallest size of the target. Inside a class the
extra copies go to hash bins in proportion and in a bin to the first documents
by hash. The bins split a hot class; a source's row holds one entry per
distinct size, not per document. Reruns agree, and no document is taken more
than twice.

Null text has size 0 and is never taken. A null source is a source, the last.
Rows that repeat are documents of their own. An empty table gives an empty
result. A column that has the name of the copies' number raises an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm import native
from stocklens.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
NEWTON_STEPS = 200
MOST_CONSTRAINTS = 512
CLOSE = 1e-12  # of a target
SETTLED = 1e-9  # of a target, from where steps go on only while they halve the distance
UNMET = 1e-6  # of a target, beyond which it counts as not met
BIN_DIGITS = 3  # hex digits: 4096 bins
_NUDGE = 1e-9  # halves round up however the rate's last bit falls


@dataclass(frozen=True)
class Balance:
    """Of each constraint: the dual variable (minus infinity for a target of 0) and what the rates reach; the constraints that are not met."""

    x: tuple[float, ...]
    reached: tuple[float, ...]
    unmet: tuple[int, ...]
    steps: int

    def rate(self, constraints: Column) -> Column:
        """The rate of a document with these constraints (an array of numbers from 0)."""
        x = F.array(*map(F.lit, self.x)) if self.x else F.array().cast("array<double>")
        return F.exp(F.aggregate(constraints, F.lit(0.0), lambda a, k: a + F.get(x, k.cast("int"))))


def groups_of(rows: DataFrame) -> DataFrame:
    """weight, constraints: the documents (size, constraints: a sorted array of distinct numbers) summed by their constraints."""
    return rows.groupBy("constraints").agg(F.sum(F.col("size").cast("double")).alias("weight"))


def balance(rows: DataFrame, goals: list[float], *, steps: int = NEWTON_STEPS) -> Balance:
    """Newton's method on the dual: ``rows`` have size and constraints, numbers of the ``goals`` that a document counts for."""
    n, goal = len(goals), np.array(goals, float)
    if n > MOST_CONSTRAINTS:
        raise ValueError(f"{n} constraints; the dual of at most {MOST_CONSTRAINTS} is solved together")
    if (goal < 0).any() or not np.isfinite(goal).all():
        raise ValueError("a target is a number from 0 on")
    groups = materialize(groups_of(rows).repartition(1), "balance-groups")  # summed in parallel; one small file
    barred = F.exists("constraints", lambda k: F.get(F.array(*[F.lit(bool(g == 0)) for g in goal]), k.cast("int"))) if n else F.lit(False)
    open_groups = groups.filter(~barred) if (goal == 0).any() else groups
    pairs = F.expr("flatten(transform(constraints, k -> transform(filter(constraints, l -> l >= k), l -> struct(k AS k, l AS l))))")
    everything = F.array(F.struct(F.lit(-1).cast("long").alias("k"), F.lit(-1).cast("long").alias("l")))

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Objective, reached tokens and Hessian."""
        own = Balance(tuple(x.tolist()), (), (), 0)
        mass = F.col("weight") * own.rate(F.col("constraints"))
        each = open_groups.select(mass.alias("m"), F.explode(F.concat(everything, pairs.cast("array<struct<k:bigint,l:bigint>>"))).alias("p"))
        total, hessian = 0.0, np.zeros((n, n))
        for r in each.groupBy("p.k", "p.l").agg(F.sum("m").alias("m")).collect():
            if r["k"] < 0:
                total = r["m"]
            else:
                hessian[r["k"], r["l"]] = hessian[r["l"], r["k"]] = r["m"]
        return total - float(x @ goal), np.diag(hessian).copy(), hessian

    x = np.zeros(n)
    value, reached, hessian = at(x)
    empty = reached == 0  # no document counts for it: nothing to solve
    away = lambda: float((np.abs(reached - goal) / np.maximum(goal, 1.0))[~empty].max(initial=0.0))
    done, last = 0, np.inf
    while done < steps and away() > CLOSE and (away() > SETTLED or away() < last / 2):  # near the end sums of doubles move no further
        done, last = done + 1, away()
        move = np.linalg.lstsq(hessian, np.where(empty, 0.0, reached - goal), rcond=1e-13)[0]
        slope = float((reached - goal) @ move)
        part, better = 1.0, None
        while part > 1e-9:
            tried = at(x - part * move)
            if np.isfinite(tried[0]) and tried[0] <= value - 1e-4 * part * slope:
                better = tried
                break
            part /= 2
        if better is None:  # as near as numbers of this length come
            break
        x, (value, reached, hessian) = x - part * move, better
    unmet = [k for k in range(n) if abs(reached[k] - goal[k]) > UNMET * max(goal[k], 1.0)]
    return Balance(tuple(np.where(goal == 0, -np.inf, x).tolist()), tuple(reached.tolist()), tuple(unmet), done)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, number (from 0, in the order of the weights): one row per source.

    Targets follow the weights up to ``MOST`` times the source's size; the
    excess is shared out again by weight, which is a common level per weight.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("i", F.row_number().over(rank)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("i") - 1) % len(WEIGHTS) + 1).cast("int"))
    )
    src = src.withColumn("cap", F.col("source_size") * MOST).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    up = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("ratio", "i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    src = src.withColumn(
        "level", (F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("cap").over(up), F.lit(0))) / F.sum("weight").over(down)
    )
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    goal = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(level, F.col("ratio")))
    return src.select("source", "source_size", goal.alias("target"), (F.col("i") - 1).cast("long").alias("number"))


def _rate_alone() -> Column:
    """Newton's steps on ``S exp(x) - T x``, from 0, where every document has one constraint."""
    ratio = F.col("target") / F.col("source_size")
    x = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), lambda x, _: x - 1 + ratio * F.exp(-x))
    return F.exp(x)


def rated(goals: DataFrame) -> DataFrame:
    """``targets`` with the rate of each source's documents."""
    known = goals.orderBy("number").limit(MOST_CONSTRAINTS + 1).select("target", "source_size").collect()
    if len(known) > MOST_CONSTRAINTS:
        rate = _rate_alone()
    else:
        rows = goals.select(F.col("source_size").alias("size"), F.array("number").alias("constraints"))
        rate = balance(rows, [float(r["target"] or 0.0) for r in known]).rate(F.array("number"))
    return goals.withColumn("rate", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(rate, F.lit(float(MOST)))))


def _copies_by_class(sizes: DataFrame) -> DataFrame:
    """source, size, n, copies, source_size, target: one row per source and size."""
    classes = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    per_source = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("classes"))
    goals = rated(materialize(targets(sizes), "mixing-targets")).withColumnRenamed("source", "s")
    rows = per_source.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<long>").alias("copies"))

    def step(acc, c):
        due = c["n"] * F.col("rate") * c["size"] + acc["left"]
        whole = F.floor(due / c["size"] + 0.5 + _NUDGE).cast("long")
        k = F.when(c["size"] == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(whole, c["n"] * MOST)))
        return F.struct((due - k * c["size"]).alias("left"), F.concat(acc["copies"], F.array(k)).alias("copies"))

    rows = rows.withColumn("copies", F.aggregate("classes", start, step, lambda a: a["copies"]))
    rows = rows.withColumn("z", F.explode(F.arrays_zip("classes", "copies")))
    return rows.select("source", F.col("z.classes.size").alias("size"), F.col("z.classes.n").alias("n"), F.col("z.copies").alias("copies"), "source_size", "target")


def _take(packed: DataFrame) -> DataFrame:
    """``row``, size, source_size, target, copies of every ``row`` (doc_id, source and what identifies it) with its size."""
    h = F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    sized = packed.select(
        "row", F.col("row.source").alias("source"), F.col("size").cast("long").alias("size"), h.alias("h"), F.substring(h, 1, BIN_DIGITS).alias("bin")
    )
    sized = materialize(sized, "mixing-sizes")
    classes = _copies_by_class(sized).select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "copies", "source_size", "target")
    bins = sized.groupBy("source", "size", "bin").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bin"))
    bins = bins.withColumn("upto", upto).join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    each, extra = F.expr("copies div n"), F.expr("copies % n")
    share = lambda x: F.floor(F.col("extra") * x / F.col("n"))
    bins = bins.withColumns({"each": each, "extra": extra}).select(
        F.col("s").alias("s"), F.col("z").alias("z"), F.col("bin").alias("b"), "each", (share(F.col("upto")) - share(F.col("upto") - F.col("m"))).alias("more"), "source_size", "target"
    )
    got = sized.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bin") == F.col("b")))
    place = F.row_number().over(Window.partitionBy("source", "size", "bin").orderBy("h", "row.doc_id"))
    copies = F.col("each") + F.when(place <= F.col("more"), 1).otherwise(0)
    return got.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def query(docs: DataFrame) -> DataFrame:
    """op7: words taken of every document."""
    rows = _take(docs.select(F.struct("doc_id", "source").alias("row"), F.size(native.words(F.col("text"))).alias("size")))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, *, number: str | None = None) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is taken. ``number``: a column to add, with 0, 1, ... over the copies of rows that are alike.

    Copies are worked out without texts and joined to the rows by id and a hash of text and source;
    rows that are alike in these share their copies.
    """
    if number and number.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {number} already")
    key = lambda p: F.xxhash64(F.col(f"{p}text"), F.col(f"{p}source"))
    taken = _take(docs.select(F.struct("doc_id", "source", key("").alias("key")).alias("row"), F.size(native.words(F.col("text"))).alias("size")))
    shared = taken.groupBy(F.col("row.doc_id").alias("i"), F.col("row.key").alias("j")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumns({"d": F.col("row.doc_id"), "k": key("row.")})
    met = packed.join(shared.filter("copies > 0"), F.col("d").eqNullSafe(F.col("i")) & (F.col("k") == F.col("j")))
    place = F.row_number().over(Window.partitionBy("d", "k").orderBy(F.lit(0)))
    own = F.expr("copies div alike") + F.when(F.col("place") <= F.expr("copies % alike"), 1).otherwise(0)
    met = met.withColumn("place", place).withColumn("own", own.cast("int")).filter("own > 0")
    each = met.select("row", "place", "alike", F.posexplode(F.array_repeat(F.lit(0), F.col("own"))))
    return each.select("row.*", *([(F.col("pos") * F.col("alike") + F.col("place") - 1).cast("long").alias(number)] if number else []))
