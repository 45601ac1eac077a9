"""Mixing sources to target weights by iterative proportional fitting
(DataFrame functions only).

Documents are counted into cells (source, language, topic) once; everything
after works on the cells.  Raking gives every value of a dimension a factor; a
cell's weight is its share of the tokens times its factors, at most what it can
give at the token budget.  One dimension after the other, factors move until
the weights' sums meet the targets.  What a value or a cell cannot give goes to
the others in proportion: first by value, when targets are set, then by cell,
when one scale, solved exactly, spends the budget.  Each document is kept if a
hash of its id, uniform in [0, 1), lies below its cell's probability, so the
choice does not depend on partitioning.

A round joins the cells with the factors and sums them by each dimension (sums
are partial before they are shuffled, so a value in a third of all cells is no
hot key); factors are written once a round, and single numbers reach the driver.
"""

from __future__ import annotations

import logging
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.llm import common as C
from seqforge.llm.quality import words_of

DIMENSIONS = ["source", "lang", "topic"]
#: Default targets: each share of tokens to this power, normalised (1 keeps
#: the mix, 0 levels it).
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET, SEED = 0.5, 42
#: Raking ends when all shares are within the tolerance, or after IDLE rounds that did not bring the worst
#: one nearer by a hundredth (targets that contradict each other or the cells), or after ROUNDS.
ROUNDS, TOLERANCE, IDLE = 200, 1e-6, 4
LOG = logging.getLogger(__name__)
ADDED = ["topic", "n_tokens", "probability", "mix_weight"]


def topic_of(text: Column) -> Column:
    """The topic of a document in tables that name none: its form by length."""
    n = F.size(words_of(text))
    return F.when(n < 100, "note").when(n < 500, "article").otherwise("longform")


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from a hash of seed and id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / F.lit(float(1 << 53))


def targets_of(cells: DataFrame, dim: str, power: float) -> DataFrame:
    share = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).select(dim, F.pow(F.col("t"), F.lit(power)).alias("p"))
    return share.crossJoin(F.broadcast(share.agg(F.sum("p").alias("all")))).select(
        dim, F.coalesce(F.try_divide("p", "all"), F.lit(0.0)).alias(f"target_{dim}"))


def calibrate(rows: DataFrame, size: str, ratio: str, cap: float) -> float:
    """The scale at which sum(size * min(cap, ratio * scale)) is one, or the
    last at which it grows if it never gets there.  The sum is piecewise linear and
    concave in the scale, so steps along its slope from zero end at the root."""
    scale = 0.0
    for _ in range(64):
        full = F.col(ratio) * scale >= cap
        held, free = rows.agg(F.sum(F.when(full, F.col(size) * cap)), F.sum(F.when(~full, F.col(size) * F.col(ratio)))).first()
        step = (1 - (held or 0.0)) / free if free else scale
        if step <= scale * (1 + 1e-12):
            break
        scale = step
    return scale


def reachable(cells: DataFrame, dim: str, cap: float) -> DataFrame:
    """The targets of a dimension's values that have tokens, summing to one and
    none above what its value can give; (dim, target)."""
    own = cells.filter("unit > 0").groupBy(dim).agg(F.sum("unit").alias("size"), F.first(f"target_{dim}").alias("target"))
    own = C.stored(own.select(dim, "size", (F.col("target") / F.col("size")).alias("ratio")), "targets")
    scale = calibrate(own, "size", "ratio", cap)
    return own.select(dim, (F.col("size") * F.least(F.lit(cap), F.col("ratio") * scale)).alias("target"))


def weighed(cells: DataFrame, factors: dict[str, DataFrame], dims: list[str]) -> DataFrame:
    """``cells`` with ``ratio``, the product of its factors, and the factors."""
    out = cells
    for d in dims:
        out = out.join(factors[d], d)
    return out.withColumn("ratio", reduce(lambda x, y: x * y, [F.col(f"f_{d}") for d in dims]))


def moved(cells: DataFrame, factors: dict[str, DataFrame], dims: list[str], dim: str, cap: float) -> DataFrame:
    """(dim, f, t, miss): the factors of one dimension that bring its values to
    their targets, and how far they were off.  Cells at the cap give no more,
    so the others of the value make up for them; where none is free, or the
    target is below what the capped cells give, the whole is scaled."""
    full = F.col("ratio") >= cap
    own = weighed(cells, factors, dims).groupBy(dim).agg(
        F.coalesce(F.sum(F.when(full, F.col("unit") * cap)), F.lit(0.0)).alias("held"),
        F.coalesce(F.sum(F.when(~full, F.col("unit") * F.col("ratio"))), F.lit(0.0)).alias("free"),
        F.first(f"f_{dim}").alias("f"), F.first(f"t_{dim}").alias("t"))
    total = F.col("held") + F.col("free")
    f = F.when((F.col("free") > 0) & (F.col("t") > F.col("held")), F.col("f") * (F.col("t") - F.col("held")) / F.col("free")) \
        .when(total > F.col("t"), F.col("f") * F.col("t") / total).otherwise(F.col("f"))
    # rounded, so that the order in which a sum was added up decides nothing
    return own.select(dim, F.round(f, 12).alias("f"), "t", F.round(F.abs(total - F.col("t")), 12).alias("miss"))


def rake(cells: DataFrame, dims: list[str], rounds: int = ROUNDS, cap: float = math.inf) -> DataFrame:
    """``cells`` (dims without nulls, tokens, target_<dim>) with ``weight``:
    token shares raked until every dimension's shares are within TOLERANCE of
    its targets, ``ratio`` (weight over the share before, at most ``cap``) and
    ``deviation``, by which the worst share misses its target.  Targets are
    first made reachable: values without tokens have none, a value has at most
    ``cap`` times its share, and the rest makes up for it.  A deviation
    over the tolerance, from targets that contradict each other, is logged
    too.  Cells without tokens have weight and ratio zero."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = cells.withColumn("unit", F.col("tokens") / F.lit(float(total or 1)))
    if not total:
        return cells.select(*[c for c in cells.columns if c != "unit"], *[F.lit(0.0).alias(c) for c in ("weight", "ratio", "deviation")])
    factors = {d: reachable(cells, d, cap).select(d, F.lit(1.0).alias(f"f_{d}"), F.col("target").alias(f"t_{d}")) for d in dims}
    best, idle = math.inf, 0
    for _ in range(rounds):
        new = dict(factors)
        steps = []
        for d in dims:
            step = moved(cells, new, dims, d, cap)
            new[d] = step.select(d, F.col("f").alias(f"f_{d}"), F.col("t").alias(f"t_{d}"))
            steps.append(step.select(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), "f", "t", "miss"))
        table = C.stored(reduce(DataFrame.unionByName, steps), "factors")
        factors = {d: table.filter(F.col("dim") == d).select(F.col("value").alias(d), F.col("f").alias(f"f_{d}"), F.col("t").alias(f"t_{d}")) for d in dims}
        worst = table.agg(F.max("miss")).first()[0] or 0.0
        idle = 0 if worst < 0.99 * best else idle + 1
        best = min(best, worst)
        if worst < TOLERANCE or idle >= IDLE:
            break
    names = [c for c in cells.columns if c != "unit"]
    ratio = F.least(F.lit(cap), F.col("ratio"))
    done = C.stored(weighed(cells.filter("unit > 0"), factors, dims).select(
        *names, (F.col("unit") * ratio).alias("weight"), ratio.alias("ratio"), *[f"t_{d}" for d in dims]), "raked")
    misses = [done.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"t_{d}")).alias("miss")).select("miss") for d in dims]
    worst = reduce(DataFrame.unionByName, misses).agg(F.max("miss")).first()[0] or 0.0
    if worst > TOLERANCE:
        LOG.warning("raking misses a target share by %.3g at worst", worst)
    idle_cells = cells.filter("not (unit > 0)").select(*names, F.lit(0.0).alias("weight"), F.lit(0.0).alias("ratio"))
    return done.select(*names, "weight", "ratio").unionByName(idle_cells).withColumn("deviation", F.lit(worst))


def keyed(docs: DataFrame, text_col: str, topic: Column | None) -> DataFrame:
    """``docs`` with _source, _lang, _topic (nulls as empty texts) and n_tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    topic = topic if topic is not None else F.col("topic") if "topic" in docs.columns else topic_of(text)
    values = [("_source", F.col("source").cast("string")), ("_lang", F.col("lang").cast("string")), ("_topic", topic.cast("string"))]
    names = [c for c in docs.columns if c.lower() not in ADDED[1:]]
    return docs.select(*names, *[F.coalesce(v, F.lit("")).alias(n) for n, v in values], F.size(words_of(text)).cast("long").alias("n_tokens"))


def cell_probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET,
                       text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """The cells of ``docs``: source, lang, topic, tokens, target_<dimension>,
    mix_weight, probability, and deviation (see :func:`rake`)."""
    own = keyed(docs, text_col, topic)
    cells = own.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("n_tokens").alias("tokens"))
    cells = with_targets = C.stored(cells, "cells")
    for d in DIMENSIONS:
        t = (targets or {}).get(d)
        with_targets = with_targets.join(t if t is not None else targets_of(cells, d, FLATTEN[d]), d, "left").fillna(0.0, [f"target_{d}"])
    cap = 1 / budget if budget > 0 else math.inf
    raked = C.stored(rake(C.stored(with_targets, "cells"), DIMENSIONS, cap=cap).withColumnRenamed("ratio", "mix_weight"), "ratios")
    total = raked.agg(F.sum("tokens")).first()[0] or 1
    scale = calibrate(raked.withColumn("unit", F.col("tokens") / F.lit(float(total))), "unit", "mix_weight", cap)
    return raked.withColumn("probability", F.least(F.lit(1.0), F.col("mix_weight") * F.lit(scale * max(budget, 0.0))))


def mix_report(cells: DataFrame) -> DataFrame:
    """Of :func:`cell_probabilities`, for each value of each dimension: its
    share of all tokens, the target asked for, and its expected share of what is kept."""
    kept = F.col("tokens") * F.col("probability")
    total = cells.agg(F.sum("tokens").alias("all"), F.sum(kept).alias("all_kept"))
    return reduce(DataFrame.unionByName, [
        cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value"))
        .agg(F.sum("tokens").alias("tokens"), F.sum(kept).alias("kept"), F.first(f"target_{d}").alias("target"))
        for d in DIMENSIONS]).crossJoin(F.broadcast(total)).select(
            "dimension", "value", F.try_divide("tokens", "all").alias("share"), "target", F.try_divide("kept", "all_kept").alias("kept_share"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with topic, n_tokens, probability and
    mix_weight (raked share of the cell over its share before).

    ``targets`` maps a dimension to a table (value, target_<dimension>); without
    one, shares are flattened by FLATTEN.  ``budget`` is the expected share of
    all tokens to keep; a cell cannot give more than it has, so where targets
    ask for more its probability is 1.  A topic column of ``docs`` is used if
    there is one.  Null dimensions are a value of their own (empty text), null
    texts have no tokens; cells without tokens are kept or dropped by their
    language and source like others of weight zero (dropped); rows repeated
    with their id are kept or dropped together, rows of null id too.  Input
    columns named as the added ones are replaced, but for topic, which is
    read.  An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() not in (ADDED[1:] if topic is None and "topic" in docs.columns else ADDED)]
    chosen = C.stored(cell_probabilities(docs, targets, budget, text_col, topic).select(
        *[F.col(d).alias(f"cell_{d}") for d in DIMENSIONS], "mix_weight", "probability"), "probabilities")
    same = [F.col(f"_{d}") == F.col(f"cell_{d}") for d in DIMENSIONS]
    out = keyed(docs, text_col, topic).join(chosen, same[0] & same[1] & same[2]).filter(uniform(id_col, seed) < F.col("probability"))
    if "topic" not in names:
        out = out.withColumn("topic", F.col("_topic"))
    return out.select(*names, *[c for c in ADDED if c not in names])


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op5."""
    return mix(docs.select("doc_id", "source", "lang", "text")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"))
