"""Problem 7: drawing documents so that sources meet target shares."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.encoding import count_tokens
from folioscope.operators.lineage import materialize

_DRAWN = "source string, doc_id bigint, n_tokens bigint, whole int, part double, block bigint, open boolean"


def transfer(parts: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> int:
    """Pivotal rounding in place: pairs of fractional parts exchange mass until one of them is 0 or 1.

    An exchange keeps the weighted sum, and its direction is drawn so that
    every part keeps its expectation. Returns the row that is left open, or -1.
    """
    draws = rng.random(len(parts))
    carry = -1
    for i in range(len(parts)):
        if not 0 < parts[i] < 1:
            continue
        if carry < 0:
            carry = i
            continue
        a, b, u, v = parts[carry], parts[i], weights[carry], weights[i]
        # Mass up moves from i to carry, mass down the other way.
        up, down = min((1 - a) * u, b * v), min(a * u, (1 - b) * v)
        if draws[i] * (up + down) < down:
            a, b = a + up / u, b - up / v
            a, b = (1.0, b) if up == (1 - parts[carry]) * u else (a, 0.0)
        else:
            a, b = a - down / u, b + down / v
            a, b = (0.0, b) if down == parts[carry] * u else (a, 1.0)
        parts[carry], parts[i] = a, b
        open_ = [j for j in (carry, i) if 1e-12 < parts[j] < 1 - 1e-12]
        for j in (carry, i):
            if j not in open_:
                parts[j] = round(parts[j])
        carry = open_[0] if open_ else -1
    return carry


def _rounding(seed: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(rows["block"].iloc[0]), *rows["source"].iloc[0].encode()])
        parts, weights = rows["part"].to_numpy(copy=True), rows["n_tokens"].to_numpy(float)
        left = transfer(parts, weights, rng)
        if left >= 0 and last:
            parts[left] = float(rng.random() < parts[left])
            left = -1
        rows["part"], rows["open"] = parts, np.arange(len(rows)) == left
        return rows

    return of_block


def plan_shares(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """A row for each target: tokens and documents at hand, the share to reach and copies a document.

    Targets of sources without tokens can't be met; the others share what they
    leave in proportion (``goal_share``). ``total_tokens`` None draws as much
    as the caps allow: the source that first has all documents at max_repeats
    sets the total. A larger given total leaves capped sources short. Targets
    that are null, negative or of a null source, and documents of sources
    without a target, are left out.
    """
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = tokens.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    plan = wanted.join(have, "source", "left").fillna(0, ["tokens", "documents"])
    sums = plan.agg(F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("met"))
    plan = plan.crossJoin(F.broadcast(sums)).withColumn("goal_share", F.when(F.col("tokens") > 0, F.col("target_share") / F.col("met")).otherwise(0.0)).drop("met")
    if total_tokens is None:
        most = plan.agg(F.min(F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("goal_share"))).alias("total"))
        plan = plan.crossJoin(F.broadcast(most))
    else:
        plan = plan.withColumn("total", F.lit(float(total_tokens)))
    return plan.withColumn("copies", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("goal_share") * F.col("total") / F.col("tokens"))).otherwise(0.0))


def draw(tokens: DataFrame, plan: DataFrame, seed: int = 11, block_size: int = 20_000, fan_in: int = 64) -> DataFrame:
    """source, doc_id, n_tokens and ``copies`` of every document that is drawn.

    Method: pivotal dependent rounding. Each document of a source has the same
    fractional number of copies; the whole part is taken, and the fractions
    exchange mass until each is 0 or 1. A source is cut into blocks by a hash of
    doc_id, so that no group grows with it; the one open document of each block
    goes up a reduction tree of ``fan_in``, and a draw decides the last. So the
    tokens of a source differ from the goal by less than its largest document.
    The result depends on the rows and the seed, not on partitions.

    Documents without tokens and those of sources without a target are not
    drawn. ``tokens`` needs doc_id (unique), source and n_tokens.
    """
    goal = F.col("copies") + 0.0
    blocks = F.ceil(F.col("documents") / block_size)
    rows = (
        tokens.where("n_tokens > 0")
        .join(plan.select("source", "copies", "documents"), "source")
        .withColumn("whole", F.floor(goal + 1e-12).cast("int"))
        .select("source", "doc_id", "n_tokens", "whole", F.when(goal - F.col("whole") < 1e-9, 0.0).otherwise(goal - F.col("whole")).alias("part"), F.pmod(F.xxhash64("doc_id"), blocks).alias("block"), (F.lit(True)).alias("open"))
    )
    most = plan.agg(F.max(blocks)).first()[0] or 1
    decided = None
    level = 0
    while True:
        last = most <= 1
        rows = materialize(rows.groupBy("source", "block").applyInPandas(_rounding(seed, level, last), _DRAWN), "drawn")
        done = rows.where("NOT open")
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        rows = rows.where("open").withColumn("block", F.floor(F.col("block") / fan_in))
        most, level = -(-most // fan_in), level + 1
    return decided.select("source", "doc_id", "n_tokens", (F.col("whole") + F.round("part").cast("int")).alias("copies")).where("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, **options: str) -> tuple[DataFrame, DataFrame]:
    """The draw, and the report: target, goal and reached share of every target, its tokens drawn and largest use of a document.

    Empty documents or targets give an empty draw; the report keeps a row for
    each target, with null shares reached where nothing was drawn.
    """
    tokens = materialize(count_tokens(documents, **options), "tokens")
    plan = materialize(plan_shares(tokens, targets, total_tokens), "plan")
    drawn = materialize(draw(tokens, plan, seed), "draw")
    used = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"), F.count("*").alias("drawn_documents"), F.max("copies").alias("most_copies"))
    report = plan.join(used, "source", "left").fillna(0, ["drawn_tokens", "drawn_documents", "most_copies"])
    all_ = report.agg(F.sum("drawn_tokens").alias("all_tokens"))
    report = report.crossJoin(F.broadcast(all_)).withColumn("reached_share", F.try_divide(F.col("drawn_tokens"), F.col("all_tokens")))
    return drawn, report.select("source", "target_share", "goal_share", "reached_share", "max_repeats", "most_copies", "documents", "drawn_documents", "tokens", "drawn_tokens")
