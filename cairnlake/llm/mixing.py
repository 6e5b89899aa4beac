"""Mixing sources to target weights by subset-sum budget fitting (problem 9).

Documents are counted by exact token length; the largest total that every
source can fill within its cap of repeats fixes each source's budget.  A
source gives whole passes, then a part: lengths in proportion, and a bounded
knapsack over the counts by length fills the rest of the budget as closely as
the lengths allow.  Which documents of a length are taken is decided by a
seeded hash.

Scale: one narrow pass for the lengths; everything after that works on counts
by (source, length).  The plan of a source runs in one task on its histogram
of lengths, never on its documents.  A length that very many documents share
is cut into hash buckets, so no window sorts more than ``bucket_rows`` rows.

Defined results: documents of a null or unknown source, null and empty texts
take no part (no tokens); sources without documents reach 0 and the other
targets are scaled to sum 1; repeated rows of a target count once; no source
with documents gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.bpe import VOCABULARY, lengths
from cairnlake.llm.staging import staged
from cairnlake.session import broadcast_if_small

#: Tokens left to the exact knapsack.
SLACK = 8192


def fit(lengths_: np.ndarray, counts: np.ndarray, budget: int, slack: int = SLACK) -> np.ndarray:
    """How many documents of each length to take so that their sum comes as
    close below ``budget`` as the knapsack over the last ``slack`` tokens can."""
    take = np.zeros(len(lengths_), np.int64)
    size = int((lengths_ * counts).sum())
    if budget <= 0 or not size:
        return take
    if budget >= size:
        return counts.astype(np.int64)
    share = max(0, budget - slack // 2) / size
    exact = counts * share
    take = np.floor(exact).astype(np.int64)
    rest = budget - int((take * lengths_).sum())
    for i in np.argsort(-(exact - take), kind="stable"):  # largest remainders first
        if rest <= slack:
            break
        more = min(int(counts[i] - take[i]), 1, rest // int(lengths_[i]))
        take[i] += more
        rest -= more * int(lengths_[i])
    for i in np.argsort(-lengths_, kind="stable"):  # only where few lengths hold most documents
        if rest <= slack:
            break
        more = min(int(counts[i] - take[i]), (rest - slack // 2) // int(lengths_[i]))
        if more > 0:
            take[i] += more
            rest -= more * int(lengths_[i])
    return take + _knapsack(lengths_, counts - take, min(rest, 4 * slack))


def _knapsack(lengths_: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """Bounded knapsack: the largest reachable sum up to ``room`` and its counts."""
    used = np.zeros(len(lengths_), np.int64)
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by, times = np.full(room + 1, -1, np.int32), np.zeros(room + 1, np.int32)
    for i, (size, n) in enumerate(zip(lengths_.tolist(), left.tolist())):
        if reach[room]:
            break
        before = reach.copy()
        for c in range(1, min(n, room // size) + 1):
            new = np.zeros(room + 1, bool)
            new[c * size :] = before[: room + 1 - c * size]
            new &= ~reach
            if not new.any() and c > 1:
                break
            reach |= new
            by[new], times[new] = i, c
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i = int(by[at])
        used[i] += times[at]
        at -= int(times[at]) * int(lengths_[i])
    return used


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: int | None = None, vocabulary: str = VOCABULARY, bucket_rows: int = 200_000) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of every document in the mix."""
    goal = targets.dropDuplicates(["source"]).filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats")
    known = docs.join(broadcast_if_small(goal.select("source")), "source", "left_semi").filter("length(text) > 0")
    sized = staged(lengths(known, ["doc_id", "source"], vocabulary=vocabulary), "sized")
    counts = staged(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "counts")
    # one row a target: bounded by the table of targets
    rows = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("size")).join(goal, "source").collect()
    whole = sum(r.target_share for r in rows)
    total = min((r.max_repeats * r.size * whole / r.target_share for r in rows), default=0)
    if total_tokens is not None:
        total = min(total, total_tokens)
    plan = {r.source: (int(total * r.target_share / whole), int(r.size), int(r.max_repeats)) for r in rows}

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        budget, size, cap = plan[pdf["source"].iloc[0]]
        passes = min(budget // size, cap)
        part = budget - passes * size if passes < cap else 0
        return pdf.assign(passes=passes, take=fit(pdf["n_tokens"].to_numpy(), pdf["n"].to_numpy(), part))

    chosen = counts.groupBy("source").applyInPandas(decide, "source string, n_tokens long, n long, passes int, take long")
    chosen = staged(chosen.filter("passes > 0 OR take > 0"), "chosen")
    d = sized.join(broadcast_if_small(chosen), ["source", "n_tokens"])
    d = d.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_b", F.pmod(F.col("_h"), F.ceil(F.col("n") / bucket_rows).cast("long")))
    part = d.filter("take > 0 AND take < n")
    by_bucket = part.groupBy("source", "n_tokens", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source", "n_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    quota = by_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("source", "n_tokens", "_b", "_before")
    in_bucket = Window.partitionBy("source", "n_tokens", "_b").orderBy("_h", "doc_id")
    part = part.join(quota, ["source", "n_tokens", "_b"]).withColumn("_k", F.row_number().over(in_bucket) + F.col("_before"))
    part = part.withColumn("repeats", F.col("passes") + (F.col("_k") <= F.col("take")).cast("int"))
    rest = d.filter("NOT (take > 0 AND take < n)").withColumn("repeats", F.col("passes") + (F.col("take") > 0).cast("int"))
    keep = ["doc_id", "source", "n_tokens", "repeats"]
    return part.select(keep).unionByName(rest.select(keep)).filter("repeats > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of the targets reached."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    d = targets.dropDuplicates(["source"]).join(got, "source", "left").fillna(0, ["tokens", "n_docs", "most_repeats"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row a target
    return d.select("source", "target_share", "max_repeats", "tokens", "n_docs", "most_repeats", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)).alias("actual_share"))
