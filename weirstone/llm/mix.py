"""Problem 8: a mix of sources by target shares of tokens, none of a source's documents beyond its cap of copies.

Every document of a source wants the same number of copies, share * size / tokens of the source, at most max_repeats.
The whole part is given; the fractions are rounded by the pivotal method: two documents (neighbours in length, so that
the sum of tokens hardly moves) pass mass between them at random until one of the fractions is 0 or 1. A block of
documents ends with at most one fraction; these go up a reduction tree, `FANOUT` blocks to one, until a source has a
single one left, which is drawn. Each document's expected copies are what it wanted, and each source's number of copies
is the wanted sum, rounded up or down. Draws depend on the seed and the blocks only, so a rerun gives the same mix.

`size` is the mix's size in tokens. "all", which the registered queries use, is as large as all documents together; a
source that can't fill its share of that stays at its cap. `shares` reads off the mix which sources those are (short), and
the shares really reached. "fill" is the largest size up to that at which every source fills its share, so nothing if one has no tokens;
"fill_present" is the same without the sources of no capacity, which are marked short. Defined results: sources match by lower case without outer blanks; documents of no or an unknown source aren't mixed but count
in the total; texts without tokens get no copies; a share of null or 0 wants nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.llm.bpe import VOCABULARY, counted
from weirstone.shared import dimension, written

BLOCK_DOCS = 4096
FANOUT = 64
EPS = 1e-9
_ROW = "skey string, doc_id bigint, tokens bigint, whole int, p double, block bigint"


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds fractions to 0 or 1 but for at most one of them; keeps their sum."""
    p = p.astype(float).copy()
    draws = rng.random(len(p))
    i = -1
    for j in range(len(p)):
        if p[j] <= EPS or p[j] >= 1 - EPS:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        a, b = p[i], p[j]
        total = a + b
        if total < 1:
            p[i], p[j] = (0.0, total) if draws[j] < b / total else (total, 0.0)
        else:
            p[i], p[j] = (1.0, total - 1) if draws[j] < (1 - b) / (2 - total) else (total - 1, 1.0)
        for k in (i, j):
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = round(p[k])
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def _key(c):
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def token_table(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, skey, tokens of every document, tokenised once and kept in the shared folder."""
    return written(counted(documents.select("doc_id", _key(F.col("source")).alias("skey"), "text"), "skey", vocabulary=vocabulary), "tokens")


def demands(tokens: DataFrame, targets: DataFrame, size: float | str = "fill") -> DataFrame:
    """Per target source: source, skey, target_share, max_repeats, tokens, docs, wanted, capacity, per_doc. size: tokens, "all", "fill" or "fill_present"."""
    have = tokens.groupBy("skey").agg(F.sum("tokens").alias("tokens"), F.count(F.when(F.col("tokens") > 0, 1)).alias("docs"))
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    t = targets.select("source", "target_share", "max_repeats").withColumn("skey", _key(F.col("source")))
    t = t.join(have, "skey", "left").fillna(0, ["tokens", "docs"])
    share, cap = F.coalesce("target_share", F.lit(0.0)), F.col("tokens") * F.coalesce("max_repeats", F.lit(1))
    t = t.withColumn("capacity", cap)
    if size in ("fill", "fill_present"):
        filled = share > 0 if size == "fill" else (share > 0) & (cap > 0)
        size = min(float(total), t.agg(F.min(F.when(filled, cap / share))).first()[0] or 0.0)
    elif size == "all":
        size = float(total)
    t = t.withColumn("wanted", share * float(size))
    per_doc = F.when(F.col("tokens") > 0, F.least(F.coalesce("max_repeats", F.lit(1)).cast("double"), F.col("wanted") / F.col("tokens"))).otherwise(0.0)
    return t.withColumn("per_doc", per_doc)


def _level(seed: int, level: int):
    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], kind="stable")
        rng = np.random.default_rng([seed, level, int(pdf["block"].iat[0]), *pdf["skey"].iat[0].encode()])
        return pdf.assign(p=pivotal(pdf["p"].to_numpy(), rng))

    return step


def mixed(tokens: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, tokens, copies (1 or more) of the mix."""
    plan = dimension(written(plan, "demands"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(1))
    rows = tokens.where("tokens > 0").join(plan.select("skey", "per_doc", "docs"), "skey")
    whole = F.floor(F.col("per_doc") + EPS).cast("int")
    rows = rows.select("skey", "doc_id", "tokens", whole.alias("whole"), F.greatest(F.col("per_doc") - whole, F.lit(0.0)).alias("p"), F.pmod(F.xxhash64("doc_id"), blocks).alias("block"))
    depth, n = 1, plan.agg(F.max(blocks)).first()[0] or 1
    while n > 1:
        n, depth = -(-n // FANOUT), depth + 1
    done = None
    for level in range(depth):
        rows = written(rows.groupBy("skey", "block").applyInPandas(_level(seed, level), _ROW), "rounded")
        even = rows.where(f"p < {EPS} or p > {1 - EPS}")
        done = even if done is None else done.unionByName(even)
        rows = rows.where(f"p >= {EPS} and p <= {1 - EPS}").withColumn("block", F.floor(F.col("block") / FANOUT))
    draw = F.pmod(F.xxhash64(F.lit(seed), "skey", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    done = done.unionByName(rows.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0)))
    copies = (F.col("whole") + F.round("p")).cast("int")
    return done.select("skey", "doc_id", "tokens", copies.alias("copies")).where("copies > 0").join(plan.select("skey", "source"), "skey").select("doc_id", "source", "tokens", "copies")


def shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """source, target_share, share reached, mix_tokens, copies, most_copies, max_repeats, capacity, wanted, short.

    A source is short if the mix holds every document of it as often as it may and still less of it than wanted.
    """
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    out = plan.select("source", "target_share", "max_repeats", "docs", "capacity", "wanted").join(got, "source", "left")
    out = out.withColumn("mix_total", F.sum("mix_tokens").over(Window.partitionBy()))  # one row per target
    zero = lambda c: F.coalesce(c, F.lit(0))
    full = zero("copies") >= F.col("docs") * F.coalesce("max_repeats", F.lit(1))
    short = full & (zero("mix_tokens") < F.col("wanted") * (1 - 1e-12))
    return out.select("source", "target_share", (zero("mix_tokens") / F.col("mix_total")).alias("share"), zero("mix_tokens").alias("mix_tokens"), zero("copies").alias("copies"), zero("most_copies").alias("most_copies"), "max_repeats", "capacity", "wanted", short.alias("short"))


def p8_mix(documents: DataFrame, targets: DataFrame, size: float | str = "fill") -> DataFrame:
    tokens = token_table(documents)
    return mixed(tokens, demands(tokens, targets, size))


def p8_shares(documents: DataFrame, targets: DataFrame, size: float | str = "fill") -> DataFrame:
    tokens = token_table(documents)
    plan = written(demands(tokens, targets, size), "demands")
    return shares(mixed(tokens, plan), plan)


def p8_found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources that stay short of their share in the mix as large as all documents that the rounding gives, each of their documents in it at its cap."""
    tokens = token_table(documents)
    plan = written(demands(tokens, targets, "all"), "demands")
    return shares(mixed(tokens, plan), plan).where("short").select("source")
