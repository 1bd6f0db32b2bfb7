"""Problem 7: mixing sources to target weights.

Sizes are tokens of a public tokenizer. Records of a source fall into blocks by
a seeded hash; a source's quota is a number of whole rounds over all its blocks
and one further draw of permuted blocks, the last of them partly. The uses of
blocks are split among output shards by a tree: each node divides its vector of
block counts by source between its two halves with one multivariate
hypergeometric draw, so that every leaf has exact counts and the counts of all
leaves add up to the quotas. Each source's permuted block uses are then dealt
out, disjoint, along those counts, and each shard is shuffled by itself.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from ..tables import source_key

#: Public tokenizer file; a parameter, never copied here.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Tokens of a block and of an output shard, about.
BLOCK_TOKENS, SHARD_TOKENS = 200_000, 4_000_000
#: Targets are a small table by contract; more rows than this are refused.
MAX_TARGETS = 10_000
#: Nodes at which the splitting tree is handed to tasks.
SUBTREES = 256
SEED = 20

_ENCODERS: dict[str, object] = {}


def encoder(path: str | None = None):
    """The byte-pair encoder of a vocabulary file (default: VOCABULARY among the installed public tokenizers)."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _tokens(path: str | None):
    def run(texts: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([len(e.encode_ordinary(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return F.pandas_udf(run, T.LongType())


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of records that a target names, a written table in the shared folder.

    Sources are compared up to case and outer spaces. Records without a source, with a source that has no target,
    and with null or blank text (size 0) are left out.
    """
    spark = documents.sparkSession
    t = F.broadcast(targets.select(source_key("source").alias("source")).where("source is not null").distinct())
    d = documents.select("doc_id", source_key("source").alias("source"), "text").where(F.col("text").rlike(r"(?U)\S")).join(t, "source")
    where = f"{shared_dir(spark)}/sized-{uuid4().hex}"
    d.select("doc_id", "source", _tokens(vocabulary)("text").alias("n_tokens")).where("n_tokens > 0").write.parquet(where)
    return spark.read.parquet(where)


def quotas(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens each source gives: its share of the total, at most max_repeats times what it has.

    Without a total, the largest one that every source present can serve; shares of absent sources go to the
    others in proportion.
    """
    here = {s: (w, r) for s, (w, r) in targets.items() if totals.get(s, 0) > 0 and w > 0 and r > 0}
    if not here:
        return {}
    sum_ = math.fsum(w for w, _ in here.values())
    most = min(r * totals[s] * sum_ / w for s, (w, r) in here.items())
    size = most if total is None else total
    return {s: min(r * totals[s], size * w / sum_) for s, (w, r) in here.items()}


def _halves(a: int, b: int, c: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """(middle, uses of each source in the left half) of a node of the tree; the draw depends on the node only."""
    m = (a + b) // 2
    n = int(c.sum())
    left = n * (m - a) // (b - a)
    return m, np.random.default_rng([seed, a, b]).multivariate_hypergeometric(c, left, method="marginals") if n else c


def _down(a: int, b: int, c: np.ndarray, seed: int, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The nodes of at most ``width`` shards below a node, from the left."""
    if b - a <= width:
        yield a, b, c
    else:
        m, draw = _halves(a, b, c, seed)
        yield from _down(a, m, draw, seed, width)
        yield from _down(m, b, c - draw, seed, width)


def split_tree(counts: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): block uses of each source in each shard, by recursive multivariate hypergeometric splits."""
    return np.stack([c for _, _, c in _down(0, shards, np.asarray(counts, dtype=np.int64), seed, 1)])


_CUT = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])


def shard_cuts(spark: SparkSession, names: list[str], counts: list[int], shards: int, seed: int = SEED) -> DataFrame:
    """(source, shard, lo, hi): a source's dealt uses lo + 1 to hi go to the shard.

    The driver draws the top of the tree, SUBTREES nodes or fewer; the subtrees are drawn in tasks, so the number
    of shards does not matter to it.
    """
    width = max(1, -(-shards // SUBTREES))
    rows, before = [], np.zeros(len(names), dtype=np.int64)
    for a, b, c in _down(0, shards, np.asarray(counts, dtype=np.int64), seed, width):
        rows.append((a, b, c.tolist(), before.tolist()))
        before = before + c
    top = spark.createDataFrame(rows, "a long, b long, counts array<bigint>, before array<bigint>").repartition(min(len(rows), 64))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, c, at in zip(pdf["a"], pdf["b"], pdf["counts"], pdf["before"], strict=True):
                at = np.asarray(at, dtype=np.int64)
                for first, last, part in _down(int(a), int(b), np.asarray(c, dtype=np.int64), seed, 64):
                    leaf = np.stack([x for _, _, x in _down(first, last, part, seed, 1)])
                    hi = at + leaf.cumsum(axis=0)
                    k, i = np.nonzero(leaf)
                    yield pd.DataFrame({"i": i.astype("int32"), "shard": k + first, "lo": (hi - leaf)[k, i], "hi": hi[k, i]})
                    at = at + part

    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return top.mapInPandas(draw, _CUT).select(name.alias("source"), "shard", "lo", "hi")


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mixture: doc_id, source, copy, shard, pos, n_tokens; shares: one row per target).

    A record stands once per use, copy counting from 1 to at most max_repeats. pos is its place in its shard.
    Each source meets its quota up to half of one record. Targets given twice keep the larger share; null shares
    and repeats count as 0.
    """
    spark = documents.sparkSession
    rows = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where("source is not null").orderBy("source", "target_share").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    want = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in rows}
    docs = sized(documents, targets, vocabulary)
    got = {r[0]: (r[1], r[2]) for r in docs.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}  # one row per target
    give = quotas({s: n for s, (n, _) in got.items()}, want, total)
    plan = []
    for s, q in give.items():
        n = got[s][0]
        full = min(want[s][1], int(q // n))
        plan.append((s, full, int(round(q - full * n)) if full < want[s][1] else 0, max(1, math.ceil(n / BLOCK_TOKENS))))
    schema = "source string, full int, rest long, blocks long"
    quota = F.broadcast(spark.createDataFrame(plan or [("", 0, 0, 1)], schema))
    placed = docs.join(quota, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    # sizes of blocks, permuted within their source: the further draw takes whole blocks up to the rest of the quota
    block = placed.groupBy("source", "block", "full", "rest").agg(F.sum("n_tokens").alias("size"))
    order = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    block = block.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    block = block.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before"))))
    block = block.select("source", "block", "full", "size", "extra", (F.col("full") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("uses")).where("uses > 0")
    where = f"{shared_dir(spark)}/blocks-{uuid4().hex}"
    block.write.parquet(where)
    block = spark.read.parquet(where)
    uses = {r[0]: r[1] for r in block.groupBy("source").agg(F.sum("uses")).collect()}
    names = sorted(uses)
    shards = max(1, math.ceil(math.fsum(give.values()) / SHARD_TOKENS))
    dealt = block.withColumn("copy", F.explode(F.sequence(F.lit(1), "uses")))
    deal = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block", "copy"), "block", "copy")
    dealt = dealt.withColumn("n", F.row_number().over(deal).cast("long"))
    if names:
        # each dealt use has its number in one cut only, so the join spreads evenly
        cuts = shard_cuts(spark, names, [uses[s] for s in names], shards, seed).select("source", "shard", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("n"))
        dealt = dealt.join(cuts, ["source", "n"])
    else:
        dealt = dealt.withColumn("shard", F.lit(0))
    dealt = dealt.select("source", "block", "copy", "full", "extra", "shard")
    # a block drawn partly gives its records in hashed order, as far as the quota goes
    inside = W.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id"), "doc_id")
    ranked = placed.select("doc_id", "source", "block", "n_tokens").withColumn("upto", F.sum("n_tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    mix = ranked.join(dealt, ["source", "block"]).where((F.col("copy") <= F.col("full")) | (F.col("upto") - F.col("n_tokens") / 2 <= F.col("extra")))
    pos = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 4), "doc_id", "copy"), "doc_id", "copy")
    mix = mix.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), F.col("shard").cast("int").alias("shard"), F.row_number().over(pos).alias("pos"), "n_tokens")
    used = mix.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("copy").alias("most_uses"))
    facts = spark.createDataFrame([(s, w, r, *(got.get(s, (0, 0))), float(give.get(s, 0.0))) for s, (w, r) in sorted(want.items())], "source string, target_share double, max_repeats int, available_tokens long, n_docs long, quota_tokens double")
    shares = facts.join(used, "source", "left").fillna(0, ["used_tokens", "most_uses"])
    shares = shares.withColumn("reached_share", F.round(F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(W.partitionBy(F.lit(1)))), F.lit(0.0)), 6))
    return mix, shares
