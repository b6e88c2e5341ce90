"""Mixing sources to target weights with a multivariate-hypergeometric tree.

1. Sizes are summed per source. Targets follow the weights, stop at
   ``max_repeats`` times a source's size, and the excess is shared again by
   weight (:func:`targets`).
2. Documents are permuted by a seeded digest of their id. A source is cut into
   blocks of about ``block_words`` words along that permutation. It is taken
   ``floor(target / size)`` times whole, and once more up to a cutoff in the
   permutation, found by radix selection over sums (no sort of a source).
   So each source has an exact quota of blocks.
3. A splitting tree over the output shards divides the quotas: each node draws
   its left half's blocks from its own by a multivariate hypergeometric draw
   seeded by the node, so every task rebuilds the part it needs. A leaf's
   blocks are disjoint stretches of each source's permuted blocks.
4. Rows of a shard get a seeded key; sorting by it shuffles them locally.

Whatever the skew: a hot source is many blocks, per-source work is on sums of
at most 4096 buckets, and rows meet their block by an equi-join on (source,
block). The driver holds one record per source; sources are the entries of a
mixing table, and more than ``max_sources`` of them are refused.

Edge cases: a null text has size 0; a null source is a source of its own,
last in order; rows of one id are drawn together; sources of size 0 get
target 0; an empty table gives no rows; extra columns pass through, and give
way to a new column of their name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.llm.common import set_aside, staged, text_or_empty, words_of

MAX_SOURCES = 100_000
_LEVEL = 12  # bits of the permutation settled by each selection pass
_BITS = 48
_WORKING = ("_u", "_own", "_size", "_sid", "_block", "_blocks", "_source", "_source_size", "_target",
            "_whole", "_cut", "_draws")


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: float = 3) -> list[float]:
    """Shares of ``sum(sizes)`` by weight, each at most ``max_repeats`` sizes."""
    out = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > max_repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
        left -= sum(out[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def place(id_col: str, seed: int) -> Column:
    """A document's place in the permutation: 48 bits of a seeded digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def _records(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # one record per source


def _first_reaching(sums: DataFrame, by: str) -> list:
    """Per source, the first bucket at which the running size reaches ``want``."""
    run = Window.partitionBy("_sid").orderBy(by)
    return (sums.withColumn("_upto", F.sum("_n").over(run))
            .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n")
                                                          < F.col("_want")))
            .select("_sid", by, (F.col("_want") - (F.col("_upto") - F.col("_n"))).alias("_rest"),
                    "_n").collect())


def _cutoffs(sized: DataFrame, extra: dict[int, float]) -> dict[int, int]:
    """Per source, the last place whose running size is nearest to ``extra``."""
    spark = sized.sparkSession
    open_ = {sid: (0, want) for sid, want in extra.items() if want > 0}
    shift = _BITS
    while shift > _BITS - 2 * _LEVEL:
        wanted = _records(spark, [(s, p, float(w)) for s, (p, w) in open_.items()],
                          "_sid int, _prefix long, _want double")
        inside = sized.join(wanted, "_sid")
        if shift < _BITS:
            inside = inside.filter(F.shiftright("_u", shift) == F.col("_prefix"))
        shift -= _LEVEL
        sums = inside.groupBy("_sid", F.shiftright("_u", shift).alias("_b"), "_want").agg(
            F.sum("_size").alias("_n"))
        open_ = {r["_sid"]: (r["_b"], r["_rest"]) for r in _first_reaching(sums, "_b")}
    wanted = _records(spark, [(s, p, float(w)) for s, (p, w) in open_.items()],
                      "_sid int, _prefix long, _want double")
    sums = (sized.join(wanted, "_sid").filter(F.shiftright("_u", shift) == F.col("_prefix"))
            .groupBy("_sid", "_u", "_want").agg(F.sum("_size").alias("_n")))
    return {r["_sid"]: r["_u"] if r["_n"] - r["_rest"] <= r["_rest"] else r["_u"] - 1
            for r in _first_reaching(sums, "_u")}


def _split(counts: np.ndarray, shards: int, node: tuple[int, int], seed: int):
    """Blocks of the left half of a node's shards, drawn without replacement."""
    left = shards // 2
    total = int(counts.sum())
    take = total * left // shards
    rng = np.random.default_rng([seed, node[0], node[1]])
    return left, rng.multivariate_hypergeometric(counts, take, method="marginals")


def leaf_quotas(quotas: np.ndarray, shards: int, first: int, last: int,
                seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot of each source, blocks of each source) for the
    shards ``first`` to ``last - 1``, visiting only the nodes above them."""
    todo = [(0, shards, np.zeros_like(quotas), quotas)]
    while todo:
        lo, n, start, counts = todo.pop()
        if lo >= last or lo + n <= first:
            continue
        if n == 1:
            yield lo, start, counts
            continue
        left, drawn = _split(counts, n, (lo, n), seed)
        todo.append((lo + left, n - left, start + drawn, counts - drawn))
        todo.append((lo, left, start, drawn))


def _block_shards(spark, plan: list[dict], shards: int, seed: int) -> DataFrame:
    """(source, block) -> the shard of each of its passes."""
    quotas = np.array([p["slots"] for p in plan], dtype=np.int64)
    sids = np.array([p["sid"] for p in plan], dtype=np.int32)
    arrow = pa.schema([("_sid", pa.int32()), ("_from", pa.int64()), ("_to", pa.int64()),
                       ("_shard", pa.int64())])

    def run(batches):
        for batch in batches:
            leaves = np.sort(batch.column(0).to_numpy())
            if not len(leaves):
                continue
            for shard, start, counts in leaf_quotas(quotas, shards, int(leaves[0]),
                                                    int(leaves[-1]) + 1, seed):
                some = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sids[some]), pa.array(start[some]),
                     pa.array(start[some] + counts[some]),
                     pa.array(np.full(some.sum(), shard, dtype=np.int64))], schema=arrow)

    ranges = spark.range(shards).mapInArrow(
        run, "_sid int, _from long, _to long, _shard long")
    size = _records(spark, [(p["sid"], p["blocks"]) for p in plan], "_sid int, _blocks long")
    slots = ranges.select("_sid", "_shard", F.explode(
        F.sequence("_from", F.col("_to") - 1)).alias("_slot")).join(size, "_sid")
    return (slots.groupBy("_sid", F.pmod("_slot", "_blocks").alias("_block"))
            .agg(F.sort_array(F.collect_list(F.struct(
                F.floor(F.col("_slot") / F.col("_blocks")).cast("int").alias("pass"),
                F.col("_shard").alias("shard")))).alias("_draws")))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3,
        block_words: int = 50_000, blocks_per_shard: int = 64, seed: int = 17,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        keep: list[str] | None = None) -> DataFrame:
    """Decides how often and into which shards every document goes.

    Sources in code-point order (null last) take ``weights`` in turn, over and
    over. Adds size (words), source_size, target (of its source), copies, and
    draws (array of pass and shard, one for each copy). Same rows and seed,
    same result.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep)
            if c.lower() not in {"size", "source_size", "target", "copies", "draws"}]
    docs, now = set_aside(docs, _WORKING)
    id_col, source_col, text_col = now[id_col], now[source_col], now[text_col]
    size = F.size(words_of(text_or_empty(text_col))).cast("long")
    sized = staged(docs.select(F.col(f"`{source_col}`").alias("_source"),
                               place(id_col, seed).alias("_u"), size.alias("_size")), "mix-sizes")
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("n")).limit(MAX_SOURCES + 1)
    rows = totals.collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix groups of sources instead")
    rows.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [r["n"] for r in rows]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], max_repeats)
    plan = []
    for sid, (r, n, t) in enumerate(zip(rows, sizes, wanted)):
        whole = min(max_repeats, math.floor(t / n + 1e-12)) if n else 0
        plan.append({"sid": sid, "source": r["_source"], "size": n, "target": t, "whole": whole,
                     "extra": t - whole * n if whole < max_repeats else 0.0,
                     "blocks": max(1, math.ceil(n / block_words)), "cut": -1})
    sources = _records(spark, [(p["source"], p["sid"]) for p in plan],
                       "_source string, _sid int")
    by_sid = sized.join(sources, sized["_source"].eqNullSafe(sources["_source"])).select(
        "_sid", "_u", "_size")
    for sid, cut in _cutoffs(by_sid, {p["sid"]: p["extra"] for p in plan}).items():
        plan[sid]["cut"] = cut
    for p in plan:  # blocks that hold a place up to the cutoff
        reached = (p["cut"] * p["blocks"] >> _BITS) + 1 if p["cut"] >= 0 else 0
        p["slots"] = p["whole"] * p["blocks"] + reached
    total = sum(p["slots"] for p in plan)
    shards = max(1, math.ceil(total / blocks_per_shard))
    draws = _block_shards(spark, plan, shards, seed) if total else spark.createDataFrame(
        [], "_sid int, _block long, _draws array<struct<pass:int,shard:long>>")
    records = _records(spark, [(p["source"], p["sid"], p["size"], float(p["target"]), p["whole"],
                                p["blocks"], p["cut"]) for p in plan],
                       "_source string, _sid int, _source_size long, _target double, "
                       "_whole int, _blocks long, _cut long")
    own = docs.select(*[F.col(f"`{now[c]}`") for c in kept], place(id_col, seed).alias("_u"),
                      F.col(f"`{source_col}`").alias("_own"), size.alias("_size"))
    own = own.join(records, F.col("_own").eqNullSafe(F.col("_source")))
    own = own.withColumn("_block", _block(F.col("_u"), F.col("_blocks")))
    own = own.join(draws, ["_sid", "_block"], "left")
    taken = F.coalesce(F.filter("_draws", lambda d: (d["pass"] < F.col("_whole"))
                                | (F.col("_u") <= F.col("_cut"))),
                       F.array().cast("array<struct<pass:int,shard:bigint>>"))
    own = own.withColumn("_draws", taken)
    return own.select(*[F.col(f"`{now[c]}`").alias(c) for c in kept], F.col("_size").alias("size"),
                      F.col("_source_size").alias("source_size"),
                      F.col("_target").alias("target"),
                      F.size("_draws").alias("copies"), F.col("_draws").alias("draws"))


def _block(u: Column, blocks: Column) -> Column:
    """floor(u * blocks / 2**48) in 64-bit steps (blocks below 2**31)."""
    high, low = F.shiftright(u, 24), u.bitwiseAND((1 << 24) - 1)
    return F.shiftright(high * blocks + F.shiftright(low * blocks, 24), 24)


def shuffled(mixed: DataFrame, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """One row per copy, with shard and the key that orders it in its shard."""
    out = mixed.withColumn("_draw", F.explode("draws")).drop("draws")
    return out.withColumn("shard", F.col("_draw.shard")).withColumn(
        "copy", F.col("_draw.pass")).withColumn("order_key", F.xxhash64(
            F.lit(seed), F.col("shard"), F.col("copy"), F.col(f"`{id_col}`").cast("string"))
        ).drop("_draw")


def write_mix(mixed: DataFrame, path: str, seed: int = 17, id_col: str = "doc_id") -> None:
    """Writes the copies in shard order, shuffled within each shard."""
    rows = shuffled(mixed, seed, id_col)
    rows.repartitionByRange("shard", "order_key").sortWithinPartitions(
        "shard", "order_key").write.parquet(path)
