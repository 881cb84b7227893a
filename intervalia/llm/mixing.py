"""Mixing sources to target weights.

Targets are found by water-filling: sources share the wanted total by weight, none beyond its limit.
A source's documents are dealt into blocks by a hash, which is a random permutation of them. A target
of several times the source's size takes every block that often, and what is left takes a prefix of
the permuted blocks (the last of them up to a cut). The drawn blocks of all sources are the quotas of a
multivariate-hypergeometric splitting tree: each node halves its output shards and draws how many
blocks of each source go left, so every shard gets a share that a uniform shuffle could have given
it and the quotas stay exact. Shards then take disjoint runs of each source's permuted blocks. laid_out()
brings the documents of a shard together, in the order of a hash: each shard is shuffled locally.

The mix has as many shards as its words ask for (SHARD_WORDS; MIN_SHARDS at least), and a source
BLOCKS_A_SHARD blocks for each. Only rows of sources and of blocks are ever gathered by source, and the
documents of one block of each, where the cut is; documents meet the table of blocks once.

Defined cases: a null text has size 0; null sources form one source, sorted last; documents of size 0
take nothing; a null doc_id is hashed as the empty text; rows that repeat a doc_id are documents of
their own, but rows alike in id and text are one lot at the cut; very long texts count whole, and one
may miss its source's target by half its size; an empty table gives an empty mix; input columns that
are carried must not be named like OWN (mix_documents takes any).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, packed, stash, table, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
LIMIT = 2
MIN_SHARDS, SHARD_WORDS = 16, 128_000_000
BLOCKS_A_SHARD = 64
#: Columns that mixed() adds, or needs on the way.
OWN = ("_size", "_source_size", "_target", "_draws", "_dice", "_source", "_block")
SEED = "mix-1"


def _dice(*parts: Column) -> Column:
    """32 hex digits that depend on the parts alone."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def _unit(digits: Column) -> Column:
    """A number in (0, 1) from hex digits."""
    return (F.conv(F.substring(digits, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, limit: int = LIMIT) -> DataFrame:
    """_source, _size -> with _target: budget * all sizes shared by weight, none above limit * size.

    Sources in order of limit over weight fill up first; the level is what the others get per weight.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("_weight", pick).withColumn("_full_at", limit * F.col("_size") / F.col("_weight"))
    before = Window.orderBy("_full_at", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_full_at", F.col("_source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumns(
        {
            "_level": (budget * F.sum("_size").over(everything) - limit * F.coalesce(F.sum("_size").over(before), F.lit(0))) / F.sum("_weight").over(after),
        }
    )
    # the level of the first source that isn't full at it holds for all that come after
    s = s.withColumn("_at", F.min(F.when(F.col("_level") < F.col("_full_at"), F.struct("_full_at", F.col("_level")))).over(everything)["_level"])
    target = F.when(F.col("_at").isNull() | (F.col("_full_at") <= F.col("_at")), (limit * F.col("_size")).cast("double")).otherwise(F.col("_weight") * F.col("_at"))
    return s.select("_source", "_size", "_docs", target.alias("_target"))


def _hypergeometric(drawn: Column, good: Column, total: Column, u: Column) -> Column:
    """How many of `drawn` balls are good, for a uniform u: inverse of the distribution, summed in logarithms.

    Counts over 40 deviations from the mean are passed over: their shares are 0 in double precision.
    """
    share = good / F.greatest(total, F.lit(1))
    mean, most = drawn * share, 40 * F.sqrt(drawn * share * (1 - share)) + 40
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - good), F.floor(mean - most).cast("long"))
    high = F.least(good, drawn, F.ceil(mean + most).cast("long"))

    def step(k: Column) -> Column:
        """Log of the ratio of the probabilities of k and k - 1."""
        return F.log((good - k + 1) * (drawn - k + 1)) - F.log(k * (total - good - drawn + k))

    def by(low: Column) -> Column:
        rest = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))

        def add(a: Column, k: Column) -> Column:
            w = a["w"] + step(k)
            top = F.greatest(a["top"], w)
            return F.struct(w.alias("w"), top.alias("top"), (a["sum"] * F.exp(a["top"] - top) + F.exp(w - top)).alias("sum"))

        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum"))
        whole = F.aggregate(rest, zero, add, lambda a: F.struct(a["top"], a["sum"]))

        def choose(t: Column) -> Column:
            wanted = u * t["sum"]

            def walk(a: Column, k: Column) -> Column:
                w = a["w"] + step(k)
                return F.struct(w.alias("w"), (a["cum"] + F.exp(w - t["top"])).alias("cum"), F.when(a["cum"] < wanted, k).otherwise(a["k"]).alias("k"))

            start = F.struct(F.lit(0.0).alias("w"), F.exp(-t["top"]).alias("cum"), low.alias("k"))
            return F.aggregate(rest, start, walk, lambda a: a["k"])

        return let(whole, choose)

    return let(low, by)


def split_quotas(quotas: DataFrame, shards: int = MIN_SHARDS) -> DataFrame:
    """_source, _blocks -> one row a source with _ends: after shard i, how many of its blocks are dealt."""
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    entry = F.struct(F.coalesce(F.col("_source").isNull().cast("int"), F.lit(0)).alias("last"), F.col("_source").alias("source"), F.col("_blocks").cast("long").alias("n"))
    nodes = quotas.agg(F.array_sort(F.collect_list(entry)).alias("_q")).withColumn("_node", F.lit(1).cast("long"))
    width = shards
    while width > 1:
        total = F.aggregate("_q", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        left = F.floor((total + F.pmod(F.col("_node"), F.lit(2))) / 2).cast("long")  # an odd block goes left or right by node
        zero = F.struct(left.alias("drawn"), total.alias("total"), F.array().cast("array<bigint>").alias("take"))

        def draw(a: Column, x: Column) -> Column:
            got = _hypergeometric(a["drawn"], x["n"], a["total"], _unit(_dice(F.col("_node"), x["source"], F.col("_tree"))))
            return let(got, lambda k: F.struct((a["drawn"] - k).alias("drawn"), (a["total"] - x["n"]).alias("total"), F.concat(a["take"], F.array(k)).alias("take")))

        cut = nodes.withColumn("_tree", F.lit("split")).withColumn("_left", F.aggregate("_q", zero, draw, lambda a: a["take"]))
        side = lambda f: F.zip_with("_q", "_left", lambda x, k: F.struct(x["last"].alias("last"), x["source"].alias("source"), f(x["n"], k).alias("n")))
        both = F.array(F.struct((F.col("_node") * 2).alias("node"), side(lambda n, k: k).alias("q")), F.struct((F.col("_node") * 2 + 1).alias("node"), side(lambda n, k: n - k).alias("q")))
        nodes = cut.select(F.explode(both).alias("_c")).select(F.col("_c.q").alias("_q"), F.col("_c.node").alias("_node"))
        width //= 2
    leaf = nodes.select((F.col("_node") - shards).cast("int").alias("_shard"), F.explode("_q").alias("_e"))
    per = leaf.groupBy(F.col("_e.source").alias("_source")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_shard", F.col("_e.n").alias("n")))), lambda x: x["n"]).alias("_n"))
    sums = F.aggregate("_n", F.array().cast("array<bigint>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(None)), F.lit(0).cast("long")) + n)))
    return per.select("_source", sums.alias("_ends"))


def shards_for(words: int, budget: float = BUDGET) -> int:
    """Output shards of a mix out of so many words: a power of two."""
    return max(MIN_SHARDS, 1 << math.ceil(math.log2(max(1.0, budget * words / SHARD_WORDS))))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: list[str] | None = None, shards: int | None = None) -> DataFrame:
    """The columns `carry` (all, if None) with _size, _source_size, _target and _draws.

    _draws has an entry (pass, shard, place) for every time the mix takes the document; see laid_out().
    """
    return planned(docs, text, source, doc_id, carry, shards)[0]


def planned(docs: DataFrame, text: str, source: str, doc_id: str, carry: list[str] | None, shards: int | None) -> tuple[DataFrame, int]:
    """mixed(), and how many shards it has."""
    carry = list(docs.columns) if carry is None else carry
    if clash := set(carry) & set(OWN):
        raise ValueError(f"columns {sorted(clash)} are the mix's own")
    dice = _dice(F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit(""))))
    sized = docs.select(*carry, word_count(F.col(text)).alias("_size"), dice.alias("_dice"), F.col(source).alias("_source"))
    slim = [] if text in carry or any(docs.schema[c].dataType.typeName() == "struct" for c in carry) else carry  # texts are read again, not written
    rows = stash(sized.select(*slim, "_size", "_dice", "_source"), "mix-sizes")
    sources = stash(rows.groupBy("_source").agg(F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_docs")), "mix-sources")
    shards = shards or shards_for(sources.agg(F.sum("_size")).first()[0] or 0)
    block = F.pmod(F.conv(F.substring("_dice", 1, 8), 16, 10).cast("long"), F.lit(BLOCKS_A_SHARD * shards)).cast("int")
    full = F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(0).cast("int")
    plan = source_targets(sources).select(F.col("_source").alias("_s"), F.col("_size").alias("_source_size"), "_target", full.alias("_full"), (F.col("_target") - full * F.col("_size")).alias("_rest"))
    plan = stash(plan, "mix-targets")

    # where blocks begin in their source's permutation; the last one that begins before the rest's end holds the cut
    in_blocks = rows.select("_source", block.alias("_block"), "_dice", "_size")
    sums = in_blocks.groupBy("_source", "_block").agg(F.sum("_size").alias("_block_size"))
    begin = F.coalesce(F.sum("_block_size").over(Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = stash(sums.withColumn("_begin", begin).join(plan, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-blocks")
    edge = blocks.filter("_begin < _rest").groupBy(F.col("_source").alias("_s")).agg(F.max("_block").alias("_cut_block"), F.max_by("_begin", "_block").alias("_cut_begin"), F.max("_rest").alias("_cut_rest"))
    edge = stash(edge, "mix-edges")
    at_edge = in_blocks.join(edge, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_cut_block"))).drop("_source")
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_s").orderBy("_dice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a document is in the last pass if its middle lies before the rest's end
    taken = at_edge.withColumn("_middle", F.col("_cut_begin") + before + F.col("_size") / 2).filter("_middle <= _cut_rest")
    cut = taken.groupBy(F.col("_s").alias("_c")).agg(F.max("_dice").alias("_cut_dice"))
    cut = stash(edge.join(cut, F.col("_s").eqNullSafe(F.col("_c")), "left").select("_s", "_cut_block", "_cut_dice"), "mix-cuts")

    passes = F.when(F.col("_begin") < F.col("_rest"), F.col("_full")).otherwise(F.col("_full") - 1)
    drawn = blocks.filter(passes >= 0).select("_source", "_block", F.explode(F.sequence(F.lit(0), passes)).alias("_pass"))
    at = Window.partitionBy("_source").orderBy(_dice(F.col("_source"), F.col("_block"), F.col("_pass")), "_block", "_pass")
    drawn = stash(drawn.withColumn("_at", F.row_number().over(at).cast("long")), "mix-drawn")
    ends = split_quotas(drawn.groupBy("_source").agg(F.count(F.lit(1)).alias("_blocks")), shards)
    ends = ends.select("_source", F.lit(None).cast("int").alias("_block"), F.lit(None).cast("int").alias("_pass"), F.explode("_ends").alias("_at"))
    # a block's shard: how many shards have ended before it
    so_far = Window.partitionBy("_source").orderBy("_at", F.col("_block").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    lots = drawn.unionByName(ends).withColumn("_shard", F.sum(F.col("_block").isNull().cast("int")).over(so_far).cast("int")).filter("_block IS NOT NULL")
    lots = lots.groupBy("_source", "_block").agg(F.array_sort(F.collect_list(F.struct(F.col("_pass").alias("pass"), F.col("_shard").alias("shard")))).alias("_lots"))
    lots = lots.select(F.col("_source").alias("_l"), F.col("_block").alias("_lb"), "_lots")
    b = blocks.join(lots, F.col("_source").eqNullSafe(F.col("_l")) & (F.col("_block") == F.col("_lb")), "left").join(cut, F.col("_source").eqNullSafe(F.col("_s")), "left")
    b = stash(b.select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_source_size", "_target", "_full", "_cut_block", "_cut_dice", "_lots"), "mix-lots")

    dealt = (rows if slim else sized).withColumn("_block", block)
    both = dealt.join(b, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    last = (F.col("_block") < F.col("_cut_block")) | ((F.col("_block") == F.col("_cut_block")) & (F.col("_dice") <= F.col("_cut_dice")))
    times = F.when(F.col("_size") > 0, F.col("_full") + F.coalesce(last, F.lit(False)).cast("int")).otherwise(0)
    taken = F.filter(F.coalesce("_lots", F.array().cast("array<struct<pass:int,shard:int>>")), lambda x: x["pass"] < times)
    place = lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), _dice(F.col("_dice"), x["pass"], F.lit("place")).alias("place"))
    return both.select(*carry, "_size", "_source_size", "_target", F.transform(taken, place).alias("_draws")), shards


def laid_out(mix: DataFrame, shards: int) -> DataFrame:
    """A row for every draw of mixed(): a partition holds a shard, in the order of its places."""
    drawn = mix.withColumn("_draw", F.explode("_draws")).drop("_draws")
    return drawn.repartitionById(shards, F.col("_draw.shard")).sortWithinPartitions("_draw.place")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    got = mixed(docs, carry=["doc_id"])
    return got.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.size("_draws")).alias("taken")
    )


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a row for every time a document is taken, in the columns it came with; a partition is a shard.

    Defined cases as above; columns of any name and type pass through.
    """
    return laid_out(*planned(packed(docs, "text", "source", "doc_id"), "text", "source", "doc_id", ["doc"], None)).select("doc.*")


SIZE_SQL = """len(list_filter(string_split(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '      '), ' '), lambda x: x <> ''))"""

SQL = f"""WITH d AS (SELECT doc_id, source, {SIZE_SQL}::BIGINT AS size, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS dice FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, count(*) AS docs FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
f AS (SELECT *, {LIMIT} * total / weight AS full_at FROM w),
l AS (SELECT *, ({BUDGET}::DOUBLE * sum(total) OVER () - {LIMIT} * coalesce(sum(total) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
lev AS (SELECT arg_min(level, full_at) AS a FROM l WHERE level < full_at),
t AS (SELECT source, total, CASE WHEN a IS NULL OR full_at <= a THEN ({LIMIT} * total)::DOUBLE ELSE weight * a END AS target,
        ({BLOCKS_A_SHARD} * greatest({MIN_SHARDS}, 2 ** ceil(log2(greatest(1, {BUDGET}::DOUBLE * sum(total) OVER () / {SHARD_WORDS})))))::BIGINT AS n_blocks FROM l CROSS JOIN lev),
r AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT d.*, total, target, whole, target - whole * total AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(dice, 1, 8))::BIGINT % n_blocks, dice, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, total AS source_size, target,
  (CASE WHEN size > 0 THEN size * (whole + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken FROM x"""
