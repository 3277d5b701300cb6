"""Mixing sources to target weights, with DataFrame operations only.

A document has a fixed place between 0 and 1 in its source, a hash of its id. A source's share
of the mix is a whole number of copies of all its documents and, of one more copy, the
documents below a cut, which is found digit by digit. Places are cut into blocks; what a source
gives is a quota of blocks. A tree splits the quotas of all sources among output shards: each
node gives half of its blocks to either child, and how many of each source is a draw of the
multivariate hypergeometric distribution, so a shard's composition is that of a random sample
and all quotas are met exactly. Sources hang in groups under a second tree, whose rows are
drawn group by group. Shards then draw disjoint runs of each source's permuted
blocks, and rows are shuffled within their shard.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from retally.llm.common import WORD, written

#: Weights of the sources in order of code points, null last, repeated.
WEIGHTS = (5, 2, 1)
#: Size of the mix in sizes of all documents; most copies of a source.
TOTAL, MOST = 1.5, 2
#: Output shards are 2**LEVELS at least, and of about so many words; documents in a block, about.
LEVELS, SHARD_WORDS, BLOCK = 4, 64_000_000, 64
#: Sources whose quotas are split in one row, and groups of sources in one row of the next tier.
GROUP = 256
SEED = "mix-1"

#: Bits of a place, and of a digit of the search for the cut.
_BITS, _DIGIT = 60, 15


def size_of(text: F.Column) -> F.Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(doc_id: F.Column) -> F.Column:
    """The place of a document in its source, 60 bits of a digest of its id (null: of '')."""
    digest = F.md5(F.concat(F.lit(f"{SEED}/"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def ranked(rows: DataFrame, *order: F.Column) -> DataFrame:
    """``rows`` with ``rank`` from 0 in an order over all of them, sorted in parallel: partitions
    are ranges, and only their sizes are summed up."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(ranges, "mix-ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").count()  # one row per partition
    before = F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = placed.join(sizes.select("_part", before.alias("_before")), "_part")
    return joined.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """Per source of ``rows`` (``source``, ``size``, ``place``): ``rank``, ``n``, ``words``, ``target``.

    Targets share ``total`` times all sizes by weight; none is above ``most`` times its source's
    size, and what that cuts off is shared among the others by weight. The level, target by
    weight of a source that is not cut off, rises until it agrees with itself; each round is one
    aggregate of two numbers.
    """
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    listed = written(ranked(sums, F.col("source").isNull(), F.col("source")), "mix-sources")
    each = F.array(*[F.lit(float(w)) for w in weights])
    listed = listed.withColumn("weight", F.get(each, (F.col("rank") % len(weights)).cast("int")))
    limit = F.col("words") * float(most)
    goal = total * (listed.agg(F.sum("words")).first()[0] or 0)
    level = 0.0
    while True:
        full = limit <= F.col("weight") * level
        taken, open_ = listed.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if not open_ or (goal - taken) / open_ <= level:
            break
        level = (goal - taken) / open_
    return listed.withColumn("target", F.least(limit, F.col("weight") * level))


def with_cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with ``copies`` of all documents, and ``cut``: documents at a lower place are
    taken once more. The words so taken are those nearest to the target, documents in order of
    place; documents at one place (of one id) are taken together.

    A step sums the sizes by source and digit, at most 2**15 rows a source, and goes on inside
    the digit where the target lies, so no task sorts a source.
    """
    some = F.col("words") > 0
    share = F.when(some, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    left = sources.withColumn("copies", share.cast("int")).withColumn(
        "rest", F.when(some, F.col("target") - F.col("copies") * F.col("words")).otherwise(0.0)
    )
    places = rows.where("size > 0").select("source", "place", "size")
    found = left.select("source", F.col("rest").alias("todo"), F.lit(0).cast("long").alias("prefix"))
    for step in range(_BITS // _DIGIT):
        lower = _BITS - _DIGIT * (step + 1)
        inside = places.withColumn("digit", F.shiftright("place", lower)).withColumn("prefix", F.shiftright("digit", _DIGIT))
        a, b = inside.alias("a"), found.alias("b")
        met = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.prefix") == F.col("b.prefix")))
        sums = met.groupBy("b.source", "todo", "digit").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("digit"))
        passed = sums.withColumn("upto", upto).where("upto > todo")
        first = passed.groupBy("source").agg(F.min(F.struct("digit", "upto", "words", "todo")).alias("at"))
        todo = F.col("at.todo") - (F.col("at.upto") - F.col("at.words"))
        found = written(first.select("source", todo.alias("todo"), F.col("at.digit").alias("prefix"), F.col("at.words").alias("words")), f"mix-cut-{step}")
    nearer = F.col("words") - F.col("todo") < F.col("todo")
    ends = found.select(F.col("source").alias("_source"), (F.col("prefix") + nearer.cast("long")).alias("cut"))
    joined = left.join(ends, left["source"].eqNullSafe(ends["_source"]), "left").drop("_source")
    # Without a rest there is no more copy, of documents without words neither.
    return joined.withColumn("cut", F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(0))).otherwise(0)).drop("rest")


def with_quotas(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sources`` with ``width`` (places in a block), ``blocks`` of one copy, and ``quota``: blocks
    that it gives in all, the last of one more copy up to the cut."""
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n") / F.lit(block), F.lit(1.0))))).cast("int")
    sized = sources.withColumn("blocks", F.pow(F.lit(2.0), bits).cast("long")).withColumn("width", F.expr(f"{1 << _BITS}L div blocks"))
    more = F.when(F.col("cut") > 0, F.expr("(cut - 1) div width") + 1).otherwise(0)
    return sized.withColumn("quota", F.col("copies") * F.col("blocks") + more)


def _hypergeometric(total: str, kind: str, drawn: str, chance: str) -> str:
    """SQL for a draw: how many of ``kind`` marked ones are among ``drawn`` of ``total``, by
    inversion of the distribution with a uniform ``chance``. Weights are summed from twelve
    deviations below the mode to twelve above; what lies beyond has a chance below 1e-30."""
    low = f"greatest(0L, {drawn} - ({total} - {kind}))"
    high = f"least({drawn}, {kind})"
    mode = f"cast(floor(({drawn} + 1D) * ({kind} + 1D) / ({total} + 2D)) as bigint)"
    reach = (
        f"cast(12 * sqrt({drawn} * ({kind} / greatest({total}, 1L)) * (1 - {kind} / greatest({total}, 1L))"
        f" * (({total} - {drawn}) / greatest({total} - 1, 1L))) as bigint) + 8"
    )
    first, last = f"greatest({low}, {mode} - ({reach}))", f"least({high}, {mode} + ({reach}))"
    steps = f"if({last} > {first}, sequence({first}, {last} - 1), cast(array() as array<bigint>))"
    ratio = f"(({kind} - x) * 1D * ({drawn} - x)) / ((x + 1D) * ({total} - {kind} - {drawn} + x + 1))"
    whole = f"aggregate({steps}, struct(1D as w, 1D as s), (t, x) -> struct(t.w * {ratio} as w, t.s + t.w * {ratio} as s), t -> t.s)"
    return (
        f"aggregate({steps}, struct(1D as w, 1D as s, {first} as at, {chance} * {whole} as goal), (t, x) -> "
        f"struct(t.w * {ratio} as w, t.s + t.w * {ratio} as s, if(t.s <= t.goal, x + 1, t.at) as at, t.goal as goal), t -> t.at)"
    )


def _halved(rows: DataFrame, level: int, tier: int) -> DataFrame:
    """``rows`` (``node``, ``group``, ``quotas``, ``drawn``) with ``left``: how many of the ``drawn`` blocks
    that go to the left half of the node's shards come from each of the group's members."""
    seed = SEED if tier == 0 else f"{SEED}/{tier}"
    chance = f"(pmod(xxhash64('{seed}', node, {level}, q.rank), 9007199254740992L) / 9007199254740992D)"
    draw = _hypergeometric("a.total", "q.quota", "a.drawn", chance)
    total = "aggregate(quotas, 0L, (s, q) -> s + q.quota)"
    # One member after the other: the rest of the group and of the draw go down as it is made.
    left = (
        f"aggregate(quotas, struct({total} as total, drawn, cast(array() as array<bigint>) as made),"
        f" (a, q) -> transform(array({draw}), x -> struct(a.total - q.quota as total, a.drawn - x as drawn, concat(a.made, array(x)) as made))[0],"
        f" a -> a.made)"
    )
    return rows.select("node", "group", "quotas", F.expr(left).alias("left"))


def _children(made: DataFrame) -> DataFrame:
    """The two halves of each row: the left one has what was drawn, the right one the rest."""
    both = F.expr(
        "explode(array("
        "struct(node * 2 as node, transform(quotas, (q, i) -> struct(q.rank as rank, left[i] as quota)) as quotas),"
        "struct(node * 2 + 1 as node, transform(quotas, (q, i) -> struct(q.rank as rank, q.quota - left[i] as quota)) as quotas)))"
    )
    return made.select("group", both.alias("child")).select("child.node", "group", "child.quotas")


def split(sources: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Blocks per ``shard`` and source ``rank``: ``quota`` and ``first``, the source's blocks that
    earlier shards have.

    The tree has two sides. Shards are halved level by level; sources hang under groups of GROUP, groups
    under groups of groups. At a node the top groups' quotas are drawn first, then those of each group's
    members given the group's draw, which is the same distribution. A row holds the numbers of one group,
    so rows are dealt to tasks and stay as short with millions of sources as with hundreds.
    """
    n = (sources.agg(F.max("rank")).first()[0] or 0) + 1
    tiers = [sources.select("rank", F.col("quota").cast("bigint").alias("quota"))]
    while n > GROUP:
        n = -(-n // GROUP)
        tiers.append(tiers[-1].groupBy(F.expr(f"rank div {GROUP}").alias("rank")).agg(F.sum("quota").alias("quota")))
    deep = len(tiers) > 1
    kept = (lambda df, name: written(df, name)) if deep else (lambda df, name: df)
    rows = []
    for tier in tiers:
        member = F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("quotas")  # GROUP at most
        grouped = tier.groupBy(F.expr(f"rank div {GROUP}").alias("group")).agg(member)
        rows.append(kept(grouped.select(F.lit(0).cast("bigint").alias("node"), "group", "quotas"), "mix-groups"))
    for level in range(levels):
        drawn = None
        for tier in reversed(range(len(tiers))):
            if drawn is None:
                given = rows[tier].withColumn("drawn", F.expr("aggregate(quotas, 0L, (s, q) -> s + q.quota) div 2"))
            else:
                given = rows[tier].join(drawn, ["node", "group"])
            made = kept(_halved(given, level, tier), f"mix-halves-{level}")
            if tier:
                each = F.expr("inline(transform(quotas, (q, i) -> struct(q.rank as group, left[i] as drawn)))")
                drawn = made.select("node", each)
            rows[tier] = _children(made)
    cells = rows[0].select(F.col("node").cast("int").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.rank", "q.quota")
    before = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))


#: A prime for permuting the blocks of a source.
_PRIME = (1 << 31) - 1


def draws(sources: DataFrame, cells: DataFrame) -> DataFrame:
    """Every block that is drawn: ``rank``, ``copy``, ``block``, ``shard``. The draws of a source are
    a permutation of its copies' blocks, a multiplication modulo their number, so shards get
    disjoint blocks from all over the source without a sort."""
    some = cells.where("quota > 0").select("shard", "rank", F.explode(F.expr("sequence(first, first + quota - 1)")).alias("draw"))
    of = sources.select("rank", F.col("quota").alias("all"), "blocks")
    factor = F.expr(f"if(all % {_PRIME} = 0, 1L, {_PRIME}L)")
    at = some.join(of, "rank").withColumn("at", (F.col("draw") * factor) % F.col("all"))
    return at.select("rank", F.expr("cast(at div blocks as int)").alias("copy"), (F.col("at") % F.col("blocks")).alias("block"), "shard")


def plan(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The sources with targets, cuts and quotas, and the drawn blocks, for documents with
    ``doc_id``, ``source`` and ``text``. Both are written tables."""
    slim = written(docs.select("source", size_of(F.col("text")).alias("size"), place_of(F.col("doc_id")).alias("place")), "mix-sizes")
    return plan_of(slim, **options)


def levels_for(words: float) -> int:
    """Levels of the tree of shards for a mix of so many words: LEVELS at least."""
    return max(LEVELS, math.ceil(math.log2(max(words, 1) / SHARD_WORDS)))


def plan_of(slim: DataFrame, block: int = BLOCK, levels: int | None = None, **shares) -> tuple[DataFrame, DataFrame]:
    """The same from ``source``, ``size`` and ``place``. The number of shards follows the mix's words
    unless ``levels`` says how often they are halved."""
    sources = written(with_quotas(with_cuts(slim, targets(slim, **shares)), block), "mix-quotas")
    if levels is None:
        levels = levels_for(sources.agg(F.sum("target")).first()[0] or 0)
    return sources, written(draws(sources, split(sources, levels)), "mix-draws")


def mixed(docs: DataFrame, sources: DataFrame, drawn: DataFrame, keep_all: bool = False) -> DataFrame:
    """``docs`` (with ``source``, ``_size``, ``_place``) once for each copy that a shard draws, with
    ``_shard``, ``_copy`` and ``_order``, the rows' order inside their shard. With ``keep_all`` a
    document that no shard draws is there once, without shard."""
    mine = sources.select(F.col("source").alias("_from"), "rank", "copies", "cut", "width", "words", "target")
    joined = docs.join(mine, docs["source"].eqNullSafe(mine["_from"])).drop("_from")
    most = F.col("copies") + (F.col("_place") < F.col("cut")).cast("int")
    listed = F.when(most > 0, F.sequence(F.lit(0), most - 1))
    joined = joined.withColumn("block", F.expr("_place div width")).withColumn("copy", F.explode_outer(listed) if keep_all else F.explode(listed))
    rows = joined.join(drawn, ["rank", "copy", "block"], "left" if keep_all else "inner")
    rows = rows.withColumnsRenamed({"shard": "_shard", "copy": "_copy"})
    return rows.withColumn("_order", F.xxhash64(F.lit(SEED), "_shard", "_place", "_copy"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix of ``docs``: their rows, each as often as it is drawn, in their shard's shuffled
    order, one partition or more a shard."""
    sources, drawn = plan(docs, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # names of its own do not clash
    own = docs.select(row, "source", size_of(F.col("text")).alias("_size"), place_of(F.col("doc_id")).alias("_place"))
    rows = mixed(own, sources, drawn)
    dealt = rows.repartitionByRange("_shard", "_order").sortWithinPartitions("_shard", "_order")
    return dealt.select("_row.*")


def digests(docs: DataFrame, **options) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of
    it, repeats counted."""
    slim = written(
        docs.select("doc_id", "source", size_of(F.col("text")).alias("_size"), place_of(F.col("doc_id")).alias("_place")), "mix-documents"
    )
    sources, drawn = plan_of(slim.select("source", F.col("_size").alias("size"), F.col("_place").alias("place")), **options)
    rows = mixed(slim.withColumn("_row", F.monotonically_increasing_id()), sources, drawn, keep_all=True)
    first = [F.first(c).alias(c) for c in ("doc_id", "_size", "words", "target")]
    summed = rows.groupBy("_row").agg(*first, F.coalesce(F.sum(F.when(F.col("_shard").isNotNull(), F.col("_size"))), F.lit(0)).alias("taken"))
    return summed.select("doc_id", F.col("_size").alias("size"), F.col("words").alias("source_size"), "target", "taken")


ORACLE = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS words, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT 0 AS k, 0::DOUBLE AS level
  UNION ALL
  SELECT k + 1, (SELECT (1.5 * sum(words) - coalesce(sum(2.0 * words) FILTER (2.0 * words <= weight * level), 0))::DOUBLE
    / sum(weight) FILTER (NOT 2.0 * words <= weight * level) FROM sources)
  FROM levels WHERE k < 60),
targets AS (
  SELECT source, words, least(2.0 * words, weight * (SELECT max(level) FROM levels))::DOUBLE AS target FROM sources),
run AS (
  SELECT s.doc_id, s.size, t.words, t.target,
    CASE WHEN t.words > 0 THEN floor(t.target / t.words) ELSE 0 END AS copies,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place) AS upto,
    sum(s.size) OVER (PARTITION BY s.source, s.place) AS here
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, words AS source_size, target,
  (size * (copies + CASE WHEN upto <= target - copies * words
    OR upto - (target - copies * words) < (target - copies * words) - (upto - here) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
