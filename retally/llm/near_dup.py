"""Near-duplicate documents: order MinHash for candidates, banded alignment for the decision.

A text is the sequence of its runs of SHINGLE words; a word is a run of letters and digits in
lower case, so changes of case and punctuation alone do not count. Similarity is that of the best alignment:
with m shingles of two texts of n1 and n2 aligned in order, m / (n1 + n2 - m). One minus it is
a metric (the Steinhaus transform of the insert-and-delete distance).

A sketch takes, under one random order of all occurrence-labelled shingles, the least ones of a
text and retains their order in the text, so it differs between texts with the same shingles in
another order. A band is a pair of sketches; texts that agree in a band are a bucket.

All members of a bucket are compared with its leader, the least text of it by digest, and links
make components. Most buckets are then in one component. In the others every pair of texts of
different components is decided inside a task: by the triangle inequality from the distances to
the leader, by the number of shingles in common, or by alignment; a pair is looked at in
the first such bucket it has in common. Large buckets are split into blocks that meet two by two,
but for blocks that lie in one component. So the number of jobs does not depend on the size of
buckets, no pair that agrees in a band is left undecided, and no pair is listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from retally.llm.common import mix, shingle_hashes, text_pieces, word_hashes, written

#: Words in a shingle, and least similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Bands of SKETCHES sketches with LEAST least shingles each. Texts with a similarity of 0.8
#: agree in a band with a chance of about 0.8**(LEAST * SKETCHES), so in none with 3e-5.
BANDS, SKETCHES, LEAST = 20, 2, 2
#: Members compared with one copy of their leader.
MEMBERS = 500
#: Texts of a block of a bucket that links with its leader do not settle. Two blocks meet in a task.
BLOCK = 400
#: Columns of the matrices by which common shingles of a block are counted.
_COLUMNS = 4096

_U = np.uint64


def labelled(hashes: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Shingle hashes labelled with how often the same shingle stands before them in its text."""
    text = np.repeat(np.arange(len(where) - 1), np.diff(where))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    seen = np.empty(len(h), np.uint64)
    seen[order] = (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))).astype(np.uint64)
    return mix(hashes + seen * _U(0x9E3779B97F4A7C15), 5)


def order_sketches(labels: np.ndarray, where: np.ndarray, n: int, least: int = LEAST) -> np.ndarray:
    """``n`` sketches of every text that has shingles, one row per text."""
    starts = where[:-1][np.diff(where) > 0]
    counts = np.diff(where)[np.diff(where) > 0]
    out = np.empty((len(starts), n), np.uint64)
    if not len(starts):
        return out
    of = np.repeat(np.arange(len(starts)), counts)
    top = _U(0xFFFFFFFFFFFFFFFF)
    for k in range(n):
        rank = (labels ^ mix(np.array([k], np.uint64), 11)) * _U(0xD6E8FEB86659FD93)
        rank ^= rank >> _U(32)
        rank *= _U(0xD6E8FEB86659FD93)
        places = np.full((len(starts), least), np.iinfo(np.int64).max)
        for i in range(least):
            lowest = np.minimum.reduceat(rank, starts)
            at = np.flatnonzero(rank == lowest[of])
            text, first = np.unique(of[at], return_index=True)  # a text may have equal ranks left
            at = at[first]
            taken = rank[at] != top
            places[text[taken], i] = at[taken]
            rank[at] = top
        places.sort(1)  # back to text order
        value = np.zeros(len(starts), np.uint64)
        for i in range(least):
            there = places[:, i] < len(labels)
            value = mix(value * _U(31) + np.where(there, labels[np.where(there, places[:, i], 0)], _U(0)), 3)
        out[:, k] = value
    return out


BUCKETS = "bucket bigint, size int, digest binary"


def _buckets(texts: DataFrame) -> DataFrame:
    """The buckets, number of shingles and ``digest`` of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, piece in text_pieces(batch.column(1)):
                hashes, where = shingle_hashes(*word_hashes(piece, plain=True), SHINGLE)
                has = np.flatnonzero(np.diff(where) > 0)
                if not len(has):
                    continue
                found = order_sketches(labelled(hashes, where), where, BANDS * SKETCHES)
                bands = np.zeros((len(has), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for k in range(SKETCHES):
                    bands = mix(bands * _U(31) + found[:, k::SKETCHES], 4)
                size = np.repeat(np.diff(where)[has], BANDS)
                take = pa.array(np.repeat(start + has, BANDS))
                columns = [pa.array(bands.ravel().view(np.int64)), pa.array(size, pa.int32()), batch.column(0).take(take)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "size", "digest"])

    return texts.select("digest", "text").mapInArrow(run, BUCKETS)


def _leaders(rows: DataFrame) -> DataFrame:
    """``bucket``, ``leader`` and its ``leader_size`` for buckets of several texts."""
    found = rows.groupBy("bucket").agg(F.min(F.struct("digest", "size")).alias("leader"), F.max("digest").alias("_most"))
    several = found.where("leader.digest <> _most")
    return several.select("bucket", F.col("leader.digest").alias("leader"), F.col("leader.size").alias("leader_size"))


def common_in_order(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """Number of elements aligned by the best alignment of two sequences, or an upper bound of it
    if the similarity is below ``least``: then no alignment inside the band reaches it.

    Equal ends are cut off; the rest is aligned in bit-parallel rows, a band wide enough for all
    inserts and deletes that ``least`` allows.
    """
    total = len(a) + len(b)
    need = least / (1 + least) * total
    n = min(len(a), len(b))
    bound = min(int(np.isin(a, b).sum()), int(np.isin(b, a).sum()))
    if bound < need:
        return bound
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b, n = a[head:], b[head:], n - head
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    width = int(total - 2 * need) + 1
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        where.setdefault(x, []).append(i)
    full = (1 << len(a)) - 1
    row = full
    for j, x in enumerate(b.tolist()):
        match = 0
        for i in where.get(x, ()):
            if abs(i - j) <= width:  # the band
                match |= 1 << i
        if match:
            step = row & match
            row = ((row + step) | (row - step)) & full
    return head + tail + len(a) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two sequences of shingles; exact if it is ``least`` or more, else an upper
    bound below it or the exact value."""
    if not len(a) or not len(b):
        return 0.0
    m = common_in_order(a, b, least)
    return m / (len(a) + len(b) - m)


#: Similarity down to which a text that is not like another one may be like one of its duplicates:
#: by the triangle inequality twice as far away as these.
BORDER = 1 - 2 * (1 - SIMILAR) - 1e-9

VERIFIED = "leader binary, digest binary, similarity double"


def _verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """``pairs`` (``leader``, ``digest``) with their similarity. A leader's text goes to as many
    tasks as its members fill, each reads it once and then one member after the other."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "digest")
    leaders = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("leader").alias("digest"))
    met = members.unionByName(leaders).join(texts, "digest").select("leader", "part", "kind", "digest", "text")
    dealt = met.repartition("leader", "part").sortWithinPartitions("leader", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            for start, piece in text_pieces(batch.column(4)):
                hashes, where = shingle_hashes(*word_hashes(piece, plain=True), SHINGLE)
                rest, out = batch.slice(start, len(piece)), []
                for i, (leader, part, kind, digest) in enumerate(zip(*(rest.column(c).to_pylist() for c in range(4)))):
                    mine = hashes[where[i] : where[i + 1]]
                    if kind == 0:
                        key, own = (leader, part), mine.copy()
                    elif key == (leader, part):
                        out.append((leader, digest, similarity(own, mine, BORDER)))
                if out:
                    a, b, s = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s)], names=["leader", "digest", "similarity"])

    return written(dealt.mapInArrow(run, VERIFIED), name)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label``: the least node of each connected component of ``links`` (``a``, ``b``).

    Labels go to neighbours and then to the label's label, so chains halve in every round;
    a round whose labels all stay is the last.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).alias("was"))
        lower = near.union(labels.select("node", "label", F.col("label").alias("was"))).groupBy("node")
        lower = written(lower.agg(F.min("label").alias("label"), F.max("was").alias("was")), "labels-near")
        of = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = written(lower.join(of, "label").select("node", F.least("label", "beyond").alias("label"), "was"), "labels-next")
        if labels.where("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def _links(verified: DataFrame) -> DataFrame:
    return verified.where(F.col("similarity") >= SIMILAR).select(F.col("leader").alias("a"), F.col("digest").alias("b"))


def _sorted_pair(a: str, b: str) -> list[F.Column]:
    return [F.least(a, b).alias("leader"), F.greatest(a, b).alias("digest")]


def _members(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts compared with the leaders of their buckets: the members of buckets of several texts with
    their component and least and most distance from the leader (``bucket``, ``digest``, ``component``,
    ``low``, ``high``), the links, and the texts that take part.

    Texts of too different lengths cannot be near and are not aligned; their lengths bound the distance.
    """
    leaders = written(_leaders(rows), "near-leaders")
    led = written(rows.join(leaders, "bucket"), "near-led")
    texts = written(_texts_of(docs, led.select("digest").distinct()), "near-texts")
    others = led.where("leader <> digest")
    ratio = F.least("size", "leader_size") / F.greatest("size", "leader_size")
    pairs = others.where(ratio >= BORDER).select(*_sorted_pair("leader", "digest")).distinct()
    verified = _verified(pairs, texts, "near-verified")
    links = _links(verified)
    labels = components(links)
    known = verified.select(F.col("leader").alias("_a"), F.col("digest").alias("_b"), "similarity")
    met = led.join(known, (F.least("leader", "digest") == F.col("_a")) & (F.greatest("leader", "digest") == F.col("_b")), "left")
    met = met.join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    own = F.col("leader") == F.col("digest")
    far = 1 - F.coalesce("similarity", ratio)
    exact = F.col("similarity") >= BORDER
    members = met.select(
        "bucket",
        "digest",
        F.coalesce("label", "digest").alias("component"),
        F.when(own, 0.0).otherwise(far).alias("low"),
        F.when(own, 0.0).when(exact, far).otherwise(1.0).alias("high"),
    )
    return written(members, "near-members"), labels.select(F.col("node").alias("a"), F.col("label").alias("b")), texts


def _open_members(members: DataFrame) -> DataFrame:
    """The members that a text of another component of their bucket may be like: by the triangle
    inequality, some other component comes near enough to the leader."""
    each = members.groupBy("bucket", "component").agg(F.min("low").alias("low"))
    first = each.groupBy("bucket").agg(F.min(F.struct("low", "component")).alias("first"), F.count("*").alias("n")).where("n > 1")
    second = each.join(first, "bucket").where("component <> first.component").groupBy("bucket").agg(F.min("low").alias("second"))
    bounds = first.join(second, "bucket").select("bucket", F.col("first.component").alias("_c"), F.col("first.low").alias("_low"), "second")
    nearest = F.when(F.col("component") == F.col("_c"), F.col("second")).otherwise(F.col("_low"))
    kept = members.join(bounds, "bucket").where(nearest - F.col("high") <= 1 - SIMILAR + 1e-9)
    return kept.select("bucket", "digest", "component", "low", "high")


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` in the tasks they meet in (``a``, ``b``, and ``second`` for those of block b): blocks follow
    components, and two blocks of one component do not meet."""
    place = F.row_number().over(W.partitionBy("bucket").orderBy("component", "digest"))
    placed = written(rows.withColumn("place", place).withColumn("block", F.expr(f"(place - 1) div {BLOCK}")).drop("place"), "near-blocks")
    block = placed.groupBy("bucket", "block").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    one = block.select("bucket", F.col("block").alias("a"), F.col("least").alias("la"), F.col("most").alias("ma"))
    two = block.select("bucket", F.col("block").alias("b"), F.col("least").alias("lb"), F.col("most").alias("mb"))
    met = one.join(two, "bucket").where((F.col("a") <= F.col("b")) & ~((F.col("la") == F.col("mb")) & (F.col("lb") == F.col("ma"))))
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(False).alias("second")))).otherwise(
        F.array(F.struct(F.col("a").alias("block"), F.lit(False).alias("second")), F.struct(F.col("b").alias("block"), F.lit(True).alias("second")))
    )
    tasks = met.select("bucket", "a", "b", F.explode(sides).alias("side")).select("bucket", "a", "b", "side.*")
    return placed.join(tasks, ["bucket", "block"]).drop("block")


LINKED = "a binary, b binary"


def _settled(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between texts of different components that share a bucket, as far as they join components."""
    rows = written(_open_members(members), "near-open")
    buckets = rows.groupBy("digest").agg(F.collect_set("bucket").alias("buckets"))  # at most BANDS
    full = _blocks(rows).join(buckets, "digest").join(texts, "digest")
    columns = ["bucket", "a", "b", "second", "digest", "component", "low", "high", "buckets", "text"]
    dealt = full.select(columns).repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "second", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            found = _links_of_blocks(key, held)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["a", "b"])

        for batch in batches:
            for start, piece in text_pieces(batch.column(9)):
                hashes, where = shingle_hashes(*word_hashes(piece, plain=True), SHINGLE)
                rest = batch.slice(start, len(piece))
                for i, row in enumerate(zip(*(rest.column(c).to_pylist() for c in range(9)))):
                    if row[:3] != key:
                        if held:
                            yield from close()
                        key, held = row[:3], []
                    held.append((*row[3:], hashes[where[i] : where[i + 1]].copy()))
        if held:
            yield from close()

    return written(dealt.mapInArrow(run, LINKED), "near-settled")


def _common_bounds(runs: list[np.ndarray]) -> np.ndarray:
    """For each two sequences an upper bound of the elements they have in common, in any order."""
    sizes = [len(r) for r in runs]
    names, codes, times = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(runs)), sizes)
    shared = times > 1  # most shingles stand in one place only
    column = np.cumsum(shared) - 1
    keep = shared[codes]
    of, at = of[keep], column[codes[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    out = np.zeros((len(runs), len(runs)), np.float32)
    for lo in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(at, [lo, lo + _COLUMNS])
        counts = np.zeros((len(runs), _COLUMNS), np.float32)
        np.add.at(counts, (of[a:b], at[a:b] - lo), 1)
        out += counts @ (counts > 0).astype(np.float32).T
    return np.minimum(out, out.T)


def _links_of_blocks(key: tuple[int, int, int], rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Links that join components, among the texts of one task."""
    bucket, a, b = key
    second, digests, components_, low, high, buckets, runs = zip(*rows)
    n = len(rows)
    sizes = np.array([len(r) for r in runs], float)
    low, high, second = np.array(low), np.array(high), np.array(second)
    common = _common_bounds(list(runs))
    apart = np.triu(np.ones((n, n), bool), 1)
    if a != b:
        apart &= second[:, None] != second[None, :]
    apart &= np.maximum(low[:, None] - high[None, :], low[None, :] - high[:, None]) <= 1 - SIMILAR + 1e-9
    apart &= common >= SIMILAR / (1 + SIMILAR) * (sizes[:, None] + sizes[None, :]) - 1e-6
    parent = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found = []
    sets = [frozenset(x) for x in buckets]
    for i, j in np.argwhere(apart):
        x, y = root(components_[i]), root(components_[j])
        if x == y or min(sets[i] & sets[j]) != bucket:
            continue
        if similarity(runs[i], runs[j], SIMILAR) >= SIMILAR:
            parent[max(x, y)] = min(x, y)
            found.append((digests[i], digests[j]))
    return found


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"), text.alias("text"))


def _texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``digest``, ``text`` once for each needed digest. Of copies, only the row with the least id
    is looked for, so copies do not meet."""
    number = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("number")
    own = docs.select("digest", number, "text")
    first = own.groupBy("digest").agg(F.min("number").alias("number")).join(needed, "digest", "left_semi")
    return own.join(first, ["digest", "number"]).groupBy("digest").agg(F.first("text").alias("text"))


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest``, ``label`` of all rows of ``docs`` (``doc_id``, ``text``): rows with one
    label are one class, equal or linked by similarities of SIMILAR or more.

    Null texts are empty; texts without words are like equal texts only; texts of fewer words
    than SHINGLE have one shingle. Repeated rows are in one class, null ids take part.
    """
    own = _digested(docs)
    members, links, texts = _members(written(_buckets(own), "near-buckets").distinct(), own)
    labels = components(links.unionByName(_settled(members, texts)))
    label = labels.select(F.col("node").alias("digest"), "label")
    return own.drop("text").join(label, "digest", "left").select("doc_id", "digest", F.coalesce("label", "digest").alias("label"))


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``class_id``, the least id of its class (null if all of
    them are null), ``class_rows`` and ``class_texts``, the rows and different texts of the class."""
    found = written(near_classes(docs), "near-classes")
    texts = found.groupBy("label", "digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    sums = texts.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_rows"), F.count("*").alias("class_texts"))
    return found.join(sums, "label").select("doc_id", "class_id", "class_rows", "class_texts")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the least id (null
    last; of equal ones the least text, and one of repeated rows), all its columns."""
    found = written(near_classes(docs), "near-classes")
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("digest").alias("d"))).alias("best"))
    chosen = best.select(F.col("best.id").alias("_id"), F.col("best.d").alias("_digest"))
    # The row is packed, so that no column of it can be taken for one of these.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    rows = docs.select(row.alias("row"), own.alias("own"), order.alias("order"))
    kept = rows.join(chosen, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_digest")))
    first = kept.groupBy("_id", "_digest").agg(F.min_by("row", "order").alias("row"))
    return first.select("row.*").select(docs.columns)
