"""Suffix-array dedup: finds every byte covered by a long string that starts anywhere else too.

Strings of LENGTH bytes are compared without listing them. Each has an anchor, the least hashed
GRAM of bytes inside it (the first of equal ones), so equal strings have equal anchors at the
same place; about two of a hundred positions are anchors. The strings of one anchor start in a
row; the bytes that all of them span are its context.

1. Anchors meet by the hash of their gram. Equal contexts cover each other whole. What is left
   are different contexts around equal grams.
2. Their suffixes (from the anchor on) and reversed prefixes (back from it) are sorted by
   mergesorts whose comparisons find the common extension by binary search over prefix
   hashes: eight steps for any two suffixes. Neighbours in sorted order with common extensions
   of l bytes before and r bytes after their anchors share a string if l + r reaches LENGTH.
   What these hashes call equal is compared byte by byte.

Contexts of step 1, which are most repeats, are not sent around as bytes: they count as equal only if
a second hash of all their bytes, of another base and other values of bytes, agrees too. Contexts on
which the two hashes disagree are different ones, and go on to step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retally.llm.common import Prefix, bytes_of, free_name, mix, text_pieces, written

LENGTH = 200
GRAM = 80
#: Base and values of bytes of the second hash of a context.
_PROOF_BASE, _PROOF_VALUE = 0xD1342543DE82EF95, mix(np.arange(256, dtype=np.uint64), 23) | np.uint64(1)
#: Starts that one anchor is looked for in.
SPAN = LENGTH - GRAM + 1


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All anchors of the texts in ``data``: ``text``, ``at`` (from the start of the data), ``key``
    (hash of the gram), ``low`` and ``high`` (first and last start of its strings), ``context``
    (hash of the bytes from low to high + LENGTH and of the anchor's place in them), ``proof`` (another
    one of these bytes)."""
    names = ("text", "at", "key", "low", "high", "context", "proof")
    n = len(data)
    if n < LENGTH:
        return {name: np.zeros(0, np.int64) for name in names}
    prefix = Prefix(data)
    keys = mix(prefix.windows(GRAM))
    # Least by the upper half of the key, then by place: no two are equal.
    order = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    least, width = order, 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if SPAN > width:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by start of the string
    # Strings must not reach into the next text.
    whole = np.zeros(n + 1, np.int64)
    whole[offsets[1:-1]] += 1
    text_of = np.cumsum(whole)[:n] if len(offsets) > 2 else np.zeros(n, np.int64)
    starts = np.flatnonzero(text_of[: n - LENGTH + 1] == text_of[LENGTH - 1 :])
    if not len(starts):
        return {name: np.zeros(0, np.int64) for name in names}
    at = at[starts]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text_of[starts[1:]] != text_of[starts[:-1]]))))
    last = np.append(first[1:], len(starts)) - 1
    low, high, at = starts[first], starts[last], at[first]
    shape = mix(((at - low) * 256 + (high - low)).astype(np.uint64), 3)
    context, key, text = mix(prefix.of(low, high + LENGTH) ^ shape, 2), keys[at], text_of[low]
    del prefix, keys, order, least, whole, text_of, starts  # each as long as the text, some eight times
    proof = Prefix(data, _PROOF_BASE, _PROOF_VALUE).of(low, high + LENGTH)
    return {"text": text, "at": at, "key": key, "low": low, "high": high, "context": context, "proof": proof}


#: Contexts of one gram that are sorted together; more are first told apart by longer strings.
MOST_CONTEXTS = 20_000
#: Contexts that a task sorts at a time, of as many grams as it takes.
SORT_ROWS = 4_000

# Place of an anchor in its text in one number: first start, bytes from there to the anchor, bytes
# from the first start to the last.
_LOW_BITS = 31


def _identified(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tag`` (64 bits of hash, which tell texts of one id apart) and ``text`` of all
    documents."""
    return docs.select("doc_id", _tag(F.col("text")).alias("tag"), F.coalesce("text", F.lit("")).alias("text"))


def _tag(text: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _pack(low: np.ndarray, off: np.ndarray, span: np.ndarray) -> np.ndarray:
    return (low << 14) | (off << 7) | span


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, ...]:
    return packed >> 14, (packed >> 7) & 127, packed & 127


def _third_or_later(key: np.ndarray, context: np.ndarray, proof: np.ndarray) -> np.ndarray:
    """Which rows have two others with their key, context and proof before them: these are equal to
    others for sure, and nothing else depends on them, so they need not meet their key."""
    order = np.lexsort((proof, context, key))
    same = np.ones(max(len(key) - 1, 0), bool)
    for part in (key, context, proof):
        same &= part[order][1:] == part[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[2:]] = same[1:] & same[:-1]
    return out


PLACES = "key bigint, context bigint, proof bigint, doc_id bigint, tag bigint, place bigint"


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """``key``, ``context``, ``proof``, ``doc_id``, ``tag``, ``place`` of every anchor, and whether it is ``sure``
    to be equal to others of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, made = batch.column(1).to_numpy(), []
            for start, piece in text_pieces(batch.column(2)):
                data, offsets = bytes_of(piece)
                found = anchors(data, offsets)
                text = found["text"]
                low = found["low"] - offsets[text]
                place = _pack(low, found["at"] - found["low"], found["high"] - found["low"])
                made.append((*(found[c].view(np.int64) for c in ("key", "context", "proof")), start + text, place))
            key, context, proof, row, place = (np.concatenate(x) for x in zip(*made))
            sure = _third_or_later(key, context, proof)
            columns = [pa.array(key), pa.array(context), pa.array(proof), batch.column(0).take(pa.array(row)), pa.array(tags[row]), pa.array(place), pa.array(sure)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "context", "proof", "doc_id", "tag", "place", "sure"])

    chosen = docs.where(f"octet_length(text) >= {LENGTH}")
    return chosen.mapInArrow(run, f"{PLACES}, sure boolean")


class _Meeting:
    """Rows of one partition in order of key, context and proof: which contexts occur again, and which
    meet others of their key. Between batches it keeps at most two rows of the context that is
    not over, and one of another context of its key as a witness."""

    def __init__(self):
        self.rest: pa.Table | None = None
        self.given = np.zeros(0, bool)  # rows of the rest that were given out as different
        self.equal = np.zeros(0, bool)  # and as equal

    def add(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        """Which of the returned rows are equal to others, and which are the one row of their
        context that meets other contexts."""
        kept = len(self.given)
        if self.rest is not None:
            rows = pa.concat_tables([self.rest, rows])
        n = rows.num_rows
        key, context, proof = (rows.column(i).to_numpy() for i in (0, 1, 2))
        given = np.concatenate([self.given, np.zeros(n - kept, bool)])
        equal = np.concatenate([self.equal, np.zeros(n - kept, bool)])
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_context = new_key.copy()
        new_context[1:] |= (context[1:] != context[:-1]) | (proof[1:] != proof[:-1])
        of = np.cumsum(new_context) - 1
        first = np.flatnonzero(new_context)
        sizes = np.diff(np.append(first, n))
        key_of = np.cumsum(new_key)[first] - 1
        several = np.bincount(key_of)[key_of] > 1
        again = sizes[of] > 1
        known = np.zeros(len(first), bool)
        np.logical_or.at(known, of, given)
        differs = np.zeros(n, bool)
        differs[first[several & ~known]] = True
        out_equal = again & ~equal
        # What the next batch may continue.
        last = np.arange(first[-1], min(first[-1] + 2, n))
        witness = [first[-2]] if len(first) > 1 and key_of[-2] == key_of[-1] else []
        keep = np.concatenate([witness, last]).astype(np.int64)
        self.rest = rows.take(pa.array(keep)).combine_chunks()
        now = (known | (several & ~known))[of]
        self.given, self.equal = now[keep], (again | equal)[keep]
        return out_equal, differs, rows


def _meet(rows: DataFrame, payload: str) -> DataFrame:
    """``rows`` (key, context, proof, ..., sure) with ``kind`` instead of ``sure``: 0 for each row whose
    context occurs again, and 1 for one row of each context whose key has others. Rows that are
    sure go anywhere, so a very frequent string does not fill one task."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = _Meeting()
        for batch in batches:
            table = pa.Table.from_batches([batch]).drop_columns(["sure", "to"])
            sure = batch.column(len(names)).to_numpy(zero_copy_only=False)
            first = int((~sure).sum())  # those that are sure come last
            parts = [(table.slice(first), np.zeros(len(sure) - first, int))]
            if first:
                equal, differs, met = meeting.add(table.slice(0, first))
                chosen = np.concatenate([np.flatnonzero(equal), np.flatnonzero(differs)])
                parts.append((met.take(pa.array(chosen)), np.repeat([0, 1], [equal.sum(), differs.sum()])))
            for found, kind in parts:
                yield from found.append_column("kind", pa.array(kind, pa.int8())).combine_chunks().to_batches()

    to = F.when(F.col("sure"), F.xxhash64(*names[3:])).otherwise(F.col("key"))
    dealt = rows.withColumn("to", to).repartition("to").sortWithinPartitions("sure", *names[:3])
    return dealt.mapInArrow(run, f"{payload}, kind tinyint")


CONTEXTS = "key bigint, context bigint, proof bigint, doc_id bigint, tag bigint, low bigint, off int, span int, bytes binary"


def _contexts(docs: DataFrame, different: DataFrame) -> DataFrame:
    """The bytes of different contexts, from their documents."""
    place = F.struct("key", "context", "proof", "place")
    listed = different.groupBy("doc_id", "tag").agg(F.collect_list(place).alias("places"))
    mine = listed.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "places")
    unique = docs.join(mine, docs["doc_id"].eqNullSafe(mine["_doc"]) & (docs["tag"] == mine["_tag"])).select("doc_id", "tag", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in text_pieces(batch.column(2)):
                data, offsets = bytes_of(piece)
                lists = batch.column(3).slice(at, len(piece))
                of = np.repeat(np.arange(len(piece)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                low, off, span = _unpack(flat.field(3).to_numpy())
                raw, begin = data.tobytes(), (offsets[of] + low).tolist()
                cut = [raw[a : a + LENGTH + s] for a, s in zip(begin, span.tolist())]
                take = pa.array(at + of)
                columns = [flat.field(0), flat.field(1), flat.field(2), batch.column(0).take(take), batch.column(1).take(take), pa.array(low), pa.array(off, pa.int32()), pa.array(span, pa.int32()), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "context", "proof", "doc_id", "tag", "low", "off", "span", "bytes"])

    return unique.mapInArrow(run, CONTEXTS)


def _told_apart(contexts: DataFrame, hot: DataFrame, step: int) -> DataFrame:
    """Contexts of hot keys cut in two by the anchor's place in the string, as equal strings have
    equal places. The key of each half is the hash of what all its strings span, which is
    longer than before: after seven steps a half is one string."""
    width, names = 128 >> step, contexts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, tag, low, off, span, data in zip(*(batch.column(i).to_pylist() for i in range(3, 9))):
                for cell in range((off - span) // width, off // width + 1):
                    most, least = min(off, cell * width + width - 1), max(off - span, cell * width)  # places
                    part = data[off - most : off - least + LENGTH]
                    anchor = most
                    core = part[most - cell * width : most - (cell * width + width - 1) + LENGTH]
                    key = hashlib.blake2b(core + bytes([step, cell]), digest_size=8).digest()
                    context = hashlib.blake2b(part + bytes([anchor]), digest_size=16).digest()
                    numbers = (int.from_bytes(x, "little", signed=True) for x in (key, context[:8], context[8:]))
                    rows.append((*numbers, doc_id, tag, low + off - most, anchor, most - least, part))
            if rows:
                kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                sure = _third_or_later(*(c.to_numpy() for c in columns[:3]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sure)], names=[*names, "sure"])

    return contexts.join(hot, "key", "left_semi").select(contexts.columns).mapInArrow(run, f"{CONTEXTS}, sure boolean")


class Suffixes:
    """Suffixes from anchors on, or reversed prefixes back from them, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, anchor: np.ndarray, length: np.ndarray, back: bool):
        self.data, self.anchor, self.length, self.back = data, anchor, length, back
        self.prefix = Prefix(data)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what suffixes i and j have in common: binary search over hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        a, b = self.anchor[i], self.anchor[j]
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            if self.back:
                same = self.prefix.of(a - middle, a) == self.prefix.of(b - middle, b)
            else:
                same = self.prefix.of(a, a + middle) == self.prefix.of(b, b + middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def byte(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        where = self.anchor[i] - 1 - at if self.back else self.anchor[i] + at
        inside = at < self.length[i]
        return np.where(inside, self.data[np.where(inside, where, 0)].astype(np.int64), -1)

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix i is less than suffix j (or equal to it)."""
        common = self.extension(i, j)
        x, y = self.byte(i, common), self.byte(j, common)
        return (x < y) | ((x == y) & or_equal)

    def sorted(self, group: np.ndarray) -> np.ndarray:
        """A mergesort inside each group (rows of a group follow one another): all pairs of runs of
        one length are merged at once, each row finding its place in the other run by binary
        search."""
        n = len(group)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, n))
        of = np.repeat(np.arange(len(first)), size)
        begin, end = first[of], (first + size)[of]
        order, slot, width = np.arange(n), np.arange(n), 1
        while width < size.max(initial=0):
            run = (slot - begin) // width
            left = run % 2 == 0
            start = begin + (run ^ 1) * width
            stop = np.minimum(start + width, end)
            move = np.flatnonzero(start < stop)
            low, high = start[move].copy(), stop[move].copy()
            mine, is_right = order[move], ~left[move]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                other = order[middle]
                # Rows of the right run go behind equal ones of the left run.
                goes_on = self.before(other, mine[open_], is_right[open_])
                low[open_] = np.where(goes_on, middle + 1, low[open_])
                high[open_] = np.where(goes_on, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            pair = begin[move] + (run[move] - run[move] % 2) * width
            own = slot[move] - (begin[move] + run[move] * width)
            target = slot.copy()
            target[move] = pair + own + (low - start[move])
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common extension of each row in order with the one before it, -1 at a group's first. The
        bytes are looked at: hashes alone decide nothing."""
        i, j = order[:-1], order[1:]
        found = self.extension(i, j)
        at = np.arange(int(found.max(initial=0)) + 1)
        for part in range(0, len(i), 20_000):
            a, b, length = i[part : part + 20_000], j[part : part + 20_000], found[part : part + 20_000]
            x, y = (self.byte(np.repeat(k, len(at)), np.tile(at, len(k))).reshape(len(k), len(at)) for k in (a, b))
            wrong = (x != y) & (at < length[:, None])
            if wrong.any():
                raise ValueError("different bytes have equal hashes")
        out = np.full(len(order), -1, np.int64)
        out[1:] = np.where(group[i] == group[j], found, -1)
        return out


def repeated_strings(group: np.ndarray, blobs: list[bytes], off: np.ndarray) -> np.ndarray:
    """Which strings of which contexts another context of the group has too: rows are contexts,
    columns places of the anchor in the string."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    length = np.fromiter(map(len, blobs), np.int64, len(blobs))
    begin = np.cumsum(length) - length
    anchor = begin + off
    ahead = Suffixes(data, anchor, np.minimum(length - off, LENGTH), back=False)
    behind = Suffixes(data, anchor, off, back=True)
    order = [s.sorted(group) for s in (ahead, behind)]
    common = [s.neighbours(o, group) for s, o in zip((ahead, behind), order)]
    n = len(group)
    out = np.zeros((n, int(off.max(initial=0)) + 1), bool)
    classes = np.empty((2, n), np.int64)
    for place in range(out.shape[1]):
        # Contexts with the same bytes behind the anchor as far as the string goes, and before it.
        for k, least in ((0, LENGTH - place), (1, place)):
            classes[k, order[k]] = np.cumsum(common[k] < least)
        both = classes[0] * (n + 1) + classes[1]
        both[off < place] = -1 - np.flatnonzero(off < place)  # it has no such string
        _, where, counts = np.unique(both, return_inverse=True, return_counts=True)
        out[:, place] = counts[where] > 1
    return out


def _sorted_strings(contexts: DataFrame) -> DataFrame:
    """``doc_id``, ``tag``, ``start``, ``stop`` of what contexts share with others of their key."""

    def found(keys: np.ndarray, table: pa.Table) -> pa.RecordBatch:
        off = table.column("off").to_numpy().astype(np.int64)
        shared = repeated_strings(keys, table.column("bytes").to_pylist(), off)
        edge = np.zeros((len(off), 1), bool)
        change = np.diff(np.concatenate([edge, shared, edge], 1).astype(np.int8), axis=1)
        row, least = np.nonzero(change == 1)  # runs of places, row by row in the same order
        most = np.nonzero(change == -1)[1] - 1
        anchor = table.column("low").to_numpy()[row] + off[row]
        take = pa.array(row)
        columns = [table.column(c).take(take).combine_chunks() for c in ("doc_id", "tag")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(anchor - most), pa.array(anchor - least + LENGTH)], names=["doc_id", "tag", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held.column("key").to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1  # the last key may go on
            done = 0
            while len(cuts) and cuts[-1] - done >= SORT_ROWS:
                stop = int(cuts[np.searchsorted(cuts, done + SORT_ROWS)])
                yield found(keys[done:stop], held.slice(done, stop - done))
                done = stop
            held = held.slice(done)
        if held is not None and held.num_rows:
            yield found(held.column("key").to_numpy(), held)

    chosen = contexts.select("key", "doc_id", "tag", "low", "off", "bytes")
    dealt = chosen.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc_id bigint, tag bigint, start bigint, stop bigint")


def _spans_of(places: DataFrame) -> DataFrame:
    """``doc_id``, ``tag``, ``start``, ``stop`` of contexts that are covered whole."""
    low = F.shiftright("place", 14)
    stop = low + F.col("place").bitwiseAND(127) + LENGTH
    return places.select("doc_id", "tag", low.alias("start"), stop.alias("stop"))


def repeated_spans(docs: DataFrame, most: int = MOST_CONTEXTS) -> DataFrame:
    """``doc_id``, ``tag``, ``start``, ``stop``: parts of documents (of ``_identified``) that are
    covered by strings that start elsewhere too; parts overlap."""
    met = written(_meet(_anchor_rows(docs), PLACES), "repeats-met")
    spans = _spans_of(met.where("kind = 0"))
    contexts = written(_contexts(docs, met.where("kind = 1")), "repeats-contexts")
    step = 0
    while True:
        hot = contexts.groupBy("key").count().where(F.col("count") > most).select("key")
        if step == 7 or hot.isEmpty():
            break
        step += 1
        hot = written(hot, f"repeats-hot-{step}")
        halves = written(_meet(_told_apart(contexts, hot, step), CONTEXTS), f"repeats-halves-{step}")
        spans = spans.unionByName(halves.where("kind = 0").select("doc_id", "tag", F.col("low").alias("start"), (F.col("low") + F.col("span") + LENGTH).alias("stop")))
        cold = contexts.join(hot, "key", "left_anti").select(contexts.columns)
        contexts = written(cold.unionByName(halves.where("kind = 1").drop("kind")), f"repeats-contexts-{step}")
    return spans.unionByName(_sorted_strings(contexts))


def dedup(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and any others; null text: empty) with ``spans`` (start and stop
    in bytes of maximal removed runs) and ``kept`` (the other bytes).

    Removed is each byte covered by a string of LENGTH bytes that also starts anywhere else, in
    the same document or another one. Matches never cross documents. Repeated rows are
    documents of their own, so their texts repeat; texts shorter than LENGTH stay whole. With
    ``whole_characters`` a run gives back characters of which it would take only a part. The
    new columns get underscores in front where ``docs`` has columns of these names.
    """
    names = [free_name(docs, n) for n in ("spans", "kept")]
    marked = repeated_spans(_identified(docs)).groupBy("doc_id", "tag").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")  # rows that are equal all add the same ones
    )
    doc, tag, listed = (free_name(docs, n) for n in ("_doc", "_tag", "_spans"))
    mine = marked.select(F.col("doc_id").alias(doc), F.col("tag").alias(tag), F.col("spans").alias(listed))
    same = docs["doc_id"].eqNullSafe(mine[doc]) & (_tag(docs["text"]) == mine[tag])
    joined = docs.join(mine, same, "left").select(*[docs[c] for c in docs.columns], listed)
    at_text, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for at, piece in text_pieces(batch.column(at_text)):
                data, offsets = bytes_of(piece)
                raw = data.tobytes()
                rest = batch.slice(at, len(piece))
                lists = rest.column(rest.num_columns - 1)
                runs, kept = [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    merged = []
                    if lists[i].is_valid:
                        flat = lists[i].values
                        merged = merge_spans(flat.field(0).to_numpy(), flat.field(1).to_numpy())
                        if whole_characters:
                            merged = _between_characters(data[a:b], merged)
                    runs.append([{"start": s, "stop": t} for s, t in merged])
                    edges = [0, *(x for pair in merged for x in pair), b - a]
                    kept.append(b"".join(raw[a + s : a + t] for s, t in zip(edges[::2], edges[1::2])))
                columns = [*rest.columns[:-1], pa.array(runs, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*docs_columns, *names])

    docs_columns = docs.columns
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    added = [T.StructField(names[0], spans_type), T.StructField(names[1], T.BinaryType())]
    return joined.mapInArrow(run, T.StructType([*schema.fields, *added]))


def _between_characters(data: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that begin and end between characters of UTF-8 text."""
    inside = (data & 0xC0) == 0x80
    out = []
    for start, stop in spans:
        while start < stop and inside[start]:
            start += 1
        while start < stop and stop < len(data) and inside[stop]:
            stop -= 1
        if start < stop:
            out.append((start, stop))
    return out


def merge_spans(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1])))
    last = np.append(first[1:], len(start)) - 1
    return list(zip(start[first].tolist(), stop[last].tolist()))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, digest of the rest."""
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
strings AS MATERIALIZED (
  SELECT r, i, md5(substr(h, (2 * i + 1)::BIGINT, {2 * LENGTH})) AS m
  FROM (SELECT r, h, unnest(range(0, greatest(n - {LENGTH - 1}, 0))) AS i FROM docs)),
again AS (SELECT r, i FROM strings WHERE m IN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1)),
marked AS (SELECT r, i, (i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH}) IS NOT TRUE AS begins FROM again),
numbered AS (SELECT r, i, sum(begins::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM marked),
runs AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM numbered GROUP BY r, k),
edges AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT docs.r, coalesce(max(b), 0), any_value(n) FROM docs LEFT JOIN runs USING (r) GROUP BY docs.r),
kept AS (SELECT edges.r, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS h
  FROM edges JOIN docs ON edges.r = docs.r GROUP BY edges.r)
SELECT doc_id, n AS n_bytes, (n - length(kept.h) // 2)::BIGINT AS n_removed,
  (SELECT count(*) FROM runs WHERE runs.r = docs.r) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM docs JOIN kept ON docs.r = kept.r
"""
