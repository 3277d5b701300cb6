"""Byte-level BPE: encoding by ranks and decoding.

Texts are split without a regular expression. Each code point gets a class; blanks and
apostrophes get one that also says what follows them. A class is a function of the splitter's
state, such functions compose associatively, and a scan of their compositions gives the state
before every code point, thus all token starts of a batch, whatever the number of texts in it.
Slices are merged by rank through a cache; byte offsets of all tokens are kept.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retally.llm.common import free_name, text_pieces

#: Slices whose merges a worker keeps; when full, the cache starts anew.
CACHE_SLICES = 300_000
#: Slices that are merged side by side, and the longest ones that are; longer ones are not kept.
ROUND_SLICES, LONGEST = 8192, 256
#: Code points in a row of the scan.
SCAN_ROW = 256
_NONE = 1 << 40  # rank of a pair that never merges

# The white space of the split pattern, as code points.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions of the split pattern.
_SHORT = "stmd"
_LONG = ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, BLANK_JOINS, BLANK_ALONE, BETWEEN = range(9)
# States: what the token so far is. FRESH: the next code point starts a token.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, JOINS, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """State after a code point of a class, and whether a token starts at it."""
    if kind == LETTER:
        if state in (IN_LETTERS, JOINS):
            return IN_LETTERS, False
        if state == ONE_MORE:
            return FRESH, False
        if state == TWO_MORE:
            return ONE_MORE, False
        return IN_LETTERS, True
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINS)
    if kind in (OTHER, SHORT, LONG):
        if state in (IN_OTHERS, JOINS):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, SHORT: ONE_MORE, LONG: TWO_MORE}[kind], True
    if kind == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (JOINS if kind == BLANK_JOINS else FRESH), True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions of states that texts can compose: the function of each class, the table of
    compositions, each function's results, and whether a token starts (state, class)."""
    basic = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    number = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *basic]))}
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in basic:
            made = tuple(g[s] for s in f)
            if made not in number:
                number[made] = len(number)
                todo.append(made)
    functions = list(number)
    compose = np.zeros((len(functions),) * 2, np.uint16)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            compose[i, j] = number[tuple(g[s] for s in f)]
    starts = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    return np.array([number[f] for f in basic], np.uint16), compose, np.array(functions, np.uint8), starts


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_SPACES] = BLANK
    return out


def _scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """The composition of all functions up to and with each."""
    n, size = len(functions), len(compose)
    flat = compose.ravel()
    width = min(SCAN_ROW, max(n, 1))
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)  # function 0 changes nothing
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for k in range(1, width):
        grid[k] = flat[grid[k - 1].astype(np.intp) * size + grid[k]]
    if rows > 1:
        before = np.concatenate(([0], _scan(grid[-1], compose)[:-1])).astype(np.intp)
        grid = flat[before * size + grid]
    return grid.T.ravel()[:n]


def token_starts(points: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Where tokens start among the code points of texts; ``between``: places of separators."""
    kinds = _classes()[points]
    kinds[between] = BETWEEN
    follows = np.append(kinds[1:], BETWEEN)
    ends_blanks = (kinds == BLANK) & (follows != BLANK) & (follows != BETWEEN)
    marks = np.flatnonzero(points == ord("'"))
    marks = marks[kinds[marks] == OTHER]
    padded = np.append(np.where(kinds == LETTER, points, 0), np.zeros(2, points.dtype))
    one, two = padded[marks + 1], padded[marks + 2]
    short = np.isin(one, [ord(c) for c in _SHORT])
    long = np.zeros(len(marks), bool)
    for a, b in _LONG:
        long |= (one == ord(a)) & (two == ord(b))
    kinds[marks[short]] = SHORT
    kinds[marks[long]] = LONG
    kinds[ends_blanks] = np.where(points[ends_blanks] == 0x20, BLANK_JOINS, BLANK_ALONE)
    of_class, compose, results, starts = _monoid()
    after = results[_scan(of_class[kinds], compose), FRESH]
    before = np.concatenate(([FRESH], after[:-1])).astype(np.uint8)
    return np.flatnonzero(starts[before, kinds] & (kinds != BETWEEN))


class Vocabulary:
    """Ranks of byte strings; encodes slices with a cache of their ids, kept as bytes of 32-bit numbers."""

    def __init__(self, file: bytes):
        pairs = [line.split() for line in file.splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.lengths = np.zeros(max(self.pieces) + 1, np.int64)
        for rank, piece in self.pieces.items():
            self.lengths[rank] = len(piece)
        self.cache: dict[bytes, bytes] = {}
        # Every two pieces that are a piece together, and its rank.
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)])
        ranks, width = self.ranks, len(self.lengths)
        found = {
            ranks[piece[:i]] * width + ranks[piece[i:]]: rank
            for piece, rank in ranks.items()
            for i in range(1, len(piece))
            if piece[:i] in ranks and piece[i:] in ranks
        }
        self.pairs = np.array(sorted(found), np.int64)
        self.joined = np.array([found[p] for p in self.pairs.tolist()], np.int64)

    def _rank_of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names = a * len(self.lengths) + b
        at = np.minimum(np.searchsorted(self.pairs, names), len(self.pairs) - 1)
        return np.where(self.pairs[at] == names, self.joined[at], _NONE)

    def merge_all(self, slices: list[bytes]) -> list[bytes]:
        """Ids of several slices, merged side by side: in each round the leftmost pair of lowest rank
        of every slice, until a slice has none."""
        out: list[bytes] = [b""] * len(slices)
        lengths = np.fromiter(map(len, slices), np.int64, len(slices))
        names = np.arange(len(slices))  # of the slices that go on
        parts = self.of_byte[np.frombuffer(b"".join(slices), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        rank = np.full(len(parts), _NONE)  # of each part with the next one
        rank[:-1] = self._rank_of_pairs(parts[:-1], parts[1:])
        rank[starts + lengths - 1] = _NONE
        while len(names):
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            if done.any():
                ids = parts.astype(np.int32)
                for k in np.flatnonzero(done).tolist():
                    out[names[k]] = ids[starts[k] : starts[k] + lengths[k]].tobytes()
                keep = np.repeat(~done, lengths)
                parts, rank, names, lengths, best = parts[keep], rank[keep], names[~done], lengths[~done], best[~done]
                if not len(names):
                    break
                starts = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            at = hits[np.searchsorted(hits, starts)]  # the first one of each slice
            parts[at] = best
            rank[at] = rank[at + 1]
            keep = np.ones(len(parts), bool)
            keep[at + 1] = False
            parts, rank, lengths = parts[keep], rank[keep], lengths - 1
            at -= np.arange(len(at))
            starts = np.cumsum(lengths) - lengths
            right = at[at < starts + lengths - 1]
            rank[right] = self._rank_of_pairs(parts[right], parts[right + 1])
            left = at[at > starts]
            rank[left - 1] = self._rank_of_pairs(parts[left - 1], parts[left])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one slice with a heap and linked parts: n log n for slices of any length."""
        import heapq

        n, ranks = len(piece), self.ranks
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:  # one of the two has been merged meanwhile
                continue
            end[i], end[j] = stop, 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return np.array(out, np.int32).tobytes()

    def encode(self, slices: list[bytes]) -> list[bytes]:
        if len(self.cache) > CACHE_SLICES:
            self.cache.clear()
        cache = self.cache
        out = list(map(cache.get, slices))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if missing:
            new = list({slices[i] for i in missing})
            long = [piece for piece in new if len(piece) > LONGEST]
            short = [piece for piece in new if len(piece) <= LONGEST]
            for at in range(0, len(short), ROUND_SLICES):
                part = short[at : at + ROUND_SLICES]
                cache.update(zip(part, self.merge_all(part)))
            cache.update((piece, self.merge_long(piece)) for piece in long)
            for i in missing:
                out[i] = cache[slices[i]]
            for piece in long:
                del cache[piece]
        return out


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row, where each text's ids start, and each token's end in bytes."""
    joined = "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(lengths + 1) - 1
    starts = token_starts(points, stops[:-1])
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate(([0], np.cumsum(sizes)))
    # A token ends where the next starts, or at the end of its text.
    text = np.searchsorted(stops, starts, side="right")
    following = np.append(starts[1:], len(points))
    ends = np.minimum(following, stops[text]) if len(starts) else starts
    data = joined.encode()
    found = vocabulary.encode([data[a:b] for a, b in zip(at[starts].tolist(), at[ends].tolist())])
    counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
    ids = np.frombuffer(b"".join(found), np.int32)
    tokens_before = np.concatenate(([0], np.cumsum(counts)))
    where = tokens_before[np.append(np.searchsorted(text, np.arange(len(texts))), len(starts))]
    total = np.concatenate(([0], np.cumsum(vocabulary.lengths[ids])))
    of = np.repeat(np.arange(len(texts)), np.diff(where))
    return ids, where, total[1:] - total[where[:-1]][of]


def decode_ids(ids: np.ndarray, where: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """Bytes of each text from its ids."""
    pieces = list(map(vocabulary.pieces.__getitem__, ids.tolist()))
    return [b"".join(pieces[a:b]) for a, b in zip(where[:-1].tolist(), where[1:].tolist())]


_kept: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The vocabulary of a broadcast file, built once in each worker."""
    if shared.value and (key := hash(shared.value)) not in _kept:
        _kept[key] = Vocabulary(shared.value)
    return _kept[hash(shared.value)]


def _share(df: DataFrame, ranks: str):
    with open(ranks, "rb") as file:  # a vocabulary has a fixed size of about a megabyte
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, ranks: str, text: str = "text", ids: str = "ids", ends: str = "ends", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of its texts and each token's end in bytes.

    ``ranks`` names a file of base64 byte strings and ranks that the driver can read.
    ``decoded`` adds the bytes that the ids decode to. Null texts count as empty and have no
    ids. New columns get underscores in front where ``df`` has columns of these names; the
    other columns stay as they are, rows too, repeated ones included.
    """
    file = _share(df, ranks)
    names = [free_name(df, n) for n in (ids, ends)] + ([free_name(df, decoded)] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file)
        for batch in batches:
            for start, piece in text_pieces(batch.column(batch.schema.get_field_index(text))):
                rows = batch.slice(start, len(piece))
                found, where, stops = encode_texts(piece.to_pylist(), vocabulary)
                at = pa.array(where, pa.int32())
                new = [pa.ListArray.from_arrays(at, pa.array(found)), pa.ListArray.from_arrays(at, pa.array(stops, pa.int64()))]
                if decoded:
                    new.append(pa.array(decode_ids(found, where, vocabulary), pa.binary()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*rows.schema.names, *names])

    new = f", `{names[0]}` array<int>, `{names[1]}` array<bigint>" + (f", `{names[2]}` binary" if decoded else "")
    return df.mapInArrow(run, _ddl(df) + new)


def decode(df: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its arrays of ids decode to; null arrays decode to nothing."""
    file = _share(df, ranks)
    name = free_name(df, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = [b"".join(vocabulary.pieces[i] for i in x or ()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, name])

    return df.mapInArrow(run, f"{_ddl(df)}, `{name}` binary")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of what they decode to."""
    found = encode(docs.select("doc_id", "text"), ranks, decoded="decoded")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
