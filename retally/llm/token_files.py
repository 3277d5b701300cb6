"""Token ids in binary files of the Arrow file format.

A file holds the ids of consecutive documents as one stream, cut into sequences of equal
length; a record batch is a run of sequences. Columns: ``ids``, a fixed-size list of unsigned
integers; ``mask``, a fixed-size list of booleans, false behind the last id of the file;
``ends``, alike, true at the last id of a document; ``doc_ids``, the documents that end in the
sequence, in order. Fixed-size lists are plain buffers: a reader maps the file and takes any
sequence without copying.

A task writes one file for each run of documents under a name of its own, and returns a row
about it; only rows of tasks that ended well reach the manifest, so a lost or repeated task
leaves a file that nothing names, not a wrong result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from retally.llm.common import file_system, ordered_runs, text_pieces, written
from retally.session import shared_folder

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE = 2048
BATCH_SEQUENCES = 64
#: Words whose ids a worker keeps; when full, the cache starts anew.
CACHE_WORDS = 400_000
LONGEST_CACHED = 100
# Python splits at four control characters, which the tokenizer takes for words.
_CONTROLS = re.compile("[\x1c-\x1f]")
_OTHER_WORDS = re.compile("(?:[^\\s]|[\x1c-\x1f])+")

MANIFEST = "run bigint, path string, n_sequences bigint, n_tokens bigint, n_documents bigint"


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs at a time
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves,
    the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
# Letters whose lower case depends on what is around them, or is more than one letter.
_ODD_CASE = re.compile("[\u03a3\u0130]")


#: The same for one byte of each of many words that line feeds separate.
_LETTERS_OF_LINES = {b: c for b, c in _LETTERS.items() if b != 0x0A}


def _spelled(words: list[str]) -> list[str]:
    """Words of letters as their model takes them, without the steps before the model. None of them
    is one of ``_unlike``."""
    lines = "\n".join(words).lower()
    return lines.encode().decode("latin-1").translate(_LETTERS_OF_LINES).split("\n") if words else []


def _unlike(word: str) -> bool:
    """Whether a word of letters may change in other ways than letter by letter."""
    return bool(_ODD_CASE.search(word)) or not word.lower().isalpha() or not unicodedata.is_normalized("NFC", word)


class WordEncoder:
    """Ids of texts from a tokenizer that lowers case, splits at white space and never looks
    across it: words are encoded by the library and kept in a cache, as bytes of their ids.

    Words of letters only are one piece each and go to the library's model at once, many at a
    time; its last token of a word says so. A comma or full stop behind a letter is a token of
    its own. All other new words go through the whole tokenizer, and so do, uncut, texts with the
    string of an added token, which the library looks for before anything else.
    """

    def __init__(self, definition: str):
        self.tokenizer = _tokenizer(definition)
        bare = json.loads(definition) | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.model = _tokenizer(json.dumps(bare))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = bare["model"].get("end_of_word_suffix")
        self.kind = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix and not bare["model"].get("continuing_subword_prefix"):
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        added = [token["content"].lower() for token in json.loads(definition).get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.mark = os.path.commonprefix(added)[:1]  # a first look for one character
        self.cache: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        cache, size = self.cache, self.kind.itemsize
        stems = {w: w[:-1] for w in words if w[-1] in ".," and w[-2:-1].isalpha() and w[-2] != "\u0130"}
        whole = words.difference(stems)
        whole.update(s for s in stems.values() if s not in cache)
        whole.update(".,")
        names = [w for w in whole if w.isalpha()] if self.ends.any() else []
        if not (joined := "".join(names)).isascii() and (_ODD_CASE.search(joined) or not unicodedata.is_normalized("NFC", "\n".join(names))):
            names = [w for w in names if w.isascii() or not _unlike(w)]
        letters = _spelled(names)
        for at in range(0, len(names), 2000):
            part = names[at : at + 2000]
            (found,) = self.model.encode_batch_fast([letters[at : at + 2000]], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, self.kind)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            if len(stops) != len(part):
                raise ValueError("the tokenizer does not mark the ends of words")
            cache.update(zip(part, map(ids.tobytes().__getitem__, map(slice, [0, *stops], stops))))
        others = list(whole.difference(names))
        for word, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            cache[word] = np.array(found.ids, self.kind).tobytes()
        for word, stem in stems.items():
            cache[word] = cache[stem] + cache[word[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of little-endian integers of ``kind``."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        # A lower-case match is enough of a reason: words are kept in lower case.
        odd = [i for i, text in enumerate(texts) if self.mark in text and self.added.search(text.lower())] if self.added else []
        if odd:
            whole = self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)
            alone = {i: np.array(found.ids, self.kind).tobytes() for i, found in zip(odd, whole)}
            rest = self.encode([text for i, text in enumerate(texts) if i not in alone])
            others = iter(rest)
            return [alone[i] if i in alone else next(others) for i in range(len(texts))]
        lines = [_words(text) for text in texts]
        words = list(chain.from_iterable(lines))
        found = list(map(self.cache.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = {words[i] for i in missing}
            self._learn(new)
            for i in missing:
                found[i] = self.cache[words[i]]
            for word in new:
                if len(word) > LONGEST_CACHED:
                    del self.cache[word]
        stops = np.cumsum([len(line) for line in lines]).tolist()
        return [b"".join(found[a:b]) for a, b in zip([0, *stops], stops)]


def _words(text: str) -> list[str]:
    if text.isascii():  # the tokenizer lowers case; so fewer words are new
        text = text.lower()
    return _OTHER_WORDS.findall(text) if _CONTROLS.search(text) else text.split()


@lru_cache(maxsize=1)
def _encoder(definition: str) -> WordEncoder:
    """One encoder in each worker, whatever the number of its tasks."""
    return WordEncoder(definition)


class _Writer:
    """Writes the stream of one file; keeps less than a record batch in memory."""

    def __init__(self, folder: str, run: int, kind: pa.DataType, sequence: int):
        self.fs, where = file_system(folder)
        self.fs.create_dir(where, recursive=True)
        self.run, self.kind, self.sequence = run, kind, sequence
        self.name = f"run-{run:08d}-{uuid.uuid4().hex}.arrow"
        self.path = f"{folder}/{self.name}"
        self.schema = pa.schema([
            ("ids", pa.list_(kind, sequence)),
            ("mask", pa.list_(pa.bool_(), sequence)),
            ("ends", pa.list_(pa.bool_(), sequence)),
            ("doc_ids", pa.list_(pa.int64())),
        ])
        self.sink = self.fs.open_output_stream(f"{where}/{self.name}")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.ends: list[np.ndarray] = []  # places of last ids among the held ones
        self.docs: list = []
        self.n_sequences = self.n_tokens = self.n_documents = 0

    def add(self, ids: np.ndarray, ends: np.ndarray, docs: list) -> None:
        """Ids of some documents, the places of their last ids, and the documents."""
        self.ids.append(ids)
        self.ends.append(ends + self.held)
        self.docs += docs
        self.held += len(ids)
        self.n_tokens += len(ids)
        self.n_documents += len(docs)
        whole = self.held // self.sequence // BATCH_SEQUENCES * BATCH_SEQUENCES
        if whole:
            self._flush(whole)

    def _flush(self, sequences: int) -> None:
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        for at in range(0, sequences, BATCH_SEQUENCES):
            n = min(BATCH_SEQUENCES, sequences - at)
            first, last = at * self.sequence, (at + n) * self.sequence
            block = np.zeros(n * self.sequence, ids.dtype)
            block[: len(ids[first:last])] = ids[first:last]
            mask = np.arange(first, last) < len(ids)
            here = ends[(ends >= first) & (ends < last)] - first
            flags = np.zeros(n * self.sequence, bool)
            flags[here] = True
            per = np.bincount(here // self.sequence, minlength=n)
            docs, self.docs = self.docs[: len(here)], self.docs[len(here) :]
            self.file.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(block, self.kind), self.sequence),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence),
                pa.FixedSizeListArray.from_arrays(pa.array(flags), self.sequence),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(docs, pa.int64())),
            ], schema=self.schema))
        cut = sequences * self.sequence
        self.ids, self.ends = [ids[cut:]], [ends[ends >= cut] - cut]
        self.held = max(0, self.held - cut)
        self.n_sequences += sequences

    def close(self) -> tuple:
        if self.held:
            self._flush(-(-self.held // self.sequence))
        self.file.close()
        self.sink.close()
        return self.run, self.path, self.n_sequences, self.n_tokens, self.n_documents


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, runs: int | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the ids of ``docs`` (``doc_id``, ``text``) in ascending order of ``doc_id`` and
    returns the manifest: one row per file, in order of ``run``.

    ``tokenizer`` names a definition file that the driver can read. Null texts count as empty
    and hold the end id alone; null ids come first; equal ids are ordered by text. ``runs``:
    number of files, from the shuffle partitions where not given.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:  # of a fixed size
        definition = spark.sparkContext.broadcast(file.read())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, made = _encoder(definition.value), None, []
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for start, texts in text_pieces(batch.column(1)):
                found = encoder.encode(texts.to_pylist())
                numbers = batch.column(2).slice(start, len(texts)).to_numpy(zero_copy_only=False)
                names = batch.column(0).slice(start, len(texts)).to_pylist()
                stream = np.frombuffer(b"".join([x + end for x in found]), encoder.kind)
                stops = np.cumsum([len(x) // encoder.kind.itemsize + 1 for x in found])
                for a, b in _same(numbers):
                    if out is None or out.run != numbers[a]:
                        if out:
                            made.append(out.close())
                        out = _Writer(folder, int(numbers[a]), pa.from_numpy_dtype(encoder.kind), sequence)
                    first = 0 if a == 0 else stops[a - 1]
                    out.add(stream[first : stops[b - 1]], stops[a:b] - 1 - first, names[a:b])
        if out:
            made.append(out.close())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["run", "path", "n_sequences", "n_tokens", "n_documents"])

    numbered = ordered_runs(docs.select("doc_id", "text"), "doc_id", runs or 4 * parts)
    dealt = numbered.repartition(parts, "run").sortWithinPartitions("run", "doc_id", "text")
    return written(dealt.mapInArrow(run, MANIFEST), "token-manifest")


def _same(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal numbers, as (start, stop)."""
    cuts = np.flatnonzero(np.diff(numbers)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]))


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids in all files before. One row per file: small at any size."""
    before = W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def sequences(path: str, at: int | None = None) -> Iterator[pa.RecordBatch] | pa.RecordBatch:
    """The batches of one file, mapped where its file system can; with ``at``, only the batch of
    that number."""
    fs, where = file_system(path)
    source = pa.memory_map(where) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(where)
    file = pa.ipc.open_file(source)
    if at is not None:
        return file.get_batch(at)
    return (file.get_batch(i) for i in range(file.num_record_batches))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, read back from the files: ``doc_id``, ``start`` (ids of all documents
    before it), ``ids`` as little-endian unsigned 32-bit integers in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rest = np.zeros(0, "<u4")
                for part in sequences(path):
                    ids = part.column(0).flatten().to_numpy()
                    mask = part.column(1).flatten().to_numpy(zero_copy_only=False)
                    stops = np.flatnonzero(part.column(2).flatten().to_numpy(zero_copy_only=False)) + 1
                    stream = np.concatenate((rest, ids[mask].astype("<u4")))
                    stops = stops + len(rest)
                    firsts = np.concatenate(([0], stops[:-1])).astype(np.int64) if len(stops) else stops
                    names = part.column(3).flatten()
                    data = [stream[a:b].tobytes() for a, b in zip(firsts.tolist(), stops.tolist())]
                    yield pa.RecordBatch.from_arrays([names, pa.array(start + firsts, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "ids"])
                    cut = int(stops[-1]) if len(stops) else 0
                    rest = stream[cut:]
                    start += cut

    # A row here is a file to read: more partitions than the size of the rows asks for.
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = with_starts(manifest).select("path", "start").repartition(parts, "path")
    return chosen.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes ``docs`` below the shared folder and gives, per document read back, the start,
    the number of ids and their checksum."""
    spark: SparkSession = docs.sparkSession
    manifest = write(docs, tokenizer, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    found = read_documents(manifest)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
