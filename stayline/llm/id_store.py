"""Operator 12: token-id payloads with a minimal perfect hash index.

Writing.  Rows are range-partitioned by key and sorted, so shard k holds the keys
before those of shard k + 1, and every shard is one file:

    payload   the ids of its documents, unsigned little-endian of 16 bits (32 where
              the vocabulary has more than 65,536 ids), one document after
              another, the end id after each;
    index     one block: header (7 x uint64: magic, documents, null keys, distinct
              keys, pilots, ids, bytes an id), keys of the documents (int64), ends of the
              documents in ids (uint64), pilots (uint32), and per slot the
              fingerprint, the first document and the number of documents
              (uint32 each);
    footer    bytes of the index block and magic (2 x uint64), the end id.

The files go through Spark's text sink: a row is one document's bytes, and the end
id's bytes are the "line separator".  So they come to be with the usual
commit protocol, on any file system Spark knows, and a task never holds more than
one block of documents and the keys of its shard.

Index.  Hash and displace: the distinct keys of a shard fall into buckets of two on
average; the largest buckets first, each takes the first pilot under which all its
keys hit free slots, and single keys take the slots left over, named directly.
There are as many slots as keys.  A slot stores a 32-bit fingerprint, so a key
that was never written is told (but for one in 2^32) without stored keys.
``Reader`` finds a shard among the shards' first keys and then needs one pilot, one
slot and one range of the payload: four small reads whatever the shard's size.

Reading back.  ``documents`` reads the files with Spark's binary source and sends
every key of a shard through its index; the slices of the payload it points to are
digested.

The library encodes the distinct pieces of a block (its own split pattern makes
pieces independent of each other); texts that contain a special string are given
to it whole.

Scale: one exchange of the texts, one write; shards of about ``shard_bytes`` of text,
a single longer text in a shard of its own size.  A hot key is split over shards
by its texts and rows.

Edge cases: null and empty texts are documents with the end id alone; null keys
come first; rows of an equal key follow one another, ordered by a hash of the text;
repeated rows are documents each; an empty table has no documents; extra columns
are ignored.
"""

from __future__ import annotations

import bisect
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayline.llm import blocks, pretoken
from stayline.llm.bpe_codec import distinct_spans
from stayline.llm.vocab import broadcast_file
from stayline.session import checkpoint_dir, cut_lineage

END_ID = 2
SHARD_BYTES = 32 << 20
TEXT_BYTES = 2 << 20
CACHED = 400_000
_MAGIC = 0x3130534449594C53  # "SLYIDS01"
_U = np.uint64
_DIRECT = 1 << 31


# ---------------------------------------------------------------- encoding
class Encoder:
    """Ids of texts by the tokenizers library, each distinct piece once."""

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_buffer(raw)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.feed, = self._library(["\n"])[0]
        self.number: dict[bytes, int] = {}  # pieces, up to CACHED
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces one after another, ids of each).  Pieces of a space and
        letters go to the library many in a text, a line feed between: it is a
        piece of one token, which no such piece has."""
        plain = np.fromiter((w[:1] == b" " and w[1:2].isalpha() for w in words), bool, len(words))
        counts = np.zeros(len(words), np.int64)
        own = [w for w, p in zip(words, plain) if p]
        lines = [b"".join([w + b"\n" for w in own[i:i + 256]]).decode() for i in range(0, len(own), 256)]
        ids = np.fromiter(chain.from_iterable(self._library(lines)), np.uint32)
        cut = ids == self.feed
        counts[plain] = np.diff(np.flatnonzero(cut), prepend=-1) - 1
        other = self._library([w.decode() for w, p in zip(words, plain) if not p])
        counts[~plain] = [len(x) for x in other]
        out = np.zeros(int(counts.sum()), np.uint32)
        at = np.repeat(plain, counts)
        out[at] = ids[~cut]
        out[~at] = np.fromiter(chain.from_iterable(other), np.uint32)
        return out, counts

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where the ids of each word begin, how many they are, ids)."""
        number = list(map(self.number.get, words))
        fresh = [w for w, k in zip(words, number) if k is None]
        ids, at = self.ids, self.at
        if fresh:
            more, counts = self._pieces(fresh)
            ids, at = np.concatenate([ids, more]), np.concatenate([at, at[-1] + np.cumsum(counts)])
            new = iter(range(len(self.at) - 1, len(at) - 1))
            number = [next(new) if k is None else k for k in number]
            if len(self.number) + len(fresh) <= CACHED:  # the earliest words are the most frequent: they stay
                self.number.update(zip(fresh, range(len(self.at) - 1, len(at) - 1)))
                self.ids, self.at = ids, at
        number = np.array(number, np.int64)
        return at[number], at[number + 1] - at[number], ids

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text)."""
        odd = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        plain = texts if not odd else ["" if k in set(odd) else t for k, t in enumerate(texts)]
        data = np.frombuffer("".join(plain).encode(), np.uint8)
        ids, counts = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(data):
            lo, hi, text_of = pretoken.pieces(plain)
            first, inverse = distinct_spans(data, lo, hi, blocks.word_keys(data, lo, hi))
            raw = data.tobytes()
            begin, n, known = self._encoded([raw[a:b] for a, b in zip(lo[first].tolist(), hi[first].tolist())])
            n = n[inverse]
            ids = known[blocks.ragged(begin[inverse], n)]
            counts = np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64)
        if odd:
            parts, at = [], np.concatenate([[0], np.cumsum(counts)])
            whole = dict(zip(odd, self._library([texts[k] for k in odd])))
            for k in range(len(texts)):
                parts.append(np.array(whole[k], np.uint32) if k in whole else ids[at[k]:at[k + 1]])
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, counts


_ENCODERS: dict[int, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The encoder of a tokenizer file, built once a process."""
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


# ---------------------------------------------------------------- index
def _hash(keys: np.ndarray) -> np.ndarray:
    return blocks.mix64(keys.astype(np.int64).view(_U) ^ _U(0x5851F42D4C957F2D))


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (blocks.mix64(h ^ _U(0xD1342543DE82EF95)) >> _U(32)).astype(np.uint32)


def _slot(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (blocks.mix64(h + pilot.astype(_U) * _U(0x9E3779B97F4A7C15)) % _U(n)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Pilots of a minimal perfect hash function of distinct int64 keys."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.uint32)
    h = _hash(keys)
    m = (n + 1) // 2
    bucket = (h % _U(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=m)
    begin = np.cumsum(size) - size
    pilots = np.zeros(m, np.uint32)
    free = np.ones(n, bool)
    by_size = np.argsort(-size, kind="stable")
    for b in by_size[:int((size > 1).sum())].tolist():
        own = h[order[begin[b]:begin[b] + size[b]]]
        start, step = 0, 16
        while True:  # more pilots at a time the longer it takes
            trial = np.arange(start, start + step, dtype=np.int64)
            slots = np.sort(_slot(own[None, :], trial[:, None], n), axis=1)
            ok = free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
            hit = int(ok.argmax())
            if ok[hit]:
                pilots[b] = start + hit
                free[slots[hit]] = False
                break
            start, step = start + step, min(4096, step * 2)
    left = np.flatnonzero(free)
    single = by_size[int((size > 1).sum()):int((size > 0).sum())]
    pilots[single] = (left + _DIRECT).astype(np.uint32)
    return pilots


def slots_of(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key in a function of ``n`` keys."""
    h = _hash(keys)
    p = pilots[(h % _U(len(pilots))).astype(np.int64)].astype(np.int64)
    return np.where(p >= _DIRECT, p - _DIRECT, _slot(h, p, n))


def index_block(keys: np.ndarray, nulls: int, counts: np.ndarray, width: int) -> bytes:
    """The index of documents in shard order: ``nulls`` of them without a key,
    then those of the sorted ``keys``; ``counts``: ids of each, end id included;
    ``width``: bytes an id."""
    distinct, first, times = np.unique(keys, return_index=True, return_counts=True)
    pilots = perfect_hash(distinct)
    slot = slots_of(distinct, pilots, len(distinct)) if len(distinct) else np.zeros(0, np.int64)
    cells = np.zeros((len(distinct), 3), np.uint32)
    cells[slot] = np.stack([_fingerprint(_hash(distinct)), first + nulls, times], axis=1).astype(np.uint32)
    head = np.array([_MAGIC, len(counts), nulls, len(distinct), len(pilots), counts.sum(), width], _U)
    every = np.concatenate([np.zeros(nulls, np.int64), keys])
    body = b"".join(x.tobytes() for x in (head, every, np.cumsum(counts).astype(_U), pilots, cells))
    return body + np.array([len(body), _MAGIC], _U).tobytes()


class Index:
    """A shard's index, read from the end of its file."""

    HEAD = 56

    def __init__(self, tail: bytes):
        """``tail``: the file from the index block on."""
        head = np.frombuffer(tail, _U, 7)
        if int(head[0]) != _MAGIC:
            raise ValueError("no index block")
        self.n, self.nulls, self.distinct, n_pilots, self.n_ids, self.width = map(int, head[1:])
        at = self.HEAD
        self.keys = np.frombuffer(tail, np.int64, self.n, at)
        self.ends = np.frombuffer(tail, _U, self.n, at + 8 * self.n).astype(np.int64)
        self.pilots = np.frombuffer(tail, np.uint32, n_pilots, at + 16 * self.n)
        self.cells = np.frombuffer(tail, np.uint32, 3 * self.distinct, at + 16 * self.n + 4 * n_pilots).reshape(-1, 3)

    @staticmethod
    def place(end: bytes, length: int) -> int:
        """Where the index block of a file of ``length`` bytes begins; ``end``: its
        last 20 bytes.  The end id behind the footer has 2 or 4 bytes."""
        for width in (2, 4):
            size, magic = np.frombuffer(end[4 - width:20 - width], _U).tolist()
            if magic == _MAGIC:
                return length - width - 16 - size
        raise ValueError("no footer")

    def ids(self, data: bytes) -> np.ndarray:
        """Ids from their bytes."""
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; none: number 0."""
        if not self.distinct or not len(keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        cell = self.cells[slots_of(keys, self.pilots, self.distinct)]
        known = cell[:, 0] == _fingerprint(_hash(keys))
        return cell[:, 1].astype(np.int64), np.where(known, cell[:, 2], 0).astype(np.int64)

    def span(self, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of documents."""
        begin = np.where(document > 0, self.ends[np.maximum(document, 1) - 1], 0)
        return begin, self.ends[document] - begin


# ---------------------------------------------------------------- Spark
def _largest_id(raw: bytes, end_id: int) -> int:
    from tokenizers import Tokenizer
    return max([end_id, *Tokenizer.from_buffer(raw).get_vocab(with_added_tokens=True).values()])


def write(docs: DataFrame, tokenizer_file: str, folder: str | None = None, key: str = "doc_id", text: str = "text",
          end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> str:
    """Writes the ids of all documents; returns the folder of the shards."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    shipped = broadcast_file(spark, tokenizer_file)
    with open(tokenizer_file, "rb") as f:
        kind = np.dtype("<u2" if _largest_id(f.read(), end_id) < 1 << 16 else "<u4")
    end = np.array([end_id], kind).tobytes()
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    rows = rows.select("k", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("r"))
    order = [F.col("k").asc_nulls_first(), "h", "r"]
    rows = rows.repartitionByRange(max(1, -(-int(total) // shard_bytes)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shipped.value)
        keys, sizes, nulls = [], [], 0
        for batch in batches:
            k = batch.column(0)
            nulls += k.null_count
            keys.append(k.drop_null().to_numpy(zero_copy_only=False))
            for i, j in blocks.row_blocks(batch.column(1), TEXT_BYTES):
                ids, counts = own([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                sizes.append(counts + 1)
                at = np.concatenate([[0], np.cumsum(counts * kind.itemsize)])
                value = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [
                    None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([value.cast(pa.binary())], names=["value"])
        none = np.zeros(0, np.int64)
        block = index_block(np.concatenate([none, *keys]), nulls, np.concatenate([none, *sizes]),
                            kind.itemsize)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["value"])
        blocks.release()

    shards = rows.select("k", "t").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    shards.write.option("lineSep", end.decode("latin-1")).option("compression", "none").option(
        "maxRecordsPerFile", 0).text(folder)
    return folder


def documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, shard,
    offset (ids before it in its shard); with_ids: ids array<bigint>.  Every key goes
    through its shard's index."""
    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint").alias("shard"), "content")
    fields = "shard bigint, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                if not len(data):
                    continue
                index = Index(data[Index.place(bytes(data[-20:]), len(data)):])
                width = index.width
                keys, times = np.unique(index.keys[index.nulls:], return_counts=True)
                first, n = index.find(keys)
                if not np.array_equal(n, times):
                    raise ValueError(f"shard {shard}: index and keys differ")
                doc = np.concatenate([np.arange(index.nulls), blocks.ragged(first, n)])
                id_of = np.concatenate([np.zeros(index.nulls, np.int64), np.repeat(keys, n)])
                for a in range(0, len(doc), 4096):
                    part = doc[a:a + 4096]
                    begin, size = index.span(part)
                    own = [index.ids(data[width * b:width * (b + s)]) for b, s in zip(begin.tolist(), size.tolist())]
                    crc = [zlib.crc32(x) for x in own]
                    cols = [pa.array(np.full(len(part), shard)),
                            pa.array(id_of[a:a + 4096], mask=np.arange(a, a + len(part)) < index.nulls),
                            pa.array(begin), pa.array(size), pa.array(crc, pa.int64())]
                    names = ["shard", "doc_id", "offset", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                del data, index, content
        blocks.release()

    rows = cut_lineage(files.mapInArrow(run, fields + (", ids array<bigint>" if with_ids else "")))
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(shards, "shard").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset",
        *(["ids"] if with_ids else []))


class Reader:
    """Keyed access to a folder of shards from one process.  Opening reads the
    end of every shard; a key then costs a bisection over the shards' first keys,
    one index probe, and a read of its own ids.  ``cached`` indexes are kept."""

    def __init__(self, folder: str, cached: int = 64):
        if folder.startswith("file:") or "://" not in folder:
            self.fs, path = fs.LocalFileSystem(), folder.removeprefix("file:")
        else:
            self.fs, path = fs.FileSystem.from_uri(folder)
        files = [f for f in self.fs.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-") and f.size]
        self.shards = []
        for f in sorted(files, key=lambda f: int(f.base_name.split("-")[1])):
            with self.fs.open_input_file(f.path) as file:
                at = Index.place(file.read_at(20, f.size - 20), f.size)
                n, nulls = np.frombuffer(file.read_at(16, at + 8), _U).tolist()
                if n > nulls:
                    low, = np.frombuffer(file.read_at(8, at + Index.HEAD + 8 * nulls), np.int64).tolist()
                    high, = np.frombuffer(file.read_at(8, at + Index.HEAD + 8 * (n - 1)), np.int64).tolist()
                    self.shards.append((low, high, f.path, at))
        self.low = [s[0] for s in self.shards]
        self.high = [s[1] for s in self.shards]
        self.cached, self.open = cached, {}

    def _index(self, k: int) -> Index:
        if k not in self.open:
            if len(self.open) >= self.cached:
                self.open.pop(next(iter(self.open)))
            _, _, path, at = self.shards[k]
            with self.fs.open_input_file(path) as file:
                file.seek(at)
                self.open[k] = Index(file.read())
        return self.open[k]

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of the documents of a key (the end id last); none: empty list."""
        out = []
        for k in range(bisect.bisect_left(self.high, key), bisect.bisect_right(self.low, key)):  # a hot key spans shards
            index = self._index(k)
            first, n = (int(x[0]) for x in index.find(np.array([key], np.int64)))
            with self.fs.open_input_file(self.shards[k][2]) as file:
                for d in range(first, first + n):
                    begin, size = (int(x[0]) for x in index.span(np.array([d])))
                    out.append(index.ids(file.read_at(index.width * size, index.width * begin)))
        return out
