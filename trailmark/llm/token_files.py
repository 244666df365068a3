"""Token-id shards with a minimal perfect hash index.

A shard file holds, one after the other:

* the ids of its documents, unsigned little-endian, in key order, nothing between them; 16 bits each where the
  tokenizer's vocabulary allows it, else 32;
* the index: key hashes' levels of bits (a minimal perfect hash), then per slot a 32-bit fingerprint, the place of the
  document's first id and its number of ids;
* the keys in order (number, null flag, how often the same key came before in the shard), for listing a shard;
* a footer of fixed size with the counts and places of all parts.

A lookup hashes the key, finds its slot by a rank over bits, compares the fingerprint and reads the slot: constant time,
no search. Unknown keys are refused by the fingerprint (one in 2^32 passes).

Documents are range-partitioned and sorted by key, so a shard is bounded by its partition and the number of shards
follows the shuffle partitions. A task writes to a name of its own and then moves the file into place, so a retried task
replaces equal bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import BARE, Splitter, encoder, map_batches, slices
from trailmark.plans.lineage import new_folder, store

MAGIC = b"TMIDS003"
#: magic, documents, ids, places of levels, fingerprints, starts, counts, keys; number of levels, bytes of an id.
FOOTER = struct.Struct("<8s9Q")
MANIFEST = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("uri", T.StringType()),
    T.StructField("n_docs", T.LongType()),
    T.StructField("n_ids", T.LongType()),
])


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(number: np.ndarray, null: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """One hash per key: the document's number, whether it is null, and how often it came before in the shard."""
    return mix(mix(number.astype(np.int64).view(np.uint64), 1) ^ (copy.astype(np.uint64) << np.uint64(1)) ^ null.astype(np.uint64), 2)


class PerfectHash:
    """Minimal perfect hash by levels: keys alone in their place take its bit, the others go on to the next level."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels, self.before, total = levels, [], 0
        for bits in levels:
            ones = np.unpackbits(bits, bitorder="little")
            self.before.append(total + np.cumsum(ones, dtype=np.int64) - ones)
            total += int(ones.sum())
        self.size = total

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            width = -(-int(len(left) * 1.5 + 8) // 8) * 8
            place = mix(left, len(levels) + 11) % np.uint64(width)
            alone = np.bincount(place.astype(np.int64), minlength=width) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[place.astype(np.int64)]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """A number from 0 to size - 1 for every key of the set; any number, or -1, for others."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for k, bits in enumerate(self.levels):
            place = (mix(hashes[left], k + 11) % np.uint64(len(bits) * 8)).astype(np.int64)
            hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            out[left[hit]] = self.before[k][place[hit]]
            left = left[~hit]
        return out


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 3) >> np.uint64(32)).astype("<u4")


def copies(number: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each one of a sorted list."""
    n = len(number)
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (number[1:] != number[:-1]) | (null[1:] != null[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.arange(n) - first


class ShardReader:
    """Keyed access to one shard file."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        end = self.file.size() - FOOTER.size
        magic, self.n_docs, self.n_ids, levels, prints, starts, counts, keys, n_levels, self.width = FOOTER.unpack(self._read(end, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        widths = np.frombuffer(self._read(levels, 8 * n_levels), "<u8").tolist()
        bits = np.frombuffer(self._read(levels + 8 * n_levels, sum(widths)), np.uint8)
        self.hash = PerfectHash(np.split(bits, np.cumsum(widths)[:-1]) if widths else [])
        self.prints = np.frombuffer(self._read(prints, 4 * self.n_docs), "<u4")
        self.starts = np.frombuffer(self._read(starts, 8 * self.n_docs), "<u8").astype(np.int64)
        self.counts = np.frombuffer(self._read(counts, 8 * self.n_docs), "<u8").astype(np.int64)
        self.keys_at = keys

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at) if n else b""

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All keys in order: number, null flag, copies before."""
        n = self.n_docs
        number = np.frombuffer(self._read(self.keys_at, 8 * n), "<i8")
        null = np.frombuffer(self._read(self.keys_at + 8 * n, n), np.uint8).astype(bool)
        return number, null, np.frombuffer(self._read(self.keys_at + 9 * n, 8 * n), "<i8")

    def find(self, number: np.ndarray, null: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first id and number of ids for each key; -1 and 0 for a key the shard does not hold."""
        if self.n_docs == 0:
            return np.full(len(number), -1, np.int64), np.zeros(len(number), np.int64)
        hashes = key_hash(number, null, copy)
        slot = self.hash.slots(hashes)
        known = (slot >= 0) & (self.prints[np.maximum(slot, 0)] == fingerprint(hashes))
        slot = np.where(known, slot, 0)
        return np.where(known, self.starts[slot], -1), np.where(known, self.counts[slot], 0)

    def ids(self, start: int, count: int) -> bytes:
        """Ids as unsigned 32-bit little-endian numbers, whatever their width in the file."""
        raw = self._read(self.width * start, self.width * count)
        return raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()

    def close(self) -> None:
        self.file.close()


def _index(number: np.ndarray, null: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """Everything behind the ids of a shard, each ``width`` bytes long."""
    copy = copies(number, null)
    hashes = key_hash(number, null, copy)
    perfect = PerfectHash.build(hashes)
    slot = perfect.slots(hashes)
    by_slot = np.argsort(slot)
    widths = np.array([len(b) for b in perfect.levels], "<u8").tobytes()
    levels = widths + b"".join(b.tobytes() for b in perfect.levels)
    starts = np.cumsum(counts) - counts
    parts = [
        levels, fingerprint(hashes)[by_slot].tobytes(), starts[by_slot].astype("<u8").tobytes(),
        counts[by_slot].astype("<u8").tobytes(),
        number.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + copy.astype("<i8").tobytes(),
    ]
    places = (width * int(counts.sum()) + np.cumsum([0, *map(len, parts[:-1])])).tolist()
    return b"".join(parts) + FOOTER.pack(MAGIC, len(number), int(counts.sum()), *places, len(perfect.levels), width)


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str, splitter: Splitter = BARE, end_id: int = 2,
    key: str = "doc_id", text: str = "text", specials: bool = False,
) -> DataFrame:
    """Write all documents in ascending key order and return the manifest, one row per shard that holds documents.

    Null keys come first; rows with the same key are ordered by their text and may reach over several shards, so a hot
    key does not meet in one task. A null text is an empty one. ``folder`` is a URI that driver and executors share.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shard = encoder(tokenizer, splitter, specials), TaskContext.get().partitionId()
        encode, width = tokens.encode, 2 if max(tokens.tokenizer.get_vocab_size(), end_id + 1) <= 2**16 else 4
        system, root = fs.FileSystem.from_uri(folder)
        out, own = None, f"{root}/.{shard}-{uuid.uuid4().hex}"
        number, null, counts = [], [], []
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(own)
                payload = [encode(value) + end for value in part.column("text").to_pylist()]
                ids = b"".join(payload)
                out.write(ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                counts.append(np.array([len(p) // 4 for p in payload], np.int64))
                keys = part.column("key")
                null.append(keys.is_null().to_numpy(zero_copy_only=False))
                number.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
        if out is None:
            return
        number, null, counts = (np.concatenate(x) for x in (number, null, counts))
        total = int(counts.sum())
        out.write(_index(number, null, counts, width))
        out.close()
        system.move(own, f"{root}/shard-{shard:06d}.ids")
        row = [[shard], [f"{folder}/shard-{shard:06d}.ids"], [len(number)], [total]]
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=MANIFEST.names)

    order = [F.col("key").asc_nulls_first(), F.col("text_hash"), F.col("text")]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("key", "text")
    return store(map_batches(rows, run, MANIFEST, encodes=True), "manifest")


def place_shards(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``, the number of ids before each shard; a row per shard, so the driver adds them up."""
    first, rows = 0, []
    for shard in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((shard.shard, shard.uri, first))
        first += shard.n_ids
    made = manifest.sparkSession.createDataFrame(rows, "shard int, uri string, first long")
    return made.repartition(max(1, len(rows)), "shard")


def read_shards(manifest: DataFrame, block: int = 4_096) -> DataFrame:
    """Look every key of every shard up in its index and read its ids: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before it. Repeated keys give a row each.
    """
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                reader = ShardReader(shard["uri"])
                number, null, copy = reader.keys()
                for k in range(0, len(number), block):
                    start, count = reader.find(*(x[k : k + block] for x in (number, null, copy)))
                    if (start < 0).any():
                        raise ValueError(f"{shard['uri']} misses some of its keys")
                    crc = [zlib.crc32(reader.ids(s, n)) for s, n in zip(start.tolist(), count.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number[k : k + block], pa.int64(), mask=null[k : k + block]),
                         pa.array(start + shard["first"]), pa.array(count), pa.array(crc, pa.int64())],
                        names=schema.names,
                    )
                reader.close()

    return map_batches(place_shards(manifest), run, schema)


def encode_and_read(
    docs: DataFrame, tokenizer: str, splitter: Splitter = BARE, end_id: int = 2, specials: bool = False
) -> DataFrame:
    """Write the shards to a new folder of the shared place and read all documents back through the index."""
    folder = new_folder(docs.sparkSession, "ids")
    return read_shards(write_shards(docs, tokenizer, folder, splitter, end_id, specials=specials))
