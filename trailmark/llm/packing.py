"""Best-fit packing of documents into token sequences by hierarchical residual packing.

1. Every document becomes token ids and an end id; one longer than a sequence is cut into full pieces, a shorter piece
   first. Full pieces are sequences of their own.
2. Each partition packs its pieces by best fit, longest first, in chunks of bounded size; bins that stay open are items
   of the next chunk. A bin with at most ``slack`` free tokens is emitted.
3. Open bins are dealt to fewer partitions and packed again as items, until one partition has seen them all or a round
   no longer saves bins. Each round is written to the shared folder, so a lost executor costs one round at most.

A bin holds at most ``size`` members, a task at most ``chunk`` items and ``open_limit`` open bins, whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import SPACED, Splitter, encoder, map_batches, slices
from trailmark.plans.lineage import store

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])
MEMBER = T.StructType([*PIECES, T.StructField("offset", T.LongType())])
BINS = T.StructType([
    T.StructField("sequence_id", T.LongType()),
    T.StructField("fill", T.LongType()),
    T.StructField("members", T.ArrayType(MEMBER)),
])
_ARROW = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
_MEMBER = pa.struct([*_ARROW.items(), ("offset", pa.int64())])
_ITEMS = pa.schema([("fill", pa.int64()), ("members", pa.list_(_MEMBER))])


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: full ones, a shorter one first where ``n`` is no multiple."""
    first = n % size
    return ([first] if first else []) + [size] * (n // size)


def token_pieces(
    docs: DataFrame, tokenizer: str, splitter: Splitter = SPACED, size: int = 1024, end_id: int = 2,
    key: str = "doc_id", text: str = "text", specials: bool = False,
) -> DataFrame:
    """One row per piece of every document: its place in the document, length and the crc32 of its 32-bit ids.

    ``specials`` says whether literals of added tokens give their ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, splitter, specials).encode
        for batch in batches:
            for part in slices(batch, "text"):
                row, piece, start, length, crc = [], [], [], [], []
                for i, value in enumerate(part.column("text").to_pylist()):
                    ids = memoryview(encode(value) + end)
                    at = 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, size)):
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                        at += n
                made = [part.column("doc_id").take(pa.array(row, pa.int64())), piece, start, length, crc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) if isinstance(x, list) else x.cast(t) for x, t in zip(made, _ARROW.values())],
                    names=list(_ARROW),
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, PIECES, encodes=True)


class Packer:
    """Best fit over items of bounded number: the fullest bin that still takes the item, found in a bit mask of gaps."""

    def __init__(self, size: int) -> None:
        self.size, self.gaps, self.by_gap = size, 0, [[] for _ in range(size + 1)]

    def add(self, length: int, members: list) -> None:
        above = self.gaps >> length
        if above:
            gap = length + (above & -above).bit_length() - 1
            fits = self.by_gap[gap]
            held = fits.pop()
            if not fits:
                self.gaps &= ~(1 << gap)
            held.extend(members)
        else:
            gap, held = self.size, list(members)
        gap -= length
        self.by_gap[gap].append(held)
        self.gaps |= 1 << gap

    def take(self, least: int, most: int) -> list[tuple[int, list]]:
        """Remove and return the bins with a gap from ``least`` to ``most``, as (fill, members)."""
        out = []
        for gap in range(least, most + 1):
            if self.by_gap[gap]:
                out += [(self.size - gap, held) for held in self.by_gap[gap]]
                self.by_gap[gap] = []
                self.gaps &= ~(1 << gap)
        return out

    def count(self) -> int:
        return sum(map(len, self.by_gap))


def _bins(bins: list[tuple[int, list]], ids: Iterator[int], table: pa.Table) -> pa.RecordBatch:
    """Bins whose members are row numbers of ``table`` (members with their lengths), offsets counted anew."""
    order = [i for _, held in bins for i in held]
    counts = np.array([len(held) for _, held in bins], np.int64)
    taken = table.take(pa.array(order, pa.int64())).combine_chunks()
    length = taken.column("length").to_numpy()
    total = np.cumsum(length) - length
    first = np.cumsum(counts) - counts
    offset = total - np.repeat(total[first], counts) if len(order) else total
    columns = [taken.column(c).combine_chunks() if isinstance(taken.column(c), pa.ChunkedArray) else taken.column(c) for c in _ARROW]
    members = pa.StructArray.from_arrays([*columns, pa.array(offset, pa.int64())], fields=list(_MEMBER))
    starts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    nested = pa.ListArray.from_arrays(starts, members)
    fill = pa.array([f for f, _ in bins], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([next(ids) for _ in bins], pa.int64()), fill, nested], names=["sequence_id", "fill", "members"]
    )


def _numbers(round_: int) -> Iterator[int]:
    """Sequence numbers that no other task of any round gives."""
    at = (round_ << 56) | (TaskContext.get().partitionId() << 32)
    while True:
        yield at
        at += 1


def _pack(
    batches: Iterator[pa.RecordBatch], round_: int, size: int, slack: int, chunk: int, open_limit: int
) -> Iterator[pa.RecordBatch]:
    """Pack one partition of bins; the fill of a returned bin tells whether it is nearly full."""
    ids, emit = _numbers(round_), 2_000
    held, waiting = [], 0

    def packed(tables: list[pa.Table], last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
        bins = pa.concat_tables(tables)
        nested = bins.column("members").combine_chunks()
        nested = nested if isinstance(nested, pa.ListArray) else nested.chunk(0)
        members = pa.Table.from_struct_array(nested.flatten())
        begins = nested.offsets.to_numpy() - nested.offsets[0].as_py()
        fill = bins.column("fill").to_numpy()
        packer = Packer(size)
        for i in np.argsort(-fill, kind="stable").tolist():
            packer.add(int(fill[i]), range(begins[i], begins[i + 1]))
        out = packer.take(0, slack)
        keep = None
        if last or packer.count() > open_limit:
            out += packer.take(slack + 1, size)
        else:
            rest = packer.take(slack + 1, size)
            keep = pa.Table.from_batches([_bins(rest, iter(range(len(rest))), members)]) if rest else None
        return [_bins(out[k : k + emit], ids, members) for k in range(0, len(out), emit)], keep

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(pa.Table.from_batches([batch]).select(["fill", "members"]).cast(_ITEMS))
        waiting += batch.num_rows
        if waiting >= chunk:
            out, keep = packed(held, False)
            yield from out
            held, waiting = ([keep.select(["fill", "members"]).cast(_ITEMS)], 0) if keep is not None else ([], 0)
    if held:
        yield from packed(held, True)[0]


def pack_pieces(
    pieces: DataFrame, size: int = 1024, slack: int = 4, fan_in: int = 8, chunk: int = 20_000, open_limit: int = 20_000
) -> DataFrame:
    """Sequences of at most ``size`` tokens: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``pieces`` must be stored rows (they are read once). Equal pieces, repeated rows and null ids are packed as they
    are; an empty table gives no sequence. ``slack`` is the gap up to which a bin counts as full.
    """
    spark = pieces.sparkSession
    member = F.struct(*[F.col(c) for c in PIECES.names], F.lit(0).cast("long").alias("offset"))
    items = pieces.select(F.lit(0).cast("long").alias("sequence_id"), F.col("length").alias("fill"), F.array(member).alias("members"))

    def packed(rows: DataFrame, round_: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _pack(batches, round_, size, slack, chunk, open_limit)

        return store(map_batches(rows, run, BINS), f"bins{round_}")

    is_open = F.col("fill") < size - slack
    bins = packed(items, 1)
    closed, left, parts = [bins.filter(~is_open)], bins.filter(is_open), None
    before = left.count()
    for round_ in range(2, 60):
        if before < 2:
            break
        wide = -(-before // chunk)
        parts = max(wide, 1) if parts is None else max(wide, parts // fan_in, 1)
        bins = packed(left.repartition(parts), round_)
        closed.append(bins.filter(~is_open))
        left = bins.filter(is_open)
        now = left.count()
        done = parts == 1 or now > 0.98 * before
        before = now
        if done:
            break
    out = left
    for more in closed:
        out = out.unionByName(more)
    return out.select("sequence_id", F.inline("members")).select(*PIECES.names, "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, tokenizer: str, splitter: Splitter = SPACED, size: int = 1024, end_id: int = 2,
    specials: bool = False, **options
) -> DataFrame:
    """Tokenise and pack whole documents; a null text is an empty one, so it is one piece with the end id alone.

    Rows are packed one by one: repeated rows and null doc_ids keep their pieces. Extra columns are not read.
    """
    return pack_pieces(store(token_pieces(docs, tokenizer, splitter, size, end_id, specials=specials), "pieces"), size, **options)
