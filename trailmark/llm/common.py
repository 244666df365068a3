"""Helpers shared by the text operators: words, batches of bounded size, cached tokenizer chunks."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import zipfile
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and text bytes that a Python worker handles at a time.
SLICE_ROWS, SLICE_BYTES = 1_000, 1_500_000

#: ASCII letters folded, every other ASCII byte but digits a blank; bytes of other characters stay.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


_SHIPPED: set[str] = set()


#: Rows that Spark hands to a Python worker at a time; whole texts make Spark's own default too much for one task.
BATCH_ROWS = 1_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session once, so that they need no installation of it.

    The session's Arrow batches are made smaller, where they are larger than ``BATCH_ROWS``.
    """
    if not 0 < int(spark.conf.get(_BATCH_CONF, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="trailmark-package-")) / "trailmark.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers outlive their tasks, and both keep what was freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def map_batches(
    rows: DataFrame,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
    encodes: bool = False,
) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers, which give free memory back when a task ends.

    Encoders that earlier tasks left in a worker go first, unless ``encodes`` says that these tasks use them.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            forget_encoders()
        try:
            yield from run(batches)
        finally:
            give_back()

    ship_package(rows.sparkSession)
    return rows.mapInArrow(whole, schema)


def ascii_words(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters as UTF-8, A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key's decimal text, modulo ``divisor``; null keys give null."""
    return F.crc32(F.col(key).cast("string")) % divisor


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds more than ``most`` bytes of text (one row may be longer)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    begin = 0
    while begin < batch.num_rows:
        done = size[begin - 1] if begin else 0
        end = int(np.searchsorted(size, done + most, side="right"))
        end = min(max(end, begin + 1), begin + SLICE_ROWS, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def per_text(
    docs: DataFrame,
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., list[pa.Array]]],
    text: str = "text",
    also: Sequence[str] = (),
) -> DataFrame:
    """Columns ``keep`` of every row and ``fields`` computed from its text; no shuffle.

    A kept column named like one of the fields is left out.

    ``make`` runs once per task and returns the function from texts (and the values of columns ``also``) to one array
    per field.
    """
    kept = [c for c in keep if c not in {f.name for f in fields}]
    schema = T.StructType([docs.schema[c] for c in kept] + list(fields))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                made = work(part.column(text).to_pylist(), *(part.column(c).to_pylist() for c in also))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=names)

    return map_batches(docs.select(*dict.fromkeys([*kept, text, *also])), run, schema)


def filter_texts(
    docs: DataFrame, make: Callable[[], Callable[[list[str | None]], np.ndarray]], text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text gives true; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(work(part.column(text).to_pylist()), pa.bool_()))

    return map_batches(docs, run, docs.schema)


# Unicode white space, as the tokenizers' patterns see it; the separators 1C-1F are not part of it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BYTE_LEVEL = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_NO_SPACE = re.compile(f"[^{_SPACE}]+")
_SEPARATORS = re.compile("[\\x1c-\\x1f]")


#: A piece of Latin letters with at most one mark at its end; the letters are one pre-token, the mark another.
_PLAIN = re.compile("([\\x00\\n]?)([A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+)([,.]?)")


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Pairs of blanks and line ends, and all other white space.
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_RARE = tuple(map(chr, [9, *range(11, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def uneven(text: str) -> bool:
    """Whether some white space is more than one blank or one line end between two words; plain searches are far faster than a pattern."""
    if text[:1] in (" ", "\n") or text[-1:] == " ":
        return True
    return any(pair in text for pair in _PAIRS) or any(blank in text for blank in _RARE)


class Splitter:
    """How a tokenizer cuts texts.

    ``pieces(text)`` gives strings that stand for the text's chunks in order, ``chunk(piece)`` the chunk of a piece; no
    pre-token crosses a chunk. ``lower`` says that the tokenizer lowers the case.
    """

    def __init__(self, name: str, pieces: Callable, chunk: Callable[[str], str], lower: bool) -> None:
        self.name, self.pieces, self.chunk, self.lower = name, pieces, chunk, lower


def _spaced(text: str) -> list[str]:
    """A word without its blank stands for the word with it; a word after a line end carries the line end."""
    if uneven(text):
        return ["\0" + c for c in _BYTE_LEVEL.findall(text)]
    return ("\0" + text.replace("\n", " \n")).split(" ")


def _spaced_chunk(piece: str) -> str:
    return piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece


def _bare(text: str) -> list[str]:
    """Lowered as a whole where lowering does not depend on the place in the word (it does for the capital sigma)."""
    if "\u03a3" not in text:
        text = text.lower()
    return _NO_SPACE.findall(text) if _SEPARATORS.search(text) else text.split()


#: For the byte-level pattern, whose words carry the blank before them.
SPACED = Splitter("spaced", _spaced, _spaced_chunk, False)
#: For tokenizers that lower the case and drop white space.
BARE = Splitter("bare", _bare, str, True)


class ChunkEncoder:
    """Token ids of whole texts, with a bounded cache from pieces to ids.

    With ``specials`` the literal of an added token gives its id, as the tokenizer does by itself: such texts go through
    the whole tokenizer as they stand. Without, literals are plain text.

    A BPE tokenizer merges inside pre-tokens only, so the ids of a text are the joined ids of chunks that no pre-token
    crosses. Words repeat, so most pieces are found in the cache. New plain words go straight to the tokenizer's model,
    all other new chunks through the whole tokenizer.
    """

    LONGEST, MOST = 64, 400_000

    def __init__(self, path: str, splitter: Splitter, specials: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else []
        self.literal = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.whole = Tokenizer.from_file(path) if added else None
        self.tokenizer.encode_special_tokens = True
        self.splitter, self.known = splitter, {}
        self.tokens, self.alphabet = self.tokenizer.model.tokenize, byte_alphabet()
        self.marks = {mark: self._word(mark) for mark in ",."}
        self.newline = array("I", self.tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():
            word = word.replace(" ", self.alphabet[32])
        else:
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.tokens(word)]).tobytes()

    def _start(self, begin: str, word: str) -> bytes:
        """Ids of a plain word; ``begin`` tells whether a line end or nothing stands before it instead of a blank."""
        ids = self._word(word if begin or self.splitter.lower else " " + word)
        return self.newline + ids if begin == "\n" else ids

    def _new(self, piece: str) -> bytes:
        """Ids of a piece that is not in the cache; a word with a mark behind it shares the ids of the word."""
        plain = _PLAIN.fullmatch(piece)
        if plain is None or (self.splitter.lower and not piece.islower()):
            chunk = self.splitter.chunk(piece)
            ids = self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids
            return array("I", ids).tobytes()
        begin, word, mark = plain.groups()
        if not mark:
            return self._start(begin, word)
        ids = self.known.get(piece[:-1])
        if ids is None:
            ids = self.known[piece[:-1]] = self._start(begin, word)
        return ids + self.marks[mark]

    def encode(self, text: str | None) -> bytes:
        """Unsigned 32-bit ids in native (little-endian) order; null gives none."""
        if not text:
            return b""
        if self.literal is not None and self.literal.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        pieces, known = self.splitter.pieces(text), self.known
        parts = list(map(known.get, pieces))
        if None in parts:
            late = {}
            for piece in {x for x, part in zip(pieces, parts) if part is None}:
                made = self._new(piece)
                (known if len(piece) <= self.LONGEST else late)[piece] = made
            parts = [known.get(x) or late.get(x, b"") if part is None else part for x, part in zip(pieces, parts)]
            if len(known) > self.MOST:
                self.known = dict(islice(known.items(), len(known) // 2, None))
        return b"".join(parts)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, splitter: Splitter, specials: bool = False) -> ChunkEncoder:
    """One encoder per Python worker, kept between the tasks that encode."""
    key = (path, splitter.name, specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, splitter, specials)
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Let the encoders of this worker go: with their vocabularies and caches they hold some 150 MB."""
    if _ENCODERS:
        _ENCODERS.clear()
        give_back()
