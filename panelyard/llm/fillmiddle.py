"""Fill-in-the-middle texts assembled by secondary sort and restored by sorting once more."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import whole_text

#: Marks before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a piece; whole lines as long as one fits.
CHUNK = 1 << 16
#: Bytes of pieces that leave a task at once.
_FLUSH = 4 << 20
#: Sections in the order of the text.
_SECTION = {PREFIX.encode(): 0, MIDDLE.encode(): 1, SUFFIX.encode(): 2}

PIECES = "row long, doc_id long, place long, chunk binary, n long, form string, prefix_chars long, middle_chars long"
_META = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]


def drawn(seed: int, doc_id: int | None) -> list[int]:
    """The numbers that decide on a document; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def line_ends(text: bytes) -> np.ndarray:
    """Where each line ends, its line break included; what follows the last break is a line too."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.append(ends, len(text)) if len(text) and (not len(ends) or ends[-1] < len(text)) else ends


def chars(text: bytes) -> int:
    """Code points of UTF-8 text."""
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def spans(start: int, end: int, text: bytes, ends: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    """Cuts a section into runs of whole lines of at most ``chunk`` bytes; a longer line between code points."""
    while start < end:
        stop = min(start + chunk, end)
        if stop < end:
            whole = int(ends[np.searchsorted(ends, stop, side="right") - 1]) if ends[0] <= stop else 0
            if whole > start:
                stop = whole
            else:
                while stop > start + 1 and text[stop] & 0xC0 == 0x80:
                    stop -= 1
        yield start, stop
        start = stop


def planned(doc_id: int | None, text: bytes, rate: int, spm_share: int, seed: int) -> tuple[int, str, list[tuple[bytes, int, int]], np.ndarray]:
    """Number of lines, form, sections (mark, start, end) in output order, and the line ends."""
    ends = line_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = drawn(seed, doc_id)
    if not text or any(mark in text for mark in _SECTION) or h3 % 100 >= rate:
        return n, "plain", [(b"", 0, len(text))], ends
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, suffix, middle = (PREFIX.encode(), 0, a), (SUFFIX.encode(), b, len(text)), (MIDDLE.encode(), a, b)
    return (n, "spm", [suffix, prefix, middle], ends) if h4 % 100 < spm_share else (n, "psm", [prefix, suffix, middle], ends)


def restore(output: str, form: str) -> str:
    """The text behind an output."""
    if form == "plain":
        return output
    at = sorted((output.index(mark), mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    stops = [place for place, _ in at[1:]] + [len(output)]
    part = {mark: output[place + len(mark) : stop] for (place, mark), stop in zip(at, stops)}
    return part[PREFIX] + part[MIDDLE] + part[SUFFIX]


def fim_pieces(docs: DataFrame, rate: int = 100, spm_share: int = 50, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The pieces of every output: ``row`` (one per input row), ``place`` (output position), ``chunk``.

    A piece is a run of whole lines of one section, with the section's mark
    before its first piece; a line longer than ``chunk`` bytes is cut. The first piece of a row carries its
    id, number of lines, form and lengths.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in PIECES.split(", ")]

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)

        for batch in batches:
            out, size = [], 0
            for row, doc_id, value in zip(*(batch.column(k) for k in range(3))):
                doc_id, text = doc_id.as_py(), value.as_buffer().to_pybytes()
                n, form, sections, ends = planned(doc_id, text, rate, spm_share, seed)
                lengths = {mark: chars(text[a:b]) for mark, a, b in sections} if form != "plain" else {}
                first = (doc_id, n, form, lengths.get(PREFIX.encode()), lengths.get(MIDDLE.encode()))
                place = 0
                for mark, start, end in sections:
                    for k, (a, b) in enumerate(spans(start, end, text, ends, chunk) if start < end else [(start, end)]):
                        piece = (b"" if k else mark) + text[a:b]
                        own, rest = (first[0], first[1:]) if place == 0 else (None, (None,) * 4)
                        out.append((row.as_py(), own, place, piece, *rest))
                        place, size = place + 1, size + len(piece)
                        if size > _FLUSH:
                            yield batch_of(out)
                            out, size = [], 0
            if out:
                yield batch_of(out)

    rows = docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), whole_text(text_col).cast("binary")).toDF("row", "id", "text")
    return rows.mapInArrow(cut, PIECES)


def _by_row(batches: Iterator, columns: list[str]) -> Iterator[tuple]:
    """(values of ``columns``) of the sorted rows, one at a time."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def fim_digests(pieces: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    Pieces are dealt by row and sorted within their partition by output
    position, and stream into the digest of the output. Read by their
    marks, they are sorted once more, in place, by position in the text and
    stream into the digest of the restored text. No text is held in whole.
    """

    def assembled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def finished(row: int, meta: tuple, digest) -> tuple:
            return (row, 3, 0, None, *meta, digest.hexdigest())

        row, meta, digest, section, out, size = None, (), None, 0, [], 0
        for at, place, chunk, *rest in _by_row(batches, ["row", "place", "chunk", *_META]):
            if at != row:
                if row is not None:
                    out.append(finished(row, meta, digest))
                row, meta, digest, section = at, tuple(rest), hashlib.sha256(), 0
            digest.update(chunk)
            if meta[2] != "plain" and chunk[:3] in _SECTION:
                section, chunk = _SECTION[chunk[:3]], chunk[3:]
            out.append((row, section, place, chunk, *(None,) * 6))
            size += len(chunk)
            if size > _FLUSH or len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types())], names=names)
                out, size = [], 0
        if row is not None:
            out.append(finished(row, meta, digest))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types())], names=names)

    def types() -> list:
        import pyarrow as pa

        return [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def restored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        out, digest = [], hashlib.sha256()
        for section, chunk, *rest in _by_row(batches, ["section", "chunk", *_META, "output_sha256"]):
            if section < 3:
                digest.update(chunk)
                continue
            # a row ends with its output's digest
            out.append((*rest, digest.hexdigest()))
            digest = hashlib.sha256()
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*_META, "output_sha256", "restored_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*_META, "output_sha256", "restored_sha256"])

    names = ["row", "section", "place", "chunk", *_META, "output_sha256"]
    meta = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"
    sorted_once = pieces.repartition("row").sortWithinPartitions("row", "place")
    parts = sorted_once.mapInArrow(assembled, f"row long, section int, place long, chunk binary, {meta}")
    return parts.sortWithinPartitions("row", "section", "place").mapInArrow(restored, f"{meta}, restored_sha256 string")


def fim_texts(pieces: DataFrame) -> DataFrame:
    """One row per document with its ``output``, joined from its sorted pieces."""

    def joined(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def one(meta: tuple, chunks: list[bytes]) -> pa.RecordBatch:
            values = [*meta, b"".join(chunks).decode()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[*_META, "output"])

        row, meta, chunks = None, (), []
        for at, chunk, *rest in _by_row(batches, ["row", "chunk", *_META]):
            if at != row:
                if row is not None:
                    yield one(meta, chunks)
                row, meta, chunks = at, tuple(rest), []
            chunks.append(chunk)
        if row is not None:
            yield one(meta, chunks)

    sorted_once = pieces.repartition("row").sortWithinPartitions("row", "place")
    return sorted_once.mapInArrow(joined, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def fill_in_middle(docs: DataFrame, rate: int = 100, spm_share: int = 50, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Every row with its form, lengths and the digests of its output and of the text rebuilt from it.

    A text is cut into lines. Hashes of seed and id choose two cuts between
    lines, whether the text is transformed (``rate`` in 100) and the order of
    its parts (``spm_share`` in 100 put the suffix first). Texts that are empty
    or hold a mark stay plain; their lengths are null. Null counts as empty, a
    null id as no digits. Rows that repeat an id are rows of their own. A very
    long text passes in pieces. An empty table gives no rows; other columns are
    ignored.
    """
    found = fim_digests(fim_pieces(docs, rate, spm_share, seed, id_col, text_col, chunk))
    return found.withColumnRenamed("doc_id", id_col)
