"""FASTQ as a Spark data source: plain files are read in byte ranges by many tasks, packed ones by one task each.

A task begins at the first record that starts in its range and goes on to the end of the last one. Four lines are a record if the
first begins with '@', the third with '+' and the second and fourth are equally long; a quality line that begins with '@' does not fit.
Files are read in blocks; the lines of a block are one Arrow array over its bytes, of which names, sequences and qualities are taken.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, file_name string, read_idx bigint, name string, seq string, qual string"
_SCHEMA = pa.schema([(n, pa.int64() if n == "read_idx" else pa.string()) for n in ("path", "file_name", "read_idx", "name", "seq", "qual")])
#: Bytes that are read at once, and records of a batch.
BLOCK = 4 << 20
BATCH = 10_000
ENDLESS = 1 << 62


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, packed: bool = False) -> None:
        self.path, self.start, self.end, self.packed = path, start, end, packed


def open_fs(path: str):
    """pyarrow's file system and the path in it. Paths with a scheme are in that one; others, which the driver has qualified, are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Lines:
    """The whole lines of a block of bytes, without their ends, and where they begin."""

    def __init__(self, block: bytes) -> None:
        ends = np.flatnonzero(np.frombuffer(block, dtype=np.uint8) == 10)
        self.offsets = np.concatenate([[0], ends + 1]).astype(np.int32)
        text = pa.StringArray.from_buffers(len(ends), pa.py_buffer(self.offsets), pa.py_buffer(block))
        text.validate(full=True)
        self.text = pc.ascii_rtrim(text, characters="\r\n")
        self.sizes = pc.binary_length(self.text).to_numpy(zero_copy_only=False)
        self.at, self.plus = (pc.starts_with(self.text, pattern=p).to_numpy(zero_copy_only=False) for p in "@+")

    def __len__(self) -> int:
        return len(self.sizes)

    def is_record(self, k: np.ndarray) -> np.ndarray:
        """Whether records begin at these lines; three more follow each."""
        return self.at[k] & self.plus[k + 2] & (self.sizes[k + 1] == self.sizes[k + 3])


def records(stream, base: int, end: int, aligned: bool, block: int = BLOCK) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, pa.Array]]:
    """(positions, names, seqs, quals) of the records that begin before `end`, in pieces. base: the position of the stream's first byte, at which
    a line begins; aligned: it begins a record."""
    left, over = b"", False
    while not over:
        read = stream.read(block)
        over = not read
        data = left + read
        cut = len(data) if over else data.rfind(b"\n") + 1
        if over and data and not data.endswith(b"\n"):
            data, cut = data + b"\n", cut + 1
        lines = Lines(data[:cut])
        k, n = 0, len(lines)
        while k < n:
            if base + int(lines.offsets[k]) >= end:
                return
            if aligned and not lines.sizes[k]:
                k += 1  # a blank line between records
                continue
            if k + 4 > n:
                break
            if not aligned:
                begin = np.arange(k, n - 3)
                fits = np.flatnonzero(lines.is_record(begin))
                k, aligned = (k + int(fits[0]), True) if len(fits) else (n - 3, False)
                continue
            heads = np.arange(k, n - 3, 4)
            heads = heads[: int(np.searchsorted(lines.offsets[heads], end - base))]
            wrong = np.flatnonzero(~lines.is_record(heads))
            if len(wrong):
                heads = heads[: wrong[0]]
                if not len(heads):
                    raise ValueError(f"no FASTQ record at byte {base + int(lines.offsets[k])}")
            name = pc.utf8_slice_codeunits(lines.text.take(pa.array(heads)), 1)
            yield base + lines.offsets[heads].astype(np.int64), name, lines.text.take(pa.array(heads + 1)), lines.text.take(pa.array(heads + 3))
            k = int(heads[-1]) + 4
        if over:
            if k < n and aligned and lines.sizes[k:].any():
                raise ValueError(f"an incomplete record at byte {base + int(lines.offsets[k])}")
            return
        at = int(lines.offsets[k])
        left, base = data[at:], base + at


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.split = int(options.get("split_bytes", 128 << 20))
        self.format = options.get("format", "auto")

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            if self.format == "gzip" or self.format == "auto" and path.endswith(".gz"):
                out.append(Range(path, 0, -1, True))
                continue
            fs, p = open_fs(path)
            size = fs.get_file_info(p).size or 0
            out += [Range(path, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, p = open_fs(part.path)
        name = part.path.rsplit("/", 1)[-1]
        start, end = part.start, ENDLESS if part.packed else part.end
        if part.packed:
            stream = gzip.GzipFile(fileobj=fs.open_input_stream(p, compression=None))
        else:
            stream = fs.open_input_file(p)
            if start:
                start = _next_line(stream, start)
        try:
            for at, head, seq, qual in records(stream, start, end, part.start == 0):
                for i in range(0, len(at), BATCH):
                    n = min(BATCH, len(at) - i)
                    cols = [pa.array([part.path] * n), pa.array([name] * n), pa.array(at[i : i + n]), *(c.slice(i, n) for c in (head, seq, qual))]
                    yield pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)
        except (ValueError, pa.ArrowInvalid) as e:
            raise ValueError(f"{part.path}: {e}") from None


def _next_line(stream, start: int) -> int:
    """Go to the first line that begins at `start` or behind it, and return where that is."""
    at = start - 1
    stream.seek(at)
    while piece := stream.read(1 << 16):
        found = piece.find(b"\n")
        if found >= 0:
            at += found + 1
            break
        at += len(piece)
    stream.seek(at)
    return at


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "phylospark_fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)
