"""The binary token file: a flat array of ids in ``.bin`` and sizes, pointers and document starts in ``.idx``.

Registered as a data source: ``spark.read.format("tokenfile").load(prefix)`` gives ``item, doc, tokens``, a partition for
each run of items, each read from its byte range only; with the options ``offset`` and ``length`` only that part of each item
is read, beside its ``size``. ``write`` gives one pair of files for each partition of the rows. Paths may lie on any file
system that Arrow knows by its scheme, so on what all workers share.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
MAGIC = b"MMIDIDX\x00\x00"
LEGACY_MAGIC = b"TNTIDX\x00\x00"
CODES = {1: np.uint8, 2: np.int8, 3: np.int16, 4: np.int32, 5: np.int64, 6: np.float64, 7: np.float32, 8: np.uint16, 9: np.uint32, 10: np.uint64}
_CODE = {np.dtype(t): c for c, t in CODES.items()}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system a path names, and the path there; without a scheme the local one."""
    if re.match(r"[a-zA-Z][\w+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def opened(path: str):
    """A file to read from anywhere in it."""
    where, at = _at(path)
    return where.open_input_file(at)


def created(path: str):
    """A new file; the folder it is in is made."""
    where, at = _at(path)
    where.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(at)


def write_pair(prefix: str, items: list[np.ndarray], docs: list[int], dtype=np.int32) -> None:
    """``docs`` are the items at which documents begin, closed by the number of items."""
    sizes = np.array([len(x) for x in items], np.int32)
    pointers = np.zeros(len(items), np.int64)
    np.cumsum(sizes[:-1].astype(np.int64) * np.dtype(dtype).itemsize, out=pointers[1:])
    with created(f"{prefix}.bin") as f:
        for x in items:
            f.write(np.asarray(x, dtype).tobytes())
    with created(f"{prefix}.idx") as f:
        f.write(MAGIC + struct.pack("<QBQQ", 1, _CODE[np.dtype(dtype)], len(items), len(docs)))
        f.write(sizes.tobytes() + pointers.tobytes() + np.array(docs, np.int64).tobytes())


def read_index(prefix: str) -> tuple[np.dtype, np.ndarray, np.ndarray, np.ndarray]:
    """(type, sizes, byte pointers, document starts)."""
    with opened(f"{prefix}.idx") as f:
        raw = f.read()
    if raw[:9] != MAGIC:
        raise ValueError(f"{prefix}.idx is no token index")
    version, code, n, d = struct.unpack_from("<QBQQ", raw, 9)
    if version != 1:
        raise ValueError(f"{prefix}.idx has version {version}")
    at = 9 + 25
    sizes = np.frombuffer(raw, np.int32, n, at)
    pointers = np.frombuffer(raw, np.int64, n, at + 4 * n)
    return np.dtype(CODES[code]), sizes, pointers, np.frombuffer(raw, np.int64, d, at + 12 * n)


def write_legacy_index(prefix: str, items: list[np.ndarray], docs: list[int], dtype=np.int32) -> None:
    """The older index beside the same flat ``.bin``: offsets in dimensions and elements instead of byte pointers."""
    sizes = np.array([len(x) for x in items], np.int64)
    data = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    kind = np.dtype(dtype)
    with created(f"{prefix}.idx") as f:
        f.write(LEGACY_MAGIC + struct.pack("<QQQQQQ", 1, _CODE[kind], kind.itemsize, len(items), len(sizes), len(docs)))
        f.write(np.arange(len(items) + 1, dtype=np.int64).tobytes() + data.tobytes() + sizes.tobytes() + np.array(docs, np.int64).tobytes())


def read_legacy_index(prefix: str) -> tuple[np.dtype, np.ndarray, np.ndarray, np.ndarray]:
    """(type, sizes, byte pointers, document starts), as of the newer index."""
    with opened(f"{prefix}.idx") as f:
        raw = f.read()
    if raw[:8] != LEGACY_MAGIC:
        raise ValueError(f"{prefix}.idx is no legacy index")
    _, code, width, n, m, d = struct.unpack_from("<QQQQQQ", raw, 8)
    at = 8 + 48 + 8 * (n + 1)
    data = np.frombuffer(raw, np.int64, n + 1, at)
    sizes = np.frombuffer(raw, np.int64, m, at + 8 * (n + 1))
    return np.dtype(CODES[code]), sizes.astype(np.int32), data[:-1] * width, np.frombuffer(raw, np.int64, d, at + 8 * (n + 1 + m))


def index_of(prefix: str) -> tuple[np.dtype, np.ndarray, np.ndarray, np.ndarray]:
    """Either index, told by its first bytes."""
    with opened(f"{prefix}.idx") as f:
        return (read_legacy_index if f.read(8) == LEGACY_MAGIC else read_index)(prefix)


def write(df: DataFrame, folder: str, doc: str, order: str, tokens: str, legacy: bool = False) -> DataFrame:
    """Writes ``folder/part-N.bin`` and ``.idx``, a pair a partition, a document whole in one; returns what was written.
    ``legacy`` writes the older index. A task that runs again writes the same files again."""

    def run(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        items, starts, last = [], [], None
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d != last or not starts:
                    starts.append(len(items))
                    last = d
                items.append(np.array(x or [], np.int32))
        if items:
            write_pair(f"{folder}/part-{n:05d}", items, [*starts, len(items)])
            if legacy:
                write_legacy_index(f"{folder}/part-{n:05d}", items, [*starts, len(items)])
            yield pa.RecordBatch.from_pydict({"prefix": [f"{folder}/part-{n:05d}"], "items": [len(items)], "tokens": [int(sum(map(len, items)))]})

    return df.repartition(F.col(doc)).sortWithinPartitions(doc, order).select(doc, tokens).mapInArrow(run, "prefix string, items bigint, tokens bigint")


class _Range(InputPartition):
    def __init__(self, prefix: str, first: int, last: int, before: int) -> None:
        self.prefix, self.first, self.last, self.before = prefix, first, last, before


class TokenFileSource(DataSource):
    """Options: ``path`` one or several prefixes, comma-separated; they are read in sorted order as one file. ``offset`` and
    ``length``: the part of each item that is read."""

    RUN = 65_536

    @classmethod
    def name(cls) -> str:
        return "tokenfile"

    def schema(self) -> str:
        return "item bigint, doc bigint, size int, tokens array<int>" if "length" in self.options else "item bigint, doc bigint, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        part = (int(self.options.get("offset", 0)), int(self.options["length"])) if "length" in self.options else None
        return TokenFileReader(sorted(p.strip() for p in self.options["path"].split(",")), part)


class TokenFileReader(DataSourceReader):
    def __init__(self, prefixes: list[str], part: tuple[int, int] | None = None) -> None:
        self.prefixes, self.part = prefixes, part

    def partitions(self) -> list[InputPartition]:
        out, before, kind = [], 0, None
        for p in self.prefixes:
            dtype, sizes, _, _ = index_of(p)
            if kind not in (None, dtype):
                raise ValueError("the files' types differ")
            kind = dtype
            out += [_Range(p, i, min(i + TokenFileSource.RUN, len(sizes)), before) for i in range(0, len(sizes), TokenFileSource.RUN)]
            before += len(sizes)
        return out

    def read(self, part: _Range):
        dtype, sizes, pointers, docs = index_of(part.prefix)
        with opened(f"{part.prefix}.bin") as f:
            for i in range(part.first, part.last):
                size = int(sizes[i])
                skip, n = (0, size) if self.part is None else (min(self.part[0], size), min(self.part[1], max(size - self.part[0], 0)))
                f.seek(int(pointers[i]) + skip * dtype.itemsize)
                x = np.frombuffer(f.read(n * dtype.itemsize), dtype).astype(int).tolist()
                row = part.before + i, int(np.searchsorted(docs, i, "right")) - 1
                yield (*row, x) if self.part is None else (*row, size, x)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenFileSource)
