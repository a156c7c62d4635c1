"""Headerless little-endian 32-bit token files as a data source: read by byte ranges, written by tasks at known places."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a token, of a task's share of the files, and of what a task reads at once; tokens of a written file.
WIDTH, SPLIT, READ, PER_FILE = 4, 64 << 20, 4 << 20, 1 << 24
SCHEMA = "corpus string, pos bigint, token bigint"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it. Executors must reach it, too."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file:").removeprefix("//")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str, corpus: str) -> list[tuple[str, str, int]]:
    """corpus, file and whole tokens of each token file, in the order of corpora and names: a line for each file."""
    system, root = _place(path)
    at = system.get_file_info(root)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    rows = []
    for f in found:
        parts = posixpath.relpath(f.path, root).split("/") if f.path != root else [f.base_name]
        if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in parts):
            named = [unquote(p.removeprefix("corpus=")) for p in parts[:-1] if p.startswith("corpus=")]
            rows.append((named[-1] if named else corpus, f.path, f.size // WIDTH))
    return sorted(rows)


@dataclass
class Share(InputPartition):
    """Ranges of files that a task reads: corpus, file, first token, number of tokens, and the first one's position."""

    ranges: list[tuple[str, str, int, int, int]]


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.corpus = options["path"], options.get("corpus", "")
        self.split = max(int(options.get("splitbytes", SPLIT)) // WIDTH, 1)
        self.first, self.until = int(options.get("first", 0)), int(options.get("until", 1 << 62))

    def partitions(self) -> list[Share]:
        shares: list[Share] = []
        room, pos, last = 0, 0, None
        for corpus, file, size in _listed(self.path, self.corpus):
            pos, last = (pos if corpus == last else 0), corpus
            lo, hi = max(self.first - pos, 0), min(self.until - pos, size)
            while lo < hi:
                if room == 0:
                    shares, room = [*shares, Share([])], self.split
                n = min(room, hi - lo)
                shares[-1].ranges.append((corpus, file, lo, n, pos + lo))
                lo, room = lo + n, room - n
            pos += size
        return shares or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        for corpus, file, start, size, pos in partition.ranges:
            with system.open_input_file(file) as source:
                for lo in range(0, size, READ // WIDTH):
                    n = min(READ // WIDTH, size - lo)
                    ids = np.frombuffer(source.read_at(n * WIDTH, (start + lo) * WIDTH), "<u4").astype(np.int64)
                    if len(ids) != n:
                        raise OSError(f"{file} has changed: {len(ids)} tokens instead of {n}")
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(corpus), n), pa.array(np.arange(pos + lo, pos + lo + n)), pa.array(ids)], names=["corpus", "pos", "token"])


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: corpus, number of the file, tokens, and the name it has until all tasks are done."""

    files: list[tuple[str, int, int, str]]


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.per_file, self.overwrite = options["path"], int(options.get("perfile", PER_FILE)), overwrite
        self.run = uuid.uuid4().hex

    def _folder(self, corpus: str) -> str:
        return f"{_place(self.path)[1].rstrip('/')}/corpus={quote(corpus, safe='')}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Runs of tokens (corpus, pos, tokens) in the order of their positions, none of them over a file's edge."""
        made: list[str] = []
        try:
            return self._write(batches, made)
        except BaseException:
            self._delete(made)
            raise

    def _write(self, batches: Iterator[pa.RecordBatch], made: list[str]) -> Written:
        system, _ = _place(self.path)
        done: list[tuple[str, int, int, str]] = []
        out, corpus, number, next_pos = None, None, -1, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append((corpus, number, next_pos - number * self.per_file, name))

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("tokens"))
            ids = lists.flatten()
            if ids.null_count:
                raise ValueError("a token is null")
            ids = ids.to_numpy()
            if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 32:
                raise ValueError("a token does not fit 32 bits")
            ids = ids.astype("<u4")
            ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
            lo = 0
            for c, pos, hi in zip(batch.column(batch.schema.get_field_index("corpus")).to_pylist(), batch.column(batch.schema.get_field_index("pos")).to_pylist(), ends.tolist(), strict=True):
                if hi == lo:
                    continue
                if out is None or c != corpus or pos // self.per_file != number:
                    close()
                    corpus, number = c, pos // self.per_file
                    next_pos = number * self.per_file
                    system.create_dir(self._folder(c), recursive=True)
                    # the name is this attempt's own; readers pass over it
                    name = f"{self._folder(c)}/.{self.run}-{number:012d}-{uuid.uuid4().hex}"
                    made.append(name)
                    out = system.open_output_stream(name)
                if pos != next_pos:
                    raise ValueError(f"corpus {c}: position {pos} follows {next_pos - 1}")
                out.write(ids[lo:hi].tobytes())
                next_pos, lo = pos + hi - lo, hi
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """A name for each file, once all are there: the number of its first token."""
        system, root = _place(self.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        for corpus in {f[0] for f in files}:
            own = [f for f in files if f[0] == corpus]
            if [f[1] for f in own] != list(range(len(own))) or any(f[2] != self.per_file for f in own[:-1]):
                self.abort(messages)
                raise ValueError(f"corpus {corpus}: positions are missing or come twice")
        if self.overwrite and system.get_file_info(root).type == fs.FileType.Directory:
            for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
                if f.type == fs.FileType.File and f.base_name.startswith("tokens-") and f.base_name.endswith(".bin"):
                    system.delete_file(f.path)
        for corpus, number, _, name in files:
            system.move(name, f"{self._folder(corpus)}/tokens-{number * self.per_file:018d}.bin")

        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _delete(self, names: list[str]) -> None:
        system, _ = _place(self.path)
        for name in names:
            if system.get_file_info(name).type == fs.FileType.File:
                system.delete_file(name)

    def _sweep(self) -> None:
        """Delete what this write has left under names of its own: files of lost or repeated attempts."""
        system, root = _place(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        self._delete([f.path for f in found if f.base_name.startswith(f".{self.run}-")])


class TokenFiles(DataSource):
    """Format token_files. Reading (corpus, pos, token): `path`, a file or a folder; `corpus`, the name where no folder corpus=...
    gives one; `splitBytes` of a task; `first` and `until`, positions outside of which nothing is read. Writing: runs of tokens,
    by write_tokens()."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options), overwrite)


def read_tokens(spark: SparkSession, path: str, corpus: str = "", split_bytes: int = SPLIT, first: int = 0, until: int = 1 << 62) -> DataFrame:
    """corpus, pos, token of headerless little-endian 32-bit token files, for exchange with other programs. Positions run on over
    a corpus's files in the order of their names. Tasks read byte ranges of `split_bytes`, whatever the sizes of the files, and
    only those between the positions `first` and `until`; bytes past a file's last whole token are dropped."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").options(path=path, corpus=corpus, splitBytes=split_bytes, first=first, until=until).load()


def write_tokens(runs: DataFrame, path: str, per_file: int = PER_FILE, mode: str = "overwrite") -> None:
    """Token files of `per_file` tokens, each named by the position of its first token: corpus=.../tokens-<position>.bin. runs:
    corpus, pos, tokens (an array, which begins at pos), or corpus, pos, token. A task writes whole files, in the order of
    positions and under names of its own; they are renamed once all tasks are done, so a lost task leaves nothing behind that
    a reader sees. Positions must run from 0 without a gap: a missing or repeated one fails the write."""
    runs.sparkSession.dataSource.register(TokenFiles)
    if "tokens" not in runs.columns:
        runs = runs.select("corpus", "pos", F.array("token").alias("tokens"))
    last = F.col("pos") + F.size("tokens") - 1
    whole = runs.where(F.size("tokens") > 0).select("corpus", "pos", "tokens", F.explode(F.sequence(F.floor(F.col("pos") / per_file), F.floor(last / per_file))).alias("file"))
    from_ = F.greatest(F.col("file") * per_file - F.col("pos"), F.lit(0))
    to = F.least((F.col("file") + 1) * per_file - F.col("pos"), F.size("tokens").cast("long"))
    cut = whole.select("corpus", "file", (F.col("pos") + from_).alias("pos"), F.slice("tokens", (from_ + 1).cast("int"), (to - from_).cast("int")).alias("tokens"))
    placed = cut.repartition("corpus", "file").sortWithinPartitions("corpus", "file", "pos").select("corpus", "pos", F.col("tokens").cast("array<bigint>").alias("tokens"))
    placed.write.format("token_files").mode(mode).options(path=path, perFile=per_file).save()
