"""bigWig files as a Python data source: `spark.read.format("bigwig").load(path)`.

The format is the published one (Kent et al. 2010): a header, a B+ tree of chromosomes, an
R tree of compressed data blocks. A partition is a run of blocks, so a large file is many tasks.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "track string, chrom string, start long, end long, value double"
#: Fixed values of the format.
MAGIC, CHROM_MAGIC, TREE_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BEDGRAPH, VARIABLE, FIXED = 1, 2, 3


class File:
    def __init__(self, path: str):
        self.f = open(path, "rb")
        head = self.f.read(64)
        self.order = next((o for o in "<>" if struct.unpack(o + "I", head[:4])[0] == MAGIC), None)
        if self.order is None:
            raise ValueError(f"{path} is no bigWig file")
        _, _, _, self.chrom_at, self.data_at, self.index_at, _, _, _, _, self.buffer, _ = struct.unpack(self.order + "IHHQQQHHQQIQ", head)

    def read(self, at: int, fmt: str) -> tuple:
        self.f.seek(at)
        fmt = self.order + fmt
        return struct.unpack(fmt, self.f.read(struct.calcsize(fmt)))

    def chroms(self) -> dict[int, tuple[str, int]]:
        """Id to (name, length)."""
        magic, _, key, _, _, _ = self.read(self.chrom_at, "IIIIQQ")
        if magic != CHROM_MAGIC:
            raise ValueError("damaged chromosome tree")
        out: dict[int, tuple[str, int]] = {}
        todo = [self.chrom_at + 32]
        while todo:
            at = todo.pop()
            leaf, _, n = self.read(at, "BBH")
            for i in range(n):
                if leaf:
                    name, k, size = self.read(at + 4 + i * (key + 8), f"{key}sII")
                    out[k] = name.rstrip(b"\0").decode(), size
                else:
                    todo.append(self.read(at + 4 + i * (key + 8), f"{key}sQ")[1])
        return out

    def blocks(self) -> list[tuple[int, int]]:
        """(offset, size) of the data blocks, in file order."""
        if self.read(self.index_at, "I")[0] != TREE_MAGIC:
            raise ValueError("damaged index")
        out, todo = [], [self.index_at + 48]
        while todo:
            at = todo.pop()
            leaf, _, n = self.read(at, "BBH")
            for i in range(n):
                if leaf:
                    out.append(self.read(at + 4 + i * 32, "IIIIQQ")[4:])
                else:
                    todo.append(self.read(at + 4 + i * 24, "IIIIQ")[4])
        return sorted(out)

    def block(self, at: int, size: int) -> Iterator[tuple[int, int, int, float]]:
        """(chromosome id, start, end, value)."""
        self.f.seek(at)
        raw = self.f.read(size)
        if self.buffer:
            raw = zlib.decompress(raw)
        chrom, start, _, step, width, kind, _, n = struct.unpack(self.order + "IIIIIBBH", raw[:24])
        if kind == BEDGRAPH:
            for s, e, v in struct.iter_unpack(self.order + "IIf", raw[24 : 24 + 12 * n]):
                yield chrom, s, e, v
        elif kind == VARIABLE:
            for s, v in struct.iter_unpack(self.order + "If", raw[24 : 24 + 8 * n]):
                yield chrom, s, s + width, v
        elif kind == FIXED:
            for i, (v,) in enumerate(struct.iter_unpack(self.order + "f", raw[24 : 24 + 4 * n])):
                yield chrom, start + i * step, start + i * step + width, v


class Run(InputPartition):
    def __init__(self, path: str, blocks: list[tuple[int, int]]):
        self.path, self.blocks = path, blocks


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.run = int(options.get("blocksPerPartition", 4096))

    def partitions(self) -> list[Run]:
        out = []
        for path in self.paths:
            blocks = File(path).blocks()
            out += [Run(path, blocks[i : i + self.run]) for i in range(0, len(blocks), self.run)]
        return out or [Run("", [])]

    def name_of(self, path: str) -> str:
        """The base name without its suffix; the whole path where two files share it."""
        base = lambda p: os.path.splitext(os.path.basename(p))[0]
        return base(path) if sum(base(p) == base(path) for p in self.paths) == 1 else path

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        f, track = File(partition.path), self.name_of(partition.path)
        chroms = f.chroms()
        for at, size in partition.blocks:
            rows = list(f.block(at, size))
            cols = [pa.array([track] * len(rows)), pa.array([chroms[r[0]][0] for r in rows]), *(pa.array([r[i] for r in rows], k) for i, k in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64())))]
            yield pa.RecordBatch.from_arrays(cols, ["track", "chrom", "start", "end", "value"])


class BigWig(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_bigwig(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(track, chrom, start, end, value) of files that all nodes can open; the track is the file's name (or path, see Reader.name_of)."""
    spark.dataSource.register(BigWig)
    return spark.read.format("bigwig").load(paths if isinstance(paths, str) else ",".join(paths))


def chrom_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(chrom, length) of all files' chromosomes; where files differ, the largest."""
    sizes: dict[str, int] = {}
    for path in [paths] if isinstance(paths, str) else paths:
        for chrom, length in File(path).chroms().values():
            sizes[chrom] = max(length, sizes.get(chrom, 0))
    return spark.createDataFrame(list(sizes.items()), "chrom string, length long")
