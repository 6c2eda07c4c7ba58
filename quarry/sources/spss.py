"""SPSS system files (.sav) as a Spark data source: ``spark.read.format("sav").load(path)``.

Numeric variables are doubles (the system-missing value is null), text variables strings without their
padding, with value labels available through ``value_labels``. Plain and bytecode-compressed files of either
byte order are read; text variables of more than 255 bytes and zlib-compressed files are rejected. A file is
one partition, since its records cannot be found without reading those before; several files are read in parallel.
"""

from __future__ import annotations

import glob
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the file format: the marks of the two kinds of file, and the system-missing number.
MAGIC, ZLIB = b"$FL2", b"$FL3"
MISSING = -struct.unpack("<d", struct.pack("<Q", 0x7FEFFFFFFFFFFFFF))[0]
# The codes of bytecode compression that are not small numbers.
SKIP, END, RAW, BLANKS, SYSMIS = 0, 252, 253, 254, 255


@dataclass
class Variable:
    name: str
    width: int  # 0: a number, else bytes of text
    labels: dict = field(default_factory=dict)


@dataclass
class Header:
    order: str
    compressed: bool
    bias: float
    encoding: str
    variables: list[Variable]
    slots: list[int]  # variable of each 8-byte slot of a case
    data_at: int


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def read_header(path: str) -> Header:
    with open(_local(path), "rb") as f:
        magic = f.read(4)
        if magic == ZLIB:
            raise ValueError(f"{path}: zlib-compressed files are not supported")
        if magic != MAGIC:
            raise ValueError(f"{path} is not an SPSS system file")
        f.read(60)
        layout = f.read(4)
        order = "<" if struct.unpack("<i", layout)[0] in (2, 3) else ">"
        number = lambda: struct.unpack(order + "i", f.read(4))[0]
        _, compression, _, _ = (number() for _ in range(4))
        bias = struct.unpack(order + "d", f.read(8))[0]
        f.read(9 + 8 + 64 + 3)
        variables: list[Variable] = []
        slots: list[int] = []
        names: list[bytes] = []
        labels: list[tuple[list[tuple[bytes, bytes]], list[int]]] = []
        long_names, encoding = b"", "utf-8"
        while (kind := number()) != 999:
            if kind == 2:
                width, labelled, missing, _, _ = (number() for _ in range(5))
                name = f.read(8).rstrip()
                if labelled:
                    f.read(-(-number() // 4) * 4)
                f.read(8 * abs(missing))
                if width >= 0:
                    variables.append(Variable("", width))
                    names.append(name)
                slots.append(len(variables) - 1)
            elif kind == 3:
                pairs = []
                for _ in range(number()):
                    value = f.read(8)
                    size = f.read(1)[0]
                    pairs.append((value, f.read(-(-(size + 1) // 8) * 8 - 1)[:size]))
                if number() != 4:
                    raise ValueError(f"{path}: value labels without variables")
                labels.append((pairs, [number() for _ in range(number())]))
            elif kind == 6:
                f.read(80 * number())
            elif kind == 7:
                subtype, size, count = number(), number(), number()
                body = f.read(size * count)
                if subtype == 13:
                    long_names = body
                elif subtype == 14:
                    raise ValueError(f"{path}: text variables of more than 255 bytes are not supported")
                elif subtype == 20:
                    encoding = body.decode("ascii").strip("\0 ").lower()
            else:
                raise ValueError(f"{path}: unknown record {kind}")
        number()
        spelled = dict(pair.split(b"=", 1) for pair in long_names.split(b"\t") if b"=" in pair)
        for variable, name in zip(variables, names, strict=True):
            variable.name = spelled.get(name, name).decode(encoding)
        for pairs, places in labels:
            for place in places:
                variable = variables[slots[place - 1]]
                for value, text in pairs:
                    key = struct.unpack(order + "d", value)[0] if variable.width == 0 else value.rstrip().decode(encoding)
                    variable.labels[key] = text.decode(encoding)
        return Header(order, bool(compression), bias, encoding, variables, slots, f.tell())


def value_labels(path: str) -> dict[str, dict]:
    """Labels by variable and value, of the variables that have any."""
    return {v.name: v.labels for v in read_header(path).variables if v.labels}


def _units(f, header: Header) -> Iterator[bytes | float | None]:
    """The 8-byte units of all cases: raw bytes, or a number where compression states one (None: system-missing)."""
    if not header.compressed:
        while len(unit := f.read(8)) == 8:
            yield unit
        return
    while len(codes := f.read(8)) == 8:
        for code in codes:
            if code == SKIP:
                continue
            if code == END:
                return
            if code == RAW:
                yield f.read(8)
            elif code == BLANKS:
                yield b" " * 8
            elif code == SYSMIS:
                yield None
            else:
                yield code - header.bias


def read_cases(path: str) -> Iterator[tuple]:
    """The rows of one file."""
    header = read_header(path)
    number = struct.Struct(header.order + "d").unpack
    with open(_local(path), "rb") as f:
        f.seek(header.data_at)
        units = _units(f, header)
        while True:
            row: list = [None] * len(header.variables)
            texts: dict[int, bytes] = {}
            for place in header.slots:
                try:
                    unit = next(units)
                except StopIteration:
                    return
                if header.variables[place].width == 0:
                    value = number(unit)[0] if isinstance(unit, bytes) else unit
                    row[place] = None if value == MISSING else value
                else:
                    texts[place] = texts.get(place, b"") + (unit if isinstance(unit, bytes) else b" " * 8)
            for place, text in texts.items():
                row[place] = text[: header.variables[place].width].decode(header.encoding, "replace").rstrip(" ")
            yield tuple(row)


@dataclass
class _File(InputPartition):
    path: str


class SavReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(p) for p in _files(self.path)]

    def read(self, partition):
        yield from read_cases(partition.path)


def _files(path: str) -> list[str]:
    files = sorted(glob.glob(_local(path).rstrip("/") + "/*.sav") or glob.glob(_local(path)))
    if not files:
        raise FileNotFoundError(path)
    return files


class SavSource(DataSource):
    """One file, a pattern, or a folder of files with the same variables."""

    @classmethod
    def name(cls) -> str:
        return "sav"

    def schema(self) -> T.StructType:
        first = read_header(_files(self.options["path"])[0])
        return T.StructType([T.StructField(v.name, T.StringType() if v.width else T.DoubleType()) for v in first.variables])

    def reader(self, schema: T.StructType) -> SavReader:
        return SavReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SavSource)
