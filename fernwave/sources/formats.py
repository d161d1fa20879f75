"""Two formats for Spark's own readers and writers; `register(spark)` makes them known to a session.

`structure_files` reads fixed-column structure files, as a table or as a stream, with the columns of `structures.read_atoms`.
Tasks get whole files, small ones together. The option `only` (JSON: allowed values by column; for resseq the least and the
greatest) drops files by structure_id before they are opened, and rows by record, atom, resname, chain and resseq before their
numbers are parsed. These are options and not pushed filters, because Spark 4.1 keeps what one query pushed into a Python
source for the next query of the same DataFrame, if that one pushes nothing. A structure is named by a folder
structure_id=..., else by its file, without the ending.

`target_folders` writes rows (structure_id, part, pos, line) as text files `part` in a folder for each structure. What tasks write
stands in a folder of its own (`_writing-...`) until all have ended; then the driver moves each structure's folder into place, so
a reader meets all its files or none, and a write that fails leaves what was there before. Moving is one step on file systems
that can rename folders; on an object store a reader should wait for `_SUCCESS`.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.graph import S

ATOMS = f"{S} string, line_no int, record string, serial int, atom string, altloc string, resname string, chain string, resseq int, icode string, x double, y double, z double, occupancy double, bfactor double, line string"
#: Bytes of files that a task reads at most, unless one file alone is larger (option `together`).
TOGETHER = 32 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def named(path: str) -> str:
    folder = re.search(rf"/{S}=([^/]+)/", path)
    return unquote(folder[1]) if folder else re.search(r"([^/]+?)(\.\w+)?$", path)[1]


def found(path: str) -> list[fs.FileInfo]:
    """All files at or below a path, in order, but those that are hidden or still being written."""
    system, base = opened(path)
    at = system.get_file_info(base)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [at] if at.is_file else [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and not re.search(r"/[_.]", f.path[len(base.rstrip("/")) :])]
    return sorted(files, key=lambda f: f.path)


@dataclass
class Files(InputPartition):
    paths: list[str]


def together(files: list[fs.FileInfo], most: int) -> list[Files]:
    parts, held = [Files([])], 0
    for f in files:
        if parts[-1].paths and held + f.size > most:
            parts.append(Files([]))
            held = 0
        parts[-1].paths.append(f.path)
        held += f.size
    return parts


#: Columns that `only` may name.
CHOSEN = (S, "record", "atom", "resname", "chain", "resseq")


def kept(only: dict[str, list], columns: dict[str, pa.Array]) -> pa.Array | None:
    """Which rows meet all conditions on these columns; None if there are none."""
    mask = None
    for name, values in only.items():
        c = columns.get(name)
        if c is not None:
            one = pc.and_(pc.greater_equal(c, values[0]), pc.less_equal(c, values[1])) if name == "resseq" else pc.is_in(c, pa.array(values, c.type))
            mask = one if mask is None else pc.and_(mask, one)
    return mask


def number(text: pa.Array, kind: pa.DataType) -> pa.Array:
    """Numbers of a column of trimmed text; null where it is none."""
    form = r"^[+-]?\d{1,9}$" if pa.types.is_integer(kind) else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    good = pc.if_else(pc.match_substring_regex(text, form), text, pa.scalar(None, pa.string()))
    return pc.cast(pc.replace_substring_regex(good, r"^\+", ""), kind)


def atoms_of(name: str, text: str, only: dict[str, list]) -> pa.RecordBatch:
    """The atoms of a file's first model that meet the conditions."""
    line = pa.array(re.split("\r?\n", text), pa.string())
    at = pa.array(range(len(line)), pa.int32())
    cut = lambda a, b: pc.utf8_trim(pc.utf8_slice_codeunits(line, a - 1, b), " ")
    record = cut(1, 6)
    end = pc.index(record, "ENDMDL").as_py()
    use = pc.is_in(record, pa.array(["ATOM", "HETATM"]))
    if end >= 0:
        use = pc.and_(use, pc.less(at, end))
    line, at = line.filter(use), at.filter(use)
    text_columns = lambda: {"record": cut(1, 6), "atom": cut(13, 16), "resname": cut(18, 20), "chain": cut(22, 22), "resseq": number(cut(23, 26), pa.int32())}
    mask = kept(only, text_columns())
    if mask is not None:
        line, at = line.filter(mask), at.filter(mask)
    some, real = text_columns(), lambda a, b: number(cut(a, b), pa.float64())
    columns = {
        S: pa.array([name] * len(line), pa.string()), "line_no": at, "record": some["record"], "serial": number(cut(7, 11), pa.int32()), "atom": some["atom"], "altloc": cut(17, 17), "resname": some["resname"],
        "chain": some["chain"], "resseq": some["resseq"], "icode": cut(27, 27), "x": real(31, 38), "y": real(39, 46), "z": real(47, 54), "occupancy": pc.coalesce(real(55, 60), pa.scalar(0.0)), "bfactor": real(61, 66), "line": line,
    }
    return pa.RecordBatch.from_pydict(columns)


def read_files(path: str, part: Files, only: dict[str, list]) -> Iterator[pa.RecordBatch]:
    system, _ = opened(path)
    for p in part.paths:
        with system.open_input_stream(p) as f:
            text = f.read().decode("utf-8", "replace")
        yield atoms_of(named(p), text, only)


class StructureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most, self.only = options["path"], int(options.get("together", TOGETHER)), json.loads(options.get("only", "{}"))
        unknown = sorted(set(self.only) - set(CHOSEN))
        if unknown:
            raise ValueError(f"no condition on {unknown[0]}: only on {', '.join(CHOSEN)}")

    def chosen(self, files: list[fs.FileInfo]) -> list[Files]:
        mask = kept(self.only, {S: pa.array([named(f.path) for f in files], pa.string())})
        return together(files if mask is None else [f for f, use in zip(files, mask.to_pylist(), strict=True) if use], self.most)

    def partitions(self) -> list[Files]:
        return self.chosen(found(self.path))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(self.path, partition, self.only)


class StructureStream(StructureReader, DataSourceStreamReader):
    """Offsets are times of change, in nanoseconds: files should be moved into the folder whole."""

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": max((f.mtime_ns for f in found(self.path)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.chosen([f for f in found(self.path) if start["until"] < f.mtime_ns <= end["until"]])


class StructureFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "structure_files"

    def schema(self) -> str:
        return ATOMS

    def reader(self, schema: StructType) -> DataSourceReader:
        return StructureReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StructureStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    targets: list[str]


class TargetWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.folder = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        """Rows come in order of (structure_id, part), so one file is open at a time."""
        system, base = opened(self.path)
        folder = f"{base}/{self.folder}/{uuid.uuid4().hex}"  # of its own for each attempt of a task
        targets, open_part, out = [], None, None
        try:
            for r in iterator:
                target, part = quote(r[S], safe=""), quote(r["part"], safe="")
                if (target, part) != open_part:
                    if out:
                        out.close()
                    if not targets or targets[-1] != target:
                        targets.append(target)
                        system.create_dir(f"{folder}/{target}", recursive=True)
                    out, open_part = system.open_output_stream(f"{folder}/{target}/{part}"), (target, part)
                out.write(r["line"].encode() + b"\n")
        finally:
            if out:
                out.close()
        return Written(folder, targets)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = opened(self.path)
        places = [(t, m.folder) for m in messages if m for t in m.targets]
        names = [t for t, _ in places]
        there = {t for t in names if system.get_file_info(f"{base}/{t}").type != fs.FileType.NotFound}
        if len(set(names)) < len(names) or (there and not self.overwrite):
            self.abort(messages)
            raise ValueError("a target is there already" if there and not self.overwrite else "a target's rows came in several tasks: use save_targets")
        for t, folder in places:
            if t in there:
                system.create_dir(f"{base}/{self.folder}/replaced", recursive=True)
                system.move(f"{base}/{t}", f"{base}/{self.folder}/replaced/{t}")
            system.move(f"{folder}/{t}", f"{base}/{t}")
        self.abort(messages)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        """Only what this write made is removed."""
        system, base = opened(self.path)
        if system.get_file_info(f"{base}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.folder}")


class TargetFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "target_folders"

    def schema(self) -> str:
        return f"{S} string, part string, pos long, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TargetWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known."""
    for source in (StructureFiles, TargetFolders):
        spark.dataSource.register(source)


def read_structures(spark: SparkSession, path: str, together: int = TOGETHER, only: dict[str, list] | None = None) -> DataFrame:
    """Atoms of all files at a path, as `structures.read_atoms` gives them; of those that meet all conditions."""
    register(spark)
    return spark.read.format("structure_files").option("together", together).option("only", json.dumps(only or {})).load(path)


def save_targets(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """Writes (structure_id, part, pos, line): a folder for each structure, whole or not at all. Null lines are left out; a
    structure's rows meet in one task, which holds one line at a time."""
    register(rows.sparkSession)
    one = rows.filter(f"{S} IS NOT NULL AND part IS NOT NULL AND line IS NOT NULL").select(F.col(S), "part", F.col("pos").cast("long").alias("pos"), "line")
    one.repartition(S).sortWithinPartitions(S, "part", "pos", "line").write.format("target_folders").mode("overwrite" if overwrite else "append").save(path)
