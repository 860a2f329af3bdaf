"""ZIP archives of tables: members are splits, inflated as streams; and Darwin Core archives, read by their own description."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from arborlens.workspace import materialize


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path if ":/" in path else f"file://{path}"))


def write_zip(lines: DataFrame, path: str, constants: dict[str, str] | None = None) -> None:
    """(archive, member, place, line) -> a ZIP file for each archive in path, members in order and their lines by place; each
    archive also gets `constants` (name: text). A task streams its archives; a file that is not whole has no directory."""
    rows = lines.select("archive", "member", "place", "line").repartition("archive").sortWithinPartitions("archive", "member", "place")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(path)
        fs.create_dir(root, recursive=True)
        now, out, box, member, name = None, None, None, None, None

        def close() -> pa.RecordBatch:
            member.close()
            for k, text in (constants or {}).items():
                box.writestr(k, text)
            box.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{now}.zip"])], names=["file"])

        for b in batches:
            for archive, of, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if archive != now:
                    if box is not None:
                        yield close()
                    now, name = archive, None
                    out = fs.open_output_stream(f"{root}/{archive}.zip")
                    box = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if of != name:
                    if name is not None:
                        member.close()
                    name, member = of, box.open(of, "w", force_zip64=True)
                member.write(f"{line}\n".encode())
        if box is not None:
            yield close()

    materialize(rows.mapInArrow(kernel, "file string"), "archives")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, size (inflated) of every file in the archives, from their directories at the end."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                fs, name = _store(p)
                with fs.open_input_file(name) as f, zipfile.ZipFile(f) as box:
                    own = [i for i in box.infolist() if not i.is_dir()]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(own), pa.string()), pa.array([i.filename for i in own], pa.string()), pa.array([i.file_size for i in own], pa.int64())], names=["archive", "member", "size"])

    return files.mapInArrow(kernel, "archive string, member string, size long")


def zip_table(
    spark: SparkSession, path: str, schema: str, member: str = ".*", sep: str = "\t", quote: str | None = None, header: bool = True, names: list[str] | None = None,
    skip: int = 0, bytes_a_task: int = 64 << 20,
) -> DataFrame:
    """The columns in schema of delimited members whose name matches `member`, with archive, member and place (0, 1, ... inside
    the member).

    Columns are found by the names of the header, or by `names`; a column that a member lacks is null, as are values that
    do not fit their type; members without a line give no row. With a quote, line ends and separators inside quotes
    belong to the value. A member is inflated as a stream by one task, in constant memory; small ones share tasks.
    """
    wanted: StructType = _parse_datatype_string(schema)
    fields = [f.name for f in wanted]
    parts = materialize(zip_members(spark, path).where(F.col("member").rlike(f"^(?:{member})$")), "members")
    total = parts.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-total // bytes_a_task))
    out = "archive string, member string, place long" + "".join(f", `{n}` string" for n in fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        options = {"delimiter": sep, "quotechar": quote, "doublequote": True} if quote else {"delimiter": sep, "quoting": csv.QUOTE_NONE}

        def pack(archive: str, name: str, first: int, rows: list[list[str]], at: list[int | None]) -> pa.RecordBatch:
            n = len(rows)
            columns = [pa.array([archive] * n), pa.array([name] * n), pa.array(range(first, first + n), pa.int64())]
            columns += [pa.array([r[k] if k is not None and k < len(r) and r[k] != "" else None for r in rows], pa.string()) for k in at]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "member", "place", *fields])

        for b in batches:
            for archive, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, file = _store(archive)
                with fs.open_input_file(file) as f, zipfile.ZipFile(f) as box, box.open(name) as raw:
                    rows = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), **options)
                    for _ in range(skip):
                        next(rows, None)
                    head = next(rows, None) if header else names
                    if head is None:
                        continue
                    at = [head.index(n) if n in head else None for n in fields]
                    held, first = [], 0
                    for row in rows:
                        if row:
                            held.append(row)
                        if len(held) == 4096:
                            yield pack(archive, name, first, held, at)
                            held, first = [], first + 4096
                    if held:
                        yield pack(archive, name, first, held, at)

    rows = parts.repartition(int(tasks), "archive", "member").mapInArrow(kernel, out)
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted]
    return rows.select("archive", "member", "place", *typed)


def archive_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a Darwin Core archive (a ZIP file, or several of one description) by the last part of their row type;
    the core is also "core". Files, separators, quotes, header lines, the id and the terms of columns follow meta.xml;
    each table has id, archive, member, place and a text column for each term."""
    rows = zip_table(spark, path, "line string", r"(?:.*/)?meta\.xml", sep="\x01", header=False, names=["line"])
    first = rows.agg(F.min("archive")).first()[0]
    text = "\n".join(r["line"] or "" for r in rows.where(F.col("archive") == first).orderBy("place").collect())  # one small file
    plain = lambda s: (s or "").encode().decode("unicode_escape")
    tables = {}
    for part in ElementTree.fromstring(text):
        kind = part.tag.rpartition("}")[2]
        if kind not in ("core", "extension"):
            continue
        inner = {e.tag.rpartition("}")[2]: e for e in part}
        files = [e.text.strip() for e in inner["files"] if e.text]
        columns = {int(inner["id" if kind == "core" else "coreid"].get("index")): "id"}
        columns |= {int(e.get("index")): e.get("term").rpartition("/")[2] for e in part if e.tag.endswith("field") and e.get("index") is not None}
        names = [columns.get(k, f"_{k}") for k in range(max(columns) + 1)]
        schema = ", ".join(f"`{n}` string" for n in dict.fromkeys(columns.values()))
        table = zip_table(
            spark, path, schema, "|".join(f"(?:.*/)?{re.escape(f)}" for f in files), plain(part.get("fieldsTerminatedBy", ",")) or ",", plain(part.get("fieldsEnclosedBy")) or None,
            header=False, names=names, skip=int(part.get("ignoreHeaderLines") or 0),
        )
        tables[part.get("rowType", kind).rpartition("/")[2]] = table
        if kind == "core":
            tables["core"] = table
    return tables
