"""Scan of binaries: hash, size and what an ELF file says of itself. Files are read whole,
one to a row; headers and section tables are parsed where the file is."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import whole_files

# The format's names for types and machines.
TYPES = {1: "REL", 2: "EXEC", 3: "DYN", 4: "CORE"}
MACHINES = {3: "x86", 40: "arm", 62: "x86_64", 183: "aarch64", 243: "riscv"}
BUILD_ID_NOTE = ".note.gnu.build-id"


def parse_elf(content: bytes) -> dict | None:
    """type, arch, sections, build_id and has_debug of an ELF file of any width and byte
    order; None for other files. A table that lies outside the file counts as none."""
    if content[:4] != b"\x7fELF" or len(content) < 52 or content[4] not in (1, 2) or content[5] not in (1, 2):
        return None
    wide, order = content[4] == 2, "<" if content[5] == 1 else ">"
    kind, machine = struct.unpack_from(f"{order}HH", content, 16)
    table = struct.unpack_from(f"{order}Q", content, 40)[0] if wide else struct.unpack_from(f"{order}I", content, 32)[0]
    size, count, names_at = struct.unpack_from(f"{order}HHH", content, 58 if wide else 46)
    # name, (type, flags, address) skipped, offset, length
    layout, need = (f"{order}I4x8x8xQQ", 40) if wide else (f"{order}I4x4x4xII", 24)
    heads = []
    if table and size >= need and table + size * count <= len(content):
        heads = [struct.unpack_from(layout, content, table + n * size) for n in range(count)]
    named = {}
    if names_at < len(heads):
        _, start, length = heads[names_at]
        strings = content[start : start + length]
        for name, at, n in heads:
            if label := strings[name : max(name, strings.find(b"\0", name))].decode("utf-8", "replace"):
                named[label] = content[at : at + n]
    note, build_id = named.get(BUILD_ID_NOTE, b""), None
    if len(note) >= 12:
        owner, desc = struct.unpack_from(f"{order}II", note)
        build_id = note[12 + -(-owner // 4) * 4 :][:desc].hex()
    return {"type": TYPES.get(kind, "NONE"), "arch": MACHINES.get(machine, str(machine)), "sections": sorted(named), "build_id": build_id, "has_debug": any(s.startswith(".debug_") for s in named)}


def scan_binaries(spark: SparkSession, path: str) -> DataFrame:
    """file, size, sha256 and elf (struct, null for files that are none), one row per file that
    has any byte."""
    rows = whole_files(spark, path).filter("size > 0").select("file", "size", F.sha2("content", 256).alias("sha256"), "content")
    item = pa.struct([("type", pa.string()), ("arch", pa.string()), ("sections", pa.list_(pa.string())), ("build_id", pa.string()), ("has_debug", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([parse_elf(c) for c in b.column(3).to_pylist()], item)], names=["file", "size", "sha256", "elf"])

    return rows.mapInArrow(run, "file string, size bigint, sha256 string, elf struct<type: string, arch: string, sections: array<string>, build_id: string, has_debug: boolean>")
