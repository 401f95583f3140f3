"""Debug information as tables: a data source over ELF files with compile units, functions
and line rows.

    spark.dataSource.register(DebugInfo)
    spark.read.format("debug_info").option("table", "functions").load(folder)

Tables and their columns are in ``SCHEMAS``. The folder's files are cut into slices of
``sliceBytes`` of the unit section; a task walks the unit headers, a few bytes each, and
decodes the units that begin in its slice, so a binary of any size is read by many
tasks, and the driver reads none of it. Files are opened through Arrow's file
systems, by any URI that these know.

A function's ranges are merged where they overlap or touch. Its end is an address or a size,
as its form says, or it has a range list. Line tables of the versions 2 to 5 are
replayed; rows that end a sequence are no source lines. Files that are no ELF file or have
no debug information give no rows. A unit that cannot be decoded is a row of ``units`` with
null in all columns after its offset, and has no functions; a broken line table or range
list has no rows; a string outside its section is null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "units": "file string, unit_offset bigint, version int, name string, comp_dir string, language bigint, n_functions bigint, n_lines bigint",
    "functions": "file string, unit_offset bigint, function_id string, name string, linkage_name string, is_declaration boolean, is_external boolean, is_inlined boolean, decl_file string, decl_line bigint, decl_column bigint, ranges array<struct<lo: bigint, hi: bigint>>",
    "lines": "file string, unit_offset bigint, address bigint, path string, line bigint, is_stmt boolean",
}
SLICE_BYTES = 16 << 20
#: Partitions of a read at most.
PARTITIONS = 2000

# Numbers of the format.
SUBPROGRAM = 0x2E
NAME, STMT_LIST, LOW_PC, HIGH_PC, LANGUAGE, COMP_DIR, INLINE = 0x03, 0x10, 0x11, 0x12, 0x13, 0x1B, 0x20
DECL_COLUMN, DECL_FILE, DECL_LINE, DECLARATION, EXTERNAL, RANGES, LINKAGE_NAME = 0x39, 0x3A, 0x3B, 0x3C, 0x3F, 0x55, 0x6E
STR_OFFSETS_BASE, ADDR_BASE, RNGLISTS_BASE, OLD_LINKAGE_NAME = 0x72, 0x73, 0x74, 0x2007
ADDRESS_FORM, IMPLICIT_FORM, INDIRECT_FORM, PRESENT_FORM = 0x01, 0x21, 0x16, 0x19
#: Bytes of forms of one size.
FIXED = {0x0B: 1, 0x05: 2, 0x06: 4, 0x07: 8, 0x0C: 1, 0x11: 1, 0x12: 2, 0x13: 4, 0x14: 8, 0x1C: 4, 0x20: 8, 0x24: 8, 0x25: 1, 0x26: 2, 0x27: 3, 0x28: 4, 0x29: 1, 0x2A: 2, 0x2B: 3, 0x2C: 4}
UNSIGNED_LEB = (0x0F, 0x15, 0x1A, 0x1B, 0x22, 0x23)
#: Forms of an offset, and blocks by the bytes of their length.
OFFSETS, BLOCKS = (0x0E, 0x10, 0x17, 0x1D, 0x1F), {0x0A: 1, 0x03: 2, 0x04: 4}
STRING_OFFSETS = {0x0E: ".debug_str", 0x1F: ".debug_line_str"}
STRING_INDEXES, ADDRESS_INDEXES, RANGE_INDEX = (0x1A, 0x25, 0x26, 0x27, 0x28), (0x1B, 0x29, 0x2A, 0x2B, 0x2C), 0x23


class Broken(Exception):
    """Bytes that do not follow the format."""


class Cursor:
    def __init__(self, data: bytes, at: int = 0, order: str = "little", wide: bool = False, end: int | None = None):
        self.data, self.at, self.order, self.wide = data, at, order, wide
        self.end = len(data) if end is None else min(end, len(data))

    def take(self, n: int) -> bytes:
        if not 0 <= self.at <= self.at + n <= self.end:
            raise Broken
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(n), self.order, signed=signed)

    def leb(self, signed: bool = False) -> int:
        value = shift = 0
        while True:
            b = self.number(1)
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value - (1 << shift) if signed and b & 64 else value

    def text(self) -> str:
        z = self.data.find(b"\0", self.at, self.end)
        if z < 0:
            raise Broken
        return self.take(z + 1 - self.at)[:-1].decode("utf-8", "replace")

    def length(self) -> int:
        """A unit's length; it says whether offsets have eight bytes."""
        n = self.number(4)
        self.wide = n == 0xFFFFFFFF
        return self.number(8) if self.wide else n

    def offset(self) -> int:
        return self.number(8 if self.wide else 4)


class Binary:
    """An ELF file's sections, read when they are asked for."""

    def __init__(self, source: pa.NativeFile, size: int):
        self.source, self.size, self.held = source, size, {}
        head = source.read_at(min(64, size), 0)
        if head[:4] != b"\x7fELF" or len(head) < 52 or head[4] not in (1, 2) or head[5] not in (1, 2):
            raise Broken
        self.order, wide = "little" if head[5] == 1 else "big", head[4] == 2
        self.address_bytes = 8 if wide else 4
        mark = "<" if self.order == "little" else ">"
        table = struct.unpack_from(mark + ("Q" if wide else "I"), head, 40 if wide else 32)[0]
        entry, count, names = struct.unpack_from(f"{mark}HHH", head, 58 if wide else 46) if len(head) >= (64 if wide else 52) else (0, 0, 0)
        layout = f"{mark}IIQQQQ" if wide else f"{mark}IIIIII"
        if not table or entry < struct.calcsize(layout) or table + entry * count > size or names >= count:
            raise Broken
        raw = source.read_at(entry * count, table)
        heads = [struct.unpack_from(layout, raw, n * entry) for n in range(count)]
        labels = source.read_at(heads[names][5], heads[names][4])
        self.places = {labels[h[0] : max(h[0], labels.find(b"\0", h[0]))].decode("utf-8", "replace"): (h[4], min(h[5], max(0, size - h[4])), h[2]) for h in heads}

    def part(self, name: str, at: int, n: int) -> bytes:
        """Bytes of a section; a compressed one is held whole."""
        begin, size, flags = self.places.get(name, (0, 0, 0))
        if flags & 0x800:
            return self.section(name)[at : at + n]
        return self.source.read_at(max(0, min(n, size - at)), begin + at) if at < size else b""

    def bytes_of(self, name: str) -> int:
        begin, size, flags = self.places.get(name, (0, 0, 0))
        return len(self.section(name)) if flags & 0x800 else size

    def section(self, name: str) -> bytes:
        if name not in self.held:
            begin, size, flags = self.places.get(name, (0, 0, 0))
            raw = self.source.read_at(size, begin) if size else b""
            if flags & 0x800:  # packed, behind a head
                try:
                    raw = zlib.decompress(raw[24 if self.address_bytes == 8 else 12 :])
                except zlib.error:
                    raw = b""
            self.held[name] = raw
        return self.held[name]

    def string(self, name: str, at: int) -> str | None:
        data = self.section(name)
        z = data.find(b"\0", at) if 0 <= at < len(data) else -1
        return data[at:z].decode("utf-8", "replace") if z >= 0 else None


def unit_heads(binary: Binary, first: int, last: int) -> Iterator[tuple[int, int]]:
    """(offset, end) of the units that begin in a stretch of the section."""
    at, size = 0, binary.bytes_of(".debug_info")
    while at < min(last, size):
        c = Cursor(binary.part(".debug_info", at, 12), order=binary.order)
        try:
            n = c.length()
        except Broken:
            return
        end = at + c.at + n
        if at >= first:
            yield at, end
        if n == 0 or end > size:
            return
        at = end


class Unit:
    """A compile unit: its head, and its entries once they are walked."""

    def __init__(self, binary: Binary, offset: int, end: int):
        self.binary, self.offset = binary, offset
        if end > binary.bytes_of(".debug_info"):
            raise Broken
        c = self.cursor = Cursor(binary.part(".debug_info", offset, end - offset), order=binary.order)
        c.length()
        self.version = c.number(2)
        if not 2 <= self.version <= 5:
            raise Broken
        if self.version == 5:
            kind, self.address_bytes, abbreviations = c.number(1), c.number(1), c.offset()
            if kind in (4, 5):
                c.take(8)
            elif kind in (2, 6):
                c.take(8 + (8 if c.wide else 4))
        else:
            abbreviations, self.address_bytes = c.offset(), c.number(1)
        self.codes = self._codes(abbreviations)
        self.functions: list[tuple[int, dict]] = []
        self.root: dict = {}
        for n, (at, tag, values) in enumerate(self._entries()):
            if n == 0:
                self.root = values
            if tag == SUBPROGRAM:
                self.functions.append((offset + at, values))

    def _codes(self, at: int) -> dict[int, tuple[int, list[tuple[int, int, int]]]]:
        c, codes = Cursor(self.binary.section(".debug_abbrev"), at, self.binary.order), {}
        while code := c.leb():
            tag, _, forms = c.leb(), c.number(1), []
            while True:
                name, form = c.leb(), c.leb()
                fixed = c.leb(signed=True) if form == IMPLICIT_FORM else 0
                if not name and not form:
                    break
                forms.append((name, form, fixed))
            codes[code] = tag, forms
        return codes

    def _entries(self) -> Iterator[tuple[int, int, dict[int, tuple[int, object]]]]:
        c = self.cursor
        while c.at < c.end:
            at, code = c.at, c.leb()
            if not code:
                continue
            if code not in self.codes:
                raise Broken
            tag, forms = self.codes[code]
            yield at, tag, {name: self._value(form, fixed) for name, form, fixed in forms}

    def _value(self, form: int, fixed: int = 0) -> tuple[int, object]:
        """(form, raw value) of the attribute at the cursor."""
        c = self.cursor
        if form == INDIRECT_FORM:
            return self._value(c.leb())
        if form in FIXED:
            return form, c.number(FIXED[form])
        if form in OFFSETS:
            return form, c.number(self.address_bytes) if form == 0x10 and self.version == 2 else c.offset()
        if form in UNSIGNED_LEB:
            return form, c.leb()
        if form == ADDRESS_FORM:
            return form, c.number(self.address_bytes)
        if form == 0x08:
            return form, c.text()
        if form == 0x0D:
            return form, c.leb(signed=True)
        if form in (0x09, 0x18):
            return form, c.take(c.leb())
        if form in BLOCKS:
            return form, c.take(c.number(BLOCKS[form]))
        if form in (PRESENT_FORM, IMPLICIT_FORM):
            return form, 1 if form == PRESENT_FORM else fixed
        if form == 0x1E:
            return form, c.take(16)
        raise Broken

    def _indexed(self, section: str, base: int, index: int, n: int) -> int:
        at = self.root.get(base, (0, 16 if self.cursor.wide else 8))[1] + index * n
        return Cursor(self.binary.section(section), at, self.binary.order).number(n)

    def text(self, values: dict, name: int) -> str | None:
        form, value = values.get(name, (0, None))
        if form in STRING_INDEXES:
            try:
                form, value = 0x0E, self._indexed(".debug_str_offsets", STR_OFFSETS_BASE, value, 8 if self.cursor.wide else 4)
            except Broken:
                return None
        return self.binary.string(STRING_OFFSETS[form], value) if form in STRING_OFFSETS else value if isinstance(value, str) else None

    def number(self, values: dict, name: int) -> int | None:
        value = values.get(name, (0, None))[1]
        return value if isinstance(value, int) else None

    def address(self, values: dict, name: int) -> int | None:
        form, value = values.get(name, (0, None))
        return self._indexed(".debug_addr", ADDR_BASE, value, self.address_bytes) if form in ADDRESS_INDEXES else value

    def ranges(self, values: dict) -> list[tuple[int, int]]:
        """A function's [lo, hi), merged; none without an end or with a broken list."""
        try:
            if LOW_PC in values:
                low, end = self.address(values, LOW_PC), self.address(values, HIGH_PC)
                if end is None:
                    return []
                absolute = values[HIGH_PC][0] == ADDRESS_FORM or values[HIGH_PC][0] in ADDRESS_INDEXES
                found = [(low, end if absolute else low + end)]
            elif RANGES in values:
                found = self._new_list(*values[RANGES]) if self.version >= 5 else self._old_list(values[RANGES][1])
            else:
                return []
        except Broken:
            return []
        merged: list[tuple[int, int]] = []
        for low, high in sorted(r for r in found if r[1] > r[0]):
            if merged and low <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(merged[-1][1], high)
            else:
                merged.append((low, high))
        return merged

    def _old_list(self, at: int) -> list[tuple[int, int]]:
        n, base, out = self.address_bytes, self.address(self.root, LOW_PC) or 0, []
        c, selects = Cursor(self.binary.section(".debug_ranges"), at, self.binary.order), (1 << 8 * n) - 1
        while (pair := (c.number(n), c.number(n))) != (0, 0):
            if pair[0] == selects:
                base = pair[1]
            else:
                out.append((base + pair[0], base + pair[1]))
        return out

    def _new_list(self, form: int, at: int) -> list[tuple[int, int]]:
        n, base, out = self.address_bytes, self.address(self.root, LOW_PC) or 0, []
        start = self.root.get(RNGLISTS_BASE, (0, 20 if self.cursor.wide else 12))[1]
        if form == RANGE_INDEX:
            at = start + self._indexed(".debug_rnglists", RNGLISTS_BASE, at, 8 if self.cursor.wide else 4)
        c = Cursor(self.binary.section(".debug_rnglists"), at, self.binary.order)
        listed = lambda: self._indexed(".debug_addr", ADDR_BASE, c.leb(), n)
        while kind := c.number(1):
            if kind in (1, 5):  # a new base
                base = listed() if kind == 1 else c.number(n)
            elif kind == 2:
                out.append((listed(), listed()))
            elif kind in (3, 7):  # a start and a size
                low = listed() if kind == 3 else c.number(n)
                out.append((low, low + c.leb()))
            elif kind == 4:
                out.append((base + c.leb(), base + c.leb()))
            elif kind == 6:
                out.append((c.number(n), c.number(n)))
            else:
                raise Broken
        return out

    @cached_property
    def table(self) -> LineTable | None:
        at = self.number(self.root, STMT_LIST)
        try:
            return LineTable(self, at) if at is not None else None
        except Broken:
            return None

    def rows(self) -> list[tuple[int, int, int, bool]]:
        try:
            return list(self.table.rows()) if self.table else []
        except Broken:
            return []


class LineTable:
    """The head of a unit's line table, and its program."""

    def __init__(self, unit: Unit, at: int):
        self.unit, binary = unit, unit.binary
        c = self.cursor = Cursor(binary.section(".debug_line"), at, binary.order)
        c.end = min(c.end, c.length() + c.at)
        self.version = c.number(2)
        if not 2 <= self.version <= 5:
            raise Broken
        if self.version == 5:
            c.take(2)
        size = c.offset()
        program = c.at + size
        self.step = c.number(1)
        if self.version >= 4:
            c.take(1)
        self.is_stmt, self.line_base, self.line_range, opcodes = bool(c.number(1)), c.number(1, signed=True), c.number(1), c.number(1)
        if not self.line_range:
            raise Broken
        self.operands = [0, *(c.number(1) for _ in range(opcodes - 1))]
        if self.version == 5:
            self.dirs, self.files = [d[0] for d in self._listed()], self._listed()
        else:
            self.dirs, self.files = [], []
            while name := c.text():
                self.dirs.append(name)
            while name := c.text():
                self.files.append((name, c.leb()))
                c.leb(), c.leb()
        c.at = program

    def _listed(self) -> list[tuple[str | None, int]]:
        """(path, folder) of each entry."""
        c = self.cursor
        kinds = [(c.leb(), c.leb()) for _ in range(c.number(1))]
        out = []
        for _ in range(c.leb()):
            path, folder = None, 0
            for kind, form in kinds:
                self.unit.cursor, kept = c, self.unit.cursor
                try:
                    form, value = self.unit._value(form)
                finally:
                    self.unit.cursor = kept
                if kind == 1:
                    path = self.unit.text({NAME: (form, value)}, NAME)
                elif kind == 2:
                    folder = value
            out.append((path, folder))
        return out

    def path(self, index: int) -> str | None:
        """A file's path. Old tables count from 1, and folder 0 is the unit's own."""
        shift = 0 if self.version >= 5 else 1
        if not 0 <= index - shift < len(self.files):
            return None
        name, folder = self.files[index - shift]
        home = self.unit.text(self.unit.root, COMP_DIR)
        at = folder - shift
        for d in (self.dirs[at] if folder > 0 and 0 <= at < len(self.dirs) else None, home):
            if d and name is not None and not name.startswith("/"):
                name = f"{d.rstrip('/')}/{name}"
        return name

    def rows(self) -> Iterator[tuple[int, int, int, bool]]:
        """(address, file, line, is_stmt), the ends of sequences left out."""
        c = Cursor(self.cursor.data, self.cursor.at, self.cursor.order, end=self.cursor.end)
        fresh = lambda: [0, 1, 1, self.is_stmt]
        state, base = fresh(), len(self.operands)
        while c.at < c.end:
            op = c.number(1)
            if op >= base:
                state[0] += (op - base) // self.line_range * self.step
                state[2] += self.line_base + (op - base) % self.line_range
                yield tuple(state)
            elif op == 0:
                size = c.leb()
                after, kind = c.at + size, c.number(1)
                if kind == 1:
                    state = fresh()
                elif kind == 2:
                    state[0] = c.number(size - 1)
                c.at = after
            elif op == 1:
                yield tuple(state)
            elif op == 2:
                state[0] += c.leb() * self.step
            elif op == 3:
                state[2] += c.leb(signed=True)
            elif op == 4:
                state[1] = c.leb()
            elif op == 6:
                state[3] = not state[3]
            elif op == 8:
                state[0] += (255 - base) // self.line_range * self.step
            elif op == 9:
                state[0] += c.number(2)
            else:
                for _ in range(self.operands[op]):
                    c.leb()


def _signed(value: int | None) -> int | None:
    """Into the 64 bits of the column."""
    return value if value is None or value < 1 << 63 else value - (1 << 64)


def unit_rows(binary: Binary, table: str, offset: int, end: int) -> Iterator[tuple]:
    """A unit's rows of a table, without the file."""
    try:
        u = Unit(binary, offset, end)
        if table == "units":
            yield offset, u.version, u.text(u.root, NAME), u.text(u.root, COMP_DIR), u.number(u.root, LANGUAGE), len(u.functions), len(u.rows())
        elif table == "lines":
            names: dict[int, str | None] = {}
            for address, file, line, stmt in u.rows():
                if file not in names:
                    names[file] = u.table.path(file) or f"<unknown file {file}>"
                yield offset, _signed(address), names[file], line, stmt
        else:
            for at, v in u.functions:
                declared = bool(u.number(v, DECLARATION))
                file = u.number(v, DECL_FILE)
                ranges = [] if declared else u.ranges(v)
                yield (
                    offset, f"cu{offset:#x}:die{at:#x}", u.text(v, NAME), u.text(v, LINKAGE_NAME) or u.text(v, OLD_LINKAGE_NAME), declared, bool(u.number(v, EXTERNAL)), INLINE in v,
                    u.table.path(file) if file is not None and u.table else None, u.number(v, DECL_LINE), u.number(v, DECL_COLUMN), [{"lo": _signed(a), "hi": _signed(z)} for a, z in ranges],
                )
    except Broken:
        if table == "units":
            yield offset, None, None, None, None, None, None


@dataclass
class Slice:
    path: str
    name: str
    first: int
    last: int


class Slices(InputPartition):
    def __init__(self, slices: list[Slice]):
        self.slices = slices


class DebugInfo(DataSource):
    """Format ``debug_info``; options: path (a file or a folder, with all below it), table,
    sliceBytes."""

    @classmethod
    def name(cls) -> str:
        return "debug_info"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "functions")]

    def reader(self, schema) -> DebugReader:
        return DebugReader(self.options)


class DebugReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.table, self.step = options["path"], options.get("table", "functions"), int(options.get("sliceBytes", SLICE_BYTES))

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")

    def partitions(self) -> list[Slices]:
        system, path = self._files()
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._")
        # a unit section is no longer than its file; of more slices than PARTITIONS, runs go to one task, as one slice of a file
        total = sum(-(-max(size, 1) // self.step) for _, _, size in files)
        most, out, room = max(1, -(-total // PARTITIONS)), [], 0
        for p, name, size in files:
            at = 0
            while at < max(size, 1):
                if not room:
                    out.append(Slices([]))
                    room = most
                n = min(room, -(-(max(size, 1) - at) // self.step))
                out[-1].slices.append(Slice(p, name, at, at + n * self.step))
                at, room = at + n * self.step, room - n
        return out

    def read(self, partition: Slices) -> Iterator[tuple]:
        for part in partition.slices:
            yield from self._read(part)

    def _read(self, part: Slice) -> Iterator[tuple]:
        system, _ = self._files()
        with system.open_input_file(part.path) as source:
            try:
                binary = Binary(source, source.size())
            except (Broken, struct.error):
                return
            for offset, end in unit_heads(binary, part.first, part.last):
                for row in unit_rows(binary, self.table, offset, end):
                    yield (part.name, *row)
