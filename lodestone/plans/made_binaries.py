"""Binaries with debug information made from the parts, for the queries that read them:
500 parts a file, 25 a unit, one function each."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE, UNIT, BASE = 500, 25, 0x400000


def _leb(n: int, signed: bool = False) -> bytes:
    out = bytearray()
    while True:
        low, n = n & 127, n >> 7
        if n == (-(low >> 6) if signed else 0):
            return bytes([*out, low])
        out.append(low | 128)


def _abbreviations(version: int) -> bytes:
    """1 the unit; 2 to 5 functions by end address, by size, by range list, declared only."""
    offset, flag = (0x17, 0x19) if version >= 4 else (0x06, 0x0C)
    name, home = (0x1A, 0x1F) if version == 5 else (0x0E, 0x08)
    base = [(0x72, 0x17)] if version == 5 else []
    seen = [(0x03, name), (0x3A, 0x0F), (0x3B, 0x05)]
    units = [
        (0x11, 1, [*base, (0x03, 0x08), (0x1B, home), (0x13, 0x0B), (0x10, offset), (0x11, 0x01)]),
        (0x2E, 0, [*seen, (0x3F, flag), (0x11, 0x01), (0x12, 0x01)]),
        (0x2E, 0, [*seen, (0x6E, 0x08), (0x11, 0x01), (0x12, 0x06 if version < 3 else 0x0F)]),
        (0x2E, 0, [*seen, (0x40, 0x0A), (0x55, offset)]),
        (0x2E, 0, [*seen, (0x3C, flag)]),
    ]
    out = b""
    for code, (tag, children, forms) in enumerate(units, 1):
        out += _leb(code) + _leb(tag) + bytes([children]) + b"".join(_leb(a) + _leb(f) for a, f in forms) + b"\0\0"
    return out + b"\0"


def make(parts: pd.DataFrame, bad: int | None = None) -> bytes:
    """An ELF file; every fifth unit (or the one named) has the abbreviations of none."""
    parts = parts.sort_values("p_partkey")
    number = int(parts["p_partkey"].iloc[0]) // FILE
    mark = "<" if number % 2 == 0 else ">"
    pack = lambda f, *v: struct.pack(mark + f, *v)
    abbreviations, strings, lists, new_lists, line_strings, infos, tables, offsets = b"", b"\0", b"", b"", b"/five\0", b"", b"", b""
    places = {}
    for version in (2, 3, 4, 5):
        places[version] = len(abbreviations)
        abbreviations += _abbreviations(version)
    for unit, rows in parts.groupby(parts["p_partkey"] // UNIT):
        version = 2 + int(unit) % 4
        # the line table
        program, last = b"", None
        for key, size in zip(rows["p_partkey"].tolist(), rows["p_size"].tolist(), strict=True):
            low = BASE + key % FILE * 64
            program += b"\0\x09\x02" + pack("Q", low) + b"\x03" + _leb(size - 1, True) + b"\x04" + _leb((0 if version == 5 else 1) + size % 2)
            for n in range(size % 4 + 1):  # four bytes and a line further each time
                program += b"\x01" if n == 0 else bytes([13 + 4 * 14 + 1 - (-5)])
            program += b"\x02\x08\0\x01\x01"
        steps = bytes([1]) + (b"\x01" if version >= 4 else b"") + b"\x01" + struct.pack("b", -5) + bytes([14, 13, 0, 1, 1, 1, 1, 0, 0, 0, 1, 0, 0, 1])
        if version == 5:
            steps += b"\x01\x01\x1f" + _leb(2) + pack("I", 0) + pack("I", 0) + b"\x02\x01\x08\x02\x0b" + _leb(2) + b"main.c\0\0" + b"part.h\0\x01"
        else:
            steps += b"inc\0\0" + b"main.c\0\0\0\0" + b"part.h\0\x01\0\0" + b"\0"
        body = pack("H", version) + (b"\x08\0" if version == 5 else b"") + pack("I", len(steps)) + steps + program
        at_table = len(tables)
        tables += pack("I", len(body)) + body
        # the entries
        home = pack("I", 0) if version == 5 else b"/home\0"
        slots: list[int] = []
        entries = _leb(1) + (pack("I", len(offsets) + 8) if version == 5 else b"") + f"unit{unit}.c\0".encode() + home + b"\x0c" + pack("I", at_table) + pack("Q", BASE)
        for key, name, size in zip(rows["p_partkey"].tolist(), rows["p_name"].tolist(), rows["p_size"].tolist(), strict=True):
            low, word = BASE + key % FILE * 64, len(strings)
            strings += name.replace(" ", "_").encode() + b"\0"
            slots.append(word)
            seen = (_leb(len(slots) - 1) if version == 5 else pack("I", word)) + _leb((0 if version == 5 else 1) + size % 2) + pack("H", size)
            kind = 3 if size % 11 == 0 else size % 3
            if kind == 0:
                entries += _leb(2) + seen + (b"" if version >= 4 else b"\x01") + pack("QQ", low, low + 8 + size)
            elif kind == 1:
                entries += _leb(3) + seen + f"_Z{key}\0".encode() + pack("Q", low) + (pack("I", size) if version < 3 else _leb(size))
            elif kind == 2:
                entries += _leb(4) + seen + b"\x01\x9c" + pack("I", len(new_lists) if version == 5 else len(lists))
                if version == 5:
                    new_lists += b"\x05" + pack("Q", low) + b"\x04\x08" + _leb(16) + b"\x07" + pack("Q", low) + b"\x08" + b"\x06" + pack("QQ", low + 24, low + 24 + size % 8) + b"\0"
                else:
                    near = low - BASE
                    lists += pack("QQQQ", near + 8, near + 16, near, near + 8) + pack("QQ", (1 << 64) - 1, low) + pack("QQ", 24, 24 + size % 8) + pack("QQ", 0, 0)
            else:
                entries += _leb(5) + seen + (b"" if version >= 4 else b"\x01")
        entries += b"\0"
        if version == 5:
            offsets += pack("I", 4 + 4 * len(slots)) + pack("HH", 5, 0) + b"".join(pack("I", s) for s in slots)
        place = len(abbreviations) + 1 if unit % 5 == 4 and bad is None or unit == bad else places[version]
        head = pack("H", version) + (b"\x01\x08" + pack("I", place) if version == 5 else pack("I", place) + b"\x08")
        infos += pack("I", len(head) + len(entries)) + head + entries
    sections = [("", b""), (".debug_info", infos), (".debug_abbrev", abbreviations), (".debug_str", strings), (".debug_line", tables), (".debug_line_str", line_strings), (".debug_ranges", lists), (".debug_rnglists", new_lists), (".debug_str_offsets", offsets)]
    names = b"".join(n.encode() + b"\0" for n, _ in [*sections, (".shstrtab", b"")])
    sections.append((".shstrtab", names))
    out, heads, label = b"\0" * 64, b"", 0
    for name, data in sections:
        heads += pack("IIQQQQIIQQ", label, 1, 0, 0, len(out), len(data), 0, 0, 1, 0)
        out, label = out + data, label + len(name) + 1
    start = b"\x7fELF\x02" + (b"\x01" if mark == "<" else b"\x02") + b"\x01" + b"\0" * 9 + pack("HHIQQQIHHHHHH", 2, 62, 1, 0, 0, len(out), 0, 64, 0, 0, 64, len(sections), len(sections) - 1)
    return start + out[64:] + heads


def binaries_of(parts: DataFrame) -> DataFrame:
    """(bin, content): a file for each run of FILE parts."""
    keyed = parts.select(F.expr(f"CAST(floor(p_partkey / {FILE}) AS BIGINT)").alias("bin"), F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("long").alias("p_size"))
    return keyed.groupBy("bin").applyInPandas(lambda g: pd.DataFrame({"bin": [g["bin"].iloc[0]], "content": [make(g)]}), "bin bigint, content binary")
