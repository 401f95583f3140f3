"""Functions and control structures of C source text, by spans.

A text is read once by one pattern that knows comments, strings, characters and directives;
brackets are matched by a stack, and statements are followed by a stack of what is open.
Nothing is read twice and nothing recurses, so time is linear in the text and any depth
of nesting is fine. Text that is no C gives what functions it seems to have; brackets
without a partner reach to the end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    rb"""(?P<skip>//(?:[^\n\\]|\\.)*|/\*.*?(?:\*/|\Z)|^[ \t]*\#(?:[^\n\\]|\\.)*)|(?P<text>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<word>[A-Za-z_$][\w$]*)|(?P<mark>[{}()\[\];:?=,])|(?P<other>[^\s\w])|(?P<number>\d[\w.]*)""",
    re.DOTALL | re.MULTILINE,
)
_CLOSES = {b"(": b")", b"[": b"]", b"{": b"}"}
# Words that are followed by a bracket without being a function's name, and words that begin control structures.
_NO_NAMES = frozenset(b"__attribute__ __attribute __declspec __asm__ __asm asm _Alignas alignas typeof __typeof__ int char short long float double void signed unsigned const static extern inline return sizeof struct union enum if while for switch".split())
_HEADED = {b"if": "if_statement", b"for": "for_statement", b"while": "while_statement", b"switch": "switch_statement"}
_PLAIN = {b"return": "return_statement", b"goto": "goto_statement"}
SPANS = "struct<name: string, start_line: bigint, end_line: bigint, start_byte: bigint, end_byte: bigint, body_byte: bigint, body_line: bigint, nodes: array<struct<node_type: string, start_line: bigint, end_line: bigint, start_byte: bigint, end_byte: bigint, depth: int>>>"


class Source:
    """Tokens of a text: ``texts``, ``starts`` and ``ends``, and for an opening bracket the place
    of its partner in ``match``."""

    def __init__(self, data: bytes):
        self.texts, self.starts, self.ends = [], [], []
        for m in _TOKEN.finditer(data):
            if m.lastgroup != "skip":
                kind = m.lastgroup
                self.texts.append(m[0] if kind in ("word", "mark") else b"0" if kind != "other" else b".")
                self.starts.append(m.start())
                self.ends.append(m.end())
        n = len(self.texts)
        self.match, opened = {}, []
        for i, t in enumerate(self.texts):
            if t in _CLOSES:
                opened.append(i)
            elif t in (b")", b"]", b"}"):
                # a brace closes what was left open inside it
                if t == b"}":
                    while opened and self.texts[opened[-1]] != b"{":
                        self.match[opened.pop()] = i
                if opened and _CLOSES[self.texts[opened[-1]]] == t:
                    self.match[opened.pop()] = i
        self.match.update((i, n) for i in opened)
        self.lines, at = [], data.find(b"\n")
        while at >= 0:
            self.lines.append(at)
            at = data.find(b"\n", at + 1)

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at - 1)

    def functions(self) -> Iterator[tuple[str, int, int]]:
        """(name, first token, token of the body's brace) of each function at the top."""
        i, first, name, valued, n = 0, 0, None, False, len(self.texts)
        while i < n:
            t = self.texts[i]
            if t == b"(" and name is None and not valued:
                name = self._declared(first, i)
            elif t == b"=":
                valued = True
            elif t == b"{" and name is not None and not valued:
                yield name.decode("utf-8", "replace"), first, i
            if t in _CLOSES:
                i = self.match[i]  # parameters, a body, a type's members, a value
            if t == b";" or t == b"}" or t == b"{" and name is not None and not valued:
                first, name, valued = i + 1, None, False
            i += 1

    def _declared(self, first: int, i: int) -> bytes | None:
        """The name that a bracket's parameters belong to: the word before it, or the one inside."""
        before = self.texts[i - 1] if i > first else b""
        if _is_word(before) and before not in _NO_NAMES:
            return before
        if before.strip(b"_") in (b"attribute", b"declspec", b"asm", b"typeof", b"alignas", b"Alignas"):
            return None
        for k in range(i + 1, min(self.match[i], len(self.texts) - 1)):
            if _is_word(self.texts[k]) and self.texts[k] not in _NO_NAMES and self.texts[k + 1] in (b"(", b")"):
                return self.texts[k]
        return None

    def nodes(self, brace: int) -> list[tuple[str, int, int, int]]:
        """(type, first token, last token, depth) of a body and the control structures in it, in
        the order in which they begin. Depth counts syntax nodes below the function's."""
        texts, last = self.texts, min(self.match[brace], len(self.texts) - 1)
        found: list[list] = []

        def begin(kind: str, i: int, depth: int) -> int:
            found.append([kind, i, i, depth])
            return len(found) - 1

        def skip(i: int, ends: tuple[bytes, ...]) -> int:
            """The place of the next of some marks that no bracket holds."""
            asked = 0
            while i <= last:
                t = texts[i]
                if t in ends and not (t == b":" and asked):
                    return i
                asked += (t == b"?") - (t == b":")
                if t == b"}":
                    return i - 1
                i = self.match[i] + 1 if t in _CLOSES else i + 1
            return last

        # what is open: (kind, node, depth of its statements)
        opened: list[list] = [["block", begin("compound_statement", brace, 1), 2]]
        i = brace + 1
        while opened:
            kind, node, depth = opened[-1]
            t = texts[i] if i <= last else b"}"
            done = None  # the last token of a statement that has ended
            if t == b"}":
                done = min(i, last)
                if kind == "block":
                    found[node][2] = done
                    opened.pop()
                    i += 1
                else:  # a statement is missing
                    done = min(i - 1, last)
            elif t == b"{":
                opened.append(["block", begin("compound_statement", i, depth), depth + 1])
                i += 1
            elif t in _HEADED:
                opened.append([t.decode(), begin(_HEADED[t], i, depth), depth + 1])
                i += 1
                if i <= last and texts[i] == b"(":
                    i = self.match[i] + 1
            elif t == b"do":
                opened.append(["do", begin("do_statement", i, depth), depth + 1])
                i += 1
            elif t in (b"case", b"default") and not (t == b"default" and i < last and texts[i + 1] != b":"):
                i = skip(i + 1, (b":", b";")) + 1
                if kind == "block":  # what follows belongs to the case
                    opened[-1][2] = found[node][3] + 2
                else:
                    opened.append(["case", -1, depth + 1])
            elif _is_word(t) and i < last and texts[i + 1] == b":":
                opened.append(["label", begin("labeled_statement", i, depth), depth + 1])
                i += 2
            else:
                done = skip(i, (b";",))
                if t in _PLAIN:
                    found[begin(_PLAIN[t], i, depth)][2] = done
                i = done + 1
            while done is not None and opened and opened[-1][0] != "block":
                kind, node, depth = opened[-1]
                if kind == "if" and i <= last and texts[i] == b"else":
                    opened[-1] = ["else", node, depth + 1]
                    i += 1
                    break
                if kind == "do" and i <= last and texts[i] == b"while":
                    done = skip(i, (b";",))
                    i = done + 1
                if node >= 0:
                    found[node][2] = max(done, found[node][1])
                opened.pop()
        return [tuple(f) for f in found]


def _is_word(t: bytes) -> bool:
    return t[:1].isalpha() or t[:1] in (b"_", b"$")


def functions_of(text: str) -> list[dict]:
    """Functions with their spans; the signature ends and the body begins at ``body_byte``, and
    the preamble is what is before ``start_byte``. Lines count from 0."""
    s, out = Source(text.encode()), []
    place = lambda a, z: {"start_line": s.line(s.starts[a]), "end_line": s.line(s.ends[z]), "start_byte": s.starts[a], "end_byte": s.ends[z]}
    for name, first, brace in s.functions():
        end = min(s.match[brace], len(s.texts) - 1)
        nodes = [{"node_type": kind, "depth": depth, **place(a, z)} for kind, a, z, depth in s.nodes(brace)]
        out.append({"name": name, **place(first, end), "body_byte": s.starts[brace], "body_line": s.line(s.starts[brace]), "nodes": nodes})
    return out


def with_functions(units: DataFrame, text: str = "text", out: str = "functions") -> DataFrame:
    """``units`` with their functions, an array of SPANS; none for null."""
    at, kind = units.columns.index(text), f"array<{SPANS}>"
    whole = [("start_line", pa.int64()), ("end_line", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]
    node = pa.struct([("node_type", pa.string()), *whole, ("depth", pa.int32())])
    item = pa.list_(pa.struct([("name", pa.string()), *whole, ("body_byte", pa.int64()), ("body_line", pa.int64()), ("nodes", pa.list_(node))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(0, b.num_rows, 256):
                part = b.slice(n, 256)
                found = [functions_of(t) if t is not None else [] for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, item)], names=[*part.schema.names, out])

    return units.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in units.dtypes), f"`{out}` {kind}"]))
