"""BPE encoding and decoding with content-defined chunk reuse.

A rolling (gear) hash over the bytes of a text cuts it into chunks, so equal
passages give equal chunks wherever they stand. A distinct chunk is encoded once,
in each task (:func:`map_encoded`) or by the whole cluster (:func:`encode_shared`), and
its ids are reused for every document that has it; where two chunks meet, the few
words around the cut are encoded anew, in a window that widens until its outer words
agree exactly with the ids that the chunks hold.

Cuts are safe at white space only: the vocabulary's pre-tokenizer never joins
characters across it. The part of a chunk before its first white space and
after its last one is therefore left to the join.

Null texts count as empty and give no ids. Rows are kept as they are, repeated
ones and clashing column names included; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, partitions, text_bytes

#: Words and bytes of chunks that a Python worker keeps; past them it starts anew.
CACHED_WORDS = 300_000
CACHED_CHUNK_BYTES = 16 << 20
#: A chunk has 2 ** CHUNK_BITS bytes on average; the hash sees CHUNK_WINDOW bytes.
CHUNK_BITS = 11
CHUNK_WINDOW = 16

#: Ids of known words held, and bytes from which a word goes to the library.
CACHED_IDS = 8_000_000
LONG_WORD = 60

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)
#: Latin-1 letters: they lower-case, normalise and pre-tokenize one by one.
_LETTERS = bytes(c for c in range(256) if chr(c).isalpha() and chr(c).lower() != chr(c).upper() and c not in (0xAA, 0xB5, 0xBA))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gear_hash(symbols: np.ndarray) -> np.ndarray:
    """At each place, a hash of the CHUNK_WINDOW symbols (below 65536) that end there."""
    h, step = _GEAR[symbols], 1
    while step < CHUNK_WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def cut_points(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Ends of the content-defined chunks of one sequence, its own end left out."""
    if len(symbols) <= CHUNK_WINDOW:
        return np.empty(0, np.int64)
    top = gear_hash(symbols)[CHUNK_WINDOW - 1 : -1] >> np.uint32(32 - bits)
    return np.flatnonzero(top == 0) + CHUNK_WINDOW


class Merger:
    """The library's merge table applied to many words at once: each round merges, in
    every word, its pair of lowest rank, from the left, until no word has a known pair."""

    NONE = np.int32(1 << 30)

    def __init__(self, tok: object):
        import json

        model = json.loads(tok.to_str())["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = (left << 20) | right
        self.bits = 20
        slots = self._slots(keys)
        # two places a key: what finds both taken goes to the short sorted rest
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, self.NONE, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        rest = []
        for n, (k, at) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
            if self.key[at] == -1:
                self.key[at], self.rank[at], self.made[at] = k, n, made[n]
            else:
                rest.append(n)
        rest = np.array(rest, np.int64)
        rest = rest[np.argsort(keys[rest])]
        self.rest = np.append(keys[rest], np.iinfo(np.int64).max)
        self.rest_rank, self.rest_made = np.append(rest, self.NONE).astype(np.int32), np.append(made[rest], 0).astype(np.int32)
        self.collided = np.zeros(1 << self.bits, bool)
        self.collided[slots[rest]] = True

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 20) | right
        at = self._slots(keys)
        hit = self.key[at] == keys
        rank, made = np.where(hit, self.rank[at], self.NONE), self.made[at]
        odd = np.flatnonzero(~hit & self.collided[at])
        if len(odd):
            k = np.searchsorted(self.rest, keys[odd])
            same = self.rest[k] == keys[odd]
            rank[odd] = np.where(same, self.rest_rank[k], self.NONE)
            made[odd] = self.rest_made[k]
        return rank, made

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has; ``symbols`` has the first
        symbols of all words in a row."""
        word, symbols = np.arange(len(lengths)), symbols.astype(np.int32)
        counts = np.zeros(len(lengths), np.int64)
        done_word, done = [], []
        while len(word):
            starts = np.cumsum(lengths) - lengths
            rank, made = self.lookup(symbols[:-1], symbols[1:])
            rank, made = np.append(rank, self.NONE), np.append(made, np.int32(0))
            rank[starts[1:] - 1] = self.NONE  # no pair reaches into the next word
            best = np.minimum.reduceat(rank, starts)
            open_ = best < self.NONE
            wide_open = np.repeat(open_, lengths)
            counts[word[~open_]] = lengths[~open_]
            done_word.append(np.repeat(word, lengths)[~wide_open])
            done.append(symbols[~wide_open])
            take = (rank == np.repeat(best, lengths)) & (rank < self.NONE)
            for i in np.flatnonzero(take[1:] & take[:-1]).tolist():  # aaa: the left pair goes first
                if take[i]:
                    take[i + 1] = False
            symbols = np.where(take, made, symbols)
            stay = wide_open.copy()
            stay[np.flatnonzero(take) + 1] = False
            lengths = np.add.reduceat(stay.astype(np.int64), starts)[open_]
            symbols, word = symbols[stay], word[open_]
        order = np.argsort(np.concatenate(done_word), kind="stable")
        return np.concatenate(done)[order], counts


class Codec:
    """One vocabulary in one Python worker, with the words it has met."""

    _loaded: dict[str, Codec] = {}
    #: Words of these characters alone part into pre-tokens byte by byte; with what ODD
    #: finds (contractions, added tokens) in them they go to the library all the same.
    PLAIN = f"^[!-~{_LETTERS.decode('latin-1')}]+$"
    ODD = f"'[{_LETTERS.decode('latin-1')}]|<\\|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.merger = Merger(self.tok)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        named = self._byte_names()
        #: The ids that a byte has inside a pre-token and at its end.
        self.inner = np.array([vocab[named[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[named[b] + "</w>"] for b in range(256)], np.int32)
        #: 1: part of a letter, 2: digit, 3: mark
        self.kind = np.full(256, 3, np.uint8)
        self.kind[48:58], self.kind[65:91], self.kind[97:123], self.kind[128:] = 2, 1, 1, 1
        self.names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.room = CACHED_WORDS
        self.forget()

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @classmethod
    @contextmanager
    def lent(cls, path: str) -> Iterator[Codec]:
        """For one task: the vocabulary stays loaded, the words met are forgotten after it."""
        codec = cls.load(path)
        codec.room = CACHED_WORDS
        try:
            yield codec
        finally:
            codec.forget()

    def forget(self) -> None:
        """Start anew: no word is known. ``ids[ends[n]:ends[n + 1]]`` are those of word n."""
        self.words = pa.array([], pa.string())
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _byte_names(self) -> dict[int, str]:
        """The character that stands for each byte: printable ones for themselves,
        the others from U+0100 on in order."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}

    def direct_many(self, pieces: list[str]) -> list[bytes]:
        """The library's ids of any texts, as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _plain_ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as in PLAIN, one after the other, and how many each has. Runs of
        letters, single digits and runs of marks are their pre-tokens."""
        words = pc.utf8_lower(words)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        flat = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        kind = self.kind[flat]
        starts = np.empty(len(flat), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts[ends[:-1]] = True
        at = np.flatnonzero(starts)
        symbols, last = self.inner[flat], np.append(at[1:], len(flat)) - 1
        symbols[last] = self.final[flat[last]]
        ids, counts = self.merger.merge(symbols, np.diff(np.append(at, len(flat))))
        return ids, np.add.reduceat(counts, np.searchsorted(at, ends[:-1]))

    def learn(self, words: pa.StringArray) -> np.ndarray:
        """Encode words that are not known; returns their places among the known."""
        plain = pc.and_(pc.match_substring_regex(words, self.PLAIN), pc.less(pc.binary_length(words), LONG_WORD))
        plain = pc.and_not(plain, pc.match_substring_regex(words, self.ODD)).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        ids, counts = [self.ids], [np.empty(0, np.int64)]
        if n:
            for part in zip((ids, counts), self._plain_ids(words.take(pa.array(order[:n]))), strict=True):
                part[0].append(part[1])
        if n < len(order):
            made = self.direct_many(words.take(pa.array(order[n:])).to_pylist())
            ids.append(np.frombuffer(b"".join(made), "<u4"))
            counts.append(np.array([len(m) // 4 for m in made], np.int64))
        places = np.empty(len(order), np.int64)
        places[order] = len(self.words) + np.arange(len(order))
        self.words = pa.concat_arrays([self.words, words.take(pa.array(order))])
        self.ids = np.concatenate(ids).astype(np.uint32)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        return places

    def _places(self, words: pa.StringArray) -> np.ndarray:
        """Where distinct words stand among the known ones."""
        found = pc.index_in(words, value_set=self.words)
        if not found.null_count:
            return found.to_numpy().astype(np.int64)
        if len(self.words) + found.null_count > self.room or self.ends[-1] > CACHED_IDS:
            self.forget()
            return self.learn(words)
        new = found.is_null().to_numpy(zero_copy_only=False)
        places = found.fill_null(0).to_numpy().astype(np.int64)
        places[new] = self.learn(words.filter(pa.array(new)))
        return places

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end. White space
        always parts pre-tokens, so texts are encoded word by word."""
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            texts = pa.array([t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        if not len(words):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        places = self._places(words.dictionary)[words.indices.to_numpy()]
        counts = self.ends[places + 1] - self.ends[places]
        after = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.ends[places] - after[:-1], counts) + np.arange(after[-1])]
        return ids, after[bounds - bounds[0]]

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        ids, ends = self.encode_arrow(pa.array(texts, pa.binary()))
        raw, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [raw[a:z] for a, z in zip(ends, ends[1:], strict=False)]

    def encode(self, text: bytes) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """As the library's decode without a decoder step: token strings, space-joined."""
        return " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


class ChunkEncoder:
    """Whole texts by reused chunks and repaired joins, for one Python worker."""

    _SPACE = re.compile(rb"[ \t\n\r\x0b\f]")
    _LAST_SPACE = re.compile(rb"[ \t\n\r\x0b\f][^ \t\n\r\x0b\f]*\Z")

    def __init__(self, codec: Codec, bits: int = CHUNK_BITS):
        self.codec, self.bits = codec, bits
        self.chunks: dict[bytes, tuple[int, int, bytes]] = {}
        self.joins: dict[tuple[bytes, bytes, bytes], bytes] = {}
        self.held = 0
        self.reused = self.encoded = self.repaired = 0

    def _parts(self, chunk: bytes) -> tuple[int, int]:
        """Where its first white space begins and its last one ends; equal ends: it has
        none, and belongs to a join as a whole."""
        first = self._SPACE.search(chunk)
        return (len(chunk), len(chunk)) if first is None else (first.start(), max(map(chunk.rfind, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\f"))) + 1)

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode what stands between the outer white space of chunks not met before."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        self.reused += len(chunks) - len(new)
        self.encoded += len(new)
        size = sum(map(len, new))
        if self.held + 2 * size > CACHED_CHUNK_BYTES:
            self.chunks.clear()
            self.joins.clear()
            self.held, new = 0, list(dict.fromkeys(chunks))
        self.held += 2 * size
        parts = [self._parts(c) for c in new]
        for c, (a, z), ids in zip(new, parts, self.codec.encode_many([c[a:z] for c, (a, z) in zip(new, parts, strict=True)]), strict=True):
            self.chunks[c] = (a, z, ids)

    def _window(self, text: bytes, start: int, end: int, reach: int) -> tuple[bytes, bytes, bytes]:
        """What stands before, in and behind text[start:end], ``reach`` bytes or more to
        each side, up to white space."""
        a, b = max(0, start - reach), min(len(text), end + reach)
        while 0 < a < start and text[a - 1 : a] not in b" \t\n\r\x0b\f":
            a -= 1
        while end < b < len(text) and text[b : b + 1] not in b" \t\n\r\x0b\f":
            b += 1
        return text[a:start], text[start:end], text[end:b]

    def _repair(self, texts: list[bytes], joins: list[tuple[int, int, int]]) -> list[bytes]:
        """Ids of what stands around a cut up to the nearest white space, for joins (text,
        start, end): encoded with its neighbour words, more of them until both outer
        sides of the window give just the ids that they have on their own."""
        out, open_, reach = [b""] * len(joins), [n for n, (_, a, z) in enumerate(joins) if z > a], 1
        while open_:
            windows = [self._window(texts[joins[n][0]], joins[n][1], joins[n][2], reach) for n in open_]
            new = [w for w in dict.fromkeys(windows) if w not in self.joins]
            self.repaired += len(new)
            alone = self.codec.encode_many([part for w in new for part in w])
            whole = self.codec.direct_many([b"".join(w).decode("utf-8", "replace") for w in new])
            for w, ids, before, middle, after in zip(new, whole, alone[::3], alone[1::3], alone[2::3], strict=True):
                if ids == before + middle + after:
                    self.joins[w] = middle
                    self.held += sum(map(len, w)) + len(middle)
            left = []
            for n, w in zip(open_, windows, strict=True):
                if (ids := self.joins.get(w)) is not None:
                    out[n] = ids
                elif sum(map(len, w)) == len(texts[joins[n][0]]):  # all of it: no side to agree with
                    out[n] = self.codec.direct_many([w[1].decode("utf-8", "replace")])[0]
                else:
                    left.append(n)
            open_, reach = left, 16 * reach
        return out

    def encode(self, text: bytes) -> bytes:
        return self.encode_many([text])[0]

    def cut(self, text: bytes) -> list[bytes]:
        ends = [0, *cut_points(np.frombuffer(text, np.uint8), self.bits).tolist(), len(text)]
        return [text[a:z] for a, z in zip(ends, ends[1:], strict=False)]

    def pieces(self, texts: list[bytes], parts: list[list[bytes]], of: Callable[[bytes], tuple[int, int, bytes]]) -> Iterator[list[bytes]]:
        """Per text: the ids of a join, what ``of`` has of a chunk, the next join's ids and so
        on, a join last; ``of`` gives a chunk's first and last white space and its own."""
        joins: list[tuple[int, int, int]] = []
        inner: list[list[bytes]] = []
        for n, (t, p) in enumerate(zip(texts, parts, strict=True)):
            at, open_at, own = 0, 0, []
            for c in p:
                a, z, mine = of(c)
                if a < len(c):
                    joins.append((n, open_at, at + a))
                    own.append(mine)
                    open_at = at + z
                at += len(c)
            joins.append((n, open_at, len(t)))
            inner.append(own)
        made = iter(self._repair(texts, joins))
        for own in inner:
            yield [x for mine in own for x in (next(made), mine)] + [next(made)]

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        parts = [self.cut(t) for t in texts]
        self._learn([c for p in parts for c in p])
        return [b"".join(p) for p in self.pieces(texts, parts, self.chunks.__getitem__)]

    def insides(self, texts: list[bytes]) -> Iterator[list[bytes]]:
        """As :meth:`pieces`, with what is to be encoded of each chunk instead of its ids."""

        def of(chunk: bytes) -> tuple[int, int, bytes]:
            a, z = self._parts(chunk)
            return a, z, chunk[a:z]

        if self.held > CACHED_CHUNK_BYTES:
            self.joins.clear()
            self.held = 0
        return self.pieces(texts, [self.cut(t) for t in texts], of)


def map_encoded(docs: DataFrame, emit: Callable[[bytes, Codec], tuple], fields: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Encode each row's whole text; per row the columns of ``keep`` and what ``emit``
    makes of the ids (little-endian unsigned 32-bit) as the columns ``fields``."""
    path = path or vocabulary_path()
    narrow = docs.select(text_bytes(text).alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[1:]), fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec.lent(path) as codec:
            chunks = ChunkEncoder(codec)
            for b in batches:
                if b.num_rows:
                    rows = [emit(ids, codec) for ids in chunks.encode_many(b.column(0).to_pylist())]
                    columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns], names=[f"f{i}" for i in range(len(b.columns) - 1 + len(columns))])

    return map_arrow(narrow, run, schema)


def _cut(path: str, bits: int):
    """Rows to (keep..., row, joins, digests, digest, inside): a recipe per text, its keep
    columns kept, and a row with digest and inside per chunk that the task has not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        from pyspark import TaskContext

        chunks, sent, row = ChunkEncoder(Codec.load(path), bits), set(), TaskContext.get().partitionId() << 40
        for b in batches:
            joins, digests, insides = [], [], {}
            for p in chunks.insides(b.column(0).to_pylist()):
                names = [blake2b(c, digest_size=16).digest() for c in p[1::2]]
                insides.update((n, c) for n, c in zip(names, p[1::2], strict=True) if n not in sent)
                joins.append(p[::2])
                digests.append(b"".join(names))
            if len(sent) > CACHED_WORDS:
                sent.clear()
            sent.update(insides)
            m, n = b.num_rows, len(insides)
            columns = [*b.columns[1:], pa.array(range(row, row + m), pa.int64()), pa.array(joins, pa.list_(pa.binary())), pa.array(digests, pa.binary())]
            row += m
            whole = [pa.concat_arrays([c, pa.nulls(n, c.type)]) for c in columns]
            whole += [pa.array([*[None] * m, *insides], pa.binary()), pa.array([*[None] * m, *insides.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(whole, names=[f"f{i}" for i in range(len(whole))])

    return run


def _encode_once(path: str, at: int):
    """Of rows sorted by digest (column ``at``, its text behind it): each digest once, ids
    in place of the text; recipes, which have none, pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        with Codec.lent(path) as codec:
            for b in batches:
                keep = []
                for d in b.column(at).to_pylist():
                    keep.append(d is None or d != last)
                    last = d
                b = b.filter(pa.array(keep, pa.bool_()))
                insides = b.column(at + 1)
                made = iter(codec.encode_many([x for x in insides.to_pylist() if x is not None]))
                ids = pa.array([next(made) if ok else None for ok in insides.is_valid().to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[: at + 1], ids], names=b.schema.names)

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keep..., joins, chunks): keep and the ids, joins and chunks in turn."""
    for b in batches:
        out = [b"".join([x for j, c in zip(joins, [*(chunks or []), b""], strict=True) for x in (j, c)]) for joins, chunks in zip(b.column(-2).to_pylist(), b.column(-1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.binary())], names=b.schema.names[:-1])


def encode_shared(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, bits: int = CHUNK_BITS) -> DataFrame:
    """``keep`` and ``ids``, each distinct chunk encoded once by the whole cluster.

    Chunks go to the task that owns their digest, each task sending a chunk once; their ids
    come back by a join on the digest (which adaptive execution splits where one is hot)
    and meet the document's joins, which were repaired where the text is. That shuffles the
    text once and the ids twice, where :func:`map_encoded` shuffles nothing."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    narrow = docs.select(text_bytes(text).alias("_text"), *[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)])
    kept = [f"k{n}" for n in range(len(keep))]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[1:]), "row bigint, joins array<binary>, digests binary, digest binary, ids binary"])
    sent = map_arrow(narrow, _cut(path, bits), schema)
    dealt = sent.repartition(partitions(spark), F.when(F.col("digest").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("digest")))
    once = materialise(map_arrow(dealt.sortWithinPartitions("digest"), _encode_once(path, len(kept) + 3), schema), "shared-chunks")
    recipes, chunks = once.filter("digest IS NULL"), once.filter("digest IS NOT NULL").select("digest", "ids")
    uses = recipes.select("row", F.posexplode(F.expr("transform(sequence(0, octet_length(digests) div 16 - 1), i -> substring(digests, i * 16 + 1, 16))")).alias("pos", "digest")).filter("octet_length(digest) = 16")
    found = uses.join(chunks, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("c"))
    whole = recipes.join(found, "row", "left").select(*kept, "joins", F.col("c.ids").alias("chunks"))
    ids = map_arrow(whole, _assemble, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[1:]), "ids binary"]))
    return ids.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "ids")


def encode_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``."""
    return map_encoded(docs, lambda ids, codec: (ids, codec.decode(ids)), "ids binary, decoded string", text, keep, path)


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(ids: bytes, codec: Codec) -> tuple[int, str, str]:
    from hashlib import sha256

    return len(ids) // 4, sha256(ids).hexdigest(), sha256(codec.decode(ids).encode()).hexdigest()


def encoding_digests(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of each whole text."""
    return map_encoded(docs, digests, DIGESTS, text, keep, path)
