"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import threading
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, embeddings, exact_dedup, langid, mixing, pii, registry, simhash, tokenstore, urlfilter
from lodestone.llm.common import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string"
ODD = [
    (1, None, None),
    (2, "", "a"),
    (3, "  \n", "a"),
    (4, "one", "b"),
    (4, "one", "b"),
    (5, "call +1 (521) 555-6210 or mail a.b@c.de", "b"),
    (6, "word " * 30000, "c"),
    (7, "x" * 50000, None),
    (None, "no id <|endoftext|> Ünïcode ΑΣ 日本", "c"),
    (8, "one", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "p", 1.0, "q") for r in ODD], DOCS + ", score string, kept double, _text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 1 ------------------------------------------------------------------------


def brute_base(text):
    def luhn(d):
        s = sum(int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(reversed(d)))
        return s % 10 == 0

    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a.b", "@", "c-d.e", ".", "1.2.3.4", "300", "0004", "+1", " ", "(", "5", "4111 1111-1111 1111", "x", "-", "é", "..", "@@", "+12 345 678 901"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_base(text), text


def test_pii_query(spark, docs):
    got = {r.doc_id: r for r in registry.op1_pii(spark, SF).collect()}
    for r in docs.collect():
        base = brute_base(r.text)
        g = got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        said = pii.spans_text(base)
        assert g.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(g.spans.split(","))


def test_pii_skip_links_add_what_a_pattern_misses(spark, docs):
    field = pii.fit_field(docs)
    text = "Call +1 (521) 555-6210 today. Later: (521) 555-6210 again, room 12."
    base = pii.base_spans(text)
    added, _ = field.added_spans(text, base)
    assert [text[a:z] for a, k, z in added if k == 3 and "555-6210" in text[a:z]]
    assert not any("12" == text[a:z] for a, _, z in added)
    assert field.added_spans("page 12 of 30 and 7 more", []) == ([], True)


def test_pii_all_repeats_of_a_token_agree(spark, docs):
    fitted, level = pii.fit_field(docs), pii.Field()
    level.skip = np.array([4.0, 0.0])
    for field, later in ((fitted, "(521) 555-6210"), (level, "15215556210")):
        for repeats in (1, 60):
            text = "Call +15215556210 today. " if field is level else "Call +1 (521) 555-6210 today. "
            text += f"Later: {later} again. " * repeats
            base = pii.base_spans(text)
            assert len(base) == 1
            added = [text[a:z] for a, k, z in field.added_spans(text, base)[0] if k == 3]
            assert sum(later[-8:] in t for t in added) == repeats


def exact_marginals(field, g):
    """By enumeration of all labels, shared nodes included."""
    groups = [(k, group) for k, of in enumerate(g.groups) for group in of]
    n, total = len(g.known), np.zeros((len(g.known), pii.LABELS))
    kinds = [set(g.known[m].tolist()) - {-1} for _, m in groups]
    known = [*g.known.tolist(), *(min(k) if len(k) == 1 else -1 for k in kinds)]
    for y in itertools.product(range(pii.LABELS), repeat=n + len(groups)):
        if all(k in (-1, v) for k, v in zip(known, y, strict=True)):
            score = sum(g.shapes[m] @ field.unary[:, y[m]] for m in range(n))
            score += sum(field.chain[gap, y[m], y[m + 1]] for m, gap in g.chain)
            score += sum(field.skip[k] * (y[m] == y[n + i]) for i, (k, group) in enumerate(groups) for m in group)
            for m in range(n):
                total[m, y[m]] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_pii_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    field = pii.Field()
    field.unary, field.chain, field.skip = rng.normal(0, 0.7, field.unary.shape), rng.normal(0, 0.7, field.chain.shape), np.array([1.2, 0.6])
    far = " w" * 9 + " "
    for text, tolerance in (
        ("a 12 b 345 67", 1e-3),  # a chain
        (f"12345678{far}a@b{far}1234-5678", 1e-3),  # equal tokens
        (f"+1 521 5556210{far}5556210{far}99", 1e-3),
        (f"5215556210{far}5215556211", 1e-3),  # similar ones
        (f"5556210 x 42 5556210{far}7", 0.05),  # a loop
    ):
        g = pii.Graph(text, pii.base_spans(text))
        assert len(g.chain) or any(g.groups)
        assert np.abs(field.marginals(g) - exact_marginals(field, g)).max() < tolerance, text


def test_pii_similar_tokens_and_other_digits(spark, docs):
    field = pii.fit_field(docs)

    def added(text):
        return [(text[a:z], pii.KINDS[k]) for a, k, z in field.added_spans(text, pii.base_spans(text))[0]]

    assert added("pay 4465758382889437 4465758382889437 now") == [("4465758382889437", "card")] * 2
    assert added("pay 4465758382889438 now") == []  # fails its check alone
    text = "Call +1 (521) 555-6210 now. Or write, " + "word " * 12 + "5215556210 at night."
    assert ("5215556210", "phone") in added(text)
    for odd in ("version 1.2.3.²", "①②③④⑤⑥⑦ ٠١٢.٣٤.٥.٦ 1.2.3.٤", "² 1²3 @ @@ +", "12" * 5000 + " @"):
        assert added(odd) == []


def test_pii_learns_from_whole_texts(spark):
    words = "word " * 400
    df = spark.createDataFrame([(n, f"{words}{n} mail a{n}@b.de {words}call +1 (521) 555-62{10 + n % 80} end", "s") for n in range(60)], DOCS)
    assert pii.fit_field(df).unary[1, 1] > 0.1
    rows = pii.training_rows("x 12 4465758382889437 4465758382889437 a@b.c 4465758382889438x 1.2.3.400")
    assert rows[:, pii.SHAPES].tolist() == [0, 1, 0, 0] and rows.shape[1] == pii.ROW
    assert pii.training_rows("").shape == pii.training_rows("no node").shape == (0, pii.ROW)


def test_pii_odd(spark, odd, empty):
    field = pii.fit_field(odd)
    got = pii.span_digests(pii.find_pii(odd, field)).collect()
    assert len(got) == len(ODD)
    assert {(r.n_phone, r.n_email) for r in got if r.doc_id == 5} == {(1, 1)}
    assert pii.span_digests(pii.find_pii(empty, pii.fit_field(empty))).count() == 0


def test_long_unbroken_texts_take_linear_time():
    field = pii.Field()
    for text in ("+1 521 555 6210 " + "x" * 1_000_000, "日本語のテキスト。" * 100_000 + "5", "a1" * 300_000, "+" * 300_000 + "1", "1.2." * 200_000):
        began = time.time()
        base = pii.base_spans(text)
        field.added_spans(text, base)
        pii.training_rows(text)
        assert time.time() - began < 20


def test_unsettled_messages_are_told():
    g = pii.Graph("mail a.b@c.de and a.b@c.de or 12345 and 12345", [])
    pii.Field().marginals(g)
    assert g.settled


# -- 2 ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary_path())


def library(codec, text):
    ids = codec.tok.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), codec.tok.decode(ids, skip_special_tokens=False)


TEXTS = [
    "", "a", " x ", "<|endoftext|>a <|startoftext|> <|endoftext|", "é ́a İstanbul ΑΣ Σ " * 50, "don't it's 'RE x.y,z " * 300, "x" * 30000, "日本語テキスト" * 400,
    "a\x1cb\x85c\xa0d " * 200, "1234 5,6.7 " * 300, "ß.; Àé| µª º×÷ ÿŸ " * 200, "aaaa aaaaa aaaaaaaaaaaa. ......" * 30, "\x00 ... |", "word's ''s 's. foo'. (bar) " * 99,
]


def test_codec_equals_the_library(codec, docs):
    texts = TEXTS + [r.text for r in docs.collect()]
    fine, coarse = bpe.ChunkEncoder(codec, 5), bpe.ChunkEncoder(codec)
    raw = [t.encode() for t in texts]
    for t, a, b, c in zip(texts, codec.encode_many(raw), fine.encode_many(raw), coarse.encode_many(raw), strict=True):
        ids, said = library(codec, t)
        assert a == b == c == ids
        assert codec.decode(ids) == said
    assert fine.reused > 0


def test_merges_equal_the_model(codec):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 39))).encode() for _ in range(3000)}
    words |= {"".join(rng.choice("abrsteé Üß12.,'-(_&<|>²µ") for _ in range(rng.randint(1, 12))).encode() for _ in range(6000)}
    codec.forget()
    for w, ids in zip(words, codec.encode_many(list(words)), strict=True):
        assert ids == library(codec, w.decode())[0]
    codec.forget()
    assert [codec.encode(w) for w in list(words)[:99]] == codec.encode_many(list(words)[:99])


def test_bpe_query_and_odd(spark, codec, odd, empty):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in df.collect():
            ids, said = library(codec, r.text or "")
            want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
        assert rows(bpe.encoding_digests(df)) == sorted(want, key=repr)
    assert bpe.encoding_digests(empty).count() == 0
    r = bpe.encode_documents(odd).filter("doc_id = 5").first()
    assert (bytes(r.ids), r.decoded) == library(codec, ODD[5][1])


def test_chunks_encoded_once_by_the_cluster(spark, codec, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copied = docs.unionByName(docs.withColumn("text", F.concat(F.lit("Other "), "text")))
    for df in (copied, odd):
        want = sorted(((r.doc_id, library(codec, r.text or "")[0]) for r in df.collect()), key=repr)
        got = sorted(((r.doc_id, bytes(r.ids)) for r in bpe.encode_shared(df.repartition(5)).collect()), key=repr)
        assert got == want
    assert bpe.encode_shared(empty).count() == 0


# -- 3 ------------------------------------------------------------------------


def brute_mix(given):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in given]
    sources = sorted({s for _, _, s in given}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    of = {s: sum(z for z, r in zip(size, given, strict=True) if r[2] == s) for s in sources}
    budget, target, open_ = 1.5 * sum(size), {}, set(sources)
    while open_:
        left, w = budget - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * of[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 2.0 * of[s] for s in over}
        open_ -= set(over)
    return size, of, target


@pytest.mark.parametrize("which", ["odd", "docs", "skew"])
def test_mix(spark, odd, docs, which):
    skew = spark.createDataFrame([(n, "w " * (n % 7), "hot" if n % 3 else f"s{n % 11}") for n in range(400)], DOCS)
    df = {"odd": odd, "docs": docs, "skew": skew}[which]
    given = [(r.doc_id, r.text, r.source) for r in df.collect()]
    size, of, target = brute_mix(given)
    got = mixing.mixed_documents(df).collect()
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=repr) == sorted(((g[0], z, of[g[2]]) for g, z in zip(given, size, strict=True)), key=repr)
    near = {s: pytest.approx(t, rel=1e-9) for s, t in target.items()}
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_size.setdefault((r.source_size, r.target), 0)
        by_size[(r.source_size, r.target)] += r.taken
    assert all(any(of[s] == z and t == near[s] for s in of) for z, t in by_size)
    if which != "odd":
        assert abs(sum(r.taken for r in got) - 1.5 * sum(size)) <= len(of)
    again = mixing.mixed_documents(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_is_ordered_and_cut(spark, docs):
    mixed = sorted(mixing.mix(docs).collect(), key=lambda r: (r.finish, r._source, r.epoch, r._key))
    sent = 0
    for r in mixed:
        assert r.position == sent
        sent += r.words
    assert [r.finish for r in mixed] == sorted(r.finish for r in mixed)


def test_mix_takes_its_cut_from_the_sorted_queue(spark, docs, monkeypatch):
    """Each source near its target; not so once the queue is sorted by something else."""
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    _, _, target = brute_mix(given)
    source = {g[0]: g[2] for g in given}

    def far():
        sent = {}
        for r in mixing.mixed_documents(docs).collect():
            sent[source[r.doc_id]] = sent.get(source[r.doc_id], 0) + r.taken
        return max(abs(sent[s] - t) for s, t in target.items())

    assert far() <= 1
    sort = mixing.range_prefix

    def unsorted(df, order, value, out, **rest):
        order = [F.col("_key"), *order] if rest["name"] == "mix-order" else order
        return sort(df, order, value, out, **rest)

    monkeypatch.setattr(mixing, "range_prefix", unsorted)
    assert far() > 100


def test_mix_empty(empty):
    assert mixing.mixed_documents(empty).count() == 0


# -- 4 ------------------------------------------------------------------------


def brute_fp(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def check_simhash(df):
    given = [(r.doc_id, brute_fp(r.text)) for r in df.collect() if r.doc_id is not None]
    links = [(a, b) for n, (a, f) in enumerate(given) for b, g in given[:n] if (f ^ g).bit_count() <= 2]
    comp = brute_components({d for d, _ in given}, links)
    want = sorted((d, f"{f:016x}", comp[d]) for d, f in given)
    assert rows(simhash.near_duplicates(df).filter("doc_id IS NOT NULL")) == sorted(want, key=repr)


def test_simhash(spark, docs, odd, empty):
    check_simhash(docs)
    check_simhash(odd)
    assert simhash.near_duplicates(odd).count() == len(ODD)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "A b c d"), (None, "x y z"), (3, None), (None, " ")], "doc_id bigint, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted([(None, 7), (7, 7), (None, None), (3, 3), (None, 3)], key=repr)


def test_simhash_links_of_close_fingerprints(spark):
    rng = random.Random(9)
    values = []
    for _ in range(60):
        c = rng.getrandbits(64)
        for _ in range(6):
            v = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.linked_fingerprints(spark.createDataFrame(signed, "fp bigint")).collect()
    mod = 1 << 64
    found = [(r.a % mod, r.b % mod) for r in links]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    brute = [(a, b) for n, a in enumerate(values) for b in values[:n] if (a ^ b).bit_count() <= 2]
    assert brute_components(values, found) == brute_components(values, brute)


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    values = [rng.getrandbits(12) for _ in range(500)]
    tree, seen = simhash.BKTree(), []
    for v in values:
        assert sorted(tree.values[n] for n in tree.add_and_search(v, 2)) == sorted(s for s in seen if (s ^ v).bit_count() <= 2)
        seen.append(v)


# -- 5 ------------------------------------------------------------------------


def test_pairs_that_no_window_reaches_by_default(spark):
    """So many vectors that the passes compare a part of all pairs only."""
    rng = np.random.default_rng(21)
    n, dim = 40_000, 16
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(0, 2000, 2):  # right above the threshold
        side = rng.normal(size=dim)
        side -= (side @ x[k]) * x[k]
        x[k + 1] = 0.905 * x[k] + (1 - 0.905**2) ** 0.5 * side / np.linalg.norm(side)
    x = x.astype(np.float32)
    assert embeddings.passes_for(n) * embeddings.WINDOW * n < n * (n - 1) // 2
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    true = sum(np.count_nonzero(unit[a : a + 2000] @ unit.T >= 0.9) for a in range(0, n, 2000)) - n
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))
    got = embeddings.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert 0.95 * true <= got <= true


def check_vectors(spark, vectors, **options):
    df = spark.createDataFrame([(n, v, 0) for n, v in vectors], "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, **options).collect()}
    unit = {}
    for n, v in vectors:
        x = None if v is None or None in v else np.asarray(v, np.float32).astype(float)
        if x is not None and len(x) and np.isfinite(x).all() and np.linalg.norm(x):
            unit[n] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if b < a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    comp = brute_components([n for n, _ in vectors], links)
    count = {n: sum(n in x for x in links) for n, _ in vectors}
    assert len(got) == len(vectors)
    return got, comp, count


def test_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(1 + c % 9):
            vectors.append((len(vectors), [float(x) for x in centre + rng.normal(size=16) * 0.1]))
    vectors += [(len(vectors) + k, list(vectors[0][1])) for k in range(4)]
    n = len(vectors)
    nan = float("nan")
    vectors += [(n, None), (n + 1, [0.0] * 16), (n + 2, [nan] * 16), (n + 3, [1.0, None]), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [float("inf")] * 16)]
    got, comp, count = check_vectors(spark, vectors)
    assert {k: r.component_id for k, r in got.items()} == comp
    assert {k: r.n_links for k, r in got.items()} == count
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    got, comp, count = check_vectors(spark, vectors, window=16, block=32)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(count.values())
    assert all(r.n_links <= count[k] for k, r in got.items())


def test_vectors_empty(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_vectors_that_share_an_id(spark):
    given = [(1, [1.0, 0, 0]), (1, [0, 1.0, 0]), (2, [0, 1.0, 0.01]), (3, [1.0, 0, 0.01]), (4, [0, 0, 1.0]), (4, None), (None, [0, 0, 1.0]), (5, [0, 0, 1.0])]
    df = spark.createDataFrame([(n, v and [float(c) for c in v], "x") for n, v in given], "vec_id bigint, embedding array<float>, n_links string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 0, 4, True), (None, 0, None, True), (5, 1, 4, False)], key=repr)


def test_vectors_in_one_dense_group(spark):
    """More members than a window reaches, at the default parameters: every link is found."""
    rng = np.random.default_rng(11)
    x = np.concatenate([cone(rng, 4000, 0.97), rng.normal(size=(9000, 64))]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(n, [float(c) for c in v]) for n, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    assert true[:4000].min() == 3999 and all(got[n] <= t for n, t in enumerate(true.tolist()))
    assert sum(got.values()) >= 0.99 * true.sum()


def cone(rng, rows, cosine, dim=64):
    """Unit vectors of which any two have about this cosine."""
    centre, x = rng.normal(size=dim), rng.normal(size=(rows, dim))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return cosine**0.5 * centre / np.linalg.norm(centre) + (1 - cosine) ** 0.5 * unit


def test_vectors_in_dense_clusters(spark):
    """A tight cluster, links of more members than all windows reach, and a wide cone with planted pairs at 0.905."""
    rng = np.random.default_rng(7)
    x = np.concatenate([cone(rng, 3000, 0.75), cone(rng, 600, 0.97), rng.normal(size=(6000, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for n in range(0, 1000, 2):
        y = x[n + 1] - x[n + 1] @ x[n] * x[n]
        x[n + 1] = 0.905 * x[n] + (1 - 0.905**2) ** 0.5 * y / np.linalg.norm(y)
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(n, [float(c) for c in v]) for n, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, window=16, block=512).collect()}
    assert true[3000:3600].min() >= 599 and all(r.n_links <= true[k] for k, r in got.items())
    assert sum(got[n].n_links for n in range(3000, 3600)) >= 0.99 * true[3000:3600].sum()
    assert {got[n].component_id for n in range(3000, 3600)} == {3000}
    assert sum(got[n].component_id == got[n + 1].component_id for n in range(0, 1000, 2)) >= 490


# -- 6 ------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", None, "", "\\\\h ### </turn>\n### user: x", "Ünï 日本 <|endoftext|>  spaces ", "x" * 20000]
    data = [(c, t, ["user", "assistant", "sys:tem\\", None][(c + t) % 4], said[(c * 5 + t) % 6], "x") for c in range(12) for t in range(c % 5 + 1)] + [(None, None, "assistant", "a", "x"), (3, 1, "assistant", "tie", "x")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    convs = {}
    for c, t, role, text, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == len(chat.render(turns)[0])
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_query(spark):
    assert registry.op6_chat(spark, SF).filter("conv_id = -7").first().loss_chars == 26


# -- 7 ------------------------------------------------------------------------


def test_langid_held_out(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = registry.op7_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    net = langid.train(docs)
    marked = langid.predict(odd, net)
    assert marked.columns[-2:] == ["lang_pred", "_score"]
    assert {r.lang_pred for r in marked.filter("doc_id in (1, 2, 3)").collect()} == {"und"}
    assert marked.count() == len(ODD)
    assert langid.train(empty.selectExpr("*", "'x' AS lang")) is None
    assert langid.predict(odd, None).filter("lang_pred <> 'und'").count() == 0


def brute_forward(net, x):
    """Softmax of a plain convolution: each filter at each place of each window."""
    out = []
    for row in x:
        h = []
        for n, w in enumerate(langid.WIDTHS):
            for f in range(langid.FILTERS):
                best = max(sum(float(net.filters[w][k, row[at + k], f]) for k in range(w)) for at in range(langid.WINDOW - w + 1))
                h.append(max(0.0, best + float(net.bias[n * langid.FILTERS + f])))
        z = np.array(h) @ net.top.astype(float) + net.top_bias
        out.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    return np.array(out)


def test_langid_network_equals_a_plain_convolution():
    rng = np.random.default_rng(3)
    net = langid.Network(["a", "b", "c"])
    net.bias += rng.normal(0, 0.2, net.bias.shape).astype(np.float32)
    x = rng.integers(0, langid.CLASSES, (3, langid.WINDOW)).astype(np.uint16)
    net.compose()
    assert np.abs(net.probabilities(x) - brute_forward(net, x)).max() < 1e-5


def test_langid_gradient_equals_differences():
    rng = np.random.default_rng(4)
    net, y = langid.Network(["a", "b"]), np.array([0, 1, 1])
    x = rng.integers(0, langid.CLASSES, (3, langid.WINDOW)).astype(np.uint16)
    net.filters = {w: f.astype(float) for w, f in net.filters.items()}
    net.bias, net.top, net.top_bias = (v.astype(float) for v in (net.bias, net.top, net.top_bias))

    def loss():
        net.compose()
        return -np.log(net.probabilities(x)[np.arange(3), y]).mean()

    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        for at in np.argsort(-np.abs(g).ravel())[:5].tolist():
            was = p.flat[at]
            p.flat[at] = was + 1e-6
            up = loss()
            p.flat[at] = was - 1e-6
            down = loss()
            p.flat[at] = was
            assert (up - down) / 2e-6 == pytest.approx(g.flat[at], rel=1e-3, abs=1e-6)


def test_langid_letters(spark, docs):
    net = langid.train(docs.withColumn("source", F.lit(None).cast("string")))
    texts = ["² ½ Ⅷ ①", "123 _", "", None, "é", "ªx", "日本", "1" * 5000 + "a"]
    df = spark.createDataFrame([(None if n % 2 else n, t, "odd") for n, t in enumerate(texts)], "doc_id bigint, text string, lang_pred string")
    got = {r.text: (r._lang_pred, r.score) for r in langid.predict(df, net).collect()}
    assert [t for t in texts if got[t][0] == "und"] == texts[:4] and all(got[t][1] == 0 for t in texts[:4])
    assert langid.train(docs.limit(0)) is None


# -- 8 ------------------------------------------------------------------------


def test_urls(spark):
    urls = [
        None, "", "nourl", "://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/71", "http://badexample.com/en/71", "http://a.net/de", "http://a.net/de/", "x://b.example.net/de/8#q",
        "http://bad.org/x/?q", "http://bad.org/x", "http://bad.org/xy", "http://bad.org", "a://b://c/d", "http://h?/en/",
    ]
    nameless = spark.createDataFrame([(None, "http://bad.org/x"), (None, None), (None, "http://bad.org/x")], "page_id bigint, url string")
    assert sorted(r.verdict for r in urlfilter.judge(nameless, spark.createDataFrame([("bad.org/x",)], "listed string"), []).collect()) == ["allow", "block", "block"]
    pages = spark.createDataFrame([(n, u, "h", "r") for n, u in enumerate(urls * 2)], "page_id bigint, url string, host string, rule string")
    listed = spark.createDataFrame([("bad.org/x",), ("bad.org/x",), (None,)], "listed string")
    got = {r.page_id: r for r in urlfilter.judge(pages, listed, registry.RULES).collect()}
    assert len(got) == 2 * len(urls)
    for n, u in enumerate(urls * 2):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in registry.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "block" if host + path.rstrip("/") == "bad.org/x" else "allow"))
        assert (got[n].host, got[n].path, got[n].rule, got[n].verdict) == (host, path, rule, verdict), u
    none = urlfilter.judge(pages, listed.limit(0), registry.RULES)
    assert none.filter("rule IS NULL AND verdict = 'block'").count() == 0
    assert urlfilter.judge(pages.limit(0), listed, registry.RULES).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '/x') AS listed")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://h', id, '/x') AS url")
    got = urlfilter.judge(pages, listed, [])
    assert got.filter("verdict = 'block'").count() == 3000


# -- 9 ------------------------------------------------------------------------


def test_exact_dedup(spark, odd, empty):
    groups = {}
    for d, t, _ in ODD:
        groups.setdefault(t or "", []).append(d)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    assert rows(exact_dedup.duplicate_groups(odd)) == sorted(want, key=repr)
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.text or "", r.doc_id) for r in kept.collect() if r.doc_id) == sorted((t, max(i for i in ids if i is not None)) for t, ids in groups.items() if any(ids))
    assert kept.count() == len(groups)
    assert exact_dedup.duplicate_groups(empty).count() == 0


def test_exact_dedup_tells_texts_of_one_digest_apart(spark, odd):
    groups = {}
    for d, t, _ in ODD:
        groups.setdefault(t or "", []).append(d)
    want = sorted(((d, max((i for i in ids if i is not None), default=None), len(ids)) for ids in groups.values() for d in ids), key=repr)
    for digest in (lambda t: F.lit("same"), lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)):
        got = exact_dedup.duplicate_groups(odd, digest=digest).select("doc_id", "keep_id", "group_size")
        assert rows(got) == want


# -- 10 -----------------------------------------------------------------------


def brute_store(codec, df):
    at, out = 0, []
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = library(codec, r.text or "")[0] + (1).to_bytes(4, "little")
        out.append((r.doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def test_token_store(spark, codec, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        path = new_path(spark, "test-store")
        tokenstore.write_store(df, path)
        want = brute_store(codec, df)
        assert rows(tokenstore.read_digests(spark, path)) == sorted(want, key=repr)
        whole = {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in tokenstore.read_documents(spark, path).collect()}
        assert whole == {s: c for _, s, _, c in want}
        chunks = spark.read.parquet(f"{path}/objects").filter("kind = 'chunk'")
        assert chunks.count() == chunks.select("digest").distinct().count()
    path = new_path(spark, "test-store")
    tokenstore.write_store(empty, path)
    assert tokenstore.read_digests(spark, path).count() == 0


def test_token_store_reads_hot_chunks_and_plain_files(spark, codec, monkeypatch):
    text = "one two three four " * 4000
    df = spark.createDataFrame([(n, text if n % 2 else f"{text} and {n}") for n in range(40)], "doc_id bigint, text string")
    path = new_path(spark, "test-store")
    tokenstore.write_store(df, path)
    want = sorted(brute_store(codec, df), key=repr)
    assert rows(tokenstore.read_digests(spark, path)) == want  # its chunks are hot
    spark.sql(f"DROP TABLE {tokenstore._table(path)}")  # as in another session
    assert rows(tokenstore.read_digests(spark, path)) == want
    monkeypatch.setattr(tokenstore, "HOT", 0)
    assert rows(tokenstore.read_digests(spark, path)) == want


def test_token_store_refuses_changed_chunks(spark, odd):
    path = new_path(spark, "test-store")
    tokenstore.write_store(odd, path)
    spark.sql(f"DROP TABLE {tokenstore._table(path)}")
    objects = spark.read.parquet(f"{path}/objects")
    lost = objects.filter("kind = 'chunk'").agg(F.min("digest")).first()[0]
    for name, kept in (("less", objects.filter(~((F.col("kind") == "chunk") & (F.col("digest") == F.lit(lost))))), ("other", objects.withColumn("payload", F.when(F.col("digest") == F.lit(lost), F.lit(b"\x02\x07\x00")).otherwise(F.col("payload"))))):
        import shutil

        shutil.copytree(path, f"{path}-{name}")
        kept.write.mode("overwrite").partitionBy("kind").parquet(f"{path}-{name}/objects")
        with pytest.raises(Exception, match="missing|do not give"):
            tokenstore.read_digests(spark, f"{path}-{name}").collect()


def test_token_store_refuses_changed_files(spark, odd):
    path = new_path(spark, "test-store")
    tokenstore.write_store(odd, path)
    spark.read.parquet(f"{path}/recipes").filter("doc_id <> 6").write.parquet(f"{path}/other")
    import shutil

    shutil.rmtree(f"{path}/recipes")
    shutil.move(f"{path}/other", f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        tokenstore.read_digests(spark, path)


# -- pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark, codec):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, "").collect()
    assert len(kept) >= 0.99 * docs.count()
    junk = spark.createDataFrame([(10**6, "123 456", "en", "src0", 7), (10**6 + 1, None, "en", "src0", 0)], docs.schema)
    assert stages["language_id"](spark, docs.unionByName(junk), "").filter(f"doc_id >= {10**6}").count() == 0

    one = stages["exact_dedup"](spark, docs, "").cache()
    last = {}
    for r in docs.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in one.collect()) == sorted(last.values())

    near = stages["simhash_near_dedup"](spark, one, "")
    given = [(r.doc_id, brute_fp(r.text)) for r in one.collect()]
    comp = brute_components([d for d, _ in given], [(a, b) for n, (a, f) in enumerate(given) for b, g in given[:n] if (f ^ g).bit_count() <= 2])
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(comp.values()))

    near_rows = near.collect()
    copies = {}
    for r in stages["mix_sources"](spark, near, "").collect():
        assert tuple(r) in set(map(tuple, near_rows))
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == brute_copies([(r.doc_id, r.text, r.source) for r in near_rows])
    assert docs.columns == near.columns

    few = near.limit(300)
    want = []
    for r in few.collect():
        ids, said = library(codec, r.text)
        want.append((r.doc_id, ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    encoded = stages["bpe_encode"](spark, few, "")
    assert sorted((r.doc_id, bytes(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded.collect()) == sorted(want)


def brute_copies(given):
    """How often each id is in the mix: sources served in md5 order, twice, up to their targets."""
    size, _, target = brute_mix(given)
    sent, out = {}, {}
    key = {g[0]: hashlib.md5(f"mix-1|{'null' if g[0] is None else g[0]}".encode()).hexdigest() for g in given}
    for _ in range(2):
        for g, z in sorted(zip(given, size, strict=True), key=lambda v: key[v[0][0]]):
            if z and sent.get(g[2], 0) < int(target[g[2]] + 1e-6):
                out[g[0]] = out.get(g[0], 0) + 1
            sent[g[2]] = sent.get(g[2], 0) + z
    return out


def test_pipeline_run_leaves_its_result_alone(spark):
    import os

    import corpus_pipeline
    from lodestone.llm import common

    os.makedirs(common.shared_dir(spark), exist_ok=True)
    before = set(os.listdir(common.shared_dir(spark)))
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 200 and got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {n.rpartition("-")[0] for n in set(os.listdir(common.shared_dir(spark))) - before} == {"stage-bpe_encode"}


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    """Null and repeated ids, clashing columns, no rows: all rows that a stage keeps are rows of its input."""
    import corpus_pipeline

    odd, empty = (df.withColumn("lang", F.lit("en")) for df in (odd, empty))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").count() == 0, name
        got = stage(spark, odd, "")
        assert got.columns == odd.columns, name
        assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in odd.collect()}, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() == len(ODD)


def test_pipeline_rows_without_an_id_or_with_the_same(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60)) for _ in range(4)]
    given = [(None, texts[0], "a"), (None, texts[1], "a"), (4, texts[2], "b"), (4, texts[3], "b"), (9, texts[3], "b"), (None, texts[3], "b")]
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    unique = stages["simhash_near_dedup"](spark, df, SF)
    assert rows(unique) == sorted(given[:4], key=repr)
    pair = spark.createDataFrame(given[2:4], df.schema)
    copies = [r.text for r in stages["mix_sources"](spark, pair, SF).collect()]
    assert len(copies) <= 4 and set(copies) == {texts[2], texts[3]}
    assert {r.text for r in stages["mix_sources"](spark, spark.createDataFrame(given[:2], df.schema), SF).collect()} == {texts[0], texts[1]}


def test_store_cut_at_its_end(spark, odd):
    """Whole last segments gone from recipes and manifest alike: the top root tells."""
    path = new_path(spark, "test-store")
    tokenstore.write_store(odd, path)
    last = spark.read.parquet(f"{path}/manifest").agg(F.max("segment")).first()[0]
    rows = spark.read.parquet(f"{path}/manifest").withColumn("segment", F.col("segment") + last + 1).unionByName(spark.read.parquet(f"{path}/manifest"))
    assert tokenstore._top(rows).collect() != tokenstore._top(spark.read.parquet(f"{path}/manifest")).collect()
    for name in ("recipes", "manifest"):
        table = spark.read.parquet(f"{path}/{name}")
        kept = table.filter(F.lit(False)).toArrow()
        spark.createDataFrame(kept, table.schema).write.mode("overwrite").parquet(f"{path}/{name}")
    with pytest.raises(ValueError, match="top root"):
        tokenstore.read_digests(spark, path)
    tokenstore.forget(spark, path)
    tokenstore.forget(spark, path)


def test_training_takes_bounded_windows(spark):
    """A training document of many megabytes gives as many windows as others at most."""
    rows = [(n, "eins zwei drei vier " * 20 if n % 2 else "one two three four " * 20, "de" if n % 2 else "en") for n in range(60) if zlib.crc32(str(n).encode()) % 3 != 1]
    rows += [(n, "one two three " * 1_000_000, "en") for n in range(60, 70) if zlib.crc32(str(n).encode()) % 3 != 1][:1]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = []
    train = langid.Network.train
    langid.Network.train = lambda self, x, y, **k: kept.append(len(x)) or train(self, x, y, **k)
    try:
        net = langid.train(df)
    finally:
        langid.Network.train = train
    assert kept[0] <= langid.DOC_WINDOWS + 2 * 60
    got = {r.doc_id: r.lang_pred for r in langid.predict(df.filter("doc_id < 60").select("doc_id", "text"), net).collect()}
    assert all(v == ("de" if k % 2 else "en") for k, v in got.items())


def test_runs_delete_their_own_tables_only(spark):
    """Two runs in two threads, one of them with empty results."""
    from lodestone.llm.common import drop_but_last, materialise, new_path, recorded

    def run(rows, out):
        with recorded() as made:
            df = spark.range(rows)
            for _ in range(3):
                df = materialise(materialise(df, "step"), "stage")
                drop_but_last(spark, made)
                assert len(made) == 1
            out.append(df)

    kept, outs = materialise(spark.range(5), "kept"), [[], []]
    threads = [threading.Thread(target=run, args=(n, outs[k])) for k, n in enumerate((100, 0))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [o[0].count() for o in outs] == [100, 0] and kept.count() == 5 and new_path(spark, "x")


def test_own_encoding_equals_the_library_on_random_texts(codec):
    """Random mixes of the vocabulary's own tokens, Latin-1, controls and other scripts."""
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(bpe.vocabulary_path()), random.Random(17)
    pieces = [tokenizer.decode([i], skip_special_tokens=False) for i in rng.sample(range(tokenizer.get_vocab_size()), 6000)]
    other = ["é", "Ü", "ß", "\x00", "\x7f", "\xa0", "\xad", " ", "  ", "\n", "\t", "日本", "🙂", "á", "ﬁ", "<|endoftext|>", "1234567", "don't", "—"]
    texts = ["".join(rng.choice(pieces) if rng.random() < 0.7 else rng.choice(other) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    flat, bounds = codec.encode_arrow(pa.array([t.encode() for t in texts], pa.binary()))
    for t, a, z in zip(texts, bounds.tolist(), bounds[1:].tolist(), strict=False):
        assert flat[a:z].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
