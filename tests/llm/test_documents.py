"""Operators over documents against plain forms of the same, on rows with every odd case."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from tokenizers import Tokenizer

from weftline.llm import bpe_automaton, near_dup, packing, quality, secret_scan, sharding, syncmers, token_files, toxicity, vocab

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def order(row):
    return (row[0] is not None, row[0] or 0)


# --- 1 secrets


def plain_base(text):
    found = []
    for k, (kind, shape, least) in enumerate(
        [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12), ("access", re.compile("AKIA[A-Z0-9]+"), 18), ("hex", re.compile("[0-9a-f]+"), 16)]
    ):
        for m in shape.finditer(text):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(found))


def test_secret_base_spans(spark):
    rng = random.Random(1)
    parts = ["password", "Secret", "API_KEY", "apikey", "toKen", "ſecret", " = ", ":", "'", '"', "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "x", " ", "\n", "é", "=", "abc/+_.-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.secret_digests(df).collect():
        expected = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest()
        assert not set(filter(None, expected.split(","))) - set(r["spans"].split(","))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(expected.count(k + ":") for k in ("assign", "access", "hex"))


@pytest.mark.parametrize(
    "text, secrets",
    [
        ('x = "hunter2Zq9!kd"\npassword = x', ["hunter2Zq9!kd"]),
        ("a = 'part1Xy' + 'part2Zz9'\nb = a\nclient_secret = b", ["part1Xy", "part2Zz9"]),
        ('{"db": {"passphrase": "C0rrect-Horse9"}}', ["C0rrect-Horse9"]),
        ("url: postgres://bob:s3cretPw9@db/x", ["s3cretPw9"]),
        ("authToken := `eyJhbGciOi9`", ["eyJhbGciOi9"]),
        ("password = changeme123\nname = 'hunter2Zq9!kd'", []),
        ("the secret: something that nobody says", []),
    ],
)
def test_assignments_are_followed(text, secrets):
    found = secret_scan.all_findings(text)[1]
    assert [text[f.start : f.end] for f in found] == secrets
    assert not any(s in secret_scan.redacted(text) for s in secrets)


SECRET = "".join(random.Random(9).choices("abcdefghijkmnpqrsuvwyzABCDEFGHKLMNPQRSTUVWXYZ23456789", k=1211))


@pytest.mark.parametrize("text", [f"jwt = -{SECRET}", f"jwt{' ' * 40}= -{SECRET}", f"x{'_y' * 60}_credential: -{SECRET}", f"'{'a b' * 40} credential' : '-{SECRET}'", f"redis://:-{SECRET}@host", f"redis://{'u' * 90}:-{SECRET}@host"])
def test_lexed_literals_are_whole(text):
    assert [text[f.start : f.end] for f in secret_scan.all_findings(text)[1]] == ["-" + SECRET]
    assert SECRET[-9:] not in secret_scan.redacted(text)


@pytest.mark.parametrize(
    ("text", "secrets"),
    [
        ('db_password: str = "hunter2Ab9xQ"', ["hunter2Ab9xQ"]),
        ('let api_key: &\'static str = "kQ8zR2mW7x1P";', ["kQ8zR2mW7x1P"]),
        ('auth_token: Optional[str] = "kQ8zR2mW7x1P"', ["kQ8zR2mW7x1P"]),
        ('def f(token: str, title="Plain4Title99"): pass', []),
        ('if passwd == "hunter2Ab9xQ" or a != "b":', ["hunter2Ab9xQ"]),
        ('pwd === "hunter2Ab9xQ"\nother = pwd', ["hunter2Ab9xQ"]),
        ("client_secret: |\n    kQ8zR2mW7x1P\n    Zz81kd02LQpa\nnext: 1", ["kQ8zR2mW7x1P", "Zz81kd02LQpa"]),
        ("<clientSecret>\n kQ8zR2mW7x1P\n</clientSecret>", ["kQ8zR2mW7x1P"]),
        ('<add key="DbPassword" value="kQ8zR2mW7x1P" />', ["kQ8zR2mW7x1P"]),
        ('passphrase = """kQ8zR2mW7x1P"""', ["kQ8zR2mW7x1P"]),
        ("credential = \'\'\'\n  kQ8zR2mW7x1P\n\'\'\'", ["kQ8zR2mW7x1P"]),
        ('jwt = b"kQ8zR2mW7x1P"', ["kQ8zR2mW7x1P"]),
        ('jwt = "" + "kQ8zR2mW7x1P"', ["kQ8zR2mW7x1P"]),
    ],
)
def test_other_forms_of_assignment(text, secrets):
    found = secret_scan.lexed_findings(text)
    assert [text[f.start : f.end] for f in found] == secrets
    assert not any(s in secret_scan.redacted(text) for s in secrets)


def test_long_odd_texts_are_read_in_linear_time():
    pieces = ['a = """', "k: |\n ", "<b>" * 3, "x: y = ", "'" * 3, "p == ", "\\" * 5, 'key="a" ', "|\n  z"]
    for piece in pieces:
        began = time.process_time()
        secret_scan.all_findings(piece * (400_000 // len(piece)))
        assert time.process_time() - began < 20


def test_operators_within_a_long_literal():
    text = "jwt=" * 30 + "aB3"
    runs = {(f.start, f.score) for f in secret_scan.lexed_findings(text)}
    assert runs == {(k, score) for k in range(4, 121, 4) if (score := round(0.9 * secret_scan.literal_strength(text[k:], False), 4)) >= secret_scan.THRESHOLD}
    assert len(secret_scan.lexed_findings("jwt=" * 10000 + "aB3" * 1000)) > 100


def test_secrets_of_odd_rows(edges, nothing, edge_rows):
    assert secret_scan.secret_digests(edges).count() == len(edge_rows)
    assert secret_scan.secret_digests(nothing).isEmpty() and secret_scan.find_secrets(nothing).isEmpty()
    redacted = secret_scan.redact_documents(edges)
    assert redacted.schema == edges.schema and redacted.exceptAll(edges).isEmpty()


# --- 2 shards


def best_capacity(sizes, shards):
    """The smallest possible largest shard, by trying every cut."""
    best = {0: 0}
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(shards):
        best = {i: min(max(best[j], ends[i] - ends[j]) for j in best if j <= i) for i in range(len(ends))}
    return best[len(sizes)]


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_smallest(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 40))]
    shards = rng.randint(1, 8)
    ends = list(np.cumsum(sizes))
    capacity = sharding.smallest_capacity(ends, shards)
    assert capacity == best_capacity(sizes, shards)
    cuts = [0, *sharding.balanced_cuts(ends, capacity, shards), len(ends)]
    assert cuts == sorted(cuts) and len(cuts) == shards + 1
    assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) <= capacity


def test_shards(edges, nothing, edge_rows):
    out = sharding.shard_documents(edges, shards=5).toPandas()
    assert Counter((r["size"], r["text_crc32"]) for _, r in out.iterrows()) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in edge_rows)
    assert (out.groupby("text_crc32").shard.nunique() == 1).all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    groups = defaultdict(int)
    for _, t in edge_rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    largest = out.groupby("shard")["size"].sum().max()
    own = max(groups.values())
    rest = [groups[k] for k in sorted(groups)]
    assert largest == max(own, min(best_capacity([v for k, v in sorted(groups.items()) if v not in sorted(groups.values())[-n:]] if n else rest, 5 - n) for n in range(4)))
    assert sharding.shard_documents(nothing).isEmpty()


def test_one_huge_group_and_many_small_ones(spark):
    df = spark.createDataFrame([(i, "hot " * 50) for i in range(60)] + [(100 + i, f"cold {i}") for i in range(200)], "doc_id long, text string")
    sums = sharding.shard_documents(df, shards=4).groupBy("shard").sum("size").toPandas()["sum(size)"].sort_values().tolist()
    assert len(sums) == 4 and sums[-1] == 60 * 208 and max(sums[:-1]) - min(sums[:-1]) < 60


# --- 3 packing, 6 token files


@pytest.fixture(scope="module")
def byte_ids(edge_rows):
    tok = Tokenizer.from_file(BYTE)
    return {(i, t): [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in edge_rows}


def test_packing(edges, nothing, byte_ids, edge_rows):
    out = packing.pack_documents(edges, BYTE).toPandas()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        n = g.length.sum()
        assert n == 1024 or (n < 1024 and n & (n - 1) == 0)
    ids = {r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in out.itertuples()}
    assert ids == {True}
    assert out.length.sum() == sum(len(byte_ids[i, t]) for i, t in edge_rows)
    for doc_id, g in out.groupby("doc_id"):
        copies = [byte_ids[i, t] for i, t in edge_rows if i == doc_id]
        g = g.sort_values(["start"])
        assert g.length.sum() == sum(map(len, copies)) and set(g.doc_tokens) == {len(c) for c in copies}
        for r in g.itertuples():
            assert any(np.array(c[r.start : r.start + r.length], "<u4").tobytes() == r.ids for c in copies)
    assert packing.pack_documents(nothing, BYTE).isEmpty()


def test_bm25_finds_what_a_full_comparison_finds():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 400, rng.integers(5, 60)) for _ in range(40)]
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    frequency = np.zeros(400, np.int64)
    for d in docs:
        frequency[np.unique(d)] += 1
    stats = packing.TermStatistics(40, ends[-1] / 40, frequency)
    index, idf = packing.InvertedIndex(ids, ends, stats), stats.idf()

    def weight(term, doc):
        tf = (docs[doc] == term).sum()
        shrink = packing.K1 * (1 - packing.B + packing.B * len(docs[doc]) / stats.mean_tokens)
        return idf[term] * tf * (packing.K1 + 1) / (tf + shrink) if tf else 0.0

    for seed in range(40):
        scores = np.array([sum(weight(t, d) for t in set(docs[seed].tolist())) for d in range(40)])
        unused = np.ones(40, np.float32)
        unused[seed] = 0
        found = list(index.neighbours(seed, unused))
        best = sorted((d for d in range(40) if d != seed and scores[d] > 0), key=lambda d: -scores[d])
        assert sorted(found) == sorted(best) and np.allclose(scores[found], scores[best], rtol=1e-4)


def plain_packing(docs, documents, mean, frequency):
    """Pieces by the rules, one document after the other: (document, start, length, sequence, offset)."""
    n = len(docs)
    counts = [Counter(d) for d in docs]

    def score(seed, d):
        out = 0.0
        for t in sorted(counts[seed]):
            if tf := counts[d][t]:
                idf = math.log1p((documents - frequency[t] + 0.5) / (frequency[t] + 0.5))
                out += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean))
        return out

    left, order, room, ranked, seed = list(range(n)), [], 0, [], None
    while left:
        if room == 0:
            ranked = []
        elif seed is not None:
            scored = [(d, score(seed, d)) for d in left]
            ranked, seed = [d for d, s in sorted(scored, key=lambda x: (-round(x[1], 4), x[0])) if s > 0], None
        doc = ranked.pop(0) if ranked else left[0]
        left.remove(doc)
        order.append(doc)
        if room == 0 or len(docs[doc]) >= room:
            seed = doc
        room = (room - len(docs[doc])) % packing.WINDOW
    stream = [(d, k) for d in order for k in range(len(docs[d]))]
    rooms = [packing.WINDOW] * (len(stream) // packing.WINDOW)
    rest = len(stream) % packing.WINDOW
    rooms += [1 << k for k in range(10, -1, -1) if rest >> k & 1]
    pieces, at = [], 0
    for sequence, size in enumerate(rooms):
        for offset, (d, k) in enumerate(stream[at : at + size]):
            if pieces and pieces[-1][0] == d and pieces[-1][3] == sequence and pieces[-1][1] + pieces[-1][2] == k:
                pieces[-1][2] += 1
            else:
                pieces.append([d, k, 1, sequence, offset])
        at += size
    return sorted(map(tuple, pieces))


@pytest.mark.parametrize("seed", range(4))
def test_packing_equals_a_plain_one(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 600, rng.integers(1, 90 if seed % 2 else 1600)) + 300 * rng.integers(0, 3) for _ in range(70)]
    docs += [docs[3], docs[3], docs[8]]
    frequency = np.zeros(1200, np.int64)
    for d in docs:
        frequency[np.unique(d)] += 1
    ends = np.cumsum([len(d) for d in docs])
    stats = packing.TermStatistics(len(docs), ends[-1] / len(docs), frequency)
    made = packing.pack_shard([len(d) for d in docs], packing.InvertedIndex(np.concatenate(docs), ends, stats))
    assert sorted(zip(made.doc, made.start, made.length, made.sequence, made.offset, strict=True)) == plain_packing([d.tolist() for d in docs], len(docs), stats.mean_tokens, frequency)


def test_splits_keep_like_vectors_together():
    rng = np.random.default_rng(1)
    vectors = np.repeat(rng.standard_normal((20, packing.PROJECTIONS)), 50, 0) + 0.01 * rng.standard_normal((1000, packing.PROJECTIONS))
    tree = packing.learn_tree(vectors, np.ones(1000), 130)
    leaves = tree.leaves(vectors)
    sizes = np.unique(leaves, return_counts=True)[1]
    assert sizes.sum() == 1000 and sizes.max() <= 130 and len(sizes) >= 8
    assert sum(len(set(leaves[k : k + 50])) > 1 for k in range(0, 1000, 50)) <= 8
    assert len(packing.learn_tree(vectors[:1].repeat(90, 0), np.ones(90), 10).below) == 1
    assert packing.learn_tree(np.zeros((0, packing.PROJECTIONS)), np.zeros(0), 10).leaves(np.zeros((0, packing.PROJECTIONS))).size == 0


def bm25_index(docs, terms):
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    frequency = np.zeros(terms, np.int64)
    for d in docs:
        frequency[np.unique(d)] += 1
    return packing.InvertedIndex(ids, ends, packing.TermStatistics(len(docs), ends[-1] / len(docs), frequency))


def test_short_neighbours_fill_the_window():
    """One that shares only the seed's lightest terms, and far more than 16 short ones."""
    rest = [np.arange(1000 + 20 * k, 1020 + 20 * k) for k in range(100)]
    near = [np.r_[k % 20, np.arange(5000 + 19 * k, 5019 + 19 * k)] for k in range(40)]
    docs = [np.arange(400), *rest, *near]
    index = bm25_index(docs, 6000)
    unused = np.ones(len(docs), np.float32)
    unused[0] = 0
    assert sorted(index.neighbours(0, unused)) == list(range(101, 141))
    order = list(packing.pack_order([len(d) for d in docs], index))
    assert order[0] == 0 and set(order[1:33]) <= set(range(101, 141))


def test_copies_in_over_a_quarter_of_the_documents_are_neighbours():
    docs = [np.arange(20) if k % 3 == 0 else np.arange(20 + 20 * k, 40 + 20 * k) for k in range(30)]
    unused = np.ones(30, np.float32)
    unused[0] = 0
    assert list(bm25_index(docs, 700).neighbours(0, unused)) == list(range(3, 30, 3))


@pytest.mark.parametrize("row", [(0, ""), (1, " {}")])
def test_copies_are_split_over_shards(spark, monkeypatch, row):
    """Rows with one id and text, or alike ones."""
    monkeypatch.setattr(packing, "SHARD_DOCUMENTS", 50)
    df = spark.createDataFrame([(i * row[0], "the same words again and again" + row[1].format(i)) for i in range(300)], "doc_id long, text string")
    out = packing.pack_documents(df, BYTE, with_ids=False).toPandas()
    documents = out[out.start == 0].groupby(out.sequence_id // 2**32).size()
    assert len(documents) >= 6 and documents.max() < 90 and documents.sum() == 300 and out.length.sum() == out[out.start == 0].doc_tokens.sum()


def test_byte_level_ids_equal_the_library():
    rng, tok, enc = random.Random(2), Tokenizer.from_file(BYTE), vocab.ByteLevelEncoder(BYTE)
    for alphabet in ("ab  \n\n'sté×ßÉ12\t\r\x1c  日本.!?$%_ǅ'll'd", "ab  \n'stéßÉ12.!?'lldvrem"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_rank_code_round_trip(n):
    ranks = np.random.default_rng(n).choice(np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32), n)
    control, data = token_files.encode_ranks(ranks)
    assert len(control) == -(-n // 4) and (token_files.decode_ranks(control, data, n) == ranks).all()
    content = token_files.pack_file([None, 5], np.array([0, n]), ranks)
    ids, lengths, back = token_files.unpack_file(content)
    assert ids == [None, 5] and lengths.tolist() == [0, n] and (back == ranks).all()
    with pytest.raises(ValueError):
        token_files.unpack_file(content[:-1] + b"\xff\xff")


def test_token_files(spark, edges, nothing, byte_ids, edge_rows):
    files = token_files.write_token_files(edges, BYTE, ids_per_file=3000)
    assert files.manifest.count() > 3
    out = sorted(map(tuple, token_files.read_token_files(spark, files).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [i for i, _ in sorted(edge_rows, key=order)]
    assert [r[1] for r in out] == [0, *np.cumsum([r[2] for r in out])[:-1]]
    assert Counter((r[0], r[2], r[3]) for r in out) == Counter((i, len(byte_ids[i, t]), zlib.crc32(np.array(byte_ids[i, t], "<u4").tobytes())) for i, t in edge_rows)
    assert token_files.read_token_files(spark, token_files.write_token_files(nothing, BYTE)).isEmpty()
    same = spark.createDataFrame([(None if k % 2 else 1, "the same words once more") for k in range(3000)], "doc_id long, text string")
    files = token_files.write_token_files(same, BYTE, ids_per_file=2000)
    sizes = [r["ids"] for r in files.manifest.collect()]
    assert len(sizes) > 3 and max(sizes) < sum(sizes) / 2
    out = sorted(map(tuple, token_files.read_token_files(spark, files).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [None] * 1500 + [1] * 1500 and [r[1] for r in out] == [k * out[0][2] for k in range(3000)]


# --- 5 automaton


def test_automaton_equals_the_library(edges, nothing, edge_rows):
    tok = Tokenizer.from_file(WORD)

    def expected(text):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(map(tuple, bpe_automaton.round_trip_digests(edges, WORD).collect())) == Counter((i, *expected(t)) for i, t in edge_rows)
    assert bpe_automaton.round_trip_digests(nothing, WORD).isEmpty()
    some = edges.where("doc_id < 5").select("doc_id", "text")
    decoded = bpe_automaton.decode_documents(bpe_automaton.encode_documents(some, WORD), WORD)
    assert {r["text"] for r in decoded.collect()} == {tok.decode(tok.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in edge_rows if i is not None and i < 5}


@pytest.mark.parametrize("seed", range(40))
def test_automaton_of_random_merges(seed):
    """Every word over a small alphabet is coded as merging step by step codes it."""
    rng = random.Random(seed)
    tokens, merges = list("abc"), []
    while len(tokens) < 20:
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens and len(u + v) < 8:
            merges.append((u, v))
            tokens.append(u + v)
    ids = {t: k for k, t in enumerate(tokens)}
    automaton = bpe_automaton.MergeAutomaton(len(tokens), [(ids[u], ids[v], ids[u + v]) for u, v in merges])

    def merged(word):
        parts = list(word)
        for u, v in merges:
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == (u, v):
                    parts[k : k + 2] = [u + v]
                k += 1
        return [ids[p] for p in parts]

    encoder = object.__new__(bpe_automaton.AutomatonEncoder)
    arcs = {t: k for t, k in ids.items() if automaton.arcs[k]}
    encoder.automaton, encoder.inner, encoder.final, encoder.longest = automaton, arcs, arcs, 8
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        assert encoder.word_ids(word) == merged(word)


# --- 4 near-duplicates


def plain_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return Counter((i, len(sets[k]), names.get(find(k), i)) for k, (i, _) in enumerate(rows))


def test_near_duplicates(edges, nothing, edge_rows):
    out = near_dup.near_duplicates(edges).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == plain_groups(edge_rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert near_dup.near_duplicates(nothing).isEmpty()


def test_rows_without_an_id_are_compared(spark):
    words = [f"w{k}" for k in range(80)]
    near, other = " ".join([*words[:78], "x", "y"]), " ".join(f"v{k}" for k in range(60))
    rows = [(1, " ".join(words)), (None, near), (None, near), (None, other), (None, other + " z"), (7, "far away")]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in out) == Counter([(1, 76, 1, True), (None, 76, 1, False), (None, 76, 1, False), (None, 56, None, True), (None, 57, None, True), (7, 1, 7, True)])


def test_one_row_of_a_group_stays(spark, edges, nothing, edge_rows):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(3, base, 1), (5, base + " more", 2), (5, "an unrelated text that stays", 3), (9, "twice", 4), (9, "twice", 4), (9, "Twice", 5), (None, "twice", 6), (4, None, 7), (4, None, 7), (None, base + " again", 8)]
    out = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, key int"))
    kept = sorted((tuple(r) for r in out.collect()), key=str)
    assert out.columns == ["doc_id", "text", "key"]
    assert [r for r in kept if r[0] != 9] == sorted([(3, base, 1), (5, "an unrelated text that stays", 3), (4, None, 7), (4, None, 7)], key=str)
    assert len([r for r in kept if r[0] == 9]) == 1
    left = Counter(r["text"] for r in near_dup.keep_one(edges).collect())
    groups = {}
    for r in near_dup.near_duplicates(edges.select("doc_id", "text")).collect():
        groups.setdefault(r["component_id"], []).append(r)
    words = [t for _, t in edge_rows if (t or "").split()]
    assert sum(left.values()) == len(edge_rows) - len(words) + len({g for g, of in groups.items() if of[0]["n_shingles"]}) and left[None] == 2
    assert near_dup.keep_one(nothing).isEmpty()


def variants(n, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    return rows


SMALL = (("LEAF", 12), ("CLUSTER", 20), ("PART", 10), ("SHARED", 4), ("DEPTH", 3), ("SAMPLE", 8))


@pytest.mark.parametrize("settings", [SMALL, (*SMALL, ("HELD", 15), ("DRAWN", 10)), (*SMALL, ("HELD", 15), ("DRAWN", 10**6)), (("HELD", 40), ("LEAF", 20), ("CLUSTER_BYTES", 2000)), (("PART", 16), ("ONE_BY_ONE", 5), ("CHUNK", 64), ("LEAF", 40))])
def test_groups_larger_than_a_leaf_and_a_task(spark, monkeypatch, settings):
    for name, value in settings:
        monkeypatch.setattr(near_dup, name, value)
    shared = " ".join(f"s{k}" for k in range(30))
    rows = variants(90, 6, 1) + [(1000 + k, shared + " " + " ".join(f"u{k}x{j}" for j in range(80))) for k in range(60)]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == plain_groups(rows)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 800).astype(np.uint64) * np.uint64(2))
    y = np.unique(np.concatenate([x[:720], rng.integers(0, 2**63, 80).astype(np.uint64) * np.uint64(2)]))
    sketches = np.frombuffer(near_dup.sketch_of(near_dup.minwise_tokens(x)).tobytes() + near_dup.sketch_of(near_dup.minwise_tokens(y)).tobytes(), np.uint8).reshape(2, -1)
    estimate, least = near_dup.similarities(sketches)
    assert abs(estimate[0, 1] - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.09 and least[0, 1] < 0.75


# --- 7 fingerprints


def chained(values):
    """Spark's xxhash64 of several values."""
    seed = 42
    for v in values:
        raw = v if isinstance(v, bytes) else struct.pack("<q" if abs(v) > 2**31 else "<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_anchors(tokens):
    hashes = [chained([w.encode()]) for w in tokens]
    found = [(k, chained(hashes[k : k + 5])) for k in range(len(hashes) - 4) if min(hashes[k : k + 5]) in (hashes[k], hashes[k + 4])]
    return found or ([(0, chained(hashes))] if hashes else [])


def plain_fingerprint(text):
    spaced = regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Khmer}\p{Lao}\p{Myanmar}])", r" \1 ", text)
    words = [c for w in re.split(r"[ \t\n\x0b\f\r]+", spaced) if w for c in (w if len(w) > 32 else [w])]
    characters = [c for c in text if c not in " \t\n\x0b\f\r"] if len(text) < 512 else []
    return plain_anchors(words), plain_anchors(characters)


def plain_links(fingerprint):
    out = set()
    for kind, found in enumerate(fingerprint):
        if len(found) == 1:
            out.add((kind, found[0][1]))
        out |= {(kind, a[1], b[1], b[0] - a[0]) for a, b in zip(found, found[1:])}
    return out


def plain_text(fingerprint):
    words, characters = ("".join(f"{k - before:x}{a & 0xFFFFFFFF:08x}" for (before, _), (k, a) in zip([(0, 0), *found], found)) for found in fingerprint)
    return words + (";" + characters if characters else "")


def plain_likeness(a, b):
    a, b = plain_links(a), plain_links(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(edges, nothing, edge_rows):
    """Every column equals a plain reckoning, rows of equal ids in the order of their text's hash."""
    by_id = sorted(((i, t or "") for i, t in edge_rows), key=lambda r: (r[0] is not None, r[0] or 0, chained([r[1].encode()])))
    expected = []
    for (i, t), (_, following) in zip(by_id, [*by_id[1:], by_id[0]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, new, other = map(plain_fingerprint, (t, edited, following))
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_text(own), plain_text(new), plain_likeness(own, new), plain_likeness(own, other)))
    found = syncmers.edited_fingerprints(edges)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert syncmers.edited_fingerprints(nothing).isEmpty() and syncmers.anchors(nothing).isEmpty()


def test_a_shared_passage_counts_wherever_it_stands(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, " ".join([*words[:2500], passage, *words[2500:3000]])), (2, " ".join([passage, *words[3000:]])), (3, "a" * 900), (4, "unbroken" * 90)]
    out = {r["doc_id"]: r for r in syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0 < out[1]["near_next"] < 0.05 and out[1]["near_edited"] > 0.3
    assert out[4]["near_edited"] > 0 and out[3]["near_edited"] > 0


def test_ranges_do_not_change_the_result(edges, monkeypatch):
    whole = {tuple(r) for r in syncmers.edited_fingerprints(edges).collect()}
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 2000)
    assert {tuple(r) for r in syncmers.edited_fingerprints(edges).collect()} == whole


def test_anchors_are_closed_syncmers(spark):
    words = [f"w{random.Random(k).randrange(1000)}" for k in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "lead in " + " ".join(words[50:]))], "doc_id long, text string")
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w)").collect()]
    expected = {k for k in range(len(words) - 4) if min(hashes[k : k + 5]) in (hashes[k], hashes[k + 4])}
    found = defaultdict(dict)
    for r in syncmers.anchors(df).collect():
        found[r["doc_id"]][r["position"]] = r["anchor"]
    assert set(found[1]) == expected
    assert all(found[2].get(k - 48) == found[1][k] for k in expected if k >= 50)


# --- 9 toxicity, 10 quality


def labelled(spark, n=1200):
    rng, rows, labels = random.Random(4), [], []
    for k in range(n):
        toxic = k % 8 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(40)] + (["vileword", "nastyness"] if toxic else [])
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_texts(spark):
    _, docs, labels = labelled(spark)
    out = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97 and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_held_out_labels_are_never_learned(spark):
    rows, docs, labels = labelled(spark, 400)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(string(doc_id) as binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.toxicity_scores(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_toxicity_of_odd_rows(spark, edges, nothing, edge_rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9999, 1), (3, 0), (4, 1), (6, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(edges, labels).collect()
    assert len(out) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity_scores(nothing, labels).isEmpty()
    assert {r["score"] < 1e-6 for r in toxicity.toxicity_scores(edges, labels.limit(0)).collect()} == {True}


def test_a_negative_rest_is_pushed_back():
    """A prior that overstates the toxic share makes the clean part negative, which must not let the scores run away."""
    rng = np.random.default_rng(6)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    texts = [rng.choice(np.arange(10, 300), 12, replace=False) for _ in range(400)]
    for k in range(0, 100):
        texts[k] = np.concatenate([texts[k], [k % 10]])
    positive, unlabelled = np.zeros(400), np.ones(400)
    positive[:50] = 1
    unlabelled[:50] = 0
    model = toxicity.fit(toxicity.Incidence.of(texts, len(words)), toxicity.parts_of_words(words), positive, unlabelled, 0.5)
    weight = np.array([model.word_weight(w) for w in words])
    scores = np.array([weight[t].sum() + model.bias for t in texts])
    assert scores[50:100].mean() > scores[100:].mean() + 0.3 and np.abs(scores).max() < 60


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    accuracy, good = np.array([0.95, 0.9, 0.85, 0.7, 0.6]), rng.random(20000) < 0.7
    votes = np.where(rng.random((20000, 5)) < accuracy, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random((20000, 5)) < 0.3] = quality.SILENT
    model = quality.fit_label_model(dict(Counter("".join(map(str, v)) for v in votes)))
    assert abs(model.good - 0.7) < 0.03 and np.abs(model.accuracy - accuracy).max() < 0.04


def test_shapes_are_of_whole_tokens():
    facts = quality.facts_of("x" * 64 + "!" * 5000)
    assert dict(facts.shapes) == {"l!+": 1} and facts.signs == facts.shouting == 1


def test_patterns_of_copies_are_learned_from(spark, monkeypatch):
    """One text of each pattern, and patterns of 3,000 copies of one text."""
    seen = []
    fit = quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda rows, target, weight: seen.append(len(rows)) or fit(rows, target, weight))
    monkeypatch.setattr(quality, "OF_PATTERN", 1)
    junk = ["!!! ??? !!! ???", "1 2 3 4 5 6 7", "AAA BBB CCC DDD EEE"]
    assert len({quality.votes_of(quality.facts_of(t)) for t in junk}) == 3
    rows, names = quality._analysed(spark.createDataFrame([(t,) for t in junk for _ in range(3000)], "text string"), "text", keep_text=False)
    quality.train(rows.toDF("digest", "votes", "features"))
    assert seen == [3]


def test_quality(spark, edges, nothing, edge_rows):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice((2, 2, 3, 5, 7))))
    good = [" ".join(word() for _ in range(80)) + "." for _ in range(240)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(20)] + [" | ".join(word() + "xyz" for _ in range(50)) for _ in range(20)] + ["again " * 90 for _ in range(20)]
    df = spark.createDataFrame(list(enumerate([*good, *bad])), "doc_id long, text string")
    out = quality.quality_scores(df).toPandas().sort_values("doc_id")
    assert (out.kept.values == [True] * 240 + [False] * 60).mean() > 0.97 and out.kept[:240].mean() > 0.99
    assert quality.keep_good(df).count() == out.kept.sum()
    odd = quality.quality_scores(edges).collect()
    assert len(odd) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.keep_good(edges).schema == edges.schema
    assert quality.quality_scores(nothing).isEmpty() and quality.keep_good(nothing).isEmpty()
