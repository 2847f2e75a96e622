"""Operators 11 to 13 against brute-force versions, and on odd tables; their registered queries on whole tables."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import nearest, queries, tokenlinks, vectors, whitening
from barloom.session import Scratch

SF = "/root/testdata/sf0.001"
ROW = "vec_id bigint, embedding array<float>, x binary, v string, n string, w string, ids string"


@pytest.fixture()
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def table(spark, rows):
    return spark.createDataFrame([(i, v, *[None] * 5) for i, v in rows], ROW)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and vectors, null and non-finite components, zero, empty, short and repeated vectors."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(20)]
    rows += [(20, None), (21, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (22, [float("nan")] * 6), (23, [float("inf")] + [0.0] * 5), (24, [0.0] * 6), (25, []), (26, [1.0, 2.0])]
    rows += [(100, rows[0][1]), (150, rows[0][1]), (150, rows[0][1]), (None, rows[1][1]), (200, [3.0e38] * 6), (250, [1e-38] * 6)]
    return table(spark, rows).repartition(3)


# 13: whitening

def exact_fit(rows, scale=256, width=6):
    """x vectors of the rows that take part, by id, and the distinct ones."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    xs = [(i, tuple(int(np.floor(scale * float(c))) for c in list(v) + [0.0] * (width - len(v)))) for i, v in kept]
    xs = [(i, x) for i, x in xs if all(abs(c) < 1 << 63 for c in x)]
    return xs, sorted({x for _, x in xs})


def check_whitening(df, got, width, scale=256, places=1e-7):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    xs, fit = exact_fit(rows, scale, width)
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    found = defaultdict(list)
    for r in got:
        found[r.vec_id, r.component].append(r)
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - max(0, values[r.component - 1]) / values.sum()) <= 1e-4 * r.explained + 1e-12
    for i, x in xs:
        for c in range(1, min(4, width) + 1):
            r = found[i, c].pop()
            assert int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            want = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ axes[:, c - 1] / np.sqrt(values[c - 1])
            assert abs(abs(r.whitened) - abs(want)) <= places * max(1, abs(want))
    assert not any(found.values())


def test_singular_values_and_vectors():
    rng = np.random.default_rng(5)
    for trial in range(40):
        d, m = int(rng.integers(1, 30)), int(rng.integers(1, 60))
        a = rng.normal(size=(m, d)) * 10.0 ** rng.uniform(-6, 3, size=d)
        if trial % 5 == 0:
            a[:, :d // 2] = 0
        if trial % 7 == 0:
            a = np.eye(d) * 3
        if trial % 9 == 0:
            a = np.repeat(a[:1], 5, axis=0)
        r = whitening.triangle(iter([a[:3], a[3:]] if len(a) > 3 else [a]), d)
        q, b, right = whitening.bidiagonal(np.vstack([r, np.zeros((d - len(r), d))]))
        squares = whitening.squared_singular_values(q, b)
        want = np.linalg.svd(a, compute_uv=False)
        want = np.pad(want, (0, d - len(want)))
        top = max(want.max(), 1e-300)
        assert np.abs(np.sqrt(squares) - want).max() <= 1e-13 * top
        z = whitening.twisted_vectors(q, b, squares[:4])
        for i in range(len(right) - 1, -1, -1):
            if right[i] is not None:
                z[:, i + 1:] -= 2 * np.outer(z[:, i + 1:] @ right[i], right[i])
        assert max(np.linalg.norm(a.T @ (a @ v) - s * v) for v, s in zip(z, squares)) <= 1e-12 * top ** 2
        assert np.abs(z @ z.T - np.eye(len(z))).max() <= 1e-11


def test_singular_values_keep_small_digits():
    """A graded bidiagonal matrix: values over 30 orders of magnitude, each to full relative accuracy."""
    a, b = 10.0 ** -np.arange(0, 30, 3.0), 10.0 ** -np.arange(0, 27, 3.0) / 7
    from fractions import Fraction
    got = whitening.squared_singular_values(a, b)
    exact = np.prod([Fraction(float(x)) ** 2 for x in a])  # the squares' product is the squared determinant
    product = Fraction(1)
    for v in got:
        product *= Fraction(float(v))
    assert abs(float(product / exact) - 1) < 1e-12


def test_whitening_against_eigenvectors(spark, scratch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.QUERIES["op13_bidiagonal_qd_whitening"](spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check_whitening(df, got.collect(), 64)


def test_whitening_of_odd_tables(spark, scratch, odd):
    df = odd.filter("vec_id IS NULL OR vec_id NOT IN (200)")
    check_whitening(df, whitening.whiten(df, scratch).collect(), 6, places=1e-6)


def test_whitening_keeps_rows_beyond_64_bits(spark, scratch):
    df = table(spark, [(1, [1e15, 0.0]), (2, [-1e15, 5.0]), (3, [1e30, 1.0]), (4, [1e14, 7.0])])
    got = whitening.whiten(df, scratch).collect()
    assert {r.vec_id for r in got} == {1, 2, 4}  # 256e30 is no bigint
    check_whitening(df, got, 2)
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in ([1e15, 0.0], [-1e15, 5.0], [1e14, 7.0])]
    sums = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in got if r.component == 1}[1] == sum((3 * a - s) ** 2 for a, s in zip(x[0], sums))


def test_whitening_without_directions(spark, scratch):
    assert whitening.whiten(table(spark, []), scratch).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [float("nan")])]), scratch).collect() == []
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])]), scratch).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained == 0 and int(r.deviation) == 0 and r.n == 1 for r in same)
    line = whitening.whiten(table(spark, [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [5.0, 5.0])]), scratch).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and {round(r.explained, 9) for r in line} == {0.0, 1.0}


def test_packed_rows_round_trip():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.integers(-(1 << k), 1 << k, size=(5, 7)) for k in (3, 12, 28, 60)])
    assert (vectors.unpacked_rows(vectors.packed_rows(x), 7) == x).all()
    assert len({*vectors.packed_rows(x)}) == len({tuple(r) for r in x})


# 11: nearest neighbours

def brute_nearest(rows, wanted, k):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    width = max((len(v) for _, v in rows), default=0)
    m = nearest.units(np.array([list(v) + [0.0] * (width - len(v)) for _, v in rows], float).reshape(len(rows), width))
    out = {}
    for j, (q, v) in enumerate(rows):
        if wanted(q):
            scores = sorted(((-float(s), i) for s, (i, _) in zip((m * m[j]).sum(axis=1), rows) if i != q))
            out.setdefault(q, []).append(scores)
    return out


def test_nearest_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 50 == 0, 5)
    got = defaultdict(list)
    for r in queries.QUERIES["op11_adaptive_dimension_scan"](spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].append(r)
    assert set(got) == set(want)
    hits = 0
    for q, (scores,) in want.items():
        rows = sorted(got[q], key=lambda r: r["rank"])
        known = {i: -s for s, i in scores}
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and all(abs(known[r.vec_id] - r.score) < 1e-12 for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len({i for _, i in scores[:5]} & {r.vec_id for r in rows})
    assert hits / (5 * len(want)) >= 0.9


def test_nearest_on_odd_tables(spark, scratch, odd):
    """One centre: the scan alone is exact here. Copies, ties, own ids and short vectors."""
    rows = [(r.vec_id, r.embedding) for r in odd.filter("vec_id <> 26 OR vec_id IS NULL").collect()]
    df = odd.filter("vec_id <> 26 OR vec_id IS NULL")
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0, scratch).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(rows, lambda i: i % 50 == 0, 5)
    assert set(got) == set(want) == {0, 100, 150, 200, 250}
    for q in (0, 100, 150):
        assert [i for _, i, _ in sorted(got[q])][:2] == sorted({0, 100, 150} - {q})
    assert sorted(got[200])[0][1] == 250 and abs(sorted(got[200])[0][2] - 1) < 1e-12
    assert nearest.nearest(table(spark, []), F.col("vec_id") % 50 == 0, scratch).collect() == []
    assert nearest.nearest(table(spark, [(50, [1.0])]), F.col("vec_id") % 50 == 0, scratch).collect() == []
    few = nearest.nearest(table(spark, [(50, [1.0, 0.0]), (51, [1.0]), (52, [0.0, 1.0])]), F.col("vec_id") % 50 == 0, scratch).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in few) == [(1, 51, 1.0), (2, 52, 0.0)]


def test_hot_lists_are_split(spark, scratch, monkeypatch):
    """Small blocks give the same neighbours."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one = {tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 50 == 0, scratch).collect()}
    monkeypatch.setattr(nearest, "CHUNK", 4)
    monkeypatch.setattr(nearest, "ASKED", 2)
    few = {tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 50 == 0, scratch).collect()}
    assert len(few) == len(one) and len(one & few) / len(one) > 0.9


# 12: two tokenizers

@pytest.fixture(scope="module")
def both():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of_letter():
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute_alignment(both, rows):
    first, second = both
    letters = byte_of_letter()
    a_bytes = lambda i: bytes(letters[c] for c in first.id_to_token(i))
    b_bytes = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    counts, kept, out = Counter(), [], []
    for doc, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            kept.append((doc, None))
            continue
        groups, left, right, i, j, a_end, b_end = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if a_end <= b_end and i < len(a):
                left.append(a[i])
                a_end, i = a_end + len(a_bytes(a[i])), i + 1
            else:
                right.append(b[j])
                b_end, j = b_end + len(b_bytes(b[j])), j + 1
            if a_end == b_end and left and right:
                groups.append((left, right))
                left, right = [], []
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        kept.append((doc, (len(a), len(b), groups, links)))
    highest = defaultdict(int)
    for (x, _), c in counts.items():
        highest[x] = max(highest[x], c)
    for doc, found in kept:
        if found is None:
            out.append((doc, 0, 0, 0, 0, "", 0, 0))
            continue
        n_a, n_b, groups, links = found
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        best = sum(counts[x] == highest[x[0]] for x in links)
        out.append((doc, n_a, n_b, len(groups), len(links), hashlib.sha256(shown.encode()).hexdigest(), best, sum(counts[x] for x in links)))
    return out, counts


def same_rows(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


ODD_TEXTS = [
    (1, None), (2, ""), (3, "a▁b"), (4, " "), (5, "x" * 3000), (6, "<|endoftext|> <s> <unk> <0x41>"), (7, "日本語テキスト 😀😀 \x00 \n\t é é"),
    (None, "hello"), (8, "hello"), (8, "hello"), (9, "  lead   spaces   "), (10, "字" * 5000 + "𓀀" * 3000), (11, "aabab" * 4000), (None, None),
]


def test_alignment_of_odd_texts(spark, scratch, both):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in ODD_TEXTS], "doc_id bigint, text string, run string, data string").repartition(3)
    want, counts = brute_alignment(both, ODD_TEXTS)
    for fan in (1, 2, 64):  # small runs and fans: several runs a task, several merges
        got = tokenlinks.align(df, scratch, run_records=400, fan=fan)
        assert same_rows(map(tuple, got.collect()), want)
    pairs = tokenlinks.pair_counts(df, scratch, run_records=400, fan=2).collect()
    assert {(r.a_id, r.b_id): r.documents for r in pairs} == dict(counts) and len(pairs) == len(counts)
    assert tokenlinks.align(df.limit(0), scratch).collect() == []


def test_wide_groups_are_counted(spark, scratch, both, monkeypatch):
    monkeypatch.setattr(tokenlinks, "WIDE", 2)
    tokenlinks.opened.cache_clear()
    pair = tokenlinks.opened(*tokenlinks.default_paths())
    text = "日本語 aabab antidisestablishmentarianism 字字字"
    wide = tokenlinks.links_of(pair, *pair.tokens(text))
    monkeypatch.setattr(tokenlinks, "WIDE", 1 << 40)
    plain = tokenlinks.links_of(pair, *pair.tokens(text))
    assert wide[:3] == plain[:3] and (wide[3] == plain[3]).all() and (wide[4] == plain[4]).all()


def test_alignment_query_on_a_whole_table(spark, both):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op12_external_spill_alignment"](spark, SF)
    assert same_rows(map(tuple, got.collect()), brute_alignment(both, [(r.doc_id, r.text) for r in docs.collect()])[0])


def test_merge_by_heap():
    rng = np.random.default_rng(2)
    total, lists = Counter(), []
    for _ in range(7):
        codes = np.unique(rng.integers(0, 5000, size=int(rng.integers(1, 2000))))
        counts = rng.integers(1, 9, size=len(codes))
        total.update(dict(zip(codes.tolist(), counts.tolist())))
        lists.append([tokenlinks.squeezed(tokenlinks.steps_of(codes[i:i + 50]), counts[i:i + 50]) for i in range(0, len(codes), 50)])
    got = [(int(c), int(k)) for cs, ks in tokenlinks.merged([*lists, []]) for c, k in zip(cs, ks)]
    assert got == sorted(total.items())
