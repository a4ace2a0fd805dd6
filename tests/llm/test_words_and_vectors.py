"""Whitening, token counts and spelling variants against plain versions, on small and awkward inputs."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from schemaloom.llm import batches, queries, token_counts, variants, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n long, word string, n_tokens double"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, rows):
    """A documents table with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, -1, "x", 0.5) for i, t in rows], DOCS)


# ---- op 11 -----------------------------------------------------------------------

VECS = "vec_id long, embedding array<double>, n long, x0 long, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, -1, -1, "?") for i, v in rows], VECS)


def plain_whitening(rows):
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    away = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    c = np.array(x, float) - np.array(s) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    return away, c, e[::-1], w[:, ::-1]


def test_whitening_matches_a_plain_version(spark):
    rng = np.random.default_rng(5)
    good = [(k, rng.normal(size=12).tolist()) for k in range(300)]
    good += [(7, good[7][1]), (None, good[3][1]), (900, [0.0] * 12)]  # a repeated row, a null id, a zero vector
    bad = [(901, None), (902, [None] + [0.1] * 11), (903, [math.nan] * 12), (904, [math.inf] + [0.0] * 11), (905, []), (906, [1.0] * 11)]
    out = whitening.whiten(vectors(spark, good + bad).repartition(5), 8).toPandas()
    away, c, e, w = plain_whitening(good)
    assert len(out) == 8 * len(good) and set(out["n"]) == {len(good)} and out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9
    key = lambda i: -1 if i is None or i != i else int(i)
    want = collections.Counter((key(i), a) for (i, _), a in zip(good, away, strict=True))
    assert collections.Counter((key(i), a) for i, a, k in zip(out["vec_id"], out["deviation"], out["component"], strict=True) if k == 1) == want
    for k in range(8):
        rows = out[out["component"] == k + 1]
        assert np.allclose(rows["explained"], e[k] / e.sum(), rtol=1e-12)
        got = {key(i): v for i, v in zip(rows["vec_id"], rows["whitened"], strict=True)}
        plain = {key(i): v for (i, _), v in zip(good, c @ w[:, k] / np.sqrt(e[k]), strict=True)}
        sign = np.sign(got[0] * plain[0])
        assert got.keys() == plain.keys() and all(abs(got[i] * sign - plain[i]) < 1e-9 for i in got)


def test_whitening_of_few_and_extreme_vectors(spark):
    flat = whitening.whiten(vectors(spark, [(1, [0.5, 0.5])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat] == [(1, 0, 0.0, None, None), (2, 0, 0.0, None, None)]
    line = whitening.whiten(vectors(spark, [(k, [float(k), 1.0, -float(k)]) for k in range(4)])).toPandas()
    assert len(line) == 12 and line["identity_error"][0] < 1e-9
    assert (line[line["component"] > 1]["whitened"] == 0).all() and np.allclose(line[line["component"] == 1]["explained"], 1)
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] < 3) and all(math.isfinite(r["whitened"]) for r in huge)
    wide = [(k, [1e6 * (k % 7), float(k)]) for k in range(50)]  # squares beyond 2**53, still longs
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vectors(spark, wide)).collect()}
    assert got == {i: a if a < 1 << 63 else None for (i, _), a in zip(wide, plain_whitening(wide)[0], strict=True)}
    for rows in ([], [(1, None)], [(1, []), (2, [])]):
        assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_pairs_in_several_passes(spark, monkeypatch):
    rows = [(k, [math.sin(k * (j + 1)) for j in range(6)]) for k in range(40)]
    want = whitening.fit(vectors(spark, rows)).covariance
    monkeypatch.setattr(whitening, "PAIRS", 7)
    assert np.allclose(whitening.fit(vectors(spark, rows)).covariance, want, rtol=1e-12)


# ---- op 12 -----------------------------------------------------------------------

AWKWARD = [None, "", " ", "\n\n", "it's  we'll\n\n x ", "é×÷ü ½ª", "日本語 テスト 123 ４５", "a\x1cb \x1c c", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext|", "😀 😀😀  😀", "x" * 50_000, "a　b \xa0 c", "the " * 30_000]


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = AWKWARD + ["".join(rng.choice([" ", "\n", "a", "b", "1", "!", "'s", "é", "×", "日", "<|endoftext|>", "the ", " zzz"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    rows = [*enumerate(texts), (None, "one two"), (3, texts[4])]
    lib = Tokenizer.from_file(BPE)
    want = collections.Counter()
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 30] += 1
    got = token_counts.count_tokens(docs(spark, rows).repartition(4), BPE, 30)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert token_counts.count_tokens(docs(spark, []), BPE).collect() == []


def test_most_words_take_the_shortcut():
    counter = token_counts.Counter(BPE, token_counts._table(token_counts.whole_tokens(BPE)))
    text = "The people of the country were there, and the water was cold. 2024 Zyxxqv!"
    s = next(batches.slices([pa.RecordBatch.from_pydict({"text": pa.array([text.encode()], pa.binary())})]))
    assert token_counts.slice_counts(s, counter, ()).tolist() == [len(token_counts._merger(BPE)(b" Zyxxqv")) + len(token_counts._merger(BPE)(b" 2024")) + 15]
    assert set(counter.known) <= {b" Zyxxqv", b" 2024"}


def test_a_false_hash_does_not_count(monkeypatch):
    """Where every hash is one and the same, bytes alone decide."""
    monkeypatch.setattr(token_counts, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    counter = token_counts.Counter(BPE, token_counts._table([b"the", b" cat"]))
    s = next(batches.slices([pa.RecordBatch.from_pydict({"text": pa.array([b"the zyx cat zyxw"], pa.binary())})]))
    merge = token_counts._merger(BPE)
    assert token_counts.slice_counts(s, counter, ()).tolist() == [sum(len(merge(w)) for w in (b"the", b" zyx", b" cat", b" zyxw"))]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.load(public_tokenizers.path("word_bpe_49k.json"))


# ---- op 13 -----------------------------------------------------------------------

UP = {i: i + 32 for i in range(65, 91)}


def brute_variants(rows, least=5, count=3):
    c = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    n = {k: v for k, v in c.items() if len(k) >= least and v >= count}
    near, holes = collections.defaultdict(set), collections.defaultdict(list)
    for k in n:
        for p in range(len(k)):
            holes[p, k[:p], k[p + 1 :]].append(k)
            m = k[:p] + k[p + 1 :]
            if m in n:
                near[k].add(m)
                near[m].add(k)
    for g in holes.values():
        for k in g:
            near[k] |= set(g) - {k}
    form = {}
    for k in n:
        if near[k]:
            best = min(near[k], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[k]:
                form[k] = best

    def root(k):
        while k in form:
            k = form[k]
        return k

    return {(k, form.get(k), root(k), n[k], len(near[k]), n[form[k]] if k in form else None) for k in n}


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vocabulary(rng, size):
    """Texts of words that are near one another, in chains of falling counts."""
    out = []
    for _ in range(size):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(5, 7)))
        n = rng.choice([3, 9, 40])
        while n >= 2:
            out += [w] * n
            p = rng.randrange(len(w))
            w, n = rng.choice([w[:p] + w[p + 1 :], w[:p] + "z" + w[p:], w[:p] + w[p] + w[p:], w[:p] + "ÿ" + w[p + 1 :]]), n // 2
    rng.shuffle(out)
    return out


def test_variants_match_brute_force(spark):
    rng = random.Random(7)
    words = vocabulary(rng, 150)
    rows = [(k, " ".join(words[k::40]).upper() if k % 5 == 0 else ", ".join(words[k::40])) for k in range(40)]
    rows += [(None, " ".join(words[:200])), (41, None), (42, ""), (43, "abc × ÷ 123 a"), (3, rows[3][1]), (44, "wordword " * 20_000), (45, "x÷y×zabc " * 3)]
    assert found(variants.group_variants(docs(spark, rows).repartition(6))) == brute_variants(rows)
    assert found(variants.group_variants(docs(spark, []))) == found(variants.group_variants(docs(spark, [(1, "")]))) == set()


def test_frequent_prefixes_and_long_words(spark, monkeypatch):
    """Blocks are split by the words' other letters, down to single positions; words of many positions are halved first."""
    monkeypatch.setattr(variants, "BLOCK_ROWS", 4)
    monkeypatch.setattr(variants, "WIDE", 3)
    rng = random.Random(8)
    words = ["shared" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(120)] + ["".join(rng.choice("ab") for _ in range(4)) + "ending" for _ in range(60)]
    long_ = "".join(rng.choice("abcdefgh") for _ in range(3000))
    words += [long_, long_[:1500] + "x" + long_[1500:], long_[:-1], long_[1:], long_[:700] + long_[701:]]
    rows = [(k, " ".join(w for w in words for _ in range(rng.randint(1, 4)))) for k in range(4)]
    assert found(variants.group_variants(docs(spark, rows))) == brute_variants(rows)


def test_wavelet_matrix_reports_ranges():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        v = rng.permutation(n)
        a, z, low, high = (rng.integers(0, n + 1, 200) for _ in range(4))
        q, got = variants.WaveletMatrix(v).report(a, z, low, high)
        want = {(k, x) for k in range(200) for x in v[a[k] : z[k]].tolist() if low[k] <= x < high[k]}
        assert len(q) == len(want) and set(zip(q.tolist(), got.tolist(), strict=True)) == want


def test_crc32_in_passes():
    rng = random.Random(4)
    spans = [rng.randbytes(rng.choice([0, 1, 5, 20, 64, 65, 300])) for _ in range(300)]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(x) for x in spans])
    starts = ends - [len(x) for x in spans]
    prefix = np.array([zlib.crc32(b"%d:" % k) for k in range(300)], np.uint32)
    assert variants.crc32_of(prefix, data, starts, ends).tolist() == [zlib.crc32(b"%d:" % k + x) for k, x in enumerate(spans)]


def test_variants_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({queries.ORACLE_SQL['op13_wavelet_variants']})").fetchall()}
    assert found(queries.QUERIES["op13_wavelet_variants"](spark, SF)) == want
