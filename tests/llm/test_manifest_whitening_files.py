"""Merkle manifest, whitening and id files against plain versions: nulls, empty and long texts, ties, repeats, no rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencespark.llm import id_files, merkle, whitening
from evidencespark.llm.word_bpe import WordBpe

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- 11 -----------------------------------------------------------------------------------------------------------


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Levels of a list of digests, and the siblings of each leaf by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])

    def way(i):
        out = []
        for level in levels[:-1]:
            run = range(i - i % 3, min(i - i % 3 + 3, len(level)))
            out.append(([level[j] for j in run if j < i], [level[j] for j in run if j > i]))
            i //= 3
        return out

    return levels[-1][0], way


def plain_manifest(rows):
    """One row for each, as a multiset of (doc_id, leaf, subroot, root, proof, folded)."""
    by = {}
    for r in rows:
        cut = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        leaf, changed = (H(*(coded(v) for v in (*r[:4], t))) for t in (r[4], cut))
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, r[0], changed))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    root, above = tree([subs[s][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for j, (_, _, leaf, doc, changed) in enumerate(sorted(by[s])):
            way = [*subs[s][1](j), *above(i)]
            for left, right in way:
                changed = H(*left, changed, *right)
            out.append((doc, leaf, subs[s][0], root, H(*(d for left, right in way for d in (*left, *right))), changed))
    return sorted(map(str, out))


def spark_manifest(df):
    text = F.col("text").cast("string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)
    hexed = lambda c: F.lower(F.hex(c))
    got = merkle.manifest(df, tampered).select(
        "doc_id", hexed("leaf").alias("leaf"), hexed("subroot"), hexed("root"), merkle.proof(F.col("path")), hexed(merkle.folded(F.coalesce("changed", "leaf"), F.col("path")))
    )
    return sorted(str(tuple(r)) for r in got.collect())


ODD = [
    (None, None, None, None, None), (None, None, None, None, None), (5, None, "en", 3, "a\nb"), (5, None, "en", 3, "a\nb"), (5, None, "en", 3, "a"), (7, "", "", 0, ""),
    (8, "é", "en", None, "x\n" * 50_000), (9, "z", None, 1, "null"), (-3, "z", "-", 1, "-"), (4, "Z", "en", 1, "1:a"),
]


def test_manifest_equals_plain_trees(spark):
    rng = random.Random(4)
    rows = ODD + [(rng.randrange(500), rng.choice(["hot", "hot", "b", "c", None, "é"]), "en", i % 7, rng.choice(["a\nb", "c", "", None])) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"key": F.lit(1), "pos": F.lit(2), "digest": F.lit("x")})
    assert spark_manifest(df) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(n)]
    assert spark_manifest(spark.createDataFrame(rows, SCHEMA)) == plain_manifest(rows)


def test_manifest_over_several_bands(spark, monkeypatch):
    """Blocks of nine leaves, so that a source of 300 takes three bands."""
    monkeypatch.setattr(merkle, "BAND", 2)
    monkeypatch.setattr(merkle, "WIDE", 9)
    rows = [(i, "s" if i % 9 else f"t{i % 4}", "en", 1, f"t{i}\n") for i in range(300)]
    assert spark_manifest(spark.createDataFrame(rows, SCHEMA)) == plain_manifest(rows)
    monkeypatch.setattr(merkle, "COUNTS", 0)
    monkeypatch.setattr(merkle, "HEADS", 0)
    assert spark_manifest(spark.createDataFrame(rows, SCHEMA)) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


# --- 12 -----------------------------------------------------------------------------------------------------------


def test_rank_one_updates_of_any_spectrum():
    """Ties, zeros, far scales, vectors along axes: the update is the matrix's spectrum, with orthogonal vectors."""
    rng = np.random.default_rng(1)
    for t in range(400):
        m = int(rng.integers(1, 18))
        d = [np.sort(rng.random(m) * 10 ** rng.uniform(-6, 6)), np.sort(rng.integers(0, 4, m)).astype(float), np.zeros(m), np.sort(1 + 1e-15 * rng.integers(0, 9, m))][t % 4]
        v = rng.normal(size=m) * 10 ** rng.uniform(-3, 3)
        if t % 3:
            v[rng.random(m) < 0.5] = 0
        q = np.linalg.qr(rng.normal(size=(m, m)))[0]
        rho = 10 ** rng.uniform(-4, 3)
        want = q @ np.diag(d) @ q.T + rho * np.outer(v, v)
        values, vectors = whitening.updated(d, q, v, rho)
        assert (np.diff(values) >= 0).all()
        assert np.abs(vectors @ np.diag(values) @ vectors.T - want).max() <= 1e-12 * max(np.abs(want).max(), 1e-300)
        assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-12


def test_spectra_join():
    x = np.random.default_rng(2).integers(-90, 90, (60, 7))
    parts = [whitening.Spectrum(7) for _ in range(3)]
    for s, rows in zip(parts, (x[:1], x[1:40], x[40:]), strict=True):
        s.add(rows)
    empty = whitening.Spectrum(7)
    empty.merge(parts[0])
    for s in (parts[1], parts[2], whitening.Spectrum(7)):
        empty.merge(s)
    again = whitening.Spectrum.of(empty.row(0))
    want = np.cov(x.T, bias=True) * 60
    assert again.n == 60 and again.sums == x.sum(0).tolist() and np.allclose(again.vectors @ np.diag(again.values) @ again.vectors.T, want)


def plain_whitening(rows, k):
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(0)
    cov = np.cov(fit.T, bias=True).reshape(fit.shape[1], fit.shape[1])
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return {i: (n, sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums, strict=True)), (v - sums / n) @ axes / np.sqrt(e), e / np.trace(cov)) for i, v in x.items()}


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = [(i, [float(np.float32(c)) for c in (rng.normal(size=6) * [3, 2, 1.2, 0.7, 0.4, 0.2]) @ axes]) for i in range(300)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(100)]  # copies count once in the fit
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, [])]
    df = spark.createDataFrame([(i, v, "own") for i, v in rows + bad], "vec_id long, embedding array<float>, n string").repartition(11)
    got = whitening.whiten(df).collect()
    want = plain_whitening(rows, 4)
    assert len(got) == 4 * len(rows) and {r["vec_id"] for r in got} == set(want) and got[0]["n"] == "own"
    signs = {r["component"]: np.sign(r["whitened"] * want[5][2][r["component"] - 1]) for r in got if r["vec_id"] == 5}
    for r in got:
        n, deviation, white, explained = want[r["vec_id"]]
        c = r["component"]
        assert (r["_n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"] * signs[c] - white[c - 1]) < 1e-9 and abs(r["explained"] - explained[c - 1]) < 1e-12 and r["identity_error"] < 1e-9


def test_whitening_of_odd_vectors(spark):
    """One vector, lengths apart, fewer vectors than dimensions, equal eigenvalues, huge components, nothing."""
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<double>")).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    mixed = [(1, [1.0]), (2, [2.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, -1.0, 0.0]), (5, [0.0, 1.0, 0.0])]
    got = sorted(whitening.whiten(spark.createDataFrame(mixed, "vec_id long, embedding array<double>")).collect())
    assert [(r["vec_id"], r["component"], r["n"], None if r["whitened"] is None else round(abs(r["whitened"]), 9)) for r in got] == [
        (1, 1, 2, 1.0), (2, 1, 2, 1.0), *[(i, c, 2, 1.0 if c == 1 else None) for i in (3, 4, 5) for c in (1, 2, 3)]
    ]
    square = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1)))]
    got = whitening.whiten(spark.createDataFrame(square, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 and all(r["identity_error"] < 1e-9 and abs(r["explained"] - 0.5) < 1e-12 for r in got)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e14]), (2, [-1e14])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None and abs(abs(r["whitened"]) - 1) < 1e-9 for r in huge)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# --- 13 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(id_files.default_vocabulary())


ALPHABET = "aAbBzZ019 \t\n\r\x0b\x0c'sStTrevmld.,;!?-_<|>éÉçœŒßÀÿ×÷ªº²½\x85\xa0\xad\x1c\x1f\x00İıΣςσЖж中文éäﬁ™Å​😀ǅ"
WORDS = ["<|startoftext|>", "<|endoftext|>", "don't", "We'LL", "IT'S", "x" * 100, "é" * 80, "  ", "\n", "ÉCOLE", "'''s", "a1b2", "ΑΣ", "ΑΣ."]


def test_word_bpe_equals_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [rng.choice(["", " "]).join(rng.choice(WORDS) for _ in range(rng.randrange(9))) for _ in range(3000)] + [None, ""]
    coder = WordBpe(id_files.default_vocabulary())
    for some in (texts, [None], [""], ["'"], ["é"], []):
        ids, ends = coder.encode(pa.array(some, pa.string()))
        want = [x.ids for x in library.encode_batch([t or "" for t in some], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


@pytest.mark.parametrize("bits", [1, 8])
def test_planes(bits):
    rng = np.random.default_rng(6)
    for ids in (np.zeros(5), np.array([1]), rng.integers(0, 49_408, 1001), np.array([0, 2**32 - 1]), np.zeros(0)):
        ids = ids.astype(np.uint32)
        planes = id_files.to_planes(ids, bits)
        assert len(planes) == -(-int(ids.max(initial=0)).bit_length() // bits) and (id_files.from_planes(planes, bits, len(ids)) == ids).all()


@pytest.mark.parametrize("bits", [1, 8])
def test_files_give_back_all_ids(spark, library, tmp_path, bits):
    """Documents over many blocks, shards that end within a block, nulls, repeats, clashing names."""
    rng = random.Random(7)
    rows = [(i * 3 % 101, " ".join(rng.choice(WORDS[2:]) for _ in range(rng.randrange(30)))) for i in range(101)]
    rows += [(None, "null id"), (200, None), (201, ""), (202, "word " * 3000), (5, "again"), (5, "again"), (203, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns({"seq": F.lit("x"), "ids": F.lit(1)})
    folder = f"{tmp_path}/ids"
    id_files.write_ids(df, folder, id_files.default_vocabulary(), bits=bits, block_ids=256)
    got = sorted(id_files.read_ids(spark, folder).withColumn("list", id_files.id_array(F.col("ids"))).collect(), key=lambda r: r["start"])
    coded = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    assert sorted(str((r["doc_id"], r["list"])) for r in got) == sorted(str((d, coded(t))) for d, t in rows)
    assert [r["doc_id"] for r in got] == [None, *sorted(d for d, _ in rows if d is not None)]
    assert [r["start"] for r in got] == np.cumsum([0, *[len(r["list"]) for r in got[:-1]]]).tolist() and all(r["n_tokens"] == len(r["list"]) for r in got)
    some = id_files.read_ids(spark, folder, (got[10]["start"], got[20]["start"])).collect()
    assert sorted(r["start"] for r in some) == [r["start"] for r in got[10:21]]


def test_files_of_nothing_and_damaged_ones(spark, tmp_path):
    id_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none", id_files.default_vocabulary())
    assert id_files.read_ids(spark, f"{tmp_path}/none").count() == 0
    id_files.write_ids(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), f"{tmp_path}/one", id_files.default_vocabulary())
    spark.read.parquet(f"{tmp_path}/one/blocks").withColumn("ids_crc32", F.lit(1).cast("long")).write.parquet(f"{tmp_path}/bad/blocks")
    spark.read.parquet(f"{tmp_path}/one/shards").write.parquet(f"{tmp_path}/bad/shards")
    with pytest.raises(Exception, match="damaged"):
        id_files.read_ids(spark, f"{tmp_path}/bad").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):  # without the last table the files are not whole
        spark.read.parquet(f"{tmp_path}/one/blocks").write.parquet(f"{tmp_path}/half/blocks")
        id_files.read_ids(spark, f"{tmp_path}/half")
