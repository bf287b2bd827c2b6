"""The dense space against numpy's SVD of the whole matrix, and near copies as neighbours."""

import numpy as np
import pytest

from agora.operators import embed, lsa
from agora.sources import tables as T

SF = "/root/testdata/sf0.001"


def dense(rows, idf):
    out = np.zeros((len(rows), len(idf)))
    for i, words in enumerate(rows):
        for w in words or []:
            out[i, w] += idf[w]
        length = np.linalg.norm(out[i])
        if length:
            out[i] /= length
    return out


def test_singular_values_are_those_of_the_whole_matrix(spark):
    docs = T.v_comment(spark, SF)
    words = [r["words"] for r in lsa.hashed(docs, 2048).select("words").collect()]
    df = np.bincount([w for row in words for w in set(row)], minlength=2048)
    idf = np.log((len(words) + 1) / (df + 1))
    want = np.linalg.svd(dense(words, idf), compute_uv=False)
    space = lsa.fit(docs, dim=24, buckets=2048)
    assert np.allclose(space.idf, idf)
    assert np.all(np.abs(space.values - want[:24]) <= 0.01 * want[:24])
    assert np.allclose(space.vectors.T @ space.vectors, np.eye(24), atol=1e-8)


def test_near_copies_are_nearest(spark):
    docs = T.v_comment(spark, SF).select("comment_id", "body").persist()
    text = {r[0]: r[1] or "" for r in docs.collect()}
    shingles = {}
    for i, t in text.items():
        w = t.lower().split()
        shingles[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
    ids = sorted(i for i in text if shingles[i])
    near = {i: {j for j in ids if j != i and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])}
            for i in ids}
    got = {r[0]: np.array(r[1]) for r in embed.persistable(lsa.embed(docs, lsa.fit(docs))).collect()}
    docs.unpersist()
    keys = sorted(got)
    unit = np.array([got[k] for k in keys])
    assert unit.shape[1] == 384 and np.allclose(np.linalg.norm(unit, axis=1), 1, atol=1e-3)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -1)
    asked = [n for n, k in enumerate(keys) if near.get(k)]
    assert asked
    found = [keys[cosine[n].argmax()] in near[keys[n]] for n in asked]
    assert np.mean(found) >= 0.9


def test_words_of_one_company_are_near(spark):
    """Two comments without a common word are near if their words occur with the same others."""
    rows = [(i, f"{a} {b}") for i, (a, b) in enumerate(
        [("car", "engine"), ("car", "wheel"), ("truck", "engine"), ("truck", "wheel"),
         ("cat", "fur"), ("cat", "paw"), ("dog", "fur"), ("dog", "paw"), ("car", "car"), ("truck", "truck"),
         ("dog", "dog")])]
    df = spark.createDataFrame(rows, "comment_id long, body string")
    got = {r[0]: np.array(r[1]) for r in lsa.embed(df, lsa.fit(df, dim=2, oversample=8, buckets=256)).collect()}
    assert got[8] @ got[9] > 0.9 > 0.3 > got[8] @ got[10]


def test_empty_null_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "one two"), (4, "one two"), (5, "three")],
                               "comment_id long, body string")
    got = lsa.embed(df, lsa.fit(df, dim=3, buckets=64)).collect()
    assert sorted((r[0], r[2]) for r in got) == [(1, True), (2, True), (3, True), (4, False), (4, False), (5, False)]
    none = df.where("false")
    space = lsa.fit(none, dim=3, buckets=64)
    assert not space.values.any() and lsa.embed(none, space).count() == 0
    with pytest.raises(ValueError):
        lsa.fit(none, dim=65, buckets=64)


def test_chunks_multiply_common_and_rare_columns_as_the_whole_matrix():
    """Common columns are dense, entries of the others are multiplied one by one; zero rows are left out."""
    rng = np.random.default_rng(6)
    idf = np.r_[np.full(5, 0.1), np.full(58, 4.0), 0.0]
    words = [rng.choice(64, n).tolist() for n in (3, 40, 1, 0, 200)] + [None, [63, 63], [7]]
    basis, total, whole = rng.standard_normal((64, 9)), np.zeros((64, 9)), np.zeros((len(words), 64))
    for k, w in enumerate(words):
        np.add.at(whole[k], w or [], 1)
    whole *= idf
    whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-300)
    seen = []
    for where, chunk in lsa.chunks(words, idf):
        seen += where.tolist()
        assert chunk.dense.shape[1] == 6 and not np.isin(chunk.column, chunk.common).any()
        assert np.allclose(chunk.times(basis), whole[where] @ basis)
        chunk.add_gram(total, basis)
    assert seen == [0, 1, 2, 4, 7] and np.allclose(total, whole.T @ whole @ basis)
