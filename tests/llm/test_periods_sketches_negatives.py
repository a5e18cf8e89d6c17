"""Periodic runs, similarity sketches and hard negatives against brute force; odd rows for each."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.test_llm import ODD, docs, empty, odd, texts  # noqa: F401


# -- 11 periodic runs ---------------------------------------------------------
def _runs(words, least=24, times=3):
    n, code = len(words), {}
    x = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    found = []
    for q in range(1, n // times + 1):
        same = np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = b - a + q
            if length < max(least, times * q):
                continue
            if not any((x[a : a + length - p] == x[a + p : a + length]).all() for p in range(1, q)):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    from pluvio.llm.periodic_runs import find_runs

    rng = np.random.default_rng(5)
    several = []
    for n in (0, 1, 2, 5, 24, 60, 200):
        for letters in (1, 2, 3, 5):
            x = rng.integers(0, letters, n)
            if n > 20:  # plant a period
                p, a = int(rng.integers(1, n // 4)), int(rng.integers(0, n // 4))
                x[a : n - 3] = x[a + (np.arange(n - 3 - a) % p)]
            several.append(x)
    for least in (1, 6, 24):
        want, base = [], 0
        for x in several:
            want += [(base + s, length, q) for s, length, q in _runs(x.tolist(), least)]
            base += len(x)
        text = np.repeat(np.arange(len(several)), [len(x) for x in several])
        assert list(zip(*(v.tolist() for v in find_runs(np.concatenate(several), text, least, 3)), strict=True)) == want
    with pytest.raises(ValueError):
        find_runs(np.zeros(4, np.int64), np.zeros(4, np.int64), 1, 2)


def _planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark, texts):  # noqa: F811
    from pluvio.llm.queries import op11_periodic_runs

    got = {r.doc_id: r for r in op11_periodic_runs(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        words = _planted(doc, text)
        runs = _runs(words)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        r = got[doc]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == want
    assert sum(r.n_runs > 0 for r in got.values()) > 10


def test_runs_odd_rows(spark, odd, empty):  # noqa: F811
    from pluvio.llm.periodic_runs import periodic_runs

    got = periodic_runs(odd).collect()
    assert len(got) == len(ODD) and periodic_runs(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].runs == [] and by[1].collapsed == ""
    assert [tuple(r) for r in by[8].runs] == [(0, 3000, 1)] and by[8].collapsed == "word"
    assert by[None].n_words == 4 and by[6].collapsed == "One two three"
    long = spark.createDataFrame([(1, "a b c d e f g " * 40_000), (2, None)], "n long, body string")
    row = periodic_runs(long, id_col="n", text_col="body").where("n = 1").first()
    assert [tuple(r) for r in row.runs] == [(0, 280_000, 7)]


# -- 12 similarity sketches ------------------------------------------------------
def test_sketches_fill_and_estimate():
    from pluvio.llm.minhash import band_keys, bands_for, sketches

    rng = np.random.default_rng(1)
    t, errors = 180, []
    for size in (1, 2, 7, 40, 1000):
        for share in (0.5, 0.85, 0.95):
            both = rng.integers(0, 2**63, max(1, round(size * share)), np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, size - len(both), np.uint64)]) for _ in range(2))
            s = sketches([a, b, both], t)
            assert (s != np.uint64(2**64 - 1)).all()
            assert (sketches([a], t)[0] == s[0]).all()  # alone or among others
            errors.append((s[0] == s[1]).mean() - len(both) / (2 * size - len(both)))
    assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.05
    # sets at the threshold meet in a band
    bands, met = bands_for(85, 100), 0
    for _ in range(400):
        both = rng.integers(0, 2**63, 85, np.uint64)
        x = rng.integers(0, 2**63, 15, np.uint64)
        k = band_keys(sketches([np.concatenate([both, x[:7]]), np.concatenate([both, x[7:]])], bands * 6), bands, 6)
        met += bool((k[0] == k[1]).any())
    assert met == 400 and bands == 30


def _components(rows, n, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    low = {i: i for i, _ in rows}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                low[y] = x
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)}


def test_minhash_against_brute_force(spark, texts):  # noqa: F811
    from pluvio.llm.minhash import similar_components

    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = sorted(texts.items())
    at = 10_000

    def add(words):
        nonlocal at
        at += 1
        rows.append((at, " ".join(words)))

    for size in (1, 4, 6, 9, 30, 200):  # pairs and short texts around the threshold
        for edits in (0, 1, 2, 3, 6):
            base = rng.choice(vocabulary, size).tolist()
            add(base)
            changed = list(base)
            for k in rng.integers(0, size, edits):
                changed[k] = "changed"
            add(changed)
            add([*base, *vocabulary[:edits]])
    base = rng.choice(vocabulary, 120).tolist()  # one family over many entries, linked in parts only
    for _ in range(120):
        changed = list(base)
        for k in rng.integers(0, 120, int(rng.integers(1, 5))):
            changed[k] = str(rng.choice(vocabulary))
        add(changed)
    add(base)
    rows += [(at + 1 + i, "equal copies of one text are one class " * 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in similar_components(df).collect()}
    want = _components(rows, 5, 85, 100)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert len({c for _, c in want.values()}) < len(rows) - 100


def test_minhash_odd_rows(spark, odd, empty):  # noqa: F811
    from pluvio.llm.minhash import minhash_dedup, similar_components

    got = similar_components(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert by[5].component_id == 4 and not by[5].kept and by[7].component_id == 6
    assert by[None].component_id is None and by[None].kept is None
    kept = minhash_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 8, 9, 10, 10, 11]
    assert similar_components(empty).count() == 0 and minhash_dedup(empty).count() == 0


# -- 13 hard negatives --------------------------------------------------------
def _negatives(rows, is_anchor, k=5, low=80, high=100):
    clean = {}
    for i, vector, label in rows:
        if i is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = (label, vector)
        clean[i] = min(clean.get(i, q), q)
    vec = {i: [math.floor(256 * x) for x in v] for i, (_, v) in clean.items()}
    out = set()
    for a in filter(is_anchor, vec):
        score = {i: sum(x * y for x, y in zip(vec[a], v, strict=False)) for i, v in vec.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        label = clean[a][0]
        for p in [i for i in order if clean[i][0] == label][:k]:
            inside = [i for i in order if clean[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]][:k]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(inside)}
    return out


def _mined(df, every):
    from pluvio.llm.hard_negatives import hard_negatives

    names = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return [tuple(r[n] for n in names) for r in hard_negatives(df, df["vec_id"] % every == 0).collect()]


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(4)
    shape = "vec_id long, embedding array<float>, label int, anchor_id int, score string, id int"
    rows = []
    for i in range(400):  # clusters, so that reading stops early for some; coarse values, so that scores tie
        centre = np.eye(8)[i % 5] * (1.5 if i % 3 else 0.2)
        rows.append((i, (np.round((centre + rng.normal(0, 0.1, 8)) * 16) / 16).tolist(), i % 4))
    rows += [(400 + i, rows[100][1], i % 4) for i in range(40)]  # one vector that many rows have
    rows += [
        (500, None, 1), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (504, [float("nan")] * 8, 2), (506, [float("inf")] + [0.0] * 7, 2),
        (508, [0.5] * 8, None), (510, [], 1), (520, [0.0] * 8, 2), (530, [1.0, 1.0], 3), (None, [0.5] * 8, 1),
        (540, [0.25] * 8, 2), (540, [0.25] * 8, 2), (540, [0.5] * 8, 1), (550, [-1.0] * 8, 77),
    ]
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], shape).repartition(5)
    got = _mined(df, 10)
    assert len(got) == len(set(got)) and set(got) == _negatives(rows, lambda i: i % 10 == 0)
    assert _mined(df.limit(0), 10) == []
    assert _mined(df.where("vec_id % 10 <> 0"), 10) == []


def test_negatives_in_many_blocks_and_large_values(spark, monkeypatch):
    from pluvio.llm import hard_negatives as h

    monkeypatch.setattr(h, "BLOCK_ROWS", 64)
    monkeypatch.setattr(h, "BLOCK_ANCHORS", 8)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 1, 4) * (1e5 if i % 2 else 1)).tolist(), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    assert set(_mined(df, 7)) == _negatives(rows, lambda i: i % 7 == 0)


def test_sorted_access_stops_early():
    from pluvio.llm.hard_negatives import SortedLists

    rng = np.random.default_rng(8)
    x = np.floor(rng.exponential(8, (5000, 3)) ** 2)
    x[:50] *= 20
    lists = SortedLists(np.arange(5000), x.astype(np.float32))
    read = [0]
    inner = lists.access

    def counted(anchor):
        for fresh, limit in inner(anchor):
            read[0] += len(fresh)
            yield fresh, limit

    lists.access = counted
    anchor = np.array([5, 3, 0], np.float32)
    found = lists.best(anchor, [(None, None)], 5)
    score = x @ anchor
    assert sorted(found) == sorted(np.lexsort((np.arange(5000), -score))[:5].tolist())
    assert read[0] < 1000


# -- 6 rows that repeat an identifier, clashing names ------------------------------
def test_repeats_are_cut_from_their_own_rows_only(spark):
    from pluvio.llm.substring import remove_repeats

    rng = np.random.default_rng(9)
    passage = " ".join(f"p{k}" for k in range(60))
    clean, first, again = (" ".join(f"{n}{rng.integers(10**9)}" for _ in range(80)) for n in "cfa")
    rows = [(1, f"{first} {passage}", "x", 1), (2, clean, "x", 2), (2, f"{again} {passage} {again}", "x", 3), (None, passage, "x", 4), (3, None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cuts string, _cut_id int").repartition(3)
    got = {r["_cut_id"]: r for r in remove_repeats(df).collect()}
    assert remove_repeats(df).columns == df.columns and len(got) == 5
    assert [got[k].text for k in (1, 2, 4, 5)] == [rows[0][1], clean, passage, None]
    assert got[3].text.startswith(again[:200]) and len(got[3].text) < len(rows[2][1]) - 120


# -- what is sent and held --------------------------------------------------------
def test_bitmap_keeps_all_keys_and_few_others(spark):
    from pluvio.llm.common import maybe_among

    rows = spark.range(100_000).selectExpr("IF(id % 10 = 3, NULL, id) AS k", "id AS v")
    keys = spark.range(0, 100_000, 1000).selectExpr("id - 1 AS id").union(spark.sql("SELECT CAST(NULL AS bigint)"))
    got = maybe_among(rows, "k", keys.union(keys)).collect()
    assert all(r.asDict() == {"k": r.v, "v": r.v} for r in got) and len({r.v for r in got}) == len(got)
    assert set(range(999, 99_000, 1000)) <= {r.k for r in got} and len(got) < 150
    crowded = {r.k for r in maybe_among(rows, "k", keys, words=1).collect()}
    assert {r.k for r in got if r.k % 1000 == 999} <= crowded  # a full bitmap loses nothing
    assert maybe_among(rows, "k", keys.limit(0)).count() == 0


def test_texts_are_not_shuffled_for_their_sets(spark, monkeypatch):
    from pluvio.llm import ngram_join

    plans = []
    monkeypatch.setattr(ngram_join, "write_table", lambda df, name: plans.append(df) or (df, ""))
    rows = spark.range(1000).selectExpr("id AS _id", "repeat(concat('word', id, ' '), 20) AS _text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.id for r in ngram_join.set_table(rows, spark.range(0, 1000, 100).distinct(), 3).collect()}
        text = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(range(0, 1000, 100)) <= got and len(got) < 50
    assert "SortMergeJoin" not in text and "_text" not in "".join(x for x in text.split("\n") if "Exchange" in x)


def test_batches_of_written_tables_are_bounded(spark):
    import pyarrow as pa

    from pluvio.llm.common import drop_table, write_table

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    rows = spark.range(0, 9000, numPartitions=1).selectExpr("array_repeat('abcde', 430) AS w")
    kept = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    table, path = write_table(rows.mapInArrow(sizes, "n long, size long"), "sizes")
    got = table.collect()
    drop_table(spark, path)
    assert sum(r.n for r in got) == 9000 and max(r["size"] for r in got) <= 10 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == kept


def test_words_are_handled_in_small_slices():
    import pyarrow as pa

    from pluvio.llm.tokenize import slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([["a"] * 10_000] * 99 + [["b"] * 300_000])], ["_id", "_words"])
    parts = list(slices(batch, "_words"))
    assert [i for p in parts for i in p.column("_id").to_pylist()] == list(range(100))
    assert all(p.num_rows == 1 or len(p.column("_words").flatten()) <= 250_000 for p in parts)


def test_strangers_with_a_common_passage_do_not_meet_in_blocks(spark, monkeypatch):
    import pyarrow as pa

    from pluvio.llm import ngram_join
    from pluvio.llm.common import components

    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(150)]
    texts = {k: passage + [word() for _ in range(140)] for k in range(1000, 1300)}  # strangers
    for k in range(90):  # near copies around the threshold, some of one length and some cut
        copy = list(base) if k % 3 else base[: 150 - k // 3]
        for at in rng.integers(0, len(copy), k % 7):
            copy[at] = word() if k % 2 else "edited"
        texts[k] = copy
    texts[2000], texts[2001] = texts[1000], [*texts[1000][:-3], word(), word(), word()]  # of the strangers, two that link
    shingle = ngram_join.Shingler(5)
    found = {k: shingle(" ".join(t)) for k, t in texts.items()}
    in_blocks, plain = 1000, ngram_join._block_links

    def only_copies(table: pa.Table, num: int, den: int) -> pa.Table:
        assert max(table.column("id").to_pylist()) < in_blocks, "a stranger is compared with all others"
        return plain(table, num, den)

    monkeypatch.setattr(ngram_join, "_block_links", only_copies)
    here = spark.createDataFrame([(k, k, 0 if k < 1000 else 1000, 500) for k in texts], "id long, c long, first long, n long")
    sets = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in found.items()], "id long, set binary")
    links = ngram_join.family_links(here, sets, 80, 100)
    got = {r.node: r.component for r in components(links, "a", "b", "test").collect()}

    top = {k: k for k in found}
    for a in sorted(found):
        for b in sorted(found):
            both = len(np.intersect1d(found[a], found[b])) if a < b and (a < 1000) == (b < 1000) else 0
            if both and 100 * both >= 80 * (len(found[a]) + len(found[b]) - both):
                low, high = sorted((top[a], top[b]))
                top = {k: low if t == high else t for k, t in top.items()}
    assert got == {k: t for k, t in top.items() if k != t}
    assert got[2000] == got[2001] == 1000 and len(got) > 20
