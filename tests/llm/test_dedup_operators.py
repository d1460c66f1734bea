"""SimHash groups, similar groups, substring dedup, pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import queries, simhash_dedup, substring_dedup

from .helpers import AWKWARD, SF, awkward, documents, empty, lower, words


def fingerprint(text, n=3):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}


def test_simhash_query(spark):
    prints = {d.doc_id: fingerprint(d.text) for d in documents(spark).collect()}
    group = classes(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash_dedup(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", group[d]) for d, p in prints.items()}


def test_no_link_is_missed(spark):
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(20)}
    for p in list(prints):
        for _ in range(12):
            q = p
            for b in r.sample(range(64), r.randrange(5)):
                q ^= 1 << b
            prints.add(q)
    values = sorted(prints)
    expected = {(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 2}
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in values], "print long")
    for parts in (("golay", "golay"), ("golay", "golay", "hamming")):
        rows = simhash_dedup.near_pairs(df, parts).collect()
        got = [tuple(sorted((x.u % 2**64, x.v % 2**64))) for x in rows]
        assert len(got) == len(set(got)) and set(got) == expected


def test_codes_are_perfect():
    for kind, size, radius in (("golay", 23, 3), ("hamming", 15, 1)):
        n, r, error, _ = simhash_dedup._decoder(kind)
        assert (n, r) == (size, radius) and len(set(error.tolist())) == len(error)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 199)]
    r = random.Random(1)
    edges = [(b, a) if r.random() < 0.5 else (a, b) for a, b in edges]
    got = {x.node: x.root for x in simhash_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 200: 199}


def test_simhash_edge_cases(spark):
    docs = awkward(spark, extra=True).withColumns({"print": F.lit("clash"), "component_id": F.lit("clash")})
    got = {r.doc_id: r.component_id for r in simhash_dedup.groups(docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[4] == got[11] == 4 and got[6] == got[7] == 6
    assert simhash_dedup.groups(empty(spark)).count() == 0
    assert simhash_dedup.fingerprints(pa.array([None, "", " "], pa.string())).tolist() == [0, 0, 0]


def near_copies(seed=4, n_groups=6):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(n_groups):
        base = [r.choice(vocabulary) for _ in range(300)]
        for c in range(8):
            w = list(base)
            for _ in range(c % 3):
                w[r.randrange(300)] = r.choice(vocabulary)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    return rows, group


def test_similar_groups(spark):
    rows, group = near_copies()
    rows += [(1000 + d, t) for d, t in AWKWARD]
    r = random.Random(1)
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash_dedup.similar_groups(docs).collect()}
    first = {g: min(d for d, k in group.items() if k == g) for g in group.values()}
    assert {d: got[d] for d in group} == {d: first[g] for d, g in group.items()}
    assert got[1001] == got[1002] == 1000 and got[1011] == 1004 and got[1007] == 1006
    kept = simhash_dedup.keep_one(docs.withColumn("lang", F.lit("x")))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({*got.values()}) and "lang" in kept.columns


def test_blocks_of_an_anchor_link_alike(spark, monkeypatch):
    rows, group = near_copies(7, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash_dedup, "BLOCK", 3)
    got = {x.doc_id: x.component_id for x in simhash_dedup.similar_groups(docs).collect()}
    assert got == {d: 8 * g for d, g in group.items()}


def test_strays_of_a_large_group_meet_every_member(spark, monkeypatch):
    """On a chain each member is near its neighbours only, so the smallest links one of them and the rest are strays."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 4)
    members = spark.createDataFrame([(a, 100 * a + i, 1) for a in (1, 2) for i in range(20)], "anchor long, copy long, n long")
    payload = members.select("copy", F.col("copy").alias("data"))

    def near_of(data):
        every = np.array(data)
        return lambda i, others: np.abs(every[others] - every[i]) <= 1

    got = simhash_dedup.components(simhash_dedup._links(members, payload, near_of)).collect()
    assert {(r.node, r.root) for r in got} == {(100 * a + i, 100 * a) for a in (1, 2) for i in range(1, 20)}


def around_the_threshold():
    """Pairs of a text and a copy with one block or single words changed, of similarities around 0.8."""
    r = random.Random(8)
    rows = []
    for g in range(60):
        n = r.choice([60, 300, 800])
        base = [f"g{g}w{r.randrange(2000)}" for _ in range(n)]
        size, at = round(n * r.uniform(0.08, 0.24)), r.randrange(n // 2)
        new = [f"v{g}x{i}" for i in range(size)]
        single = list(base)
        for i in r.sample(range(n), max(1, round(n * r.uniform(0.01, 0.03)))):
            single[i] = "y"
        edits = [base + new, base[:at] + base[at + size :], base[:at] + new[: size // 2] + base[at + size // 2 :], single]
        rows += [" ".join(base), " ".join(edits[g % 4])]
    return list(enumerate(rows))


def test_similar_groups_are_brute_force(spark):
    rows = around_the_threshold()
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    expected = classes(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert 10 < sum(d != c for d, c in expected.items()) < 50
    got = {x.doc_id: x.component_id for x in simhash_dedup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_one_row_stays_of_copies_under_one_id_or_none(spark):
    rows = [(3, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (5, None), (5, "")]
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept) == [(0, "g h i j k l"), (3, "a b c d e f"), (5, "")]


def test_pipeline_groups_have_the_links_of_fingerprints(spark):
    """A line said fifty times decides a fingerprint, which counts repeats, whatever the end of the text; the sets of shingles differ."""
    tail = lambda i: " ".join(f"t{i}x{j}" for j in range(20))
    rows = [(i, f"{'a b c ' * 50}{tail(i)}") for i in range(3)] + [(i, tail(i)) for i in range(10, 13)] + [(20, ""), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_prints = {x.doc_id: x.component_id for x in simhash_dedup.groups(docs).collect()}
    by_shingles = {x.doc_id: x.component_id for x in simhash_dedup.similar_groups(docs).collect()}
    kept = {x.doc_id for x in simhash_dedup.keep_one(docs).collect()}
    assert kept == {0, 10, 11, 12, 20} == set(by_prints.values())
    assert set(by_shingles.values()) == kept | {1, 2}


def test_similarity_of_sketches():
    a = [f"w{i}" for i in range(2000)]
    for cut in (0, 100, 400):
        b = a[:2000 - cut] + [f"v{i}" for i in range(cut)]
        sa, sb = (simhash_dedup.minima(next(simhash_dedup.kernel.word_slices(pa.array([" ".join(x)])))[2])[0][0] for x in (a, b))
        x, y = ({tuple(w[i : i + 5]) for i in range(1996)} for w in (a, b))
        estimate = ((sa == sb) & (sa != 0)).sum() / ((sa != 0) | (sb != 0)).sum()
        assert abs(estimate - len(x & y) / len(x | y)) < 0.1


def removed(rows, k=13):
    first = {}
    text = {d: words(t) for d, t in rows}
    for d in sorted(text):
        for j in range(len(text[d]) - k + 1):
            first.setdefault(tuple(text[d][j : j + k]), d)
    out = {}
    for d, w in text.items():
        gone = {x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < d for x in range(j, j + k)}
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def check_removal(docs, rows):
    got = substring_dedup.removal_digests(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(rows)


def test_substring_query(spark):
    rows = [tuple(d) for d in documents(spark).collect()]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_substring_dedup(spark, SF).collect()} == removed(rows)


def test_substrings_that_overlap_and_branch(spark):
    r = random.Random(6)
    pieces = [[f"p{k}w{i}" for i in range(r.randrange(5, 30))] for k in range(8)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(pieces)
            a = r.randrange(len(p))
            w += p[a:] if r.random() < 0.5 else p
            w += ["the"] * r.randrange(16) if r.random() < 0.3 else [f"u{d}"] * r.randrange(2)
        rows.append((d, " ".join(w)))
    check_removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def removed_rows(rows, k=13):
    """(id, words, removed, digest) of every row; windows of all texts of an id start at it."""
    first = {}
    for d, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            s = tuple(w[j : j + k])
            first[s] = min(d, first.get(s, d))
    out = Counter()
    for d, t in rows:
        w = words(t)
        gone = {x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < d for x in range(j, j + k)}
        out[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    return out


def test_several_texts_under_one_id(spark):
    r = random.Random(11)
    pieces = [[f"p{k}w{i}" for i in range(r.randrange(10, 40))] for k in range(12)]
    rows = [(r.randrange(25), r.choice((" ", "  ", "\n")).join(r.choice(pieces) + [f"u{i}"] * r.randrange(3) + r.choice(pieces))) for i in range(150)]
    rows += [(30, " ".join(pieces[0]))] * 50 + [(1, rows[0][1]), (40, rows[0][1]), (40, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = substring_dedup.removal_digests(docs).collect()
    expected = removed_rows(rows)
    assert Counter((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got) == expected
    cut = substring_dedup.remove_repeats(docs).collect()
    kept = Counter((g.doc_id, g.n_removed, hashlib.sha256(" ".join(words(g.text)).encode()).hexdigest()) for g in cut)
    fewer = Counter()
    for (d, _, n, sha), m in expected.items():
        fewer[d, n, sha] += m
    assert kept == fewer


def test_spans_name_their_source(spark):
    shared = [f"s{i}" for i in range(60)]
    rows = [(1, " ".join(["a"] * 5 + shared + ["b"])), (2, " ".join(["c", "d"] + shared[10:50])), (3, " ".join(shared[:30] + ["x"] + shared[30:]))]
    _, spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: list(zip(r.at, r.n, r.source, r.source_at)) for r in spans.collect()}
    assert got[2] == [(2, 40, 1, 15)]
    text = {d: t.split() for d, t in rows}
    assert sum(n for _, n, _, _ in got[3]) >= 60
    for d, parts in got.items():
        for at, n, source, there in parts:
            assert source < d and text[d][at : at + n] == text[source][there : there + n]


def test_a_very_long_text_and_a_very_common_passage(spark):
    r = random.Random(5)
    long = [f"w{r.randrange(10**9)}" for _ in range(1_900_000)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(0, " ".join(long)), (1, " ".join(long[1000:200_000]))] + [(i, f"a{i} b{i} {passage} c{i}") for i in range(10, 10_010)]
    assert len(rows[0][1]) > 20_000_000
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (1_900_000, 0), 1: (199_000, 199_000), 10: (43, 0)} | {i: (43, 40) for i in range(11, 10_010)}


def test_substring_edge_cases(spark):
    check_removal(awkward(spark), AWKWARD)
    twice = substring_dedup.removal_digests(awkward(spark, extra=True)).collect()
    assert len(twice) == len(AWKWARD) + 2
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in twice} == {(d, *v) for d, v in removed(AWKWARD).items()}
    assert substring_dedup.removal_digests(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a " * 20), (None, "a " * 20), (1, "a " * 20), (2, "a " * 20)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.removal_digests(nulls).collect()) == [(0, 0), (0, 0), (1, 0), (2, 20)]
    docs = awkward(spark, extra=True).withColumns({"n_removed": F.lit("clash"), "lang": F.lit("x")})
    cut = substring_dedup.remove_repeats(docs).collect()
    kept = {d: v[2] for d, v in removed(AWKWARD).items()}
    assert len(cut) == len(AWKWARD) + 2
    assert all(hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest() == kept[r.doc_id] and r.lang == "x" for r in cut)


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "substring_dedup":
            expected = removed(list(before.items()))
            assert {d: hashlib.sha256(" ".join(words(t)).encode()).hexdigest() for d, t in after.items()} == {d: v[2] for d, v in expected.items()}
        else:
            assert all(before[d] == t for d, t in after.items())
    final = {r.doc_id: list(r.ids) for r in docs.collect()}
    assert final and set(final) < set(given)
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()} == final


def test_pipeline_of_an_empty_table(spark):
    docs = empty(spark, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
