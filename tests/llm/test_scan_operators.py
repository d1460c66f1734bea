"""License scan, quality rules, decontamination, importance resampling: operators that read each text once."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import decontaminate, importance_sample, kernel, license_scan, quality_rules, queries

from .helpers import AWKWARD, SF, awkward, documents, empty, lower, words

# --- kernel --------------------------------------------------------------------


def test_words_and_windows_of_slices(monkeypatch):
    texts = [t for _, t in AWKWARD]
    for limit in (16, 1 << 20):
        got = []
        for a, b, w in kernel.word_slices(pa.array(texts, pa.string()), limit=limit):
            for i in range(b - a):
                got.append([w.data[s:e].tobytes().decode() for s, e in zip(w.starts[w.word_off[i] : w.word_off[i + 1]], w.ends[w.word_off[i] : w.word_off[i + 1]])])
        assert got == [words(t) for t in texts]


def test_hashes_do_not_depend_on_place():
    seen = {}
    for a, b, w in kernel.word_slices(pa.array(["x yy zzz yy", "yy zzz x", "zzz"]), limit=1):
        for s, e, h in zip(w.starts, w.ends, w.hashes()):
            assert seen.setdefault(w.data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == 3


# --- licenses --------------------------------------------------------------------


def test_alignment_is_increasing_and_no_longer_than_the_best():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(14))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) <= best[-1][-1]
    assert license_scan.align([1, 2, 3, 9, 4], [1, 2, 7, 3, 4]) == [(0, 0), (1, 1), (2, 3), (4, 4)]


def test_licenses_in_documents(spark):
    notices = {"GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    expected = Counter((d.doc_id, name) for d in documents(spark).collect() for name, line in notices.items() for _ in range((d.text or "").count(line)))
    assert Counter((r.doc_id, r.license) for r in queries.op1_license_scan(spark, SF).collect()) == expected


def test_long_notices_with_edits_and_near_misses(spark):
    mit = next(t.text for t in license_scan.TEMPLATES if t.name == "MIT" and len(t.text) > 100)
    edited = mit.replace("free of charge", "gratis").replace("\"AS IS\"", "as-is").upper()
    rows = [(1, "some words " * 50 + edited + " and more" * 50), (2, "Released under the license."), (3, mit[:200]), (4, f"{mit}\n{mit}"), (5, "Licensed under CC BY 4.0.")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license) for r in got) == {(1, "MIT"): 1, (4, "MIT"): 2}


def test_license_edge_cases(spark):
    assert license_scan.scan_licenses(awkward(spark, extra=True)).count() == 0
    assert license_scan.scan_licenses(empty(spark)).count() == 0


# --- quality rules ---------------------------------------------------------------


def figures(text):
    w = words(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_figures(spark):
    rows = documents(spark).collect()
    got = {r.doc_id: r for r in queries.op6_quality_rules(spark, SF).collect()}
    assert len(got) == len(rows)
    for d in rows:
        g, f = got[d.doc_id], figures(d.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == f
        assert g.base_failed == (f[0] < 20 or 100 * f[4] > 30 * f[0])
        assert not (g.base_failed and g.kept)


def test_labels_agree_with_held_out_quality(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    learn = spark.createDataFrame([(d, q) for d, q in labels.items() if d % 2], "doc_id long, quality int")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, learn, keep=["doc_id"]).collect()}
    judged = [(q, got[d].kept) for d, q in labels.items() if d % 2 == 0 and not got[d].base_failed]
    assert sum(q == k for q, k in judged) > 0.95 * len(judged)


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(0)
    field = quality_rules.LineField(r.normal(size=(quality_rules.N_FEATURES, 2)), r.normal(size=(2, 2)))
    active = r.integers(-1, quality_rules.N_FEATURES, (9, 4))
    lines = quality_rules.Lines(np.array([0] * 5 + [2] * 4), active, np.ones(9))
    got = quality_rules.viterbi(field, lines)
    score = quality_rules._scores(field.emission, active)
    for a, b in ((0, 5), (5, 9)):
        total = lambda y: sum(score[a + i, y[i]] for i in range(b - a)) + sum(field.transition[y[i - 1], y[i]] for i in range(1, b - a))  # noqa: B023, E731
        every = [[x >> i & 1 for i in range(b - a)] for x in range(2 ** (b - a))]
        assert np.isclose(total(got[a:b].tolist()), max(map(total, every)))


def test_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(1)
    field = quality_rules.LineField(2 * r.normal(size=(quality_rules.N_FEATURES, 2)), 2 * r.normal(size=(2, 2)))
    active = r.integers(-1, quality_rules.N_FEATURES, (9, 4))
    lines = quality_rules.Lines(np.array([0] * 5 + [2] * 4), active, np.ones(9))
    score = quality_rules._scores(field.emission, active)
    for a, b in ((0, 5), (5, 9)):
        total, content = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            weight = math.exp(sum(score[a + i, y[i]] for i in range(b - a)) + sum(field.transition[y[i - 1], y[i]] for i in range(1, b - a)))
            total, content = total + weight, content + weight * np.array(y)
        assert np.allclose(quality_rules.marginals(field, lines)[a:b], content / total)


def test_labels_of_lines_keep_their_documents_share():
    r = np.random.default_rng(3)
    row = np.sort(r.integers(0, 40, 400))
    lines = quality_rules.Lines(row, np.zeros((400, 1), np.int64), r.integers(1, 30, 400))
    good, content = (row % 2 == 0), np.round(r.random(400), 1)
    got = quality_rules.line_labels(lines, good, content)
    for d in range(40):
        at = np.flatnonzero(row == d)
        words, limit = 0, 0.5 * lines.n_words[at].sum()
        for i in sorted(at, key=lambda i: (-content[i], i)):  # the likeliest first
            n = int(lines.n_words[i])
            assert got[i] == (content[i] > 0.5 or words < limit if good[i] else content[i] > 0.5 and words + n < limit)
            words += n


def test_planted_lines_are_labelled(spark):
    """Menus stand in good documents and sentences in poor ones; only documents are labelled."""
    r = random.Random(5)

    def sentence():
        return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(9, 25))).capitalize() + "."

    def menu():
        return " | ".join("".join(r.choice("aeioulnrst") for _ in range(r.randrange(3, 9))).capitalize() for _ in range(r.randrange(3, 9)))

    rows, planted = [], {}
    for d in range(600):
        good = d % 3 > 0
        most, few = (sentence, menu) if good else (menu, sentence)
        lines = [most] * (7 if good else 14) + [few] * r.randrange(3)
        r.shuffle(lines)
        planted[d] = [line is sentence for line in lines]
        rows.append((d, "\n".join(line() for line in lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d % 3 > 0)) for d in range(300)], "doc_id long, quality int")
    field = quality_rules.fit_on_labels(docs, labels)
    texts = pa.array([t for _, t in rows[300:]])
    held = [x for d in range(300, 600) for x in planted[d]]
    found = np.concatenate([quality_rules.viterbi(field, quality_rules.figures_and_lines(w)[1]) for _, _, w in kernel.word_slices(texts)])
    assert len(found) == len(held) and sum(bool(f) == h for f, h in zip(found, held)) > 0.97 * len(held)
    got = {x.doc_id: x for x in quality_rules.apply_rules(docs, labels, keep=["doc_id"]).collect()}
    mixed = [d for d in range(300, 600) if 0 < sum(planted[d]) < len(planted[d])]
    assert sum(0 < got[d].content_share < 1 for d in mixed) > 0.9 * len(mixed) > 90
    assert sum(got[d].kept == (d % 3 > 0) for d in range(300, 600)) > 290


def test_quality_edge_cases(spark):
    none = empty(spark, "doc_id long, quality int")
    docs = awkward(spark, extra=True).withColumns({"kept": F.lit("clash"), "lang": F.lit("en")})
    got = quality_rules.apply_rules(docs, none)
    assert got.columns.count("kept") == 1 and dict(got.dtypes)["kept"] == "boolean" and "lang" in got.columns
    rows = got.collect()
    assert len(rows) == len(AWKWARD) + 2
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures(r.text) and r.kept != r.base_failed
    assert quality_rules.apply_rules(empty(spark), none).count() == 0


# --- decontamination ---------------------------------------------------------------


def overlap(doc, item):
    window = min(13, len(item))
    allowed = 2 * window // 13
    best = None
    if len(item) < decontaminate.LEAST_WORDS:
        return None
    for shift in range(window - len(item), len(doc) - window + 1):
        covered = set()
        for j in range(max(shift, 0), min(shift + len(item), len(doc)) - window + 1):
            if sum(doc[j + k] == item[j + k - shift] for k in range(window)) >= window - allowed:
                covered.update(range(j, j + window))
        if covered:
            found = (-sum(doc[j] == item[j - shift] for j in covered), min(covered))
            best = found if best is None or found < best else best
    return best


def test_overlaps_are_those_of_all_windows(spark):
    docs = [(d.doc_id, words(lower(d.text))) for d in documents(spark).collect()]
    items = [(b.item_id, words(lower(b.text))) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in items}
    expected = {}
    for d, w in docs:
        own = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}  # 11 of 13 equal words leave three in a row
        for i, item in items:
            if own & grams[i] and (found := overlap(w, item)):
                expected[d, i] = found
    got = {(r.doc_id, r.item_id): (-r.matched_words, r.first_word) for r in queries.op10_decontaminate(spark, SF).collect()}
    assert got == expected and got


def test_masks_are_lossless_and_blocks_agree(spark):
    r = random.Random(1)
    item = [f"w{i}" for i in range(20)]
    rows = []
    for n in range(200):
        s = r.randrange(8)
        part = item[s : s + 13]
        for k in r.sample(range(13), 2):
            part[k] = f"z{k}"
        rows.append((n, " ".join([f"p{k}" for k in range(r.randrange(6))] + part + ["q"])))
    rows += [(1000, " ".join(item[:10])), (1001, "one two three four five six"), (1002, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item)), (6, "One two three FOUR five six"), (7, "a b"), (8, None), (9, ""), (4, " ".join(item))], "item_id long, text string")
    expected = {(n, 4) for n in range(200)} | {(1001, 6)}
    for block in (1, 10**6):
        assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs, bench, block).collect()} == expected
        flags = decontaminate.flagged(docs, bench, ["doc_id"], block)
        assert {x.doc_id for x in flags.where("contaminated").collect()} == {d for d, _ in expected}


def test_short_items_are_found_with_a_substitution(spark):
    r = random.Random(2)
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in range(3, 13)]
    docs = []
    for n, w in items:
        for wrong in (0, 1, 2):
            for _ in range(6):
                part = list(w)
                for k in r.sample(range(n), wrong):
                    part[k] = "z"
                docs.append((len(docs), [f"p{k}" for k in range(r.randrange(5))] + part + ["q"] * r.randrange(3)))
    expected = {(d, n) for d, w in docs for n, item in items if overlap(w, item)}
    assert {n for _, n in expected} == set(range(5, 13))
    as_rows = lambda rows, names: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], names)
    docs_, items_ = as_rows(docs, "doc_id long, text string"), as_rows(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs_.withColumn("item_id", F.lit("clash")), items_).collect()} == expected
    assert {x.item_id for x in decontaminate.overlaps(docs_, items_, least_words=3).collect()} == set(range(3, 13))


def test_decontamination_edge_cases(spark):
    bench = empty(spark, "item_id long, text string")
    assert decontaminate.overlaps(awkward(spark), bench).count() == 0
    assert decontaminate.flagged(awkward(spark, extra=True), bench).where("contaminated").count() == 0
    items = spark.createDataFrame([(1, "A b C " * 5)], "item_id long, text string")
    docs = awkward(spark, extra=True).withColumn("contaminated", F.lit("clash"))
    assert sorted(r.doc_id for r in decontaminate.flagged(docs, items).where("contaminated").collect()) == [6, 6, 7]
    assert decontaminate.overlaps(empty(spark), items).count() == 0


# --- importance resampling -----------------------------------------------------------


def test_kth_largest(spark):
    r = random.Random(5)
    values = [r.choice([r.random(), 0.5, -3.0, 1e9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values, reverse=True)
    for k in (1, 17, 800, 2999, 3000):
        assert importance_sample.kth_largest(df, "v", k, few=10) == (order[k - 1], sum(v > order[k - 1] for v in values))


def test_scores_and_choice_by_counting(spark):
    r = random.Random(8)
    good, bad = ["alpha", "beta", "gamma"], ["spam", "scam"]
    rows = [(i, " ".join(r.choice(good + (bad if i % 4 == 0 else [])) for _ in range(12))) for i in range(400)]
    rows += rows[:3] + [(500, None), (500, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    features = [Counter((t or "").split()) + Counter(zip((t or "").split(), (t or "").split()[1:])) for _, t in rows]
    raw = sum(features, Counter())
    target = sum((f for (i, _), f in zip(rows, features) if i % 4 and i < 400), Counter())
    n_raw, n_target = sum(raw.values()), sum(target.values())
    gumbel = {x.id: x.g for x in spark.createDataFrame([(i,) for i, _ in rows], "id long").select("id", importance_sample.gumbel("id").alias("g")).collect()}
    for z in (0.0, importance_sample.Z):
        ratio = {}
        for f, n in raw.items():
            expected = n * n_target / n_raw
            told = abs(target[f] - expected) > z * math.sqrt(expected * (1 - n_target / n_raw))
            ratio[f] = math.log((target[f] + 0.5) / (expected + 0.5)) if told else 0.0
        keyed = sorted(((sum(ratio[w] * c for w, c in f.items()) + gumbel[i], i) for (i, _), f in zip(rows, features)), key=lambda x: (-x[0], x[1]))
        got = importance_sample.resample(docs, labels, keep=["doc_id"], z=z).collect()
        assert np.allclose(sorted(g.gumbel_key for g in got), sorted(k for k, _ in keyed))
        k = round(0.75 * len(rows))
        assert {g.doc_id for g in got if g.kept} == {i for _, i in keyed[:k]}
        assert sum(g.kept for g in got if g.doc_id % 4 == 0 and g.doc_id < 400) < 10


def test_equal_keys_go_by_the_smallest_id(spark, monkeypatch):
    monkeypatch.setattr(importance_sample, "gumbel", lambda key, seed=0: F.lit(0.0))
    docs = spark.createDataFrame([(i, "same words") for i in (5, 3, 9, 1, 7, 3)], "doc_id long, text string")
    got = importance_sample.resample(docs, empty(spark, "doc_id long, quality int, toxic int"), ["doc_id"], share=0.5).collect()
    assert sorted(g.doc_id for g in got if g.kept) == [1, 3, 3]


def test_gumbel_is_gumbel(spark):
    x = np.array([r[0] for r in spark.range(20000).select(importance_sample.gumbel("id")).collect()])
    assert abs(x.mean() - 0.5772) < 0.03 and abs(x.std() - 1.2825) < 0.03


def test_resampling_edge_cases(spark):
    none = empty(spark, "doc_id long, quality int, toxic int")
    got = importance_sample.resample(awkward(spark, extra=True), none, ["doc_id"]).collect()
    assert len(got) == len(AWKWARD) + 2 and all(g.kept and g.log_importance == 0 for g in got)
    some = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance_sample.resample(awkward(spark), some, ["doc_id"]).where("kept").count() == len(AWKWARD) // 2
    assert importance_sample.resample(empty(spark), none, ["doc_id"]).count() == 0
