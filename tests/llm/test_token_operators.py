"""Byte-level BPE, chat formatting, language model, sharding."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from docloom.llm import attention_lm, byte_bpe, chat_format, kernel, queries, sharding

from .helpers import AWKWARD, SF, awkward, documents, empty, lower, words

RANKS, PATTERN = queries.RANKS, public_tokenizers.PATTERN


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- BPE -------------------------------------------------------------------------


def test_encoding_is_the_rank_files(monkeypatch):
    known, own = reference(), byte_bpe.encoder(RANKS, PATTERN)
    r = random.Random(3)
    odd = [chr(c) for c in [9, 10, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0x180E, 0x4E2D, 0x1F600, 0x301, 0x660, 0xB2, 0x2160, *range(0xC0, 0x180)]]
    plain = [chr(c) for c in range(32, 127)]
    tokens = list(own.table.values())
    for _ in range(4000):
        text = "".join(r.choice(plain + odd if r.random() < 0.5 else plain) for _ in range(r.randrange(25)))
        assert own.ids(text).tolist() == known.encode_ordinary(text)
        text = b"".join(r.choice(tokens) for _ in range(3)).decode("utf-8", "replace")
        assert own.ids(text).tolist() == known.encode_ordinary(text)


def test_small_tables_change_nothing():
    own = byte_bpe.Encoder(RANKS, PATTERN, max_pieces=5, max_states=20)
    text = " ".join(w for _, t in AWKWARD for w in words(t)[:40]) + " unbelievably thathereationly"
    assert own.ids(text).tolist() == reference().encode_ordinary(text)


def test_round_trip_query(spark):
    known = reference()
    got = {r.doc_id: r for r in queries.op9_byte_bpe(spark, SF).collect()}
    for d in documents(spark).collect():
        ids, g = known.encode_ordinary(d.text or ""), got[d.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_utf8_machine_is_the_codec():
    r = random.Random(2)
    some = [0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0x41, 0xC3, 0xA9, 0xED, 0xA0, 0xF4, 0x90, 0xC0, 0xFF]
    for _ in range(5000):
        data, machine, out, i = bytes(r.choice(some) for _ in range(r.randrange(12))), byte_bpe.Utf8Machine(), "", 0
        while i < len(data):
            j = i + r.randrange(1, 4)
            out, i = out + machine.feed(data[i:j]), j
        assert out + machine.finish() == data.decode("utf-8", "replace")


def test_bpe_edge_cases(spark):
    docs = awkward(spark, extra=True).withColumns({"ids": F.lit("clash"), "lang": F.lit("x")})
    rows = byte_bpe.encode(docs, RANKS, PATTERN).collect()
    table = byte_bpe.encoder(RANKS, PATTERN).table
    assert len(rows) == len(AWKWARD) + 2
    for r in rows:
        assert b"".join(table[i] for i in r.ids).decode() == (r.text or "") and r.n_tokens == len(r.ids) and r.lang == "x"
    assert byte_bpe.encode(empty(spark), RANKS, PATTERN).count() == 0


# --- chats -----------------------------------------------------------------------


def test_escapes_can_be_undone():
    r = random.Random(2)
    for _ in range(5000):
        parts = ["".join(r.choice(["\\", "###", "#", "</turn>", "<", ":", "a", " ", "\n"]) for _ in range(r.randrange(8))) for _ in range(3)]
        assert chat_format.unescape("".join(map(chat_format.escape, parts))) == "".join(parts)
        assert chat_format.unescape(chat_format.escape(parts[0], role=True)) == parts[0]


def digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2], x[3])):
        by[conv].append((role, text))
    out = {}
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        formatted = "".join(f"### {chat_format.escape(r, True)}: {chat_format.escape(t)}</turn>\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    return out


def columns(r):
    return r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]
    assert {r.conv_id: columns(r) for r in queries.op7_chat_format(spark, SF).collect()} == digests(rows)


def test_chat_edge_cases_and_masks(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 5, "we: ird ###", "é😀\n### x"), (2, 9, "assistant", "</turn>\\"), (None, 0, "user", "hi")]
    schema = "conv_id long, turn long, role string, text string"
    turns = chat_format.assemble(spark.createDataFrame(rows, schema).withColumn("start", F.lit(1)), RANKS, PATTERN)
    assert {r.conv_id: columns(r) for r in chat_format.read_back(turns, RANKS, PATTERN).collect()} == digests(rows)
    for r in turns.collect():
        assert (r.loss_to > r.loss_from) == (r.role == "assistant" and r.text != "") and r.start < r.loss_from <= r.loss_to < r.start + len(r.ids)
    assert chat_format.read_back(chat_format.assemble(empty(spark, schema), RANKS, PATTERN), RANKS, PATTERN).count() == 0


# --- language model ----------------------------------------------------------------


def base_figures(rows):
    held = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for i, (d, _) in enumerate(rows)}
    tokens = [words(lower(t)) for _, t in rows]
    c = Counter(w for i, ws in enumerate(tokens) if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    return [(rows[i][0], held[i], len(ws) + 1, sum(w in c for w in ws) + (ends > 0), n, sum(log(c[w]) for w in ws) + log(ends)) for i, ws in enumerate(tokens)]


def same(got, expected):
    key = lambda x: (x[0] is not None, x[0] or 0, x[2], round(x[5], 6))
    got = sorted(((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, g.base_score) for g in got), key=key)
    for g, e in zip(got, sorted(expected, key=key), strict=True):
        assert g[:5] == e[:5] and math.isclose(g[5], e[5], rel_tol=1e-9, abs_tol=1e-9)


def test_base_figures_of_documents(spark, monkeypatch):
    monkeypatch.setattr(attention_lm.frequent_words, "__defaults__", (50,))  # so that words are joined, too
    got = queries.op5_attention_lm(spark, SF).collect()
    same(got, base_figures([tuple(d) for d in documents(spark).collect()]))
    assert all(g.score < 0 for g in got)


def test_every_repeated_run_and_word_is_remembered(spark, monkeypatch):
    docs = spark.createDataFrame(documents(spark).collect(), "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r.score for r in attention_lm.score(docs, RANKS, 400).collect()}
    monkeypatch.setattr(attention_lm.frequent_words, "__defaults__", (50,))
    monkeypatch.setattr(attention_lm.pairs_and_memory, "__defaults__", (50,))
    got = {r.doc_id: r.score for r in attention_lm.score(docs, RANKS, 400).collect()}
    assert whole.keys() == got.keys() and all(math.isclose(got[d], whole[d], rel_tol=1e-3) for d in got)


def test_model_edge_cases(spark):
    got = attention_lm.score(awkward(spark, extra=True), RANKS).collect()
    same(got, base_figures(AWKWARD + [AWKWARD[6], AWKWARD[1]]))
    assert all(math.isfinite(g.score) for g in got)
    assert attention_lm.score(empty(spark), RANKS).count() == 0


def tiny():
    rng = np.random.default_rng(2)
    n = 80
    t = attention_lm.tables(rng.poisson(2, (n, n)).astype(float))
    ids = rng.integers(0, n, 200)
    rows = np.array([0, 3, 120]), np.array([3, 120, 200])
    return t, ids, rows, attention_lm._shifted(ids, rows[0], n - 1)


def test_model_is_a_distribution_and_causal():
    t, ids, rows, shifted = tiny()
    w = attention_lm.start_weights()
    w["out"] *= 20
    x = attention_lm.batch(ids, shifted, *attention_lm.window_places(*rows))
    assert sorted(x.place[x.scored].tolist()) == list(range(200))  # each id once
    total = np.zeros(x.target.shape)
    for i in range(len(t.of_class)):
        y = attention_lm.Windows(x.read, x.there, np.full_like(x.target, i), x.scored, x.place)
        total += np.exp(attention_lm.forward(w, t, y)[0])
    assert np.allclose(total, 1, atol=1e-4)
    later = ids.copy()
    later[60:] = (later[60:] + 7) % 80
    y = attention_lm.batch(later, attention_lm._shifted(later, rows[0], 79), *attention_lm.window_places(*rows))
    a, b = attention_lm.forward(w, t, x)[0], attention_lm.forward(w, t, y)[0]
    before = x.scored & (x.place < 60)
    assert np.allclose(a[before], b[before])


def test_a_window_scores_alike_in_every_batch():
    rng = np.random.default_rng(4)
    t, *_ = tiny()
    ids = rng.integers(0, 80, 20_000)
    ends = np.sort(rng.choice(np.arange(1, 20_000), 60, replace=False))
    rows = np.r_[0, ends], np.r_[ends, 20_000]
    places = attention_lm.window_places(*rows)
    shifted = attention_lm._shifted(ids, rows[0], 79)
    w = attention_lm.unpack(attention_lm.pack(attention_lm.start_weights()) + 0.2 * rng.standard_normal(len(attention_lm.pack(attention_lm.start_weights()))))
    scorer = attention_lm.Scorer.of(w, t)

    def scores(size):
        out = np.zeros(len(ids))
        for i in range(0, len(places[0]), size):
            x = attention_lm.batch(ids, shifted, *(p[i : i + size] for p in places))
            out[x.place[x.scored]] = scorer.log_p(x)[x.scored]
        return out

    whole = scores(10**6)
    assert all((scores(size) == whole).all() for size in (1, 37, 256))
    x = attention_lm.batch(ids, shifted, *places)
    assert np.allclose(attention_lm.forward(w, t, x)[0], scorer.log_p(x), atol=1e-4)


def test_a_scored_id_reads_seventeen_ids_back():
    t, ids, rows, shifted = tiny()
    w = attention_lm.start_weights()
    w["out"] *= 20
    places = attention_lm.window_places(np.array([0]), np.array([200]))
    first = 6 * attention_lm.STRIDE
    other = ids.copy()
    other[first - 17] = (ids[first - 17] + 7) % 79
    a, b = (attention_lm.batch(x, attention_lm._shifted(x, np.array([0]), 79), *places) for x in (ids, other))
    at = a.scored & (a.place == first)
    assert attention_lm.forward(w, t, a)[0][at] != attention_lm.forward(w, t, b)[0][at]
    assert (attention_lm.RANKS, attention_lm.CLASSES) == (2048, 64)


def test_words_of_a_small_alphabet_share_one(spark):
    """Ids are single bytes, so a word is one string of ids, and all texts of up to 3 words of up to 3 letters are nearly all that the model knows."""
    every = ["".join(w) for n in (1, 2, 3) for w in itertools.product("ab", repeat=n)]
    texts = [" ".join(t) for n in range(4) for t in itertools.product(every, repeat=n)]
    ids = iter(range(10**6))
    train, held = ([i for i in itertools.islice(ids, 100_000) if (zlib.crc32(str(i).encode()) % 5 == 1) == h] for h in (False, True))
    r = random.Random(4)
    seen = [" ".join(r.choice(every[:5]) for _ in range(r.choice((0, 1, 1, 2)))) for _ in range(20_000)]
    docs = spark.createDataFrame([*zip(train, seen), *zip(held, texts)], "doc_id long, text string")
    got = attention_lm.score(docs, RANKS, 0).where("held_out").collect()
    total = math.fsum(10**g.score for g in got)
    assert len(got) == len(texts) and 0.95 < total < 1.0001


def test_prefixes_of_the_one_word_keep_nothing(spark):
    word = "thathereationing"
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 != 1][:2000]
    texts = [word[:n] for n in range(len(word) + 1)]
    docs = spark.createDataFrame([*zip(train, itertools.repeat(word)), *zip(held, texts)], "doc_id long, text string")
    got = {g.doc_id: 10**g.score for g in attention_lm.score(docs, RANKS).where("held_out").collect()}
    assert math.fsum(got.values()) < 1.0001 and got[held[len(word)]] > 0.5


def test_begins_are_the_sum_of_their_ids():
    _, ids, rows, shifted = tiny()
    rng = np.random.default_rng(2)
    begins = np.arange(80) % 3 == 2
    t = attention_lm.tables(rng.poisson(2, (80, 80)).astype(float), begins)
    w = attention_lm.start_weights()
    w["out"] *= 20
    x = attention_lm.batch(ids, shifted, *attention_lm.window_places(*rows))
    scorer = attention_lm.Scorer.of(w, t)
    total = np.zeros(x.target.shape)
    for i in np.flatnonzero(begins):
        total += np.exp(scorer.log_p(attention_lm.Windows(x.read, x.there, np.full_like(x.target, i), x.scored, x.place)))
    own = begins[x.target]
    assert np.allclose(scorer.scores(x)[1][own], total[own], atol=1e-5) and (scorer.scores(x)[1][~own] == 1).all()


def test_gradient_and_training():
    t, ids, rows, shifted = tiny()
    w = {k: v.astype(np.float64) for k, v in attention_lm.start_weights().items()}
    w["out"] *= 10
    x = attention_lm.batch(ids, shifted, *attention_lm.window_places(*rows))
    mean = lambda: attention_lm.forward(w, t, x)[0][x.scored].mean()
    g = attention_lm.slopes(w, x, attention_lm.forward(w, t, x)[1])
    rng = np.random.default_rng(0)
    for name in w:
        flat, slope = w[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            old = flat[i]
            flat[i] = old + 1e-3
            up = mean()
            flat[i] = old - 1e-3
            down = mean()
            flat[i] = old
            assert np.isclose(slope[i], (up - down) / 2e-3, atol=3e-4), name
    trainer = attention_lm.Trainer(t)
    places = attention_lm.window_places(*rows)
    start = attention_lm.forward(trainer.w, t, x)[0][x.scored].mean()
    for _ in range(40):
        trainer.take(ids, shifted, *places)
    assert attention_lm.forward(trainer.w, t, x)[0][x.scored].mean() > start + 0.05


def test_a_word_is_encoded_once(monkeypatch):
    """Ids are those of each word by itself, however many words are remembered."""
    texts = pa.array(["the cat the mat", "", None, "The cat\t\u00e9t\u00e9 <|end|> sat on thE mat", "\u00a0 the \U0001f600\n\n" + "a" * 300, "the"] * 50)
    parts = [w for _, _, w in kernel.word_slices(texts, lower=True, limit=100)]
    for most, encoded in ((1 << 18, 10), (4, None)):
        monkeypatch.setattr(attention_lm, "MET", most)
        own = attention_lm.Subwords(RANKS, 400)
        one = lambda word: own.encoding.encode_to_numpy(" " + word, disallowed_special=()).tolist()
        expected, seen, plain = [], [], own.encoding
        monkeypatch.setattr(own, "encoding", type("Counted", (), {"encode_to_numpy": lambda self, text, **k: seen.append(text) or plain.encode_to_numpy(text, **k)})())
        got = [own.sequence(w) for w in parts]
        if encoded:
            assert sum(t.count(" ") for t in seen) == encoded
        monkeypatch.setattr(own, "encoding", plain)
        for text in texts.to_pylist():
            expected += [i for w in words(lower(text)) for i in one(w)] + [own.end]
        assert np.concatenate([g[0] for g in got]).tolist() == expected
        for ids, unit_at, row_at, hashes in got:
            assert unit_at.tolist() == np.flatnonzero(own.begins[ids]).tolist() and len(unit_at) == len(hashes) == row_at[-1]


def test_token_table_is_smaller_than_its_ids(spark, monkeypatch):
    made, plain = [], attention_lm.stored
    monkeypatch.setattr(attention_lm, "stored", lambda *a: made.append(plain(*a)) or made[-1])
    attention_lm.score(documents(spark), RANKS).count()
    tokens = next(t for t in made if "ids" in t.columns)
    held = tokens.agg(F.sum(sum(F.octet_length(c) for c in ("ids", "counts", "rare_at", "rare")))).first()[0]
    files = [Path(unquote(urlparse(f).path)).stat().st_size for f in tokens.inputFiles()]
    assert sum(files) < 0.6 * held  # 0.47; by snappy 0.68


def test_every_training_text_moves_the_attention(spark):
    own = attention_lm.subwords(RANKS, 10)
    rng = np.random.default_rng(4)
    t = attention_lm.tables(rng.poisson(2, (own.size, own.size)).astype(float))
    texts = [rng.integers(0, own.size, 40).astype("<u2") for _ in range(6)]

    def weights(texts):
        rows = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(texts)], "doc_id long, ids binary").coalesce(1)
        return attention_lm.pack(attention_lm.fit_attention(rows, t, RANKS, 10, 240))

    whole = weights(texts)
    for k in range(6):
        other = [x if i != k else (x + 7) % own.size for i, x in enumerate(texts)]
        assert not np.array_equal(whole, weights([x.astype("<u2") for x in other])), k


def test_weights_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "SHARD_IDS", 500)
    monkeypatch.setattr(attention_lm, "_SUMMED", 2)
    own = attention_lm.subwords(RANKS, 10)
    rng = np.random.default_rng(6)
    t = attention_lm.tables(rng.poisson(2, (own.size, own.size)).astype(float))
    texts = [(None if i % 9 == 0 else i // 2, bytearray(rng.integers(0, own.size, rng.integers(1, 200)).astype("<u2").tobytes())) for i in range(60)]
    n = sum(len(x[1]) // 2 for x in texts)
    rows = spark.createDataFrame(texts + texts[:5], "doc_id long, ids binary")
    made = [attention_lm.pack(attention_lm.fit_attention(rows.repartition(k).orderBy(F.rand(k)), t, RANKS, 10, n)) for k in (1, 7)]
    assert np.array_equal(*made) and np.abs(made[0]).max() > 0


def test_scores_do_not_depend_on_partitions(spark):
    docs = documents(spark)
    runs = [{r.doc_id: r.score for r in attention_lm.score(docs.repartition(k), RANKS).collect()} for k in (1, 7)]
    assert runs[0] == runs[1]


# --- sharding ----------------------------------------------------------------------


def test_matrix_sums_and_law():
    sizes = [7, 0, 100, 33, 1]
    total = np.zeros((5, 8))
    for seed in range(2000):
        m = sharding.communication_matrix(sizes, 8, seed)
        assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == [18] * 5 + [17] * 3
        total += m
    assert np.allclose(total / 2000, np.outer(sizes, np.array([18] * 5 + [17] * 3) / 141), atol=0.35)


def test_large_draws_have_the_moments():
    rng = np.random.default_rng(1)
    x = [sharding.hypergeometric(rng, 10**12, 9 * 10**12, 10**6) for _ in range(300)]
    assert abs(np.mean(x) - 1e5) < 100 and 250 < np.std(x) < 350


def test_sharding_query(spark):
    rows = {d.doc_id: d.text or "" for d in documents(spark).collect()}
    got = queries.op2_sharding(spark, SF).collect()
    assert {g.doc_id: (g.size, g.text_crc32) for g in got} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows.items()}
    assert {g.law for g in got} == {"rows"} and {g.grown_shard for g in got} == {None}
    exact(got, 8)


def exact(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_edge_cases(spark):
    docs = awkward(spark, extra=True).unionByName(spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string")).withColumn("slot", F.lit("clash"))
    got = sharding.shuffle_into_shards(docs, "doc_id", 4, group_rows=3).collect()
    assert Counter(r.text for r in got) == Counter(r.text for r in docs.collect())
    exact(got, 4)
    assert sharding.shuffle_into_shards(empty(spark), "doc_id").count() == 0
    one, two = (sharding.shuffle_into_shards(spark.range(500).repartition(n), "id", group_rows=50).collect() for n in (1, 7))
    assert sorted(one) == sorted(two)  # whatever the partitions
    places = {r.id: r.shard for r in one}
    assert len({places[i] for i in range(40)}) == 8


def test_rows_of_one_id_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)  # so that copies are made in several blocks
    rows = [(i, "same" if i % 2 else f"text {j}") for i in range(20) for j in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shuffle_into_shards(docs, "doc_id", 8, group_rows=100).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    exact(got, 8)
    placed = {(r.shard, r.slot): r.doc_id for r in got}
    near = sum(placed[s, k] == placed.get((s, k + 1)) for s, k in placed)
    assert 20 <= near <= 85  # 992 neighbours; 49 of one id by chance, 7 the deviation
    spread = Counter((r.shard, r.doc_id) for r in got)
    assert 300 < sum((spread[s, i] - 6.25) ** 2 for s in range(8) for i in range(20)) < 1300  # about 5.4 for each of 160
    again = sharding.shuffle_into_shards(docs.repartition(5), "doc_id", 8, group_rows=100).collect()
    assert sorted(got) == sorted(again)
