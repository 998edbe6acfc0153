import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import gru_lm, word_chunks

SCHEMA = "doc_id long, text string, score double, kinds string"


def base_rows(rows):
    """n_tokens, n_known, N and the add-one score by hand."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for d, t, *_ in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(((d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for d, t, *_ in rows), key=str)


def mine(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in df.collect()), key=str)


def test_counts_and_base(spark, sf_dir):
    odd = [(i, t, 0.0, "x") for i, t in enumerate([None, "", " \n", "É é A a", "word " * 20_000, "x" * 50_000, "a\x00b a", "日本 語"] * 2)] + [(3, "same", 0.0, ""), (3, "same", 0.0, ""), (None, "null id", None, None)]
    for rows in (odd, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]):
        docs = spark.createDataFrame([(*r, None, None)[:4] for r in rows], SCHEMA)
        got = gru_lm.score_documents(docs)
        assert mine(got) == base_rows(rows)
    assert gru_lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_training_rows(spark):
    held = [d for d in range(50) if zlib.crc32(str(d).encode()) % 7 == 2]
    rows = [(d, "a b", 0.0, "") for d in held]
    got = gru_lm.score_documents(spark.createDataFrame(rows, SCHEMA))
    assert mine(got) == base_rows(rows)
    assert all(r["score"] <= 0 for r in got.collect())


def grid():
    """Symbols of all kinds; a text begins within the window."""
    rng = np.random.default_rng(0)
    inputs = rng.choice([0, 1, 3, 40, 127, 128, 129, 160, 500, 1151], (6, 4))
    targets = rng.choice([0, 1, 3, 40, 127, 128, 129, 131, 160, 500, 1151], (6, 4))
    inputs[0, :2] = inputs[3, 1] = inputs[2, 2] = gru_lm.BEFORE
    return inputs, targets, np.arange(6)[:, None] < np.array([6, 6, 4, 2]), rng.normal(size=(4, gru_lm.HIDDEN)).astype(np.float32)


def test_gradient():
    net = gru_lm.Gru(3)
    inputs, targets, live, h = grid()

    def loss():
        total, state = 0.0, h
        for t in range(6):
            state = np.where((inputs[t] == gru_lm.BEFORE)[:, None], 0, state)
            state = np.where(live[t][:, None], net.step(inputs[t], state)[0], state)
            total -= float((net.log_targets(state, targets[t]) * live[t]).sum())
        return total

    grads, _ = net.window(inputs, targets, live, h)
    used = [int(x) for x in np.unique(inputs)][:6]
    places = [("w", (3, 2)), ("b", (1,)), ("u", (2, 5)), ("u", (3, 20)), ("u", (1, 40)), *(("e", (x, 7)) for x in used), *(("e", (x, 40)) for x in used), ("v", (0, 1, 3)), ("v", (1, 0, 5)), ("c", (0, 1)), ("c", (31, 31))]
    for name, at in places:
        value, old = getattr(net, name), getattr(net, name)[at]
        value[at] = old + 0.01
        up = loss()
        value[at] = old - 0.01
        down = loss()
        value[at] = old
        assert grads[name][at] == pytest.approx((up - down) / 0.02, rel=0.03, abs=0.01), (name, at)


def probabilities(net, state):
    """P of every symbol that can be a target, by plain softmaxes."""
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    p = soft(state.astype(float) @ net.w + net.b)
    out = np.zeros(gru_lm.BEFORE)
    out[: gru_lm.CLASSES] = p
    for k in range(gru_lm.FREQUENT):
        out[gru_lm.FIRST_FREQUENT + k] = 0
        out[gru_lm.CLASSES + k * gru_lm.MEMBERS : gru_lm.CLASSES + (k + 1) * gru_lm.MEMBERS] = p[gru_lm.FIRST_FREQUENT + k] * soft(net.v[k].astype(float) @ state + net.c[k])
    return out


def test_scores_carry_the_state_and_sum_to_one():
    net, rng = gru_lm.Gru(4), np.random.default_rng(1)
    sizes = [40, 1, 17, 16, 3]
    kinds = rng.choice([0, 1, 50, 127, *range(128, 1152)], sum(sizes)).astype("<u2")
    got, at = gru_lm.document_scores(net, kinds, sizes, width=3), 0
    for n, value in zip(sizes, got):
        h, before, total = np.zeros((1, gru_lm.HIDDEN), np.float32), gru_lm.BEFORE, 0.0
        for k in kinds[at : at + n].tolist():
            h = net.step(np.array([before]), h)[0]
            p = probabilities(net, h[0])
            assert p.sum() == pytest.approx(1.0)
            total, before = total + math.log(p[k]), k
        at += n
        assert value == pytest.approx(total, rel=1e-4)


def test_training_carries_the_state_through_long_documents():
    """Windows over lanes of several documents give the gradients of whole documents from a zero state."""
    rng = np.random.default_rng(6)
    docs = [rng.integers(128, 400, n).astype("<u2") for n in (50, 7, 1, 33, 20)]
    lanes = gru_lm.Lanes(docs, 2, 0)
    assert lanes.sizes.sum() == 111 and sum((x == gru_lm.BEFORE).sum() for x in lanes.inputs) == 5
    net, h, seen = gru_lm.Gru(2), np.zeros((2, gru_lm.HIDDEN), np.float32), []
    for t in range(0, len(lanes), gru_lm.WINDOW):
        inputs, targets, live = lanes.window(t, min(t + gru_lm.WINDOW, len(lanes)))
        h = h[: inputs.shape[1]]
        for s in range(len(inputs)):
            h = np.where((inputs[s] == gru_lm.BEFORE)[:, None], 0, h)
            h = net.step(inputs[s], h)[0]
            seen += [float(x) for x in net.log_targets(h, targets[s])[live[s]]]
    whole = gru_lm.document_scores(net, np.concatenate(docs), [len(d) for d in docs])
    assert sum(seen) == pytest.approx(whole.sum(), rel=1e-4)


def test_windows_hold_every_symbol_once():
    rng = np.random.default_rng(3)
    docs = [rng.integers(1, 60_000, n).astype("<u2") for n in (130, 1, 1, 64, 65, 5, 200, 3)]
    for lanes in (1, 3, 8):
        dealt = gru_lm.Lanes(docs, lanes, 5)
        columns = [[] for _ in range(lanes)]
        for t in range(0, len(dealt), 64):
            inputs, targets, live = dealt.window(t, min(t + 64, len(dealt)))
            assert inputs.shape == targets.shape == live.shape and (inputs[~live] == gru_lm.END).all()
            assert inputs.shape[1] == (dealt.sizes > t).sum()
            for k in range(inputs.shape[1]):
                columns[k] += list(zip(inputs[live[:, k], k].tolist(), targets[live[:, k], k].tolist(), strict=True))
        for i, (stop, *parts) in enumerate(dealt.windows(2)):
            alone = dealt.window(i * gru_lm.WINDOW, stop)
            assert all((a == b).all() and a.shape == b.shape for a, b in zip(parts, alone, strict=True))
        assert stop == len(dealt)
        whole = [d for c in columns for d in "".join("|" if i == gru_lm.BEFORE else chr(i) for i, _ in c).split("|")[1:]]
        assert sorted(whole) == sorted("".join(map(chr, d[:-1].tolist())) for d in docs)
        assert sorted(t for c in columns for _, t in c) == sorted(np.concatenate(docs).tolist())


def test_a_very_long_text_takes_little_memory():
    """A text of a million words beside 300 short ones: what is laid out stays near the size of the symbols."""
    import tracemalloc

    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 1000, n).astype("<u2") for n in [1_000_000, *[4_000] * 300]]
    tracemalloc.start()
    lanes = gru_lm.Lanes(docs, 244, 7)
    seen = sum(int(lanes.window(t, min(t + gru_lm.WINDOW, len(lanes)))[2].sum()) for t in range(0, len(lanes), gru_lm.WINDOW))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 2_200_000 and most < 60_000_000


def test_shares_sum_to_one():
    counts = {b"aa": 5, b"ab": 3, b"ba": 2, b"c": 1, b"d": 1, b"the": 9}
    vocab = gru_lm.Vocabulary(21, 7, 1, 2, 0.4, {b"the": 128}, {b"aa": 60, b"ab": 60}, np.zeros(gru_lm.BEFORE))
    for w, c in counts.items():
        vocab.mass[vocab.symbol_of(w, c)] += c
    kinds = np.array([vocab.symbol_of(w, c) for w, c in counts.items()] + [gru_lm.RARE])
    share = 10 ** vocab.share(kinds, np.array([*counts.values(), 0]))
    for k in set(kinds.tolist()):
        assert share[kinds == k].sum() == pytest.approx(1.0)


def test_partitions_do_not_change_scores(spark, monkeypatch):
    """End to end: whole tables in one, three or seven partitions, several shards a round."""
    monkeypatch.setattr(gru_lm.train_round, "__defaults__", (5_000,))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).select("doc_id", "text").toPandas()
    docs = spark.createDataFrame(docs)
    runs = []
    for n in (1, 3, 7):
        rows = gru_lm.score_documents(docs.repartition(n)).collect()
        runs.append({r["doc_id"]: (r["score"], r["n_tokens"]) for r in rows})
    for other in runs[1:]:
        assert other.keys() == runs[0].keys()
        assert max(abs(other[d][0] - s) / n for d, (s, n) in runs[0].items()) < 1e-3


def test_learns(spark):
    """Held-out texts are likelier than under the unigram model, and a net that has learnt beats one that hasn't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = gru_lm.score_documents(docs).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert np.mean([r["score"] > r["base_score"] for r in rows]) > 0.9
    per_token = sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    print("log10 per token", per_token, sum(r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows))


ODD_TEXTS = [b"", b" ", b" a", b"a ", b"\n\n a\tB\x0bc\x0cd\re  ", "\u00c9 \u00e9 A\x1c\x1d\x85 x\u00a0y  z\x00".encode(), b"x" * 50_000, b"the the The a"]


def test_words_as_arrays():
    """Arrays give the words and, coded, the chunk that Python words give."""
    many, found = gru_lm.words_of(pa.array(ODD_TEXTS, pa.binary()))
    by_text = [gru_lm.words(t) for t in ODD_TEXTS]
    assert many.tolist() == [len(w) for w in by_text] and found.to_pylist() == [w for ws in by_text for w in ws]
    codes = word_chunks._Codes()
    coded = [np.fromiter(map(codes.__getitem__, ws), np.int32, len(ws)) for ws in by_text]
    ids, extra = list(range(len(ODD_TEXTS))), [k % 2 for k in range(len(ODD_TEXTS))]
    pieces = [gru_lm.words_of(pa.array(ODD_TEXTS, pa.binary()).slice(k, 2))[1] for k in range(0, len(ODD_TEXTS), 2)]
    for parts in (1, 5, 50):
        assert word_chunks._array_chunk(3, ids, extra, many.tolist(), pieces, parts) == word_chunks._chunk(3, ids, extra, many.tolist(), coded, codes, parts)
    empty = word_chunks._array_chunk(0, [1], [1], [0], [found[:0]], 5)
    assert empty["codes"] == empty["order"] == b"" and empty["parts"] == []
    for part in word_chunks._array_chunk(0, ids, extra, many.tolist(), pieces, 5)["parts"]:
        assert word_chunks.split_array(part["words"]).to_pylist() == word_chunks.split_words(part["words"])


def test_counts_of_many_chunks(spark):
    """More chunks than word_table holds at once: counts and symbols as by hand."""
    rng = np.random.default_rng(8)
    rows = [(d, " ".join(f"w{k}" for k in rng.zipf(1.5, 30) if k < 500)) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    chunks = word_chunks.chunked(docs, gru_lm.words, extra=gru_lm.F.lit(1), chunk_bytes=16, split_arrays=gru_lm.words_of)
    assert chunks.count() == 300
    counts = Counter(w for _, t in rows for w in gru_lm.words(t.encode()))
    table = gru_lm.word_table(chunks)
    got = {}
    for r in table.collect():
        got |= dict(zip(word_chunks.split_words(r["words"]), np.frombuffer(word_chunks.stretch(r["counts"]), "<i8").tolist(), strict=True))
        mine = Counter({w: c for w, c in got.items() if zlib.crc32(w) % int(spark.conf.get("spark.sql.shuffle.partitions")) == r["part"]})
        assert r["tokens"] == sum(mine.values()) and r["distinct"] == len(mine)
        assert [(bytes(x["word"]), x["n"]) for x in r["top"]] == sorted(mine.items(), key=lambda x: (-x[1], x[0]))[: gru_lm.WORDS]
    assert got == counts
    vocab = gru_lm.vocabulary(table, 300)
    vocab.mass = gru_lm._symbol_mass(table, vocab)
    data = gru_lm.sequences(chunks, gru_lm._classed(chunks, table, vocab), vocab).collect()
    kinds = {r["doc_ids"][0]: np.frombuffer(r["kinds"], "<u2").tolist() for r in data}
    assert kinds == {d: [*(vocab.symbol_of(w, counts[w]) for w in gru_lm.words(t.encode())), gru_lm.END] for d, t in rows}


def test_windows_reuse_their_memory():
    """After the first window of a shard the next take no new arrays of its size; before, each took megabytes."""
    import tracemalloc

    net, rng = gru_lm.Gru(1), np.random.default_rng(2)
    inputs, targets = rng.integers(128, 1152, (2, gru_lm.WINDOW, 256))
    live, h = np.ones(inputs.shape, bool), np.zeros((256, gru_lm.HIDDEN), np.float32)
    _, h = net.window(inputs, targets, live, h)
    tracemalloc.start()
    net.window(inputs, targets, live, h)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2_000_000, most
