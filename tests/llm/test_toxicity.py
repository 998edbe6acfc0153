import pickle

import pytest

from quillspark.llm import minhash_dedup, toxicity, worker_cache

INSULTS = ["idiot", "moron", "clown", "loser"]
LABELS = "doc_id long, quality int, toxic int, score double"


def corpus(n=600, seed=4):
    """Different texts; every fifth holds insults."""
    import random

    rng = random.Random(seed)
    plain = "the river runs past a quiet mill and you reading books is good way to rest at night markets open early close late in week train coast leaves from platform nine".split()
    rows = []
    for i in range(n):
        w = rng.choices(plain, k=30)
        if i % 5 == 0:
            w[rng.randrange(30)] = INSULTS[i // 5 % 4]
            w[rng.randrange(30)] = INSULTS[(i // 5 + 1) % 4]
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y, 0.5) for i, _, y in corpus()] + [(None, None, None, None), (3, 1, None, None)], LABELS)
    return toxicity.fit(docs, labels)


def test_scores(spark, model):
    odd = ["", None, "you 1d10t", "such a m0r0n!!", "i d i o t", "l-o-s-e-r", "cl*wn", "idiooooot", "IDIOT", "the river runs", "a $$$ b%%% 2020", "x" * 50_000, "the " * 50_000, "1" * 5_000 + "a"]
    docs = spark.createDataFrame([(i, t, 1.0, "y") for i, t in enumerate(odd)] + [(None, "idiot", 0.0, "")], "doc_id long, text string, score double, held_out string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, model).collect()}
    assert {i for i, p in got.items() if p} == {2, 3, 4, 5, 6, 7, 8, None}
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 9, 10, 11, 12, 13}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("token", ['"1diot', "(1diot)", "'1diot',", "-1diot-", "“1diot”", "idio7,", "idio7.", "!diot", '"!diot!"', "moro*", "(moro*).", "|diot", "+he !diot"])
def test_replaced_at_either_end(model, token):
    """No plain word or beginning of these is a feature: only the restored word marks them."""
    bare = toxicity.ToxicityModel({n: w for n, w in model.weights.items() if not n.endswith("*")}, model.bias, model.chars)
    assert bare.score(f"you {token} there".encode()) >= 0.7
    assert "idiot" in bare.restored(token) or "moron" in bare.restored(token)


def without_beginnings(model):
    """Only whole words mark, so that a token is found by what it is read as."""
    weights = {n: w for n, w in model.weights.items() if not n.endswith("*")}
    return toxicity.ToxicityModel(weights, model.bias, model.chars, toxicity.Marks(weights, model.marks.known))


@pytest.mark.parametrize("separator", toxicity.SEPARATORS)
def test_every_separator(model, separator):
    bare = without_beginnings(model)
    for word in INSULTS:
        for token in (separator.join(word), word[:2] + separator + word[2:], f"({word[:3]}{separator}{word[3:]})!"):
            assert bare.score(f"you {token} there".encode()) >= 0.7, token
            assert word in bare.restored(token), token


@pytest.mark.parametrize("word", INSULTS)
def test_one_doubled_letter(model, word):
    bare = without_beginnings(model)
    for i in range(len(word)):
        token = word[: i + 1] + word[i:]
        assert bare.score(f"you {token}, there".encode()) >= 0.7 and word in bare.restored(token), token


def test_words_of_like_shape(spark):
    """A plain word that differs from an insult by a doubled letter or an apostrophe stays what it is."""
    rows = corpus() + [(1000 + i, f"night market number {i} has looser rules and l'oser comes", 0) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1, y, 0.0) for i, _, y in rows], LABELS))
    assert model.marks.known == {"looser", "l'oser"}
    assert model.score(b"looser rules l'oser") < 0.7 and model.score(b"llooser rules") >= 0.7
    for plain in ("don't", "letter", "he'll", "l'eau", "aa", "o'clock", "i'd", "book's"):
        assert toxicity.readings(plain, model.marks) == []


def test_runs_of_three(model):
    """They are read where they can spell a marked word, with one mask at most; other lists are left alone."""
    weights = model.weights | {"ass": 9.0}
    chars = toxicity.CharModel(model.chars.tri, {"ass": 50.0, "idiot": 50.0})
    short = toxicity.ToxicityModel(weights, model.bias, chars, toxicity.Marks(weights))
    for run in ("a s s", "A S S", "a $ $", "@ s 5", "a * s", "x\na s s\ny"):
        assert short.score(f"you {run}".encode()) >= 0.7, run
    for run in ("a b c", "1 2 3", "* * *", "a * *", "a s", "s s a"):
        assert short.score(f"you {run}".encode()) < 0.7, run
        assert short.restored(f"You {run}") == f"you {run}".lower()


@pytest.mark.parametrize("text", ["the river!", "**quiet** mill*", "(the) 'train'", "week+ late!!", "5 $9 *** !!! ++", "“quiet” mill…"])
def test_plain_punctuation(model, text):
    assert model.score(text.encode()) < 0.7


def test_restored_text(model):
    assert model.restored("You 1d10t, l o s e r") == "you idiot loser"
    assert model.restored("the quiet town") == "the quiet town"


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], LABELS))
    assert 0 <= toxicity.score_documents(docs, model).first()["score"] <= 1


def test_held_out_accuracy(spark):
    """On labelled documents that training never saw; labels outside of English are noisy at this size."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id")
    rows = scored.select("toxic", "predicted").collect()
    hit = sum(r["toxic"] == 1 and r["predicted"] == 1 for r in rows)
    false = sum(r["toxic"] == 0 and r["predicted"] == 1 for r in rows)
    assert hit >= 0.6 * sum(r["toxic"] == 1 for r in rows) and false <= 0.005 * len(rows)


def test_copies_are_no_evidence(spark):
    """A rare word of one toxic document that was copied many times isn't learnt."""
    rows = corpus() + [(1000 + i, "one harmless wording about zebras that nobody else would ever use " + "again " * 20 + str(i % 2), 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1, y, 0.0) for i, _, y in rows], LABELS))
    assert "idiot" in model.weights and model.weights.get("zebras", 0) < 1


def every_path(chars, token, spaced=False):
    """Value and words of the likeliest of all lattice paths, each scored by its last four characters."""
    from itertools import product

    best = (float("-inf"), None)
    for path in product(*toxicity.lattice(token, spaced)):
        text, value = "".join(t for t, _ in path), sum(c for _, c in path)
        padded = "____" + text + "_"
        value += sum(chars.log(padded[i - 4 : i], padded[i]) for i in range(4, len(padded)))
        if value > best[0]:
            best = (value, [w for w in text.split("_") if w])
    return best


def value_of(chars, token, spaced=False):
    slots = toxicity.lattice(token, spaced)
    return toxicity._best_path(chars, slots, toxicity._best_path(chars, slots, beam=8)[0])[0]


@pytest.mark.parametrize("token", ["1d10t", "m0r0n!!", "**r*n", "**r*age", "cl*wn", "m***n", "**t", "***", "l-0-5-e_r", "idiooooot", "é*b", "!*$", "a" * 9 + "*", "x.y-z", "|d|*t", "l0s**"])
def test_viterbi_is_exact(model, token):
    value, text = every_path(model.chars, token)
    assert value_of(model.chars, token) == pytest.approx(value, abs=1e-9)
    assert toxicity.restore(model.chars, token) == text


def test_viterbi_is_exact_on_a_richer_word_list(model):
    import random

    rng = random.Random(3)
    syllables = ["mo", "ron", "gar", "bage", "wo", "tra", "id", "iot", "ge", "lo", "ser", "cl", "own"]
    words = {"".join(rng.choices(syllables, k=rng.randint(2, 3))): rng.randint(1, 9) for _ in range(150)}
    chars = toxicity.CharModel(model.chars.tri, words)
    for word in sorted(words)[:40]:
        masked = list(word)
        for i in rng.sample(range(len(word)), min(2, len(word))):
            masked[i] = "*"
        masked[rng.randrange(len(word))] = rng.choice("1043!")
        token = "".join(masked)
        value, text = every_path(chars, token)
        assert value_of(chars, token) == pytest.approx(value, abs=1e-9) and toxicity.restore(chars, token) == text, token
    for run in ("id1ot", "l0se", "mor*n"):
        value, text = every_path(chars, run, True)
        assert value_of(chars, run, True) == pytest.approx(value, abs=1e-9) and toxicity.restore(chars, run, True) == text


def test_long_runs_of_masks(model):
    """What is left out of a run doesn't change the result; very long tokens end."""
    most = int(4 * model.chars.floor / (toxicity.MASK_COST - toxicity.DROP_COST)) + 1
    assert toxicity.restore(model.chars, "id" + "*" * (most + 3) + "t") == toxicity.restore(model.chars, "id" + "*" * (most + 50) + "t")
    for token in ("a" + "*" * 30_000 + "b", "*a" * 2_000, "1" * 20_000 + "a", "1a" * 5_000):
        toxicity.restore(model.chars, token)


def test_clashing_columns_and_repeated_rows(spark, model):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7, "x", 1.0) for i, t, _ in rows] * 2, "doc_id long, text string, toxic int, quality string, bad double")
    labels = spark.createDataFrame([(i, 1, y, 0.5) for i, _, y in rows] + [(i, 0, 0, 0.5) for i, _, y in rows[:50]], LABELS)
    again = toxicity.fit(docs, labels)
    assert set(again.weights) == set(model.weights)
    assert toxicity.drop_toxic(docs.limit(0), again).count() == 0
    assert toxicity.fit(docs.limit(0), labels).score(b"idiot") <= 1


def test_few_texts_are_held_at_once(spark, model):
    """Scored row by row: whole texts pile up in no Arrow batch beside the rows that await their score."""
    docs = spark.createDataFrame([(0, "the river runs", "x"), (1, "you 1d10t", "y"), (2, None, "z")], "doc_id long, text string, lang string")
    kept = toxicity.drop_toxic(docs, model)
    assert kept.collect() == docs.where("doc_id <> 1").collect()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan


def test_tables_of_earlier_models_go(model):
    """A worker keeps the tables of one model, registered once however many tasks it runs."""
    first, second = pickle.loads(pickle.dumps(model)), without_beginnings(model)
    minhash_dedup.enter()
    minhash_dedup.shingles(b"a b c", 2)
    for _ in range(3):
        first.enter().score(b"you 1d10t")
    assert not minhash_dedup._word_hashes and first.cache and first.chars.known
    assert sum(map(len, worker_cache._kept.values())) == 2
    second.enter()
    assert not first.cache and not first.chars.known
