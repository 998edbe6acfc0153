"""Toxicity by noisy-channel deobfuscation: restore obfuscated words, then score the restored text.

Source model: characters. A mixture of a trigram model counted over the whole training side of the
corpus and a 5-gram model of the words that the training labels mark. Channel: leetspeak, masked
characters, separators within a word, spaced-out letters, repeated letters. A suspicious token (or run
of single characters) becomes a lattice of what each character may stand for, and an exact Viterbi search
finds the likeliest restored text. Plain words have a lattice with one path and pass unchanged.

Score: logistic regression on the presence of words and word beginnings. Features are chosen by a
log-likelihood ratio test against the labels, from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker_cache

#: What a character may stand for. An asterisk masks any letter.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
MASK, SEPARATORS, LETTERS = "*", "-._~^'`’", "abcdefghijklmnopqrstuvwxyz"
#: Natural-log costs of the channel.
LEET_COST, MASK_COST, DROP_COST, FOLD_COST, GAP_COST = -0.5, -2.0, -0.7, -0.3, -0.7
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What stands around a token without being part of its word. Characters that may stand for a letter stay.
OUTER = "".join(c for c in PUNCTUATION.decode() if c not in "@$!|+*") + "“”„‘’‚«»‹›…–—"
EDGE = "@$!|+"
INNER_LEET = re.compile(r"[a-z][0-9@$!|+*(€£._~^-]+[a-z]|^[0-9@$!|+*(€£]+[a-z]|[a-z][0-9@$!|+*€£]+$")
REPEATED = re.compile(r"([a-z])\1\1|(?:([a-z])\2.?){3}")
SPACED = re.compile(rb"(?:(?<=\s)|^)(?:[a-z0-9@$!|+*](?:[ \t]+|$|(?=\n))){3,}")
#: What plain words have as well: an apostrophe between letters, one doubled letter.
BROKEN = re.compile(r"[a-z]['`’][a-z]|([a-z])\1")
UNBROKEN, DOUBLES = str.maketrans("", "", "'`’"), re.compile(r"(.)\1+")
PREFIXES = (4, 5, 6)
#: A feature with this share of toxic documents, in the sample, marks a document alone.
SURE = 0.94


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def words(text: bytes) -> set[bytes]:
    """The distinct blank-separated tokens, A-Z lower-cased."""
    return set(text.lower().split())


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a trailing star)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if len(word) >= 3 else []


class CharModel:
    """Mixture of the corpus's character trigrams and a 5-gram model of a word list."""

    def __init__(self, trigrams: dict[str, int], lexicon: dict[str, float]):
        self.tri, self.bi = dict(trigrams), Counter()
        for gram, n in trigrams.items():
            self.bi[gram[:2]] += n
        self.lex, self.lex_context = Counter(), Counter()
        for word, weight in lexicon.items():
            text = "____" + word + "_"
            for i in range(4, len(text)):
                for n in range(2, 5):
                    self.lex[text[i - n : i + 1]] += weight
                    self.lex_context[text[i - n : i]] += weight
        self.known: dict[tuple[str, str], tuple[float, str]] = {}
        #: No character is less likely than this in any context.
        self.floor = math.log(0.5 * 0.05 / (max(self.bi.values(), default=0) + 2.0))

    def log(self, context: str, char: str) -> float:
        """log P(char | the four characters before it), or the suffix of them that `suffix` gives."""
        base = (self.tri.get(context[-2:] + char, 0) + 0.05) / (self.bi.get(context[-2:], 0) + 0.05 * 40)
        lex = 0.0
        for n in (4, 3, 2):
            if len(context) >= n and self.lex_context.get(context[-n:]):
                lex = self.lex.get(context[-n:] + char, 0) / self.lex_context[context[-n:]] * (0.5 if n == 2 else 1.0)
                if lex:
                    break
        return math.log(0.5 * base + 0.5 * lex)

    def suffix(self, context: str) -> str:
        """All of a context that any later probability depends on: its longest suffix, of four or three
        characters, that occurs in the word list, else its last two. What precedes the last character of
        a context of the word list is one of its contexts as well, so suffixes follow from suffixes."""
        return next((context[-n:] for n in (4, 3) if context[-n:] in self.lex_context), context[-2:])

    def step(self, state: str, char: str) -> tuple[float, str]:
        """log P(char | state) and the state after it."""
        key = (state, char)
        value = self.known.get(key)
        if value is None:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = value = (self.log(state, char), self.suffix(state + char))
        return value


def lattice(token: str, spaced: bool = False, masks: int | None = None) -> list[list[tuple[str, float]]]:
    """What each place of a token may stand for: (text, log cost). spaced: a word may end at each place.

    masks: the most letters that a run of masks can stand for in a likeliest reading; the places of a run
    are alike, so those beyond it are left out together.
    """
    slots, i = [], 0
    # at either end these may as well be what they look like
    first, last = (0, len(token)) if spaced else (len(token) - len(token.lstrip(EDGE)), len(token.rstrip(EDGE)))
    while i < len(token):
        c, j = token[i], i + 1
        while j < len(token) and token[j] == c:
            j += 1
        if c in LEET:
            one = [(x, LEET_COST) for x in LEET[c]]
        elif c == MASK:
            one = [(x, MASK_COST) for x in LETTERS] + [("", DROP_COST)]
        elif c in SEPARATORS:
            one = [("", DROP_COST), ("_", GAP_COST)]
        else:
            one = [(c, 0.0)]
        if j - i > 1 and (c in LETTERS or c in LEET):
            one = one + [(x + x, cost) for x, cost in one if x] if j - i > 1 else one
            one = [(x, cost + (FOLD_COST if len(x) < j - i else 0.0)) for x, cost in one]
            slots.append(one + [("", DROP_COST)] if c in EDGE and (j <= first or i >= last) else one)
        elif c in EDGE and (j <= first or i >= last):
            slots.append([*one, ("", DROP_COST)])
        elif c in SEPARATORS:
            slots.append(one)
        elif c == MASK:
            slots += [one] * (j - i if masks is None else min(j - i, masks))
            if masks is not None and j - i > masks:
                slots.append([("", DROP_COST * (j - i - masks))])
        else:
            slots += [one] * (j - i)
        if spaced:
            slots.append([("", 0.0), ("_", GAP_COST)])
        i = j
    return slots


def _best_path(model: CharModel, slots: list, least: float = -math.inf, beam: int | None = None) -> tuple[float, tuple | None]:
    """Value and linked characters of the likeliest path. A state is what model.suffix keeps of a context.

    least: the value of a known path; states that cannot reach it even if all that follows were certain are
    left out. beam: looks at so many states only, to find a known path.
    """
    rest = [0.0]
    for slot in reversed(slots):
        rest.append(rest[-1] + max(cost for _, cost in slot))
    step, states = model.step, {model.suffix("____"): (0.0, None)}
    for slot, ahead in zip(slots, reversed(rest[:-1]), strict=True):
        after: dict[str, tuple] = {}
        bar = least - ahead - 1e-9
        for state, (value, back) in states.items():
            for text, cost in slot:
                v, s, b = value + cost, state, back
                for char in text:
                    p, s = step(s, char)
                    v, b = v + p, (b, char)
                if v >= bar and (s not in after or v > after[s][0]):
                    after[s] = (v, b)
        states = dict(sorted(after.items(), key=lambda x: -x[1][0])[:beam]) if beam else after
    return max(((v + step(s, "_")[0], b) for s, (v, b) in states.items()), key=lambda x: x[0], default=(-math.inf, None))


def restore(model: CharModel, token: str, spaced: bool = False) -> list[str]:
    """The words of the likeliest path through the lattice: exact Viterbi, linear in the token's length.

    A mask read as a letter costs MASK_COST - DROP_COST more than one that is dropped, and changes the
    context of at most four later characters, each worth at most -floor: longer readings of a run never pay.
    A token with masks has many states, so a first path is found to leave hopeless ones out by: that without
    the masks and, where masks stand before other characters, that of a narrow search.
    """
    slots, least = lattice(token, spaced, int(4 * model.floor / (MASK_COST - DROP_COST)) + 1), -math.inf
    if MASK in token:
        least = _best_path(model, [slot if len(slot) <= len(LETTERS) else slot[-1:] for slot in slots])[0]
    if MASK in token.rstrip(MASK):
        least = max(least, _best_path(model, slots, least, beam=8)[0])
    back, out = _best_path(model, slots, least)[1], []
    while back is not None:
        back, char = back
        out.append(char)
    return [w for w in "".join(reversed(out)).split("_") if w]


def shape(word: str) -> str:
    """A word without apostrophes and with every run of a character as one: all that folding and joining can tell apart is gone."""
    return DOUBLES.sub(r"\1", word.translate(UNBROKEN))


class Marks:
    """Which plain-looking tokens may hide a marked word behind an apostrophe or a doubled letter.

    Every such token has a lattice of several paths, and nearly all are plain words (don't, letter). Only those whose
    shape is that of a marked word, or begins as the longest marked beginnings do, are restored, and of these no word
    that clean documents use (he'll).
    """

    def __init__(self, features, known=()):
        self.words = {shape(f) for f in features if not f.endswith("*")}
        self.beginnings = {shape(f[:-1]) for f in features if len(f) > PREFIXES[-1] and f.endswith("*")}
        self.lengths, self.known = sorted({len(b) for b in self.beginnings}), frozenset(known)

    def show(self, plain: str) -> bool:
        if not BROKEN.search(plain) or plain in self.known:
            return False
        form = shape(plain)
        return form in self.words or any(form[:n] in self.beginnings for n in self.lengths)

    def spaced(self, letters: str) -> bool:
        """Runs of three single characters are mostly lists: read only where they can spell a marked word, with one mask at most."""
        if len(letters) > 3:
            return True
        return letters.count(MASK) < 2 and any(shape("".join(p)) in self.words for p in product(*(LETTERS if c == MASK else LEET.get(c, "") + c for c in letters)))


def readings(token: str, marks: Marks | None = None) -> list[str]:
    """The forms of a suspicious token that are restored: without all its outer punctuation, and with the
    outer characters that may stand for a letter. A bracket at either end is a bracket. Plain tokens have none."""
    plain, trimmed = token.strip(PUNCTUATION.decode()), token.strip(OUTER)
    inner = INNER_LEET.search(plain) or REPEATED.search(plain) or (marks and marks.show(plain))
    if not (inner or INNER_LEET.search(token) or INNER_LEET.search(trimmed)):
        return []
    return sorted({plain, trimmed}) if inner else [trimmed]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    chars: CharModel
    marks: Marks = field(default_factory=lambda: Marks(()))
    most: int = 300_000
    cache: dict = field(default_factory=dict)
    #: Names this model's tables in a worker; it travels with the model.
    name: str = field(default_factory=lambda: f"toxicity-{uuid.uuid4().hex}")

    def features(self, token: bytes) -> tuple[str, ...]:
        """The model's features that a token shows, as written or restored."""
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) > self.most:
                self.cache.clear()
            plain = token.strip(PUNCTUATION).decode("utf-8", "replace")
            names = word_features(plain)
            for candidate in readings(token.decode("utf-8", "replace"), self.marks):
                for word in restore(self.chars, candidate):
                    names += word_features(word)
            self.cache[token] = found = tuple({n for n in names if n in self.weights})
        return found

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def enter(self) -> ToxicityModel:
        """Called in a task: the tables of other operators and of other models go."""
        worker_cache.enter(self.name)
        worker_cache.hold(self.name, self.cache.clear)
        worker_cache.hold(self.name, self.chars.known.clear)
        return self

    def joined(self, run: bytes) -> list[str]:
        """The words of a run of single characters; none of a run that is left as it is."""
        letters = run.decode().replace(" ", "").replace("\t", "")
        return restore(self.chars, letters, True) if self.marks.spaced(letters) else []

    def restored(self, text: str) -> str:
        """The text with suspicious tokens replaced by what they are read as."""
        low = text.encode().lower()
        joined = SPACED.sub(lambda m: (" " + " ".join(words) + " ").encode() if (words := self.joined(m[0])) else m[0], low)
        out = []
        for token in joined.decode("utf-8", "replace").split():
            plain = token.strip(PUNCTUATION.decode())
            read = {form: restore(self.chars, form) for form in readings(token, self.marks)}
            marked = [r for r in read.values() if any(n in self.weights for word in r for n in word_features(word))]
            out += marked[0] if marked else read.get(plain, [token])
        return " ".join(out)

    def score(self, text: bytes) -> float:
        low, found = text.lower(), set()
        for token in set(low.split()):
            if names := self.features(token):
                found.update(names)
        for run in SPACED.findall(low):
            for word in self.joined(run):
                found.update(n for n in word_features(word) if n in self.weights)
        z = self.bias + sum(self.weights[n] for n in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _texts(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))


def _slices(batches, rows: int = 500):
    """Arrow batches in parts, so that a task makes Python objects of a few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def corpus_trigrams(docs: DataFrame) -> dict[str, int]:
    """Counts of character trigrams over a-z, word boundary (_) and other letters (?), over all rows given.

    At most 28^3 counts, whatever the input.
    """
    symbols = "_" + LETTERS + "?"
    table = np.zeros(256, np.int64)
    table[128:] = 27
    for i, c in enumerate(LETTERS, 1):
        table[ord(c)] = table[ord(c.upper())] = i

    def count(batches):
        total = np.zeros(28**3, np.int64)
        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                c = table[np.frombuffer(b" " + text + b" ", np.uint8)]
                total += np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3) if len(text) > 2000 else 0
                if len(text) <= 2000:
                    np.add.at(total, (c[:-2] * 28 + c[1:-1]) * 28 + c[2:], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    rows = _texts(docs, []).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {symbols[g // 784] + symbols[g // 28 % 28] + symbols[g % 28]: n for g, n in rows}


def _without_copies(sample: DataFrame, hashes: int = 64, bands: int = 16, bar: float = 0.5) -> DataFrame:
    """doc_id and toxic of the sampled rows, one of each group of near copies.

    Copies would make any rare word of a copied document look like evidence. A row goes if at least `bar` of
    its minhashes over three-word shingles equal those of a row of the same label that stays; rows are
    taken by doc_id, and only those that share a band are compared. The sample is bounded, so its
    hashes are compared on the driver.
    """
    from . import minhash_dedup

    def run(batches):
        minhash_dedup.enter()
        for batch in _slices(batches):
            found = []
            for text in batch.column(2).to_pylist():
                s = minhash_dedup.shingles(text, 3)
                found.append(minhash_dedup.minhashes(s)[:hashes].astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "toxic", "low"])

    rows = sorted(((r["doc_id"], r["toxic"], r["low"]) for r in sample.mapInArrow(run, "doc_id long, toxic int, low binary").collect()), key=lambda r: (r[0], r[1], r[2] or b""))
    low = np.stack([np.frombuffer(r[2], "<u4") if r[2] else np.zeros(hashes, "<u4") for r in rows]) if rows else None
    met: dict[tuple, list[int]] = {}
    kept: list[int] = []
    for i, (_, toxic, mine) in enumerate(rows):
        if mine is None:
            kept.append(i)
            continue
        keys = [(toxic, k, mine[4 * k * (hashes // bands) : 4 * (k + 1) * (hashes // bands)]) for k in range(bands)]
        near = sorted({j for key in keys for j in met.get(key, ())})
        if near and ((low[near] == low[i]).mean(axis=1) >= bar).any():
            continue
        kept.append(i)
        for key in keys:
            met.setdefault(key, []).append(i)
    return sample.sparkSession.createDataFrame([rows[i][:2] for i in kept], "doc_id long, toxic int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 30_000, most_features: int = 4_000, held_out=is_held_out) -> ToxicityModel:
    """Fit on the rows that are not held out.

    Labels: at most about `sample` labelled documents (a documented bound; a pseudo-random choice by
    doc_id where there are more), whose ids alone are broadcast. Character counts: all rows not held
    out. Several labels for a document: the largest holds; null labels are left out. Rows that repeat a
    doc_id share its label; copies count once. Other columns of either table aren't read.
    """
    docs = docs.select("doc_id", "text")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)
    training = docs.where(~held_out(F.col("doc_id")))
    known = _without_copies(_texts(training.join(F.broadcast(known), "doc_id"), ["doc_id", "toxic"]))
    trained = _texts(training.join(F.broadcast(known), "doc_id"), ["toxic"])

    def count(batches):
        seen: dict[str, list[int]] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["feature", "bad", "good"])

        docs_seen = [0, 0]
        for batch in _slices(batches):
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = set()
                for token in words(text):
                    found.update(word_features(token.strip(PUNCTUATION).decode("utf-8", "replace")))
                for name in found:
                    seen.setdefault(name, [0, 0])[0 if toxic else 1] += 1
                docs_seen[0 if toxic else 1] += 1
                if len(seen) > 150_000:
                    yield rows()
                    seen.clear()
        seen[""] = docs_seen
        yield rows()

    counts = trained.mapInArrow(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = counts.where("feature = '' OR bad >= 2")
    from . import workspace

    counts = workspace.staged(counts, "toxic-features")
    totals = counts.where("feature = ''").first()
    bad, good = (totals["bad"], totals["good"]) if totals else (0, 0)
    tried = counts.count()
    if not bad or not good:
        return ToxicityModel({}, math.log((bad + 0.5) / (good + 0.5)), CharModel(corpus_trigrams(docs.where(~held_out(F.col("doc_id")))), {}))
    share = F.lit((bad / (bad + good)))
    both = F.col("bad") + F.col("good")
    g2 = 2 * (F.col("bad") * F.log(F.col("bad") / (both * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - share)))).otherwise(0.0))
    lift = (F.col("bad") / bad) / ((F.col("good") + 0.5) / good)
    chosen = counts.where("feature <> ''").select("feature", "bad", "good", g2.alias("g2")).where(lift >= 5).orderBy(F.desc("g2"), "feature").limit(most_features).collect()
    names = [r["feature"] for r in chosen if r["g2"] >= 2 * math.log(max(tried, 2)) + 2] or [r["feature"] for r in chosen[:10]]
    index = {name: i for i, name in enumerate(names)}
    marks = Marks(names)

    def hits(batches):
        for batch in _slices(batches):
            toxic, found, like = [], [], []
            for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plain = {token.strip(PUNCTUATION).decode("utf-8", "replace") for token in words(text)}
                toxic.append(y)
                found.append(sorted({index[f] for word in plain for f in word_features(word) if f in index}))
                like.append(sorted(word for word in plain if marks.show(word)))
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(like, pa.list_(pa.string()))], names=["toxic", "found", "like"])

    # equal rows are counted, so that clean documents without a feature come as one
    rows = trained.mapInArrow(hits, "toxic int, found array<int>, like array<string>").groupBy("toxic", "found", "like").count().collect()
    use = Counter()
    for r in rows:
        for word in r["like"]:
            use[word] += -r["count"] if r["toxic"] > 0 else r["count"]
    y, n = np.array([r["toxic"] > 0 for r in rows], float), np.array([r["count"] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r["found"]) for r in rows])
    col = np.array([i for r in rows for i in r["found"]], np.int64)
    w, b = _logistic(y, n, at, col, len(names))
    # joint weights are shared among features that occur together; one sure feature must be enough by itself
    for name, sure in _precision({r["feature"]: (r["bad"], r["good"]) for r in chosen}).items():
        if name in index and sure >= SURE:
            w[index[name]] = max(w[index[name]], math.log(sure / (1 - sure)) - b)
    lexicon = {r["feature"]: float(r["bad"]) for r in chosen if r["feature"] in index and not r["feature"].endswith("*") and w[index[r["feature"]]] > 0}
    chars = CharModel(corpus_trigrams(docs.where(~held_out(F.col("doc_id")))), lexicon)
    # a word that more clean documents of the sample use than toxic ones is itself
    marks = Marks([name for name, i in index.items() if w[i] > 0], [word for word, n in use.items() if n > 0])
    return ToxicityModel({name: float(w[i]) for name, i in index.items()}, float(b), chars, marks)


def _precision(counts: dict[str, tuple[int, int]], weight: float = 20.0) -> dict[str, float]:
    """Share of toxic documents among those that show a feature; longer beginnings and words are drawn
    towards their own beginning, of which more is known."""
    out: dict[str, float] = {}
    for name in sorted(counts, key=lambda x: (len(x.rstrip("*")), not x.endswith("*"))):
        bad, good = counts[name]
        above = next((out[name[:n] + "*"] for n in reversed(PREFIXES) if name[:n] + "*" in out and name != name[:n] + "*"), None)
        out[name] = (bad + 0.5) / (bad + good + 1) if above is None else (bad + weight * above) / (bad + good + weight)
    return out


def _logistic(y, n, at, col, width: int, rounds: int = 600, shrink: float = 0.5) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on sparse 0/1 features, weights kept >= 0, by Adam steps; deterministic."""
    w, b = np.zeros(width), math.log((n @ y + 0.5) / (n @ (1 - y) + 0.5))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(at, w[col], minlength=len(y))
        error = n * (1 / (1 + np.exp(-z)) - y)
        g = np.append(np.bincount(col, error[at], minlength=width) + shrink * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return w, b


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, held_out=is_held_out) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Only the text is scored; null counts as empty, and an
    empty text has the score of a document without any feature. Repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value.enter()
        for batch in _slices(batches):
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = _texts(docs, ["doc_id"]).mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """docs without those of a score >= threshold; columns unchanged. A map without shuffle.

    The function takes texts row by row: an Arrow batch would hold up to 10,000 whole texts outside the heap, as
    Python strings and, with all other columns, in the queue of rows that await their score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.udf("double", useArrow=False)
    def score(text):
        return shared.value.enter().score((text or "").encode())

    return docs.where(score(F.col("text")) < threshold)
