"""A gated recurrent language model in numpy with a class-factored output.

Every word belongs to one of at most 128 classes: the end of a text, rare words, 32 classes of frequent
words, and classes of the other words by their first two bytes. P(word | before) = P(class | state) *
P(word | class, state). The state gives a softmax over classes and, within a class of frequent words, a
softmax over its words; frequent words have input vectors of their own. The words of the other classes have
their share of counts within the class. Rare words are those met at most once; unseen words are among them,
with the share that counts of once and twice seen words foretell (Good-Turing), so probabilities of known
words and of the one unseen symbol sum to 1.

Counting: word counts come from all training documents by a shuffle of distinct words per chunk.
Training: every training document once, in four rounds of growing size. A round deals its documents into
shards of a fixed number of tokens by a hash of id and text; each shard is trained from the round's weights
by truncated backpropagation in windows of 16 tokens, documents following one another in lanes, the state
carried from a document's first token to its last; the shards' weights are averaged by tokens. What a
shard holds and its order depend on the documents alone, not on partitions or tasks.
Scoring: the state is carried across all windows of a document, whole, whatever its length.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_chunks, workspace

CLASSES, HIDDEN, WINDOW = 128, 16, 16
#: Classes: END, RARE, then those of frequent words, MEMBERS words each, then those by first bytes; the last holds what is left.
END, RARE, FIRST_FREQUENT, FREQUENT, MEMBERS = 0, 1, 2, 32, 32
WORDS, FIRST_BEGINNING = FREQUENT * MEMBERS, FIRST_FREQUENT + FREQUENT
#: Symbols: the classes, the frequent words by rank, and what stands before a text.
BEFORE = CLASSES + WORDS
CLASS_OF = np.concatenate([np.arange(CLASSES), FIRST_FREQUENT + np.arange(WORDS) // MEMBERS])
SHARD_TOKENS, LANES = 1 << 21, 256
#: Rounds: which sixteenths of the documents, and the rate.
ROUNDS = [(range(1), 0.01), (range(1, 4), 0.006), (range(4, 8), 0.004), (range(8, 16), 0.003)]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words() each text has, and all of them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    found, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])
    real = pc.greater(pc.binary_length(found), 0)  # blanks at the ends of a text give empty ones
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return np.diff(before[ends]), found.filter(real).view(pa.binary())


@dataclass
class Vocabulary:
    """What training and scoring need of the corpus's counts: at most CLASSES + WORDS rows."""

    tokens: int  # with ends
    distinct: int  # with the end
    ends: int
    once: int
    unseen_share: float
    frequent: dict[bytes, int]
    beginnings: dict[bytes, int]
    mass: np.ndarray  # training positions of each symbol

    def symbol_of(self, word: bytes, count: int) -> int:
        if count <= 1:
            return RARE
        return self.frequent.get(word) or self.beginnings.get(word[:2]) or CLASSES - 1

    def share(self, kind: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words that the net doesn't tell apart; 0 for frequent words."""
        own = np.log10(np.maximum(count, 1)) - np.log10(np.maximum(self.mass[kind], 1))
        if self.once:
            rare = np.where(count > 0, math.log10(max(1 - self.unseen_share, 1e-12) / self.once), math.log10(self.unseen_share))
        else:
            rare = np.zeros(len(kind))
        return np.where(kind == RARE, rare, np.where((kind == END) | (kind >= CLASSES), 0.0, own))


def word_table(chunks: DataFrame) -> DataFrame:
    """One row for each part: part, words, counts (of the words met in training documents), and their sums."""

    def run(batches):
        held, now = [], None

        def out():
            met = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).filter(pc.field("n_sum") > 0).sort_by("word")
            seen, counts = pa.concat_arrays([pa.array([], pa.binary()), *met["word"].chunks]), met["n_sum"].to_numpy()
            often = pa.table({"word": pc.binary_slice(seen, 0, 2), "n": counts}).filter(pa.array(counts > 1))
            first = often.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            top = np.lexsort([np.arange(len(seen)), -counts])[:WORDS]
            return pa.RecordBatch.from_pylist(
                [{"part": now, "words": word_chunks.join_array(seen), "counts": word_chunks.squeeze(counts.astype("<i8").tobytes()), "tokens": int(counts.sum()), "distinct": len(seen), "once": int((counts == 1).sum()), "twice": int((counts == 2).sum()), "top": [{"word": seen[i].as_py(), "n": int(counts[i])} for i in top.tolist()], "first": first.to_pylist()}],
                schema,
            )

        for batch in batches:
            for part, data, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and now is not None:
                    yield out()
                    held.clear()
                now = part
                held.append(pa.table({"word": word_chunks.split_array(data), "n": np.frombuffer(word_chunks.stretch(counts), "<u4").astype(np.int64)}))
                if len(held) == 64:  # bounded by the part's distinct words
                    held[:] = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])]
        if now is not None:
            yield out()

    pair = pa.struct([("word", pa.binary()), ("n", pa.int64())])
    schema = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), *((k, pa.int64()) for k in ("tokens", "distinct", "once", "twice")), ("top", pa.list_(pair)), ("first", pa.list_(pair))])
    text = "part int, words binary, counts binary, tokens long, distinct long, once long, twice long, top array<struct<word binary, n long>>, first array<struct<word binary, n long>>"
    rows = word_chunks.met(chunks, "words", "counts").sortWithinPartitions("part").select("part", "words", "counts")
    return workspace.staged(rows.mapInArrow(run, text), "lm-words")


def vocabulary(table: DataFrame, training_docs: int) -> Vocabulary:
    sums = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "once", "twice"))).first()
    top = table.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "word").limit(WORDS).collect()
    frequent = {bytes(r["word"]): CLASSES + i for i, r in enumerate(r for r in top if r["n"] > 1)}
    left = table.select(F.explode("first").alias("t")).select("t.*").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(CLASSES - FIRST_BEGINNING - 1)
    beginnings = {bytes(r["word"]): FIRST_BEGINNING + i for i, r in enumerate(left.collect())}
    share = sums["once"] / (sums["once"] + 2 * sums["twice"]) if sums["once"] else 1.0
    mass = np.zeros(BEFORE)
    return Vocabulary(sums["tokens"] + training_docs, sums["distinct"] + (training_docs > 0), training_docs, sums["once"], min(max(share, 0.05), 0.95), frequent, beginnings, mass)


def _classed(chunks: DataFrame, table: DataFrame, vocab: Vocabulary) -> DataFrame:
    """chunk and answers: for each part the symbols (2 bytes each) and counts (8 bytes each) of its words."""
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = word_chunks.word_parts(chunks).select("part", F.lit(1).alias("kind"), "chunk", "words", F.lit(None).cast("binary").alias("counts"))
    known = table.select("part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("chunk"), "words", "counts")
    rows = entries.unionByName(known).repartition(n, "part").sortWithinPartitions("part", "kind")

    def run(batches):
        held, kinds, counts, now = pa.array([], pa.binary()), np.array([RARE], "<u2"), np.zeros(1, "<i8"), None
        for batch in batches:
            out = []
            for part, kind, chunk, data, met in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = word_chunks.split_array(data)
                if part != now:
                    held, kinds, counts, now = found[:0], np.array([RARE], "<u2"), np.zeros(1, "<i8"), part
                if kind == 0:
                    held, counts = found, np.append(np.frombuffer(word_chunks.stretch(met), "<i8"), 0)
                    kinds = np.fromiter(map(vocab.symbol_of, chain(found.to_pylist(), [b""]), counts.tolist()), "<u2", len(counts))
                    continue
                at = pc.fill_null(pc.index_in(found, held), len(held)).to_numpy()  # the last place is that of words not met in training
                out.append((chunk, part, word_chunks.squeeze(kinds[at].tobytes() + counts[at].tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "part", "data"])

    return word_chunks.gathered(rows.mapInArrow(run, "chunk long, part int, data binary"))


def _symbol_mass(table: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Training positions of each symbol; at most CLASSES + WORDS sums."""

    def run(batches):
        mass = np.zeros(BEFORE, np.int64)
        for batch in batches:
            for data, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = np.frombuffer(word_chunks.stretch(counts), "<i8")
                kinds = np.fromiter(map(vocab.symbol_of, word_chunks.split_words(data), c.tolist()), np.int64, len(c))
                np.add.at(mass, kinds, c)
        seen = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(mass[seen])], names=["kind", "n"])

    mass = np.zeros(BEFORE)
    for kind, n in table.select("words", "counts").mapInArrow(run, "kind long, n long").groupBy("kind").agg(F.sum("n")).collect():
        mass[kind] = n
    mass[END] = vocab.ends
    return mass


SEQUENCES = "doc_ids array<long>, training array<int>, sizes array<int>, known array<int>, base array<double>, shares array<double>, kinds binary"


def sequences(chunks: DataFrame, replies: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per chunk: symbols (2 bytes each) of all positions (ends included) and each document's sums that need no model."""
    arrow = pa.schema([("doc_ids", pa.list_(pa.int64())), ("training", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("known", pa.list_(pa.int32())), ("base", pa.list_(pa.float64())), ("shares", pa.list_(pa.float64())), ("kinds", pa.binary())])
    below = math.log10(vocab.tokens + vocab.distinct + 1)
    end_base = math.log10(vocab.ends + 1) - below

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, extra, sizes, codes, order, answers = (batch.column(k)[i].as_py() for k in range(6))
                codes, places = word_chunks.unpack_codes(codes), np.frombuffer(order, "<u4")
                kinds, counts = np.zeros(len(places), "<u2"), np.zeros(len(places), np.int64)
                at = 0
                for a in sorted(answers or [], key=lambda a: a["part"]):
                    data = word_chunks.stretch(a["data"])
                    n = len(data) // 10
                    kinds[places[at : at + n]] = np.frombuffer(data, "<u2", n)
                    counts[places[at : at + n]] = np.frombuffer(data, "<i8", n, 2 * n)
                    at += n
                share, base = vocab.share(kinds, counts), np.log10(counts + 1.0) - below
                ends = np.cumsum(sizes)
                sums = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[np.concatenate([[0], ends])])
                row = {"doc_ids": ids, "training": extra, "sizes": [s + 1 for s in sizes], "known": (sums((counts > 0)[codes]) + (vocab.ends > 0)).round().astype(int).tolist()}
                row |= {"base": (sums(base[codes]) + end_base).tolist(), "shares": sums(share[codes]).tolist(), "kinds": np.insert(kinds[codes], ends, END).tobytes()}
                yield pa.RecordBatch.from_pylist([row], arrow)

    joined = chunks.select("chunk", "doc_ids", "extra", "sizes", "codes", "order").join(replies, "chunk", "left")
    return workspace.staged(joined.select("doc_ids", "extra", "sizes", "codes", "order", "answers").mapInArrow(run, SEQUENCES), "lm-sequences")


class Gru:
    """Inputs: BEFORE + 1 symbols; state: HIDDEN; outputs: CLASSES, and MEMBERS words in each class of frequent words.

    All weights lie in one vector, `weights`, of which e, u, w, b, v and c are views. The recurrence works on
    [features, texts], so that each gate lies in one piece; the outputs on [texts, features].
    """

    SHAPES = {"e": (BEFORE + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "w": (HIDDEN, CLASSES), "b": (CLASSES,), "v": (FREQUENT, MEMBERS, HIDDEN), "c": (FREQUENT, MEMBERS)}
    ROWS = 256  # of class logits at once: 131 kB, which a core's cache holds beside the rest

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.weights = np.zeros(sum(math.prod(x) for x in self.SHAPES.values()), np.float32)
        self.__dict__ |= self.named(self.weights)
        self._kept: dict[str, np.ndarray] = {}
        for name in ("e", "u", "w", "v"):
            getattr(self, name)[...] = rng.normal(size=self.SHAPES[name]) * 0.2

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array without contents, in memory that is kept from one window to the next."""
        size = math.prod(shape)
        if name not in self._kept or self._kept[name].size < size:
            self._kept[name] = np.empty(size, np.float32)
        return self._kept[name][:size].reshape(shape)

    @classmethod
    def named(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of a vector of all weights, as views."""
        ends = np.cumsum([math.prod(x) for x in cls.SHAPES.values()]).tolist()
        return {name: flat[end - math.prod(shape) : end].reshape(shape) for end, (name, shape) in zip(ends, cls.SHAPES.items(), strict=True)}

    def start_from(self, mass: np.ndarray) -> Gru:
        """Biases from counts; places of words that don't exist get next to nothing."""
        total = np.bincount(CLASS_OF, mass, CLASSES)
        self.b[...] = np.log((total + 1) / (total + 1).sum())
        words = mass[CLASSES:].reshape(FREQUENT, MEMBERS)
        self.c[...] = np.where(words > 0, np.log(np.maximum(words, 1) / np.maximum(words.sum(axis=1, keepdims=True), 1)), np.where(words.sum(axis=1, keepdims=True) > 0, -40.0, 0.0))
        return self

    def flat(self) -> np.ndarray:
        return self.weights.copy()

    def load(self, flat: np.ndarray) -> Gru:
        self.weights[...] = flat
        return self

    def _input_weights(self) -> tuple[np.ndarray, np.ndarray]:
        """e, and u with features first, halved for the gates, which take tanh of half their argument."""
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * HIDDEN, HIDDEN])
        return self.e * half, np.ascontiguousarray((self.u * half).T)

    @staticmethod
    def _step(x: np.ndarray, a: np.ndarray, h: np.ndarray, gates: np.ndarray, n: np.ndarray, after: np.ndarray) -> None:
        """One step of [features, texts]: x from the symbols, a from the states h. Fills gates (r, z), n and after."""
        np.add(x[: 2 * HIDDEN], a[: 2 * HIDDEN], out=gates)
        np.tanh(gates, out=gates)
        gates += np.float32(1)
        gates *= np.float32(0.5)
        np.multiply(gates[:HIDDEN], a[2 * HIDDEN :], out=n)
        n += x[2 * HIDDEN :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=after)
        after *= gates[HIDDEN:]
        after += n

    def step(self, before: np.ndarray, h: np.ndarray):
        """One step of [texts, HIDDEN]: the states after it, and the gates."""
        e, u = self._input_weights()
        h = np.ascontiguousarray(h.T, np.float32)
        a, gates, n, after = u @ h, np.empty((2 * HIDDEN, h.shape[1]), np.float32), np.empty_like(h), np.empty_like(h)
        self._step(e.take(before, axis=0).T, a, h, gates, n, after)
        return after.T, gates[:HIDDEN].T, gates[HIDDEN:].T, n.T, a[2 * HIDDEN :].T

    @staticmethod
    def _unbounded(weights: np.ndarray) -> bool:
        """Whether logits may be too large for exp in single precision. States lie between -1 and 1, so weights
        (the bias in the last row) bound them; only beyond that bound is each row's largest taken off."""
        return np.abs(weights).sum(axis=-2).max() >= 80

    def _class_logits(self, h1: np.ndarray):
        """(where, logits) of all rows of h1, states with a column of ones, ROWS texts at a time."""
        weights = np.concatenate([self.w, self.b[None]])
        room, shift = self._room("classes", min(self.ROWS, len(h1)), CLASSES), self._unbounded(weights)
        for i in range(0, len(h1), self.ROWS):
            here = slice(i, min(i + self.ROWS, len(h1)))
            logits = np.matmul(h1[here], weights, out=room[: here.stop - i])
            if shift:
                logits -= logits.max(axis=1, keepdims=True)
            yield here, logits

    def _word_logits(self, h1: np.ndarray, symbols: np.ndarray):
        """Of the frequent words among the symbols, by class: places, members, the classes with their slices, states, logits of all members."""
        at = np.flatnonzero(symbols >= CLASSES)
        rank = symbols[at] - CLASSES
        order = np.argsort((rank // MEMBERS).astype(np.uint8), kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(rank // MEMBERS, minlength=FREQUENT))]).tolist()
        met = [(k, slice(cuts[k], cuts[k + 1])) for k in range(FREQUENT) if cuts[k] < cuts[k + 1]]
        weights = np.concatenate([self.v, self.c[..., None]], axis=2).transpose(0, 2, 1)
        states, logits = h1.take(at, axis=0, out=self._room("own", len(at), HIDDEN + 1), mode="clip"), self._room("words", len(at), MEMBERS)
        for k, here in met:
            np.matmul(states[here], weights[k], out=logits[here])
        if len(at) and self._unbounded(weights):
            logits -= logits.max(axis=1, keepdims=True)
        return at, rank % MEMBERS, met, states, logits

    def _log_targets(self, h1: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        out, classes, rows = np.empty(len(symbols), np.float32), CLASS_OF[symbols], np.arange(len(symbols))
        for here, logits in self._class_logits(h1):
            own = logits[rows[: len(logits)], classes[here]]
            out[here] = own - np.log(np.exp(logits, out=logits) @ np.ones(CLASSES, np.float32))
        at, member, _, _, logits = self._word_logits(h1, symbols)
        if len(at):
            own = logits[rows[: len(at)], member]
            out[at] += own - np.log(np.exp(logits, out=logits) @ np.ones(MEMBERS, np.float32))
        return out

    def log_targets(self, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """log P(class | state), and for frequent words + log P(word | class, state); h: [texts, HIDDEN]."""
        return self._log_targets(np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1), symbols)

    def window(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, h: np.ndarray):
        """Gradients, by name, over a window [time, lanes] and the state after it, [lanes, HIDDEN]."""
        grads = np.zeros_like(self.weights)
        return self.named(grads), self.add_gradient(inputs, targets, live, h, grads)

    def add_gradient(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, h: np.ndarray, grads: np.ndarray) -> np.ndarray:
        """Adds a window's gradients to grads, laid out as weights; the state after it. The state is zero wherever a text begins."""
        steps, lanes = inputs.shape
        g, full, begins = self.named(grads), bool(live.all()), inputs == BEFORE
        some = begins.any(axis=1).tolist()
        e, u = self._input_weights()
        h = np.ascontiguousarray(h.T, np.float32)
        before, gates, n, a = (self._room(name, steps, k * HIDDEN, lanes) for name, k in (("before", 1), ("gates", 2), ("n", 1), ("a", 3)))
        states, x, after = self._room("states", steps, lanes, HIDDEN + 1), self._room("x", 3 * HIDDEN, lanes), np.empty_like(h)
        states[:, :, HIDDEN] = 1
        for t in range(steps):
            before[t] = np.where(begins[t], np.float32(0), h) if some[t] else h
            np.matmul(u, before[t], out=a[t])
            x[...] = e.take(inputs[t], axis=0).T
            self._step(x, a[t], before[t], gates[t], n[t], after)
            h = after if full else np.where(live[t], after, before[t])
            states[t, :, :HIDDEN] = h.T
        back = self._output_gradient(states.reshape(-1, HIDDEN + 1), np.where(live, targets, END).ravel(), None if full else live.ravel(), g).reshape(steps, lanes, HIDDEN)
        # slopes of the new state in what each gate takes: (1 - z)(1 - nn), (before - n) z (1 - z), a r (1 - r)
        r, z, to_r = gates[:, :HIDDEN], gates[:, HIDDEN:], a[:, 2 * HIDDEN :]
        to_n, to_z = np.subtract(1, z, out=self._room("to_n", *z.shape)), np.subtract(before, n, out=self._room("to_z", *z.shape))
        to_z *= z
        to_z *= to_n
        np.multiply(n, n, out=n)
        to_n *= np.subtract(1, n, out=n)
        to_r *= r
        to_r *= np.subtract(1, r, out=n)
        slopes, slope = self._room("slopes", steps, lanes, 3 * HIDDEN), self._room("slope", 3 * HIDDEN, lanes)
        dr, dz, dn = (slope[k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
        carry, d = np.zeros_like(after), np.empty_like(after)
        for t in reversed(range(steps)):
            np.add(carry, back[t].T, out=d)
            np.multiply(d, to_n[t], out=dn)
            np.multiply(d, to_z[t], out=dz)
            np.multiply(dn, to_r[t], out=dr)
            if not full:
                slope *= live[t]
            slopes[t] = slope.T
            dn *= r[t]
            g["u"] += before[t] @ slope.T
            carry = self.u @ slope
            if full:
                d *= z[t]
                carry += d
            else:
                carry = np.where(live[t], d * z[t] + carry, d)
            if some[t]:
                carry[:, begins[t]] = 0
        symbols = inputs.ravel()
        order = np.argsort(symbols.astype(np.uint16), kind="stable")
        cuts = np.flatnonzero(np.diff(symbols[order], prepend=-1))
        slopes = slopes.reshape(-1, 3 * HIDDEN).take(order, axis=0, out=self._room("sorted", len(order), 3 * HIDDEN), mode="clip")
        g["e"][symbols[order[cuts]]] += np.add.reduceat(slopes, cuts, axis=0)
        return h.T.copy()

    def _output_gradient(self, h1: np.ndarray, symbols: np.ndarray, live: np.ndarray | None, g: dict[str, np.ndarray]) -> np.ndarray:
        """Adds to g of the outputs and returns the slopes of the states. h1: states with a column of ones."""
        back, rows, classes = self._room("back", len(symbols), HIDDEN), np.arange(len(symbols)), CLASS_OF[symbols]
        for here, p in self._class_logits(h1):
            # p stays unnormalised: each row's sum divides the narrow factor of each product
            total = np.exp(p, out=p) @ np.ones(CLASSES, np.float32)
            p[rows[: len(p)], classes[here]] -= total
            each = 1 / total if live is None else live[here] / total
            g["w"] += np.multiply(h1[here, :HIDDEN].T, each, order="C") @ p
            g["b"] += each @ p
            np.matmul(p, self.w.T, out=back[here])
            back[here] *= each[:, None]
        at, member, met, own, q = self._word_logits(h1, symbols)
        if len(at):
            total = np.exp(q, out=q) @ np.ones(MEMBERS, np.float32)
            q[rows[: len(at)], member] -= total
            each = (1 / total)[:, None]
            own *= each
            more = self._room("more", len(at), HIDDEN)
            for k, here in met:
                both = q[here].T @ own[here]
                g["v"][k] += both[:, :HIDDEN]
                g["c"][k] += both[:, HIDDEN]
                np.matmul(q[here], self.v[k], out=more[here])
            more *= each
            back[at] += more
        return back


def training_rows(data: DataFrame) -> DataFrame:
    """One row for each training document: sixteenth, key (hash of id and symbols), doc_id, tokens, symbols."""
    arrow = pa.schema([("sixteenth", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.int64()), ("symbols", pa.binary())])

    def run(batches):
        import xxhash

        for batch in batches:
            for ids, training, sizes, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, at = [], 0
                for doc, on, n in zip(ids, training, sizes, strict=True):
                    if on > 0:
                        mine = kinds[2 * at : 2 * (at + n)]
                        key = xxhash.xxh3_64_intdigest(str(doc).encode() + b"\0" + mine)
                        out.append({"sixteenth": key >> 60, "key": key - (1 << 63), "doc_id": doc, "tokens": n, "symbols": mine})
                    at += n
                yield pa.RecordBatch.from_pylist(out, arrow)

    made = data.select("doc_ids", "training", "sizes", "kinds").mapInArrow(run, "sixteenth int, key long, doc_id long, tokens long, symbols binary")
    return workspace.staged(made, "lm-training", by="sixteenth")


class Lanes:
    """Documents dealt to lanes, longest lane first, of which windows are cut one after another.

    Documents go whole, the longest first, each to the emptiest lane; within a lane their order is pseudo-random. A lane
    keeps its symbols in two bytes each, as targets and, one later, as inputs; only a window is ever laid out as a rectangle,
    so one very long document beside many short ones takes no more memory than its symbols.
    """

    def __init__(self, docs: list[np.ndarray], lanes: int, seed: int):
        filled = [(0, k) for k in range(lanes)]
        mine: list[list[int]] = [[] for _ in range(lanes)]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, k = filled[0]
            mine[k].append(i)
            heapq.heapreplace(filled, (n + len(docs[i]), k))
        rng = np.random.default_rng(seed)
        order = [rng.permutation(m) for m in mine]
        sizes = np.array([sum(len(docs[i]) for i in m) for m in mine])
        by_size = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[by_size]
        self.targets, self.inputs = [], []
        for k in by_size.tolist():
            parts = [np.asarray(docs[i], np.uint16) for i in order[k].tolist()]
            targets = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
            inputs = np.roll(targets, 1)
            inputs[np.cumsum([0, *(len(p) for p in parts)])[:-1]] = BEFORE
            self.targets.append(targets)
            self.inputs.append(inputs)

    def __len__(self) -> int:
        return int(self.sizes.max(initial=0))

    def window(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets and what of them is there, [time, lane], of the lanes that reach beyond start."""
        many = int((self.sizes > start).sum())
        made = []
        for rows in (self.inputs, self.targets):
            out = np.full((many, stop - start), END, np.int64)
            for k in range(many):
                part = rows[k][start:stop]
                out[k, : len(part)] = part
            made.append(np.ascontiguousarray(out.T))
        return (*made, np.arange(start, stop)[:, None] < self.sizes[:many])

    def windows(self, at_once: int = 16):
        """(stop, inputs, targets, live) of all windows in order, cut from rectangles of at_once windows."""
        for first in range(0, len(self), at_once * WINDOW):
            laid = self.window(first, min(first + at_once * WINDOW, len(self)))
            for t in range(first, first + len(laid[0]), WINDOW):
                stop, many = min(t + WINDOW, len(self)), int((self.sizes > t).sum())
                yield (stop, *(x[t - first : stop - first, :many] for x in laid))


def train_shard(net: Gru, docs: list[np.ndarray], rate: float) -> int:
    """One pass over the documents by Adam, a step for each window of all lanes, or for several where few
    lanes are left; returns the number of tokens."""
    total = sum(map(len, docs))
    lanes = min(LANES, max(8, total >> 13), max(len(docs), 1))
    dealt = Lanes(docs, lanes, total)
    steps = waiting = 0
    h = np.zeros((lanes, HIDDEN), np.float32)
    m, v, grads, change = (np.zeros_like(net.weights) for _ in range(4))
    for stop, inputs, targets, live in dealt.windows():
        h = net.add_gradient(inputs, targets, live, h[: inputs.shape[1]], grads)
        waiting += int(live.sum())
        if waiting * 4 < lanes * WINDOW and stop < len(dealt):
            continue
        steps += 1
        fix = math.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
        grads *= np.float32(1 / max(waiting, 1))
        m *= np.float32(0.9)
        m += np.multiply(grads, np.float32(0.1), out=change)
        v *= np.float32(0.999)
        grads *= grads
        grads *= np.float32(0.001)
        v += grads
        np.sqrt(v, out=grads)
        grads += np.float32(1e-8)
        np.multiply(m, np.float32(rate * fix), out=change)
        change /= grads
        net.weights -= change
        grads[...] = waiting = 0
    return total


def train_round(rows: DataFrame, start: np.ndarray, rate: float, shard_tokens: int = SHARD_TOKENS) -> np.ndarray:
    """Each shard of the rows is trained from the same weights; the mean of all, weighted by tokens.

    Shards hold about shard_tokens; a shard that rows of equal id and text make larger is trained in parts,
    one after another. A task adds up its shards' weights, and a second level adds up the tasks'.
    """
    spark = rows.sparkSession
    tokens = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if not tokens:
        return start
    shards = -(-tokens // shard_tokens)
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(start)

    def run(batches):
        total, done = np.zeros(len(start)), 0
        now, net, docs, held, mine = None, None, [], 0, 0

        def close():
            nonlocal total, done, mine
            mine += train_shard(net, docs, rate)
            total += net.flat().astype(np.float64) * mine
            done += mine

        for batch in batches:
            for shard, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if now is not None:
                        close()
                    now, net, docs, held, mine = shard, Gru().load(shared.value), [], 0, 0
                docs.append(np.frombuffer(symbols, "<u2"))
                held += len(docs[-1])
                if held >= 2 * shard_tokens:
                    mine += train_shard(net, docs, rate)
                    docs, held = [], 0
        if now is not None:
            close()
            yield pa.RecordBatch.from_pylist([{"task": TaskContext.get().partitionId(), "tokens": done, "weights": total.tobytes()}])

    def add(batches):
        total, tokens = None, 0
        for batch in batches:
            for n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = np.frombuffer(w, np.float64)
                total, tokens = w if total is None else total + w, tokens + n
        if tokens:
            yield pa.RecordBatch.from_pylist([{"tokens": tokens, "weights": total.tobytes()}])

    dealt = rows.select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "doc_id", "symbols")
    dealt = dealt.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "key", "doc_id", "symbols")
    made = dealt.select("shard", "symbols").mapInArrow(run, "task long, tokens long, weights binary")
    # a tree of two levels: about as many sums reach the driver as the root of the number of tasks
    sums = made.repartition(max(1, math.isqrt(parts)), "task").sortWithinPartitions("task").select("tokens", "weights").mapInArrow(add, "tokens long, weights binary").collect()
    return sum(np.frombuffer(r["weights"], np.float64) for r in sums) / sum(r["tokens"] for r in sums)


def document_scores(net: Gru, kinds: np.ndarray, sizes: list[int], width: int = 384) -> np.ndarray:
    """Natural-log P of each document's symbols, the state carried from its first token to its end."""
    sizes = np.asarray(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out, order = np.zeros(len(sizes)), np.argsort(-sizes, kind="stable")
    e, u = net._input_weights()
    room = 4_096 + width
    states, targets, who = np.ones((room, HIDDEN + 1), np.float32), np.zeros(room, np.int64), np.zeros(room, np.int64)
    for i in range(0, len(order), width):
        group = order[i : i + width]
        size, begin, longest = sizes[group], starts[group], int(sizes[group[0]])
        there = np.searchsorted(-size, -np.arange(longest), side="left").tolist()  # documents longer than t
        h, before, held, last = np.zeros((HIDDEN, len(group)), np.float32), np.full(len(group), BEFORE), 0, 0
        for t, many in enumerate(there):
            if many != last:
                h, last = h[:, :many], many
                gates, n, after = (np.empty((k * HIDDEN, many), np.float32) for k in (2, 1, 1))
            net._step(np.ascontiguousarray(e.take(before[:many], axis=0).T), u @ h, h, gates, n, after)
            h, after = after, np.empty_like(after)
            here = slice(held, held + many)
            states[here, :HIDDEN] = h.T
            targets[here] = before = kinds[begin[:many] + t]
            who[here] = group[:many]
            held += many
            if held >= 4_096 or t == longest - 1:
                logs = net._log_targets(states[:held], targets[:held])
                out += np.bincount(who[:held], logs.astype(np.float64), len(sizes))
                held = 0
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(data: DataFrame, weights: np.ndarray, vocab: Vocabulary) -> DataFrame:
    shared = data.sparkSession.sparkContext.broadcast(weights)
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    tokens = vocab.tokens

    def run(batches):
        net = Gru().load(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, training, sizes, known, base, shares, kinds = (batch.column(k)[i].as_py() for k in range(7))
                total = document_scores(net, np.frombuffer(kinds, "<u2"), sizes) / math.log(10) + np.array(shares)
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "held_out": [x <= 0 for x in training], "n_tokens": sizes, "n_known": known, "train_tokens": [tokens] * len(ids), "base_score": base, "score": total.tolist()}, arrow)

    return data.mapInArrow(run, SCORES)


def score_documents(docs: DataFrame, held_out=is_held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: one token, its end. A row with a null doc_id is a training row. Without
    training rows every probability is that of the unseen symbol and of the untrained net. Repeated rows count
    each. Scores don't depend on how docs is partitioned, but for rounding.
    """
    chunks = word_chunks.chunked(docs, words, extra=F.when(held_out(F.col(id_col)), 0).otherwise(1), id_col=id_col, text_col=text_col, split_arrays=words_of)
    training = chunks.select(F.coalesce(F.sum(F.size(F.filter("extra", lambda x: x > 0))), F.lit(0))).first()[0]
    table = word_table(chunks)
    vocab = vocabulary(table, training)
    vocab.mass = _symbol_mass(table, vocab)
    data = sequences(chunks, _classed(chunks, table, vocab), vocab)
    rows, weights = training_rows(data), Gru().start_from(vocab.mass).flat().astype(np.float64)
    for sixteenths, rate in ROUNDS:
        weights = train_round(rows.where(F.col("sixteenth").isin(list(sixteenths))), weights, rate)
    return scored(data, weights, vocab)
