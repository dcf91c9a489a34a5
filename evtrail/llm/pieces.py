"""Operators 6 and 7: scores over all, or the best, segmentations of words into a fixed public vocabulary's pieces.

Distinct words are sorted into a trie, level by level: the words that share a prefix share its node, and a node's
score is worked out once, from those of the nodes above it and of the pieces that end there.

Words are runs without white space, lower-cased for operator 6, with the vocabulary's word mark in front. A word of
more than LONGEST characters stays out of the trie and is walked by itself, over the same pieces. A character that no
piece spells counts as one unknown piece (operator 6) or as its UTF-8 bytes (operator 7). A task keeps the scores of
the words it has met, KEPT_WORDS of them, and puts only new ones into a trie.

An empty table gives no rows. Columns other than doc_id, text and lang aren't read, whatever their names.
"""

from __future__ import annotations

import os
import pickle
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, slices

MARK, LONGEST = "▁", 40
#: Characters of a long word that are looked up at once.
BLOCK = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Documents that operator 6 is fitted on at most; the learnt rows with the least hash of their id are taken.
FIT_DOCS = 6000
#: Of these, rows that each language has at least, as far as it has them.
LEAST_DOCS = 100
#: Distinct words whose trie is in memory at once while fitting.
FIT_WORDS = 20_000
#: Words whose scores a task keeps from slice to slice; past that it begins anew.
KEPT_WORDS = 100_000
UNDETERMINED = "und"


def vocabulary_path(name: str = "piece_bpe_32k.model", folder: str = "/opt/tokenizers") -> str:
    return os.path.join(folder, name)


def vocabulary(path: str) -> list[str]:
    """Pieces that spell text, in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row of code points."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + codes[:, i]
    return out


class Pieces:
    """The vocabulary, to be looked up by the hash of a piece."""

    def __init__(self, pieces: list[str]) -> None:
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(BASE) + ord(c)) & (2**64 - 1)
            keys[i] = h
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.longest = max(map(len, pieces), default=1)
        self.power = np.array([pow(int(BASE), i, 2**64) for i in range(self.longest + 1)], np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys * BASE) >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h that are pieces, their numbers)"""
        at = np.flatnonzero(self.filter[(h * BASE) >> np.uint64(44)])
        own = h[at]
        i = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ok = self.keys[i] == own
        return at[ok], self.order[i[ok]]

    def ends(self, word: str) -> Iterator[tuple[list[int], list[int]]]:
        """For each character of a word: the sizes of the pieces that end there, least first, and their numbers."""
        codes = np.array([word]).view(np.uint32).astype(np.uint64)
        for at in range(0, len(word), BLOCK):
            first = max(0, at - self.longest + 1)
            own = codes[first : at + BLOCK]
            h, found = np.zeros(len(own) + 1, np.uint64), []
            for size in range(1, min(self.longest, len(own)) + 1):
                h = h[:-1] * BASE + own[size - 1 :]
                i, number = self.find(h)
                found.append(np.stack([i + (first + size), np.full(len(i), size), number])[:, i + (first + size) > at])
            every = np.concatenate(found, axis=1)
            end, sizes, numbers = every[:, np.argsort(every[0], kind="stable")]
            cuts = np.searchsorted(end, np.arange(at + 1, first + len(own) + 2)).tolist()
            sizes, numbers = sizes.tolist(), numbers.tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield sizes[a:b], numbers[a:b]


class Trie:
    """Distinct words, all of 1 to LONGEST characters and a mark, as nodes by depth."""

    def __init__(self, words: list[str]) -> None:
        self.words = np.sort(np.array(words, dtype=f"U{LONGEST + 1}"))
        n = len(words)
        width = int(np.char.str_len(self.words).max()) if n else 0
        codes = self.words.view(np.uint32).reshape(n, LONGEST + 1)[:, :width]
        self.codes = codes
        self.size = np.char.str_len(self.words)
        same = np.zeros(n, np.int64)
        if n > 1:
            same[1:] = (codes[1:] == codes[:-1]).cumprod(axis=1).sum(axis=1)
        self.hashes = _hash(codes)
        self.row: list[np.ndarray] = [np.zeros(min(n, 1), np.int64)]
        self.node: list[np.ndarray] = [np.zeros(n, np.int64)]
        for d in range(1, width + 1):
            has = self.size >= d
            new = has & (same < d)
            if n:
                new[np.flatnonzero(has)[0]] = True
            node = np.cumsum(new) - 1
            self.row.append(np.flatnonzero(new))
            self.node.append(node)

    def walk(self, pieces: Pieces, start: np.ndarray, join: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None], unknown: Callable[[np.ndarray, np.ndarray], np.ndarray], empty: Callable[[int], np.ndarray]) -> np.ndarray:
        """The value of each word. join(values, nodes, values above, pieces) adds one piece length to a level's values."""
        levels = [np.repeat(start[None], len(self.row[0]), axis=0)]
        for d in range(1, len(self.row)):
            row = self.row[d]
            values = empty(len(row))
            for size in range(1, min(d, pieces.longest) + 1):
                h = self.hashes[row, d] - self.hashes[row, d - size] * pieces.power[size]
                at, number = pieces.find(h)
                if len(at):
                    join(values, at, levels[d - size][self.node[d - size][row[at]]], number)
            # Any character may also stand alone as an unknown one, so that every word has a segmentation.
            levels.append(unknown(values, levels[d - 1][self.node[d - 1][row]], self.codes[row, d - 1]))
        out = empty(len(self.words))
        for d in range(1, len(self.row)):
            ends = np.flatnonzero(self.size == d)
            out[ends] = levels[d][self.node[d][ends]]
        return out


def split(text: str, lower: bool) -> list[str]:
    """Words with the mark in front."""
    own = (text.lower() if lower else text).split()
    return [MARK + w.replace("\0", "�") for w in own]


def lettered(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def by_length(words: Iterable[str]) -> tuple[list[str], list[str]]:
    """Words for the trie, and those that are too long for it."""
    short, long = [], []
    for w in words:
        (short if len(w) <= LONGEST + 1 else long).append(w)
    return short, long


class Known:
    """Scores of the words that a task has met so far."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.values: np.ndarray | None = None

    def of(self, words: set[str], score: Callable[[Iterable[str]], tuple[list[str], np.ndarray]]) -> tuple[dict[str, int], np.ndarray]:
        """(word's place, scores by place) for at least these words; score is asked about new ones only."""
        new = [w for w in words if w not in self.number]
        if new and len(self.number) + len(new) > KEPT_WORDS:
            self.number, self.values, new = {}, None, list(words)
        if new or self.values is None:
            order, values = score(new)
            self.number.update(zip(order, range(len(self.number), len(self.number) + len(order)), strict=True))
            self.values = values if self.values is None else np.concatenate([self.values, values])
        return self.number, self.values


class Languages:
    """Operator 6's model: for each language the log-probability of each piece."""

    def __init__(self, names: list[str], pieces: Pieces, logs: np.ndarray, unknown: np.ndarray, prior: np.ndarray) -> None:
        self.names, self.pieces, self.logs, self.unknown, self.prior = names, pieces, logs, unknown, prior

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], vocab: list[str], rounds: int = 2, docs: dict[str, int] | None = None) -> Languages:
        """Learns from (text, lang) rows, in rounds; docs: each language's share, if the rows don't have it. A piece that ends a prefix of a word counts with its share in
        that prefix's forward score, as often as words with that prefix occur; the first round's pieces are alike."""
        names = sorted({lang for _, lang in rows})
        pieces = Pieces(vocab)
        counts = [Counter() for _ in names]
        docs = docs or Counter(lang for _, lang in rows)
        for text, lang in rows:
            counts[names.index(lang)].update(split(text, True))
        made = cls(names, pieces, np.full((len(vocab), len(names)), -np.log(len(vocab) + 1.0)), np.full(len(names), -20.0), np.log(np.array([docs[x] / sum(docs.values()) for x in names])))
        words, long = by_length(sorted(set(chain.from_iterable(counts))))
        for _ in range(rounds):
            total = np.full((len(vocab), len(names)), 0.05)
            for at in range(0, len(words), FIT_WORDS):
                trie = Trie(words[at : at + FIT_WORDS])
                weights = np.array([[c[w] for c in counts] for w in trie.words.tolist()], float)
                through = [np.stack([np.bincount(trie.node[d][trie.size >= d], weights[trie.size >= d, i], minlength=len(trie.row[d])) for i in range(len(names))], axis=1) for d in range(len(trie.row))]
                made._values(trie, total, through)
            for w in long:
                made._value(w, total, np.array([c[w] for c in counts], float))
            made.logs = np.log(total / total.sum(axis=0))
            made.unknown = np.full(len(names), np.log(1e-7))
        return made

    def _values(self, trie: Trie, total: np.ndarray | None = None, through: list[np.ndarray] | None = None) -> np.ndarray:
        """Forward scores of the trie's words by language; with total, adds up expected pieces on the way."""
        ending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        depth = [0]

        def join(values: np.ndarray, at: np.ndarray, above: np.ndarray, number: np.ndarray) -> None:
            term = above + self.logs[number]
            if total is not None:
                ending.append((at, number, term))
            values[at] = np.logaddexp(values[at], term)

        def unknown(values: np.ndarray, above: np.ndarray, _: np.ndarray) -> np.ndarray:
            out = np.logaddexp(values, above + self.unknown)
            depth[0] += 1
            if total is not None:
                for at, number, term in ending:
                    np.add.at(total, number, np.exp(term - out[at]) * through[depth[0]][at])
                ending.clear()
            return out

        return trie.walk(self.pieces, np.zeros(len(self.names)), join, unknown, lambda n: np.full((n, len(self.names)), -np.inf))

    def _value(self, word: str, total: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """As _values, for one word of any length."""
        past = deque([np.zeros(len(self.names))], maxlen=max(1, self.pieces.longest))
        for sizes, numbers in self.pieces.ends(word):
            terms = [past[-size] + self.logs[number] for size, number in zip(sizes, numbers, strict=True)]
            out = np.logaddexp.reduce([*terms, past[-1] + self.unknown], axis=0)
            if total is not None:
                for number, term in zip(numbers, terms, strict=True):
                    total[number] += np.exp(term - out) * weight
            past.append(out)
        return past[-1]

    def scored(self, words: Iterable[str]) -> tuple[list[str], np.ndarray]:
        """The words in another order, and their forward scores."""
        short, long = by_length(words)
        trie = Trie(short)
        return trie.words.tolist() + long, np.concatenate([self._values(trie), *(self._value(w)[None] for w in long)])

    def predict(self, texts: list[str | None], known: Known | None = None) -> list[tuple[str, float]]:
        own = [split(t, True) if t else [] for t in texts]
        known = Known() if known is None else known
        number, values = known.of(set(chain.from_iterable(own)), self.scored)
        out = []
        for text, mine in zip(texts, own, strict=True):
            if not lettered(text):
                out.append((UNDETERMINED, 0.0))
                continue
            if not self.names:
                out.append((UNDETERMINED, 0.0))
                continue
            score = self.prior + values[np.fromiter(map(number.__getitem__, mine), np.int64, len(mine))].sum(axis=0)
            share = np.exp(score - score.max())
            best = int(np.argmax(score))
            out.append((self.names[best], float(share[best] / share.sum())))
        return out


def sampled(docs: DataFrame, limit: int = FIT_DOCS) -> tuple[DataFrame | None, dict[str, int]]:
    """(text, lang) of about limit rows, 2 * limit at most, of those that may be learnt from, and how many of these
    each language has: rows with a language whose id's crc32 mod 3 isn't 1. A hash of the row picks them, so the choice
    doesn't depend on the order. A language of which that leaves few has its share raised to LEAST_DOCS rows."""
    rows = docs.filter(docs["lang"].isNotNull() & docs["text"].isNotNull() & (crc_mod("doc_id", 3) != 1)).select("text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None, {}
    share, least = limit / sum(sizes.values()), max(1, min(LEAST_DOCS, limit // (4 * len(sizes))))
    below = docs.sparkSession.createDataFrame([(lang, int(min(1.0, max(share, least / n)) * (1 << 20) + 1)) for lang, n in sizes.items()], f"lang {rows.schema['lang'].dataType.simpleString()}, below long")
    picked = rows.join(F.broadcast(below), "lang").filter("h < below").orderBy("h", F.xxhash64("text")).limit(2 * limit)
    return picked.select(picked["text"].cast("string").alias("text"), "lang"), sizes


def learnt(docs: DataFrame, limit: int = FIT_DOCS) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """sampled() with its rows at hand."""
    sample, sizes = sampled(docs, limit)
    return [] if sample is None else [tuple(r) for r in sample.collect()], sizes


def fitted(docs: DataFrame, path: str) -> Languages:
    """The model, fitted by one task on the bounded sample; the driver gets its numbers alone."""
    sample, sizes = sampled(docs)
    vocab = vocabulary(path)
    if sample is None:
        return Languages.fit([], vocab, docs={})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pair for b in batches for pair in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)]
        if rows:
            made = Languages.fit(rows, vocab, docs=sizes)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((made.names, made.logs, made.unknown, made.prior))], pa.binary())], ["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    if not found:
        return Languages.fit([], vocab, docs={})
    names, logs, unknown, prior = pickle.loads(found[0]["model"])
    return Languages(names, Pieces(vocab), logs, unknown, prior)


def languages(docs: DataFrame, path: str, fit_on: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, lang_pred, score) for each row.

    Null texts and texts without a letter are undetermined, with score 0; so is all text if nothing could be learnt.
    Equal scores go to the language that comes first by name. Repeated rows get equal answers.
    """
    model = fitted(docs if fit_on is None else fit_on, path)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in slices(batches, "text"):
            lang, score = zip(*sent.value.predict(b.column("text").to_pylist(), known), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame, path: str) -> DataFrame:
    out = languages(docs, path)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def determined(docs: DataFrame, path: str, fit_on: DataFrame | None = None) -> DataFrame:
    """The rows of docs that have a language, with all their columns; lang, if docs has it, becomes the predicted one.

    Rows whose text is null or has no letter go. If no language could be learnt, the others stay with their lang as it
    is. Columns may have any names, and lang any type that a string can be cast to.
    """
    model = fitted(docs if fit_on is None else fit_on, path)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in slices(batches, text):
            texts = b.column(text).to_pylist()
            found = [lang if lang != UNDETERMINED else None for lang, _ in sent.value.predict(texts, known)]
            stay = pa.array([lang is not None or not sent.value.names and lettered(t) for t, lang in zip(texts, found, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "found"]).filter(stay)

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("found", T.StringType())]))
    kept = [F.coalesce(F.col("found").cast(f.dataType), F.col(f"c{i}")) if f.name == "lang" else F.col(f"c{i}") for i, f in enumerate(docs.schema.fields)]
    return out.select(*[c.alias(n) for c, n in zip(kept, names, strict=True)])


class Counts:
    """Operator 7's model: pieces by a fixed log-probability that falls with their id, as by Zipf's law."""

    def __init__(self, vocab: list[str]) -> None:
        self.pieces = Pieces(vocab)
        self.cost = np.log(np.arange(len(vocab)) + 2.0) + np.log(np.log(len(vocab) + 2.0))
        self.byte_cost = float(self.cost.max(initial=1.0)) + 1.0

    def tokens(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word's best segmentation; of equally good ones the fewest."""
        order, n = self.counted(words)
        return dict(zip(order, n.tolist(), strict=True))

    def counted(self, words: Iterable[str]) -> tuple[list[str], np.ndarray]:
        """The words in another order, and their tokens."""
        words, long = by_length(words)
        trie = Trie(words)

        def join(values: np.ndarray, at: np.ndarray, above: np.ndarray, number: np.ndarray) -> None:
            better(values, at, above + np.stack([self.cost[number], np.ones(len(number))], axis=1))

        def better(values: np.ndarray, at: np.ndarray, term: np.ndarray) -> None:
            old = values[at]
            less = (term[:, 0] < old[:, 0] - 1e-9) | (np.abs(term[:, 0] - old[:, 0]) <= 1e-9) & (term[:, 1] < old[:, 1])
            values[at[less]] = term[less]

        def unknown(values: np.ndarray, above: np.ndarray, codes: np.ndarray) -> np.ndarray:
            size = 1.0 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            better(values, np.arange(len(values)), above + np.stack([size * self.byte_cost, size], axis=1))
            return values

        values = trie.walk(self.pieces, np.zeros(2), join, unknown, lambda n: np.full((n, 2), np.inf))
        return trie.words.tolist() + long, np.concatenate([values[:, 1].astype(np.int64), np.array([self._tokens(w) for w in long], np.int64)])

    def _tokens(self, word: str) -> int:
        """As tokens, for one word of any length."""
        past = deque([(0.0, 0)], maxlen=max(1, self.pieces.longest))
        for c, (sizes, numbers) in zip(word, self.pieces.ends(word), strict=True):
            best = (np.inf, 0)
            options = [(past[-size][0] + cost, past[-size][1] + 1) for size, cost in zip(sizes, self.cost[numbers].tolist(), strict=True)]
            size = 1 + (c >= "\x80") + (c >= "\u0800") + (c >= "\U00010000")
            for term in [*options, (past[-1][0] + size * self.byte_cost, past[-1][1] + size)]:
                if term[0] < best[0] - 1e-9 or abs(term[0] - best[0]) <= 1e-9 and term[1] < best[1]:
                    best = term
            past.append(best)
        return past[-1][1]


_counts: dict[str, Counts] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = Counts(vocabulary(path))
        known = Known()
        for b in slices(batches, "text"):
            own = [split(t or "", False) for t in b.column("text").to_pylist()]
            number, tokens = known.of(set(chain.from_iterable(own)), _counts[path].counted)
            sums = [int(tokens[np.fromiter(map(number.__getitem__, w), np.int64, len(w))].sum()) for w in own]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, own)), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
