"""Operator 9: byte-level BPE by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens: it begins as one state with an
arc for each byte, and each merge (a, b) adds a gadget. Where the state behind a has an arc b, all arcs a are led to
a copy of that state without the arc b, and each state with an arc a gets an arc ab that leads where b led. All
arcs with one label lead to one state, so the automaton is kept as: the state each label leads to, and for each
state its origin, the label it lost and the merge that made it. Whether a state has an arc then follows from these
alone, and the answers that words ask for fill the transition table. A word has one path, whose labels are its tokens.

Null text counts as empty; an empty text has no tokens. Special strings become their ids as the library's default
does. Repeated rows and ties get equal answers. An empty table gives no rows. Other columns, whatever their names,
aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: The split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a worker keeps; beyond that the table starts anew.
KEPT_WORDS = 250_000
#: Transitions that a worker keeps, likewise.
KEPT_STEPS = 500_000
#: Where a node of the tree of labels has the token that ends there; its other keys are bytes.
TOKEN = -1


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    return os.path.join(folder, name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Tokens are numbered by their ids in the vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.label: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.label |= {i: t.encode() for t, i in self.special.items()}
        self.born = dict.fromkeys((vocab[c] for c in letters if c in vocab), 0)
        self.left: dict[int, int] = {}
        self.origin, self.lost, self.made = [0], [-1], [0]
        self.leads = dict.fromkeys(self.born, 0)
        self.table: dict[int, dict[int, bool]] = {}
        self.filled = 0
        for n, merge in enumerate(spec["model"]["merges"], 1):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self._gadget(n, vocab[a], vocab[b], vocab[a + b])
        self._settle()
        self.size = {i: len(x) for i, x in self.label.items()}
        self.longest = max(self.size.values(), default=1)
        self.tree: dict[int, dict] = {}
        for t in self.leads:
            node = self.tree
            for byte in self.label[t]:
                node = node.setdefault(byte, {})
            node[TOKEN] = t
        self.known = Words(self)
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _gadget(self, n: int, a: int, b: int, ab: int) -> None:
        if a not in self.leads or b not in self.leads:
            return
        behind, target = self.leads[a], self.leads[b]
        if not self.arc(behind, b):
            return
        self.origin.append(behind)
        self.lost.append(b)
        self.made.append(n)
        if ab not in self.leads:
            self.born[ab], self.left[ab] = n, a
            self.leads[ab] = target
        self.leads[a] = len(self.origin) - 1

    def arc(self, state: int, token: int) -> bool:
        """Whether state has an arc token, of all labels made so far; follows the gadgets back one by one."""
        s, t = state, token
        while True:
            if self.born[t] < self.made[s]:
                if self.lost[s] == t:
                    return False
                s = self.origin[s]
            elif t in self.left:
                t = self.left[t]
            else:
                return True

    def _settle(self) -> None:
        """Numbers the states so that the copies of a state form an interval, and lists for each label where it was lost."""
        copies: list[list[int]] = [[] for _ in self.origin]
        for s in range(1, len(self.origin)):
            copies[self.origin[s]].append(s)
        first, after, n = [0] * len(copies), [0] * len(copies), 0
        stack = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                after[s] = n
                continue
            first[s] = n
            n += 1
            stack.append((s, True))
            stack.extend((c, False) for c in copies[s])
        gone: dict[int, list[tuple[int, int, int]]] = {}
        for s in range(1, len(copies)):
            gone.setdefault(self.lost[s], []).append((first[s], after[s], self.made[s]))
        self.first = first
        self.gone = {t: tuple(zip(*sorted(x), strict=True)) for t, x in gone.items()}

    def _transition(self, state: int, token: int) -> bool:
        """arc() after _settle(): a label or one of its left parts is missing if some origin of state lost it in time."""
        at, t, by = self.first[state], token, len(self.born) + len(self.origin)
        gone, left, born = self.gone, self.left, self.born
        out = True
        while out:
            if (x := gone.get(t)) is not None:
                i = bisect_right(x[0], at) - 1
                if i >= 0 and at < x[1][i] and x[2][i] <= by:
                    out = False
                    break
            by = born[t]
            t = left.get(t, -1)
            if t < 0:
                break
        return out

    def _arcs(self, word: bytes, at: int) -> list[int]:
        """The labels that the word spells from a place on, longest last."""
        node, out = self.tree, []
        for byte in word[at : at + self.longest]:
            if (node := node.get(byte)) is None:
                break
            if (t := node.get(TOKEN)) is not None:
                out.append(t)
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """The labels on the word's path.

        From each place the longest arc that its state has is taken first. Each prefix of the word has just one path,
        so a place from which none leads on is never looked at again; the number of steps is in proportion to the word.
        The table has which arcs a state has; what it doesn't hold yet is worked out once.
        """
        if self.filled >= KEPT_STEPS:
            self.table, self.filled = {}, 0
        n, table, size, leads = len(word), self.table, self.size, self.leads
        if not n:
            return []
        at, state, out, dead = 0, 0, [], set()
        todo = [self._arcs(word, 0)]
        while True:
            if todo[-1]:
                t = todo[-1].pop()
                after = at + size[t]
                if after in dead:
                    continue
                if (arcs := table.get(state)) is None:
                    arcs = table[state] = {}
                if (ok := arcs.get(t)) is None:
                    ok = arcs[t] = self._transition(state, t)
                    self.filled += 1
                if not ok:
                    continue
                out.append(t)
                if after == n:
                    return out
                at, state = after, leads[t]
                todo.append(self._arcs(word, at))
            else:
                dead.add(at)
                todo.pop()
                at -= size[out.pop()]
                state = leads[out[-1]] if out else 0

    def forget(self) -> None:
        """Drops what texts so far have filled in: a worker serves other stages after this one."""
        self.known, self.table, self.filled = Words(self), {}, 0

    def words(self, text: str) -> list[str]:
        """The pre-split words of a text; a special string is a word by itself, which no split makes."""
        out: list[str] = []
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            out += self.split.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.split.findall(text[at:]) if at else self.split.findall(text)

    def spelled(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """For each text its ids, joined by commas, and the labels that they stand for, joined; each distinct word is looked up once."""
        own = [self.words(t) for t in texts]
        ends = np.zeros(len(own) + 1, np.int64)
        np.cumsum([len(x) for x in own], out=ends[1:])
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        coded = pa.array(list(chain.from_iterable(own)), pa.large_string()).dictionary_encode()
        found = list(map(self.known.__getitem__, coded.dictionary.to_pylist()))
        ids, labels = (pa.array([x[i] for x in found], pa.large_binary()).take(coded.indices) for i in (0, 1))
        return [x[:-1] for x in _runs(ids, ends)], _runs(labels, ends)

    def encode(self, text: str) -> list[int]:
        ids = self.spelled([text])[0][0]
        return list(map(int, ids.split(b","))) if ids else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.label[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of each text the number of tokens, the hash of its ids, and the hash of what the ids' labels spell."""
        ids, labels = self.spelled(texts)
        n = [x.count(b",") + 1 if x else 0 for x in ids]
        return n, [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in labels]


def _runs(parts: pa.Array, ends: np.ndarray) -> list[bytes]:
    """The parts, put together from end to end; they lie in one buffer already."""
    if not len(parts):
        return [b""] * (len(ends) - 1)
    _, offsets, data = parts.buffers()
    at = np.frombuffer(offsets, np.int64)[ends].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(whole[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Words(dict):
    """Each word's ids, each with a comma, and the labels that they stand for; encoded when first asked for."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        own = self.automaton
        ids = [own.special[word]] if word in own.special else own.encode_word(word.encode())
        out = self[word] = (b"".join([b"%d," % i for i in ids]), own.decode_bytes(ids))
        return out


_loaded: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of path, built once in each worker."""
    if path not in _loaded:
        _loaded[path] = Automaton(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(path)
        for b in slices(batches, "t"):
            ids = [made.encode(x or "") for x in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])
        made.forget()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) for each row of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(path)
        for b in batches:
            text = [made.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(text, pa.string())], ["k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(encoded[key].alias("k"), encoded["ids"]).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(path)
        for b in slices(batches, "t"):
            n, ids, spelled = made.digests([x or "" for x in b.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(spelled)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        made.forget()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("t")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
