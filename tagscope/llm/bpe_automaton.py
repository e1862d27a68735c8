"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over token
labels that accepts exactly the token sequences BPE produces.  It starts as one
state with a loop for every base symbol.  The gadget of a merge (u, v) -> w
splits the state that u leads to: the copy loses its v arc (u followed by v can
no longer stay unmerged), u is redirected to the copy, and every state with a u
arc gets a w arc that leads where v led.  The state reached is fixed by the last
label, so the compiled form is a table: per label the chain of states it was
derived from, and per (label, label) the merge that removed the arc.

A word is encoded left to right by a table over bytes.  Its states hold the
positions reached in a trie of the labels together with the label read before
each; among the labels that end at a byte exactly one is an arc of the automaton
from the state at its start, and that one is the last label of the prefix.  The
table's rows are made when first needed (any text touches a small part) and
dropped beyond a bound; the path is read backwards from the word's end.
Decoding emits the labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 1 << 60
CACHE_PIECES = 150_000   # pieces between blanks remembered by one Python worker, twice
KEPT_STATES = 200_000    # rows of the byte table kept by one Python worker
# The white space of the vocabulary's normaliser (Unicode White_Space).
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Automaton:
    """Arcs of the tokenization automaton and the label trie."""

    def __init__(self, labels: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.text = {i: s for s, i in labels.items()}
        self.parts: dict[int, tuple[int, int, int]] = {}      # label -> (left, right, rank)
        self.cut: dict[tuple[int, int], int] = {}             # (label, label) -> rank that removed the arc
        self._heads: dict[int, list[tuple[int, int]]] = {}
        self._tails: dict[int, list[tuple[int, int]]] = {}
        for rank, (left, right) in enumerate(merges):
            self._gadget(labels[left], labels[right], labels[left + right], rank)
        self._heads, self._tails = {}, {}
        self._arc: dict[tuple[int, int], bool] = {}

    def _gadget(self, u: int, v: int, w: int, rank: int) -> None:
        if self.arc(u, v):            # else no state that u leads to has a v arc: the merge changes nothing
            self.cut[u, v] = rank
            if w not in self.parts:
                self.parts[w] = (u, v, rank)

    def _chain(self, label: int, side: int, kept: dict) -> list[tuple[int, int]]:
        """(label, rank at which it was merged into the next), outermost first:
        the states (side 1) or arcs (side 0) that ``label`` was derived from."""
        chain = kept.get(label)
        if chain is None:
            chain, at, until = [], label, NEVER
            while True:
                chain.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][2], self.parts[at][side]
            kept[label] = chain
        return chain

    def arc(self, last: int, label: int) -> bool:
        """Does the state that ``last`` leads to have an arc ``label``?"""
        cut = self.cut
        for x, x_until in self._chain(last, 1, self._tails):
            for y, y_until in self._chain(label, 0, self._heads):
                rank = cut.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True


class WordBpe:
    """Encoder and decoder for a word-end BPE vocabulary file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        labels = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.automaton = Automaton(labels, [tuple(m) for m in spec["model"]["merges"]])
        self.labels = dict(self.automaton.text)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels.update({i: s for s, i in self.special.items()})
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}"))
        shown = byte_symbols()
        self.inner = [labels[c] for c in shown]
        self.final = [labels[c + self.end] for c in shown]
        # trie over labels, spelled in base symbols
        self.next: list[dict[int, int]] = [{}]
        self.at: list[int] = [-1]
        spelled: dict[int, tuple[int, ...]] = {i: (i,) for i in (*self.inner, *self.final)}
        for label in (*spelled, *self.automaton.parts):
            if label not in spelled:
                left, right, _ = self.automaton.parts[label]
                spelled[label] = spelled[left] + spelled[right]
            node = 0
            for s in spelled[label]:
                to = self.next[node].get(s)
                if to is None:
                    to = self.next[node][s] = len(self.next)
                    self.next.append({})
                    self.at.append(-1)
                node = to
            self.at[node] = label
        self.length = {i: len(c) for i, c in spelled.items()}
        self._reset()
        self.pieces: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def _state(self, key: tuple) -> int:
        """Number of the state in which the trie positions and the labels
        before them are ``key``; the last pair's label is the one just read."""
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.label.append(key[-1][1])
        return number

    def _step(self, state: int, symbol: int) -> list[tuple[int, int]]:
        """The pairs after one more symbol; the last one starts a new label."""
        step, at, arc = self.next, self.at, self.automaton.arc
        open_, read = [], -1
        for node, before in self.keys[state]:
            to = step[node].get(symbol)
            if to is not None:
                label = at[to]
                if label >= 0 and read < 0 and (before < 0 or arc(before, label)):
                    read = label
                if step[to]:
                    open_.append((to, before))
        open_.append((0, read))
        return open_

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.label: list[int] = []
        self.go: dict[int, int] = {}           # state and byte -> state
        self.end_label: dict[int, int] = {}    # state and last byte -> label
        self._state(((0, -1),))

    def forget(self) -> None:
        """Drop what was remembered of texts; the compiled tables stay."""
        self._reset()
        self.pieces, self.older = {}, {}
        self.automaton._heads.clear()
        self.automaton._tails.clear()

    def encode_word(self, word: str) -> list[int]:
        """Labels on the automaton's only path that spells the word."""
        if len(self.keys) > KEPT_STATES:
            self._reset()
        raw = word.encode("utf-8")
        go, label, state, ends = self.go, self.label, 0, []
        for b in raw[:-1]:
            at = state << 8 | b
            to = go.get(at)
            if to is None:
                to = go[at] = self._state(tuple(self._step(state, self.inner[b])))
            state = to
            ends.append(label[state])
        at = state << 8 | raw[-1]
        last = self.end_label.get(at)
        if last is None:
            last = self.end_label[at] = self._step(state, self.final[raw[-1]])[-1][1]
        length = self.length
        out, i = [last], len(ends) - length[last]
        while i >= 0:
            last = ends[i]
            out.append(last)
            i -= length[last]
        return out[::-1]

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character on its own
        return text.lower()

    def _piece(self, piece: str) -> tuple[int, str, str]:
        got = self.older.get(piece)
        if got is None:
            plain = self._normal(piece)
            if plain.isalpha():
                ids = self.encode_word(plain)
            else:
                ids = [i for w in self.words.findall(plain) for i in self.encode_word(w)]
            got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        if len(piece) <= 64:
            if len(self.pieces) >= CACHE_PIECES:   # the pieces in use move over from the older half
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = got
        return got

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        # no match and no composition crosses a blank, tab or line end
        text = text.replace("\n", " ").replace("\t", " ")
        known = self.pieces.get
        return [p for p in ((known(w) or self._piece(w)) for w in text.split(" ") if w) if p[0]]

    def run(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids joined by one blank, decoded text)."""
        text = text or ""
        if self.split_special is None or "<" not in text:
            parts = self._plain(text)
        else:
            parts, at = [], 0
            for m in self.split_special.finditer(text):
                parts += self._plain(text[at:m.start()])
                parts.append((1, str(self.special[m.group()]), m.group()))
                at = m.end()
            parts += self._plain(text[at:])
        return sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.run(text)[1].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """Labels of the arcs, joined by one blank (the vocabulary names no decoder)."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The compiled vocabulary, once per Python worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                     ids: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (array), decoded, ids_sha256,
    decoded_sha256; with ``ids=False`` without the two large ones.

    ``path`` names the vocabulary file, which every executor must have; it is
    compiled once per worker.  Rows are independent (no shuffle).  Null text
    counts as empty: no tokens, empty decoded text.  Ids may be null or repeat;
    other columns are not read, so their names cannot clash.
    """
    fields = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    if ids:
        fields += [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())]
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[] for _ in fields]
                for t in part.column(1):
                    n, joined, decoded = bpe.run(t.as_py())
                    row = [n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    if ids:
                        row += [[int(i) for i in joined.split()], decoded]
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(v, f[2]) for v, f in zip(out, fields)]], names=["doc_id", *[f[0] for f in fields]])
        bpe.forget()     # the worker lives on and may serve other stages
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, ", ".join([f"doc_id {id_type}", *[f"{n} {t}" for n, t, _ in fields]]))
