"""Byte-pair encoding as a deterministic automaton over tokens.

The automaton starts with one state that loops on every base symbol, and the merges are put into it in order. The
merge (a, b) -> c is a gadget: wherever a path reads a and then b, an arc c is laid beside it that leads where b led,
and the state after a is replaced by a copy without the arc b. All arcs with one label lead to one state, so a state
is named by the label that leads to it, and a gadget adds one state, a copy less one arc. What remains accepts
exactly the token sequences that BPE produces, one for every word.

Arcs are not listed, for states times tokens would be billions. A state lacks an arc t if some gadget took it away:
one for a label on the right edge of the state's own label, before that label became part of a longer one, and for t
or the left part from which t's arc was laid, no later than that. ``_finds_arc`` looks along both edges; what it
finds is kept in a bounded transition table. Encoding follows the arcs whose labels spell the word; the path to a
prefix is unique, so each position is reached once.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed values of byte-level vocabularies: bytes written as themselves; the others are written as U+0100 and up.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Below U+0180 letters are composed, and lower case and character classes are the same in all versions of Unicode.
UNSETTLED = re.compile("[^\x00-\u017f]")
#: Fixed value: how the tokenizer files split normalised text into words, with the settled letters, digits and spaces spelt out.
LETTERS, DIGITS, SPACES = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \x85\xa0"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")
#: Results of words are remembered until they take so many bytes together, each with so many for its places in tables.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 400
#: Fewer words of one length than this are read one by one: arrays of few rows cost more than they save.
FEW, ARC_LIMIT = 32, 2_000_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    others = [b for b in range(256) if b not in PLAIN_BYTES]
    return {b: chr(b) for b in PLAIN_BYTES} | {b: chr(256 + n) for n, b in enumerate(others)}


class _Table:
    """A map from non-negative 64-bit integers to non-negative integers, read and filled by arrays; emptied when half full."""

    def __init__(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.size = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 where there is none."""
        at = self._slots(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.values[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        at = at[open_]
        while open_.size:
            at = (at + 1) & self.mask
            there = self.keys[at]
            same = there == keys[open_]
            found[open_[same]] = self.values[at[same]]
            left = ~same & (there >= 0)
            open_, at = open_[left], at[left]
        return found

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are not there yet, each once."""
        if 2 * (self.size + len(keys)) > self.mask:
            self.keys[:], self.size = -1, 0
        self.size += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            stored = self.keys[at] == keys
            self.values[at[stored]] = values[stored]
            keys, values, at = keys[~stored], values[~stored], (at[~stored] + 1) & self.mask


class Automaton:
    """The automaton of a list of merges. A symbol is a byte, or a byte that ends its word.

    Tokens are numbered: byte b is b, byte b at a word's end 256 + b, then come the merges.
    """

    def __init__(self, merges: list[tuple[int, int]]) -> None:
        self.left, self.right = [-1] * 512, [-1] * 512  # the parts of a merge
        self.gadgets: dict[int, int] = {}  # (a, b) -> c, of the merges that can apply
        spelling = [bytes([b]) for b in range(256)] * 2
        ends = [False] * 256 + [True] * 256
        dead = set()
        for c, (a, b) in enumerate(merges, 512):
            if dead.isdisjoint((a, b)) and self._finds_arc(a, b):
                self.gadgets[a << 20 | b] = c
            else:
                dead.add(c)
            self.left.append(a)
            self.right.append(b)
            spelling.append(spelling[a] + spelling[b])
            ends.append(ends[b])
        self._spell(spelling, ends, dead)
        self.table = _Table(21)
        self.arcs: dict[int, bool] = {}

    def _spell(self, spelling: list[bytes], ends: list[bool], dead: set[int]) -> None:
        """A trie over the labels: (node, byte) -> node, and the tokens that a node spells inside a word and at its end."""
        trie: dict[int, int] = {}
        inside, at_end = [-1], [-1]
        for token, label in enumerate(spelling):
            node = 0
            for byte in label:
                node = trie.setdefault(node << 8 | byte, len(inside))
                if node == len(inside):
                    inside.append(-1)
                    at_end.append(-1)
            if token not in dead:
                (at_end if ends[token] else inside)[node] = token
        self.nodes, self.spelt = trie, (inside, at_end)
        self.inside, self.at_end = np.array(inside, np.int32), np.array(at_end, np.int32)
        self.trie = _Table((2 * len(trie)).bit_length())
        self.trie.put(np.fromiter(trie, np.int64, len(trie)), np.fromiter(trie.values(), np.int32, len(trie)))

    def _finds_arc(self, state: int, token: int) -> bool:
        """Whether the state after one token has an arc for another."""
        left, right, gadgets = self.left, self.right, self.gadgets
        a, a_until = state, 1 << 60
        while a >= 0:
            b, b_until = token, 1 << 60
            while b >= 0:
                c = gadgets.get(a << 20 | b)
                if c is not None and c < a_until and c <= b_until:
                    return False
                b, b_until = left[b], b
            a, a_until = right[a], a
        return True

    def _arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for its token: the transition table, filled as pairs turn up."""
        keys = states.astype(np.int64) << 20 | tokens
        found = self.table.get(keys)
        if (new := keys[found < 0]).size:
            new = np.unique(new)
            self.table.put(new, np.array([self._finds_arc(k >> 20, k & 0xFFFFF) for k in new.tolist()], np.int32))
            found = self.table.get(keys)
        return found == 1

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word. Many words of one length advance together, a position at a time."""
        found: list[list[int]] = [[] for _ in words]
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for length, places in by_length.items():
            if len(places) < FEW:
                for k in places:
                    found[k] = self._path(words[k])
                continue
            step = max(1, (1 << 18) // max(length, 1))
            for at in range(0, len(places) if length else 0, step):
                part = places[at : at + step]
                letters = np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(len(part), length)
                for k, path in zip(part, self._paths(letters), strict=True):
                    found[k] = path
        return found

    def _path(self, word: bytes) -> list[int]:
        """The tokens of one word, in time linear in its length: a label has few letters, and so has a walk in the trie."""
        nodes, (inside, at_end), arcs, length = self.nodes, self.spelt, self.arcs, len(word)
        token, start = [-1] * (length + 1), [0] * (length + 1)
        for at in range(length):
            state, node = token[at], 0
            for to in range(at + 1, length + 1):
                node = nodes.get(node << 8 | word[to - 1])
                if node is None:
                    break
                spelt = (at_end if to == length else inside)[node]
                if spelt < 0 or token[to] >= 0:
                    continue
                if at:
                    key = state << 20 | spelt
                    there = arcs.get(key)
                    if there is None:
                        if len(arcs) >= ARC_LIMIT:
                            arcs.clear()
                        there = arcs[key] = self._finds_arc(state, spelt)
                    if not there:
                        continue
                token[to], start[to] = spelt, at
        path, place = [], length
        while place:
            path.append(token[place])
            place = start[place]
        return path[::-1]

    def _paths(self, letters: np.ndarray) -> list[list[int]]:
        many, length = letters.shape
        letters = np.ascontiguousarray(letters.T).astype(np.int64)
        token, start = np.full((length + 1, many), -1, np.int32), np.zeros((length + 1, many), np.int32)  # the last arc to each prefix
        for at in range(length):
            row, node = np.arange(many), np.zeros(many, np.int64)
            for to in range(at, length):
                node = self.trie.get(node << 8 | letters[to][row])
                alive = np.flatnonzero(node >= 0)
                if not alive.size:
                    break
                row, node = row[alive], node[alive].astype(np.int64)
                spelt = (self.at_end if to + 1 == length else self.inside)[node]
                open_ = np.flatnonzero((spelt >= 0) & (token[to + 1][row] < 0))
                if open_.size:
                    rows, tokens = row[open_], spelt[open_]
                    if at:
                        there = self._arcs(token[at][rows], tokens)
                        rows, tokens = rows[there], tokens[there]
                    token[to + 1, rows], start[to + 1, rows] = tokens, at
        every, place, columns = np.arange(many), np.full(many, length), []
        while place.any():
            columns.append(np.where(place > 0, token[place, every], -1))
            place = start[place, every]
        return [[t for t in path if t >= 0] for path in np.array(columns[::-1]).T.tolist()]


class WordTokenizer:
    """Encoding and decoding of texts as a tokenizer file of the kind "word BPE" defines it.

    Texts of settled letters are lower-cased and split into words here, others by the library's own normaliser and
    pre-tokeniser. The automaton encodes the words; a bounded cache keeps results. Special tokens count where their
    strings stand. Decoding emits the labels of the arcs with a space between them: the files name no decoder.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.labels = [letters[b] for b in range(256)] + [letters[b] + end for b in range(256)]
        number = {text: n for n, text in enumerate(self.labels)}
        merges = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.append((number[a], number[b]))
            number[a + b] = len(self.labels)
            self.labels.append(a + b)
        self.automaton = Automaton(merges)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.ids = [vocabulary[label] for label in self.labels]
        self.label_of = dict(zip(self.ids, self.labels, strict=True)) | {n: t for t, n in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.byte = {letter: b for b, letter in letters.items()}
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.known: dict[str | bytes, tuple[str, str]] = {t: (str(n), t) for t, n in self.special.items()}
        self.kept, self.size = dict(self.known), 0

    def split(self, text: str) -> list[str | bytes]:
        """The words of a text: str of settled letters, bytes of others, special tokens as they are."""
        if "<|" in text:
            return [w for part in self.at_special.split(text) for w in ([part] if part in self.special else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str | bytes]:
        if text.isascii() or not UNSETTLED.search(text):
            return WORDS.findall(text.lower())
        return [bytes([self.byte[letter] for letter in word]) for word, _ in self.pre_tokenize(self.normalize(text))]

    def decode(self, ids: list[int]) -> str:
        """The text of token ids."""
        return " ".join([self.label_of[n] for n in ids])

    def encode_texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its decimal ids, joined by spaces, and what they decode to."""
        words = [self.split(text) for text in texts]
        if self.size > CACHE_BYTES:
            self.known, self.size = dict(self.kept), 0
        known = self.known
        if new := list({w for some in words for w in some if w not in known}):
            paths = self.automaton.encode_many([w if isinstance(w, bytes) else w.encode() for w in new])
            ids = self.ids
            for word, path in zip(new, paths, strict=True):
                numbers = [ids[t] for t in path]
                known[word] = found = (" ".join(map(str, numbers)), self.decode(numbers))
                self.size += len(word) + len(found[0]) + len(found[1]) + ENTRY_BYTES
        results = []
        for some in words:
            numbers, labels = zip(*map(known.__getitem__, some), strict=True) if some else ((), ())
            results.append((" ".join(numbers), " ".join(labels)))
        return results
