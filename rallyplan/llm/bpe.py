"""Byte-pair encoding by a tokenization automaton (operator 7) and token counts (operator 9).

Automaton. Start with one state that loops on every byte. Apply the merges in
order; merge (u, v) -> w puts this gadget in: the state entered by u loses its
arc v (on a copy, as other tokens may share the state), and every state that
still has an arc u gets an arc w into the state that v enters. The state that a
token enters depends on that token alone, so a state is named by its last token,
and a word's tokenization is the one path through the automaton that spells it.

The explicit automaton of the 50,000 merges has too many arcs to be held (README:
measured), so the compiled form keeps what makes them: for every token its merge's
rank and two parts, and the table of merged pairs. ``Automaton.arc`` unwinds the
gadgets that touch one (state, label) and memoises the answer in a transition table
of bounded size. The tests compare it with the explicit construction.

Encoding is one pass over the bytes of a pre-split word, without a step back. A
second table, of the vocabulary's strings (trie nodes by byte, with the node of the
longest proper suffix), leads from byte to byte and gives the labels that end there.
Every prefix of a word has one path, so of these labels exactly one has an arc from
the state that its own start is in; this state is stored for the place.
Decoding concatenates the labels of the arcs.

Defined results: null and empty texts have no tokens (the digest of no bytes);
repeated rows give repeated rows; an empty table gives an empty table; further
columns of the input are ignored. A word of any length takes time in proportion
to its length (times the labels that end at a place), memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from rallyplan.llm.common import per_text

#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points outside these ranges may be classed otherwise by another Unicode version; such texts are split by the library.
SETTLED = re.compile("[^\x00-՗Ḁ-₎₠-₿℀-↋←-⏿─-⭳　-〃ぁ-ゖァ-ヺ一-鿪가-힣]")
#: Words that a process remembers, twice over: those met lately, and those met before them.
MEMO = 250_000
FOREVER = 1 << 60
#: Entries of the transition table, some 50 MB, that a process holds; then it is begun anew.
ARCS = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled merge gadgets. Tokens are numbered by age: 0-255 are bytes, 256 + k comes from merge k."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.labels: list[bytes] = [bytes([b]) for b in range(256)]
        self.number: dict[bytes, int] = {x: i for i, x in enumerate(self.labels)}
        self.left, self.right = list(range(256)), list(range(256))
        self.merged: dict[tuple[int, int], int] = {}
        for u, v in merges:
            self.put_gadget(u, v)
        self.arcs: dict[int, bool] = {}
        self.compile_strings()

    def compile_strings(self) -> None:
        """The table of the labels' strings: node * 256 + byte -> node, and for each node the labels that end there, longest first."""
        self.step: dict[int, int] = {}
        own: list[int] = [-1]  # the label that the node spells
        for label, text in enumerate(self.labels):
            node = 0
            for byte in text:
                node = self.step.setdefault(node * 256 + byte, len(own))
                if node == len(own):
                    own.append(-1)
            own[node] = label
        # nodes by depth: the longest proper suffix that is a node, too
        self.shorter = [0] * len(own)
        self.ends: list[tuple[int, ...]] = [()] * len(own)
        children: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, node in self.step.items():
            children[key >> 8].append((key & 255, node))
        queue = [0]
        for node in queue:
            for byte, child in children[node]:
                at = self.shorter[node]
                while at and at * 256 + byte not in self.step:
                    at = self.shorter[at]
                if node:
                    self.shorter[child] = self.step.get(at * 256 + byte, 0)
                self.ends[child] = ((own[child],) if own[child] >= 0 else ()) + self.ends[self.shorter[child]]
                queue.append(child)

    def put_gadget(self, u: bytes, v: bytes) -> None:
        """Put in the gadget of the next merge."""
        a, b, w = self.number[u], self.number[v], len(self.labels)
        if u + v in self.number:
            raise ValueError(f"two merges make {u + v!r}")
        self.merged[a, b] = w
        self.labels.append(u + v)
        self.number[u + v] = w
        self.left.append(a)
        self.right.append(b)

    def arc(self, state: int, label: int) -> bool:
        """Does the state entered by token ``state`` have an arc ``label``?"""
        known = self.arcs.get(state << 20 | label)
        if known is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            known = self.arcs[state << 20 | label] = self._unwind(state, label)
        return known

    def _unwind(self, state: int, label: int) -> bool:
        before = FOREVER  # gadgets from this one on don't count
        while True:
            gadget = self.merged.get((state, label))
            if gadget is not None and gadget < before:
                return False  # that gadget took the arc away
            if state > label and state > 255:
                before, state = state, self.right[state]  # the state began as the one its right part entered
            elif label > 255:
                before, label = label + 1, self.left[label]  # the arc came with an arc of its left part, after the removal
            else:
                return True

    def encode(self, word: bytes) -> list[int]:
        """Labels of the path that spells word."""
        step, shorter, ends, labels, arc = self.step, self.shorter, self.ends, self.labels, self.arc
        last = [-1] * (len(word) + 1)  # the state after each place: the last label of the path that spells what is before it
        node = 0
        for place, byte in enumerate(word, 1):
            while (found := step.get(node * 256 + byte)) is None:
                node = shorter[node]
            node = found
            for label in ends[node]:
                before = place - len(labels[label])
                if not before or arc(last[before], label):
                    last[place] = label
                    break
        path, place = [], len(word)
        while place:
            path.append(last[place])
            place -= len(labels[last[place]])
        return path[::-1]


def merge_word(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The plain definition: join the pair of lowest rank, leftmost first, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 400:  # a long word goes by a queue, to stay off the square
        return _merge_long(parts, ranks)
    of = ranks.get
    rank = [of(p, FOREVER) for p in zip(parts, parts[1:], strict=False)]
    while rank:
        least = min(rank)
        if least == FOREVER:
            break
        at = rank.index(least)
        joined = parts[at] = parts[at] + parts.pop(at + 1)
        del rank[at]
        if at:
            rank[at - 1] = of((parts[at - 1], joined), FOREVER)
        if at < len(rank):
            rank[at] = of((joined, parts[at + 1]), FOREVER)
    return parts


def _merge_long(parts: list[bytes], ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    import heapq

    after, before, alive = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), [True] * len(parts)
    queue = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i] if alive[i] else len(parts)
        if j >= len(parts) or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else len(parts)
            if left >= 0 and right < len(parts) and (pair := (parts[left], parts[right])) in ranks:
                heapq.heappush(queue, (ranks[pair], left, *pair))
    return [p for p, x in zip(parts, alive, strict=True) if x]


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: merges, ids, special strings and the splitter."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.path = path
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = [(raw(a), raw(b)) for a, b in pairs]
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._split = regex.compile(PATTERN).findall
        self._library = None

    def sections(self, text: str) -> list[str]:
        """Plain text and special strings by turns, as the library cuts them."""
        if self._special is None or not any(x in text for x in self.special):
            return [text]
        return self._special.split(text)

    def words(self, text: str) -> list[str]:
        """Pre-split words of a section without special strings."""
        if SETTLED.search(text) is None:
            return self._split(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once a process."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def automaton(path: str) -> tuple[Automaton, np.ndarray, list[bytes]]:
    """The automaton, the vocabulary id of each label, and the label bytes by id."""
    v = vocabulary(path)
    machine = Automaton(v.merges)
    ids = np.array([v.ids[x] for x in machine.labels], "<u4")
    by_id = {int(i): x for i, x in zip(ids, machine.labels, strict=True)} | {i: s.encode() for s, i in v.special.items()}
    return machine, ids, [by_id.get(i, b"") for i in range(max(by_id) + 1)]


class Memo(dict):
    """word -> something made from it; forgets words that weren't met for a while."""

    def __init__(self, make, first: dict | None = None):
        self.make, self.first = make, first or {}
        self.old: dict = {}
        self.update(self.first)

    def __missing__(self, word: str):
        if len(self) > MEMO + len(self.first):
            self.old = dict(self)
            self.clear()
            self.update(self.first)
        made = self.old.get(word)
        if made is None:
            made = self.make(word.encode())
        if len(word) < 256:
            self[word] = made
        return made


@lru_cache(maxsize=2)
def word_ids(path: str) -> Memo:
    """word -> its ids, packed as little-endian unsigned 32-bit integers; one memo a process."""
    machine, ids, _ = automaton(path)
    packed = [i.tobytes() for i in ids]
    return Memo(lambda word: b"".join([packed[x] for x in machine.encode(word)]))


class Codec:
    """Encode and decode whole texts."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.memo = word_ids(path)
        self.arc_labels = automaton(path)[2].__getitem__

    def encode(self, text: str) -> bytes:
        """Packed ids of the text."""
        v, of, out = self.vocabulary, self.memo.__getitem__, []
        for i, section in enumerate(v.sections(text)):
            if i % 2:
                out.append(v.special[section].to_bytes(4, "little"))
            elif section:
                out.extend(map(of, v.words(section)))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """Emit the label of each arc; bytes that aren't UTF-8 become U+FFFD, as in the library."""
        return b"".join(map(self.arc_labels, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def row():
        codec = Codec(path)

        def of(raw: bytes) -> tuple:
            packed = codec.encode(raw.decode("utf-8", "replace"))
            decoded = codec.decode(packed).encode()
            return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return of

    return per_text(docs, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def tokenize_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the token ids themselves, for a training run."""

    def row():
        codec = Codec(path)
        return lambda raw: (np.frombuffer(codec.encode(raw.decode("utf-8", "replace")), "<u4").astype("i4"),)

    return per_text(docs, key, text, "token_ids array<int>", row)


@lru_cache(maxsize=2)
def proven_singles(path: str) -> frozenset[bytes]:
    """Vocabulary strings whose own merges end in one token: each is merged from its bytes, before any text is read."""
    v = vocabulary(path)
    ranks = {pair: i for i, pair in enumerate(v.merges)}
    return frozenset(x for x in v.ids if len(merge_word(x, ranks)) == 1)


@lru_cache(maxsize=2)
def word_counts(path: str, singles: frozenset[bytes]) -> Memo:
    """word -> number of tokens: the proven singles at once, the rest by merging; one memo a process."""
    ranks = {pair: i for i, pair in enumerate(vocabulary(path).merges)}
    words = {}
    for x in singles:
        try:
            words[x.decode()] = 1
        except UnicodeDecodeError:
            pass  # part of a character: never a whole word
    return Memo(lambda word: len(merge_word(word, ranks)), words)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    Special strings inside a text count as one token each, as the library takes
    them by default. Null and empty texts have 0 bytes and 0 tokens. The proof is done
    once, before any text is read; tasks get the proven strings (as many as the vocabulary has at most).
    """
    singles = proven_singles(path)

    def row():
        v, of_word = vocabulary(path), word_counts(path, singles).__getitem__

        def of(raw: bytes) -> tuple:
            n = 0
            for i, section in enumerate(v.sections(raw.decode("utf-8", "replace"))):
                n += 1 if i % 2 else sum(map(of_word, v.words(section)))
            return len(raw), n, n > limit

        return of

    return per_text(docs, key, text, "n_bytes long, n_tokens long, over_limit boolean", row)
