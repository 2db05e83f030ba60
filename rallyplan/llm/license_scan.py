"""Licence scan by a positional rare-token index (operator 1).

``license_texts`` has licence notices and texts, each with the key phrases that
must stand in it. A first pass counts in how many documents each template word
occurs (all documents; the table it makes is as long as the templates'
vocabulary). The index has the postings (template, position) of each template's
words of highest IDF: as many as leave no more than ``BESIDE`` of its weight to the
others, so every place that holds ``LEAST_SHARE`` of a template holds indexed words
worth LEAST_SHARE - BESIDE, and none is missed.

A file's licence words of highest IDF, those in the index, fetch their postings;
every posting votes with its weight for a relative position (place in the text less
place in the template). Positions are intersected within ``DRIFT`` words, so that a
few words put in or left out don't part a text from its template. Where the votes
can still reach LEAST_SHARE, all of the template's words are compared at that
position, and the key phrases have to stand there word for word.

Base phrases are found apart from that, at every place.

Defined results: a null or empty text has no words, no labels and score 0;
equal labels appear once; repeated rows give repeated rows; an empty table gives
an empty table; other columns of the input are ignored. Work on a text grows
with the number of its template words, in memory too.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyplan.llm.common import folded_words, per_text, raw_texts, slices
from rallyplan.llm.license_texts import NOTICES, TEXTS

#: Phrase -> label; found wherever the words stand consecutively. Fixed values.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, words, key phrases in words).
TEMPLATES = [(label, folded_words(text.encode()), [folded_words(k.encode()) for k in keys]) for label, text, keys in NOTICES + TEXTS]
#: Weighted share of a template's words that must fall together, and the share that words may have that aren't indexed.
LEAST_SHARE, BESIDE = 0.6, 0.25
#: Words by which a part of a text may stand further on than the template says.
DRIFT = 3


class Index:
    """Postings of the templates' rarest words: word -> (template, position)."""

    def __init__(self, documents: int, holding: dict[bytes, int]):
        self.labels = [label for label, _, _ in TEMPLATES]
        self.words = [words for _, words, _ in TEMPLATES]
        self.keys = [keys for _, _, keys in TEMPLATES]
        self.number = {w: i for i, w in enumerate(sorted({w for words in self.words for w in words}))}
        self.idf = {w: math.log(1 + (documents + 1) / (1 + holding.get(w, 0))) for w in self.number}
        self.ids = [np.array([self.number[w] for w in words]) for words in self.words]
        self.mass = [np.array([self.idf[w] for w in words]) for words in self.words]
        self.weight = [float(x.sum()) for x in self.mass]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        #: Weight of a template that its words in the index don't have.
        self.beside: list[float] = []
        for t, words in enumerate(self.words):
            rest, of = self.weight[t], Counter(words)
            for w in sorted(of, key=lambda w: (-self.idf[w], w)):
                if rest <= BESIDE * self.weight[t]:
                    break
                rest -= of[w] * self.idf[w]
                self.postings[w] += [(t, i) for i, x in enumerate(words) if x == w]
            self.beside.append(rest)

    def starts(self, at: dict[bytes, list[int]]) -> dict[int, np.ndarray]:
        """template -> places where it may start: votes within DRIFT words, and what isn't indexed, reach LEAST_SHARE."""
        votes: dict[int, Counter] = defaultdict(Counter)
        for w, places in at.items():
            for t, i in self.postings.get(w, ()):
                own, weight = votes[t], self.idf[w]
                for p in places:
                    own[p - i] += weight
        out = {}
        for t, of in votes.items():
            offsets = np.array(sorted(of))
            sums = np.concatenate(([0.0], np.cumsum([of[x] for x in offsets.tolist()])))
            first = np.unique((offsets[:, None] - np.arange(DRIFT + 1)).ravel())
            got = sums[np.searchsorted(offsets, first + DRIFT, side="right")] - sums[np.searchsorted(offsets, first)]
            able = first[got + self.beside[t] >= LEAST_SHARE * self.weight[t] - 1e-9]
            if len(able):
                out[t] = able
        return out

    def find(self, words: list[bytes], at: dict[bytes, list[int]]) -> dict[str, tuple[float, int, int]]:
        """label -> (share, first word, last word) of the templates that stand in words; at: places of template words."""
        found: dict[str, tuple[float, int, int]] = {}
        starts = self.starts(at)
        if not starts:
            return found
        longest = max(map(len, self.words)) + DRIFT
        seen = np.full(len(words) + 2 * longest, -1)  # the text's template words by number, with a margin
        for w, places in at.items():
            if w in self.number:
                seen[np.array(places) + longest] = self.number[w]
        for t, of in starts.items():
            own, n = self.ids[t], len(self.ids[t])
            for start in of.tolist():
                low = max(start + longest, 0)
                part = seen[low : low + n + DRIFT]
                hits = np.logical_or.reduce([part[d : d + n] == own for d in range(DRIFT + 1)])
                share = float(self.mass[t][hits].sum()) / self.weight[t]
                if share < LEAST_SHARE or not all(self.stands(words, k, start, n + DRIFT) for k in self.keys[t]):
                    continue
                places = np.flatnonzero(hits)
                best = (round(share, 9), start + int(places[0]), start + int(places[-1]))
                found[self.labels[t]] = max(found.get(self.labels[t], best), best)
        return found

    @staticmethod
    def stands(words: list[bytes], phrase: list[bytes], start: int, length: int) -> bool:
        """Does the phrase stand word for word within the template's place?"""
        n = len(phrase)
        return any(words[i : i + n] == phrase for i in range(max(0, start), start + length - n + 1))


def vocabulary() -> set[bytes]:
    return {w for _, words, _ in TEMPLATES for w in words}


def document_counts(docs: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each template word; the result is as long as the templates' vocabulary."""
    known = vocabulary()

    def run(batches):
        total, held = 0, Counter()
        for batch in slices(batches):
            for raw in raw_texts(batch.column(0)):
                total += 1
                held.update(known.intersection(folded_words(raw)))
        held[b""] = total
        yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "held"])

    rows = docs.select(text).mapInArrow(run, "word string, held long").groupBy("word").agg(F.sum("held").alias("held")).collect()
    held = {r.word.encode(): r.held for r in rows}
    return held.pop(b"", 0), held


def phrase_places(words: list[bytes], at: dict[bytes, list[int]]) -> list[tuple[int, str]]:
    """(word index, label) of every place of every base phrase."""
    out = []
    for phrase, label in BASE_PHRASES.items():
        own = phrase.encode().split()
        n = len(own)
        out += [(i, label) for i in at.get(own[0], ()) if words[i : i + n] == own]
    return sorted(out)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    score: 1 with a base place, else the largest share of a template found, else 0.
    """
    documents, held = document_counts(docs, text)
    known = vocabulary() | {w for p in BASE_PHRASES for w in p.encode().split()}

    def row():
        index = Index(documents, held)
        needed = set(index.postings) | {p.encode().split()[0] for p in BASE_PHRASES}

        def of(raw: bytes) -> tuple:
            words = folded_words(raw)
            if needed.isdisjoint(words):
                return len(words), 0, None, None, "", "", 0.0
            at: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(words):
                if w in known:
                    at[w].append(i)
            places = phrase_places(words, at)
            found = index.find(words, at)
            base = sorted({label for _, label in places})
            labels = sorted({*base, *found})
            score = 1.0 if base else round(max((s for s, _, _ in found.values()), default=0.0), 6)
            first, last = (places[0][0], places[-1][0]) if places else (None, None)
            return len(words), len(places), first, last, ",".join(base), ",".join(labels), min(1.0, score)

        return of

    return per_text(docs, key, text, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", row)
