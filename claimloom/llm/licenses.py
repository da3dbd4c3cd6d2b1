"""License scans by a generalised suffix automaton of template tokens.

The automaton accepts every run of consecutive tokens of every template and
knows all places where it stands. A text's tokens stream through it and yield
matching statistics: at each token the longest run ending there that some
template contains; suffix links give the shorter runs that other templates or
places share. Runs of `least` tokens or more are chained in the order of text
and template into covered spans. A token weighs the more the fewer labels have
it in a template, so that words all licences use don't make one; the share of a
template's weight that its best chain covers is its score.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, column, slices, tidy, utf8
from .license_texts import PHRASES, TEMPLATES
from .words import U, digest, words

#: Bytes that part words (all of ASCII but digits and letters) become spaces, capitals small letters.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_ROUNDING = 1e-10
Run = tuple[int, int, int]  # start in the text, start in the template, tokens
Span = tuple[int, int, int, int]  # start and end in the text, start and end in the template


def tokens(text: str) -> list[int]:
    return [int.from_bytes(digest(w)[:8], "little") for w in text.encode().translate(TABLE).split()]


@dataclass
class Automaton:
    """Generalised suffix automaton over token hashes; each state knows every (template, end) where it stands."""

    edges: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _new(self, length: int) -> int:
        self.edges.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.edges) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.edges[clone], self.link[clone] = dict(self.edges[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.edges[p].get(token) == q:
            self.edges[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, template: int, sequence: Sequence[int]) -> None:
        last = 0
        for place, token in enumerate(sequence):
            known = self.edges[last].get(token)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, known, token)
            else:
                state, p = self._new(self.length[last] + 1), last
                while p >= 0 and token not in self.edges[p]:
                    self.edges[p][token] = state
                    p = self.link[p]
                if p >= 0:
                    q = self.edges[p][token]
                    self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
                last = state
            self.ends[last].add((template, place + 1))

    def finish(self) -> None:
        """A state stands wherever the states that link to it stand."""
        for state in sorted(range(1, len(self.edges)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def statistics(self, sequence: Sequence[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest run ending at each token."""
        state = size = 0
        out = []
        for token in sequence:
            while state and token not in self.edges[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.edges[state]:
                state, size = self.edges[state][token], size + 1
            else:
                state = size = 0
            out.append((size, state))
        return out

    def standing(self, state: int, size: int, least: int) -> dict[tuple[int, int], int]:
        """Every (template, end) where the last `least` tokens or more stand, with the number of tokens."""
        out = dict.fromkeys(self.ends[state], size)
        state = self.link[state]
        while state > 0 and self.length[state] >= least:
            for place in self.ends[state]:
                out.setdefault(place, self.length[state])
            state = self.link[state]
        return out

    def runs(self, sequence: Sequence[int], least: int) -> dict[int, list[Run]]:
        """By template, the maximal runs of `least` tokens or more that it has in common with the sequence."""
        found: dict[tuple[int, int, int], int] = {}  # template, start in the text and in the template: tokens
        for place, (size, state) in enumerate(self.statistics(sequence)):
            if size >= least:
                for (template, end), n in self.standing(state, size, least).items():
                    found[template, place + 1 - n, end - n] = n
        out: dict[int, list[Run]] = {}
        for (template, a, c), n in found.items():
            out.setdefault(template, []).append((a, c, n))
        return out


def chain(runs: Sequence[Run], size: int, gap: int) -> list[tuple[int, int]]:
    """The most (text, template) tokens of the runs in strictly rising order, at most `gap` text tokens apart.

    A sweep over the text: at each token the best chain that ends below each
    template place comes from the last gap + 1 tokens' prefix maxima.
    """
    by_place: dict[int, set[int]] = {}
    for a, c, n in runs:
        for k in range(n):
            by_place.setdefault(a + k, set()).add(c + k)
    cells: list[tuple[int, int, int]] = []  # text, template, number of the cell before
    window: deque[tuple[int, np.ndarray, np.ndarray]] = deque()
    best, last = 0, -1
    for i in sorted(by_place):
        while window and window[0][0] < i - gap - 1:
            window.popleft()
        js = np.array(sorted(by_place[i]))
        value, before = np.ones(len(js), np.int64), np.full(len(js), -1)
        if window:
            below = np.stack([w[1][js] for w in window])
            row = below.argmax(0)
            top = below[row, np.arange(len(js))]
            who = np.stack([w[2][js] for w in window])[row, np.arange(len(js))]
            value, before = value + top, np.where(top > 0, who, -1)
        own, name = np.zeros(size + 1, np.int64), np.full(size + 1, -1)
        own[js + 1] = value
        name[js + 1] = len(cells) + np.arange(len(js))
        cells += zip([i] * len(js), js.tolist(), before.tolist(), strict=True)
        up = np.maximum.accumulate(own)
        at = np.maximum.accumulate(np.where((own == up) & (own > 0), np.arange(size + 1), 0))
        window.append((i, up, name[at]))
        if up[-1] > best:
            best, last = int(up[-1]), int(name[at[-1]])
    out = []
    while last >= 0:
        i, j, last = cells[last]
        out.append((i, j))
    return out[::-1]


def spans(cells: Sequence[tuple[int, int]]) -> list[Span]:
    """Cells that follow each other in both text and template as one span each."""
    out: list[list[int]] = []
    for i, j in cells:
        if out and out[-1][1] == i and out[-1][3] == j:
            out[-1][1] += 1
            out[-1][3] += 1
        else:
            out.append([i, i + 1, j, j + 1])
    return [tuple(s) for s in out]


@dataclass
class Scanner:
    automaton: Automaton
    labels: list[str]
    sizes: list[int]
    weights: list[np.ndarray]  # of each template's tokens, 1 together
    vocabulary: np.ndarray
    phrases: list[tuple[str, list[int]]]
    least: int
    share: float
    gap: int


def build(templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, least: int = 3, share: float = 0.6, gap: int = 12) -> Scanner:
    """least: tokens of a long match; share: of a template's weight to report it; gap: text tokens between matches of one chain.

    Templates and phrases are (label, text); several may have one label. A
    template of fewer than `least` tokens is never found.
    """
    automaton = Automaton()
    found = [tokens(text) for _, text in templates]
    for k, sequence in enumerate(found):
        automaton.add(k, sequence)
    automaton.finish()
    having: dict[int, set[str]] = {}
    for (label, _), sequence in zip(templates, found, strict=True):
        for token in sequence:
            having.setdefault(token, set()).add(label)
    every = len({label for label, _ in templates})
    weights = [np.log([(1 + every) / len(having[t]) for t in s]) for s in found]
    weights = [w / w.sum() if len(w) else w for w in weights]
    vocabulary = np.unique(np.array([h for s in found for h in s], U))
    return Scanner(automaton, [label for label, _ in templates], [len(s) for s in found], weights, vocabulary, [(label, tokens(text)) for label, text in phrases], least, share, gap)


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def covered(sequence: np.ndarray, known: np.ndarray, scanner: Scanner) -> list[tuple[str, float, list[Span]]]:
    """(label, share, spans) of each label found; known flags tokens that some template has.

    Where chains of several labels claim the same tokens, the one that covers
    more stays (then the larger share, then the smaller label) and one that has
    more than half of its tokens there goes.
    """
    runs: dict[int, list[Run]] = {}
    for a, b in _stretches(known):
        if b - a >= scanner.least:  # no match leaves its stretch of known tokens
            for template, own in scanner.automaton.runs(sequence[a:b].tolist(), scanner.least).items():
                runs.setdefault(template, []).extend((a + x, y, n) for x, y, n in own)
    claims = []
    for template, own in runs.items():
        weights = scanner.weights[template]
        if weights[list({c + k for _, c, n in own for k in range(n)})].sum() >= scanner.share - _ROUNDING:
            cells = chain(own, scanner.sizes[template], scanner.gap)
            share = min(1.0, float(weights[[j for _, j in cells]].sum()) + _ROUNDING)
            if share >= scanner.share:
                claims.append((-len(cells), -round(share, 9), scanner.labels[template], cells))
    out: dict[str, tuple[float, list[Span]]] = {}
    owner: dict[int, str] = {}
    for n, share, label, cells in sorted(claims):
        if 2 * sum(owner.get(i, label) != label for i, _ in cells) <= -n:
            if -share > out.get(label, (0.0, []))[0]:
                out[label] = -share, spans(cells)
            for i, _ in cells:
                owner.setdefault(i, label)
    return [(label, share, own) for label, (share, own) in sorted(out.items())]


def _scan(scanner: Scanner, batches: Batches) -> Batches:
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        for a, b in slices(offsets, 2 << 20):
            out = scan_rows(scanner, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.record_batch([batch.column(0).slice(a, b - a), *out], _COLUMNS)


_COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans"]
_FIELDS = ["label", "start", "stop", "template_start", "template_stop"]
_SPANS = pa.list_(pa.struct([("label", pa.string()), *((f, pa.int64()) for f in _FIELDS[1:])]))


def scan_rows(scanner: Scanner, raw: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    rows = len(offsets) - 1
    found = words(raw, offsets, TABLE)
    hashes = found.hashes
    counts = found.counts(rows)
    starts = np.concatenate([[0], np.cumsum(counts)])
    place, row, label = [], [], []
    for k, (_, sequence) in enumerate(scanner.phrases):
        n = len(sequence)
        if len(hashes) < n or not n:
            continue
        hit = found.row[n - 1 :] == found.row[: len(hashes) - n + 1]
        for j, h in enumerate(sequence):
            hit &= hashes[j : len(hashes) - n + 1 + j] == U(h)
        at = np.flatnonzero(hit)
        place.append(at)
        row.append(found.row[at])
        label.append(np.full(len(at), k))
    place, row, label = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (place, row, label))
    n_base = np.bincount(row, minlength=rows)
    first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    np.minimum.at(first, row, place - starts[row])
    np.maximum.at(last, row, place - starts[row])
    base: list[set[str]] = [set() for _ in range(rows)]
    for r, k in zip(row.tolist(), label.tolist(), strict=True):
        base[r].add(scanner.phrases[k][0])
    at = np.minimum(np.searchsorted(scanner.vocabulary, hashes), max(0, len(scanner.vocabulary) - 1))
    known = scanner.vocabulary[at] == hashes if len(scanner.vocabulary) else np.zeros(len(hashes), bool)
    # Only rows with `least` known tokens in a row can hold a long match.
    dense = known.copy()
    for j in range(1, scanner.least):
        after = np.zeros(len(known), bool)
        after[: max(0, len(known) - j)] = known[j:] & (found.row[j:] == found.row[: max(0, len(known) - j)])
        dense &= after
    labels, scores, own_spans = [set(b) for b in base], np.array([1.0 if b else 0.0 for b in base]), [[] for _ in base]
    for r in np.unique(found.row[dense]).tolist():
        own = slice(starts[r], starts[r + 1])
        for name, share, covers in covered(hashes[own], known[own], scanner):
            labels[r].add(name)
            scores[r] = max(scores[r], share)
            own_spans[r] += [dict(zip(_FIELDS, (name, *s), strict=True)) for s in covers]
    some = n_base > 0
    return [
        pa.array(counts), pa.array(n_base), pa.array(first, mask=~some), pa.array(last, mask=~some),
        pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(scores), pa.array(own_spans, _SPANS),
    ]


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, license_spans for each row.

    license_spans: (label, start, stop, template_start, template_stop) in words,
    ends exclusive, of the method's labels. Null, empty and blank texts have no
    words, no labels, no spans and score 0. Overlapping places of phrases all
    count. Repeated rows give repeated rows; other columns are ignored. An empty
    table gives an empty table. The score is 1 with a base phrase, else the
    largest share of a template's weight that is covered, from scanner.share up, else 0.
    """
    scanner = scanner or build()
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, license_spans array<struct<label:string,start:bigint,stop:bigint,template_start:bigint,template_stop:bigint>>"
    return rows.mapInArrow(tidy(_scan, scanner), schema)
