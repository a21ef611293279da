"""License scan: winnowed fingerprints of templates in an inverted index, then banded sequence alignment.

A text's words (letters and digits, lower case) are hashed in GRAM-word shingles, and winnowing keeps
the least of every WINNOW neighbours, so any run of GRAM + WINNOW - 1 equal words gives a common
fingerprint. The templates are known beforehand: their fingerprints and places form a small inverted
index that goes to every task. Where enough fingerprints of a template meet at about one shift, the
template is aligned with the words there, in a band; the alignment reports matched coverage and span.

The search is certain: a match may lack a tenth of the template's words and hold a tenth of others
(COVERAGE, DENSITY), which leaves so many fingerprints untouched as needed() says. A template too short
for any change at all is posted under its rarest fingerprint alone.

Words that tell licenses apart (names, variants, versions, negations) must agree in their order: what
lacks one, or holds one more, is no match however much else agrees.

A license's name alone is a template too, if words that lead to a license stand before it in its sentence.
Behind every notice the other members of an expression are read: "MIT OR Apache-2.0", "the MIT License and ISC".
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import LOWER, PUNCTUATION, Words, chunks, mix
from .license_templates import IDENTIFIERS, NAMED, TEMPLATES

GRAM, WINNOW = 2, 2
#: Least share of a template's words that must be there, and of a place's words that must be the template's.
COVERAGE = DENSITY = 0.9

# Words that tell licenses apart, and words that deny one when they stand before it.
TELLING = frozenset("affero agpl agplv3 apache artistic boost bsd by cc cc0 commons creative eclipse expat gnu gpl gplv2 gplv3 isc later lesser lgpl lgplv3 library mit modified mozilla nc nd never no noderivatives noncommercial not sa sharealike simplified unlicense wtfpl zero zlib".split())
DENYING = frozenset("aren cannot isn never not wasn without".split())

# Words that make the name after them another license's.
ALTERING = frozenset("affero clear documentation lesser library modified".split())

_FACTORS = np.random.default_rng(23).integers(0, 2**63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LATER = re.compile(rb"^[^.;\n]{0,80}?\blater\b")
_MORE_VERSION = re.compile(rb"^\.[1-9]")
#: What leads to a name in its sentence, the end of a sentence, and how far before the name both are looked for.
_LEADING = re.compile(rb"(?i)\b(?:(?:licen[cs]ed|released|distributed?|redistributed?|available|offered|provided|published|covered|governed)\b[^:]*\b(?:under|by)\b|licen[cs]es?\s*[:=]|spdx-license-identifier)")
_SENTENCE = re.compile(rb"[.!?;][\s\"')]+(?=[A-Z])|\n\s*\n")
_BEFORE = 200
#: A further member of an expression.
_MEMBER = re.compile(rb"(?i)\s*[,)]?\s*(with\b|and\b|or\b|/)\s*(?:(?:the|under)\s+)*\(?\s*([a-z0-9][a-z0-9.-]*[a-z0-9])(\+?)")


def led(before: bytes) -> bool:
    """Whether the bytes before a name lead to a license in the name's sentence, and don't deny it in the three words before the lead or the name."""
    sentence = _SENTENCE.split(before)[-1]
    lead = None
    for lead in _LEADING.finditer(sentence):
        pass
    if lead is None:
        return False
    near = [re.findall(rb"[0-9a-z]+", part.lower())[-3:] for part in (sentence[: lead.start()], sentence)]
    return not DENYING & {w.decode() for words in near for w in words}


def members(raw: np.ndarray, at: int, stop: int) -> list[tuple[str, int, int]]:
    """(identifier, first byte, end) of the further members of an expression, from the byte at, in a text that ends at stop.

    What follows WITH is an exception, no license.
    """
    out = []
    while m := _MEMBER.match(raw, at, stop):
        at = m.end()
        name = IDENTIFIERS.get(m[2].decode().lower())
        if m[1].lower() == b"with":
            continue
        if name is None:
            break
        if name.endswith("-only") and (m[3] or _LATER.match(bytes(raw[at : min(at + 100, stop)]))):
            name = name.removesuffix("-only") + "-or-later"
        out.append((name, m.start(2), m.end(2)))
    return out


def fingerprints(words: Words, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first words) of the winnowed shingles; a text with fewer than WINNOW shingles keeps its least. Shingles in also (sorted) are kept in any case."""
    n = np.maximum(np.diff(words.at) - GRAM + 1, 0)
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(words.at[:-1] - at[:-1], n) + np.arange(at[-1])
    h = np.zeros(len(first), np.uint64)
    for k in range(GRAM):
        h += words.hashes[first + k] * _FACTORS[k]
    h = mix(h)
    keep = np.zeros(len(h), bool)
    end = np.repeat(at[1:], n)
    i = np.arange(len(h))
    i = i[i + WINNOW <= end]
    best = i.copy()
    for k in range(1, WINNOW):
        best = np.where(h[i + k] <= h[best], i + k, best)
    keep[best] = True
    for t in np.flatnonzero((n > 0) & (n < WINNOW)):
        keep[at[t] + int(h[at[t] : at[t + 1]].argmin())] = True
    if also is not None and len(also):
        keep |= also[np.minimum(np.searchsorted(also, h), len(also) - 1)] == h
    return h[keep], first[keep]


def changes(m: int) -> tuple[int, int]:
    """How many of a template's m words may be missing, and how many others may stand between them."""
    lost = int(m * (1 - COVERAGE) + 1e-9)
    return lost, int(m / DENSITY - m + 1e-9)


def needed(m: int) -> int:
    """Fingerprints that every match of a template of m words has in common with it: its equal words form
    at most lost + other + 1 runs, and winnowing keeps at least every other shingle that begins in a run."""
    lost, other = changes(m)
    runs = lost + other + 1
    return max(1, -(-(m - lost - runs * (GRAM + WINNOW - 2)) // WINNOW))


def telling(words: list[str], digits: bool) -> list[str]:
    return [w for w in words if w in TELLING or (digits and w.isdigit())]


class Index:
    """The templates' words, and their fingerprints sorted, with template and place. Names are templates that ask for a lead before them."""

    def __init__(self, templates: tuple[tuple[str, str], ...], names: tuple[tuple[str, str], ...] = ()):
        self.bare = np.arange(len(templates) + len(names)) >= len(templates)
        templates += names
        self.names = [name for name, _ in templates]
        texts = [t.encode() for _, t in templates]
        raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        words = Words(raw, at, PUNCTUATION, LOWER)
        self.words = [words.hashes[a:b] for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
        spelled = [re.findall(r"[0-9a-z]+", t.decode().lower()) for t in texts]
        self.digits = [any(w.isdigit() for w in s) for s in spelled]
        self.telling = [telling(s, d) for s, d in zip(spelled, self.digits, strict=True)]
        self.rigid = np.array([changes(len(w)) == (0, 0) for w in self.words])
        h, first = fingerprints(words)
        template = np.searchsorted(words.at, first, "right") - 1
        # winnowing may pass over a shingle that is a template by itself
        self.single = np.unique(h[np.diff(words.at)[template] == GRAM])
        # of a template that allows no change all fingerprints are there or none: the rarest is enough
        often = Counter(h.tolist())
        rarest: dict[int, int] = {}
        for k, (x, t) in enumerate(zip(h.tolist(), template.tolist(), strict=True)):
            if t not in rarest or often[x] < often[int(h[rarest[t]])]:
                rarest[t] = k
        keep = ~self.rigid[template]
        keep[[k for t, k in rarest.items() if self.rigid[t]]] = True
        h, template, first = h[keep], template[keep], first[keep]
        order = np.argsort(h, kind="stable")
        self.hashes, self.template, self.place = h[order], template[order], (first - words.at[template])[order]
        self.need = np.array([1 if r else needed(len(w)) for r, w in zip(self.rigid, self.words, strict=True)])
        self.band = np.array([sum(changes(len(w))) for w in self.words])

    def meetings(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the fingerprint in h, number in the index) of all equal ones."""
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hit = np.flatnonzero(high > low)
        n = (high - low)[hit]
        ends = np.cumsum(n)
        return np.repeat(hit, n), np.repeat(low[hit] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)

    def places(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(text, template, least shift) where so many fingerprints meet within the band as a match has."""
        h, first = fingerprints(words, self.single)
        i, k = self.meetings(h)
        text, template = np.searchsorted(words.at, first[i], "right") - 1, self.template[k]
        shift = first[i] - words.at[text] - self.place[k]
        order = np.lexsort((shift, template, text))
        text, template, shift = text[order], template[order], shift[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (template[1:] != template[:-1])
        group = np.cumsum(new) << 40
        key = group + shift
        within = np.searchsorted(key, key + self.band[template], "right") - np.arange(len(key))
        last = None
        for t, m, s in ((int(text[x]), int(template[x]), int(shift[x])) for x in np.flatnonzero(within >= self.need[template])):
            if last is None or last[:2] != (t, m) or s > last[2] + self.band[m]:
                last = (t, m, s)
                yield last


@cache
def index_of(templates: tuple[tuple[str, str], ...], names: tuple[tuple[str, str], ...]) -> Index:
    """A worker's index; it outlives the task."""
    return Index(templates, names)


_ONE = 1 << 32


def align(template: np.ndarray, text: np.ndarray, shift: int, before: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(equal words, first, end in text), for each end, of the best alignment with template word i at text words i + shift - before to i + shift + after.

    The best has the most equal words less the other words between them; of equals the latest first word.
    """
    width = before + after + 1
    column = np.arange(width, dtype=np.int64)
    none = -_ONE
    state = np.full(width + 1, none, np.int64)  # by diagonal: score and first word; below 0: not begun
    tops = np.full(len(text) + 1, none, np.int64)
    for i in range(len(template)):
        j = column + i + shift - before
        inside = (j >= 0) & (j < len(text))
        equal = np.zeros(width, bool)
        equal[inside] = text[j[inside]] == template[i]
        # diagonal d of the row above stands for the same text word as d + 1 there; a template word left out costs nothing
        row = state[1:].copy()
        row[equal] = np.maximum(row[equal], np.maximum(state[:-1][equal] + _ONE, _ONE + j[equal]))
        # a text word left out costs one
        row = np.maximum.accumulate(row + column * _ONE) - column * _ONE
        tops[j[inside] + 1] = np.maximum(tops[j[inside] + 1], row[inside])
        state = np.append(row, none)
    end = np.flatnonzero(tops >= _ONE)
    begin = tops[end] % _ONE
    return (tops[end] // _ONE + end - begin) // 2, begin, end


def _scanner(templates: tuple[tuple[str, str], ...], names: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(templates, names)
        for rows, raw, at in chunks(batches):
            words = Words(raw, at, PUNCTUATION, LOWER)
            found: dict[int, list[tuple]] = {}
            for t, m, s in index.places(words):
                a, b = int(words.at[t]), int(words.at[t + 1])
                size, band = len(index.words[m]), int(index.band[m])
                if index.rigid[m]:
                    if s < 0 or a + s + size > b or not np.array_equal(words.hashes[a + s : a + s + size], index.words[m]):
                        continue
                    spans = [(size, s, s + size)]
                else:
                    low = max(0, s - band)
                    equal, begin, end = align(index.words[m], words.hashes[a + low : min(b, a + s + size + 2 * band)], s - low, band, 2 * band)
                    fine = (equal >= COVERAGE * size - 1e-9) & (equal >= DENSITY * (end - begin) - 1e-9)
                    spans = list(zip(equal[fine].tolist(), (begin[fine] + low).tolist(), (end[fine] + low).tolist(), strict=True))
                for equal, begin, end in spans:
                    own = slice(max(a, a + begin - 3), a + end)
                    spelled = [bytes(raw[p:q]).decode().lower() for p, q in zip(words.starts[own].tolist(), words.ends[own].tolist(), strict=True)]
                    inside, lead = spelled[begin - end :], spelled[: begin - end]
                    stop = int(words.ends[a + end - 1])
                    rest = bytes(raw[stop : min(stop + 100, int(at[t + 1]))])
                    if telling(inside, index.digits[m]) != index.telling[m] or DENYING & set(lead) or (inside[-1].isdigit() and _MORE_VERSION.match(rest)):
                        continue
                    start = int(words.starts[a + begin])
                    if index.bare[m] and (ALTERING & set(lead[-1:]) or not led(bytes(raw[max(int(at[t]), start - _BEFORE) : start]))):
                        continue
                    name = index.names[m]
                    if name.endswith("-only") and (rest.startswith(b"+") or _LATER.match(rest)):
                        name = name.removesuffix("-only") + "-or-later"
                    for other, p, q in members(raw, stop, int(at[t + 1])) if names else ():
                        # the first and the end of the member's words; it counts as a whole match of them
                        p, q = int(np.searchsorted(words.starts, p)) - a, int(np.searchsorted(words.starts, q)) - a
                        found.setdefault(t, []).append((q - p, 1.0, 1.0, m, p, q, other))
                    found.setdefault(t, []).append((equal, equal / size, equal / (end - begin), m, begin, end, name))
            out = []
            for t, spans in found.items():
                kept: list[tuple] = []
                for x in sorted(spans, key=lambda x: (-x[0] * x[2], -x[1], x[3], x[4])):
                    if all(x[5] <= y[4] or y[5] <= x[4] for y in kept):
                        kept.append(x)
                base, ids = int(words.at[t]), rows.column("doc_id")[t].as_py()
                for equal, share, _, m, begin, end, name in kept:
                    p, q = int(words.starts[base + begin] - at[t]), int(words.ends[base + end - 1] - at[t])
                    lead = bytes(raw[at[t] : at[t] + q])
                    out.append((ids, name, m, equal, round(share, 6), begin, end, len(lead[:p].decode()), len(lead.decode())))
            if out:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "license", "template", "matched_words", "coverage", "first_word", "end_word", "first_char", "end_char"])

    return run


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, names: tuple[tuple[str, str], ...] = NAMED) -> DataFrame:
    """A row for each place of docs (doc_id, text; other columns are ignored) where a template stands, a name that is led to, or a further member of its expression.

    license, template (its number, names after templates; a member has that of what it follows), matched_words, coverage (of the template's words), and the span in words and
    in characters, ends excluded. Of overlapping places the one with the most words, least interrupted, stays; a GNU license
    of one version that is followed by "or later" in its sentence is the one for later versions. Null and
    empty texts have none; repeated rows are scanned each; a null doc_id stays null. Every word of a text is read.
    An empty table gives an empty result.
    """
    schema = "doc_id long, license string, template int, matched_words int, coverage double, first_word long, end_word long, first_char long, end_char long"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_scanner(templates, names), schema)
