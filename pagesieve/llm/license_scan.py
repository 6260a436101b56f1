"""License scan: ordered signature rules over the words of every document.

A rule is a regular expression over whole words. Licences have names, written as
expressions below, and there are ways to put a name into a sentence; every licence in
every way is one rule. A way has a priority: a denied licence outranks an identifier in a
header, that outranks a grant, and so on down to a mere mention.

A rule runs only on documents that hold its keywords. What the rules find are intervals of words. An interval inside another
one goes if the other is of higher priority, or of equal priority and longer, or equal in
both and of an earlier rule; so "lesser general public license" is not also "general
public license", and the grant of a licence that is denied counts for nothing. What is
left gives labels; the score is the greatest confidence among them.

The base phrases are exact runs of words. Their labels stay whatever the rules say.

Defined results
    null or empty text          no words, no labels, score 0
    repeated rows, null ids     every row is scanned by itself and comes back once
    very long texts             scanned whole
    matches of one rule         leftmost first, without overlap; of a base phrase, all places
    columns of the same name    replaced by the new ones
    empty table                 no rows
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagesieve.llm.arrow import parts, text_bytes

#: Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: A licence: label, its name as an expression over words, and keywords, words or parts of
#: words. Every spelling of the name holds all keywords of one of the alternatives.
LICENCES = (
    ("mit", "mit(?: x11| expat)?", "mit"),
    ("mit-0", "mit(?: no attribution| 0)", "mit"),
    ("apache-1.1", "apache(?: software)?(?: licen[cs]e)?(?: version)?(?: v1| 1) 1", "apache"),
    ("apache-2", "apache(?: software)?(?: licen[cs]e)?(?: version)?(?: v2| 2)(?: 0)?", "apache"),
    ("apache", "apache(?: software)?", "apache"),
    ("gpl-1", "(?:gnu )?(?:gpl|general public licen[cs]e)(?: version)?(?: v1| 1)(?: 0)?", "gpl|general public"),
    ("gpl-2", "(?:gnu )?(?:gpl|general public licen[cs]e)(?: version)?(?: v2| 2)(?: 0)?", "gpl|general public"),
    ("gpl-3", "(?:gnu )?(?:gpl|general public licen[cs]e)(?: version)?(?: v3| 3)(?: 0)?", "gpl|general public"),
    ("gpl", "(?:gnu )?(?:gpl|gplv[23]|general public licen[cs]e)", "gpl|general public"),
    ("lgpl-2", "(?:gnu )?(?:lgpl|library general public licen[cs]e)(?: version)?(?: v2| 2)(?: 0)?", "lgpl|lesser general|library general"),
    ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version)?(?: v2| 2) 1", "lgpl|lesser general|library general"),
    ("lgpl-3", "(?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version)?(?: v3| 3)(?: 0)?", "lgpl|lesser general|library general"),
    ("lgpl", "(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)", "lgpl|lesser general|library general"),
    ("agpl-3", "(?:gnu )?(?:agpl|affero general public licen[cs]e)(?: version)?(?: v3| 3)(?: 0)?", "agpl|affero"),
    ("agpl", "(?:gnu )?(?:agpl|affero general public licen[cs]e)", "agpl|affero"),
    ("gfdl", "(?:gnu )?(?:gfdl|free documentation licen[cs]e)(?: version)?(?: 1(?: [123])?)?", "gfdl|documentation"),
    ("bsd-2-clause", "(?:(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause)", "bsd"),
    ("bsd-3-clause", "(?:(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause)", "bsd"),
    ("bsd-4-clause", "(?:(?:original|4 clause|four clause) bsd|bsd 4 clause)", "bsd"),
    ("0bsd", "(?:0bsd|(?:zero clause|0 clause) bsd|bsd zero clause)", "bsd"),
    ("bsd", "bsd(?: style)?", "bsd"),
    ("isc", "isc", "isc"),
    ("mpl-1.1", "(?:mpl|mozilla public licen[cs]e)(?: version)?(?: v1| 1) 1", "mpl|mozilla"),
    ("mpl-2", "(?:mpl|mozilla public licen[cs]e)(?: version)?(?: v2| 2)(?: 0)?", "mpl|mozilla"),
    ("mpl", "(?:mpl|mozilla public licen[cs]e)", "mpl|mozilla"),
    ("epl-1", "(?:epl|eclipse public licen[cs]e)(?: version)?(?: v1| 1)(?: 0)?", "epl|eclipse"),
    ("epl-2", "(?:epl|eclipse public licen[cs]e)(?: version)?(?: v2| 2)(?: 0)?", "epl|eclipse"),
    ("epl", "(?:epl|eclipse public licen[cs]e)", "epl|eclipse"),
    ("eupl", "(?:eupl|european union public licen[cs]e)(?: version)?(?: v1| 1)?(?: [012])?", "eupl|european"),
    ("cddl", "(?:cddl|common development and distribution licen[cs]e)(?: version)?(?: 1(?: [01])?)?", "cddl|distribution"),
    ("artistic-2", "artistic(?: licen[cs]e)?(?: version)?(?: v2| 2)(?: 0)?", "artistic"),
    ("artistic", "(?:perl )?artistic", "artistic"),
    ("bsl-1", "boost(?: software)?(?: licen[cs]e)?(?: version)?(?: 1(?: 0)?)?", "boost"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("unlicense", "(?:the )?unlicen[cs]e", "unlicen"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public licen[cs]e)(?: version)?(?: 2)?", "wtfpl|fuck"),
    ("ofl-1.1", "(?:sil )?(?:ofl|open font licen[cs]e)(?: version)?(?: 1 1)?", "ofl|font"),
    ("odbl", "(?:odbl|open database licen[cs]e)(?: version)?(?: 1 0)?", "odbl|database"),
    ("python-2", "(?:psf|python software foundation)(?: licen[cs]e)?(?: version)?(?: 2)?", "psf|python"),
    ("ms-pl", "(?:ms pl|microsoft public)", "ms pl|microsoft"),
    ("postgresql", "postgresql", "postgresql"),
    ("cc0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?", "cc0|cc zero|creative zero"),
    ("cc-by", "(?:cc|creative commons) (?:by|attribution)(?: [1234] [05])?", "cc by|cc attribution|creative by|creative attribution"),
    ("cc-by-sa", "(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: [1234] [05])?", "cc by|cc attribution|creative by|creative attribution"),
    ("cc-by-nd", "(?:cc|creative commons) (?:by|attribution) (?:nd|no ?deriv[a-z]*)(?: [1234] [05])?", "cc by|cc attribution|creative by|creative attribution"),
    ("cc-by-nc", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)(?: [1234] [05])?", "cc by|cc attribution|creative by|creative attribution"),
    ("cc-by-nc-sa", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: [1234] [05])?", "cc by|cc attribution|creative by|creative attribution"),
    ("cc-by-nc-nd", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv[a-z]*)(?: [1234] [05])?", "cc by|cc attribution|creative by|creative attribution"),
    ("public-domain", "(?:the )?public domain", "public domain"),
    ("proprietary", "(?:a )?(?:proprietary|commercial)", "proprietary|commercial"),
)

_GIVEN = "(?:licen[cs]ed|released|distributed|available|published|provided|made available)"
_TERMS = "under(?: the)?(?: terms (?:of|and conditions of)(?: the)?)?"

#: A way to put a name into a sentence: priority, confidence in percent, expression and
#: keywords. The first one finds what is denied and gives no label.
DENIED, HEADER, GRANT, COPY, NAMED, MENTION = 6, 5, 4, 3, 2, 1
WAYS = (
    (DENIED, 0, f"(?:not|never)(?: be)? {_GIVEN} {_TERMS} {{}}(?: licen[cs]e)?", "under"),
    (HEADER, 100, "spdx licen[cs]e identifier {}(?: only| or later)?", "spdx identifier"),
    (GRANT, 95, f"{_GIVEN} {_TERMS} {{}}(?: licen[cs]e)?", "under"),
    (COPY, 80, "(?:copy of|subject to|governed by|see)(?: the)?(?: terms of(?: the)?)? {} licen[cs]e", "licen"),
    (NAMED, 70, "licen[cs]e(?: is| type| name)?(?: the)? {}", "licen"),
    (MENTION, 50, "{} licen[cs]e", "licen"),
)


class Rule(NamedTuple):
    order: int
    priority: int
    confidence: int
    label: str | None
    pattern: str
    keywords: tuple[frozenset[str], ...]


@cache
def rules() -> tuple[Rule, ...]:
    """Every licence in every way, in order. Words of a pattern stand in blanks of their own."""
    made = []
    for priority, confidence, way, near in WAYS:
        for label, name, held in LICENCES:
            # A name that ends in "license" by itself needs no second one to be mentioned.
            alone = priority == MENTION and ("public licen" in name or label in _SELF_NAMED)
            words = name if alone else way.format(name)
            beside = "" if alone else near
            keywords = tuple(frozenset(f"{k} {beside}".split()) for k in held.split("|"))
            label = None if priority == DENIED else label
            made.append(Rule(len(made), priority, confidence, label, _in_blanks(words), keywords))
    return tuple(made)


#: Licences that a text can name without the word "license".
_SELF_NAMED = {
    "gfdl", "cddl", "unlicense", "ofl-1.1", "odbl", "cc0", "cc-by", "cc-by-sa", "cc-by-nd",
    "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd",
}


def _in_blanks(words: str) -> str:
    """An expression over " w1  w2  w3 ": a match has the blanks of its own words only."""
    return " " + words.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + " "


class _Scanner:
    """Rules and phrases, ready to run over lower-case bytes."""

    def __init__(self):
        self.word = re.compile(rb"[0-9a-z\x80-\xff]+")
        self.phrases = [
            (b" " + p.replace(" ", "  ").encode() + b" ", tuple(w.encode() for w in p.split()), label)
            for p, label in PHRASES.items()
        ]
        self.rules = [
            (r, re.compile(r.pattern.encode()), [{k.encode() for k in ks} for ks in r.keywords])
            for r in rules()
        ]
        groups = [*(p[1] for p in self.phrases), *chain.from_iterable(r[2] for r in self.rules)]
        self.keywords = sorted(set(chain.from_iterable(groups)))

    def scan(self, text: bytes) -> tuple[list[int], list[str], list[str], float]:
        """Places of base phrases, their labels, all labels and the score of a lower-case text."""
        held = {k for k in self.keywords if k in text}
        phrases = [p for p in self.phrases if held.issuperset(p[1])]
        gated = [r for r in self.rules if any(map(held.issuperset, r[2]))]
        if not phrases and not gated:
            return [], [], [], 0.0
        words = self.word.findall(text)
        line = b" " + b"  ".join(words) + b" "
        starts = list(accumulate((len(w) + 2 for w in words), initial=0))
        places, base = [], set()
        for phrase, _, label in phrases:
            at = line.find(phrase)
            while at >= 0:
                places.append(bisect_right(starts, at) - 1)
                base.add(label)
                at = line.find(phrase, at + 1)
        found = [
            (m.start(), m.end(), r)
            for r, pattern, _ in gated
            for m in pattern.finditer(line)
        ]
        left = [r for r in _outermost(found) if r.label is not None]
        labels = base | {r.label for r in left}
        return places, sorted(base), sorted(labels), max((r.confidence for r in left), default=0) / 100


def _outermost(found: list[tuple[int, int, Rule]]) -> list[Rule]:
    """Rules of the intervals that no stronger one holds. In order of strength, an interval
    is kept if no kept one reaches from before its begin to behind its end."""
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[2].order, d[0]))
    kept, begins, reach = [], [], []
    for begin, end, rule in found:
        i = bisect_right(begins, begin)
        if i and reach[i - 1] >= end:
            continue
        kept.append(rule)
        # ``begins`` ascends and so does ``reach``: what a wider interval covers is left out.
        j = i
        while j < len(begins) and reach[j] <= end:
            j += 1
        if i and begins[i - 1] == begin:
            i -= 1
        begins[i:j], reach[i:j] = [begin], [end]
    return kept


@cache
def _scanner() -> _Scanner:
    return _Scanner()


@cache
def _is_word() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
    table[ord("A") : ord("Z") + 1] = True
    return table


def word_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of each text of ``text_bytes``."""
    inside = _is_word()[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = inside[begins]
    total = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


NEW = (
    "n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the columns of ``NEW``: words, places of base phrases
    and where the first and last begin, labels of both kinds, and the score."""
    new = T._parse_datatype_string(NEW)
    kept = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in new.names]
    schema = T.StructType(kept + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for part in chain.from_iterable(map(parts, batches)):
            data, at = text_bytes(part.column(text))
            lower = data.tobytes().lower()  # of bytes: A-Z only
            places = at.tolist()
            rows = [scanner.scan(lower[a:b]) for a, b in zip(places, places[1:], strict=False)]
            found = [
                pa.array(word_counts(data, at)),
                pa.array([len(r[0]) for r in rows], pa.int64()),
                pa.array([min(r[0], default=None) for r in rows], pa.int64()),
                pa.array([max(r[0], default=None) for r in rows], pa.int64()),
                pa.array([",".join(r[1]) for r in rows], pa.string()),
                pa.array([",".join(r[2]) for r in rows], pa.string()),
                pa.array([r[3] for r in rows], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f.name) for f in kept), *found], names=schema.fieldNames()
            )

    columns = [f"`{f.name}`" for f in kept] + [text]
    return docs.select(*columns).mapInArrow(run, schema)
