"""License rules against phrases whose answer is known, and against plain counting."""

import random
import re

import pytest

from pagesieve.llm import license_scan as scan


def plain(text):
    """Words and base places by the contract alone."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [
        (i, label)
        for phrase, label in scan.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    return (
        len(words),
        len(places),
        min((i for i, _ in places), default=None),
        max((i for i, _ in places), default=None),
        ",".join(sorted({x for _, x in places})),
    )


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [tuple(r)[1:] for r in scan.scanned(docs).orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("Released under the MIT License.", "mit", 0.95),
        ("SPDX-License-Identifier: Apache-2.0", "apache-2", 1.0),
        ("the GNU Lesser General Public License, version 2.1", "lgpl-2.1", 0.5),
        ("licensed under the GNU General Public License, version 3", "gpl-3", 0.95),
        ("GPLv3 licence and a BSD-style license", "bsd,gpl", 0.5),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa", 0.5),
        ("never distributed under the terms of the Mozilla Public License", "", 0.0),
        ("not released under the MIT license", "mit", 0.0),  # a base label stays
        ("not released under the ISC license. Released under the ISC license.", "isc", 0.95),
        ("émit license", "", 0.0),
        ("mitlicense under the mit\n\n* LICENSE", "mit", 0.5),
        ("permit licensees", "", 0.0),
    ],
)
def test_labels(text, labels, score):
    found = scan._Scanner().scan(text.encode().lower())
    assert (",".join(found[2]), found[3]) == (labels, score)


def test_whole_texts_and_odd_ones(spark):
    rng = random.Random(4)
    words = "under the mit license apache version 2 cc by nc é \x00 É-x A".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += [None, "", " \n", "x" * 60_000, "word " * 20_000 + "CC BY-NC", "cc by nc cc by nc", "\U00010400 under_the-MIT/License"]
    found = scanned(spark, texts)
    assert [r[:5] for r in found] == [plain(t) for t in texts]
    assert all({*r[4].split(",")} - {""} <= {*r[5].split(",")} and 0 <= r[6] <= 1 for r in found)


def test_a_keyword_never_hides_a_match():
    """What a rule's expression matches always holds the keywords of an alternative."""
    gated, names = scan._Scanner(), {}
    for r in scan.rules():
        for example in _examples(r.pattern):
            assert re.fullmatch(r.pattern, example), (r, example)
            words = example.split()
            assert any(all(any(k in w for w in words) for k in ks) for ks in r.keywords), (r, example)
            names.setdefault(r.label, example)
    assert len(scan.rules()) == 300 and gated.scan(b"") == ([], [], [], 0.0)


def _examples(pattern):
    """Strings of a pattern: every alternative, with and without what is optional."""
    from itertools import islice, product
    from re import _parser as parser

    def strings(tree):
        parts = []
        for kind, value in tree:
            name = str(kind)
            if name == "LITERAL":
                parts.append([chr(value)])
            elif name == "IN":
                chars = [chr(v) if str(k) == "LITERAL" else chr(v[0]) for k, v in value]
                parts.append(chars)
            elif name == "SUBPATTERN":
                parts.append(list(islice(strings(value[-1]), 12)))
            elif name == "BRANCH":
                parts.append([s for t in value[1] for s in islice(strings(t), 4)])
            elif name == "MAX_REPEAT":
                parts.append((["" ] if value[0] == 0 else []) + list(islice(strings(value[2]), 12)))
            else:
                raise AssertionError(name)
        return ("".join(p) for p in product(*parts))

    return islice(strings(parser.parse(pattern)), 400)


def test_containment_is_that_of_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        found = []
        for i in range(rng.randrange(12)):
            a = rng.randrange(20)
            found.append((a, a + rng.randrange(1, 9), scan.Rule(i, rng.randrange(1, 4), 50, "x", "", ())))

        def strength(d):
            return (d[2].priority, d[1] - d[0], -d[2].order)

        expected = [
            d[2]
            for d in found
            if not any(e[0] <= d[0] and e[1] >= d[1] and strength(e) > strength(d) for e in found)
        ]
        assert sorted(scan._outermost(list(found))) == sorted(expected)


def test_odd_documents(odd_documents, no_documents):
    rows = scan.scanned(odd_documents)
    assert rows.count() == odd_documents.count() and "text" not in rows.columns
    assert rows.schema["n_words"].dataType.simpleString() == "bigint"
    assert scan.scanned(no_documents).isEmpty()
