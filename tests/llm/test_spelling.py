"""Spelling variants against pairs found by plain comparison."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pagesieve.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_forms(counts):
    out = {}
    for w, n in counts.items():
        near = sorted(((-m, v) for v, m in counts.items() if one_edit(w, v)))
        is_form = near and -near[0][0] >= 10 * n
        out[w] = (near[0][1] if is_form else None, n, len(near), -near[0][0] if is_form else None)
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                k = h % len(run)
                counts[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def collected(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_acceptor_finds_every_pair_once():
    rng = random.Random(1)
    for _ in range(200):
        letters = "abcé"[: rng.randrange(1, 5)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 50))})
        a, b = spelling.Acceptor(words, np.zeros(len(words))).pairs()
        got = sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True))
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]


def test_states_are_fewer_than_begins():
    words = sorted(a + b + "ing" for a in "bcdfgh" for b in ("all", "end", "ook"))
    machine = spelling.Acceptor(words, np.zeros(len(words)))
    assert machine.size == 1 + 6 + 6 * 3 * 6 and len(machine.final) < 20


@pytest.mark.parametrize("most", [spelling.MOST_WORDS, 40, 3])
def test_forms_whatever_the_partitions(spark, most):
    """Partitions of any size, most words with one begin and one end, and very long words."""
    rng = random.Random(2)
    counts = {}
    for _ in range(260):
        middle = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 6)))
        word = rng.choice(["national" + middle, middle + "lessness", "abca" + middle + "bca", middle * 8])
        if len(word) >= 7:
            counts[word] = rng.choice([2, 2, 3, 30, 400, 5000])
    counts |= {"x" * 3000: 2, "x" * 3001: 50, "y" + "x" * 2999: 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert collected(spelling.forms(words, most_words=most)) == brute_forms(counts)


def test_documents(spark, odd_documents, no_documents):
    rng = random.Random(3)
    stems = ["Strassenbahn", "colourful", "naïveté×", "ÉCOLIERE", "organise", "organize", "sequence"]
    rows = [
        (rng.choice([None, *range(50)]), " ".join(rng.choice(stems) + rng.choice(["", "", "s", "e"]) for _ in range(60)) + rng.choice(["", "1", "-", "\n"]))
        for _ in range(60)
    ]
    rows += [(7, None), (8, ""), (9, "q" * 40_000), (9, "q" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_forms(brute_counts(rows))
    assert any(r[1] for r in expected) and collected(spelling.variants(docs)) == expected
    odd = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert collected(spelling.variants(odd_documents)) == brute_forms(brute_counts(odd))
    assert spelling.variants(no_documents).isEmpty()


def test_long_chains_of_forms(spark):
    counts = {"aaaaaaa" + "b" * k: 2 * 10**k for k in range(12)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = collected(spelling.forms(words))
    assert got == brute_forms(counts) and {r[2] for r in got} == {"aaaaaaa" + "b" * 11}
