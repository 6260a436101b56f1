"""Near copies, repeated lines and repeated bytes against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import prose
from pagesieve.llm import cover_tree, line_dedup, minhash, suffix_dedup


def _least(nodes, links):
    """Least node of every component."""
    group = {x: x for x in nodes}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# Embeddings


def _vectors():
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, 2):
        centres = rng.normal(size=(12, 16))
        for centre in centres:
            for _ in range(12):
                spread = rng.choice([0.0, 0.02, 0.05, 0.3])
                rows.append((n, (centre + spread * rng.normal(size=16)).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n + i, [1.0] * 16, 1) for i in range(30)]  # one group of equal vectors
    rows += [(n + 30 + i, (1 + 0.01 * rng.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(60)]
    return rows


ODD_VECTORS = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0] * 15 + [None], 1), (904, [1.0] * 15 + [float("nan")], 1),
    (905, [1.0] * 15 + [float("inf")], 1), (906, [1.0] * 16, None), (None, [1.0] * 16, 1), (907, [2.0] * 8, 1), (908, [1.0] * 8, 1),
    (909, [3.0] * 16, 7), (909, [3.0] * 16, 7), (910, [-1.0] * 16, 7),
]


@pytest.mark.parametrize("block", [4096, 40])
def test_cover_tree(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = _vectors()
    df = spark.createDataFrame(
        [(*r, "x") for r in rows + ODD_VECTORS], "vec_id long, embedding array<float>, label int, kept string"
    )
    got = sorted((tuple(r) for r in cover_tree.near_duplicates(df).collect()), key=repr)
    links = defaultdict(set)
    for label in (0, 1, 2):
        own = [r for r in rows if r[2] == label]
        unit = np.array([r[1] for r in own], np.float32).astype(float)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        for i, j in np.argwhere(unit @ unit.T >= 0.98):
            if i != j:
                links[own[i][0]].add(own[j][0])
    least = _least([r[0] for r in rows], [(a, b) for a in links for b in links[a]])
    expected = [(i, len(links[i]), least[i], least[i] == i) for i, _, _ in rows]
    expected += [(i, 0, i, True) for i in (900, 901, 902, 903, 904, 905, 906, None, 910)]
    expected += [(907, 1, 907, True), (908, 1, 907, False), (909, 1, 909, True), (909, 1, 909, True)]
    assert got == sorted(expected, key=repr)
    assert len(links) > 200


def test_cover_tree_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cover_tree.near_duplicates(empty).collect() == []


# Word shingles


def _shingles(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def _copies(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        words = prose(rng, 120).split()
        for _ in range(25):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = prose(rng, 1)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("width", "block"), [(4, 1024), (5, 8)])
def test_minhash(spark, monkeypatch, width, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = dict(enumerate(_copies(width)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: _shingles(t, width) for i, t in texts.items()}
    links = [
        (a, b)
        for a in sets for b in sets
        if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    least = _least(texts, links)
    expected = {(i, len(sets[i]), least[i], least[i] == i) for i in texts}
    assert {tuple(r) for r in minhash.near_duplicates(df, width=width).collect()} == expected
    assert 6 < len(set(least.values())) < len(texts)


def test_a_bucket_with_one_open_row_is_repeated_once(spark):
    rows = spark.range(5000).select(
        F.lit(1).alias("key"), F.col("id").cast("string").cast("binary").alias("cls"), F.lit(9).alias("blocks"),
        F.lit(b"r").alias("root"), (F.col("id") == 77).alias("open"),
    )
    dealt = minhash.in_blocks(rows)
    assert dealt.filter("open").count() == 9 and dealt.filter("NOT open").count() == 5000
    pairs = dealt.filter("open").select("i", "j").join(dealt.filter("NOT open").select("i", "j", "cls"), ["i", "j"])
    assert pairs.select("cls").distinct().count() == 5000


@pytest.mark.parametrize("size", [4000])
def test_blocks_are_bounded_in_bytes(spark, monkeypatch, size):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    test_minhash(spark, monkeypatch, 4, 1024)


def test_minhash_of_odd_documents(odd_documents, no_documents):
    rows = sorted((tuple(r) for r in minhash.near_duplicates(odd_documents).collect()), key=repr)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r[1:])
    assert len(rows) == odd_documents.count()
    assert by_id[3] == [(77, 1, False)] and by_id[1] == [(77, 1, True)]
    assert by_id[4] == by_id[5] == by_id[6] == [(0, by_id[4][0][1], True)] or all(
        by_id[i] == [(0, i, True)] for i in (4, 5, 6)
    )
    assert all(c is None and kept for _, c, kept in by_id[None])
    assert [r[1] for r in by_id[2]].count(1) == 2  # near copies of 1, the third row is not
    assert minhash.near_duplicates(no_documents).collect() == []
    left = minhash.one_of_each(odd_documents)
    assert left.columns == odd_documents.columns
    assert sorted(r.doc_id for r in left.collect() if r.text and r.doc_id in (1, 2, 3)) == [1, 2]
    assert minhash.one_of_each(no_documents).collect() == []


def test_signatures_estimate_similarity(spark):
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.9):
        a = rng.integers(0, 1 << 63, 1000, np.uint64)
        b = np.concatenate([a[: int(1000 * share)], rng.integers(0, 1 << 63, 1000 - int(1000 * share), np.uint64)])
        pair = [minhash.signature_of(minhash.minima(x)).tolist() for x in (a, b)]
        df = spark.createDataFrame([pair], "a array<long>, b array<long>")
        found = df.select(minhash.estimate(df.a, df.b)).first()[0]
        assert abs(found - share / (2 - share)) < 0.2


# Lines


def _patience(a, b):
    """Patience diff by recursion, from its description."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *_patience(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*_patience(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    once = lambda rows: {k: i for i, (_, k) in enumerate(rows) if [x for _, x in rows].count(k) == 1}
    ua, ub = once(a), once(b)
    both = sorted((i, ub[k]) for k, i in ua.items() if k in ub)
    best = []  # the longest run that ends here; of equally long ones, the latest is gone on with
    for n, (_, y) in enumerate(both):
        size = max((len(best[m]) for m in range(n) if both[m][1] < y), default=0)
        before = [best[m] for m in range(n) if len(best[m]) == size]
        best.append([*(before[-1] if size else []), both[n]])
    size = max(map(len, best), default=0)
    run = [x for x in best if len(x) == size][-1] if size else []
    if not run:
        return []
    out, i, j = [], 0, 0
    for x, y in run:
        out += [*_patience(a[i:x], b[j:y]), (a[x][0], b[y][0])]
        i, j = x + 1, y + 1
    return out + _patience(a[i:], b[j:])


def _brute_lines(docs):
    """Lines that are left, for documents with different ids."""
    rows = {
        i: [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate(t.split("\n")) if x.encode().split()]
        for i, t in docs.items()
    }
    numbered = {i: [((k, n, len(x.encode().split())), x) for k, (n, x) in enumerate(r)] for i, r in rows.items()}
    first = {}
    for i in sorted(docs):
        for _, x in rows[i]:
            first.setdefault(x, i)
    out = {}
    for i in docs:
        gone = set()
        partners = {first[x] for _, x in rows[i] if len(x.encode().split()) >= 5 and first[x] < i}
        for p in partners:
            shared = {x for x in {y for _, y in rows[p]} & {y for _, y in rows[i]}}
            every = lambda d: [r for r in numbered[d] if r[1] in shared]
            blocks = []
            for a, b in _patience(every(p), every(i)):
                if blocks and (blocks[-1][-1][0][0] + 1, blocks[-1][-1][1][0] + 1) == (a[0], b[0]):
                    blocks[-1].append((a, b))
                else:
                    blocks.append([(a, b)])
            for block in blocks:
                if sum(b[2] for _, b in block) >= 5:
                    gone |= {b[1] for _, b in block}
        out[i] = "\n".join(x for n, x in enumerate(docs[i].split("\n")) if n not in gone)
    return out


def test_line_dedup(spark):
    rng = random.Random(8)
    pool = [prose(rng, rng.choice([1, 2, 6, 9])) for _ in range(25)]
    docs = {}
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(8)):
            start = rng.randrange(len(pool))
            lines += pool[start : start + rng.randrange(5)] if rng.random() < 0.6 else [prose(rng, 7), ""]
        docs[i] = "\n".join(lines)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(df).collect()}
    assert got == _brute_lines(docs)
    assert got != docs


def _left_of(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {r.doc_id: r.text for r in line_dedup.without_repeats(df, whole=True).collect()}


def assert_whole(docs, left):
    """Whole line dedup from both sides: lines that go are in a block of five words that an
    earlier document has, and of a line of five words no more copies stay than may."""
    worded = {
        i: [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n") if x.encode().split()] for i, t in docs.items()
    }
    size = lambda x: len(x.encode().split())
    seen, most = set(), defaultdict(int)  # blocks, and copies that one earlier document has
    for i in sorted(docs):
        lines, blocks = worded[i], {}
        for a in range(len(lines)):
            # Blocks from which the first or the last line cannot be left out.
            for b in range(a + 1, len(lines) + 1):
                words = sum(map(size, lines[a:b]))
                if words >= 5 and min(words - size(lines[a]), words - size(lines[b - 1])) < 5:
                    blocks[a, b] = tuple(lines[a:b])
                if words - size(lines[a]) >= 5:
                    break
        may_go = {k for (a, b), x in blocks.items() if x in seen for k in range(a, b)}
        stay = [x.strip(" \t\n\x0b\x0c\r") for x in left[i].split("\n") if x.encode().split()]
        rest = iter(lines)
        assert all(any(x == y for y in rest) for x in stay)
        for x in set(lines):
            gone = lines.count(x) - stay.count(x)
            assert gone <= sum(lines[k] == x for k in may_go), (i, x)
            assert size(x) < 5 or gone >= min(lines.count(x), most[x]), (i, x)
        seen.update(blocks.values())
        for x in set(lines):
            most[x] = max(most[x], lines.count(x))


def test_whole_line_dedup_unites_what_partners_delete(spark):
    x, y = "a line of just six words", "another line that is not that"
    docs = {0: x, 1: f"{y}\n{x}", 2: f"{x}\n{y}\n{x}", 3: f"new words in this own line\n{x}"}
    left = _left_of(spark, docs)
    assert left == {0: x, 1: y, 2: "", 3: "new words in this own line"}
    assert_whole(docs, left)


def test_whole_line_dedup_from_both_sides(spark):
    rng = random.Random(28)
    pool = [prose(rng, rng.choice([1, 3, 5, 8])) for _ in range(25)]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(10))) for i in range(90)}
    left = _left_of(spark, docs)
    assert_whole(docs, left)
    with pytest.raises(AssertionError):
        assert_whole(docs, docs)
    with pytest.raises(AssertionError):
        assert_whole(docs, dict.fromkeys(docs, ""))


def test_line_dedup_beyond_the_first_alignment(spark):
    p, q, x = "one passage of six words here", "another passage of six words there", "this line comes more than once"
    docs = {
        0: f"{p}\n{q}", 1: f"{q}\n{p}", 2: f"{q}\n{p}",  # other order
        10: x, 11: f"new {x}\n{x}\n{x}", 12: f"{x}\n{x}\n{x}",  # the first holder has it once
    }
    left = _left_of(spark, docs)
    assert left[1] == left[2] == ""
    assert left[11] == f"new {x}\n{x}" and left[12] == x


def test_line_dedup_leaves_no_line_of_an_earlier_document(spark):
    rng = random.Random(18)
    pool = [prose(rng, rng.choice([5, 6, 9])) for _ in range(30)]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(9))) for i in range(80)}
    left = _left_of(spark, docs)
    most = defaultdict(int)  # copies that one earlier document has
    for i in sorted(docs):
        lines = [x for x in docs[i].split("\n") if x]
        kept = left[i].split("\n")
        for line in set(lines):
            assert kept.count(line) <= lines.count(line) - min(most[line], lines.count(line))
            assert most[line] or kept.count(line) == lines.count(line)
        for line in set(lines):
            most[line] = max(most[line], lines.count(line))


def test_line_dedup_of_short_lines(spark):
    verse = [f"{a} {b}" for a in ("sun", "moon", "star") for b in ("tree", "leaf", "root", "stone", "cloud")]
    docs = {
        0: "\n".join(verse), 1: "\n".join(verse),
        2: "\n".join(["head", *verse[3:9], "end"]),
        3: "\n".join([*verse[9:12], "own", *verse[3:5]]),  # the last two have four words
        10: "a line of many words\nold", 11: "a line of many words\nodd", 12: "a line of many words\nodd",
    }
    left = _left_of(spark, docs)
    assert left[0] == docs[0] and left[1] == ""
    assert left[2] == "head\nend"
    assert left[3] == "\n".join(["own", *verse[3:5]])
    assert left[11] == "odd" and left[12] == ""


def test_patience_alignment():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        assert line_dedup.aligned(a, b) == _patience(list(enumerate(a)), list(enumerate(b)))
    n = 100_000
    assert len(line_dedup.aligned(["x"] * n, ["x"] * n)) == n
    assert len(line_dedup.aligned([*range(n)], [*range(n // 2, n), *range(n // 2)])) == n // 2


def test_line_dedup_of_odd_documents(odd_documents, no_documents):
    rows = line_dedup.without_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    text = defaultdict(list)
    for r in rows:
        text[r.doc_id].append(r.text)
    before = {r.doc_id: r.text for r in odd_documents.collect()}
    assert text[1] == [before[1]] and text[3] == [""] and text[12] == [before[12].split("\n")[1]]
    assert text[11] == [before[11].split("\n")[0]]
    assert sorted(text[None], key=repr) == ["", None]
    assert text[4] == [None] and text[5] == [""] and text[6] == [before[6]]
    left = line_dedup.deduplicated(odd_documents)
    assert left.columns == odd_documents.columns
    assert left.count() == len(rows) - 2  # 3 and the null id lost all
    assert line_dedup.without_repeats(no_documents).collect() == []


# Bytes


def _brute_bytes(docs):
    least = {}
    for i, data in docs:
        for p in range(len(data) - 49):
            least[data[p : p + 50]] = min(i, least.get(data[p : p + 50], i))
    out = []
    for i, data in docs:
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - 49):
            if least[data[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(data) else 0
        kept = bytes(x for x, g in zip(data, gone, strict=False) if not g)
        out.append((i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def _repeats():
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (8, 9, 12, 40, 200)]
    docs = []
    for i in rng.sample(range(1000), 60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else prose(rng, 6) for _ in range(rng.randrange(6))]
        docs.append((i, rng.choice([" ", "", "é"]).join(parts)))
    docs += [(2000 + i, "a" * n) for i, n in enumerate((49, 50, 51, 400))]
    docs += [(3000 + i, "ab" * n) for i, n in enumerate((24, 25, 26, 300, 3000))]
    return docs


def test_suffix_dedup(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    docs = _repeats()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kept string").repartition(5)
    got = sorted(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
        for r in suffix_dedup.without_repeats(df).collect()
    )
    assert got == _brute_bytes([(i, t.encode()) for i, t in docs])


def test_deep_shallow_sorting():
    rng = np.random.default_rng(13)
    for letters in (1, 2, 26):
        text = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
        text[1000:1400] = text[200:600]
        text[2000:2060] = text[100:160]
        places = np.arange(len(text) - 49)
        classes = suffix_dedup.deep_shallow_classes(text, places)
        data = text.tobytes()
        names = [data[p : p + 50] for p in places]
        assert len(set(zip(names, classes.tolist(), strict=True))) == len(set(names)) == len(set(classes.tolist()))


def test_suffix_dedup_of_odd_documents(odd_documents, no_documents):
    rows = defaultdict(list)
    for r in suffix_dedup.without_repeats(odd_documents).collect():
        rows[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans))
    assert sum(map(len, rows.values())) == odd_documents.count()
    n = rows[1][0][0]
    assert rows[1] == [(n, 0, 0)] and rows[3] == [(n, n, 1)] and rows[12] == [(2 * n + 1, 2 * n + 1, 1)]
    assert sorted(rows[None]) == [(0, 0, 0), (n, 0, 0)]
    assert rows[4] == rows[5] == [(0, 0, 0)]
    assert sum(x[1] > 0 for x in rows[2]) == 2  # of the rows of one id, those with the text of 1
    assert suffix_dedup.without_repeats(no_documents).collect() == []
