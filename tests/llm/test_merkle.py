"""The manifest and its proofs against trees built in plain Python."""

import hashlib
import zlib

from pyspark.sql import functions as F

from pagesieve.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def small(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    """Sorted proofs of ``rows(doc_id, source, lang, n_chars, text)``."""
    groups = {}
    for r in rows:
        leaf, other = (digest(*map(field, (*r[:4], t))) for t in (r[4], small(r[4])))
        spoiled = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        key = (r[0] is not None, r[0] or 0, leaf)
        groups.setdefault(r[2], []).append((key, r[0], leaf, other if spoiled else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in groups}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for g in order:
        for place, (_, doc_id, leaf, shown) in enumerate(sorted(groups[g])):
            siblings, folded = [], shown
            for tree, pos in ((trees[g], place), (top, order.index(g))):
                for row in tree[:-1]:
                    run, k = row[pos // 8 * 8 : pos // 8 * 8 + 8], pos % 8
                    siblings += run[:k] + run[k + 1 :]
                    folded = digest(*run[:k], folded, *run[k + 1 :])
                    pos //= 8
            root = top[-1][0]
            out.append((doc_id, leaf, trees[g][-1][0], root, digest(*siblings), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def collected(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert collected(merkle.document_proofs(docs)) == brute(rows)


def test_nulls_ties_repeats_and_a_lone_leaf(spark):
    rows = [
        (1, "a", "en", 3, "ONE"),
        (1, "a", "en", 3, "ONE"),
        (1, "a", "en", 3, "other"),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (None, "s", "en", None, ""),
        (3, "s", "", 1, "-"),
        (-4, "s", "é", 1, "É" * 50_000 + "A"),
        *((i, "s", "de", 1, f"Text {i}") for i in range(70)),
    ]
    check(spark, rows)
    check(spark, rows[:1])


def test_trees_of_several_segments(spark):
    n = merkle.SEGMENT + 9
    rows = [(i, f"s{i % 3}", "en" if i < n else f"l{i % 11}", i, f"T {i}") for i in range(n + 40)]
    check(spark, rows)


def test_more_groups_than_a_segment_holds(spark):
    check(spark, [(i, None, f"g{i}", None, "x") for i in range(merkle.SEGMENT + 2)])


def test_some_requests_get_the_same_proofs_as_all(spark):
    docs = spark.range(500).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 3).cast("string").alias("lang"),
        F.lit(1).alias("n_chars"), F.concat(F.lit("T"), "id").alias("text"),
    )
    m = merkle.manifest(merkle.document_leaves(docs), "lang", "doc_id", ["doc_id"])
    some = merkle.proofs(m, m.leaves.filter("pos IN (0, 77, 165)"))
    everything = collected(merkle.proofs(m))
    assert len(some.collect()) == 9 and set(collected(some)) <= set(everything)


def test_clashing_columns_and_no_rows(spark, no_documents):
    docs = no_documents.withColumns({"n_chars": F.lit(1), "source": F.lit("s")})
    assert merkle.document_proofs(docs).columns == COLUMNS
    assert merkle.document_proofs(docs).isEmpty()
    leaves = spark.createDataFrame([(1, "en", b"x" * 32, None, 5)], "doc_id long, lang string, leaf binary, claim binary, root int")
    row = merkle.proofs(merkle.manifest(leaves, "lang", "doc_id", ["doc_id", "root"])).collect()
    assert [r.root for r in row] == [(b"x" * 32).hex()]
