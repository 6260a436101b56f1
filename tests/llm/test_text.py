"""Quality rules, mixing, chat examples, WARC archives and url rules."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from llm_helpers import prose
from pagesieve.llm import chat, mixing, quality, url_rules, warc
from pagesieve.llm.queries import LISTED, ORACLE_SQL, QUERIES

# Quality


def test_base_counts(spark):
    text = "a b c d e\nx y\na b c d e\n\n \na#b <c> d e"
    row = quality.judged(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"))
    q = row.first().quality
    words = text.split()
    assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (
        len(words), sum(map(len, words)), 3, 1, 10,
    )
    assert q.base_failed and not q.kept and q.class_distance is None


def test_windows_found_twice(spark):
    rng = random.Random(2)
    texts = ["", "a", "a " * 5, "a " * 6, "a " * 40, *(" ".join(rng.choice("abc") for _ in range(n)) for n in range(0, 60, 3))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = dict(df.select("i", quality.repeated_words(quality.words_of(F.col("text")))).collect())
    for i, text in enumerate(texts):
        w = text.split()
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        under = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert got[i] == len(under), text


def test_distance_is_jensen_shannon(spark):
    cases = [([1, 0], [0, 1]), ([3, 1], [3, 1]), ([5, 2, 0], [1, 1, 4]), ([0, 0], [1, 2])]
    for p, q in cases:
        df = spark.createDataFrame([(p, q)], "p array<long>, q array<long>")
        got = df.select(quality.js_distance(df.p, df.q)).first()[0]
        if not sum(p):
            assert got is None
            continue
        a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
        part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
        assert got == pytest.approx(math.sqrt(sum(part(x, y) + part(y, x) for x, y in zip(a, b, strict=True)) / 2))


def test_far_documents_go_and_clean_ones_stay(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 120), "en") for i in range(40)]
    junk = [(100, " ".join(w.upper() + "!!" for w in prose(rng, 120).split()), "en"), (101, "%$# " * 3 + prose(rng, 60).replace(" ", "### "), "en")]
    guarded = [(200, "QQ## " + prose(rng, 12).upper(), "en"), (201, prose(rng, 60).upper(), "xx")]
    df = spark.createDataFrame(rows + junk + guarded, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.kept_documents(df).collect()}
    assert kept == {r[0] for r in rows + guarded}


def test_common_words_have_any_length(spark):
    rng = random.Random(23)
    common = [c * 3 for c in "абвгдежз"]  # six bytes each
    clean = [" ".join(rng.choice(common) if rng.random() < 0.7 else f"слово{rng.randrange(9999)}" for _ in range(100)) for _ in range(60)]
    other = " ".join(f"слово{rng.randrange(9999)}" for _ in range(100))
    df = spark.createDataFrame([(i, t, "ru") for i, t in enumerate([*clean, other])], "doc_id long, text string, lang string")
    found = {r.doc_id: r.quality for r in quality.judged(df).collect()}
    assert all(found[i].kept and found[i].word_distance is not None for i in range(60))
    assert found[60].class_distance is not None and found[60].word_distance > quality.MOST_WORD_DISTANCE
    assert not found[60].base_failed and not found[60].kept


def test_quality_of_odd_documents(odd_documents, no_documents):
    rows = quality.judged(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert r.quality.n_words == len((r.text or "").encode().split())
        assert r.quality.kept is not None and (r.quality.n_words >= 10 or not r.quality.kept)
    kept = quality.kept_documents(odd_documents)
    assert kept.columns == odd_documents.columns or sorted(kept.columns) == sorted(odd_documents.columns)
    assert quality.judged(no_documents).collect() == []


def test_quality_plan_has_no_python(odd_documents):
    plan = quality.judged(odd_documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Mixing

LEVELS = (
    mixing.Level("domain", "substring(source, 1, 1)", {"a": 3, "b": 1}),
    mixing.Level("lang", "lang", {"en": 2}),
    mixing.Level("source", "source", {"a0": 5, "b9": 0}),
)


def _fill(children, budget):
    """Whole shares of a budget: children are (key, capacity, weight)."""
    given, left = {}, sorted((c for c in children if c[2]), key=lambda c: (c[1] / c[2], (c[0] is not None, c[0] or "")))
    given.update((c[0], 0) for c in children if not c[2])
    while left:
        key, capacity, weight = left[0]
        total = sum(c[2] for c in left)
        if capacity * total > budget * weight:
            given.update((c[0], budget * c[2] // total) for c in left)
            return given
        given[key] = capacity
        budget -= capacity
        left.pop(0)
    return given


def _brute_mix(docs, percent, epochs, seed):
    tokens = {i: len((t or "").encode().split()) for i, t, _, _ in docs}
    path = {i: (s and s[:1], g, s) for i, _, g, s in docs}
    weights = [lambda v, x=level: x.weights.get(v, x.default) for level in LEVELS]

    def deal(ids, depth, budget):
        if depth == 3:
            return {path[ids[0]]: budget} if ids else {}
        groups = defaultdict(list)
        for i in ids:
            groups[path[i][depth]].append(i)
        room = lambda v: epochs * sum(tokens[i] for i in v if all(w(x) for w, x in zip(weights, path[i], strict=True)))
        shares = _fill([(k, room(v), weights[depth](k)) for k, v in groups.items()], budget)
        return {k: v for key, own in groups.items() for k, v in deal(own, depth + 1, shares[key]).items()}

    budgets = deal(list(tokens), 0, sum(tokens.values()) * percent // 100)
    out = {}
    for leaf, budget in budgets.items():
        own = [i for i in tokens if path[i] == leaf]
        total = sum(tokens[i] for i in own)
        whole, rest = divmod(budget, total) if total else (0, 0)
        start = 0
        for i in sorted(own, key=lambda i: hashlib.md5(f"{seed}:{whole}:{i}".encode()).hexdigest()):
            out[i] = (budget, whole + (start < rest))
            start += tokens[i]
    return out


@pytest.mark.parametrize(("percent", "epochs", "ranges"), [(30, 1, 5000), (90, 3, 3), (400, 2, 3)])
def test_mixing(spark, monkeypatch, percent, epochs, ranges):
    monkeypatch.setattr(mixing, "RANGE_DOCUMENTS", ranges)
    rng = random.Random(percent)
    docs = [
        (i, None if rng.random() < 0.1 else prose(rng, rng.randrange(60)), rng.choice(["en", "de", None]), rng.choice(["a0", "a0", "a1", "b2", "b9", "c3", None]))
        for i in range(150)
    ]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, source string, mix int")
    rows = mixing.selected(df, LEVELS, percent=percent, epochs=epochs, seed=5).collect()
    assert {r.doc_id: (r.mix.leaf_budget, r.mix.copies) for r in rows} == _brute_mix(docs, percent, epochs, 5)
    assert len(rows) == len(docs)
    out = mixing.mixed(df, LEVELS, percent=percent, epochs=epochs, seed=5)
    assert Counter(r.doc_id for r in out.collect()) == +Counter({r.doc_id: r.mix.copies for r in rows})
    assert sorted(out.columns) == sorted(df.columns)


def test_mixing_of_odd_documents(odd_documents, no_documents):
    levels = (mixing.Level("lang", "lang"), mixing.Level("source", "source"))
    rows = mixing.selected(odd_documents, levels, percent=100).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.mix.copies == (r.mix.n_tokens > 0) or not r.mix.n_tokens for r in rows)
    assert mixing.selected(no_documents, levels, percent=50).collect() == []


# Chat

HOSTILE = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]<s", ">", "<", "[/INST", "]", "", None, "a\nb", "$1 \\ é\U0001f600"]


def test_chat_round_trip(spark):
    rng = random.Random(7)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "tool</s>", None]), rng.choice(HOSTILE) if rng.random() < 0.8 else prose(rng, 5))
        for c in [*range(40), None]
        for t in [0, 1, 1, None, 3, 4][: rng.randrange(1, 7)]
    ]
    rows += [(7, 9, "assistant", "same"), (7, 9, "assistant", "same")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, example int")
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == turns.keys()
    for c, own in turns.items():
        said = [(r, x) for _, _, r, x in sorted(own)]
        loss = "".join(x for r, x in said if r == "assistant")
        r = got[c]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256) == (len(said), digest("".join(f"{a}\n{b}\n" for a, b in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))
    for e in made.collect():
        assert e.formatted.count("</s>") == e.formatted.count("[INST] ") == e.formatted.count(" [/INST]")
        assert e.formatted.endswith("</s>") and e.formatted[e.mask_end :] == "</s>" or not e.mask_end


def test_every_assistant_turn_is_an_example(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [(e.formatted, e.formatted[e.mask_start : e.mask_end]) for e in chat.examples(df).orderBy("example").collect()]
    first = "[INST] user [/INST]q</s>[INST] assistant [/INST]a</s>"
    second = first + "[INST] user [/INST]r</s>[INST] assistant [/INST]b</s>"
    assert found == [(first, "a"), (second, "b"), (second + "[INST] user [/INST]s</s>", "")]
    assert chat.read_back(chat.examples(df.limit(0))).collect() == []


# WARC


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(3)
    long = [prose(rng, 40) for _ in range(30)]
    rows = [(i, f"http://h/{i}\r\n\x00é", rng.choice(long)) for i in range(100)]
    rows += [(500, None, None), (501, "u", ""), (502, "u", ""), (None, "u", long[0]), (None, None, "own" * 50), (3, "again", rows[3][2])]
    rows += [(504, "u", "é" * 50), (503, "u", "é" * 50), (505, "u", "x" * 99), (506, "u", "x" * 99), (507, "u", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    folder = str(tmp_path / "archives")
    pages = df.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    index = warc.write_archives(pages, folder, archive_bytes=2000)
    got = Counter(tuple(r) for r in warc.read_archives(index, folder).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first.get(h) is not None and first[h] != i
        digest = hashlib.sha256(data).hexdigest()
        expected[(i, len(data), digest, "revisit" if again else "response", first[h] if again else None, True)] += 1
    assert got == expected
    files = list((tmp_path / "archives").iterdir())
    assert len(files) > 3
    for file in files:  # readable without the index, as frames one after the other
        data = file.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.DICTIONARY_FRAME and size > 0
        known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        reader = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data[8 + size :], read_across_frames=True)
        assert reader.read(8) == b"WARC/1.1"


def test_payloads_are_not_shuffled_by_digest(spark, monkeypatch):
    """A third of the pages are one error page; the usual way and the broadcast agree."""
    rows = [(i, "u", "error " * 40 if i % 3 == 0 else f"page {i % 50} " * 40) for i in range(300)] + [(None, "u", "error " * 40)] * 9
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.col("html").cast("binary"))
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    expected = Counter((i, None if i == first[h] else first[h]) for i, _, h in rows)
    for share in (1000, 4, 0):  # all hot, the error page alone, none
        monkeypatch.setattr(warc, "SHARE", share)
        kinds = warc.record_kinds(pages.drop("html"))
        assert Counter((r.page_id, r.refers_to) for r in kinds.collect()) == expected
        plan = spark._jvm.PythonSQLUtils.explainString(kinds._jdf.queryExecution(), "formatted")
        moved = re.findall(r"Input \[\d+\]: \[([^\n]*)\]\nArguments: hashpartitioning\(([^\n]*)", plan)
        assert any("payload#" in columns for columns, _ in moved) or share == 1000
        assert all("payload#" not in columns or "page_id#" in by for columns, by in moved)


def test_a_revisit_without_its_response_is_not_sound(spark):
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean"
    rows = [
        (1, 200, "a", "response", None, True), (2, 999, "a", "revisit", 1, None), (3, 200, "a", "revisit", 7, None),
        (4, 200, "b", "revisit", 1, None), (5, 300, "c", "response", None, False), (6, 300, "c", "revisit", 5, None),
        (1, 200, "a", "response", None, True), (None, 200, "a", "revisit", 1, None),
    ]
    found = Counter((r.page_id, r.payload_bytes, r.sound) for r in warc._resolved(spark.createDataFrame(rows, schema)).collect())
    assert found == Counter(
        [(1, 200, True), (2, 200, False), (3, 200, False), (4, 200, False), (5, 300, False), (6, 300, False), (1, 200, True), (None, 200, True)]
    )


def test_folders_as_spark_writes_them(tmp_path):
    for uri in (f"file:{tmp_path}", f"file://{tmp_path}", str(tmp_path)):
        assert warc.open_folder(uri)[1] == str(tmp_path)


def test_warc_of_nothing(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# Urls


def test_listed_rules(spark):
    cases = {
        "http://EXAMPLE.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://a.www.example.com/en/1?x#y": ("a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "x://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://com/": ("com", "/", "com/", "allow"),
        "http://a.net/es/?/fr/": ("a.net", "/es/", "net/es/", "block"),
        "http://a.net?/fr/": ("a.net", "", None, "allow"),
        "http://ÉA.net#://b.com/": ("Éa.net", "", None, "allow"),
        "a.com/en/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://u:p@a.net:80/fr/\nx": ("u:p@a.net:80", "/fr/\nx", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(cases)], "page_id long, url string, host int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r[1:5] for r in url_rules.judged_urls(pages, labels, LISTED).collect()}
    assert got == dict(enumerate(cases.values()))


def test_mined_rules(spark):
    rng = random.Random(4)
    urls = [
        f"http://{h}.org/{p}/{i}?{q}=1"
        for i, (h, p, q) in enumerate((rng.choice(["spam", "good", "news"]), rng.choice(["buy", "read"]), rng.choice("xy")) for _ in range(400))
    ]
    bad = [("spam" in u and "/buy/" in u) or rng.random() < 0.05 for u in urls]
    pages = spark.createDataFrame([*enumerate(urls), (None, "http://spam.org/buy/?y=2"), (7, "http://spam.org/buy/z"), (8, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad) if i < 300] + [(9, 1, 1), (None, 0, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    got = Counter((r.page_id, r.verdict) for r in url_rules.judged_urls(pages, labels, (), least_confidence=0.8).collect())
    for i, u in enumerate(urls):
        assert got[(i, "block" if "spam" in u and "/buy/" in u else "allow")] >= 1, u
    assert got[(None, "block")] == 1 and got[(7, "block")] >= 1 and got[(8, "allow")] >= 1
    assert sum(got.values()) == len(urls) + 3
    assert url_rules.judged_urls(pages.limit(0), labels.limit(0), LISTED).collect() == []


@pytest.mark.parametrize(("times", "makes"), [(1, ""), (3, "four"), (40, "four two")])
def test_support_is_a_share_and_a_least_count(spark, times, makes):
    """A rule needs 10 bad urls, and one in a thousand where that is more."""
    few = [f"http://{h}.org/{h}{i}" for h, n in (("four", 4), ("two", 2), ("fine", 494)) for i in range(n)]
    rare = ["http://rare.org/x"] * 10
    pages = spark.createDataFrame([*enumerate(few * times + rare * (times == 40))], "page_id long, url string")
    labels = pages.select(F.col("page_id").alias("doc_id"), F.col("url").contains("fine").cast("int").alias("quality"), F.lit(0).alias("toxic"))
    new = [(-1, "x://four.org/new"), (-2, "x://two.org/new"), (-3, "x://rare.org/new")]
    more = pages.unionByName(spark.createDataFrame(new, pages.schema))
    got = url_rules.judged_urls(more, labels, ()).filter("verdict = 'block' AND page_id < 0")
    assert {r.page_id for r in got.collect()} == {i for i, u in new if any(f"{h}.org" in u for h in makes.split())}


@pytest.mark.parametrize(("times", "makes"), [(1, {-1}), (3, {-1}), (40, {-1, -2})])
def test_url_query_mines_tables_of_few_labels(spark, tmp_path, times, makes):
    """Of 500 labelled urls, 3 of a bad host make a rule, as 10 do of 2,000; of 20,000 it takes 20."""
    few = [f"http://{h}.org/{h}{i}" for h, n in (("three", 3), ("two", 2), ("fine", 495)) for i in range(n)]
    rows = [*enumerate(few * times), (-1, "x://three.org/new"), (-2, "x://two.org/new"), (-3, "x://fine.org/new")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.filter("page_id >= 0").selectExpr("page_id AS doc_id", "int(contains(url, 'fine')) AS quality", "0 AS toxic")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op9_url_rules"](spark, str(tmp_path))
    assert {r.page_id for r in got.filter("mined AND page_id < 0").collect()} == makes
    with duckdb.connect() as db:
        for table in ("pages", "labels"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        found = db.execute(ORACLE_SQL["op9_url_rules"])
        columns = [c[0] for c in found.description]
        assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(found.fetchall())


def test_copies_of_a_long_url_make_one_rule(spark):
    """Every combination of tokens that occur together would be a rule: 2^40 of them."""
    long = "http://bad.example/" + "/".join(f"part{i}" for i in range(37))
    pages = [(i, long) for i in range(12)] + [(100 + i, f"http://bad.example/{i}") for i in range(30)]
    pages += [(200, "http://other.org/x/part7"), (201, "http://other.org/x"), (202, long + "/more")]
    labels = [(i, 0, 0) for i in range(12)] + [(100 + i, 1, 0) for i in range(30)]
    pages = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judged_urls(pages, labels, ()).collect()}
    # One token of the url is a rule by itself, as any combination of them is.
    blocked = {*range(12), 200, 202}
    assert got == {i: "block" if i in blocked else "allow" for i in got} and len(got) == 45
    rules, items = url_rules.mined_rules(
        pages.join(labels.select(labels.doc_id.alias("page_id"), (labels.quality == 0).alias("bad")), "page_id")
    )
    assert rules.count() <= 4 and items.select("item").distinct().count() <= 4
