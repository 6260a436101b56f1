"""Spelling variants: words one edit apart, and the form that a word is a variant of.

All pairs of vocabulary words that differ by one code point come from a composition of
finite-state machines: the minimised acceptor of the vocabulary, a transducer that
makes one edit, and the acceptor again. A composed state is a pair of acceptor states and
whether the edit is done. Before the edit both sides stand in the same state; from each
such state the edit leads to pairs of states, and from there both sides must read the
same code points. The pairs of states that can still be accepted are found first, each
pair once; then only those are walked to enumerate the words.

The vocabulary is partitioned by the state that four code points lead to. That holds all
pairs that differ behind their fourth code point. All others end in the same three code
points, as a word has seven at least, and come from the same composition over the reversed words,
partitioned by their last three. A partition that is too large is cut where its words first part; pairs
across such a cut agree behind the edit, so they meet on that key. A pair is found
exactly once: by the place of its first difference.

A task takes whole partitions, in parts of bounded size. It returns one row for each
word with near words, so pairs never leave a task.

Defined results
    null text                   no words
    null doc_id                 written as nothing before the colon
    repeated rows               every row counts its words again
    empty and very long texts   taken whole; so are very long words
    ties                        the near word that is first in code-point order
    other columns               not read
    empty table                 no words
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.storage import stored

#: Runs of letters; U+00D7 and U+00F7 are in the range too.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: Every so many runs, by hash, lose a code point.
SPOIL = 31
#: A form has at least so many times the occurrences of its variant.
TIMES = 10

#: Code points that lead to a partition, from the front and from the back.
FRONT, BACK = 4, LEAST_LENGTH - 4
#: Words of a partition before it is cut, and of a part that a task works on at once.
MOST_WORDS = 50_000
PART_WORDS = 20_000


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n``, its occurrences in ``docs(doc_id, text)``."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}+"), F.lit(0))).alias("run"),
    )
    capitals = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    run = F.col("run")
    # Most runs have no capital; F.lower also changes letters beyond A-Z.
    small = F.when(F.lower(run) == run, run).otherwise(F.translate(run, capitals, capitals.lower()))
    runs = runs.select("doc_id", small.alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(h % SPOIL == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the vocabulary of ``docs``."""
    return forms(stored(vocabulary(docs.select("doc_id", "text")), "vocabulary"))


def forms(words: DataFrame, times: int = TIMES, most_words: int = MOST_WORDS) -> DataFrame:
    """The same of ``words(word, n)``, distinct and of at least seven code points.

    ``most_words`` bounds a partition, see above.
    """
    best = F.struct((-F.col("n")).alias("minus_n"), "word")
    none = F.lit(None).cast("struct<minus_n: long, word: string>")
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best"))
    found = reduce(DataFrame.union, [alone, *near_words(words, most_words)])
    joined = found.groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best")
    )
    is_form = -F.col("best.minus_n") >= times * F.col("n")
    joined = stored(
        joined.select(
            "word",
            F.when(is_form, F.col("best.word")).alias("form"),
            "n",
            "n_near",
            F.when(is_form, -F.col("best.minus_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = with_roots(joined.filter("form IS NOT NULL").select("word", "form"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def with_roots(steps: DataFrame) -> DataFrame:
    """``word`` and ``root``: forms followed to the last one, twice as far in each round.

    A form has more occurrences than its word, so there are no circles.
    """
    roots = stored(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(onward, "root", "left")
        roots = stored(
            moved.select("word", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved")),
            "roots",
        )
        if roots.filter("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def near_words(words: DataFrame, most_words: int = MOST_WORDS) -> list[DataFrame]:
    """Tables of ``word, n, n_near, best``; a word's near words are dealt over their rows.

    ``best`` is (-n, word) of the near word with the most occurrences.
    """
    out = []
    for back in (False, True):
        spelled = F.reverse("word") if back else F.col("word")
        rows = words.select(spelled.alias("spelled"), "n")
        parted, cuts = partitions(rows, BACK if back else FRONT, most_words)
        found = [composed(parted, back), *(across(cut, back) for cut in cuts)]
        out += [f.select(_spelling("spelled", back).alias("word"), "n", "n_near", "best") for f in found]
    return out


def _spelling(column: str, back: bool) -> Column:
    return F.reverse(column) if back else F.col(column)


def _common_prefix(a: str, b: str) -> Column:
    """Code points that two strings begin with in common."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def partitions(rows: DataFrame, length: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with ``key`` and ``depth``, the begin that a partition has in common, and
    the cuts: rows of cut partitions with ``cut``, the place where they were.

    A cut goes where the words of a partition first differ, so every round parts them.
    """
    rows = rows.select("*", F.substr("spelled", F.lit(1), F.lit(length)).alias("key"), F.lit(length).alias("depth"))
    cuts = []
    while True:
        sizes = rows.groupBy("key").agg(
            F.count(F.lit(1)).alias("size"), F.min("spelled").alias("low"), F.max("spelled").alias("high")
        )
        large = sizes.filter(F.col("size") > most).select("key", _common_prefix("low", "high").alias("cut"))
        large = stored(large, "large-partitions")
        if large.isEmpty():
            return rows, cuts
        rows = stored(rows.join(large, "key", "left"), "partitions")
        cuts.append(rows.filter("cut IS NOT NULL").select("spelled", "n", "cut"))
        deeper = F.col("cut") + 1
        rows = rows.select(
            "spelled",
            "n",
            F.when(F.col("cut").isNull(), F.col("key")).otherwise(F.substr("spelled", F.lit(1), deeper)).alias("key"),
            F.coalesce(deeper, "depth").alias("depth"),
        )


def across(cut: DataFrame, back: bool) -> DataFrame:
    """Near words that first differ at ``cut``: without that code point they are equal, or
    one of them is what the other is without it."""
    at = F.col("cut")
    whole = cut.select(
        F.col("spelled").alias("key"), "cut", "spelled", "n", F.substr("spelled", at + 1, F.lit(1)).alias("own"), F.lit(False).alias("less")
    )
    less = cut.filter(F.char_length("spelled") > at).select(
        F.concat(F.substr("spelled", F.lit(1), at), F.substr("spelled", at + 2)).alias("key"),
        "cut",
        "spelled",
        "n",
        F.substr("spelled", at + 1, F.lit(1)).alias("own"),
        F.lit(True).alias("less"),
    )
    # At most one word for each code point that can stand at the cut, and one without it.
    member = F.struct("spelled", "n", "own", "less")
    groups = whole.union(less).groupBy("key", "cut").agg(F.collect_list(member).alias("all"))
    pairs = groups.filter(F.size("all") > 1).select("all", F.explode("all").alias("one"))

    def near(other: Column) -> Column:
        one = F.col("one")
        apart = (other["own"] != one["own"]) & (other["less"] | one["less"])
        return apart & _wanted(one["spelled"], other["spelled"], back)

    others = F.filter("all", near)
    best = F.array_min(
        F.transform(others, lambda o: F.struct((-o["n"]).alias("minus_n"), (F.reverse(o["spelled"]) if back else o["spelled"]).alias("word")))
    )
    return pairs.select(
        "one.spelled", "one.n", F.size(others).cast("long").alias("n_near"), best.alias("best")
    ).filter("n_near > 0")


def _wanted(a: Column, b: Column, back: bool) -> Column:
    """From the back only pairs count whose first four code points differ."""
    return F.right(a, F.lit(FRONT)) != F.right(b, F.lit(FRONT)) if back else F.lit(True)


def composed(rows: DataFrame, back: bool) -> DataFrame:
    """Near words inside the partitions of ``rows``."""
    dealt = rows.repartition("key").sortWithinPartitions("spelled").select("spelled", "n", "key", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_partitions(batches):
            yield from _near_in_part(part, back).to_batches()

    return dealt.mapInArrow(
        run, "spelled string, n long, n_near long, best struct<minus_n: long, word: string>"
    )


def _whole_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``PART_WORDS`` rows that end where a partition ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < PART_WORDS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column("key").combine_chunks()
        last = np.flatnonzero(np.asarray(pc.not_equal(keys[1:], keys[:-1])))
        if len(last):
            yield table.slice(0, int(last[-1]) + 1)
            table = table.slice(int(last[-1]) + 1)
        held, size = table.to_batches(), table.num_rows
    if size:
        yield pa.Table.from_batches(held)


def _near_in_part(part: pa.Table, back: bool) -> pa.Table:
    words = part.column("spelled").to_pylist()
    n = part.column("n").to_numpy()
    machine = Acceptor(words, part.column("depth").to_numpy())
    a, b = machine.pairs(FRONT - 1 if back else None)
    if back:
        head = np.array([w[: -FRONT - 1 : -1] for w in words])
        apart = head[a] != head[b]
        a, b = a[apart], b[apart]
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    plain = np.array([w[::-1] for w in words] if back else words, dtype=object)
    # Of each word's near words the first by occurrences, then by code points.
    place = np.empty(len(words), np.int64)
    place[np.argsort(plain, kind="stable") if back else np.arange(len(words))] = np.arange(len(words))
    order = np.lexsort((place[other], -n[other], one))
    one, other = one[order], other[order]
    who, first, count = np.unique(one, return_index=True, return_counts=True)
    best = other[first]
    text = pa.array(words, pa.string())
    best_of = pa.StructArray.from_arrays(
        [pa.array(-n[best]), pa.array(plain[best], pa.string())], names=["minus_n", "word"]
    )
    return pa.table(
        {"spelled": text.take(pa.array(who)), "n": pa.array(n[who]), "n_near": pa.array(count), "best": best_of}
    )


class Acceptor:
    """The minimised acceptor of sorted, distinct words, with the tree that it came from.

    A node of the tree is a begin of words; nodes that can end in the same ways are one state.
    Nodes are numbered by depth, and those of a depth by order.
    """

    def __init__(self, words: list[str], depth: np.ndarray):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters, labels = np.unique(codes, return_inverse=True)
        labels = labels.astype(np.int64) + 1
        length = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(length) - length
        common = _common_with_previous(labels, begin, length)
        self._plant(labels, begin, length, common, np.asarray(depth, np.int64))
        self._minimise()

    def _plant(self, labels, begin, length, common, depth) -> None:
        """The tree: arcs (parent, label, child), nodes without edits before their depth."""
        most = int(length.max(initial=0))
        node = np.zeros(len(length), np.int64)  # where each word stands
        self.ends = np.full(int((length - common).sum()) + 1, -1, np.int64)
        parents, arcs, may_edit = [np.array([-1])], [np.array([0])], [depth[:1] <= 0]
        count, active = 1, np.arange(len(length))
        self.depths = [np.array([0, 1])]
        for d in range(most):
            active = active[length[active] > d]
            fresh = common[active] <= d
            # A word that shares its begin stands where the last fresh one before it stands.
            number = count + np.cumsum(fresh) - 1
            first = active[fresh]
            parents.append(node[first])
            arcs.append(labels[begin[first] + d])
            may_edit.append(depth[first] <= d + 1)
            node[active] = number
            self.depths.append(np.array([count, count + len(first)]))
            count += len(first)
            done = active[length[active] == d + 1]
            self.ends[node[done]] = done
        self.parent, self.label = np.concatenate(parents), np.concatenate(arcs)
        self.may_edit = np.concatenate(may_edit)
        self.size = count
        # Children of a node stand together, as the words are sorted.
        self.children = np.bincount(self.parent[1:], minlength=count)
        self.first_child = np.concatenate([[1], 1 + np.cumsum(self.children)[:-1]])

    def _minimise(self) -> None:
        """States by the ways to end, told apart by a hash that is then checked arc by arc."""
        final = self.ends >= 0
        for seed in range(1, 9):
            value = _mixed(final.astype(np.uint64) + np.uint64(seed))
            for low, high in reversed(self.depths[1:]):
                nodes = np.arange(low, high)
                term = _mixed(value[nodes] * np.uint64(0x9E3779B97F4A7C15) + _mixed(self.label[nodes].astype(np.uint64)))
                np.add.at(value, self.parent[nodes], term)
            _, self.state_node, self.state = np.unique(value, return_index=True, return_inverse=True)
            if self._sound(final):
                break
        else:
            raise ValueError("states could not be told apart")
        self.final = final[self.state_node]
        # The least way to an end, for states.
        height = np.where(final, 0, 1 << 40)
        for low, high in reversed(self.depths[1:]):
            nodes = np.arange(low, high)
            np.minimum.at(height, self.parent[nodes], height[nodes] + 1)
        self.height = height[self.state_node]
        self.width = len(self.letters) + 1
        children = self.children[self.state_node]
        arc = _ranges(self.first_child[self.state_node], children)
        self.arc_count, self.arc_first = children, np.cumsum(children) - children
        self.arc_label, self.arc_state = self.label[arc], self.state[arc]
        self.arc_key = np.repeat(np.arange(len(children)), children) * self.width + self.arc_label
        self.node_key = self.parent[1:] * self.width + self.label[1:]

    def _sound(self, final: np.ndarray) -> bool:
        like = self.state_node[self.state]
        if (self.children != self.children[like]).any() or (final != final[like]).any():
            return False
        own = _ranges(self.first_child, self.children)
        same = _ranges(self.first_child[like], self.children)
        return bool((self.label[own] == self.label[same]).all() and (self.state[own] == self.state[same]).all())

    def pairs(self, reach: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of every accepted pair, each pair once.

        With ``reach``, pairs that go on for more than so many code points behind the edit
        need not be found.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        nodes = np.flatnonzero(self.may_edit & (self.children > 0))
        for chunk in _chunks(nodes, self.children[nodes]):
            for a, b, ahead in self._edited(chunk, reach, found):
                self._walk(a, b, ahead, found)
        none = np.zeros(0, np.int64)
        return (
            np.concatenate([none, *(f[0] for f in found)]),
            np.concatenate([none, *(f[1] for f in found)]),
        )

    def _edited(self, nodes, reach, found) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Pairs of nodes behind the edit in ``nodes``, and the reach that is left there."""
        count = self.children[nodes]
        child = _ranges(self.first_child[nodes], count)
        # A code point replaced: two children of a node.
        others = np.repeat(self.first_child[nodes] + count, count) - child - 1
        yield np.repeat(child, others), _ranges(child + 1, others), reach
        # A code point more: a node and its child. Either both end, or both read a code
        # point on that is not the one that the child has more.
        node = np.repeat(nodes, count)
        self._accept(node, child, found)
        pair, a, b = self._read(node, child)
        own = self.label[a] != self.label[child[pair]]
        yield a[own], b[own], None if reach is None else reach - 1

    def _accept(self, a: np.ndarray, b: np.ndarray, found: list) -> None:
        both = (self.ends[a] >= 0) & (self.ends[b] >= 0)
        found.append((self.ends[a[both]], self.ends[b[both]]))

    def _read(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ways of two nodes to read the same code point: pair, and where both come."""
        pair = np.repeat(np.arange(len(a)), self.children[a])
        child = _ranges(self.first_child[a], self.children[a])
        at, known = _found(self.node_key, b[pair] * self.width + self.label[child])
        return pair[known], child[known], at[known] + 1

    def _walk(self, a: np.ndarray, b: np.ndarray, reach: int | None, found: list) -> None:
        """Pairs of words that go on alike from the nodes ``a`` and ``b``."""
        levels = self._live(a, b, reach)
        for keys, live in levels:
            at, known = _found(keys, self.state[a] * len(self.final) + self.state[b])
            known &= live[at] if len(live) else False
            a, b = a[known], b[known]
            self._accept(a, b, found)
            _, a, b = self._read(a, b)

    def _live(self, a, b, reach) -> list[tuple[np.ndarray, np.ndarray]]:
        """Composed states from those of ``a`` and ``b`` on, step by step, and whether an
        end can be reached from each."""
        size = len(self.final)
        keys, steps = np.unique(self.state[a] * size + self.state[b]), []
        while len(keys):
            s, t = keys // size, keys % size
            if reach is not None:
                near = (self.height[s] <= reach) & (self.height[t] <= reach)
                keys, s, t, reach = keys[near], s[near], t[near], reach - 1
            pair = np.repeat(np.arange(len(s)), self.arc_count[s])
            arc = _ranges(self.arc_first[s], self.arc_count[s])
            at, known = _found(self.arc_key, t[pair] * self.width + self.arc_label[arc])
            onward = self.arc_state[arc[known]] * size + self.arc_state[at[known]]
            steps.append((keys, self.final[s] & self.final[t], pair[known], onward))
            keys = np.unique(onward)
        levels, after, live_after = [], np.zeros(0, np.int64), np.zeros(0, bool)
        for keys, live, pair, onward in reversed(steps):
            at, known = _found(after, onward)
            if len(after):
                live[pair[known & live_after[at]]] = True
            levels.append((keys, live))
            after, live_after = keys, live
        return levels[::-1]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether it is there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges from ``begin``, ``size`` long, one after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - before, size)


def _chunks(nodes: np.ndarray, children: np.ndarray, most: int = 1_000_000) -> Iterator[np.ndarray]:
    """``nodes`` in chunks that make about ``most`` pairs of children."""
    group = np.cumsum(children * children) // most
    yield from np.split(nodes, np.flatnonzero(np.diff(group)) + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _common_with_previous(labels: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Code points that each word has in common with the one before it."""
    common = np.zeros(len(length), np.int64)
    active, d = np.arange(1, len(length)), 0
    while len(active):
        active = active[(length[active] > d) & (length[active - 1] > d)]
        active = active[labels[begin[active] + d] == labels[begin[active - 1] + d]]
        d += 1
        common[active] = d
    return common
