"""Mixing sources to target weights: budgets down a domain-language-source tree.

The budget in tokens is dealt from the root to domains, languages and sources by weight.
A node never gets more than its documents can give in ``epochs`` passes. What a short
leaf leaves over goes to its siblings by weight; only if they are full as well does it
go to the siblings of its parent, and so on up. (Dealing from the root with the
capacity of whole subtrees as the limit does exactly that.) Shares are whole tokens,
rounded down.

Each leaf orders its documents anew in every epoch, by a hash of seed, epoch and doc_id,
and takes the prefix of that stream which its budget covers. Documents stay whole: one
that begins inside the budget is taken. Only the last epoch needs an order, and of that
only the stretch in which the budget ends, found from sums over hash ranges; so no leaf
is sorted as a whole, however large it is.

Defined results
    null text           no tokens; taken like any other where its place is in the prefix
    null level          a child of its own, with the default weight
    null doc_id         hashed like an empty string
    equal doc_ids       stand at the same place, so they are taken together
    weight 0 or below   the child gets nothing
    empty table         no rows
    budget above all    every document ``epochs`` times
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.quality import words_of
from pagesieve.llm.storage import fresh_name, stored

#: Documents in one hash range, about; sets how finely a leaf is cut.
RANGE_DOCUMENTS = 5000
_NUMBER = "decimal(38,0)"


@dataclass(frozen=True)
class Level:
    """One level of the tree: a SQL expression, and the weights of its values."""

    name: str
    value: str
    weights: Mapping[str, int] = field(default_factory=dict)
    default: int = 1

    def weight(self) -> Column:
        value, out = F.col(self.name), F.lit(self.default)
        for key, weight in self.weights.items():
            out = F.when(value == key, F.lit(weight)).otherwise(out)
        return F.greatest(out, F.lit(0)).cast("long")


def token_count(text: Column) -> Column:
    """Tokens of a document for the budget: its words."""
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def shares(nodes: DataFrame, parents: Sequence[str]) -> DataFrame:
    """``nodes`` with ``share``: what each gets of ``budget`` among its siblings.

    Siblings are ordered by how soon they are full, capacity over weight. As the common
    level rises, they fill one after the other; whoever is not full yet gets its weight's
    part of what the full ones leave. Exact in whole numbers.
    """
    order = Window.partitionBy(*parents).orderBy(
        F.col("weight") == 0, F.col("ratio"), F.col("node_key").asc_nulls_first()
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*parents)
    return (
        nodes.withColumn("ratio", F.col("capacity").cast("double") / F.greatest("weight", F.lit(1)))
        .withColumn("full_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(_NUMBER))
        .withColumn(
            "weight_left",
            F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        )
        .withColumn("left", F.greatest(F.col("budget") - F.col("full_before"), F.lit(0)).cast(_NUMBER))
        .withColumn(
            "fills",
            (F.col("weight") > 0)
            & (
                F.col("capacity").cast(_NUMBER) * F.col("weight_left").cast(_NUMBER)
                <= F.col("left") * F.col("weight").cast(_NUMBER)
            ),
        )
        .withColumn("first_open", F.min(F.when(~F.col("fills") & (F.col("weight") > 0), F.struct("ratio", "left", "weight_left"))).over(group))
        .withColumn(
            "share",
            F.when(F.col("weight") == 0, F.lit(0))
            .when(F.col("fills"), F.col("capacity"))
            .otherwise(
                F.expr(
                    f"CAST(first_open.left * CAST(weight AS {_NUMBER}) div "
                    f"greatest(first_open.weight_left, 1) AS BIGINT)"
                )
            )
            .cast("long"),
        )
        .drop("ratio", "full_before", "weight_left", "left", "fills", "first_open")
    )


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[Level], percent: int, epochs: int
) -> DataFrame:
    """``leaves`` (levels, tokens, documents) with ``leaf_budget``.

    The whole budget is ``percent`` of all tokens, rounded down.
    """
    names = [level.name for level in levels]
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    # What lies under a weight of 0 cannot be given out, so it is no capacity either.
    usable = F.col("tokens")
    for level in levels:
        usable = F.when(level.weight() > 0, usable).otherwise(F.lit(0))
    leaves, plain, given = leaves.withColumn("usable", usable), leaves, None
    for depth, level in enumerate(levels):
        above, here = names[:depth], names[: depth + 1]
        nodes = (
            leaves.groupBy(*here)
            .agg((F.sum("usable") * epochs).cast("long").alias("capacity"))
            .withColumn("weight", level.weight())
            .withColumn("node_key", F.col(level.name))
        )
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(total * percent // 100).cast("long"))
        else:
            nodes = _same(nodes, given, above)
        given = shares(nodes, above or [F.lit(0)]).select(*here, F.col("share").alias("budget"))
    return _same(plain, given, names).withColumnRenamed("budget", "leaf_budget")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which nulls are equal; the columns of ``left``, then what is new."""
    new = [c for c in right.columns if c not in keys]
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), on).select("l.*", *(f"r.{c}" for c in new))


def selected(
    docs: DataFrame,
    levels: Sequence[Level],
    *,
    percent: int,
    epochs: int = 1,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    into: str = "mix",
) -> DataFrame:
    """``docs`` with one more column, the struct ``into``.

    Its fields are the levels, ``n_tokens``, ``leaf_budget`` and ``copies``, the number of
    epochs that take the document. An older column of that name is replaced.
    """
    docs = docs.drop(into) if into not in (doc_id, text) else docs
    names = [level.name for level in levels]
    m, leaf, where = (fresh_name(docs, x) for x in ("measures", "leaf", "place"))
    fields = [F.expr(level.value).alias(level.name) for level in levels]
    counted = docs.withColumn(m, F.struct(*fields, token_count(F.col(text)).alias("n_tokens")))
    counted = counted.withColumn(leaf, F.to_json(F.struct(*(F.col(m)[n].alias(n) for n in names))))
    counted = stored(counted, "mixing-tokens")
    leaves = (
        counted.groupBy(*(F.col(m)[n].alias(n) for n in names), F.col(leaf).alias("leaf"))
        .agg(F.sum(F.col(m)["n_tokens"]).alias("tokens"), F.count("*").alias("documents"))
    )
    budgets = leaf_budgets(stored(leaves, "mixing-leaves"), levels, percent, epochs).select(
        "leaf",
        "leaf_budget",
        F.coalesce(F.expr("leaf_budget div nullif(tokens, 0)"), F.lit(0)).alias("whole_epochs"),
        F.coalesce(F.expr("leaf_budget % nullif(tokens, 0)"), F.lit(0)).alias("rest"),
        F.ceil(F.col("documents") / RANGE_DOCUMENTS).cast("long").alias("ranges"),
    )
    budgets = stored(budgets, "mixing-budgets")

    def placed(known: DataFrame) -> DataFrame:
        """Documents with what ``known`` has of their leaf, and their place in the last epoch."""
        own = known.select(F.col("leaf").alias(leaf), F.struct("*").alias(where))
        at = F.md5(
            F.concat_ws(
                ":", F.lit(str(seed)), F.col(where)["whole_epochs"], F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
            ).cast("binary")
        )
        start = F.conv(F.substring(at, 1, 8), 16, 10).cast("long")
        reach = F.shiftright(start * F.col(where)["ranges"], 32)
        return (
            counted.join(own, leaf)
            .withColumn(where, F.col(where).withField("at", at))
            .withColumn(where, F.col(where).withField("range", reach))
        )

    k = F.col(where)
    per_range = (
        placed(budgets)
        .filter(k["rest"] > 0)
        .groupBy(F.col(leaf).alias("leaf"), k["range"].alias("range"), k["rest"].alias("rest"))
        .agg(F.sum(F.col(m)["n_tokens"]).alias("tokens"))
    )
    until = F.sum("tokens").over(Window.partitionBy("leaf").orderBy("range"))
    cuts = (
        per_range.withColumn("until", until)
        .filter((F.col("until") - F.col("tokens") < F.col("rest")) & (F.col("until") >= F.col("rest")))
        .groupBy("leaf")
        .agg(F.min(F.struct("range", (F.col("rest") - F.col("until") + F.col("tokens")).alias("inside"))).alias("cut"))
    )
    known = stored(budgets.join(cuts, "leaf", "left"), "mixing-cuts")
    rows = placed(known)
    in_cut = F.coalesce(k["range"] == k["cut"]["range"], F.lit(False))
    early = F.coalesce(k["range"] < k["cut"]["range"], F.lit(False))
    up_to = Window.partitionBy(leaf).orderBy(k["at"])
    same = Window.partitionBy(leaf, k["at"])
    n = F.col(m)["n_tokens"]
    start = F.sum(n).over(up_to) - F.sum(n).over(same)
    decided = rows.filter(~in_cut).withColumn(where, k.withField("extra", early)).unionByName(
        rows.filter(in_cut).withColumn(where, k.withField("extra", start < k["cut"]["inside"]))
    )
    out = F.struct(
        *(F.col(m)[x].alias(x) for x in names),
        n.alias("n_tokens"),
        k["leaf_budget"].alias("leaf_budget"),
        (k["whole_epochs"] + k["extra"].cast("long")).alias("copies"),
    )
    return decided.withColumn(into, out).drop(m, leaf, where)


def mixed(docs: DataFrame, levels: Sequence[Level], **options) -> DataFrame:
    """The rows of ``docs`` that the budgets take, once for each epoch that takes them."""
    into = fresh_name(docs, "mix")
    taken = selected(docs, levels, into=into, **options).filter(F.col(into)["copies"] > 0)
    again = fresh_name(taken, "again")
    return taken.withColumn(
        again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(into)["copies"]))
    ).drop(into, again)
