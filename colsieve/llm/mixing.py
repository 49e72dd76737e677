"""Operator 5, mixing sources to target weights by temperature.

A source with token share p gets the weight p**a over the sum of all p**a. The exponent a in [0, 1] is found
by bisection, 15 points a step: the largest one whose weights reach a target entropy, or the smallest one
that repeats no source more often than allowed. The weights are then realised as blocks: every source is read in full seeded permutations,
and the last of them only up to the source's token budget. Only DataFrame functions are used; texts of kept
rows are carried through once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsieve.llm.ranks import ranked, unit_interval
from colsieve.sources.scratch import written

#: Each job tries this many exponents between the bounds, which so close in by SECTIONS + 1; ROUNDS jobs leave 1e-12.
SECTIONS, ROUNDS = 15, 10
#: Epochs this close to a whole number are that number.
EPS = 1e-9


def words(text: Column) -> Column:
    """Tokens of a text by default: its runs between ASCII white space, and one for its end."""
    # a letter for each word and the space behind it, so that no array of words is made
    marks = F.regexp_replace(F.ltrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")
    return (F.octet_length(marks) + 1).cast("long")


def temperature_weights(tokens: DataFrame, budget_tokens: float | None = None, entropy: float | None = None, max_epochs: float | None = None) -> DataFrame:
    """``(source, tokens, share, exponent, weight, epochs)`` from ``(source, tokens)``.

    Give either ``entropy`` (as a share of the largest possible, 0..1) or ``max_epochs``. Without
    ``budget_tokens`` the budget is what reads the least repeated source exactly once, so that no row is lost.
    A higher exponent means lower entropy and fewer repeats of the smallest source. Each step of the search is
    one aggregation with SECTIONS exponents at once; the driver gets their sums alone, however many sources
    there are. If no exponent meets the target, the nearest bound (0 for entropy, 1 for repeats) is taken.
    """
    if (entropy is None) == (max_epochs is None):
        raise ValueError("give either entropy or max_epochs")
    positive = tokens.where("tokens > 0")
    total = positive.agg(F.sum("tokens").cast("double").alias("_total"))
    shares = written(positive.crossJoin(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("_total")), "mix-shares")

    def fits(exponents: list[float]) -> list[bool]:
        aggs = [F.count(F.lit(1)).alias("n"), F.first("_total").alias("t")]
        for i, x in enumerate(exponents):
            p = F.pow(F.col("share"), F.lit(x))
            aggs += [F.sum(p).alias(f"z{i}"), F.sum(p * F.lit(x) * F.ln("share")).alias(f"l{i}"), F.max(p / F.col("share")).alias(f"top{i}"), F.min(p / F.col("share")).alias(f"low{i}")]
        r = shares.agg(*aggs).first()
        if not r["n"]:
            return [True] * len(exponents)
        out = []
        for i in range(len(exponents)):
            z, top = r[f"z{i}"], r[f"top{i}"]
            if entropy is not None:
                out.append(r["n"] == 1 or (math.log(z) - r[f"l{i}"] / z) / math.log(r["n"]) >= entropy)
            else:
                out.append((top / r[f"low{i}"] if budget_tokens is None else budget_tokens / r["t"] * top / z) <= max_epochs * (1 + EPS / 10))
        return out

    # in the order of trying: entropy wants the largest exponent that fits, repeats the smallest
    bounds = (0.0, 1.0) if entropy is not None else (1.0, 0.0)
    inside, outside = bounds
    if fits([outside])[0]:
        inside = outside
    else:
        for _ in range(ROUNDS):
            tried = [inside + (outside - inside) * (i + 1) / (SECTIONS + 1) for i in range(SECTIONS)]
            good = fits(tried)
            n = good.index(False) if False in good else SECTIONS
            ends = [inside, *tried, outside]
            inside, outside = ends[n], ends[n + 1]
    a = inside
    p = F.pow(F.col("share"), F.lit(a))
    sums = shares.agg(F.sum(p).alias("_z"), F.min(p / F.col("share")).alias("_low"))
    out = shares.crossJoin(F.broadcast(sums)).withColumn("exponent", F.lit(a)).withColumn("weight", p / F.col("_z"))
    budget = F.lit(float(budget_tokens)) if budget_tokens is not None else F.col("_total") * F.col("_z") / F.col("_low")
    return out.withColumn("epochs", budget * F.col("weight") / F.col("tokens")).drop("_total", "_z", "_low")


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with the source's name (never null), tokens and the id as text."""
    return docs.select(
        "*",
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("_name"),
        tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_tokens"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_key"),
    )


def _shuffle(seed: int, block: Column) -> Column:
    """The place of a row in a block's permutation, as hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}-"), block.cast("string"), F.lit("-"), F.col("_key")).cast("binary"))


def _whole() -> Column:
    return F.floor(F.col("epochs") + EPS).cast("int")


def plan(rows: DataFrame, seed: int, **target: float | None) -> DataFrame:
    """``(_name, tokens, weight, epochs, whole, cut)``: ``whole`` blocks are read in full, then rows up to ``cut`` of one more.

    ``rows`` has ``_name, _tokens, _key`` and is a written table. A row belongs to the part block while the
    tokens before it are under the rest of the budget, so the budget is met to within one text of a source.
    """
    weights = written(temperature_weights(rows.groupBy("_name").agg(F.sum("_tokens").alias("tokens")), **target), "mix-weights")
    part = rows.join(weights.where(F.col("epochs") - _whole() > EPS), "_name").withColumn("_hex", _shuffle(seed, _whole())).withColumn("_at", unit_interval(F.col("_hex")))
    part = written(part.select("_name", "_tokens", "_key", "_hex", "_at", (F.col("epochs") - _whole()).alias("_rest")), "mix-part")
    runs = ranked(part, "_name", "_at", ["_hex", "_key"], measure="_tokens")
    cuts = runs.where(F.col("before") < F.col("_rest") * F.col("group_sum")).groupBy("_name").agg(F.max("_hex").alias("cut"))
    return written(weights.select("*", _whole().alias("whole")).join(cuts, "_name", "left"), "mix-plan")


def _blocks(keyed: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """Each row as often as the plan says, with ``block`` from 0. Plans over Spark's size limit for broadcasts are joined by shuffling."""
    more = F.coalesce((_shuffle(seed, F.col("whole")) <= F.col("cut")).cast("int"), F.lit(0))
    copies = keyed.join(planned, "_name").withColumn("_copies", F.col("whole") + more)
    return copies.where("_copies > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))


def mix(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Callable[[Column], Column] = words, **target: float | None) -> DataFrame:
    """The rows of ``docs``, all their columns, each as often as the mixture takes it.

    ``target``: see :func:`temperature_weights`. Null sources are one source, null texts count as empty (one
    token). Rows with equal ids get the same place in a permutation and are taken or left together. An empty
    table gives an empty table. Columns of ``docs`` may have any name that doesn't begin with an underscore
    and isn't one of this module's own (``block``, ``cut``, ``whole``, ``epochs``, ``weight``, ``tokens``): those are kept aside.
    """
    names = docs.columns
    aside = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(source_col).alias("_s"))
    keyed = _keyed(aside, seed, "_i", "_t", "_s", tokens)
    planned = plan(written(keyed.select("_name", "_tokens", "_key"), "mix-rows"), seed, **target)
    return _blocks(keyed.select("_row", "_name", "_key"), planned, seed).select(*[F.col("_row")[c].alias(c) for c in names])


def schedule(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Callable[[Column], Column] = words, **target: float | None) -> DataFrame:
    """The mixture as a plan for reading: ``id_col, source, tokens, weight, block, place``.

    ``place`` counts from 0 in each block's permutation of a source. Nulls, ties and empty tables as in :func:`mix`.
    """
    keyed = _keyed(docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(source_col).alias("_s")), seed, "_i", "_t", "_s", tokens)
    rows = written(keyed.select("_i", "_s", "_name", "_tokens", "_key"), "mix-rows")
    taken = _blocks(rows, plan(rows, seed, **target), seed)
    taken = taken.withColumn("_hex", _shuffle(seed, F.col("block"))).withColumn("_group", F.concat_ws("/", F.col("block").cast("string"), "_name"))
    taken = written(taken.select("_i", "_s", "_tokens", "_key", "weight", "block", "_hex", "_group", unit_interval(F.col("_hex")).alias("_at")), "mix-taken")
    placed = ranked(taken, "_group", "_at", ["_hex", "_key"])
    return placed.select(F.col("_i").alias(id_col), F.col("_s").alias(source_col), F.col("_tokens").alias("tokens"), "weight", "block", F.col("rank").cast("long").alias("place"))
