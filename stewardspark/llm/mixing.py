"""Mixing sources to target weights, by Sainte-Lague apportionment of word blocks."""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stewardspark.llm.common import SPACE, ranked, stored

BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
MOST = 3
SEED = 7


def n_words(text: Column) -> Column:
    """Words are runs of characters other than the six ASCII white spaces."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    ends = (F.element_at(parts, 1) == "").cast("long") + (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    ).cast("long")
    return F.size(parts).cast("long") - ends


def source_targets(sizes: DataFrame, weights: Sequence[float], most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with ``source_no`` and ``target``, in words.

    Sources in code-point order, null last, get ``weights`` in turn and share all
    words by them. A target stops at ``most`` times its source's size; the excess
    is shared again by weight until none is above. Each round is one sum over the
    sources, and each but the last stops one source more at least.
    """
    order = (F.col("source").isNull(), F.col("source"))
    turn = F.pmod("source_no", F.lit(len(weights))).cast("int") + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)
    numbered = ranked(sizes, *order, name="source_no")
    sources = stored(numbered.withColumn("weight", weight), "sources")
    most_words = F.col("source_size") * F.lit(most)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, stopped = 0.0, -1
    while total:
        over = F.col("weight") * F.lit(share) > most_words
        n, used, free = sources.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, most_words)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == stopped or not free:
            break
        share, stopped = max(share, (total - used) / free), n
    target = F.least(F.col("weight") * F.lit(share), most_words.cast("double"))
    return sources.withColumn("target", target)


def sainte_lague(groups: DataFrame, key: str, unit: str | None = None) -> DataFrame:
    """``groups`` (key, claim, seats, ...) with ``quota``, whole seats, within each ``unit``.

    A group with claim c wins a seat for each of its quotients c/1, c/3, c/5, ...
    that is among the highest of its unit. Rounding each claim's share gives nearly
    that; what the sum lacks or exceeds, half a seat a group at most, goes by the
    next quotients up, or the last ones down. A group can gain or lose no more than
    its share of that, and one: so few quotients are written out and ranked.
    """
    keys = [unit] if unit else []
    plain = F.floor(F.col("_share") * F.col("seats") + F.lit(0.5)).cast("long")
    totals = (F.sum("claim").alias("_claims"), F.count("*").alias("_groups"))
    if unit:
        groups = groups.join(groups.groupBy(unit).agg(*totals), unit)
    else:
        claims, number = groups.agg(*totals).first()
        groups = groups.withColumns({"_claims": F.lit(claims).cast("double"), "_groups": F.lit(number)})
    share = F.when(F.col("_claims") > 0, F.col("claim") / F.col("_claims")).otherwise(F.lit(0.0))
    groups = stored(groups.withColumn("_share", share).withColumn("_plain", plain), "groups")
    given = F.sum("_plain").alias("_given")
    if unit:
        groups = groups.join(groups.groupBy(unit).agg(given), unit)
    else:
        groups = groups.withColumn("_given", F.lit(groups.agg(given).first()[0]))
    groups = groups.withColumn("_open", F.col("seats") - F.col("_given"))
    most = F.ceil(F.col("_share") * F.col("_groups") / 2 + 1)
    nexts = groups.filter("_open <> 0 AND _claims > 0").select(
        *keys, key, "claim", "_plain", "_open", F.explode(F.sequence(F.lit(0), most - 1)).alias("_k")
    )
    up = -F.col("claim") / (2 * (F.col("_plain") + F.col("_k")) + 1)
    down = F.col("claim") / (2 * (F.col("_plain") - F.col("_k")) - 1)
    nexts = nexts.withColumn("_order", F.when(F.col("_open") > 0, up).otherwise(down))
    nexts = nexts.filter("_open > 0 OR _plain - _k >= 1")
    if unit:
        place = F.row_number().over(Window.partitionBy(unit).orderBy("_order", key, "_k")) - 1
        nexts = nexts.withColumn("_rank", place)
    else:
        nexts = ranked(nexts, F.col("_order"), F.col(key), F.col("_k"), name="_rank")
    moved = nexts.filter(F.col("_rank") < F.abs("_open")).groupBy(*keys, key)
    moved = moved.agg((F.count("*") * F.first(F.signum("_open"))).cast("long").alias("_moved"))
    quota = F.col("_plain") + F.coalesce("_moved", F.lit(0))
    return groups.join(moved, [*keys, key], "left").withColumn("quota", quota)


def _overlap(first: Column, last: Column) -> tuple[Column, Column]:
    """The part of a document's words that lies in the span from first to last."""
    begin = F.greatest("_begin", first)
    end = F.least(F.col("_begin") + F.col("size"), last)
    return begin - F.col("_begin"), F.greatest(end, begin) - F.col("_begin")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    most: int = MOST,
    seed: int = SEED,
    keep: Sequence[str] = (),
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, passes, spans, kept) of each row.

    ``size`` is the number of words (null text: 0), ``target`` the words its
    source should give (see ``source_targets``), ``taken`` the words the mix takes
    from the row: ``passes`` times the whole and the words of ``spans``, pairs of
    first and last (exclusive) word. No row exceeds ``most`` times its size.
    ``kept`` is a struct of the columns ``keep``, whatever their names; it is joined to
    the rows' plan in the end, so that no text is sorted.

    All words of all targets make blocks of ``block_words``, apportioned to
    sources by highest quotients, then each source's to its shards by their sizes.
    A shard is a bounded part of a source, so a source with a third of all rows is
    many groups. In a shard rows lie in seeded order; its quota takes whole rounds
    of it, and what is left takes that many blocks from a seeded block on, going
    round. Reruns agree, whatever the partitions. Equal rows count one by one, a
    null source is a source of its own, empty texts take nothing, an empty table
    gives an empty result.
    """
    rows, mixed = _plan(
        docs, weights, block_words, shard_words, most, seed, keep, id_column, text_column, source_column
    )
    if not keep:
        return mixed.drop("row").withColumn("kept", F.struct(F.lit(0).alias("none")))
    return rows.select("row", "kept").join(mixed, "row").drop("row")


def _plan(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    most: int = MOST,
    seed: int = SEED,
    keep: Sequence[str] = (),
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Numbered rows with ``kept``, and what the mix takes of each row by its number."""
    size = n_words(F.col(text_column))
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            size.alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column)).alias("_place"),
            F.struct(*[docs[c] for c in keep] or [F.lit(0).alias("none")]).alias("kept"),
        ),
        "sized",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, most)
    words = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    seats = F.lit(round(words / block_words))
    claims = sources.withColumns({"claim": F.col("target"), "seats": seats.cast("long")})
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    sources = stored(
        sainte_lague(claims, "source_no").select(
            "source", "source_no", "source_size", "target", "quota", shards.alias("shards")
        ),
        "quotas",
    )
    same = rows["source"].eqNullSafe(sources["source"])
    placed = rows.join(sources.select(F.col("source"), "source_no", "shards"), same).select(
        "row", "doc_id", "size", "_place", "source_no",
        F.pmod(F.col("_place"), F.col("shards")).cast("int").alias("shard"),
    )
    held = placed.groupBy("source_no", "shard").agg(F.sum("size").cast("double").alias("claim"))
    held = held.join(sources.drop("source"), "source_no").withColumnRenamed("quota", "seats")
    quotas = sainte_lague(held, "shard", "source_no")
    length = F.col("claim").cast("long")
    wanted = F.least(F.col("quota") * block_words, length * most)
    start = F.pmod(
        F.xxhash64(F.lit(seed), "source_no", "shard"), F.ceil(length / block_words)
    ) * F.lit(block_words)
    quotas = quotas.select(
        "source_no", "shard", "source_size", "target", length.alias("_length"),
        F.when(length > 0, F.floor(wanted / length)).otherwise(0).cast("int").alias("passes"),
        F.when(length > 0, wanted % length).otherwise(0).alias("_rest"),
        F.when(length > 0, start).otherwise(0).alias("_start"),
    )
    order = Window.partitionBy("source_no", "shard").orderBy("_place", "doc_id", "size", "row")
    placed = placed.withColumn("_begin", F.sum("size").over(order) - F.col("size"))
    mixed = placed.join(quotas, ["source_no", "shard"])
    stop = F.col("_start") + F.col("_rest")
    spans = F.array(
        *[
            F.struct(first.cast("long").alias("first"), last.cast("long").alias("last"))
            for first, last in (
                _overlap(F.col("_start"), F.least(stop, F.col("_length"))),
                _overlap(F.lit(0), stop - F.col("_length")),
            )
        ]
    )
    mixed = mixed.withColumn("spans", F.filter(spans, lambda span: span["last"] > span["first"]))
    partly = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, span: n + span["last"] - span["first"]
    )
    taken = (F.col("passes") * F.col("size") + partly).alias("taken")
    mixed = mixed.select("row", "doc_id", "size", "source_size", "target", taken, "passes", "spans")
    return rows, (stored(mixed, "mix-plan") if keep else mixed)


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
    """The part of a text from its first to its last word, white space between them as it is."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def cut(text: str, first: int, last: int) -> str:
        begin = end = 0
        for i, found in enumerate(word.finditer(text)):
            if i == first:
                begin = found.start()
            if i == last - 1:
                end = found.end()
                break
        return text[begin:end]

    parts = [text and cut(text, first, last) for text, first, last in zip(texts, firsts, lasts, strict=True)]
    return pd.Series(parts, dtype=object)


def mixed_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """The mix itself, in the columns of ``docs``: whole texts as often as they are
    taken, and cut texts, their ``n_chars`` (if there) counted again, where a part is
    taken. Texts move once, to meet the plan; only those to be cut go to Python."""
    names = docs.columns
    rows, mixed = _plan(docs, keep=names, id_column=id_column, text_column=text_column, **options)
    whole = F.struct(F.lit(0).cast("long").alias("first"), F.col("size").cast("long").alias("last"))
    pieces = F.concat(F.array_repeat(whole, F.col("passes")), "spans").alias("pieces")
    # A row of the plan for each document: no side has a bound that would allow a broadcast.
    plan = mixed.filter("taken > 0").select("row", "size", pieces).hint("merge")
    taken = rows.select("row", "kept").join(plan, "row").select("kept", "size", F.explode("pieces").alias("piece"))
    full = (F.col("piece.first") == 0) & (F.col("piece.last") == F.col("size"))
    text = F.col("kept")[text_column]
    cut = _cut(F.when(~full, text), F.col("piece.first"), F.col("piece.last"))
    taken = taken.withColumn("_cut", cut)
    changed = {text_column: F.when(full, text).otherwise(F.col("_cut"))}
    if "n_chars" in names:
        again = F.length("_cut").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(full, F.col("kept")["n_chars"]).otherwise(again)
    return taken.select(*[changed.get(c, F.col("kept")[c]).alias(c) for c in names])
