"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its token share to the power ``alpha``, normalised. A
bisection finds the exponent that meets a target: an upper limit on repetition
(no source is seen more than that many times as often as the largest one) or
a lower limit on the entropy of the weights. The weights become token budgets,
and each budget is filled from a permutation of the source: whole epochs, then
the start of one more, in blocks whose order and content follow a keyed hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pandekt.llm.common import cut

BLOCK_TOKENS = 1 << 18
#: A block holds about as many documents at most, with or without words.
BLOCK_UNITS = 1 << 16
STEPS = 60
SALTS = 32
SUPER = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _total(shares: Column, alpha: Column, value) -> Column:
    """Sum of ``value(share ** alpha)`` over (share, number of sources) pairs."""
    return F.aggregate(shares, F.lit(0.0), lambda acc, s: acc + s["n"] * value(F.pow(s["share"], alpha)))


def _entropy(shares: Column, alpha: Column) -> Column:
    z = _total(shares, alpha, lambda w: w)
    return F.log(z) - _total(shares, alpha, lambda w: w * F.log(w)) / z


def temperature(sources: DataFrame, repeat_limit: float | None = 2.0, entropy: float | None = None) -> DataFrame:
    """One row: the exponent ``alpha`` in [0, 1], from (source, tokens) rows.

    With ``repeat_limit`` the smallest exponent under which the rarest source is
    seen at most that many times as often as the most common one; with
    ``entropy`` (nats) the largest exponent whose weights reach it, 0 if none does. Sources
    without tokens take no part. The repetition limit needs the smallest and the
    largest source only. For an entropy, sources of equal size are counted
    together, and one row holds an entry per distinct size.
    """
    if (repeat_limit is None) == (entropy is None):
        raise ValueError("give either repeat_limit or entropy")
    sized = sources.filter("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    if repeat_limit is not None:
        ends = F.array(*[F.struct(end("tokens").alias("tokens"), F.lit(1).cast("long").alias("n")) for end in (F.min, F.max)])
        entries = F.when(F.count("tokens") > 0, ends).otherwise(F.array().cast("array<struct<tokens: bigint, n: bigint>>"))
    else:
        entries = F.sort_array(F.collect_list(F.struct("tokens", "n")))
    one = sized.agg(F.sum(F.col("tokens") * F.col("n")).alias("total"), entries.alias("sized"))
    one = one.select(F.transform("sized", lambda s: F.struct((s["tokens"] / F.col("total")).alias("share"), s["n"].cast("double").alias("n"))).alias("shares"))
    shares = F.col("shares")

    def enough(alpha: Column) -> Column:
        """True where the exponent has to grow (repetition) or may grow (entropy)."""
        if repeat_limit is not None:
            return F.pow(F.element_at(shares, -1)["share"] / F.element_at(shares, 1)["share"], F.lit(1.0) - alpha) > F.lit(float(repeat_limit))
        return _entropy(shares, alpha) >= F.lit(float(entropy))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        up = enough(mid)
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    if repeat_limit is not None:
        alpha = F.when(enough(F.lit(0.0)), found["hi"]).otherwise(F.lit(0.0))
    else:
        alpha = F.when(enough(F.lit(1.0)), F.lit(1.0)).otherwise(found["lo"])
    return one.select(F.when(F.size(shares) > 0, alpha).otherwise(F.lit(1.0)).alias("alpha"))


def source_budgets(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                   repeat_limit: float | None = 2.0, entropy: float | None = None, budget_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, sources): units are (source, doc_id, tokens); sources carry alpha, weight, budget, epochs and rest.

    Rows that share an id and a source are one unit. Without ``budget_tokens``
    the budget is the smallest that shows every source at least once.
    """
    rows = docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).cast("long").alias("doc_id"), word_tokens(F.col(text)).alias("tokens"))
    units = cut(rows.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens")), "units")
    sources = cut(units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_units")), "sources")
    alpha = temperature(sources, repeat_limit, entropy).select("alpha").scalar()
    total = sources.agg(F.sum("tokens")).scalar()
    weighed = sources.withColumn("alpha", alpha).withColumn("raw", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.col("alpha"))).otherwise(F.lit(0.0)))
    weighed = cut(weighed, "weights")
    sums = weighed.agg(F.sum("raw").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("raw"))).alias("scale"))
    weighed = weighed.withColumn("weight", F.col("raw") / sums.select("z").scalar())
    if budget_tokens is None:
        share = F.col("raw") * sums.select("scale").scalar()
    else:
        share = F.col("weight") * F.lit(float(budget_tokens))
    budget = F.coalesce(F.round(share, 0).cast("long"), F.lit(0).cast("long"))
    planned = weighed.withColumn("budget", budget)
    # A source without any token is shown once: it costs nothing.
    planned = planned.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1)).cast("long"))
    planned = planned.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)).cast("long"))
    return units, cut(planned.select("source", "tokens", "n_units", "alpha", "weight", "budget", "epochs", "rest"), "budgets")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", repeat_limit: float | None = 2.0,
        entropy: float | None = None, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """The mixture as (source, epoch, block, doc_id, tokens, start): one row per use of a document.

    Epochs count from 0. An epoch permutes the source anew: a keyed hash of the
    document gives its block and its place inside; blocks follow each other by
    number. ``start`` is the number of tokens of the epoch before the document.
    The last epoch of a source takes the documents that end within what the
    budget leaves. Null sources are a source of their own, null ids a document,
    null texts hold no token. Rows that share id and source go together. Other
    columns are ignored. An empty table gives no rows.

    The source table is joined on (source, salt): each source is repeated
    ``SALTS`` times, so that a source with a third of the rows meets it in many
    tasks. Positions are running sums inside a block, plus sums of blocks, plus
    sums of 1,024 blocks: no window holds a source. The number of blocks of a source
    follows its tokens, or its documents where they hold few words.
    """
    units, sources = source_budgets(docs, doc_id, source, text, repeat_limit, entropy, budget_tokens)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    plan = sources.select(key.alias("key"), "epochs", "rest", F.greatest(F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("n_units") / BLOCK_UNITS), F.lit(1)).cast("long").alias("blocks"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = units.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    # Whole epochs, and one more where something is left.
    used = salted.join(plan, ["key", "salt"]).withColumn("epoch", F.explode(F.expr("sequence(0L, epochs - if(rest > 0, 0, 1))")))\
        .filter((F.col("epochs") > 0) | (F.col("rest") > 0))
    name = F.concat_ws("#", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    used = used.withColumn("hash", F.md5(name.cast("binary")))
    used = used.withColumn("block", F.pmod(F.conv(F.substring("hash", 1, 15), 16, 10).cast("long"), F.col("blocks")))
    used = used.withColumn("big", F.expr(f"block div {SUPER}"))
    sums = used.groupBy("key", "epoch", "big", "block").agg(F.sum("tokens").alias("t"))
    in_big = Window.partitionBy("key", "epoch", "big").orderBy("block")
    bigs = sums.groupBy("key", "epoch", "big").agg(F.sum("t").alias("bt"))
    bigs = bigs.withColumn("bbefore", F.sum("bt").over(Window.partitionBy("key", "epoch").orderBy("big")) - F.col("bt")).drop("bt")
    before = sums.withColumn("before", F.sum("t").over(in_big) - F.col("t")).join(bigs, ["key", "epoch", "big"]).select(
        "key", "epoch", "block", (F.col("before") + F.col("bbefore")).alias("before"))
    w = Window.partitionBy("key", "epoch", "block").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = used.withColumn("upto", F.sum("tokens").over(w)).join(cut(before, "blocks"), ["key", "epoch", "block"])
    placed = placed.withColumn("start", F.col("before") + F.col("upto") - F.col("tokens"))
    kept = placed.filter((F.col("epoch") < F.col("epochs")) | (F.col("start") + F.col("tokens") <= F.col("rest")))
    return kept.select("source", "epoch", "block", "doc_id", "tokens", "start")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture uses it; all columns stay as they are."""
    uses = mix(docs, doc_id, source, text, **options).groupBy(F.col("source").alias("_mix_source"), F.col("doc_id").alias("_mix_id")).agg(F.count(F.lit(1)).alias("_mix_uses"))
    same = docs[source].cast("string").eqNullSafe(uses["_mix_source"]) & docs[doc_id].cast("long").eqNullSafe(uses["_mix_id"])
    return docs.join(uses, same).withColumn("_mix_use", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_uses")))).select(*[docs[c] for c in docs.columns])
