"""Aliases and names as tables: as many as there are, matched by a join.

A key matches where its words follow one another in a text, without case and
between word boundaries. The runs of words of a text meet the keys as wholes, for
every number of words that keys have, so keys that begin alike don't meet each
other's texts. Keys of more than ``RUN`` words meet by their first ``RUN`` words and
are then looked for in the text's own words. The cost follows the words of the
texts and the matches, not the number of keys. Texts and keys are merged, never
broadcast: the size of a file says little of the runs and words made from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pandekt.functions.text import words


def _spaced(w: Column) -> Column:
    """Words with a blank on either side of each, so that containing is a match of whole words."""
    return F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))


#: Most words of a run that is compared as a whole.
RUN = 8


def _runs(w: Column, sizes: Column) -> Column:
    """Distinct runs of a text's words, joined by blanks, of every number of words in ``sizes``."""
    def of_size(n: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.array_distinct(F.flatten(F.transform(sizes, of_size)))


def _met(t: DataFrame, k: DataFrame) -> DataFrame:
    """Texts (qid, _w) and keys (_k, ...) whose first words, up to ``RUN``, are a run of the text."""
    head = k.withColumn("_run", F.array_join(F.slice("_k", 1, RUN), " "))
    # One value of at most RUN numbers; without keys there are no runs.
    sizes = k.agg(F.collect_set(F.least(F.size("_k"), F.lit(RUN))))
    return t.withColumn("_sizes", sizes.scalar()).select("qid", F.explode(_runs(F.col("_w"), F.col("_sizes"))).alias("_run")).join(head.hint("merge"), "_run")


def key_matches(texts: DataFrame, keys: DataFrame, qid: str = "qid", text: str = "text", key: str = "key", carry: tuple[str, ...] = ()) -> DataFrame:
    """(qid, key, carry...) for every key row found in a text. Keys without a word match nothing."""
    t = texts.select(F.col(qid).alias("qid"), words(F.col(text)).alias("_w")).filter(F.col("_w").isNotNull())
    k = keys.select(F.col(key).alias("key"), *carry, words(F.col(key)).alias("_k")).filter(F.size("_k") > 0)
    whole = _met(t, k.filter(F.size("_k") <= RUN)).select("qid", "key", *carry)
    # Candidates of more words go back to their text, which is split again there.
    longer = _met(t, k.filter(F.size("_k") > RUN)).join(t.hint("merge"), "qid").filter(_spaced(F.col("_w")).contains(_spaced(F.col("_k")))).select("qid", "key", *carry)
    return whole.unionByName(longer)


def expand_terms_by(texts: DataFrame, aliases: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, expanded): texts with the forms of the aliases found in them, for alias tables of any size.

    aliases(alias_pos, key, forms). Forms follow by alias_pos and position; one
    that is in the text already, or was added before, is left out.
    """
    found = key_matches(texts, aliases, qid, text, carry=("alias_pos", "forms"))
    forms = found.select("qid", "alias_pos", F.posexplode("forms").alias("form_pos", "form")).groupBy("qid").agg(
        F.array_sort(F.collect_set(F.struct("alias_pos", "form_pos", "form"))).alias("_f"))
    base = texts.select(F.col(qid).alias("qid"), F.col(text).alias("_t")).join(forms, "qid", "left")
    fresh = F.filter("_f", lambda x: ~F.lower("_t").contains(F.lower(x["form"])))
    first = F.filter(F.col("_n"), lambda x, i: ~F.exists(F.slice("_n", F.lit(1), i), lambda y: F.lower(y["form"]) == F.lower(x["form"])))
    picked = base.withColumn("_n", fresh).select("qid", "_t", F.transform(first, lambda x: x["form"]).alias("_p"))
    return picked.select("qid", F.when(F.size("_p") > 0, F.concat_ws(" ", F.array("_t"), "_p")).otherwise(F.col("_t")).alias("expanded"))


def detect_entities_by(texts: DataFrame, names: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, entities): ids of names(entity_pos, entity, name) found in a text, each once, by entity_pos."""
    found = key_matches(texts, names, qid, text, key="name", carry=("entity_pos", "entity"))
    each = found.groupBy("qid", "entity").agg(F.min("entity_pos").alias("p")).groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "entity"))), lambda x: x["entity"]).alias("entities"))
    kind = names.schema["entity"].dataType.simpleString()
    return texts.select(F.col(qid).alias("qid")).join(each, "qid", "left").select("qid", F.coalesce("entities", F.array().cast(f"array<{kind}>")).alias("entities"))
