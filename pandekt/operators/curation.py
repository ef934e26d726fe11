"""Gold curation and corpus audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pandekt.functions.ids import base_id, unit_type
from pandekt.functions.text import WORD
from pandekt.operators import quantiles as qt
from pandekt.operators.ordered import MAX_GROUP, row_positions, top_k
from pandekt.session import cut_lineage

# ---------------------------------------------------------------- gold tables


def apply_gold(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates with ``is_gold``; see ``stray_gold`` for the gate before writing."""
    g = gold.select("qid", "chunk_id").distinct().withColumn("is_gold", F.lit(True))
    return candidates.join(g, ["qid", "chunk_id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))


def stray_gold(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold that is not among the candidates; any row blocks the write."""
    return gold.select("qid", "chunk_id").distinct().join(candidates.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")


def overlapping_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Questions named by two gold maps that should be disjoint."""
    return a.select("qid").intersect(b.select("qid"))


def checked_gold(candidates: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """Apply several disjoint gold maps; strays or overlaps are errors."""
    gold = maps[0]
    for m in maps[1:]:
        if overlapping_maps(gold, m).take(1):
            raise ValueError("gold maps overlap")
        gold = gold.unionByName(m)
    bad = stray_gold(candidates, gold).limit(10).collect()
    if bad:
        raise ValueError(f"gold outside the candidates, for example: {[tuple(r) for r in bad]}")
    return apply_gold(candidates, gold)


def gold_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("qid").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("is_gold").alias("n_gold"))


BOILERPLATE = "[da completare]"


def gold_entries(queries: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Long-format gold answers: one row per (question, gold chunk), or one without chunk.

    Questions with gold are positive, else edge when expected so, else
    negative; only those carry boilerplate. A question may have any number of
    gold chunks, so they stay rows instead of a list.
    """
    g = gold.select("qid", "chunk_id").distinct().join(chunks.select("chunk_id", F.array_join("hierarchy_path", " > ").alias("hierarchy"), "text"), "chunk_id")
    j = queries.select("qid", "use_case", "expected_kind").join(g, "qid", "left")
    kind = F.when(F.col("chunk_id").isNotNull(), "positive").when(F.col("expected_kind") == "edge", "edge").otherwise("negative")
    return j.select("qid", "use_case", kind.alias("query_type"), "chunk_id", "hierarchy", "text",
                    F.when(F.col("chunk_id").isNull(), BOILERPLATE).alias("notes"))


ENTRY_FIELDS = ["qid", "use_case", "query_type", "question", "gold_chunks", "gold_answer", "has_corpus_limit_declaration",
                "runtime_corpus_limit_observed", "review_status", "notes"]
QUERY_TYPES = ["positive", "negative", "edge"]


def schema_checks(entries: DataFrame, raw: str, limit_pattern: Callable[[Column], Column], cite_re: str) -> DataFrame:
    """Seven pass/fail checks over gold entries, one row each.

    entries(qid, query_type, gold_chunks array<struct<chunk_id, text>>,
    has_corpus_limit_declaration, gold_answer, <raw> JSON record).
    """
    keys = F.json_object_keys(F.col(raw))
    want = F.array(*[F.lit(f) for f in ENTRY_FIELDS])
    same = (F.size(F.array_except(keys, want)) == 0) & (F.size(F.array_except(want, keys)) == 0)
    kind, g, a = F.col("query_type"), F.col("gold_chunks"), F.col("gold_answer")
    positive = kind == "positive"
    blank = F.exists(g, lambda x: (F.coalesce(x["chunk_id"], F.lit("")) == "") | (F.coalesce(x["text"], F.lit("")) == ""))
    cites = F.regexp_count(a, F.lit(cite_re))
    rules = {
        "fields": ~same,
        "enum": ~kind.isin(QUERY_TYPES),
        "gold_present": positive & (F.size(g) == 0),
        "text_filled": positive & blank,
        "limit_pattern": F.col("has_corpus_limit_declaration") & ~limit_pattern(a),
        "citations": (positive & (F.size(g) > 0) & (cites == 0)) | ((kind == "negative") & (F.size(g) == 0) & (cites > 0)) | a.rlike(r"\[cite:[^\]]+\]\[cite:"),
    }
    one = entries.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in rules.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("failed")) for name in rules])
    per = one.select("n", F.inline(rows)).select("check", (F.col("n") - F.col("failed")).alias("passed"), "failed")
    uniq = entries.groupBy("qid").count().agg(
        F.count_if(F.col("count") == 1).alias("passed"), F.count_if(F.col("count") > 1).alias("failed")).select(F.lit("unique").alias("check"), "passed", "failed")
    return per.unionByName(uniq)


def id_set_check(ids: DataFrame, expected: DataFrame, key: str = "qid") -> DataFrame:
    """Ids missing from, or unexpected in, a complete id set."""
    missing = expected.select(key).exceptAll(ids.select(key)).withColumn("problem", F.lit("missing"))
    extra = ids.select(key).exceptAll(expected.select(key)).withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def populate_payload(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold ids with path and text filled in by id (null when absent)."""
    return gold.join(chunks.select("chunk_id", "hierarchy", "text"), "chunk_id", "left")


def populate_summary(populated: DataFrame) -> DataFrame:
    d = populated.select("chunk_id", F.col("text").isNotNull().alias("_ok")).distinct()
    return d.agg(F.count(F.lit(1)).alias("required"), F.count_if("_ok").alias("populated"), F.count_if(~F.col("_ok")).alias("missing"))


def crosstab_stats(entries: DataFrame, kind: str, flag: str, norms: DataFrame, subset: Column) -> DataFrame:
    """Counts by type, by flag, by both and by law touched, per subset and overall.

    ``norms`` is (qid, norm); a question counts once per law it touches.
    """
    e = entries.select("qid", F.col(kind).cast("string").alias("kind"), F.col(flag).cast("string").alias("flag"),
                       F.explode(F.array(subset, F.lit("all"))).alias("subset"))
    crossed = e.groupingSets([["subset", "kind"], ["subset", "flag"], ["subset", "kind", "flag"], ["subset"]], "subset", "kind", "flag").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    # Grouping id over (subset, kind, flag): 0 both, 1 kind only, 2 flag only, 3 neither.
    measure = F.when(F.col("_g") == 0, "type_x_flag").when(F.col("_g") == 1, "type").when(F.col("_g") == 2, "flag").otherwise("n")
    key = F.when(F.col("_g") == 0, F.concat_ws("/", F.coalesce("kind", F.lit("null")), F.coalesce("flag", F.lit("null")))).when(
        F.col("_g") == 1, F.coalesce("kind", F.lit("null"))).when(F.col("_g") == 2, F.coalesce("flag", F.lit("null"))).otherwise(F.lit("all"))
    counts = crossed.select("subset", measure.alias("measure"), key.alias("key"), "n")
    touched = e.select("qid", "subset").join(norms.select("qid", "norm").distinct(), "qid").groupBy("subset", "norm").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(touched.select("subset", F.lit("norm").alias("measure"), F.col("norm").alias("key"), "n"))


# ------------------------------------------------------------------- overlap

# Frequent words that carry no topic.
STOPWORDS = [
    "a", "ai", "al", "alla", "alle", "agli", "allo", "che", "ci", "come", "con", "cui",
    "da", "dai", "dal", "dalla", "dalle", "dello", "degli", "delle", "di", "del", "della",
    "e", "ed", "è", "i", "il", "in", "la", "le", "lo", "ne", "nel", "nella", "nelle",
    "non", "o", "ogni", "per", "più", "quale", "quali", "quando", "quanto", "se", "si",
    "sia", "sono", "su", "sui", "sul", "sulla", "sulle", "tra", "fra", "un", "una", "uno",
    "ad", "anche", "ancora", "alcuni", "alcune", "altri", "altre", "altro", "altra",
    "essere", "stato", "stata", "stati", "state", "ha", "ho", "hanno", "questo", "questa",
    "questi", "queste", "tutto", "tutta", "tutti", "tutte", "molto", "molti", "molte",
    "loro", "mio", "mia", "miei", "mie", "suo", "sua", "suoi", "sue", "nostro", "nostra",
    "vostro", "vostra", "co",
]


def topic_words(text: Column, stopwords: list[str] | None = None) -> Column:
    """Distinct lower-case words (with ' and -) longer than two characters, no digits-only."""
    stop = F.array(*[F.lit(w) for w in (STOPWORDS if stopwords is None else stopwords)])
    w = F.regexp_extract_all(F.lower(text), F.lit(WORD[:-1] + r"'-]+"), F.lit(0))
    return F.array_except(F.filter(F.array_distinct(w), lambda t: (F.length(t) > 2) & ~t.rlike(r"^\d+$")), stop)


HIGH_OVERLAP, SOME_OVERLAP = 0.40, 0.20


def best_overlap(new: DataFrame, old: DataFrame, stopwords: list[str] | None = None, probe: int = 3, digits: int = 9) -> DataFrame:
    """Most similar old question per new one by Jaccard of topic words, with flag.

    new/old: (qid, text, norms array<string>). The pool of a new question is
    the old ones with the same law set, else those with overlapping sets;
    without either it is flagged as a new area and gets no partner. Ties go to
    the smaller id; nothing in common gives similarity 0.

    Exact without comparing all pairs, by a bound that falls along a question's
    words, rarest first. Old questions are looked up by word and law set, so
    only those of the right pool meet. First comes, for every word, the one
    shortest old question with it; the best of these is the lower bound b, above
    0 wherever there is any partner. A partner first met at word i shares at most
    the words from i on, on either side, and these s words allow a similarity of
    s / (size + old size - s): a word is looked up while that can reach b, and an
    old question compared if its own length and position allow it. The ``probe``
    rarest words go first and lift b for the others.
    """
    n = new.select("qid", "norms", topic_words(F.col("text"), stopwords).alias("w"))
    o = old.select(F.col("qid").alias("old_qid"), F.col("norms").alias("old_norms"), topic_words(F.col("text"), stopwords).alias("ow"))
    df = o.select(F.explode("ow").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def ordered(rows: DataFrame, key: str, words: str) -> DataFrame:
        """(key, t, left): known words, rarest first; ``left`` counts the words from this one on."""
        known = rows.select(key, F.explode(words).alias("t")).join(df, "t").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("k"))
        return known.select(key, F.size("k").alias("m"), F.posexplode("k.t").alias("at", "t")).select(key, "t", "at", (F.col("m") - F.col("at")).alias("left"))

    pools = _pool_level(n, o)
    set_key = lambda c: F.concat(F.lit("="), F.array_join(F.array_sort(c), "\x1f"))
    one_key = lambda c: F.transform(F.array_distinct(c), lambda x: F.concat(F.lit("+"), x))
    keys = n.join(pools.filter("pool < 2"), "qid").select("qid", F.explode(F.when(F.col("pool") == 0, F.array(set_key("norms"))).otherwise(one_key("norms"))).alias("law"), F.size("w").alias("size"))
    asked = cut_lineage(ordered(n, "qid", "w").join(keys, "qid"))
    held = cut_lineage(ordered(o, "old_qid", "ow").join(o.select("old_qid", F.size("ow").alias("old_size"), F.explode(F.concat(F.array(set_key("old_norms")), one_key("old_norms"))).alias("law")), "old_qid").select(
        "old_qid", "t", "law", F.col("left").alias("old_left"), "old_size"))

    def score(pairs: DataFrame) -> DataFrame:
        """Distinct (qid, old_qid) pairs of the right pool with their similarity."""
        j = pairs.distinct().join(n, "qid").join(o, "old_qid").join(pools, "qid")
        same = F.array_sort("norms") == F.array_sort("old_norms")
        j = j.filter(F.when(F.col("pool") == 0, same).otherwise(F.arrays_overlap("norms", "old_norms") & ~same))
        inter = F.size(F.array_intersect("w", "ow"))
        return j.select("qid", "old_qid", F.round(inter / (F.size("w") + F.size("ow") - inter), digits).alias("jaccard"))

    best_of = lambda pairs: pairs.groupBy("qid").agg(F.min_by(F.struct("old_qid", "jaccard"), F.struct((-F.col("jaccard")).alias("j"), "old_qid")).alias("b"))
    shortest = held.groupBy("law", "t").agg(F.min_by("old_qid", F.struct("old_size", "old_qid")).alias("old_qid"))
    found = cut_lineage(score(asked.join(shortest, ["law", "t"]).select("qid", "old_qid")))
    reach = lambda s, a, b: F.round(s / (a + b - s), digits)
    # The last word alone leads to nothing better than the shortest old question with it.
    for stage in (F.col("at") < probe, F.col("at") >= probe):
        open_ = asked.filter(stage & (F.col("left") > 1)).join(best_of(found), "qid").filter(reach(F.col("left"), F.col("size"), F.col("left")) >= F.col("b.jaccard"))
        s = reach(F.least("left", "old_left"), F.col("size"), F.col("old_size"))
        better = (s > F.col("b.jaccard")) | (s == F.col("b.jaccard")) & (F.col("old_qid") < F.col("b.old_qid"))
        more = score(open_.join(held, ["law", "t"]).filter(better).select("qid", "old_qid"))
        found = cut_lineage(found.unionByName(more))
    best = best_of(found)
    out = n.join(pools, "qid").join(best, "qid", "left").join(o.select(F.col("old_qid").alias("_k"), "ow"), F.col("b.old_qid") == F.col("_k"), "left")
    j = F.coalesce("b.jaccard", F.lit(0.0))
    flag = F.when(F.col("pool") == 2, "new_area").when(j >= HIGH_OVERLAP, "high").when(j >= SOME_OVERLAP, "some").otherwise("distinct")
    return out.select("qid", F.col("b.old_qid").alias("old_qid"), j.alias("jaccard"), flag.alias("flag"),
                      F.coalesce(F.array_sort(F.array_intersect("w", "ow")), F.array().cast("array<string>")).alias("shared"))


def _pool_level(n: DataFrame, o: DataFrame) -> DataFrame:
    """0 if an old question has the same law set, 1 if one overlaps, else 2."""
    key = lambda c: F.array_join(F.array_sort(c), "\x1f")
    sets = o.filter(F.size("old_norms") > 0).select(key("old_norms").alias("_set")).distinct().withColumn("_same", F.lit(1))
    singles = o.select(F.explode("old_norms").alias("_m")).distinct()
    some = n.select("qid", F.explode("norms").alias("_m")).join(singles, "_m").select("qid").distinct().withColumn("_over", F.lit(1))
    return n.select("qid", key("norms").alias("_set")).join(sets, "_set", "left").join(some, "qid", "left").select(
        "qid", F.when(F.col("_same").isNotNull(), 0).when(F.col("_over").isNotNull(), 1).otherwise(2).alias("pool"))


def rewrite_ids(lists: DataFrame, mapping: DataFrame, key: str = "qid", max_group: int = MAX_GROUP) -> DataFrame:
    """Replace an id by 1..n ids inside ordered lists, in long format.

    lists(key, pos, chunk_id, ...), mapping(chunk_id, new_pos, new_id);
    positions are renumbered and rewritten rows marked.
    """
    j = lists.join(mapping, "chunk_id", "left").withColumn("rewritten", F.col("new_id").isNotNull()).withColumn(
        "chunk_id", F.coalesce("new_id", "chunk_id")).withColumn("new_pos", F.coalesce("new_pos", F.lit(0))).drop("new_id").withColumnRenamed("pos", "old_pos")
    return row_positions(j, [key], ["old_pos", "new_pos"], "pos", max_group).drop("old_pos", "new_pos")


def append_note(notes: Column, addition: str) -> Column:
    return F.when(F.coalesce(notes, F.lit("")) != "", F.trim(F.concat_ws(" | ", notes, F.lit(addition)))).otherwise(F.lit(addition))


# ------------------------------------------------------------------- audits

UNIT_TYPES = ["article", "article_fragment", "recital", "annex", "annex_point", "other"]


def inventory(chunks: DataFrame, norm: Column | None = None) -> DataFrame:
    """Chunks per law and unit type, with distinct base ids."""
    c = chunks.select(F.col("chunk_id"), (norm if norm is not None else F.substring_index("chunk_id", "__", 1)).alias("norm"))
    c = c.withColumn("unit", unit_type(F.col("chunk_id")))
    counts = c.groupBy("norm").pivot("unit", UNIT_TYPES).agg(F.count(F.lit(1))).na.fill(0)
    bases = c.select("norm", base_id(F.col("chunk_id")).alias("_b")).distinct().groupBy("norm").agg(F.count(F.lit(1)).alias("n_base_ids"))
    return counts.join(bases, "norm")


def gap_analysis(expected: DataFrame, actual: DataFrame, repealed: DataFrame) -> DataFrame:
    """(norm, unit) rows: missing, unexpected or both; missing ones with a cause."""
    e = expected.select("norm", "unit").distinct().withColumn("_e", F.lit(1))
    a = actual.select("norm", "unit").distinct().withColumn("_a", F.lit(1))
    r = repealed.select("norm", "unit").distinct().withColumn("_r", F.lit(1))
    j = e.join(a, ["norm", "unit"], "full_outer").join(r, ["norm", "unit"], "left")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("both")
    return j.select("norm", "unit", status.alias("status"),
                    F.when(F.col("_a").isNull(), F.when(F.col("_r").isNotNull(), "repealed").otherwise("to_investigate")).alias("cause"))


def gap_summary(gaps: DataFrame, digits: int = 6) -> DataFrame:
    g = gaps.groupBy("norm").agg(F.count_if(F.col("status") != "unexpected").alias("n_expected"), F.count_if(F.col("status") == "missing").alias("n_missing"),
                                 F.count_if(F.col("status") == "unexpected").alias("n_unexpected"))
    return g.withColumn("missing_pct", F.when(F.col("n_expected") > 0, F.round(F.col("n_missing") / F.col("n_expected") * 100, digits)).otherwise(F.lit(0.0)))


def gap_impact(gaps: DataFrame, gold: DataFrame) -> DataFrame:
    """Per law: missing units, questions whose gold points at one, priority."""
    missing = gaps.filter("status = 'missing'").select("norm", "unit")
    hit = gold.select("qid", "norm", "unit").join(missing, ["norm", "unit"], "left_semi").select("norm", "qid").distinct().groupBy("norm").agg(
        F.count(F.lit(1)).alias("n_impacted"))
    per = gaps.groupBy("norm").agg(F.count_if(F.col("status") == "missing").alias("n_gap")).join(hit, "norm", "left").withColumn(
        "n_impacted", F.coalesce("n_impacted", F.lit(0).cast("long")))
    return per.withColumn("priority", F.when(F.col("n_gap") == 0, "none").when(F.col("n_impacted") > 0, "high").otherwise("medium"))


def reconcile_counts(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Counted rows per document against expected ones; unexpected documents expect 0."""
    a = actual.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    j = a.join(expected, key, "full_outer")
    zero = F.lit(0).cast("long")
    return j.select(key, F.coalesce("actual", zero).alias("actual"), F.coalesce("expected", zero).alias("expected")).withColumn(
        "ok", F.col("actual") == F.col("expected"))


CANONICAL_ID = r"^[a-z0-9/_.:\-]+__(art_\d+[a-z0-9.\-]*(__paras_\w+_\w+)?|recital_\d+|annex_[IVXLC]+(__point_\d+)?)$"


def malformed_ids(chunks: DataFrame, pattern: str = CANONICAL_ID) -> DataFrame:
    return chunks.select("chunk_id").filter(~F.col("chunk_id").rlike(pattern))


def missing_gold(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    return gold.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def audit_candidates(proposals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question: proposed, existing and missing chunks.

    proposals(qid, cluster, chunk_id), a question without proposals has a null id.
    """
    known = chunks.select("chunk_id").distinct().withColumn("_k", F.lit(1))
    j = proposals.join(known, "chunk_id", "left")
    return j.groupBy("qid", "cluster").agg(
        F.count("chunk_id").alias("proposed"), F.count("_k").alias("existing"),
        F.count_if(F.col("chunk_id").isNotNull() & F.col("_k").isNull()).alias("gap"))


def cluster_audit(audit: DataFrame, limit: float = 70.0, digits: int = 4) -> DataFrame:
    c = audit.groupBy("cluster").agg(F.count_if(F.col("gap") == 0).alias("n_pass"), F.count_if(F.col("gap") > 0).alias("n_fail"))
    pct = F.round(F.col("n_pass") / (F.col("n_pass") + F.col("n_fail")) * 100, digits)
    return c.withColumn("pass_pct", pct).withColumn("flagged", F.col("pass_pct") < limit)


def missing_proposals(proposals: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_id) proposals absent from the corpus."""
    p = proposals.filter(F.col("chunk_id").isNotNull()).select("qid", "cluster", "chunk_id").distinct()
    return p.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def often_missing(missing: DataFrame, at_least: int = 3) -> DataFrame:
    return missing.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_queries")).filter(F.col("n_queries") >= at_least)


def classify_missing(missing: DataFrame, chunks: DataFrame, laws: DataFrame, wrong_prefixes: dict[str, str]) -> DataFrame:
    """Cause of every missing id, first matching rule of a..f.

    laws(norm, max_article, annexes_loaded, repealed_excluded) is a small
    dimension; ``wrong_prefixes`` maps a known wrong law prefix to the right
    one. Fragment existence is an equi-join on the id without split suffix.
    """
    kids = chunks.filter(base_id(F.col("chunk_id")) != F.col("chunk_id")).select(base_id(F.col("chunk_id")).alias("chunk_id")).distinct().withColumn("has_fragments", F.lit(True))
    norm = F.substring_index("chunk_id", "__", 1)
    suffix = F.substring(F.col("chunk_id"), F.length(norm) + 3, F.length("chunk_id"))
    ids = missing.select("chunk_id").distinct().select("chunk_id", norm.alias("norm"), suffix.alias("suffix"))
    j = ids.join(laws, "norm", "left").join(kids, "chunk_id", "left").withColumn("has_fragments", F.coalesce("has_fragments", F.lit(False)))
    number = F.regexp_extract("suffix", r"^art_(\d+)", 1).try_cast("int")
    cause = (
        F.when(F.col("norm").isin(list(wrong_prefixes)), "c").when(F.col("max_article").isNull(), "c")
        .when(F.col("suffix").rlike(r"^art_\d+[a-z\-]*_par_\d+") | F.col("suffix").contains("paragrafo"), "d")
        .when(F.col("suffix").startswith("annex_") & ~F.coalesce(F.col("annexes_loaded"), F.lit(False)), "e")
        .when(F.col("suffix").startswith("art_") & F.coalesce(F.col("repealed_excluded"), F.lit(False)), "b")
        .when(number > F.col("max_article"), "a").when(F.col("has_fragments"), "d").otherwise("f"))
    return j.select("chunk_id", "norm", "suffix", "has_fragments", cause.alias("cause"))


def suggest_repair(classified: DataFrame, chunks: DataFrame, wrong_prefixes: dict[str, str]) -> DataFrame:
    """Per missing id: a replacement id where one exists, and the action."""
    right = F.col("norm")
    for wrong, good in wrong_prefixes.items():
        right = F.when(F.col("norm") == wrong, F.lit(good)).otherwise(right)
    known = F.col("norm").isin(list(wrong_prefixes))
    plain = F.regexp_extract("chunk_id", r"^(.*?__art_\d+[a-z\-]*?)(?:_par_\d+.*|$)", 1)
    target = F.when((F.col("cause") == "c") & known, F.concat(right, F.lit("__"), "suffix")).when((F.col("cause") == "d") & ~F.col("has_fragments"), plain)
    j = classified.withColumn("_target", target).join(
        chunks.select(F.col("chunk_id").alias("_target")).distinct().withColumn("_found", F.lit(True)), "_target", "left")
    found = F.coalesce("_found", F.lit(False))
    action = (F.when(F.col("has_fragments") & (F.col("cause") == "d"), "repair").when(found, "repair")
              .when((F.col("cause") == "c") & known, "discard").when(F.col("cause").isin("a", "b", "e"), "discard")
              .when(F.col("cause") == "c", F.lit(None)).otherwise("replace"))
    return j.select("chunk_id", "cause", action.alias("action"), F.when(found, F.col("_target")).alias("proposal"))


def query_actions(missing: DataFrame, repairs: DataFrame) -> DataFrame:
    """Action per question: repair unless something is to be discarded, discard
    only when nothing else applies, else replace."""
    has = lambda a: F.bool_or(F.coalesce(F.col("action") == a, F.lit(False)))
    per = missing.join(repairs.select("chunk_id", "action"), "chunk_id").groupBy("qid", "cluster").agg(
        has("repair").alias("_p"), has("discard").alias("_d"), has("replace").alias("_s"))
    act = F.when(F.col("_p") & ~F.col("_d"), "repair").when(F.col("_d") & ~F.col("_p") & ~F.col("_s"), "discard").otherwise("replace")
    return per.select("qid", "cluster", act.alias("action"))


def survivors(audit: DataFrame, actions: DataFrame, targets: DataFrame, digits: int = 4) -> DataFrame:
    """Questions that survive curation per cluster against the target."""
    j = audit.join(actions.select("qid", "action"), "qid", "left")
    per = j.filter((F.col("gap") == 0) | F.col("action").isin("repair", "replace")).groupBy("cluster").agg(F.count(F.lit(1)).alias("survivors"))
    t = targets.join(per, "cluster", "left").withColumn("survivors", F.coalesce("survivors", F.lit(0).cast("long")))
    ratio = F.when(F.col("target") > 0, F.round(F.col("survivors") / F.col("target"), digits)).otherwise(F.lit(0.0))
    return t.withColumn("ratio", ratio).withColumn("alert", F.when(F.col("ratio") < 1.0, "under_target").when(F.col("ratio") < 1.5, "at_risk").otherwise(""))


# -------------------------------------------------------------- corpus stats


def corpus_stats(units: DataFrame, doc: str, tokens: str, limits: tuple[int, ...] = (1000, 2000, 4000), max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """Per document: units, token percentiles (nearest rank), counts over the limits."""
    p = qt.order_stats(units, [doc], tokens, {
        "p50": qt.nearest_rank(50), "p90": qt.nearest_rank(90), "p99": qt.nearest_rank(99), "max": lambda n: n}, max_rows)
    c = units.groupBy(doc).agg(*[F.count_if(F.col(tokens) > m).alias(f"over_{m}") for m in limits])
    return p.join(c, doc)


def longest(units: DataFrame, doc: str, key: str, tokens: str, n: int = 5) -> DataFrame:
    return top_k(units, [doc], [F.desc(tokens), F.asc(key)], n)


LETTER_RE = r"(?i)(?:^|[\s\(])([a-z])\)\s"


def has_letter_list(text: Column) -> Column:
    """At least two different letters of an ``a)`` list."""
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LETTER_RE), F.lit(1)), F.lower))) >= 2


def nearest_in_array(sorted_values: Column, pct: float) -> Column:
    n = F.size(sorted_values)
    at = F.bround(F.lit(pct / 100.0) * (n - 1), 0).cast("int") + 1
    return F.when(n > 0, F.element_at(sorted_values, F.greatest(at, F.lit(1)))).otherwise(F.lit(0))


def long_articles(articles: DataFrame, tokens, limit: int = 1000) -> DataFrame:
    """Articles over the limit with their paragraph distribution and list flags.

    articles(doc, article_id, text, paragraphs array<string>); the paragraph
    counts are computed inside the row.
    """
    a = articles.withColumn("tokens", tokens(F.col("text"))).filter(F.col("tokens") > limit)
    per = F.array_sort(F.transform("paragraphs", tokens))
    d = a.withColumn("_p", per)
    return d.select("doc", "article_id", "tokens", F.size("paragraphs").alias("n_paragraphs"),
                    nearest_in_array(F.col("_p"), 50).alias("p50"), nearest_in_array(F.col("_p"), 90).alias("p90"), nearest_in_array(F.col("_p"), 99).alias("p99"),
                    F.coalesce(F.array_max("_p"), F.lit(0)).alias("max"), has_letter_list(F.col("text")).alias("has_letters"),
                    (F.size("paragraphs") == 0).alias("is_monoblock"))


def norm_distribution(gold: DataFrame, n_queries: DataFrame, digits: int = 4) -> DataFrame:
    """Questions per law and their share. gold(qid, norm, unit)."""
    per = gold.select("qid", "norm").distinct().groupBy("norm").agg(F.count(F.lit(1)).alias("n_queries"))
    return per.withColumn("pct", F.round(F.col("n_queries") / n_queries.scalar() * 100, digits))


def norm_breadth(gold: DataFrame) -> DataFrame:
    """How many questions touch one, two, three or more laws."""
    per = gold.select("qid", "norm").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(F.when(F.col("_n") == 1, "mono").when(F.col("_n") == 2, "two").otherwise("three_plus").alias("breadth")).agg(F.count(F.lit(1)).alias("n"))


def unit_distribution(gold: DataFrame) -> DataFrame:
    """Gold chunks per unit type and the distinct questions behind them."""
    u = gold.select("qid", "chunk_id", unit_type(F.col("chunk_id")).alias("unit"))
    n = u.groupBy("unit").agg(F.count(F.lit(1)).alias("n_chunks"))
    q = u.select("unit", "qid").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("n_queries"))
    return n.join(q, "unit")


def first_rule(rules: list[tuple[str, Column]], fallback: str) -> Column:
    """Label of the first rule that holds."""
    out = F.lit(fallback)
    for label, cond in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


# Labels of the use cases and the note on questions that no rule covers.
USE_CASES = {"UC1": "UC1 — GDPR compliance", "UC2": "UC2 — AI Act", "UC3": "UC3 — 231 responsabilità ente", "UC5": "UC5 — NIS2 / cybersecurity"}
FALLBACK_NOTE = "fallback: non classificata da nessuna euristica"
# The words of the rules, in the order of the rules.
AI_WORDS = ["ai act", "fria", "alto rischio", "high-risk", "gpai", "allegato iii", "l. 132/2025"]
PRIVACY_WORDS = ["dpia", "dpo", "gdpr", "considerando", "art 22", "art 5", "art 6 gdpr", "art 9", "art 35", "privacy"]
PENALTY_WORDS = ["sanzione", "sanzioni", "pena", "multa"]
SCENARIO_WORDS = ["ai", "screening", "scoring"]
PROCEDURE_WORDS = ["come si", "quali sono i compiti", "quali compiti", "quali sono i passi"]
CONDITION_WORDS = ["quando", "in quale caso", "ricade tra", "è obbligatoria", "obbligatorio", "applica"]


def use_case_of(use_case: Column, question: Column) -> Column:
    """One of five use cases by keyword, in priority order."""
    uc, q = F.lower(use_case), F.lower(question)
    both = F.concat_ws(" ", uc, q)
    return first_rule([
        (USE_CASES["UC3"], both.contains("231") | uc.contains("reato") | q.contains("responsabilità degli enti")),
        (USE_CASES["UC5"], both.contains("nis2") | uc.contains("obblighi notifica")),
        (USE_CASES["UC2"], contains_any(both, AI_WORDS) | q.contains("art 11")),
        (USE_CASES["UC1"], contains_any(both, PRIVACY_WORDS)),
    ], "?")


def question_type_of(use_case: Column, question: Column, n_norms: Column) -> Column:
    """One of seven question types by keyword, in priority order."""
    uc, q = F.lower(use_case), F.lower(question)
    scenario = (n_norms >= 3) | (q.contains("uso") & contains_any(q, SCENARIO_WORDS))
    return first_rule([
        ("Stress/edge", uc.startswith("stress") | uc.startswith("edge")),
        ("Sanzionatorio", contains_any(q, PENALTY_WORDS)),
        ("Cross-norma scenario", scenario & (n_norms >= 2)),
        ("Lookup definitorio", q.startswith("cos'è") | q.startswith("cosa è") | q.contains("definizione") | F.substring(q, 1, 20).contains("art ")),
        ("Procedurale", q.startswith("come ") | contains_any(q, PROCEDURE_WORDS)),
        ("Condizionale", contains_any(q, CONDITION_WORDS)),
    ], "Altro")


def type_note(question_type: Column) -> Column:
    """A note on questions that no rule covers, else empty."""
    return F.when(question_type == "Altro", F.lit(FALLBACK_NOTE)).otherwise(F.lit(""))


def gold_sampling(gold: DataFrame, doc_urn: str) -> DataFrame:
    """(article, qid) uses of one document's gold, with the use count per article."""
    g = gold.filter(F.col("doc_urn") == doc_urn).select(base_id(F.col("chunk_id")).alias("article"), "qid", "chunk_id").distinct()
    uses = g.groupBy("article").agg(F.count(F.lit(1)).alias("n_gold"))
    return g.select("article", "qid").distinct().join(uses, "article")


def article_integrity(wanted: DataFrame, articles: DataFrame, chunks: DataFrame, limit: int = 2000) -> DataFrame:
    """For listed articles: presence, size, paragraphs, oversize estimate, chunks produced.

    wanted(article_eid), articles(article_eid, title, paragraphs array<string>),
    chunks(article_eid, chunk_type, oversize).
    """
    body = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.array_join("paragraphs", "\n\n"))
    a = articles.select("article_eid", F.lit(True).alias("_present"), F.size("paragraphs").alias("_np"), F.length(body).alias("_nc"), (F.trim(body) != "").alias("_ne"))
    c = chunks.groupBy("article_eid").agg(F.count(F.lit(1)).alias("_chunks"), F.array_join(F.array_sort(F.collect_set("chunk_type")), ",").alias("chunk_types"),
                                          F.count_if(F.coalesce("oversize", F.lit(False))).alias("_over"))
    j = wanted.join(a, "article_eid", "left").join(c, "article_eid", "left")
    return j.select(
        "article_eid", F.coalesce("_present", F.lit(False)).alias("present"), F.coalesce("_ne", F.lit(False)).alias("non_empty"),
        F.coalesce("_np", F.lit(0)).alias("n_paragraphs"), F.coalesce("_nc", F.lit(0)).alias("n_chars"),
        F.coalesce(F.floor(F.col("_nc") / 4) > limit, F.lit(False)).alias("oversize_estimate"), F.coalesce("_chunks", F.lit(0).cast("long")).alias("n_chunks"),
        "chunk_types", F.when(F.col("_chunks").isNull(), "not_chunked").when(F.col("_over") > 0, "oversize").otherwise("ok").alias("warning"))
