"""Measures of retrieval and of answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.substrings import contained

def golden_match(golden: DataFrame, nodes: DataFrame) -> DataFrame:
    """Golden entries (case_id, expected) and the nodes they mean: part of the id in any case, or the whole name.

    Whole names are joined by their value, parts of ids by their rarest trigram.
    """
    wanted = golden.select("case_id", "expected", F.lower("expected").alias("e"))
    there = nodes.select("id", F.lower("name").alias("n"))
    named = wanted.join(there, F.col("n") == F.col("e")).select("case_id", "expected", "id")
    parts = contained(wanted.select(F.struct("case_id", "expected").alias("needle_id"), F.col("expected").alias("needle")), nodes.select("id", F.col("id").alias("text")))
    return named.unionByName(parts.select("needle_id.case_id", "needle_id.expected", "id")).distinct()


def retrieval_metrics(ranked: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """cases, p_at_1, p_at_k, recall_at_k, mrr of ``ranked`` (case_id, id, rank) against ``golden`` (case_id, id), and the 95 % interval of p_at_1."""
    expected = golden.groupBy("case_id").agg(F.count(F.lit(1)).alias("expected"))
    hits = ranked.where(F.col("rank") <= k).join(golden.select("case_id", "id").distinct(), ["case_id", "id"])
    per = hits.groupBy("case_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("found"))
    cases = expected.join(per, "case_id", "left").select(
        F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("one"),
        (F.coalesce("found", F.lit(0)) / F.lit(float(k))).alias("prec"),
        F.least(F.lit(1.0), F.coalesce("found", F.lit(0)) / F.col("expected")).alias("rec"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
    )
    out = cases.agg(F.count(F.lit(1)).alias("cases"), F.avg("one").alias("p_at_1"), F.avg("prec").alias("p_at_k"), F.avg("rec").alias("recall_at_k"), F.avg("rr").alias("mrr"))
    return out.withColumn("ci95", 1.96 * F.sqrt(F.col("p_at_1") * (1 - F.col("p_at_1")) / F.col("cases")))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases (query, top1, matched) whose first hit changed: fixed, broken, or moved while as right as before.

    Of a query's several rows the first counts, by ``seq`` where there is such a column, else the least.
    """

    def first(runs: DataFrame, name: str) -> DataFrame:
        told = F.struct("top1", "matched")
        return runs.groupBy("query").agg((F.min_by(told, "seq") if "seq" in runs.columns else F.min(told)).alias(name))

    a, b = first(before, "a"), first(after, "b")
    kind = F.when(~F.col("a.matched") & F.col("b.matched"), "fixed").when(F.col("a.matched") & ~F.col("b.matched"), "broken").otherwise("moved")
    return a.join(b, "query").where("not (a.top1 <=> b.top1)").select("query", F.col("a.top1").alias("before"), F.col("b.top1").alias("after"), kind.alias("verdict"))


def regressions(current: DataFrame, baseline: DataFrame, share: float = 0.95) -> DataFrame:
    """Metrics (metric, value) that fell below ``share`` of their baseline."""
    both = current.join(baseline.select("metric", F.col("value").alias("was")), "metric")
    return both.where(F.col("value") < share * F.col("was")).select("metric", "value", "was")


def token_reduction(sizes: DataFrame) -> DataFrame:
    """``sizes`` (naive_chars, capsule_chars): tokens at four characters each, and the share saved."""
    out = sizes.agg(F.sum(F.floor(F.col("naive_chars") / 4)).alias("naive_tokens"), F.sum(F.floor(F.col("capsule_chars") / 4)).alias("capsule_tokens"))
    return out.withColumn("percent", F.round(100.0 * (1 - F.col("capsule_tokens") / F.col("naive_tokens")), 6))


def nearest_rank(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Median, 95th percentile (nearest rank) and maximum per key."""
    return df.groupBy(*keys).agg(
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
        F.max(value).alias("max"),
    )


def content_words(text: Column, stop: tuple[str, ...] = ()) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]{3,})"), F.lit(1)))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def circular_cases(cases: DataFrame, stop: tuple[str, ...] = (), most: int = 4) -> DataFrame:
    """Cases (case_id, query, document) that share over ``most`` content words with what they should find."""
    shared = F.size(F.array_intersect(content_words(F.col("query"), stop), content_words(F.col("document"), stop)))
    return cases.withColumn("shared", shared).where(F.col("shared") > most).select("case_id", "shared")


def citations(answer: Column) -> Column:
    """The names that an answer cites, as ``[name @ place]``: bracketed texts with an @ that has something on either side."""
    inside = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    told = F.filter(inside, lambda x: (F.instr(x, "@") > 1) & (F.trim(F.substring_index(x, "@", 1)) != "") & (F.length(x) > F.instr(x, "@")))
    return F.transform(told, lambda x: F.trim(F.substring_index(x, "@", 1)))


def annotate(answer: Column, valid_names: Column, note: str = "Not among the sources: ") -> Column:
    """The answer, with a last line that names what it cites without a source of that name (whatever the case), each once; else as it is."""
    known = F.transform(F.coalesce(valid_names, F.array().cast("array<string>")), lambda n: F.lower(n))
    wrong = F.filter(citations(answer), lambda n: ~F.array_contains(known, F.lower(n)))
    # Of names that differ in case only the first counts.
    once = F.filter(wrong, lambda n, k: F.array_position(F.transform(wrong, lambda x: F.lower(x)), F.lower(n)) == k + 1)
    return F.when(F.size(once) > 0, F.concat(F.rtrim(answer), F.lit(f"\n\n{note}"), F.array_join(once, ", "))).otherwise(answer)


def contamination(ranked: DataFrame, nodes: DataFrame, excluded: list[str]) -> DataFrame:
    """Files that an index should not have (their path matches one of ``excluded``, with * and ?) and how many results show them; none: clean."""
    patterns = ["^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p) + "$" for p in excluded]
    bad = F.lit(False)
    for p in patterns:
        bad = bad | F.coalesce(F.col("file_path").rlike(p), F.lit(False))
    meant = nodes.where(bad).select("id", "file_path")
    return ranked.join(meant, "id").groupBy("file_path").agg(F.count(F.lit(1)).alias("results"))


def paragraphs(answer: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "\n\n"), lambda p: F.trim(p)), lambda p: p != "")


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) > 0, part / whole).otherwise(0.0)


def groundedness(answers: DataFrame) -> DataFrame:
    """How far ``answers`` keep to their sources, in one row of shares (0 where nothing counts).

    ``answers``: answer, valid_names, must_cite, abstained, answerable, and if
    wanted must_contain, must_not_contain.  Names and contents are compared
    whatever the case.  Citations, paragraphs and must-cite are counted over the
    cases that have an answer; such a case is hit if any name it must cite is
    part of a cited one.  Contents are checked in all cases.
    """
    none = F.array().cast("array<string>")
    absent = {c: none for c in ("must_contain", "must_not_contain") if c not in answers.columns}
    rows = answers.withColumns(absent) if absent else answers

    def small(names: Column) -> Column:
        return F.transform(F.coalesce(names, none), lambda n: F.lower(n))

    answer = F.lower(F.coalesce("answer", F.lit("")))
    said = small(citations(F.col("answer")))
    known, must = small(F.col("valid_names")), small(F.col("must_cite"))
    hit = F.exists(must, lambda m: F.exists(said, lambda n: F.contains(n, m)))
    texts = paragraphs(F.col("answer"))
    wanted, unwanted = small(F.col("must_contain")), small(F.col("must_not_contain"))
    per = rows.select(
        "abstained",
        "answerable",
        F.size(said).alias("cited"),
        F.size(F.filter(said, lambda n: F.array_contains(known, n))).alias("valid"),
        (F.size(must) > 0).cast("int").alias("must"),
        hit.cast("int").alias("got"),
        F.size(texts).alias("paras"),
        F.size(F.filter(texts, lambda p: F.size(citations(p)) == 0)).alias("uncited"),
        (F.size(wanted) + F.size(unwanted)).alias("checks"),
        (F.size(F.filter(wanted, lambda c: F.contains(answer, c))) + F.size(F.filter(unwanted, lambda c: ~F.contains(answer, c)))).alias("passed"),
    )

    def added(c: str) -> Column:
        return F.sum(F.when(F.col("answerable"), F.col(c)))

    right = F.count_if(F.col("abstained") & ~F.col("answerable"))
    return per.agg(
        _share(added("valid"), added("cited")).alias("citation_validity"),
        _share(added("got"), added("must")).alias("must_cite_recall"),
        _share(added("uncited"), added("paras")).alias("uncited_rate"),
        _share(right, F.count_if(~F.col("answerable"))).alias("abstention_recall"),
        _share(right, F.count_if("abstained")).alias("abstention_precision"),
        _share(F.sum("passed"), F.sum("checks")).alias("content_check_rate"),
    )


def line_chunks(files: DataFrame, lines: int = 40) -> DataFrame:
    """Non-overlapping windows of lines of each file (id, text), blank ones left out: id, chunk, start_line, end_line, text."""
    split = files.select("id", F.split("text", "\n").alias("l"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / lines).cast("int")))
    cut = split.select("id", "l", at.alias("chunk"))
    body = F.array_join(F.slice("l", F.col("chunk") * lines + 1, F.lit(lines)), "\n")
    rows = cut.select(
        "id", "chunk", (F.col("chunk") * lines + 1).alias("start_line"), F.least((F.col("chunk") + 1) * lines, F.size("l")).alias("end_line"), body.alias("text")
    )
    return rows.where("trim(replace(replace(text, '\n', ''), '\t', '')) <> ''")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
