"""Style profiles, targets and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.offsets import let, strip
from proofloom.operators.norm import rule_array, rule_hits
from proofloom.operators.parse import TEXT, any_of, paragraph_array, paragraphs, sentence_array
from proofloom.rules import LATIN, Pack, Rule
from proofloom.schema import explode_issues, issue, make_issues, no_issues

CHECKS = ("avoid", "metrics", "sections")


def profile_struct(text: Column, sents: Column, paras: Column, pack: Pack = LATIN) -> Column:
    """Struct of a document's metrics: sentence lengths, densities per character, share of paragraphs with a figure and of
    long paragraphs led by a summary (Y01, Y02)."""
    share = lambda a, cond: F.when(F.size(a) > 0, F.size(F.filter(a, cond)).cast("double") / F.size(a))
    n_chars = F.length(text)
    density = lambda n: F.coalesce(n.cast("double") / F.when(n_chars > 0, n_chars), F.lit(0.0))
    count = lambda name: F.regexp_count(text, F.lit(any_of(pack.words[name]))) if pack.words[name] else F.lit(0)
    lead = any_of(pack.words["lead"])
    lengths = F.filter(F.transform(sents, lambda s: F.length(strip(s["text"]))), lambda n: n >= 4)

    def told(n: Column) -> Column:
        return F.struct(
            F.size(n).cast("bigint").alias("n_sentences"),
            F.coalesce(F.aggregate(n, F.lit(0), lambda s, x: s + x).cast("double") / F.when(F.size(n) > 0, F.size(n)), F.lit(0.0)).alias("mean_sentence"),
            F.coalesce(F.array_max(n), F.lit(0)).cast("bigint").alias("max_sentence"),
            density(F.regexp_count(text, F.lit(r"[$#%&*!|]"))).alias("symbol_density"),
            density(count("hedge")).alias("hedge_density"),
            density(count("absolute")).alias("absolute_density"),
            density(count("avoid")).alias("colloquial_density"),
            F.coalesce(share(paras, lambda p: p["text"].rlike(r"\d")), F.lit(0.0)).alias("data_ratio"),
            F.coalesce(share(F.filter(paras, lambda p: F.length(p["text"]) > 40), lambda p: F.substring(p["text"], 1, 30).rlike(lead)), F.lit(1.0)).alias("lead_ratio"),
            count("europeanised").cast("bigint").alias("europeanised"),
        )

    return let(lengths, told)


def profile(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id and the metrics, one row per document."""
    rows = docs.select("doc_id", TEXT().alias("text"), sentence_array(TEXT(), pack).alias("sents"), paragraph_array(TEXT(), pack).alias("paras"))
    return rows.select("doc_id", profile_struct(F.col("text"), F.col("sents"), F.col("paras"), pack).alias("p")).select("doc_id", "p.*")


def avoid_rules(pack: Pack = LATIN) -> list[Rule]:
    return [Rule(f"avoid-{w}", any_of((w,)), "MINOR", "style", "word to avoid", advice=advice_for(w)) for w in pack.words["avoid"]]


def avoid_issues(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """Words to avoid."""
    return make_issues(rule_hits(docs, avoid_rules(pack)), "style")


def gap_array(metrics: Column, targets: Sequence[tuple[str, float, float]]) -> Column:
    """Array of (metric, value, lo, hi, direction, excess, severity) for each metric of the struct outside its target."""
    told = [F.struct(F.lit(m).alias("metric"), metrics[m].cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for m, lo, hi in targets]

    def judged(x: Column) -> Column:
        bound = F.when(x["value"] < x["lo"], x["lo"]).otherwise(x["hi"])
        excess = F.abs(x["value"] - bound)
        return x.withField("direction", F.when(x["value"] < x["lo"], "low").otherwise("high")).withField("excess", excess).withField("severity", F.when(excess > 0.3 * F.abs(bound), "MINOR").otherwise("INFO"))

    none = F.array().cast("array<struct<metric:string,value:double,lo:double,hi:double,direction:string,excess:double,severity:string>>")
    return F.concat(none, F.transform(F.filter(F.array(*told), lambda x: (x["value"] < x["lo"]) | (x["value"] > x["hi"])), judged)) if told else none


def metric_gaps(profiles: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, metric, value, lo, hi, direction, excess, severity for each metric outside its target.

    profiles: doc_id, preset and one column a metric. targets: preset, metric, lo, hi; the preset is a column of the data.
    """
    metrics = [r["metric"] for r in targets.select("metric").distinct().orderBy("metric").collect()]
    long_form = profiles.unpivot(["doc_id", "preset"], metrics, "metric", "value")
    rows = long_form.join(targets, ["preset", "metric"])
    bound = F.when(F.col("value") < F.col("lo"), F.col("lo")).when(F.col("value") > F.col("hi"), F.col("hi"))
    rows = rows.withColumn("bound", bound).filter("bound IS NOT NULL").withColumn("excess", F.abs(F.col("value") - F.col("bound")))
    direction = F.when(F.col("value") < F.col("lo"), "low").otherwise("high")
    severity = F.when(F.col("excess") > 0.3 * F.abs(F.col("bound")), "MINOR").otherwise("INFO")
    return rows.select("doc_id", "preset", "metric", "value", "lo", "hi", direction.alias("direction"), "excess", severity.alias("severity"))


def missing_sections(docs: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """doc_id, section for each required heading that a document lacks."""
    return docs.select("doc_id", F.explode(F.filter(F.array(*[F.lit(s) for s in sections]), lambda s: ~F.contains(TEXT(), s))).alias("section"))


def style_scores(profiles: DataFrame, gaps: DataFrame) -> DataFrame:
    """doc_id, style_score: 100 less 12 at most per metric outside its target, by how far it is out; not below 0."""
    loss = F.least(F.lit(12.0), 12.0 * F.col("excess") / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)))
    lost = gaps.groupBy("doc_id").agg(F.sum(loss).alias("lost"))
    return profiles.select("doc_id").join(lost, "doc_id", "left").select("doc_id", F.greatest(F.lit(0.0), 100.0 - F.coalesce("lost", F.lit(0.0))).alias("style_score"))


def transfer_plan(gaps: DataFrame) -> DataFrame:
    """doc_id, plan: what to change, in the metrics' order."""
    line = F.concat(metric_advice(F.col("metric"), F.col("direction")), F.lit(" ("), F.format_number("value", 2), F.lit(")"))
    return gaps.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))), lambda x: x["line"]), "; ").alias("plan"))


#: Advice by metric and direction, and by word.
METRIC_ADVICE = {("mean_sentence", "high"): "split sentences", ("mean_sentence", "low"): "join sentences", ("symbol_density", "high"): "drop symbols", ("lead_ratio", "low"): "open paragraphs with their point"}
WORD_ADVICE = {"this": "name what is meant", "which": "start a new sentence"}


def metric_advice(metric: Column, direction: Column) -> Column:
    """Advice for a metric, with a default."""
    table = F.create_map(*[F.lit(x) for (m, d), a in METRIC_ADVICE.items() for x in (f"{m}/{d}", a)])
    return F.coalesce(table[F.concat_ws("/", metric, direction)], F.concat(F.lit("adjust "), metric))


def advice_for(word: str) -> str:
    return WORD_ADVICE.get(word, "choose another word")


def style_array(text: Column, sents: Column, paras: Column, pack: Pack = LATIN, checks: Sequence[str] = CHECKS) -> Column:
    """The engine: words to avoid, metrics out of range, missing sections of one document, by the checks named."""
    gaps = lambda: F.transform(let(profile_struct(text, sents, paras, pack), lambda m: gap_array(m, pack.metrics)), lambda g: issue(F.concat(F.lit("metric-"), g["metric"]), 0, 0, "style", g["severity"], metric_advice(g["metric"], g["direction"]), confidence=0.7))
    lacks = lambda: F.transform(F.filter(F.array(*[F.lit(x) for x in pack.sections]).cast("array<string>"), lambda x: ~F.contains(text, x)), lambda x: issue(F.concat(F.lit("section-"), x), 0, 0, "style", "MINOR", "section is missing"))
    made = {"avoid": lambda: rule_array(text, avoid_rules(pack)), "metrics": gaps, "sections": lacks}
    return F.concat(no_issues(), *[made[c]() for c in checks])


def style_issues(docs: DataFrame, pack: Pack = LATIN, checks: Sequence[str] = CHECKS) -> DataFrame:
    """The engine over documents, as the fact table."""
    rows = docs.select("doc_id", TEXT().alias("text"), sentence_array(TEXT(), pack).alias("sents"), paragraph_array(TEXT(), pack).alias("paras"))
    return explode_issues(rows, "style", style_array(F.col("text"), F.col("sents"), F.col("paras"), pack, checks))


def lead_paragraphs(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """Long paragraphs with whether a summary leads them."""
    return paragraphs(docs, pack).filter(F.length("text") > 40).select("doc_id", "para_idx", F.substring("text", 1, 30).rlike(any_of(pack.words["lead"])).alias("leads"))
