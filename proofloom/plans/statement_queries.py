"""Queries over statements: texts made of orders, with figures, headings, figures, citations and references whose faults follow
from the order's number, so that SQL knows every finding without reading a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions.offsets import let
from proofloom.operators import academic, citations, norm, parse, style
from proofloom.plans.sql import hits
from proofloom.rules import LATIN
from proofloom.schema import entries

BASE = 90_000
LAST_YEAR = 2030


def order_references(s: SparkSession, d: str) -> DataFrame:
    """doc_id, num, text: a reference item of each order, of five kinds and in two scripts; each seventh one lacks its year."""
    o = s.read.parquet(f"{d}/orders.parquet").withColumn("k", F.col("o_orderkey").cast("string")).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    key, year = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    dated = F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(", "), year))
    volume = F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(", "), (key % 90 + 1).cast("string")))
    tails = [
        F.concat(F.lit("[J]. Acta of Trade, Part B"), dated, volume, F.lit(": "), (key % 50 + 1).cast("string"), F.lit("-"), (key % 50 + 9).cast("string"), F.lit(".")),
        F.concat(F.lit("[M]. Bern: Hill & Sons"), dated, F.lit(". doi: 10.5555/"), "k", F.lit(".")), F.concat(F.lit("[D]. 上海：某大学"), dated, F.lit("。")),
        F.concat(F.lit("[N]. 晚报, "), "day", F.lit("(7).")), F.concat(F.lit("[EB/OL]. ("), "day", F.lit("). https://example.org/o/"), "k", F.lit(".")),
    ]
    tail = F.element_at(F.array(*tails), (key % 5 + 1).cast("int"))
    names = F.when(key % 3 == 0, F.lit("Ames A, 王明, Orr B, et al")).otherwise(F.lit("Ames A; Orr B"))
    return o.select(key.alias("doc_id"), F.lit(1).alias("num"), F.concat(F.lit("[1] "), names, F.lit(". Order "), "k", F.lit(" of "), "o_orderpriority", tail).alias("text"))


def reference_fields(s, d):
    """Reference items read into fields."""
    out = citations.parsed_references(order_references(s, d))
    return out.select("doc_id", "kind", F.array_join("authors", "|").alias("authors"), "et_al", "title", "container", "place", "publisher", "year", "date", "volume", "issue", "pages", "url", "doi", F.array_join("missing", "|").alias("missing"))


def statements(s: SparkSession, d: str) -> DataFrame:
    """doc_id, text: one statement of each order."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("l"))
    rows = lines.select("doc_id", F.transform("l", lambda x: x["q"]).alias("q"))
    o = F.col("doc_id")
    total = F.aggregate("q", F.lit(0), lambda a, x: a + x) + F.when(o % 3 == 0, 7).otherwise(0)
    parts = F.array_join(F.transform("q", lambda x: F.concat(x.cast("string"), F.lit(" units"))), ", ")
    text = F.concat_ws(
        "\n", F.lit("1. Stock"), F.concat(F.lit("Stock 90,000 units, of which "), parts, F.lit(", total "), total.cast("string"), F.lit(" units, share "), (o % 130).cast("string"), F.lit("% now.")),
        F.when(o % 7 == 0, "3. Rates").otherwise("2. Rates"),
        F.concat(F.lit("rates are 1.5% and "), F.when(o % 4 == 0, "2.125%").otherwise("2.5%"), F.when(o % 5 == 0, "...").otherwise("."), F.when(o % 6 == 0, " (open").otherwise(" (shut)"), F.lit(" see figure 1, "), F.when(o % 2 == 1, "by [2] and [1]").otherwise("by [1] and [3]")),
        F.when(o % 2 == 0, "Figure 2: x").otherwise("Figure 1: x"), F.lit("References"), F.concat(F.lit("[1] A. Title"), (o % 50).cast("string"), F.lit("[J]. 2010: 1-2.")),
        F.concat(F.lit("[2] B. Title"), ((o + F.when(o % 3 == 0, 0).otherwise(1)) % 50).cast("string"), F.lit("[Q]. 2090: 1–3.")),
    )
    return rows.select("doc_id", text.alias("text"))


def _paras(s, d):
    return academic.numeric_paragraphs(statements(s, d))


def statement_numbers(s, d):
    """Facts of the paragraphs with three numbers or more."""
    facts = _paras(s, d).filter(F.startswith("text", F.lit("Stock"))).select("doc_id", F.explode("facts").alias("f"))
    return facts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("f.value").alias("sum"), F.count_if(F.col("f.unit") == "units").alias("n_units"))


def statement_sums(s, d):
    return academic.sum_consistency(_paras(s, d)).select("doc_id", "stated", "computed", "severity")


def statement_shares(s, d):
    return academic.share_consistency(_paras(s, d)).select("doc_id", "stated", F.round("computed", 6).alias("computed"))


def statement_share_range(s, d):
    return academic.share_range(_paras(s, d)).select("doc_id", "stated")


def statement_marks(s, d):
    """Ellipses, thousands commas, uneven percentages, brackets."""
    return norm.mark_faults(statements(s, d))


def statement_numbering(s, d):
    return academic.numbering_jumps(statements(s, d)).select("doc_id", "num", "expected")


def statement_figures(s, d):
    return academic.figure_faults(statements(s, d))


def statement_references(s, d):
    return parse.references(statements(s, d)).select("doc_id", "num", "text")


def statement_citations(s, d):
    return parse.citations(statements(s, d)).select("doc_id", "num")


def statement_faults(s, d):
    """Faults of reference items by themselves."""
    return academic.reference_issues(parse.references(statements(s, d)), LAST_YEAR)


def statement_twins(s, d):
    """Reference items listed twice."""
    found = let(parse.reference_array(parse.paragraph_array(parse.TEXT())), academic.repeated_references)
    return entries(statements(s, d), found).select("doc_id", "num", "first_of")


def statement_findings(s, d):
    """Findings of the whole academic engine by rule."""
    found = academic.academic_issues(statements(s, d), last_year=LAST_YEAR)
    return found.groupBy("rule_id", "category", "severity").agg(F.count("*").alias("n"))


def statement_order(s, d):
    return academic.citation_order(parse.citations(statements(s, d)))


def avoided_words(s, d):
    """Words to avoid in documents."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return style.avoid_issues(docs).select("doc_id", "rule_id", "start", "end", "original", "explain")


NAMES = [statement_numbers, statement_sums, statement_shares, statement_share_range, statement_marks, statement_numbering, statement_figures, statement_references, statement_citations, statement_faults, statement_twins, statement_findings, statement_order, reference_fields, avoided_words]
QUERIES = {f.__name__: f for f in NAMES}

_O = f"""o AS (SELECT l_orderkey AS o, list(l_quantity::INT ORDER BY l_linenumber) AS q FROM lineitem GROUP BY 1),
x AS (SELECT *, list_sum(q)::INT AS total, list_sum(q)::INT + CASE WHEN o % 3 = 0 THEN 7 ELSE 0 END AS stated, o % 130 AS share FROM o),
p AS (SELECT *, list_filter(q, lambda v: v <> stated) AS parts FROM x),
sums AS (SELECT *, list_sum(parts)::DOUBLE AS computed FROM p WHERE len(parts) >= 2),
off AS (SELECT o AS doc_id, stated::DOUBLE AS stated, computed, abs(computed - stated) / greatest(abs(stated), 1e-9) AS off FROM sums),
offs AS (SELECT doc_id, stated, computed, CASE WHEN off > 0.02 THEN 'MAJOR' ELSE 'MINOR' END AS severity FROM off WHERE off > 0.01),
shares AS (SELECT o AS doc_id, share::DOUBLE AS stated, 100 * computed / {BASE} AS computed FROM sums WHERE abs(100 * computed / {BASE} - share) / greatest(share, 1e-9) > 0.02)"""
_FAULTS = "faults AS (SELECT o AS doc_id, 2 AS num, unnest(['type-code', 'year', 'pages']) AS \"check\" FROM o)"

SQL = {
    "statement_numbers": f"WITH {_O} SELECT o AS doc_id, (len(q) + 3)::BIGINT AS n, ({BASE} + total + stated + share)::DOUBLE AS sum, (len(q) + 2)::BIGINT AS n_units FROM x",
    "statement_sums": f"WITH {_O} SELECT doc_id, stated, computed, severity FROM offs",
    "statement_shares": f"WITH {_O} SELECT doc_id, stated, round(computed, 6) AS computed FROM shares",
    "statement_share_range": f"WITH {_O} SELECT o AS doc_id, share::DOUBLE AS stated FROM x WHERE share > 100",
    "statement_marks": f"""WITH {_O} SELECT o AS doc_id, 'thousands' AS rule_id, '90,000' AS original FROM o UNION ALL SELECT o, 'ellipsis', '...' FROM o WHERE o % 5 = 0 UNION ALL SELECT o, 'percent', '' FROM o WHERE o % 4 = 0 UNION ALL SELECT o, 'pair', '() 1 0' FROM o WHERE o % 6 = 0""",
    "statement_numbering": f"WITH {_O} SELECT o AS doc_id, 3 AS num, 2 AS expected FROM o WHERE o % 7 = 0",
    "statement_figures": f"WITH {_O} SELECT o AS doc_id, '1' AS num, 'missing' AS kind FROM o WHERE o % 2 = 0 UNION ALL SELECT o, '2', 'unused' FROM o WHERE o % 2 = 0",
    "statement_references": f"WITH {_O} SELECT o AS doc_id, 1 AS num, '[1] A. Title' || (o % 50) || '[J]. 2010: 1-2.' AS text FROM o UNION ALL SELECT o, 2, '[2] B. Title' || ((o + CASE WHEN o % 3 = 0 THEN 0 ELSE 1 END) % 50) || '[Q]. 2090: 1–3.' FROM o",
    "statement_citations": f"WITH {_O} SELECT o AS doc_id, 1 AS num FROM o UNION ALL SELECT o, CASE WHEN o % 2 = 1 THEN 2 ELSE 3 END FROM o",
    "statement_faults": f"WITH {_O}, {_FAULTS} SELECT * FROM faults",
    "statement_twins": f"WITH {_O} SELECT o AS doc_id, 2 AS num, 1 AS first_of FROM o WHERE o % 3 = 0",
    "statement_findings": f"""WITH {_O}, f AS (SELECT 'sum' AS rule_id, 'data' AS category, severity FROM offs UNION ALL SELECT 'share', 'data', 'MAJOR' FROM shares UNION ALL SELECT 'share-range', 'data', 'MAJOR' FROM x WHERE share > 100
  UNION ALL SELECT 'numbering', 'format', 'MINOR' FROM o WHERE o % 7 = 0 UNION ALL SELECT 'figure-missing-1', 'format', 'MINOR' FROM o WHERE o % 2 = 0 UNION ALL SELECT 'figure-unused-2', 'format', 'INFO' FROM o WHERE o % 2 = 0
  UNION ALL SELECT 'ref-type-code-2', 'reference', 'MAJOR' FROM o UNION ALL SELECT 'ref-year-2', 'reference', 'MAJOR' FROM o UNION ALL SELECT 'ref-pages-2', 'reference', 'MINOR' FROM o UNION ALL SELECT 'ref-again-2', 'reference', 'MINOR' FROM o WHERE o % 3 = 0
  UNION ALL SELECT 'unlisted-3', 'reference', 'MAJOR' FROM o WHERE o % 2 = 0 UNION ALL SELECT 'uncited-2', 'reference', 'MINOR' FROM o WHERE o % 2 = 0 UNION ALL SELECT 'citation-order', 'reference', 'MINOR' FROM o WHERE o % 2 = 1)
  SELECT rule_id, category, severity, count(*) AS n FROM f GROUP BY 1, 2, 3""",
    "statement_order": f"WITH {_O} SELECT o AS doc_id, '2,1' AS nums FROM o WHERE o % 2 = 1",
    "reference_fields": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS kind, year(o_orderdate) AS y, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS p FROM orders)
  SELECT k AS doc_id, ['J', 'M', 'D', 'N', 'EB'][kind + 1] AS kind, CASE WHEN k % 3 = 0 THEN 'Ames A|王明|Orr B' ELSE 'Ames A|Orr B' END AS authors, k % 3 = 0 AS et_al, 'Order ' || k || ' of ' || p AS title,
  CASE WHEN kind = 0 THEN 'Acta of Trade, Part B' WHEN kind = 3 THEN '晚报' END AS container, CASE WHEN kind = 1 THEN 'Bern' WHEN kind = 2 THEN '上海' END AS place, CASE WHEN kind = 1 THEN 'Hill & Sons' WHEN kind = 2 THEN '某大学' END AS publisher,
  CASE WHEN kind >= 3 OR k % 7 <> 0 THEN y END AS year, CASE WHEN kind >= 3 THEN day END AS date, CASE WHEN kind = 0 AND k % 7 <> 0 THEN '' || (k % 90 + 1) END AS volume, CASE WHEN kind = 3 THEN '7' END AS issue, CASE WHEN kind = 0 THEN (k % 50 + 1) || '-' || (k % 50 + 9) END AS pages,
  CASE WHEN kind = 4 THEN 'https://example.org/o/' || k END AS url, CASE WHEN kind = 1 THEN '10.5555/' || k END AS doi, CASE WHEN kind < 3 AND k % 7 = 0 THEN 'year' ELSE '' END AS missing FROM o""",
    "avoided_words": f"""WITH {hits(style.avoid_rules(LATIN))} SELECT doc_id, rule_id, start, "end", original, explain FROM hits""",
}
