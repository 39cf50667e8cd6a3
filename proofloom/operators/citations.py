"""Reference items as fields: authors, title, kind, where and when published, pages, addresses, and what is left over.

An item is read from both ends of its type mark: before it stand authors and title, behind it the facts of publication, whose
order follows the kind. Each field is taken out of the tail once found; what no field explains stays in `rest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.offsets import let, strip

#: The fields that a reference of each kind must have.
REQUIRED = {
    "J": ("authors", "title", "container", "year", "pages"),
    "M": ("authors", "title", "place", "publisher", "year"),
    "D": ("authors", "title", "place", "publisher", "year"),
    "C": ("authors", "title", "place", "publisher", "year", "pages"),
    "N": ("authors", "title", "container", "date"),
    "EB": ("authors", "title", "url"),
}
SERIAL = ("J", "N")
MARK = r"\[\s*([A-Z]{1,2})(?:/([A-Z]{2}))?\s*\]"
DOI = r"(?i)(?:doi\s*[:：]?\s*|https?://(?:dx\.)?doi\.org/)(10\.\d{4,9}/[^\s,;，；]*[^\s,;，；.。])"
URL = r"https?://[^\s,;，；]*[^\s,;，；.。)\]]"
DATE = r"\b(\d{4}-\d{1,2}-\d{1,2})\b"
YEAR = r"(?<![\d.-])(1[5-9]\d{2}|20\d{2}|21\d{2})(?!\d)"
PAGES = r"[:：]\s*([A-Za-z]?\d+(?:\s*[-–—~～]\s*[A-Za-z]?\d+)?(?:\s*[,，]\s*\d+(?:\s*[-–—~～]\s*\d+)?)*)[\s.。]*$"
VOLUME = r"^\s*[,，]\s*(\d+)?\s*(?:[(（]\s*([^)）]+?)\s*[)）])?"
OTHERS = r"(?i)[,，]?\s*(?:et\s+al\.?|等)\s*$"
NONE = "CAST(NULL AS STRING)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern, stripped; null if there is none."""
    return F.nullif(strip(F.regexp_extract(text, pattern, group)), F.lit(""))


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, " ")


def reference_fields(text: Column) -> Column:
    """Struct of num, authors (array), et_al, title, kind, carrier, container, place, publisher, year, date, volume, issue,
    pages, doi, url, rest, missing (required fields that are not there; null for a kind without a rule or no type mark).

    Texts without a type mark have authors and title only; null and empty texts have no field at all."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*(?:[\[［]\s*\d+\s*[\]］]|\d+\s*[.、])\s*", "")
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(?:[\[［]\s*)?(\d+)\s*[\]］.、]", 1)
    split = F.struct(
        F.nullif(number, F.lit("")).cast("int").alias("num"),
        F.regexp_extract(bare, rf"^(.*?)(?:{MARK}|$)", 1).alias("head"),
        _found(bare, MARK, 1).alias("kind"),
        _found(bare, MARK, 2).alias("carrier"),
        F.regexp_extract(bare, rf"^.*?{MARK}\s*[.。]?(.*)$", 3).alias("tail"),
    )

    def opened(x: Column) -> Column:
        """Authors, title, and the fields that are known by their form."""
        given = strip(F.regexp_extract(x["head"], r"^(.*?)(?:[.。．]\s|[。．]|$)", 1))
        title = F.regexp_extract(x["head"], r"^.*?(?:[.。．]\s|[。．])(.*)$", 1)
        names = F.filter(F.transform(F.split(F.regexp_replace(given, OTHERS, ""), r"\s*[,，;；]\s*"), strip), lambda n: n != "")
        tail = x["tail"]
        plain = _without(_without(tail, DOI), URL)
        dated = _without(plain, rf"[\[(（]?{DATE}[\])）]?")
        return F.struct(
            x["num"].alias("num"), names.alias("authors"), given.rlike(OTHERS).alias("et_al"), F.nullif(strip(F.regexp_replace(title, r"[.。．]\s*$", "")), F.lit("")).alias("title"), x["kind"].alias("kind"), x["carrier"].alias("carrier"),
            _found(tail, DOI).alias("doi"), F.when(~F.regexp_extract(tail, URL, 0).rlike(r"doi\.org/"), _found(tail, URL, 0)).alias("url"), _found(plain, DATE).alias("date"), _found(dated, PAGES).alias("pages"), _without(dated, PAGES).alias("left"),
        )

    def told(x: Column) -> Column:
        """Where and when, by kind: a serial stands before the first comma, others as place: publisher."""
        serial = x["kind"].isin(*SERIAL)
        year = F.coalesce(_found(x["left"], YEAR), F.substring(x["date"], 1, 4))
        after = F.regexp_extract(x["left"], rf"{YEAR}(.*)$", 2)
        before = strip(F.regexp_replace(F.regexp_extract(x["left"], rf"^(.*?)(?:[,，]?\s*{YEAR}|$)", 1), r"[,，.。:：\s]+$", ""))
        place = F.when(~serial & before.rlike("[:：]"), _found(before, r"^([^:：]*)[:：]"))
        publisher = F.when(~serial & before.rlike("[:：]"), _found(before, r"^[^:：]*[:：](.*)$"))
        volume, issue = _found(after, VOLUME, 1), _found(after, VOLUME, 2)
        edition = F.when(serial, _found(before, r"[,，]\s*[(（]([^)）]+)[)）]$"))
        before = F.when(serial, strip(F.regexp_replace(before, r"[,，]\s*(?:[(（][^)）]*[)）])$", ""))).otherwise(before)
        issue = F.coalesce(issue, edition)
        unnamed = F.when(serial | before.rlike("[:：]"), F.lit("")).otherwise(before)
        rest = strip(F.regexp_replace(F.concat_ws(" ", unnamed, F.regexp_replace(after, VOLUME, "")), r"^[\s,，.。:：]+|[\s,，.。:：]+$", ""))
        made = {"num": x["num"], "authors": x["authors"], "et_al": x["et_al"], "title": x["title"], "kind": x["kind"], "carrier": x["carrier"], "container": F.when(serial, F.nullif(before, F.lit(""))), "place": place, "publisher": publisher, "year": year.cast("int"), "date": x["date"], "volume": volume, "issue": issue, "pages": x["pages"], "doi": x["doi"], "url": x["url"], "rest": rest}
        return F.struct(*[v.alias(k) for k, v in made.items()])

    def checked(x: Column) -> Column:
        lacks = lambda name: F.size(x["authors"]) == 0 if name == "authors" else x[name].isNull()
        none = F.lit(None).cast("array<string>")
        out = none
        for kind, names in REQUIRED.items():
            out = F.when(x["kind"] == kind, F.filter(F.array(*[F.when(lacks(n), F.lit(n)) for n in names]), lambda n: n.isNotNull())).otherwise(out)
        return x.withField("missing", out)

    return let(let(let(split, opened), told), checked)


def parsed_references(refs: DataFrame) -> DataFrame:
    """doc_id, num and the fields of each reference item (doc_id, num, text)."""
    return refs.select("doc_id", F.col("num").alias("at"), reference_fields(F.col("text")).alias("x")).select("doc_id", F.col("at").alias("num"), *[F.col(f"x.{c}") for c in ("authors", "et_al", "title", "kind", "carrier", "container", "place", "publisher", "year", "date", "volume", "issue", "pages", "doi", "url", "rest", "missing")])
