"""Rule-set versions, candidates and approval."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofloom.functions.offsets import let
from proofloom.operators.parse import TEXT, any_of


def merge_sets(core: DataFrame, ledger: DataFrame, key: str = "id") -> DataFrame:
    """core and ledger as one set; the ledger's row of an id wins."""
    both = core.withColumn("priority", F.lit(0)).unionByName(ledger.withColumn("priority", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("priority"))
    return both.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth", "priority")


def checksum(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: version, 16 hex digits of sha256 over the ordered rows (V01). For rule sets, which one task can hold."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return rows.select(line.alias("line")).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256), 1, 16).alias("version"))


def diff_versions(old: DataFrame, new: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """key, change (added, removed, modified), changed columns; arrays are compared as sets."""
    o, n = old.select(F.col(key), F.struct(*compared).alias("o")), new.select(F.col(key), F.struct(*compared).alias("n"))
    kinds = dict(old.dtypes)

    def differs(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if kinds[c].startswith("array"):
            return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
        return ~a.eqNullSafe(b)

    rows = o.join(n, key, "full_outer")
    changed = F.array_join(F.filter(F.array(*[F.when(differs(c), F.lit(c)) for c in compared]), lambda c: c.isNotNull()), ",")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(changed != "", "modified")
    return rows.select(key, change.alias("change"), F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), changed).otherwise("").alias("columns")).filter("change IS NOT NULL")


def stage(rows: DataFrame, path: str, version: str) -> None:
    """Write a rule set as a version beside the others; none is changed, and one that is there stays."""
    rows.drop("version").write.mode("error").parquet(f"{path}/version={version}")


class CommitLog:
    """Numbered entries of a folder. An entry is made only if its number is free, so of two writers that saw the same state one
    fails and looks again; readers list the folder and see whole entries (V05, U05)."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.root = self.path(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.spark = spark

    def entries(self) -> list[tuple[int, str]]:
        """(number, what it says) of all entries, the oldest first."""
        if not self.fs.exists(self.root):
            return []
        names = [f.getPath() for f in self.fs.listStatus(self.root)]
        told = sorted((int(n.getName().split(".")[0]), n.toString()) for n in names if n.getName().endswith(".entry"))
        if not told:
            return []
        texts = {r["p"].rsplit("/", 1)[-1]: r["value"] for r in self.spark.read.text([p for _, p in told], wholetext=True).select("value", F.input_file_name().alias("p")).collect()}
        return [(n, texts.get(p.rsplit("/", 1)[-1], "")) for n, p in told]

    def latest(self) -> str | None:
        found = self.entries()
        return found[-1][1] if found else None

    def add(self, text: str, seen: int) -> bool:
        """Write entry seen + 1 unless someone has; False if so. It is written beside and moved to its name, which a store
        refuses if the name is taken, so that no reader sees half of it."""
        self.fs.mkdirs(self.root)
        name = self.path(self.root, f"{seen + 1:012d}.entry")
        beside = self.path(self.root, f"_{uuid.uuid4().hex}")
        out = self.fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        claim = self.path(self.root, f"{seen + 1:012d}.claim")
        won = self._free(claim) and not self.fs.exists(name) and self.fs.rename(beside, name)
        if not won:
            self.fs.delete(beside, False)
        return won

    def _free(self, claim) -> bool:
        """Whether this writer is the first to ask for a number: file creation without overwriting is atomic."""
        try:
            self.fs.create(claim, False).close()
        except Exception as e:  # noqa: BLE001  the store's own exception crosses from the JVM
            if "AlreadyExists" in str(e):
                return False
            raise
        return True


def promote(spark: SparkSession, path: str, version: str, tries: int = 20) -> int:
    """Make a staged version the current one by an entry of the log; its number. Readers see the old or the new one."""
    log = CommitLog(spark, f"{path}/log")
    if not log.fs.exists(log.path(f"{path}/version={version}/_SUCCESS")):
        raise ValueError(f"there is no version {version}")
    for _ in range(tries):
        seen = max([n for n, _ in log.entries()], default=0)
        if log.add(version, seen):
            return seen + 1
        time.sleep(0.05)
    raise RuntimeError(f"others kept writing to {path}/log")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current version, with it as `version`."""
    version = CommitLog(spark, f"{path}/log").latest()
    if version is None:
        raise ValueError(f"no version of {path} was promoted")
    return spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def ledger(spark: SparkSession, path: str, schema: str = "id string, term string, confidence double, status string") -> DataFrame:
    """The approved entries: the batches that the log names, together; of one id one."""
    told = [t for _, t in CommitLog(spark, f"{path}/_log").entries()]
    rows = spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{t}" for t in told]) if told else spark.createDataFrame([], schema)
    return rows.dropDuplicates(["id"]) if told else rows


def approve_into(spark: SparkSession, pending: DataFrame, path: str, ids: Sequence[str] | None = None, tries: int = 20) -> int:
    """Approve pending entries into the ledger at path; how many it lacked (U05). What another one approved meanwhile is not
    approved again: its entry takes the number, and this one looks anew."""
    log = CommitLog(spark, f"{path}/_log")
    for _ in range(tries):
        seen = max([n for n, _ in log.entries()], default=0)
        held = ledger(spark, path)
        chosen = pending if ids is None else pending.filter(F.col("id").isin(*ids))
        new = chosen.filter(F.col("id").isNotNull()).dropDuplicates(["id"]).join(held.select("id"), "id", "left_anti").withColumn("status", F.lit("approved"))
        name = f"batch={uuid.uuid4().hex}"
        new.write.parquet(f"{path}/{name}")
        n = spark.read.parquet(f"{path}/{name}").count()
        if n and log.add(name, seen):
            return n
        log.fs.delete(log.path(f"{path}/{name}"), True)
        if not n:
            return 0
        time.sleep(0.05)
    raise RuntimeError(f"others kept writing to {path}/log")


def strip_lead(term: Column, lead: Sequence[str], least: int = 4) -> Column:
    """Leading filler words removed one after another, the first that fits in the list's order, while `least` characters
    stay (U02)."""
    return F.regexp_replace(term, rf"(?s)^(?:{any_of(lead)}(?=.{{{least}}}))+", "") if lead else term


def candidates(docs: DataFrame, cues: Sequence[str], lead: Sequence[str] = (), stop: Sequence[str] = (), least: int = 4) -> DataFrame:
    """term, occurrences, n_docs, first_cue, confidence: what cue patterns capture, cleaned and counted."""
    def captured(i: int, cue: str) -> Column:
        return F.transform(F.regexp_extract_all(TEXT(), F.lit(cue), F.lit(1)), lambda t: F.struct(t.alias("term"), F.lit(i).alias("cue")))

    found = F.flatten(F.array(*[captured(i, c) for i, c in enumerate(cues)]))
    rows = docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", F.lower("x.term").alias("term"), "x.cue")
    if lead:
        rows = rows.withColumn("term", strip_lead(F.col("term"), lead, least))
    rows = rows.filter(F.length("term") >= least)
    if stop:
        rows = rows.filter(~F.col("term").isin(*stop))
    out = rows.groupBy("term").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("n_docs"), F.min("cue").cast("bigint").alias("first_cue"))
    base = F.least(F.lit(0.9), 0.55 + 0.04 * F.length("term"))
    return out.withColumn("confidence", F.round(F.least(F.lit(0.95), base + 0.05 * (F.col("occurrences") - 1)), 6))


def drop_contained(terms: DataFrame, column: str = "term") -> DataFrame:
    """Terms that no longer term holds (U03). The longer terms' substrings of lengths that terms have are joined by equality,
    which replaces the comparison of all pairs: a term makes as many as its own length times the number of lengths."""
    lengths = sorted(r[0] for r in terms.select(F.length(column)).distinct().collect())
    sizes = lambda t: F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: (n > 0) & (n < F.length(t)))
    parts = let(F.col(column), lambda t: F.flatten(F.transform(sizes(t), lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n)))))
    subs = terms.select(F.explode(F.array_distinct(parts)).alias("sub"), F.col(column).alias("of")).filter("sub != of").select("sub").distinct()
    return terms.join(subs, terms[column] == subs["sub"], "left_anti")


def run_update(found: DataFrame, known: DataFrame, least: float = 0.6, column: str = "term") -> DataFrame:
    """Candidates that are new and confident enough, with a stable id; rows of failed sources (null or empty) go."""
    fresh = found.filter(F.col(column).isNotNull() & (F.col(column) != "") & (F.col("confidence") >= least))
    fresh = fresh.join(known.select(F.col(column)).distinct(), column, "left_anti")
    return fresh.withColumn("id", F.concat(F.lit("cand-"), F.substring(F.md5(column), 1, 10))).withColumn("status", F.lit("pending"))


def approve(pending: DataFrame, ledger: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """The ledger with the approved candidates it lacks; ids: which (all without)."""
    chosen = pending if ids is None else pending.filter(F.col("id").isin(*ids))
    new = chosen.join(ledger.select("id"), "id", "left_anti").withColumn("status", F.lit("approved"))
    return ledger.unionByName(new, allowMissingColumns=True)


def search_terms(terms: DataFrame, needle: str, severity: str | None = None, columns: Sequence[str] = ("term", "variants", "tags", "source")) -> DataFrame:
    """Terms whose text columns hold the needle."""
    text = F.lower(F.concat_ws(" ", *columns))
    out = terms.filter(F.contains(text, F.lit(needle.lower())))
    return out.filter(F.col("severity") == severity) if severity else out


def unchecked_json(text: Column, schema: str) -> Column:
    """The first object in a loose answer: code fences and words around it are left out; null if there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
