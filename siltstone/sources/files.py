"""Readers. A missing, malformed or wrong-version file gives no rows, never an error."""

from __future__ import annotations

import re
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import outline, paths

DEFAULTS = {
    "gate": {"fail_on": "high", "review_findings_blocking": False},
    "finding_filters": {"enabled": True, "test_code": "reduce", "confidence_scoring": {"enabled": False, "minimum_score": 0.5}},
    "llm_analysis": {"max_targets": 20},
}


def present(spark: SparkSession, names: list[str]) -> list[str]:
    """The paths that exist, in any file system Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(name)
        matches = path.getFileSystem(conf).globStatus(path)
        if matches is not None and len(matches):
            found.append(name)
    return found


def whole_files(spark: SparkSession, *names: str, glob: str | None = None) -> DataFrame:
    """(path, text), one row a file; folders are read to any depth."""
    found = present(spark, list(names))
    if not found:
        return spark.createDataFrame([], "path string, text string")
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(found).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def tree(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """(path, text, language) of the source files below ``root``."""
    rows = whole_files(spark, root).withColumn("language", paths.language("path"))
    return rows.filter(F.col("language").isin(languages) if languages is not None else F.col("language").isNotNull())


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of whole files, lines counted from one."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "body")).select("path", (F.col("at") + 1).alias("line"), F.col("body").alias("text"))


def sarif(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``log``; keeps only valid logs of version 2.1.0. As a generator's input each text is parsed once.

    The text is parsed as the one element of an array, so that nothing may follow the log.
    """
    one = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{schemas.SARIF}>>")
    valid = F.filter(F.when(F.size(one) == 1, one), lambda x: x["version"] == "2.1.0")
    return texts.select("*", F.explode(valid).alias("log"))


def load_sarif(spark: SparkSession, *names: str) -> DataFrame:
    return sarif(whole_files(spark, *names))


def findings(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``{"findings": [..]}`` or of a bare list."""
    item = f"array<struct<{', '.join(_fields())}>>"
    bare = F.from_json(text, item)
    boxed = F.from_json(text, f"struct<findings:{item}>")["findings"]
    body = F.when(F.ltrim(F.col(text)).startswith("["), bare).otherwise(boxed)
    return texts.select(F.explode(body).alias("f")).select("f.*")


def _fields() -> list[str]:
    """FINDING as fields of a struct type."""
    depth, out, part = 0, [], ""
    for c in schemas.FINDING.replace("\n", " "):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip().replace(" ", ":", 1))
            part = ""
        else:
            part += c
    return [*out, part.strip().replace(" ", ":", 1)]


def load_findings(spark: SparkSession, name: str) -> DataFrame:
    return findings(whole_files(spark, name))


def load_baseline(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fingerprints, suppressions, audit) of a version 2 baseline file; any other is an empty baseline."""
    box = "struct<version:int,fingerprints:map<string,struct<first_seen:timestamp>>,suppressions:array<struct<fingerprint:string,reason:string,owner:string,expires_at:date>>,audit_trail:array<struct<action:string,fingerprint:string>>>"
    b = whole_files(spark, name).select(F.from_json("text", box).alias("b")).filter("b.version = 2")
    prints = b.select(F.explode("b.fingerprints").alias("fingerprint", "v")).select("fingerprint", "v.first_seen")
    held = b.select(F.posexplode("b.suppressions").alias("seq", "s")).select("s.*", F.col("seq").cast("bigint").alias("seq"))
    audit = b.select(F.posexplode("b.audit_trail").alias("seq", "a")).select(F.col("seq").cast("bigint").alias("seq"), "a.action", "a.fingerprint")
    return prints, held, audit


def load_history(spark: SparkSession, folder: str, limit: int | None = None, since: str | None = None) -> DataFrame:
    """Saved scans, newest first; of days from ``since`` on only the folders of these are read.

    Entries may also lie in plain files without a folder for the day; their day is that of their time.
    """
    found = present(spark, [folder])
    schema = f"{schemas.HISTORY}, scan_date date"
    rows = spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)
    if since is not None:
        day = F.lit(since).cast("date")
        rows = rows.filter(F.col("scan_date").isNull() | (F.col("scan_date") >= day)).filter(F.coalesce("scan_date", F.to_date(F.try_to_timestamp("timestamp"))) >= day)
    rows = rows.filter("scan_id is not null").orderBy(F.try_to_timestamp("timestamp").desc_nulls_last(), "scan_id")
    return rows if limit is None else rows.limit(limit)


def load_ground_truth(spark: SparkSession, name: str) -> DataFrame:
    """(name, category, real, cwe): rows that start with # and blank ones are skipped, values trimmed."""
    rows = spark.read.schema(schemas.GROUND_TRUTH).option("comment", "#").csv(name)
    return ground_truth(rows)


def ground_truth(rows: DataFrame) -> DataFrame:
    keep = F.trim("name") != ""
    return rows.filter(keep & ~F.trim("name").startswith("#")).select(F.trim("name").alias("name"), F.trim("category").alias("category"), (F.lower(F.trim("real")) == "true").alias("real"), F.trim("cwe").cast("int").alias("cwe"))


def load_suppressions(spark: SparkSession, name: str) -> DataFrame:
    """Suppressions from a JSON list."""
    found = present(spark, [name])
    kind = "fingerprint string, reason string, owner string, expires_at date"
    return spark.read.schema(kind).option("multiLine", True).json(found) if found else spark.createDataFrame([], kind)


def annotations(files: DataFrame) -> DataFrame:
    """(path, line, rule_id, polarity): a comment ``ruleid: x`` or ``ok: x`` labels the next line."""
    marked = lines(files).select("path", (F.col("line") + 1).alias("line"), F.regexp_extract("text", r"^\s*(?://|#|/\*|\*)\s*(ruleid|ok):\s*([\w.-]+)", 1).alias("polarity"), F.regexp_extract("text", r"^\s*(?://|#|/\*|\*)\s*(ruleid|ok):\s*([\w.-]+)", 2).alias("rule_id"))
    return marked.filter("polarity != ''").select("path", "line", "rule_id", "polarity")


def rule_ids(files: DataFrame) -> DataFrame:
    """(path, rule_id) of the rules of rule files: the ``id`` of each item of ``rules``, wherever it stands in the item."""
    found = config_entries(files).filter(F.col("key").rlike(r"^(rules)?\[\d+\]\.id$"))
    return found.select("path", F.col("value").alias("rule_id")).distinct()


def config_entries(files: DataFrame) -> DataFrame:
    """(other columns, key, value) of the entries of indented configuration files, see ``outline.entries``."""
    kept = [c for c in files.columns if c not in ("text", "key", "value")]
    return files.select(*kept, F.explode(outline.entries(F.col("text"))).alias("e")).select(*kept, "e.*")


def rule_fields(files: DataFrame) -> DataFrame:
    """(path, rule, rule_id, field, value): the fields of each rule of rule files; rule is its place, field its key below the rule."""
    place = lambda e: F.regexp_extract(e["key"], r"^(?:rules)?\[(\d+)\]", 1)
    fields = lambda es: F.filter(F.transform(es, lambda e: F.struct(place(e).alias("rule"), F.regexp_extract(e["key"], r"^(?:rules)?\[\d+\]\.?(.*)$", 1).alias("field"), e["value"].alias("value"))), lambda f: f["rule"] != "")
    # What a generator makes is made once; a file names its rules itself, so they need no join.
    rows = files.select("path", F.explode(F.array(outline.entries(F.col("text")))).alias("es")).select("path", F.explode(F.array(fields(F.col("es")))).alias("fs"))
    ids = F.array_sort(F.transform(F.filter("fs", lambda f: f["field"] == "id"), lambda f: F.struct(f["rule"].cast("int").alias("rule"), f["value"].alias("rule_id"))))
    once = F.filter(ids, lambda x: x["rule"].isNotNull())
    each = rows.select("path", "fs", F.explode(F.array(once)).alias("ids")).select("path", "ids", F.explode("fs").alias("f")).select("path", "ids", F.col("f.rule").cast("int").alias("rule"), "f.field", "f.value")
    # Most often each rule has one id and stands at its own place among them.
    at = F.get("ids", F.col("rule"))
    known = F.when((F.size("ids") > F.col("rule")) & (at["rule"] == F.col("rule")) & ((F.col("rule") == 0) | (F.get("ids", F.col("rule") - 1)["rule"] < F.col("rule"))), at["rule_id"])
    return each.select("path", "rule", F.coalesce(known, F.get(F.filter("ids", lambda x: x["rule"] == F.col("rule")), 0)["rule_id"]).alias("rule_id"), "field", "value")


def layered_config(layers: DataFrame, *scope: str, layer: str = "layer") -> DataFrame:
    """(scope.., key, value) of configuration files in layers (scope.., layer, text): of each key the entry of the highest layer.

    A list of a higher layer replaces the whole list, and a value what nested below it.
    """
    each = config_entries(layers.select(*scope, layer, "text")).withColumn("owner", F.regexp_replace("key", r"\[\d+\].*$", ""))
    top = each.groupBy(*scope, "owner").agg(F.max(layer).alias("_top"))
    kept = each.join(top, [*scope, "owner"]).filter(F.col(layer) == F.col("_top"))
    # Keys above an entry, of which none may have a value of its own in a higher layer.
    parts = F.split("owner", r"\.")
    above = kept.select(*scope, "owner", layer, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("up")).filter("up != owner")
    over = above.join(top.select(*scope, F.col("owner").alias("up"), "_top"), [*scope, "up"]).filter(F.col("_top") > F.col(layer)).select(*scope, "owner").distinct()
    return kept.join(over, [*scope, "owner"], "left_anti").select(*scope, "key", "value")


def rule_tests(names: DataFrame, path: str = "path") -> DataFrame:
    """(language, rule_path, test_dir, test_files) of files laid out as rules/<language>/x.yml and rules/<language>/tests/*."""
    at = names.select(F.col(path).alias("path"), F.regexp_extract(path, r"^(.*/)?rules/([^/]+)/", 2).alias("language"))
    rules = at.filter(F.col("path").rlike(r"rules/[^/]+/[^/]+\.ya?ml$")).select("language", F.col("path").alias("rule_path"), F.regexp_replace("path", r"[^/]+$", "tests").alias("test_dir"))
    tests = at.filter(F.col("path").rlike(r"rules/[^/]+/tests/[^/]+$")).groupBy("language").agg(F.array_sort(F.collect_list("path")).alias("test_files"))
    return rules.join(tests, "language", "left").withColumn("test_files", F.coalesce("test_files", F.array().cast("array<string>")))


def merged_config(*layers: dict | None) -> dict:
    """Defaults under the given layers, later ones on top, dictionary by dictionary."""
    out = deepcopy(DEFAULTS)

    def lay(base: dict, top: dict) -> None:
        for k, v in top.items():
            if isinstance(v, dict) and isinstance(base.get(k), dict):
                lay(base[k], v)
            else:
                base[k] = deepcopy(v)

    for layer in layers:
        lay(out, layer or {})
    return out


def changed_files(names: list[str] | None, spark: SparkSession) -> DataFrame:
    """(file,) of a change set; none known gives an empty table."""
    return spark.createDataFrame([(n,) for n in sorted({n for n in names or [] if n})], "file string")


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True

