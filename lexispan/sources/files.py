"""Readers of source trees, plans and batches."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan import schema
from lexispan.errors import SpanError
from lexispan.functions.naming import EXTENSIONS, detect_language
from lexispan.operators.extract import source_files

#: Names that a copy of a workspace leaves out.
SKIPPED = (".git", ".svn", ".hg", "target", "node_modules", "__pycache__", ".venv", "venv", ".idea", ".vscode", "dist", "build", ".pytest_cache", ".span-backup", ".span-journal")


_WILD = re.compile(r"[*?\[{]")
_GLOB_PART = re.compile(r"(?P<deep>\*\*/)|(?P<rest>\*\*)|(?P<some>\*)|(?P<one>\?)|(?P<set>\[!?[^\]]+\])|\{(?P<either>[^}]*)\}|(?P<plain>.)", re.DOTALL)


def local_path(path) -> F.Column:
    """A file: URI as a plain path; other stores' stay."""
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def unlisted(spark: SparkSession, paths: str | list[str], recursive: bool = False, glob: str | None = None) -> list[str]:
    """Files that Spark's listing passes over because a name in their path begins with an underscore, such as ``__init__.py``.

    Few files are so named, and the driver lists them; folders on the driver's own
    disks are walked there, others through Hadoop's file systems.
    """
    fits = re.compile(_glob_regex(glob)) if glob else None
    out = []
    for top in [paths] if isinstance(paths, str) else paths:
        plain = re.sub("^file:(//)?(?=/)", "", top)
        if os.path.isfile(plain):
            found = [plain] if os.path.basename(plain)[:1] in "_." else []
        elif "://" not in plain:
            walk = os.walk(plain) if recursive else [next(os.walk(plain), (plain, [], []))]
            found = (os.path.join(d, n) for d, _, names in walk for n in names)
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(plain)
            system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
            each = system.listFiles(path, recursive) if system.exists(path) else None
            found = []
            while each is not None and each.hasNext():
                found.append(each.next().getPath().toString())
        for f in found:
            below = f[len(plain) :].split("/") if f != plain else ["_"]
            if any(x.startswith("_") for x in below) and not any(x.startswith(".") for x in below) and (fits is None or fits.match(os.path.basename(f))):
                out.append(f)
    return sorted(out)


def _opened(spark: SparkSession, path: str) -> bytes:
    if "://" not in path:
        return Path(path).read_bytes()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_texts(spark: SparkSession, paths: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """(file_path, content, is_utf8) of files; what is not UTF-8 has null content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(paths).select("path", "content")
    if more := unlisted(spark, paths, recursive, glob):
        rows = rows.unionByName(spark.createDataFrame([(p, _opened(spark, p)) for p in more], "path string, content binary"))
    text = F.col("content").cast("string")
    return rows.select(local_path(F.col("path")).alias("file_path"), F.when(F.is_valid_utf8(text), text).alias("content"), F.is_valid_utf8(text).alias("is_utf8"))


def scan_rust(spark: SparkSession, root: str) -> DataFrame:
    """All .rs files below a folder but for those in target and in folders whose names begin with a dot."""
    rows = read_texts(spark, root, True, "*.rs")
    below = F.substring(F.col("file_path"), len(os.path.abspath(root)) + 1, 1 << 20)
    return source_files(rows.where(~below.rlike(r"/(target|\.[^/]*)/")).where("is_utf8"))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files of known languages, skipped names left out."""
    rows = read_texts(spark, root, True, "*.{" + ",".join(EXTENSIONS) + "}")
    below = F.substring(F.col("file_path"), len(os.path.abspath(root)) + 1, 1 << 20)
    return source_files(rows.where(~F.exists(F.split(below, "/"), lambda p: p.isin(*SKIPPED))).where("is_utf8"))


def scan_glob(spark: SparkSession, pattern: str, language: str | None = None) -> DataFrame:
    """Files that fit a pattern, on any file system that Spark reads; without a given language, one of an unknown extension refuses the scan.

    ``**`` stands for any number of folders. The scan begins in the last folder before
    a wildcard, and the whole path then decides.
    """
    whole = pattern if "://" in pattern else os.path.abspath(pattern)
    root = os.path.dirname(whole if not _WILD.search(whole) else whole[: _WILD.search(whole).start()] + "x")
    try:
        found = read_texts(spark, root if _WILD.search(whole) else whole, bool(_WILD.search(whole)))
    except AnalysisException:  # there is no such place
        return spark.createDataFrame([], schema.SOURCE_FILES)
    rows = source_files(found.where(F.col("file_path").rlike(_glob_regex(whole))).where("is_utf8"))
    if language:
        return rows.withColumn("language", F.lit(language))
    known = F.assert_true(F.col("language").isNotNull(), F.concat(F.lit("unknown language of "), "file_path"))
    return rows.where(F.coalesce(known.cast("string"), F.lit("")) == "")


def _glob_regex(pattern: str) -> str:
    """The pattern as a regular expression over whole paths; * and ? stay inside a folder, and hidden names need a dot of their own."""

    def part(m: re.Match) -> str:
        text = m[0]
        return {
            "deep": "(?:[^/.][^/]*/)*", "rest": "[^.].*", "some": "[^/]*", "one": "[^/]", "set": text.replace("[!", "[^"),
            "either": "(?:" + "|".join(map(re.escape, (m["either"] or "").split(","))) + ")", "plain": re.escape(text),
        }[m.lastgroup]

    body = "".join(part(m) for m in _GLOB_PART.finditer(pattern))
    return "^" + re.sub(r"/(?=\[\^/\])", "/(?!\\.)", body) + "$"


def workspace_root(path: str) -> str | None:
    """The nearest folder above that holds a Cargo.toml."""
    start = Path(path).resolve()
    return next((str(p) for p in [start, *start.parents] if (p / "Cargo.toml").is_file()), None)


def read_json(path: str, kind: str) -> dict:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise SpanError("Io", f"I/O error for path {path}: {e}", file=path) from e
    except ValueError as e:
        raise SpanError(kind, f"{path} is no JSON: {e}", file=path) from e


#: Kinds that a plan's step may name.
PLAN_KINDS = ("function", "struct", "enum", "trait", "impl")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """(step, file, symbol, kind, with) of a plan, refused if a rule is broken: one step or more, no empty field, kinds of PLAN_KINDS."""
    body = read_json(path, "InvalidPlanSchema")
    rows = spark.createDataFrame([(json.dumps(body),)], "body string").select(F.from_json("body", schema.PLAN).alias("p")).select(F.posexplode("p.steps").alias("step", "s")).select(F.col("step") + 1, "s.*").toDF("step", "file", "symbol", "kind", "with")
    empty = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is empty")) for c in ("file", "symbol", "with")]
    bad = rows.select("step", F.concat_ws("; ", *empty, F.when(F.col("kind").isNotNull() & ~F.col("kind").isin(*PLAN_KINDS), F.concat(F.lit("unknown kind "), "kind"))).alias("problem")).where("problem <> ''").orderBy("step").collect()
    if bad or not rows.limit(1).count():
        raise SpanError("InvalidPlanSchema", f"Invalid plan schema: {'; '.join(f'step {r.step}: {r.problem}' for r in bad) or 'no steps'}", file=path)
    return rows


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Replacements of a batch file: each has either content or a file to read it from; paths are relative to the batch file."""
    body, folder = read_json(path, "InvalidBatchSchema"), str(Path(path).resolve().parent)
    batches = body.get("batches") if isinstance(body, dict) else None
    if not batches or not all(isinstance(b, dict) and b.get("replacements") for b in batches):
        raise SpanError("InvalidBatchSchema", "Invalid batch schema: one batch or more, each with one replacement or more", file=path)
    outer = spark.createDataFrame([(json.dumps(body),)], "body string").select(F.from_json("body", schema.BATCHES).alias("b")).select(F.posexplode("b.batches").alias("batch_no", "b"))
    rows = outer.select("batch_no", F.posexplode("b.replacements").alias("ordinal", "r")).select("batch_no", "ordinal", "r.*")
    bad = rows.where((F.col("content").isNull()) == (F.col("with").isNull()) | F.col("file").isNull() | F.col("start").isNull() | F.col("end").isNull()).orderBy("batch_no", "ordinal").collect()
    if bad:
        raise SpanError("InvalidBatchSchema", "Invalid batch schema: " + "; ".join(f"batch {r.batch_no} replacement {r.ordinal} needs file, start, end and either content or with" for r in bad), file=path)
    full = lambda c: F.when(F.startswith(c, F.lit("/")), c).otherwise(F.concat(F.lit(folder + "/"), c))
    rows = rows.withColumn("with", full(F.col("with"))).withColumn("file_path", full(F.col("file")))
    texts = [r["with"] for r in rows.where("`with` IS NOT NULL").select("with").distinct().collect()]
    if texts:
        missing = [t for t in texts if not os.path.isfile(t)]
        if missing:
            raise SpanError("Io", f"I/O error for path {missing[0]}: no such file", file=missing[0])
        new = read_texts(spark, texts).select(F.col("file_path").alias("with"), F.col("content").alias("_new"))
        rows = rows.join(new, "with", "left").withColumn("content", F.coalesce("content", "_new"))
    return rows.select(F.col("batch_no").cast("bigint").alias("batch_no"), F.col("ordinal").cast("bigint").alias("ordinal"), "file_path", F.col("start").alias("byte_start"), F.col("end").alias("byte_end"), "content")


def languages(files: DataFrame) -> DataFrame:
    return files.withColumn("language", detect_language("file_path"))
