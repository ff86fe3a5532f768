"""Files as frames: discovery, lines, spans with context, path rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File name endings of the languages that the model names.
LANGUAGES = {
    "rs": "rust", "py": "python", "go": "go", "js": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php",
}


def _ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression over relative paths, whether it takes a path back) of a line of an ignore file."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    body = line.removeprefix("!").removeprefix("\\")
    folder, body = body.endswith("/"), body.rstrip("/")
    rooted, body = "/" in body, body.removeprefix("/")
    units = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^]]+\]|[^*?\[/]+|/|\[", body)
    text = "".join(units.get(p) or (p if re.fullmatch(r"\[[^]]+\]", p) else re.escape(p)) for p in parts)
    return f"^{'' if rooted else '(?:.*/)?'}{text}{'/.+' if folder else '(?:/.*)?'}$", back


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether an ignore file of ``lines`` leaves out a relative path; the last line that fits decides."""
    out = F.lit(False)
    for rule in map(_ignore_pattern, lines):
        if rule:
            out = F.when(path.rlike(rule[0]), not rule[1]).otherwise(out)
    return out


def _ignore_file(spark: SparkSession, root: str) -> list[str]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def discover(
    spark: SparkSession, root: str, include: str = "*", exclude: tuple[str, ...] = (), max_bytes: int = 4 << 20, ignore: tuple[str, ...] = ()
) -> DataFrame:
    """(path, byte_length, content_hash, language, generated, class, status): files below ``root``; text is read only to be hashed.

    Files that match ``exclude`` (regular expressions) or are left out by the ignore file of ``root`` and
    the lines ``ignore`` after it are not listed. Those over ``max_bytes`` are, as ``too_large`` and
    without a hash, so that coverage counts them as skipped; others are ``eligible``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    relative = F.regexp_replace("path", f"^.*?{re.escape(top)}/", "")
    raw = raw.where(~ignored(relative, [*_ignore_file(spark, root), *ignore]))
    for rule in exclude:
        raw = raw.where(~F.col("path").rlike(rule))
    end = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.coalesce(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])[end], F.lit("unknown"))
    generated = F.col("path").rlike(r"(^|/)(generated|vendor|node_modules|dist)/|\.min\.js$|_pb2?\.")
    kind = F.when(F.col("path").rlike(r"(^|/)tests?/|[._]test\.|_test\."), "test").when(generated, "generated").otherwise("source")
    fits = F.col("length") <= max_bytes
    return raw.select(
        "path", F.col("length").alias("byte_length"), F.when(fits, F.sha2("content", 256)).alias("content_hash"), language.alias("language"), generated.alias("generated"),
        kind.alias("class"), F.when(fits, "eligible").otherwise("too_large").alias("status"),
    )


def read_lines(documents: DataFrame, id_col: str, text: Column, first: Column, last: Column, before: int = 0, after: int = 0) -> DataFrame:
    """(id, line, content): 1-based lines first..last with context, clipped to the text."""
    lines = documents.select(F.col(id_col), F.split(text, "\n").alias("l"), first.alias("a"), last.alias("b"))
    lo, hi = F.greatest(F.lit(1), F.col("a") - before), F.least(F.size("l"), F.col("b") + after)
    cut = lines.where(lo <= hi).select(id_col, lo.alias("lo"), F.slice("l", lo, hi - lo + 1).alias("l"))
    return cut.select(id_col, "lo", F.posexplode("l").alias("k", "content")).select(id_col, (F.col("lo") + F.col("k")).cast("int").alias("line"), "content")


def read_spans(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, start_byte, end_byte, content, status): byte spans, checked against the hash they were taken from.

    ``files``: file, text; ``spans``: file, start_byte, end_byte, content_hash (SHA-256 of the text).
    """
    raw = files.select("file", F.col("text").cast("binary").alias("raw"), F.sha2(F.col("text"), 256).alias("now"))
    j = spans.join(raw, "file", "left")
    size = F.octet_length("raw")
    status = (
        F.when(F.col("now").isNull(), "missing_file")
        .when(F.col("now") != F.col("content_hash"), "stale_hash")
        .when((F.col("start_byte") > F.col("end_byte")) | (F.col("end_byte") > size) | (F.col("start_byte") < 0), "invalid_span")
        .otherwise("ok")
    )
    content = F.when(status == "ok", F.expr("decode(substring(raw, CAST(start_byte + 1 AS INT), CAST(end_byte - start_byte AS INT)), 'UTF-8')"))
    return j.select("file", "start_byte", "end_byte", content.alias("content"), status.alias("status"))


def merge_spans(spans: DataFrame, key: str = "file") -> DataFrame:
    """(key, start, end, n): overlapping or touching spans of a file merged."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    grouped = marked.withColumn("g", F.sum("new").over(order))
    return grouped.groupBy(key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("g")
