"""Entities and uses from source text, by patterns over lines: a light extractor; built-in functions but for a file's scopes, which a sweep of its lines tells."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import route_key
from ..runtime import materialize

_NAME = r"([A-Za-z_$][\w$]*)"
_MODS = r"(?:(?:public|protected|private|internal|abstract|final|static|sealed|partial|override|virtual|async|synchronized|readonly)\s+)*"
_JS = (
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}", "function"),
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}", "class"),
    (rf"^\s*(?:export\s+)?const\s+{_NAME}\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", "function"),
    (rf"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*{_NAME}\s*\([^)]*\)\s*(?::[^={{]+)?\{{\s*$", "method"),
)
_C = (
    (r"^(?!return|else|typedef|struct|enum|union)[A-Za-z_][\w\s\*:<>,&]*?\b([A-Za-z_]\w*)\s*\([^;]*$", "function"),
    (r"^\s*(?:typedef\s+)?struct\s+([A-Za-z_]\w*)", "struct"),
    (r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?([A-Za-z_]\w*)", "enum"),
    (r"^\s*(?:typedef\s+)?union\s+([A-Za-z_]\w*)", "union"),
)
_TYPES = ((rf"^\s*{_MODS}class\s+{_NAME}", "class"), (rf"^\s*{_MODS}interface\s+{_NAME}", "interface"), (rf"^\s*{_MODS}enum\s+{_NAME}", "enum"))
# Declarations that a line may hold, by language, as (pattern, kind).
DECLARATIONS = {
    "python": ((r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", "function"), (r"^\s*class\s+([A-Za-z_]\w*)", "class")),
    "rust": (
        (r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_]\w*)", "function"),
        (r"^\s*(?:pub(?:\([a-z]+\))?\s+)?struct\s+([A-Za-z_]\w*)", "struct"),
        (r"^\s*(?:pub(?:\([a-z]+\))?\s+)?enum\s+([A-Za-z_]\w*)", "enum"),
        (r"^\s*(?:pub(?:\([a-z]+\))?\s+)?trait\s+([A-Za-z_]\w*)", "trait"),
    ),
    "go": ((r"^func\s+([A-Za-z_]\w*)", "function"), (r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)", "method"), (r"^type\s+([A-Za-z_]\w*)\s+struct", "struct"), (r"^type\s+([A-Za-z_]\w*)\s+interface", "interface")),
    "javascript": _JS,
    "typescript": (*_JS, (rf"^\s*(?:export\s+)?interface\s+{_NAME}", "interface"), (rf"^\s*(?:export\s+)?type\s+{_NAME}[^=]*=", "type_alias"), (rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}", "enum")),
    "java": (*_TYPES, (rf"^\s*{_MODS}record\s+{_NAME}", "class"), (rf"^\s+(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+[\w<>\[\],.? ]+\s+{_NAME}\s*\(", "method")),
    "c": _C,
    "cpp": (*_C, (r"^\s*class\s+([A-Za-z_]\w*)", "class"), (r"^\s*namespace\s+([A-Za-z_]\w*)", "namespace")),
    "csharp": (*_TYPES, (rf"^\s*{_MODS}(?:struct|record)\s+{_NAME}", "struct"), (r"^\s*namespace\s+([\w.]+)", "namespace"), (rf"^\s+(?:(?:public|protected|private|internal|static|override|virtual|async)\s+)+[\w<>\[\],.? ]+\s+{_NAME}\s*\(", "method")),
    "ruby": ((r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", "method"), (r"^\s*class\s+([A-Za-z_]\w*)", "class"), (r"^\s*module\s+([A-Za-z_]\w*)", "module")),
    "php": ((rf"^\s*{_MODS}function\s+&?{_NAME}", "function"), *_TYPES, (rf"^\s*trait\s+{_NAME}", "trait")),
}
_EXTENDS = (r"\b(?:class|interface)\s+([\w$]+)[^{]*?\bextends\s+([\w$.,\s]+?)\s*(?:<|\bimplements\b|\{|$)", "inheritance_use")
_IMPLEMENTS = (r"\bclass\s+([\w$]+)[^{]*?\bimplements\s+([\w$.,\s]+?)\s*(?:<|\{|$)", "implementation_use")
_COLON = (r"\b(?:class|struct|interface)\s+(\w+)[^:{]*:\s*([\w:.,<>\s]+?)\s*(?:\{|$)", "inheritance_use")
# What a declaration says of its bases, as (pattern of heir and bases, role), and those that name the bases first.
BASES = {
    "python": ((r"^\s*class\s+(\w+)\s*\(([\w.,\s]+)", "inheritance_use"),),
    "javascript": (_EXTENDS,),
    "typescript": (_EXTENDS, _IMPLEMENTS),
    "java": (_EXTENDS, _IMPLEMENTS),
    "php": (_EXTENDS, _IMPLEMENTS),
    "csharp": (_COLON,),
    "cpp": (_COLON,),
    "ruby": ((r"^\s*class\s+(\w+)\s*<\s*([\w:]+)", "inheritance_use"),),
}
BASES_FIRST = {"rust": ((r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)", "implementation_use"),)}
# Lines that open a scope of a type declared elsewhere, and lines that name the type whose method they declare.
IMPLEMENTS_FOR = {"rust": r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?:\w+::)*(\w+)"}
RECEIVER = {"go": r"^func\s+\(\s*(?:\w+\s+)?\*?(\w+)"}
#: Languages whose scopes are told by indentation; those of all others by braces.
INDENTED = ("python", "ruby")
CALL = r"((?:[A-Za-z_$][\w$]*(?:\.|::|->))*)([A-Za-z_]\w*)\s*\("
# Words before a parenthesis that call nothing.
NOT_CALLED = ("if", "for", "while", "switch", "return", "catch", "elif", "match", "function", "def", "fn", "func", "class", "and", "or", "not", "in", "sizeof", "typeof")
TYPE = r"(?::|->)\s*&?(?:mut\s+)?(?:[\w]+(?:\.|::))*([A-Z]\w*)"
TYPED = ("python", "rust", "typescript", "php")
ROUTE = r"\.(get|post|put|patch|delete)\(\s*['\"](/[^'\"]*)['\"]"
IMPORTS = {
    "python": r"^\s*(?:from|import)\s+([\w.]+)", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$", "javascript": r"(?:from|require\()\s*['\"]([^'\"]+)['\"]",
    "typescript": r"(?:from|require\()\s*['\"]([^'\"]+)['\"]", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "c": r"^\s*#\s*include\s+\"([^\"]+)\"", "cpp": r"^\s*#\s*include\s+\"([^\"]+)\"",
    "csharp": r"^\s*using\s+([\w.]+)\s*;", "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "php": r"^\s*use\s+([\w\\]+)",
}


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", "language", F.posexplode(F.split("text", "\r?\n")).alias("k", "line")).withColumn("line_no", F.col("k") + 1)


def _times(text: Column, *signs: str) -> Column:
    """How often ``text`` holds any of ``signs``, of one character each."""
    return F.length(text) - F.length(F.translate(text, "".join(signs), ""))


def leveled(files: DataFrame) -> DataFrame:
    """(path, language, line, line_no, level): how deep each line lies, by indentation or braces; null where it says nothing.

    Blank lines, comments, quoted blocks and the rest of a statement that goes on in brackets say
    nothing. All is running sums over a file's lines: of block marks, of brackets, of braces.
    """
    rows = _lines(files)
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    indented = F.col("language").isin(*INDENTED)
    hashes = F.col("language").isin(*INDENTED, "php")
    quotes = r"'(?:\\.|[^'\\])'"
    long_quotes = r"'(?:\\.|[^'\\])*'"
    one_letter = F.col("language").isin("rust", "go", "java", "c", "cpp", "csharp")
    strings = lambda q: F.regexp_replace("line", rf'"(?:\\.|[^"\\])*"|`[^`]*`|{q}', "")
    plain = F.when(one_letter, strings(quotes)).otherwise(strings(long_quotes))
    code = F.when(hashes, F.regexp_replace(plain, "#.*$", "")).otherwise(F.regexp_replace(plain, r"//.*$|/\*.*?\*/", ""))
    fences = (F.length("line") - F.length(F.regexp_replace("line", "\"\"\"|'''", ""))) / 3
    marks = F.when(indented, fences.cast("int")).otherwise((F.length(code) - F.length(F.regexp_replace(code, r"/\*", ""))) / 2 - (F.length(code) - F.length(F.regexp_replace(code, r"\*/", ""))) / 2)
    rows = rows.withColumn("code", F.trim(F.when(indented, code).otherwise(F.regexp_replace(code, r"/\*.*$", "")))).withColumn("marks", marks.cast("int"))
    open_ = so_far(F.col("marks"))
    inside = F.when(indented, open_ % 2 == 1).otherwise(open_ > 0)
    rows = rows.withColumn("inside", inside)
    told = F.when(F.col("inside") | (F.col("marks") > 0), "").otherwise(F.col("code"))
    braces = _times(told, "{") - _times(told, "}")
    brackets = _times(told, "(", "[") - _times(told, ")", "]")
    rows = rows.withColumns({"braces": braces, "brackets": brackets})
    rows = rows.withColumns({"depth": so_far(F.col("braces")), "round": so_far(F.col("brackets"))})
    # Brackets open since the last brace: a statement that goes on; those before it hold a whole body.
    held = F.last(F.when(F.col("braces") != 0, F.col("round") + F.col("brackets")), True).over(before)
    goes_on = F.when(indented, F.col("round") > 0).otherwise(F.col("round") > F.coalesce(held, F.lit(0)))
    silent = F.col("inside") | goes_on | (F.col("code") == "")
    margin = F.length(F.regexp_replace(F.regexp_extract("line", r"^[ \t]*", 0), "\t", " " * 8))
    by_margin = F.when(~F.col("code").rlike(r"^(?:[)\]}]|end\b)"), margin)
    by_brace = F.col("depth") + F.col("code").startswith("{").cast("int")
    level = F.when(~silent, F.when(indented, by_margin).otherwise(by_brace))
    return rows.select("path", "language", "line", "line_no", level.cast("int").alias("level"))


def scopes_of_lines(rows: DataFrame, opens: Column) -> DataFrame:
    """``rows`` of ``leveled`` with end, above and inside: where the scope that a line opens ends, the lines whose scopes it lies in, and the innermost of these with its own.

    ``opens``: whether a line opens a scope. A scope holds the lines after it until one that lies as
    deep or less, and ends with the last of them that is not blank. For each depth at which a file has scopes, the last of its lines that lie so deep or
    less tells whether one is open, and which: a window for each depth, not a stack.
    """
    file = Window.partitionBy("path")
    rows = rows.withColumn("opens", opens & F.col("level").isNotNull())
    told = F.when(F.trim("line") != "", F.col("line_no"))
    before = file.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"depths": F.collect_set(F.when(F.col("opens"), F.col("level"))).over(file), "last_line": F.max(told).over(file), "before": F.max(told).over(before)})
    each = rows.withColumn("d", F.explode_outer("depths"))
    event = F.when(F.col("opens") & (F.col("level") == F.col("d")), F.col("line_no")).when(F.col("level") <= F.col("d"), 0)
    by_depth = Window.partitionBy("path", "d")
    now = by_depth.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    later = by_depth.orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("event", event)
    each = each.withColumns({"open": F.last("event", True).over(now), "until": F.last(F.when(F.col("event").isNotNull(), F.col("before")), True).over(later)})
    is_open = F.col("open") > 0
    keep = [c for c in rows.columns if c not in ("depths", "last_line", "before")]
    found = each.groupBy("path", "line_no").agg(
        *[F.first(c).alias(c) for c in keep if c not in ("path", "line_no")],
        F.max(F.when(F.col("opens") & (F.col("d") == F.col("level")), F.coalesce("until", "last_line"))).alias("end"),
        F.sort_array(F.collect_set(F.when(is_open & (F.col("level").isNull() | (F.col("d") < F.col("level"))), F.col("open")))).alias("above"),
        F.max(F.when(is_open, F.col("open"))).alias("inside"),
    )
    return found


def _collected(rules: dict, element: str, made) -> Column:
    """The array of all that the rules of a row's language make of its line; one branch a language, one entry a rule."""
    none = F.array().cast(f"array<{element}>")
    out = none
    for language, own in rules.items():
        hits = [F.when(ok, found).otherwise(none) for ok, found in (made(*rule) for rule in own)]
        out = F.when(F.col("language") == language, F.concat(*hits)).otherwise(out)
    return out


def _declared(line: Column) -> Column:
    """All that ``line`` declares, in order."""

    def made(pattern: str, kind: str):
        name = F.regexp_extract(line, pattern, 1)
        return name != "", F.array(F.struct(name.alias("name"), F.lit(kind).alias("kind")))

    found = _collected(DECLARATIONS, "struct<name:string,kind:string>", made)
    return F.filter(found, lambda d: ~d["name"].isin(*NOT_CALLED))


def _named(rules: dict[str, str], line: Column) -> Column:
    """What the rule of a row's language finds in ``line``, else null."""
    out = F.lit("")
    for language, pattern in rules.items():
        out = F.when(F.col("language") == language, F.regexp_extract(line, pattern, 1)).otherwise(out)
    return F.when(out != "", out)


def declarations(files: DataFrame) -> DataFrame:
    """(path, language, name, kind, line) of files (path, language, text)."""
    rows = _lines(files).select("path", "language", F.explode(_declared(F.col("line"))).alias("d"), "line_no")
    return rows.select("path", "language", "d.name", "d.kind", F.col("line_no").alias("line"))


#: Kinds that hold methods.
HOLDERS = ("class", "struct", "interface", "trait", "enum", "union")


# Dot and end of text as the JVM reads them: a line may hold breaks other than those that part lines.
_BREAKS = r"\n\r\x85\u2028\u2029"
_DOT, _END = f"[^{_BREAKS}]", rf"(?=[{_BREAKS}]?\Z)"
_STRINGS = {one: re.compile(rf'"(?:\\{_DOT}|[^"\\])*"|`[^`]*`|' + rf"'(?:\\{_DOT}|[^'\\])" + ("'" if one else "*'")) for one in (True, False)}
_HASH, _SLASHES, _OPENED = re.compile(f"#{_DOT}*{_END}"), re.compile(rf"//{_DOT}*{_END}|/\*{_DOT}*?\*/"), re.compile(rf"/\*{_DOT}*{_END}")
_FENCE, _MARGIN, _CLOSES = re.compile("\"\"\"|'''"), re.compile(r"[ \t]*"), re.compile(r"[)\]}]|end\b")


def _levels(lines: list[str], language: str | None) -> list[int | None]:
    """The levels that ``leveled`` gives the lines of a file."""
    indented = language in INDENTED
    comment, sign = (_HASH, "#") if indented or language == "php" else (_SLASHES, "/")
    strings = _STRINGS[language in ("rust", "go", "java", "c", "cpp", "csharp")]
    out: list[int | None] = []
    opened = depth = brackets = held = 0
    for line in lines:
        quoted = '"' in line or "'" in line or "`" in line
        code = strings.sub("", line) if quoted else line
        if sign in code:
            code = comment.sub("", code)
        if indented:
            marks, inside = len(_FENCE.findall(line)) if quoted else 0, opened % 2 == 1
        else:
            marks, inside = code.count("/*") - code.count("*/"), opened > 0
            code = _OPENED.sub("", code) if "/*" in code else code
        code = code.strip(" ")
        opened += marks
        if inside or code == "" or brackets > (0 if indented else held):
            out.append(None)
        elif indented:
            margin = _MARGIN.match(line).group()
            out.append(None if _CLOSES.match(code) else len(margin) + 7 * margin.count("\t"))
        else:
            out.append(depth + code.startswith("{"))
        if not inside and marks <= 0:
            braces = code.count("{") - code.count("}")
            brackets += code.count("(") + code.count("[") - code.count(")") - code.count("]")
            depth += braces
            held = brackets if braces else held
    return out


def _scopes(lines: list[str], levels: list[int | None], opens: list[bool]) -> tuple[list, list, list]:
    """(ends, aboves, insides) of the lines of a file, as ``scopes_of_lines`` has them."""
    ends, aboves, insides = [None] * len(lines), [], []
    open_: list[int] = []
    told = None
    for k, (line, level) in enumerate(zip(lines, levels)):
        if level is not None:
            while open_ and levels[open_[-1] - 1] >= level:
                ends[open_[-1] - 1] = told
                open_ = open_[:-1]
        aboves.append(open_)
        if level is not None and opens[k]:
            open_ = [*open_, k + 1]
        insides.append(open_[-1] if open_ else None)
        told = k + 1 if line.strip(" ") else told
    for at in open_:
        ends[at - 1] = told
    return ends, aboves, insides


#: Lines that a batch of ``scoped_lines`` holds, about.
LINE_BATCH = 50_000


def _scoped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (path, language, line, declared; the last two an element a line) as rows of their lines, with levels and scopes."""
    for batch in batches:
        texts, first, found, held = batch["line"], 0, [], 0
        for i in range(batch.num_rows):
            lines = texts[i].as_py() or []
            levels = _levels(lines, batch["language"][i].as_py())
            opens = pc.greater(pc.list_value_length(batch["declared"][i].values), 0).to_pylist() if lines else []
            found.append((range(1, len(lines) + 1), levels, *_scopes(lines, levels, opens)))
            held += len(lines)
            if i + 1 < batch.num_rows and held < LINE_BATCH:
                continue
            files = batch.slice(first, i + 1 - first)
            at = pc.list_parent_indices(files["line"])
            number, level, end, above, inside = ([x for f in found for x in f[c]] for c in range(5))
            short = [pa.array(c, pa.int32()) for c in (number, level, end, inside)]
            columns = [files["path"].take(at), files["language"].take(at), files["line"].flatten(), short[0], short[1], files["declared"].flatten(), short[2], pa.array(above, pa.list_(pa.int32())), short[3]]
            out = pa.RecordBatch.from_arrays(columns, ["path", "language", "line", "line_no", "level", "declared", "end", "above", "inside"])
            for k in range(0, out.num_rows, LINE_BATCH):
                yield out.slice(k, LINE_BATCH)
            first, found, held = i + 1, [], 0


_DECLARED = "array<struct<name:string,kind:string>>"


def scoped_lines(files: DataFrame) -> DataFrame:
    """(path, language, line, line_no, level, declared, owner, end, above, inside) of every line, with ``scopes_of_lines`` of its declarations.

    ``declared``: what it declares (name, kind); a block that implements a type declares it as kind
    impl. ``owner``: the type that a receiver names. Lines in comments and quoted blocks declare nothing.
    A file is a row, so a task tells the levels and scopes of its files by one sweep of their lines, the
    open scopes in hand: lines are neither shuffled nor sorted. ``leveled`` and ``scopes_of_lines`` tell the
    same of lines that come as rows.
    """

    def declared(line: Column) -> Column:
        block = _named(IMPLEMENTS_FOR, line)
        return F.when(block.isNotNull(), F.array(F.struct(block.alias("name"), F.lit("impl").alias("kind")))).otherwise(_declared(line))

    rows = files.select("path", "language", F.split("text", "\r?\n").alias("line")).withColumn("declared", F.transform("line", declared))
    found = rows.mapInArrow(_scoped, f"path string, language string, line string, line_no int, level int, declared {_DECLARED}, end int, above array<int>, inside int")
    kept = F.when(F.col("level").isNotNull(), F.col("declared")).otherwise(F.array().cast(_DECLARED))
    return found.withColumn("declared", kept).withColumn("owner", _named(RECEIVER, F.col("line")))


def scoped_declarations(lines: DataFrame) -> DataFrame:
    """(path, language, name, kind, line, end, holder_line, holder, chain) of ``scoped_lines``: each declaration, its span, and the one it lies in.

    ``holder``: its name, null in the file itself; ``chain``: the names of all around it, the outermost
    first. A function in a type is a method. Blocks that implement a type are not declarations, but hold
    them under the type's name.
    """
    # Lines that declare are few and read three times; where ``lines`` are a plan, it runs once.
    rows = materialize(lines.where(F.size("declared") > 0).select("path", "language", "line_no", "declared", "owner", "end", "above"), "source-declaring")
    scopes = rows.select("path", F.col("line_no").alias("above_line"), F.element_at("declared", -1).alias("scope"))
    around = rows.select("path", "line_no", F.explode("above").alias("above_line")).join(scopes, ["path", "above_line"])
    around = around.groupBy("path", "line_no").agg(F.sort_array(F.collect_list(F.struct("above_line", "scope"))).alias("around"))
    out = rows.join(around, ["path", "line_no"], "left").withColumn("in", F.element_at("around", -1)).select("path", "language", F.explode("declared").alias("d"), "line_no", "end", "owner", "around", "in")
    holder = F.coalesce("owner", F.col("in.scope.name"))
    kind = F.when((F.col("d.kind") == "function") & F.col("in.scope.kind").isin("impl", *HOLDERS), "method").otherwise(F.col("d.kind"))
    return out.where("d.kind <> 'impl'").select(
        "path", "language", "d.name", kind.alias("kind"), F.col("line_no").alias("line"), "end", F.when(F.col("owner").isNull() & (F.col("in.scope.kind") != "impl"), F.col("in.above_line")).alias("holder_line"),
        holder.alias("holder"), F.coalesce(F.when(F.col("owner").isNotNull(), F.array("owner")), F.col("around.scope.name"), F.array().cast("array<string>")).alias("chain"),
    )


def inheritance(lines: DataFrame) -> DataFrame:
    """(path, language, role, text, line, heir, inside) of ``scoped_lines``: each base that a declaration names, and the type that has it."""

    def made(heir: int):
        def of(pattern: str, role: str):
            name, bases = F.regexp_extract("line", pattern, heir), F.regexp_extract("line", pattern, 3 - heir)
            return name != "", F.array(F.struct(name.alias("heir"), bases.alias("bases"), F.lit(role).alias("role")))

        return of

    kind = "struct<heir:string,bases:string,role:string>"
    found = F.concat(_collected(BASES, kind, made(1)), _collected(BASES_FIRST, kind, made(2)))
    rows = lines.select("path", "language", F.explode(found).alias("b"), F.col("line_no").alias("line"), "inside")
    each = rows.select("path", "language", F.col("b.role").alias("role"), F.explode(F.split("b.bases", ",")).alias("text"), "line", F.col("b.heir").alias("heir"), "inside")
    # Access words and what qualifies a base are dropped: names are bound by the resolver.
    plain = F.regexp_extract("text", r"([A-Za-z_$][\w$]*)(?:<[^>]*>?)?\s*$", 1)
    return each.withColumn("text", plain).where("text <> '' AND text <> heir").distinct()


def routes(files: DataFrame) -> DataFrame:
    """(path, language, key, line): routes that a file serves, by calls such as app.get("/x", ..)."""
    rows = _lines(files).select("path", "language", F.regexp_extract("line", ROUTE, 1).alias("method"), F.regexp_extract("line", ROUTE, 2).alias("route"), F.col("line_no").alias("line"))
    return rows.where("method <> ''").select("path", "language", route_key(F.col("method"), F.col("route")).alias("key"), "line").where("key IS NOT NULL")


def module_name(path: Column) -> Column:
    """A relative path as a dotted module name, without its ending and a last index or __init__."""
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/", "."), r"\.(index|mod|__init__)$", "")


def imported_module(text: Column, path: Column) -> Column:
    """The dotted module that an import names; relative ones against the folder of ``path``."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    upper = F.regexp_extract(folder, r"^(.*)/[^/]*$", 1)
    clean = F.regexp_replace(text, r"\.(h|hpp|js|jsx|ts|tsx|rb)$", "")
    joined = F.when(clean.startswith("../"), F.concat_ws("/", upper, F.substring(clean, 4, 4096))).when(clean.startswith("./"), F.concat_ws("/", folder, F.substring(clean, 3, 4096))).otherwise(clean)
    dotted = F.regexp_replace(F.regexp_replace(joined, r"::|/|\\", "."), r"^(crate|self|super)\.", "")
    return F.regexp_replace(dotted, r"^\.+", "")


def call_sites(lines: DataFrame) -> DataFrame:
    """(path, language, text, line, qualifier, inside) of ``scoped_lines``: each call, with what stands before its name; those of a line that are alike are one."""
    found = F.transform(
        F.arrays_zip(F.regexp_extract_all("line", F.lit(CALL), F.lit(1)).alias("q"), F.regexp_extract_all("line", F.lit(CALL), F.lit(2)).alias("n")),
        lambda x: F.struct(F.regexp_replace(x["q"], r"(?:\.|::|->)$", "").alias("qualifier"), x["n"].alias("text")),
    )
    own = F.transform("declared", lambda d: d["name"])
    kept = F.filter(found, lambda x: ~x["text"].isin(*NOT_CALLED) & ~F.array_contains(own, x["text"]))
    # A line is a row, so its calls are told apart there and not shuffled. Outer: for a plain explode the planner
    # asks twice more, by a filter, whether the array is empty, each time by all the patterns.
    some = lines.where(F.col("line").contains("("))
    rows = some.select("path", "language", F.col("line_no").alias("line"), F.explode_outer(F.array_distinct(kept)).alias("c"), "inside")
    return rows.where("c IS NOT NULL").select("path", "language", "c.text", "line", "c.qualifier", "inside")


def uses(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(path, language, role, text, line, heir, qualifier, inside): calls, imports, types and bases by spelling, for the resolver.

    ``inside``: the line whose scope a use lies in; ``lines``: ``scoped_lines`` of the files, where they are at hand.
    No two rows are alike where paths are unique.
    """
    rows = lines if lines is not None else scoped_lines(files)
    none = F.lit(None).cast("string").alias("heir")
    calls = call_sites(rows).select("path", "language", F.lit("call_site").alias("role"), "text", "line", none, "qualifier", "inside")
    unqualified = F.lit(None).cast("string").alias("qualifier")
    module = F.lit("")
    for language, pattern in IMPORTS.items():
        module = F.when(F.col("language") == language, F.regexp_extract("line", pattern, 1)).otherwise(module)
    imports = rows.select("path", "language", F.lit("import_use").alias("role"), module.alias("text"), F.col("line_no").alias("line"), none, unqualified, "inside").where("text <> ''")
    types = rows.where(F.col("language").isin(*TYPED)).select("path", "language", F.lit("type_use").alias("role"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(TYPE)))).alias("text"), F.col("line_no").alias("line"), none, unqualified, "inside")
    bases = inheritance(rows).select("path", "language", "role", "text", "line", "heir", unqualified, "inside")
    return calls.unionByName(imports).unionByName(types).unionByName(bases)
