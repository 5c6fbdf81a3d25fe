"""Source trees as staging tables: configuration files, and Java files by annotations, headers, fields and calls.

Files are read by Spark, one row for each; the row-local parsers below run in Arrow batches. They scan what the graph
needs and are no compilers: other front ends may write the same staging tables.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_NAMES = r"application\.(ya?ml|properties)$"


def text_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, text) of all files below a folder whose names match."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def split_flow(body: str) -> list[str]:
    """The entries of a flow collection's inside, at its commas outside quotes and brackets."""
    if "," not in body:
        return [x] if (x := body.strip()) else []
    out, at = [], 0
    while at < len(body):
        end = cut_outside(body, at, ",")
        out.append(body[at:end].strip())
        at = end + 1
    return [x for x in out if x]


def flow_values(key: str, value: str) -> Iterator[tuple[str, str]]:
    """(key, value) of a scalar, or of what a flow mapping or list on one line holds."""
    value = value.strip()
    if value[:1] == "{" and value[-1:] == "}":
        for entry in split_flow(value[1:-1]):
            name, _, rest = entry.partition(":")
            yield from flow_values(f"{key}.{name.strip().strip(QUOTES)}".lstrip("."), rest)
    elif value[:1] == "[" and value[-1:] == "]":
        for k, entry in enumerate(split_flow(value[1:-1])):
            yield from flow_values(f"{key}[{k}]", entry)
    else:
        yield key, value.strip(QUOTES)


QUOTES = "\"'"


def flatten_yaml(text: str) -> Iterator[tuple[str, str]]:
    """(dotted key, value) of mappings, lists, block and flow styles and plain scalars; list items are `key[i]`."""
    stack: list[tuple[int, str]] = []
    counts: dict[str, int] = {}
    lines = text.splitlines()
    at = 0
    while at < len(lines):
        line = re.sub(r"(^|\s)#.*$", "", lines[at]).rstrip()
        at += 1
        if not line.strip() or line.strip() in ("---", "..."):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while stack and stack[-1][0] >= indent + (body.startswith("- ") and stack[-1][0] == indent):
            stack.pop()
        parent = stack[-1][1] if stack else ""
        if body.startswith("-"):
            k = counts.get(parent, 0)
            counts[parent] = k + 1
            parent = f"{parent}[{k}]"
            body = body[1:].strip()
            stack.append((indent + 1, parent))
            indent += 2
        m = re.match(r"""("[^"]*"|'[^']*'|[^:\s{\[][^:]*):(?:\s+(.*))?$""", body)
        key = f"{parent}.{m[1].strip(QUOTES)}".lstrip(".") if m else parent
        value = (m[2] or "").strip() if m else body
        if block := re.match(r"([|>])([+-]?)\d?$", value):
            # The lines that are deeper than the key, without their common indent; folded ones are joined by spaces.
            held = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > (stack[-1][0] if stack and not m else indent if not stack or stack[-1][0] != indent - 1 else indent - 2)):
                held.append(lines[at])
                at += 1
            depth = min((len(x) - len(x.lstrip()) for x in held if x.strip()), default=0)
            joined = ("\n" if block[1] == "|" else " ").join(x[depth:] for x in held).rstrip()
            yield key, joined if block[2] == "-" or block[1] == ">" else joined + "\n"
        elif m and not value:
            stack.append((indent, key))
        elif value:
            yield from flow_values(key, value)


def flatten_properties(text: str) -> Iterator[tuple[str, str]]:
    for line in re.sub(r"\\\r?\n\s*", "", text).splitlines():
        if (m := re.match(r"\s*([^#!=:\s][^=:\s]*)\s*[=:\s]\s*(.*)$", line)) is not None:
            yield m[1], m[2].strip()


def properties(files: DataFrame) -> DataFrame:
    """(key, value) of all configuration files; of a key in several files that of the last path counts. files: (path, text)."""

    def run(batches):
        for batch in batches:
            rows = [(p, i, k, v) for p, t in zip(*(c.to_pylist() for c in batch.columns)) for i, (k, v) in enumerate((flatten_properties if p.endswith(".properties") else flatten_yaml)(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "ord", "key", "value"])

    read = files.filter(F.col("path").rlike(CONFIG_NAMES)).select("path", "text").mapInArrow(run, "path string, ord bigint, key string, value string")
    return read.groupBy("key").agg(F.max_by("value", F.struct("path", "ord")).alias("value"))


NOTE = r"@\w+(?:\.\w+)*(?:\((?:[^()]|\([^()]*\))*\))?\s*"
MODIFIER = r"(?:public|protected|private|static|final|abstract|default|synchronized|native|transient|volatile|sealed|strictfp)\s+"
NAMED = r"[\w.]+(?:<[^;{}()=]*>)?(?:\[\])*"
TYPE = re.compile(rf"((?:{NOTE})*)(?:{MODIFIER})*\b(class|interface|enum|record)\s+(\w+)\s*(?:<[^{{]*?>)?\s*(?:\([^)]*\)\s*)?(?:extends\s+([\w.<>, ]+?)\s*)?(?:implements\s+([\w.<>, ]+?)\s*)?\{{")
#: Members begin at the beginning of a word; from the middle of one only what was found there already would be found again.
BEGIN = r"(?:(?<![\w.])|(?=[@<]))"
FIELD = re.compile(rf"{BEGIN}((?:{NOTE})*)(?:{MODIFIER})*({NAMED})\s+(\w+)\s*(?:=[^;]*)?;")
METHOD = re.compile(rf"{BEGIN}((?:{NOTE})*)(?:{MODIFIER})*(?:<[^<>;{{}}()]*>\s*)?({NAMED})\s+(\w+)\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)\s*(?:throws [\w., ]+)?([{{;])")
CALL = re.compile(r"((?:\w+\s*\.\s*)*)(\w+)\s*\(")
LOCAL = re.compile(rf"(?<![\w.])({NAMED})\s+(\w+)\s*(?==[^=]|;|:)")
PARAMETER = re.compile(rf"(?:{NOTE})*(?:final\s+)?({NAMED})(?:\s*\.\.\.)?\s+(\w+)\s*(?:,|$)")
IMPORT = re.compile(r"(?:^|;)\s*import\s+(static\s+)?([\w.]+)(\.\*)?\s*(?=;)", re.M)
ASSIGNED = re.compile(r"(?:String|var)\s+(\w+)\s*=\s*([^;]+);")
ANNOTATION = re.compile(r"@(\w+)(?:\(([^)]*)\))?")
STRUCT = pa.struct([("annotation", pa.string()), ("argument", pa.string())])
JAVA = "path string, package_name string, kind string, owner string, name string, declared string, annotations array<struct<annotation: string, argument: string>>, extends_class string, interfaces array<string>, member string, argument string, ord int, method int, call int, receiver string, typed string, on int, chain int, depth int, arity int, values array<string>"
BRACE, BRACKET, WORD = re.compile("[{}]"), re.compile("[()]"), re.compile(r"[\w.]+")
KEYWORDS = {"if", "for", "while", "switch", "return", "new", "catch", "super", "this", "synchronized", "try", "throw", "else", "case", "assert", "package", "import"}


DYNAMIC = "<dynamic>"


@functools.lru_cache
def signs(stops: str) -> re.Pattern:
    return re.compile(rf"[\"'()\[\]{{}}{re.escape(stops)}]")


def cut_outside(text: str, at: int, stops: str) -> int:
    """Where the first of some signs stands at or after a place, outside quotes and brackets opened since; the end if nowhere."""
    depth, quote = 0, ""
    for m in signs(stops).finditer(text, at):
        c = m[0]
        if quote:
            quote = "" if c == quote and text[m.start() - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif not depth and c in stops:
            return m.start()
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
    return len(text)


def assembled(expression: str, known: dict[str, str]) -> str:
    """The text that a Java expression makes: literals, constants and variables joined by `+`, String.format; what is computed is `<dynamic>`.

    A name that is not known here stands as `${#name}`, to be looked up among the constants of all files.
    """
    e = expression.strip()
    if e.startswith("String.format") and (m := re.match(r"String\.format\(\s*\"((?:[^\"\\]|\\.)*)\"", e)):
        return re.sub(r"%[-\d.]*[sd]", DYNAMIC, m[1])
    out, at = [], 0
    while at < len(e):
        end = cut_outside(e, at, "+")
        part = e[at:end].strip()
        name = part.removeprefix("this.")
        if len(part) > 1 and part[0] == part[-1] == '"':
            out.append(part[1:-1])
        elif re.fullmatch(r"[A-Za-z_][\w.]*", name):
            out.append(known.get(name, f"${{#{name}}}"))
        else:
            out.append(DYNAMIC)
        at = end + 1
    return "".join(out)


def annotation_texts(argument: str | None, names: tuple[str, ...], known: dict[str, str]) -> list[str]:
    """The texts that one element of an annotation gives: of `names` the first that is there, or a lone value; each member of an array is one text."""
    entries = [(m[1], m[2]) if (m := re.match(r"(\w+)\s*=(?!=)\s*(.*)$", x, re.S)) else ("value", x) for x in split_flow(argument or "")]
    for name in names:
        for key, value in entries:
            if key == name:
                value = value.strip()
                return [assembled(x, known) for x in (split_flow(value[1:-1]) if value[:1] == "{" else [value])]
    return []


class Source:
    """A Java file without comments: its text, the text with strings blanked out, its braces and how deep each leads, and its types."""

    def __init__(self, text: str):
        self.text = re.sub(r'("(?:\\.|[^"\\\n])*")|/\*.*?\*/|//[^\n]*', lambda m: m[1] or " ", text, flags=re.S)  # comments, but not in strings
        self.plain = re.sub(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'', lambda m: m[0][0] + "_" * (len(m[0]) - 2) + m[0][0], self.text)
        braces = list(BRACE.finditer(self.plain))
        self.braces = [m.start() for m in braces]
        self.levels = list(accumulate((1 if m[0] == "{" else -1 for m in braces), initial=0))
        #: (match, begin of the body, its end): a type's members are those one brace deeper than it.
        self.types = [(m, m.end(), self.closed(m.end())) for m in TYPE.finditer(self.plain)]

    def depth(self, at: int) -> int:
        """How deep in braces a place is."""
        return self.levels[bisect_left(self.braces, at)]

    def closed(self, at: int) -> int:
        """Where the brace that was opened just before a place is closed."""
        first = bisect_left(self.braces, at)
        return next((self.braces[k] for k in range(first, len(self.braces)) if self.levels[k + 1] < self.levels[first]), len(self.plain))

    def chain(self, at: int) -> str:
        """The names of the types around a place, outermost first, joined by dots."""
        return ".".join(name for _, name in sorted((begin, m[3]) for m, begin, end in self.types if begin <= at < end))

    def owner(self, at: int) -> str | None:
        """The type (with those around it) of which a declaration at a place is a member; None in the middle of code."""
        inside = [begin for m, begin, end in self.types if begin <= at < end]
        return self.chain(at) if inside and self.depth(at) == self.depth(max(inside)) else None

    def before(self, at: int, begin: int) -> int:
        """The last place before another that is no space, or the one before `begin`."""
        at -= 1
        while at >= begin and self.plain[at].isspace():
            at -= 1
        return at

    def calls(self, begin: int, end: int, typed: dict[str, str]) -> Iterator[tuple[re.Match, str, str | None, str | None, int | None, int, int]]:
        """(match, receiver, name of the receiver, type of it, call it is made on, first call of the chain, place in the chain) of the calls in a body, in order.

        Receivers: self, super, name (a field or a type), typed (a variable of known type), chain (the result of another call), new, unknown.
        `typed` holds the parameters' types; declarations of variables add to it as they come.
        """
        opened, stack = {}, []
        for m in BRACKET.finditer(self.plain, begin, end):
            if m[0] == "(":
                stack.append(m.start())
            elif stack:
                opened[m.start()] = stack.pop()
        found: dict[int, tuple[int, int, int]] = {}  # by opening bracket: number, chain, depth
        made_by: dict[str, int] = {}
        locals_ = [m for m in LOCAL.finditer(self.plain, begin, end) if m[1] not in KEYWORDS]
        for k, c in enumerate(CALL.finditer(self.plain, begin, end)):
            while locals_ and locals_[0].start() < c.start():
                m = locals_.pop(0)
                typed.pop(m[2], None)
                made_by.pop(m[2], None)
                if m[1] != "var":
                    typed[m[2]] = m[1]
                elif new := re.match(rf"\s*=\s*new\s+({NAMED})", self.plain[m.end() : end]):
                    typed[m[2]] = new[1]
                else:
                    made_by[m[2]] = opened.get(cut_outside(self.plain, m.end(), ";") - 1, -1)
            path = "".join(c[1].split()).strip(".")
            last = self.before(c.start(), begin)
            on = None
            if self.plain[last] == ".":
                on = found.get(opened.get(self.before(last, begin), -1)) if not path else None
                receiver, name, kind = ("chain" if on else "unknown"), None, None
            elif self.plain[last] == "w" and re.search(r"(?<!\w)new$", self.plain[max(begin, last - 3) : last + 1]):
                receiver, name, kind = "new", None, ".".join(x for x in (path, c[2]) if x)
            elif path in ("", "this"):
                receiver, name, kind = "self", None, None
            elif path == "super":
                receiver, name, kind = "super", None, None
            else:
                name = path.removeprefix("this.")
                on = found.get(made_by[name]) if name in made_by and path == name else None
                kind = typed.get(name) if path == name else None
                receiver = "chain" if on else "unknown" if name in made_by and path == name else "typed" if kind else "name"
            number, chain, depth = k, on[1] if on else k, on[2] + 1 if on else 0
            found[c.end() - 1] = (number, chain, depth)
            yield c, receiver, name, kind, on[0] if on else None, chain, depth

    def members(self, pattern: re.Pattern) -> Iterator[tuple[str, re.Match]]:
        """(type, match) of the declarations in type bodies; what they name stands at the match's third group."""
        at = 0
        while m := pattern.search(self.plain, at):
            words = m[0].split()
            owner = self.owner(m.start(3))
            if owner and not KEYWORDS & {words[0], m[2], m[3]}:
                yield owner, m
                at = m.end()
            else:
                # What begins later in the same word ends as this did.
                at = m.end() if owner else m.start() + 1 if m.start() < m.start(2) else WORD.match(self.plain, m.start()).end()

    def of(self, m: re.Match, group: int = 0) -> str:
        return self.text[m.start(group) : m.end(group)] if m[group] is not None else ""


def bare(name: str) -> str:
    return re.sub(r"<.*|\[\]", "", name, flags=re.S).strip()


def java_rows(path: str, text: str) -> Iterator[tuple]:
    """Imports, types, fields, methods and invocations of a file, in order: rows of JAVA. Interfaces' methods and members without a modifier count like others.

    A nested type goes by the names of the types around it and its own. Methods are numbered in `method`, the calls of each in `call`.
    """
    source = Source(text)
    package = (re.search(r"^\s*package\s+([\w.]+)\s*;", source.plain, re.M) or [None, ""])[1]
    notes = lambda s: [{"annotation": a, "argument": b.strip().strip('"') if b else None} for a, b in ANNOTATION.findall(s or "")]
    names = lambda s: [re.sub(r"<.*", "", x).strip() for x in re.sub(r"<[^<>]*>", "", s or "").split(",") if x.strip()]
    place = (None,) * 8
    for n, m in enumerate(m for m in IMPORT.finditer(source.plain) if not m[1]):
        yield path, package, "import", None, "*" if m[3] else m[2].rpartition(".")[2], m[2], [], None, [], None, None, n, *place, []
    for n, (m, begin, _) in enumerate(source.types):
        around = source.chain(m.start())
        yield path, package, "type", around or None, source.chain(begin), m[2], notes(source.of(m, 1)), (m[4] or "").strip() or None, names(m[5]) + (names(m[4]) if m[2] == "interface" else []), None, None, n, *place, []
    fields = [(owner, m) for owner, m in source.members(FIELD)]
    texts = [assembled(source.of(m).partition("=")[2].rstrip().rstrip(";"), {}) if "=" in m[0][len(m[1]) :] else None for _, m in fields]
    constants = {m[3]: t for (_, m), t in zip(fields, texts) if t and "${#" not in t and not m[1]}
    for n, ((owner, m), held) in enumerate(zip(fields, texts)):
        marks = notes(source.of(m, 1))
        value = next((a["argument"] for a in marks if a["annotation"] == "Value"), held if bare(m[2]) == "String" else None)
        yield path, package, "field", owner, m[3], m[2], marks, "final" if re.search(r"\bfinal\s", m[0][len(m[1]) : m.start(2) - m.start()]) else None, [], None, value, n, *place, []
    at = 0
    for n, (owner, m) in enumerate(source.members(METHOD)):
        marks, raw = notes(source.of(m, 1)), dict(ANNOTATION.findall(source.of(m, 1)))
        topics = annotation_texts(raw.get("KafkaListener"), ("topics", "value"), {})
        parameters = {p[2]: p[1] for p in PARAMETER.finditer(m[4].strip())}
        many = sum(1 for _ in split_flow(m[4]))
        yield path, package, "method", owner, m[3], m[2].strip(), marks, None, [], None, f"{m[2].strip()} {m[3]}({source.of(m, 4).strip()})", n, n, None, "abstract" if m[5] == ";" else None, None, None, None, None, many, topics
        if m[5] == ";":
            continue
        end = source.closed(m.end())
        known = constants | dict.fromkeys(parameters, DYNAMIC)
        for a in ASSIGNED.finditer(source.text, m.end(), end):
            known[a[1]] = assembled(a[2], known)
        for k, (c, receiver, name, kind, on, chain, depth) in enumerate(source.calls(m.end(), end, dict(parameters))):
            if c[2] not in KEYWORDS:
                inside = source.text[c.end() : cut_outside(source.text, c.end(), ")")]
                given = split_flow(inside)
                yield path, package, "call", owner, m[3], name, [], None, [], c[2], assembled(given[0], known) if given else None, at, n, k, receiver, kind, on, chain, depth, len(given), []
                at += 1


FILES_AT_ONCE = 256


def java_staging(files: DataFrame) -> DataFrame:
    """Rows of JAVA for all files. files: (path, text)."""
    names = [f.strip().split()[0] for f in re.split(r", (?=\w+ )", JAVA.replace("struct<annotation: string, argument: string>", "S"))]
    kinds = [pa.string()] * 6 + [pa.list_(STRUCT), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()] + [pa.int32()] * 3 + [pa.string()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.string())]

    def run(batches):
        for batch in batches:
            # A batch holds many files; the rows of a few at once keep the worker small.
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                rows = [r for p, t in zip(*(c.to_pylist() for c in batch.slice(at, FILES_AT_ONCE).columns)) for r in java_rows(p, t or "")]
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return files.select("path", "text").mapInArrow(run, JAVA)


def build_probe(files: DataFrame) -> DataFrame:
    """One row: whether Maven or Gradle files are there, and how many Java files outside .git. files: (path)."""
    p = F.col("path")
    return files.agg(F.max(p.endswith("pom.xml")).alias("maven"), F.max(p.rlike(r"build\.gradle(\.kts)?$")).alias("gradle"), F.count(F.when(p.endswith(".java") & ~p.contains("/.git/"), 1)).alias("java_files"))
