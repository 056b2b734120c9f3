"""Source code: chunks, definitions and signals of Python by its own parser; imports and kinds of files by expressions."""

from __future__ import annotations

import ast
import re

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

_CHUNKS = "id long, pos int, start_line int, chunk string, name string, domain string"
_DEFINITIONS = "id long, name string, kind string, owner string, start_line int, end_line int, docstring string, decorators array<string>"
_SIGNALS = "id long, name string, internal_calls array<string>, external_calls array<string>, reads array<string>, writes array<string>, subscripts array<string>, parameters array<string>, has_loop boolean, has_condition boolean, has_try boolean, is_async boolean, n_lines int"
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _tree(source: str | None):
    try:
        return ast.parse((source or "").lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        return None


def _first_line(node) -> int:
    return min([node.lineno, *(d.lineno for d in node.decorator_list)])


def name_domain(name: str, is_class: bool) -> str:
    if name.startswith("test") or name.startswith("Test"):
        return "test"
    if name.startswith("_") and not name.startswith("__"):
        return "private"
    if not is_class and re.match("(get|set|is|has)_", name):
        return "accessor"
    return "class" if is_class else "function"


def cut_python(source: str) -> list[tuple[int, str, str | None, str | None]]:
    """(first line, text, name, domain): what precedes the first definition, then each definition with its decorators.
    A text that doesn't parse is cut at lines that start a definition; one without definitions is a single chunk."""
    source = source.lstrip("﻿")
    lines, tree = source.split("\n"), _tree(source)
    if tree is None:
        starts = [i for i, x in enumerate(lines) if i == 0 or re.match(r"\s*(def|class|function|export) ", x)]
        pieces = [(a + 1, "\n".join(lines[a:b]).strip(), None, None) for a, b in zip(starts, [*starts[1:], len(lines)])]
        return [p for p in pieces if p[1]]
    found = sorted((_first_line(n), n.end_lineno, n) for n in tree.body if isinstance(n, (*_FUNCTIONS, ast.ClassDef)))
    if not found:
        return [(1, source.strip(), None, None)] if source.strip() else []
    head = "\n".join(lines[: found[0][0] - 1]).strip()
    out = [(1, head, None, "imports")] if len(head) > 30 else []
    for a, b, n in found:
        text = "\n".join(lines[a - 1 : b]).strip()
        if len(text) >= 20:
            out.append((a, text, n.name, name_domain(n.name, isinstance(n, ast.ClassDef))))
    return out


def _each(df: DataFrame, schema: str, rows) -> DataFrame:
    """mapInPandas over (id, content) with a function that gives rows without the id."""
    names = [x.split()[0] for x in re.sub(r"<[^>]*>", "", schema).split(", ")]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([(i, *r) for i, c in zip(frame["id"], frame["content"]) for r in rows(c or "")], columns=names)

    return df.select("id", "content").mapInPandas(run, schema)


def python_chunks(df: DataFrame) -> DataFrame:
    return _each(df, _CHUNKS, lambda c: [(k, *x) for k, x in enumerate(cut_python(c))])


def _definitions(source: str):
    tree = _tree(source)
    if tree is None:
        return
    owners = {c: n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef) for c in n.body if isinstance(c, _FUNCTIONS)}
    for n in ast.walk(tree):
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
            kind = "class" if isinstance(n, ast.ClassDef) else "method" if n in owners else "function"
            doc = (ast.get_docstring(n) or "").strip() or None
            yield n.name, kind, owners.get(n), _first_line(n), n.end_lineno, doc, [ast.unparse(d).split("(")[0] for d in n.decorator_list]


def definitions(df: DataFrame) -> DataFrame:
    """id, name, kind, owner, start_line, end_line, docstring, decorators of every class, function and method."""
    return _each(df, _DEFINITIONS, lambda c: list(_definitions(c)))


def _signals(source: str):
    tree = _tree(source)
    for f in ast.walk(tree) if tree else ():
        if not isinstance(f, _FUNCTIONS):
            continue
        inner, outer, reads, writes, subs, called = set(), set(), set(), set(), set(), set()
        params = {a.arg for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]} - {"self", "cls"}
        used, every = set(), [n for s in f.body for n in ast.walk(s)]
        for n in every:
            if isinstance(n, ast.Call):
                called.add(n.func)
                text = ast.unparse(n.func)
                (inner if text.startswith("self.") else outer).add(text.removeprefix("self."))
            elif isinstance(n, ast.Subscript):
                text = ast.unparse(n)
                subs.add(text if len(text) <= 100 else text[:97] + "...")
            elif isinstance(n, ast.Name) and n.id in params:
                used.add(n.id)
        for n in every:
            if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self" and n not in called:
                (reads if isinstance(n.ctx, ast.Load) else writes).add(f"self.{n.attr}")
        has = lambda *kinds: any(isinstance(n, kinds) for n in every)
        yield f.name, sorted(inner), sorted(outer), sorted(reads), sorted(writes), sorted(subs), sorted(used), has(ast.For, ast.While, ast.AsyncFor), has(ast.If, ast.IfExp), has(ast.Try), isinstance(f, ast.AsyncFunctionDef), f.end_lineno - f.lineno + 1


def signals(df: DataFrame) -> DataFrame:
    """What each function calls, reads, writes and subscripts, and its shape."""
    return _each(df, _SIGNALS, lambda c: list(_signals(c)))


def signal_tags(rows: DataFrame) -> DataFrame:
    """id, name, tags: signals as prefixed tags, each once, in order of kinds."""
    tag = lambda prefix, c, of=lambda x: x: F.transform(c, lambda x: F.concat(F.lit(prefix), of(x)))
    calls = tag("calls:", F.concat("internal_calls", "external_calls"), lambda x: F.substring_index(x, ".", -1))
    key = lambda x: F.substring_index(F.substring_index(x, "[", 1), ".", -1)
    last = lambda x: F.substring_index(x, ".", -1)
    return rows.select("id", "name", F.array_distinct(F.concat(calls, tag("reads:", "reads", last), tag("writes:", "writes", last), tag("subscript:", "subscripts", key), tag("param:", "parameters"))).alias("tags"))


def enrich(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Chunks (id, pos, chunk) with the signals of the functions that they define appended as text, and a has_signals flag."""
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}: "), F.array_join(c, ", ")))
    text = F.concat_ws("\n", part("Calls", F.concat("internal_calls", "external_calls")), part("Reads", "reads"), part("Writes", "writes"), part("Subscripts", "subscripts"), part("Parameters used", "parameters"))
    said = rows.select("id", "name", text.alias("said")).where("said != ''")
    both = chunks.select("id", "pos", "chunk").join(said, "id", "left").withColumn("said", F.when(F.contains("chunk", F.concat(F.lit("def "), "name", F.lit("("))), F.col("said")))
    one = both.groupBy("id", "pos").agg(F.first("chunk").alias("chunk"), F.array_join(F.array_sort(F.collect_set("said")), "\n").alias("said"))
    return one.select("id", "pos", F.when(F.col("said") != "", F.concat("chunk", F.lit("\n\n[Implementation Signals]\n"), "said")).otherwise(F.col("chunk")).alias("chunk"), (F.col("said") != "").alias("has_signals"))


def parse_import(statement: Column, language: Column) -> Column:
    """struct(module, type) of an import statement; null where there is none."""
    s = strip(statement)
    get = lambda pattern, n=1: F.nullif(F.regexp_extract(s, pattern, n), F.lit(""))
    rest = lambda word: get(rf"^{word} +(.*?) *;? *$")
    quoted = get("[\"']([^\"']+)[\"']")
    one = lambda module, kind: F.when(module.isNotNull(), F.struct(module.alias("module"), F.lit(kind).alias("type")))
    return (
        F.when((language == "python") & s.startswith("from "), one(get(r"^from +(\S+)"), "from_import"))
        .when((language == "python") & s.startswith("import "), one(get(r"^import +([^\s,]+)"), "import"))
        .when(language.isin("java", "kotlin", "swift") & s.startswith("import "), one(rest("import"), "import"))
        .when((language == "go") & s.contains("import"), one(get('"([^"]+)"'), "import"))
        .when(language.isin("c", "objc") & s.startswith("#include"), one(F.coalesce(get("<([^>]+)>"), get('"([^"]+)"'), rest("#include")), "include"))
        .when((language == "csharp") & s.startswith("using "), one(rest("using"), "using"))
        .when((language == "ruby") & s.rlike("^(require|load)|(require|load)\\("), one(F.coalesce(quoted, get(r"^\w+[ (]+([^\s)]+)")), "require"))
    )


#: Kinds of syntax nodes and words that decide on a domain.
_NODES = {
    "imports": "import_statement import_from_statement import_declaration using_directive preproc_include preproc_import import_header call",
    "interface": "interface_declaration protocol_declaration trait_declaration",
    "class": "class_definition class_declaration struct_specifier struct_declaration type_declaration class_interface class_implementation object_declaration record_declaration enum_declaration enum_definition",
    "function": "function_definition function_declaration method_definition method_declaration function_item constructor_declaration destructor_declaration init_declaration deinit_declaration",
}
GENERATED = ("DO NOT EDIT", "@GENERATED", "AUTO-GENERATED", "GENERATED BY", "AUTO GENERATED", "AUTOGENERATED", "THIS FILE IS AUTOMATICALLY GENERATED")
TEST_ANNOTATIONS = ("test", "fact", "theory", "parameterizedtest", "repeatedtest", "testcase", "testmethod", "unittest")


def domain(node: Column, name: Column, path: Column, language: Column, modifiers: Column, annotations: Column) -> Column:
    """The domain of a code entity: tests first, then imports, interfaces, privates, accessors, constants, classes, functions."""
    is_ = lambda kind: node.isin(*_NODES[kind].split())
    low, mods = F.lower(name), F.transform(modifiers, F.lower)
    test = (
        F.lower(path).rlike(r"(^|/)tests?/|(^|/)specs?/|__tests__")
        | F.exists(annotations, lambda a: F.lower(a).isin(*TEST_ANNOTATIONS) | F.contains(F.lower(a), F.lit("pytest.mark")))
        | low.rlike("^(test|spec_|should_|when_|given_)") | low.rlike("(test|spec)$")
        | ((language == "ruby") & low.isin("describe", "it", "context", "before", "after", "let", "subject"))
    )
    private = F.array_contains(mods, "private") | (language.isin("python", "ruby") & name.rlike("^_(?!_)")) | ((language == "swift") & name.startswith("_"))
    accessor = is_("function") & name.rlike("^(?i:get|set|is|has|can|should|will)[A-Z_]")
    upper = (F.upper(name) == name) & (F.lower(name) != name)
    k_name = name.rlike("^k[A-Z]")
    constant = (F.arrays_overlap(mods, F.array(F.lit("const"), F.lit("final"), F.lit("static"))) & (upper | k_name)) | ((language == "python") & upper & name.contains("_")) | (language.isin("java", "kotlin", "csharp") & (upper | k_name)) | ((language == "go") & upper)
    return F.when(test, "test").when(is_("imports"), "imports").when(is_("interface"), "interface").when(private, "private").when(accessor, "accessor").when(constant, "constant").when(is_("class"), "class").otherwise("function")


def inferred_domain(annotations: Column, names: Column) -> Column:
    """A domain from annotations, else from names; the first that says something decides."""
    hint = lambda table: lambda x: F.coalesce(*(F.when(F.lower(x).rlike(p), d) for p, d in table))
    by_mark = hint((("test|junit|fact", "test"), ("controller|getmapping|postmapping", "web"), ("repository|entity|table", "data"), ("service|component|bean", "service")))
    by_name = hint((("test|spec|should", "test"), ("util|helper|common", "utility"), ("config|setting|property", "config")))
    first = lambda c, f: F.get(F.filter(F.transform(c, f), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(first(annotations, by_mark), first(names, by_name))


def simple_reason(path: Column, language: Column, content: Column, functions: Column, classes: Column, interfaces: Column) -> Column:
    """Why a file needs no summary of its own, or null."""
    lines = F.split(content, "\n")
    n, full = F.size(lines), F.size(F.filter(lines, lambda x: strip(x) != ""))
    head = F.upper(F.array_join(F.slice(lines, 1, 20), "\n"))
    made = F.lit(False)
    for m in GENERATED:
        made = made | F.contains(head, F.lit(m))
    name = F.lower(F.substring_index(path, "/", -1))
    bare = (functions == 0) & (classes == 0)
    script, typed = language.isin("typescript", "javascript"), language.isin("typescript", "javascript", "java", "csharp")
    assigned = F.size(F.filter(lines, lambda x: x.contains("=") & ~strip(x).startswith("#")))
    return (
        F.when(made, "generated_code")
        .when((language == "python") & (name == "__init__.py"), "barrel_reexport")
        .when((language == "python") & (n <= 30) & bare, F.when(full > 3, "constants_only").otherwise("empty_module"))
        .when(script & name.isin("index.ts", "index.js", "index.tsx", "index.jsx") & bare, "barrel_reexport")
        .when((language == "java") & (name == "package-info.java"), "barrel_reexport")
        .when(typed & bare & (interfaces > 0), "type_definitions")
        .when((n <= 10) & bare, "empty_module")
        .when((n <= 30) & bare & (full > 3) & (assigned >= full * 0.4), "constants_only")
    )


def parse_summary(c: Column) -> Column:
    """struct(purpose, pattern, domain, exports, dependencies) of a summary in lines `Name: value`."""
    line = lambda name: F.nullif(strip(F.regexp_extract(c, rf"(?m)^\s*{name}:(.*)$", 1)), F.lit(""))
    some = lambda x: F.when(F.lower(x) != "none", x)
    listed = lambda x: F.filter(F.transform(F.split(F.coalesce(some(x), F.lit("")), ","), strip), lambda v: v != "")
    return F.struct(line("Purpose").alias("purpose"), some(line("Pattern")).alias("pattern"), some(line("Domain")).alias("domain"), listed(line("Key Exports")).alias("exports"), listed(line("Dependencies")).alias("dependencies"))


def template_summary(path: Column, language: Column, reason: Column) -> Column:
    """The summary of a simple file without a model."""
    what = F.when(reason == "barrel_reexport", "re-exports names of its package").when(reason == "generated_code", "is generated").when(reason == "type_definitions", "declares types").when(reason == "constants_only", "holds constants").otherwise("is empty or nearly so")
    return F.format_string("Purpose: %s %s\nPattern: %s", F.substring_index(path, "/", -1), what, reason)


def call_edges(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """src, dst of calls: signals (id, name, internal_calls, external_calls) against definitions (id, name, owner).

    A call on self resolves within the class, else to any definition of that name in the file, else to a placeholder;
    another call resolves by its last part to the first definition of that name in order of (id, name), else stays as is."""
    full = F.concat_ws(".", "owner", "name")
    d = owners.select("id", "name", "owner", full.alias("full"))
    m = rows.join(d, ["id", "name"])
    inner = m.select("id", "owner", F.col("full").alias("src"), F.explode("internal_calls").alias("called"))
    same = d.select("id", F.col("owner").alias("o"), F.col("name").alias("called"), F.col("full").alias("dst"))
    within = inner.join(same, ["id", "called"], "left").groupBy("id", "src", "called", "owner").agg(F.min(F.struct(F.when(F.col("o").eqNullSafe(F.col("owner")), 0).otherwise(1).alias("k"), "dst")).alias("b"))
    a = within.select("src", F.coalesce(F.col("b.dst"), F.concat(F.lit("self."), "called")).alias("dst"))
    outer = m.select(F.col("full").alias("src"), F.explode("external_calls").alias("called")).withColumn("last", F.substring_index("called", ".", -1))
    first = d.groupBy(F.col("name").alias("last")).agg(F.min_by("full", F.struct("id", "full")).alias("hit"))
    b = outer.join(first, "last", "left").select("src", F.coalesce("hit", "called").alias("dst"))
    return a.unionByName(b).where("src != dst").distinct()
