"""Facts from source text: imports, symbols, calls, endpoints, commands, schedules, scripts and tokens.

What regular expressions can say is said in column functions; what needs a
syntax tree is parsed file by file in Arrow batches.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

FACT = StructType([StructField(n, IntegerType() if n == "line" else StringType()) for n in ("fact", "name", "detail", "owner", "confidence", "line")])
PARSED = StructType([StructField("path", StringType()), StructField("status", StringType()), StructField("facts", ArrayType(FACT))])
VERBS = ("get", "post", "put", "patch", "delete")
#: Runners whose one argument is a source file, and tokens that say nothing of a convention.
RUNNERS = ("node", "nodejs", "tsx", "ts-node", "bun", "python", "python3", "php")
GENERIC = ("active", "btn", "button", "container", "disabled", "error", "form", "form-control", "hidden", "input", "label", "modal", "row", "selected", "show", "table", "text", "title", "value", "wrapper")


def python_facts(text: str, path: str) -> tuple[str, list[tuple]]:
    """Imports, top-level symbols, plain calls, decorator endpoints and framework commands of a Python file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return "parse-failed", []
    out: list[tuple] = []
    local = {n.name for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [("import", a.name, a.asname, None, "exact", node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            out += [("import", base, a.name, a.asname, "exact", node.lineno) for a in node.names]
    bound = {x[3] or x[2] or x[1] for x in out}
    for top in tree.body:
        if not isinstance(top, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            continue
        out.append(("symbol", top.name, "class" if isinstance(top, ast.ClassDef) else "function", None, "exact", top.lineno))
        for d in top.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            target = call.func if call else d
            if not isinstance(target, ast.Attribute):
                continue
            verb = target.attr.lower()
            route = next((a.value for a in (call.args if call else []) if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
            if verb in (*VERBS, "route") and route is not None:
                methods = [verb.upper()]
                if verb == "route":
                    given = next((k.value for k in call.keywords if k.arg == "methods" and isinstance(k.value, ast.List | ast.Tuple)), None)
                    methods = [e.value.upper() for e in given.elts if isinstance(e, ast.Constant)] if given else ["GET"]
                out += [("endpoint", f"{m} {route}", top.name, None, "likely", d.lineno) for m in methods]
            elif verb == "command":
                out.append(("command", route or top.name.replace("_", "-"), top.name, None, "exact", d.lineno))
        if isinstance(top, ast.ClassDef) and top.name == "Command" and "/management/commands/" in f"/{path}" and any("BaseCommand" in ast.unparse(b) for b in top.bases):
            if sum(isinstance(n, ast.FunctionDef) and n.name == "handle" for n in top.body) == 1:
                out.append(("command", path.rsplit("/", 1)[-1][:-3], "Command", None, "exact", top.lineno))
            else:
                out.append(("unsupported", path.rsplit("/", 1)[-1][:-3], "handle-not-unique", None, "exact", top.lineno))
        for f in ast.walk(top):
            if not isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
                continue
            args = f.args
            shadow = {a.arg for a in (*args.args, *args.kwonlyargs, *args.posonlyargs)} | {t.id for n in ast.walk(f) for t in ast.walk(n) if isinstance(t, ast.Name) and isinstance(t.ctx, ast.Store)}
            for n in ast.walk(f):
                if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in local | bound and n.func.id not in shadow:
                    out.append(("call", n.func.id, None, top.name, "exact", n.lineno))
    return "parsed", sorted(set(out), key=lambda r: (r[5], r[0], r[1] or ""))


def script_facts(text: str) -> tuple[str, list[tuple]]:
    """Imports, top-level symbols, literal routes, fetches and cron schedules of a JavaScript or TypeScript file, by pattern."""
    out: list[tuple] = []
    line = lambda at: text.count("\n", 0, at) + 1
    for m in re.finditer(r"""(?:^|[;\n])\s*(?:import|export)\b[^;'"\n]*?from\s*['"]([^'"]+)['"]|(?:^|[;\n])\s*import\s*['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)""", text):
        out.append(("import", next(g for g in m.groups() if g), None, None, "exact", line(m.end())))
    for m in re.finditer(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+([A-Za-z_$][\w$]*)|^(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", text, re.M):
        out.append(("symbol", m[2] or m[3], m[1] or "function", None, "exact", line(m.start())))
    for m in re.finditer(r"""\b(?:app|router|server)\.(get|post|put|patch|delete)\(\s*['"](/[^'"]*)['"]\s*,\s*([A-Za-z_$][\w$]*)?""", text):
        out.append(("endpoint", f"{m[1].upper()} {m[2]}", m[3], None, "exact", line(m.start())))
    for m in re.finditer(r"""\bfetch\(\s*['"](/[^'"]*)['"](?:\s*,\s*\{[^}]*method:\s*['"](\w+)['"])?""", text):
        out.append(("request", f"{(m[2] or 'GET').upper()} {m[1]}", None, None, "exact", line(m.start())))
    for m in re.finditer(r"""\bcron\.schedule\(\s*['"]([^'"]*)['"]\s*,\s*([A-Za-z_$][\w$]*)?""", text):
        ok = len(m[1]) <= 128 and re.fullmatch(r"[0-9A-Z*/?,-]+(?: [0-9A-Z*/?,-]+){4,5}", m[1]) and m[2]
        out.append(("schedule" if ok else "unsupported", m[1], m[2] or "task-not-named", None, "exact", line(m.start())))
    return "parsed", sorted(set(out), key=lambda r: (r[5], r[0], r[1] or ""))


def extract(files: DataFrame) -> DataFrame:
    """``(path, status, facts)`` of files ``(path, language, text)``; languages without a parser give an inventory-only row."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(PARSED)
        for batch in batches:
            rows = []
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "text")), strict=True):
                if language == "python":
                    status, facts = python_facts(text or "", path)
                elif language in ("javascript", "jsx", "typescript", "tsx", "svelte"):
                    status, facts = script_facts(text or "")
                else:
                    status, facts = "inventory-only", []
                rows.append({"path": path, "status": status, "facts": [dict(zip(FACT.fieldNames(), f, strict=True)) for f in facts]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "language", "text").mapInArrow(run, PARSED)


def facts(parsed: DataFrame, kind: str | None = None) -> DataFrame:
    rows = parsed.select("path", F.explode("facts").alias("f")).select("path", "f.*")
    return rows if kind is None else rows.where(F.col("fact") == kind)


def framework_route(path: Column) -> Column:
    """Route of a file-system endpoint: ``[x]`` is ``:x``, ``[...x]`` is ``*x``, ``(group)`` folders are left out; null for other files."""
    inner = F.coalesce(F.nullif(F.regexp_extract(path, r"(?:^|/)app/(.*)route\.[jt]sx?$", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"(?:^|/)routes/(.*)\+server\.[jt]s$", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"(?:^|/)pages/(api/.*)\.[jt]s$", 1), F.lit("")))
    parts = F.filter(F.split(inner, "/"), lambda p: (p != "") & ~p.rlike(r"^\(.*\)$") & (p != "index"))
    named = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\[\.\.\.(.+)\]$", "*$1"), r"^\[(.+)\]$", ":$1"))
    return F.when(inner.isNotNull(), F.concat(F.lit("/"), F.array_join(named, "/")))


def convention_tokens(html: Column, stop: tuple[str, ...] = GENERIC, most: int = 80) -> Column:
    """Tokens ``kind:value`` of class, id and data attributes, values of 3 to 120 characters and not generic; sorted, the first ``most``."""

    def of(kind: str, name: str) -> Column:
        values = F.regexp_extract_all(html, F.lit(rf"""(?i)\b(?:{name})\s*=\s*["']([^"']*)["']"""), 1)
        words = F.flatten(F.transform(values, lambda v: F.split(v, r"\s+")))
        kept = F.filter(words, lambda w: F.length(w).between(3, 120) & ~F.lower(w).isin(*stop))
        return F.transform(kept, lambda w: F.concat(F.lit(f"{kind}:"), w))

    every = F.concat(of("class", "class"), of("id", "id"), of("data", r"data-[\w-]+"))
    return F.slice(F.array_sort(F.array_distinct(every)), 1, most)


def package_scripts(manifests: DataFrame) -> DataFrame:
    """``(path, script, runner, target, status)`` of the scripts of package manifests ``(path, text)``; only ``runner target`` is taken."""
    scripts = F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")
    rows = manifests.select("path", F.explode(scripts).alias("script", "command"))
    words = F.split(F.trim("command"), r"\s+")
    status = (
        F.when(F.trim("command") == "", "script-is-not-a-nonempty-string")
        .when(F.trim("command").rlike(r"""[|&;<>$`"'\\\r\n]"""), "shell-syntax-or-quoting")
        .when(F.size(words) != 2, "not-a-direct-runner-and-source-target")
        .when(~F.element_at(words, 1).isin(*RUNNERS), "unsupported-direct-runner")
        .when(F.element_at(words, 2).startswith("-"), "missing-literal-source-target")
        .when(F.element_at(words, 2).rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)"), "target-outside-repository")
        .otherwise("supported")
    )
    return rows.select("path", "script", F.element_at(words, 1).alias("runner"), F.try_element_at(words, F.lit(2)).alias("target"), status.alias("status"))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
