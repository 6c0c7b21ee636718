"""Entities, calls, routes, manifests and infrastructure found in source texts."""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import canonical_route, stable_id
from quarry.operators.model import extension, language_of
from quarry.operators.relational import is_test_file

# --- entities -------------------------------------------------------------------------------------------

_ID = r"[A-Za-z_$][\w$]*"
_NO_NAME = r"(?:if|for|while|switch|catch|foreach|lock|using|fixed|synchronized|return|new|else|do|try|when|base|this|super)\b"
#: Per language: (pattern with the name as group ``name``, kind, or None where group ``kind`` says it).
_DECLARATIONS: dict[str, list[tuple[re.Pattern, str | None]]] = {
    "rust": [(re.compile(rf"^[ \t]*(?P<pub>pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|default|extern(?:\s+\"\w+\")?)\s+)*fn\s+(?P<name>{_ID})", re.M), "function"), (re.compile(rf"^[ \t]*(?P<pub>pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>{_ID})", re.M), "struct")],
    "go": [(re.compile(rf"^func\s+\([^)]*\)\s*(?P<name>{_ID})", re.M), "method"), (re.compile(rf"^func\s+(?P<name>{_ID})", re.M), "function"), (re.compile(rf"^type\s+(?P<name>{_ID})\s+(?P<kind>struct|interface)\b", re.M), None)],
    "javascript": [(re.compile(rf"^[ \t]*(?P<pub>export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})", re.M), "function"), (re.compile(rf"^[ \t]*(?P<pub>export\s+(?:default\s+)?)?class\s+(?P<name>{_ID})", re.M), "class"), (re.compile(rf"^[ \t]+(?:(?:static|async|get|set|public|private|protected|override|readonly)\s+)*(?!(?:if|for|while|switch|catch|function|return)\b)(?P<name>{_ID})\s*(?:<[^>\n]*>)?\([^;{{}}\n]*\)\s*(?::[^;{{}}\n]+)?\{{", re.M), "method")],
    "c": [(re.compile(rf"^(?!(?:if|for|while|switch|return|else|typedef|#))(?:[A-Za-z_][\w]*[ \t*]+)+(?P<name>{_ID})\s*\([^;{{}}]*\)\s*\{{", re.M), "function"), (re.compile(rf"^[ \t]*(?:typedef\s+)?(?P<kind>struct|enum)\s+(?P<name>{_ID})\s*\{{", re.M), None)],
    "java": [(re.compile(rf"^[ \t]*(?:(?P<pub>public)|(?:private|protected|static|final|abstract|sealed)|\s)*\b(?P<kind>class|interface|enum|struct|record)\s+(?P<name>{_ID})", re.M), None), (re.compile(rf"^[ \t]+(?P<pub>public\s+)?(?:(?:private|protected|internal|static|final|abstract|synchronized|override|virtual|async|sealed)\s+)*(?:(?!(?:return|new|throw|else|await|yield)\b)[\w<>\[\],.?]++\s++)*?(?!{_NO_NAME})(?P<name>{_ID}+)\s*\([^;{{}}()]*+\)\s*+(?:throws [\w., ]+)?\{{", re.M), "method")],
    "php": [(re.compile(rf"^[ \t]*(?:abstract\s+|final\s+)?(?P<kind>class|interface|trait|enum)\s+(?P<name>{_ID})", re.M), None), (re.compile(rf"^[ \t]+(?:(?P<pub>public)\s+|(?:private|protected|static|final|abstract)\s+)+function\s+&?(?P<name>{_ID})", re.M), "method"), (re.compile(rf"^function\s+&?(?P<name>{_ID})", re.M), "function")],
}
_DECLARATIONS["typescript"] = [*_DECLARATIONS["javascript"], (re.compile(rf"^[ \t]*(?P<pub>export\s+)?(?:declare\s+)?(?:const\s+)?(?P<kind>interface|enum|type)\s+(?P<name>{_ID})", re.M), None)]
_DECLARATIONS["cpp"] = [(re.compile(rf"^(?!(?:if|for|while|switch|return|else|typedef|#))(?:[A-Za-z_][\w:<>,]*[ \t*&]+)+(?P<name>(?:{_ID}::)*~?{_ID})\s*\([^;{{}}]*\)[^;{{}}()]*\{{", re.M), "function"), (re.compile(rf"^[ \t]*(?P<kind>class|struct|enum)\s+(?:class\s+)?(?P<name>{_ID})[^;{{}}()]*\{{", re.M), None)]
_DECLARATIONS["csharp"] = _DECLARATIONS["java"]
_BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)


#: A line so long holds packed code; there a declaration is a keyword and a name, or a name with its parameters and a brace.
_LONG_LINE = re.compile(r"[^\n]{2000,}")
_ROUND = r"\((?:[^;{}()]++|\((?:[^;{}()]++|\([^;{}()]*+\))*+\))*+\)"
_PACKED = re.compile(rf"(?<![\w$.])(?P<pub>(?:export|public|pub)\s+(?:default\s+)?)?(?:(?:async|static|abstract|final)\s+)*(?:(?P<kind>function|fn|func|class|interface|struct|enum|trait|record)\b\s*\*?\s*(?P<name>{_ID}+)|(?<![\w$] )(?!(?:if|for|while|switch|return|else|catch|foreach|match|new|throw|await|do|using|lock|function|with|synchronized)\b)(?P<bare>{_ID}+)\s*{_ROUND}\s*(?=\{{))")
_PACKED_KINDS = {"fn": "function", "func": "function"}


def _block_ends(code: str) -> dict[int, int]:
    """The place after the closing brace of each opening brace; in one pass."""
    ends, opened = {}, []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def _block_end(code: str, at: int, ends: dict[int, int]) -> int:
    """The end of the declaration that begins at ``at``: its closing brace, or its semicolon if it has no body."""
    m = re.compile(r"[{};]").search(code, at)
    if not m:
        return len(code)
    return ends.get(m.start(), len(code)) if m.group() == "{" else m.end()


def _line_numbers(code: str, places: list[int]) -> dict[int, int]:
    """The line of each place, in one pass."""
    out, line, done = {}, 1, 0
    for place in sorted(set(places)):
        line, done = line + code.count("\n", done, place), place
        out[place] = line
    return out


_PY_TEXT = re.compile(r"#[^\n]*|\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_PY_DECLARATION = re.compile(r"[ \t]*(?:(?P<def>(?:async[ \t]+)?def)|class)[ \t]+(?P<name>[^\W\d]\w*)[ \t]*(?=[(:\[\\]|$)")


def _by_indentation(source: str) -> list[tuple[str, str, int, int, bool, str]]:
    """As ``entities`` for Python that does not parse: a declaration lasts while lines are indented deeper than its own."""
    inside: set[int] = set()

    def blanked(m: re.Match) -> str:
        if m.group()[0] == "#":
            return " " * len(m.group())
        first = source.count("\n", 0, m.start())
        inside.update(range(first + 1, first + m.group().count("\n") + 1))
        return re.sub(r"[^\n]", "_", m.group())

    code, lines = _PY_TEXT.sub(blanked, source).split("\n"), source.split("\n")
    indent = [len(line.expandtabs()) - len(line.expandtabs().lstrip()) if line.strip() else None for line in code]
    found, opened = [], []  # opened: (indent, kind, name, first line, line that ends the signature)

    def close(least: int, at: int, last: int) -> None:
        while opened and opened[-1][0] >= least and at > opened[-1][4]:
            _, kind, name, first, signature = opened.pop()
            end = max(signature, min(last, at - 1))
            found.append((kind, name, first + 1, end + 1, True, "\n".join(lines[first : end + 1])))

    last = 0
    for k, line in enumerate(code):
        if indent[k] is None or k in inside:
            last = k if k in inside else last
            continue
        close(indent[k], k, last)
        m = _PY_DECLARATION.match(line)
        if m:
            # The signature goes on until its brackets close; one that never does is taken for its first line.
            signature, depth = k, 0
            for j in range(k, len(code)):
                depth += sum(map(code[j].count, "([{")) - sum(map(code[j].count, ")]}"))
                if j > k and _PY_DECLARATION.match(code[j]):
                    break
                if depth <= 0:
                    signature = j
                    break
            opened.append((indent[k], "function" if m["def"] else "class", m["name"], k, signature))
        last = k
    close(0, len(code) + 1, last)
    return sorted(found, key=lambda e: (e[2], e[1]))


def entities(source: str, language: str) -> list[tuple[str, str, int, int, bool, str]]:
    """(kind, name, start line, end line, exported, text) of the declarations of a source."""
    if language == "python":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return _by_indentation(source)
        lines, found = source.splitlines(keepends=True), []
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                found.append((kind, node.name, node.lineno, node.end_lineno, True, "".join(lines[node.lineno - 1 : node.end_lineno])))
        return sorted(found, key=lambda e: (e[2], e[1]))
    code = _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)
    # On very long lines the line patterns would be tried at every place; there declarations are sought by their words.
    shown = _LONG_LINE.sub(lambda m: " " * len(m.group()), code)
    matches = [(m, kind) for pattern, kind in _DECLARATIONS.get(language, ()) for m in pattern.finditer(shown)]
    matches += [(m, None) for line in _LONG_LINE.finditer(code) for m in _PACKED.finditer(code, line.start(), line.end()) if m["kind"] or language not in ("rust", "go", "php")]
    found = []
    ends = _block_ends(code) if matches else {}
    for m, kind in matches:
        groups = m.groupdict()
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        end = _block_end(code, start, ends)
        name = groups["name"] or groups.get("bare")
        kind = kind or _PACKED_KINDS.get(groups["kind"], groups["kind"]) or ("function" if language in ("c", "cpp") else "method")
        exported = {"rust": True, "go": name[:1].isupper(), "c": True, "cpp": True}.get(language, bool(groups.get("pub")))
        found.append((kind, name, start, end, exported))
    lines = _line_numbers(code, [p for _, _, start, end, _ in found for p in (start, end - 1)])
    found = [(kind, name, lines[start], lines[end - 1], exported, source[start:end]) for kind, name, start, end, exported in found]
    return sorted(set(found), key=lambda e: (e[2], e[1]))


def extract_nodes(files: DataFrame) -> DataFrame:
    """Node rows of files (project_id, file_path, source): one of kind ``file`` each and one for every declaration.

    Complexity is the span in lines; ids are stable hashes of the natural key, so a second run gives the same.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for project, path, language, source in zip(*(batch[c].to_pylist() for c in ("project_id", "file_path", "language", "source")), strict=True):
                listed = entities(source, language)
                last = max([e[3] for e in listed], default=source.count("\n") + 1)
                rows.append((project, path, "file", path.rsplit("/", 1)[-1], path, 1, last, None, False, source))
                rows += [(project, path, kind, name, name, start, end, end - start + 1, exported, text) for kind, name, start, end, exported, text in listed]
            columns = list(zip(*rows, strict=True)) or [()] * 10
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["project_id", "file_path", "kind", "name", "qualified_name", "start_line", "end_line", "complexity", "is_exported", "source"])

    known = files.withColumn("language", language_of(F.col("file_path"))).where("language is not null and source is not null").select("project_id", "file_path", "language", "source")
    rows = known.mapInArrow(found, "project_id long, file_path string, kind string, name string, qualified_name string, start_line long, end_line long, complexity long, is_exported boolean, source string")
    key = [F.col(c) for c in ("project_id", "file_path", "kind", "qualified_name", "start_line")]
    return rows.select(stable_id(*key).alias("id"), "*", F.lpad(F.lower(F.hex(F.xxhash64("source"))), 16, "0").alias("content_hash"))


def contains_edges(nodes: DataFrame) -> DataFrame:
    """``contains`` edges from each file node to the other nodes of its file; routes, libraries and images hang on other edges."""
    files = nodes.where("kind = 'file'").select("project_id", "file_path", F.col("id").alias("source_node_id"))
    inner = nodes.where("kind not in ('file', 'route', 'library', 'docker_image')").select("project_id", "file_path", F.col("id").alias("target_node_id"))
    return files.join(inner, ["project_id", "file_path"]).select("project_id", "source_node_id", "target_node_id", F.lit("contains").alias("kind"))


# --- calls ------------------------------------------------------------------------------------------------

# Names before a parenthesis that are no calls of project functions.
NO_CALLS = ("if while for switch catch match return let fn function impl struct class interface using import super this self assert println print expect unwrap panic log debug info warn error").split()


def call_names(source: Column) -> Column:
    """The distinct (name, is_method) of the calls in a text."""
    found = F.transform(F.regexp_extract_all(source, F.lit(r"((?:\.\s*)?\b[A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda c: F.struct(F.regexp_replace(c, r"^\.\s*", "").alias("name"), c.startswith(".").alias("is_method")))
    return F.array_distinct(F.filter(found, lambda c: ~c["name"].isin(NO_CALLS)))


def resolve_calls(nodes: DataFrame) -> DataFrame:
    """``calls`` edges by name: in the same file, else in the same folder and language, else if exported and unique in the project.

    A method call is looked up among the methods of its file only. Three equi-joins; no edge to itself.
    """
    callable_nodes = nodes.where(F.col("kind").isin("function", "method"))
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    calls = callable_nodes.where("source is not null").select("project_id", F.col("id").alias("source_node_id"), "file_path", folder.alias("folder"), extension(F.col("file_path")).alias("ext"), F.explode(call_names(F.col("source"))).alias("c")).select("project_id", "source_node_id", "file_path", "folder", "ext", F.col("c.name").alias("called"), F.col("c.is_method").alias("is_method"))
    names = callable_nodes.where("name is not null").select("project_id", "id", "file_path", folder.alias("folder"), extension(F.col("file_path")).alias("ext"), F.col("name").alias("called"), "kind", "is_exported")
    order = F.struct((F.col("kind") != "function").alias("method"), F.col("id"))
    in_file = names.groupBy("project_id", "file_path", "called").agg(F.min(order)["id"].alias("t_file"), F.min(F.when(F.col("kind") == "method", F.col("id"))).alias("t_method"))
    in_folder = names.groupBy("project_id", "folder", "ext", "called").agg(F.min(order)["id"].alias("t_folder"))
    alone = names.groupBy("project_id", "called").agg(F.min(F.when(F.col("is_exported"), F.col("id"))).alias("t_project"), F.count("*").alias("n")).where("n = 1").drop("n")
    joined = calls.join(in_file, ["project_id", "file_path", "called"], "left").join(in_folder, ["project_id", "folder", "ext", "called"], "left").join(alone, ["project_id", "called"], "left")
    target = F.when(F.col("is_method"), F.col("t_method")).otherwise(F.coalesce("t_file", "t_folder", "t_project"))
    return joined.select("project_id", "source_node_id", target.alias("target_node_id"), F.lit("calls").alias("kind")).where("target_node_id is not null and source_node_id <> target_node_id").distinct()


# --- routes -----------------------------------------------------------------------------------------------

_QUOTED = r"""['"`]([^'"`\s?#]+)['"`]"""
_VERB = r"(get|post|put|delete|patch|head|options)"
#: How frameworks register routes, by their documentation: (pattern, group of the verb or None, group of the path, fixed verb).
ROUTE_PATTERNS = (
    # Express, Koa, Fastify, Flask 2, FastAPI: a verb as the method of an application, router or blueprint; as a call or a decorator.
    (rf"\b(?:app|router|route|api|server|blueprint|bp)\.{_VERB}\s*\(\s*{_QUOTED}", 1, 2, None),
    # Flask: @app.route("/path"); the verbs stand in another argument, GET by default.
    (rf"@(?:app|router|api|blueprint|bp)\.route\s*\(\s*{_QUOTED}", None, 1, "ROUTE"),
    # Gin, Echo, Chi: verbs in capitals; net/http: Handle and HandleFunc.
    (rf"\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*\(\s*{_QUOTED}", 1, 2, None),
    (rf"\.(Handle|HandleFunc)\s*\(\s*{_QUOTED}", None, 2, "ANY"),
    # Axum: .route("/path", get(handler)).
    (rf"\.route\s*\(\s*{_QUOTED}\s*,\s*(?:\w+::)*{_VERB}\s*\(", 2, 1, None),
    # Spring: @GetMapping("/path"), @RequestMapping(value = "/path").
    (rf"@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?{_QUOTED}", 1, 2, None),
    (rf"@RequestMapping\s*\(\s*(?:(?:value|path)\s*=\s*)?{_QUOTED}", None, 1, "ANY"),
)


def extract_routes(files: DataFrame) -> DataFrame:
    """(project_id, file_path, method, path, name, qualified_name) of the routes registered in files."""
    def hits(pattern: str, verb: int | None, path: int, fixed: str | None) -> Column:
        paths = F.regexp_extract_all("source", F.lit(pattern), F.lit(path))
        if verb is None:
            return F.transform(paths, lambda p: F.struct(F.lit(fixed).alias("method"), p.alias("path")))
        both = F.arrays_zip(F.regexp_extract_all("source", F.lit(pattern), F.lit(verb)).alias("m"), paths.alias("p"))
        return F.transform(both, lambda z: F.struct(F.upper(z["m"]).alias("method"), z["p"].alias("path")))

    found = F.flatten(F.array(*[hits(*p) for p in ROUTE_PATTERNS]))
    rows = files.where("source is not null").select("project_id", "file_path", F.explode(found).alias("r")).select("project_id", "file_path", "r.method", canonical_route(F.col("r.path")).alias("path")).distinct()
    return rows.withColumn("name", F.concat_ws(" ", "method", "path")).withColumn("qualified_name", F.concat(F.lit("__route__"), F.col("method"), F.lit("__"), F.col("path")))


# --- manifests and infrastructure ----------------------------------------------------------------------------

MANIFESTS = r"(^|/)(package\.json|Cargo\.toml|go\.mod|requirements\.txt|pyproject\.toml)$"
INFRA = r"(?i)((^|/)Dockerfile[^/]*|\.ya?ml)$"


def _version(value: object) -> str:
    return value if isinstance(value, str) else str(value.get("version", "*")) if isinstance(value, dict) else "*"


def manifest(path: str, source: str) -> tuple[str | None, list[tuple[str, str]]]:
    """(package name, its dependencies as (name, version)) of a manifest; (None, []) if it cannot be read."""
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    try:
        if base == "package.json":
            data = json.loads(source)
            return data.get("name"), sorted({**(data.get("dependencies") or {}), **(data.get("devDependencies") or {})}.items())
        if base == "Cargo.toml":
            data = tomllib.loads(source)
            every = {**data.get("dependencies", {}), **data.get("dev-dependencies", {})}
            return data.get("package", {}).get("name"), sorted((n, _version(v)) for n, v in every.items())
        if base == "pyproject.toml":
            data = tomllib.loads(source)
            project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
            listed = [re.match(r"\s*([\w.-]+)(?:\[[^\]]*\])?\s*(.*)", d).groups() for d in project.get("dependencies", [])]
            return project.get("name") or poetry.get("name"), sorted({*((n, v.strip() or "*") for n, v in listed), *((n, _version(v)) for n, v in poetry.get("dependencies", {}).items())})
        if base == "go.mod":
            name = re.search(r"^module\s+(\S+)", source, re.M)
            block = "\n".join(re.findall(r"^require\s*\((.*?)\)", source, re.M | re.S)) + "\n" + "\n".join(re.findall(r"^require\s+([^(\s].*)$", source, re.M))
            return name and name.group(1), sorted(set(re.findall(r"^\s*([\w./-]+)\s+(v\S+)", block, re.M)))
        if base == "requirements.txt":
            return None, sorted({(m.group(1), m.group(2).strip() or "*") for line in source.splitlines() if (m := re.match(r"\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*([^#;]*)", line)) and not line.strip().startswith(("#", "-"))})
    except (ValueError, AttributeError, TypeError):
        pass
    return None, []


def infrastructure(path: str, source: str) -> list[tuple[str, str, str, str | None]]:
    """(kind, name, JSON of the rest, owner) of what a Dockerfile or a Kubernetes document declares; an image's owner is what uses it."""
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    if base.lower().startswith("dockerfile"):
        images = re.findall(r"^\s*FROM\s+(?:--\S+\s+)*(\S+)", source, re.M | re.I)
        ports = [p for line in re.findall(r"^\s*EXPOSE\s+(.+)$", source, re.M | re.I) for p in line.split()]
        out = [("dockerfile", base, json.dumps({"base_image": images[-1] if images else None, "exposed_ports": ports}), None)]
        return out + [("docker_image", images[-1], "{}", f"__dockerfile__{base}")] if images else out
    import yaml

    out = []
    for part in re.split(r"^---.*$", source, flags=re.M):
        try:
            data = yaml.safe_load(part)
        except yaml.YAMLError:
            continue
        if not isinstance(data, dict) or "apiVersion" not in data or "kind" not in data:
            continue
        images: list[str] = []

        def collect(value: object, images: list[str] = images) -> None:
            if isinstance(value, dict):
                images += [v for k, v in value.items() if k == "image" and isinstance(v, str)]
                for v in value.values():
                    collect(v)
            elif isinstance(value, list):
                for v in value:
                    collect(v)

        collect(data)
        meta = data.get("metadata")
        name = str((meta if isinstance(meta, dict) else {}).get("name") or "unnamed")
        out.append(("k8s_resource", f"{data['kind']}/{name}", json.dumps({"apiVersion": data["apiVersion"], "resource_kind": data["kind"], "resource_name": name, "container_images": images}), None))
        out += [("docker_image", image, "{}", f"__k8s_resource__{data['kind']}/{name}") for image in dict.fromkeys(images)]
    return out


def extract_declared(files: DataFrame) -> DataFrame:
    """(project_id, file_path, kind, name, metadata, owner) of manifests, libraries, Dockerfiles, images and Kubernetes resources."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for project, path, source in zip(*(batch[c].to_pylist() for c in ("project_id", "file_path", "source")), strict=True):
                if re.search(MANIFESTS, path):
                    name, needs = manifest(path, source)
                    title = name or path.rsplit("/", 1)[-1]
                    rows.append((project, path, "manifest", title, json.dumps({"package_name": name, "dependencies_count": len(needs)}), None))
                    rows += [(project, path, "library", n, json.dumps({"version": v}), f"__manifest__{title}") for n, v in needs]
                else:
                    rows += [(project, path, *x) for x in infrastructure(path, source)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 5), strict=True)], ["project_id", "file_path", "kind", "name", "metadata", "owner"])

    wanted = files.where(F.col("source").isNotNull() & (F.col("file_path").rlike(MANIFESTS) | F.col("file_path").rlike(INFRA))).select("project_id", "file_path", "source")
    return wanted.mapInArrow(found, "project_id long, file_path string, kind string, name string, metadata string, owner string")


def declared_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of routes, manifests and infrastructure: their nodes, file nodes where extraction made none, and the edges between them.

    A file ``handles`` its routes and ``contains`` its manifest, Dockerfile and resources; a manifest ``depends_on`` its
    libraries, a Dockerfile is ``derived_from`` its image and a resource ``deploys_image`` its images.
    """
    routes = extract_routes(files).select("project_id", "file_path", F.lit("route").alias("kind"), "name", "qualified_name", F.to_json(F.struct("method", "path")).alias("metadata"), F.lit("file").alias("owner_kind"), F.lit(None).cast("string").alias("owner"), F.lit("handles").alias("edge"))
    listed = extract_declared(files)
    own = F.concat(F.lit("__"), F.col("kind"), F.lit("__"), F.col("name"))
    owner_kind = F.when(F.col("owner").isNull(), "file").when(F.col("kind") == "library", "manifest").when(F.col("owner").startswith("__dockerfile__"), "dockerfile").otherwise("k8s_resource")
    edge = F.when(F.col("owner").isNull(), "contains").when(F.col("kind") == "library", "depends_on").when(F.col("owner").startswith("__dockerfile__"), "derived_from").otherwise("deploys_image")
    declared = listed.select("project_id", "file_path", "kind", "name", own.alias("qualified_name"), "metadata", owner_kind.alias("owner_kind"), "owner", edge.alias("edge"))
    rows = routes.unionByName(declared).distinct()
    identity = lambda kind, name: stable_id(F.col("project_id"), F.col("file_path"), kind, name, F.lit(1))
    base = F.element_at(F.split("file_path", "/"), -1)
    blank = {"start_line": F.lit(1).cast("long"), "end_line": F.lit(1).cast("long"), "is_exported": F.lit(True)}
    nodes = rows.groupBy("project_id", "file_path", "kind", "name", "qualified_name").agg(F.min("metadata").alias("metadata"))
    nodes = nodes.select(identity(F.col("kind"), F.col("qualified_name")).alias("id"), "*", *[v.alias(k) for k, v in blank.items()])
    bare = files.where(F.col("source").isNotNull() & language_of(F.col("file_path")).isNull()).select("project_id", "file_path", "source").distinct()
    plain = bare.select(identity(F.lit("file"), F.col("file_path")).alias("id"), "project_id", "file_path", F.lit("file").alias("kind"), base.alias("name"), F.col("file_path").alias("qualified_name"), F.lit(None).cast("string").alias("metadata"), F.lit(1).cast("long").alias("start_line"), (F.length("source") - F.length(F.replace("source", F.lit("\n"))) + 1).cast("long").alias("end_line"), F.lit(False).alias("is_exported"))
    edges = rows.select("project_id", identity(F.col("owner_kind"), F.coalesce("owner", "file_path")).alias("source_node_id"), identity(F.col("kind"), F.col("qualified_name")).alias("target_node_id"), F.col("edge").alias("kind")).distinct()
    return nodes.unionByName(plain.select(*nodes.columns)), edges


# --- tests ------------------------------------------------------------------------------------------------

def test_contracts(nodes: DataFrame) -> DataFrame:
    """``test_of`` edges from test functions of test files to the symbols their names speak of, by name within a project."""
    tests = nodes.where(is_test_file(F.col("file_path")) & F.col("kind").isin("function", "method")).select("project_id", F.col("id").alias("source_node_id"), "name")
    speaks = F.array_distinct(F.array_compact(F.array(F.when(F.col("name").startswith("test_"), F.expr("substring(name, 6)")), F.when(F.col("name").rlike("^Test[A-Z]"), F.expr("substring(name, 5)")))))
    named = tests.select("project_id", "source_node_id", F.explode(speaks).alias("name"))
    targets = nodes.where(~F.col("kind").isin("file", "test_contract")).select("project_id", "name", F.col("id").alias("target_node_id"))
    return named.join(targets, ["project_id", "name"]).where("source_node_id <> target_node_id").select("project_id", "source_node_id", "target_node_id", F.lit("test_of").alias("kind")).distinct()


# --- refresh ----------------------------------------------------------------------------------------------

def state_diff(stored: DataFrame, current: DataFrame, key: tuple[str, ...] = ("project_id", "file_path")) -> DataFrame:
    """(*key, status): ``new``, ``changed``, ``same`` or ``deleted`` by content hash between two states of files."""
    a, b = stored.select(*key, F.col("content_hash").alias("was"), F.lit(True).alias("_a")), current.select(*key, F.col("content_hash").alias("now"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return a.join(b, list(key), "full").select(*key, status.alias("status"))


def semantic_diff(old: DataFrame, new: DataFrame, least: int = 5) -> DataFrame:
    """(project_id, file_path, name, change, delta): symbols removed, introduced, or whose complexity moved by more than ``least``."""
    key = ["project_id", "file_path", "name"]
    side = lambda rows, c: rows.where("kind <> 'file' and name is not null").groupBy(*key).agg(F.max(F.coalesce("complexity", F.lit(0))).alias(c))
    both = side(old, "was").join(side(new, "now"), key, "full")
    change = F.when(F.col("was").isNull(), "introduced").when(F.col("now").isNull(), "removed").when(F.abs(F.col("now") - F.col("was")) > least, "complexity")
    return both.select(*key, change.alias("change"), (F.col("now") - F.col("was")).alias("delta")).where("change is not null")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
