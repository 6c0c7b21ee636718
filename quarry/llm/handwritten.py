"""Generated, minified and vendored source files, and data stored as code.

Three sources of evidence, from the most to the least explicit:

1. Attribute files of a repository (``linguist-generated`` and ``linguist-vendored``, each set, unset or
   unspecified on its own). Patterns are globs of the attribute file's directory; a deeper file wins over a
   shallower one and a later line over an earlier one. What is set or unset decides.
2. The file itself: a mark in its leading comment, lines no one types, or a text that is almost
   wholly literals.
3. Patterns equivalent to declarations. An attribute text of public conventions (``CONVENTIONS``) holds below
   the root of every project where its own files do not say otherwise. Further patterns are mined from the
   corpus: directory names and file suffixes under which nearly every file of several projects has evidence 1
   or 2, and phrases of leading comments whose files lie at declared or conventional paths about as often as
   files that evidence 2 marks do, which ordinary files seldom do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.tables import slashed

# Directory names and base names that repositories declare vendored or generated.
VENDORED_DIRS = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "godeps", "external", "externals", "extern", "deps", "pods", "carthage", ".bundle", "web_modules")
GENERATED_DIRS = ("generated", "__generated__", "autogen", "auto_generated", "gen", "dist", "generated-sources", "generated_sources")
GENERATED_NAMES = (
    "*[._-]min.js", "*[._-]min.css", "*[._-]min.mjs", "*[._-]min.cjs", "*[._]bundle.js", "*[._]bundle.mjs", "*[._]pb.[a-z]*", "*[._]pb2.[a-z]*", "*[._]pb_grpc.[a-z]*", "*[._]pb2_grpc.[a-z]*",
    "*[._]gen.[a-z]*", "*[._]generated.[a-z]*", "*.g.cs", "*.g.dart", "*.designer.cs", "*.designer.vb", "*.tab.[chp]*", "*.yy.[chp]*", "*[._]moc.[a-z]*", "zz_generated*.[a-z]*",
    "moc_*.cpp", "moc_*.cc", "moc_*.cxx", "moc_*.h", "ui_*.cpp", "ui_*.cc", "ui_*.cxx", "ui_*.h", "qrc_*.cpp", "qrc_*.cc", "qrc_*.cxx", "qrc_*.h", "*Grpc.java",
)
#: The conventions as an attribute file; letter case does not count in it.
CONVENTIONS = "\n".join([f"**/{d}/** linguist-vendored" for d in VENDORED_DIRS] + [f"**/{d}/** linguist-generated" for d in GENERATED_DIRS] + [f"{n} linguist-generated" for n in GENERATED_NAMES])

_GENERATED = re.compile(
    r"""^(
      (this|the)\ (file|code|class|module|source)\ (was|is|has\ been|were)\ (auto|machine)?[a-z]*[-\ ]?generated\b
    | (this\ (file|code)\ (was|is)\ )?auto(matically)?[-\ ]?generated\b (?!\ (ids?|names?|keys?)\b)
    | (code|file|source|sources|stubs?|bindings?)\ (auto-?)?(generated|created)\ (by|from|with)\b
    | generated\ (by|from|with|using|at|on|automatically)\b
    | machine[-\ ]generated\b
    | @generated\b
    | <auto-?generated
    | created\ (with|by)\ \S+\ v?\d+(\.\d+)+
    | (warning[:!]?\ )?do\ not\ (edit|modify|change)(\ this\ file)?(\ by\ hand|\ manually)?\ *([:;.,!]|$|--|-\ |—)
    | automatisch\ (erzeugt|generiert)\b | g[ée]n[ée]r[ée]\ automatiquement\b | fichier\ g[ée]n[ée]r[ée]\b
    | (archivo\ )?generado\ (autom[áa]ticamente|por)\b | (arquivo\ )?gerado\ (automaticamente|por)\b
    | (wygenerowano|wygenerowany)\ (automatycznie|przez)\b | (файл\ )?(автоматически\ )?(создан|сгенерирован)\w*\b | .{0,20}自動生成
    ) | \bgenerated\b.*\bdo\ not\ (edit|modify)\b | \bchanges\ will\ be\ (lost|overwritten)\b""",
    re.I | re.X,
)
_VENDORED = re.compile(
    r"""^(bundled|vendored|imported|verbatim|unmodified)\ copy\b | ^vendored\ (from|in|at)\b | ^imported\ from\ \S+\.(tar|zip|tgz|tar\.\w+)\b
    | ^copied\ (verbatim\ |unmodified\ )?from\ (https?:|\S+\ v?\d)""",
    re.I | re.X,
)
_COMMENT_START = re.compile(r"^\s*(///?!?|#(?!\s*(include|define|if|ifdef|ifndef|endif|pragma|else|undef|region|!\[|\[))|/\*+!?|\*+/?|<!--|--|;+|\"\"\"|''')")
_CODE_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/|(?m:^\s*#[^\n]*)", re.S)
_LITERAL = re.compile(r"""[-+]?\b(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]*\b|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[\[\]{},]""")
_INDEX = re.compile(r"\[(\d+)\]")

LONG_LINE, LONG_SHARE = 300, 0.5
LITERAL_SHARE, LEAST_LITERALS, LEAST_LITERAL_CHARS = 0.8, 24, 400
#: Support a mined path pattern needs, and the share of its files with other evidence.
MINED_FILES, MINED_PROJECTS, MINED_SHARE = 10, 3, 0.97
#: Words of a mined phrase; the share of its files at marked paths, less a standard error, must reach this part of that of files with a certain mark, and be so many times that of all others.
PHRASE_WORDS, ERRORS, OF_CERTAIN, OVER_ORDINARY = 3, 1.0, 0.5, 3.0
#: Files a mined phrase needs, as a part of the certainly marked ones: names of owners are rarer than customary phrases.
PHRASE_SUPPORT = 0.05
_LETTERS = re.compile(r"[^\W\d_]+")


def leading_comment(source: str) -> list[str]:
    """The texts of the comment lines before the first line of code, without comment signs."""
    out, inside = [], False
    for line in source.split("\n"):
        text = line.strip()
        if not text or text in ("<?php", "'use strict';", '"use strict";') or text.startswith("#!"):
            continue
        if inside or _COMMENT_START.match(line):
            if text.startswith("/*") or text.startswith("<!--"):
                inside = True
            if "*/" in text or "-->" in text:
                inside = False
            out.append(re.sub(r"^(///?!?|#+|/\*+!?|\*+/?|<!--|--|;+)\s*|\s*(\*+/|-->)$", "", text).strip())
            continue
        break
    return out


def content_reason(source: str | None) -> str | None:
    """``generated``, ``vendored``, ``minified`` or ``data`` where the text itself shows it."""
    if not source or source.isspace():
        return None
    for text in leading_comment(source):
        if _GENERATED.search(text):
            return "generated"
        if _VENDORED.search(text):
            return "vendored"
    code = _CODE_COMMENT.sub(" ", source)
    total = sum(map(len, code.split()))
    if not total:
        return None
    literals = [m.group() for m in _LITERAL.finditer(code)]
    values = [x for x in literals if x not in "[]{},"]
    chars = sum(len(x) - sum(map(str.isspace, x)) for x in literals)
    if chars >= LITERAL_SHARE * total and len(values) >= LEAST_LITERALS and chars >= LEAST_LITERAL_CHARS:
        return "data"
    if sum(len(line) for line in code.split("\n") if len(line) > LONG_LINE) >= LONG_SHARE * len(code):
        return "minified"
    indexes = [int(x) for x in _INDEX.findall(code)]
    if len(indexes) >= 6 and indexes == list(range(len(indexes))) and sum(map(len, code.split("\n"))) < 160 * len(indexes):
        return "generated"
    return None


def comment_phrases(source: str | None) -> list[str]:
    """The distinct runs of ``PHRASE_WORDS`` words within the lines of a leading comment, in lower case, without digits."""
    found: dict[str, None] = {}
    for line in leading_comment(source or ""):
        words = _LETTERS.findall(line.lower())
        found.update(dict.fromkeys(" ".join(words[k : k + PHRASE_WORDS]) for k in range(len(words) - PHRASE_WORDS + 1)))
    return list(found)


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources = batch["source"].to_pylist()
        reasons = pa.array([content_reason(s) for s in sources], pa.string())
        phrases = pa.array([comment_phrases(s) for s in sources], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch["id"], batch["project_id"], batch["path"], reasons, phrases], ["id", "project_id", "path", "content", "phrases"])


def below_root(path: Column, root: Column) -> Column:
    """``path`` with ``/`` separators and without the project's root, whatever the letter case of a drive."""
    clean, base = slashed(path), F.rtrim(slashed(F.coalesce(root, F.lit(""))), F.lit("/"))
    inside = (F.length(base) > 0) & F.lower(clean).startswith(F.concat(F.lower(base), F.lit("/")))
    return F.ltrim(F.when(inside, F.substring(clean, F.length(base) + 2, F.length(clean))).otherwise(clean), F.lit("/"))


# --- attribute files -----------------------------------------------------------------------------------

def glob_to_regex(pattern: str) -> tuple[str, bool]:
    """(regular expression, whether it is held against the base name only) of one attribute glob."""
    anchored = "/" in pattern.rstrip("/")
    body, out, k = pattern.strip("/"), "", 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        elif body[k] == "[" and "]" in body[k + 1 :]:
            end = body.index("]", k + 1)
            inner = body[k + 1 : end]
            out, k = out + "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, k = out + re.escape(body[k]), k + 1
    return f"^{out}$", not anchored


_PATTERN = re.compile(r'"((?:[^"\\]|\\.)*)"\s+(.*)|(\S+)\s+(.*)')


def _rule_key(pattern: str) -> str:
    """What a path must have for the pattern to be tried on it: its first folder, base name or extension, or nothing."""
    if "/" in pattern.strip("/") or pattern.startswith("/"):
        first, _, rest = pattern.strip("/").partition("/")
        if re.search(r"[*?\[\\]", first):
            return "any"
        return f"dir:{first}" if rest else f"name:{first}"
    ending = re.fullmatch(r"[*][^*?\[\\]*\.([^*?\[\\./]+)", pattern)
    return f"ext:{ending.group(1)}" if ending else "any" if re.search(r"[*?\[\\]", pattern) else f"name:{pattern}"


def attribute_rules(source: str | None) -> list[tuple[int, str, str, bool, str, bool | None]]:
    """(line number, key, regular expression, base name only, attribute, state) of the lines that speak of the two attributes.

    The state is true where the attribute is set, false where it is unset or a false value, None where it is unspecified
    (``!``). Patterns may be quoted. A negative pattern, or one that ends in a slash, matches nothing in attribute files.
    """
    rules = []
    for number, line in enumerate((source or "").splitlines()):
        found = _PATTERN.match(line.strip())
        if not found or line.lstrip().startswith(("#", "[attr]")):
            continue
        pattern = re.sub(r"\\(.)", r"\1", found.group(1)) if found.group(1) is not None else found.group(3)
        if pattern.endswith("/") or pattern.startswith("!"):
            continue
        regex, base = glob_to_regex(pattern)
        for word in (found.group(2) or found.group(4)).split():
            name, _, value = word.lstrip("-!").partition("=")
            if name in ("linguist-generated", "linguist-vendored"):
                state = None if word[0] == "!" else word[0] != "-" and value.lower() not in ("false", "0", "no")
                rules.append((number, _rule_key(pattern), regex, base, name, state))
    return rules


def conventional(path: Column) -> Column:
    """Whether the public conventions mark a path."""
    held = {False: [], True: []}
    for _, _, regex, base, _, _ in attribute_rules(CONVENTIONS):
        held[base].append(regex)
    name = F.element_at(F.split(path, "/"), -1)
    return path.rlike("(?i)" + "|".join(held[False])) | name.rlike("(?i)" + "|".join(held[True]))


_RULE = (("project_id", "long", pa.int64()), ("folder", "string", pa.string()), ("line", "int", pa.int32()), ("key", "string", pa.string()), ("regex", "string", pa.string()), ("base", "boolean", pa.bool_()), ("attribute", "string", pa.string()), ("state", "boolean", pa.bool_()))


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, f, *rule) for p, f, s in zip(batch["project_id"].to_pylist(), batch["folder"].to_pylist(), batch["source"].to_pylist(), strict=True) for rule in attribute_rules(s)]
        columns = list(zip(*rows, strict=True)) or [()] * len(_RULE)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, _RULE, strict=True)], [n for n, _, _ in _RULE])


def _folders(path: Column) -> Column:
    """Every directory above a path, '' the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def declared(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, declared) of the files an attribute rule of a directory above them speaks of.

    For each of the two attributes the deepest, latest rule decides; ``declared`` is true if one of them is set, false
    if one is unset and none set, null if both are unspecified. A rule is tried only on the paths that have its key.
    """
    rules = attributes.mapInArrow(_rules, ", ".join(f"{n} {t}" for n, t, _ in _RULE))
    above = files.select("id", "project_id", "path", F.explode(_folders(F.col("path"))).alias("folder"))
    rest = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("folder") + 2, F.length("path")))
    above = above.withColumn("_rest", rest).withColumn("_name", F.element_at(F.split("_rest", "/"), -1))
    first = F.when(F.col("_rest").contains("/"), F.concat(F.lit("dir:"), F.element_at(F.split("_rest", "/"), 1)))
    ending = F.when(F.col("_name").contains("."), F.concat(F.lit("ext:"), F.element_at(F.split("_name", r"\."), -1)))
    keyed = above.withColumn("key", F.explode(F.array_compact(F.array(F.lit("any"), F.concat(F.lit("name:"), F.col("_name")), first, ending))))
    held = F.when(F.col("base"), F.col("_name")).otherwise(F.col("_rest"))
    met = keyed.join(rules, ["project_id", "folder", "key"]).withColumn("_held", held).where(F.expr("rlike(_held, regex)"))
    decided = met.groupBy("id", "attribute").agg(F.max_by("state", F.struct(F.length("folder"), "line")).alias("state"))
    return decided.groupBy("id").agg(F.max("state").alias("declared"))


# --- path patterns -------------------------------------------------------------------------------------

def path_patterns(path: Column) -> Column:
    """The directory names of a path (``dir:x``) and the distinguishing end of its base name (``end:x``)."""
    parts = F.split(F.lower(path), "/")
    dirs = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: F.concat(F.lit("dir:"), d))
    end = F.regexp_extract(F.element_at(parts, -1), r"[._]([a-z]+\d?\.[a-z]+)$", 1)
    return F.array_distinct(F.concat(dirs, F.when(end != "", F.array(F.concat(F.lit("end:"), end))).otherwise(F.array().cast("array<string>"))))


def mined_patterns(evidence: DataFrame) -> DataFrame:
    """(pattern) of the directory names and ends under which nearly every file of several projects has evidence."""
    spread = evidence.select("project_id", F.explode(path_patterns(F.col("path"))).alias("pattern"), F.col("marked"))
    counted = spread.groupBy("pattern", "project_id").agg(F.count("*").alias("files"), F.sum(F.col("marked").cast("int")).alias("hits"))
    totals = counted.groupBy("pattern").agg(F.sum("files").alias("files"), F.sum("hits").alias("hits"), F.count("*").alias("projects"))
    return totals.where((F.col("files") >= MINED_FILES) & (F.col("projects") >= MINED_PROJECTS) & (F.col("hits") >= MINED_SHARE * F.col("files"))).select("pattern")


def mined_phrases(evidence: DataFrame) -> DataFrame:
    """(phrase) of the comment phrases whose files lie at marked paths about as often as files with a certain mark do.

    ``evidence`` has (id, project_id, phrases, certain, at_marked_path). Where a path says nothing the file may still not
    be hand-written, so the share is held against that of certainly marked files, not against all. Phrases are tested
    twice: first on all files that have them, then each file speaks only for the most frequent of its phrases that
    passed, so a phrase that merely stands beside a telling one falls away.
    """
    at = F.col("at_marked_path").cast("int")
    shares = evidence.agg(F.avg(F.when(F.col("certain"), at)).alias("of_certain"), F.avg(F.when(~F.col("certain"), at)).alias("of_rest"), F.count_if("certain").alias("certain"))

    def telling(spread: DataFrame) -> DataFrame:
        counted = spread.groupBy("phrase", "project_id").agg(F.count("*").alias("files"), F.sum("hit").alias("hits"))
        totals = counted.groupBy("phrase").agg(F.sum("files").alias("files"), F.sum("hits").alias("hits"), F.count("*").alias("projects"))
        enough = totals.where((F.col("files") >= MINED_FILES) & (F.col("projects") >= MINED_PROJECTS)).join(shares).where(F.col("files") >= PHRASE_SUPPORT * F.col("certain"))
        share = F.col("hits") / F.col("files")
        surely = share - ERRORS * F.sqrt(share * (1 - share) / F.col("files"))
        return enough.where((surely >= OF_CERTAIN * F.col("of_certain")) & (share >= OVER_ORDINARY * F.col("of_rest")) & (F.col("hits") > 0)).select("phrase", "files")

    spread = evidence.select("id", "project_id", at.alias("hit"), F.explode("phrases").alias("phrase"))
    passed = spread.join(telling(spread), "phrase").groupBy("id", "project_id", "hit").agg(F.max(F.struct("files", "phrase"))["phrase"].alias("phrase"))
    return telling(passed).select("phrase")


def not_handwritten(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, reason) of the file rows whose file no one wrote by hand in the project.

    ``reason`` is ``declared``, ``generated``, ``vendored``, ``minified``, ``data``, ``convention``, ``mined path`` or
    ``mined comment``. Exact duplicate rows count once; a null path is judged by content, a null or empty source by
    path; a file without a known project has no root. Names compare whole: ``vendors`` is not ``vendor``.
    """
    from quarry.session import stored

    roots = projects.groupBy(F.col("id").alias("project_id")).agg(F.max("root_path").alias("root_path"))
    rows = nodes.where("kind = 'file' and id is not null").select(F.col("id").cast("long").alias("id"), F.col("project_id").cast("long").alias("project_id"), "file_path", "source")
    path = F.coalesce(below_root(F.col("file_path"), F.col("root_path")), F.lit(""))
    files = rows.join(roots, "project_id", "left").select("id", "project_id", path.alias("path"), "source")
    judged = stored(files.mapInArrow(_content, "id long, project_id long, path string, content string, phrases array<string>").distinct())
    attributes = files.where(F.col("path").rlike(r"(^|/)\.gitattributes$")).select("project_id", F.regexp_replace("path", r"/?\.gitattributes$", "").alias("folder"), "source").distinct()
    known = judged.join(declared(judged.select("id", "project_id", "path"), attributes), "id", "left").withColumn("listed", conventional(F.col("path")))
    first = known.withColumn("marked", F.coalesce("declared", F.col("content").isNotNull()))
    open_rows = first.where("declared is null and content is null and not listed")
    # What repositories with attribute files declare is told by these alone; the others have nothing that could contradict.
    declaring = first.join(attributes.select("project_id").distinct(), "project_id", "left_semi")
    patterns = mined_patterns(first).unionByName(mined_patterns(declaring))
    paths = open_rows.select("id", F.explode(path_patterns(F.col("path"))).alias("pattern")).join(patterns, "pattern", "left_semi").select("id").distinct().withColumn("by_path", F.lit("mined path"))
    told = first.where("declared is null or declared").select("id", "project_id", "phrases", F.col("content").isNotNull().alias("certain"), F.coalesce("declared", "listed").alias("at_marked_path"))
    comments = open_rows.select("id", F.explode("phrases").alias("phrase")).join(mined_phrases(told), "phrase", "left_semi").select("id").distinct().withColumn("by_comment", F.lit("mined comment"))
    reason = F.when(F.col("declared"), "declared").when(~F.col("declared"), None).otherwise(F.coalesce("content", F.when(F.col("listed"), "convention"), "by_path", "by_comment"))
    return first.join(paths, "id", "left").join(comments, "id", "left").select("id", reason.alias("reason")).where("reason is not null").distinct()
