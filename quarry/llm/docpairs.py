"""Functions paired with the documentation that says something about them.

Each function row offers comment candidates: its ``doc_comment``, the docstring and the comments of its
source. Candidates and the functions found in the source are matched by minimum-cost assignment; the cost
falls with shared parameter tags and name words and rises with the distance between comment and signature,
and a comment delivered with a function costs nothing for it and fits no other. Links above a limit are
implausible and dropped; what remains is assigned within each group of functions and comments that links
connect, so a file of any length takes time in proportion to it. What is left is cleaned of comment signs, tags and tool
directives, and kept if it says more than the function's own name.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- cleaning ---------------------------------------------------------------------------------------

_MARKER = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|\*+$|///+!?|//!|//|#+!?(?=\s|$|[^\s\[!])|--+(?=\s|$)|;+(?=\s|$)|<!--|\"\"\"|''')?[ \t]?")
_CLOSER = re.compile(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$")
#: Tags whose whole text belongs to a parameter, a result or the like; the rest of the tags only loses its sign.
_TAG = re.compile(r"^[@\\](param|arg|argument|tparam|typeparam|template|return|returns|result|retval|throws|throw|exception|raises|raise|yield|yields|type|rtype|since|version|author|see|sa|link|inheritdoc|inheritDoc|private|public|protected|internal|override|static|deprecated|group|ingroup|memberof|name|function|method|access|api|package|category|copyright|license|todo|ignore|hidden|async|readonly|var|property|default|suppress\w*)\b", re.I)
_FIELD = re.compile(r"^:(param|parameter|arg|argument|key|keyword|type|raises?|except|exception|return|returns|rtype|var|ivar|meta|yields?)\b[^:]*:", re.I)
_SECTION = re.compile(r"^(args|arguments|parameters|params|returns?|raises|yields|throws|attributes|keyword args|other parameters)\s*:\s*$", re.I)
_XML_WHOLE = re.compile(r"<(param|typeparam|returns|exception|value|permission|seealso)\b[^>]*?(?:/>|>.*?</\1\s*>)", re.S | re.I)
_XML_SIGN = re.compile(r"</?[A-Za-z][\w.:-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*/?>")
_INLINE = re.compile(r"\{@?(inheritdoc|code|link|linkplain|literal|value|see)\b\s*([^}]*)\}", re.I)
_DIRECTIVE = re.compile(
    r"""^(
      noinspection\b.* | eslint(-\w+)*\b.* | [tj]slint\b.* | jshint\b.* | pylint\s*:.* | flake8\s*:?.* | noqa\b.* | nolint\b.* | NOLINT\w*\b.*
    | type\s*:\s*ignore.* | mypy\s*:.* | pyright\s*:.* | pragma\b.* | prettier-ignore.* | @?ts-(ignore|expect-error|nocheck)\b.* | @?formatter\s*:\s*(on|off) | clang-(format|tidy)\b.*
    | fmt\s*:.* | yapf\s*:.* | isort\s*:.* | go:\w+.* | \+build\b.* | rustfmt\S* | clippy\S* | phpcs\s*:.* | phpstan\S*.* | psalm\S*.* | istanbul\s+ignore.* | c8\s+ignore.* | v8\s+ignore.*
    | coverage\s*:.* | codecov\S*.* | checkstyle\S*.* | CHECKSTYLE\S*.* | NOSONAR\b.* | NOPMD\b.* | ReSharper\b.* | resharper\b.* | swiftlint\S*.* | rubocop\S*.* | lint:\S+.* | @?SuppressWarnings\b.*
    | \#?(end)?region\b.* | cspell\S*.* | nosec\b.* | nosemgrep\b.* | @?codeCoverageIgnore\w* | @?noinspection\b.* | @flow\b.* | webpack\w+\s*:.* | stylelint\S*.* | sourcery\S*.* | ruff\s*:.* | bandit\S*.* | cppcheck\S*.* | IWYU\s+pragma.* | spell-?checker\S*.*
    )$""",
    re.X,
)
_RULE = re.compile(r"^[\W_]*$")
#: Any letters of any script.
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+")

#: Lines that only announce a text still to be written.
_TEXT = r"(docs?|documentation|descriptions?|comments?|docstrings?|summary|text|details|explanation)"
_STAND_IN = re.compile(
    rf"""^(
      (todo|fixme|tbd|tba|tbc|to\ do)\b .*
    | (no|missing|empty|needs?|lacks|without|insert|add|write|fill\ in|put|provide|enter|replace|update|complete|your|some|short|brief)
      (\ (a|an|the|this|some|any|more|proper|better|your|meaningful|useful|short|brief|method|function|code|api|inline))*\ {_TEXT}(\ (here|yet|later|available|needed|now|please|(for|of)\ this\ \w+))*
    | ((the|a|an|this)\ )?{_TEXT}\ ((goes|comes)\ here|to\ (be\ (added|done|written|completed|provided)|follow|come)|will\ (follow|be\ (added|written|provided))|(is\ )?(pending|missing|needed|required|tbd|todo|unavailable)|follows)(\ (here|later|soon|yet))*
    | (to|will)\ be\ (documented|described|written|defined|done|added|completed|filled|determined|announced|explained)\b .*
    | (not|un)[- ]?(yet\ )?documented(\ yet)? | lorem\ ipsum\b .*
    | (placeholder|stub|dummy|sample|example)\ {_TEXT}(\ .{{0,12}})?
    | (auto-?generated|generated)\ ((method|function|constructor|catch)\ )?(docs?|comment|stub|documentation)\b .{{0,20}}
    | coming\ soon\b .* | see\ above\b .{{0,20}} | same\ as\ above\b .{{0,20}}
    )$""",
    re.I | re.X,
)
_KINDS = frozenset("function method func fn procedure routine subroutine def".split())
_ARTICLES = frozenset("a an the der die das ein eine le la les un une el los las una o os as um uma".split())


def clean(text: str | None) -> str:
    """The prose of a documentation comment: without comment signs, tags, parameter descriptions and directives."""
    if not text:
        return ""
    text = _XML_WHOLE.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n"))
    kept, skipping, section = [], False, None
    for raw in text.split("\n"):
        stripped = _CLOSER.sub("", raw)
        body = _MARKER.sub("", stripped, count=1)
        indent, line = len(body) - len(body.lstrip()), body.strip()
        line = re.sub(r"^(?:/\*+!?|\*+/|///?!?|\"\"\"|''')\s*", "", _CLOSER.sub("", line))
        if not line:
            skipping = False
            continue
        if _DIRECTIVE.match(line) or _RULE.match(line):
            continue
        if _TAG.match(line) or _FIELD.match(line):
            skipping = True
            continue
        if _SECTION.match(line):
            section = indent
            continue
        if section is not None:
            if indent > section:
                continue
            section = None
        if line.startswith(("@", "\\", ":")):
            skipping = False
        if skipping:
            continue
        line = _INLINE.sub(lambda m: " " if m.group(1).lower() == "inheritdoc" else m.group(2), line)
        line = _XML_SIGN.sub(" ", line)
        line = re.sub(r"^[@\\]\w+\b|^#+\s+|^[=*~-]{3,}|[=*~-]{3,}$", " ", line).strip()
        if line and not _DIRECTIVE.match(line) and not _RULE.match(line):
            kept.append(line)
    return "\n".join(kept)


def name_pieces(name: str | None) -> list[str]:
    return [p.lower() for p in _PIECES.findall(name or "")]


def stem(word: str) -> str:
    """A word without its common English endings, so that inflected forms meet."""
    word = word.lower()
    for ending, rest in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if word.endswith(ending) and len(word) - len(ending) >= 3 and not (ending == "s" and word.endswith("ss")):
            word = word[: -len(ending)] + rest
            break
    if len(word) > 3 and word[-1] == word[-2] and word[-1] not in "aeiouls":
        word = word[:-1]
    return word[:-1] if len(word) > 3 and word[-1] == "e" else word


def _bare(text: str) -> list[str]:
    return [p for w in _WORD.findall(text.replace("_", " ")) for p in (name_pieces(w) or [w.lower()])]


def is_trivial(text: str | None, name: str | None, kind: str | None = None) -> bool:
    """Whether documentation, once cleaned, says nothing: see the module of tests for each case."""
    prose = clean(text)
    if len(_WORD.findall(prose)) < 3:
        return True
    flat = re.sub(r"[\s]+", " ", prose).strip(" .:;,!?-–—[]()<>{}*_`\"'")
    flat = re.sub(r"[\[\]<>{}()`]", "", flat)
    lines = [re.sub(r"[\[\]<>{}()`*_]", "", x).strip(" .:;,!?-–—\"'") for x in prose.split("\n")]
    if _STAND_IN.match(flat) and len(lines) == 1 or all(_STAND_IN.match(x) for x in lines):
        return True
    own = {stem(p) for p in name_pieces(name)} | ({kind.lower()} if kind else set())
    said = [w for w in _bare(prose) if w not in _ARTICLES and w not in _KINDS and not w.isdigit()]
    return all(stem(w) in own or w in own for w in said)

# --- candidates and assignment ----------------------------------------------------------------------

_BLOCK = re.compile(r"""(?P<block>/\*.*?(?:\*/|\Z))|(?P<doc>(?P<q>\"\"\"|''')(?:\\.|.)*?(?:(?P=q)|\Z))|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<line>//[^\n]*|\#(?!\[|!\[)[^\n]*)""", re.S)
_FUNCTION = re.compile(
    r"""^[ \t]*(?:(?:export|default|public|private|protected|internal|static|final|abstract|virtual|override|async|unsafe|extern|inline|const|pub(?:\([^)]*\))?|sealed|synchronized|native|readonly|constexpr|explicit|friend)\s+)*
        (?:(?:def|fn|func|function)\b\s*\*?\s*(?:\([^()]*\)\s*)?(?P<a>[A-Za-z_$][\w$]*)?\s*(?:<[^>\n]*>)?\s*\(
        |(?!(?:if|for|while|switch|return|else|catch|foreach|match|new|throw|await|yield|do|using|lock|in|not|and|or|print|assert|del|with|elif|except|case|sizeof|typeof)\b)
         (?:[\w$:<>,\[\]?.]+[ \t*&]+)*(?P<b>~?[A-Za-z_$][\w$]*)\s*\([^;{}]*\)[^;{}()=]*(?=\{))""",
    re.X | re.M,
)
#: A line so long holds packed code, where functions begin after a brace or semicolon as well; of bounded nesting, so that it takes linear time.
_LONG_LINE = re.compile(r"[^\n]{2000,}")
_ROUND = r"\((?:[^;{}()]++|\((?:[^;{}()]++|\([^;{}()]*+\))*+\))*+\)"
_PACKED = re.compile(
    rf"""(?:^|(?<=[;{{}}]))[ \t]*(?:[A-Za-z_]\w*+[ \t*&]++)*?
        (?:(?:def|fn|func|function)\b\s*\*?\s*(?:\([^()]*+\)\s*)?(?P<a>[A-Za-z_$][\w$]*+)?\s*{_ROUND}
        |(?!(?:if|for|while|switch|return|else|catch|foreach|match|new|throw|await|yield|do|using|lock|in|not|and|or|print|assert|del|with|elif|except|case|sizeof|typeof)\b)(?P<b>~?[A-Za-z_$][\w$]*+)\s*{_ROUND}[^;{{}}()=]*+(?=\{{))""",
    re.X | re.M,
)
_SIGNATURE = re.compile(r"(?:(?!:[ \t]*\n)[^{;])*+")
_PARAMETER = re.compile(r"(?:[@\\](?:param|arg|tparam)\s+(?:\{[^}]*\}\s*)?\[?|:param\s+(?:[\w\[\], ]+\s)?|<param\s+name=\")([\w$]+)", re.I)
_BETWEEN = re.compile(r"^(?:\s|@[\w.]+(?:\([^)\n]*\))?|#!?\[[^\]\n]*\]|\[[^\]\n]*\]|template\s*<[^>\n]*>)*$")

#: Cost of a link without any sign for or against it, what each sign takes off, and the cost from which a link is implausible.
BASE, TAG_GAIN, NAME_GAIN, LINE_COST, IMPLAUSIBLE = 1.0, 0.5, 0.3, 0.6, 2.0


class Comment:
    __slots__ = ("text", "start", "end", "docstring", "delivered")

    def __init__(self, text: str, start: int, end: int, docstring: bool, delivered: bool = False):
        self.text, self.start, self.end, self.docstring, self.delivered = text, start, end, docstring, delivered


def comments(source: str, hash_comments: bool, triple: bool) -> list[Comment]:
    """The comments of a source, line comments of adjoining lines joined, and its triple-quoted strings."""
    found: list[Comment] = []
    for m in _BLOCK.finditer(source):
        if m.group("str") or (m.group("line") and m.group("line")[0] == "#" and not hash_comments) or (m.group("line") and m.group("line").startswith("//") and triple):
            continue
        if m.group("doc") and not triple:
            continue
        line_start = source.rfind("\n", 0, m.start()) + 1
        alone = not source[line_start : m.start()].strip()
        if not alone and not m.group("doc") and not (m.group("block") and source[line_start : m.start()].rstrip()[-1] in ";{}" and re.compile(r"[ \t]*[^\s]").match(source, m.end())):
            continue
        last = found[-1] if found else None
        if m.group("line") and last and not last.docstring and not source[last.end : m.start()].strip() and source.count("\n", last.end, m.start()) <= 1 and not last.text.lstrip().startswith("/*"):
            last.text, last.end = source[last.start : m.end()], m.end()
        else:
            found.append(Comment(m.group(), m.start(), m.end(), bool(m.group("doc"))))
    return found


def _body_start(source: str, at: int, end: int | None = None) -> int:
    """The place after the colon or brace that ends the signature beginning at ``at``, else ``end``."""
    depth, end = 0, len(source) if end is None else end
    for k in range(at, end):
        c = source[k]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and c in "{:" and source[k : k + 2] != "::":
            return k + 1
    return end


def link_cost(comment: Comment, source: str, at: int, name: str, parameters: set[str], body: int | None = None) -> float:
    """The cost of taking ``comment`` for the documentation of the function whose signature begins at ``at`` and whose body at ``body``."""
    tags = set(_PARAMETER.findall(comment.text))
    cost = BASE - TAG_GAIN * bool(tags & parameters) - (NAME_GAIN if name and re.search(rf"\b{re.escape(name)}\b", comment.text) else 0)
    if comment.docstring:
        start = _body_start(source, at) if body is None else body
        return cost if not source[start : comment.start].strip() and comment.start >= start and _body_string(source, comment) else IMPLAUSIBLE + 1
    if comment.end > at:
        return IMPLAUSIBLE + 1
    between = source[comment.end : at]
    if not _BETWEEN.match(between):
        return IMPLAUSIBLE + 1
    return cost + LINE_COST * max(0, between.count("\n") - 1 - len(re.findall(r"\n[ \t]*[@#\[]", between)))


def _body_string(source: str, comment: Comment) -> bool:
    """Whether a triple-quoted string stands as a statement of its own."""
    after = source[comment.end : comment.end + 2].lstrip(" \t;")
    return not after or after[0] in "\r\n#" or comment.end >= len(source)


def assign(cost: list[list[float]]) -> list[int]:
    """For each row the column of a minimum-cost assignment, -1 where the rows outnumber the columns."""
    rows, columns = len(cost), max(len(cost), len(cost[0]) if cost else 0)
    padded = [list(r) + [IMPLAUSIBLE + 2] * (columns - len(r)) for r in cost]
    u, v, match = [0.0] * (rows + 1), [0.0] * (columns + 1), [0] * (columns + 1)
    for i in range(1, rows + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (columns + 1), [0] * (columns + 1), [False] * (columns + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, columns + 1):
                if not used[j]:
                    reduced = padded[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(columns + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * rows
    for j in range(1, columns + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    width = len(cost[0]) if cost else 0
    return [j if j < width else -1 for j in out]


def _links(functions: list[tuple[str, int, set[str]]], found: list[Comment], source: str) -> dict[tuple[int, int], float]:
    """(function, comment) to its cost, for all links that are not implausible.

    Nothing but white space and attributes may stand between a comment and its function, so those before a
    function are tried from the nearest on until one is too far; a docstring must be the first thing of a body.
    """
    links: dict[tuple[int, int], float] = {}
    before = sorted((j for j, c in enumerate(found) if not c.docstring and not c.delivered), key=lambda j: found[j].end)
    ends = [found[j].end for j in before]
    inside = sorted((j for j, c in enumerate(found) if c.docstring), key=lambda j: found[j].start)
    starts = [found[j].start for j in inside]
    order = sorted(at for _, at, _ in functions)
    for k, (name, at, parameters) in enumerate(functions):
        if k == 0:
            links |= {(0, j): 0.0 for j, c in enumerate(found) if c.delivered}
        for p in range(bisect.bisect_right(ends, at) - 1, -1, -1):
            cost = link_cost(found[before[p]], source, at, name, parameters)
            if cost > IMPLAUSIBLE:
                break
            links[k, before[p]] = cost
        if inside:
            following = bisect.bisect_right(order, at)
            body = _body_start(source, at, order[following] if following < len(order) else len(source))
            p = bisect.bisect_left(starts, body)
            if p < len(inside) and (cost := link_cost(found[inside[p]], source, at, name, parameters, body)) < IMPLAUSIBLE:
                links[k, inside[p]] = cost
    return {link: cost for link, cost in links.items() if cost < IMPLAUSIBLE}


def _assigned(links: dict[tuple[int, int], float]) -> dict[int, int]:
    """Function to comment by minimum-cost assignment, in each group that links connect."""
    groups: dict[int, list[int]] = {}
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, j in links:
        root[find(k)] = find(~j)
    for k in {k for k, _ in links}:
        groups.setdefault(find(k), []).append(k)
    beside: dict[int, set[int]] = {}
    for k, j in links:
        beside.setdefault(find(k), set()).add(j)
    out: dict[int, int] = {}
    for group, rows in groups.items():
        columns = sorted(beside[group])
        for k, j in zip(rows, assign([[links.get((k, j), IMPLAUSIBLE + 1) for j in columns] for k in rows]), strict=True):
            if j >= 0 and (k, columns[j]) in links:
                out[k] = columns[j]
    return out


def documented_functions(source: str, path: str | None, signature: str | None = None, name: str | None = None, delivered: str | None = None) -> list[tuple[str, int, list[str]]]:
    """(name, offset, documentation texts) of the functions of a source; the given signature, if any, is the first.

    A ``delivered`` comment is one that came with the first function; it is then the function's only text.
    """
    extension = (path or "").rsplit(".", 1)[-1].lower()
    python = extension in ("py", "pyi", "pyw") or (not extension and bool(re.match(r"\s*(async\s+)?def\b", source)))
    found = comments(source, python or extension in ("php", "phtml", "rb", "sh", "r", "pl"), python)
    pieces, done = [], 0
    for c in found:
        pieces += [source[done : c.start], re.sub(r"[^\n]", " ", source[c.start : c.end])]
        done = c.end
    code = "".join([*pieces, source[done:]])
    functions: list[tuple[str, int, set[str]]] = []
    if signature is not None or name is not None:
        first = re.search(r"\S", code)
        at = code.find(signature.strip()) if signature and signature.strip() else -1
        if at < 0:
            at = _skip_attributes(code, first.start() if first else len(code))
        functions.append((name or "", at, set(re.findall(r"[A-Za-z_$][\w$]*", signature or ""))))
    heads = list(_FUNCTION.finditer(_LONG_LINE.sub(lambda m: " " * len(m.group()), code)))
    heads += [m for line in _LONG_LINE.finditer(code) for m in _PACKED.finditer(code, line.start(), line.end())]
    for m in heads:
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        if not functions or at > functions[0][1] + 1 or signature is None and name is None:
            functions.append((m.group("a") or m.group("b") or "", at, set(re.findall(r"[A-Za-z_$][\w$]*", _SIGNATURE.match(code, at).group()))))
    if not functions:
        return []
    if delivered is not None:
        found.append(Comment(delivered, -1, -1, False, True))
    links = _links(functions, found, source)
    texts: list[list[str]] = [[] for _ in functions]
    # A function may have a docstring and a comment before it, so the two kinds are assigned apart.
    for docstring in (True, False):
        for k, j in _assigned({link: cost for link, cost in links.items() if found[link[1]].docstring == docstring}).items():
            texts[k] = [found[j].text] if found[j].delivered else [*texts[k], found[j].text]
    return [(name, at, t) for (name, at, _), t in zip(functions, texts, strict=True)]


def _skip_attributes(code: str, at: int) -> int:
    while m := re.compile(r"(?:@[\w.]+(?:\([^)\n]*\))?|#!?\[[^\]\n]*\]|\[[^\]\n]*\])\s*").match(code, at):
        at = m.end()
    return at


def called(signature: str | None) -> str | None:
    """The name a signature declares: the identifier before its first parameter list that is no receiver."""
    for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*(?:<[^<>\n]*>\s*)?\(", signature or ""):
        if m.group(1) not in ("func", "fn", "def", "function"):
            return m.group(1)
    return None


def documentation(source: str, path: str | None, signature: str | None, name: str | None, kind: str | None, doc_comment: str | None) -> str | None:
    """The cleaned documentation of one function row, or None where there is none or it is trivial.

    A ``doc_comment`` that is not blank is a candidate delivered with the row and decides; else the docstring and
    the comment before the signature are candidates and the first that says something holds.
    """
    name = name or called(signature) or called(source)
    linked = documented_functions(source, path, signature or "", name, doc_comment if doc_comment and doc_comment.strip() else None)
    for text in linked[0][2] if linked else []:
        if not is_trivial(text, name, kind):
            return clean(text)
    return None


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("id", "file_path", "kind", "name", "signature", "doc_comment", "source")
    for batch in batches:
        rows = []
        for node, path, kind, name, signature, doc, source in zip(*(batch[n].to_pylist() for n in names), strict=True):
            text = documentation(source, path, signature, name, kind, doc)
            if text is not None:
                rows.append((node, text, source, signature))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["node_id", "description", "code", "signature"])


def documented_pairs(nodes: DataFrame, exact_rows: bool = True) -> DataFrame:
    """(node_id, description, code, signature) of functions and methods whose documentation says something.

    Rows of other kinds, with a null id or a null or empty source are left out; null names, signatures and
    paths are allowed. With ``exact_rows`` equal results count once. No row depends on another, so nothing is
    shuffled but the results.
    """
    rows = nodes.where(F.col("kind").isin("function", "method") & (F.col("source") != "") & F.col("id").isNotNull())
    rows = rows.select(F.col("id").cast("long").alias("id"), "file_path", "kind", "name", "signature", "doc_comment", "source")
    found = rows.mapInArrow(_pairs, "node_id long, description string, code string, signature string")
    return found.distinct() if exact_rows else found


def file_pairs(files: DataFrame) -> DataFrame:
    """(file_id, name, description) of the documented functions inside whole source files (file_id, file_path, source)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, path, source in zip(batch["file_id"].to_pylist(), batch["file_path"].to_pylist(), batch["source"].to_pylist(), strict=True):
                for name, _, texts in documented_functions(source, path):
                    rows += [(file, name, clean(t)) for t in texts if not is_trivial(t, name, "function")][:1]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["file_id", "name", "description"])

    rows = files.where("file_id is not null and source is not null and source <> ''")
    return rows.select(F.col("file_id").cast("long").alias("file_id"), "file_path", "source").mapInArrow(extract, "file_id long, name string, description string").distinct()
