"""Lexing into bracket spans and filling the chart of (span, kind); the cost and places of the repair.

Brackets are paired first: a closing bracket ends the nearest open one of its kind, brackets open above that lack
their end, and one that ends nothing is left over. Each missing end and each left-over token is one edit. Given the
pairs, the cost is the least number of edits of tokens that makes the text a word of its language's grammar.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quarry.llm.syntax.automata import Repair, Span
from quarry.llm.syntax.grammars import EXTENSIONS, GRAMMARS, KINDS, RESERVED, SOFT

BY_EXTENSION = {e: language for language, extensions in EXTENSIONS.items() for e in extensions}
CLOSER = {"(": ")", "[": "]", "{": "}"}
#: Known contents of bracket pairs kept for one language, so that what repeats is parsed once, and the longest of them.
MOST_SPANS, LONGEST_KEPT = 50_000, 60
MOST_TOKENS = 100_000

_CONFLICT = r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \t\r]|$)[^\n]*"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\(?:.|\n))*(?:"|(?=\n)|\Z)', r"'(?:[^'\\\n]|\\(?:.|\n))*(?:'|(?=\n)|\Z)"
_DOUBLE_M, _SINGLE_M = r'"(?:[^"\\]|\\(?:.|\n))*(?:"|\Z)', r"'(?:[^'\\]|\\(?:.|\n))*(?:'|\Z)"
_WORD = r"[^\W\d]\w*"
_NUMBER = r"(?:0[xX][0-9a-fA-F_']+|0[bB][01_']+|0[oO][0-7_]+|\d[\d_']*(?:\.(?!\.)\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)(?:[a-zA-Z_]\w*)?"
_DIRECTIVE = r"^[ \t]*#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|elifdef|else|endif|pragma|error|warning|line|region|endregion|nullable|import|include_next)\b[^\n]*(?<!\\)(?:\\\n[^\n]*)*"
_TEMPLATE = r"`(?:[^`\\$]|\\(?:.|\n)|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*(?:`|\Z)"
_REGEX = r"(?:(?<=[(,=:;!&|?{}\[])|(?<=[(,=:;!&|?{}\[] )|(?<=return ))/(?![*/ ])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"

_LEX = {
    "javascript": [_CONFLICT, _LINE, _BLOCK, _DOUBLE, _SINGLE, _TEMPLATE, _REGEX, r"\n", r"[$\w]*[$][\w$]*|" + _WORD, _NUMBER, r"\.\.\.|=>|===|!==|\*\*=|&&=|\|\|=|\?\?=|<<=|==|!=|<=|>=|\*\*|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"],
    "go": [_CONFLICT, _LINE, _BLOCK, _DOUBLE, r"`[^`]*(?:`|\Z)", _SINGLE, r"\n", _WORD, _NUMBER, r"\.\.\.|<<=|>>=|&\^=|:=|==|!=|<=|>=|&&|\|\||<-|\+\+|--|<<|>>|&\^|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"],
    "rust": [_CONFLICT, _LINE, _BLOCK, r'(?:br|r|cr)(#*)"[\s\S]*?(?:"\1|\Z)', r"[bc]?" + _DOUBLE_M, r"b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'", r"'[A-Za-z_]\w*", r"r#\w+|" + _WORD, r"(?:0[xob][0-9a-fA-F_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d+)?)(?:[a-zA-Z_]\w*)?", r"\.\.=|\.\.\.|<<=|::|->|=>|==|!=|<=|>=|&&|\|\||\.\.|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"],
    "java": [_CONFLICT, _LINE, _BLOCK, r'"""(?:[^"\\]|\\.|"(?!""))*(?:"""|\Z)', _DOUBLE, _SINGLE, r"[$\w]*[$][\w$]*|" + _WORD, _NUMBER, r"\.\.\.|<<=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"],
    "csharp": [_CONFLICT, _LINE, _BLOCK, _DIRECTIVE, r'\$*"""(?:[^"]|"(?!""))*(?:"""|\Z)', r'(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z)', r"\$?" + _DOUBLE, _SINGLE, r"@?" + _WORD, _NUMBER, r"<<=|\?\?=|=>|->|::|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|<<|\.\.|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"],
    "c": [_CONFLICT, _LINE, _BLOCK, _DIRECTIVE, r"(?:L|u8?|U)?" + _DOUBLE, r"(?:L|u8?|U)?" + _SINGLE, _WORD, _NUMBER, r"\.\.\.|<<=|->|==|!=|<=|>=|&&|\|\||\+\+|--|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"],
    "cpp": [_CONFLICT, _LINE, _BLOCK, _DIRECTIVE, r'(?:u8|[LuU])?R"([^(\s]*)\([\s\S]*?(?:\)\1"|\Z)', r"(?:L|u8?|U)?" + _DOUBLE, r"(?:L|u8?|U)?" + _SINGLE, _WORD, _NUMBER, r"\.\.\.|<=>|<<=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"],
    "php": [_CONFLICT, r"\?>\n?(?:[^<]|<(?!\?))*(?:<\?(?:php\b|=)?|\Z)", _LINE, r"#(?!\[)[^\n]*", _BLOCK, r"<<<[ \t]*(['\"]?)(\w+)\1\n(?:[\s\S]*?\n)??[ \t]*\2\b", _DOUBLE_M, _SINGLE_M, r"`[^`]*(?:`|\Z)", r"\$" + _WORD, _WORD, _NUMBER, r"\.\.\.|===|!==|\*\*=|\?\?=|<<=|<=>|=>|->|\?->|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\*\*|\+\+|--|<<|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|\S"],
    "python": [_CONFLICT, r"#[^\n]*", r"(?:[rRbBfFuUtT]{0,2})\"\"\"(?:[^\\\"]|\\(?:.|\n)|\"(?!\"\"))*(?:\"\"\"|\Z)", r"(?:[rRbBfFuUtT]{0,2})'''(?:[^\\']|\\(?:.|\n)|'(?!''))*(?:'''|\Z)", r"[rRbBfFuUtT]{0,2}" + _DOUBLE, r"[rRbBfFuUtT]{0,2}" + _SINGLE, r"\\\n", r"\n[ \t\f]*", _WORD, r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d[\d_]*)?[jJ]?|\.\d[\d_]*(?:[eE][+-]?\d+)?[jJ]?)(?:[a-zA-Z_]\w*)?", r"\.\.\.|\*\*=|//=|>>=|<<=|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\S"],
}
_LEX["typescript"] = _LEX["javascript"]


@dataclass
class Result:
    """What parsing found: the repair's cost, where its edits lie (shares of the text), and what kind of damage that is."""

    cost: int = 0
    places: list[float] = field(default_factory=list)
    conflict: bool = False
    unclosed: int = 0
    lines: int = 0

    @property
    def cause(self) -> str | None:
        if not self.cost:
            return None
        if self.conflict:
            return "conflict"
        if self.cost >= max(6, 0.25 * self.lines):
            return "mismatch"
        ends = [p for p in self.places if 0.02 < p < 0.97]
        if not ends or self.unclosed and all(p > 0.9 for p in self.places):
            return "truncation"
        return "damage"


class Parser:
    """The lexer and chart parser of one language, with what it has learned from earlier texts."""

    def __init__(self, language: str):
        self.language, self.grammar = language, GRAMMARS[language]
        parts = _LEX[language]
        shifted, groups = [], 0
        for part in parts:
            shifted.append(re.sub(r"\\([12])(?![0-9])", lambda m, g=groups: f"\\{int(m.group(1)) + g}", part))
            groups += re.compile(part, re.M).groups
        self.lexer = re.compile("|".join(f"(?:{p})" for p in shifted), re.M)
        self.plain = groups == 0
        self.names: list[frozenset[str]] = []
        self._symbols: dict[frozenset[str], int] = {}
        self._tokens: dict[str, int] = {}
        self._spans: dict[tuple, int] = {}
        self.reserved, self.soft = set(RESERVED[language].split()), set(SOFT.get(language, "").split())
        self.kinds = {bracket: kinds.split() for bracket, kinds in KINDS[language].items()}
        self.semicolon, self.nl = self.symbol({";", "ANY"}), self.symbol({"NL"})
        self.html = self.symbol({"HTML", ";"})
        self.left_over, self.without_end = self.symbol({"LEFT OVER"}), self.symbol({"WITHOUT END"})
        self.newlines = language in ("javascript", "typescript", "go", "python")

    def symbol(self, names: set[str]) -> int:
        key = frozenset(names)
        number = self._symbols.get(key)
        if number is None:
            number = self._symbols[key] = len(self.names)
            self.names.append(key)
        return number

    def _classify(self, token: str) -> int:
        """The symbol of a token, -1 for what is no token of the language, -2 for what is skipped."""
        language, c = self.language, token[0]
        if token.isspace():
            return -2
        if token.startswith(("<<<<<<<", ">>>>>>>", "|||||||")) or re.fullmatch(r"={7}[ \t\r]*[^\n]*", token):
            return -3
        if c == "/" and token[1:2] in ("/", "*") and language != "python":
            return -2 if token[1] == "/" or token.endswith("*/") and len(token) >= 4 else -1
        if c == "#" and (language in ("python", "php") and token != "#" or language in ("c", "cpp", "csharp") and len(token) > 1):
            return -2
        if language == "php" and token.startswith("?>"):
            return self.html
        if language == "php" and token.startswith("<<<") and len(token) > 3:
            return self.symbol({"STR", "ANY"})
        if language == "php" and c == "$" and len(token) > 1:
            return self.symbol({"VAR", "ANY"})
        body = token.lstrip("rRbBfFuUtTLcC8$@#") if c not in "\"'`" and token[-1] in "\"'`#" or c in "@$" and len(token) > 1 and token[1] in '"@$' else token
        if body[:1] in ("\"", "'", "`") or (c in "rbcRLuU" and '"' in token[:4]):
            return self._string(token, body)
        if language in ("javascript", "typescript") and c == "/" and len(token) > 2:
            return self.symbol({"STR", "ANY"})
        if c.isdigit() or c == "." and token[1:2].isdigit():
            return self._number(token)
        if c.isalpha() or c in "_$@" and len(token) > 1 or c == "_":
            word = token.lstrip("@") if language == "csharp" else token
            if language == "php":
                word = word.lower()
            if language == "rust" and token.startswith("r#") or language == "csharp" and c == "@":
                return self.symbol({"ID", "NAME", "ANY"})
            if word in self.reserved:
                return self.symbol({word, "NAME", "ANY"})
            if word in self.soft:
                return self.symbol({word, "ID", "NAME", "ANY"})
            return self.symbol({"ID", "NAME", "ANY"})
        if language == "rust" and c == "'":
            return self.symbol({"LIFE", "ANY"})
        if len(token) == 1 and ord(c) > 127 or c in "\\`\"'$#?" and language in ("java", "go", "c", "python") and not (c == "?" and language in ("java", "c")):
            return -1
        return self.symbol({token, "ANY", "OPERATOR"})

    def _string(self, token: str, body: str) -> int:
        mark = body[:3] if body[:3] in ('"""', "'''") else body[:1]
        raw = re.match(r'(?:br|r|cr)(#*)"', token) if self.language == "rust" else None
        if raw:
            closed = token.endswith('"' + raw.group(1)) and len(token) > len(raw.group()) 
        elif self.language == "cpp" and re.match(r"(?:u8|[LuU])?R\"", token):
            closed = token.endswith('"') and token.count('"') > 1
        elif self.language == "rust" and body[:1] == "'" and not token.endswith("'"):
            return self.symbol({"LIFE", "ANY"})
        else:
            closed = len(body) >= 2 * len(mark) and body.endswith(mark)
            if closed and len(mark) == 1 and mark != "`" and not token.startswith("@"):
                tail = len(body) - 1 - len(body[:-1].rstrip("\\"))
                closed = tail % 2 == 0
        if not closed:
            return -1
        if mark == "'" and self.language in ("go", "java", "c", "cpp", "csharp", "rust") and not re.fullmatch(r"'(?:[^\\]{1,4}|\\.{1,10}|\\u\{[^}]*\})'", body, re.S):
            return -1
        return self.symbol({"STR", "ANY"})

    def _number(self, token: str) -> int:
        tail = re.sub(r"^(0[xX][0-9a-fA-F_'.]+([pP][+-]?\d+)?|0[bB][01_']+|0[oO][0-7_]+|[\d_'.]+([eE][+-]?[\d_]+)?)", "", token)
        allowed = {"python": r"[jJ]?", "javascript": r"n?", "typescript": r"n?", "go": r"i?", "java": r"[lLfFdD]?", "csharp": r"[uUlLfFdDmM]{0,2}", "php": r"", "rust": r"(_?[iuf](8|16|32|64|128|size))?", "c": r"[uUlLfFjJ]{0,3}", "cpp": r"([uUlLfFzZ]{0,3}|_\w+|h|min|s|ms|us|ns)"}[self.language]
        return self.symbol({"NUM", "ANY"}) if re.fullmatch(allowed, tail) else -1

    # --- spans -------------------------------------------------------------------------------------

    def span(self, bracket: str, content: list[int]) -> int:
        """The symbol of a bracket pair: all kinds its content matches."""
        key = (bracket, *content)
        number = self._spans.get(key)
        if number is None:
            found = {f"<{kind}>" for kind in self.kinds[bracket] if self.grammar.accepts(kind, content, self.names)}
            found.add("ANY")
            if not content:
                found.add("OPERATOR")
            number = self.symbol(found)
            if len(self._spans) > MOST_SPANS:
                self._spans.clear()
            if len(content) <= LONGEST_KEPT:
                self._spans[key] = number
        return number

    def is_bad(self, number: int) -> bool:
        return not any(n[0] == "<" and len(n) > 2 for n in self.names[number])

    _STARTS_NO_STATEMENT = frozenset(". , ; ) ] ? : = + - * / % & | ^ < > ( [ { ?. => == === != !== <= >= && || ?? ** += -= *= /= %= &= |= ^= << ... catch finally in of instanceof as extends implements satisfies from is }".split()) - {"...", "of", "from", "is"}
    _ENDS_NO_STATEMENT = frozenset("const let var function class import export extends new typeof void delete throw case in instanceof if for while do else try finally switch with default implements , ; . ( [ { ? : = + - * / % & | ^ < ! ~ => == === != !== <= >= && || ?? ** += -= *= /= %= &= |= ^= << ... @ # ?.".split()) - {"default"}
    _GO_ENDS = frozenset("break continue fallthrough return ++ --".split())

    def parse(self, text: str, thorough: bool = False) -> Result:
        """The least repair of a text; without ``thorough`` the chart is filled only until the cost is known to be 0 or more (then 1)."""
        self.grammar.tidy()
        text = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        result = Result(lines=text.count("\n") + 1)
        tokens = self._python(text, result, thorough) if self.language == "python" else self._bracketed(text, result, thorough)
        if tokens is None or not tokens and not result.cost:
            return result
        if not thorough:
            result.cost = 0 if self.grammar.accepts("file", tokens, self.names) else 1
            return result
        repair = Repair(self.grammar, "file", tokens, self.names)
        result.cost += repair.least()
        result.places += repair.places()
        return result

    def _closed(self, bracket: str, content: list[int], thorough: bool, missing: bool = False) -> int | None:
        """The symbol of a pair; None if its content is of no kind and only whether there is damage is asked."""
        if not thorough:
            symbol = self.span(bracket, content)
            return None if self.is_bad(symbol) else symbol
        return Span(self.without_end if missing else self.span(bracket, content), bracket, self.kinds[bracket], content, missing)

    def _bracketed(self, text: str, result: Result, thorough: bool) -> list[int] | None:
        language, classify, known, names = self.language, self._classify, self._tokens, self.names
        go, js, php = language == "go", language in ("javascript", "typescript"), language == "php"
        if php:
            opening = re.search(r"<\?(?:php\b|=)", text)
            if not opening:
                return []
            offset = opening.end()
            text = text[offset:]
        if js and "<" in text:
            text = _without_jsx(text)
        if js and text.startswith("#!"):
            text = text[text.find("\n") + 1 :] if "\n" in text else ""
        current: list[int] = []
        opened: list[tuple[str, list[int]]] = []
        depth = dict.fromkeys(")]}", 0)
        newline, bracket = False, ""
        for match in self.lexer.finditer(text):
            token = match.group()
            if token == "\n":
                newline = True
                if go and current and (self._go_ends(current[-1]) or self._go_clause(current)):
                    current.append(self.semicolon)
                continue
            number = known.get(token)
            if number is None:
                number = -4 if token in "()[]{}" else classify(token)
                if len(known) < MOST_TOKENS and len(token) < 60:
                    known[token] = number
            if number == -2:
                if go and "\n" in token and current and self._go_ends(current[-1]):
                    current.append(self.semicolon)
                if js and "\n" in token:
                    newline = True
                continue
            if js and newline:
                newline = False
                if current and bracket in ("", "{") and token not in self._STARTS_NO_STATEMENT and not self._js_open(current[-1]):
                    current.append(self.semicolon)
            if number >= 0:
                current.append(number)
                continue
            if number == -4:
                if token in "([{":
                    depth[CLOSER[token]] += 1
                    opened.append((bracket, current))
                    bracket, current = token, []
                    continue
                if token in depth:
                    while depth[token] and CLOSER[bracket] != token and thorough:
                        depth[CLOSER[bracket]] -= 1
                        result.unclosed += 1
                        symbol = self._closed(bracket, current, True, True)
                        bracket, current = opened.pop()
                        current.append(symbol)
                    if depth[token] and CLOSER[bracket] == token:
                        depth[token] -= 1
                        symbol = self._closed(bracket, current, thorough)
                        if symbol is None:
                            result.cost = 1
                            return None
                        bracket, current = opened.pop()
                        current.append(symbol)
                        continue
            result.conflict |= number == -3
            if not thorough:
                result.cost = 1
                return None
            current.append(self.left_over)
        if go and current and self._go_ends(current[-1]):
            current.append(self.semicolon)
        while opened:
            if not thorough:
                result.cost = 1
                return None
            result.unclosed += 1
            symbol = self._closed(bracket, current, True, True)
            bracket, current = opened.pop()
            current.append(symbol)
        return current

    def _go_ends(self, number: int) -> bool:
        names = self.names[number]
        return "ID" in names or "NUM" in names or "STR" in names or "OPERATOR" not in names and ";" not in names and not (names & self.reserved) or bool(names & self._GO_ENDS) or any(n[0] == "<" and len(n) > 2 and n.endswith(">") for n in names)

    def _go_clause(self, current: list[int]) -> bool:
        """Whether the tokens are a package clause, whose name may be any word (see the grammars)."""
        return len(current) == 2 and "package" in self.names[current[0]] and "NAME" in self.names[current[1]]

    def _js_open(self, number: int) -> bool:
        return bool(self.names[number] & self._ENDS_NO_STATEMENT) and "ID" not in self.names[number]

    def _python(self, text: str, result: Result, thorough: bool) -> list[int] | None:
        known = self._tokens
        current: list[int] = []
        opened: list[tuple[str, list[int]]] = []
        bracket, fresh = "", True
        indents: list[int] = [0]

        def close(missing: bool = False) -> bool:
            nonlocal current, bracket
            symbol = self._closed(bracket, current, thorough, missing)
            if symbol is None:
                return False
            bracket, current = opened.pop()
            current.append(symbol)
            return True

        pending = len(text) - len(text.lstrip(" \t"))
        for match in self.lexer.finditer(text):
            token = match.group()
            if token[0] == "\n":
                if bracket in ("", "INDENT"):
                    if not fresh:
                        current.append(self.nl)
                        fresh = True
                    pending = len(token[1:].expandtabs(8).rsplit("\f", 1)[-1])
                continue
            if token == "\\\n":
                continue
            number = known.get(token)
            if number is None:
                number = -4 if token in "()[]{}" else self._classify(token)
                if len(known) < MOST_TOKENS and len(token) < 60:
                    known[token] = number
            if number == -2:
                continue
            if number == -3:
                result.cost, result.conflict = result.cost + 1, True
                result.places.append(match.start() / max(1, len(text)))
                if not thorough:
                    return None
                continue
            if fresh and bracket in ("", "INDENT"):
                fresh = False
                if pending > indents[-1]:
                    indents.append(pending)
                    opened.append((bracket, current))
                    bracket, current = "INDENT", []
                while pending < indents[-1]:
                    indents.pop()
                    if not close():
                        result.cost = 1
                        return None
                if pending != indents[-1]:
                    result.cost += 1
                    result.places.append(match.start() / max(1, len(text)))
                    if not thorough:
                        return None
                    indents[-1] = pending if len(indents) > 1 else 0
            if number >= 0:
                current.append(number)
                continue
            if number == -4:
                if token in "([{":
                    opened.append((bracket, current))
                    bracket, current = token, []
                    continue
                if bracket in CLOSER and CLOSER[bracket] == token:
                    if not close():
                        result.cost = 1
                        return None
                    continue
            if not thorough:
                result.cost = 1
                return None
            current.append(self.left_over)
        while bracket in CLOSER:
            result.unclosed += 1
            if not thorough:
                result.cost = 1
                return None
            close(missing=True)
        if not fresh:
            current.append(self.nl)
        while bracket == "INDENT":
            if not close():
                result.cost = 1
                return None
        return current


_JSX_BEFORE = re.compile(r"(?:[(,=:?\[{;]|=>|&&|\|\||\breturn|\bdefault)\s*$")
_JSX_OPEN = re.compile(r"<(?:>|[A-Za-z][\w.:-]*(?=[\s/>]))")


def _without_jsx(text: str) -> str:
    """The text with each element written in an expression replaced by a string of as many lines."""
    out, done, at = [], 0, 0
    while (m := _JSX_OPEN.search(text, at)) is not None:
        at = m.end()
        before = text[max(0, m.start() - 40) : m.start()]
        if not _JSX_BEFORE.search(before) or re.search(r"[;{]\s*$", before) and not re.search(r"\breturn\s*$", before):
            continue
        end = _jsx_end(text, m.start())
        if end:
            out += [text[done : m.start()], '"x"', "\n" * 0]
            done = at = end
    return "".join(out) + text[done:] if out else text


def _jsx_end(text: str, at: int) -> int | None:
    """The end of the element that begins at ``at``, None if it has none."""
    depth = 0
    while at < len(text):
        if text.startswith("</", at):
            close = text.find(">", at)
            if close < 0:
                return None
            depth, at = depth - 1, close + 1
        elif text[at] == "<":
            m = re.compile(r"<(?:[A-Za-z][\w.:-]*)?").match(text, at)
            at, depth = m.end(), depth + 1
            while at < len(text) and text[at] != ">":
                if text[at] in "\"'":
                    at = text.find(text[at], at + 1)
                    if at < 0:
                        return None
                elif text[at] == "{":
                    at = _braces_end(text, at) - 1
                elif text.startswith("/>", at):
                    depth -= 1
                elif text[at] in "<;":
                    return None
                at += 1
            at += 1
        elif text[at] == "{":
            at = _braces_end(text, at)
        else:
            at += 1
            continue
        if depth == 0:
            return at
    return None


def _braces_end(text: str, at: int) -> int:
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if depth == 0:
            return k + 1
    return len(text)


_PARSERS: dict[str, Parser] = {}


def parser(language: str) -> Parser:
    """The parser of a language, shared by all texts of a process."""
    if language not in _PARSERS:
        _PARSERS[language] = Parser(language)
    return _PARSERS[language]


def language_of(path: str | None, language: str | None) -> str | None:
    """The language a file is held against: the stated one, else that of the extension; None if it has no grammar."""
    stated = (language or "").strip().lower()
    stated = {"c++": "cpp", "c#": "csharp", "js": "javascript", "ts": "typescript", "py": "python", "golang": "go"}.get(stated, stated)
    if stated:
        return stated if stated in GRAMMARS else None
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    return BY_EXTENSION.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def check(text: str | None, language: str | None, thorough: bool = False) -> Result:
    """The repair of a text in a language; empty texts and languages without a grammar need none."""
    if not text or text.isspace() or language not in GRAMMARS:
        return Result()
    return parser(language).parse(text, thorough)
