"""A pattern query language over the property graph, compiled to joins.

``MATCH (a:Function)-[r:calls]->(b)<-[:contains]-(f) WHERE a.name = 'main' AND NOT EXISTS { (b)<-[:calls]-() }
RETURN a.name, b ORDER BY a.name DESC LIMIT 10``
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Properties that are columns of a node; any other name is looked up in its metadata.
PROPERTIES = ("id", "project_id", "file_path", "kind", "name", "qualified_name", "signature", "doc_comment", "start_line", "end_line", "complexity", "is_exported", "content_hash", "source", "created_at", "updated_at")
#: Columns a whole variable returns.
WHOLE = ("id", "file_path", "kind", "name", "qualified_name", "start_line", "end_line", "complexity", "is_exported")

_TOKEN = re.compile(r"\s*(?:(?P<word>[A-Za-z_]\w*)|(?P<text>'[^']*'|\"[^\"]*\")|(?P<number>\d+)|(?P<sign><-|->|[-(){}\[\]:.,=<>]))")


class PatternError(ValueError):
    """A query text that cannot be read, with the place of the trouble."""


@dataclass
class Node:
    name: str | None = None
    label: str | None = None


@dataclass
class Hop:
    name: str | None = None
    kind: str | None = None
    direction: str = "out"


@dataclass
class Equal:
    name: str
    prop: str
    value: str


@dataclass
class NotExists:
    nodes: list[Node]
    hops: list[Hop]


@dataclass
class Query:
    nodes: list[Node]
    hops: list[Hop]
    where: list[Equal | NotExists] = field(default_factory=list)
    returns: list[tuple[str, str | None]] = field(default_factory=list)
    order: tuple[str, str, bool] | None = None
    limit: int | None = None


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise PatternError(f"unexpected character {text[at : at + 1]!r} at {at}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup), m.start(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead][:2] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self) -> str:
        kind, value = self.peek()
        if kind == "end":
            raise PatternError("the query ends too early")
        self.at += 1
        return value

    def sign(self, value: str) -> bool:
        if self.peek() == ("sign", value):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.sign(value):
            raise PatternError(f"expected {value!r} before {self.peek()[1]!r}")

    def keyword(self, *words: str) -> bool:
        for k, word in enumerate(words):
            kind, value = self.peek(k)
            if kind != "word" or value.upper() != word:
                return False
        self.at += len(words)
        return True

    def word(self) -> str:
        kind, value = self.peek()
        if kind != "word":
            raise PatternError(f"expected a name before {value!r}")
        self.at += 1
        return value

    def node(self) -> Node:
        self.expect("(")
        node = Node()
        if self.peek()[0] == "word":
            node.name = self.word()
        if self.sign(":"):
            node.label = self.word()
        self.expect(")")
        return node

    def hop(self) -> Hop | None:
        if self.sign("<-"):
            hop = Hop(direction="in")
        elif self.sign("-"):
            hop = Hop(direction="out")
        elif self.peek() == ("sign", "->"):
            raise PatternError("a relationship begins with '-' or '<-'")
        else:
            return None
        if self.sign("["):
            if self.peek()[0] == "word":
                hop.name = self.word()
            if self.sign(":"):
                hop.kind = self.word()
            self.expect("]")
        if hop.direction == "in":
            self.expect("-")
        elif not self.sign("->"):
            self.expect("-")
            hop.direction = "both" if not self.sign(">") else "out"
        return hop

    def path(self) -> tuple[list[Node], list[Hop]]:
        nodes, hops = [self.node()], []
        while (hop := self.hop()) is not None:
            hops.append(hop)
            nodes.append(self.node())
        return nodes, hops

    def condition(self) -> Equal | NotExists:
        if self.keyword("NOT", "EXISTS"):
            self.expect("{")
            nodes, hops = self.path()
            self.expect("}")
            return NotExists(nodes, hops)
        name = self.word()
        self.expect(".")
        prop = self.word()
        self.expect("=")
        kind, value = self.peek()
        if kind not in ("text", "number"):
            raise PatternError("a property is compared with a text or a number")
        self.at += 1
        return Equal(name, prop, value[1:-1] if kind == "text" else value)


def parse(text: str) -> Query:
    """The syntax tree of a query; PatternError for what the language does not have, trailing text included."""
    reader = _Reader(text)
    if not reader.keyword("MATCH"):
        raise PatternError("a query begins with MATCH")
    query = Query(*reader.path())
    if reader.keyword("WHERE"):
        query.where.append(reader.condition())
        while reader.keyword("AND"):
            query.where.append(reader.condition())
    if not reader.keyword("RETURN"):
        raise PatternError(f"expected RETURN before {reader.peek()[1]!r}")
    while True:
        name = reader.word()
        if reader.peek() == ("sign", "("):
            raise PatternError(f"functions such as {name}() are not part of the language")
        query.returns.append((name, reader.word() if reader.sign(".") else None))
        if not reader.sign(","):
            break
    if reader.keyword("ORDER", "BY"):
        name = reader.word()
        reader.expect(".")
        prop = reader.word()
        down = reader.keyword("DESC")
        if not down:
            reader.keyword("ASC")
        query.order = (name, prop, down)
    if reader.keyword("LIMIT"):
        kind, value = reader.peek()
        if kind != "number":
            raise PatternError("LIMIT takes a whole number")
        query.limit = int(reader.take())
    if reader.peek()[0] != "end":
        raise PatternError(f"unexpected {reader.peek()[1]!r} after the query")
    return query


def label_kinds(label: str) -> list[str]:
    """The kinds a label stands for: itself in lower case and in snake case."""
    return list(dict.fromkeys([label.lower(), re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", label).lower()]))


def _property(alias: str, prop: str) -> Column:
    return F.col(f"{alias}.{prop}") if prop in PROPERTIES else F.get_json_object(F.coalesce(F.col(f"{alias}.metadata"), F.lit("{}")), f"$.{prop}")


def _equals(nodes: DataFrame, alias: str, prop: str, value: str) -> Column:
    """Equality as the column's type has it; a JSON value must be a text to equal one."""
    if prop not in PROPERTIES:
        return (F.get_json_object(F.coalesce(F.col(f"{alias}.metadata"), F.lit("{}")), f"$.{prop}") == value) & F.col(f"{alias}.metadata").rlike(rf'"{re.escape(prop)}"\s*:\s*"')
    kind = dict(nodes.dtypes)[prop]
    if kind == "string":
        return F.col(f"{alias}.{prop}") == value
    literal = {"true": "1", "false": "0"}.get(value.lower(), value) if kind == "boolean" else value
    own = F.col(f"{alias}.{prop}").cast("int") if kind == "boolean" else F.col(f"{alias}.{prop}")
    return own == F.lit(literal).try_cast("double" if kind in ("bigint", "int", "double", "boolean") else kind)


def _steps(edges: DataFrame, hop: Hop, number: int) -> DataFrame:
    """Edges as (from, to) in the direction of the hop. Both directions are a union with the reversed edges, never an OR-join."""
    rows = edges if hop.kind is None else edges.where(F.col("kind") == hop.kind)
    forth = rows.select(F.col("source_node_id").alias(f"_from{number}"), F.col("target_node_id").alias(f"_to{number}"))
    back = rows.select(F.col("target_node_id").alias(f"_from{number}"), F.col("source_node_id").alias(f"_to{number}"))
    if hop.direction == "out":
        return forth
    if hop.direction == "in":
        return back
    return forth.unionByName(back).where(F.col(f"_from{number}") != F.col(f"_to{number}"))


def compile_query(query: Query, nodes: DataFrame, edges: DataFrame, project_id: int | None = None) -> DataFrame:
    """The DataFrame of a query. A name used twice stands for one node; columns are named ``variable_property``."""
    scope = nodes if project_id is None else nodes.where(F.col("project_id") == project_id)
    aliases: dict[str, str] = {}
    plan: DataFrame | None = None
    last = ""
    for k, node in enumerate(query.nodes):
        alias = aliases.get(node.name) if node.name else None
        repeated = alias is not None
        alias = alias or f"n{k}"
        if node.name:
            aliases[node.name] = alias
        rows = scope if node.label is None else scope.where(F.col("kind").isin(*label_kinds(node.label)))
        if plan is None:
            plan = rows.alias(alias)
        else:
            step = _steps(edges, query.hops[k - 1], k)
            plan = plan.join(step, F.col(f"{last}.id") == F.col(f"_from{k}"))
            if repeated:
                plan = plan.where(F.col(f"{alias}.id") == F.col(f"_to{k}"))
                if node.label:
                    plan = plan.where(F.col(f"{alias}.kind").isin(*label_kinds(node.label)))
            else:
                plan = plan.join(rows.alias(alias), F.col(f"_to{k}") == F.col(f"{alias}.id"))
            plan = plan.where(F.col(f"{last}.project_id") == F.col(f"{alias}.project_id"))
        last = alias

    def alias_of(name: str) -> str:
        if name not in aliases:
            raise PatternError(f"unknown variable {name}")
        return aliases[name]

    for condition in query.where:
        if isinstance(condition, Equal):
            plan = plan.where(_equals(nodes, alias_of(condition.name), condition.prop, condition.value))
        else:
            bound = [(i, n) for i, n in enumerate(condition.nodes) if n.name in aliases]
            if len(bound) != 1 or bound[0][0] not in (0, len(condition.nodes) - 1):
                raise PatternError("NOT EXISTS needs exactly one known variable, at an end of its path")
            parts, hops = condition.nodes, condition.hops
            if bound[0][0]:
                parts, hops = parts[::-1], [Hop(h.name, h.kind, {"in": "out", "out": "in"}.get(h.direction, "both")) for h in hops[::-1]]
            found: DataFrame | None = None
            for k, hop in enumerate(hops, 1):
                step = _steps(edges, hop, 900 + k)
                found = step if found is None else found.join(step, F.col(f"_to{900 + k - 1}") == F.col(f"_from{900 + k}"))
                end = scope if parts[k].label is None else scope.where(F.col("kind").isin(*label_kinds(parts[k].label)))
                found = found.join(end.select(F.col("id").alias(f"_to{900 + k}")).distinct(), f"_to{900 + k}", "left_semi")
            starts = found.select(F.col("_from901").alias("_start")).distinct()
            plan = plan.join(starts, F.col(f"{alias_of(bound[0][1].name)}.id") == F.col("_start"), "left_anti")
    whole = [n for n, p in query.returns if p is None]
    columns: list[Column] = []
    for name, prop in query.returns:
        alias = alias_of(name)
        if prop is not None:
            columns.append(_property(alias, prop).alias(f"{name}_{prop}"))
        else:
            columns += [F.col(f"{alias}.{c}").alias(f"{name}_{c}" if len(whole) > 1 else c) for c in WHOLE]
    if query.order:
        name, prop, down = query.order
        key = _property(alias_of(name), prop)
        plan = plan.orderBy(key.desc_nulls_last() if down else key.asc_nulls_first())
    out = plan.select(*columns)
    return out if query.limit is None else out.limit(query.limit)


def run(text: str, nodes: DataFrame, edges: DataFrame, project_id: int | None = None) -> DataFrame:
    """The result of a query text over nodes and edges, of one project or of all."""
    return compile_query(parse(text), nodes, edges, project_id)
