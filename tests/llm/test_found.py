import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import cooccurrence, docpairs, encoding, handwritten, leakage, neardup, packing, ranking
from quarry.llm.syntax import parse

# --- 1: syntax ------------------------------------------------------------------------------------------

VALID = {
    "python": ["def f(a, *b, c=1, **d) -> int:\n    '''<<<<<<< in a string'''\n    return [x for x in a if x] or {**d}\n", "@d\nclass A(B):\n    x: int = 3\n    async def g(self):\n        async with a as b:\n            await b\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nfinally:\n    pass\n", "match x:\n    case [1, *r]:\n        pass\n", "x = lambda a, b=2: a if b else -a\n", "# only a comment\n"],
    "rust": ["pub fn f<'a, T: Clone>(x: &'a mut Vec<Option<T>>) -> Result<T, E> where T: Copy {\n    let y = match x { Some(v) if v > 1 => v, _ => return Err(e) };\n    for (i, c) in x.iter().enumerate() { println!(\"{}\", i); }\n    x.iter().map(|a| a + 1).collect::<Vec<_>>()\n}\n", "use a::{b, c::*};\n#[derive(Debug)]\nstruct P { x: u64 }\nimpl P { fn n(&self) -> u64 { self.x } }\n"],
    "go": ["package p\n\nimport (\n\t\"fmt\"\n)\n\nfunc (s *T) F(a int, b ...string) (int, error) {\n\tif x := g(); x > 1 {\n\t\treturn x, nil\n\t}\n\tfor i, v := range b {\n\t\tm[i] = T{A: v}\n\t}\n\tgo func() { ch <- 1 }()\n\tswitch a {\n\tcase 1:\n\t\tf()\n\tdefault:\n\t}\n\treturn 0, nil\n}\n"],
    "java": ["package a.b;\nimport java.util.*;\npublic class A<T extends B> extends C implements D {\n  private final Map<String, List<Integer>> m = new HashMap<>();\n  @Override public <R> R f(int a, String... b) throws E { for (var x : b) { m.get(x).add(1); } return a > 1 ? (R) x : y -> y.z(); }\n}\n"],
    "javascript": ["import { a as b } from './c'\nexport default async function* f(x = 1, { y, ...z }) {\n  const t = `a${x}b`\n  for await (const q of z) { if (q?.r) continue }\n  return x => ({ x, y: /re[/]x/g })\n}\nclass A extends B { #p = 1; static get q() { return this.#p } }\n", "const el = (<div a={b}>{c}</div>);\n"],
    "typescript": ["interface A<T> { x?: number; f(a: T): void }\nexport type B = { [k: string]: A<number> } | null;\nexport class C<T extends A<T>> { constructor(private readonly a: Map<string, T[]>) {} m(): asserts x is T { return <any>this.a as unknown as T; } }\nenum E { A = 1, B }\n"],
    "c": ["#include <stdio.h>\n#define X(a) (a)\ntypedef struct { int a; char *b[3]; } S;\nstatic int f(const char *a, ...) {\n  for (int i = 0; i < 3; i++) { a[i] = (char) 1; }\n  switch (x) { case 1: break; default: return -1; }\n  do { x->y = &z; } while (0);\n}\n"],
    "cpp": ["template <typename T>\nclass A : public B<T> {\npublic:\n  explicit A(std::vector<int> v) : v_(std::move(v)) {}\n  auto f() const -> int { for (auto& x : v_) { std::cout << x; } return [&](int a) { return a; }(1); }\n};\nnamespace a::b { using X = Y<int>; }\n"],
    "csharp": ["using System;\nnamespace A.B {\n  public class C<T> : D where T : class {\n    public int P { get; set; } = 1;\n    public async Task<int> F(string a, params int[] b) => await G(x => x.Y ?? 1);\n    void H() { foreach (var x in b) { Console.WriteLine($\"{x}\"); } }\n  }\n}\n"],
    "php": ["<?php\nnamespace A\\B;\nuse C\\{D, E};\nfinal class F extends G implements H {\n  public function __construct(private ?int $a = null) {}\n  public static function f(array $x): string { foreach ($x as $k => $v) { echo \"a{$v}\"; } return match($x) { 1 => 'a', default => fn($y) => $y }; }\n}\n?>\n<b>text { [</b>\n"],
}


@pytest.mark.parametrize("language", sorted(VALID))
def test_valid_sources_cost_nothing(language):
    for text in VALID[language]:
        assert parse.check(text, language).cost == 0, text
        assert parse.check(text.replace("\n", "\r\n"), language).cost == 0


@pytest.mark.parametrize("language", sorted(VALID))
def test_damage_is_found_and_told_apart(language):
    text = VALID[language][0]
    middle = text.index("\n", len(text) // 3) + 1
    conflict = text[:middle] + "<<<<<<< HEAD\n=======\n>>>>>>> other\n" + text[middle:]
    got = parse.check(conflict, language, thorough=True)
    assert got.cost and got.cause == "conflict"
    if language != "python":
        cut = parse.check(text.rstrip()[: text.rstrip().rindex("}") - 1].rstrip("}\n >?"), language)
        assert cut.cost


def test_other_languages_are_mismatches():
    assert parse.check(VALID["rust"][0], "java").cost and parse.check(VALID["python"][0], "go").cost and parse.check("# title\n\n- isn't code\n", "c").cost
    assert parse.check("", "go").cost == 0 and parse.check(None, "go").cost == 0 and parse.check("// only\n/* this */\n", "go").cost == 0
    assert parse.check("%%%", "cobol").cost == 0 and parse.language_of("a/b.TSX", None) == "typescript" and parse.language_of("x", None) is None


def test_python_agrees_with_its_own_parser():
    import ast

    rng = random.Random(4)
    base = "\n".join(VALID["python"])
    for _ in range(150):
        a, b = sorted(rng.sample(range(len(base)), 2))
        text = base[:a] + base[b if b - a < 12 else a + 3 :]
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if ok:
            assert parse.check(text, "python").cost == 0, text


def test_very_long_texts_end_soon():
    import time

    began = time.time()
    packed = "function a(b,c){" + "d(b&&c,e*f&g);" * 60_000 + "}"
    assert parse.check(packed, "javascript").cost == 0 and parse.check(packed[:-1], "javascript").cost
    assert parse.check("f(" * 3000 + ")" * 3000, "python").cost == 0
    assert docpairs.documented_functions("/* Keeps the order of rows. */\n" + packed, "a.js", "function a(b,c)", "a")[0][2]
    assert handwritten.content_reason(packed) == "minified"
    assert encoding.repair("あ" * 100_000, encoding.PairModel(*[__import__("numpy").zeros(1 << b, int) for b in (encoding.PAIR_BITS, encoding.CHAR_BITS)], 10))[1] == []
    assert time.time() - began < 60


def test_repair_counts_edits():
    got = parse.check("int f() { return 1 }\nint g() { return 2; }\n", "c", thorough=True)
    assert got.cost == 1
    assert parse.check("int f(int a] { return a; }\n", "c", thorough=True).unclosed == 1
    many = "int f() { " + "a = b; " * 900 + "return 1 }\n"
    assert parse.check(many, "c", thorough=True).cost == 1 and parse.check(many.replace("a = b;", "a = = b;", 3), "c", thorough=True).cost == 4


@pytest.mark.parametrize("seed", range(12))
def test_repair_is_the_least_of_all(seed):
    from quarry.llm.syntax.automata import Grammar, Repair

    rng = random.Random(seed)
    grammar = Grammar("file = (item ';')* item?\nitem = 'a' 'b'* | 'c' item 'd' | '(' list ')'\nlist = item (',' item)*", "a b ; ,")
    alphabet, words = ["a", "b", "c", "d", ";", ",", "(", ")"], [frozenset([x]) for x in "abcd;,()"]
    text = [rng.randrange(8) for _ in range(rng.randrange(0, 6))]
    accepts = lambda t: grammar.accepts("file", list(t), words)
    seen, frontier, cost = {tuple(text)}, [tuple(text)], 0
    while not any(map(accepts, frontier)):
        new = set()
        for t in frontier:
            new |= {t[:k] + t[k + 1 :] for k in range(len(t))}
            new |= {t[:k] + (alphabet.index(x),) + t[k + r :] for k in range(len(t) + 1) for r in (0, 1) if k + r <= len(t) for x in grammar.insertable}
        frontier, cost = list(new - seen), cost + 1
        seen |= new
    repair = Repair(grammar, "file", text, words)
    assert repair.least() == cost and len(repair.places()) == cost


MORE_VALID = {
    "javascript": "if (a)\n  b()\nelse\n  c()\n", "java": "class A { void f(List<? super T> x, Map<K, List<Set<Map<A, B>>>> y) { super.f(this); } }\n", "rust": "fn f() { let x = y.collect::<Result<Vec<_>, _>>(); let z: HashMap<A, Vec<Option<Arc<B>>>> = g(); }\n",
    "go": "package package\n\ntype T struct {\n\tf func(int) <-chan int\n\tg func(a func(b int) error) (int, error)\n}\n", "typescript": "class A { [key: string]: Map<string, Array<Set<Record<A, B<C>>>>>; x = 1; }\n",
    "cpp": "template <typename... T> auto f(T... a) { return (a + ...); }\ntemplate <typename T> concept C = requires(T t) { t.f(); { t.g() } -> D; typename T::x; };\nstd::map<int, std::vector<std::pair<int, std::set<A>>>> m;\n",
    "c": "int f(int a) __attribute__((pure));\nint g(void) { __asm__ volatile (\"nop\" : : \"r\"(a) : \"memory\"); return 0; }\n", "csharp": "class A { Dictionary<string, List<Dictionary<int, List<A>>>> m; }\n",
}


@pytest.mark.parametrize("language", sorted(MORE_VALID))
def test_less_common_constructs_are_valid(language):
    assert parse.check(MORE_VALID[language], language).cost == 0


# --- 2: documentation ------------------------------------------------------------------------------------

@pytest.mark.parametrize("text", ["", "/** */", "TODO", "to be documented later", "@param x the x\n@return y", "Scans the registry.", "scan_registry", "/// # Panics", "noinspection X", "pylint: disable=all-of-it", "Function scanRegistry.", "The scan registry function", "<inheritdoc/>", "******", "Two words", "Description goes here", ":param a: first of all things"])
def test_trivial_documentation(text):
    assert docpairs.is_trivial(text, "scanRegistry", "function")


@pytest.mark.parametrize("text", ["Scans the registry twice for stale rows.", "/**\n * Never waits for readers.\n * @param a b\n */", "TODO: split this up.\nOnly local rows are touched.", "<summary>Keeps the order of rows.</summary>", "Liefert den Knoten zum Baum."])
def test_telling_documentation(text):
    assert not docpairs.is_trivial(text, "scanRegistry", "function")


def test_candidates_are_linked_to_the_right_function():
    source = "# Reads all the rows.\n@cached\ndef a(x):\n    # not this comment here\n    def b():\n        '''Inner text of b.'''\n    return 1\n"
    got = docpairs.documented_functions(source, "f.py", "def a(x):", "a")
    assert got[0][0] == "a" and got[0][2] == ["# Reads all the rows."]
    assert docpairs.documentation("fn a() {\n    // inside the body only\n}\n", "f.rs", "fn a()", "a", "function", None) is None
    assert docpairs.documentation("/* Far above, of another thing. */\n\n\n\n\nint a() {\n}\n", "f.c", "int a()", "a", "function", " ") is None
    assert docpairs.assign([[1.0, 0.0], [0.0, 5.0]]) == [1, 0]


def test_delivered_comments_enter_the_matching():
    source = "/* Reads all rows twice. */\nint a() {\n}\n"
    assert docpairs.documented_functions(source, "f.c", "int a()", "a", "Keeps the order of rows.")[0][2] == ["Keeps the order of rows."]
    nested = "function a() {\n/* Opens the inner gate. */\nfunction b() {\n}\n}\n"
    assert [t for _, _, t in docpairs.documented_functions(nested, "f.js", "function a()", "a", "Keeps the order.")] == [["Keeps the order."], ["/* Opens the inner gate. */"]]


def test_functions_on_very_long_lines_and_of_long_files():
    import time

    packed = "/* Keeps the order of rows. */\nfunction a(b,c){" + "d(b&&c,e*f&g);" * 300 + "}/* Counts what is left. */function z(q){return q}"
    got = {n: t for n, _, t in docpairs.documented_functions(packed, "a.js")}
    assert got["a"] == ["/* Keeps the order of rows. */"] and got["z"] == ["/* Counts what is left. */"]
    c_line = "/* Keeps the order of rows. */\nint a(int b) { " + "f(b); " * 400 + "}\n"
    assert docpairs.documented_functions(c_line, "a.c")[0][0::2] == ("a", ["/* Keeps the order of rows. */"])
    wide = "/** Adds. @param last x */\nint a(" + ", ".join(f"int p{k}" for k in range(90)) + ", int last) {\n}\n"
    assert docpairs.documented_functions(wide, "a.c")[0][2]
    began = time.time()
    many = "".join(f"// Keeps row {k} in order.\nfunction f{k}(a) {{\n  return a;\n}}\n" for k in range(4000))
    assert all(len(t) == 1 for _, _, t in docpairs.documented_functions(many, "a.js")) and time.time() - began < 20


def test_documented_pairs_with_nulls_and_extra_columns(spark):
    cols = "id long, kind string, file_path string, name string, signature string, doc_comment string, source string, node_id long"
    rows = [(1, "function", None, None, None, "Keeps the order of rows.", "x", 9), (1, "function", None, None, None, "Keeps the order of rows.", "x", 9), (2, "method", "a.py", "f", None, None, "", 9), (3, "class", "a", "f", "s", "Keeps the order of rows.", "x", 9), (None, "function", "a", "f", "s", "Keeps the order of rows.", "x", 9), (4, "function", "a.py", "f", "def f():", "", "def f():\r\n    '''Keeps the order of rows.'''\r\n", 9)]
    got = docpairs.documented_pairs(spark.createDataFrame(rows, cols)).collect()
    assert sorted(r.node_id for r in got) == [1, 4]
    assert docpairs.documented_pairs(spark.createDataFrame([], cols)).count() == 0


# --- 4: ranking --------------------------------------------------------------------------------------------

def brute_flow(rows, q, p):
    out = [0.0] * len(rows)
    for f in range(len(rows[0])):
        values = [r[f] if r[f] is not None else float("-inf") for r in rows]
        rank = [(sum(v < x for v in values) + sum(v == x for v in values) / 2) / len(values) for x in values]
        pref = lambda d: min(max((d - q) / (p - q), 0.0), 1.0)
        for i in range(len(rows)):
            out[i] += sum(pref(rank[i] - r) - pref(r - rank[i]) for r in rank) / max(1, len(rows) - 1) / len(rows[0])
    return out


def test_net_flow_against_brute_force(spark):
    rng = random.Random(1)
    factors = [(rng.choice([None, 0.0, -0.0, 1e-9, rng.random(), 1e12, -3.0]), rng.choice([None, 0, 1, 2, 10**9]), rng.randrange(4), rng.randrange(1000)) for _ in range(40)]
    data = [(1, i, *f) for i, f in enumerate(factors)] * 2 + [(2, 5, None, None, 1, 1)]
    df = spark.createDataFrame(data, "plan_id long, node_id long, pagerank double, blast_radius_files long, git_churn long, complexity long").withColumn("flow", F.lit("clash")).withColumn("n", F.lit(0))
    got = {(r.plan_id, r.node_id): r.net_flow for r in ranking.net_flows(df).collect()}
    want = brute_flow(factors, ranking.INDIFFERENCE, ranking.PREFERENCE)
    assert all(got[1, i] == pytest.approx(w, abs=1e-9) for i, w in enumerate(want)) and got[2, 5] == 0
    assert ranking.top_targets(ranking.net_flows(df)).where("plan_id = 1").count() == 5
    assert ranking.net_flows(df.limit(0)).count() == 0


def test_extreme_values_do_not_win(spark):
    rows = [(1, 0, 1e9, 0, 0, 0), *[(1, i, i / 100, i, i, i) for i in range(1, 41)]]
    df = spark.createDataFrame([(*map(int, r[:2]), float(r[2]), *map(int, r[3:])) for r in rows], "plan_id long, node_id long, pagerank double, blast_radius_files long, git_churn long, complexity long")
    assert {r.node_id for r in ranking.top_targets(ranking.net_flows(df)).collect()} == {36, 37, 38, 39, 40}


# --- 5: co-occurrence ----------------------------------------------------------------------------------------

def test_cooccurrence_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "SEGMENT_BASKETS", 3)
    monkeypatch.setattr(cooccurrence, "BUFFER_PAIRS", 20)
    rng = random.Random(6)
    data, baskets = [], {}
    for b in range(60):
        items = {0} | set(rng.sample(range(1, 14), rng.randrange(1, 6))) if b % 3 == 0 else set(rng.sample(range(1, 14), rng.randrange(1, 6)))
        baskets[b] = items
        data += [(1, f"H{b}" if rng.random() < 0.5 else f"h{b}", i) for i in items for _ in range(rng.randrange(1, 3))]
    data += [(1, "big", i) for i in range(60)] + [(1, None, 1), (1, "h0", None)]
    df = spark.createDataFrame(data, "project_id long, commit_hash string, node_id long").withColumn("item", F.lit(1))
    got = {(r.node_a, r.node_b): (r.count_a, r.count_b, r.together, r.baskets) for r in cooccurrence.together(df).collect()}
    count = lambda *xs: sum(all(x in s for x in xs) for s in baskets.values())
    want = {(a, b): (count(a), count(b), count(a, b), 60) for a in range(14) for b in range(a + 1, 14) if count(a, b)}
    assert got == want
    assert cooccurrence.together(df.limit(0)).count() == 0


def test_significance_decides_where_conditions_are_weak(spark):
    cols = "node_a long, node_b long, count_a long, count_b long, together long, baskets long, llr double"
    import math

    def llr(a, b, k, n):
        cells = [(k, a * b), (a - k, a * (n - b)), (b - k, (n - a) * b), (n - a - b + k, (n - a) * (n - b))]
        return 2 * sum(x * math.log(x * n / e) for x, e in cells if x and e)

    rows = [(1, 2, 10, 12, 2, 100, llr(10, 12, 2, 100)), (3, 4, 10, 12, 6, 100, llr(10, 12, 6, 100))]
    got = cooccurrence.beyond_chance(spark.createDataFrame(rows, cols), min_together=2, min_lift=1).collect()
    assert [(r.node_a, r.node_b) for r in got] == [(3, 4)]
    weakest = min(llr(a, b, k, n) for n in (8, 20, 50, 200, 1000, 20_000) for k in range(4, 40) for a in range(k, n, max(1, n // 60)) for b in range(k, n, max(1, n // 60)) if k * n >= 3 * a * b and a + b - k <= n)
    assert weakest >= cooccurrence.SIGNIFICANT


# --- 6: files not written by hand ---------------------------------------------------------------------------

@pytest.mark.parametrize(("text", "want"), [
    ("// Code generated by x. DO NOT EDIT.\npackage a\n", "generated"), ("# Not generated: please edit this file freely.\nx = 1\n", None), ("// Maintained by hand; the generated stubs live elsewhere.\nint a;\n", None),
    ("// Do not edit offset values without a review.\nint a;\n", None), ("// Bundled copy of x 1.2.\nint a;\n", "vendored"), ("x = [1, 2, 3]\n" * 2 + "def f():\n    return x\n", None),
    ("T = [\n" + "  0x1f, 22, 33,\n" * 60 + "]\n", "data"), ("function a(b){" + "c(b);" * 200 + "}\n", "minified"), (None, None), ("", None), ("// x\n" + "// Code generated by x. DO NOT EDIT.\n", "generated"),
])
def test_content_evidence(text, want):
    assert handwritten.content_reason(text) == want


def test_paths_and_attributes(spark):
    node = "id long, project_id long, kind string, file_path string, source string, content string"
    f = lambda i, path, source="int a;\n", project=1: (i, project, "file", path, source, "clash")
    rows = [f(1, "/srv/vendor/p/src/a.c"), f(2, "/srv/vendor/p/vendor/a.c"), f(3, "/srv/vendor/p/vendors/a.c"), f(4, "src\\node_modules\\x\\a.js"), f(5, None), f(6, "x.min.js", None), f(2, "/srv/vendor/p/vendor/a.c"),
            f(7, "lib/.gitattributes", "*.c linguist-generated\nkeep/** -linguist-generated\n"), f(8, "lib/z.c"), f(9, "lib/keep/z.c"), f(10, "other/z.c"), f(11, "lib/vendor/z.h"), f(12, "lib/keep/vendor/q.c"), f(13, "x.c", "int a;\n", None)]
    projects = spark.createDataFrame([(1, "/srv/vendor/p/")], "id long, root_path string")
    got = {r.id: r.reason for r in handwritten.not_handwritten(spark.createDataFrame(rows, node), projects).collect()}
    assert got == {2: "convention", 4: "convention", 6: "convention", 8: "declared", 11: "convention"}
    assert handwritten.not_handwritten(spark.createDataFrame([], node), projects).count() == 0


def test_attribute_files_of_declared_repositories(spark):
    node = "id long, project_id long, kind string, file_path string, source string"
    f = lambda i, path, source="int a;\n": (i, 1, "file", path, source)
    text = 'vendor/** linguist-vendored\nvendor/** -linguist-generated\n"with blank/*.c" linguist-generated\nbuild/ linguist-generated\nout/* linguist-generated=true\nout/keep.c !linguist-generated\nthird_party/own/** -linguist-vendored\n*.x.js linguist-generated\n# *.h linguist-generated\ndocs linguist-generated\n'
    rows = [f(1, ".gitattributes", text), f(2, "vendor/a/b.c"), f(3, "with blank/a.c"), f(4, "build/a.c"), f(5, "out/a.c"), f(6, "out/keep.c"), f(7, "third_party/own/a.c"), f(8, "third_party/other/a.c"), f(9, "src/q.x.js"), f(10, "a.h"), f(11, "src/docs"), f(12, "out/deep/a.c")]
    got = {r.id: r.reason for r in handwritten.not_handwritten(spark.createDataFrame(rows, node), spark.createDataFrame([(1, "/p")], "id long, root_path string")).collect()}
    assert got == {2: "declared", 3: "declared", 5: "declared", 8: "convention", 9: "declared", 11: "declared"}


def test_patterns_are_mined_from_declared_and_marked_files(spark):
    node = "id long, project_id long, kind string, file_path string, source string"
    rows, number = [], 0

    def add(project, path, source="int a;\n"):
        nonlocal number
        number += 1
        rows.append((number, project, "file", path, source))
        return number

    for p in range(1, 6):
        add(p, ".gitattributes", "autocode/** linguist-generated\n")
        for k in range(4):
            add(p, f"autocode/{k}.c")
            add(p, f"vendor/{k}.c", "// Snapshot of the widget library kept as is\nint a;\n")
            add(p, f"lib/gen{k}.c", "// Code generated by x. DO NOT EDIT.\nint a;\n")
            add(p, f"vendor/gen{k}.c", "// Code generated by x. DO NOT EDIT.\nint a;\n")
            for j in range(4):
                add(p, f"src/{k}{j}.c", "// Licensed under the usual terms\nint a;\n")
    by_path, by_comment, plain = add(9, "autocode/z.c"), add(9, "src/z.c", "// Snapshot of the widget library kept as is\nint b;\n"), add(9, "src/y.c", "// Licensed under the usual terms\nint b;\n")
    projects = spark.createDataFrame([(p, f"/p{p}") for p in range(1, 10)], "id long, root_path string")
    got = {r.id: r.reason for r in handwritten.not_handwritten(spark.createDataFrame(rows, node), projects).collect()}
    assert got[by_path] == "mined path" and got[by_comment] == "mined comment" and plain not in got


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.c", "a.c", True), ("a/*.c", "a/b/c.c", False), ("a/**/c.c", "a/b/d/c.c", True), ("/x", "x", True), ("d/**", "d/e/f", True), ("[ab].c", "b.c", True), ("?.c", "ab.c", False)])
def test_globs(glob, path, hit):
    regex, base = handwritten.glob_to_regex(glob)
    assert bool(re.search(regex, path.rsplit("/", 1)[-1] if base else path)) == hit


# --- 7: near-duplicates ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("long_list", [2, 200])
def test_near_duplicates_against_brute_force(spark, monkeypatch, long_list):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup.candidates, "__defaults__", (long_list, *neardup.candidates.__defaults__[1:]))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words[:40]) for _ in range(30)] + [rng.choice(words) for _ in range(rng.randrange(15, 60))]
        for _ in range(rng.randrange(1, 5)):
            edited = [rng.choice(words) if rng.random() < rng.choice([0, 0.02, 0.08]) else w for w in base]
            texts.append(" ".join(edited))
    texts += [texts[0]] * 3 + ["short text", ""]
    rows = [(i, rng.choice(["function", "method"]), t) for i, t in enumerate(texts)] + [(900, "file", texts[0]), (901, "function", None), (0, "function", texts[0])][:2]
    df = spark.createDataFrame(rows, "id long, kind string, source string").withColumn("rep", F.lit(1))
    sets = {i: set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for i, t in enumerate(texts) if len(t.split()) >= 40}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    links, members = neardup.near_duplicates(df)
    assert {tuple(r) for r in neardup.all_pairs(links, members).collect()} == want
    assert len({r.group_id for r in neardup.groups(links, members).collect()}) <= len(sets)


def test_a_hot_list_is_spread_over_blocks(spark, monkeypatch):
    """Records that share boilerplate and are not similar meet in long lists; they are told apart there, and copies are kept."""
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(40)]
    texts = [" ".join(shared + [f"u{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(300)]
    texts += [texts[5].rsplit(" ", 3)[0] + " x y z", texts[7], texts[7]]
    df = spark.createDataFrame([(i, "function", t) for i, t in enumerate(texts)], "id long, kind string, source string")
    got = {tuple(r) for r in neardup.all_pairs(*neardup.near_duplicates(df)).collect()}
    assert got == {(5, 300), (7, 301), (7, 302), (301, 302)}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id long, kind string, source string")
    assert neardup.all_pairs(*neardup.near_duplicates(df)).count() == 0


# --- 8: packing -----------------------------------------------------------------------------------------------------

def test_packing_holds_every_rule(spark):
    rng = random.Random(9)
    items = [(i, rng.choice([0, 1, 30, 700, 1500, 2048, 5000]), rng.randrange(3), rng.randrange(40)) for i in range(400)]
    df = spark.createDataFrame(items, "doc_id long, tokens long, source long, cluster long")
    got = packing.packed(df, shard_items=150).collect()
    fill, clusters, sizes = {}, {}, {}
    cluster = {i: c for i, _, _, c in items}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.tokens
        clusters.setdefault(r.container, []).append(cluster[r.doc_id])
    assert max(fill.values()) <= 2048 and sizes == {i: t for i, t, _, _ in items}
    assert all(len(c) == len(set(c)) for c in clusters.values())
    assert all(sum(r.doc_id == i for r in got) == max(1, -(-t // 2048)) for i, t, _, _ in items)
    assert packing.packed(df.limit(0)).count() == 0


def test_measuring(spark):
    rows = spark.createDataFrame([(1, "hello world", "s"), (1, "hello world", "s"), (2, None, None), (3, "", "s"), (None, "x", "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.tokens for r in packing.measured(rows).collect()} == {1: len(packing.tokenizer().encode_ordinary("hello world")), 2: 0, 3: 0}


# --- 9: leakage -------------------------------------------------------------------------------------------------------

def test_leaks_against_brute_force(spark):
    rng = random.Random(10)
    words = [f"wort{i}" for i in range(80)] + ["Straße", "日本", "naïve", "x1"]
    passage = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, passage(rng.choice([10, 16, 40]))) for i in range(12)]
    docs = []
    for d in range(60):
        text = passage(rng.randrange(0, 80))
        if d % 2:
            item = rng.choice(items)[1]
            take = rng.choice([15, 16, 17, 40])
            start = rng.randrange(max(1, len(item) - take + 1))
            text = text[:20] + item[start : start + take] + text[20:]
        docs.append((d, rng.choice([" ", "_", " - ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in text)))
    docs += [(100, None), (101, ""), (1, docs[1][1])]
    fold = lambda ws: [w.casefold() for w in ws]
    index = {}
    for i, p in items:
        for k in range(len(p) - 15):
            index.setdefault(tuple(fold(p)[k : k + 16]), set()).add(i)
    want = set()
    for d, t in docs:
        w = fold(re.findall(r"[^\W_]+", t or ""))
        want |= {(d, i) for k in range(len(w) - 15) for i in index.get(tuple(w[k : k + 16]), ())}
    documents = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    table = spark.createDataFrame([(i, " ".join(p)) for i, p in items] + [(50, None)], "item_id long, passage string")
    assert {tuple(r) for r in leakage.leaked_pairs(leakage.leaks(documents, table, block_words=60)).collect()} == want
    assert leakage.leaks(documents.limit(0), table).count() == 0 and leakage.leaks(documents, table.limit(0)).count() == 0


def test_whole_items_and_weighted_similarity(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, passage(n)) for i, n in enumerate([5, 16, 23, 40, 40])]
    docs = [(10 + i, " ".join(passage(30) + p + passage(30))) for i, p in items] + [(99, " ".join(passage(200)))]
    table = spark.createDataFrame([(i, " ".join(p)) for i, p in items] + [(7, ""), (8, None)], "item_id long, passage string")
    got = {(r.doc_id, r.item_id): r.similarity for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), table, window=None).collect()}
    assert got == {(10 + i, i): 1.0 for i, _ in items}

    import numpy as np

    index = leakage.ItemIndex([(1, " ".join(items[3][1])), (2, " ".join(items[4][1] + items[3][1][:9]))], 16, 3)
    known = leakage._Hashes()
    hashes = lambda ws: leakage.word_hashes(" ".join(ws), known)
    grams = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
    other = items[3][1][:14] + passage(2)
    weight = lambda g: 1 / max(1, sum(g in grams(p) for p in (items[3][1], items[4][1] + items[3][1][:9])))
    a, b = grams(other), grams(items[3][1][:16])
    similarity, equal = index.verify(hashes(other), np.array([0]), np.array([0]))
    assert similarity[0] == pytest.approx(sum(map(weight, a & b)) / sum(map(weight, a | b))) and not equal[0]


def test_repeated_words_do_not_multiply():
    import time

    import pyarrow as pa

    began = time.time()
    index = leakage.ItemIndex([(1, "la " * 400), (2, "la le " * 200)], 16, 3)
    batch = pa.RecordBatch.from_pydict({"doc_id": [5], "text": ["la " * 20_000]})
    rows = [r for b in leakage._search([index], iter([batch]), 0.8) for r in b.to_pylist()]
    assert rows == [{"doc_id": 5, "item_id": 1, "windows": 19_985 * 385, "equal_windows": 19_985 * 385, "similarity": 1.0}] and time.time() - began < 2


@pytest.mark.parametrize("window", [1, 2, 3, 7, 16, 24, 40])
def test_fingerprints_against_counting(window):
    import numpy as np

    words = np.random.default_rng(3).integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2)
    bits = (words[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    want = [sum(1 << b for b in range(64) if bits[k : k + window, b].sum() * 2 > window) for k in range(61 - window)]
    assert leakage.fingerprints(words, window).tolist() == want


def test_fingerprints_do_not_depend_on_blocks():
    import numpy as np

    words = np.random.default_rng(2).integers(0, 2**63, 500).astype(np.uint64)
    whole = leakage.fingerprints(words, 16)
    assert len(whole) == 485 and all((leakage.fingerprints(words, 16, b) == whole).all() for b in (1, 7, 484, 485, 486))


def test_fingerprints_within_the_radius_are_all_found():
    import numpy as np

    rng = np.random.default_rng(1)
    index = leakage.ItemIndex([(1, " ".join(f"a{i}" for i in range(200)))], 16, 3)
    for _ in range(200):
        k = int(rng.integers(len(index.print)))
        flipped = index.print[k]
        for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            flipped ^= np.uint64(1) << np.uint64(bit)
        assert k in index.candidates(np.array([flipped]))[1]


# --- 10: encodings ------------------------------------------------------------------------------------------------------

CLEAN = ["Größere Schlüssel über den Zähler ändern – „später“.", "Le schéma a été déplacé à côté du numéro … déjà vu.", "Żółć gęślą jaźń, łańcuch się zakończy.", "Каждый узел проверяется после того, как блок обновлён.", "新しい経路は履歴に依存しません。関数を再実行。", "naïve café 30 °C ± 2 × 4 → “quoted” ‘word’ it’s fine", "NÃO REMOVA O CORAÇÃO SEM AVISAR", "plain ascii"]


def test_garbled_texts_are_found_and_restored(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(CLEAN) + " " + rng.choice(CLEAN)) for i in range(400)]
    broken = {}
    for i, (wrong, times) in enumerate([("cp1252", 1), ("latin-1", 1), ("cp437", 1), ("mac_roman", 1), ("cp1251", 1), ("cp1252", 2)]):
        text = "Der naïve Größenwert – “später” gelöscht, déjà vu." if wrong != "cp1252" else "Größe über den café schlüssel – Ende"
        bad = text
        for _ in range(times):
            bad = "".join(bytes([b]).decode(wrong, "replace") if bytes([b]).decode(wrong, "replace") != "�" else chr(b) for b in bad.encode("utf-8"))
        broken[1000 + i] = (text, "Clean part: Größe. " + bad)
    rows = docs + [(k, b) for k, (_, b) in broken.items()] + [(2000, None), (2001, ""), (2002, "Le sch�ma est d�plac�"), (1000, broken[1000][1])]
    got = {r.doc_id: r for r in encoding.garbled(spark.createDataFrame(rows, "doc_id long, text string").withColumn("restored", F.lit(1))).collect()}
    assert set(got) == {*broken, 2002}
    assert all(got[k].restored.endswith(t) for k, (t, _) in broken.items()) and got[2002].lost
    assert encoding.garbled(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("language", ["es", "fr", "ru"])
@pytest.mark.parametrize("clean_too", [True, False])
def test_a_third_of_the_rows_garbled_alike_does_not_hide_itself(spark, language, clean_too):
    words = {"es": "función año después también según niño vacía más petición índice", "fr": "déjà créé où façon élève être modèle forêt clé préféré", "ru": "каждый узел проверяется после того блок обновлён затем снова"}[language].split()
    rng = random.Random(7)
    make = lambda: " ".join(rng.choice([*words, "node", "value"]) for _ in range(12))
    garbled = {i: make() for i in range(200)}
    others = [(1000 + i, make() if clean_too else rng.choice(CLEAN[2:5])) for i in range(400)]
    rows = [(i, t.encode("utf-8").decode("latin-1")) for i, t in garbled.items()] + others
    got = {r.doc_id: r.restored for r in encoding.garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t for i, t in garbled.items() if not t.isascii()}


@pytest.mark.parametrize("seed", range(20))
def test_maximal_segments_against_brute_force(seed):
    import numpy as np

    rng = random.Random(seed)
    values = [rng.choice([-4, -3, -1, 0, 1, 2, 5]) for _ in range(rng.randrange(0, 14))]

    def maximal(low, high):
        """By definition: the best segment of a range, the shortest of equals, then those left and right of it."""
        best = max(((sum(values[i:j]), i - j, i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        return [*maximal(low, best[2]), (best[2], best[3]), *maximal(best[3], high)]

    got = encoding.maximal_segments(np.array(values, float))
    score = lambda segments: [sum(values[i:j]) for i, j in segments]
    assert score(got) == score(maximal(0, len(values))) and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
    assert encoding.maximal_segments(np.array([5.0, -4.0, 1.0])) == [(0, 1), (2, 3)]


def test_text_garbled_many_times_is_restored():
    text = bad = "Größenänderung für Schlüssel"
    for _ in range(6):
        bad = bad.encode("utf-8").decode("latin-1")
    model = encoding.PairModel(*[__import__("numpy").zeros(1 << b, int) for b in (encoding.PAIR_BITS, encoding.CHAR_BITS)], 10)
    assert encoding.repair(bad, model)[0] == text


def test_runs_of_clean_texts_that_happen_to_be_utf8_stay():
    model = encoding.PairModel(*[__import__("numpy").zeros(1 << b, int) for b in (encoding.PAIR_BITS, encoding.CHAR_BITS)], 10)
    for text in ("L’été, l’étang, l’écran, d’Évian", "Её узел и её блок, рад, сам, так", "исправлен только счётчик", "только", "„Spaß“ und „groß“ und „süß“, „Spaß“", "│ ├─ a\n│ └─┐ b ─┤"):
        assert encoding._evident_repair(text) == (text, []) and not encoding.repair(text, model)[1]


def _shown_as_ascii():
    russian, japanese = "Каждый узел проверяется после того, как блок обновлён.", "新しい経路は履歴に依存しません"
    one_byte = lambda text, encoding: text.encode(encoding).decode("latin-1")
    return {
        "utf-16": (russian, one_byte(russian, "utf-16-le")), "utf-16-be": (russian, one_byte(russian, "utf-16-be")), "utf-32": (russian, one_byte(russian, "utf-32-le")),
        "latin utf-16": ("the block was updated", one_byte("the block was updated", "utf-16-le")), "utf-16 inside": ("see: каждый узел (node)", "see: " + one_byte("каждый узел", "utf-16-le") + " (node)"),
        "utf-16 of ascii only": ("こたえはここに", one_byte("こたえはここに", "utf-16-be")),
        "iso-2022-jp": (f"see {japanese} here", f"see {one_byte(japanese, 'iso2022_jp')} here"), "escapes lost": (f"see {japanese}.", f"see {one_byte(japanese, 'iso2022_jp')}.".replace("\x1b", "")),
        "iso-2022-kr": ("node 안녕 세계", one_byte("node 안녕 세계", "iso2022_kr")), "hz": ("node 这个函数返回", one_byte("node 这个函数返回", "hz")),
        "utf-7": ("Größe und Schlüssel für später, déjà", one_byte("Größe und Schlüssel für später, déjà", "utf-7")), "utf-7 words": ("узел node", one_byte("узел node", "utf-7")),
        "twice": ("Größe und Schlüssel für später, déjà", one_byte(one_byte("Größe und Schlüssel für später, déjà", "utf-8"), "utf-7")),
    }


def test_texts_of_ascii_are_read_too(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([*CLEAN, "こたえはここにある", "a plain text of ascii"]) + " " + rng.choice(CLEAN)) for i in range(300)]
    cases = {1000 + i: case for i, case in enumerate(_shown_as_ascii().values())}
    assert all(bad.isascii() for _, bad in cases.values())
    lost = "see \x1b$B?7$7\x7f\x1b(B"
    rows += [(k, bad) for k, (_, bad) in cases.items()] + [(2000, lost), (2001, "plain"), (2002, ""), (2003, None), (None, cases[1000][1])]
    found = encoding.garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.restored for r in found if r.doc_id != 2000} == {k: text for k, (text, _) in cases.items()}
    assert len(found) == len(cases) + 1


def test_all_texts_vote(spark):
    rows = [(1, "plain"), (None, "plain"), (2, "Größe"), (3, ""), (4, None)]
    model = encoding.fit_pairs(spark.createDataFrame(rows, "doc_id long, text string").where("text is not null"))
    assert (model.documents, model.beyond) == (4, 1)


@pytest.mark.parametrize("text", [
    "\x1b[31mred\x1b[0m and \x1b[1;32mgreen\x1b[0m", "N\x08NA\x08AM\x08ME\x08E _\x08n_\x08a", "page one\x0cpage two\x0c", "a\0b\0src/main.c\0src/lib.c\0", "\0\0\0\0\0\0\0\0", "C++ and a+b+c, REST+API, +49 301234567, x+AND-y",
    "(format t \"~{~a~^, ~}~%\" items) ~{<~a>~}", "$BASE/bin(B) $BUILD_DIR(B) cost$B2(B", "+Assert\n+foo\n-bar", "sha512-9Jn+ABCd/efGhIjKlMnOpQrStUv+wxyz0123456789abcdefg==", "q\0", "x", "zq xj vk", "\x0e>H3g\u3000\x0f",
])
def test_clean_texts_of_ascii_stay(text):
    model = encoding.PairModel(*[__import__("numpy").zeros(1 << b, int) for b in (encoding.PAIR_BITS, encoding.CHAR_BITS)], 10)
    assert encoding.repair(text, model) == (text, [], False)


def test_long_texts_of_ascii_end_soon():
    import time

    model = encoding.PairModel(*[__import__("numpy").zeros(1 << b, int) for b in (encoding.PAIR_BITS, encoding.CHAR_BITS)], 10)
    start = time.time()
    for unit in ("$B", "~{a", "+", "\x1b$B", "\x0e", "(B", "$B(B", "a\0", "\0", "\x01a\x02"):
        encoding.repair(unit * 50_000, model)
    assert time.time() - start < 30
