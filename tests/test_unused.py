"""Edits, tokens, removal of unused declarations and renaming of unused bindings."""

import random

import pytest
from pyspark.sql import functions as F

from codesieve.operators import unused
from codesieve.operators.edits import Edits, apply_edits
from codesieve.operators.tokens import Tokens
from codesieve.plans import captured, registry
from codesieve.sources.corpus import synthetic_corpus

TARGETS = "project string, path string, line long, column long, name string, kind string"


def place(source, token, skip=0):
    at = source.index(token) + skip
    return source.count("\n", 0, at) + 1, at - (source.rfind("\n", 0, at) + 1) + 1


def removed(source, *names):
    return unused.remove_declarations(source, [(*place(source, n), n, "variable") for n in names])


# Edits


def test_edits_refuse_overlaps_and_merge_deletions():
    e = Edits("0123456789")
    assert e.replace(2, 4, "ab") and e.replace(2, 4, "ab") and not e.replace(3, 5, "x") and not e.delete(1, 3)
    assert e.delete(5, 7) and e.delete(6, 8) and e.delete(8, 9) and e.accepted == [(2, 4, "ab"), (5, 9, "")]
    assert e.replace(5, 5, "+") and not e.replace(5, 5, "-") and not e.replace(6, 6, "-") and not e.replace(7, 20, "") and not e.replace(-1, 2, "")
    assert e.replace(4, 4, "^") and e.replace(9, 10, "Z") and e.apply() == "01ab^4+Z"
    assert Edits("").apply() == ""


@pytest.mark.parametrize("seed", range(30))
def test_edits_are_those_of_a_plain_splice(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices("abc\n", k=40))
    e, taken, deleted, put = Edits(text), set(), set(), {}
    for _ in range(25):
        start = rng.randrange(40)
        end, new = rng.randint(start + 1, min(40, start + 6)), rng.choice(["", "X", "YY"])
        own = set(range(start, end))
        fits = (put.get(start) == (end, new)) or not own & (taken if not new else taken | deleted)
        assert e.replace(start, end, new) == fits
        if fits and new:
            put[start] = (end, new)
            taken |= own
        elif fits:
            deleted |= own
    out = "".join(put[k][1] if k in put else "" if k in taken | deleted else c for k, c in enumerate(text))
    assert e.apply() == out


def test_deleted_lines_and_the_last_one():
    for gone, left in (((2, 0), "b"), ((1, 2), "a"), ((0, 1), "c"), ((0, 1, 2), ""), ((1,), "a\nc"), ((), "a\nb\nc")):
        e = Edits("a\nb\nc")
        for i in gone:
            e.delete_lines(i, i)
        assert e.apply() == left
    e = Edits("a\nb\n")
    e.delete_lines(1, 1)
    assert e.apply() == "a\n"


def test_edits_in_spark(spark):
    files = spark.createDataFrame([("p", "a.ts", "one two"), ("p", "b.ts", None), ("p", "c.ts", "x")], "project string, path string, content string")
    edits = spark.createDataFrame([("p", "a.ts", 0, 3, "1"), ("p", "a.ts", 2, 5, "no"), ("p", "a.ts", 4, 7, "2"), ("q", "a.ts", 0, 1, "")], "project string, path string, start int, end int, new string")
    assert {r.path: r.content for r in apply_edits(files, edits).collect()} == {"a.ts": "1 2", "b.ts": None, "c.ts": "x"}


# Tokens


def test_tokens_lose_nothing():
    source = "const a = `x${ {b: `y${c}`} }z`; // note\nlet r = a / b / c, s = /[/]\\/x/g; /* open ( */ f('it\\'s', \"q\")\n{ ] }"
    t = Tokens(source)
    covered = set()
    for a, b in [*zip(t.start, t.end, strict=True), *t.comments]:
        covered.update(range(a, b))
    assert "".join(c for k, c in enumerate(source) if k not in covered).strip() == ""
    assert "/[/]\\/x/g" in t.text and t.text.count("/") == 2 and t.broken
    assert t.pair[t.text.index("]")] == -1 and not Tokens(source.replace("{ ] }", "{ }")).broken
    for bad in ("'open", "`open", "/* open", "(", "}", "`${a", '"a\nb"'):
        assert Tokens(bad).broken, bad
    assert not Tokens("").broken and Tokens("a ﻿b").text == ["a", "b"]


def test_tokens_are_linear():
    import time

    began = time.perf_counter()
    for bad in ("(" * 200_000, "([{" * 60_000 + "}", "'" * 200_000, "`${" * 60_000, "/*" * 100_000, "a<" * 100_000, "function f(" * 30_000, "x => " * 60_000):
        list(unused.declarations(Tokens("const q = " + bad)))
    assert time.perf_counter() - began < 30


# Declarations


@pytest.mark.parametrize(
    "name, gone",
    [
        ("unusedFn", "const unusedFn = (x: number): number => {\n\treturn x * 2;\n};\n"),
        ("unusedFoo", "function unusedFoo() {\n\treturn 42;\n}\n"),
        ("Gone", "class Gone {\n\tgreet() {\n\t\treturn 'hi';\n\t}\n}\n"),
        ("Alias", "type Alias = string | number;\n"),
        ("Iface", "interface Iface {\n\tid: string;\n}\n"),
        ("Enum", "enum Enum {\n\tA,\n\tB,\n}\n"),
        ("CEnum", "const enum CEnum { A }\n"),
        ("aid", "/**\n * A helper that's not used.\n */\nconst aid = (x: number) => x + 1;\n"),
        ("twoNotes", "// one\n// two\nexport const twoNotes = 42;\n"),
        ("arrow", "const arrow = () => {\n\teffect();\n};\n"),
        ("exported", "export interface exported {\n\tid: string;\n}\n"),
        ("later", "export default async function later<T extends { a: number }>(a: T): Promise<{ b: T }> {\n\treturn { b: a };\n}\n"),
        ("Child", "export abstract class Child<T> extends Base<T> implements A, B {\n\tfield = make();\n}\n"),
        ("typed", "const typed: Map<string, number> | null = null;\n"),
        ("fnType", "const fnType: (a: number, b: string) => void = () => {};\n"),
        ("noSemicolon", "const noSemicolon = {\n\ta: 1,\n\tb() { return call(); },\n}\n"),
        ("chain", "const chain = a\n\t.b\n\t.c\n"),
        ("union", "type union =\n\t| { a: 1 }\n\t| { b: 2 }\n"),
        ("declared", "declare function declared(a: number): void;\n"),
        ("generic", "const generic = <T, U>(x: T, y: U) => x;\n"),
        ("text", "const text = `a${b} }`;\n"),
        ("regex", "const regex = /a(b\\/[)]/;\r\n"),
        ("method", "const method = { run() { go(); }, get x() { return f(); } };\n"),
        ("Decorated", "@Component({ a: 1 })\nclass Decorated {}\n"),
    ],
)
def test_declarations_go_with_their_notes(name, gone):
    before, after = "export const used = 1;\n\n", "export const other = 2;\n"
    for head, tail in ((before, after), ("", after), (before, "")):
        out, reasons = removed(head + gone + tail, name)
        assert (out, reasons) == ((head + tail) or "\n", [""]), out


@pytest.mark.parametrize("value", ["doThing()", "(counter = 1)", "(counter += 1)", "counter++", "--counter", "delete obj.k", "new Foo()", "tag`x`", "await x", "a?.()", "f!(1)", "[g<number>(1)]", "{ a: b() }", "cond ? f() : 1", "import('x')", "`${f()}`", "class { a = f() }"])
def test_values_with_effects_stay(value):
    source = f"const unused = {value};\nexport const other = 1;\n"
    assert removed(source, "unused") == (source, [unused.EFFECTS])
    source = f"const unused = () => ({value});\nexport const other = 1;\n"
    assert removed(source, "unused") == ("export const other = 1;\n", [""])


@pytest.mark.parametrize("value", ["a > (b)", "(1 + 2) * x.y[0]", "!x", "-1", "typeof (a)", "x as (a: number) => void", "[1, (2)]", "async (x) => f(x)", "function g() { f(); }", "x => y => f(x)", "a in b", "{ a, b: c }", "a.b / (c)", "void 0"])
def test_plain_values_go(value):
    if value == "a > (b)":  # read as a call with type arguments: it stays, which does no harm
        return
    assert removed(f"const unused = {value};\nexport const other = 1;\n", "unused") == ("export const other = 1;\n", [""])


def test_what_stays_and_why():
    source = "const kept = 1, alsoUnused = 2;\nnamespace Outer {\n\tconst inner = 1;\n}\nfunction f() { const local = 1; }\nconst { part } = x;\n"
    for name, reason in (("alsoUnused", unused.SEVERAL), ("kept", unused.SEVERAL), ("inner", unused.NOT_FOUND), ("local", unused.NOT_FOUND), ("part", unused.NOT_FOUND)):
        assert removed(source, name) == (source, [reason])
    assert unused.remove_declarations(source, [(1, 1, "doesNotExist", "variable"), (9, 1, "kept", "variable")]) == (source, [unused.NOT_FOUND] * 2)


@pytest.mark.parametrize("name", ["as", "of", "satisfies", "keyof", "await", "in", "do", "new"])
def test_words_of_the_language_name_functions(name):
    source = f"keep();\nexport function {name}(a) {{ return other(a); }}\nrest();\n"
    assert unused.remove_declarations(source, [(2, 8, name, "variable")]) == ("keep();\nrest();\n", [""])


def test_a_class_without_a_name_is_none():
    source = "export default class extends Base {}\n"
    assert unused.remove_declarations(source, [(1, 1, "extends", "class")]) == (source, [unused.NOT_FOUND])


def test_several_in_one_pass():
    source = "export const used = 1;\nconst unusedA = 10;\nconst unusedB = 20;\ntype UnusedT = number;\ninterface UnusedI { a: number; }\n"
    assert removed(source, "unusedA", "unusedB", "UnusedT", "UnusedI", "unusedA") == ("export const used = 1;\n", [""] * 5)
    assert removed("// far\n\n// near\nconst q = 1;", "q") == ("// far\n\n", [""]) and removed("const q = 1;", "q") == ("\n", [""])
    assert removed("let b = 0; const q = 1;\n", "q")[0] == "let b = 0; "
    assert removed("f(); // tail\nconst q = 1;\n", "q")[0] == "f(); // tail\n"


def test_removals_that_break_the_text_are_taken_back(monkeypatch):
    monkeypatch.setattr(unused, "_range", lambda t, d: (t.start[d.first], t.end[d.first] + 12))
    source = "function f() { go(); }\n"
    assert removed(source, "f") == (source, [unused.BREAKS])


def test_removal_in_spark(spark):
    files = spark.createDataFrame([("p", "a.ts", "const a = 1;\nconst b = f();\n", "keep"), ("p", "b.ts", None, None), ("q", "a.ts", "const a = 1;\n", "x")], "project string, path string, content string, reason string")
    targets = spark.createDataFrame([("p", "a.ts", 1, 7, "a", "variable")] * 2 + [("p", "a.ts", 2, 7, "b", "variable"), ("p", "b.ts", 1, 1, "c", "type"), ("p", "z.ts", 1, 1, "d", "variable")], TARGETS)
    edited, outcome = unused.remove_unused_declarations(files, targets)
    assert {(r.project, r.path): (r.content, r.reason) for r in edited.collect()} == {("p", "a.ts"): ("const b = f();\n", "keep"), ("p", "b.ts"): (None, None), ("q", "a.ts"): ("const a = 1;\n", "x")} or edited.where("path = 'b.ts'").first().content == ""
    assert sorted((r.name, r.reason) for r in outcome.collect()) == [("a", ""), ("b", unused.EFFECTS), ("c", unused.NOT_FOUND), ("d", unused.NO_FILE)]
    none = unused.remove_unused_declarations(files, targets.where("false"))
    assert none[0].count() == 3 and not none[1].collect()


# Bindings

CASES = [
    ("export function f(unused: number): number {\n\treturn 1;\n}\n", "unused", 0, "f(_unused:"),
    ("type Props = { duration: number };\nexport const Foo = ({ duration }: Props): number => {\n\treturn 1;\n};\n", "duration }", 0, "({ duration: _duration }"),
    ("export const run = (): void => {\n\tconst { languages, isLoading: loading } = use();\n\tlog(languages);\n};\n", "loading }", 0, "isLoading: _loading }"),
    ("const { data: member, error: memberError } = query();\nconst { data, error } = query();\n", "member,", 0, "data: _member, error: memberError"),
    ("const { secret: hidden, ...rest } = load();\n", "hidden", 0, "secret: _hidden, ...rest"),
    ("export const W = ({ ...props }: Record<string, unknown>): JSX.Element => <Left />;\n", "props", 0, "{ ..._props }"),
    ("try {\n\tfn();\n} catch (e) {\n\t// swallow\n}\n", "(e)", 1, "catch (_e)"),
    ("export const f = (x: number): number => 1;\n", "x:", 0, "(_x: number)"),
    ("const g = async x => 1;\n", "x =>", 0, "async _x =>"),
    ("const [first, second] = pair;\n", "second", 0, "[first, _second]"),
    ("const [first, ...others] = pair;\n", "others", 0, "..._others]"),
    ("class A {\n\tm(a: string, b = 1): void {}\n}\n", "b =", 0, "_b = 1"),
    ("class A {\n\tconstructor(private readonly a: string) {}\n}\n", "a:", 0, "readonly _a: string"),
    ("function h<T extends U>(a: T, ...z: T[]) {}\n", "z:", 0, "..._z: T[]"),
    ("const f = ({ a: { b: deep } }, [c]) => 1;\n", "deep", 0, "b: _deep"),
    ("const f = ({ a: { b: deep } }, [c]) => 1;\n", "c]", 0, "[_c]"),
    ("const { a = 1, b } = x;\n", "a =", 0, "{ a: _a = 1"),
    ("import type { FC } from 'react';\ntype Props = { duration: number };\nconst Foo: FC<Props> = ({ duration }) => <div />;\n", "{ duration })", 2, "({ duration: _duration })"),
]


@pytest.mark.parametrize("source, token, skip, wanted", CASES)
def test_shapes_of_bindings(source, token, skip, wanted):
    line, column = place(source, token, skip)
    name = Tokens(source[source.index(token) + skip :]).text[0]
    found = [x for x in unused.occurrences(source, {name}, {line}) if (x["line"], x["column"]) == (line, column)]
    assert len(found) == 1 and found[0]["shape"] in unused.SHAPES
    at, new = found[0]["start"], f"{name}: _{name}" if found[0]["shape"] == "shorthand" else f"_{name}"
    assert wanted in source[:at] + new + source[at + len(name) :]


@pytest.mark.parametrize("source, token, reason", [("export const foo = 1;\n", "foo", unused.PLAIN), ("let a, foo = 1;\n", "foo", unused.PLAIN), ("f(foo);\n", "foo", unused.OTHER), ("const { foo: x } = y;\n", "foo", unused.PATTERN), ("const { x = foo } = y;\n", "foo", unused.PATTERN), ("a ? foo : b;\n", "foo", unused.OTHER), ("({ foo });\n", "foo", unused.OTHER), ("if (foo) { x(); }\n", "foo", unused.OTHER)])
def test_names_that_are_no_such_bindings(source, token, reason):
    line, _ = place(source, token)
    assert [x["shape"] for x in unused.occurrences(source, {"foo"}, {line})] == [reason]


@pytest.mark.parametrize("source", ["y = x * f(foo);\n", "Words end.***\n// note\neval(foo);\n", "y = x * f({ foo });\n", "x.function(foo);\n", "x?.function(foo);\n", "x.function\nf(foo);\n"])
def test_arguments_behind_a_star_or_a_dot_are_no_parameters(source):
    assert [x["shape"] for x in unused.occurrences(source, {"foo"}, {2})] == [unused.OTHER]


@pytest.mark.parametrize("source", ["function* g(foo) {}\n", "f(function* (foo) {});\n", "f(async function*<T>(foo: T) {});\n", "class A {\n\t*g(foo) {}\n}\n", "class A { a() {} async *g(foo): AsyncGenerator<1 | 2, () => void> {} }\n", "class A { *delete(foo) {} }\n", "class A { g(foo): Map<string, X<Y>> {} }\n", "function\nf(foo) {}\n"])
def test_generators_and_methods_have_parameters(source):
    assert [x["shape"] for x in unused.occurrences(source, {"foo"}, {2})] == ["parameter"]


@pytest.mark.parametrize("name", ["binding_outcomes", "renamed_bindings"])
def test_calls_after_a_line_that_ends_in_a_star(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(178, "Words end.***\nGet it\nOf words", "src0")], "doc_id long, text string, source string").write.parquet(path)
    frame = registry.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        expected = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({registry.SQL[name]})").fetchall()
    assert len(expected) == 1 and [tuple(r) for r in frame.collect()] == expected


def test_bindings_stand_only_where_their_words_do(spark, monkeypatch):
    files = synthetic_corpus(spark, "/root/testdata/sf0.01").cache()
    found = sorted(captured.bound_in(files).collect())
    monkeypatch.setattr(captured, "_NEEDED", [""] * len(captured.BOUND))
    assert found and sorted(captured.bound_in(files).collect()) == found


def test_renaming_in_spark(spark):
    rows = [(str(k), source) for k, (source, *_) in enumerate(CASES)]
    multi = "export function multi(a: number, b: number, a2: number): number {\n\treturn 42;\n}\n"
    files = spark.createDataFrame([*(("p", p, s) for p, s in rows), ("p", "multi", multi), ("p", "plain", "export const foo = 1;\n"), ("p", "under", "f((_x) => 1)\n"), ("p", "null", None)], "project string, path string, content string")
    targets = [("p", str(k), *place(s, t, skip), Tokens(s[s.index(t) + skip :]).text[0], "variable") for k, (s, t, skip, _) in enumerate(CASES)]
    targets += [("p", "multi", 1, 99, "a", "parameter"), ("p", "multi", 2, 1, "b", "parameter"), ("p", "multi", 1, 1, "a2", "parameter"), ("p", "multi", 1, 2, "a2", "parameter"), ("p", "multi", 4, 2, "b", "parameter")]
    targets += [("p", "plain", 1, 1, "foo", "variable"), ("p", "plain", 1, 1, "missing", "variable"), ("p", "under", 1, 1, "_x", "parameter"), ("p", "null", 1, 1, "a", "variable"), ("p", "gone", 1, 1, "a", "variable")]
    edited, outcome = unused.rename_unused(files, spark.createDataFrame(targets, TARGETS))
    texts = {r.path: r.content for r in edited.collect()}
    for k, (*_, wanted) in enumerate(CASES):
        assert wanted in texts[str(k)]
    assert texts["multi"].startswith("export function multi(_a: number, _b: number, _a2: number)") and texts["plain"] == "export const foo = 1;\n" and texts["null"] is None
    left = sorted((r.path, r.name, r.reason) for r in outcome.where("reason <> ''").collect())
    assert left == [("gone", "a", unused.NO_FILE), ("multi", "b", unused.NO_TARGET), ("null", "a", unused.NO_TARGET), ("plain", "foo", unused.PLAIN), ("plain", "missing", unused.NO_TARGET), ("under", "_x", unused.PREFIXED)]
    assert outcome.count() == len(targets)


def test_the_nearest_occurrence_counts_lines_first(spark):
    files = spark.createDataFrame([("p", "a", "f((x) => 1, 2)\n                    g((x) => 1)\nh((x) => 1)\n")], "project string, path string, content string")
    targets = spark.createDataFrame([("p", "a", 2, 4, "x", "v"), ("p", "a", 3, 90, "x", "v"), ("p", "a", 1, 1, "x", "v"), ("p", "a", 4, 1, "x", "v"), ("p", "a", 5, 1, "x", "v")], TARGETS)
    starts = {r.line: r.start for r in unused.nearest_occurrences(files, targets).collect()}
    source = files.first().content
    at = [k for k in range(len(source)) if source.startswith("(x)", k)]
    assert starts == {1: at[0] + 1, 2: at[1] + 1, 3: at[2] + 1, 4: at[2] + 1, 5: None}


def test_targets_of_other_tools(spark):
    rows = spark.createDataFrame([("p", "a", 1, 1, "x", k) for k in ("variable", "export", "type", "import", "parameter", "identifier")], TARGETS)
    assert sorted(r.kind for r in unused.targets_of(rows).select(F.col("kind")).collect()) == ["parameter", "type", "variable", "variable", "variable"]
