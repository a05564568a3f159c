"""Symbol rules per language on hand-written snippets, including the cases that must give nothing."""

import pytest
from pyspark.sql import functions as F

from commitlens.functions.symbols import add_symbol_columns, check_kinds

PY = '''from . import q
from .mod import r, s as t
from __future__ import annotations
from x import (a,
   b as c)
import a.b, c as d
from m import *
x: int = 1
y: str
a = b = 3
p, q2 = 1, 2
obj.attr = 5
arr[0] = 1
f(k=1,
  j=2)
s = "def fake(a, b=1): pass  # not code"
@decor(1)
async def run(a, b, *args, c=1, d: int = 2, **kw):
    total = sum(range(len(a)))
    return print(total)
def g(a, b): pass
def h(a=1, b=2, c, d=3): pass
lst = [i for i in range(3)]
class K(Base, metaclass=M):
    pass
'''
PY_IMPORTS = ["a", "a.b", "b", "c", "decor", "f", "len", "m", "print", "q", "r", "range", "s", "sum", "x"]
PY_VARIABLES = ["K", "a", "b", "c", "d", "g", "h", "lst", "run", "s", "total", "x", "y"]

JAVA = '''package single;
import static java.lang.Math.max;
import foo;
/* class Fake { int bad; } */
@Deprecated
public abstract class Outer<T extends Comparable<T>> extends Base implements Runnable, Cloneable {
    // int commented = 1;
    private static final String NAME = "class Nope { }";
    protected List<Map<String, Integer>> items = new ArrayList<>(), other;
    int[] arr = {1, 2, 3};
    Runnable r = () -> { int inLambda = 1; };
    static { int staticLocal = 2; }
    public Outer(int ctorParam) { super(); int ctorLocal = 3; }
    @Override
    public <R> List<R> mapAll(final Function<T, R> fn, int[] idx, String... rest) throws IOException, Exception {
        for (int i = 0; i < 3; i++) { if (i > 1) { int deep = i; } else { int other2 = 0; } }
        return null;
    }
    abstract void later(long when);
    interface Inner { void call(String arg); }
    @interface Marker { }
    enum Color { RED, GREEN; int shade; }
    class Nested { double weight = 1.0; void nestedMethod() {} }
}
'''
JAVA_IMPORTS = ["foo", "java.lang.Math.max"]
JAVA_VARIABLES = ["Inner", "NAME", "Nested", "Outer", "arg", "arr", "call", "fn", "idx", "items", "later", "mapAll",
                  "nestedMethod", "other", "r", "shade", "weight", "when"]

JS = '''import D, {e as f, g} from 'm';
import {a as b, c as d} from "x";
import 'side-effect';
const req = require('x');
// import Fake from 'fake';
let q = p, z;
for (let o of items) { total += o; }
const f2 = (u = 1) => u;
x = function nm() {};
a == b;
if (cond === other) { y = z; }
s = "a = b";
this.count;
a.b.c
foo.bar
  .baz();
export default class Widget extends Base {}
export function helper() {}
function* gen() {}
const obj2 = { key: val };
m = n = o2;
'''
JS_IMPORTS = ["'m'", "D", "a as b", "a.b.c", "c as d", "d", "e as f", "g", "m", "this.count", "x"]
JS_VARIABLES = ["Widget", "a.b.c", "f2", "helper", "m", "n", "o2", "obj2", "p", "q", "req", "s", "this.count", "x",
                "y", "z"]

TEMPLATES = {
    "python": ('''import os.path
import numpy as np
from pkg6 import name1, other as o
class C6:
    def m1(self, x, y=1):
        v5 = fn1(x)  # w = 1
        v5 += 1
        self.q = 2
''', ["fn1", "name1", "numpy", "os.path", "other", "pkg6"], ["C6", "m1", "self", "v5", "x", "y"]),
    "java": ('''package org.p6;
import java.util.List;
import java.io.*;
public class J6 {
  private int f6 = 0, g = 1;
  J6(int z) { int loc = 1; }
  int run2(String s6, int n) { int t = n; return t; }
}
''', ["java.io", "java.util.List", "org.p6"], ["J6", "f6", "g", "n", "org.p6", "run2", "s6"]),
    "javascript": ('''import React from 'react';
import * as ns5 from "lib5";
import {p4, q as r4} from 'mod';
var u6 = w;
let k = 1;
function go5(arg) { k = u6; }
class K4 { meth() {} }
import('dyn6').then((mm) => { k; });
obj.prop5;
''', ["'react'", "React", "dyn6", "lib5", "mm", "mod", "ns5", "obj.prop5", "p4", "q as r4", "r4"],
        ["K4", "dyn6", "go5", "k", "mm", "obj.prop5", "u6", "w"]),
}


def extract(spark, lang, text):
    df = spark.createDataFrame([(lang, text)], "programming_language string, text string")
    r = add_symbol_columns(df).select(F.array_sort("imports").alias("i"), F.array_sort("variables").alias("v")).first()
    return list(r.i), list(r.v)


@pytest.mark.parametrize("lang, text, imports, variables", [
    ("python", PY, PY_IMPORTS, PY_VARIABLES),
    ("java", JAVA, JAVA_IMPORTS, JAVA_VARIABLES),
    ("javascript", JS, JS_IMPORTS, JS_VARIABLES),
] + [(k, *v) for k, v in TEMPLATES.items()])
def test_rules(spark, lang, text, imports, variables):
    assert extract(spark, lang, text) == (imports, variables)


def test_other_languages_are_empty(spark):
    assert extract(spark, "jupyter notebook", TEMPLATES["python"][0]) == ([], [])


def test_unknown_kind():
    with pytest.raises(ValueError, match="known kinds: imports, variables"):
        check_kinds(["imports", "functions"])


def test_long_literal_does_not_overflow(spark):
    text = "x = '" + "a" * 2_000_000 + "'\nimport big\n"
    assert extract(spark, "python", text) == (["big"], ["x"])


PY_SUITES = '''if a: b = 1
elif c: d += 2
else: e: int = 3
for i in r: t = i
while x: w = 1; z = 2
try: y = open(p)
except E: q = 0
with f() as g: h = 1
x: int = 1
lam = lambda k: k
print(f"{len(items)} items, {obj.method()} {{literal}}", F"{max(a, b)}")
s = "not {len(x)} an f-string"
'''


def test_python_one_line_suites_and_fstrings(spark):
    assert extract(spark, "python", PY_SUITES) == (
        ["f", "len", "max", "open", "print"],
        ["b", "d", "e", "h", "lam", "q", "s", "t", "w", "x", "y", "z"])


def test_js_destructuring_and_java_interface_constants(spark):
    js = ("const {a = 1, b} = obj;\nlet [c = 2] = arr;\nconst {d} = e;\n"
          "const {f: {g = 3}, h} = deep;\nlet [i, [j = 4]] = pairs;\n")
    assert extract(spark, "javascript", js) == ([], ["arr", "deep", "e", "obj", "pairs"])
    java = "interface Api {\n  int LIMIT = 10;\n  void call(int n);\n}\nclass Impl implements Api {\n  int count = 0;\n}\n"
    assert extract(spark, "java", java) == ([], ["Api", "Impl", "call", "count", "n"])


def test_python_soft_keywords(spark):
    text = "match = pattern(s)\ncase: int = 2\nmatch command:\n    case 1:\n        pass\nexec(code)\n"
    assert extract(spark, "python", text) == (["exec", "pattern"], ["case", "match"])


def test_java_anonymous_class_fields(spark):
    java = ("class Host {\n  int kept = 1;\n  void run() {\n    int local = 2;\n"
            "    Runnable r = new Runnable() {\n      int anonField = 3;\n      public void go(int a) { int inner = 4; }\n"
            "    };\n  }\n}\n")
    assert extract(spark, "java", java) == ([], ["Host", "a", "anonField", "go", "kept", "run"])


def test_texts_given_with_the_files_are_dealt_once_to_all_tasks(spark):
    from commitlens.operators.symbols import extract_symbols
    rows = [("a", "python", "import os\n"), ("a", "python", "import os\n"), ("b", "java", "import p.Q;\nclass K { void f() { if (x) { } } int n; }\n"), (None, "java", "class L { }")]
    out = extract_symbols(spark.createDataFrame(rows, "blob_id string, programming_language string, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    got = sorted((str(r.blob_id), sorted(r.imports), sorted(r.variables)) for r in out.collect())
    assert got == [("None", [], ["L"]), ("a", ["os"], []), ("b", ["p.Q"], ["K", "f", "n"])]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_search_a_text_once(spark):
    """What imports and variables share, and all groups of a pattern, come from one search."""
    from commitlens.functions.symbols import python
    df = spark.createDataFrame([("a", "python", "x = 1")], "blob_id string, programming_language string, text string")
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 24)
    plan = _plan(add_symbol_columns(df).select("imports", "variables"))
    assert plan.count("regexp_extract_all(_js#") == 2  # static imports, and dynamic imports for both kinds
    froms = _plan(df.select(python.imports(F.col("text")).alias("x")))
    assert froms.count("regexp_extract_all(text") == 3  # "from", "import" and calls


def test_vendored_paths_as_by_each_pattern(spark):
    import re

    from commitlens.functions.language import VENDORED_PATTERNS, is_vendored
    names = ["vendor", "vendors", "vendored", "xvendor", "node_modules", "third-party", "thirdparty", "3rd_party", "extern", "external", "externals", "dist", "distx",
             "jquery-1.js", "xjquery.js", "bootstrap.css", "bootstrap.cssx", "a.min.js", "a.min.jsx", "min.css", ".min.css", "a.py"]
    paths = [*names, *[f"{a}/{b}" for a in names for b in names]]
    got = {r.p: r.v for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", is_vendored("p").alias("v")).collect()}
    assert got == {p: any(re.search(x, p) for x in VENDORED_PATTERNS) for p in paths}


def test_classification_tests_a_path_once(spark):
    """Vendored paths and images are dropped before contents are met, and not looked for again."""
    from commitlens.functions.language import VENDORED_REGEX
    from commitlens.operators.classify import classify_changes
    c = spark.createDataFrame([("a.py", "1"), ("vendor/a.py", "1"), ("a.png", "1"), ("b.py", "2"), ("c", "3")], "file_path string, new_blob_id string")
    b = spark.createDataFrame([("1", "x"), ("2", "x\0"), ("3", "#!/bin/sh\n")], "blob_id string, text string")
    out = classify_changes(c, b)
    assert sorted((r.file_path, r.programming_language) for r in out.collect()) == [("a.py", "python"), ("c", "shell")]
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 24)
    assert _plan(out).count(VENDORED_REGEX) == 1


def test_open_files_are_tokenised_once(spark):
    """The model holds no plan over texts, and the texts of open files are searched once."""
    from commitlens.operators.content_language import decide, learn
    blobs = spark.createDataFrame([("1", "def f(): 7"), ("2", "int f() { 8 }"), ("3", "def g(): 9"), ("4", "{ int : }"), ("5", "z")], "blob_id string, text string")
    known = spark.createDataFrame([("1", "python"), ("2", "c"), ("6", "c"), (None, "c")], "blob_id string, programming_language string")
    model = learn(known, blobs)
    assert _plan(model).count("regexp_extract_all") == 0
    assert {(r.token, r.language): r.n for r in model.where("token IS NULL OR token = '0' OR token = 'def'").collect()} == {
        (None, "python"): 1, (None, "c"): 1, ("0", "python"): 1, ("0", "c"): 1, ("def", "python"): 1}
    both = ["python", "c"]
    open_ = spark.createDataFrame([("3", both), ("3", both), ("4", both), ("5", ["perl"]), ("7", both), (None, both)], "blob_id string, candidates array<string>")
    out = decide(open_, blobs, model)
    assert _plan(out).count("regexp_extract_all") == 1
    assert sorted(((r.blob_id, r.language) for r in out.collect()), key=str) == sorted([("3", "python"), ("4", "c"), ("5", None), ("7", None), (None, None)], key=str)


def test_newest_versions_are_ranked_once(spark):
    """The changes are classified and ranked to find the symbols, and not once more to meet them."""
    from commitlens.operators.symbols import latest_symbols
    c = spark.createDataFrame([("r", "a.py", "1", "c1", 1), ("r", "a.py", "2", "c2", 2), ("r", "b.js", "3", "c2", 2), ("r", "b.js", None, "c3", 3)],
                              "repo_url string, file_path string, new_blob_id string, commit_id string, commit_time int")
    b = spark.createDataFrame([("1", "x = 1"), ("2", "y = 1"), ("3", "let z = 1;")], "blob_id string, text string")
    out = latest_symbols(c, b, order=(("commit_time", False),), commit_order=(("commit_time", False),), commit_limit=2)
    assert sorted((r.file_path, r.blob_id, r.variables[0]) for r in out.collect()) == [("a.py", "2", "y"), ("b.js", "3", "z")]
    assert "Window" not in _plan(out) and "Aggregate" not in _plan(out)
