import time

from lodestone.parse import frames
from lodestone.parse.activity import activity
from lodestone.parse.languages import parse
from lodestone.parse.source import Source
from tests import samples


def told(text, path):
    return [(s.name, s.type, s.start_line, s.end_line) for s in parse(text, path)[0]]


def brought(text, path):
    return [(i.target_path, i.relation, i.symbols) for i in parse(text, path)[1]]


JS = """import { pool, query as q } from './db.js';
import path from 'node:path';
const { readFile } = require('fs');
// function ghost() {}
const tpl = `function fake() { ${1} }`;
export async function load(id) {
  if (id) { return "}"; }
  return /[}]/.test(id);
}
const run = async (x) => {
  return x;
};
class Store extends Base {
  async get(key) {
    while (key) { break; }
    return key;
  }
}
app.get('/api/items', handler);
interface Shape { a: number }
export type Alias = string;
enum Color { Red }
"""


def test_javascript():
    assert told(JS, "src/a.ts") == [
        ("load", "function", 6, 9), ("run", "function", 10, 12), ("Store", "class", 13, 18), ("Store.get", "method", 14, 17),
        ("Shape", "type", 20, 20), ("Color", "type", 22, 22), ("Alias", "type", 21, 21), ("GET /api/items", "route", 19, 23),
    ]
    assert brought(JS, "src/a.ts") == [("./db.js", "imports", ["pool", "query"]), ("node:path", "imports", ["path"]), ("fs", "requires", ["readFile"])]


PY = """import os, sys as system
from a.b import (
    c,  # note
    d as e,
)
from x import y

@router.get("/items")
@limit
def items(
    q: str,
) -> int:
    return 1

@bp.route('/two', methods=['GET', 'POST'])
async def two():
    pass

class Box(Base):
    size = 1

    def open(self):
        return 2

def last(): return 3
"""


def test_python():
    assert told(PY, "a.py") == [
        ("GET /items", "route", 8, 14), ("items", "function", 10, 14), ("GET /two", "route", 15, 18), ("POST /two", "route", 15, 18),
        ("two", "function", 16, 18), ("Box", "class", 19, 24), ("Box.open", "method", 22, 24), ("last", "function", 25, 26),
    ]
    assert brought(PY, "a.py") == [("os", "imports", ["os"]), ("sys", "imports", ["sys"]), ("a.b", "imports", ["c", "d"]), ("x", "imports", ["y"])]


def test_go_rust_shell():
    text = 'package m\nimport (\n  "fmt"\n  z "a/b"\n)\ntype T struct {\n  x int\n}\nfunc (t *T) Do(a int) error {\n  return nil\n}\nfunc Main() {\n}\n'
    assert told(text, "a.go") == [("T.Do", "method", 9, 11), ("Main", "function", 12, 13), ("T", "type", 6, 8)]
    assert brought(text, "a.go") == [("fmt", "imports", ["fmt"]), ("a/b", "imports", ["z"])]
    text = "use std::io;\nuse a::{b, c};\npub struct P {\n x: i32\n}\npub fn go(x: i32) -> i32 {\n x\n}\ntrait Q {\n}\n"
    assert told(text, "a.rs") == [("go", "function", 6, 8), ("P", "type", 3, 5), ("Q", "type", 9, 10)]
    assert brought(text, "a.rs") == [("std::io", "imports", ["io"]), ("a", "imports", ["b", "c"])]
    text = "#!/bin/bash\n# ghost() {\nfunction up {\n  echo '}' # }\n}\ndown() {\n  true\n}\n"
    assert told(text, "a.sh") == [("up", "function", 3, 5), ("down", "function", 6, 8)]


JAVA = """package p;
import java.util.List;
import static org.X.of;

public class Shop {
  private List<String> all;
  public Shop(int n) {
    this.n = n;
  }
  @Override
  public List<String> names() throws Exception {
    return all;
  }
}
interface Seller {
  void sell(int n);
}
@interface Mark {
}
"""


def test_java():
    assert told(JAVA, "A.java") == [
        ("Shop", "class", 5, 14), ("Seller", "type", 15, 17), ("Mark", "type", 18, 19), ("Shop.Shop", "method", 7, 9), ("Shop.names", "method", 10, 13), ("Seller.sell", "method", 16, 16),
    ]
    assert brought(JAVA, "A.java") == [("java.util.List", "imports", ["List"]), ("org.X.of", "imports", ["of", "X"])]


def test_markdown_and_generic():
    text = "# One\ntext [a](b/c.md#x) [w](https://z)\n```\n# no\n```\n## Two\nmore\n# `Three`\n"
    assert told(text, "r.md") == [("One", "section", 1, 7), ("Two", "section", 6, 7), ("Three", "section", 8, 9)]
    assert brought(text, "r.md") == [("b/c.md", "references", ["a"])]
    assert told("int main(int argc) {\n  return 0;\n}\n", "a.c") == [("main", "function", 1, 4)]


def test_degenerate_and_fast():
    assert parse(None, "a.js") == parse("", None) == parse("short", "a.py") == parse("a\0" * 20, "a.js") == ([], [])
    text = "\n".join(f"function f{i}() {{ return {i}; }}" for i in range(5000))
    began = time.process_time()
    assert len(parse(text, "a.js")[0]) == 5000 and time.process_time() - began < 2


def test_masks_keep_places():
    s = Source(JS)
    assert len(s.code) == len(s.bare) == len(JS) and s.bare.count("\n") == JS.count("\n") and "ghost" not in s.code and "fake" not in s.bare


def test_activity():
    imports = "import os\nfrom m import (Alpha,\n  B as C, D)\n"
    text = "import os\nobj = Alpha()\nx = os.path\n" + "y = 1\n" * 4 + "obj.run()\n"
    got = {b.local_name: (b.status, b.via_receiver) for b in activity(text, imports, "a.py")}
    assert got == {"os": ("earlier_only", False), "Alpha": ("immediate_cursor", True), "C": ("unused_staged", False), "D": ("unused_staged", False)}
    java = "import a.Foo;\nimport b.Bar;\nclass X {\n Foo foo;\n int a;\n int b;\n int c;\n int d;\n void m() {\n  foo.go();\n }\n}\n"
    assert {b.local_name: b.status for b in activity(java, None, "X.java")} == {"Foo": "immediate_cursor", "Bar": "unused_staged"}


def test_frames(spark):
    rows = [("1", "a.ts", JS), ("2", "b.py", PY), ("3", None, None), ("4", "x.js", "")]
    files = spark.createDataFrame(rows, "id string, file_path string, content string")
    assert frames.symbols(files).groupBy("blob_id").count().orderBy("blob_id").collect() == [("1", 8), ("2", 8)]
    assert frames.edges(files).count() == 7
    assert {r.blob_id: round(r.unused_ratio, 2) for r in frames.unused_ratio(frames.import_activity(files)).collect()} == {"1": 0.75, "2": 0.6}
    spine = {r.blob_id: r.symbol_spine for r in frames.spine(frames.symbols(files)).collect()}
    assert spine["2"].startswith("GET /items router.get items limit") or "GET /items" in spine["2"]
    assert frames.symbols(files.limit(0)).count() == 0


def test_samples(spark):
    files = spark.createDataFrame([(k, k, x) for k, x in samples.SOURCES.items()], "id string, file_path string, content string")
    found = frames.symbols(files).select("file_path", "symbol_name", "symbol_type", "start_line", "end_line").collect()
    assert sorted(map(tuple, found)) == sorted(samples.SYMBOLS)
    assert sorted((r.source_path, r.target_path, r.relation, " ".join(r.symbols)) for r in frames.edges(files).collect()) == sorted(samples.IMPORTS)
    text, path = samples.ACTIVITY
    rows = frames.import_activity(spark.createDataFrame([("1", path, text)], "id string, file_path string, content string"))
    assert sorted(map(tuple, rows.select("local_name", "status", "via_receiver").collect())) == sorted(samples.STATUS)


def test_python_statements():
    text = 'x = """\ndef ghost():\n"""\nclass A:  # def no()\n    class B:\n        def f(self): pass\n    def g(self,\n          y="):"):\n        from m import (a as b, # c\n          d)\n        return y\nimport p.q as r, s \\\n    , t\ndef broken(a, (\ndef fine(a):\n    pass\n@app.route("/p")\n@wrap\ndef h(): ...\nfrom . import *\n'
    assert told(text, "a.py") == [
        ("A", "class", 4, 11), ("B", "class", 5, 6), ("B.f", "method", 6, 6), ("A.g", "method", 7, 11), ("broken", "function", 14, 14), ("fine", "function", 15, 16),
        ("GET /p", "route", 17, 19), ("h", "function", 19, 19),
    ]
    assert brought(text, "a.py") == [("m", "imports", ["a", "d"]), ("p.q", "imports", ["p.q"]), ("s", "imports", ["s"]), ("t", "imports", ["t"]), (".", "imports", ["*"])]


def test_markdown_links_and_levels():
    text = "##### five\n#none\n# A `b`\n[x](y.md) [[z] (q) [k]( c/d.md#e ) [](f) [l](MAILTO:a) [m](#n)\n### C\n## D\n# E"
    assert told(text, "r.md") == [("A b", "section", 3, 6), ("C", "section", 5, 5), ("D", "section", 6, 6), ("E", "section", 7, 7)]
    assert brought(text, "r.md") == [("y.md", "references", ["x"]), ("c/d.md", "references", ["k"])]
