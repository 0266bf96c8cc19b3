"""Small fixed sources and what a reader finds in them, for the queries over parsers and bridges."""

from __future__ import annotations

SOURCES = {
    "a.ts": """import { pool, query as q } from './db.js';
const { readFile } = require('fs');
// function ghost() {}
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
""",
    "b.py": """import os, sys as system
from a.b import (
    c,  # note
    d as e,
)

@router.get("/items")
def items(
    q: str,
) -> int:
    return 1

class Box(Base):
    def open(self):
        return 2
""",
    "c.go": "package m\nimport (\n  \"fmt\"\n  z \"a/b\"\n)\ntype T struct {\n  x int\n}\nfunc (t *T) Do(a int) error {\n  return nil\n}\nfunc Main() {\n}\n",
    "d.rs": "use std::io;\nuse a::{b, c};\npub struct P {\n x: i32\n}\npub fn go(x: i32) -> i32 {\n x\n}\ntrait Q {\n}\n",
    "e.sh": "#!/bin/bash\n# ghost() {\nfunction up {\n  echo '}' # }\n}\ndown() {\n  true\n}\n",
    "F.java": """package p;
import java.util.List;
import static org.X.of;

public class Shop {
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
""",
    "g.md": "# One\ntext [a](b/c.md#x) [w](https://z)\n```\n# no\n```\n## Two\nmore\n# `Three`\n",
    "h.c": "int main(int argc) {\n  return 0;\n}\n",
}
#: (file, name, type, first line, last line), read off the sources by hand.
SYMBOLS = (
    ("a.ts", "load", "function", 4, 7), ("a.ts", "run", "function", 8, 10), ("a.ts", "Store", "class", 11, 16), ("a.ts", "Store.get", "method", 12, 15), ("a.ts", "Shape", "type", 18, 18),
    ("a.ts", "Color", "type", 20, 20), ("a.ts", "Alias", "type", 19, 19), ("a.ts", "GET /api/items", "route", 17, 21),
    ("b.py", "GET /items", "route", 7, 12), ("b.py", "items", "function", 8, 12), ("b.py", "Box", "class", 13, 16), ("b.py", "Box.open", "method", 14, 16),
    ("c.go", "T.Do", "method", 9, 11), ("c.go", "Main", "function", 12, 13), ("c.go", "T", "type", 6, 8),
    ("d.rs", "go", "function", 6, 8), ("d.rs", "P", "type", 3, 5), ("d.rs", "Q", "type", 9, 10),
    ("e.sh", "up", "function", 3, 5), ("e.sh", "down", "function", 6, 8),
    ("F.java", "Shop", "class", 5, 13), ("F.java", "Seller", "type", 14, 16), ("F.java", "Shop.Shop", "method", 6, 8), ("F.java", "Shop.names", "method", 9, 12), ("F.java", "Seller.sell", "method", 15, 15),
    ("g.md", "One", "section", 1, 7), ("g.md", "Two", "section", 6, 7), ("g.md", "Three", "section", 8, 9), ("h.c", "main", "function", 1, 4),
)
#: (file, target, relation, symbols joined by blanks).
IMPORTS = (
    ("a.ts", "./db.js", "imports", "pool query"), ("a.ts", "fs", "requires", "readFile"), ("b.py", "os", "imports", "os"), ("b.py", "sys", "imports", "sys"), ("b.py", "a.b", "imports", "c d"),
    ("c.go", "fmt", "imports", "fmt"), ("c.go", "a/b", "imports", "z"), ("d.rs", "std::io", "imports", "io"), ("d.rs", "a", "imports", "b c"),
    ("F.java", "java.util.List", "imports", "List"), ("F.java", "org.X.of", "imports", "of X"), ("g.md", "b/c.md", "references", "a"),
)
#: A text whose last lines use a variable built from an import, and the status of each of its imports.
ACTIVITY = ("import os\nfrom m import Alpha, B as C, D\nobj = Alpha()\nx = os.path\n" + "y = 1\n" * 4 + "obj.run()\n", "a.py")
STATUS = (("os", "earlier_only", False), ("Alpha", "immediate_cursor", True), ("C", "unused_staged", False), ("D", "unused_staged", False))

#: Files of one repository: (id, path, summary); edges: (id, source, target).
FILES = ((1, "src/auth.js", "session login"), (2, "src/token.js", "jwt refresh rotation"), (3, "src/mail.js", "letters"), (4, "src/log.js", "traces login"), (5, "src/deep.js", "rotation"))
EDGES = ((1, "src/auth.js", "./token"), (2, "src/mail.js", "./auth"), (3, "src/token.js", "./deep"))
#: Ranked rows: (id, similarity), and what a query for "login rotation" (k rows) makes of them: (id, similarity rounded, bridge).
ROOM = (((1, 0.9), (4, 0.5)), 5, ((1, 0.9, False), (2, 0.756, True), (4, 0.5, False)))
FULL = (((1, 0.9), (4, 0.5), (3, 0.4)), 3, ((1, 0.9, False), (4, 0.5, False), (2, 0.756, True)))
COVERED = (((1, 0.9), (2, 0.5)), 5, ((1, 0.9, False), (2, 0.5, False)))
