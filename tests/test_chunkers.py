import pytest

from seekstone.chunkers.base import FallbackChunker
from seekstone.chunkers.registry import chunker_for
from seekstone.chunkers.script import ScriptChunker
from seekstone.config import Settings


def chunks(ext, source, **settings):
    return chunker_for(ext, Settings(**settings)).chunk_file(f"dir/name{ext}", source)


def one(found, qualified):
    hits = [c for c in found if c.qualified_name == qualified]
    assert len(hits) == 1, [c.qualified_name for c in found]
    return hits[0]


PY = '''"""Module."""
import os
from a import b

LIMIT = 3

@dec(1)
@other
def plain(x, y=(1, 2)):
    "Adds."
    def inner():
        pass
    return x


async def later():
    return 1


class Store(Base, metaclass=Meta):
    """Keeps things."""

    size = 1

    def get(self, key: str = ")") -> int:
        """Find it.

        More."""
        return 1

    @property
    def name(self):
        return "n"
'''


def test_python():
    found = chunks(".py", PY)
    plain = one(found, "plain")
    assert plain.code_text.startswith("@dec(1)\n@other\ndef plain") and (plain.start_line, plain.end_line) == (9, 13) and plain.kind == "function"
    assert "# imports:\n#   import os\n#   from a import b" in plain.embed_text
    assert one(found, "later").code_text.startswith("async def") and not any(c.symbol_name == "inner" for c in found)
    get = one(found, "Store.get")
    assert get.kind == "method" and "# class: Store" in get.embed_text
    cls = one(found, "Store")
    assert cls.code_text == 'class Store(Base, metaclass=Meta):\n    """Keeps things."""\nMethods:\n  - get(self, key: str = ")") - Find it.\n  - name(self)'
    assert [c.qualified_name for c in found].index("Store") > [c.qualified_name for c in found].index("Store.name")
    block = found[-1]
    assert block.kind == "module_block" and block.code_text == '"""Module."""\nLIMIT = 3' and block.symbol_name == "name.py:module:1-5"


def test_python_oversize_and_broken():
    body = "\n".join(f"    x{i} = 'a b c'" for i in range(90))
    windows = chunks(".py", f"def big():\n{body}\n", max_chunk_tokens=50)
    assert all(c.truncated and c.qualified_name == "big" for c in windows) and [(c.start_line, c.end_line) for c in windows] == [(1, 60), (51, 91)]
    parts = chunks(".py", f"def big():\n    def a():\n        pass\n    class B:\n        pass\n{body}\n", max_chunk_tokens=50)
    assert [(c.start_line, c.end_line, c.truncated) for c in parts] == [(2, 3, False), (4, 5, False)]
    assert chunks(".py", "def (:\n")[0].kind == "fallback_window"


def test_module_blocks_overlap():
    source = "\n".join(f"v{i} = '{'w ' * 48}'" for i in range(9))
    found = chunks(".py", source)
    assert [(c.start_line, c.end_line) for c in found] == [(1, 8), (8, 9)]
    tail = "\n".join(f"v{i} = '{'w ' * 48}'" for i in range(8))
    assert len(chunks(".py", tail)) == 2 and len(chunks(".py", tail, dedupe_module_tail=True)) == 1


JS = """import a from "b";
// adds
export function add(a, b) { return a + b; }
const mul = (a, b) => {
  return a * b;
};
const re = /ab[/"]c/g, z = `x${a + `y${1}`}`
/** C */
export default class Foo extends Bar {
  x = 1;
  // make
  constructor(a) { super(); }
  static async go(x = {a: 1}) {
    return x;
  }
  get v() { return 1 }
}
app.set = function set(a) { return a; };
module.exports = { a: 1 };
if (a) { b() } else { c() }
foo()
  .bar()
baz()
"""


def test_javascript():
    found = chunks(".js", JS)
    assert one(found, "add").code_text == "// adds\nfunction add(a, b) { return a + b; }" and one(found, "add").start_line == 3
    assert one(found, "mul").code_text.startswith("const mul") and (one(found, "mul").start_line, one(found, "mul").end_line) == (4, 6)
    assert one(found, "Foo.constructor").code_text == "// make\nconstructor(a) { super(); }"
    assert one(found, "Foo.go").kind == "method" and one(found, "Foo.v").code_text == "get v() { return 1 }"
    assert one(found, "Foo").code_text == "/** C */\nclass Foo {\n  // methods:\n  //   constructor(a)\n  //   go(x = {a: 1})\n  //   v()\n}"
    assert one(found, "set").kind == "function"
    block = found[-1].code_text.split("\n")
    assert block[1] == "module.exports = { a: 1 };" and "foo()\n  .bar()\nbaz()" in found[-1].code_text and found[-1].kind == "module_block"
    assert '//   import a from "b";' in one(found, "add").embed_text


def test_declarators_and_oversize():
    found = chunks(".js", "const a = 1, f = () => a;\nexports.run = async (x) => x;\nfunction* gen() {}\n")
    assert one(found, "f").code_text == "() => a" and one(found, "run").kind == "function" and found[-1].code_text == "function* gen() {}"
    body = "\n".join(f"  x{i} = 'a b c';" for i in range(90))
    assert all(c.truncated for c in chunks(".js", f"function big() {{\n{body}\n}}", max_chunk_tokens=50))
    nested = chunks(".js", f"function big() {{\n  function inner() {{ return 1 }}\n{body}\n}}", max_chunk_tokens=50)
    assert [(c.qualified_name, c.code_text) for c in nested] == [("big", "function inner() { return 1 }")]


def test_typescript_and_jsx():
    found = chunks(".ts", "export interface Opt {\n  a: string;\n  b?: number\n  run(x: number): void;\n}\ntype T = { a: 1 };\nexport const f = async <T>(x: T): Promise<T> => x;\nfunction g(x: { a: number }): { b: 1 } { return null as any; }\nexport class Q<T> implements Z {\n  private a: string = 'x';\n  m(a: number): string { return '' }\n  over(a: string): void;\n}\n")
    assert one(found, "Opt").code_text == "interface Opt {\n  a: string\n  b?: number\n  run(x: number): void\n}" and one(found, "Opt").kind == "class"
    assert one(found, "f").kind == "function" and one(found, "g").start_line == 8 and one(found, "Q").code_text.endswith("//   m(a: number)\n}")
    assert found[-1].code_text == "type T = { a: 1 };"
    view = chunks(".tsx", 'export const App = ({ name }: Props) => {\n  return <div className="a">Don\'t {name} <b/></div>;\n};\n')
    assert one(view, "App").language == "tsx"
    assert chunks(".js", "function f() { (")[0].kind == "fallback_window"
    with pytest.raises(ValueError):
        ScriptChunker("ruby")


def test_script_oddities():
    source = """'use strict'
methods.forEach(function (m) {
  app[m] = function (path) { return /a"b/.test(path) };
});
do { a++ } while (a < 3)
switch (a) { case 1: break; default: b() }
export { a, b as c };
export default async function main() { await x }
let n = a / b / c;
(async () => { await 1 })();
class A { #p = 1; static { init() } async *gen() { yield 1 } 'str'() {} [Symbol.iterator]() {} }
if (a) b(); else c()
x = y
++z
"""
    found = chunks(".js", source)
    assert [c.qualified_name for c in found[:-1]] == ["main", "A.gen", "A.'str'", "A.[Symbol.iterator]", "A"]
    assert found[-1].code_text.split("\n")[-3:] == ["if (a) b(); else c()", "x = y", "++z"]
    view = chunks(".tsx", """enum E { A, B }
export default function App<T extends {}>({ a }: Props<T>): JSX.Element {
  const [s, set] = useState<string | null>(null);
  return (<><Foo<T> x={a} onClick={() => set("}")} /> it's {s && <b>{`${s}`}</b>} </>);
}
export abstract class Base { abstract foo(): void; bar(): void {} }
export const useX = function <T>(x: T) { return x };
export interface P extends Q { a: () => void, b: string }
""")
    assert [(c.qualified_name, c.kind) for c in view] == [("App", "function"), ("useX", "function"), ("P", "class"), ("name.tsx:module:1-6", "module_block")]
    assert one(view, "P").code_text == "interface P {\n  a: () => void\n  b: string\n}"


MD = """intro

# A
text

```py
# no
```
## B
b
### C
c
# D #
<h1 align="center">T <b>x</b></h1>

para <h2>not alone</h2>

## E
"""


def test_markdown():
    found = chunks(".md", MD)
    assert [(c.symbol_name, c.qualified_name) for c in found] == [("intro", "name.md"), ("A", "A"), ("B", "A > B"), ("C", "A > B > C"), ("D", "D"), ("T x", "D > T x"), ("E", "D > E")]
    assert "# no" in found[1].code_text and "## B" not in found[1].code_text and found[2].embed_text.startswith("# file: dir/name.md\n# section: A > B\n")
    assert "not alone" in found[5].code_text and all(c.kind == "doc_section" for c in found)
    assert [c.symbol_name for c in chunks(".md", "just text\n")] == ["intro"]
    long = chunks(".md", "# T\n" + "\n".join("w " * 40 for _ in range(70)))
    assert all(c.truncated and c.symbol_name == "T" for c in long) and [(c.start_line, c.end_line) for c in long] == [(1, 60), (51, 71)]


@pytest.mark.parametrize("n,expected", [(0, []), (1, [(1, 1)]), (60, [(1, 60)]), (61, [(1, 60), (51, 61)]), (110, [(1, 60), (51, 110)]), (111, [(1, 60), (51, 110), (101, 111)])])
def test_fallback(n, expected):
    found = FallbackChunker().chunk_file("a/b.txt", "\n".join(str(i) for i in range(n)))
    assert [(c.start_line, c.end_line) for c in found] == expected
    blank = FallbackChunker(Settings(window_lines=2, overlap_lines=0)).chunk_file("a/b.txt", "x\n\n\n\ny")
    assert [c.symbol_name for c in blank] == ["b.txt:window1", "b.txt:window3"]


def test_regular_expressions_after_brackets():
    """A slash after a condition or a block begins a regular expression, after a value it divides."""
    found = chunks(".js", "function f(a) { if (a) /['\"(]/.test(b); return 1 }\n/[(\"]/.exec(x)\nfunction g() { const o = {b: 1} / 2; return (o) / 3 / (b) }\nfunction h() { while (x) /\\//g.test(y) }\nclass A { m() {} }\n/[\"]/;\nfunction k() { for (;;) {} /[\"']/.test(1) }\n")
    assert [c.qualified_name for c in found if c.kind != "module_block"] == ["f", "g", "h", "A.m", "A", "k"]
