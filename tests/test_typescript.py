"""The parser's contract: imports, exports, places, and what isn't a statement."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from migrascope.sources.typescript import _all_tokens, _plain_tokens, exports, imports


def seen(text, tsx=False):
    return [(i.path, i.kind, i.names) for i in imports(text, tsx)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("let n = 0;\nimport {Ledger,Quota,} from \"lib/books\"\nn++", [('"lib/books"', "named", ["Ledger", "Quota"])]),
        ("'use strict'\nimport $store from \"./store.js\" // last", [('"./store.js"', "default", ["$store"])]),
        ("import*as geo from'maps/geo'", [("'maps/geo'", "namespace", ["geo"])]),
        ("import 'zone.js'\nimport \"./setup\"", [("'zone.js'", "side_effect", []), ('"./setup"', "side_effect", [])]),
        ("import type {Shape, Area} from\t'@lib/shapes'", [("'@lib/shapes'", "type_only", ["Shape", "Area"])]),
        ("load(() => import ( 'pages/late' ).then(p => p.default))", [("'pages/late'", "dynamic", [])]),
        ("import { default as first, second as other } from './m'", [("'./m'", "named", ["default", "second"])]),
        ("import D, { A } from 'x'", [("'x'", "default", ["D", "A"])]),
        ("import D, * as N from 'x'", [("'x'", "namespace", ["D", "N"])]),
        ("import {} from 'x'", [("'x'", "side_effect", [])]),
        ("import { type Foo } from 'x'", [("'x'", "named", ["Foo"])]),
        ("import typeFoo from './x'", [("'./x'", "type_only", ["typeFoo"])]),
        ("import  type { X } from './y'", [("'./y'", "named", ["X"])]),
        ("import {\n  A,\n  B,\n} from\n  \"q\"", [('"q"', "named", ["A", "B"])]),
        ("import a from 'a' with { type: 'json' };", [("'a'", "default", ["a"])]),
        ("import x = require('z');", []),
        ("require('x'); export { a } from 'b'; import(`t`); import.meta.url;", []),
        ("", []),
        ("const a = 1;", []),
        ("// import a from 'b'\n/* import 'c' */", []),
        ("const s = \"import 'd'\"; const t = `import 'e' ${`import 'f'`}`;", []),
        ("const t = `${import('f')}`;", [("'f'", "dynamic", [])]),
        ("const r = /import 'h'/; const d = a / import('i') / b;", [("'i'", "dynamic", [])]),
        ("import a from 'b", []),
        ("import {a from 'b'; import c from 'c'", [("'c'", "default", ["c"])]),
    ],
)
def test_imports(text, want):
    assert seen(text) == want


def test_tsx():
    text = "import { h } from 'preact'; import cards from './cards'; export default () => <ul t='import \"x\"'>Don't import {y} from 'z' {import('k')} <li/> it's</ul>; import Q from 'q'"
    assert [x[0] for x in seen(text, True)] == ["'preact'", "'./cards'", "'k'", "'q'"]
    text = "const f = <T,>(x: T) => x; import A from 'a'; const c = a < b; function F() { return <><p>it's</p></> } import C from 'c'"
    assert [x[0] for x in seen(text, True)] == ["'a'", "'c'"]


def test_places_are_bytes():
    one = imports("import { tally } from './count'")[0]
    assert one.location == (1, 0, 0)
    text = "// é\n/* ü */ import 'a';\nconst ö = import('b');"
    a, b = imports(text)
    assert a.location == (2, 9, len(text[: text.index("import 'a'")].encode()))
    assert b.location == (3, len("const ö = import(".encode()), len(text[: text.index("'b'")].encode()))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("export class Tariff<T> extends Base<T> implements Priced {\n  private x = 1\n}", [("Tariff", "class", None)]),
        ("export interface Priced extends Named {\n  readonly net?: number\n}", [("Priced", "interface", None)]),
        ("const a = 1, b = 2\nexport {a, b as c,}", [("a", "named", None), ("b", "named", None)]),
        ("export {min, max as most} from \"./limits\"", [("min", "re_export", '"./limits"'), ("max", "re_export", '"./limits"')]),
        ("export default class Q {}", [("Q", "class", None)]),
        ("export const a = 1; export * from 'k'; export type T = {}; export enum E {}; export function f() {}", []),
        ("// export class A {}\nconst s = 'export class B {}';", []),
    ],
)
def test_exports(text, want):
    assert [(e.name, e.kind, e.reexport_source) for e in exports(text)] == want


NAME = st.from_regex(r"[A-Z][a-z]{1,6}", fullmatch=True)
PATH = st.from_regex(r"[a-z./_-]{1,12}", fullmatch=True)
NOISE = st.sampled_from(["// import 'n'\n", "/* import 'n' */", "const a = 'import x';\n", "let b = `import 'n' ${1 + 1}`;\n", "if (a / 2 > 1) { f(/import 'r'/g) }\n", "x = {a: [1, 2]};\n", "\n", "class A { m() { return `${`import 'q'`}` } }\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["named", "default", "namespace", "side_effect", "type_only", "dynamic"]), st.lists(NAME, min_size=1, max_size=3), PATH, NOISE), max_size=8))
def test_round_trip(model):
    text, want = "", []
    for kind, names, path, noise in model:
        q = f"'{path}'"
        code = {
            "named": f"import {{ {', '.join(names)} }} from {q};",
            "default": f"import {names[0]} from {q};",
            "namespace": f"import * as {names[0]} from {q};",
            "side_effect": f"import {q};",
            "type_only": f"import type {{ {', '.join(names)} }} from {q};",
            "dynamic": f"void import({q});",
        }[kind]
        got = {"named": names, "type_only": names, "default": names[:1], "namespace": names[:1]}.get(kind, [])
        text += noise + code + "\n"
        want.append((q, kind, got))
    assert seen(text) == want
    for i in imports(text):
        at = text.encode()[i.location.byte_offset :].decode()
        assert at.startswith("import" if i.kind != "dynamic" else i.path)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"aé$_{}()[]<>.,;:'\"`\\/*\n 19eE+-#@=", "//", "/*", "*/", "import ", "'x'", "`t`", "\\u{41}"]), max_size=30).map("".join))
def test_plain_lexer_agrees(text):
    fast = _plain_tokens(text) if "${" not in text else None
    assert fast is None or fast == _all_tokens(text, False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="import export{}from'\"`$<>/*\\\n (),;aé=", max_size=80), st.booleans())
def test_never_fails(text, tsx):
    imports(text, tsx)
    exports(text, tsx)
