from loomline.operators.extraction import cut_body, extract, extracted, tokens
from tests.small_project import DECLARED, PROJECT

CLOCK = """// a wall clock with alarms
import { padTime } from "../time/pad"
import Face, * as dial from "./face"

type Alarm = { at: number; label?: string }

export default class Ring { ring() { return 1 } }

export async function nextAlarm(list: Alarm[], now: number): Promise<Alarm | undefined> {
  for (const a of list) {
    if (a.at > now && a.label) return a
  }
  do { now -= 60 } while (now > 0)
  switch (list.length) { case 0: return undefined; case 1: return list[0]; default: break }
  try { beep() } catch { mute() }
  return list.length ? list[0] : undefined
}

const ticks = (count: number): number[] => Array.from({ length: count }, (_, i) => i * 6)

export const Clock = ({ zone, alarms }: { zone: string; alarms: Alarm[] }) => {
  const now = useNow(zone)
  const [open, setOpen] = useToggle(false)
  const text = `${open ? "o" : `c ${1}`} while if`
  return (
    <Face when={now} onClick={() => { if (open) setOpen(false) }}>
      for {text} {ticks(12).map((d) => <i key={d}>{padTime(d)}</i>)}
    </Face>
  )
}
"""


def names(rows):
    return [r[0] for r in rows]


def test_declarations_and_lines():
    r = extract("ui/Clock.tsx", CLOCK)
    assert r["functions"] == [
        ("nextAlarm", "(list: Alarm[], now: number)", "Promise<Alarm | undefined>", True, True, 9, 17),
        ("Clock", "({ zone, alarms }: { zone: string; alarms: Alarm[] })", None, False, True, 21, 30),
        ("ticks", "(count: number)", "number[]", False, False, 19, 19),
    ]
    assert r["imports"] == ["../time/pad", "./face"]
    assert [(x[0], x[1], x[3], x[4]) for x in r["types"]] == [("type", "Alarm", False, 5)]
    assert [(c[0], c[2], c[3]) for c in r["components"]] == [("Clock", ["useNow", "useToggle"], False)] * 2


def test_options():
    assert [c[0] for c in extract("x.tsx", CLOCK, dedupe_components=True)["components"]] == ["Clock"]
    text = "const a = async () => 1\nasync function b() {}"
    assert [f[3] for f in extract("x.tsx", text)["functions"]] == [True, True]
    assert [f[3] for f in extract("x.tsx", text, faithful_async=True)["functions"]] == [True, False]
    assert extract("x.md", "text") is None


def test_types():
    text = "export interface A<T> extends B<T> {\n  a: T\n}\ninterface A { again: 1 }\nexport type Shade =\n  | 'dark'\n  | { grey: number }\ntype F = (a: string) => Promise<void>;\nconst x = 1\n"
    r = extract("t.ts", text)
    assert [(x[0], x[1], x[3], x[4], x[5]) for x in r["types"]] == [("interface", "A", True, 1, 3), ("type", "Shade", True, 5, 7), ("type", "F", False, 8, 8)]
    assert r["types"][2][2] == "(a: string) => Promise<void>" and r["exports"] == ["A", "Shade"]


def test_strings_comments_and_regular_expressions_hide_code():
    text = 'const a = "function no() {}" // if (x)\n/* if */ const r = /[/"]if{/g\nconst t = `if ${a ? 1 : 2}`\nconst o = { if: 1, ...a }\nx?.y ?? z\n'
    r = extract("t.ts", text)
    assert r["functions"] == [] and r["cyclomatic"] == 1
    assert [x.kind for x in tokens("a = /x/ / 2", False)] == ["word", "op", "regex", "op", "number"]


def test_cyclomatic():
    text = "function f(a?: number, b?: (x: string) => void) { if (a) {} else if (b) {} for (;;) {} for (const k in o) {} while (1) {} do {} while (0)\n switch (a) { case 1: case 2: default: } try {} catch (e) {} return a ? 1 : (b ? 2 : 3) }"
    assert extract("t.ts", text)["cyclomatic"] == 1 + 11


def test_cut_body():
    assert cut_body("x" * 250) == "x" * 250
    assert cut_body("{ {" + " " * 300) == "{ { /* … */ }}" and cut_body("}{" + "y" * 300) == "}{" + "y" * 248 + " /* … */"


def test_table(spark):
    rows = {r.path: r for r in extracted(spark.createDataFrame([*PROJECT.items(), ("a.md", "x"), ("b.ts", None)], "path string, content string")).collect()}
    assert set(rows) == {*PROJECT, "b.ts"}
    assert rows["shop/cart.ts"].cyclomatic == 3 and names(rows["shop/prices.ts"].functions) == []
    assert {f.name for f in rows["shop/cart.ts"].functions} == {"fetchLines", "addLine"}
    assert rows["shop/LineTable.tsx"].components[0].hooks == ["useSorted"] and rows["shop/LineTable.tsx"].cyclomatic == 1


def test_small_project_read_by_hand(spark):
    """Every declaration, import, export and complexity that was read off by hand, and no other."""
    got = set()
    for r in extracted(spark.createDataFrame(list(PROJECT.items()), "path string, content string")).collect():
        for kind, found in (("function", r.functions), ("type", r.types)):
            got |= {(r.path, kind, i, x.name, x.start_line, x.end_line) for i, x in enumerate(found)}
        for kind, names in (("component", [x.name for x in r.components]), ("import", r.imports), ("export", r.exports), ("cyclomatic", [str(r.cyclomatic)])):
            got |= {(r.path, kind, i, x, None, None) for i, x in enumerate(names)}
    assert got == set(DECLARED)
