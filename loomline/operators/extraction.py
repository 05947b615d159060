"""Source extraction: functions, types, components, imports and branches of TypeScript text, as one nested record per file.

A tokenizer walks the text once; declarations are then matched on its tokens. It knows strings, templates, comments,
regular expressions, nested brackets and JSX, and aims at the constructs of declarations, not at the whole grammar.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_hash
from ..sources.scratch import ship

FUNCTION = "struct<name:string,params:string,return_type:string,is_async:boolean,is_exported:boolean,start_line:int,end_line:int>"
TYPE = "struct<kind:string,name:string,body:string,is_exported:boolean,start_line:int,end_line:int>"
COMPONENT = "struct<name:string,props:string,hooks:array<string>,is_default:boolean>"
CHUNK = f"functions array<{FUNCTION}>, types array<{TYPE}>, components array<{COMPONENT}>, imports array<string>, exports array<string>, cyclomatic int"

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\?\.|\?\?|&&|\|\||[=!]==?|<=|>=|\+\+|--|\.\.\.|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Words after which a slash starts a regular expression and ``<`` may start JSX.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield", "default"}
_BRANCH_WORDS = {"if", "for", "while", "do", "case", "catch"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    jsx: bool = False  # a ``<`` that opens an element
    mate: int = -1  # place of the matching bracket


def _template_end(s: str, i: int) -> int:
    """End of the template that starts at i; substitutions nest."""
    i += 1
    while i < len(s):
        if s[i] == "\\":
            i += 2
        elif s[i] == "`":
            return i + 1
        elif s.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(s) and depth:
                if s[i] == "`":
                    i = _template_end(s, i)
                    continue
                depth += {"{": 1, "}": -1}.get(s[i], 0)
                i += 1
        else:
            i += 1
    return i


def tokens(s: str, tsx: bool) -> list[Token]:
    out: list[Token] = []
    i, stack = 0, []
    text_until: list[int] = []  # depths of open elements, inside which plain text stands

    def value_next() -> bool:
        """Whether a value, not an operator, is due."""
        if not out:
            return True
        p = out[-1]
        return p.text in _BEFORE_VALUE if p.kind == "word" else p.kind == "op" and p.text not in {")", "]", "}"}

    while i < len(s):
        if text_until and len(stack) == text_until[-1] and (not out or out[-1].kind == "tag"):
            m = re.compile(r"[^<{]*", re.S).match(s, i)
            i = m.end()
            if i >= len(s):
                break
            if s[i] == "<":
                i = _tag(s, i, out, text_until, len(stack))
                continue
        if s[i] == "`":
            end = _template_end(s, i)
            out.append(Token("string", s[i:end], i, end))
            i = end
            continue
        if s[i] == "/" and value_next() and (m := _REGEX.match(s, i)):
            out.append(Token("regex", m[0], i, m.end()))
            i = m.end()
            continue
        if tsx and s[i] == "<" and value_next() and re.match(r"<(?:>|[A-Za-z][\w.]*(?:\s+[\w:-]+\s*(?:=|/?>)|\s*/?>|\s*\{))", s[i : i + 200]) and not re.match(r"<[A-Za-z]\w*\s*(?:,|extends\b)[^>]*>\s*\(", s[i : i + 200]):
            i = _tag(s, i, out, text_until, len(stack))
            continue
        m = _TOKEN.match(s, i)
        kind = m.lastgroup
        if kind not in ("space", "comment"):
            t = Token(kind, m[0], i, m.end())
            if t.text in _OPEN and kind == "op":
                stack.append(len(out))
            elif t.text in _CLOSE and kind == "op" and stack and out[stack[-1]].text == _CLOSE[t.text]:
                t.mate = stack.pop()
                out[t.mate].mate = len(out)
            out.append(t)
            if t.text == "}" and text_until and len(stack) == text_until[-1]:
                out[-1].kind = "tag"  # back in an element's text
        i = m.end()
    return out


def _tag(s: str, i: int, out: list[Token], text_until: list[int], depth: int) -> int:
    """Read one tag; opens or closes an element. Attribute values in braces are skipped over as a whole but for hooks and branches, which don't stand there."""
    start, closing = i, s.startswith("</", i)
    i += 2 if closing else 1
    while i < len(s) and s[i] != ">":
        if s[i] in "\"'":
            j = s.find(s[i], i + 1)
            i = len(s) if j < 0 else j + 1
        elif s[i] == "{":
            level, i = 1, i + 1
            while i < len(s) and level:
                if s[i] == "`":
                    i = _template_end(s, i)
                    continue
                if s[i] in "\"'" and (m := _TOKEN.match(s, i)) and m.lastgroup == "string":
                    i = m.end()
                    continue
                level += {"{": 1, "}": -1}.get(s[i], 0)
                i += 1
        else:
            i += 1
    alone = i > start and s[i - 1] == "/"
    i = min(len(s), i + 1)
    if closing:
        if text_until:
            text_until.pop()
    elif not alone:
        text_until.append(depth)
    out.append(Token("tag" if text_until else "op", ")" if not text_until else s[start:i], start, i, jsx=True))
    return i


class Source:
    """Tokens of a text with what is declared in it."""

    def __init__(self, text: str, tsx: bool):
        self.text, self.t = text, tokens(text, tsx)
        self.lines = [m.start() for m in re.finditer("\n", text)]

    def line(self, place: int) -> int:
        return bisect_right(self.lines, place - 1) + 1

    def at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def past(self, i: int) -> int:
        """Place after the bracket, or generic list, that starts at i; i itself without one."""
        if self.at(i) in _OPEN:
            return self.t[i].mate + 1 if self.t[i].mate >= 0 else len(self.t)
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            x = self.at(i)
            if x in _OPEN:
                i = self.past(i)
                continue
            depth += (x == "<") - (x == ">")
            i += 1
            if depth == 0:
                break
        return i

    def generics(self, i: int) -> int:
        return self.past(i) if self.at(i) == "<" else i

    def type_end(self, i: int, stops: set[str]) -> int:
        """Place after a type that starts at i: it ends before a stop at its own level, or where a new statement begins."""
        first = True
        while i < len(self.t):
            x = self.at(i)
            if not first and x in stops:
                return i
            if x in _OPEN and not (x == "{" and not first and self.at(i - 1) not in {"|", "&", ":", "=>", "=", ",", "<", "("}):
                i = self.past(i)
            elif x == "{":
                return i
            elif x == "<":
                i = self.past(i)
            elif x in {"|", "&", ".", "=>", "?", ":", "extends", "keyof", "typeof", "readonly", "infer", "is", "in", "new", "unique"} or first:
                i += 1
                first = x in {"|", "&", ".", "=>", "?", ":", "extends", "keyof", "typeof", "readonly", "infer", "is", "in", "new", "unique"}
                continue
            else:
                if x in {")", "]", "}", ",", ";"} or self.line(self.t[i].start) > self.line(self.t[i - 1].end):
                    return i
                i += 1
            first = False
        return i

    def span(self, a: int, b: int) -> str:
        return self.text[self.t[a].start : self.t[b - 1].end].strip() if b > a else ""

    def expression_end(self, i: int) -> int:
        """Place after an expression: at a comma or semicolon of its level, or where a line begins a new statement."""
        while i < len(self.t):
            x = self.at(i)
            if x in {",", ";", ")", "]", "}"} and not self.t[i].jsx:
                return i
            nxt = self.past(i) if x in _OPEN else i + 1
            if nxt < len(self.t) and self.line(self.t[nxt].start) > self.line(self.t[nxt - 1].end - 1):
                last, y = self.t[nxt - 1], self.t[nxt]
                goes_on = (last.kind == "op" and last.text not in {")", "]", "}", "++", "--"}) or last.kind == "tag" or y.kind == "tag" or (y.kind == "op" and y.text not in {"{", "}", "++", "--", "(", "["} and not y.jsx)
                if not goes_on:
                    return nxt
            i = nxt
        return i

    def functions(self) -> list[dict]:
        """Declarations in text order: name, params, return_type, is_async, exported, default, first, last (places), arrow."""
        out, n = [], len(self.t)
        for i in range(n):
            x, k = self.at(i), self.t[i].kind
            if k == "word" and x == "function" and self.at(i - 1) not in {".", "?."}:
                star = i + 1 + (self.at(i + 1) == "*")
                if star >= n or self.t[star].kind != "word":
                    continue
                head = i - (self.at(i - 1) == "async")
                statement = head == 0 or self.at(head - 1) in {";", "}", "{", "export", "default", "declare"} or self.line(self.t[head - 1].end) < self.line(self.t[head].start)
                if not statement or self.at(head - 1) in {"=", "(", ",", "return", ":", "=>"}:
                    continue
                p = self.generics(star + 1)
                end = self.past(p)
                ret, body = None, end
                if self.at(end) == ":":
                    body = self.type_end(end + 1, {"{", ";"})
                    ret = self.span(end + 1, body)
                if self.at(body) != "{":
                    continue  # a signature without body
                default = self.at(head - 1) == "default"
                exported = self.at(head - 1) == "export" or (default and self.at(head - 2) == "export")
                first = head - default - exported
                out.append({"name": self.at(star), "params": self.span(p, end), "return_type": ret, "is_async": head < i, "exported": exported, "default": default, "first": first, "inner": head, "last": self.past(body) - 1, "arrow": False})
            elif k == "word" and x in {"const", "let"} and self.at(i - 1) not in {".", "?."}:
                exported, j = self.at(i - 1) == "export", i + 1
                while j < n and self.t[j].kind == "word":
                    name, e = j, j + 1
                    if self.at(e) == ":":
                        e = self.type_end(e + 1, {"=", ",", ";"})
                    if self.at(e) != "=":
                        break
                    stop = self.expression_end(e + 1)
                    is_async = self.at(e + 1) == "async" and self.at(e + 2) != "=>"
                    p = self.generics(e + 1 + is_async)
                    end = self.past(p) if self.at(p) == "(" else p + 1
                    ret, arrow = None, end
                    if self.at(end) == ":" and self.at(p) == "(":
                        arrow = self.type_end(end + 1, {"=>"})
                        ret = self.span(end + 1, arrow)
                    if self.at(arrow) == "=>" and (self.at(p) == "(" or self.t[p].kind == "word"):
                        last = stop if self.at(stop) == ";" else stop - 1
                        out.append({"name": self.at(name), "params": self.span(p, end), "return_type": ret, "is_async": is_async, "exported": exported, "default": False, "first": i - exported, "inner": name, "last": last, "arrow": True})
                    if self.at(stop) != ",":
                        break
                    j = stop + 1
        return out

    def types(self) -> list[dict]:
        out = []
        for i, t in enumerate(self.t):
            if t.kind != "word" or t.text not in {"interface", "type"} or i + 1 >= len(self.t) or self.t[i + 1].kind != "word":
                continue
            exported = self.at(i - 1) == "export"
            e = self.generics(i + 2)
            if t.text == "interface":
                while e < len(self.t) and self.at(e) != "{":
                    e = self.past(e) if self.at(e) in {"<", "("} else e + 1
                if e >= len(self.t):
                    continue
                body, last = self.span(e, self.past(e)), self.past(e) - 1
            else:
                if self.at(e) != "=":
                    continue
                end = self.type_end(e + 1, {";"})
                body, last = self.span(e + 1, end), end if self.at(end) == ";" else end - 1
            out.append({"kind": t.text, "name": self.at(i + 1), "body": body, "exported": exported, "first": i - exported, "last": last})
        return out

    def imports(self) -> list[str]:
        out = []
        for i, t in enumerate(self.t):
            if t.kind == "word" and t.text == "import" and self.at(i - 1) not in {".", "?."} and self.at(i + 1) not in {"(", "."}:
                j = i + 1
                while j < len(self.t) and self.t[j].kind != "string" and self.at(j) != ";":
                    j += 1
                if j < len(self.t) and self.t[j].kind == "string" and len(self.at(j)) > 2:
                    out.append(self.at(j)[1:-1])
        return out

    def branches(self) -> int:
        n = 0
        for i, t in enumerate(self.t):
            if t.kind == "word" and t.text in _BRANCH_WORDS and self.at(i - 1) not in {".", "?."} and self.at(i + 1) not in {":", "=", ",", ")"}:
                done = t.text == "while" and self.at(i - 1) == "}" and self._closes_do(i - 1)
                n += not done
            elif t.kind == "op" and t.text == "?" and self.at(i + 1) not in {":", ")", ",", "=", ";", "(", "]"}:
                n += 1
            elif t.kind == "op" and t.text == "?" and self.at(i + 1) == "(" and self.at(i - 1) not in {"}"}:
                after = self.past(i + 1)
                n += self.at(after) != ":" or self.at(after + 1) != "=>"
        return n

    def _closes_do(self, i: int) -> bool:
        return self.t[i].mate > 0 and self.at(self.t[i].mate - 1) == "do"


def cut_body(body: str, most: int = 250) -> str:
    if len(body) <= most:
        return body
    cut = body[:most]
    left = cut.count("{") - cut.count("}")
    return cut.rstrip() + (" /* … */ " + "}" * left if left > 0 else " /* … */")


def extract(path: str, text: str | None, *, faithful_async: bool = False, dedupe_components: bool = False) -> dict | None:
    """The record of one file; None for other suffixes than .ts and .tsx.

    Async arrows are flagged unless ``faithful_async``; exported components are listed twice unless ``dedupe_components``,
    as they are found once as exported and once as such.
    """
    if not path.endswith((".ts", ".tsx")):
        return None
    s = Source(text or "", path.endswith(".tsx"))
    declared = s.functions()
    ranked = [f for arrow in (False, True) for f in ([g for g in declared if g["arrow"] is arrow and g["exported"] and not g["default"]] + [g for g in declared if g["arrow"] is arrow])]
    functions, seen = [], set()
    for f in ranked:
        if f["name"] not in seen:
            seen.add(f["name"])
            functions.append((f["name"], f["params"], f["return_type"], f["is_async"] and not (faithful_async and f["arrow"]), f["exported"], s.line(s.t[f["first"]].start), s.line(s.t[f["last"]].end - 1)))
    found = s.types()
    types, seen = [], set()
    for kind in ("interface", "type"):
        own = [x for x in found if x["kind"] == kind]
        for x in [y for y in own if y["exported"]] + own:
            if x["name"] not in seen:
                seen.add(x["name"])
                types.append((x["kind"], x["name"], cut_body(x["body"]), x["exported"], s.line(s.t[x["first"]].start), s.line(s.t[x["last"]].end - 1)))
    components, seen = [], set()
    for f in ranked:
        inside = s.t[f["inner"] : f["last"] + 1]
        if not re.fullmatch(r"[A-Z][a-zA-Z0-9]*", f["name"]) or not any(x.jsx for x in inside) or (dedupe_components and f["name"] in seen):
            continue
        seen.add(f["name"])
        hooks = [s.at(i) for i in range(f["inner"], f["last"]) if s.t[i].kind == "word" and re.match(r"use[A-Z]", s.at(i)) and s.at(s.generics(i + 1)) == "(" and s.at(i - 1) not in {".", "?."}]
        components.append((f["name"], f["params"] or None, list(dict.fromkeys(hooks)), f["default"]))
    return {
        "functions": functions,
        "types": types,
        "components": components,
        "imports": s.imports(),
        "exports": [f[0] for f in functions if f[4]] + [x[1] for x in types if x[3]] + [c[0] for c in components],
        "cyclomatic": 1 + s.branches(),
    }


def extracted(sources: DataFrame, **how: bool) -> DataFrame:
    """(path, file_hash, functions, types, components, imports, exports, cyclomatic) of (path, content); files that can't be parsed are left out.

    Files stay where they are read; parsing is by batches in Python, as no expression can say it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("functions", "types", "components")
        fields = {"functions": ("name", "params", "return_type", "is_async", "is_exported", "start_line", "end_line"), "types": ("kind", "name", "body", "is_exported", "start_line", "end_line"), "components": ("name", "props", "hooks", "is_default")}
        for b in batches:
            rows = []
            for path, text, sha in zip(b["path"], b["content"], b["file_hash"], strict=True):
                try:
                    r = extract(path, text, **how)
                except (IndexError, RecursionError):
                    r = None  # unparsable: the caller deletes what it had
                if r is not None:
                    rows.append({"path": path, "file_hash": sha, **r, **{k: [dict(zip(fields[k], x, strict=True)) for x in r[k]] for k in names}})
            yield pd.DataFrame(rows, columns=["path", "file_hash", *names, "imports", "exports", "cyclomatic"])

    ship(sources.sparkSession)
    rows = sources.select("path", "content", source_hash(F.coalesce("content", F.lit(""))).alias("file_hash"))
    return rows.mapInPandas(run, f"path string, file_hash string, {CHUNK}")
