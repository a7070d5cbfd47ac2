"""``extract_facts``: Java source text -> declaration-level fact rows.

This is the one place with Python per row: each task turns its own files into fact rows with a
small declaration-level scanner (tokens, braces, annotations, members), and every later step is
a Spark join over those rows. Bodies are scanned flat for calls and assignments, so calls in
lambdas and anonymous classes count as the enclosing method's. A file that cannot be scanned
becomes one ``parse_failures`` row carrying the first problem; it never aborts the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIMITIVES = {"boolean", "byte", "short", "int", "long", "char", "float", "double", "void"}
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "sealed",
             "strictfp", "default", "synchronized", "native", "transient", "volatile"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new",
             "super", "this", "throw", "assert", "else", "do", "case", "yield"}

_TOKEN = re.compile(r'''
    (?P<ws>\s+)
  | (?P<lc>//[^\n]*)
  | (?P<bc>/\*.*?\*/)
  | (?P<tb>"""(?:\\.|(?!""").)*?""")
  | (?P<str>"(?:\\.|[^"\\\n])*")
  | (?P<chr>'(?:\\.|[^'\\\n])+')
  | (?P<id>[A-Za-z_$][A-Za-z0-9_$]*)
  | (?P<num>\d[\w.]*)
  | (?P<op>->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|\.\.\.|[{}()\[\];,.@=<>?:!~+\-*/&|^%])
''', re.S | re.X)


class ParseError(Exception):
    pass


@dataclass
class Tok:
    kind: str
    text: str
    line: int
    start: int
    end: int


def tokenize(src: str) -> list[Tok]:
    toks, pos, line, n = [], 0, 1, len(src)
    while pos < n:
        m = _TOKEN.match(src, pos)
        if not m:
            raise ParseError(f"line {line}: unexpected character {src[pos]!r}")
        kind = m.lastgroup
        text = m.group()
        if kind not in ("ws", "lc", "bc"):
            toks.append(Tok("str" if kind == "tb" else kind, text, line, pos, m.end()))
        line += text.count("\n")
        pos = m.end()
    return toks


def _unquote(s: str) -> str:
    if s.startswith('"""'):
        return s[3:-3]
    return s[1:-1].replace('\\"', '"').replace("\\\\", "\\")


class Scanner:
    def __init__(self, src: str, path: str):
        self.src, self.path = src, path
        self.t = tokenize(src)
        self.i = 0
        self.rows: list[dict] = []
        self.package = ""
        self.type_ord = 0
        self.ann_ord = 0

    # --- token helpers -------------------------------------------------------------------
    def peek(self, k=0) -> Tok | None:
        j = self.i + k
        return self.t[j] if j < len(self.t) else None

    def at(self, text, k=0) -> bool:
        p = self.peek(k)
        return p is not None and p.text == text

    def take(self, text=None) -> Tok:
        p = self.peek()
        if p is None:
            raise ParseError("unexpected end of file")
        if text is not None and p.text != text:
            raise ParseError(f"line {p.line}: expected '{text}' but found '{p.text}'")
        self.i += 1
        return p

    def ident(self) -> Tok:
        p = self.take()
        if p.kind != "id":
            raise ParseError(f"line {p.line}: expected an identifier but found '{p.text}'")
        return p

    def skip_balanced(self, open_, close):
        depth = 0
        start = self.i
        while True:
            p = self.take()
            if p.text == open_:
                depth += 1
            elif p.text == close:
                depth -= 1
                if depth == 0:
                    return start, self.i
            if depth < 0:
                raise ParseError(f"line {p.line}: unbalanced '{close}'")

    def skip_generics(self):
        if not self.at("<"):
            return
        depth = 0
        while True:
            p = self.take()
            if p.text == "<":
                depth += 1
            elif p.text == ">":
                depth -= 1
            elif p.text in (">>", ">>>"):
                depth -= len(p.text)
            if depth <= 0:
                return

    def qualified(self) -> str:
        parts = [self.ident().text]
        while self.at(".") and self.peek(1) is not None and self.peek(1).kind == "id":
            self.take(".")
            parts.append(self.ident().text)
        return ".".join(parts)

    def emit(self, kind, **cols):
        cols["fact_kind"] = kind
        cols["path"] = self.path
        self.rows.append(cols)

    # --- compilation unit ------------------------------------------------------------------
    def run(self) -> list[dict]:
        anns = self.annotations_and_modifiers()[0]
        if self.at("package"):
            self.take("package")
            self.package = self.qualified()
            self.take(";")
            anns = []
        imp_ord = 0
        while self.at("import"):
            self.take("import")
            static = False
            if self.at("static"):
                self.take("static")
                static = True
            name = self.qualified()
            wildcard = False
            if self.at("."):
                self.take(".")
                self.take("*")
                wildcard = True
            self.take(";")
            self.emit("imports", ord=imp_ord, name=name, is_static=static, is_wildcard=wildcard)
            imp_ord += 1
        while self.peek() is not None:
            if self.at(";"):
                self.take(";")
                continue
            anns2, mods = self.annotations_and_modifiers()
            self.type_decl(anns + anns2, mods, None, top=True)
            anns = []
        return self.rows

    def annotations_and_modifiers(self):
        anns, mods = [], set()
        while True:
            p = self.peek()
            if p is None:
                return anns, mods
            if p.text == "@" and not self.at("interface", 1):
                anns.append(self.annotation())
            elif p.text in MODIFIERS:
                mods.add(self.take().text)
            elif p.text == "non" and self.at("-", 1) and self.at("sealed", 2):
                self.i += 3
            else:
                return anns, mods

    def annotation(self) -> dict:
        at = self.take("@")
        name = self.qualified()
        shape, values = "marker", []
        end = self.t[self.i - 1].end
        if self.at("("):
            s, e = self.skip_balanced("(", ")")
            inner = self.t[s + 1:e - 1]
            end = self.t[e - 1].end
            shape, values = self.annotation_args(inner)
        return {"written_name": name, "simple_name": name.split(".")[-1], "shape": shape,
                "text": self.src[at.start:end], "values": values, "line": at.line}

    def annotation_args(self, toks: list[Tok]):
        if not toks:
            return "normal", []
        pairs = []
        if len(toks) >= 2 and toks[0].kind == "id" and toks[1].text == "=":
            for chunk in _split_top(toks, ","):
                if len(chunk) < 3 or chunk[1].text != "=":
                    raise ParseError(f"line {chunk[0].line}: malformed annotation argument")
                pairs.append((chunk[0].text, chunk[2:]))
            shape = "normal"
        else:
            pairs.append(("value", toks))
            shape = "single"
        values = []
        for attr, vt in pairs:
            if vt and vt[0].text == "{" and vt[-1].text == "}":
                for k, el in enumerate(_split_top(vt[1:-1], ",")):
                    if el:
                        values.append((attr, k, *_expr_kind(el, self.src), True))
            else:
                values.append((attr, 0, *_expr_kind(vt, self.src), False))
        return shape, values

    def emit_annotations(self, owner_kind, owner_id, anns):
        for k, a in enumerate(anns):
            self.emit("annotations", owner_kind=owner_kind, owner_id=owner_id, ord=k,
                      written_name=a["written_name"], simple_name=a["simple_name"],
                      shape=a["shape"], text=a["text"], line=a["line"])
            for attr, vo, kind, text, in_array in a["values"]:
                self.emit("annotation_values", owner_id=owner_id, annotation_ord=k, attr=attr,
                          ord=vo, expr_kind=kind, expr_text=text, in_array=in_array)

    # --- types -------------------------------------------------------------------------------
    def type_ref(self):
        """A type use: written name (no generics), top-level type arguments, primitive flag."""
        start = self.i
        name = self.qualified()
        args = []
        if self.at("<"):
            s = self.i
            self.skip_generics()
            inner = self.t[s + 1:self.i - 1]
            for chunk in _split_top(inner, ","):
                ids = [x.text for x in chunk if x.kind == "id" and x.text not in ("extends", "super")]
                args.append(".".join(_leading_qualified(chunk)) if ids else "?")
            while self.at(".") and self.peek(1) is not None and self.peek(1).kind == "id":
                self.take(".")
                name += "." + self.ident().text
                self.skip_generics()
        while self.at("[") and self.at("]", 1):
            self.i += 2
        if self.at("..."):
            self.take("...")
        raw = self.src[self.t[start].start:self.t[self.i - 1].end]
        return name, raw, args, name in PRIMITIVES

    def type_decl(self, anns, mods, parent, top=False):
        kw = self.take()
        is_annotation = False
        if kw.text == "@":
            self.take("interface")
            is_annotation = True
            kind = "interface"
        else:
            kind = kw.text
        if kind not in ("class", "interface", "enum", "record"):
            raise ParseError(f"line {kw.line}: expected a type declaration but found '{kw.text}'")
        name = self.ident().text
        fqcn = (f"{parent}.{name}" if parent else (f"{self.package}.{name}" if self.package else name))
        self.skip_generics()
        if kind == "record" and self.at("("):
            self.skip_balanced("(", ")")
        sup = []
        while self.peek() is not None and self.peek().text in ("extends", "implements", "permits"):
            rel = self.take().text
            while True:
                written, _, _, _ = self.type_ref()
                if rel != "permits":
                    sup.append((rel, written))
                if not self.at(","):
                    break
                self.take(",")
        if not self.at("{"):
            p = self.peek()
            raise ParseError(f"line {p.line if p else '?'}: expected '{{' after type header")
        visible = kind in ("class", "interface")  # records and enums are not indexed
        if not visible:
            self.skip_balanced("{", "}")
            return
        self.type_ord += 1
        self.emit("types", fqcn=fqcn, simple_name=name, package=self.package, type_ord=self.type_ord,
                  line=kw.line, is_interface=kind == "interface", is_annotation=is_annotation,
                  is_top_level=top, parent_fqcn=parent)
        for k, (rel, written) in enumerate(sup):
            self.emit("supertypes", fqcn=fqcn, relation=rel, ord=k, written_name=written)
        self.emit_annotations("type", fqcn, anns)
        self.body(fqcn, name)

    def body(self, fqcn, simple):
        self.take("{")
        field_ord = method_ord = 0
        while not self.at("}"):
            if self.peek() is None:
                raise ParseError("unexpected end of file inside a type body")
            if self.at(";"):
                self.take(";")
                continue
            if self.at("{") or (self.at("static") and self.at("{", 1)):
                if self.at("static"):
                    self.take("static")
                self.skip_balanced("{", "}")
                continue
            anns, mods = self.annotations_and_modifiers()
            p = self.peek()
            if p is None:
                raise ParseError("unexpected end of file inside a type body")
            if p.text in ("class", "interface", "enum", "record") or (p.text == "@" and self.at("interface", 1)):
                if p.text == "record" and not (self.peek(1) and self.peek(1).kind == "id" and self.peek(2)
                                               and self.peek(2).text in ("(", "<")):
                    pass  # a field or method whose type is named 'record'
                else:
                    self.type_decl(anns, mods, fqcn)
                    continue
            self.skip_generics()
            if self.peek().kind == "id" and self.at("(", 1) and self.peek().text == simple:
                self.ident()  # constructor: parameters and body only
                self.params(None, None)
                self.throws()
                self.method_body(fqcn, None)
                continue
            rtype, rraw, rargs, rprim = self.type_ref()
            name_tok = self.ident()
            if self.at("("):
                m_ord = method_ord
                method_ord += 1
                owner = f"{fqcn}#m{m_ord}"
                self.emit("methods", fqcn=fqcn, ord=m_ord, name=name_tok.text, line=name_tok.line,
                          is_private="private" in mods, is_static="static" in mods, return_type=rtype)
                self.emit_annotations("method", owner, anns)
                self.params(fqcn, m_ord)
                while self.at("[") and self.at("]", 1):
                    self.i += 2
                self.throws()
                if self.at("default"):  # annotation element default value
                    self.take("default")
                    self.skip_expr()
                    self.take(";")
                elif self.at(";"):
                    self.take(";")
                else:
                    self.method_body(fqcn, m_ord)
                continue
            # fields: one or more declarators
            while True:
                while self.at("[") and self.at("]", 1):
                    self.i += 2
                init_kind = init_text = None
                init_type = None
                if self.at("="):
                    self.take("=")
                    s = self.i
                    self.skip_expr()
                    et = self.t[s:self.i]
                    init_kind, init_type, init_text = _init_kind(et, self.src)
                    self.scan_calls(et, fqcn, None)
                f_ord = field_ord
                field_ord += 1
                self.emit("fields", fqcn=fqcn, ord=f_ord, name=name_tok.text, line=name_tok.line,
                          type_written=rtype, type_raw=rraw, type_args=rargs, is_primitive=rprim,
                          is_static="static" in mods, is_final="final" in mods,
                          init_kind=init_kind, init_text=init_text, init_type=init_type)
                self.emit_annotations("field", f"{fqcn}#f{f_ord}", anns)
                if self.at(","):
                    self.take(",")
                    name_tok = self.ident()
                    continue
                self.take(";")
                break
        self.take("}")

    def params(self, fqcn, m_ord):
        self.take("(")
        k = 0
        while not self.at(")"):
            anns, _ = self.annotations_and_modifiers()
            ptype, praw, pargs, pprim = self.type_ref()
            if self.at("this"):  # receiver parameter
                self.take("this")
            else:
                name = self.ident()
                while self.at("[") and self.at("]", 1):
                    self.i += 2
                if fqcn is not None:
                    self.emit("params", fqcn=fqcn, method_ord=m_ord, ord=k, name=name.text,
                              line=name.line, type_written=ptype, type_raw=praw, type_args=pargs,
                              is_primitive=pprim)
                    self.emit_annotations("param", f"{fqcn}#m{m_ord}#p{k}", anns)
            k += 1
            if self.at(","):
                self.take(",")
        self.take(")")

    def throws(self):
        if self.at("throws"):
            self.take("throws")
            self.type_ref()
            while self.at(","):
                self.take(",")
                self.type_ref()

    def skip_expr(self):
        """Skip an initialiser or default value: up to ',' or ';' at depth 0."""
        depth = 0
        while True:
            p = self.peek()
            if p is None:
                raise ParseError("unexpected end of file in an expression")
            if depth == 0 and p.text in (",", ";"):
                return
            if p.text in ("(", "{", "["):
                depth += 1
            elif p.text in (")", "}", "]"):
                depth -= 1
                if depth < 0:
                    raise ParseError(f"line {p.line}: unbalanced '{p.text}'")
            self.i += 1

    def method_body(self, fqcn, m_ord):
        s, e = self.skip_balanced("{", "}")
        toks = self.t[s + 1:e - 1]
        if m_ord is not None:
            self.scan_calls(toks, fqcn, m_ord)
            self.scan_assigns(toks, fqcn, m_ord)

    def scan_calls(self, toks, fqcn, m_ord):
        for j, tk in enumerate(toks):
            if tk.kind != "id" or j + 1 >= len(toks) or toks[j + 1].text != "(":
                continue
            if tk.text in NOT_CALLS or (j > 0 and toks[j - 1].text in ("new", "@")):
                continue
            if j > 0 and (toks[j - 1].kind == "id" or toks[j - 1].text in (">", "]")) and \
                    toks[j - 1].text not in ("return", "throw", "else", "case", "yield"):
                continue  # a declaration (e.g. a method of an anonymous class), not a call
            if j > 0 and toks[j - 1].text == ".":
                recv = "this" if j > 1 and toks[j - 2].text == "this" and (j < 3 or toks[j - 3].text != ".") else "other"
            elif j > 0 and toks[j - 1].text == "::":
                continue
            else:
                recv = "none"
            depth, k, arg = 0, j + 1, []
            while k < len(toks):
                x = toks[k]
                if x.text in ("(", "[", "{"):
                    depth += 1
                    if depth == 1 and x.text == "(":
                        k += 1
                        continue
                elif x.text in (")", "]", "}"):
                    depth -= 1
                    if depth == 0:
                        break
                if depth == 1 and x.text == ",":
                    break
                arg.append(x)
                k += 1
            a_kind, a_type = _arg_kind(arg)
            self.emit("calls", fqcn=fqcn, method_ord=m_ord, callee=tk.text, receiver=recv,
                      arg0_kind=a_kind, arg0_type=a_type, line=tk.line)

    def scan_assigns(self, toks, fqcn, m_ord):
        for j, tk in enumerate(toks):
            if tk.text != "=":
                continue
            if j >= 1 and toks[j - 1].kind == "id":
                if j >= 3 and toks[j - 2].text == "." and toks[j - 3].text == "this":
                    start = j - 3
                elif j >= 2 and toks[j - 2].text == ".":
                    continue  # other.x = ...
                else:
                    start = j - 1
                if start > 0 and toks[start - 1].text not in (";", "{", "}", ")"):
                    continue  # a local declaration such as 'Foo x = ...'
                k = j + 1
                depth = 0
                val = []
                while k < len(toks):
                    x = toks[k]
                    if depth == 0 and x.text in (";", ","):
                        break
                    if x.text in ("(", "[", "{"):
                        depth += 1
                    elif x.text in (")", "]", "}"):
                        depth -= 1
                    val.append(x)
                    k += 1
                kind, vtype, _ = _init_kind(val, self.src)
                self.emit("assigns", fqcn=fqcn, method_ord=m_ord, target_name=toks[j - 1].text,
                          value_kind=kind if kind in ("new", "mock", "spy") else "other",
                          value_type=vtype, line=tk.line)


def _split_top(toks, sep):
    out, cur, depth = [], [], 0
    for x in toks:
        if x.text in ("(", "{", "[", "<"):
            depth += 1
        elif x.text in (")", "}", "]", ">"):
            depth -= 1
        if depth == 0 and x.text == sep:
            out.append(cur)
            cur = []
        else:
            cur.append(x)
    out.append(cur)
    return out


def _leading_qualified(toks):
    parts = []
    for k, x in enumerate(toks):
        if x.kind == "id" and (k == 0 or toks[k - 1].text == "."):
            parts.append(x.text)
        elif x.text == ".":
            continue
        else:
            break
    return parts


def _expr_kind(toks, src):
    text = src[toks[0].start:toks[-1].end] if toks else ""
    if len(toks) == 1 and toks[0].kind == "str":
        return "literal", _unquote(toks[0].text)
    if len(toks) == 1 and toks[0].kind == "id":
        return "name", text
    if toks and all((x.kind == "id") if k % 2 == 0 else (x.text == ".") for k, x in enumerate(toks)) \
            and len(toks) % 2 == 1:
        if toks[-1].text == "class":
            return "class_literal", ".".join(x.text for x in toks[:-1:2])
        return "field_access", text
    return "other", text


def _arg_kind(toks):
    if len(toks) >= 3 and toks[-1].text == "class" and toks[-2].text == ".":
        return "class_literal", ".".join(x.text for x in toks[:-2] if x.kind == "id")
    if toks and toks[0].text == "new" and len(toks) > 1:
        return "new", ".".join(_leading_qualified(toks[1:]))
    return ("other", None) if toks else (None, None)


def _init_kind(toks, src):
    """Kind of an initialiser/assigned value: string_literal, new X, mock(X), spy(X), other."""
    text = src[toks[0].start:toks[-1].end] if toks else ""
    if len(toks) == 1 and toks[0].kind == "str":
        return "string_literal", None, toks[0].text
    if toks and toks[0].text == "new" and len(toks) > 1:
        return "new", ".".join(_leading_qualified(toks[1:])), text
    if len(toks) >= 3 and toks[0].text in ("mock", "spy", "mockStatic") and toks[1].text == "(":
        inner = toks[2:-1] if toks[-1].text == ")" else toks[2:]
        first = _split_top(inner, ",")[0]
        kind, typ = _arg_kind(first)
        return toks[0].text, typ if kind in ("class_literal", "new") else None, text
    return "other", None, text


# --- Spark job ---------------------------------------------------------------------------------

FACT_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in [
    ("repo", T.StringType()), ("snapshot", T.StringType()), ("path", T.StringType()),
    ("fact_kind", T.StringType()), ("fqcn", T.StringType()), ("simple_name", T.StringType()),
    ("package", T.StringType()), ("type_ord", T.IntegerType()), ("ord", T.IntegerType()),
    ("line", T.IntegerType()), ("is_interface", T.BooleanType()), ("is_annotation", T.BooleanType()),
    ("is_top_level", T.BooleanType()), ("parent_fqcn", T.StringType()), ("relation", T.StringType()),
    ("written_name", T.StringType()), ("name", T.StringType()), ("is_static", T.BooleanType()),
    ("is_wildcard", T.BooleanType()), ("owner_kind", T.StringType()), ("owner_id", T.StringType()),
    ("shape", T.StringType()), ("text", T.StringType()), ("annotation_ord", T.IntegerType()),
    ("attr", T.StringType()), ("expr_kind", T.StringType()), ("expr_text", T.StringType()),
    ("in_array", T.BooleanType()), ("type_written", T.StringType()), ("type_raw", T.StringType()),
    ("type_args", T.ArrayType(T.StringType())), ("is_primitive", T.BooleanType()),
    ("is_final", T.BooleanType()), ("init_kind", T.StringType()), ("init_text", T.StringType()),
    ("init_type", T.StringType()), ("method_ord", T.IntegerType()), ("is_private", T.BooleanType()),
    ("return_type", T.StringType()), ("callee", T.StringType()), ("receiver", T.StringType()),
    ("arg0_kind", T.StringType()), ("arg0_type", T.StringType()), ("target_name", T.StringType()),
    ("value_kind", T.StringType()), ("value_type", T.StringType()), ("reason", T.StringType()),
]])
_COLS = [f.name for f in FACT_SCHEMA.fields]


def scan_source(path: str, content: str) -> list[dict]:
    """Fact rows of one file, or a single parse-failure row: whatever a file makes the scanner stumble
    over is that file's reject, never the end of the job."""
    try:
        return Scanner(content, path).run()
    except Exception as e:  # noqa: BLE001
        msg = str(e).splitlines()[0] if str(e) else type(e).__name__
        return [{"fact_kind": "parse_failures", "path": path, "reason": msg}]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for repo, snap, path, content in zip(pdf["repo"], pdf["snapshot"], pdf["path"], pdf["content"]):
            for r in scan_source(path, content or ""):
                r["repo"], r["snapshot"] = repo, snap
                rows.append(r)
        # object dtype keeps None as None (no NaN in list or integer columns)
        yield pd.DataFrame([[r.get(c) for c in _COLS] for r in rows], columns=_COLS, dtype=object)


def extract_facts(sources: DataFrame) -> DataFrame:
    """``sources(repo, snapshot, path, content)`` -> tagged fact rows (``fact_kind`` says which
    table). Partition by file: one task never holds more than its own files; write the result
    with ``partitionBy('repo', 'snapshot', 'fact_kind')`` so each gold job reads its own facts."""
    return sources.select("repo", "snapshot", "path", "content").mapInPandas(_extract, FACT_SCHEMA)


FACT_COLUMNS = {
    "types": ["fqcn", "simple_name", "package", "path", "type_ord", "line", "is_interface",
              "is_annotation", "is_top_level", "parent_fqcn"],
    "supertypes": ["fqcn", "relation", "ord", "written_name", "path"],
    "imports": ["path", "ord", "name", "is_static", "is_wildcard"],
    "annotations": ["path", "owner_kind", "owner_id", "ord", "written_name", "simple_name", "shape",
                    "text", "line"],
    "annotation_values": ["path", "owner_id", "annotation_ord", "attr", "ord", "expr_kind",
                          "expr_text", "in_array"],
    "fields": ["path", "fqcn", "ord", "name", "line", "type_written", "type_raw", "type_args",
               "is_primitive", "is_static", "is_final", "init_kind", "init_text", "init_type"],
    "methods": ["path", "fqcn", "ord", "name", "line", "is_private", "is_static", "return_type"],
    "params": ["path", "fqcn", "method_ord", "ord", "name", "line", "type_written", "type_raw",
               "type_args", "is_primitive"],
    "calls": ["path", "fqcn", "method_ord", "callee", "receiver", "arg0_kind", "arg0_type", "line"],
    "assigns": ["path", "fqcn", "method_ord", "target_name", "value_kind", "value_type", "line"],
    "parse_failures": ["path", "reason"],
}


def fact_table(facts: DataFrame, kind: str) -> DataFrame:
    """One fact table out of the tagged rows (column pruning keeps the scan narrow)."""
    return facts.where(F.col("fact_kind") == kind).select("repo", "snapshot", *FACT_COLUMNS[kind])
