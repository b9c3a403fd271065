"""Facts of C and Rust source by lexing: comments and strings are blanked, then headers are
matched and their bodies found by brackets. What a grammar would see and this does not is told
in the README."""

from __future__ import annotations

import re

from sextant.extract.facts import Facts, blanked, closing, comment_above, line_of

C_TRIVIA = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S)
RUST_TRIVIA = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\])'", re.S)
C_DOC = re.compile(r"^\s*(?:/\*+|//+!?|\*(?!/))?\s?(.*?)(?:\*/)?\s*$")
C_WORDS = frozenset("if for while switch return sizeof do else case goto typedef struct union enum static extern const volatile inline void int char long short unsigned signed float double defined _Alignof alignof typeof".split())
RUST_WORDS = frozenset("if for while loop match return fn impl trait struct enum mod use pub let mut ref move in as where unsafe async await dyn crate self super Self const static type break continue else Some None Ok Err".split())


def c_doc(lines: list[str], line: int) -> str | None:
    out, k = [], line - 2
    if k >= 0 and lines[k].rstrip().endswith("*/"):
        while k >= 0:
            out.append(C_DOC.match(lines[k])[1].strip())
            if "/*" in lines[k]:
                break
            k -= 1
    else:
        while k >= 0 and lines[k].lstrip().startswith("//"):
            out.append(lines[k].lstrip().lstrip("/!").strip())
            k -= 1
    return "\n".join(reversed(out)).strip() or None


def c(data: bytes) -> dict:
    facts, text = Facts(), data.decode("utf-8", "replace")
    lines, at = text.split("\n"), line_of(text)
    facts.symbol("", "", "file", 1, max(1, len(lines) - (lines[-1] == "")))
    code = blanked(text, C_TRIVIA)
    flat = re.sub(r"\\\n", " \n", code)
    # Directives: includes, macros, branches and the guard.
    stack: list[list] = []
    for m in re.finditer(r"^[ \t]*#[ \t]*(\w+)[ \t]*([^\n]*)", flat, re.M):
        word, rest, line = m[1], m[2].strip(), at(m.start())
        if word == "include" and (inc := re.match(r"[ \t]*#[ \t]*include[ \t]*([<\"])([^>\"]+)", text[m.start() :])):
            facts.import_(inc[2], line, via=inc[1])
        elif word == "define" and (d := re.match(r"(\w+)(\([^)]*\))?[ \t]*(.*)", rest)):
            facts.symbol(d[1], d[1], "macro", line, line, c_doc(lines, line), value=d[3].strip() if not d[2] else None)
        elif word in ("if", "ifdef", "ifndef"):
            test = rest if word == "if" else f"{'!' if word == 'ifndef' else ''}defined({rest.split()[0] if rest.split() else ''})"
            if not stack and word == "ifndef" and facts.guard is None and not flat[: m.start()].strip():
                facts.guard = rest
            stack.append([line, test, [test]])
        elif word in ("elif", "else", "endif") and stack:
            began, test, tried = stack[-1]
            facts.branch(began + 1, line - 1, test) if line - 1 > began and not (facts.guard and test == f"!defined({facts.guard})") else None
            if word == "endif":
                stack.pop()
            else:
                now = " && ".join([*(f"!({t})" for t in tried), *([f"({rest})"] if word == "elif" else [])])
                stack[-1] = [line, now, [*tried, rest] if word == "elif" else tried]
    body = re.sub(r"^[ \t]*#[^\n]*", lambda m: " " * len(m[0]), flat, flags=re.M)
    spans: list[tuple[int, int, str]] = []
    # Tags and enumerators.
    for m in re.finditer(r"\b(struct|union|enum)\s+(\w+)\s*\{|\b(struct|union|enum)\s*\{", body):
        kind, name = m[1] or m[3], m[2]
        end = closing(body, m.end() - 1)
        if name:
            facts.symbol(name, name, kind, at(m.start()), at(end - 1), c_doc(lines, at(m.start())))
        if kind == "enum":
            inside = body[m.end() : end - 1]
            for e in re.finditer(r"(?:^|,)\s*(\w+)", re.sub(r"\([^()]*\)", lambda p: " " * len(p[0]), inside)):
                where = at(m.end() + e.start(1))
                facts.symbol(e[1], f"{name}::{e[1]}" if name else e[1], "variant", where, where)
    for m in re.finditer(r"\btypedef\b[^;{]*(\{)?", body):
        end = closing(body, m.end() - 1) if m[1] else m.end()
        tail = re.match(r"[^;]*?\(\s*\*\s*(\w+)\s*\)|[^;]*?(\w+)\s*(?:\[[^\]]*\]\s*)*;", body[end:] if m[1] else body[m.start() :])
        if tail:
            facts.symbol(tail[1] or tail[2], tail[1] or tail[2], "type_alias", at(m.start()), at(end), c_doc(lines, at(m.start())))
    # Functions, prototypes and variables at the top level.
    k = 0
    header = re.compile(r"([A-Za-z_][\w\s*,]*?[\s*])([A-Za-z_]\w*)\s*\(")
    pos = 0
    while m := header.search(body, pos):
        depth_text = body[k : m.start()]
        pos = m.end()
        if m[2] in C_WORDS or depth_text.count("{") > depth_text.count("}"):
            continue
        close = closing(body, m.end() - 1, "()")
        after = re.match(r"\s*(?:__\w+(?:\(\([^)]*\)\))?\s*)*([{;])", body[close:])
        line = at(m.start(2))
        internal = bool(re.search(r"\bstatic\b", m[1]))
        if after and after[1] == "{" and not re.search(r"[;}=]", m[1]):
            opened = close + after.end() - 1
            end = closing(body, opened)
            start = at(m.start() + len(m[1]) - len(m[1].lstrip()))
            full = facts.symbol(m[2], m[2], "function", start, at(end - 1), c_doc(lines, start), internal=internal)
            spans.append((opened, end, full))
            k = pos = end
        elif after and after[1] == ";" and m[1].strip() and not re.search(r"\btypedef\b|\breturn\b|=", m[1]):
            facts.symbol(m[2], m[2], "declaration", line, at(close), c_doc(lines, line), internal=internal, declared=True)
            k = pos = close
    outside = body
    for a, b, _ in spans:
        outside = outside[:a] + re.sub(r"[^\n]", " ", outside[a:b]) + outside[b:]
    for m in re.finditer(r"^(?!\s*(?:typedef|return|struct\s+\w+\s*;))[ \t]*((?:[A-Za-z_]\w*[\s*]+)+)(\w+)(?:\[[^\]]*\])*\s*(?:=|;)", outside, re.M):
        depth = outside[: m.start()]
        if depth.count("{") == depth.count("}") and m[2] not in C_WORDS and not re.search(r"\bextern\b", m[1]):
            facts.symbol(m[2], m[2], "variable", at(m.start(2)), at(m.start(2)), c_doc(lines, at(m.start(2))), internal=bool(re.search(r"\bstatic\b", m[1])))
    owner = lambda p: next((full for a, b, full in spans if a <= p < b), None)
    for m in re.finditer(r"(?<![\w.])(?:(\w+)\s*(->|\.)\s*)?([A-Za-z_]\w*)\s*\(", body):
        if m[3] in C_WORDS or any(s["start"] <= at(m.start(3)) <= s["end"] and s["name"] == m[3] and s["kind"] in ("function", "declaration") and owner(m.start(3)) is None for s in facts.symbols):
            continue
        facts.call(m[3], "method" if m[2] else "free", at(m.start(3)), owner(m.start()), receiver=m[1])
    for m in re.finditer(r"\b(struct|union|enum)\s+(\w+)(?!\s*\{)", body):
        facts.ref(m[2], "type", at(m.start(2)), owner(m.start()))
    for m in re.finditer(r"(?:\.|->)\s*(\w+)\s*=\s*&?\s*([A-Za-z_]\w*)\s*[,;}]", body):
        facts.ref(m[2], "set", at(m.start(2)), owner(m.start()), path=m[1])
    known = {s["name"] for s in facts.symbols if s["name"]}
    for m in re.finditer(r"(?<![\w.>])([A-Za-z_]\w*)\b(?!\s*\()", body):
        inside = owner(m.start())
        if inside and m[1] not in C_WORDS and (m[1] in known or m[1].isupper()):
            facts.ref(m[1], "value", at(m.start()), inside)
    return facts.done()


def rust(data: bytes) -> dict:
    facts, text = Facts(), data.decode("utf-8", "replace")
    lines, at = text.split("\n"), line_of(text)
    facts.symbol("", "", "file", 1, max(1, len(lines) - (lines[-1] == "")))
    code = blanked(text, RUST_TRIVIA)
    doc_mark, attr = re.compile(r"^\s*///(?!/)\s?(.*)$"), re.compile(r"^\s*#!?\[.*\]\s*$")
    doc = lambda line: comment_above(lines, line, doc_mark, attr)
    item = re.compile(
        r"(?P<pub>\bpub(?:\([^)]*\))?\s+)?(?:(?:unsafe|async|const|default|extern(?:\s*\"[^\"]*\")?)\s+)*"
        r"\b(?P<kind>fn|struct|enum|union|trait|impl|mod|const|static|type|macro_rules!)\s*(?P<rest>[^;{=]*)(?P<end>[;{=]|\Z)"
    )
    spans: list[tuple[int, int, str, str]] = []

    def cfg_above(line: int) -> str | None:
        k, found = line - 2, None
        while k >= 0 and (attr.match(lines[k]) or doc_mark.match(lines[k])):
            if m := re.match(r"\s*#\[cfg\((.*)\)\]\s*$", lines[k]):
                found = m[1]
            k -= 1
        return found

    def read(lo: int, hi: int, path: str, owner_kind: str) -> None:
        pos = lo
        while m := item.search(code, pos, hi):
            kind, rest, start = m["kind"], m["rest"].strip(), m.start()
            line = at(start)
            end = closing(code, m.end() - 1) if m["end"] == "{" else m.end()
            if m["end"] == "=":
                end = (code.find(";", m.end()) + 1) or hi
            name = re.match(r"(?:mut\s+)?(\w+)", rest)
            if (kind == "const" and re.match(r"fn\b", rest)) or (not name and kind != "impl"):
                pos = m.start("rest") if m.start("rest") > start else m.end()
                continue
            join = f"{path}::" if path else ""
            if (cond := cfg_above(line)) is not None:
                facts.branch(line, at(end - 1), cond)
            if kind == "fn":
                full = facts.symbol(name[1], join + name[1], "method" if owner_kind in ("impl", "trait") else "function", line, at(end - 1), doc(line), typed=(t[1].strip() if (t := re.search(r"->\s*([^{]+?)(?:\s+where\b.*)?$", rest, re.S)) else None))
                spans.append((start, end, full, "fn"))
                if m["end"] == "{":
                    read(m.end(), end - 1, full, "fn")
            elif kind == "impl":
                head = re.sub(r"^<(?:[^<>]|<[^<>]*>)*>\s*", "", re.sub(r"\s+where\b.*", "", rest, flags=re.S)).strip()
                bare = re.sub(r"<(?:[^<>]|<[^<>]*>)*>", "", head)
                trait, mark, of = bare.partition(" for ")
                target = (of if mark else trait).strip().split("::")[-1].strip("&' ")
                full = facts.symbol(target, f"{join}impl {bare}", "impl", line, at(end - 1), doc(line), typed=target)
                spans.append((start, end, full, "impl"))
                if mark:
                    facts.ref(trait.strip().split("::")[-1], "type", line, full, path=trait.strip())
                facts.ref(target, "type", line, full)
                read(m.end(), end - 1, f"{join}{target}", "impl")
            elif kind in ("struct", "enum", "union", "trait", "mod"):
                full = facts.symbol(name[1], join + name[1], {"mod": "module"}.get(kind, kind), line, at(end - 1), doc(line), internal=not m["pub"], declared=kind == "mod" and m["end"] == ";")
                spans.append((start, end, full, kind))
                if kind == "enum":
                    for v in re.finditer(r"(?:^|,)\s*(?:#\[[^\]]*\]\s*)*(\w+)", re.sub(r"\{[^{}]*\}|\([^()]*\)", lambda p: " " * len(p[0]), code[m.end() : end - 1])):
                        where = at(m.end() + v.start(1))
                        facts.symbol(v[1], f"{full}::{v[1]}", "variant", where, where, doc(where))
                elif m["end"] == "{" and kind in ("trait", "mod"):
                    read(m.end(), end - 1, join + name[1], kind)
            elif kind == "macro_rules!":
                facts.symbol(name[1], join + name[1], "macro", line, at(end - 1), doc(line))
            else:
                facts.symbol(name[1], join + name[1], {"type": "type_alias"}.get(kind, kind), line, at(end - 1), doc(line), internal=not m["pub"])
            pos = end

    read(0, len(code), "", "")

    def owner(p: int, kinds: tuple[str, ...] = ("fn",)) -> str | None:
        held = [s for s in spans if s[0] <= p < s[1] and s[3] in kinds]
        return max(held)[2] if held else None

    def tree(text_: str, prefix: str, line: int, public: bool, importer: str | None) -> None:
        text_ = text_.strip()
        if (brace := text_.find("{")) >= 0 and text_.endswith("}"):
            depth, part = 0, ""
            for ch in text_[brace + 1 : -1] + ",":
                depth += (ch == "{") - (ch == "}")
                if ch == "," and not depth:
                    if part.strip():
                        tree(part, prefix + text_[:brace].strip(), line, public, importer)
                    part = ""
                else:
                    part += ch
            return
        path, _, alias = text_.partition(" as ")
        whole = (prefix + path.strip()).removesuffix("::self")
        glob = whole.endswith("::*")
        last = whole.rsplit("::", 1)[-1]
        facts.import_(whole.removesuffix("::*"), line, alias=None if glob else alias.strip() or last, glob=glob, public=public, importer=importer)

    for m in re.finditer(r"(\bpub(?:\([^)]*\))?\s+)?\buse\s+([^;]+);", code):
        tree(re.sub(r"\s+", " ", m[2]), "", at(m.start(2)), bool(m[1]), owner(m.start(), ("mod", "fn")))
    inside_use = [(m.start(), m.end()) for m in re.finditer(r"\buse\s+[^;]+;", code)]
    defined = {(s["name"], s["start"]) for s in facts.symbols}
    for m in re.finditer(r"(?:([\w)\]?]+)\s*\.\s*)?((?:(?:\w+|<[^<>;(){}]*>)::)*)(\w+)\s*(!)?\s*(?:::<[^;(){}]*>\s*)?([({\[])", code):
        name, line = m[3], at(m.start(3))
        if name in RUST_WORDS or (name, line) in defined or (m[5] != "(" and not m[4]) or any(a <= m.start() < b for a, b in inside_use) or re.search(r"\b(fn|struct|enum|trait|mod|union)\s+$", code[max(0, m.start() - 12) : m.start(3)]):
            continue
        path = m[2].removesuffix("::") or None
        kind = "macro" if m[4] else "method" if m[1] else "path" if path else "free"
        facts.call(name, kind, line, owner(m.start()), path=f"{path}::{name}" if path else None, receiver=m[1])
    for m in re.finditer(r"(?<!::)\b((?:\w+::)*)([A-Z]\w*)\b(?!\s*[(!]|::)", code):
        if (m[2], at(m.start(2))) not in defined and not any(a <= m.start() < b for a, b in inside_use):
            facts.ref(m[2], "type", at(m.start(2)), owner(m.start(), ("fn", "impl", "struct", "enum", "trait")), path=(m[1] + m[2]) if m[1] else None)
    return facts.done()
