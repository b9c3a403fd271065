"""Facts of Bash and Nix source by lexing."""

from __future__ import annotations

import re

from sextant.extract.facts import Facts, blanked, closing, comment_above, line_of

BASH_WORDS = frozenset("if then else elif fi for while until do done case esac in function select time coproc { } ! [[ ]] [ ] echo printf read cd exit return local declare export readonly unset set shift test true false eval exec source . trap wait kill let typeset".split())
WRAPPERS = frozenset("sudo exec env nohup time command builtin xargs nice timeout".split())
HASH = re.compile(r"^\s*#(?!!)\s?(.*)$")


def shell_word(text: str) -> str:
    """The first word of a command's arguments, quotes around and within it taken off; `$(..)` and its quotes stay whole."""
    out, depth, quote = [], 0, ""
    text = text.lstrip()
    for k, c in enumerate(text):
        if c == ")" and depth:
            depth -= 1
        elif depth:
            pass
        elif c in "\"'" and quote in ("", c):
            quote = "" if quote else c
            continue
        elif c in " \t" and not quote:
            break
        if c == "(" and (depth or text[k - 1 : k] == "$"):
            depth += 1
        out.append(c)
    return "".join(out)


def bash(data: bytes) -> dict:
    facts, text = Facts(), data.decode("utf-8", "replace")
    lines, at = text.split("\n"), line_of(text)
    code = blanked(text, re.compile(r"(?:(?<=\s)|^)#[^\n]*|'[^']*'", re.M))
    # Bodies of here documents.
    for m in list(re.finditer(r"<<-?\s*([\"']?)(\w+)\1[^\n]*\n", code)):
        stop = re.compile(rf"^\s*{m[2]}\s*$", re.M).search(code, m.end())
        end = stop.start() if stop else len(code)
        code = code[: m.end()] + re.sub(r"[^\n]", " ", code[m.end() : end]) + code[end:]
    head = []
    for line in lines[1 if lines[0].startswith("#!") else 0 :]:
        if not (m := HASH.match(line)):
            break
        head.append(m[1])
    facts.symbol("", "", "file", 1, max(1, len(lines) - (lines[-1] == "")), "\n".join(head).strip())
    for m in re.finditer(r"^#\s*[-=#*]{3,}\s*\n#\s*(\S.*?)\s*\n#\s*[-=#*]{3,}\s*$", text, re.M):
        facts.symbol(m[1], m[1], "section", at(m.start()), at(m.end()))
    spans: list[tuple[int, int, str]] = []
    for m in re.finditer(r"^[ \t]*(?:function\s+([\w:.-]+)\s*(?:\(\s*\))?|([\w:.-]+)\s*\(\s*\))\s*([{(])", code, re.M):
        name, line = m[1] or m[2], at(m.start())
        end = closing(code, m.end() - 1, "{}" if m[3] == "{" else "()")
        line = at(m.start(1) if m[1] else m.start(2))
        spans.append((m.start(), end, facts.symbol(name, name, "function", line, at(end - 1), comment_above(lines, line, HASH))))
    owner = lambda p: (max((s for s in spans if s[0] <= p < s[1]), default=(0, 0, None)))[2]
    seen: set[tuple[str | None, str]] = set()
    for m in re.finditer(r"(?:^|[;&|({]\s*|\b(?:then|do|else)\s+|[ \t])((?:export|local|declare|readonly|typeset)\s+(?:-\w+\s+)*)?([A-Za-z_]\w*)\+?=", code, re.M):
        before = code[code.rfind("\n", 0, m.start(2)) + 1 : m.start(2)].strip()
        if before and not m[1] and not re.search(r"(?:[;&|({]|\bthen|\bdo|\belse|\w=\S*)$", before):
            continue
        user, line = owner(m.start(2)), at(m.start(2))
        local = user if m[1] and m[1].split()[0] in ("local", "declare", "typeset") else None
        if (local, m[2]) not in seen:
            seen.add((local, m[2]))
            kind = "environment" if m[1] and m[1].split()[0] == "export" else "variable"
            facts.symbol(m[2], f"{local}::{m[2]}" if local else m[2], kind, line, line, comment_above(lines, line, HASH), internal=bool(local))
        else:
            facts.ref(m[2], "set", line, user)
    for m in re.finditer(r"\$(?:\{[#!]?)?([A-Za-z_]\w*)", code):
        facts.ref(m[1], "value", at(m.start()), owner(m.start()))
    starts = {s[0] for s in spans}
    for m in re.finditer(r"(?:^|[;&|(`{]|\$\(|\b(?:then|do|else|if|while|until|!)\s)[ \t]*((?:[A-Za-z_]\w*=\S*[ \t]+)*)((?:\S+[ \t]+)*?)([\w./$\"{}:~-]+)(?=[ \t\n;|&)]|\Z)([^\n;|&]*)", code, re.M):
        if m.start() in starts or m[2].strip():
            continue
        name, args, line = m[3].strip('"'), m[4].split(), at(m.start(3))
        while name in WRAPPERS and args:
            rest = [a for a in args if not a.startswith("-") and "=" not in a]
            name, args = (rest[0].strip('"'), args[args.index(rest[0]) + 1 :]) if rest else ("", [])
        if name in ("source", ".") and args:
            facts.import_(shell_word(m[4]) if m[3].strip('"') == name else args[0].strip('"'), line, importer=owner(m.start()), via="source")
        elif name in ("bash", "sh") and args and not args[0].startswith("-"):
            facts.import_(args[0].strip('"'), line, importer=owner(m.start()), via="run")
        elif re.search(r"[$*]", name) and name not in BASH_WORDS:
            facts.call(re.sub(r"\$\{?\w+\}?", "*", name), "free", line, owner(m.start()), path=re.sub(r"\$\{?\w+\}?", "*", name))
        elif "/" in name:
            facts.import_(name, line, importer=owner(m.start()), via="run")
        elif name and name not in BASH_WORDS and re.fullmatch(r"[A-Za-z_][\w:.-]*", name):
            facts.call(name, "free", line, owner(m.start()))
    return facts.done()


def nix(data: bytes) -> dict:
    """Bindings by their whole path, options, inputs, imports and uses of names."""
    facts, text = Facts(), data.decode("utf-8", "replace")
    lines, at = text.split("\n"), line_of(text)
    facts.symbol("", "", "file", 1, max(1, len(lines) - (lines[-1] == "")), comment_above(lines, next((k + 1 for k, line in enumerate(lines) if line.strip() and not line.lstrip().startswith("#")), 1), HASH))
    code = blanked(text, re.compile(r"#[^\n]*|/\*.*?(?:\*/|\Z)", re.S))
    strings = blanked(code, re.compile(r"\"(?:\\.|[^\"\\])*\"|''(?:'''|''\$|''\\|[^'])*?(?:''(?!['$\\])|\Z)", re.S))
    segment = r"(?:[A-Za-z_][\w'-]*|\"[^\"\n]*\"|\$\{[^}]*\})"
    binding = re.compile(rf"(?<![\w.'-])({segment}(?:\s*\.\s*{segment})*)\s*=(?![=])")
    token = re.compile(r"[{}();]|\blet\b|\bin\b")
    stack: list[tuple[str, int]] = []
    prefixes: list[str] = []
    marks = {m.start(1): m for m in binding.finditer(code) if strings[m.start(1)] != " " or code[m.start(1)] == '"'}
    pending: str | None = None
    spans: list[tuple[int, int, str]] = []
    for p, m in sorted([*((k, v) for k, v in marks.items()), *((t.start(), t) for t in token.finditer(strings))], key=lambda x: x[0]):
        if m.re is binding:
            name = re.sub(r"\s*\.\s*", ".", m[1])
            whole = ".".join([*filter(None, prefixes), name])
            depth, end = 0, len(strings)
            for t in re.compile(r"[{}()\[\];]|\blet\b|\bin\b").finditer(strings, m.end()):
                depth += (t[0] in "{([") or t[0] == "let"
                depth -= (t[0] in "})]") or t[0] == "in"
                if (t[0] == ";" and depth <= 0) or depth < 0:
                    end = t.start()
                    break
            value = code[m.end() : end].strip()
            kind = "option" if re.match(r"(?:lib\.)?mk(?:Option|EnableOption|PackageOption)\b", value) else "input" if whole.startswith("inputs.") and whole.count(".") == 1 else "function" if re.match(r"(?:\w+|\{[^{}]*\}(?:\s*@\s*\w+)?)\s*:(?!/)", value) else "attribute"
            shown = whole.removeprefix("options.") if kind == "option" else whole
            description = re.search(r"description\s*=\s*(?:lib\.mdDoc\s*)?(?:\"((?:\\.|[^\"\\])*)\"|''(.*?)'')", value, re.S) if kind == "option" else None
            line = at(p)
            doc = (description[1] or description[2] or "").strip() if description else comment_above(lines, line, HASH)
            spans.append((p, end, facts.symbol(name.split(".")[-1].strip('"'), shown, kind, line, at(max(p, end - 1)), doc, value=None)))
            pending = name
        elif m[0] == "{":
            stack.append(("{", len(prefixes)))
            prefixes.append(pending or "")
            pending = None
        elif m[0] == "}" and stack:
            _, n = stack.pop()
            del prefixes[n:]
            pending = None
        elif m[0] == ";":
            pending = None
    owner = lambda p: (max((s for s in spans if s[0] <= p < s[1]), default=(0, 0, None)))[2]
    for m in re.finditer(r"\b(import|callPackage)\s+\(?((?:\.{1,2}/)[\w./-]+)", code):
        facts.import_(m[2], at(m.start(2)), importer=owner(m.start()), via=m[1])
    for m in re.finditer(r"(?<![\w/.~])(\.{1,2}/[\w./-]+)", strings):
        if not any(i["line"] == at(m.start()) and i["path"] == m[1] for i in facts.imports):
            facts.import_(m[1], at(m.start()), importer=owner(m.start()), via="path")
    heads = {m.start(1) for m in binding.finditer(code)}
    # Names of a function's arguments; what stands after a question mark is a use.
    for m in re.finditer(r"\{[^{}=;]*\}(?=\s*(?:@\s*\w+)?\s*:(?!/))", strings):
        heads |= {m.start() + a.start(1) for a in re.finditer(r"[{,]\s*([A-Za-z_][\w'-]*)", m[0])}
    local = {s["qualified"] for s in facts.symbols}
    for m in re.finditer(r"(?<![\w.'\"$/-])([A-Za-z_][\w'-]*(?:\.[A-Za-z_][\w'-]*)*)", strings):
        if m.start() in heads or m[1] in ("let", "in", "with", "rec", "inherit", "if", "then", "else", "assert", "or", "true", "false", "null", "import"):
            continue
        name = m[1].split(".")[-1]
        facts.ref(name, "path" if "." in m[1] else "value", at(m.start()), owner(m.start()), path=m[1] if "." in m[1] else None, local=m[1].split(".")[0] if m[1].split(".")[0] in local else None)
    return facts.done()
