"""Facts of Python source, from its syntax tree.

Scopes: functions, classes and the module; a name is looked up where Python would. A bare name
that a scope of the file binds carries its full name in `local`. Files that do not parse give
their file symbol alone, marked as having a syntax error.
"""

from __future__ import annotations

import ast
import builtins

from sextant.extract.facts import MAX_DEPTH, Facts

BUILTINS = frozenset(dir(builtins))


def dotted(node: ast.AST) -> str | None:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super" and parts:
        return ".".join(["super()", *reversed(parts)])
    return None


class Scope:
    def __init__(self, node, kind: str, qualified: str, above: Scope | None):
        self.node, self.kind, self.qualified, self.above = node, kind, qualified, above
        self.bound: dict[str, str] = {}  # names to full names
        self.types: dict[str, str] = {}  # names to the class written for them
        self.elsewhere: set[str] = set()  # global and nonlocal names

    def find(self, name: str) -> str | None:
        scope, first = self, True
        while scope:
            if (first or scope.kind != "class") and name in scope.bound and name not in scope.elsewhere:
                return scope.bound[name]
            scope, first = scope.above, False
        return None

    def type_of(self, name: str) -> str | None:
        scope = self
        while scope:
            if name in scope.types:
                return scope.types[name]
            scope = scope.above
        return None

    def enclosing_class(self) -> Scope | None:
        scope = self
        while scope and scope.kind != "class":
            scope = scope.above
        return scope


class Reader(ast.NodeVisitor):
    def __init__(self, facts: Facts, source: str):
        self.facts, self.lines = facts, source.splitlines()
        self.scope = Scope(None, "module", "", None)
        self.depth = 0

    # Definitions are recorded when a scope opens, so uses above them find them too.

    def full(self, name: str) -> str:
        return f"{self.scope.qualified}.{name}" if self.scope.qualified else name

    def open(self, body: list[ast.stmt]) -> None:
        for stmt in self.statements(body):
            if isinstance(stmt, ast.Global | ast.Nonlocal):
                self.scope.elsewhere |= set(stmt.names)
            elif isinstance(stmt, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(stmt, ast.ClassDef) else "method" if self.scope.kind == "class" else "function"
                start = min([stmt.lineno, *(d.lineno for d in stmt.decorator_list)])
                doc = ast.get_docstring(stmt) or self.above(start)
                stmt.full_name = self.facts.symbol(stmt.name, self.full(stmt.name), kind, start, stmt.end_lineno, doc, declared=True)
                self.scope.bound.setdefault(stmt.name, stmt.full_name)
            elif isinstance(stmt, ast.Assign | ast.AnnAssign | ast.AugAssign):
                for target in stmt.targets if isinstance(stmt, ast.Assign) else [stmt.target]:
                    for name in (n for n in ast.walk(target) if isinstance(n, ast.Name)):
                        self.assign(name.id, stmt)
            elif isinstance(stmt, ast.For | ast.AsyncFor | ast.With | ast.AsyncWith):
                targets = [stmt.target] if isinstance(stmt, ast.For | ast.AsyncFor) else [i.optional_vars for i in stmt.items if i.optional_vars]
                for target in targets:
                    for name in (n for n in ast.walk(target) if isinstance(n, ast.Name)):
                        self.scope.bound.setdefault(name.id, self.full(name.id))

    def assign(self, name: str, stmt) -> None:
        if name in self.scope.elsewhere:
            return
        typed = self.written_type(stmt)
        if typed:
            self.scope.types.setdefault(name, typed)
        if name in self.scope.bound:
            return
        if self.scope.kind in ("module", "class"):
            kind = "const" if name.isupper() else "variable" if self.scope.kind == "module" else "attribute"
            value = dotted(stmt.value) if getattr(stmt, "value", None) is not None else None
            self.scope.bound[name] = self.facts.symbol(name, self.full(name), kind, stmt.lineno, stmt.end_lineno, self.above(stmt.lineno), typed=typed, value=value, declared=isinstance(stmt, ast.AnnAssign))
        else:
            self.scope.bound[name] = self.full(name)

    @staticmethod
    def written_type(stmt) -> str | None:
        if isinstance(stmt, ast.AnnAssign):
            return dotted(stmt.annotation) or (stmt.annotation.value if isinstance(stmt.annotation, ast.Constant) and isinstance(stmt.annotation.value, str) else None)
        value = getattr(stmt, "value", None)
        return dotted(value.func) if isinstance(value, ast.Call) else None

    def statements(self, body):
        """Statements of a scope, those within if, try, for, with and match too, but none of an inner scope."""
        for stmt in body:
            yield stmt
            for field in ("body", "orelse", "finalbody"):
                if not isinstance(stmt, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    yield from self.statements(getattr(stmt, field, []) or [])
            for part in [*getattr(stmt, "handlers", []), *getattr(stmt, "cases", [])]:
                yield from self.statements(part.body)

    def above(self, line: int) -> str | None:
        out, k = [], line - 2
        while k >= 0 and self.lines[k].lstrip().startswith("#") and not self.lines[k].startswith("#!"):
            out.append(self.lines[k].lstrip().lstrip("#").strip())
            k -= 1
        return "\n".join(reversed(out)) or None

    def caller(self) -> str | None:
        scope = self.scope
        while scope and scope.kind not in ("function", "class"):
            scope = scope.above
        return scope.qualified if scope else None

    def inside(self, kind: str, node, qualified: str, body: list[ast.stmt]) -> None:
        self.scope = Scope(node, kind, qualified, self.scope)
        if kind == "function":
            args = node.args
            named = [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]
            for k, a in enumerate(named):
                self.scope.bound[a.arg] = f"{qualified}.{a.arg}"
                typed = dotted(a.annotation) if a.annotation else None
                owner = self.scope.above.qualified if self.scope.above.kind == "class" else None
                if k == 0 and owner and not any(dotted(d) == "staticmethod" for d in node.decorator_list):
                    self.scope.types[a.arg] = f"={owner}"
                elif typed:
                    self.scope.types[a.arg] = typed
        self.open(body)
        if kind == "class":
            self.attributes(node, qualified)
        for stmt in body:
            self.visit(stmt)
        self.scope = self.scope.above

    def attributes(self, node: ast.ClassDef, qualified: str) -> None:
        """Attributes that methods set on their first argument."""
        for method in node.body:
            if isinstance(method, ast.FunctionDef | ast.AsyncFunctionDef) and method.args.args:
                own = method.args.args[0].arg
                for stmt in ast.walk(method):
                    for target in stmt.targets if isinstance(stmt, ast.Assign) else [stmt.target] if isinstance(stmt, ast.AnnAssign) else []:
                        if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == own and target.attr not in self.scope.bound:
                            self.scope.bound[target.attr] = self.facts.symbol(target.attr, f"{qualified}.{target.attr}", "attribute", stmt.lineno, stmt.end_lineno, None, typed=self.written_type(stmt))

    # Uses.

    def visit(self, node):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.facts.too_deep = True
        else:
            super().visit(node)
        self.depth -= 1

    def function(self, node) -> None:
        for part in [*node.decorator_list, *node.args.defaults, *filter(None, node.args.kw_defaults), *filter(None, [node.returns, *(a.annotation for a in ast.walk(node.args) if isinstance(a, ast.arg))])]:
            self.visit(part)
        self.inside("function", node, getattr(node, "full_name", self.full(node.name)), node.body)

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_ClassDef(self, node) -> None:
        full = getattr(node, "full_name", self.full(node.name))
        for base in node.bases:
            if path := dotted(base):
                self.facts.import_(path, base.lineno, alias=None, importer=full, via="base")
            self.visit(base)
        for part in [*node.decorator_list, *(k.value for k in node.keywords)]:
            self.visit(part)
        self.inside("class", node, full, node.body)

    def visit_If(self, node) -> None:
        test = ast.unparse(node.test)
        if any(w in test for w in ("sys.platform", "os.name", "version_info", "TYPE_CHECKING", "platform.system")):
            self.facts.branch(node.body[0].lineno, node.body[-1].end_lineno, test)
            if node.orelse:
                self.facts.branch(node.orelse[0].lineno, node.orelse[-1].end_lineno, f"not ({test})")
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.facts.import_(a.name, node.lineno, alias=a.asname or a.name.split(".")[0], importer=self.caller())

    def visit_ImportFrom(self, node) -> None:
        base = "." * node.level + (node.module or "")
        for a in node.names:
            star = a.name == "*"
            path = base if star else f"{base}{'' if base.endswith('.') or not base else '.'}{a.name}"
            self.facts.import_(path, node.lineno, alias=None if star else a.asname or a.name, glob=star, importer=self.caller(), via=base)

    def visit_Call(self, node) -> None:
        path, line = dotted(node.func), node.func.end_lineno
        if isinstance(node.func, ast.Name):
            found = self.scope.find(node.func.id)
            if found or node.func.id not in BUILTINS:
                self.facts.call(node.func.id, "free", line, self.caller(), local=found)
        elif isinstance(node.func, ast.Attribute):
            head = path.split(".")[0] if path else None
            typed = self.scope.type_of(head) if head and path.count(".") == 1 else None
            if isinstance(node.func.value, ast.Call) and not typed and (made := dotted(node.func.value.func)):
                typed = made
            if head == "super()" and (owner := self.scope.enclosing_class()):
                typed = f"super={owner.qualified}"
            self.facts.call(node.func.attr, "method", line, self.caller(), path=path, receiver=head, local=self.scope.find(head) if head else None, typed=typed)
            self.visit(node.func.value)
        else:
            self.visit(node.func)
        for part in [*node.args, *(k.value for k in node.keywords)]:
            self.visit(part)

    def visit_Name(self, node) -> None:
        if isinstance(node.ctx, ast.Load) and (found := self.scope.find(node.id)) or isinstance(node.ctx, ast.Load) and node.id not in BUILTINS:
            self.facts.ref(node.id, "value", node.lineno, self.caller(), local=found)

    def visit_Attribute(self, node) -> None:
        path = dotted(node)
        if path and isinstance(node.ctx, ast.Load):
            head = path.split(".")[0]
            self.facts.ref(node.attr, "path", node.end_lineno, self.caller(), path=path, local=self.scope.find(head), typed=self.scope.type_of(head))
        elif not path:
            self.generic_visit(node)


def extract(data: bytes) -> dict:
    facts, source = Facts(), data.decode("utf-8", "replace")
    last = max(1, source.count("\n") + (not source.endswith("\n")))
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        facts.syntax_error = True
        facts.symbol("", "", "file", 1, last)
        return facts.done()
    facts.symbol("", "", "file", 1, last, ast.get_docstring(tree))
    reader = Reader(facts, source)
    reader.open(tree.body)
    for stmt in tree.body:
        reader.visit(stmt)
    return facts.done()
