"""Python functions as behaviour terms, by the standard library's parser."""

from __future__ import annotations

import ast

from ..functions.forms import UNIT, Form, Pattern, select, sequence

#: Operators by the parser's node.
_BINARY = {"Add": "+", "Sub": "-", "Mult": "*", "Div": "/", "FloorDiv": "//", "Mod": "%", "Pow": "**", "LShift": "<<", "RShift": ">>", "BitOr": "|", "BitXor": "^", "BitAnd": "&", "MatMult": "@"}
_COMPARE = {"Eq": "==", "NotEq": "!=", "Lt": "<", "LtE": "<=", "Gt": ">", "GtE": ">=", "Is": "is", "IsNot": "is not", "In": "in", "NotIn": "not in"}


class _Scope:
    def __init__(self):
        self.names: dict[str, int] = {}

    def bind(self, name: str) -> int:
        return self.names.setdefault(name, len(self.names))


class Lowering:
    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
        self.scope = _Scope()
        for a in [*function.args.posonlyargs, *function.args.args, *function.args.kwonlyargs]:
            self.scope.bind(a.arg)
        # a name that is stored anywhere is local; its number stays the same throughout
        for n in ast.walk(function):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                self.scope.bind(n.id)

    def pattern(self, t: ast.expr) -> Pattern:
        if isinstance(t, ast.Name):
            return Pattern("ignored") if t.id == "_" else Pattern("bind", self.scope.bind(t.id))
        if isinstance(t, (ast.Tuple, ast.List)):
            return Pattern("tuple", None, tuple(map(self.pattern, t.elts)))
        if isinstance(t, ast.Starred):
            return self.pattern(t.value)
        return Pattern("ignored")

    # expressions

    def expr(self, e: ast.expr | None) -> Form:
        if e is None:
            return UNIT
        f = getattr(self, "e_" + type(e).__name__, None)
        return f(e) if f else Form("opaque", type(e).__name__, tuple(self.expr(c) for c in ast.iter_child_nodes(e) if isinstance(c, ast.expr)))

    def e_Name(self, e):
        return Form("local", self.scope.names[e.id]) if e.id in self.scope.names else Form("path", e.id)

    def e_Constant(self, e):
        if isinstance(e.value, bool) or e.value is None or e.value is Ellipsis:
            return Form("const", str(e.value))
        return Form("num", repr(e.value)) if isinstance(e.value, (int, float, complex)) else Form("lit")

    def e_Attribute(self, e):
        return Form("field", e.attr, (self.expr(e.value),))

    def e_Call(self, e):
        args = [self.expr(a) for a in e.args] + [self.expr(k.value) for k in e.keywords]
        if isinstance(e.func, ast.Attribute):
            return Form("method", e.func.attr, (self.expr(e.func.value), *args))
        if isinstance(e.func, ast.Name) and e.func.id not in self.scope.names:
            if e.func.id in ("list", "set", "tuple", "frozenset") and len(args) == 1 and not e.keywords:
                return Form("collect", e.func.id, (args[0],))
            if e.func.id in ("list", "dict", "set") and not args:
                return Form("construct", e.func.id)
        return Form("call", None, (self.expr(e.func), *args))

    def e_BinOp(self, e):
        return Form("binary", _BINARY[type(e.op).__name__], (self.expr(e.left), self.expr(e.right)))

    def e_BoolOp(self, e):
        op = "and" if isinstance(e.op, ast.And) else "or"
        out = self.expr(e.values[0])
        for v in e.values[1:]:
            out = Form("binary", op, (out, self.expr(v)))
        return out

    def e_Compare(self, e):
        terms = [self.expr(x) for x in (e.left, *e.comparators)]
        parts = [Form("binary", _COMPARE[type(o).__name__], (a, b)) for o, a, b in zip(e.ops, terms, terms[1:])]
        out = parts[0]
        for p in parts[1:]:
            out = Form("binary", "and", (out, p))
        return out

    def e_UnaryOp(self, e):
        return Form("opaque", {"Not": "not", "USub": "negate", "UAdd": "plus", "Invert": "invert"}[type(e.op).__name__], (self.expr(e.operand),))

    def e_IfExp(self, e):
        return Form("branch", None, (self.expr(e.test), self.expr(e.body), self.expr(e.orelse)))

    def e_List(self, e):
        return Form("opaque", "list", tuple(map(self.expr, e.elts))) if e.elts else Form("construct", "list")

    def e_Dict(self, e):
        return Form("opaque", "dict", tuple(self.expr(x) for kv in zip(e.keys, e.values) for x in kv if x is not None)) if e.keys else Form("construct", "dict")

    def e_Tuple(self, e):
        return Form("opaque", "tuple", tuple(map(self.expr, e.elts)))

    def e_Subscript(self, e):
        if isinstance(e.slice, ast.Slice):
            return Form("opaque", "slice", (self.expr(e.value), self.expr(e.slice.lower), self.expr(e.slice.upper), self.expr(e.slice.step)))
        return Form("opaque", "index", (self.expr(e.value), self.expr(e.slice)))

    def e_Lambda(self, e):
        pats = tuple(Pattern("bind", self.scope.bind(a.arg)) for a in e.args.args)
        return Form("lambda", None, (self.expr(e.body),), pats)

    def e_NamedExpr(self, e):
        return Form("let", None, (self.expr(e.value),), (self.pattern(e.target),))

    def e_Await(self, e):
        return Form("opaque", "await", (self.expr(e.value),))

    def _comprehension(self, generators, element: Form, container: str | None) -> Form:
        """Filters keep, the element transforms; an inner generator is an optional step
        of the outer one."""
        g, rest = generators[0], generators[1:]
        item = self.pattern(g.target)
        out = self.expr(g.iter)
        for test in g.ifs:
            out = Form("retain", None, (out, self.expr(test)), (item,))
        if rest:
            out = Form("sift", None, (out, self._comprehension(rest, element, None)), (item,))
        elif not (item.kind == "bind" and element == Form("local", item.name)):
            out = Form("transform", None, (out, element), (item,))
        return Form("collect", container, (out,)) if container else out

    def _first_pattern(self, generators):
        for g in generators:
            self.pattern(g.target)

    def e_ListComp(self, e, container="list"):
        self._first_pattern(e.generators)
        return self._comprehension(e.generators, self.expr(e.elt), container)

    def e_SetComp(self, e):
        return self.e_ListComp(e, "set")

    def e_GeneratorExp(self, e):
        return self.e_ListComp(e, None)

    def e_DictComp(self, e):
        self._first_pattern(e.generators)
        return self._comprehension(e.generators, Form("opaque", "tuple", (self.expr(e.key), self.expr(e.value))), "dict")

    # statements

    def block(self, body: list[ast.stmt]) -> Form:
        out: list[Form] = []
        i = 0
        while i < len(body):
            fused = self._filled_container(body, i)
            if fused:
                form, i = fused
                out.append(form)
                continue
            counted = self._counted_while(body, i)
            if counted:
                out.append(counted)
                i += 2
                continue
            f = self.stmt(body[i])
            if f != UNIT:
                out.append(f)
            i += 1
        return sequence(out) if out else UNIT

    def _filled_container(self, body, i) -> tuple[Form, int] | None:
        """`v = []` and a loop that only appends to v is a collection."""
        if i + 1 >= len(body):
            return None
        start, loop = body[i], body[i + 1]
        if not (isinstance(start, ast.Assign) and len(start.targets) == 1 and isinstance(start.targets[0], ast.Name) and isinstance(start.value, (ast.List, ast.Call)) and isinstance(loop, ast.For) and not loop.orelse):
            return None
        empty = isinstance(start.value, ast.List) and not start.value.elts or isinstance(start.value, ast.Call) and isinstance(start.value.func, ast.Name) and start.value.func.id == "list" and not start.value.args
        inner, tests = loop.body, []
        while len(inner) == 1 and isinstance(inner[0], ast.If) and not inner[0].orelse:
            tests.append(inner[0].test)
            inner = inner[0].body
        name = start.targets[0].id
        call = inner[0].value if len(inner) == 1 and isinstance(inner[0], ast.Expr) and isinstance(inner[0].value, ast.Call) else None
        if not (empty and call and isinstance(call.func, ast.Attribute) and call.func.attr == "append" and isinstance(call.func.value, ast.Name) and call.func.value.id == name and len(call.args) == 1):
            return None
        used = [loop.iter, *tests, call.args[0]]
        if any(isinstance(n, ast.Name) and n.id == name for u in used for n in ast.walk(u)):
            return None
        item = self.pattern(loop.target)
        out = self.expr(loop.iter)
        for t in tests:
            out = Form("retain", None, (out, self.expr(t)), (item,))
        element = self.expr(call.args[0])
        if not (item.kind == "bind" and element == Form("local", item.name)):
            out = Form("transform", None, (out, element), (item,))
        out = Form("collect", "list", (out,))
        if i + 2 < len(body) and isinstance(body[i + 2], ast.Return) and isinstance(body[i + 2].value, ast.Name) and body[i + 2].value.id == name:
            return Form("return", None, (out,)), i + 3
        return Form("let", None, (out,), (Pattern("bind", self.scope.bind(name)),)), i + 2

    def _counted_while(self, body, i) -> Form | None:
        """`n = 0; while n < len(s): ...; n += 1` walks s by its places."""
        if i + 1 >= len(body):
            return None
        start, loop = body[i], body[i + 1]
        if not (isinstance(start, ast.Assign) and isinstance(start.value, ast.Constant) and start.value.value == 0 and len(start.targets) == 1 and isinstance(start.targets[0], ast.Name) and isinstance(loop, ast.While) and not loop.orelse):
            return None
        n, test, last = start.targets[0].id, loop.test, loop.body[-1]
        by_one = isinstance(last, ast.AugAssign) and isinstance(last.op, ast.Add) and isinstance(last.target, ast.Name) and last.target.id == n and isinstance(last.value, ast.Constant) and last.value.value == 1
        below = isinstance(test, ast.Compare) and isinstance(test.left, ast.Name) and test.left.id == n and len(test.ops) == 1 and isinstance(test.ops[0], ast.Lt) and isinstance(test.comparators[0], ast.Call) and isinstance(test.comparators[0].func, ast.Name) and test.comparators[0].func.id == "len"
        if not (by_one and below and len(test.comparators[0].args) == 1):
            return None
        over = Form("call", None, (Form("path", "range"), self.expr(test.comparators[0])))
        return Form("traverse", None, (over, self.block(loop.body[:-1])), (Pattern("bind", self.scope.bind(n)),))

    def stmt(self, s: ast.stmt) -> Form:
        f = getattr(self, "s_" + type(s).__name__, None)
        return f(s) if f else Form("opaque", type(s).__name__, tuple(self.expr(c) for c in ast.iter_child_nodes(s) if isinstance(c, ast.expr)))

    def s_Expr(self, s):
        # a docstring does nothing
        return UNIT if isinstance(s.value, ast.Constant) else self.expr(s.value)

    def s_Pass(self, s):
        return UNIT

    def s_Return(self, s):
        return Form("return", None, (self.expr(s.value) if s.value is not None else Form("const", "None"),))

    def s_Break(self, s):
        return Form("opaque", "break")

    def s_Continue(self, s):
        return Form("opaque", "continue")

    def s_Raise(self, s):
        return Form("opaque", "raise", tuple(self.expr(x) for x in (s.exc, s.cause) if x is not None))

    def s_Assign(self, s):
        value = self.expr(s.value)
        out = []
        for t in s.targets:
            if isinstance(t, (ast.Name, ast.Tuple, ast.List)) and not any(isinstance(x, (ast.Attribute, ast.Subscript)) for x in ast.walk(t)):
                out.append(Form("let", None, (value,), (self.pattern(t),)))
            else:
                out.append(Form("assign", "=", (self.expr(t), value)))
        return sequence(out)

    def s_AnnAssign(self, s):
        return UNIT if s.value is None else self.s_Assign(ast.Assign(targets=[s.target], value=s.value))

    def s_AugAssign(self, s):
        return Form("assign", _BINARY[type(s.op).__name__] + "=", (self.expr(s.target), self.expr(s.value)))

    def s_If(self, s):
        body, other = self.block(s.body), self.block(s.orelse)
        return Form("branch", None, (self.expr(s.test), body, *([other] if other != UNIT else [])))

    def s_For(self, s):
        walk, back = s.iter, None
        if isinstance(walk, ast.Call) and isinstance(walk.func, ast.Name) and walk.func.id == "reversed" and len(walk.args) == 1:
            walk, back = walk.args[0], "back"
        item = self.pattern(s.target)
        out = Form("traverse", back, (self.expr(walk), self.block(s.body)), (item,))
        return sequence([out, Form("opaque", "else", (self.block(s.orelse),))]) if s.orelse else out

    s_AsyncFor = s_For

    def s_While(self, s):
        return Form("opaque", "while", (self.expr(s.test), self.block(s.body), *([self.block(s.orelse)] if s.orelse else [])))

    def s_With(self, s):
        heads = [Form("opaque", "with", (self.expr(i.context_expr),)) if i.optional_vars is None else Form("let", None, (Form("opaque", "with", (self.expr(i.context_expr),)),), (self.pattern(i.optional_vars),)) for i in s.items]
        return sequence([*heads, self.block(s.body)])

    s_AsyncWith = s_With

    def s_Try(self, s):
        """The body's outcome decides: each exception by its name, `_` for none."""
        arms = []
        for h in s.handlers:
            kinds = h.type.elts if isinstance(h.type, ast.Tuple) else [h.type]
            part = (Pattern("bind", self.scope.bind(h.name)),) if h.name else ()
            arms += [(Pattern("variant", "BaseException" if k is None else ast.unparse(k), part), self.block(h.body)) for k in kinds]
        arms.append((Pattern("ignored"), self.block(s.orelse)))
        out = select(self.block(s.body), arms) if s.handlers else self.block(s.body)
        return sequence([out, Form("opaque", "finally", (self.block(s.finalbody),))]) if s.finalbody else out

    def s_FunctionDef(self, s):
        pats = tuple(Pattern("bind", self.scope.bind(a.arg)) for a in s.args.args)
        return Form("let", None, (Form("lambda", None, (self.block(s.body),), pats),), (Pattern("bind", self.scope.bind(s.name)),))

    def s_Match(self, s):
        arms = []
        for c in s.cases:
            p = c.pattern
            name = ast.unparse(p) if not (isinstance(p, ast.MatchAs) and p.pattern is None) else None
            pat = Pattern("variant", name) if name and c.guard is None else Pattern("ignored")
            arms.append((pat, Form("opaque", "guard", (self.expr(c.guard), self.block(c.body))) if c.guard else self.block(c.body)))
        return select(self.expr(s.subject), arms)


def functions(source: str) -> list[tuple[str, int, int, Form]]:
    """(qualified name, first and last line, term) of every function of a module."""
    out = []

    def go(node: ast.AST, prefix: str) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((prefix + c.name, c.lineno, c.end_lineno or c.lineno, Lowering(c).block(c.body)))
                go(c, f"{prefix}{c.name}.")
            elif isinstance(c, ast.ClassDef):
                go(c, f"{prefix}{c.name}.")
            else:
                go(c, prefix)

    go(ast.parse(source), "")
    return out


def bare_calls(source: str) -> dict[str, int]:
    """Calls of a module: by bare names that the module binds, builtins, other bare
    names, by attribute; and while loops, those that walk among them."""
    import builtins

    tree = ast.parse(source)
    bound = {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    bound |= {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {(a.asname or a.name).split(".")[0] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names} | {a.arg for n in ast.walk(tree) if isinstance(n, ast.arguments) for a in [*n.args, *n.kwonlyargs, *n.posonlyargs]}
    out = dict.fromkeys(["bound", "builtin", "other", "attribute", "while_loops", "while_walks"], 0)
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            kind = "attribute" if not isinstance(n.func, ast.Name) else "bound" if n.func.id in bound else "builtin" if hasattr(builtins, n.func.id) else "other"
            out[kind] += 1
        elif isinstance(n, ast.While):
            out["while_loops"] += 1
            last = n.body[-1]
            out["while_walks"] += isinstance(last, ast.AugAssign) and isinstance(last.op, (ast.Add, ast.Sub)) and isinstance(n.test, ast.Compare)
    return out
