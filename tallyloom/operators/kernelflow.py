"""What a kernel computes, by data flow over its body.

Every value of a kernel is at one of three levels: INDEX (offsets, sizes, masks, constants), LOADED (what a load gave,
whatever it was cast to or named since) or COMPUTED (anything made of loaded values). Levels only rise, so assignments
are read until none changes. A kernel is a copy if all it stores is LOADED and goes to where it was loaded from, so
address arithmetic alone is no computation and a gather, a flip or a placement at an offset is no copy.
"""

from __future__ import annotations

import ast

INDEX, LOADED, COMPUTED = 0, 1, 2
#: Calls that hand their first operand on, ones that fold a block, and the fields of a value that give others.
SAME = {"to", "cast", "broadcast_to", "reshape", "view", "trans", "expand_dims", "ravel", "max_contiguous", "multiple_of", "max_constancy"}
FOLDS = {"sum", "max", "min", "reduce", "argmax", "argmin", "xor_sum", "associative_scan", "cumsum", "cumprod"}
LIBRARIES = {"tl", "triton", "libdevice", "math"}
LAUNCH_INDEX = {"program_id", "num_programs", "arange", "cdiv", "zeros", "full"}


def dotted(node: ast.AST) -> str:
    """'a.b.c' of a name or attribute chain, else ''."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else ""


#: Nodes that say only how an expression is used or combined; checks read them from their parents.
_MARKS = (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)


def below(node: ast.AST) -> list[ast.AST]:
    """A node's children, without marks of use, kept with the node."""
    try:
        return node._kids
    except AttributeError:
        out = node._kids = []
    for name in node._fields:
        value = getattr(node, name, None)
        if type(value) is list:
            out += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST) and not isinstance(value, _MARKS):
            out.append(value)
    return out


def walk(node: ast.AST) -> list[ast.AST]:
    """``ast.walk`` without marks of use, kept with the node: checks go over the same functions again and again."""
    try:
        return node._below
    except AttributeError:
        out = node._below = [node]
    for n in out:
        out += below(n)
    return out


def _op(node: ast.AST) -> str:
    f = node.func if isinstance(node, ast.Call) else node
    return f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""


def _is_library(node: ast.AST) -> bool:
    """Whether a call's target starts from the kernel language and not from a value."""
    while isinstance(node, ast.Attribute):
        node = node.value
    return isinstance(node, ast.Name) and node.id in LIBRARIES


class KernelFlow:
    """Levels of names, stores with their levels, and the kind of one kernel."""

    def __init__(self, node: ast.FunctionDef):
        self.node = node
        self.params = [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]]
        self.level: dict[str, int] = {}
        self.values: dict[str, list[ast.AST]] = {}
        self.in_loop: list[tuple[str, ast.AST, bool]] = []  # name, value, whether it is added to
        self.stores: list[tuple[ast.AST, ast.AST]] = []
        self.masks: dict[int, ast.AST | None] = {}  # by the address of a store
        self._collect(node, False)
        while any([self._raise(name, value) for name, values in self.values.items() for value in values]):
            pass

    def _collect(self, node: ast.AST, loop: bool) -> None:
        for n in below(node):
            if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr)) and n.value is not None:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    for m in walk(t):
                        if isinstance(m, ast.Name):
                            value = ast.BinOp(ast.Name(m.id, ast.Load()), n.op, n.value) if isinstance(n, ast.AugAssign) else n.value
                            self.values.setdefault(m.id, []).append(value)
                            if loop:
                                self.in_loop.append((m.id, value, isinstance(n, ast.AugAssign)))
            if isinstance(n, ast.Call) and len(n.args) >= 2 and (_op(n) == "store" or _op(n).startswith("atomic_")):
                self.stores.append((n.args[0], n.args[1]))
                self.masks[id(n.args[0])] = next((k.value for k in n.keywords if k.arg == "mask"), n.args[2] if len(n.args) > 2 else None)
            self._collect(n, loop or isinstance(n, (ast.For, ast.While)))

    def _raise(self, name: str, value: ast.AST) -> bool:
        new = max(self.level.get(name, INDEX), self.of(value))
        changed = new > self.level.get(name, INDEX)
        self.level[name] = new
        return changed

    def of(self, node: ast.AST | None) -> int:
        """The level of an expression."""
        if node is None or isinstance(node, ast.Constant):
            return INDEX
        if isinstance(node, ast.Name):
            return self.level.get(node.id, INDEX)
        if isinstance(node, ast.Call):
            op, args = _op(node), [*node.args, *(k.value for k in node.keywords)]
            if op == "load":
                return LOADED
            if op in LAUNCH_INDEX and _is_library(node.func):
                return INDEX
            method = isinstance(node.func, ast.Attribute) and not _is_library(node.func)
            first = node.func.value if method else args[0] if args else None
            if op in SAME:
                return self.of(first)
            return COMPUTED if any(self.of(a) for a in [*args, *([first] if method else [])]) else INDEX
        if isinstance(node, (ast.Tuple, ast.List)):
            return max(map(self.of, node.elts), default=INDEX)
        if isinstance(node, ast.IfExp):
            return max(self.of(node.body), self.of(node.orelse))
        if isinstance(node, (ast.Subscript, ast.Attribute, ast.Starred)):
            return self.of(node.value)
        return COMPUTED if any(self.of(n) for n in below(node) if isinstance(n, ast.expr)) else INDEX

    def _whole(self, node: ast.AST, depth: int = 12) -> ast.AST:
        """An expression with names that are assigned once replaced by what they stand for."""
        if depth and isinstance(node, ast.Name) and len(self.values.get(node.id, ())) == 1 and node.id not in self.params:
            return self._whole(self.values[node.id][0], depth - 1)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return ast.BinOp(self._whole(node.left, depth), ast.Add(), self._whole(node.right, depth))
        return node

    def place(self, address: ast.AST) -> tuple[str, ...] | None:
        """The terms of an address beside its pointer, the leftmost parameter; None where it is no such sum."""
        terms = self._terms(address)
        at = next((i for i, t in enumerate(terms) if isinstance(t, ast.Name) and t.id in self.params), None)
        return None if at is None else tuple(sorted(ast.dump(t) for i, t in enumerate(terms) if i != at))

    def _terms(self, address: ast.AST) -> list[ast.AST]:
        todo, out = [self._whole(address)], []
        while todo:
            n = todo.pop(0)
            if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add):
                todo[:0] = [n.left, n.right]
            else:
                out.append(n)
        return out

    def _deep(self, node: ast.AST, depth: int = 8) -> list[ast.AST]:
        """All nodes of an expression and of what its names were assigned."""
        out = []
        for n in walk(node):
            out.append(n)
            if depth and isinstance(n, ast.Name) and n.id not in self.params:
                for v in self.values.get(n.id, ()):
                    out += self._deep(v, depth - 1)
        return out

    def _ranges(self, node: ast.AST) -> bool:
        return any(isinstance(n, ast.Call) and _op(n) == "arange" for n in self._deep(node))

    def covers(self, address: ast.AST) -> bool:
        """Whether a store surely reaches every element: no index counts twice (a diagonal), no single range is strided or taken apart (a scatter, padding), and no mask compares ranges (a triangle)."""
        terms = self._terms(address)
        wide = [t for t in terms if self._ranges(t)]
        if any(isinstance(n, ast.BinOp) and isinstance(n.op, (ast.FloorDiv, ast.Mod)) and self._ranges(n.left) for t in wide for n in self._deep(t)):
            return False
        if len(wide) == 1 and any(isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mult) and (self._ranges(n.left) or self._ranges(n.right)) for n in walk(wide[0])):
            return False
        held = [{n.id for n in walk(t) if isinstance(n, ast.Name) and n.id not in self.params and n.id not in LIBRARIES} for t in terms]
        if any(a & b for i, a in enumerate(held) for b in held[:i]):
            return False
        mask = self.masks.get(id(address))
        return mask is None or not any(isinstance(n, ast.Compare) and self._ranges(n.left) and any(map(self._ranges, n.comparators)) for n in self._deep(mask))

    def _loads(self, value: ast.AST, depth: int = 12) -> list[ast.Call]:
        """The loads that a LOADED value may be."""
        if depth and isinstance(value, ast.Name):
            return [x for v in self.values.get(value.id, ()) for x in self._loads(v, depth - 1)]
        if isinstance(value, ast.Call) and _op(value) != "load":
            inner = value.func.value if isinstance(value.func, ast.Attribute) and not _is_library(value.func) else value.args[0] if value.args else None
            return self._loads(inner, depth) if inner is not None else []
        return [value] if isinstance(value, ast.Call) and value.args else []

    def _is_copy(self) -> bool:
        for address, value in self.stores:
            if self.of(value) != LOADED:
                return False
            to, came = self.place(address), self._loads(value)
            if to is None or not came or any(self.place(x.args[0]) != to for x in came):
                return False
        return bool(self.stores)

    def _accumulates(self) -> bool:
        """A loop that carries loaded data from one round to the next."""
        return any(self.of(value) > INDEX and (added or any(isinstance(m, ast.Name) and m.id == name for m in walk(value))) for name, value, added in self.in_loop)

    @property
    def kind(self) -> str:
        ops = {_op(n) for n in walk(self.node) if isinstance(n, ast.Call)}
        if "dot" in ops:
            return "matmul"
        if ops & FOLDS or self._accumulates():
            return "reduction"
        if self._is_copy():
            return "copy"
        return "elementwise" if self.stores else "unknown"
