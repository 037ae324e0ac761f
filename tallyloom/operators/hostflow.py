"""Where tensors go in a program's timed path: buffers across functions, what kernels do with their parameters, sizes of inputs.

A buffer is a class of (function, name) pairs: names that alias one another, arguments and the parameters they are
passed to, results and the names they are returned under. Classes come from a union over all timed functions, so a tensor keeps its
identity through helpers, methods and submodules of the file.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from .callgraph import closure, functions_of
from .kernelflow import KernelFlow, dotted, walk

#: Methods that give another view or layout of a tensor, those that leave it non-contiguous, allocations, and ones filled with zeros.
VIEWS = {"view", "reshape", "permute", "transpose", "squeeze", "unsqueeze", "expand", "t", "flatten", "ravel", "narrow", "as_strided", "detach", "contiguous", "to", "cuda"}
LAYOUTS = {"permute", "transpose", "t", "expand", "movedim", "swapaxes"}
ALLOCATIONS = {"empty", "empty_like", "empty_strided", "zeros", "zeros_like", "ones", "ones_like", "full", "full_like", "new_empty", "new_zeros", "new_ones", "new_full"}
ZEROS = {"zeros", "zeros_like"}
#: Methods and attributes that give numbers, not tensors.
SCALARS = {"numel", "size", "dim", "ndimension", "nelement", "element_size", "stride", "item", "shape", "ndim", "data_ptr", "is_contiguous", "dtype", "device"}

#: The name of what a function returns.
RESULT = "<return>"


def base(node: ast.AST) -> str | None:
    """The name that a chain of attributes, calls and subscripts starts from."""
    while True:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, (ast.Attribute, ast.Subscript, ast.Starred)):
            node = node.value
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            node = node.func.value
        elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add) and any(isinstance(n, ast.Attribute) and n.attr == "data_ptr" for n in walk(node.left)):
            node = node.left  # an address within the tensor
        else:
            return None


def names(node: ast.AST) -> set[str]:
    return {n.id for n in walk(node) if isinstance(n, ast.Name)}


@dataclass
class Role:
    loaded: bool = False
    stored: bool = False
    atomic: bool = False
    partial: bool = False


def roles(kernel: ast.FunctionDef) -> dict[str, Role]:
    """What a kernel does with each of its parameters; pointers are followed through assignments to a fixed point."""
    if not hasattr(kernel, "_roles"):
        kernel._roles = _roles(kernel)
    return kernel._roles


def _roles(kernel: ast.FunctionDef) -> dict[str, Role]:
    params = [a.arg for a in [*kernel.args.posonlyargs, *kernel.args.args, *kernel.args.kwonlyargs]]
    comes: dict[str, set[str]] = {p: {p} for p in params}
    flow = KernelFlow(kernel)
    while True:
        before = sum(map(len, comes.values()))
        for n in walk(kernel):
            if isinstance(n, (ast.Assign, ast.AugAssign)) and not any(isinstance(c, ast.Call) and dotted(c.func).endswith(("tl.load",)) for c in walk(n.value)):
                sources = set().union(*(comes.get(x, set()) for x in names(n.value))) if names(n.value) else set()
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    for x in names(t):
                        comes[x] = comes.get(x, set()) | sources
        if sum(map(len, comes.values())) == before:
            break
    out = {p: Role() for p in params}
    for c in walk(kernel):
        if not isinstance(c, ast.Call) or not c.args:
            continue
        op = dotted(c.func).rpartition(".")[2]
        pointer = c.args[0]
        first = _leftmost(pointer)
        for p in comes.get(first, set()) if first else ():
            r = out.get(p)
            if r is None:
                continue
            if op in ("load", "make_block_ptr"):
                r.loaded |= op == "load"
            if op == "store":
                r.stored = True
                r.partial |= not flow.covers(pointer)
            if op.startswith("atomic_"):
                r.stored = r.atomic = True
    return out


def _leftmost(node: ast.AST) -> str | None:
    while isinstance(node, ast.BinOp):
        node = node.left
    return node.id if isinstance(node, ast.Name) else None


@dataclass
class Buffer:
    alloc: str | None = None
    line: int = 0
    is_input: bool = False
    returned: bool = False
    read: bool = False
    loaded_by: set[int] = field(default_factory=set)
    stored_by: set[int] = field(default_factory=set)


@dataclass
class Scope:
    node: ast.FunctionDef
    cls: str | None

    @property
    def params(self) -> list[str]:
        a = self.node.args
        out = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]]
        return out[1:] if out[:1] in (["self"], ["ctx"], ["cls"]) else out


class Flow:
    """The timed path of a program (``staticcheck.Program``): scopes, calls, buffers, launches in it."""

    def __init__(self, program):
        self.p = program
        self.attr_classes, self.modules, self.mixed = self._attributes()
        self.scopes = self._timed()
        self._parent: dict[tuple[int, str], tuple[int, str]] = {}
        self.noncontiguous: set[tuple[int, str]] = set()
        self.launches = [(s, x) for s in self.scopes for x in program.launches if x.node in self._calls(s)]
        self.buffers: dict[tuple[int, str], Buffer] = {}
        self._unite()
        self._observe()

    # what attributes hold

    def _attributes(self):
        """Per class: attributes bound to classes of the file, to nn modules, and containers that hold nn modules besides."""
        local, modules, mixed = {}, {}, set()
        for cname, c in self.p.classes.items():
            for n in walk(c):
                if not (isinstance(n, ast.Assign) and isinstance(n.value, ast.Call)):
                    continue
                made = [dotted(x.func) for x in walk(n.value) if isinstance(x, ast.Call)]
                for t in n.targets:
                    attr = dotted(t)
                    if not attr.startswith("self."):
                        continue
                    kind = dotted(n.value.func)
                    own = [m for m in made if m in self.p.classes]
                    if own:
                        local[cname, attr[5:]] = own
                    if kind.startswith(("nn.", "torch.nn.")) and not kind.rpartition(".")[2] == "Parameter":
                        modules[cname, attr[5:]] = kind
                        if any(m.startswith(("nn.", "torch.nn.")) for m in made if m != kind):
                            mixed.add((cname, attr[5:]))
        return local, modules, mixed

    def module_of(self, cls: str | None, attr: str) -> tuple[str, tuple[str, str]] | None:
        """The nn module that self.attr holds in a class, or in the entry class."""
        for c in (cls, self.p.entry):
            if (c, attr) in self.modules:
                return self.modules[c, attr], (c, attr)
        return None

    # what runs under forward

    def _method(self, cls: str | None, name: str, seen=frozenset()) -> Scope | None:
        node = self.p.classes.get(cls or "")
        if node is None or cls in seen:
            return None
        for f in node.body:
            if isinstance(f, ast.FunctionDef) and f.name == name:
                return Scope(f, cls)
        return next((s for b in node.bases if (s := self._method(dotted(b), name, seen | {cls}))), None)

    def callee(self, scope: Scope, call: ast.Call) -> Scope | None:
        """The function of the file that a call runs: a helper, an own or inherited method, a submodule's forward, an autograd function's."""
        name = dotted(call.func)
        if name in self.p.functions and not any(name == f.name for c in self.p.classes.values() for f in c.body if isinstance(f, ast.FunctionDef)):
            return Scope(self.p.functions[name], None)
        if name.startswith("self."):
            attr = name[5:]
            for c in (scope.cls, self.p.entry):
                if (found := self._method(c, attr)) is not None:
                    return found
                if (c, attr) in self.attr_classes:
                    return self._method(self.attr_classes[c, attr][0], "forward")
        if name.endswith(".apply") and name[:-6] in self.p.classes:
            return self._method(name[:-6], "forward")
        if isinstance(call.func, ast.Call) and dotted(call.func.func) in self.p.classes:
            return self._method(dotted(call.func.func), "forward")
        return None

    def _calls(self, scope: Scope) -> list[ast.Call]:
        return [n for n in walk(scope.node) if isinstance(n, ast.Call)]

    def _timed(self) -> list[Scope]:
        """The functions that a forward call runs, itself first."""
        functions = functions_of(self.p)
        return [Scope(*functions[x]) for x in closure(self.p.edges, self.p.entry_forward, True) if x in functions]

    # buffers

    def find(self, scope: Scope, name: str) -> tuple[int, str]:
        key = (id(scope.node), name)
        while self._parent.setdefault(key, key) != key:
            key = self._parent[key]
        return key

    def _join(self, a: tuple[Scope, str], b: tuple[Scope, str]) -> None:
        x, y = self.find(*a), self.find(*b)
        if x != y:
            self._parent[x] = y

    def _scope(self, found: Scope) -> Scope | None:
        return next((s for s in self.scopes if s.node is found.node), None)

    def _unite(self) -> None:
        for s in self.scopes:
            for n in walk(s.node):
                if isinstance(n, ast.Return) and n.value is not None:
                    for x in n.value.elts if isinstance(n.value, ast.Tuple) else [n.value]:
                        self._alias(s, RESULT, x)
                if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                    self._alias(s, n.targets[0].id, n.value)
                if isinstance(n, ast.Call) and (found := self.callee(s, n)) is not None and (g := self._scope(found)) is not None:
                    for arg, param in zip(n.args, g.params, strict=False):
                        if (b := base(arg)) and _is_tensor_expr(arg):
                            self._join((s, b), (g, param))
                    for k in n.keywords:
                        if k.arg in g.params and (b := base(k.value)):
                            self._join((s, b), (g, k.arg))

    def _alias(self, s: Scope, target: str, value: ast.AST) -> None:
        if isinstance(value, (ast.Name, ast.Subscript)) and (b := base(value)):
            self._join((s, target), (s, b))
            if (id(s.node), b) in self.noncontiguous:
                self.noncontiguous.add((id(s.node), target))
        elif isinstance(value, (ast.BinOp, ast.Call)) and any(isinstance(n, ast.Attribute) and n.attr == "data_ptr" for n in walk(value)) and (b := base(value)):
            self._join((s, target), (s, b))
        elif isinstance(value, ast.Attribute) and value.attr in ("T", "mT") and (b := base(value)):
            self._join((s, target), (s, b))
            self.noncontiguous.add((id(s.node), target))
        elif isinstance(value, ast.Call):
            if (found := self.callee(s, value)) is not None and (g := self._scope(found)) is not None:
                self._join((s, target), (g, RESULT))
            elif isinstance(value.func, ast.Attribute) and value.func.attr in VIEWS and (b := base(value)) and b not in ("torch", "F", "tl", "triton"):
                self._join((s, target), (s, b))
                if value.func.attr != "contiguous" and self.bent(s, value):
                    self.noncontiguous.add((id(s.node), target))

    def bent(self, s: Scope, node: ast.AST) -> bool:
        """Whether an expression's layout is certainly not contiguous."""
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            if node.func.attr == "contiguous":
                return False
            return node.func.attr in LAYOUTS or self.bent(s, node.func.value)
        if isinstance(node, ast.Attribute):
            return node.attr in ("T", "mT") or self.bent(s, node.value)
        return isinstance(node, ast.Name) and (id(s.node), node.id) in self.noncontiguous

    def label(self, key: tuple[int, str]) -> str:
        """What forward calls a buffer, or else the function that made it."""
        own = [n for f, n in self._parent if self.scopes and f == id(self.scopes[0].node) and n != RESULT and self.find(self.scopes[0], n) == key]
        return min(own, default=key[1])

    def buffer(self, s: Scope, name: str) -> Buffer:
        return self.buffers.setdefault(self.find(s, name), Buffer())

    def bound(self, launch) -> dict[str, ast.AST]:
        """Parameter to argument of a launch."""
        a = self.p.kernels[launch.kernel].node.args
        params = [x.arg for x in [*a.posonlyargs, *a.args]]
        return dict(zip(params, launch.node.args, strict=False)) | {k.arg: k.value for k in launch.node.keywords if k.arg}

    def _observe(self) -> None:
        forward = self.scopes[0] if self.scopes else None
        for s in self.scopes:
            inside = {id(n) for _, x in self.launches for n in walk(x.node)}
            skip = set(inside)
            for n in walk(s.node):
                # passing on, viewing and measuring a tensor reads nothing of it
                if isinstance(n, ast.Call) and (self.callee(s, n) is not None or dotted(n.func).rpartition(".")[2] in ALLOCATIONS or (isinstance(n.func, ast.Attribute) and n.func.attr in VIEWS | SCALARS)):
                    skip |= {id(m) for m in walk(n)}
                elif isinstance(n, ast.Attribute) and n.attr in SCALARS:
                    skip |= {id(m) for m in walk(n)}
                elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Name):
                    skip.add(id(n.value))
            for n in walk(s.node):
                if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and (op := dotted(n.value.func).rpartition(".")[2]) in ALLOCATIONS:
                    for t in n.targets:
                        if isinstance(t, ast.Name):
                            b = self.buffer(s, t.id)
                            b.alloc, b.line = op, n.lineno
                elif isinstance(n, ast.Return) and n.value is not None:
                    for x in n.value.elts if isinstance(n.value, (ast.Tuple, ast.List)) else [n.value]:
                        if isinstance(x, (ast.Name, ast.Subscript)):
                            skip |= {id(m) for m in walk(x)}
                        if s is forward and (b := base(x)):
                            self.buffer(s, b).returned = True
                    if s is forward:
                        self.buffer(s, RESULT).returned = True
                elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and id(n) not in skip:
                    self.buffer(s, n.id).read = True
        if forward:
            for x in forward.params:
                self.buffer(forward, x).is_input = True
        for i, (s, x) in enumerate(self.launches):
            role = roles(self.p.kernels[x.kernel].node)
            for param, arg in self.bound(x).items():
                if param in role and (b := base(arg)):
                    if role[param].loaded:
                        self.buffer(s, b).loaded_by.add(i)
                    if role[param].stored:
                        self.buffer(s, b).stored_by.add(i)

    def is_tensor(self, s: Scope, node: ast.AST) -> bool:
        """Whether an expression starts from a tensor: an input of forward, or what a kernel wrote."""
        if not _is_tensor_expr(node) or not (b := base(node)):
            return False
        buf = self.buffers.get(self.find(s, b))
        return buf is not None and (buf.is_input or bool(buf.stored_by))


def _is_tensor_expr(node: ast.AST) -> bool:
    """Not a size, stride or other number of a tensor."""
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        return node.func.attr not in SCALARS
    if isinstance(node, ast.Subscript):
        return _is_tensor_expr(node.value)
    if isinstance(node, ast.Attribute):
        return node.attr not in SCALARS
    return isinstance(node, (ast.Name, ast.Call))
