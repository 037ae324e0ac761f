"""Sizes of tensors, read from a program and from the reference problem that it answers.

The inputs come from ``get_inputs`` of the program, or of its reference where it has none of its own; a forward's
parameters take them by position. Whole numbers that shapes are asked for (``numel``, ``size``, ``shape``) and
allocations made of them are evaluated until nothing changes, over buffers that keep their identity through helpers.
What is not certain is None, and None is never counted.
"""

from __future__ import annotations

import ast
import math

from .hostflow import RESULT, Flow, Scope, base
from .kernelflow import dotted

#: Bytes of an element, and the cost model's bytes a second and seconds of a launch.
BYTES = {"float64": 8, "double": 8, "int64": 8, "long": 8, "float32": 4, "float": 4, "int32": 4, "int": 4, "float16": 2, "half": 2, "bfloat16": 2, "int16": 2, "short": 2, "int8": 1, "uint8": 1, "bool": 1}
BANDWIDTH, LAUNCH = 1.6e12, 5e-6
#: Calls that make a tensor of given sizes, and methods that keep a tensor's sizes.
MAKERS = {"rand", "randn", "zeros", "ones", "empty", "full", "randint"}
LIKE = {"empty_like", "zeros_like", "ones_like", "full_like", "rand_like", "randn_like"}
KEEPS = {"cuda", "to", "contiguous", "float", "half", "requires_grad_", "clone", "abs", "detach", "relu", "sigmoid"}
PASSES = 4

Tensor = tuple[tuple[int, ...], str]


def constants(tree: ast.Module) -> dict[str, int]:
    """Module-level names bound to whole numbers, by arithmetic over earlier ones."""
    out: dict[str, int] = {}
    for n in tree.body:
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and (v := number(n.value, out)) is not None:
            out[n.targets[0].id] = v
    return out


def number(node: ast.AST, known: dict[str, int]) -> int | None:
    if isinstance(node, ast.Constant):
        return node.value if type(node.value) is int else None
    if isinstance(node, ast.Name):
        return known.get(node.id)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and (v := number(node.operand, known)) is not None:
        return -v
    if isinstance(node, ast.BinOp):
        a, b = number(node.left, known), number(node.right, known)
        ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.FloorDiv: lambda: a // b if b else None, ast.Mod: lambda: a % b if b else None}
        if a is not None and b is not None and type(node.op) in ops:
            return ops[type(node.op)]()
        if a is not None and b is not None and isinstance(node.op, ast.Pow) and 0 <= b <= 64 and abs(a) <= 1024:
            return a**b
    return None


def _dtype(call: ast.Call, default: str) -> str:
    named = next((dotted(k.value).rpartition(".")[2] for k in call.keywords if k.arg == "dtype"), "")
    return named if named in BYTES else default


def made(call: ast.Call, known: dict[str, int], default: str) -> Tensor | None:
    """The tensor that a call with literal or known sizes makes."""
    op = dotted(call.func).rpartition(".")[2] or (call.func.attr if isinstance(call.func, ast.Attribute) else "")
    op = op.removeprefix("new_")
    if op not in MAKERS:
        return None
    args = call.args
    if op == "randint":
        args, default = [next((a for a in args if isinstance(a, (ast.Tuple, ast.List))), ast.Tuple([], ast.Load()))], "int64"
    elif op == "full":
        args = args[:1]
    sizes = args[0].elts if len(args) == 1 and isinstance(args[0], (ast.Tuple, ast.List)) else args
    dims = [number(a, known) for a in sizes]
    return (tuple(dims), _dtype(call, default)) if dims and None not in dims else None


def input_tensors(tree: ast.Module) -> list[Tensor | None]:
    """What get_inputs returns, None where unknown; [] without such a function. The last definition counts, and names that it binds itself."""
    last = next((n for n in reversed(tree.body) if isinstance(n, ast.FunctionDef) and n.name == "get_inputs"), None)
    if last is None:
        return []
    known, held = constants(tree), {}

    def tensor(node: ast.AST) -> Tensor | None:
        if isinstance(node, ast.Name):
            return held.get(node.id)
        if isinstance(node, ast.Call):
            if (found := made(node, known, "float32")) is not None:
                return found
            return tensor(node.func.value) if isinstance(node.func, ast.Attribute) and node.func.attr in KEEPS else None
        if isinstance(node, ast.BinOp):
            return tensor(node.left) or tensor(node.right)
        return None

    for n in last.body:
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            if (v := number(n.value, known)) is not None:
                known = known | {n.targets[0].id: v}
            else:
                held[n.targets[0].id] = tensor(n.value)
        elif isinstance(n, ast.Return) and isinstance(n.value, (ast.List, ast.Tuple)):
            return [tensor(e) for e in n.value.elts]
    return []


def source_inputs(source: str | None) -> list[Tensor | None]:
    """The inputs of a reference problem's source; [] where it does not parse."""
    try:
        return input_tensors(ast.parse(source or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def tensor_bytes(t: Tensor) -> int:
    return math.prod(t[0]) * BYTES[t[1]]


def input_bytes(inputs: list[Tensor | None]) -> int | None:
    """Bytes that any right program reads: its inputs once; None where a size is unknown."""
    return sum(map(tensor_bytes, inputs)) or None if None not in inputs else None


def transfer_seconds(n: int) -> float:
    return n / BANDWIDTH


class Sizes:
    """Tensors of a program's buffers: by the buffer's class in ``Flow``."""

    def __init__(self, flow: Flow, inputs: list[Tensor | None]):
        self.flow, self.inputs = flow, inputs
        self.tensors: dict[tuple[int, str], Tensor] = {}
        self.numbers: dict[int, dict[str, int]] = {}
        self.default = next((t[1] for t in inputs if t), "float32")
        if flow.scopes:
            for name, t in zip(flow.scopes[0].params, inputs, strict=False):
                if t:
                    self.tensors[flow.find(flow.scopes[0], name)] = t
        top = constants(flow.p.tree)
        for _ in range(PASSES):
            before = len(self.tensors), sum(map(len, self.numbers.values()))
            for s in flow.scopes:
                known = self.numbers.setdefault(id(s.node), dict(top))
                for n in ast.walk(s.node):
                    if isinstance(n, ast.Assign) and len(n.targets) == 1:
                        self._assign(s, n.targets[0], n.value, known)
                    elif isinstance(n, ast.Return) and isinstance(n.value, ast.Call):
                        self._hold(s, RESULT, n.value, known)
            if before == (len(self.tensors), sum(map(len, self.numbers.values()))):
                break

    def of(self, s: Scope, node: ast.AST) -> Tensor | None:
        name = base(node)
        return self.tensors.get(self.flow.find(s, name)) if name else None

    def bytes(self, key: tuple[int, str]) -> int | None:
        return tensor_bytes(self.tensors[key]) if key in self.tensors else None

    def _ask(self, s: Scope, node: ast.AST) -> int | None:
        """x.numel(), x.size(i), x.shape[i], len(x)."""
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Attribute) and node.value.attr == "shape":
            t, i = self.of(s, node.value.value), number(node.slice, {})
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("numel", "nelement"):
            t = self.of(s, node.func.value)
            return math.prod(t[0]) if t else None
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "size" and node.args:
            t, i = self.of(s, node.func.value), number(node.args[0], {})
        else:
            return None
        return t[0][i] if t and i is not None and -len(t[0]) <= i < len(t[0]) else None

    def _number(self, s: Scope, node: ast.AST, known: dict[str, int]) -> int | None:
        asked = {f"#{i}": v for i, n in enumerate(ast.walk(node)) if (v := self._ask(s, n)) is not None}
        if not asked:
            return number(node, known)

        class Put(ast.NodeTransformer):
            def visit(put, n):  # noqa: N805
                v = self._ask(s, n)
                return ast.Constant(v) if v is not None else put.generic_visit(n)

        return number(Put().visit(ast.parse(ast.unparse(node), mode="eval").body), known)

    def _assign(self, s: Scope, target: ast.AST, value: ast.AST, known: dict[str, int]) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            whole = isinstance(value, ast.Attribute) and value.attr == "shape"
            whole = whole or (isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and value.func.attr == "size" and not value.args)
            t = self.of(s, value.value if isinstance(value, ast.Attribute) else value.func.value) if whole else None
            if t and len(t[0]) == len(target.elts):
                known.update({e.id: d for e, d in zip(target.elts, t[0], strict=True) if isinstance(e, ast.Name)})
        elif isinstance(target, ast.Name):
            if (v := self._number(s, value, known)) is not None:
                known[target.id] = v
            elif isinstance(value, ast.Call):
                self._hold(s, target.id, value, known)

    def _hold(self, s: Scope, name: str, call: ast.Call, known: dict[str, int]) -> None:
        op = dotted(call.func).rpartition(".")[2]
        t = None
        if op in LIKE and call.args and (like := self.of(s, call.args[0])):
            t = like[0], _dtype(call, like[1])
        elif op in MAKERS or op.startswith("new_"):
            sizes = call.args[0] if len(call.args) == 1 else None
            if isinstance(sizes, ast.Attribute) and sizes.attr == "shape" and (like := self.of(s, sizes.value)):
                t = like[0], _dtype(call, self.default)
            else:
                put = {k: v for k, v in known.items()}
                args = [ast.Constant(v) if (v := self._number(s, a, put)) is not None else a for a in call.args]
                args = [type(a)([ast.Constant(v) if (v := self._number(s, e, put)) is not None else e for e in a.elts], ast.Load()) if isinstance(a, (ast.Tuple, ast.List)) else a for a in args]
                t = made(ast.Call(call.func, args, call.keywords), put, self.default)
        if t:
            self.tensors.setdefault(self.flow.find(s, name), t)
