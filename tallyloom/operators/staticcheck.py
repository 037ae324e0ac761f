"""Static checks over program text: one parse of each source, findings as rows. Text is compiled at most, never run.

Checks register under an id; ``findings`` applies them through an Arrow UDF that isolates failures, so a bad source
yields a row with its parse status and never an error.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from .callgraph import GRAPH, closure, entry_of, owner, program_edges
from .callgraph import kernel_uses as closed_uses
from .hostflow import ZEROS, Flow, base, roles
from .kernelflow import KernelFlow, below, dotted, walk
from .shapes import LAUNCH, Sizes, input_bytes, input_tensors, source_inputs, tensor_bytes, transfer_seconds

#: Entry class names in order of preference, module aliases that programs use, names that offload or fall back.
ENTRY = "ModelNew"
MODULES = {"torch", "triton", "tl", "nn", "F", "math", "np", "numpy"}
OFFLOAD = {"torch.compile", "torch.jit.script", "torch.jit.trace", "torch._dynamo", "torch._inductor"}
HEAVY = {
    "matmul", "mm", "bmm", "addmm", "baddbmm", "einsum", "linear", "dot", "mv",
    "conv1d", "conv2d", "conv3d", "conv_transpose1d", "conv_transpose2d", "conv_transpose3d",
    "scaled_dot_product_attention", "softmax", "log_softmax",
    "layer_norm", "batch_norm", "group_norm", "instance_norm", "rms_norm",
    "max_pool1d", "max_pool2d", "max_pool3d", "avg_pool1d", "avg_pool2d", "avg_pool3d",
    "adaptive_avg_pool1d", "adaptive_avg_pool2d", "adaptive_avg_pool3d", "adaptive_max_pool1d", "adaptive_max_pool2d", "adaptive_max_pool3d",
    "interpolate", "upsample", "upsample_bilinear", "upsample_nearest", "grid_sample", "multi_head_attention_forward",
    "sort", "topk", "cumsum", "cumprod",
}
#: Heavy only as functions; as methods they are views.
HEAVY_FUNCTIONS = {"unfold", "fold"}
LIGHT = {
    "relu", "gelu", "silu", "sigmoid", "tanh", "elu", "leaky_relu", "hardtanh",
    "exp", "log", "log2", "log10", "sqrt", "rsqrt", "pow", "abs", "sign",
    "sum", "mean", "prod", "std", "var", "norm", "amax", "amin", "argmax", "argmin", "clamp", "clip", "where", "sigmoid_", "dropout",
    "add", "sub", "mul", "div", "neg", "reciprocal", "erf", "floor", "ceil", "round", "maximum", "minimum", "gather", "scatter", "scatter_add",
    "index_select", "masked_fill", "cross_entropy", "mse_loss",
    "softplus", "mish", "selu", "celu", "relu6", "hardswish", "hardsigmoid", "logsigmoid", "log_sigmoid", "softsign", "glu", "prelu", "rrelu", "threshold",
    "hardshrink", "softshrink", "tanhshrink",
    "log1p", "expm1", "exp2", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sinh", "cosh", "erfc", "square", "logsumexp",
    "normalize", "pad", "one_hot", "pixel_shuffle", "pixel_unshuffle",
    "binary_cross_entropy", "binary_cross_entropy_with_logits", "nll_loss", "kl_div", "l1_loss", "smooth_l1_loss", "huber_loss", "cosine_similarity",
}
#: Names that Python has itself; called bare, on numbers, they are no tensor operations.
BUILTINS = {"round", "abs", "pow", "sum"}
#: Modules that carry a task's work, those that do nothing at inference, and containers.
HEAVY_MODULES = {
    "Linear", "LazyLinear", "Bilinear", "Embedding", "EmbeddingBag",
    "Conv1d", "Conv2d", "Conv3d", "ConvTranspose1d", "ConvTranspose2d", "ConvTranspose3d",
    "LayerNorm", "BatchNorm1d", "BatchNorm2d", "BatchNorm3d", "GroupNorm", "InstanceNorm1d", "InstanceNorm2d", "InstanceNorm3d", "RMSNorm",
    "MultiheadAttention", "Transformer", "TransformerEncoderLayer", "LSTM", "GRU", "RNN",
    "MaxPool1d", "MaxPool2d", "MaxPool3d", "AvgPool1d", "AvgPool2d", "AvgPool3d", "AdaptiveAvgPool1d", "AdaptiveAvgPool2d", "AdaptiveAvgPool3d",
    "Softmax", "LogSoftmax", "Sequential",
}
INERT = {"Dropout", "Dropout1d", "Dropout2d", "Dropout3d", "AlphaDropout", "FeatureAlphaDropout", "Identity", "Flatten", "Unflatten"}
CONTAINERS = {"Sequential", "ModuleList", "ModuleDict"}
#: Host operations that copy a whole tensor, and types that a cast names.
COPIES = {"clone", "cat", "stack", "repeat", "repeat_interleave", "contiguous", "to"}
DTYPES = {"float", "float16", "float32", "float64", "half", "bfloat16", "double", "int", "int8", "int16", "int32", "int64", "long", "short", "bool", "uint8"}


@dataclass
class Kernel:
    name: str
    node: ast.FunctionDef
    loads: list[ast.Call] = field(default_factory=list)
    stores: list[ast.Call] = field(default_factory=list)
    calls: set[str] = field(default_factory=set)

    @property
    def constexpr(self) -> set[str]:
        return {a.arg for a in [*self.node.args.args, *self.node.args.kwonlyargs] if a.annotation is not None and dotted(a.annotation).endswith("constexpr")}

    @cached_property
    def kind(self) -> str:
        return KernelFlow(self.node).kind


@dataclass
class Launch:
    kernel: str
    node: ast.Call
    scope: str
    in_loop: bool

    @property
    def args(self) -> list[str]:
        return [a.id for a in self.node.args if isinstance(a, ast.Name)] + [k.value.id for k in self.node.keywords if isinstance(k.value, ast.Name)]


class Program:
    """A parsed source: kernels, host functions, classes, launches, the entry class and what it reaches."""

    def __init__(self, source: str, reference: str | None = None):
        self.source, self.reference, self.status, self.error_line = source, reference, "ok", None
        self.tree: ast.Module = ast.Module([], [])
        self.kernels: dict[str, Kernel] = {}
        self.functions: dict[str, ast.FunctionDef] = {}
        self.classes: dict[str, ast.ClassDef] = {}
        self.launches: list[Launch] = []
        self.entry: str | None = None
        try:
            compile(source, "<source>", "exec", dont_inherit=True)
            self.compiles = True
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            self.compiles, self.error_line = False, getattr(e, "lineno", None)
        if not source.strip():
            self.status = "empty"
            return
        try:
            self.tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            self.status = "syntax_error"
            return
        for n in walk(self.tree):
            if isinstance(n, ast.FunctionDef):
                if any(dotted(d.func if isinstance(d, ast.Call) else d).rpartition(".")[2] == "jit" for d in n.decorator_list):
                    self.kernels[n.name] = k = Kernel(n.name, n)
                    for c in walk(n):
                        if isinstance(c, ast.Call):
                            name = dotted(c.func)
                            k.calls.add(name)
                            k.loads += [c] * name.endswith("tl.load")
                            k.stores += [c] * (name.endswith("tl.store") or ".atomic_" in name)
                else:
                    self.functions.setdefault(n.name, n)
            elif isinstance(n, ast.ClassDef):
                self.classes.setdefault(n.name, n)
        self._find_launches(self.tree, "<module>", False)
        self.entry = self._entry()

    def _entry(self) -> str | None:
        """The entry class by name, by another name that stands for it, or the only module there is."""
        named = {t.id: dotted(n.value) for n in self.tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
        for name in (ENTRY, "Model"):
            for _ in range(len(named) + 1):
                if name in self.classes:
                    return name
                name = named.get(name, "")
        modules = [c for c, n in self.classes.items() if any(dotted(b).endswith("Module") for b in n.bases)]
        return modules[0] if len(modules) == 1 else None

    def _find_launches(self, node: ast.AST, scope: str, loop: bool) -> None:
        for n in below(node):
            inner, again = scope, loop
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner, again = (f"{scope}.{n.name}" if scope != "<module>" else n.name), False
            elif isinstance(n, ast.ClassDef):
                inner = n.name
            elif isinstance(n, (ast.For, ast.While, ast.ListComp, ast.GeneratorExp)):
                again = True
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Subscript) and dotted(n.func.value).rpartition(".")[2] in self.kernels:
                self.launches.append(Launch(dotted(n.func.value).rpartition(".")[2], n, scope, loop))
            self._find_launches(n, inner, again)

    def forward(self, cls: str | None, seen: frozenset = frozenset()) -> ast.FunctionDef | None:
        """Own or in-file inherited forward."""
        node = self.classes.get(cls or "")
        if node is None or cls in seen:
            return None
        own = next((f for f in node.body if isinstance(f, ast.FunctionDef) and f.name == "forward"), None)
        return own or next((f for b in node.bases if (f := self.forward(dotted(b), seen | {cls}))), None)

    @cached_property
    def flow(self) -> Flow:
        return Flow(self)

    @cached_property
    def edges(self) -> list[tuple[str, str, bool]]:
        return program_edges(self)

    @property
    def entry_forward(self) -> str | None:
        return entry_of(self)

    @cached_property
    def may_run(self) -> list[Launch]:
        """Launches that may run: those outside cannot."""
        met = set(closure(self.edges, self.entry_forward, False))
        return [x for x in self.launches if owner(x.scope, self.classes) in met]

    @cached_property
    def inputs(self) -> list:
        """The tensors of get_inputs, or of the reference problem's where there is none here."""
        return input_tensors(self.tree) or source_inputs(self.reference)

    @cached_property
    def sizes(self) -> Sizes:
        return Sizes(self.flow, self.inputs)

    def live(self) -> set[str]:
        """Kernels with a launch that may run, or called by ones that have."""
        out, todo = set(), [x.kernel for x in self.may_run]
        while todo:
            k = todo.pop()
            if k not in out:
                out.add(k)
                todo += [c for c in self.kernels if c in {x.rpartition(".")[2] for x in self.kernels[k].calls}]
        return out

    def bindings(self) -> set[str]:
        out = set(dir(builtins))
        for n in walk(self.tree):
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                out |= {(a.asname or a.name).partition(".")[0] for a in n.names}
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.add(n.name)
            elif isinstance(n, ast.arg):
                out.add(n.arg)
            elif isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
                out.add(n.id)
            elif isinstance(n, ast.ExceptHandler) and n.name:
                out.add(n.name)
        return out

    def top_level(self) -> set[str]:
        out: set[str] = set()
        for n in self.tree.body:
            if isinstance(n, (ast.FunctionDef, ast.ClassDef)):
                out.add(n.name)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                out |= {(a.asname or a.name).partition(".")[0] for a in n.names}
            else:
                out |= {m.id for m in walk(n) if isinstance(m, ast.Name) and isinstance(m.ctx, ast.Store)}
        return out


Finding = tuple  # severity, message, line and, where they are known, bytes of traffic
CHECKS: dict[str, tuple[str, Callable[[Program], Iterator[Finding]]]] = {}


def check(cid: str, name: str):
    """Registers a check; ids are unique and become columns of reports."""

    def add(fn):
        if cid in CHECKS:
            raise ValueError(f"check {cid} twice")
        CHECKS[cid] = (name, fn)
        return fn

    return add


@check("S1.0", "not_compilable")
def _not_compilable(p: Program):
    if not p.compiles:
        yield "fail", "the source does not compile", p.error_line or 0


@check("S1.1", "no_entry_class")
def _no_entry(p: Program):
    if p.status == "empty" or (p.status == "ok" and ENTRY not in p.top_level()):
        yield "fail", f"{ENTRY} is not bound at module level", 0


@check("S1.2", "entry_has_no_forward")
def _no_forward(p: Program):
    if ENTRY in p.classes and p.forward(ENTRY) is None:
        outside = [b for b in map(dotted, p.classes[ENTRY].bases) if b and not b.endswith("Module") and b not in p.classes]
        if not outside:  # a base from elsewhere may bring one
            yield "fail", f"{ENTRY} has no forward", p.classes[ENTRY].lineno


@check("S1.3", "unresolved_name")
def _unresolved(p: Program):
    if p.status == "ok":
        bound = p.bindings()
        star = any(isinstance(n, ast.ImportFrom) and any(a.name == "*" for a in n.names) for n in walk(p.tree))
        used = {n.value.id: n.lineno for n in walk(p.tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)}
        for name in sorted(MODULES & set(used) - bound) if not star else ():
            yield "fail", f"{name} is used but never bound", used[name]


@check("F1.1", "no_kernel")
def _no_kernel(p: Program):
    if p.status == "ok" and not p.kernels:
        yield "fail", "no jit kernel", 0


@check("F1.2", "dead_kernel")
def _dead_kernel(p: Program):
    severity = "fail" if p.entry_forward or p.entry is None else "info"
    for k in sorted(set(p.kernels) - p.live()):
        yield severity, f"kernel {k} is never launched", p.kernels[k].node.lineno


@check("F1.3", "discarded_output")
def _discarded(p: Program):
    for i, (scope, x) in enumerate(p.flow.launches):
        role = roles(p.kernels[x.kernel].node)
        out = [p.flow.buffer(scope, b) for param, arg in p.flow.bound(x).items() if param in role and role[param].stored and (b := base(arg)) and b != "self"]
        if out and not any(b.returned or b.read or b.is_input or b.loaded_by - {i} for b in out):
            yield "fail", f"what {x.kernel} writes is never read", x.node.lineno


def _functional(name: str) -> bool:
    """A public operation of the functional namespace."""
    rest = name[2:] if name.startswith("F.") else name.partition("nn.functional.")[2]
    return bool(rest) and "." not in rest and not rest.startswith("_")


#: Shape, layout, allocation and movement, which are no computation.
PLUMBING = {
    "empty", "empty_like", "empty_strided", "zeros", "zeros_like", "ones", "ones_like", "full", "full_like", "tensor", "as_tensor", "from_numpy",
    "view", "reshape", "permute", "transpose", "squeeze", "unsqueeze", "expand", "t", "flatten", "ravel", "narrow", "as_strided", "detach", "item",
    "size", "stride", "shape", "numel", "dim", "data_ptr", "element_size", "is_contiguous", "is_cuda", "get_device",
    "contiguous", "clone", "to", "cuda", "cpu", "type", "float", "half", "long", "int", "bool", "double", "bfloat16", "cat", "stack", "repeat",
    "cdiv", "next_power_of_2", "range", "len", "min", "max",
}


def _host_calls(p: Program):
    """(scope, call, name) of the timed path, without launches and without what the file defines itself."""
    for s in p.flow.scopes:
        for n in walk(s.node):
            if isinstance(n, ast.Call) and not isinstance(n.func, ast.Subscript):
                name = dotted(n.func) or (n.func.attr if isinstance(n.func, ast.Attribute) else "")
                if name and name.partition(".")[0] not in ("tl", "triton"):
                    yield s, n, name


@check("F1.4", "torch_fallback")
def _fallback(p: Program):
    heavy, light = [], []
    for s, n, name in _host_calls(p):
        op = name.rpartition(".")[2]
        module = p.flow.module_of(s.cls, name[5:].partition(".")[0]) if name.startswith("self.") else None
        if p.flow.callee(s, n) is not None and module is None:
            continue
        if op in BUILTINS and name == op and isinstance(n.func, ast.Name) and not any(p.flow.is_tensor(s, m) for a in [*n.args, *(k.value for k in n.keywords)] for m in walk(a) if isinstance(m, ast.Name)):
            continue
        functional = _functional(name)
        if op in PLUMBING and not functional:
            continue
        if op in HEAVY or (functional and op in HEAVY_FUNCTIONS):
            heavy.append((name, n.lineno))
        elif op in LIGHT or functional:
            light.append((name, n.lineno))
    if heavy or light:
        yield "fail" if heavy else "warn", f"{', '.join(x for x, _ in heavy or light)} in the timed path", min(line for _, line in heavy + light)
    signs = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.MatMult: "@", ast.Pow: "**", ast.FloorDiv: "//", ast.Mod: "%"}
    hits = [(signs[type(n.op)], n.lineno) for s in p.flow.scopes for n in walk(s.node) if isinstance(n, ast.BinOp) and type(n.op) in signs and any(p.flow.is_tensor(s, x) for x in (n.left, n.right))]
    if hits:
        yield "fail" if any(x == "@" for x, _ in hits) else "warn", f"{', '.join(sorted({x for x, _ in hits}))} on tensors in the timed path", min(line for _, line in hits)


@check("F1.5", "nn_module_call")
def _module_call(p: Program):
    heavy, light = [], []
    for s, n, name in _host_calls(p):
        if not name.startswith("self.") or (found := p.flow.module_of(s.cls, name[5:])) is None:
            continue
        kind, where = found[0].rpartition(".")[2], found[1]
        if kind in INERT or (kind in CONTAINERS and where in p.flow.attr_classes and where not in p.flow.mixed):
            continue
        (heavy if kind in HEAVY_MODULES else light).append((found[0], n.lineno))
    if heavy or light:
        yield "fail" if heavy else "warn", f"{', '.join(x for x, _ in heavy + light)} called in the timed path", min(line for _, line in heavy + light)


@check("F1.6", "passthrough_kernel")
def _passthrough(p: Program):
    for k in sorted({x.kernel for x in p.may_run}):
        if p.kernels[k].kind == "copy":
            yield "fail", f"kernel {k} only copies", p.kernels[k].node.lineno


@check("F1.7", "compile_offload")
def _offload(p: Program):
    for n in walk(p.tree):
        name = dotted(n) if isinstance(n, ast.Attribute) else ""
        if name in OFFLOAD:
            yield "fail", f"{name} hands the work to a compiler", n.lineno


#: Kinds of producer and consumer that one kernel can always be made of.
FUSIBLE = {("elementwise", "elementwise"), ("elementwise", "reduction"), ("copy", "elementwise"), ("copy", "reduction"), ("matmul", "elementwise")}


def intermediates(p: Program) -> list[tuple[tuple[int, str], int, list[int]]]:
    """(buffer, launch that fills it, launches that read it) of buffers that only pass data between launches."""
    out = []
    for key, b in sorted(p.flow.buffers.items(), key=lambda x: x[1].line):
        if b.alloc and len(b.stored_by) == 1 and b.loaded_by and not b.stored_by & b.loaded_by and not (b.returned or b.read or b.is_input):
            out.append((key, min(b.stored_by), sorted(b.loaded_by)))
    return out


def chains(p: Program) -> list[list[tuple[tuple[int, str], int, list[int]]]]:
    """Intermediates that share a launch, directly or through others, as one chain each."""
    out: list[list] = []
    for x in intermediates(p):
        touched = {x[1], *x[2]}
        joined = [c for c in out if any(touched & {i, *js} for _, i, js in c)]
        out = [c for c in out if c not in joined] + [[y for c in joined for y in c] + [x]]
    return sorted(out, key=lambda c: min(p.flow.buffers[k].line for k, _, _ in c))


@check("F2.1", "dead_intermediate")
def _dead_intermediate(p: Program):
    kernel = lambda i: p.kernels[p.flow.launches[i][1].kernel]
    for c in chains(p):
        pairs = [(kernel(i), kernel(j)) for _, i, js in c for j in js]
        fuse = all((a.kind, b.kind) in FUSIBLE for a, b in pairs)
        moved = [p.sizes.bytes(k) for k, _, _ in c]
        names, through = ", ".join(p.flow.label(k) for k, _, _ in c), " -> ".join(dict.fromkeys(x.name for pair in pairs for x in pair))
        text = f"{names}: filled by one kernel only to be read by the next; " + (f"one kernel can do {through}" if fuse else f"{through} need not fit one kernel")
        yield "warn" if fuse else "info", text, min(p.flow.buffers[k].line for k, _, _ in c), 2 * sum(moved) if None not in moved else None


@check("F2.2", "launch_overhead")
def _overhead(p: Program):
    mine = [x for _, x in p.flow.launches]
    for x in mine:
        if x.in_loop:
            yield "fail", f"{x.kernel} is launched in a loop", x.node.lineno
    if len(mine) >= 3:
        moved = input_bytes(p.inputs)
        slow = bool(moved) and len(mine) * LAUNCH > transfer_seconds(moved)
        yield "warn" if slow else "info", f"{len(mine)} launches" + (" take longer than reading the inputs" if slow else ""), min(x.node.lineno for x in mine)


@check("F2.3", "layout_churn")
def _churn(p: Program):
    for s, n, name in _host_calls(p):
        op = name.rpartition(".")[2]
        if op not in COPIES or p.flow.callee(s, n) is not None:
            continue
        if op == "contiguous" and not (isinstance(n.func, ast.Attribute) and p.flow.bent(s, n.func.value)):
            continue
        if op == "to" and not (any(k.arg == "dtype" for k in n.keywords) or any(dotted(a).rpartition(".")[2] in DTYPES for a in n.args if not isinstance(a, ast.Constant))):
            continue
        t = p.sizes.of(s, n.func.value) if isinstance(n.func, ast.Attribute) and dotted(n.func.value) != "torch" else None
        yield "warn", f"{op} copies a whole tensor in the timed path", n.lineno, 2 * tensor_bytes(t) if t else None


@check("F2.4", "zeroed_overwritten_buffer")
def _zeroed(p: Program):
    for key, b in sorted(p.flow.buffers.items(), key=lambda x: x[1].line):
        if b.alloc not in ZEROS or not b.stored_by or b.loaded_by or b.read:
            continue
        written = []
        for i in b.stored_by:
            scope, x = p.flow.launches[i]
            role = roles(p.kernels[x.kernel].node)
            written += [role[param] for param, arg in p.flow.bound(x).items() if param in role and role[param].stored and (n := base(arg)) and p.flow.find(scope, n) == key]
        if written and not any(r.atomic or r.loaded or r.partial for r in written):
            yield "warn", f"{key[1]} is zeroed and then overwritten", b.line, p.sizes.bytes(key)


@check("F3.1", "unvectorised_kernel")
def _unvectorised(p: Program):
    for k in (p.kernels[x] for x in sorted({x.kernel for x in p.may_run})):
        if (k.loads or k.stores) and not any(c.endswith("arange") for c in k.calls):
            loop = any(isinstance(n, (ast.For, ast.While)) for n in walk(k.node))
            yield "warn" if loop else "info", f"kernel {k.name} moves one element at a time", k.node.lineno


@check("F3.2", "runtime_loop_bounds")
def _runtime_bounds(p: Program):
    for k in (p.kernels[x] for x in sorted({x.kernel for x in p.may_run})):
        params = {a.arg for a in [*k.node.args.args, *k.node.args.kwonlyargs]} - k.constexpr
        if any(c.endswith("arange") for c in k.calls):
            bounds = [(n.iter.args[0].id, n.lineno) for n in walk(k.node) if isinstance(n, ast.For) and isinstance(n.iter, ast.Call) and dotted(n.iter.func) == "range" and len(n.iter.args) == 1 and isinstance(n.iter.args[0], ast.Name) and n.iter.args[0].id in params]
            if bounds:
                yield "info", f"{', '.join(sorted({x for x, _ in bounds}))} known only at run time bound loops of {k.name}", min(line for _, line in bounds)


def analyze(source: str | None, reference: str | None = None, only: str = "") -> dict:
    """parse_status, findings in order of (check, line) and summary counts of one source. ``reference``: the problem's source, for the sizes of inputs; ``only``: a family of checks, by the head of its ids."""
    program, found, notes = Program(source or "", reference), [], []
    for cid, (_, fn) in CHECKS.items():
        if not cid.startswith(only):
            continue
        try:
            found += [{"check_id": cid, "severity": s, "message": m, "lineno": int(line or 0), "bytes": more[0] if more else None} for s, m, line, *more in fn(program)]
        except Exception as e:  # noqa: BLE001 - one check's failure must not hide the others'
            notes.append(f"{cid}: {type(e).__name__}")
    found.sort(key=lambda x: (x["check_id"], x["lineno"]))
    count = lambda severity: sum(x["severity"] == severity for x in found)
    return {
        "parse_status": program.status if not notes or program.status != "ok" else "partial",
        "findings": found,
        "n_kernels": len(program.kernels),
        "n_launches": len(program.may_run),
        "launches_in_loop": sum(x.in_loop for x in program.may_run),
        "n_fail": count("fail"),
        "n_warn": count("warn"),
        "n_info": count("info"),
        "wasted_bytes": sum(x["bytes"] or 0 for x in found if x["check_id"] in WASTE),
        "notes": notes,
    }


#: The checks whose findings name traffic that need not be.
WASTE = {"F2.1", "F2.3", "F2.4"}
_COUNTS = ("n_kernels", "n_launches", "launches_in_loop", "n_fail", "n_warn", "n_info")
REPORT = T.StructType(
    [
        T.StructField("parse_status", T.StringType()),
        T.StructField("findings", T.ArrayType(T.StructType([T.StructField("check_id", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("message", T.StringType()), T.StructField("lineno", T.IntegerType()), T.StructField("bytes", T.LongType())]))),
        *(T.StructField(c, T.IntegerType()) for c in _COUNTS),
        T.StructField("wasted_bytes", T.LongType()),
        T.StructField("notes", T.ArrayType(T.StringType())),
    ]
)
analyze_udf = F.udf(analyze, REPORT, useArrow=True)


def submission_ok(source: str | None) -> bool:
    return not analyze(source, only="S1")["findings"]


#: A comment of plain words as a text's last line. What it says is no code: its line stays, so places of findings do, too.
_LAST_COMMENT = r"(?<=[^\\\r]\n)#[\w ,.:;-]*(\n?)\z"


def _codes(rows: DataFrame, *texts: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_sha``, a hash of what checks can see of their texts, and (_sha, texts) with each code once, dealt by number, as a code's analysis costs far more than its bytes."""
    own = [F.regexp_replace(F.coalesce(F.col(t), F.lit("")), _LAST_COMMENT, "#$1") for t in texts]
    rows = rows.withColumn("_sha", F.concat(*(F.sha1(x.cast("binary")) for x in own)))
    once = rows.groupBy("_sha").agg(*(F.min(x).alias(f"_t{i}") for i, x in enumerate(own)))
    return rows, once.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_sha")


def scan(sources: DataFrame, text: str = "source", references: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """``sources`` with the column ``report``. Each distinct code (with its reference) is analyzed once, and reports come back by a hash of both; texts that differ only in what a comment on their last line says are one code. ``references`` (by, reference): the sources of the problems, joined by ``by``; a problem without one has none."""
    rows = sources.join(references.select(*by, F.col("reference").alias("_ref")), by, "left") if references is not None else sources.withColumn("_ref", F.lit(None).cast("string"))
    rows, codes = _codes(rows, text, "_ref")
    return rows.join(codes.select("_sha", analyze_udf("_t0", "_t1").alias("report")), "_sha").drop("_sha", "_ref")


def findings(scanned: DataFrame, *keys: str) -> DataFrame:
    """(keys, check_id, severity, message, lineno, bytes): a row for each finding."""
    return scanned.select(*keys, F.explode("report.findings").alias("f")).select(*keys, "f.*")


def flags(scanned: DataFrame) -> DataFrame:
    """One boolean column for each registered check."""
    ids = F.col("report.findings.check_id")
    return scanned.withColumns({cid.replace(".", "_"): F.array_contains(ids, cid) for cid in CHECKS})


def outcomes(flagged: DataFrame, checks: list[str], correct: str, speed: str) -> DataFrame:
    """For each check: rows, flag rate, share correct and median speedup of flagged and clean rows, rounded to 4 places.

    A row keeps its flags as one short code, so rates and shares come from counts of codes, and no row is repeated for each check.
    """
    code = F.concat(*(F.when(F.col(c).isNull(), "n").when(F.col(c), "y").otherwise("-") for c in checks))
    rows = written(flagged.select(code.alias("code"), F.col(correct).cast("double").alias("y"), F.col(speed).cast("double").alias("v")), "outcomes")
    sums = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("ny"), F.sum("y").alias("sy"))
    total = lambda c, flag=None: F.sum(F.when(F.col("flag") == flag, F.col(c)) if flag else F.col(c))
    sums = sums.select(F.posexplode(F.split("code", "")).alias("at", "flag"), "n", "ny", "sy").groupBy("at").agg(
        total("n").alias("n"),
        F.try_divide(F.coalesce(total("n", "y"), F.lit(0)), F.sum(F.when(F.col("flag") != "n", F.col("n")))).alias("rate"),
        F.try_divide(total("sy", "y"), total("ny", "y")).alias("correct_flagged"),
        F.try_divide(total("sy", "-"), total("ny", "-")).alias("correct_clean"),
    )
    middle = _medians(rows).groupBy("at").agg(*(F.max(F.when(F.col("flag") == f, F.col("median"))).alias(c) for f, c in (("y", "speedup_flagged"), ("-", "speedup_clean"))))
    names = F.array(*map(F.lit, checks))
    figures = ("rate", "correct_flagged", "correct_clean", "speedup_flagged", "speedup_clean")
    return sums.join(F.broadcast(middle), "at", "left").select(F.get(names, F.col("at")).alias("check_id"), "n", *(F.round(c, 4).alias(c) for c in figures))


def _medians(rows: DataFrame) -> DataFrame:
    """(at, flag, median): the exact median of ``v`` over the rows (code, v) whose code has ``flag`` at that place, for all places together.

    Values are dealt into ranges once; counts of ranges tell in which one each median lies, and only those ranges are counted value by value. No task holds more than a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.where("v IS NOT NULL").select("code", "v").repartitionByRange(parts, "v").withColumn("range", F.spark_partition_id()), "ranges")
    held = ranged.groupBy("range", "code").agg(F.count(F.lit(1)).alias("c")).select("range", "c", F.posexplode(F.split("code", "")).alias("at", "flag"))
    held = held.where("flag <> 'n'").groupBy("at", "flag", "range").agg(F.sum("c").alias("c"))
    own = Window.partitionBy("at", "flag")
    held = held.withColumns({"before": F.coalesce(F.sum("c").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("c").over(own)})
    wanted = held.withColumn("place", F.explode(F.array_distinct(F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2))))).where("before <= place AND place < before + c")
    near = ranged.join(F.broadcast(wanted.drop("c", "all")), "range").where(F.col("code").substr(F.col("at") + 1, F.lit(1)) == F.col("flag"))
    near = near.groupBy("at", "flag", "place", "before", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("at", "flag", "place").orderBy("v"))
    return near.withColumn("upto", upto).where("place < upto AND place >= upto - c").groupBy("at", "flag").agg(F.avg("v").alias("median"))


# call graphs


def graph_of(source: str | None) -> dict:
    """The graph of one program, as a row."""
    p = Program(source or "")
    return {
        "entry": p.entry_forward,
        "has_class": p.entry is not None,
        "kernels": sorted(p.kernels),
        "edges": [{"src": a, "dst": b, "does": does} for a, b, does in p.edges],
        "launches": [{"scope": owner(x.scope, p.classes), "kernel": x.kernel, "in_loop": x.in_loop} for x in p.launches],
        "calls": [{"src": k, "dst": c} for k in p.kernels for c in sorted({x.rpartition(".")[2] for x in p.kernels[k].calls} & set(p.kernels))],
    }


graph_udf = F.udf(graph_of, GRAPH, useArrow=True)


def graphs(programs: DataFrame, key: str, text: str = "source") -> DataFrame:
    """(key, graph) of each program."""
    rows, codes = _codes(programs, text)
    return rows.select(key, "_sha").join(_graphs(codes), "_sha").drop("_sha")


def _graphs(codes: DataFrame) -> DataFrame:
    return codes.select("_sha", graph_udf("_t0").alias("graph")).select("_sha", "graph.*")


def kernel_uses(programs: DataFrame, key: str, text: str = "source") -> DataFrame:
    """``callgraph.kernel_uses`` of programs: each distinct code's graph is closed once, and its kernels come back for every program that has it."""
    rows, codes = _codes(programs, text)
    return rows.select(key, "_sha").join(closed_uses(_graphs(codes), "_sha"), "_sha").drop("_sha")
