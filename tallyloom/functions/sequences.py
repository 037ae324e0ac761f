"""Token sequences and prompts as columns: prefixes, encoded pairs, budgets, the two passes of a sampler and their seam, prompt blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the sampler puts before a plan and between the two passes, and the segment numbers of their tokens.
PLAN_PREFIX, CODE_FENCE = "## Plan\n", "```python"
SEG_PLAN, SEG_CODE = 0, 1


def prefix_text(raw: Column, cut: Column, beam: Column) -> Column:
    """The generated part of a prefix: the text up to the cut, and a beam's branch. A cut outside the text is an error."""
    inside = (cut >= 0) & (cut <= F.length(raw))
    return F.when(inside, F.concat(F.substr(raw, F.lit(1), cut), F.coalesce(beam, F.lit("")))).otherwise(F.raise_error(F.concat(F.lit("a cut at "), cut.cast("string"), F.lit(" lies outside its text"))))


def scored_text(prompt: Column, raw: Column, cut: Column, beam: Column) -> Column:
    """What a process scorer reads: the bare prompt, then the generated part."""
    return F.concat(prompt, prefix_text(raw, cut, beam))


def tail(ids: Column, n: int) -> Column:
    """The last ``n`` ids: a prefix is cut at its head, as its end is what is scored. Nothing is appended."""
    if n < 1:
        raise ValueError(f"a length of {n}")
    return F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def encoded_pair(ref: Column, kernel: Column, instruction: list[int], separator: list[int], eos: int | None, max_length: int, reserve: int) -> Column:
    """Struct of ids (instruction, reference, separator, kernel, end) and what was kept of each side: the reference gets ``reserve`` tokens at most, the kernel what is left."""
    room = max(max_length - (eos is not None) - len(instruction) - len(separator), 0)
    n_ref = F.least(F.size(ref), F.lit(reserve), F.lit(room))
    n_kernel = F.least(F.size(kernel), room - n_ref)
    fixed = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    ids = F.concat(fixed(instruction), F.slice(ref, 1, n_ref), fixed(separator), F.slice(kernel, 1, n_kernel), fixed([] if eos is None else [eos]))
    return F.struct(
        ids.alias("ids"),
        n_ref.alias("ref_tokens"),
        n_kernel.alias("kernel_tokens"),
        F.size(ref).alias("ref_total"),
        F.size(kernel).alias("kernel_total"),
        ((F.size(ref) > n_ref) | (F.size(kernel) > n_kernel)).alias("truncated"),
    )


def budget(spent: Column, cap: int) -> Column:
    """Tokens that are left of a cap, never under zero."""
    return F.greatest(F.lit(0), cap - spent)


def joined_passes(plan: Column, code: Column) -> Column:
    """Struct of two passes' token arrays (structs token_ids, topk_ids, topk_lp, sampled_lp, sampled_rank) as one, with seg and the tokens of each pass. Passes of different widths of top-k are an error."""
    width = lambda p: F.coalesce(F.size(F.get(p["topk_ids"], F.lit(0))), F.lit(-1))
    n_plan, n_code = F.size(plan["token_ids"]), F.size(code["token_ids"])
    same = (width(plan) == width(code)) | (width(plan) < 0) | (width(code) < 0)
    seg = F.concat(F.array_repeat(F.lit(SEG_PLAN), n_plan), F.array_repeat(F.lit(SEG_CODE), n_code))
    cols = [F.concat(plan[c], code[c]).alias(c) for c in ("token_ids", "topk_ids", "topk_lp", "sampled_lp", "sampled_rank")]
    return F.when(same, F.struct(*cols, seg.alias("seg"), n_plan.alias("n_plan_tokens"), n_code.alias("n_code_tokens"))).otherwise(F.raise_error(F.lit("the passes have different widths of top-k")))


def assembled(plan: Column, code: Column) -> Column:
    """Struct of the text of two passes and where each stands in it. The fence gets a newline unless the code begins with one."""
    seam = F.when(F.startswith(code, F.lit("\n")), CODE_FENCE).otherwise(CODE_FENCE + "\n")
    start = F.lit(len(PLAN_PREFIX))
    stop = start + F.length(plan)
    code_start = stop + F.length(seam)
    return F.struct(
        F.concat(F.lit(PLAN_PREFIX), plan, seam, code).alias("text"),
        start.alias("plan_char_start"),
        stop.alias("plan_char_end"),
        code_start.alias("code_char_start"),
        (code_start + F.length(code)).alias("code_char_end"),
    )


def with_blocks(prompt: Column, *blocks: Column) -> Column:
    """A prompt with blocks after it, each a paragraph of its own; null blocks add nothing."""
    for b in blocks:
        strip = F.regexp_replace(F.regexp_replace(b, r"^\n+", ""), r"\n+$", "")
        prompt = F.when(F.coalesce(b, F.lit("")) == "", prompt).otherwise(F.concat(F.regexp_replace(prompt, r"\n+$", ""), F.lit("\n\n"), strip, F.lit("\n")))
    return prompt


def contract(constructor: Column, shapes: Column) -> Column:
    """The block that states how a model is built and called, from its constructor's arguments and its inputs' shapes (arrays of sizes); null where any shape is unknown."""
    known = shapes.isNotNull() & (F.size(shapes) > 0) & ~F.exists(shapes, lambda s: s.isNull())
    lines = F.transform(shapes, lambda s, i: F.concat(F.lit("  arg "), (i + 1).cast("string"), F.lit(": float32, shape ("), F.array_join(F.transform(s, lambda d: d.cast("string")), ", "), F.lit(")")))
    head = F.concat(F.lit("## Input contract\nModelNew is constructed as ModelNew("), constructor, F.lit(") and called with "), F.size(shapes).cast("string"), F.lit(" positional inputs, all on CUDA and contiguous:\n"))
    return F.when(known, F.concat(head, F.array_join(lines, "\n"), F.lit("\nThis supersedes any shape stated in comments or docstrings above.")))


def anchor_key(run: Column, shard: Column, stem: Column) -> Column:
    return F.concat_ws("__", run, shard, stem)


def unit_name(run: Column, shard: Column) -> Column:
    return F.concat_ws("__", run, shard)
