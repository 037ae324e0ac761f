"""Settings in sections: defaults, overrides by dotted keys, checks, and the flat form that a report records."""

from __future__ import annotations

import dataclasses
import json
import typing
from dataclasses import dataclass, field


@dataclass
class Labels:
    label_mode: str = "graded"
    speedup_stat: str = "mean"
    speedup_lo: float = 0.2
    speedup_hi: float = 4.0
    speed_quant: float = 0.0


@dataclass
class Cuts:
    prose_lines_per_chunk: int = 1
    code_steps_per_chunk: int = 1
    min_frac: float = 0.0
    max_length: int = 16_384


@dataclass
class Campaign:
    k: int = 5
    min_rollouts: int = 2
    min_rel_depth: float = 0.1
    max_rel_depth: float = 0.9
    depth_buckets: int = 4
    min_list_size: int = 2
    max_list_size: int = 8
    label_source: str = "measured"
    seed: int = 42


@dataclass
class Search:
    beam_width: int = 4
    beam_groups: int = 1
    expand: int = 4
    max_steps: int = 16
    min_distinct_parents: int = 1
    segment_max_tokens: int = 256
    max_new_tokens: int = 4096
    two_pass: bool = True
    think_temperature: float = 1.0
    temperature: float = 0.6
    advance: str = "tokens"
    score_at_cut: bool = True
    selector: str = "scored"


@dataclass
class Settings:
    labels: Labels = field(default_factory=Labels)
    cuts: Cuts = field(default_factory=Cuts)
    campaign: Campaign = field(default_factory=Campaign)
    search: Search = field(default_factory=Search)


def coerce(text, kind):
    """A value of type ``kind`` from a string as a command line or a settings file has it."""
    if not isinstance(text, str):
        return text
    if kind is bool:
        if text.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{text!r} is neither true nor false")
        return text.lower() in ("true", "1", "yes")
    return kind(text)


def load(path: str | None = None, overrides: typing.Iterable[str] = ()) -> Settings:
    """Defaults, then a JSON file of sections, then overrides like ``search.beam_width=8``. Unknown sections and keys are errors."""
    out = Settings()
    pairs = []
    if path:
        with open(path) as f:
            pairs += [(f"{section}.{k}", v) for section, body in json.load(f).items() for k, v in body.items()]
    for x in overrides:
        key, eq, value = x.partition("=")
        if not eq:
            raise ValueError(f"{x!r} is no key=value")
        pairs.append((key, value))
    for key, value in pairs:
        section, _, name = key.partition(".")
        part = getattr(out, section, None)
        kinds = typing.get_type_hints(type(part)) if dataclasses.is_dataclass(part) else {}
        if name not in kinds:
            raise KeyError(f"no setting {key!r}")
        setattr(part, name, coerce(value, kinds[name]))
    check(out)
    return out


def check(s: Settings) -> None:
    """An error that names the first setting that cannot work."""
    lab, cuts, c, q = s.labels, s.cuts, s.campaign, s.search
    rules = [
        (lab.label_mode in ("binary", "graded"), "labels.label_mode"),
        (lab.speedup_stat in ("mean", "min"), "labels.speedup_stat"),
        (0 < lab.speedup_lo < lab.speedup_hi, "labels.speedup_lo and speedup_hi"),
        (0 <= lab.speed_quant <= 1, "labels.speed_quant"),
        (cuts.prose_lines_per_chunk >= 1 and cuts.code_steps_per_chunk >= 1, "cuts: lines and steps per chunk"),
        (0 <= cuts.min_frac < 1 and cuts.max_length >= 1, "cuts.min_frac or max_length"),
        (1 <= c.min_rollouts <= c.k, "campaign.min_rollouts"),
        (0 <= c.min_rel_depth < c.max_rel_depth <= 1, "campaign: depth window"),
        (c.depth_buckets >= 1 and 2 <= c.min_list_size <= c.max_list_size, "campaign: buckets or list sizes"),
        (c.label_source in ("measured", "imputed"), "campaign.label_source"),
        (q.beam_width >= 1 and q.beam_groups >= 1 and q.beam_width % q.beam_groups == 0, "search: beam_groups must divide beam_width"),
        (q.expand >= 1 and q.max_steps >= 1 and q.min_distinct_parents >= 1, "search: steps"),
        (1 <= q.segment_max_tokens <= q.max_new_tokens, "search: token budgets"),
        (q.advance in ("tokens", "cuts") and q.selector in ("scored", "random"), "search.advance or selector"),
    ]
    for ok, what in rules:
        if not ok:
            raise ValueError(f"bad setting: {what}")


def flat(s) -> dict[str, object]:
    """All settings under dotted keys."""
    out = {}
    for f in dataclasses.fields(s):
        v = getattr(s, f.name)
        if dataclasses.is_dataclass(v):
            out |= {f"{f.name}.{k}": x for k, x in flat(v).items()}
        else:
            out[f.name] = v
    return out
