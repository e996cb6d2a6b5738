"""Static configuration: data sets, panel, arm sets and judges, with pure lookups."""

from __future__ import annotations

import functools
import os
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

#: The suite in its order, the sets beside it, and those that come with evidence.
SUITE = ("medhallu", "ragtruth", "truthfulqa", "factscore", "aggrefact_xsum", "aggrefact_wice", "aggrefact_cnn", "aggrefact_expertqa")
GROUPS = {
    "all": SUITE,
    "qa": tuple(d for d in SUITE if not d.startswith("aggrefact_")),
    "cc": tuple(d for d in SUITE if d.startswith("aggrefact_")),
    "grounded": ("medhallu", "ragtruth", *(d for d in SUITE if d.startswith("aggrefact_"))),
}


@dataclass(frozen=True)
class Judge:
    """A reference judge: its key, family and harness, the data sets it runs on, and whether it has a contrast arm."""

    key: str
    family: str
    harness: str
    group: str = "all"
    contrast: bool = False


#: The registry of reference judges.
JUDGES = (
    Judge("sonnet", "api", "judge", contrast=True),
    Judge("qwen72b", "oss", "judge", contrast=True),
    Judge("qwen32b", "oss", "judge", contrast=True),
    Judge("prometheus2", "pt", "ptjudge"),
    Judge("judgelm", "pt", "ptjudge"),
    Judge("autoj", "pt", "ptjudge"),
    Judge("minicheck_ft5", "specialist", "minicheck", "grounded"),
    Judge("bespoke_minicheck", "specialist", "minicheck", "grounded"),
)
FAMILIES = tuple(dict.fromkeys(j.family for j in JUDGES))


def datasets(group: str) -> tuple[str, ...]:
    """Data sets of a group, or the one named."""
    if group in GROUPS:
        return GROUPS[group]
    if group in SUITE:
        return (group,)
    raise ValueError(f"unknown data set or group {group!r}")


def frame_of(dataset: str) -> str:
    return "claimcheck" if dataset.startswith("aggrefact_") else "qa"


def condition_of(dataset: str) -> str:
    return "claimcheck" if frame_of(dataset) == "claimcheck" else "def_on"


#: Arm sets: the file a measurement is kept in, the frames it applies to, and its conditions per data set.
ARM_SETS: dict[str, tuple[str, tuple[str, ...], Callable[[str], tuple[str, ...]]]] = {
    "main": ("experiment.jsonl", ("qa", "claimcheck"), lambda d: (condition_of(d),)),
    "contrast": ("contrast.jsonl", ("claimcheck",), lambda d: ("def_on",)),
}


def conditions_for(arm_set: str, dataset: str) -> tuple[str, ...]:
    """Conditions an arm set measures on a data set; raises where it does not apply."""
    if arm_set not in ARM_SETS:
        raise ValueError(f"unknown arm set {arm_set!r}")
    _, frames, conditions = ARM_SETS[arm_set]
    if frame_of(dataset) not in frames:
        raise ValueError(f"{arm_set} does not apply to {dataset}")
    return conditions(dataset)


def permitted(arm_set: str, dataset: str, wanted: str) -> tuple[str, ...]:
    """The conditions named in a comma list, without repeats; raises on one the arm set does not have there."""
    have = conditions_for(arm_set, dataset)
    named = tuple(dict.fromkeys(w.strip() for w in wanted.split(",") if w.strip()))
    unknown = [w for w in named if w not in have]
    if unknown or not named:
        raise ValueError(f"{unknown or 'nothing'} is not among {have}")
    return named


def select(spec: str) -> list[Judge]:
    """Judges by key, family, ``all`` or a comma list of these, each once, in the order named."""
    out: dict[str, Judge] = {}
    for token in (t.strip() for t in spec.split(",") if t.strip()):
        found = [j for j in JUDGES if token in ("all", j.family, j.key)]
        if not found:
            raise ValueError(f"unknown judge or family {token!r}")
        out |= {j.key: out.get(j.key, j) for j in found}
    return list(out.values())


def expected_arms(judge: Judge, dataset: str, contrast: bool = False) -> tuple[str, ...]:
    """Labels that a run of a judge on a data set records."""
    if contrast:
        return ("def_on",)
    return {"judge": (condition_of(dataset),), "ptjudge": (frame_of(dataset),), "minicheck": ("claimcheck",)}[judge.harness]


def tag_judge(tag: str) -> Judge | None:
    """The judge of a file's tag, with or without the mark of the contrast arm; None for an unknown tag."""
    key = tag.removesuffix("_defon").removeprefix("pt_")
    return next((j for j in JUDGES if j.key == key), None)


def require(condition: bool, message: str) -> None:
    """Raise unless ``condition`` holds: what must be there before a run."""
    if not condition:
        raise RuntimeError(message)


def _marked(kind: str, category: type[Warning], note: str) -> Callable:
    def mark(f: Callable) -> Callable:
        @functools.wraps(f)
        def warned(*args, **kwargs):
            if not os.environ.get(f"QUORATE_SILENCE_{kind.upper()}"):
                warnings.warn(f"{f.__name__} is {kind}: {note}", category, stacklevel=2)
            return f(*args, **kwargs)

        warned.lifecycle = kind
        return warned

    return mark


def experimental(note: str) -> Callable:
    """Mark a function whose results may change."""
    return _marked("experimental", FutureWarning, note)


def deprecated(note: str) -> Callable:
    """Mark a function that another one replaces."""
    return _marked("deprecated", DeprecationWarning, note)


def roster_matches(found: Sequence[str], panel: Sequence[str]) -> bool:
    """Whether recorded models are just the panel's."""
    return set(found) == set(panel)
