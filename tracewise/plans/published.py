"""The published figures as analyses, made by rule from families of comparisons."""

from __future__ import annotations

from dataclasses import replace

from tracewise.plans.specs import CohortConfig, ComparisonSpec, EpochSpec, EventTableParams, ModulationSpec, NormalizeSpec

# How figures call protocols, and the windows in seconds.
NAMES = {
    "task_axons": "Axons", "NO_DREADDs": "NO_DREADDs", "passive_axons": "Passive axons", "passive_dendrites": "Passive dendrites",
    "control_dendrites (pre-CNO)": "Control dendrites pre-CNO", "control_dendrites (post-CNO)": "Control dendrites post-CNO",
    "task_dendrites (pre-CNO)": "hM4D dendrites pre-CNO", "task_dendrites (post-CNO)": "hM4D dendrites post-CNO",
}
CONTROL = ("control_dendrites (post-CNO)", "control_dendrites (pre-CNO)")
TASK = ("task_dendrites (post-CNO)", "task_dendrites (pre-CNO)")
EARLY = {"default_window": (5.1, 6.1), "per_protocol": {"NO_DREADDs": (5.05, 5.8)}}
STIM_WINDOW = (3.1, 3.5)
PASSIVE_GROUPS = ("passive_axons", "passive_dendrites")
METHODS_BASELINE = (2.0, 3.0)


def within(protocol: str, metric: str, **more) -> ComparisonSpec:
    """Catch-rewarded against not, within a protocol."""
    a, b = ("cRew", "nRew") if "passive" in protocol else ("cHIT", "nHIT")
    return ComparisonSpec(f"{NAMES[protocol]} {a} vs. {b}", (protocol, a), (protocol, b), metric, **more)


def across(kind: str, outcome: str, metric: str, **more) -> ComparisonSpec:
    """Before against after treatment."""
    pre, post = f"{kind} (pre-CNO)", f"{kind} (post-CNO)"
    shown = "Hit" if outcome == "HIT" else outcome
    return ComparisonSpec(f"{NAMES[pre]} vs. post-CNO {shown}", (pre, outcome), (post, outcome), metric, **more)


def against(passive: str, task: str, outcomes: tuple[str, str], metric: str, name: str | None = None, **more) -> ComparisonSpec:
    """A passive protocol against a task."""
    return ComparisonSpec(name or f"{NAMES[passive]} {outcomes[0]} vs. {outcomes[1]}", (passive, outcomes[0]), (task, outcomes[1]), metric, **more)


def normalized(spec: ComparisonSpec, offset: float = 0.0) -> ComparisonSpec:
    """The comparison over the outcomes without catch reward."""
    return replace(spec, normalize=NormalizeSpec((spec.a[0], "nRew"), (spec.b[0], "nHIT"), offset=offset))


def _state(run_id: str, alignment: str, comparisons: list[ComparisonSpec], extra: dict | None = None) -> CohortConfig:
    name = "early reward" if alignment == "reward" else "stim"
    epoch = EpochSpec(name, EARLY["default_window"], EARLY["per_protocol"] | (extra or {})) if alignment == "reward" else EpochSpec(name, STIM_WINDOW)
    return CohortConfig(run_id, alignment, epochs=(epoch,), modulation=ModulationSpec(name, "median"), comparisons=tuple(comparisons))


def published() -> tuple[CohortConfig, ...]:
    """The seven states of the published figures: 57 comparisons."""
    pd62 = {"passive_dendrites": (5.1, 6.2)}

    def active(metric: str, test: str) -> list[ComparisonSpec]:
        how = {"epoch": "early reward", "test": test}
        mixed = against("passive_dendrites", "NO_DREADDs", ("cRew", "cHIT"), metric, **how)
        gate = {"p_threshold": 1.5}
        return [within("NO_DREADDs", metric, **how, **gate), mixed, normalized(mixed), within("passive_dendrites", metric, **how, **gate)]

    reward = {"epoch": "early reward", "roi_set": "modulated"}
    gated = reward | {"p_threshold": 1.5}
    mw, st, pt = {"test": "mannwhitney"}, {"test": "student_t"}, {"test": "paired_t"}
    axons_rate, axons_onset = (against("passive_axons", "task_axons", ("cRew", "cHIT"), m, **reward, **t) for m, t in (("rate", mw), ("ev_onset", st)))
    named = lambda o: against("passive_dendrites", "NO_DREADDs", o, "rate", f"Passive_dendrites {o[0]} vs. NO_DREADDs {o[1]}", **gated, **mw)
    changes = lambda metric, how: [across("task_dendrites", o, metric, **how) for o in ("HIT", "cHIT", "nHIT")]
    stim = {"epoch": "stim", "roi_set": "modulated"}
    kinds = ("task_axons", *CONTROL, *TASK)
    return (
        _state("v10-reward-rate-mannwhitney-active-pd62", "reward", active("rate", "mannwhitney"), pd62),
        _state("v10-reward-ev-onset-student-t-active-pd62", "reward", active("ev_onset", "student_t"), pd62),
        _state("v10-reward-ev-duration-paired-t-modulated", "reward", [within(p, "ev_duration", **gated, **pt) for p in kinds]),
        _state(
            "v10-reward-ev-onset-rate-mannwhitney-modulated", "reward",
            [*[within(p, "ev_onset", **gated, **mw) for p in ("task_axons", *CONTROL, "passive_axons", *TASK)], *changes("ev_onset", gated | mw),
             *[within(p, "rate", **gated, **mw) for p in ("task_axons", *CONTROL)], across("control_dendrites", "HIT", "rate", **gated, **mw),
             axons_rate, normalized(axons_rate), within("passive_axons", "rate", **gated, **mw),
             against("passive_dendrites", "NO_DREADDs", ("nRew", "nHIT"), "rate", **gated, **mw), named(("cRew", "cHIT")), named(("nRew", "nHIT")),
             *[within(p, "rate", **gated, **mw) for p in TASK], *changes("rate", gated | mw)],
        ),
        _state(
            "v10-reward-ev-onset-peak-student-t-modulated", "reward",
            [across("control_dendrites", "HIT", "ev_onset", **gated, **st), axons_onset, normalized(axons_onset, 5.0), *[within(p, "peak", **gated, **st) for p in kinds]],
        ),
        _state(
            "v10-stimulus-ev-onset-rate-mannwhitney-modulated", "stimulus",
            [within(p, m, **stim, **mw) for m in ("ev_onset", "rate") for p in ("task_axons", *TASK)] + changes("rate", stim | mw),
        ),
        _state("v10-stimulus-ev-onset-student-t-modulated", "stimulus", changes("ev_onset", stim | st)),
    )


def passive_methods() -> tuple[CohortConfig, ...]:
    """The same with the passive groups' events found again by the published method."""
    params = EventTableParams(baseline_window_overrides=dict.fromkeys(PASSIVE_GROUPS, METHODS_BASELINE))
    return tuple(replace(c, run_id=f"{c.run_id}-passive-methods", event_source="regenerated", regenerated_groups=PASSIVE_GROUPS, event_tables=params) for c in published())


MANIFESTS = {"v10": published, "v10-passive-methods": passive_methods}
