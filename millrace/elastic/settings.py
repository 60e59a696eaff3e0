"""Settings of a run of the planner, from ``key value ...`` lines."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# What the file calls the goals, and the storages it may name.
GOALS = {"JCT": "time", "cost": "cost"}
STORAGES = ("S3", "Redis")


@dataclass(frozen=True)
class Settings:
    cpus: int = 0
    step: str = ""
    algorithm: str = ""
    goal: str = "time"
    resource: str = ""
    slots: list[int] = field(default_factory=list)
    degree: int = 0
    storage: str = "S3"


def _one_of(names, value: str) -> str:
    if value not in names:
        raise ValueError(f"{value} is none of {', '.join(names)}")
    return value


#: Key of the file -> field and how its values are read (fixed values).
KEYS = {
    "num_cpus": ("cpus", lambda v: int(v[0])),
    "proc_step": ("step", lambda v: v[0]),
    "algorithm": ("algorithm", lambda v: v[0]),
    "mode": ("goal", lambda v: GOALS[_one_of(GOALS, v[0])]),
    "resource": ("resource", lambda v: v[0]),
    "distribution": ("slots", lambda v: [int(x) for x in v]),
    "base_deg": ("degree", lambda v: int(v[0])),
    "external": ("storage", lambda v: _one_of(STORAGES, v[0])),
}


def parse_settings(text: str) -> Settings:
    """Comments (#), empty lines and unknown keys are passed over; a known key's last line counts; a goal or storage it doesn't know is an error."""
    found = {}
    for line in text.splitlines():
        key, *values = line.split() or ["#"]
        if key in KEYS:
            name, read = KEYS[key]
            if not values:
                raise ValueError(f"{key} has no value")
            found[name] = read(values)
    return Settings(**found)


def even_slots(settings: Settings) -> Settings:
    """The same slots in all, dealt evenly over the servers; the first servers have what is left over."""
    n = len(settings.slots)
    each, more = divmod(sum(settings.slots), n) if n else (0, 0)
    return replace(settings, slots=[each + (k < more) for k in range(n)])
