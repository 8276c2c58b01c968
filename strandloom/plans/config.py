"""Run settings: read, checked, and turned into what a chemistry lets a run measure. Small, on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Run:
    """Declared codes with species, run offsets and labels, read lengths, and what of them a read can show."""

    species: dict[str, str]
    offsets: dict[str, int]
    labels: dict[str, str]
    barcodes: tuple[str, ...] = ()
    read_lengths: tuple[int, int] = (0, 0)
    accepted: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def from_json(cls, text: str, names: dict[str, str] | None = None) -> Run:
        """Settings from JSON; `names` gives the JSON's own name for any of this class's fields."""
        raw = json.loads(text)
        get = lambda field, none: raw.get((names or {}).get(field, field), none)
        return cls(
            {str(k): str(v) for k, v in get("species", {}).items()},
            {str(k): int(v) for k, v in get("offsets", {}).items()},
            {str(k): str(v) for k, v in get("labels", {}).items()},
            tuple(get("barcodes", ())),
            tuple(get("read_lengths", (0, 0))),
            frozenset(get("accepted", ())),
        )

    def measurable(self) -> dict[str, bool]:
        """Which of the structures the reads are long enough to show."""
        code = max(map(len, self.species), default=0)
        reach = max(self.offsets.values(), default=0)
        first, second = self.read_lengths
        return {"code": first >= code > 0, "g_run": first >= code + reach + 3, "mate_tail": second >= 40}

    def problems(self) -> list[str]:
        """What is wrong with the settings; an empty list lets the run start."""
        out = []
        if not self.species:
            out.append("no codes are declared")
        bad = sorted(c for c in self.species if set(c) - set("ACGT"))
        out += [f"code {c} has letters other than A, C, G, T" for c in bad]
        out += [f"species {s} is unknown" for s in sorted(set(self.species.values()) - {"human", "mouse"})]
        for name, have in (("offset", self.offsets), ("label", self.labels)):
            out += [f"code {c} has no {name}" for c in sorted(set(self.species) - set(have))] if have else []
            out += [f"{name} of undeclared code {c}" for c in sorted(set(have) - set(self.species))]
        if self.labels and len(set(self.labels.values())) < len(self.labels):
            out.append("a label is given twice")
        out += [f"{k} can't be measured with these reads" for k, v in self.measurable().items() if not v and k not in self.accepted]
        return out

    def checked(self) -> Run:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self

    def guide(self) -> str:
        """The settings as lines of key and value between marks, which parse_guide() reads."""
        rows = [f"species.{k}\t{v}" for k, v in sorted(self.species.items())] + [f"offset.{k}\t{v}" for k, v in sorted(self.offsets.items())] + [f"label.{k}\t{v}" for k, v in sorted(self.labels.items())]
        return "\n".join(["BEGIN_CONFIG", *rows, "END_CONFIG", ""])
