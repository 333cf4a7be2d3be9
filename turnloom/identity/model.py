"""The identity model: voices become components (E), components belong to identities (G), and an identity shows one label (O).

`infer` is pure: of one tick's observations it says which component explains each, which identity that is, and which label it publishes.
`commit` changes the state by such an inference, once an observation. No single source of evidence may begin or move a label: support comes
from independent lineages, each capped, and a label is shown from `claim` support on and taken over from `switch` support on."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

from ..functions.matching import assign
from ..functions.voices import constrained
from .evidence import Bridge, Evidence, Exemplars


@dataclass(frozen=True)
class Settings:
    cap: float = 0.55  # support of one source at most
    prototype: float = 0.70
    location: float = 0.45  # cosine that argues neither for nor against
    scale: float = 0.12
    context: float = 0.75
    unexplained: float = 0.35
    lineages: int = 4
    parts: int = 1  # components of an identity
    inertia: float = 0.0
    exemplars: int = 4
    components: int = 8
    challengers: int = 2
    provisional: bool = True

    def __post_init__(self):
        if not 0 <= self.cap < 1 or self.scale <= 0 or not 0 <= self.prototype <= 1 or self.lineages < 2 or self.parts < 1:
            raise ValueError("settings out of range")

    @property
    def claim(self) -> float:
        """Support from which an identity may come to show a label: midway between one source and one establishment."""
        return (self.cap + 1) / 2

    @property
    def switch(self) -> float:
        """Support from which it may take over another label: an establishment and half a source."""
        return 1 + self.cap / 2


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-x))) if x >= 0 else float(np.exp(x) / (1 + np.exp(x)))


class Lineages(dict):
    """Independent sources of support with the most that each has given; only the greatest are kept."""

    def put(self, lineage: str, value: float, most: int) -> None:
        self[lineage] = max(self.get(lineage, 0.0), max(0.0, value))
        for k in sorted(self, key=lambda k: (-self[k], k))[most:]:
            del self[k]

    @property
    def total(self) -> float:
        return float(sum(self.values()))


@dataclass
class Component:
    profile: Exemplars
    novelty: Lineages = field(default_factory=Lineages)
    bridges: dict[str, Lineages] = field(default_factory=dict)
    owner: str | None = None


@dataclass
class Identity:
    parts: set[str] = field(default_factory=set)
    support: dict[str, Lineages] = field(default_factory=dict)
    provisional: str | None = None


@dataclass(frozen=True)
class Observation:
    key: str
    evidence: Evidence
    bridges: tuple[Bridge, ...] = ()
    excluded: frozenset[str] = frozenset()  # labels that other voices of its snapshot have


@dataclass(frozen=True)
class Decision:
    key: str
    identity: str | None
    component: str | None
    kind: str  # component, unexplained or none
    label: str | None  # None: a new one is allocated
    allocation: str  # none, acoustic_new, provisional_local_partition or provisional_evidence_poor
    reason: str
    binding: str  # unmatched, attach, retain or switch
    update: float  # weight with which the component's profile learns; 0: not at all
    bridge: Bridge | None
    bridge_support: float
    lineage: str
    novelty: float


@dataclass(frozen=True)
class Inference:
    observations: tuple[Observation, ...]
    decisions: tuple[Decision, ...]
    attached: tuple[tuple[str, str], ...]
    shown: Mapping[str, str | None]


@dataclass(frozen=True)
class Heard:
    """How a label sounds for an observation: by its components (sure) and by its first anchors (weak)."""

    sure: float | None = None
    sure_raw: float | None = None
    weak: float | None = None
    weak_raw: float | None = None

    @property
    def known(self) -> bool:
        return self.sure is not None or self.weak is not None

    @property
    def inlier(self) -> float:
        return max((x for x in (self.sure, self.weak) if x is not None), default=0.0)

    @property
    def utility(self) -> float:
        """Sure evidence counts for and against; anchors may recall a label, never veto it."""
        weak = 0.0 if self.weak is None else max(0.0, 2 * self.weak - 1)
        return (self.weak or 0.0) if self.sure is None else 2 * self.sure - 1 if self.weak is None else max(2 * self.sure - 1, weak)

    def excess(self, location: float) -> float:
        return max(0.0, max((x for x in (self.sure_raw, self.weak_raw) if x is not None), default=location) - location)


class IdentityModel:
    def __init__(self, settings: Settings | None = None):
        self.set = settings or Settings()
        self.components: dict[str, Component] = {}
        self.identities: dict[str, Identity] = {}
        self.anchors: dict[str, dict[str, np.ndarray]] = {}  # label -> its last two weak anchors
        self.shown: dict[str, str] = {}
        self.done: set[str] = set()

    # What is known
    def holder(self, label: str) -> str | None:
        return next((g for g, o in self.shown.items() if o == label), None)

    def add_label(self, label: str, anchor: Evidence | None = None) -> None:
        mine = self.anchors.setdefault(label, {})
        if anchor is not None and anchor.center is not None:
            mine[anchor.key] = anchor.center
            for k in sorted(mine)[:-2]:
                del mine[k]

    def fit(self, part: Component, e: Evidence) -> tuple[float, float, float]:
        """(cosine, score, inlier) of an observation under a component; wide voices and wide profiles are judged by a wider scale."""
        raw = part.profile.score(e.views, self.set.prototype)
        wide = (1 - np.cos(e.instability)) + (1 - np.cos(part.profile.dispersion))
        z = float((raw - self.set.location) / (self.set.scale + 0.5 * wide))
        return raw, z, sigmoid(z)

    def state_bytes(self) -> int:
        vectors = sum(8 * len(v) for c in self.components.values() for v, _, _ in c.profile.items.values()) + sum(8 * len(v) for a in self.anchors.values() for v in a.values())
        lines = sum(len(c.novelty) + sum(map(len, c.bridges.values())) for c in self.components.values()) + sum(len(x) for g in self.identities.values() for x in g.support.values())
        return vectors + 16 * lines

    # Inference
    def _heard(self, e: Evidence) -> dict[str, Heard]:
        out = {}
        for label, anchors in sorted(self.anchors.items()):
            g = self.holder(label)
            fits = [self.fit(self.components[c], e) for c in sorted(self.identities[g].parts) if c in self.components and self.components[c].profile.items] if g and e.route else []
            raw, _, inlier = max(fits, key=lambda x: (x[2], x[0]), default=(None, None, None))
            near = max((float(e.center @ a) for a in anchors.values()), default=None) if e.route else None
            weak = None if near is None else sigmoid(float(np.clip((near - self.set.location) / self.set.scale, -3.5, 3.5)))
            out[label] = Heard(inlier, raw, weak, near)
        return out

    def _kinship(self, component: str | None, label: str, precision: float) -> float:
        """Support of a label by the component's own prototype."""
        part = self.components.get(component) if component else None
        if part is None or part.profile.prototype is None:
            return 0.0
        g = self.holder(label)
        others = [self.components[c].profile.prototype for c in self.identities[g].parts if c in self.components] if g else []
        cosines = [float(part.profile.prototype @ v) for v in [*self.anchors[label].values(), *others] if v is not None]
        return precision * max(0.0, max(cosines, default=self.set.location) - self.set.location)

    def _claimed(self, o: Observation, component: str | None) -> tuple[Bridge | None, float]:
        if component is None or not o.evidence.profile:
            return None, 0.0
        best: dict[tuple[str, str], tuple[float, Bridge]] = {}
        for b in o.bridges:
            w = min(self.set.cap, self.set.cap * b.weight * o.evidence.profile)
            if b.label in self.anchors and w > best.get((b.label, b.lineage), (0.0, None))[0]:
                best[b.label, b.lineage] = (w, b)
        w, b = min(best.values(), key=lambda x: (-x[0], x[1].label, x[1].lineage), default=(0.0, None))
        return b, w

    def infer(self, observations: Iterable[Observation], apart: Iterable[tuple[str, str]] = ()) -> Inference:
        """What the observations of one tick are; those that are `apart` are different voices and get different components and labels."""
        seen = sorted(observations, key=lambda o: o.key)
        if not seen or len({o.key for o in seen}) != len(seen):
            raise ValueError("observations of one tick need different keys")
        keys = {o.key for o in seen}
        edges = sorted({tuple(sorted(e)) for e in apart if set(e) <= keys and e[0] != e[1]})
        s = self.set

        fits: dict[str, dict[str, tuple[float, float, float]]] = {}
        for o in seen:
            known = {c: self.fit(p, o.evidence) for c, p in sorted(self.components.items()) if p.profile.items} if o.evidence.route else {}
            fits[o.key] = {**known, f"E:{o.key}": (-1.0, -s.unexplained, 1.0)} if o.evidence.route else {f"NONE:{o.key}": (-1.0, 0.0, 0.0)}
        explained = constrained({k: {c: z for c, (_, z, _) in f.items()} for k, f in fits.items()}, edges)
        component = {k: None if c.startswith("NONE:") else c for k, c in explained.items()}

        claims, heard, affinity = {}, {}, {}
        for o in seen:
            b, w = claims[o.key] = self._claimed(o, component[o.key])
            heard[o.key] = sound = self._heard(o.evidence)
            affinity[o.key] = {}
            for label, h in sound.items():
                rivals = [x.inlier for other, x in sound.items() if other != label and x.known]
                kin = self._kinship(component[o.key], label, o.evidence.route)
                bridged = w if b and b.label == label and (h.excess(s.location) > 0 or kin > 0 or not self.identities) else 0.0
                own = o.evidence.route * (h.utility + max(0.0, h.inlier - max(rivals, default=0.5)))
                affinity[o.key][label] = s.context * o.evidence.context.get(label, 0.0) + own + kin + bridged

        identity, attached = self._attach(seen, component, affinity, heard)
        support = {(g, o): Lineages(x) for g, i in self.identities.items() for o, x in i.support.items()}
        now: dict[tuple[str, str], float] = {}
        for o in seen:
            g, (b, w) = identity[o.key], claims[o.key]
            if g is None:
                continue
            if b and w > 0:
                support.setdefault((g, b.label), Lineages()).put(b.lineage, w, s.lineages)
            for label, x in affinity[o.key].items():
                now[g, label] = max(now.get((g, label), 0.0), x)
        shown = self._project({*self.identities, *filter(None, identity.values())}, {k: x.total for k, x in support.items()}, now)

        rows, fresh = {}, {}
        for o in seen:
            rows[o.key], fresh[o.key] = self._options(o, component[o.key], identity[o.key], shown, affinity[o.key], fits[o.key])
        published = constrained(rows, edges)
        decisions = tuple(self._decide(o, explained[o.key], fits[o.key], identity[o.key], shown, published[o.key], fresh[o.key], claims[o.key]) for o in seen)
        return Inference(tuple(seen), decisions, attached, shown)

    def _attach(self, seen: Sequence[Observation], component: Mapping, affinity: Mapping, heard: Mapping) -> tuple[dict, tuple]:
        """The identity of each observation: its component's, else the free one of greatest affinity to the component, else a new one."""
        of: dict[str, list[Observation]] = {}
        for o in seen:
            if component[o.key] is not None:
                of.setdefault(component[o.key], []).append(o)
        owner = {c: self.components[c].owner for c in of if c in self.components and self.components[c].owner}
        loose = sorted(set(of) - set(owner))
        free = sorted(g for g, i in self.identities.items() if len(i.parts) < self.set.parts)
        score = {}
        for c in loose:
            for g in free:
                label = self.shown.get(g)
                if label is None:
                    continue
                sure = any(heard[o.key][label].excess(self.set.location) > 0 or self._kinship(c, label, o.evidence.route) > 0 for o in of[c])
                if sure or not self.identities[g].parts:
                    score[c, g] = max(affinity[o.key].get(label, 0.0) for o in of[c])
        joined = assign(loose, free, score)
        owner |= {c: joined.get(c, "G:" + c.removeprefix("E:")) for c in loose}
        new = tuple(sorted((c, owner[c]) for c in loose if any(o.evidence.profile for o in of[c])))
        return {o.key: owner.get(component[o.key]) for o in seen}, new

    def _project(self, identities: Iterable[str], support: Mapping, now: Mapping) -> dict[str, str | None]:
        """The label that each identity shows: one to one, by support and what is heard now, behind the two gates."""
        score = {}
        rows = sorted(identities)
        for g in rows:
            mine = self.shown.get(g)
            for label in self.anchors:
                lasting, current = support.get((g, label), 0.0), now.get((g, label), 0.0)
                if mine == label:
                    idle = self.identities[g].provisional == label and lasting <= 0 and current <= 0
                    gate, bonus = (np.inf if idle else -np.inf), self.set.inertia
                else:
                    gate, bonus = (self.set.claim if mine is None else self.set.switch), 0.0
                if lasting >= gate:
                    score[g, label] = lasting + current + bonus
        got = assign(rows, sorted(self.anchors), score)
        return {g: got.get(g) for g in rows}

    def _options(self, o: Observation, component, identity, shown, affinity, fits) -> tuple[dict[str, float], float]:
        """What an observation may publish, with the worth of each; and the worth of a new label."""
        s, mapped = self.set, shown.get(identity) if identity else None
        linked = {b.label for b in o.bridges if not b.conflict and b.authority > 0}
        barred = o.excluded - linked if s.provisional else frozenset()
        new = -1000.0
        if component is not None and mapped is None and o.evidence.novelty:
            lines = Lineages(self.components[component].novelty if component in self.components else {})
            line = self._lineage(o)
            lines[line] = max(lines.get(line, 0.0), min(s.cap, s.cap * o.evidence.novelty))
            best = max((raw for c, (raw, _, _) in fits.items() if c in self.components), default=s.location)
            new = lines.total - s.claim + o.evidence.novelty * max(0.0, s.location - best) - 1e-9
        if not self.anchors:
            new = max(new, 1.0)
        if mapped is not None and mapped not in barred:
            row = {mapped: affinity[mapped]}
        else:
            taken = {label: g for g, label in self.shown.items()}
            row = {label: x - (s.claim if taken.get(label, identity) != identity else 0.0) for label, x in affinity.items() if label not in barred}
        if s.provisional and barred and not row and not linked and not o.evidence.profile:
            row[f"PROVISIONAL:{o.key}"] = 0.0
        return {**row, f"NEW:{o.key}": new}, new

    @staticmethod
    def _lineage(o: Observation) -> str:
        roots = {b.lineage for b in o.bridges}
        return roots.pop() if len(roots) == 1 else o.evidence.key

    def _decide(self, o: Observation, explained: str, fits, identity, shown, published: str, new: float, claim) -> Decision:
        component = None if explained.startswith("NONE:") else explained
        kind = "none" if component is None else "component" if component in self.components else "unexplained"
        poor = published.startswith("NEW:") and identity is None and component is None and not o.evidence.profile
        cut = published.startswith("PROVISIONAL:")
        allocation = "provisional_local_partition" if cut else "provisional_evidence_poor" if poor else "acoustic_new" if published.startswith("NEW:") else "none"
        label = published if allocation == "none" else None
        predicted, current = (shown.get(identity), self.shown.get(identity)) if identity else (None, None)
        if identity is None and allocation.startswith("provisional"):
            identity = f"G:{o.key}"
            predicted, current = shown.get(identity), self.shown.get(identity)
        bridge, support = claim
        binding = "unmatched" if predicted is None else "attach" if current is None else "retain" if current == predicted else "switch"
        learns = component is not None and identity is not None and bool(o.evidence.profile) and (bridge is None or predicted in (None, bridge.label)) and (allocation == "acoustic_new" or predicted is None or predicted == label)
        if allocation == "none":
            reason = "matched_identity" if predicted == label else "bridge" if bridge and bridge.label == label else "best_effort"
        else:
            reason = allocation if allocation != "acoustic_new" else "authority" if new > 0 and self.anchors else "startup" if not self.anchors else "structural_conflict"
        novelty = min(self.set.cap, self.set.cap * o.evidence.novelty) if component is not None else 0.0
        return Decision(o.key, identity, component, kind, label, allocation, reason, binding, o.evidence.profile * fits[explained][2] * learns, bridge, support, self._lineage(o), novelty)

    # Commit
    def _component(self, key: str) -> Component | None:
        """The component, made if need be: at capacity the one without owner and with least support goes, and if all are owned none is made."""
        if key not in self.components:
            if len(self.components) >= self.set.components:
                worth = {k: c.profile.support + c.novelty.total + sum(x.total for x in c.bridges.values()) for k, c in self.components.items() if c.owner is None}
                if not worth:
                    return None
                del self.components[min(worth, key=lambda k: (worth[k], k))]
            self.components[key] = Component(Exemplars(self.set.exemplars))
        return self.components[key]

    def _back(self, g: str, label: str, lineage: str, value: float) -> None:
        mine = self.identities.setdefault(g, Identity()).support
        mine.setdefault(label, Lineages()).put(lineage, value, self.set.lineages)
        first = self.shown.get(g)
        for o in sorted(mine, key=lambda o: (o != first, -mine[o].total, o))[self.set.challengers + 1 :]:
            del mine[o]

    def _show(self, mapping: Mapping[str, str | None]) -> None:
        self.shown, taken = {}, set()
        for g, label in sorted(mapping.items()):
            if g in self.identities and label in self.anchors and label not in taken:
                self.shown[g] = label
                taken.add(label)

    def commit(self, inference: Inference, labels: Mapping[str, str] | None = None) -> dict[str, str]:
        """Learn from an inference; labels: observation -> new label, for those that allocate one. An observation counts once."""
        todo = [d for d in inference.decisions if d.key not in self.done]
        out = {d.key: "duplicate" if d.key in self.done else "applied" for d in inference.decisions}
        evidence = {o.key: o.evidence for o in inference.observations}
        links = dict(labels or {})
        if missing := [d.key for d in todo if d.allocation != "none" and d.key not in links]:
            raise ValueError(f"no label given for {missing}")
        for d in todo:
            teaches = d.update > 0 or d.bridge is not None or d.novelty > 0
            if d.identity and (teaches or d.allocation != "none"):
                self.identities.setdefault(d.identity, Identity())
            part = self._component(d.component) if d.component and teaches else None
            if part is None:
                continue
            if d.identity and (d.component, d.identity) in inference.attached:
                held = self.identities[d.identity].parts
                if part.owner not in (None, d.identity) or (part.owner is None and len(held) >= self.set.parts):
                    raise RuntimeError("the component has another owner by now")
                part.owner = d.identity
                held.add(d.component)
            if d.novelty > 0:
                part.novelty.put(d.lineage, d.novelty, self.set.lineages)
            if d.bridge is not None:
                part.bridges.setdefault(d.bridge.label, Lineages()).put(d.bridge.lineage, d.bridge_support, self.set.lineages)
                own = self.shown.get(part.owner) if part.owner else None
                rivals = sorted((o for o in part.bridges if o != own), key=lambda o: (-part.bridges[o].total, o))
                for o in rivals[self.set.challengers :]:
                    del part.bridges[o]
                if d.identity:
                    self._back(d.identity, d.bridge.label, d.bridge.lineage, d.bridge_support)
        self._show(inference.shown)
        for d in todo:
            if d.allocation == "none":
                continue
            self.add_label(links[d.key])
            if d.allocation == "acoustic_new":
                self._back(d.identity, links[d.key], f"allocation:{d.key}", 1.0)
            else:
                self.identities[d.identity].provisional = links[d.key]
        lasting = {(g, o): x.total for g, i in self.identities.items() for o, x in i.support.items()}
        self._show(self._project(self.identities, lasting, {}))
        taken = set(self.shown.values())
        for g, i in sorted(self.identities.items()):  # provisional labels last while they are chosen or supported, and no one else has them
            chosen = any(d.identity == g and d.allocation.startswith("provisional") for d in todo)
            if i.provisional and (chosen or inference.shown.get(g) == i.provisional) and g not in self.shown and i.provisional not in taken:
                self.shown[g] = i.provisional
                taken.add(i.provisional)
        for d in todo:
            part = self.components.get(d.component) if d.component else None
            if d.update > 0 and part is not None:
                if part.owner != d.identity:
                    raise RuntimeError("the component has another owner by now")
                part.profile.admit(evidence[d.key], d.update)
        self.done |= {d.key for d in todo}
        return out
