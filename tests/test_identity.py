"""Evidence, voice profiles and the identity model on hand-written cases."""

import itertools

import numpy as np
import pytest

from turnloom.functions.alignment import align, deadline_groups, lineage, resolve, revisions, tier
from turnloom.functions.turns import Turn
from turnloom.identity.evidence import Bridge, Candidate, Evidence, Exemplars, VoiceProfile, assess, bridge, union_length
from turnloom.identity.model import IdentityModel, Lineages, Observation, Settings
from turnloom.identity.registry import Registry, Seen
from turnloom.streaming.binding import CleanCoreBinder, Heard, ModelBinder, quality

rng = np.random.default_rng(3)
A, B, C = (v / np.linalg.norm(v) for v in rng.normal(size=(3, 32)))


def near(v, by=0.05):
    x = v + by * rng.normal(size=len(v)) / np.sqrt(len(v))
    return x / np.linalg.norm(x)


def heard(key, v, text="one two three four", **more):
    return assess(key, [near(v) for _ in range(4)], [(i * 1.5, i * 1.5 + 1.5) for i in range(4)], text=text, **more)


def test_views_and_permissions():
    one = assess("a", [A], [(0, 1.5)], text="one two")
    assert one.instability == pytest.approx(np.pi / 3) and one.route == pytest.approx(0.75) and one.profile > 0
    assert assess("a", [A], [(0, 0.6)], padded=True).route == pytest.approx(0.3) and assess("a", [A], [(0, 0.6)], padded=True).profile == 0
    assert assess("a", [A], [(0, 1.5)], text="one one").profile == 0 and assess("a", [A], [(0, 1.5)], mixed=True).route == 0
    assert assess("a", [], []).center is None and union_length([(0, 2), (1, 3), (5, 6)]) == 4
    with pytest.raises(ValueError):
        assess("a", [np.zeros(3)], [(0, 1)])
    assert Bridge("S01", "x", structure=0.5, row=0.4, column=0.8, authority=0.9).weight == pytest.approx(0.18)
    assert Bridge("S01", "x", conflict=True).weight == 0


def test_exemplars_keep_the_best_subset():
    p = Exemplars(3)
    for i in range(3):
        assert p.admit(heard(f"a{i}", A), 0.9) == "admitted"
    assert p.admit(heard("a0", A), 0.9) == "duplicate" and p.admit(assess("x", [], []), 1) == "inadmissible"
    assert p.admit(heard("far", B), 0.2) == "quarantined" and set(p.items) == {"a0", "a1", "a2"}
    assert p.score([A]) > 0.9 > p.score([B])
    pool = {f"k{i}": (near(A, 0.6), rng.uniform(0.3, 1), rng.uniform(0.5, 6)) for i in range(4)}
    q = Exemplars(3)
    q.items = {k: pool[k] for k in list(pool)[:3]}
    best = max(itertools.combinations(sorted(pool), 3), key=lambda ks: Exemplars.utility({k: pool[k] for k in ks}))
    e = Evidence("k3", (pool["k3"][0],), pool["k3"][0], 0.0, pool["k3"][2], 1, 1, 1)
    q.admit(e, pool["k3"][1])
    assert set(q.items) == set(best)


def test_voice_profile_states():
    v = VoiceProfile(most=2)
    make = lambda k, x, tick, seconds=2.0, text="one two three": Candidate(k, near(x), tick, seconds, text)
    v.derive([])
    assert v.state == "unseeded"
    v.derive([make("a", A, 1, 1.0)])
    assert v.state == "provisional" and not v.active and v.quarantine == ("a",)
    v.derive([make("a", A, 1), make("b", A, 2)])
    assert v.state == "established" and v.active == ("a", "b")
    v.derive([make("a", A, 1), make("b", A, 2), make("c", -A, 3)])
    assert v.active == ("a", "b") and v.reason == "established_outlier_resistance" and v.quarantine == ("c",)
    better = [make(f"d{i}", -A, 4 + i, 6.0, "one two three four five six seven eight nine") for i in range(2)]
    v.derive([make("a", A, 1), make("b", A, 2), *better])
    assert v.reason == "coherent_cohort_refresh" and v.active == ("d0", "d1")


def test_model_starts_separates_and_returns():
    m, made = IdentityModel(), {}

    def tick(*seen, apart=()):
        plan = m.infer(seen, apart)
        labels = {d.key: f"S{len(made) + i + 1:02d}" for i, d in enumerate([d for d in plan.decisions if d.label is None])}
        made.update(labels)
        m.commit(plan, labels)
        return {d.key: (d.label or labels[d.key], d.reason, d.binding) for d in plan.decisions}, plan

    got, plan = tick(Observation("t1", heard("t1", A)))
    assert got["t1"][:2] == ("S01", "startup") and m.shown == {"G:t1": "S01"}
    assert m.commit(plan, {"t1": "S01"}) == {"t1": "duplicate"}
    got, _ = tick(Observation("t2", heard("t2", B)), Observation("t3", heard("t3", A)), apart=[("t2", "t3")])
    assert got["t3"] == ("S01", "matched_identity", "retain") and got["t2"][0] == "S02"
    got, _ = tick(Observation("t4", heard("t4", B)))
    assert got["t4"][0] == "S02" and got["t4"][1] == "matched_identity"
    before = (dict(m.shown), m.state_bytes())
    m.infer([Observation("t5", heard("t5", C))])  # pure
    assert (dict(m.shown), m.state_bytes()) == before
    with pytest.raises(ValueError):
        m.infer([Observation("x", heard("x", A)), Observation("x", heard("x", B))])
    plan = m.infer([Observation("t6", heard("t6", C)), Observation("t7", heard("t7", A)), Observation("t8", heard("t8", B))], [("t6", "t7"), ("t6", "t8"), ("t7", "t8")])
    assert next(d for d in plan.decisions if d.key == "t6").label is None
    with pytest.raises(ValueError):
        m.commit(plan)


def test_display_gates():
    s = Settings()
    assert (s.claim, s.switch) == (pytest.approx(0.775), pytest.approx(1.275))
    m = IdentityModel()
    for label in ("S01", "S02"):
        m.add_label(label)
    for total, shown in ((0.55, None), (0.775, "S01"), (1.2, "S01")):
        m.identities.clear()
        m.shown = {}
        m._back("G:x", "S01", "one", total)
        assert m._project(m.identities, {("G:x", "S01"): total}, {})["G:x"] == shown
    m.shown = {"G:x": "S02"}
    assert m._project(m.identities, {("G:x", "S01"): 1.274}, {})["G:x"] is None
    assert m._project(m.identities, {("G:x", "S01"): 1.275}, {})["G:x"] == "S01"
    assert m._project(m.identities, {("G:x", "S01"): 1.2, ("G:x", "S02"): 0.1}, {})["G:x"] == "S02"
    lines = Lineages()
    for k, x in (("a", 0.1), ("b", 0.3), ("a", 0.05), ("c", 0.2), ("d", 0.4), ("e", 0.5)):
        lines.put(k, x, 4)
    assert lines == {"b": 0.3, "c": 0.2, "d": 0.4, "e": 0.5}


def test_component_capacity_evicts_the_least_supported():
    m = IdentityModel(Settings(components=2))
    m._component("E:a").novelty.put("x", 0.5, 4)
    m._component("E:b")
    assert m._component("E:c") and set(m.components) == {"E:a", "E:c"}
    for c in m.components.values():
        c.owner = "G"
    assert m._component("E:d") is None


def test_binder_follows_voices_not_local_labels():
    b = ModelBinder()
    out = {}
    for i in range(8):  # the decoder swaps its labels in every other tick
        first, second = ("S01", "S02") if i % 2 == 0 else ("S02", "S01")
        out |= b.take([Heard(2 * i, 10 * i, 10 * i + 4, first, near(A), text="one two three"), Heard(2 * i + 1, 10 * i + 5, 10 * i + 9, second, near(B), text="four five six")])
    assert len({out[2 * i] for i in range(8)}) == 1 and len({out[2 * i + 1] for i in range(8)}) == 1 and out[0] != out[1]
    assert b.take([]) == {} and quality(Heard(0, 1, 1, "x", None), []) == 0
    x, y = Heard(0, 0, 4, "a", None), Heard(1, 3, 9, "b", None)
    assert quality(x, [x, y]) == pytest.approx(0.75)
    assert set(ModelBinder().take([Heard(1, 0, 1, "S01", None), Heard(2, 0.5, 2, "S02", None)]).values()) == {"S01", "S02"}  # no voices: apart, so two labels


def test_alignment():
    now = [Turn(0, 4, "S01", "good morning"), Turn(5, 9, "S02", "thank you all")]
    then = [Turn(0, 4, "anna", "good morning"), Turn(5, 8, "ben", "thank you")]
    got = align(now, then)
    assert (got["S01"].selected, got["S02"].selected) == ("anna", "ben") and got["S01"].row_unique and got["S01"].column_unique
    assert got["S01"].scores["anna"] == pytest.approx(4 * (0.55 + 0.25 + 0.2))
    tied = align([Turn(0, 4, "S01", "x")], [Turn(0, 4, "anna", "x"), Turn(0, 4, "ben", "x")])["S01"]
    assert tied.best is None and tied.selected is None and not tied.row_unique
    assert align(now, []) == {} and align([Turn(0, 0.05, "S01", "x")], then) == {}
    assert lineage("S01", "anna", now, {"k": then[0], "l": then[1]}) == "k"
    assert lineage("S01", "anna", now, {"k": then[0], "l": then[0]}) is None
    e = heard("k", A)
    link = bridge("anna", got["S01"].scores, (got["S01"].row_margin, got["S01"].column_margin), (True, True), True, "k", e)
    assert link.weight > 0 and bridge("anna", got["S01"].scores, (0.0, 1.0), (False, True), True, "k", e).weight == 0 and bridge(None, {}, (0, 0), (False, False), False, None, e) is None


def test_revisions_and_deadlines():
    p = {"p": Turn(0, 4, "S01", "the quick brown fox"), "q": Turn(9, 12, "S01", "another thing here")}
    assert revisions({"a": Turn(0, 4.1, "S02", "the quick brown foxes")}, p) == {"a": "p"}
    assert revisions({"a": Turn(0, 4, "S01", "the quick brown fox"), "b": Turn(0, 4, "S01", "the quick brown fox")}, p) == {}
    tracks = {"x": [(1, Turn(0, 4, "", ""))], "y": [(1, Turn(9, 10, "", ""))], "z": [(2, Turn(3, 5, "", ""))], "w": [(5, Turn(20, 21, "", ""))]}
    assert deadline_groups(tracks) == [["w"], ["x", "y", "z"]]
    assert tier(0.8, [3], True, 1)[2] == "fused" and tier(0.8, [], True, 1)[0] == pytest.approx(4.8) and tier(None, [1], False, None)[0] == pytest.approx(3.5)
    assert tier(None, [], True, 1) == (2.5, 0.5, "local_continuity") and tier(None, [], False, 1)[0] == pytest.approx(1.5) and tier(None, [], False, None)[2] == "registry_prior"
    names = iter(["S02", "S03", "S04"])
    got = resolve(tracks, ["S01"], lambda t, o: tier(0.9 if (t, o) == ("x", "S01") else None, [], False, None), lambda: next(names))
    assert got["x"] == ("S01", "acoustic") and len({got[t][0] for t in "xyz"}) == 3 and got["w"][0] in {"S01", "S02", "S03"}


def test_registry_moves_are_all_or_nothing():
    r = Registry()
    a, b = r.new_track(), r.new_track()
    see = lambda k, rev=1, x=A, s=0.0: Seen(k, rev, "L", s, s + 2.0, float(rev), near(x), 1.0, "one two three")
    for k in "pqr":
        assert r.observe(see(k), a.name)
    assert not r.observe(see("p"), b.name) and r.observe(see("p", 2), b.name) and r.owner("p") == b.name
    assert a.support == 2.0 and set(a.evidence) == {"q", "r"}
    r.published.add("q")
    assert r.move(a.name, b.name) == () and set(a.evidence) == {"q", "r"}
    assert r.move(a.name, b.name, ["r", "zz"]) == () and r.move(a.name, b.name, ["r"]) == ("r",)
    assert not r.discard(a.name) and r.replace("r", see("r2", 3)) and r.owner("r2") == b.name and r.owner("r") is None and not r.replace("q", see("s"))
    assert r.new_label(b.name) == "S01" == r.new_label(b.name) and r.labels == ["S01"] and not r.discard(b.name)
    c = r.new_track()
    r.observe(see("t"), c.name)
    assert r.discard(c.name) and c.name not in r.tracks
    assert [x.sequence for x in r.ledger] == list(range(len(r.ledger))) and {x.event for x in r.ledger} == {"observed", "revised", "moved", "discarded"}


def test_clean_core_names_established_voices_and_decides_at_the_deadline():
    b, out = CleanCoreBinder(), {}
    for i in range(6):
        out |= b.take([Heard(2 * i, 10 * i, 10 * i + 4, "S01", near(A), text="one two three"), Heard(2 * i + 1, 10 * i + 5, 10 * i + 9, "S02", near(B), text="four five six")])
    out |= b.end()
    assert set(out) == set(range(12)) and len({out[2 * i] for i in range(6)}) == 1 and len({out[2 * i + 1] for i in range(6)}) == 1 and out[0] != out[1]
    short = CleanCoreBinder()
    assert short.take([Heard(1, 0, 0.5, "S01", None)]) == {} and short.take([]) == {1: "S01"}
