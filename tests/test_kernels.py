"""Grammar, similarity, loop detectors, assignment and the revision ledger, against brute force and invariants."""

import itertools
import json
import random

import numpy as np
import pytest

from turnloom.functions import turns as T
from turnloom.functions import voices
from turnloom.functions.matching import assign
from turnloom.functions.turns import Turn
from turnloom.streaming.binding import Binder, Heard
from turnloom.streaming.ledger import Ledger, stable_id
from turnloom.streaming.replay import Replay, revision_ledger, shown, snapshots, stream_ledger

AT = "/root/testdata/sf0.001"


def test_grammar():
    assert T.parse("noise [0.5][S1] hello, you [1.25][1.5][G02]x[2]") == [Turn(0.5, 1.25, "S01", "hello, you"), Turn(1.5, 2.0, "S02", "x")]
    assert T.parse("") == T.parse("[1][S01]no end") == T.parse("[2][S01]early[1]") == T.parse("[1][S01]  [2]") == []
    assert [w for _, w in T.scan("[2][S01]a[1][3][S02][4][5][S03]b")] == ["ends early", "no text", "no end"]
    assert T.parse("[1][S01]a[2][S02]b[3]") == [Turn(1, 2, "S01", "a"), Turn(2, 3, "S02", "b")]  # a borrowed end
    for bad in ("[1][S00]a[2]", "[1][Sx]a[2]"):
        with pytest.raises(ValueError):
            T.parse(bad)


def test_two_parsers_agree():
    rng = random.Random(3)
    bits = ["[1.5]", "[2]", "[0.25][S01]", "[3][G4]", "[S02]", "a b", " ", "[", "7]", "对。"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert T.parse(text) == T.reparse(text), text


def test_similarity_and_loops():
    one = lambda x: Turn(0, 1, "S01", x)
    assert T.similarity(one("Hello, there"), one("hello")) == 0.5 and T.similarity(one(""), one("a")) == T.similarity(one("..."), one("a")) == 0
    assert T.repeats("start " + "ha" * 8) and not T.repeats("ha" * 7) and not T.repeats("-" * 99) and T.repeats("对。" * 9)
    assert T.only_markers("[1][S01]" * 8 + "。") and not T.only_markers("[1][S01]" * 7) and not T.only_markers("[1][S01]" * 8 + "x")
    fast = "".join(f"[{i / 10}][S0{1 + i % 2}]对。[{i / 10 + 0.1:.1f}]" for i in range(30))
    assert T.short_text_loop(fast) and not T.short_text_loop(fast.replace("对", "不同的话"))
    assert T.cut_at("A, b!", 2) == 4 and T.cut_at("", 1) == 0


def test_assignment_is_best():
    rng = random.Random(5)
    for _ in range(400):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        w = {(i, j): rng.randrange(-3, 9) for i in range(n) for j in range(m) if rng.random() < 0.7}
        got = assign(range(n), range(m), w)
        assert len(set(got.values())) == len(got)
        best = max(sum(max(0, w.get((i, j), 0)) for i, j in zip(range(n), p, strict=False)) for p in itertools.permutations([*range(m), *[-1] * n], n))
        assert sum(w[i, j] for i, j in got.items()) == best


def test_ledger_publishes_once_after_two_agreeing_snapshots():
    a, b = Turn(0, 2, "S01", "We begin now."), Turn(2.5, 5, "S02", "Something else entirely, then")
    g = Ledger()
    assert g.take(4, [a, b]) == []
    assert [t.text for t in g.take(6, [a, b])] == ["We begin now."]
    assert g.take(8, [a._replace(text="We begin now!"), b]) == []  # a late rewrite
    assert [t.text for t in g.take(10, [a, b], final=True)] == ["Something else entirely, then."]
    with pytest.raises(ValueError):
        g.take(10, [])


def test_ledger_split_silence_and_state():
    g = Ledger()
    g.take(4, [Turn(0, 3, "S01", "one two three four")])
    g.take(6, [Turn(0, 1.4, "S01", "one two"), Turn(1.5, 3, "S01", "three four")])
    assert len(g.pending) == 2 and all(len(h.seen) == 2 for h in g.pending)
    g = Ledger.load(g.dump())
    assert g.take(8, []) == [] and g.pending  # grace
    assert [t.text for t in g.take(10, [])] == ["one two.", "three four."]
    assert json.loads(g.dump())["empties"] == 2
    empty = Ledger()
    assert empty.take(2, []) == [] and empty.take(4, [Turn(0, 1, "S01", "..."), Turn(1, 1, "S01", "x")], True) == []


def _spoken(rng, n):
    at, out = 0, []
    for _ in range(n):
        words = "".join(f"{rng.choice(['alpha', 'beta', 'gamma', 'delta', 'rho', 'tau'])}{rng.randrange(999)} " for _ in range(rng.randrange(1, 40)))
        start = max(0, at + rng.randrange(-300, 3000))
        out.append((start, start + len(words) * 20, f"S0{rng.randrange(1, 4)}", words))
        at = out[-1][1]
    return sorted(out)


def test_replay_invariants():
    rng = random.Random(11)
    for _ in range(15):
        spoken, at = _spoken(rng, 30), Replay(1)
        rows = [r for t in spoken for r in at.put(t)] + list(at.end())
        turns = [Turn(*r[3:7]) for r in rows]
        assert [r[1] for r in rows] == list(range(len(rows))) and [r[2] for r in rows] == sorted(r[2] for r in rows)
        assert len({stable_id(t) for t in turns}) == len(turns) and all(t.end <= r[2] + 1e-6 for t, r in zip(turns, rows, strict=True))
        said = T.normal("".join(t.text for t in turns))
        assert len(said) >= 0.85 * len(T.normal("".join(s[3] for s in spoken)))
        assert len(at.ledger.published) < 60 and not at.ledger.pending


def test_state_survives_restart_at_any_tick():
    spoken = _spoken(random.Random(2), 12)
    stop = max(t[1] for t in spoken)
    ticks = [*range(2000, stop, 2000), stop]
    one, two, a, b = Ledger(), Ledger(), [], []
    for t in ticks:
        a += one.take(t / 1000, shown(spoken, t), t == stop)
        two = Ledger.load(two.dump())
        b += two.take(t / 1000, shown(spoken, t), t == stop)
    assert a == b


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rec, *t) for rec in range(3) for t in _spoken(rng, 5)]
    schema = "rec long, start_ms long, end_ms long, label string, text string"
    dialog = spark.createDataFrame([*rows, (9, 0, 40, None, None), (None, 0, 100, "S01", "x")], schema)
    batch = sorted(tuple(r) for r in revision_ledger(dialog).collect())
    assert {r[0] for r in batch} == {0, 1, 2}
    shots = snapshots(spark.createDataFrame(rows, schema))
    middle = 20000
    for i, part in enumerate((shots.where(f"tick_ms <= {middle}"), shots.where(f"tick_ms > {middle}"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_ledger(spark.readStream.schema(shots.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, i
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch
    assert revision_ledger(spark.createDataFrame([], schema)).count() == 0


def test_voice_evidence():
    a, b = np.array([1.0, 0.0]), np.array([0.6, 0.8])
    assert voices.view_starts(0, 1) == [0] and voices.view_starts(0, 4.5) == [0, 1.5, 3] and len(voices.view_starts(0, 99)) == 4
    assert voices.unit(None) is None and voices.unit([0, 0]) is None and voices.unit([1, None]) is None and voices.unit([]) is None
    mid, spread = voices.medoid([a, b, voices.unit([1, 0.3])])
    assert mid[1] == pytest.approx(voices.unit([1, 0.3])[1]) and spread > 0 and voices.medoid([a])[1] == pytest.approx(np.pi / 3)
    assert voices.precision(1, 3, 1.5, np.pi) == 0.5
    assert voices.profile_score([a], a, [a, b]) == pytest.approx(0.7 + 0.3 * 0.8)


def test_constrained_choice_is_best():
    rng = random.Random(9)
    for _ in range(200):
        rows = [f"r{i}" for i in range(rng.randrange(1, 5))]
        cand = {r: {f"c{j}": rng.randrange(6) for j in range(4)} for r in rows}
        apart = [p for p in itertools.combinations(rows, 2) if rng.random() < 0.5]
        fits = [dict(zip(rows, c, strict=True)) for c in itertools.product(*[sorted(cand[r]) for r in rows])]
        fits = [f for f in fits if all(f[x] != f[y] for x, y in apart)]
        assert voices.constrained(cand, apart) == min(fits, key=lambda f: (-sum(cand[r][c] for r, c in f.items()), tuple(f[r] for r in rows)))
    with pytest.raises(ValueError):
        voices.constrained({"a": {"x": 1.0}, "b": {"x": 1.0}}, [("a", "b")])


def test_binding_keeps_labels_and_follows_voices():
    x, y = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    b = Binder()
    assert b.take([Heard(0, 0, 2, "S01", x), Heard(1, 2, 4, "S02", y)]) == {0: "Speaker 1", 1: "Speaker 2"}
    assert b.take([Heard(2, 4, 6, "S02", x), Heard(3, 6, 8, "S01", y)]) == {2: "Speaker 1", 3: "Speaker 2"}  # labels swapped, voices not
    assert b.take([Heard(4, 9, 11, "S09", -x)]) == {4: "Speaker 3"} and b.take([Heard(5, 30, 30.5, "S01", None)]) == {5: "Speaker 4"}
    assert b.take([]) == {}


def test_kernel_queries(spark):
    from turnloom.operators.kernels import QUERIES

    got = {n: f(spark, AT).count() for n, f in QUERIES.items()}
    assert got["parser_agreement"] == 0
    assert got["parse_transcript"] and got["text_similarity"] and got["assignment"] and got["revision_ledger"]
    from turnloom.plans import catalog

    assert got["speaker_binding_fixed_cosine"] == catalog.view(spark, AT, "dialog").count()
