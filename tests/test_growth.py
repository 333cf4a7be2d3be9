"""Steps that grew faster than their input, or held more of it than they need."""

import random
import re
from difflib import SequenceMatcher

import pytest
from turnloom.functions import alignment
from turnloom.functions import turns as T
from turnloom.functions.turns import Turn
from turnloom.plans import catalog

AT = "/root/testdata/sf0.001"


def test_ratio_is_that_of_sequence_matcher():
    r = random.Random(5)
    for size in [12] * 300 + [40] * 100 + [260] * 30:
        k = r.choice([2, 4, 26, 120])
        a, b = ("".join(chr(97 + min(r.randrange(k), r.randrange(k))) for _ in range(r.randrange(size + 1))) for _ in range(2))
        b = r.choice([b, a[: len(a) // 2] + b, a[3:] + "z" + a[:3]])
        for junk in (True, False):
            assert T.ratio(a, b, junk) == SequenceMatcher(None, a, b, junk).ratio()


def test_caches_hold_a_window_and_not_a_recording():
    assert T.normal.cache_info().maxsize <= 4096 and T._similar.cache_info().maxsize <= 4096
    assert T.normal("Straße, ЁЖ « 漢 » $5 x") == "strasseёж漢5x"


def test_times_are_compared_before_texts(monkeypatch):
    monkeypatch.setattr(alignment, "similarity", lambda *_: pytest.fail("texts were compared"))
    a = Turn(0, 10, "", "one two three four")
    assert alignment.revision(a, Turn(8, 18, "", "one two three five")) is None
    assert alignment.revision(a, Turn(0, 10, "", "one two three four and many more")) is None


def _exchanges(df):
    return re.findall(r"REPARTITION_BY_NUM", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("name", ["revision_ledger", "published_speakers", "pending_revision_match", "snapshot_duplicates", "speaker_binding_clean_core", "publication_terminal"])
def test_slow_rows_are_dealt_by_number(spark, name):
    assert _exchanges(catalog.queries()[name](spark, AT))


def test_windows_meet_turns_by_bin(spark, tmp_path):
    """A long recording with turns over several windows, one without text and one on the border of a bin."""
    rows = [(1, i, "user" if i % 2 else "assistant", "x" * n) for i, n in enumerate([2999, 1, 0, 3000, 9000, 17, 2983, 400])] + [(2, 0, "user", ""), (3, 0, None, "abc"), (4, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    w, d = (catalog.view(spark, str(tmp_path), n) for n in ("windows", "dialog"))
    spoken = d.collect()
    want = sorted((x.rec, x.tick_ms, y.turn) for x in w.collect() for y in spoken if x.rec == y.rec and y.end_ms is not None and y.start_ms < x.tick_ms and y.end_ms > x.from_ms)
    for name in ("snapshots", "revised"):
        got = catalog.view(spark, str(tmp_path), name)
        assert sorted((r.rec, r.tick_ms, r.turn) for r in got.collect()) == want
        assert ".b" in got._jdf.queryExecution().analyzed().toString() or "b#" in got._jdf.queryExecution().analyzed().toString()


def test_only_ends_of_texts_go_to_python(spark, tmp_path, monkeypatch):
    from turnloom.operators import kernels

    gap = " \t　 \x1c\x85" * 900
    texts = ["", None, "ha " * 16, "word " * 3000 + "no end", "a" * 3000 + "!", "x" * 900 + gap + "ho" * 8, gap + "b" * 5, "ab" + gap + "cd" * 7 + gap + "cd", "é" * 1500 + " " + "q1" * 8]
    spark.createDataFrame([(4 * i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = kernels.repetition_loop(spark, str(tmp_path))
    assert sorted(r.id for r in got.collect()) == [4 * i + 1 for i, t in enumerate(texts) if T.repeats(t or "")]
    assert "right" in got._jdf.queryExecution().analyzed().toString().lower()


def test_a_text_that_many_ticks_show_is_read_once(spark):
    shown = catalog.view(spark, AT, "revised")
    once = catalog.view(spark, AT, "revised_once")
    assert once.count() < shown.count() / 2
    for name in catalog.ONCE:
        got = catalog.queries()[name](spark, AT)
        assert "collect_list" in got._jdf.queryExecution().analyzed().toString()
        plain = spark.sql(catalog._resolver(spark, AT)(catalog.expand(catalog.ENTRIES[name][0], 0)))
        assert got.schema == plain.schema or got.dtypes == plain.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def _both(spark, at, name):
    """Rows by the query's own plan, and by the text of its entry."""
    got = catalog.queries()[name](spark, at)
    plain = spark.sql(catalog._resolver(spark, at)(catalog.expand(catalog.ENTRIES[name][0], 0)))
    assert got.dtypes == plain.dtypes
    return got, sorted(map(str, got.collect())), sorted(map(str, plain.collect()))


def test_cosines_by_blocks_are_those_of_the_text(spark, tmp_path, monkeypatch):
    from turnloom.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 7)
    r = random.Random(4)
    rows = [(i % 40 if i > 44 else i, [r.gauss(0, 1) for _ in range(5)], i % 3) for i in range(50)]
    rows += [(90, [1.0, 2.0], 0), (91, None, 0), (92, [0.0] * 5, 0), (93, [1.0, None, 0.0, 0.0, 0.0], 1), (94, [float("nan")] * 5, 1), (95, [1.0] * 5, None), (None, [1.0] * 5, 2), (97, [1.0] * 5, 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, a, b = _both(spark, str(tmp_path), "cosine_pairs")
    assert a == b and len(a) > 300
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["cannot_link_edges", "overlap_exclusions"])
def test_overlaps_without_pairs_are_those_of_the_text(spark, tmp_path, name):
    r = random.Random(6)
    day = "2024-01-0"
    rows = [(i if i < 190 else i - 100, f"{day}{1 + i % 2} 00:{r.randrange(6):02d}:{r.randrange(60):02d}", 1, r.choice("abc"), float(r.choice([0, 1, 5, 30, 200, -3]))) for i in range(200)]
    rows += [(300, f"{day}1 00:01:00", 1, None, 9.0), (301, f"{day}1 00:01:00", 1, "a", None), (None, f"{day}1 00:01:00", 1, "a", 9.0), (302, None, 1, "a", 9.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "'' as props")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got, a, b = _both(spark, str(tmp_path), name)
    assert a == b and a
    if name == "cannot_link_edges":  # pairs of sole ids go through no exchange
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.splitlines()[0].startswith("Union")
