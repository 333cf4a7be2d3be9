"""The model's tables, derived from the driver's: one definition each for Spark SQL and for the SQL oracle.

turns (rec, id, start, end, speaker, text): rec is the calendar day, times are seconds from its start. dialog: conversations with times from
cumulative text length in whole milliseconds. snapshots: what a window of 60 s, moved on by 2 s, shows of the dialog, clipped to it.
voices (id, label, v). texts (id, text). revised: snapshots with the noise of a decoder. published: the ledger. units, centroids, affinity,
weighed, exemplars and angles: unit vectors, their labels' centres, evidence, and profiles of five vectors a label."""

from __future__ import annotations

STEP_MS, CONTEXT_MS, RIGHT_MS, CHAR_MS = 2000, 60000, 2000, 20

_DIALOG = """SELECT rec, turn, label, text, start_ms, start_ms + n * {c} AS end_ms FROM (
 SELECT conv_id AS rec, turn, CASE role WHEN 'user' THEN 'S01' WHEN 'assistant' THEN 'S02' ELSE 'S03' END AS label, text, CAST(length(text) AS bigint) AS n,
  CAST(coalesce(sum(CAST(length(text) AS bigint)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) * {c} AS start_ms
 FROM $conversations) d""".format(c=CHAR_MS)

SPARK = {
    "turns": """SELECT CAST(CAST(ts AS date) AS string) AS rec, event_id AS id, pmod(unix_micros(CAST(ts AS timestamp)), 86400000000) / 1e6D AS start,
 pmod(unix_micros(CAST(ts AS timestamp)), 86400000000) / 1e6D + value AS `end`, event_type AS speaker, props AS text, user_id FROM $events""",
    "dialog": _DIALOG,
    "ticks": f"""SELECT rec, stop_ms, k * {STEP_MS} AS tick_ms FROM (SELECT rec, max(end_ms) AS stop_ms FROM $dialog GROUP BY rec) r
 LATERAL VIEW explode(sequence(1L, greatest(1L, CAST(ceil(stop_ms / {STEP_MS}.0D) AS bigint)))) e AS k""",
    "voices": "SELECT vec_id AS id, label, transform(embedding, x -> CAST(x AS double)) AS v FROM $embeddings",
}
DUCK = {
    "turns": """SELECT CAST(CAST(ts AS date) AS varchar) AS rec, event_id AS id, (epoch_us(ts) % 86400000000) / 1e6::double AS start,
 (epoch_us(ts) % 86400000000) / 1e6::double + value AS "end", event_type AS speaker, props AS text, user_id FROM $events""",
    "dialog": _DIALOG,
    "ticks": f"""SELECT rec, stop_ms, k * {STEP_MS} AS tick_ms FROM (SELECT rec, max(end_ms) AS stop_ms FROM $dialog GROUP BY rec) r,
 unnest(generate_series(1::bigint, greatest(1::bigint, CAST(ceil(stop_ms / {STEP_MS}.0::double) AS bigint)))) e(k)""",
    "voices": "SELECT vec_id AS id, label, CAST(embedding AS double[]) AS v FROM $embeddings",
}
_COMMON = {
    "texts": "SELECT doc_id AS id, text FROM $documents",
    "windows": f"SELECT rec, least(tick_ms, stop_ms) AS tick_ms, greatest(0, least(tick_ms, stop_ms) - {CONTEXT_MS}) AS from_ms, stop_ms FROM $ticks",
    "snapshots": """SELECT w.rec, w.tick_ms, w.stop_ms, d.turn, d.label, greatest(d.start_ms, w.from_ms) AS start_ms, least(d.end_ms, w.tick_ms) AS end_ms, d.end_ms <= w.tick_ms AS whole, d.text
 FROM $windows w JOIN $dialog d ON w.rec = d.rec AND d.start_ms < w.tick_ms AND d.end_ms > w.from_ms""",
}
# What a rolling decoder shows: in every fifth tick it numbers the first two voices the other way round, and a turn's text is cut with it.
_COMMON["revised"] = f"""SELECT w.rec, w.tick_ms, w.stop_ms, w.from_ms, d.turn, d.label,
 CASE WHEN (d.rec + @DIV(w.tick_ms, {STEP_MS})) % 5 = 0 AND d.label = 'S01' THEN 'S02' WHEN (d.rec + @DIV(w.tick_ms, {STEP_MS})) % 5 = 0 AND d.label = 'S02' THEN 'S01' ELSE d.label END AS local,
 greatest(d.start_ms, w.from_ms) AS start_ms, least(d.end_ms, w.tick_ms) AS end_ms, d.end_ms <= w.tick_ms AS whole,
 substring(d.text, CAST(1 + @DIV(greatest(0, w.from_ms - d.start_ms), {CHAR_MS}) AS int), CAST(@DIV(least(d.end_ms, w.tick_ms) - greatest(d.start_ms, w.from_ms), {CHAR_MS}) AS int)) AS text
 FROM $windows w JOIN $dialog d ON w.rec = d.rec AND d.start_ms < w.tick_ms AND d.end_ms > w.from_ms"""
# A turn is released at the first tick that shows it whole and behind the frontier; seq is the order of release.
_COMMON["published"] = f"""SELECT *, row_number() OVER (PARTITION BY rec ORDER BY seen_ms, start_ms, turn) AS seq FROM (
 SELECT rec, turn, label, text, min(start_ms) AS start_ms, end_ms, min(tick_ms) AS seen_ms FROM $snapshots WHERE whole AND (end_ms <= tick_ms - {RIGHT_MS} OR tick_ms = stop_ms) GROUP BY rec, turn, label, text, end_ms) f"""
_COMMON["units"] = "SELECT id, label, @UNIT(v, n) AS u FROM (SELECT id, label, v, @NORM(v) AS n FROM $voices) w WHERE n > 0"
_COMMON["centroids"] = "SELECT label, n, @UNIT(m, @NORM(m)) AS c FROM (SELECT label, max(n) AS n, @VECTOR(d, x) AS m FROM (SELECT label, d, avg(x) AS x, count(*) AS n FROM $parts GROUP BY label, d) a GROUP BY label) b"
_COMMON["affinity"] = "SELECT e.id, e.label AS own, c.label, @DOT(e.u, c.c) AS cosine FROM $units e JOIN $centroids c ON @SIZE(e.u) = @SIZE(c.c)"
# Evidence of a vector: how clean it is, seconds that it covers, angle by which its views differ, and the weight it has for its own label.
_COMMON["evidence"] = """SELECT u.id, u.label, u.u, CASE WHEN u.id % 7 = 0 THEN 0.8 ELSE 1.0 END * 1.0E0 AS purity, (1 + u.id % 4) * 0.75E0 AS coverage, (u.id % 5) * 0.1E0 AS instability,
 1 / (1 + exp(-(a.cosine - 0.45) / 0.12)) AS inlier FROM $units u JOIN $affinity a ON u.id = a.id AND a.own = a.label"""
_COMMON["weighed"] = "SELECT *, purity * least(1, coverage / 1.5) / (1 + instability / pi()) AS precision_route, purity * least(1, coverage / 1.5) / (1 + instability / pi()) * inlier AS weight FROM $evidence"
# A profile: the five heaviest vectors of a label.
_COMMON["exemplars"] = "SELECT id, label, u, weight, coverage, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(weight, 9) DESC, id) AS place FROM $weighed) w WHERE place <= 5"
_COMMON["angles"] = """SELECT a.label, a.id, b.id AS other, greatest(-1, least(1, @DOT(a.u, b.u))) AS cosine, CASE WHEN a.id = b.id THEN 0 ELSE acos(greatest(-1, least(1, @DOT(a.u, b.u)))) END AS angle
 FROM $exemplars a JOIN $exemplars b ON a.label = b.label"""
SPARK["parts"] = "SELECT id, label, d, x FROM $units LATERAL VIEW posexplode(u) e AS d, x"
DUCK["parts"] = "SELECT id, label, unnest(range(len(u))) AS d, unnest(u) AS x FROM $units"
SPARK |= _COMMON
DUCK |= _COMMON
# Spark meets windows and turns by bins as long as a window, once, in the bin where the later of the two begins: by recording alone a long
# one would compare all its windows with all its turns, in one task.
_MET = f"""(SELECT /*+ REPARTITION(#SHARDS, rec, b) */ rec, tick_ms, from_ms, stop_ms, b FROM $windows LATERAL VIEW explode(sequence(from_ms div {CONTEXT_MS}, greatest(from_ms, tick_ms - 1) div {CONTEXT_MS})) e AS b) w
 JOIN (SELECT /*+ REPARTITION(#SHARDS, rec, b) */ rec, turn, label, text, start_ms, end_ms, b FROM $dialog LATERAL VIEW explode(sequence(start_ms div {CONTEXT_MS}, greatest(start_ms, end_ms - 1) div {CONTEXT_MS})) e AS b) d
 ON w.rec = d.rec AND w.b = d.b AND d.start_ms < w.tick_ms AND d.end_ms > w.from_ms AND w.b = greatest(d.start_ms, w.from_ms) div {CONTEXT_MS}"""
for _name in ("snapshots", "revised"):
    SPARK[_name] = _COMMON[_name].replace("$windows w JOIN $dialog d ON w.rec = d.rec AND d.start_ms < w.tick_ms AND d.end_ms > w.from_ms", _MET)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# What the ticks show, once for all ticks that show the same of a turn: tick_ms is a list. Groups are made before rows are dealt by number.
SPARK["revised_once"] = """SELECT /*+ REPARTITION(#SHARDS, rec, turn) */ * FROM (
 SELECT rec, turn, start_ms, end_ms, text, collect_list(tick_ms) AS tick_ms FROM $revised GROUP BY rec, turn, start_ms, end_ms, text) g"""
