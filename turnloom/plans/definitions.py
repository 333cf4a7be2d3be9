"""The catalogue's entries, by layer. Overlap joins are bucketed: a turn is entered in each 60 s bin that it touches, pairs meet on
(rec, bin), and count only in the bin where the later of the two begins, so no pair is found twice."""

from .catalog import query as q

BINS = """SELECT t.*, b FROM $turns t LATERAL VIEW explode(sequence(CAST(floor(start / 60) AS bigint), CAST(floor(`end` / 60) AS bigint))) e AS b"""
PAIRS = f"""SELECT l.rec, l.id AS l_id, r.id AS r_id, l.speaker AS l_speaker, r.speaker AS r_speaker, l.start AS l_start, l.`end` AS l_end, r.start AS r_start, r.`end` AS r_end
 FROM ({BINS}) l JOIN ({BINS}) r ON l.rec = r.rec AND l.b = r.b AND l.id <> r.id AND l.start < r.`end` AND r.start < l.`end` AND l.b = CAST(floor(greatest(l.start, r.start) / 60) AS bigint)"""
DPAIRS = """SELECT l.rec, l.id AS l_id, r.id AS r_id, l.speaker AS l_speaker, r.speaker AS r_speaker, l.start AS l_start, l."end" AS l_end, r.start AS r_start, r."end" AS r_end
 FROM $turns l JOIN $turns r ON l.rec = r.rec AND l.id <> r.id AND l.start < r."end" AND r.start < l."end" """


def both(name: str, text: str) -> None:
    """An entry over the overlapping pairs: bucketed for Spark, plain for the oracle. `end` is quoted for each."""
    q(name, text.replace("#PAIRS", f"({PAIRS})").replace("#END", "`end`"), text.replace("#PAIRS", f"({DPAIRS})").replace("#END", '"end"'))


# Intervals
OVER = "least(l_end, r_end) - greatest(l_start, r_start)"
both("overlap_pairs", f"SELECT rec, l_id, r_id, round({OVER}, 6) AS seconds FROM #PAIRS p WHERE l_id < r_id AND l_speaker <> r_speaker")
both("interval_iou", f"SELECT l_id, r_id, round(({OVER}) / (greatest(l_end, r_end) - least(l_start, r_start)), 6) AS iou FROM #PAIRS p WHERE l_id < r_id")
both("cannot_link_edges", "SELECT DISTINCT rec, least(l_id, r_id) AS a, greatest(l_id, r_id) AS b FROM #PAIRS p WHERE l_speaker <> r_speaker")
both("containment_split", "SELECT l_id AS parent, @BIG(count(*)) AS children FROM #PAIRS p WHERE r_start >= l_start AND r_end <= l_end AND l_speaker = r_speaker GROUP BY l_id HAVING count(*) >= 2")
both("containment_merge", "SELECT r_id AS child, @BIG(count(*)) AS parents FROM #PAIRS p WHERE r_start >= l_start AND r_end <= l_end GROUP BY r_id HAVING count(*) >= 2")
both("overlap_exclusions", "SELECT l_id AS id, @BIG(count(DISTINCT r_speaker)) AS excluded, min(r_speaker) AS first_excluded FROM #PAIRS p WHERE l_speaker <> r_speaker GROUP BY l_id")
both("material_successor", "SELECT DISTINCT l_id AS id FROM #PAIRS p WHERE r_start > l_start + 0.25 AND r_end >= l_end - 0.25 AND l_speaker <> r_speaker")
both("clean_span", """SELECT id, round(span_start, 6) AS span_start, round(span_end, 6) AS span_end FROM (
 SELECT id, gap_start AS span_start, gap_end AS span_end, row_number() OVER (PARTITION BY id ORDER BY round(gap_end - gap_start, 6) DESC, gap_start) AS r FROM (
  SELECT id, s AS gap_start, coalesce(lead(lo) OVER (PARTITION BY id ORDER BY lo), hi_limit) AS gap_end FROM (
   SELECT id, lo, greatest(max(hi) OVER (PARTITION BY id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lo) AS s, hi_limit FROM (
    SELECT id, start AS lo, start AS hi, #END AS hi_limit FROM $turns
    UNION ALL SELECT l_id, greatest(l_start, r_start), least(l_end, r_end), l_end FROM #PAIRS p WHERE l_speaker <> r_speaker) x) y) z
 WHERE gap_end - gap_start >= 0.4) g WHERE r = 1""")
ISLANDS = """SELECT rec, speaker, isle, min(start) AS s, max(#END) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY rec, speaker ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS isle FROM (
 SELECT *, CASE WHEN start <= max(#END) OVER (PARTITION BY rec, speaker ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM $turns) a) b GROUP BY rec, speaker, isle"""
both("coverage_union", f"SELECT rec, speaker, @BIG(count(*)) AS islands, round(sum(e - s), 6) AS seconds FROM ({ISLANDS}) i GROUP BY rec, speaker")
both("acoustic_bins", "SELECT id, @BIG(floor(start / 0.1 + 0.5)) AS bin_start, @BIG(floor(#END / 0.1 + 0.5)) AS bin_end FROM $turns")
both("turn_duration", "SELECT id, round(greatest(0, #END - start), 6) AS seconds FROM $turns")
both("valid_turns", "SELECT id FROM $turns WHERE start >= 0 AND #END >= start AND trim(speaker) <> ''")
both("active_at", "SELECT rec, id FROM $turns WHERE start <= 43200 AND #END > 43200")
both("timeline", "SELECT rec, id, @BIG(row_number() OVER (PARTITION BY rec ORDER BY start, #END, speaker, text, id)) AS place FROM $turns")
both("newest_first", "SELECT rec, id, @BIG(row_number() OVER (PARTITION BY rec ORDER BY start DESC, id)) AS place FROM $turns")
both("containing_range_read", "SELECT id, round(greatest(start, 3600), 6) AS s, round(least(#END, 7200), 6) AS e FROM $turns WHERE start < 7200 AND #END > 3600")
both("stable_frontier_batch", "SELECT rec, id, round(max(#END) OVER (PARTITION BY rec ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS published_until FROM $turns")
both("frontier_backtrack", """SELECT rec, @BIG(count(*)) AS backtracks, round(max(f - #END), 6) AS worst FROM (SELECT *, max(#END) OVER (PARTITION BY rec ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM $turns) t
 WHERE #END < f GROUP BY rec""")
both("near_span_rewrite", "SELECT l_id, r_id FROM #PAIRS p WHERE l_id < r_id AND abs(l_start - r_start) <= 0.25 AND abs(l_end - r_end) <= 0.25 AND least(l_end - l_start, r_end - r_start) >= 0.65 * greatest(l_end - l_start, r_end - r_start)")
both("short_tail", """SELECT l_id, r_id FROM #PAIRS p WHERE l_speaker <> r_speaker AND l_end - l_start <= 0.75 AND r_end - r_start >= 3 AND r_end - l_end >= 2 AND (least(l_end, r_end) - greatest(l_start, r_start)) <= 0.25 * (r_end - r_start)""")
both("lane_union", "SELECT rec, speaker, @BIG(dense_rank() OVER (PARTITION BY rec ORDER BY first_start, speaker)) AS lane FROM (SELECT rec, speaker, min(start) AS first_start FROM $turns GROUP BY rec, speaker) t")
both("speaker_legend", "SELECT rec, speaker, round(min(start), 6) AS first_release, @BIG(count(*)) AS turns FROM $turns GROUP BY rec, speaker")
both("latency_percentiles", "SELECT rec, round(@PCT(#END - start, 0.5), 6) AS p50, round(@PCT(#END - start, 0.95), 6) AS p95, round(max(#END - start), 6) AS worst FROM $turns GROUP BY rec")
both("stage_profile", "SELECT speaker AS stage, round(sum(#END - start), 6) AS total, round(sum(#END - start) / (SELECT sum(#END - start) FROM $turns), 9) AS share FROM $turns GROUP BY speaker")
both("mode_confidence", "SELECT speaker AS mode, @BIG(count(*)) AS n, round(min(#END - start), 6) AS low, round(avg(#END - start), 6) AS mean, round(max(#END - start), 6) AS high FROM $turns GROUP BY speaker")
both("ordered_evidence", "SELECT rec, id, @BIG(row_number() OVER (PARTITION BY rec ORDER BY #END, start, id)) AS place FROM $turns")
both("context_confidence", "SELECT id, round(greatest(0, #END - start) / (1 + greatest(0, #END - start)), 6) AS confidence, round(least(1, greatest(0, (#END - start) / 100)), 6) AS clamped, round(1 / (1 + exp(-(#END - start - 50) / 10)), 6) AS inlier FROM $turns")
both("bounded_fraction", "SELECT id, round(least(1, greatest(0, #END - start - 5) / greatest(abs(start), 1e-12)), 6) AS fraction FROM $turns")
both("publication_age", "SELECT id, round(ceil(#END / 2) * 2 - #END, 6) AS age FROM $turns")
# Window schedule and ledger, over the dialog's snapshots
q("tick_schedule", "SELECT rec, tick_ms, from_ms FROM $windows")
q("window_membership", "SELECT rec, tick_ms, @BIG(count(*)) AS turns, @BIG(sum(end_ms - start_ms)) AS visible_ms FROM $snapshots GROUP BY rec, tick_ms")
q("stable_frontier", "SELECT rec, tick_ms, CASE WHEN tick_ms = stop_ms THEN tick_ms ELSE greatest(0, tick_ms - 2000) END AS frontier_ms FROM $windows")
FIRST = "SELECT rec, turn, label, text, end_ms, min(tick_ms) AS seen_ms FROM $snapshots WHERE whole AND (end_ms <= tick_ms - 2000 OR tick_ms = stop_ms) GROUP BY rec, turn, label, text, end_ms"
q("published_ledger", f"SELECT rec, turn, label, end_ms, seen_ms, seen_ms - end_ms AS lag_ms FROM ({FIRST}) f")
q("published_frontier", f"SELECT rec, seen_ms, max(max(end_ms)) OVER (PARTITION BY rec ORDER BY seen_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS published_until FROM ({FIRST}) f GROUP BY rec, seen_ms")
q("replay_audit", f"SELECT rec, count(*) = count(DISTINCT turn) AND min(seen_ms - end_ms) >= 0 AS passed, @BIG(count(*)) AS published FROM ({FIRST}) f GROUP BY rec")
q("latest_per_id", "SELECT rec, turn, tick_ms, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY rec, turn ORDER BY tick_ms DESC) AS r FROM $snapshots) s WHERE r = 1")
q("whole_segment_gate", "SELECT rec, tick_ms, turn FROM $snapshots WHERE end_ms <= tick_ms - 2000")
q("window_containment", "SELECT @BIG(count(*)) AS violations FROM $snapshots s WHERE start_ms < tick_ms - 60001 OR end_ms > tick_ms + 1")
q("monotonic_guard", "SELECT @BIG(count(*)) AS violations FROM (SELECT tick_ms, lag(tick_ms) OVER (PARTITION BY rec ORDER BY tick_ms) AS was FROM $windows) w WHERE was >= tick_ms")
q("provisional_tail", f"SELECT s.rec, s.tick_ms, @BIG(count(*)) AS provisional FROM $snapshots s LEFT JOIN ({FIRST}) f ON s.rec = f.rec AND s.turn = f.turn AND f.seen_ms <= s.tick_ms WHERE f.rec IS NULL GROUP BY s.rec, s.tick_ms")
q("sentence_of_lanes", "SELECT rec, label, @BIG(dense_rank() OVER (PARTITION BY rec ORDER BY s, label)) AS lane FROM (SELECT rec, label, min(start_ms) AS s FROM $dialog GROUP BY rec, label) d")
q("context_eviction", "SELECT w.rec, w.tick_ms, @BIG(count(*)) AS kept FROM $windows w JOIN $dialog d ON w.rec = d.rec AND d.end_ms > w.from_ms AND d.start_ms < w.tick_ms GROUP BY w.rec, w.tick_ms")
q("context_lineage", "SELECT s.rec, s.tick_ms, s.label AS local, d.label AS output, @BIG(sum(least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms))) AS score FROM $snapshots s JOIN $dialog d ON s.rec = d.rec AND s.start_ms < d.end_ms AND d.start_ms < s.end_ms GROUP BY s.rec, s.tick_ms, s.label, d.label")
q("expired_pending", "SELECT rec, turn, max(tick_ms) AS last_ms FROM $snapshots GROUP BY rec, turn, stop_ms HAVING max(tick_ms) + 4000 < stop_ms")
q("publication_lag", f"SELECT round(@PCT(@DBL(seen_ms - end_ms), 0.5), 6) AS p50, round(@PCT(@DBL(seen_ms - end_ms), 0.95), 6) AS p95 FROM ({FIRST}) f")
q("local_partition_pairs", "SELECT l.rec, l.tick_ms, l.turn AS a, r.turn AS b FROM $snapshots l JOIN $snapshots r ON l.rec = r.rec AND l.tick_ms = r.tick_ms AND l.turn < r.turn AND l.label <> r.label")

# Vectors
U = "SELECT id, label, u FROM $units"
q("l2_normalize", f"SELECT id, round(@NORM(u), 6) AS norm, round(@NTH(u, 1), 6) AS first FROM ({U}) x")
q("cosine_pairs", f"SELECT a.label, a.id AS l_id, b.id AS r_id, round(@DOT(a.u, b.u), 6) AS cosine FROM ({U}) a JOIN ({U}) b ON a.label = b.label AND a.id < b.id")
E_ = ("SELECT id, label, d, x FROM (" + U + ") y LATERAL VIEW posexplode(u) e AS d, x", "SELECT id, label, unnest(range(len(u))) AS d, unnest(u) AS x FROM (" + U + ") y")


def dims(name: str, text: str) -> None:
    """An entry over #E: id, label, d, x, one row a dimension."""
    q(name, text.replace("#E", f"({E_[0]})"), text.replace("#E", f"({E_[1]})"))


dims("centroid", "SELECT label, @BIG(d) AS d, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM (SELECT label, d, avg(x) AS m FROM #E e GROUP BY label, d) c")
RUN = "SELECT id, label, d, x, sum(x) OVER (PARTITION BY label, d ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM #E e"
dims("running_centroid", f"SELECT id, round(sum(x * s) / sqrt(sum(s * s)), 6) AS cosine FROM ({RUN}) r WHERE s IS NOT NULL GROUP BY id")
CC = "SELECT id, own, label, cosine FROM $affinity"
dims("centroid_cosines", f"SELECT id, label, round(cosine, 6) AS cosine FROM ({CC}) c")
dims("row_margin", f"SELECT id, best, round(top - next, 6) AS margin FROM (SELECT id, label AS best, cosine AS top, lead(cosine) OVER (PARTITION BY id ORDER BY cosine DESC, label) AS next, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, label) AS r FROM ({CC}) c) m WHERE r = 1")
dims("column_margin", f"SELECT label, best, round(top - next, 6) AS margin FROM (SELECT label, id AS best, cosine AS top, lead(cosine) OVER (PARTITION BY label ORDER BY cosine DESC, id) AS next, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, id) AS r FROM ({CC}) c) m WHERE r = 1")
dims("unique_best", f"SELECT id, best FROM (SELECT id, label AS best, cosine AS top, lead(cosine) OVER (PARTITION BY id ORDER BY cosine DESC, label) AS next, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, label) AS r FROM ({CC}) c) m WHERE r = 1 AND (next IS NULL OR top - next > 1e-12)")
P = "SELECT label, id, other, cosine FROM $angles"
q("acoustic_best_edge", f"SELECT id, other FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, other) AS r FROM ({P}) p WHERE id <> other) x WHERE r = 1")
# Text
NORMAL = "@REPLACE(replace(lower(text), 'ß', 'ss'), '[\\\\p{P}\\\\p{S}\\\\s]', '')"


def text(name: str, sql: str) -> None:
    """An entry whose regular expressions are written for Spark's string literals, where a backslash is doubled."""
    q(name, sql, sql.replace("\\\\", "\\"))


text("normalized_text", f"SELECT id, @SHA({NORMAL}) AS norm FROM $texts")
text("lexical_units", "SELECT id, @BIG(@COUNT_RE(@REPLACE(text, '([一-龥])', ' x '), '[\\\\p{L}\\\\p{N}\\\\p{M}]+')) AS units FROM $texts")
text("binding_key", "SELECT rec, turn, @SHA(concat(@STR(rec), '|', @STR(start_ms), '|', @STR(end_ms), '|', text)) AS binding_key FROM $dialog")
# Selection and sharding