"""The catalogue's entries for exports, gates, alignment, evidence, identity support, the wire format and selection.

Where a rule can be said in two ways, the oracle says it in another way than the query."""

from .catalog import query as q
from .definitions import both, text

# Overlap quality: 1 less the greatest share of a turn that one turn of another speaker covers; nothing for a turn without duration.
OVER = "greatest(0, least(l_end, r_end) - greatest(l_start, r_start))"
WORST = f"SELECT l_id, count(*) AS n, max(({OVER}) / greatest(1e-6, l_end - l_start)) AS worst FROM #PAIRS p WHERE l_speaker <> r_speaker GROUP BY l_id"
QUALITY = "CASE WHEN t.#END > t.start THEN greatest(0, 1 - coalesce(o.worst, 0)) ELSE 0 END"
both("overlap_report", f"""SELECT t.rec, t.speaker, @BIG(count(*)) AS turns, round(sum(t.#END - t.start), 6) AS seconds, @BIG(sum(coalesce(o.n, 0))) AS n_overlaps, round(avg({QUALITY}), 6) AS quality
 FROM $turns t LEFT JOIN ({WORST}) o ON t.id = o.l_id GROUP BY t.rec, t.speaker""")
both("overlap_quality", f"SELECT t.id, round({QUALITY}, 6) AS quality FROM $turns t LEFT JOIN ({WORST}) o ON t.id = o.l_id")
# Binned and plain joins give the same pairs: the query is binned, the oracle is not.
both("overlap_pairs_binned", "SELECT rec, @BIG(count(*)) AS pairs, round(sum(least(l_end, r_end) - greatest(l_start, r_start)), 5) AS seconds FROM #PAIRS p WHERE l_id < r_id GROUP BY rec")
q(
    "nearest_neighbor_gap",
    """SELECT id, round(gap, 6) AS gap, round(1 / (1 + gap), 6) AS confidence FROM (SELECT id, greatest(0, least(coalesce(start - before, 1e18), coalesce(after - `end`, 1e18))) AS gap, before, after FROM (
 SELECT *, max(`end`) OVER (PARTITION BY rec, speaker ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lead(start) OVER (PARTITION BY rec, speaker ORDER BY start, id) AS after FROM $turns) t) g
 WHERE before IS NOT NULL OR after IS NOT NULL""",
    """SELECT id, round(gap, 6) AS gap, round(1 / (1 + gap), 6) AS confidence FROM (SELECT a.id, min(greatest(0, a.start - b."end", b.start - a."end")) AS gap FROM $turns a JOIN $turns b ON a.rec = b.rec AND a.speaker = b.speaker AND a.id <> b.id GROUP BY a.id) g""",
)

# Text predicates
NORMAL = "@REPLACE(replace(lower(text), 'ß', 'ss'), '[\\\\p{P}\\\\p{S}\\\\s]', '')"
CJK = "[\\\\x{3400}-\\\\x{9FFF}\\\\x{F900}-\\\\x{FAFF}]"
UNITS = f"@BIG(@COUNT_RE(@REPLACE(text, '({CJK})', ' x '), '[\\\\p{{L}}\\\\p{{N}}\\\\p{{M}}]+'))"
BARE = "@REPLACE(text, '\\\\s+$', '')"
OPEN = "@RLIKE(text, '(\\\\.{2,}|[…⋯]+)\\\\s*$')"
CLOSED = f"(NOT {OPEN} AND @RLIKE(@REPLACE(@REPLACE({BARE}, '[\"\\\\x27”’)\\\\]】』》〉〗〙〛]+$', ''), '\\\\s+$', ''), '[。！？!?；;.]$'))"
text("open_ending", f"SELECT rec, tick_ms, turn, {OPEN} AS open_end FROM $revised")
text("sentence_terminal", f"SELECT rec, tick_ms, turn, {CLOSED} AS terminal FROM $revised")
TAIL = f"@REPLACE(@REPLACE({BARE}, '[，,、；;：:]+$', ''), '\\\\s+$', '')"
text("publication_terminal", f"""SELECT rec, tick_ms, turn, @SHA(CASE WHEN length({NORMAL}) < 5 OR {OPEN} OR {CLOSED} OR {TAIL} = '' THEN text
 WHEN @RLIKE({TAIL}, '[一-鿿]') THEN concat({TAIL}, '。') ELSE concat({TAIL}, '.') END) AS closed FROM (SELECT rec, tick_ms, turn, @REPLACE(text, '…$', ',') AS text FROM $revised) r""")
text("cjk_prefix", f"SELECT id, @RLIKE(norm, '^{CJK}') AS cjk FROM (SELECT id, {NORMAL} AS norm FROM (SELECT id, CASE WHEN id % 3 = 0 THEN concat('「漢', text) ELSE text END AS text FROM $texts) t) n")
text("evidence_poor", f"SELECT rec, tick_ms, turn, {UNITS} AS units, end_ms - start_ms < 400 AND {UNITS} = 1 AS poor, NOT (end_ms - start_ms < 400 AND {UNITS} = 1) AS material FROM $revised")
q(
    "lexical_diversity",
    "SELECT id, CAST(size(u) AS bigint) AS units, CAST(size(array_distinct(u)) AS bigint) AS diversity FROM (SELECT id, regexp_extract_all(lower(text), '[A-Za-z0-9]+|[\\\\x{3400}-\\\\x{9FFF}]', 0) AS u FROM $texts) t",
    "SELECT id, CAST(count(*) FILTER (WHERE w <> '') AS bigint) AS units, CAST(count(DISTINCT w) FILTER (WHERE w <> '') AS bigint) AS diversity FROM (SELECT id, unnest(string_split(regexp_replace(regexp_replace(lower(text), '([\\x{3400}-\\x{9FFF}])', ' \\1 ', 'g'), '[^a-z0-9\\x{3400}-\\x{9FFF}]+', ' ', 'g'), ' ')) AS w FROM $texts) t GROUP BY id",
)
text("boundary_merge", f"""SELECT rec, tick_ms, turn, @SHA(concat(head, CASE WHEN @RLIKE(head, '[A-Za-z0-9]$') AND @RLIKE(rest, '^[A-Za-z0-9]') THEN ' ' ELSE '' END, rest)) AS merged FROM (
 SELECT rec, tick_ms, turn, @REPLACE(@REPLACE(text, '(\\\\.{{2,}}|[…⋯]+)\\\\s*$', ''), '\\\\s+$', '') AS head, @REPLACE(after, '^\\\\s+', '') AS rest FROM (
  SELECT r.rec, r.tick_ms, r.turn, r.text, substring(d.text, CAST(length(r.text) AS int)) AS after FROM $revised r JOIN $dialog d ON r.rec = d.rec AND r.turn = d.turn WHERE NOT r.whole AND r.from_ms = 0) x) y""")
START = "\\\\[\\\\d+(\\\\.\\\\d+)?\\\\]\\\\[[SG][^\\\\]]*\\\\]"
text("marker_only_loop", f"""SELECT rec, @BIG(@COUNT_RE(raw, '{START}')) AS markers, @COUNT_RE(raw, '{START}') >= 8 AND @REPLACE(@REPLACE(@REPLACE(raw, '{START}', ''), '\\\\[\\\\d+(\\\\.\\\\d+)?\\\\]', ''), '[.,，。!！?？;；:：…\\\\[\\\\]\\\\-—]', '') = '' AS marker_loop FROM (
 SELECT rec, concat(raw, raw, CASE WHEN rec % 3 = 0 THEN 'word' WHEN rec % 3 = 1 THEN ',。[12.5]' ELSE '' END) AS raw FROM (SELECT rec, @JOINED(marker, turn, '') AS raw FROM (SELECT rec, turn, concat('[', @STR(@DIV(start_ms, 1000)), '][', label, ']') AS marker FROM $dialog) d GROUP BY rec) m) n""")
q(
    "canonical_label",
    "SELECT raw, CASE WHEN raw rlike '^[SG]\\\\d+$' AND CAST(substring(raw, 2) AS int) > 0 THEN concat('S', @PAD2(@STR(CAST(substring(raw, 2) AS int)))) END AS canonical FROM (SELECT DISTINCT concat(CASE WHEN id % 2 = 0 THEN 'S' WHEN id % 3 = 0 THEN 'G' ELSE 'X' END, @STR(id % 250)) AS raw FROM $turns) t",
    "SELECT raw, CASE WHEN raw NOT LIKE 'X%' AND TRY_CAST(raw[2:] AS integer) > 0 THEN printf('S%02d', CAST(raw[2:] AS integer)) END AS canonical FROM (SELECT DISTINCT concat(CASE WHEN id % 2 = 0 THEN 'S' WHEN id % 3 = 0 THEN 'G' ELSE 'X' END, @STR(id % 250)) AS raw FROM $turns) t",
)
# A key of times to the hundredth and text without space; an id of times to the millionth and normalised text. Speakers are in neither.
C2 = "concat(@STR(@DIV(@BIG(floor({0} * 100 + 0.5)), 100)), '.', lpad(@STR(@BIG(floor({0} * 100 + 0.5)) % 100), 2, '0'))"
both("revision_key", f"SELECT id, concat({C2.format('start')}, ':', {C2.format('#END')}, ':', @REPLACE(replace(lower(text), 'ß', 'ss'), '[ \t\n\r]+', '')) AS revision_key FROM $turns")
text("stable_ids", f"SELECT rec, turn, @SHA(concat('[', @STR(start_ms * 1000), ',', @STR(end_ms * 1000), ',\"', {NORMAL}, '\"]')) AS segment_id FROM $dialog")
text("snapshot_dedupe", f"SELECT DISTINCT rec, tick_ms, local, start_ms, end_ms, @SHA({NORMAL}) AS norm FROM $revised")

# Exports
STAMP = "concat(@PAD2(@STR(@DIV({0}, 3600000))), ':', lpad(@STR(@DIV({0}, 60000) % 60), 2, '0'), ':', lpad(@STR(@DIV({0}, 1000) % 60), 2, '0'), ',', lpad(@STR({0} % 1000), 3, '0'))"
q("srt_export", f"""SELECT rec, concat(@JOINED(block, place, '\n\n'), '\n') AS srt FROM (SELECT rec, place, concat(@STR(place), '\n', {STAMP.format('start_ms')}, ' --> ', {STAMP.format('end_ms')}, '\n[', label, '] ', text) AS block
 FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start_ms, end_ms, turn) AS place FROM $published) p) b GROUP BY rec""")
q(
    "json_export",
    """SELECT rec, to_json(named_struct('schema_version', 'turnloom-export.v1', 'audio_name', CAST(rec AS string), 'duration_ms', max(end_ms), 'speaker_count', count(DISTINCT label), 'speakers', array_sort(collect_set(label)),
 'segments', transform(array_sort(collect_list(struct(seq, start_ms, end_ms, label, text))), x -> named_struct('start_ms', x.start_ms, 'end_ms', x.end_ms, 'speaker', x.label, 'text', x.text)))) AS export FROM $published GROUP BY rec""",
    """SELECT rec, CAST(to_json(struct_pack(schema_version := 'turnloom-export.v1', audio_name := CAST(rec AS varchar), duration_ms := max(end_ms), speaker_count := count(DISTINCT label), speakers := list_sort(list(DISTINCT label)),
 segments := list(struct_pack(start_ms := start_ms, end_ms := end_ms, speaker := label, text := text) ORDER BY seq))) AS varchar) AS export FROM $published GROUP BY rec""",
)
CLOCK = "concat(@PAD2(@STR(@DIV({0}, 60000))), ':', lpad(@STR(@DIV({0}, 1000) % 60), 2, '0'))"
q("clock_format", f"SELECT rec, turn, {CLOCK.format('start_ms')} AS clock, concat({CLOCK.format('start_ms')}, '.', @STR(@DIV(start_ms, 100) % 10)) AS tenths, {CLOCK.format('(start_ms * 400)')} AS long_clock, (CAST(substring(label, 2) AS int) - 1) % 10 AS color FROM $dialog")
text("download_name", "SELECT page_id, concat(coalesce(nullif(substring(@REPLACE(@REPLACE(coalesce(url, ''), '\\\\.[^./\\\\\\\\]+$', ''), '[^A-Za-z0-9._-]+', '_'), 1, 80), ''), 'transcript'), '.srt') AS name FROM $pages")
COMMITTED = "SELECT rec, label, text, start_ms, end_ms FROM $published WHERE (rec + turn) % 17 <> 0 UNION ALL SELECT rec, label, text, start_ms, end_ms FROM $published WHERE (rec + turn) % 19 = 0"
STREAMED = "SELECT rec, label, text, start_ms, end_ms FROM $published"
q(
    "artifact_multiset_diff",
    f"SELECT 'missing' AS side, rec, start_ms, end_ms, label FROM ({STREAMED} EXCEPT ALL ({COMMITTED})) m UNION ALL SELECT 'extra', rec, start_ms, end_ms, label FROM (({COMMITTED}) EXCEPT ALL {STREAMED}) e",
    f"""SELECT CASE WHEN n > 0 THEN 'missing' ELSE 'extra' END AS side, rec, start_ms, end_ms, label FROM (SELECT rec, start_ms, end_ms, label, text, CAST(sum(n) AS bigint) AS n FROM (
 SELECT *, 1 AS n FROM ({STREAMED}) s UNION ALL SELECT *, -1 FROM ({COMMITTED}) c) u GROUP BY rec, start_ms, end_ms, label, text HAVING sum(n) <> 0) d, range(abs(n)) r""",
)
q("canonical_digest", "SELECT rec, @SHA(@JOINED(line, seq, '\n')) AS digest FROM (SELECT rec, seq, concat('{\"end\":', @STR(end_ms), ',\"speaker\":\"', label, '\",\"start\":', @STR(start_ms), ',\"text\":\"', @SHA(text), '\"}') AS line FROM $published) p GROUP BY rec")

# Ledger
q("wait_ticks", """SELECT p.rec, p.turn, @BIG(ceil(p.seen_ms / 2000.0E0)) - @BIG(ceil(s.first_ms / 2000.0E0)) AS ticks, p.seen_ms - s.first_ms AS wait_ms FROM $published p
 JOIN (SELECT rec, turn, min(tick_ms) AS first_ms FROM $snapshots GROUP BY rec, turn) s ON p.rec = s.rec AND p.turn = s.turn""")
q("label_immutability", "SELECT rec, turn, @BIG(count(DISTINCT local)) AS labels, min(local) AS low, max(local) AS high FROM $revised GROUP BY rec, turn HAVING count(DISTINCT local) > 1")
q("append_only_audit", """SELECT rec, turn, tick_ms, CASE WHEN start_ms <> start_was THEN 'start' WHEN end_ms <> end_was THEN 'end' WHEN local <> local_was THEN 'speaker' ELSE 'text' END AS field FROM (
 SELECT rec, turn, tick_ms, start_ms, end_ms, local, text, lag(start_ms) OVER w AS start_was, lag(end_ms) OVER w AS end_was, lag(local) OVER w AS local_was, lag(text) OVER w AS text_was FROM $revised WHERE whole AND start_ms > from_ms
 WINDOW w AS (PARTITION BY rec, turn ORDER BY tick_ms)) v WHERE start_ms <> start_was OR end_ms <> end_was OR local <> local_was OR text <> text_was""")
q("owner_lookup", "SELECT rec, turn, local AS owner, tick_ms AS revision FROM (SELECT *, row_number() OVER (PARTITION BY rec, turn ORDER BY tick_ms DESC, local) AS r FROM $revised) s WHERE r = 1")
q("evidence_ledger", "SELECT rec, turn, @BIG(count(*)) AS records, max(tick_ms) AS revision, min(tick_ms) AS first_ms, @BIG(count(DISTINCT local)) AS tracks FROM $revised GROUP BY rec, turn")
q("partition_exclusions", "SELECT a.rec, a.tick_ms, a.local, @TEXT_OF(@SORTED_SET(b.label), ',') AS occupied FROM $revised a JOIN $revised b ON a.rec = b.rec AND a.tick_ms = b.tick_ms AND a.local <> b.local GROUP BY a.rec, a.tick_ms, a.local")
q("confirmed_support", """SELECT d.rec, d.label, d.support_ms, t.ticks FROM (SELECT rec, label, @BIG(sum(end_ms - start_ms)) AS support_ms FROM $dialog GROUP BY rec, label) d
 JOIN (SELECT rec, label, @BIG(count(DISTINCT tick_ms)) AS ticks FROM $snapshots GROUP BY rec, label) t ON d.rec = t.rec AND d.label = t.label WHERE d.support_ms >= 1500 AND t.ticks >= 2""")
FRONTIER = "SELECT w.rec, w.tick_ms, coalesce(max(p.end_ms), 0) AS until_ms FROM $windows w LEFT JOIN $published p ON w.rec = p.rec AND p.seen_ms < w.tick_ms GROUP BY w.rec, w.tick_ms"
q("head_of_line_block", f"""SELECT rec, tick_ms, turn FROM (SELECT s.rec, s.tick_ms, s.turn, max(CASE WHEN (p.seen_ms IS NULL OR p.seen_ms > s.tick_ms) AND s.end_ms > f.until_ms + 250 THEN 1 ELSE 0 END) OVER (PARTITION BY s.rec, s.tick_ms ORDER BY s.start_ms, s.end_ms, s.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blocked
 FROM $revised s JOIN ({FRONTIER}) f ON s.rec = f.rec AND s.tick_ms = f.tick_ms LEFT JOIN $published p ON s.rec = p.rec AND s.turn = p.turn) b WHERE blocked = 1""",
f"""SELECT DISTINCT a.rec, a.tick_ms, a.turn FROM $revised a JOIN $revised b ON a.rec = b.rec AND a.tick_ms = b.tick_ms AND (b.start_ms, b.end_ms, b.turn) < (a.start_ms, a.end_ms, a.turn) JOIN ({FRONTIER}) f ON a.rec = f.rec AND a.tick_ms = f.tick_ms
 WHERE b.end_ms > f.until_ms + 250 AND NOT EXISTS (SELECT 1 FROM $published p WHERE p.rec = b.rec AND p.turn = b.turn AND p.seen_ms <= a.tick_ms)""")
q("empty_grace", """SELECT rec, @BIG(max(streak)) AS longest, max(streak) > 1 AS forced FROM (SELECT rec, isle, sum(empty) AS streak FROM (SELECT rec, tick_ms, empty, sum(1 - empty) OVER (PARTITION BY rec ORDER BY tick_ms ROWS UNBOUNDED PRECEDING) AS isle FROM (
 SELECT w.rec, w.tick_ms, CASE WHEN s.rec IS NULL OR (w.rec + @DIV(w.tick_ms, 6000)) % 4 = 0 THEN 1 ELSE 0 END AS empty FROM $windows w LEFT JOIN (SELECT DISTINCT rec, tick_ms FROM $snapshots) s ON w.rec = s.rec AND w.tick_ms = s.tick_ms) e) i GROUP BY rec, isle) g GROUP BY rec""")
q("tick_projection", """SELECT w.rec, w.tick_ms, w.from_ms, 'passed' AS status, 'passed' AS gate_status, coalesce(s.n, 0) AS local_segments, coalesce(s.open_n, 0) AS pending_segments, coalesce(p.n, 0) AS delta_segments, coalesce(p.n, 0) AS committed_segments,
 coalesce(p.delta, '') AS user_text_delta, coalesce(p.age_ms, 0) AS delta_first_publish_age_ms, CASE WHEN w.tick_ms = w.stop_ms THEN w.tick_ms ELSE greatest(0, w.tick_ms - 2000) END AS stable_until, coalesce(max(p.until_ms) OVER (PARTITION BY w.rec ORDER BY w.tick_ms ROWS UNBOUNDED PRECEDING), 0) AS published_until,
 greatest(0, w.tick_ms - coalesce(s.oldest_ms, w.tick_ms)) AS pending_age_ms FROM $windows w
 LEFT JOIN (SELECT r.rec, r.tick_ms, @BIG(count(*)) AS n, @BIG(sum(CASE WHEN q.seen_ms > r.tick_ms THEN 1 ELSE 0 END)) AS open_n, min(CASE WHEN q.seen_ms > r.tick_ms THEN r.start_ms END) AS oldest_ms FROM $revised r JOIN $published q ON r.rec = q.rec AND r.turn = q.turn GROUP BY r.rec, r.tick_ms) s ON w.rec = s.rec AND w.tick_ms = s.tick_ms
 LEFT JOIN (SELECT rec, seen_ms, @BIG(count(*)) AS n, @SHA(@JOINED(text, seq, '')) AS delta, max(seen_ms - end_ms) AS age_ms, max(end_ms) AS until_ms FROM $published GROUP BY rec, seen_ms) p ON w.rec = p.rec AND w.tick_ms = p.seen_ms""")
LOCALS = "SELECT DISTINCT rec, tick_ms, @BIG(ceil(tick_ms / 2000.0E0)) AS k, local FROM $revised"
q("set_changes", f"""SELECT rec, k, @BIG(sum(CASE WHEN was AND now THEN 1 ELSE 0 END)) AS reused, @BIG(sum(CASE WHEN was AND NOT now THEN 1 ELSE 0 END)) AS expired, @BIG(sum(CASE WHEN now AND NOT was THEN 1 ELSE 0 END)) AS created FROM (
 SELECT rec, k, local, max(w) = 1 AS was, max(n) = 1 AS now FROM (SELECT rec, k, local, 0 AS w, 1 AS n FROM ({LOCALS}) a UNION ALL SELECT rec, k + 1, local, 1, 0 FROM ({LOCALS}) b) u GROUP BY rec, k, local) c GROUP BY rec, k""",
f"""SELECT rec, k, CAST(count(*) FILTER (WHERE n.local IS NOT NULL AND p.local IS NOT NULL) AS bigint) AS reused, CAST(count(*) FILTER (WHERE n.local IS NULL) AS bigint) AS expired, CAST(count(*) FILTER (WHERE p.local IS NULL) AS bigint) AS created
 FROM (SELECT rec, k, local FROM ({LOCALS}) a) n FULL JOIN (SELECT rec, k + 1 AS k, local FROM ({LOCALS}) b) p USING (rec, k, local) GROUP BY rec, k""")
q("speaker_union", """SELECT rec, label, min(place) AS first_place, @BIG(count(*)) AS n FROM (SELECT rec, label, seq AS place FROM $published UNION ALL SELECT r.rec, r.local, 1000000 + r.turn FROM $revised r JOIN $published p ON r.rec = p.rec AND r.turn = p.turn AND p.seen_ms > r.tick_ms) u WHERE trim(label) <> '' GROUP BY rec, label""")

# Alignment of a snapshot's labels with what was published before its tick
SECONDS = "((least(r.end_ms, p.end_ms) - greatest(r.start_ms, p.start_ms)) / 1000.0E0)"
SIM = "CASE WHEN r.norm = '' OR p.norm = '' THEN 0 WHEN contains(r.norm, p.norm) OR contains(p.norm, r.norm) THEN least(length(r.norm), length(p.norm)) * 1.0E0 / greatest(length(r.norm), length(p.norm)) ELSE 0 END"
EDGES = f"""SELECT rec, tick_ms, local, output, sum(best) AS score FROM (SELECT r.rec, r.tick_ms, r.local, r.turn, p.label AS output,
 max({SECONDS} * (0.55 * {SECONDS} / ((r.end_ms - r.start_ms) / 1000.0E0) + 0.25 * {SECONDS} / ((greatest(r.end_ms, p.end_ms) - least(r.start_ms, p.start_ms)) / 1000.0E0) + 0.2 * {SIM})) AS best
 FROM (SELECT *, {NORMAL} AS norm FROM $revised) r JOIN (SELECT *, {NORMAL} AS norm FROM $published) p ON r.rec = p.rec AND p.seen_ms < r.tick_ms AND least(r.end_ms, p.end_ms) - greatest(r.start_ms, p.start_ms) >= 100
 GROUP BY r.rec, r.tick_ms, r.local, r.turn, p.label) e GROUP BY rec, tick_ms, local, output"""
text("alignment_score", f"SELECT rec, tick_ms, local, output, round(score, 6) AS score FROM ({EDGES}) s")
MARGINS = f"""SELECT *, lead(score) OVER (PARTITION BY rec, tick_ms, local ORDER BY score DESC, output) AS row_next, row_number() OVER (PARTITION BY rec, tick_ms, local ORDER BY score DESC, output) AS row_place,
 lead(score) OVER (PARTITION BY rec, tick_ms, output ORDER BY score DESC, local) AS col_next, row_number() OVER (PARTITION BY rec, tick_ms, output ORDER BY score DESC, local) AS col_place FROM (SELECT rec, tick_ms, local, output, round(score, 9) AS score FROM ({EDGES}) s) t"""
BEST = f"""SELECT rec, tick_ms, local, CASE WHEN row_unique THEN output END AS best, score, score - coalesce(row_next, 0) AS row_margin, row_unique, row_unique AND col_place = 1 AND (col_next IS NULL OR score - col_next > 1e-9) AS column_unique,
 CASE WHEN row_unique AND col_place = 1 AND (col_next IS NULL OR score - col_next > 1e-9) THEN score - coalesce(col_next, 0) ELSE 0 END AS column_margin FROM (SELECT *, row_next IS NULL OR score - row_next > 1e-9 AS row_unique FROM ({MARGINS}) m) u WHERE row_place = 1"""
text("alignment_margins", f"SELECT rec, tick_ms, local, best, round(score, 6) AS score, round(row_margin, 6) AS row_margin, round(column_margin, 6) AS column_margin, row_unique, column_unique FROM ({BEST}) b")
text("event_claims", f"""SELECT rec, local, @BIG(count(*)) AS alignments, round(min(score), 6) AS context_score, round(min(row_margin), 6) AS row_margin, round(min(column_margin), 6) AS column_margin, min(CASE WHEN row_unique THEN 1 ELSE 0 END) = 1 AS row_unique,
 min(CASE WHEN column_unique THEN 1 ELSE 0 END) = 1 AS column_unique, CASE WHEN count(DISTINCT best) > 1 THEN 'conflicting targets' END AS conflict, CASE WHEN count(DISTINCT best) = 1 THEN min(best) END AS target FROM ({BEST}) b GROUP BY rec, local""")
text("context_prior", f"SELECT rec, output, round(max(score), 6) AS prior FROM ({EDGES}) s GROUP BY rec, output")
text("context_normalized", f"SELECT rec, tick_ms, local, output, round(greatest(-1, least(1, score / max(abs(score)) OVER (PARTITION BY rec, tick_ms, local))), 6) AS context FROM ({EDGES}) s")
# A candidate's tier: fused 5, acoustic 4, context 3, continuity 2.5, neighbour 1, else the registry's prior.
TIER = """SELECT id, label, CASE WHEN acoustic IS NOT NULL AND context IS NOT NULL THEN 'fused' WHEN acoustic IS NOT NULL THEN 'acoustic' WHEN context IS NOT NULL THEN 'context' WHEN same THEN 'local_continuity' WHEN distance IS NOT NULL THEN 'neighbor' ELSE 'registry_prior' END AS source,
 CASE WHEN acoustic IS NOT NULL AND context IS NOT NULL THEN greatest(least(1, greatest(0, acoustic)), context / (1 + context)) WHEN acoustic IS NOT NULL THEN least(1, greatest(0, acoustic)) WHEN context IS NOT NULL THEN context / (1 + context) WHEN same THEN 0.5E0 WHEN distance IS NOT NULL THEN 1 / (1 + distance) ELSE 0 * 1.0E0 END AS confidence FROM (
 SELECT id, label, CASE WHEN (id + label) % 3 = 0 THEN cosine END AS acoustic, CASE WHEN (id + label) % 4 = 0 THEN greatest(0, cosine) * 3 END AS context, own = label AS same, CASE WHEN (id + label) % 5 = 0 THEN abs(cosine) * 10 END AS distance FROM $affinity) a"""
q("deadline_tiers", f"SELECT id, label, source, round(confidence, 6) AS confidence, round(confidence + CASE source WHEN 'fused' THEN 5 WHEN 'acoustic' THEN 4 WHEN 'context' THEN 3 WHEN 'local_continuity' THEN 2 WHEN 'neighbor' THEN 1 ELSE 0.1 END, 6) AS score FROM ({TIER}) t")

# Evidence and profiles
q("evidence_precision", """SELECT id, round(precision_route, 6) AS route, purity >= 1 AND precision_route > 0 AS usable, purity >= 1 AND coverage >= 1.5 AND id % 6 >= 2 AS profile_allowed, round(CASE WHEN purity >= 1 AND coverage >= 1.5 AND id % 6 >= 2 THEN precision_route ELSE 0 END, 6) AS profile,
 round(CASE WHEN purity >= 1 AND coverage >= 1.5 AND id % 6 >= 2 AND coverage >= 3 THEN precision_route ELSE 0 END, 6) AS novelty FROM $weighed""")
text("candidate_permissions", f"""SELECT rec, turn, quality >= 0.25 AS routing, quality >= 0.25 AND seconds >= 1.5 AND units >= 2 AND kinds >= 2 AS profile, quality >= 0.25 AND seconds >= 3 AND units >= 2 AND kinds >= 2 AS novelty FROM (
 SELECT rec, turn, (end_ms - start_ms) / 1000.0E0 AS seconds, CASE WHEN (rec + turn) % 9 = 0 THEN 0.2 ELSE 1.0 END AS quality, {UNITS} AS units, CASE WHEN @RLIKE(lower(text), '^\\\\W*(\\\\w+)\\\\W*$') THEN 1 ELSE 2 END AS kinds FROM $dialog) c""")
q("evidence_strength", """SELECT id, round(least(1, greatest(0, purity)) * (0.55 * least(1, coverage / 6) + 0.45 * least(1, (1 + id % 11) / 8.0E0)), 6) AS strength FROM $evidence""")
q("effective_support", "SELECT label, round(sum(least(1, weight * 1.5)), 6) AS support FROM $exemplars GROUP BY label")
MEDOID = "SELECT label, id, dispersion FROM (SELECT label, id, dispersion, row_number() OVER (PARTITION BY label ORDER BY round(total, 9), id) AS r FROM (SELECT label, id, sum(angle) AS total, @MEDIAN(angle) AS dispersion FROM $angles GROUP BY label, id) t) m WHERE r = 1"
q("medoid", f"SELECT label, id AS medoid, round(dispersion, 6) AS dispersion FROM ({MEDOID}) m")
q("exemplar_utility", f"SELECT e.label, round(avg(least(1, e.weight)) + 0.15 * avg(e.coverage / (e.coverage + 1.5)) - max(m.dispersion) / pi(), 6) AS utility FROM $exemplars e JOIN ({MEDOID}) m ON e.label = m.label GROUP BY e.label")
DROPS = "SELECT d.label, d.id AS dropped, a.id, sum(a.angle) AS total, @MEDIAN(a.angle) AS dispersion FROM $exemplars d JOIN $angles a ON d.label = a.label AND a.id <> d.id AND a.other <> d.id GROUP BY d.label, d.id, a.id"
KEPT = "SELECT d.label, d.id AS dropped, avg(least(1, e.weight)) + 0.15 * avg(e.coverage / (e.coverage + 1.5)) AS worth FROM $exemplars d JOIN $exemplars e ON d.label = e.label AND e.id <> d.id GROUP BY d.label, d.id"
q("exemplar_subset", f"""SELECT label, dropped, round(utility, 6) AS utility FROM (SELECT k.label, k.dropped, k.worth - m.dispersion / pi() AS utility, row_number() OVER (PARTITION BY k.label ORDER BY round(k.worth - m.dispersion / pi(), 9) DESC, k.dropped) AS r FROM ({KEPT}) k
 JOIN (SELECT label, dropped, dispersion, row_number() OVER (PARTITION BY label, dropped ORDER BY round(total, 9), id) AS place FROM ({DROPS}) d) m ON k.label = m.label AND k.dropped = m.dropped AND m.place = 1) u WHERE r = 1""")
SHOWN = f"SELECT e.label AS profile, v.label AS observed, v.id, @DOT(v.u, e.u) AS s, CASE WHEN e.id = m.id THEN 1 ELSE 0 END AS proto FROM $exemplars v JOIN $exemplars e ON @SIZE(v.u) = @SIZE(e.u) JOIN ({MEDOID}) m ON m.label = e.label WHERE v.place <= 4"
VIEWS = f"SELECT profile, observed, id, 0.7 * max(CASE WHEN proto = 1 THEN s END) + 0.3 * avg(CASE WHEN r <= 2 THEN s END) AS s FROM (SELECT *, row_number() OVER (PARTITION BY profile, observed, id ORDER BY s DESC, proto) AS r FROM ({SHOWN}) v) w GROUP BY profile, observed, id"
RAW = f"SELECT profile, observed, CASE WHEN count(*) >= 3 THEN (sum(s) - min(s) - max(s)) / (count(*) - 2) ELSE avg(s) END AS raw FROM ({VIEWS}) v GROUP BY profile, observed"
q("trimmed_score", f"SELECT profile, observed, round(raw, 6) AS raw FROM ({RAW}) r")
ZED = f"SELECT r.profile, r.observed, (r.raw - 0.45) / (0.12 + 0.5 * ((1 - cos(o.dispersion)) + (1 - cos(p.dispersion)))) AS z FROM ({RAW}) r JOIN ({MEDOID}) p ON r.profile = p.label JOIN ({MEDOID}) o ON r.observed = o.label"
q("component_score", f"SELECT profile, observed, round(z, 6) AS z, round(1 / (1 + exp(-z)), 6) AS inlier FROM ({ZED}) z")
q("output_uniqueness", f"SELECT observed, profile, round(inlier - coalesce(peer, 0.5), 6) AS uniqueness FROM (SELECT observed, profile, inlier, CASE WHEN r = 1 THEN second ELSE first END AS peer FROM (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY inlier DESC, profile) AS r, max(inlier) OVER (PARTITION BY observed) AS first, lead(inlier) OVER (PARTITION BY observed ORDER BY inlier DESC, profile) AS second FROM (SELECT observed, profile, 1 / (1 + exp(-z)) AS inlier FROM ({ZED}) z) i) j) k",
f"SELECT a.observed, a.profile, round(a.inlier - coalesce(max(b.inlier), 0.5), 6) AS uniqueness FROM (SELECT observed, profile, 1 / (1 + exp(-z)) AS inlier FROM ({ZED}) z) a LEFT JOIN (SELECT observed, profile, 1 / (1 + exp(-z)) AS inlier FROM ({ZED}) y) b ON a.observed = b.observed AND a.profile <> b.profile GROUP BY a.observed, a.profile, a.inlier")
q("cohesion_floor", "SELECT label, round(min(best), 6) AS cohesion FROM (SELECT label, id, max(cosine) AS best FROM $angles WHERE id <> other GROUP BY label, id) n GROUP BY label")
q("acceptance_floor", "SELECT label, round(greatest(0.7, 0.8 * min(best)), 6) AS floor_cos FROM (SELECT label, id, max(cosine) AS best FROM $angles WHERE id <> other GROUP BY label, id) n GROUP BY label")
q("profile_utility", """SELECT e.label, round(e.strength + 0.08 * e.ticks + 0.02 * least(12, e.units) + 0.05 * a.nonredundancy + 0.05 * a.least_cosine, 6) AS utility FROM (
 SELECT x.label, sum(least(1, purity) * (0.55 * least(1, x.coverage / 6) + 0.45 * least(1, (1 + x.id % 11) / 8.0E0))) AS strength, count(DISTINCT x.id % 3) AS ticks, sum(1 + x.id % 11) AS units FROM $exemplars x JOIN $evidence v ON x.id = v.id GROUP BY x.label) e
 JOIN (SELECT label, avg(1 - cosine) AS nonredundancy, min(cosine) AS least_cosine FROM $angles WHERE id < other GROUP BY label) a ON e.label = a.label""")
q("max_cross_similarity", "SELECT a.label AS l, b.label AS r, round(max(@DOT(a.u, b.u)), 6) AS best FROM $exemplars a JOIN $exemplars b ON @SIZE(a.u) = @SIZE(b.u) WHERE a.label < b.label GROUP BY a.label, b.label")
CROSS = "SELECT a.label AS l, b.label AS r, round(max(@DOT(a.u, b.u)), 9) AS best FROM $exemplars a JOIN $exemplars b ON @SIZE(a.u) = @SIZE(b.u) WHERE a.label <> b.label GROUP BY a.label, b.label"
RANKS = f"SELECT l, r, best, row_number() OVER (PARTITION BY l ORDER BY best DESC, r) AS place, lead(best) OVER (PARTITION BY l ORDER BY best DESC, r) AS next FROM ({CROSS}) c"
q("mutual_best", f"SELECT a.l, a.r, a.best FROM ({RANKS}) a JOIN ({RANKS}) b ON a.l = b.r AND a.r = b.l AND a.place = 1 AND b.place = 1 WHERE a.l < a.r AND (a.next IS NULL OR a.best - a.next > 1e-9) AND (b.next IS NULL OR b.best - b.next > 1e-9)",
f"SELECT least(l, r) AS l, greatest(l, r) AS r, max(best) AS best FROM ({CROSS}) c WHERE best = (SELECT max(d.best) FROM ({CROSS}) d WHERE d.l = c.l) AND best = (SELECT max(e.best) FROM ({CROSS}) e WHERE e.r = c.r) GROUP BY least(l, r), greatest(l, r) HAVING count(*) = 2")
ANCHORS = "SELECT label, id, u FROM (SELECT label, id, u, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS r FROM $units) a WHERE r <= 2"
WEAK = f"SELECT e.label AS observed, a.label, max(@DOT(e.u, a.u)) AS raw FROM (SELECT x.label, x.id, x.u FROM $exemplars x JOIN ({MEDOID}) m ON x.id = m.id) e JOIN ({ANCHORS}) a ON @SIZE(e.u) = @SIZE(a.u) GROUP BY e.label, a.label"
q("weak_anchors", f"SELECT observed, label, round(raw, 6) AS raw, round(1 / (1 + exp(-greatest(-3.5, least(3.5, (raw - 0.45) / 0.12)))), 6) AS inlier FROM ({WEAK}) w")
q("output_acoustic_utility", f"""SELECT w.observed, w.label, round(CASE WHEN z.z IS NULL THEN 1 / (1 + exp(-greatest(-3.5, least(3.5, (w.raw - 0.45) / 0.12)))) ELSE greatest(2 / (1 + exp(-z.z)) - 1, greatest(0, 2 / (1 + exp(-greatest(-3.5, least(3.5, (w.raw - 0.45) / 0.12)))) - 1)) END, 6) AS utility
 FROM ({WEAK}) w LEFT JOIN ({ZED}) z ON z.observed = w.observed AND z.profile = w.label AND z.profile % 3 <> 0""")
q("component_output_support", f"SELECT w.observed, w.label, round(p.route * greatest(0, w.raw - 0.45), 6) AS support FROM ({WEAK}) w JOIN (SELECT label, avg(precision_route) AS route FROM $weighed GROUP BY label) p ON w.observed = p.label")
q("bridge_authority", """SELECT id, round(CASE WHEN id % 13 = 0 THEN 0 ELSE least(0.55, 0.55 * (purity * inlier * least((id % 10) / 10.0E0, (id % 4) / 4.0E0) * precision_route)) END, 6) AS contribution FROM $weighed""")
q("novelty_support", "SELECT label, round(sum(best), 6) AS projected FROM (SELECT label, lineage, best, row_number() OVER (PARTITION BY label ORDER BY round(best, 9) DESC, lineage) AS r FROM (SELECT label, id % 6 AS lineage, max(least(0.55, 0.55 * precision_route)) AS best FROM $weighed WHERE coverage >= 3 AND purity >= 1 GROUP BY label, id % 6) l) t WHERE r <= 4 GROUP BY label")
LINEAGES = """SELECT own AS g, label AS o, lineage, best FROM (SELECT own, label, lineage, best, row_number() OVER (PARTITION BY own, label ORDER BY round(best, 9) DESC, lineage) AS r FROM (
 SELECT a.own, a.label, a.id % 6 AS lineage, max(least(0.55, 0.55 * greatest(0, a.cosine) * w.precision_route)) AS best FROM $affinity a JOIN $weighed w ON a.id = w.id GROUP BY a.own, a.label, a.id % 6) l) t WHERE r <= 4"""
TOTALS = f"SELECT g, o, round(sum(best), 6) AS total FROM ({LINEAGES}) l GROUP BY g, o"
q("lineage_topk", f"SELECT g, o, lineage, round(best, 6) AS best FROM ({LINEAGES}) l")
q("support_totals", TOTALS)
q("challenger_topk", f"SELECT g, o, @BIG(r) AS place FROM (SELECT g, o, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN g = o THEN 0 ELSE 1 END, total DESC, o) AS r FROM ({TOTALS}) t) c WHERE r <= 3")
q("eviction_victim", f"SELECT g, o AS victim FROM (SELECT g, o, row_number() OVER (PARTITION BY g ORDER BY total, o) AS r FROM ({TOTALS}) t WHERE g <> o) v WHERE r = 1")
q("display_gate", f"SELECT g, o, total, g % 2 = 0 AND g = o OR g % 2 = 1 AND total >= 0.775 OR g % 2 = 0 AND total >= 1.275 AS eligible FROM ({TOTALS}) t")
q("display_margin", f"SELECT g, o, total, round(total - coalesce(CASE WHEN r = 1 THEN second ELSE first END, 0), 6) AS margin FROM (SELECT g, o, total, row_number() OVER (PARTITION BY g ORDER BY total DESC, o) AS r, max(total) OVER (PARTITION BY g) AS first, lead(total) OVER (PARTITION BY g ORDER BY total DESC, o) AS second FROM ({TOTALS}) t) m",
f"SELECT a.g, a.o, a.total, round(a.total - coalesce(max(b.total), 0), 6) AS margin FROM ({TOTALS}) a LEFT JOIN ({TOTALS}) b ON a.g = b.g AND a.o <> b.o GROUP BY a.g, a.o, a.total")
q("inactive_labels", f"SELECT DISTINCT c.label FROM $centroids c LEFT JOIN (SELECT DISTINCT o FROM ({TOTALS}) t WHERE total >= 2.1) m ON c.label = m.o WHERE m.o IS NULL")
q("best_assessment", "SELECT label, id FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY round(precision_route, 9) DESC, round(CASE WHEN purity >= 1 THEN precision_route ELSE 0 END, 9) DESC, round(CASE WHEN purity >= 1 AND coverage >= 3 THEN precision_route ELSE 0 END, 9) DESC, id) AS r FROM $weighed) t WHERE r = 1")
POLICY = "SELECT a.id, a.label, a.cosine, a.own = a.label AS same, (a.id % 4) * 0.1E0 AS overlap, c.cohesion FROM $affinity a JOIN (SELECT label, min(best) AS cohesion FROM (SELECT label, id, max(cosine) AS best FROM $angles WHERE id <> other GROUP BY label, id) n GROUP BY label) c ON a.label = c.label"
q("track_score", f"""SELECT id, label, round(CASE WHEN same AND (cosine < 0.3 OR overlap < 0.1 AND cosine < 0.7) THEN -1 WHEN same THEN CASE WHEN overlap >= 0.1 THEN 2 ELSE 0.5 END + overlap + greatest(0, cosine) WHEN cosine < 0.9 THEN -1 ELSE overlap + greatest(0, cosine) END, 6) AS fixed_cosine,
 round(CASE WHEN cosine + 1e-12 < greatest(0.7, 0.8 * cohesion) THEN -1 ELSE greatest(0, cosine) END, 6) AS clean_core, round(CASE WHEN cosine + 1e-12 < 0.7 THEN -1 ELSE greatest(0, cosine) END, 6) AS pending FROM ({POLICY}) p""")
q("state_size", f"SELECT e.label, e.bytes + coalesce(l.bytes, 0) AS bytes FROM (SELECT label, @BIG(sum(8 * @SIZE(u) + 16)) AS bytes FROM $exemplars GROUP BY label) e LEFT JOIN (SELECT g, @BIG(16 * count(*)) AS bytes FROM ({LINEAGES}) l GROUP BY g) l ON e.label = l.g")
both("audio_interval_views", "SELECT id, k, round(start + CASE WHEN n > 1 THEN (#END - start - 1.5) * k / (n - 1) ELSE 0 END, 6) AS view_start FROM (SELECT t.id, t.start, t.#END, v.k, greatest(1, least(4, floor((t.#END - t.start) / 1.5))) AS n FROM $turns t JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) v ON v.k < greatest(1, least(4, floor((t.#END - t.start) / 1.5)))) x")

# Decoder output: windows' turns in seconds from the window's start, with the faults that a decoder makes
RAWTURN = """SELECT rec, tick_ms, from_ms, turn, local, (start_ms - from_ms) / 1000.0E0 + CASE WHEN (rec + turn + @DIV(tick_ms, 2000)) % 11 = 0 THEN -0.4 WHEN (rec + turn + @DIV(tick_ms, 2000)) % 13 = 0 THEN 0.1 ELSE 0 END AS s,
 (end_ms - from_ms) / 1000.0E0 + CASE WHEN (rec + turn + @DIV(tick_ms, 2000)) % 7 = 0 THEN 0.2 WHEN (rec + turn + @DIV(tick_ms, 2000)) % 17 = 0 THEN 0.5 ELSE 0 END - CASE WHEN (rec + turn + @DIV(tick_ms, 2000)) % 19 = 0 THEN (end_ms - start_ms) / 1000.0E0 ELSE 0 END AS e, (tick_ms - from_ms) / 1000.0E0 AS length FROM $revised"""
REASON = "CASE WHEN s < -0.251 OR e > length + 0.251 THEN 'outside tolerance' WHEN e <= s THEN 'no span' WHEN e < -0.001 OR s > length + 0.001 THEN 'outside window' END"
q("mapped_turns", f"SELECT rec, tick_ms, turn, {REASON} AS dropped, CASE WHEN {REASON} IS NULL THEN round(from_ms / 1000.0E0 + greatest(0, s), 6) END AS start_sec, CASE WHEN {REASON} IS NULL THEN round(from_ms / 1000.0E0 + least(length, e), 6) END AS end_sec FROM ({RAWTURN}) r")
q("drop_reasons", f"SELECT reason, @BIG(count(*)) AS n FROM (SELECT coalesce({REASON}, 'kept') AS reason FROM ({RAWTURN}) r) d GROUP BY reason")
q(
    "response_text",
    """SELECT id, sha2(coalesce(get_json_object(payload, '$.text'), concat_ws('', transform(from_json(payload, 'choices array<struct<delta:struct<content:string>,text:string,content:string>>').choices, c -> coalesce(c.delta.content, c.text, c.content)))), 256) AS body FROM (
 SELECT id, CASE id % 4 WHEN 0 THEN to_json(named_struct('text', text)) WHEN 1 THEN to_json(named_struct('choices', array(named_struct('delta', named_struct('content', substring(text, 1, 40)), 'text', 'no', 'content', 'no'))))
  WHEN 2 THEN concat('{"choices":[', to_json(named_struct('text', substring(text, 1, 40))), ',', to_json(named_struct('content', substring(text, 41, 40))), ',{"delta":{}},{"delta":{"content":"!"}}]}') ELSE '{"usage":{}}' END AS payload FROM $texts) p""",
    "SELECT id, sha256(CASE id % 4 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, 40) WHEN 2 THEN concat(substring(text, 1, 40), substring(text, 41, 40), '!') ELSE '' END) AS body FROM $texts",
)
FRAME = "SELECT id, id % 7 AS kind, CASE WHEN id % 5 = 0 THEN 8000 ELSE 16000 END AS rate, CASE WHEN id % 11 = 0 THEN 2 ELSE 1 END AS channels, id % 9 - 1 AS sequence, (id % 13) * 2666 + CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS bytes FROM $turns"
q(
    "wire_headers",
    f"""SELECT id, CASE WHEN m.type IS NULL OR m.type NOT IN ('start', 'chunk', 'eos', 'cancel') THEN 'unsupported' WHEN m.type = 'start' AND m.sample_rate <> 16000 THEN 'rate' WHEN m.type = 'start' AND m.channels <> 1 THEN 'channels' WHEN m.type = 'chunk' AND m.sequence < 0 THEN 'sequence'
 WHEN m.type = 'chunk' AND m.byte_length <= 0 THEN 'empty' WHEN m.type = 'chunk' AND m.byte_length > 32000 THEN 'too long' WHEN m.type = 'chunk' AND m.byte_length % 2 = 1 THEN 'odd' ELSE m.type END AS verdict FROM (
 SELECT id, from_json(raw, 'type string, sample_rate bigint, channels bigint, sequence bigint, byte_length bigint') AS m FROM (
 SELECT id, CASE WHEN kind = 0 THEN concat('{{"type":"start","sample_rate":', rate, ',"channels":', channels, ',"format":"pcm_s16le"}}') WHEN kind <= 3 THEN concat('{{"type":"chunk","sequence":', sequence, ',"byte_length":', bytes, '}}') WHEN kind = 4 THEN '{{"type":"eos"}}' WHEN kind = 5 THEN '{{"type":"pause"}}' ELSE '{{}}' END AS raw FROM ({FRAME}) f) j) p""",
    f"""SELECT id, CASE WHEN kind = 0 THEN CASE WHEN rate <> 16000 THEN 'rate' WHEN channels <> 1 THEN 'channels' ELSE 'start' END WHEN kind <= 3 THEN CASE WHEN sequence < 0 THEN 'sequence' WHEN bytes <= 0 THEN 'empty' WHEN bytes > 32000 THEN 'too long' WHEN bytes % 2 = 1 THEN 'odd' ELSE 'chunk' END
 WHEN kind = 4 THEN 'eos' ELSE 'unsupported' END AS verdict FROM ({FRAME}) f""",
)
q("recoverable_errors", """SELECT id, kind IN ('timeout') OR kind = 'runtime' AND (message LIKE 'failed to connect to the decoder:%' OR message LIKE 'decoder request failed with HTTP %') AS recoverable FROM (
 SELECT id, CASE id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'runtime' ELSE 'value' END AS kind, CASE id % 4 WHEN 0 THEN 'failed to connect to the decoder: refused' WHEN 1 THEN 'decoder request failed with HTTP 503' WHEN 2 THEN 'HTTP 503' ELSE 'out of memory' END AS message FROM $turns) e""",
"SELECT id, id % 3 = 0 OR id % 12 IN (1, 4) AS recoverable FROM $turns")

# Runs: one row a tick, with a wall time and a decoder that fails now and then
TRACE = "SELECT w.rec, w.tick_ms, w.stop_ms, 200 + (w.rec * 7 + @DIV(w.tick_ms, 2000) * 13) % 900 AS wall_ms, CASE WHEN (w.rec * 31 + @DIV(w.tick_ms, 2000)) % 23 = 0 THEN 1 ELSE 0 END AS recovered, CASE WHEN w.rec % 29 = 0 AND w.tick_ms = w.stop_ms THEN 1 ELSE 0 END AS failed FROM $windows w"
ROLLUP = f"""SELECT t.rec, @BIG(count(*)) AS tick_count, max(@BIG(ceil(t.stop_ms / 2000.0E0))) AS expected_tick_count, @BIG(sum(t.failed)) AS failed_ticks, @BIG(sum(t.recovered)) AS recoverable_errors, max(t.wall_ms) AS latency_max_ms, @BIG(count(t.wall_ms)) AS latency_count, @BIG(sum(t.wall_ms)) AS wall_ms, max(t.stop_ms) AS duration_ms,
 max(coalesce(p.published, 0)) AS committed, max(coalesce(p.ids, 0)) AS distinct_ids, max(coalesce(p.least_lag, 0)) AS least_lag_ms, max(coalesce(p.worst_lag, 0)) AS worst_lag_ms, max(coalesce(p.at_end, 0)) AS published_at_end, max(coalesce(s.mapped, 0)) AS mapped, max(coalesce(s.material, 0)) AS material, 4000 AS algorithmic_delay_ms
 FROM ({TRACE}) t LEFT JOIN (SELECT p.rec, @BIG(count(*)) AS published, @BIG(count(DISTINCT concat(@STR(p.start_ms), ':', @STR(p.end_ms), ':', p.text))) AS ids, min(p.seen_ms - p.end_ms) AS least_lag, max(p.seen_ms - p.end_ms) AS worst_lag, @BIG(sum(CASE WHEN p.seen_ms = w.stop_ms THEN 1 ELSE 0 END)) AS at_end
  FROM $published p JOIN (SELECT rec, max(stop_ms) AS stop_ms FROM $windows GROUP BY rec) w ON p.rec = w.rec GROUP BY p.rec) p ON t.rec = p.rec
 LEFT JOIN (SELECT rec, @BIG(count(*)) AS mapped, @BIG(sum(CASE WHEN end_ms - start_ms >= 400 THEN 1 ELSE 0 END)) AS material FROM $revised GROUP BY rec) s ON t.rec = s.rec GROUP BY t.rec"""
GATES = "failed_ticks = 0 AND tick_count = expected_tick_count AND recoverable_errors < expected_tick_count AND latency_max_ms <= 1050 AS execution_gate, committed = distinct_ids AND least_lag_ms >= 0 AS trace_gate, material = 0 OR committed > 0 AS final_content_gate"
q("validation_rollup", f"SELECT *, CASE WHEN execution_gate AND trace_gate AND final_content_gate THEN 'passed' ELSE 'failed' END AS status FROM (SELECT r.*, {GATES} FROM ({ROLLUP}) r) g")
q("publish_gate", f"SELECT rec, execution_gate AND trace_gate AND final_content_gate AND (mapped > 0) = (material > 0 OR mapped > 0) AND committed >= 0 AND latency_max_ms >= 0 AND worst_lag_ms >= 0 AND algorithmic_delay_ms >= 0 AND rec % 31 <> 0 AS publishable FROM (SELECT r.*, {GATES} FROM ({ROLLUP}) r) g")
text("final_content_gate", f"""SELECT s.rec, s.material, coalesce(p.committed, 0) AS committed, NOT s.material OR coalesce(p.committed, 0) > 0 AS passes FROM (SELECT rec, max(CASE WHEN end_ms - start_ms < 400 AND {UNITS} = 1 THEN 0 ELSE 1 END) = 1 AS material FROM $revised GROUP BY rec) s
 LEFT JOIN (SELECT rec, @BIG(count(*)) AS committed FROM $published WHERE rec % 10 <> 0 GROUP BY rec) p ON s.rec = p.rec""")
q("run_gates", f"SELECT @BIG(count(*)) AS runs, @BIG(sum(committed)) AS published, @BIG(sum(committed - distinct_ids)) AS duplicates, @BIG(sum(published_at_end)) AS novel_at_end, @BIG(max(worst_lag_ms)) AS worst_lag_ms, @BIG(sum(recoverable_errors)) AS recovered, @BIG(sum(CASE WHEN failed_ticks > 0 THEN 1 ELSE 0 END)) AS failed_runs FROM ({ROLLUP}) r")
q("rtf_weighted", f"SELECT round(sum(wall_ms) * 1.0E0 / sum(duration_ms), 9) AS rtf, @BIG(count(*)) AS completed, @BIG(sum(duration_ms)) AS audio_ms FROM ({ROLLUP}) r WHERE failed_ticks = 0 AND duration_ms > 0")
q("fully_assigned", "SELECT d.rec, @BIG(count(*)) AS unassigned FROM $dialog d LEFT JOIN (SELECT rec, turn FROM $published WHERE (rec + turn) % 17 <> 0) p ON d.rec = p.rec AND d.turn = p.turn WHERE p.rec IS NULL GROUP BY d.rec")
q("hypothesis_schema", """SELECT rec, max(CASE WHEN start_ms IS NULL OR end_ms IS NULL OR start_ms < 0 OR end_ms < start_ms OR trim(coalesce(label, '')) = '' OR text IS NULL THEN 1 ELSE 0 END) = 0 AS valid FROM (
 SELECT rec, turn, start_ms, CASE WHEN rec % 37 = 0 THEN start_ms - 1 ELSE end_ms END AS end_ms, CASE WHEN rec % 41 = 0 THEN ' ' ELSE label END AS label, text FROM $published) h GROUP BY rec""")

# Recordings
DECLARED = "SELECT rec, CASE WHEN rec % 3 = 0 THEN max(end_ms) + 500 END AS declared_ms, CASE WHEN rec % 3 = 1 OR rec % 6 = 0 THEN max(end_ms) + 250 END AS probed_ms, max(end_ms) AS reference_ms FROM $dialog GROUP BY rec"
q("duration_resolution", f"SELECT rec, coalesce(CASE WHEN declared_ms > 0 THEN declared_ms END, probed_ms, CASE WHEN reference_ms > 0 THEN reference_ms END) AS duration_ms FROM ({DECLARED}) d",
f"SELECT rec, CASE WHEN rec % 3 = 0 THEN reference_ms + 500 WHEN rec % 3 = 1 THEN reference_ms + 250 ELSE reference_ms END AS duration_ms FROM ({DECLARED}) d WHERE reference_ms > 0")
q("buffer_read", """SELECT rec, CASE WHEN wanted_from < greatest(0, stop_ms - 60000) THEN 'evicted' WHEN wanted_to > stop_ms THEN 'not available' ELSE 'read' END AS verdict, CASE WHEN wanted_from >= greatest(0, stop_ms - 60000) AND wanted_to <= stop_ms THEN (wanted_to - wanted_from) * 16 ELSE 0 END AS samples FROM (
 SELECT rec, max(stop_ms) AS stop_ms, max(stop_ms) - CASE rec % 3 WHEN 0 THEN 70000 ELSE 1000 END AS wanted_from, max(stop_ms) + CASE rec % 4 WHEN 0 THEN 10 ELSE 0 END AS wanted_to FROM $windows GROUP BY rec) w""")
q("circle_pad", "SELECT id, element_at(slice(flatten(array_repeat(x, CAST(ceil(12 / CAST(size(x) AS double)) AS int))), 1, 12), CAST(1 + id % 12 AS int)) AS sample FROM (SELECT id, slice(v, 1, 5) AS x FROM $voices) s", "SELECT id, v[1 + (id % 12) % 5] AS sample FROM $voices")
# Places without one task for all: within a bucket of names, after the sizes of the buckets before.
PLACED = "SELECT b.rec, o.before + row_number() OVER (PARTITION BY b.b ORDER BY b.rec) - 1 AS place FROM (SELECT rec, @DIV(rec, 64) AS b FROM $dialog WHERE rec % 7 <> 3 GROUP BY rec) b JOIN (SELECT b, coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT @DIV(rec, 64) AS b, count(DISTINCT rec) AS n FROM $dialog WHERE rec % 7 <> 3 GROUP BY @DIV(rec, 64)) n) o ON b.b = o.b"
q("shard_select", f"SELECT rec, @BIG(place) AS place FROM ({PLACED}) p WHERE place < 1000 AND place % 4 = 1", "SELECT rec, CAST(place AS bigint) AS place FROM (SELECT rec, row_number() OVER (ORDER BY rec) - 1 AS place FROM (SELECT DISTINCT rec FROM $dialog WHERE rec % 7 <> 3) d) s WHERE place < 1000 AND place % 4 = 1")
RECS = "SELECT DISTINCT rec FROM $dialog WHERE rec % 11 <> 0"
q("prune_sessions", f"SELECT r.rec FROM ({RECS}) r LEFT JOIN (SELECT rec FROM ({RECS}) x ORDER BY rec DESC LIMIT 8) k ON r.rec = k.rec WHERE k.rec IS NULL", f"SELECT rec FROM (SELECT rec, row_number() OVER (ORDER BY rec DESC) AS r FROM ({RECS}) d) s WHERE r > 8")
# Passages of seven words or more: found by a run of five inner words, then compared whole.
q(
    "prefix_containment",
    """SELECT DISTINCT b.item_id, t.id FROM (SELECT item_id, text, xxhash64(slice(split(text, ' '), 2, 5)) AS k FROM $benchmark WHERE size(split(text, ' ')) >= 7) b
 JOIN (SELECT id, text, explode(array_distinct(transform(sequence(1, size(p) - 4), i -> xxhash64(slice(p, i, 5))))) AS k FROM (SELECT id, text, split(text, ' ') AS p FROM $texts) s WHERE size(p) >= 5) t ON b.k = t.k AND contains(t.text, b.text)""",
    "SELECT b.item_id, t.id FROM $benchmark b JOIN $texts t ON contains(t.text, b.text) WHERE len(string_split(b.text, ' ')) >= 7",
)
q(
    "suffix_prefix_overlap",
    "SELECT rec, turn, CAST(coalesce(array_max(filter(sequence(1, 40), n -> n <= length(mine) AND n <= length(said) AND right(said, n) = left(mine, n))), 0) AS bigint) AS longest FROM (SELECT rec, turn, concat(right(said, CAST(turn % 9 AS int)), text) AS mine, said FROM (SELECT rec, turn, text, lag(text) OVER (PARTITION BY rec ORDER BY turn) AS said FROM $dialog) d WHERE said IS NOT NULL) x",
    "SELECT rec, turn, CAST(coalesce(max(n) FILTER (WHERE n <= length(mine) AND n <= length(said) AND ends_with(said, substring(mine, 1, n))), 0) AS bigint) AS longest FROM (SELECT rec, turn, concat(right(said, turn % 9), text) AS mine, said FROM (SELECT rec, turn, text, lag(text) OVER (PARTITION BY rec ORDER BY turn) AS said FROM $dialog) d WHERE said IS NOT NULL) x, range(1, 41) r(n) GROUP BY rec, turn",
)
text("containment_similarity", f"SELECT a.rec, a.turn, round(CASE WHEN x = '' OR y = '' THEN 0 WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) * 1.0E0 / greatest(length(x), length(y)) END, 6) AS similarity, CASE WHEN x = '' OR y = '' THEN false ELSE contains(x, y) OR contains(y, x) END AS contained FROM (SELECT r.rec, r.turn, r.tick_ms, r.x, d.y FROM (SELECT rec, turn, tick_ms, {NORMAL} AS x FROM $revised WHERE NOT whole) r JOIN (SELECT rec, turn, {NORMAL} AS y FROM $dialog) d ON r.rec = d.rec AND r.turn = d.turn) a")
