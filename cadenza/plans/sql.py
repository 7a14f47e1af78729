"""DuckDB SQL for the registered queries."""

_FRAMES = """f AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame,
  CASE WHEN event_type <> 'error' THEN CAST(55 + CAST(floor(value) AS BIGINT) % 46 AS DOUBLE) END AS midi, value / 500 AS conf FROM events)"""
_RUNS = """r AS (SELECT *, midi IS NOT NULL AS v, row_number() OVER (PARTITION BY rec ORDER BY frame) - row_number() OVER (PARTITION BY rec, midi IS NOT NULL ORDER BY frame) AS g FROM f)"""
_NOTES = """e AS (SELECT *, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS s FROM events WHERE event_type <> 'error'),
n AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS seq, CAST(55 + CAST(floor(value) AS BIGINT) % 46 AS INTEGER) AS pitch,
  (s - min(s) OVER (PARTITION BY user_id)) / 60 AS beat, value / 100 AS dur, value / 500 AS conf FROM e)"""
_BLOCKS = _NOTES + ", b AS (SELECT rec, seq, pitch, conf, seq // 8 AS block, CAST(seq % 8 AS DOUBLE) * 0.75::DOUBLE AS start, dur FROM n)"
_SLOTS = (
    _BLOCKS
    + """, sp AS (SELECT *, greatest(0, CAST(round_even(start * 2, 0) AS INTEGER)) AS i0, CAST(round_even((start + dur) * 2, 0) AS INTEGER) AS ie FROM b),
sq AS (SELECT *, least(12, greatest(i0 + 1, ie)) AS i1 FROM sp),
sl AS (SELECT rec, block, CAST(slot AS INTEGER) AS slot, arg_max(pitch, seq) AS pitch FROM (SELECT *, unnest(range(i0, i1)) AS slot FROM sq WHERE i0 < i1) GROUP BY rec, block, slot)"""
)
_ROLES = "ro AS (SELECT conv_id AS owner, turn AS seq, substr(role, 1, 1) AS label FROM conversations)"
_RLE = (
    _ROLES
    + """, ch AS (SELECT *, CASE WHEN lag(label) OVER w IS NULL OR lag(label) OVER w <> label THEN 1 ELSE 0 END AS c FROM ro WINDOW w AS (PARTITION BY owner ORDER BY seq)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY owner ORDER BY seq) AS run FROM ch),
rl AS (SELECT owner, CAST(run AS BIGINT) AS run, any_value(label) AS label, count(*) AS n FROM rn GROUP BY owner, run)"""
)
_PC = """pw AS (SELECT rec, pitch % 12 AS pc, sum(dur * greatest(0.1::DOUBLE, conf)) AS weight FROM n GROUP BY ALL), pc AS (SELECT *, weight / sum(weight) OVER (PARTITION BY rec) AS share FROM pw)"""
_LAGS = "lg AS (SELECT unnest(range(5, 60, 5)) AS lag)"
_GRAM = "SELECT {o} AS owner, unnest(list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])) AS g FROM (SELECT {o}, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM {t})"

SQL = {
    "voiced_runs": f"WITH {_FRAMES}, {_RUNS} SELECT rec, min(frame) AS run_start, max(frame) + 1 AS run_end, count(*) AS n FROM r WHERE v GROUP BY rec, g",
    "pitch_scale": "SELECT event_id, round(m, 9) AS midi, round(440 * pow(2, (m - 69) / 12), 9) AS hz FROM (SELECT event_id, CASE WHEN value - 50 > 0 THEN 69 + 12 * log2((value - 50) / 440) END AS m FROM events)",
    "gated": f"WITH {_FRAMES} SELECT rec, frame, CASE WHEN conf >= 0.1 AND midi BETWEEN 60 AND 90 THEN midi END AS midi FROM f",
    "normalized_confidence": f"WITH {_FRAMES}, t AS (SELECT rec, quantile_cont(conf, 0.95) FILTER (WHERE conf > 0) AS top FROM f GROUP BY rec) SELECT rec, frame, round(CASE WHEN top > 1e-9 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, conf / top)) ELSE 0.0 END, 9) AS conf FROM f JOIN t USING (rec)",
    "jump_gate": f"""WITH {_FRAMES}, v AS (SELECT *, lag(midi) OVER w AS a, lead(midi) OVER w AS c, lag(frame) OVER w AS fa, lead(frame) OVER w AS fc FROM f WHERE midi IS NOT NULL WINDOW w AS (PARTITION BY rec ORDER BY frame)),
x AS (SELECT *, coalesce(frame - fa <= 3 AND fc - frame <= 3 AND abs(midi - a) > 6 AND abs(c - midi) > 6 AND abs(c - a) < 0.5 * abs(midi - a), false) AS x FROM v),
g AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY frame) - row_number() OVER (PARTITION BY rec, x ORDER BY frame) AS g FROM x),
p AS (SELECT rec, frame, x, row_number() OVER (PARTITION BY rec, x, g ORDER BY frame) AS p FROM g)
SELECT f.rec, f.frame, CASE WHEN x AND p % 2 = 1 THEN NULL ELSE midi END AS midi FROM f LEFT JOIN p ON p.rec = f.rec AND p.frame = f.frame""",
    "rolling_median": f"""WITH {_FRAMES}, e AS (SELECT rec, min(frame) AS lo, max(frame) AS hi FROM f GROUP BY rec),
p AS (SELECT rec, frame, midi, false AS pad FROM f UNION ALL SELECT f.rec, f.frame - k, midi, true FROM f JOIN e ON e.rec = f.rec AND f.frame = e.lo, range(1, 5) t(k) UNION ALL SELECT f.rec, f.frame + k, midi, true FROM f JOIN e ON e.rec = f.rec AND f.frame = e.hi, range(1, 5) t(k)),
m AS (SELECT *, quantile_cont(midi, 0.5) OVER (PARTITION BY rec ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS median FROM p)
SELECT rec, frame, median FROM m WHERE NOT pad""",
    "octave_correction": f"""WITH {_FRAMES}, e AS (SELECT rec, min(frame) AS lo, max(frame) AS hi FROM f GROUP BY rec),
p AS (SELECT rec, frame, midi, conf, false AS pad FROM f UNION ALL SELECT f.rec, f.frame - k, midi, conf, true FROM f JOIN e ON e.rec = f.rec AND f.frame = e.lo, range(1, 7) t(k) UNION ALL SELECT f.rec, f.frame + k, midi, conf, true FROM f JOIN e ON e.rec = f.rec AND f.frame = e.hi, range(1, 7) t(k)),
m AS (SELECT *, quantile_cont(midi, 0.5) OVER (PARTITION BY rec ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS med FROM p),
s AS (SELECT *, CASE WHEN abs(midi - med - 12) < 1.5 THEN -12.0 WHEN abs(midi - med + 12) < 1.5 THEN 12.0 ELSE 0.0 END::DOUBLE AS sh FROM m WHERE NOT pad)
SELECT rec, frame, midi + sh AS midi, round(CASE WHEN sh <> 0 THEN conf * 0.85::DOUBLE ELSE conf END, 9) AS conf FROM s""",
    "fill_gaps": f"""WITH {_FRAMES}, {_RUNS}, k AS (SELECT *, count(*) OVER (PARTITION BY rec, v, g) AS n, row_number() OVER (PARTITION BY rec, v, g ORDER BY frame) - 1 AS i,
  last_value(midi IGNORE NULLS) OVER b AS l, first_value(midi IGNORE NULLS) OVER a AS rr, last_value(CASE WHEN v THEN conf END IGNORE NULLS) OVER b AS lc, first_value(CASE WHEN v THEN conf END IGNORE NULLS) OVER a AS rc
  FROM r WINDOW b AS (PARTITION BY rec ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY rec ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
q AS (SELECT *, coalesce(NOT v AND n <= 5 AND abs(rr - l) <= 8, false) AS fills FROM k)
SELECT rec, frame, round(CASE WHEN fills THEN l + i * CASE WHEN n > 1 THEN (rr - l) / (n - 1) ELSE 0.0 END ELSE midi END, 9) AS midi, round(CASE WHEN fills THEN 0.8::DOUBLE * least(lc, rc) ELSE conf END, 9) AS conf FROM q""",
    "note_features": f"""WITH {_FRAMES}, {_RUNS}, p AS (SELECT *, count(*) OVER (PARTITION BY rec, g) AS n, row_number() OVER (PARTITION BY rec, g ORDER BY frame) - 1 AS i FROM r WHERE v),
c AS (SELECT *, CASE WHEN n - floor(n * 0.12::DOUBLE) < 3 OR i >= floor(n * 0.12::DOUBLE) THEN midi END AS core FROM p),
m AS (SELECT rec, g, quantile_cont(core, 0.5) AS pitch FROM c GROUP BY rec, g)
SELECT c.rec, min(frame) AS run_start, max(frame) + 1 AS run_end, round(any_value(pitch), 9) AS pitch, round(100 * quantile_cont(abs(core - pitch), 0.9), 9) AS spread_cents, round(avg(conf), 9) AS conf FROM c JOIN m ON m.rec = c.rec AND m.g = c.g GROUP BY c.rec, c.g""",
    "presence": f"""WITH {_FRAMES}, c AS (SELECT rec, CAST(round_even(midi, 0) AS INTEGER) AS p, count(*) AS n FROM f WHERE midi IS NOT NULL GROUP BY ALL),
m AS (SELECT rec, p AS modal_pitch, n / sum(n) OVER (PARTITION BY rec) AS share, row_number() OVER (PARTITION BY rec ORDER BY n DESC, p) AS k FROM c),
w AS (SELECT rec, quantile_cont(midi, 0.75) - quantile_cont(midi, 0.25) AS iqr, avg(CASE WHEN midi IS NULL THEN 0 ELSE 1 END) AS vf FROM f GROUP BY rec)
SELECT w.rec, modal_pitch, round(share, 9) AS modal_share, round(iqr, 9) AS iqr, round(vf, 9) AS voiced_fraction FROM w LEFT JOIN m ON m.rec = w.rec AND k = 1""",
    "repetition": f"""WITH {_FRAMES}, {_LAGS}, d AS (SELECT a.rec, lag, abs(a.midi - b.midi) AS d FROM f a, lg JOIN f b ON b.rec = a.rec AND b.frame = a.frame + lag WHERE a.midi IS NOT NULL AND b.midi IS NOT NULL),
s AS (SELECT rec, lag, avg(CASE WHEN d < 0.6 OR abs(d - 12) < 0.6 THEN 1.0 ELSE 0.0 END) AS sim FROM d GROUP BY rec, lag HAVING count(*) >= 10),
b AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY sim DESC, lag) AS k, quantile_cont(sim, 0.5) OVER (PARTITION BY rec) AS base FROM s)
SELECT rec, CAST(lag AS INTEGER) AS lag, round(sim, 9) AS similarity, round(base, 9) AS baseline, round(sim - base, 9) AS excess FROM b WHERE k = 1""",
    "quantized": f"""WITH {_NOTES}, q AS (SELECT *, CAST(round_even(4 * beat, 0) AS BIGINT) AS q0 FROM n), u AS (SELECT *, max(q0 - seq) OVER (PARTITION BY rec ORDER BY seq) + seq AS q FROM q)
SELECT rec, seq, q, coalesce(lead(q) OVER (PARTITION BY rec ORDER BY seq) - q, greatest(1, CAST(round_even(4 * dur, 0) AS BIGINT))) AS q_dur FROM u""",
    "nearest_duration": """WITH d AS (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0])::DOUBLE AS d), c AS (SELECT event_id, d, abs(greatest(value / 100, 0.25::DOUBLE) - d) + CASE WHEN d IN (0.75, 1.5, 3.0) THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END AS cost FROM events, d)
SELECT event_id, d AS dur FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY cost, d) AS k FROM c) WHERE k = 1""",
    "on_beats": f"""WITH {_NOTES}, b0 AS (SELECT rec, seq // 3 AS beat_idx, beat AS t FROM n WHERE seq % 3 = 1), b AS (SELECT rec, t, beat_idx, lead(t) OVER (PARTITION BY rec ORDER BY t) AS nxt FROM b0),
p AS (SELECT rec, quantile_cont(nxt - t, 0.5) AS period, min(t) AS t0, arg_min(beat_idx, t) AS i0, max(t) AS t1, arg_max(beat_idx, t) AS i1 FROM b GROUP BY rec),
q AS (SELECT DISTINCT rec, beat AS t FROM n), j AS (SELECT q.rec, q.t, b.beat_idx, b.t AS bt, b.nxt FROM q ASOF LEFT JOIN b ON q.rec = b.rec AND q.t >= b.t)
SELECT j.rec, round(j.t, 9) AS t, round(coalesce(beat_idx + (j.t - bt) / (nxt - bt), CASE WHEN j.t < t0 THEN i0 + (j.t - t0) / period ELSE i1 + (j.t - t1) / period END, j.t), 9) AS beat FROM j LEFT JOIN p ON p.rec = j.rec""",
    "folded_tempo": f"""WITH {_NOTES}, t AS (SELECT rec, CAST(30 + count(*) * 7 % 500 AS DOUBLE) AS tempo FROM n GROUP BY rec), x AS (SELECT rec, tempo, f, row_number() OVER (PARTITION BY rec ORDER BY abs(log2(tempo * f / 120)), f) AS k FROM t, (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0])::DOUBLE AS f) WHERE tempo * f BETWEEN 90 AND 260)
SELECT t.rec, t.tempo, coalesce(f, 1.0) AS factor, t.tempo * coalesce(f, 1.0) AS folded FROM t LEFT JOIN x ON x.rec = t.rec AND k = 1""",
    "meter_phase": f"WITH {_NOTES}, m AS (SELECT rec, seq % 4 AS phase, avg(conf) AS s FROM n GROUP BY ALL) SELECT rec, phase, round(s, 9) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s DESC, phase) AS k FROM m) WHERE k = 1",
    "tune_start": f"WITH {_NOTES}, t AS (SELECT rec, CAST(round_even(beat * 960, 0) AS BIGINT) AS tick FROM n), c AS (SELECT *, count(*) OVER (PARTITION BY rec ORDER BY tick RANGE BETWEEN CURRENT ROW AND 575999 FOLLOWING) AS k FROM t) SELECT rec, coalesce(min(tick) FILTER (WHERE k >= 4), min(tick)) AS start_tick FROM c GROUP BY rec",
    "slots": f"WITH {_SLOTS} SELECT rec, block, slot, pitch FROM sl",
    "consensus_vote": f"""WITH {_SLOTS}, w AS (SELECT rec, block, greatest(0.05::DOUBLE, avg(conf)) AS weight FROM b GROUP BY ALL), s AS (SELECT sl.*, weight FROM sl JOIN w ON w.rec = sl.rec AND w.block = sl.block),
c AS (SELECT rec, slot, pitch % 12 AS pc, sum(weight) AS w, min(block) AS b FROM s GROUP BY ALL), k AS (SELECT *, w / sum(w) OVER (PARTITION BY rec, slot) AS agreement, row_number() OVER (PARTITION BY rec, slot ORDER BY w DESC, b) AS k FROM c),
o AS (SELECT rec, slot, pitch, pitch % 12 AS pc, sum(weight) AS w, min(block) AS b FROM s GROUP BY ALL), p AS (SELECT o.rec, o.slot, pitch, agreement, row_number() OVER (PARTITION BY o.rec, o.slot ORDER BY o.w DESC, o.b) AS r FROM o JOIN k ON k.rec = o.rec AND k.slot = o.slot AND k.pc = o.pc AND k.k = 1)
SELECT rec, slot, pitch, round(agreement, 9) AS agreement FROM p WHERE r = 1""",
    "block_similarity": f"""WITH {_SLOTS}, s AS (SELECT * FROM sl), z AS (SELECT rec, block, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT x.rec, x.block AS i, y.block AS j, sum(CASE WHEN x.pitch = y.pitch THEN 1.0::DOUBLE WHEN abs(x.pitch - y.pitch) % 12 = 0 THEN 0.6::DOUBLE ELSE 0 END) AS agree FROM s x JOIN s y ON x.rec = y.rec AND x.slot = y.slot AND x.block < y.block GROUP BY ALL)
SELECT m.rec, i, j, round(agree / n, 9) AS similarity FROM m JOIN z ON z.rec = m.rec AND z.block = m.i""",
    "pitch_classes": f"WITH {_NOTES}, {_PC} SELECT rec, pc, round(weight, 9) AS weight, round(share, 9) AS share FROM pc",
    "key_topk": f"""WITH {_NOTES}, {_PC}, md AS (SELECT * FROM (VALUES (0, 'major', [0, 2, 4, 5, 7, 9, 11], 1.0), (1, 'mixolydian', [0, 2, 4, 5, 7, 9, 10], 0.7), (2, 'dorian', [0, 2, 3, 5, 7, 9, 10], 0.55), (3, 'minor', [0, 2, 3, 5, 7, 8, 10], 0.4)) AS v(m, mode, steps, mp)),
tn AS (SELECT t AS tonic, CASE t WHEN 2 THEN 1.0 WHEN 9 THEN 0.95 WHEN 7 THEN 0.85 WHEN 0 THEN 0.6 WHEN 4 THEN 0.4 WHEN 5 THEN 0.3 WHEN 10 THEN 0.25 ELSE 0.2 END AS tp FROM range(12) r(t)),
l AS (SELECT rec, arg_max(pitch, seq) % 12 AS last FROM n GROUP BY rec),
k AS (SELECT l.rec, CAST(tonic AS INTEGER) AS tonic, mode, tonic * 4 + m AS k, tp::DOUBLE * mp::DOUBLE AS prior, last, steps FROM l, md, tn),
s AS (SELECT k.rec, k.tonic, k.mode, k.k, coalesce(sum(share) FILTER (WHERE list_contains(list_transform(steps, lambda x: (k.tonic + x) % 12), pc)), 0) + 1.6::DOUBLE * coalesce(sum(share) FILTER (WHERE pc = k.tonic), 0) + 0.5::DOUBLE * coalesce(sum(share) FILTER (WHERE pc = (k.tonic + 7) % 12), 0)
  + CASE WHEN last = k.tonic THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END + 0.15::DOUBLE * prior AS score FROM k JOIN pc ON pc.rec = k.rec GROUP BY k.rec, k.tonic, k.mode, k.k, last, prior)
SELECT rec, tonic, mode, round(score, 9) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY round(score, 9) DESC, k) AS r FROM s) WHERE r <= 5""",
    "interval_idf": f"""WITH {_NOTES}, i AS (SELECT rec, seq, greatest(-12, least(12, lead(pitch) OVER (PARTITION BY rec ORDER BY seq) - pitch)) AS x, lead(pitch) OVER (PARTITION BY rec ORDER BY seq) IS NOT NULL AS ok FROM n),
g AS (SELECT rec, x || ' ' || lead(x) OVER (PARTITION BY rec ORDER BY seq) AS g FROM i WHERE ok) SELECT g, round(ln(1 + (SELECT count(DISTINCT rec) FROM g WHERE g IS NOT NULL) / count(DISTINCT rec)), 9) AS idf FROM g WHERE g IS NOT NULL GROUP BY g""",
    "identify": f"""WITH c AS ({_GRAM.format(o="item_id", t="benchmark")}), o AS ({_GRAM.format(o="doc_id", t="documents")}), df AS (SELECT g, ln(1 + (SELECT count(DISTINCT owner) FROM c) / count(DISTINCT owner)) AS idf FROM c GROUP BY g),
w AS (SELECT owner, c.g, idf FROM c JOIN df ON df.g = c.g), t AS (SELECT owner, sum(idf) AS whole FROM w GROUP BY owner), m AS (SELECT o.owner AS rec, w.owner AS tune, sum(idf) AS met FROM w JOIN o ON o.g = w.g GROUP BY ALL),
v AS (SELECT rec, tune, round(met / whole, 9) AS cov FROM m JOIN t ON t.owner = m.tune), r AS (SELECT *, row_number() OVER k AS rank, cov - coalesce(lead(cov) OVER k, 0) AS margin FROM v WINDOW k AS (PARTITION BY rec ORDER BY cov DESC, tune))
SELECT rec, tune, round(cov, 9) AS coverage, CAST(rank AS INTEGER) AS rank, round(margin, 9) AS margin FROM r WHERE rank <= 3""",
    "auc": """WITH s AS (SELECT lang AS grp, n_chars AS score, toxic = 1 AS pos FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2 AS r FROM s)
SELECT grp, round(CASE WHEN count(*) FILTER (WHERE pos) > 0 AND count(*) FILTER (WHERE NOT pos) > 0 THEN (sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)) ELSE 0.5 END, 9) AS auc FROM r GROUP BY grp""",
    "calibration": """SELECT lang, round(count(*) FILTER (WHERE n_chars < 800 AND quality = 0) / nullif(count(*) FILTER (WHERE n_chars < 800), 0), 9) AS flag_precision, round(count(*) FILTER (WHERE n_chars < 800 AND quality = 0) / nullif(count(*) FILTER (WHERE quality = 0), 0), 9) AS flag_recall,
  round(avg(n_chars) FILTER (WHERE quality = 0), 9) AS mean_wrong, round(avg(n_chars) FILTER (WHERE quality <> 0), 9) AS mean_right FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
    "run_lengths": f"WITH {_RLE} SELECT owner, run, label, n FROM rl",
    "repeat_structure": f"WITH {_RLE}, k AS (SELECT *, max(run) OVER (PARTITION BY owner) AS runs FROM rl) SELECT owner, round(avg(CASE n WHEN 1 THEN 0.35 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 WHEN 4 THEN 0.15 ELSE 0.10 END::DOUBLE), 9) AS score FROM k WHERE runs <= 2 OR run < runs GROUP BY owner",
    "reduced_form": f"WITH {_ROLES}, fo AS (SELECT owner, string_agg(label, '' ORDER BY seq) AS form FROM ro GROUP BY owner) SELECT owner, form, substr(form, 1, CAST(list_min([k FOR k IN range(1, len(form) + 1) IF len(form) % k = 0 AND repeat(substr(form, 1, CAST(k AS INTEGER)), CAST(len(form) // k AS INTEGER)) = form]) AS INTEGER)) AS unit FROM fo",
    "sequence_similarity": f"WITH {_BLOCKS}, s AS (SELECT rec, block, string_agg(chr(pitch), '' ORDER BY seq) AS s FROM b GROUP BY ALL) SELECT x.rec, x.block, round(1 - levenshtein(x.s, y.s) / greatest(len(x.s), len(y.s)), 9) AS similarity FROM s x JOIN s y ON y.rec = x.rec AND y.block = x.block + 1",
    "spectrum_entropy": """WITH b AS (SELECT vec_id AS owner, (i - 1 + 21) % 12 AS pc, sum(greatest(CAST(embedding[i] AS DOUBLE), 0)) AS w FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL), p AS (SELECT *, w / nullif(sum(w) OVER (PARTITION BY owner), 0) AS p FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY p DESC NULLS LAST, pc) AS r FROM p) SELECT owner, round(sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END), 9) AS bits, round(coalesce(sum(p) FILTER (WHERE r <= 2), 0), 9) AS top2 FROM r GROUP BY owner""",
    "octave_shift": f"""WITH {_NOTES}, s AS (SELECT rec, shift, list_min(list_filter([pitch + shift - 50, pitch + shift - 55, pitch + shift - 59, pitch + shift - 62], lambda x: x BETWEEN 0 AND 12)) AS fret FROM n, (SELECT unnest([-24, -12, 0, 12]) AS shift)),
w AS (SELECT rec, shift, sum(CASE WHEN fret <= 7 THEN 2 WHEN fret IS NOT NULL THEN 1 ELSE 0 END) AS worth FROM s GROUP BY ALL) SELECT rec, shift, CAST(worth AS BIGINT) AS worth FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY worth DESC, shift) AS k FROM w) WHERE k = 1""",
}
