import random
import struct

from cadenza.operators import segments
from cadenza.sources import export
from cadenza.sources.export import read_musicxml


def test_onsets_cut_long_notes_only(spark):
    spans = spark.createDataFrame([(1, 0, 300), (1, 310, 325), (2, 0, 300)], "rec long, run_start long, run_end long")
    onsets = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 1.05), (1, 2.0), (1, 3.15), (1, None), (2, 0.05), (2, 2.95)], "rec long, t double")
    got = sorted((r.rec, r.note_start, r.note_end) for r in segments.cut_at_onsets(spans, onsets, 0.01, 0.10).collect())
    assert got == [(1, 0, 100), (1, 100, 200), (1, 200, 300), (1, 310, 325), (2, 0, 300)]
    assert segments.cut_at_onsets(spans, onsets.limit(0), 0.01, 0.10).count() == 3
    assert segments.least_length(0.5) == 0.225 and segments.least_length() == 0.10


def test_dropouts_join_in_order(spark):
    random.seed(4)
    rows, t = [], 0.0
    for _ in range(400):
        d = random.choice([0.0625, 0.125, 0.5])
        rows.append((1, t, t + d, 60.4 + random.choice([0, 0.2, 0.7]), random.random(), random.random() * 9, 1.0))
        t += d + random.choice([0.0, 0.015625, 0.015625, 0.25])
    kept = [list(rows[0])]
    for n in rows[1:]:
        p = kept[-1]
        if 0 < n[1] - p[2] <= 0.03 and round(p[3]) == round(n[3]):
            a, b = p[2] - p[1], n[2] - n[1]
            kept[-1] = [1, p[1], n[2], (p[3] * a + n[3] * b) / (a + b), (p[4] * a + n[4] * b) / (a + b), max(p[5], n[5]), 1.0]
        else:
            kept.append(list(n))
    df = spark.createDataFrame(rows, "rec long, start double, end double, pitch double, conf double, spread double, voiced double")
    got = [list(r) for r in segments.join_dropouts(df).orderBy("start").collect()]
    assert len(got) == len(kept) < len(rows) and all(abs(x - y) < 1e-9 for a, b in zip(got, kept, strict=True) for x, y in zip(a, b, strict=True))


def test_intruders_go_and_fast_passages_stay(spark):
    def run(durs, pitches):
        df = spark.createDataFrame([(1, i, p, d) for i, (p, d) in enumerate(zip(pitches, durs, strict=True))], "rec long, seq long, pitch int, dur double")
        return [(r.pitch, r.dur) for r in segments.absorb_intruders(df, 0.5).orderBy("seq").collect()]

    assert run([1.0, 1.0, 0.25, 1.0, 1.0], [60, 62, 50, 62, 64]) == [(60, 1.0), (62, 1.25), (62, 1.0), (64, 1.0)]
    assert run([1.0, 1.0, 0.25, 1.0, 1.0], [60, 62, 62, 62, 64])[2] == (62, 0.25)
    assert len(run([0.25] * 6, [60, 62, 64, 65, 67, 69])) == 6
    assert len(run([1.0, 0.1], [60, 50])) == 2


def heard(content):
    """(pitch, start, length) of a file's notes, its division and its tempo."""
    assert content[:4] == b"MThd" and content[14:18] == b"MTrk" and struct.unpack(">I", content[18:22])[0] == len(content) - 22
    at, now, notes, on, tempo = 22, 0, [], {}, None
    while at < len(content):
        d = 0
        while True:
            b, at = content[at], at + 1
            d = d << 7 | b & 127
            if b < 128:
                break
        now += d
        if content[at] == 255:
            tempo = int.from_bytes(content[at + 3 : at + 6], "big") if content[at + 1] == 0x51 else tempo
            at += 3 + content[at + 2]
        else:
            kind, pitch = content[at] >> 4, content[at + 1]
            at += 3
            if kind == 9:
                on[pitch] = now
            else:
                notes.append((pitch, on[pitch], now - on.pop(pitch)))
    return sorted(notes), struct.unpack(">H", content[12:14])[0], tempo


def test_midi_is_read_back(spark):
    rows = [(1, 0, 960, 60), (1, 960, 240, 60), (1, 1200, 480, None), (1, 3_000_000, 40_000, 127), (1, 3_050_000, 1, 0)]
    notes = spark.createDataFrame(rows, "rec long, start_tick long, dur_tick long, pitch int")
    tunes = spark.createDataFrame([(1, 120.0), (2, 90.0)], "rec long, tempo double")
    got = {r.rec: heard(bytes(r.content)) for r in export.midi_file(notes, tunes).collect()}
    assert got[1] == (sorted((p, s, d) for _, s, d, p in rows if p is not None), 960, 500_000) and got[2] == ([], 960, 666_667)


def test_musicxml_is_read_back(spark, tmp_path):
    rows = [(1, s, m, i, p, d) for s, m, i, p, d in [("A", 0, 0, 61, 1920), ("A", 0, 1, None, 1920), ("A", 1, 2, 71, 960), ("B", 2, 3, 36, 240), ("B", 2, 4, 85, 3600)]]
    notes = spark.createDataFrame(rows, "rec long, section string, measure long, seq long, pitch int, dur_tick long")
    for sharps in (2, -3):
        tunes = spark.createDataFrame([(1, "a < b & c", 4, sharps, 2)], "rec long, title string, beats int, sharps int, repeats int")
        (row,) = export.musicxml_text(notes, tunes).collect()
        path = tmp_path / f"tune{sharps}.musicxml"
        path.write_text(row.text)
        got = [(r.section, r.measure, r.pitch, r.dur_tick) for r in read_musicxml(spark, str(path)).orderBy("section", "measure", "seq").collect()]
        assert got == [(0, 1, 61, 1920), (0, 1, None, 1920), (0, 2, 71, 960), (1, 1, 36, 240), (1, 1, 85, 3600)]
        assert row.text.count("<time>") == 3 and "a &lt; b &amp; c" in row.text
