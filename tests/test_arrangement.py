"""Banjo parts: capo, chords, places on the neck, the roll, the tab, and edge cases."""

import pytest
from pyspark.sql import functions as F

from cadenza.operators import arrangement as ar

NOTES, TUNES = "rec long, seq long, bar long, start_tick long, pitch int", "rec long, key string, meter string, beats_per_bar int"


def part(spark, pitches, key="G major", meter="4/4", beats=4, step=960, **how):
    """Quarter notes (None: rest) as a part, in order."""
    per = beats * 960 // step
    notes = spark.createDataFrame([(1, i, i // per, i * step, p) for i, p in enumerate(pitches)], NOTES)
    tunes = spark.createDataFrame([(1, key, meter, beats)], TUNES)
    return ar.arrange(notes, tunes, **how), tunes


def test_capo(spark):
    keys = {"G major": 0, "A major": 2, "A mixolydian": 2, "C major": 5, "D major": 0, "B- major": 3, "nothing": 0, None: 0}
    got = spark.createDataFrame(list(enumerate(keys)), "i int, key string").select("key", ar.capo(F.col("key")).alias("capo")).collect()
    assert {r.key: r.capo for r in got} == keys


@pytest.mark.parametrize("capo", [0, 2, 5])
def test_every_pitch_has_the_lowest_fret(spark, capo):
    got = spark.range(20, 110).select(F.col("id").cast("int").alias("p")).select("p", ar.fingered(F.col("p"), F.lit(capo)).alias("x")).collect()
    for p, (string, fret) in got:
        sounds = ar.OPEN[string - 1] + capo + fret
        assert 1 <= string <= 4 and 0 <= fret <= 12 and (sounds - p) % 12 == 0
        if 50 + capo <= p <= 74 + capo:
            assert sounds == p and fret == min(p - o - capo for o in ar.OPEN[:4] if 0 <= p - o - capo <= 12)
        else:
            assert abs(sounds - (50 + capo if p < 50 + capo else 74 + capo)) < 12


def test_part_is_an_unbroken_playable_stream(spark):
    got, _ = part(spark, [67, 69, 71, 72, 74, None, 71, 69, 67, 66, 64, 62, 91, 67, 67, 67])
    rows = got.orderBy("start_tick").collect()
    assert [r.start_tick for r in rows] == [i * 480 for i in range(32)] and {r.dur_tick for r in rows} == {480}
    assert all(r.pitch == ar.OPEN[r.string - 1] + r.fret and 0 <= r.fret <= 12 for r in rows)
    assert all(r.fret == 0 and not r.melody for r in rows if r.string == 5) and any(r.string == 5 for r in rows)
    sung = [r.pitch for r in rows if r.melody]
    assert sung[:5] == [55, 57, 59, 60, 62] and len(sung) == 15 and (sung[11] - 91) % 12 == 0
    assert ar.melody_share(got).head().share == pytest.approx(15 / 32)


def test_filler_is_of_the_chord_of_the_bar(spark):
    got, _ = part(spark, [69, 73, 76, 69, 62, 66, 69, 62], key="D major", vary=False)
    rows = got.where("not melody and string < 5").collect()
    assert {r.pitch % 12 for r in rows if r.bar == 0} <= {9, 1, 4} and {r.pitch % 12 for r in rows if r.bar == 1} <= {2, 6, 9}
    assert all(r.string == ar.ROLLS["forward"][r.slot] for r in rows)


def test_rolls_take_turns_and_first_notes_win(spark):
    notes = spark.createDataFrame([(1, 1, 0, 10, 60), (1, 0, 0, 0, 55), (1, 2, 0, 3840, 59), (1, 0, 3, 3 * 3840, None), (2, 0, 0, 0, 60)], NOTES)
    tunes = spark.createDataFrame([(1, "G major", "4/4", 4), (2, "G major", "0/4", 0), (3, "G major", "4/4", 4)], TUNES)
    rows = ar.arrange(notes, tunes).collect()
    assert {(r.rec, r.bar) for r in rows} == {(1, 0), (1, 3)} and [(r.slot, r.pitch) for r in rows if r.melody] == [(0, 55)]
    assert [r.string for r in sorted(rows, key=lambda r: r.slot) if r.bar == 3] == list(ar.ROLLS["alternating_thumb"])


def test_tab(spark):
    got, tunes = part(spark, [55, 62, 74, 50], vary=False)
    text = ar.tablature(got, tunes).head().text.split("\n")
    assert text[:2] == ["Banjo arrangement -- G major, 4/4, open-G tuning, capo 0", ""]
    assert text[2].startswith("D|") and [len(x) for x in text[2:7]] == [2 + 8 * 3 + 1] * 5 and [x[:2] for x in text[2:8]] == ["D|", "B|", "G|", "D|", "g|", "  "]
    assert text[7].split() == ["T", "i", "M", "t", "M", "i", "T", "t"]
    # every slot sounds on one string, the twelfth fret takes both places
    assert all(sum(text[2 + s][2 + 3 * i] != "-" for s in range(5)) == 1 for i in range(8)) and text[2][2 + 12 : 2 + 15] == "12-"
    assert text[-2:] == ["uppercase finger = melody note, lowercase = roll filler", "T = thumb, I = index, M = middle"]


def test_lines_have_four_bars_and_nothing_makes_nothing(spark):
    got, tunes = part(spark, [60] * 4 * 9)
    assert sorted((r.block, r.lines[0].count("|")) for r in ar.tablature_lines(got).collect()) == [(0, 5), (1, 5), (2, 2)]
    none, tunes = part(spark, [None] * 4)
    assert none.where("melody").count() == 0 and none.count() == 8
    assert ar.arrange(spark.createDataFrame([], NOTES), tunes).count() == 0


def test_own_capo(spark):
    _, tunes = part(spark, [64])
    notes = spark.createDataFrame([(1, 0, 0, 0, 64)], NOTES)
    with_capo = tunes.withColumn("capo", F.lit(4))
    row = ar.arrange(notes, with_capo).where("melody").head()
    assert row.pitch % 12 == 4 and row.pitch == ar.OPEN[row.string - 1] + 4 + row.fret
    assert "capo 4" in ar.tablature(ar.arrange(notes, with_capo), with_capo).head().text
