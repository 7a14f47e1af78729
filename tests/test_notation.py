"""Notation as it sounds, and the tunes that a catalog takes."""

import pytest
from pyspark.sql import functions as F

from cadenza import sources
from cadenza.sources import notation

HEAD = "X:1\nT:One\nM:4/4\nL:1/8\nK:%s\n"


def read(spark, *texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, tune long, text string")


def pitches(spark, text):
    return [r.pitch for r in notation.sounding_notes(read(spark, text)).orderBy("section", "seq").collect()]


def test_signature_and_signs_of_the_bar(spark):
    assert pitches(spark, HEAD % "D" + "FcB =ccC ^g|cgf_b|") == [66, 73, 71, 72, 72, 61, 80, 73, 79, 78, 82]
    assert pitches(spark, HEAD % "Eb" + "ABE F2 z") == [68, 70, 63, 65, None]
    assert pitches(spark, HEAD % "Ador" + "fcg") == [78, 72, 79] and pitches(spark, HEAD % "Bm" + "fcg") == [78, 73, 79]


@pytest.mark.parametrize(("field", "name"), [("AMix", "A mixolydian"), ("Bm", "B minor"), ("Eb Dorian", "E- dorian"), ("F#min", "F# minor"), ("G", "G major"), ("", "D major"), ("C maj", "C major"), ("Dphr", "D major")])
def test_key_fields(spark, field, name):
    assert spark.range(1).select(notation.key_of(F.lit(field))).head()[0] == name


def test_sections_bars_and_lengths(spark):
    text = HEAD % "D" + "R:reel\nP:A\na2 fa gfef|dcde fdcd|\nP:Turn\nf2 df e2 ce|dcde f/2f/f3|\n"
    got = notation.sounding_notes(read(spark, text)).orderBy("section", "seq").collect()
    assert [(r.name, r.pitch, r.start_tick, r.bar, r.measure) for r in got if r.seq in (0, 7)] == [("A", 81, 0, 1, 1), ("A", 74, 3840, 2, 2), ("Turn", 78, 0, 1, 1), ("Turn", 73, 4320, 2, 2)]
    assert sum(r.dur_tick for r in got if r.name == "Turn") == 2 * 3840
    short = notation.sounding_notes(read(spark, "X:1\nM:2/4\nK:D\na")).head()
    assert short.dur_tick == 240


def test_a_catalog_says_why_it_leaves_tunes_out(spark, tmp_path):
    good = "X:1\nT:Good\nR:reel\nM:4/4\nL:1/8\nK:AMix\n|:d2 dd d2 de|f2 e2 d4:|\n|:f2 f2 f2 ga|b2 a2 f4:|\n"
    bad = "X:2\nT:Bad Bars\nM:4/4\nL:1/8\nK:D\n|:d2 dd d|\n"
    jig, empty = "X:3\nT:A Jig\nM:6/8\nL:1/8\nK:D\n|:ded cdc|def gfe:|\n", "X:4\nK:D\nz4 z4|\n"
    (tmp_path / "book.abc").write_text(good + bad + jig + empty)
    got = {r.tune: r for r in notation.catalog(sources.read_notation(spark, str(tmp_path))).collect()}
    assert {t: r.reason for t, r in got.items()} == {1: None, 2: "bars", 3: "meter", 4: "empty"}
    assert (got[1].title, got[1].key, got[1].rhythm, [tuple(s) for s in got[1].sections]) == ("Good", "A mixolydian", "reel", [("A", 2), ("B", 2)])
    assert got[2].sections[0].bars is None and got[4].title == "Untitled"
