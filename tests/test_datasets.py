"""Folders of recordings with parts missing or broken."""

from cadenza.sources import datasets

TUNE = "X:1\nT:Good\nM:2/2\nL:1/8\nK:AMix\n|:d2 dd d2 de|f2 e2 d4:|\n|:f2 f2 f2 ga|b2 a2 f4:|\n"


def test_folders_are_rows_whatever_is_in_them(spark, tmp_path):
    made = {
        "whole": {"recording.wav": "x", "recording.m4a": "y", "expected.abc": TUNE, "meta.json": '{"key": "D major", "tempo_bpm": 124, "form": "AABB"}', "notes.txt": "z"},
        "plain": {"recording.ogg": "x", "expected.abc": TUNE}, "mute": {"expected.abc": TUNE.replace("d4", "d3")}, "lost": {"recording.mp3": "x"}, "xml": {"recording.flac": "x", "expected.xml": "<a/>"},
        "torn": {"recording.wav": "x", "expected.abc": TUNE, "meta.json": '{"key": '},
    }
    for slug, files in made.items():
        (tmp_path / slug).mkdir()
        for name, said in files.items():
            (tmp_path / slug / name).write_text(said)
    folders = datasets.dataset_folders(spark, str(tmp_path))
    got = {r.slug: r for r in folders.collect()}
    assert set(got) == set(made) and got["whole"].recording.endswith("/whole/recording.m4a") and got["whole"].text == TUNE
    assert {s: (r.missing, r.broken) for s, r in got.items()} == {"whole": ([], []), "plain": ([], []), "mute": (["recording"], []), "lost": (["truth"], []), "xml": ([], []), "torn": ([], ["meta"])}
    assert got["plain"].meta is None and got["torn"].meta is None and got["xml"].text is None and got["xml"].truth.endswith("expected.xml")
    truth = {r.slug: r for r in datasets.dataset_truth(folders).collect()}
    assert set(truth) == {"whole", "plain", "mute", "torn"} and truth["mute"].reason == "bars"
    assert tuple(truth["whole"])[1:6] == ("D major", "2/2", 124.0, "AABB", ["key", "tempo", "form"]) and truth["whole"].reason is None
    assert (truth["plain"].key, truth["plain"].form, truth["plain"].told) == (None, "ABAB", [])


def test_no_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "other.txt").write_text("x")
    assert datasets.dataset_folders(spark, str(tmp_path)).count() == 0
