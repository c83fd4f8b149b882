"""A folder of old pages, read into collections and a review queue."""

from shelfmark.sources import legacy


def page(*paragraphs, more=""):
    return "<html><body>" + "".join(f"<p>{p}" for p in paragraphs) + more + "</body></html>"


def test_folder_of_pages(spark, tmp_path):
    root = tmp_path / "alte seiten+1"
    files = {
        "作曲家/Bach/Bach.htm": page("巴赫 (J. S. Bach)", "Born.", " ", "Died &amp; buried."),
        "作曲家/Bach/协奏曲/钢琴协奏曲/No 1/a.htm": page("时间地点：1950, Wien", "指挥：<a href='/x'>Karl B&ouml;hm</a>", "专辑：Alpha", more="<div><img src='1.jpg'><a href='https://www.youtube.com/x'>v</a>"),
        "作曲家/Bach/协奏曲/钢琴协奏曲/No 1/b.HTM": page("钢琴: -", "nothing said"),
        "作曲家/Bach/协奏曲/钢琴协奏曲/No 1/No 1.htm": page("First Concerto (Erstes Konzert)", "A work."),
        "作曲家/Bach/stray.htm/x.htm": page("Label：B"),
        "作曲家/Liszt/Etudes/Wild Hunt/c.htm": page("Date: 1990", "Orchestra：Radio"),
        "指挥家/Karl Böhm.htm": page("Karl Böhm（伯姆）", "Conducted."),
        "独奏家/piano/Karl Böhm.htm": page("no name here", "Played, too."),
        "独奏家/piano/Anna.htm": page(),
        "作曲家/Bach/notes.txt": "not a page",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = legacy.pages(spark, str(root))
    assert {r.path for r in found.collect()} == {f for f in files if f.lower().endswith(".htm")}
    lib = {k: [r.asDict(True) for r in df.collect()] for k, df in legacy.imported(found).items()}
    composers = {c["name"]: c for c in lib["composers"]}
    assert set(composers) == {"Bach", "Liszt"}
    assert (composers["Bach"]["nameLatin"], composers["Bach"]["aliases"], composers["Bach"]["summary"]) == ("J. S. Bach", ["巴赫"], "Born.\n\nDied & buried.")
    people = {p["name"]: p for p in lib["people"]}
    assert set(people) == {"Karl Böhm", "Anna"} and people["Karl Böhm"]["roles"] == ["conductor", "soloist"]
    assert (people["Karl Böhm"]["nameLatin"], people["Karl Böhm"]["summary"]) == ("伯姆", "Conducted.")
    assert sorted(g["title"] for g in lib["workGroups"]) == ["Etudes", "协奏曲", "钢琴协奏曲"]
    works = {w["title"]: w for w in lib["works"]}
    assert set(works) == {"First Concerto", "Wild Hunt"} and works["First Concerto"]["summary"] == "A work."
    assert [g.split("/")[-1] for g in works["First Concerto"]["groupIds"]] == ["协奏曲", "钢琴协奏曲"]
    assert set(works["First Concerto"]["groupIds"]) | set(works["Wild Hunt"]["groupIds"]) == {g["id"] for g in lib["workGroups"]}
    recordings = {r["title"]: r for r in lib["recordings"]}
    assert set(recordings) == {"a", "b", "c"} and recordings["a"]["workId"] == works["First Concerto"]["id"]
    a = recordings["a"]
    assert (a["performanceDateText"], a["venueText"], a["albumTitle"]) == ("1950", "Wien", "Alpha")
    assert [(c["role"], c["displayName"]) for c in a["credits"]] == [("conductor", "Karl Böhm")] and a["links"][0]["platform"] == "youtube"
    issues = {(r["sourcePath"].split("/")[-1], r["issue"]) for r in lib["review"]}
    assert issues == {
        ("b.HTM", "missing-performance-date"), ("b.HTM", "missing-image"), ("b.HTM", "missing-album-metadata"), ("c.htm", "missing-image"), ("c.htm", "missing-album-metadata"), ("x.htm", "unsupported-path"),
    }
    assert all(df.count() == 0 for df in legacy.imported(found.limit(0)).values())
