"""JSON item files as a stream: unreadable lines aside, newest version of an item, files archived."""

import json
import os

from agora.streaming import streams as S


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def test_items_broken_lines_and_versions(spark, tmp_path):
    folder, archive, work = (str(tmp_path / d) for d in ("in", "archive", "work"))
    good = {"id": 1, "type": "comment", "text": "line\nbreak", "by": "a", "score": 2, "time": 5, "kids": [3, 4], "extra": 9}

    def run():
        items, broken = S.run_items(S.item_stream(spark, folder, archive), "items", work)
        newest = {r["id"]: r["score"] for r in S.latest_items(items).collect()}
        return newest, sorted((r["reason"], r["line"]) for r in broken.collect()), items

    os.makedirs(folder)
    assert run()[:2] == ({}, [])
    put(folder, "a.json", [json.dumps(good), '{"id": 2, "score": ', "", '{"score": 1}', '{"id": 3, "score": "x"}', '{"id": 4}'])
    newest, broken, items = run()
    assert newest == {1: 2, 4: None}
    assert [r for r, _ in broken] == ["no id", "unreadable", "unreadable"]
    assert broken[1][1] == '{"id": 2, "score": ' and broken[2][1] == '{"id": 3, "score": "x"}'
    row = items.where("id = 1").first()
    assert row["text"] == "line\nbreak" and row["kids"] == [3, 4] and row["source_file"].endswith("a.json")
    put(folder, "b.json", [json.dumps({**good, "score": 8}), json.dumps({**good, "score": 8}), '{"id": 2, "score": 1}'])
    assert run()[0] == {1: 8, 2: 1, 4: None}
    again = run()  # nothing new: nothing changes
    assert again[0] == {1: 8, 2: 1, 4: None} and again[2].count() == 5
    assert not os.path.exists(f"{folder}/a.json")
