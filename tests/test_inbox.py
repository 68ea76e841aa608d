"""The watched folder: what a look does with each file, and that no handled file is opened again."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.sources import readers
from paperloom.streaming import inbox

PNG = bytes.fromhex("89504e470d0a1a0a")


class Box:
    def __init__(self, spark, root, monkeypatch):
        self.spark, self.root, self.number, self.opened = spark, root, 0, []
        self.dir = root / "in"
        self.dir.mkdir()
        read = inbox.contents
        monkeypatch.setattr(inbox, "contents", lambda s, paths: self.opened.extend(os.path.basename(p) for p in paths) or read(s, paths))

    def put(self, name, data, mtime=None):
        (self.dir / name).write_bytes(data)
        if mtime:
            os.utime(self.dir / name, (mtime, mtime))

    def look(self, number=None):
        """Names that this look opened."""
        before = len(self.opened)
        inbox.poll(self.spark, str(self.dir), str(self.root / "ledger"), str(self.root / "polls"), self.number if number is None else number, C.image_like(F.col("content")), str(self.root / "log"))
        self.number += 1
        return sorted(self.opened[before:])

    def ledger(self):
        return sorted((r.name, r.outcome) for r in inbox.ledger_at(self.spark, str(self.root / "ledger")).collect())

    def log(self):
        found = []
        for f in (self.root / "log").glob("*.json"):
            found += [(e["type"], e["name"]) for e in map(json.loads, f.read_text().splitlines())]
        return sorted(found)


@pytest.fixture
def box(spark, tmp_path, monkeypatch):
    return Box(spark, tmp_path, monkeypatch)


def test_each_file_is_opened_once(box):
    box.put("a.png", PNG + b"one")
    box.put("b.png", PNG + b"part")
    box.put("notes.txt", b"no image")
    box.put("clip.gif", b"GIF89a")
    box.put(".hidden.png", PNG)
    (box.dir / "nested").mkdir()
    (box.dir / "nested/deep.png").write_bytes(PNG + b"deep")
    assert box.look() == []
    box.put("b.png", PNG + b"part and more")  # grows
    assert box.look() == ["a.png"]
    assert box.look() == ["b.png"]
    assert [box.look() for _ in range(3)] == [[], [], []]
    assert box.ledger() == [("a.png", "ingested"), ("b.png", "ingested")]
    assert box.log() == [("inbox_ingested", "a.png"), ("inbox_ingested", "b.png")]
    assert sorted(os.listdir(box.dir)) == [".hidden.png", "a.png", "b.png", "clip.gif", "nested", "notes.txt"]
    assert sorted(os.listdir(box.root / "polls")) == ["poll=4", "poll=5"]  # old looks go


def test_rejects_are_remembered(box):
    box.put("empty.png", b"")
    box.put("fake.png", b"this is no image")
    assert box.look() == [] and box.look() == ["fake.png"]
    assert box.look() == [] and box.look() == []
    assert box.ledger() == [("empty.png", "rejected"), ("fake.png", "rejected")]
    assert [t for t, _ in box.log()] == ["inbox_rejected", "inbox_rejected"]
    known = {r.sha256 for r in inbox.ledger_at(box.spark, str(box.root / "ledger")).collect()}
    assert hashlib.sha256(b"").hexdigest() in known


def test_same_content_and_same_name(box):
    box.put("a.png", PNG + b"x", 1_700_000_000)
    assert box.look() == [] and box.look() == ["a.png"]
    box.put("b 1+%.png", PNG + b"x")  # the content again, under a name with marks
    assert box.look() == [] and box.look() == ["b 1+%.png"] and box.look() == []
    assert box.ledger() == [("a.png", "ingested")]
    box.put("a.png", PNG + b"y", 1_700_000_001)  # another content under the name, of the same size
    assert box.look() == [] and box.look() == ["a.png"] and box.look() == []
    assert box.ledger() == [("a.png", "ingested"), ("a.png", "ingested")]


def test_restart_and_repeated_looks(box, spark):
    box.put("[1]{a}.png", PNG + b"once")
    box.look()
    assert box.look() == ["[1]{a}.png"] and box.look(1) == ["[1]{a}.png"]  # a look that failed late runs again: nothing twice
    again = Box.__new__(Box)
    again.__dict__.update(box.__dict__)
    again.number = 10  # a new process goes on from what is stored
    assert again.look() == [] and again.look() == []
    assert box.ledger() == [("[1]{a}.png", "ingested")] and len(box.log()) == 1


def test_file_that_changes_or_goes_while_it_is_read(box, monkeypatch):
    box.put("a.png", PNG + b"a")
    box.put("gone.png", PNG + b"gone")
    box.look()
    read = inbox.contents

    def late(spark, paths):
        box.put("a.png", PNG + b"longer")
        (box.dir / "gone.png").unlink(missing_ok=True)
        return read(spark, paths)

    monkeypatch.setattr(inbox, "contents", late)
    box.look()
    monkeypatch.setattr(inbox, "contents", read)
    assert not (box.root / "ledger").exists() or box.ledger() == []
    box.look()
    box.look()
    assert box.ledger() == [("a.png", "ingested")]
    assert [r.sha256 for r in inbox.ledger_at(box.spark, str(box.root / "ledger")).collect()] == [hashlib.sha256(PNG + b"longer").hexdigest()]


def plain_steps(looks):
    held, out = {}, []
    for poll, name, size, mtime in sorted(looks):
        was = held.get(name)
        same = was is not None and was[0] == poll - 1 and was[1:3] == (size, mtime)
        out.append((poll, name, "wait" if not same else "skip" if was[3] else "read"))
        held[name] = poll, size, mtime, same
    return sorted(out)


def test_steps_in_batch_and_in_a_stream(spark, tmp_path):
    random.seed(8)
    looks = [(p, f"f{k}", random.choice([1, 1, 1, 2]), p // 9) for p in range(40) for k in range(5) if random.random() < 0.9]
    schema = "poll bigint, name string, size bigint, mtime bigint"
    assert sorted(map(tuple, inbox.file_steps(spark.createDataFrame(looks, schema)).collect())) == plain_steps(looks)
    for part in ([x for x in looks if x[0] < 13], [x for x in looks if 10 <= x[0] < 27], [x for x in looks if x[0] >= 25]):  # looks that overlap come again
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "looks"))
        q = inbox.live_steps(spark.readStream.schema(schema).parquet(str(tmp_path / "looks"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(30)
    assert sorted((r.poll, r.name, r.step) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == plain_steps(looks)


def test_images_by_folder_and_path(spark, tmp_path):
    (tmp_path / "some").mkdir()
    (tmp_path / "some/a.png").write_bytes(PNG)
    (tmp_path / "some/b.txt").write_bytes(b"x")
    (tmp_path / "none").mkdir()
    (tmp_path / "none/b.txt").write_bytes(b"x")
    assert [r.name for r in readers.read_test_images(spark, str(tmp_path / "some")).collect()] == ["a.png"]
    with pytest.raises(FileNotFoundError):
        readers.read_test_images(spark, str(tmp_path / "none"))
    assert [bytes(r.content) for r in readers.image_at(spark, str(tmp_path / "some/a.png")).collect()] == [PNG]
    assert readers.image_at(spark, str(tmp_path / "some/gone.png")).count() == 0
