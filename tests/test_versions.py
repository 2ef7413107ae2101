"""Versions of the registry and of snapshots: nobody's change is lost, and readers keep what they have opened."""

import threading
from pathlib import Path

import pytest

from graphloom import files, service
from graphloom.api import App
from graphloom.versions import Conflict, VersionLog


@pytest.fixture()
def app(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def one():\n    two()\n\ndef two():\n    pass\n")
    app = App(spark, str(tmp_path / "home"))
    app.add_service(str(tmp_path / "src"), "s", "first")
    return app


def test_a_version_is_made_once(tmp_path):
    log, other = VersionLog(str(tmp_path / "log")), VersionLog(str(tmp_path / "log"))
    assert log.latest() == (0, None) and log.versions() == []
    log.commit(1, {"a": 1})
    with pytest.raises(Conflict):
        other.commit(1, {"a": 2})
    with pytest.raises(Conflict):
        other.commit(3, {"a": 2})
    other.commit(2, {"a": 3})
    assert log.latest() == (2, {"a": 3}) and log.read(1) == {"a": 1}
    log.forget(2)
    log.forget(1)
    assert log.versions() == [2] and sorted(p.name for p in (tmp_path / "log").iterdir()) == ["000000000002.json"]


def test_of_many_writers_one_makes_a_version(tmp_path):
    log, won, start = VersionLog(str(tmp_path / "log")), [], threading.Barrier(8)

    def write(i):
        start.wait()
        try:
            VersionLog(log.folder).commit(1, {"writer": i})
            won.append(i)
        except Conflict:
            pass

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.read(1) == {"writer": won[0]} and files.names(log.folder) == ["000000000001.json"]


def test_writers_of_the_registry_lose_nothing(tmp_path):
    one, two = service.Registry(str(tmp_path)), service.Registry(str(tmp_path))
    one.add("s", "/x")
    two.update("s", description="told")  # made from what is there, not from what was read
    one.update("s", main_entities=["E"])
    assert service.Registry(str(tmp_path)).get("s") == {"rootAbs": "/x", "description": "told", "mainEntities": ["E"]}
    two.services["s"]["description"] = "stale"
    with pytest.raises(Conflict):
        two.save()
    with pytest.raises(ValueError, match="exists"):
        two.add("s", "/y")
    threads = [threading.Thread(target=lambda i=i: service.Registry(str(tmp_path)).add(f"t{i}", "/z")) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert service.Registry(str(tmp_path)).names() == ["s", *[f"t{i}" for i in range(6)]]
    for _ in range(30):
        one.update("s", description="again")
    assert len(one.log.versions()) <= one.KEPT + 1


def test_readers_outlive_syncs(spark, app, tmp_path):
    opened = service.open_index(spark, app.registry, "s")
    calls, nodes = opened.edges_calls, opened.nodes.where("kind = 'method'")
    for text in ("def three():\n    pass\n", "x = 1\n"):
        (tmp_path / "src" / "a.py").write_text(text)
        app.sync("s")
    assert calls.count() == 1 and {r["name"] for r in nodes.collect()} == {"<module>", "one", "two"}
    assert {r["name"] for r in service.open_index(spark, app.registry, "s").nodes.collect()} == {"<module>"}
    assert [h["version"] for h in service.history(app.registry, "s")] == [1, 2, 3]
    assert {r["name"] for r in service.open_index(spark, app.registry, "s", 2).nodes.collect()} == {"<module>", "three"}
    with pytest.raises(KeyError):
        service.open_index(spark, app.registry, "s", 7)


def test_the_slower_of_two_syncs_is_refused(spark, app, monkeypatch):
    write = service.write_index

    def overtaken(*args, **more):
        monkeypatch.setattr(service, "write_index", write)
        app.sync("s", full=True)  # another writer, while this one works
        return write(*args, **more)

    monkeypatch.setattr(service, "write_index", overtaken)
    with pytest.raises(Conflict):
        app.sync("s", full=True)
    folder = Path(app.registry.dir("s"))
    assert [h["version"] for h in service.history(app.registry, "s")] == [1, 2] and len(list(folder.glob("index-*"))) == 2
    assert app.stats("s")["files"] == 1


def test_keep_time_and_wipe(spark, app):
    old = service.open_index(spark, app.registry, "s").nodes.count()
    assert service.wipe(spark, app.registry, "s").nodes.count() == 0 and app.stats("s")["files"] == 0
    assert service.open_index(spark, app.registry, "s", 1).nodes.count() == old == 3
    folder = Path(app.registry.dir("s"))
    left = folder / "index-1000-00ff"
    left.mkdir()
    assert service.vacuum(app.registry, "s") == ["index-1000-00ff"] and not left.exists()
    assert len(service.vacuum(app.registry, "s", 0)) == 1 and [h["version"] for h in service.history(app.registry, "s")] == [2]
    assert len(list(folder.glob("index-*"))) == 1 and app.sync("s")["files"] == 1
