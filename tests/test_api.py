"""A collection end to end, through the API and the command line."""

import json

import pytest

from larkspur import __main__ as cli
from larkspur import config
from larkspur.api import Collection
from larkspur.operators.schema import load_overlay

OVERLAY = """
fields:
  label: {type: formula, formula: "kind + ':' + title", result_type: string}
scopes:
  boats:
    fields:
      crew_size: {type: rollup, relation_field: boat, target_field: hands, relation_direction: incoming, relation_scope: trips, formula: "values.reduce((sum, value) => sum + value, 0)", result_type: number}
      trips: {type: rollup, relation_field: boat, target_field: hands, relation_direction: incoming, relation_scope: trips, formula: values.length, result_type: number}
  trips:
    fields:
      boat: {type: relation, target: boats}
      harbour: {type: lookup, relation_field: boat, target_field: home}
      label: {type: formula, formula: "'trip of ' + String(nights)", result_type: string}
  trips/winter:
    fields:
      label: {type: formula, formula: "'winter trip'", result_type: string}
      harbour: {type: lookup, relation_field: boat, target_field: kind}
"""
DOCS = {
    "boats/heron.md": "---\nkind: ketch\nhome: Brest\n---\n# Heron\nA ketch for long crossings, skippered by [[../people/ines]].\n",
    "boats/plover.md": "---\nkind: sloop\nhome: Cork\n---\n# Plover\nA sloop that stays near the coast.\n",
    "people/ines.md": "# Ines\nSails **Heron** and writes the [log](../trips/june.md).\n",
    "trips/june.md": "---\nboat: '[[heron]]'\nhands: 4.5\nnights: 12\n---\nCrossing with steady wind.\n",
    "trips/winter/storm.md": "---\nboat: '[[boats/heron]]'\nhands: 3\nnights: 2\n---\nA crossing cut short by a storm.\n",
    "trips/winter/odd.md": "---\nhands: 1\n---\nOn foot.\n",
    "drafts/idea.md": "crossing ideas that nobody should find\n",
}


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logbook")
    for name, text in DOCS.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".gitignore").write_text("drafts/\n")
    c = Collection(spark, str(root), str(root / ".store"), overlay=load_overlay(OVERLAY))
    c.ingest()
    return c


def test_search_and_get(vault):
    got = [r.path for r in vault.search("crossings wind", mode="lexical").collect()]
    assert set(got) == {"boats/heron.md", "trips/june.md", "trips/winter/storm.md"} and got[0] == "trips/june.md"
    assert [r.path for r in vault.search('"steady wind"', mode="lexical").collect()] == ["trips/june.md"]
    assert [r.path for r in vault.search("+crossing -storm", mode="lexical", scope="trips").collect()] == ["trips/june.md"]
    assert vault.search("heron", mode="semantic", filters=["nights=12"]).count() == 1
    assert {r.source for r in vault.search("log", mode="edge").select("source").collect()} == {"boats/heron.md", "people/ines.md"}
    assert json.loads(vault.get("boats/plover.md").head().metadata) == {"kind": "sloop", "home": "Cork"}


def test_lexical_search_reads_the_index_only(vault):
    plan = vault.search("storm", mode="lexical")._jdf.queryExecution().toString()
    assert "In(stem" in plan or "EqualTo(stem" in plan
    scores = vault.index().terms.where("term = 'heron'").select("chunk_id", "field", "tf", "stem").collect()
    assert sorted(tuple(r) for r in scores) == [("boats/heron.md#0", "c", 1, "heron"), ("boats/heron.md#0", "h", 1, "heron"), ("people/ines.md#0", "c", 1, "heron")]


def test_graph(vault):
    assert {(r.target, r.state) for r in vault.links("boats/heron.md").collect()} == {("people/ines.md", "Valid")}
    assert [r.source for r in vault.backlinks("people/ines.md").collect()] == ["boats/heron.md"]
    assert sorted(r.path for r in vault.orphans().collect()) == ["boats/plover.md", "trips/winter/odd.md"]
    assert [(r.source, r.field) for r in vault.referenced_by("boats/heron.md").collect()] == [("trips/june.md", "boat"), ("trips/winter/storm.md", "boat")]
    assert vault.edges().count() == 2 and vault.edges("people/ines.md").count() == 2
    assert {r.state for r in vault.tree().where("NOT is_dir").collect()} == {"indexed"}


def test_scoped_modules_and_collection(vault):
    rows = vault.run_modules().collect()
    good = {(r.path, r.field): json.loads(r.value) for r in rows if r.code is None}
    bad = {(r.path, r.field): r.code for r in rows if r.code is not None}
    assert good == {
        ("trips/june.md", "harbour"): "Brest", ("trips/winter/storm.md", "harbour"): "ketch", ("trips/winter/odd.md", "harbour"): None,
        ("boats/heron.md", "crew_size"): 7.5, ("boats/heron.md", "trips"): 2, ("boats/plover.md", "crew_size"): 0, ("boats/plover.md", "trips"): 0,
        ("boats/heron.md", "label"): "ketch:heron", ("boats/plover.md", "label"): "sloop:plover",
        ("trips/june.md", "label"): "trip of 12", ("trips/winter/storm.md", "label"): "winter trip", ("trips/winter/odd.md", "label"): "winter trip",
    }
    assert bad == {("people/ines.md", "label"): "unknown_identifier"}
    page, columns, total = vault.collection(path="boats", sort="crew_size", descending=True)
    assert [r.path for r in page.collect()] == ["boats/heron.md", "boats/plover.md"] and total.head().total == 2
    assert json.loads(page.head().metadata)["crew_size"] == 7.5 and {"kind", "home", "crew_size", "trips", "label"} <= {r.name for r in columns.collect()}
    trips, _, _ = vault.collection(path="trips", recursive=True, populate=True)
    assert trips.where("path = 'trips/june.md'").head().relations["boat"][0].target == "boats/heron.md"
    assert {r.field: (r.done, r.failed) for r in vault.module_status().collect()} == {"crew_size": (2, 0), "harbour": (3, 0), "label": (5, 1), "trips": (2, 0)}


def test_clusters_status_doctor(vault):
    s = vault.status().head()
    assert (s.files, s.chunks, s.vectors) == (6, 6, 6) and vault.status("trips").head().files == 3
    assert {r.check for r in vault.doctor().where("ok").collect()} >= {"bad_metadata", "chunks_without_vector", "vector_sizes"}
    found = vault.clusters()
    assert found["members"].count() == 6 and found["labels"].count() >= 1
    ids = {r.path: r.cluster_id for r in found["members"].collect()}
    again = vault.clusters()
    assert {r.path: r.cluster_id for r in again["members"].collect()} == ids  # the same clusters keep their ids
    assert {r.cluster_id for r in again["parents"].collect()} == {r.cluster_id for r in again["labels"].collect()} == set(ids.values())
    vault.add_shard("Cold", "trips/winter")
    assert vault.search("crossing", mode="lexical", shard="cold").count() == 1
    assert Collection(vault.spark, vault.root, vault.store.path).shards.get("cold").path == "trips/winter"
    assert [(r.shard, r.files) for r in vault.shard_table().collect()] == [("cold", 2)]
    vault.set_topic("weather", "storm and wind", 0.1, new=True)
    with pytest.raises(ValueError):
        vault.set_topic("weather", "x", new=True)
    vault.set_topic("weather", seeds=("trips/june.md",))
    assert [(r.topic, r.description, r.seeds) for r in vault.topic_table().collect()] == [("weather", "storm and wind", ["trips/june.md"])]
    assigned, _ = vault.topics(vault.topic_definitions())
    assert assigned.where("path = 'trips/june.md'").count() == 1
    vault.remove_topic("weather")
    assert vault.topic_table().count() == 0


def test_clusters_follow_documents(spark, tmp_path):
    for i in range(8):
        (tmp_path / "v").mkdir(exist_ok=True)
        (tmp_path / "v" / f"{i}.md").write_text(f"note number {i}")
    c = Collection(spark, str(tmp_path / "v"), str(tmp_path / "s"))
    c.ingest()
    before = {r.path: r.cluster_id for r in c.clusters()["members"].collect()}
    (tmp_path / "v" / "8.md").write_text("another note")
    (tmp_path / "v" / "0.md").unlink()
    c.ingest()
    after = {r.path: r.cluster_id for r in c.follow_clusters().collect()}
    assert after.keys() == (before.keys() | {"8.md"}) - {"0.md"} and all(after[p] == before[p] for p in after if p in before)
    assert c.store.read("cluster_state").head().changes == 2 and after["8.md"] in before.values()
    c.follow_clusters(threshold=2)
    assert c.store.read("cluster_state").head().changes == 0


def test_command_line(vault, spark):
    root = vault.root
    base = [root, "--store", f"{root}/.store"]
    for argv, want in ((["search", "crossing", "--mode", "lexical", "--limit", "1"], 1), (["collection", "boats", "--sort", "home"], 2), (["backlinks", "people/ines.md"], 1), (["schema"], 4), (["ingest", "--preview"], 1), (["info"], 1), (["config"], 10)):
        got = cli.run(cli.arguments([*base, *argv]), spark)
        assert next(iter(got.values())).count() >= want


def test_settings_reach_ingest(spark, tmp_path):
    for name, text in (("a/one.md", "word " * 30), ("b/two.md", "two"), ("a/skip.md", "x")):
        (tmp_path / "v" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / name).write_text(text)
    c = Collection(spark, str(tmp_path / "v"), str(tmp_path / "s"), config.Config(source_dirs=("a",), ignore_patterns=("skip",), chunk_max_tokens=10, chunk_overlap_tokens=2))
    c.ingest()
    assert [r.path for r in c.files().collect()] == ["a/one.md"] and c.chunks().count() == 4
    (tmp_path / "v" / "a" / "one.md").write_text("new")
    (tmp_path / "v" / "a" / "three.md").write_text("three")
    assert {r.change: r.files for r in c.ingest(file="a/one.md").collect()} == {"reembed": 1}
    assert sorted(r.content for r in c.chunks().collect()) == ["new"]
    assert {r.change: r.files for r in c.ingest().collect()} == {"new": 1, "unchanged": 1}


def test_config(tmp_path):
    (tmp_path / "p.yml").write_text("search_limit: 7\nignore_patterns: [drafts/]\n")
    got = config.load(str(tmp_path / "p.yml"), env={"LARKSPUR_SEARCH_LIMIT": "9", "LARKSPUR_DECAY": "true"})
    assert got.search_limit == 9 and got.decay and got.ignore_patterns == ("drafts/",)
    (tmp_path / "bad.yml").write_text("nope: 1\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "bad.yml"), env={})
    with pytest.raises(ValueError):
        config.load(env={"LARKSPUR_CHUNK_OVERLAP_TOKENS": "600"})
