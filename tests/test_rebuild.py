"""A graph rebuild: lasting ids, edges of today's rules, retirement and revival, and a fixed point."""

from __future__ import annotations

from cairnbook.operators import rebuild

OBJECTS = "object_id string, object_class string, source_id string, account_id string, native_path string, body string"
URLS = "object_id string, normalized_url string, domain string"


def run(spark, objects, urls, old, high):
    out = rebuild.rebuild(spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(urls, URLS), old["entities"], old["edges"], high)
    rows = {k: sorted(map(tuple, v.collect()), key=str) for k, v in out.items()}
    return {k: spark.createDataFrame(rows[k], v.schema) for k, v in out.items()}, rows


def test_rebuilds(spark):
    a = ("o1", "File", "workspace", "me", "/home/x/notes/a", "we read alpha.example today")
    b = ("o2", "Conversation", None, "me", "/home/x/plans/b", None)
    many = [(f"m{k}", "File", None, None, None, "nothing here") for k in range(60)]
    page = ("u1", "http://alpha.example/", "www.alpha.example")
    entities, edges = rebuild.empty_graph(spark)
    edges = spark.createDataFrame([("o1", "x", "PART_OF", "job:1"), ("o1", "gone", "STORED_IN", "rule:old")], edges.schema)
    one, rows = run(spark, [a, b, *many], [page], {"entities": entities, "edges": edges}, 10)
    assert [(r[0], r[1], r[2], r[4]) for r in rows["entities"]] == [
        ("KB-00000011", "Account", "me", "CURRENT"), ("KB-00000012", "Domain", "alpha.example", "CURRENT"), ("KB-00000013", "Folder", "notes", "CURRENT"), ("KB-00000014", "Folder", "plans", "CURRENT"),
        ("KB-00000015", "Workspace", "workspace", "CURRENT"),
    ]
    assert {e[:3] for e in rows["edges"]} == {
        ("o1", "x", "PART_OF"), ("u1", "KB-00000012", "HOSTED_AT"), ("o1", "KB-00000012", "MENTIONS"), ("o1", "KB-00000015", "BELONGS_TO"), ("o2", "KB-00000011", "BELONGS_TO"),
        ("o1", "KB-00000013", "STORED_IN"), ("o2", "KB-00000014", "STORED_IN"),
    }
    assert len(rows["provenance"]) == 5
    # the same again: a fixed point
    again, same = run(spark, [a, b, *many], [page], one, 15)
    assert same["entities"] == rows["entities"] and same["edges"] == rows["edges"] and same["provenance"] == []
    # the page and a folder go, then come back; a word becomes too frequent to be mentioned
    c = ("o3", "File", None, None, "/home/x/misc/c", None)
    frequent = [(*m[:5], "workspace") for m in many]
    two, rows = run(spark, [a, c, *frequent], [], again, 15)
    state = {(r[1], r[2]): r[4:] for r in rows["entities"]}
    assert state[("Account", "me")] == ("SUPERSEDED", False, 2) and state[("Folder", "plans")] == ("SUPERSEDED", False, 2)
    assert state[("Workspace", "workspace")] == ("CURRENT", True, 2) and state[("Domain", "alpha.example")] == ("CURRENT", False, 1)
    assert ("Folder", "misc") in state and {p[2] for p in rows["provenance"]} == {"graph:retire-orphan", "graph:mention-saturation", "graph:folder-from-path"}
    _, rows = run(spark, [a, b, *many], [page], two, 16)
    state = {(r[1], r[2]): r[0] for r in rows["entities"] if r[4] == "CURRENT"}
    assert state[("Account", "me")] == "KB-00000011" and state[("Folder", "plans")] == "KB-00000014"
    assert ("KB-00000011:v03", "KB-00000011", "graph:revive") in rows["provenance"]
