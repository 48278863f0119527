import pytest

from palimpsest.memory import Memory
from palimpsest.operators import search


@pytest.fixture
def memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.load(spark.createDataFrame([(i, f"note {i} about the {w} cache", s, "", f"2024-01-{i:02d}") for i, (w, s) in enumerate([("query", "Ann"), ("write", "Bob"), ("query", "Bob"), ("read", "Cy")], 1)] + [(9, "  ", "x", "", "")], "id bigint, content string, sender string, recipient string, timestamp string"))
    return m


def test_crud(memory):
    assert memory.stats()["messages"] == 4
    new = memory.add("always answer in French", directive=True)
    assert new == 5 and memory.add("always answer in French", directive=True) == 5 and memory.add("   ") is None
    assert memory.update(2, "changed text") and memory.get(2)["content"] == "changed text" and not memory.update(77, "x")
    assert memory.delete([1, 99]) == 1 and memory.get(1) is None
    assert memory.delete_sender("bob") == 2
    memory.compact()
    assert sorted(r["id"] for r in memory.get_all().collect()) == [4, 5]
    assert [r["id"] for r in memory.directives().collect()] == [5]
    with pytest.raises(ValueError):
        memory.add("x" * 60_000)


def test_searches(memory):
    assert [r["id"] for r in memory.search_simple("query", 2).collect()] in ([1, 3], [3, 1])
    got = memory.search("what did Bob say about the query cache", 3)
    assert got.first()["id"] == 3 and got.columns[0] == "id"
    assert {r["sender"] for r in memory.search("cache", 5, sender="Ann").collect()} == {"Ann"}
    assert memory.search_deep("query cache", 2).count() == 2
    assert memory.search("cache", 3, rerank=search.lexical_rerank).count() == 3


def test_empty_store(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "e"))
    assert m.search("anything").count() == 0 and m.get(1) is None and m.delete([1]) == 0 and m.stats()["messages"] == 0
