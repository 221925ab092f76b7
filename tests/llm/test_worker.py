"""A reused worker holds the tables of one operator only."""

from framelight.llm import worker
from framelight.llm.words import blocks


def test_another_owner_drops_tables():
    dropped = []
    worker.enter("first", lambda: dropped.append("first"))
    worker.enter("first", lambda: dropped.append("first"))
    assert dropped == []
    worker.enter("second")
    worker.enter("second")
    assert dropped == ["first"]
    worker.enter("first", lambda: dropped.append("again"))
    list(blocks([b"x"]))
    assert dropped == ["first", "again"]
