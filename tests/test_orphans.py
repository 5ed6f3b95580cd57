from datetime import datetime

import pytest

from lodestrata.operators import orphans


def t(day, month=1):
    return datetime(2024, month, day)


CHUNKS = "source_file string, page_number int, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
ENTITIES = "entity_id string, company string, entity_name string, source_refs array<string>, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
RELS = "rel_id string, company string, source_entity string, target_entity string, loaded_at timestamp_ntz"


def frames(spark):
    chunks = spark.createDataFrame([("a:b.md", 7, t(1), None), ("a:b.md", 8, t(1), t(5)), ("a:b.md", None, t(1), None)], CHUNKS)
    entities = spark.createDataFrame(
        [
            ("e1", " ACME", "A &amp;  B", ["a:b.md:007:u1", " a:b.md : 7 :u", "a:b.md:9:u", ":7:u", "a:b.md:x:u", "nope", None], t(2), None),
            ("e2", "acme", "C", None, t(2), t(4)),
            ("e3", "acme", "D", ["a:b.md:8:u"], t(6), None),
            ("e4", "acme", "E", [], t(2), None),
        ],
        ENTITIES,
    )
    rels = spark.createDataFrame(
        [("r1", "acme", "a & b", "C", t(3)), ("r2", "Acme ", "c", None, t(4)), ("r3", "other", "E", " ", t(3, 2)), ("r4", "acme", "e", "E", t(3)), ("r5", "acme", "d", "E", t(7)), ("r5", "acme", "d", "E", t(7))],
        RELS,
    )
    return chunks, entities, rels


def test_direct(spark):
    got = {tuple(r) for r in orphans.orphaned_references(*frames(spark)).where("depth = 0").select("ref_table", "row_id", "ref_field", "ref_value").collect()}
    assert got == {
        ("entities", "e1", "source_refs", "a:b.md:9:u"),
        ("entities", "e3", "source_refs", "a:b.md:8:u"),
        ("relationships", "r2", "source_entity", "c"),
        ("relationships", "r3", "source_entity", "E"),
    }


def test_report_separates_inherited(spark):
    got = {(r.ref_table, str(r.month)): (r.n_rows, r.n_direct, r.n_inherited) for r in orphans.monthly_report(*frames(spark)).collect()}
    assert got == {("entities", "2024-01-01"): (4, 2, 0), ("relationships", "2024-01-01"): (4, 1, 2), ("relationships", "2024-02-01"): (1, 1, 0)}


def keys(spark, edges, present):
    """One table ``t`` whose rows refer to each other; ``present`` are the rows that exist."""
    refs = spark.createDataFrame([("t", c, "f", p, "t", p, t(1)) for c, p in edges], "ref_table string, row_id string, ref_field string, ref_value string, parent string, key string, at timestamp_ntz")
    target = spark.createDataFrame([(p, t(1), None, p) for p in present], "key string, valid_from timestamp_ntz, valid_to timestamp_ntz, target_id string")
    return [orphans.ForeignKey("t", "t", refs, target)]


def test_cascade_goes_deep_and_ends_on_cycles(spark):
    edges = [("0", "gone")] + [(str(i + 1), str(i)) for i in range(6)] + [("0", "6"), ("9", "8"), ("8", "9")]
    got = {r.row_id: r.depth for r in orphans.orphan_cascade(keys(spark, edges, [str(i) for i in range(10)])).collect()}
    assert got == {str(i): i for i in range(7)}
    with pytest.raises(RuntimeError):
        orphans.orphan_cascade(keys(spark, edges, [str(i) for i in range(10)]), max_rounds=3)


def test_one_orphaned_parent_is_enough_and_hot_parents_come_once(spark):
    edges = [("p", "gone"), *[(f"c{k}", "p") for k in range(50)], *[(f"c{k}", "q") for k in range(50)]]
    got = [(r.row_id, r.depth) for r in orphans.orphan_cascade(keys(spark, edges, ["p", "p", "q"])).collect()]
    assert sorted(got) == sorted([("p", 0), *[(f"c{k}", 1) for k in range(50)]])


def test_empty(spark):
    chunks, entities, rels = (f.where("false") for f in frames(spark))
    assert orphans.orphaned_references(chunks, entities, rels).count() == 0
    assert orphans.monthly_report(chunks, entities, rels).count() == 0
