import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_llm_package():
    from pathlib import Path

    for p in Path(entry.__file__).parent.glob("lodeline/**/*.py"):
        if "llm" not in p.parts:
            assert "lodeline.llm" not in p.read_text(), p


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
