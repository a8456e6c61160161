"""Tables between steps."""


def test_memory_is_given_back_after_each_staged_table(spark, monkeypatch):
    from nightloom.sources import staging

    seen = []
    monkeypatch.setattr(staging, "trimmed", lambda s: seen.append(s))
    assert staging.staged(spark.range(3), "test").count() == 3 and seen == [spark]
    staging.released()
