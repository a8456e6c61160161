"""Boilerplate in the places where it usually stands."""

from nightloom.llm import lines

BLOCK = ["We use cookies.", "Read our policy.", "Choose what we may store.", "Accept all"]


def test_paragraphs_and_blocks_go_and_copies_stay(spark):
    """Lines set off by blank lines, and every line of a fixed block, on 12 sites in 48 texts; copies of a text stay."""
    rows = [(k, f"unique {k} start\n\nShare this page!\n\nunique {k} end\n" + "\n".join(BLOCK), f"site{k % 12}") for k in range(48)]
    rows += [(100 + k, "one copy\n\nof a whole text", f"site{k % 12}") for k in range(36)]
    rows += [(200 + k, f"own {k}\n\non nine sites\n\nown too {k}", f"site{k % 9}") for k in range(36)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for k, text, _ in rows:
        assert got[k]["text"] == (f"unique {k} start\n\n\nunique {k} end" if k < 100 else text)
        assert got[k]["n_removed"] == (5 if k < 100 else 0)
